"""Balanced sampling: targets by plain fractions, totals kept, whole documents but for one a source."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from llm_fixtures import ODD, words

from spindrift.llm import mixing


def plain_targets(sizes):
    """Shares by weight; what the capped ones leave is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | {s: float(v) for s, v in share.items()}
        for s in over:
            out[s] = float(2 * sizes[s])
            left -= 2 * sizes[s]
        open_ -= set(over)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    made = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), rng.choice(["a", "b", "c", "d", "é", "Z", None, ""])) for i in range(600)]
    same = [(7000, "one two three", "b")] * 350 + [(7001, "four", None)] * 40 + [(None, "five six", "a")] * 9
    return made + same + [(8000 + i, t, "odd") for i, t in enumerate(ODD)] + [(9000, None, "empty"), (9001, "", "empty"), (None, None, None)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "n", "t") for r in rows], "doc_id bigint, text string, source string, taken string, rank string").repartition(parts)


@pytest.mark.parametrize("block", [1024, 7])
def test_mix_hits_its_targets(spark, rows, block):
    got = mixing.mix(frame(spark, rows), block).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len(words(t))) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = plain_targets(sizes)
    for s, own in sizes.items():
        mine = [r for r in got if r.source == s]
        assert {(r.source_size, r.target) for r in mine} == {(own, target[s])}
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
        times = target[s] / own if own else 0
        cut = [r for r in mine if r.taken != r.copies * r["size"]]
        assert len(cut) <= 1 and all(r.copies in (int(times), int(times) + 1, 2) and 0 <= r.taken <= 2 * r["size"] for r in mine)
        assert abs(sum(r.copies for r in mine) - times * len(mine)) <= 3
    again = mixing.mix(frame(spark, list(reversed(rows)), 5), block).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_empty_tables_and_sources_without_words(spark, rows):
    assert mixing.mix(frame(spark, rows).limit(0)).collect() == []
    got = mixing.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert {(r.source_size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}
    (one,) = mixing.mix(frame(spark, [(1, "w " * 11, None)])).collect()
    assert (one["size"], one.target, one.taken) == (11, 16.5, 17)


def test_targets_over_many_sources(spark):
    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        sizes = {f"s{i}": int(rng.paretovariate(0.6)) for i in range(n)} | {None: rng.randrange(100)}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(3)).collect()
        assert {r.source: r.target for r in got} == plain_targets(sizes)


def test_a_flight_keeps_documents_and_words():
    rng = random.Random(3)
    for n in (1, 2, 3, 40, 500):
        sizes = [rng.choice([1, 1, 2, 5, 100, rng.randrange(1, 5000)]) for _ in range(n)]
        p = rng.uniform(0.05, 0.95)
        units = [[p, s] for s in sizes]
        mixing.flight(units, f"x{n}")
        assert abs(sum(u[0] for u in units) - p * n) < 1e-6 and abs(sum(u[0] * u[1] for u in units) - p * sum(sizes)) < 1e-3
        assert sum(0 < u[0] < 1 for u in units) <= 2


def test_a_flight_draws_each_document_by_its_probability():
    hits, sizes, turns = [0] * 12, [3, 9, 9, 14, 2, 2, 70, 8, 5, 21, 4, 4], 4000
    for turn in range(turns):
        units = [[0.3, s, i] for i, s in enumerate(sizes)]
        mixing.flight(units, f"t{turn}")
        for p, _, i in units:
            hits[i] += p
    assert all(abs(h / turns - 0.3) < 0.04 for h in hits)


def test_the_landing_takes_whole_documents_and_cuts_one():
    for left in ([], [[0.4, 10]], [[0.5, 10], [0.5, 4]], [[0.9, 10], [0.9, 4]], [[0.1, 10], [0.2, 4]], [[0.99, 3], [0.01, 900]]):
        taken = mixing.landing(left)
        assert sum(taken) == round(sum(p * s for p, s in left)) and sum(t not in (0, s) for t, (_, s) in zip(taken, left)) <= 1
