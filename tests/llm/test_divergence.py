"""The source divergence audit against dense sums over every term and group."""

import random
import re
from collections import Counter, defaultdict

import pytest
from llm_fixtures import ODD, lower

from spindrift.llm import divergence


def brute(rows, min_docs, top):
    """Every group's probability of every kept term, and every pair's sum."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        there = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in there.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for own, source, terms in docs:
            if own == lang:
                counts[source].update(t for t in terms if t in set(kept))
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for source, own in counts.items():
            pairs = sorted(((-sum(f(p(own, t), p(c, t)) for t in kept), other) for other, c in counts.items() if other != source), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p(own, t), p(whole, t)), t) for t in kept if own[t] and p(own, t) > p(whole, t)), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, "pair", item, -v, k) for k, (v, item) in enumerate(pairs, 1)]
            out += [(lang, source, "term", item, -v, k) for k, (v, item) in enumerate(terms[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("x", "É", "ß", "K", "aa") for b in "abcdefghijkl"]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 60))) for _ in range(160)]
    made = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "S9", None, ""]), t) for t in texts]
    alone = [("it", "only", "Uno due")] * 12 + [("pt", "p1", "rare"), ("pt", "p2", None)]
    return made + [("en", "s1", t) for t in ODD] + made[:20] + alone + [(None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "z", 1) for i, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string, item string, rank int").repartition(4)


@pytest.mark.parametrize("min_docs, top, held, tile", [(10, 10, 1 << 18, 512), (2, 3, 5, 2), (1, 1, 40, 1)])
def test_audit_equals_dense_sums(spark, rows, monkeypatch, min_docs, top, held, tile):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "TILE", tile)
    got = divergence.audit(frame(spark, rows), min_docs, top).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute(rows, min_docs, top)
    assert divergence.audit(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("few, sent", [(4096, 1 << 20), (2, 1 << 20), (6, 0)])
def test_selection_by_bits_and_bytes(spark, monkeypatch, few, sent):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", sent)
    rng = random.Random(few)
    start = "common beginning of all é"
    words = sorted({start + "".join(rng.choice("abÿ\U0001f600") for _ in range(rng.randrange(0, 7))) for _ in range(150)} | {start[:5]})
    rows = [(g, w, rng.choice([0, 1, 1, 5, 1023, 1024, (1 << 30) - 1, 1 << 20])) for g in range(6) for w in rng.sample(words, [len(words), 90, 40, 10, 9, 1][g])]
    rows += [(9, w, 7) for w in words]
    got = divergence.top(spark.createDataFrame(rows, "gid bigint, term string, value bigint"), 10, few).collect()
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))
        want += [(*r, k) for k, r in enumerate(own[:10], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_probabilities_are_exact(spark):
    rng = random.Random(2)
    cases = [(0, 2), (10**15, 9 * 10**15), (5, 7), (0, 10**15)] + [(rng.randrange(0, n), n + rng.randrange(2, 10**6)) for n in (10, 10**4, 10**9, 10**14) for _ in range(20)]
    got = spark.createDataFrame(cases, "c bigint, n bigint").select("c", "n", divergence.probability(divergence.F.col("c"), divergence.F.col("n")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 2) // r.n for r in got)
