"""Pools, ranks and metrics by their properties and against plain counts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import expr as X
from spindrift.operators import bm25, retrieval
from spindrift.plans.registry import table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def library(spark, sizes):
    """Videos v0, v1, ... of these sizes; a question about each, and a second one about every third."""
    chunks = spark.createDataFrame([(f"v{v}", i) for v, n in enumerate(sizes) for i in range(n)], "vid string, idx int")
    asked = [(f"q{v}{x}", f"v{v}", (v * 7) % n) for v, n in enumerate(sizes) for x in ("", "b")[: 2 - (v % 3 > 0)]]
    return chunks, spark.createDataFrame(asked, "qid string, vid string, oracle_idx int"), {q: (v, o) for q, v, o in asked}


def by_question(rows):
    out = {}
    for r in rows:
        out.setdefault(r.qid, []).append(r)
    return out


def test_within_and_cross_pools(spark):
    sizes = [5, 1, 2, 9, 4, 3, 6, 2]
    chunks, questions, asked = library(spark, sizes)
    for q, rows in by_question(retrieval.pools_of("within", questions, chunks).collect()).items():
        vid, oracle = asked[q]
        assert sorted(r.idx for r in rows) == list(range(sizes[int(vid[1:])])) and [r.idx for r in rows if r.is_oracle] == [oracle]
    cross = retrieval.pools_of("cross", questions, chunks, seed=5)
    pools = by_question(cross.collect())
    for q, (vid, oracle) in asked.items():
        assert len({(r.vid, r.idx) for r in pools[q]}) == len(pools[q]) == sizes[int(vid[1:])]
        assert [(r.vid, r.idx) for r in pools[q] if r.is_oracle] == [(vid, oracle)]
        assert all(r.is_oracle or r.vid != vid for r in pools[q])
    assert sorted(cross.collect()) == sorted(retrieval.pools_of("cross", questions, chunks, seed=5).collect())
    assert sorted(cross.collect()) != sorted(retrieval.pools_of("cross", questions, chunks, seed=6).collect())


def test_draws_of_different_questions_are_independent(spark):
    """Of 500 chunks two questions about one video share some 5 of 50 draws, not nearly all of them."""
    chunks = spark.createDataFrame([(f"v{v}", i) for v in range(101) for i in range(5)], "vid string, idx int")
    questions = spark.createDataFrame([(f"q{k}", "v0", 0) for k in range(40)], "qid string, vid string, oracle_idx int")
    rows = retrieval.cross_pools(questions, chunks, pool_size=51).filter("NOT is_oracle").collect()
    drawn = [{(r.vid, r.idx) for r in x} for x in by_question(rows).values()]
    shared = [len(a & b) for i, a in enumerate(drawn) for b in drawn[i + 1 :]]
    assert all(len(x) == 50 for x in drawn) and 4 < sum(shared) / len(shared) < 6 and max(shared) < 20


def test_a_pool_larger_than_the_library_holds_all_of_it(spark):
    sizes = [3, 2, 4]
    chunks, questions, asked = library(spark, sizes)
    pools = by_question(retrieval.cross_pools(questions, chunks, pool_size=100).collect())
    assert all(len(pools[q]) == 1 + sum(sizes) - sizes[int(v[1:])] for q, (v, _) in asked.items())
    gone = spark.createDataFrame([("v2",), ("unknown",)], "vid string")
    pools = by_question(retrieval.cross_pools(questions, chunks, pool_size=100, exclude=gone).collect())
    assert all(r.is_oracle or r.vid != "v2" for rows in pools.values() for r in rows)
    nothing = retrieval.cross_pools(questions, chunks, exclude=chunks)
    assert all(r.is_oracle for r in nothing.collect()) and nothing.count() == len(asked)


def test_what_pools_refuse(spark):
    chunks, questions, _ = library(spark, [2, 2])
    for wrong in (lambda: retrieval.pools_of("near", questions, chunks), lambda: retrieval.pools_of("within", questions, chunks, pool_size=3), lambda: retrieval.pools_of("within", questions, chunks, exclude=chunks), lambda: retrieval.cross_pools(questions, chunks, pool_size=1), lambda: retrieval.training_pools(questions, chunks, n_easy=-1)):
        with pytest.raises(ValueError):
            wrong()


def test_training_pools(spark):
    sizes = [3, 8, 2, 5, 7, 4, 6]
    chunks, questions, asked = library(spark, sizes)
    held_out = spark.createDataFrame([("v1",), ("v4",)], "vid string")
    first, second = (retrieval.training_pools(questions, chunks, 6, seed=2, epoch=e, held_out=held_out).collect() for e in (1, 2))
    for q, rows in by_question(first).items():
        vid, oracle = asked[q]
        kinds = {k: {(r.vid, r.idx) for r in rows if r.kind == k} for k in ("oracle", "hard", "easy")}
        assert kinds["oracle"] == {(vid, oracle)}
        assert kinds["hard"] == {(vid, i) for i in range(sizes[int(vid[1:])])} - {(vid, oracle)}
        assert len(kinds["easy"]) == 6 == sum(r.kind == "easy" for r in rows) and not {v for v, _ in kinds["easy"]} & {vid, "v1", "v4"}
    near = lambda rows: sorted(r for r in rows if r.kind != "easy")
    assert near(first) == near(second) and sorted(first) != sorted(second)
    assert {r.kind for r in retrieval.training_pools(questions, chunks, 0).collect()} == {"oracle", "hard"}


def test_batches_of_an_epoch(spark):
    rows = spark.createDataFrame([(f"q{i}",) for i in range(103)], "qid string")
    one_, two = ({r.qid: r.batch for r in retrieval.batches(rows, "qid", 10, seed=1, epoch=e).collect()} for e in (0, 1))
    sizes = [sum(b == k for b in one_.values()) for k in range(11)]
    assert sizes == [10] * 10 + [3] and one_ != two and one_.keys() == two.keys()


def test_ranks_count_all_that_score_as_much(spark):
    rng = random.Random(31)
    rows = []
    for q in range(200):
        scores = [rng.choice([0.0, 0.25, 0.25, 0.5, 0.75, math.nan]) for _ in range(rng.randrange(1, 9))]
        rows += [(q, i == len(scores) // 2, s) for i, s in enumerate(scores)]
    got = {r.qid: r for r in retrieval.pessimistic_ranks(spark.createDataFrame(rows, "qid int, is_oracle boolean, score double")).collect()}
    for q in range(200):
        own = [s for k, _, s in rows if k == q]
        oracle = next(s for k, o, s in rows if k == q and o)
        want = None if math.isnan(oracle) else sum(s >= oracle for s in own) - 1  # Python's NaN is never ahead
        assert (got[q]["rank"], got[q]["pool"]) == (want, len(own))


def test_bands_by_setup(spark):
    ranks = spark.createDataFrame([("a", 0, 2), ("a", 1, 3), ("b", 0, 7), ("b", 0, 25)], "setup string, rank int, pool int")
    rows = {(r.setup, r.band): r for r in retrieval.banded(ranks, ((2, 3), (7, 7)), ("setup",)).collect()}
    assert {k: (r.n, r.top1) for k, r in rows.items()} == {("a", "2-3"): (2, 0.5), ("a", "7"): (0, None), ("b", "2-3"): (0, None), ("b", "7"): (1, 1.0)}
    assert rows["a", "7"].lo is None and rows["a", "2-3"].lo < 0.5 < rows["a", "2-3"].hi


def test_shuffled_queries_come_from_other_videos(spark):
    _, questions, asked = library(spark, [4, 2, 6, 3])
    got = retrieval.shuffled(questions.withColumn("query", F.col("qid"))).collect()
    assert len(got) == len(asked) and all(r.vid != r.from_vid == asked[r.query][0] for r in got)
    with pytest.raises(ValueError):
        retrieval.shuffled(questions.filter("vid = 'v0'").withColumn("query", F.col("qid")))


def binomial_tail(n, m):
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n) if n else 1.0


def test_paired_p_values_are_exact(spark):
    rng = random.Random(32)
    cases = [(0, 0), (1, 0), (3, 3), (700, 651), (1, 1400), (5000, 4800)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(100)]
    rows = spark.createDataFrame(cases, "a long, b long").select("a", "b", X.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(math.isclose(r.p, binomial_tail(r.a + r.b, min(r.a, r.b)), rel_tol=1e-9) for r in rows)
    huge = one(spark, X.mcnemar_p(F.lit(50_000_000), F.lit(50_010_000)))
    assert math.isclose(huge, math.erfc(9_999 / math.sqrt(100_010_000) / math.sqrt(2)), rel_tol=1e-3)


def test_wilson_ends_solve_their_equation(spark):
    for k, n in ((3, 17), (0, 9), (9, 9), (400, 1000)):
        for end in X.wilson(F.lit(k), F.lit(n)):
            p = one(spark, end)
            assert abs((k / n - p) ** 2 - 1.959963984540054**2 * p * (1 - p) / n) < 1e-9
    assert one(spark, X.wilson(F.lit(1), F.lit(0))[0]) is None and one(spark, X.wilson(F.lit(5), F.lit(4))[1]) is None


def test_scores_of_later_tables_win(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "setup string, top1 double")
    b = spark.createDataFrame([("y", 3.0), ("z", 4.0)], "setup string, top1 double")
    assert {r.setup: r.top1 for r in retrieval.later_wins([a, b], ("setup",)).collect()} == {"x": 1.0, "y": 3.0, "z": 4.0}


def test_the_score_table_is_in_order(spark):
    rows = [("e", p, r, f) for f in ("question+options", "answer", "question") for r in ("fused", "video") for p in ("cross", "within")]
    listed = [tuple(r) for r in retrieval.score_table(spark.createDataFrame(rows, "encoder string, pool_type string, representation string, query_form string")).collect()]
    assert listed[:3] == [("e", "within", "video", f) for f in ("answer", "question", "question+options")] and listed[-1] == ("e", "cross", "fused", "question+options")


def test_positional_picks_fall_back_to_a_place_that_exists(spark):
    chunks, _, _ = library(spark, [5, 5, 2, 1])
    questions = spark.createDataFrame([("a", "v0", 3), ("b", "v1", 3), ("c", "v2", 1), ("d", "v2", 1), ("e", "v3", 0), ("f", "v0", 3)], "qid string, vid string, oracle_idx int")
    assert {r.qid: r.idx for r in retrieval.positional_picks(questions, chunks).collect()} == {"a": 3, "b": 3, "c": 1, "d": 1, "e": 0, "f": 3}


def test_losses(spark):
    scores = spark.createDataFrame([("q", True, 0.2, 0.9), ("q", False, 0.6, 0.1), ("q", False, -0.4, 0.3)], "qid string, is_oracle boolean, score double, answer double")
    ce = lambda xs, t: math.log(sum(math.exp(x / t) for x in xs)) - xs[0] / t
    for weight in (0.0, 0.5):
        want = ce([0.2, 0.6, -0.4], 0.07) + weight * ce([0.9, 0.1, 0.3], 0.07)
        assert math.isclose(retrieval.pool_loss(scores, math.log(0.07), "answer", weight).first()["loss"], want, rel_tol=1e-9)
    assert one(spark, X.temperature(F.lit(-20.0))) == 0.01
    batches = spark.createDataFrame([(1.0, 3), (5.0, 1)], "loss double, n int")
    assert batches.agg(retrieval.mean_loss(batches).alias("x")).first()["x"] == 2.0


def plain_bm25(texts, asked):
    import re

    docs = [re.findall("[a-z0-9']+", t.lower()) for t in texts]
    words = {w for d in docs for w in d}
    raw = {w: math.log(len(docs) - sum(w in d for d in docs) + 0.5) - math.log(sum(w in d for d in docs) + 0.5) for w in words}
    mean, length = sum(raw.values()) / len(raw), sum(map(len, docs)) / len(docs)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    score = lambda d: sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / length)) for w in re.findall("[a-z0-9']+", asked.lower()) if w in idf)
    return [score(d) for d in docs]


def test_bm25_by_pool_and_over_the_corpus(spark):
    rng = random.Random(33)
    vocabulary = ["tea", "kettle", "the", "it's", "Rain", "x9", "moss"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))) for _ in range(30)]
    asked = ["kettle tea tea", "THE rain", "nobody knows", ""]
    docs = spark.createDataFrame([(f"v{i // 6}", i % 6, t, i) for i, t in enumerate(texts)], "vid string, idx int, text string, doc int")
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    pools = docs.select("vid", "idx").crossJoin(queries.select("qid"))
    got = {(r.qid, r.vid, r.idx): r.score for r in bm25.bm25_scores(pools, queries, docs).collect()}
    found = bm25.bm25_search(queries, docs.select("doc", "text"), "doc", 5).collect()
    for q, text in enumerate(asked):
        want = plain_bm25(texts, text)
        assert all(math.isclose(got[q, f"v{i // 6}", i % 6], s, abs_tol=2e-6) for i, s in enumerate(want))
        shares = [i for i, t in enumerate(texts) if set(t.lower().split()) & set(text.lower().split())]
        best = sorted(shares, key=lambda i: (-round(want[i], 6), i))[:5]
        assert [r.doc for r in sorted((r for r in found if r.qid == q), key=lambda r: r.place)] == best


def test_registered_queries_on_small_data(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    plain = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert plain <= entry.oracle_sql().keys() and "retrieval_within" in plain
    assert table(spark, "/root/testdata/sf0.001", "region").count() == 5


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_pruned_search_equals_scoring_all(spark, monkeypatch, most):
    from spindrift.operators import bm25

    monkeypatch.setattr(bm25, "MOST_WEIGHTS", most)
    monkeypatch.setattr(bm25, "BLOCK", 40)
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(400)] + [(1000, None), (1001, "w1 w1"), (1002, "w1 w1"), (1003, "w1 w1")]
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for q in range(25)] + [(99, None), (98, "absent words"), (97, "w1")]
    got = bm25.bm25_search(spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(3), "doc_id", 4).collect()
    said = {i: re.findall("[a-z0-9']+", (t or "").lower()) for i, t in docs}
    df = Counter(w for own in said.values() for w in set(own))
    idf = {w: math.log(len(said) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    mean = sum(map(len, said.values())) / len(said)
    want = []
    for q, t in asked:
        scores = {}
        for i, own in said.items():
            for w in re.findall("[a-z0-9']+", (t or "").lower()):
                if w in own:
                    tf = own.count(w)
                    scores[i] = scores.get(i, 0) + (low if idf[w] < 0 else idf[w]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
        want += [(q, i, round(s, 6), k) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4], 1)]
    assert sorted((r.qid, r.doc_id, r.score, r.place) for r in got) == sorted(want)


def test_blocks_below_the_floor_are_passed_over():
    """Once the best are found, texts that only share common words with a query are no candidates."""
    from spindrift.operators import bm25

    asked, best = {1: ([0, 1], [0.1, 5.0])}, {1: bm25.Best(2)}
    one = lambda rows: tuple(np.array(x) for x in zip(*sorted(rows, key=lambda r: (r[1], r[0]))))
    rare = [(d, 1, 1.0) for d in range(3)] + [(d, 0, 1.0) for d in range(9)]
    assert bm25.score_block(*one(rare), 10, asked, best, list(range(10))) == 9
    assert bm25.score_block(*one([(d, 0, 1.5) for d in range(10)]), 10, asked, best, list(range(10, 20))) == 0
    assert bm25.score_block(*one([(0, 0, 1.0), (1, 1, 1.1), (2, 0, 1.0)]), 3, asked, best, [20, 21, 22]) == 1
    assert [k for _, k, _ in best[1].rows] == [21, 0]
