"""Gradients against differences, the optimiser against a plain loop, and a run that learns."""

import math
from dataclasses import replace

import numpy as np
import pytest

from spindrift.operators import adapter as A
from spindrift.operators import training as T


def rough(adapter, seed):
    """``adapter`` with all parameters moved at random, so that no gradient is 0 by construction."""
    rng = np.random.default_rng(seed)
    return T._moved(adapter, {n: x + rng.normal(0, 0.2, x.shape) for n, x in T._values(adapter).items()})


@pytest.mark.parametrize("made", [A.small(5, rank=3), A.small(5, rank=0), A.big(5, hidden=4)])
def test_gradients_are_the_losses_slopes(made):
    rng = np.random.default_rng(7)
    adapter = replace(rough(made, 3), log_temperature=-1.0)
    sizes = np.array([4, 1, 6])
    q, v, t = rng.normal(size=(3, 5)), rng.normal(size=(11, 5)), rng.normal(size=(11, 5))
    _, found = T.gradients(adapter, q, v, t, sizes, 0.5)
    values = T._values(adapter)
    assert found.keys() == values.keys()
    for name, x in values.items():
        for at in list(np.ndindex(x.shape))[::3] if x.size else []:
            up, down = x.copy(), x.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            losses = [T.gradients(T._moved(adapter, values | {name: y}), q, v, t, sizes, 0.5)[0] for y in (up, down)]
            assert math.isclose((losses[0] - losses[1]) / 2e-5, found[name][at], rel_tol=1e-4, abs_tol=1e-6), name


def test_a_cold_temperature_and_frozen_sides_have_no_slope():
    v, q = np.eye(3), np.eye(3)[:1]
    assert T.gradients(A.small(3, rank=1, log_temperature=math.log(0.001)), q, v, v, np.array([3]))[1]["log_temperature"] == 0
    frozen = A.build("small", 3, freeze_chunks=True, rank=1)
    assert set(T.gradients(frozen, q, v, v, np.array([3]))[1]) == {"log_temperature", "query.down", "query.up"}


def test_a_step_moves_against_the_gradient_and_decays():
    move = T.AdamW(0.1, 0.5)
    x = {"a": np.array(2.0)}
    for k, g in enumerate((3.0, -1.0), 1):
        before = float(x["a"])
        x = move(x, {"a": np.array(g)})
        m = [0.1 * 3, 0.9 * 0.3 + 0.1 * -1][k - 1] / (1 - 0.9**k)
        s = [0.001 * 9, 0.999 * 0.009 + 0.001][k - 1] / (1 - 0.999**k)
        assert math.isclose(float(x["a"]), before - 0.1 * (0.5 * before + m / (math.sqrt(s) + 1e-8)))


def test_shared_vectors_have_the_slopes_of_repeated_ones():
    rng = np.random.default_rng(9)
    adapter = rough(A.big(4, hidden=3), 2)
    v, t, q = rng.normal(size=(7, 4)), rng.normal(size=(7, 4)), rng.normal(size=(3, 4))
    pools = [np.array([3, 0, 1]), np.array([6]), np.array([2, 3, 0, 5, 6])]
    at = np.concatenate(pools)
    weights = np.array([1.0, 0.5, 2.0])
    loss, got = T.pooled_gradients(adapter, q, v, t, pools, weights)
    parts = [T.gradients(adapter, q[i : i + 1], v[p], t[p], np.array([len(p)]), weights[i]) for i, p in enumerate(pools)]
    assert math.isclose(loss, sum(x for x, _ in parts), rel_tol=1e-12) and len(at) == 9
    for name, g in got.items():
        assert np.abs(g - sum(own[name] for _, own in parts)).max() < 1e-9


def learnable(spark):
    """Chunks and questions that are their oracles, turned: a query side can learn that."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows, asked = [], []
    for vid in range(12):
        for idx in range(5):
            x = rng.normal(size=6)
            x /= np.linalg.norm(x)
            rows.append((vid, idx, x.tolist(), x.tolist()))
            asked.append((vid * 5 + idx, vid, idx, (x @ turn).tolist(), x.tolist() if idx % 2 else None))
    chunks = spark.createDataFrame(rows, "vid int, idx int, v array<double>, t array<double>")
    return chunks, spark.createDataFrame(asked, "qid int, vid int, oracle_idx int, query array<double>, answer array<double>")


def plain_epoch(adapter, move, pools, order, asked, vectors, answer_weight):
    """An epoch by a loop over batches and questions, each pool's vectors gathered for it alone."""
    loss_all = 0.0
    for b in sorted(set(order.values())):
        own = sorted(q for q, k in order.items() if k == b)
        total = {}
        for q in own:
            members = sorted(pools[q])
            v, t = (np.array([vectors[m[1:]][k] for m in members]) for k in (0, 1))
            for query, weight in ((asked[q].query, 1.0), (asked[q].answer, answer_weight)):
                if query is not None and weight:
                    loss, g = T.gradients(adapter, np.array([query]), v, t, np.array([len(v)]), weight)
                    loss_all += loss
                    total = {n: total.get(n, 0.0) + x for n, x in g.items()}
        adapter = T._moved(adapter, move(T._values(adapter), {n: x / len(own) for n, x in total.items()}))
    return adapter, loss_all / len(order)


@pytest.mark.parametrize("parts", [3])
def test_an_epoch_in_one_job_equals_a_plain_loop(spark, parts):
    from pyspark.sql import functions as F

    from spindrift.operators import retrieval as R

    chunks, questions = learnable(spark)
    dev = chunks.filter("vid >= 10").select("vid").distinct()
    start = rough(A.small(6, rank=3, seed=1), 4)
    _, history = T.train(start, chunks, questions, dev, epochs=2, batch=16, rate=0.02, n_easy=4, patience=2, answer_weight=0.3, seed=3, parts=parts)
    asked = {r.qid: r for r in questions.filter("vid < 10").collect()}
    vectors = {(r.vid, r.idx): (r.v, r.t) for r in chunks.collect()}
    fit, adapter, move = questions.filter("vid < 10"), start, T.AdamW(0.02, 0.01)
    for epoch, seen in enumerate(history.orderBy("epoch").collect()):
        pools = {}
        for r in R.training_pools(fit, chunks, 4, 3, epoch, dev).collect():
            pools.setdefault(r.qid, []).append((r.kind != "oracle", r.vid, r.idx))
        order = {r.qid: r.batch for r in R.batches(fit.select("qid"), "qid", 16, 3, epoch).collect()}
        adapter, loss = plain_epoch(adapter, move, pools, order, asked, vectors, 0.3)
        assert math.isclose(seen.loss, loss, rel_tol=1e-9)
    encoded = T.encoded(R.training_pools(fit, chunks, 4, 3, 0, dev), R.batches(fit.select("qid"), "qid", 16, 3, 0).withColumn("part", F.lit(0)), fit, chunks)
    for row in encoded.collect():
        members = [(x.place, (x.v, x.t)) for x in row.vectors]
        assert [p for p, _ in members] == list(range(len(members))) and len({str(x) for _, x in members}) == len(members)
        assert all(tuple(row.vectors[a.positions[0]][1:]) == vectors[asked[a.qid].vid, asked[a.qid].oracle_idx] for a in row.asked)


def test_a_task_holds_a_stretch_of_a_batch_however_large_it_is(spark, monkeypatch):
    from pyspark.sql import functions as F

    chunks, questions = learnable(spark)
    dev = chunks.filter("vid >= 10").select("vid").distinct()
    start, real, seen = rough(A.small(6, rank=3, seed=1), 4), T.run_epoch, []

    def watched(rows, *a, **k):
        each = rows.groupBy("part", "batch", "stretch").agg(F.count("place").alias("chunks"), F.count("qid").alias("asked"), F.max(F.size("positions")).alias("pool"))
        seen.append(each.collect())
        assert not {"vectors", "asked"} & set(rows.columns)  # nothing is gathered into a row but a question's own pool
        return real(rows, *a, **k)

    monkeypatch.setattr(T, "run_epoch", watched)
    args = dict(epochs=2, batch=50, rate=0.02, n_easy=4, patience=2, answer_weight=0.3, seed=3, parts=2)  # all questions are one batch
    whole = T.train(start, chunks, questions, dev, **args)[0]
    assert max(r.asked for r in seen[-1]) == 25
    monkeypatch.setattr(T, "HELD_CHUNKS", 30)
    cut = T.train(start, chunks, questions, dev, **args)[0]
    assert len(seen) == 4 and all(sum(r.asked for r in each) == 50 for each in seen)
    assert all(r.chunks <= 30 and r.asked <= 3 and r.pool == 9 for each in seen[2:] for r in each)
    assert {r.part for r in seen[2]} == {0, 1} and len(seen[2]) == 17
    assert all(np.allclose(x, y, rtol=1e-9, atol=1e-12) for x, y in zip(T._values(cut).values(), T._values(whole).values()))


def test_rows_are_told_apart_by_stretch_wherever_arrow_cuts_them():
    import pyarrow as pa

    keys = [(0, 0)] * 3 + [(0, 2)] * 4 + [(1, 0)] * 2 + [(3, 2)]
    rows = pa.RecordBatch.from_pydict({"batch": [b for b, _ in keys], "stretch": [s for _, s in keys], "place": list(range(len(keys)))})
    for size in (1, 2, 4, 20):
        found = [(b, s, t["place"].to_pylist()) for b, s, t in T._stretches(rows.slice(i, size) for i in range(0, len(keys), size))]
        assert found == [(0, 0, [0, 1, 2]), (0, 2, [3, 4, 5, 6]), (1, 0, [7, 8]), (3, 2, [9])]
    assert T._matrix(pa.chunked_array([[[1.0, 2.0]], [[3.0, 4.0]]]).slice(1)).tolist() == [[3.0, 4.0]]
    for bad in ([[1.0], None], [[1.0], [2.0, 3.0]]):
        with pytest.raises(ValueError):
            T._matrix(pa.chunked_array([bad]))


def test_a_broken_run_goes_on_to_the_same_numbers(spark, tmp_path, monkeypatch):
    chunks, questions = learnable(spark)
    dev = chunks.filter("vid >= 9").select("vid").distinct()
    args = dict(epochs=3, batch=20, rate=0.03, n_easy=3, patience=4, seed=2, parts=2)
    whole, history = T.train(A.small(6, rank=2, seed=1), chunks, questions, dev, **args)
    real, calls = T.run_epoch, []

    def lost(*a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the driver is lost")
        return real(*a, **k)

    monkeypatch.setattr(T, "run_epoch", lost)
    path = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        T.train(A.small(6, rank=2, seed=1), chunks, questions, dev, path=path, **args)
    made, again = T.train(A.small(6, rank=2, seed=1), chunks, questions, dev, path=path, **args)
    assert len(calls) == 4  # two epochs, the broken one, one more
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, history.collect()))
    assert all((x == y).all() for x, y in zip(T._values(made).values(), T._values(whole).values()))
    assert sorted(map(tuple, T.train(A.small(6, rank=2, seed=1), chunks, questions, dev, path=path, **args)[1].collect())) == sorted(map(tuple, history.collect())) and len(calls) == 4
    with pytest.raises(ValueError):
        T.train(A.small(6, rank=3), chunks, questions, dev, path=path, **args)


def test_a_run_learns_and_stops(spark):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]  # questions are their oracles, turned: a query side can learn that
    rows, asked = [], []
    for vid in range(12):
        for idx in range(5):
            x = rng.normal(size=6)
            x /= np.linalg.norm(x)
            rows.append((vid, idx, x.tolist(), x.tolist()))
            asked.append((vid * 5 + idx, vid, idx, (x @ turn).tolist(), x.tolist()))
    asked.append((999, 0, 0, None, None))
    chunks = spark.createDataFrame(rows, "vid int, idx int, v array<double>, t array<double>")
    questions = spark.createDataFrame(asked, "qid int, vid int, oracle_idx int, query array<double>, answer array<double>")
    dev = chunks.filter("vid >= 9").select("vid").distinct()
    made, history = T.train(A.small(6, rank=6, seed=1), chunks, questions, dev, epochs=3, batch=32, rate=0.05, n_easy=4, patience=2, answer_weight=0.1)
    h = history.orderBy("epoch").collect()
    assert h[-1].loss < h[0].loss and max(r.top1 for r in h) >= h[0].top1
    assert [r.epoch for r in h] == list(range(len(h))) and made.query.up.any()
    again, _ = T.train(A.small(6, rank=2), chunks, questions, dev, epochs=3, batch=64, rate=0.0, decay=0.0, n_easy=0, patience=1)
    assert not again.query.up.any()
    with pytest.raises(ValueError):
        T.train(made, chunks, questions, chunks.filter("vid < 0"), epochs=1)
