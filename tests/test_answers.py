"""Answers, lookups, prompts, encoders and adapters."""

import html
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.functions import encoders, runs
from spindrift.functions import expr as X
from spindrift.operators import adapter, answers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_answers_are_the_first_possible_digit(spark):
    rng = random.Random(41)
    texts = ["".join(rng.choice(["7", "4", "3", "0", "option ", "-", "\n", "B"]) for _ in range(rng.randrange(6))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "raw string").select("raw", X.parse_answer(F.col("raw")).alias("x")).collect()
    assert all(r.x == next((int(c) for c in r.raw if c in "0123"), None) for r in rows)


def test_scores_are_three_valued(spark):
    rows = spark.createDataFrame([("  3 ", 3.0), ("it's 1", 3.0), ("none", 3.0), ("3", None), ("3", math.nan), ("none", None)], "raw string, gold double")
    scored = answers.score(rows.withColumn("seq", F.monotonically_increasing_id()))
    assert [(r.raw, r.pred, r.gold, r.correct) for r in scored.orderBy("seq").collect()] == [("3", 3, 3, True), ("it's 1", 1, 3, False), ("none", None, 3, False), ("3", 3, None, None), ("3", 3, None, None), ("none", None, None, None)]
    assert answers.summary(scored).first().asDict() == {"n": 6, "accuracy": round(1 / 3, 6), "unparsed": 2, "unparsed_rate": round(2 / 6, 6)}
    assert answers.summary(scored.limit(0)).first().asDict() == {"n": 0, "accuracy": None, "unparsed": 0, "unparsed_rate": None}
    assert [r.raw for r in answers.unparsed(scored, "seq", 1).collect()] == ["none"]


def test_running_accuracy_over_blocks(spark):
    rng = random.Random(42)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([True, False, None])) for i in rng.sample(range(1000), 150)]
    got = {r.seq: r.running for r in answers.running_accuracy(spark.createDataFrame(rows, "seq int, lang string, correct boolean"), "lang", "seq", block=90).collect()}
    assert len(got) == len(rows)
    for seq, lang, _ in rows:
        known = [c for s, g, c in rows if g == lang and s <= seq and c is not None]
        assert got[seq] == (round(sum(known) / len(known), 6) if known else None)


def test_cached_questions_are_found_by_key(spark):
    qa = spark.createDataFrame([("q1", "late", 5), ("q1", "early", 2), ("q2", "only", 9)], "qid string, q string, at int")
    cached = spark.createDataFrame([(0, "q2"), (1, "q1")], "seq int, qid string")
    assert sorted((r.seq, r.q) for r in answers.rows_in_query_order(cached, qa, "at").collect()) == [(0, "only"), (1, "early")]
    lost = spark.createDataFrame([(0, "q2"), (1, "q7")], "seq int, qid string")
    with pytest.raises(Exception, match="q7"):
        answers.rows_in_query_order(lost, qa, "at").collect()


def test_narrowing(spark):
    rows = spark.createDataFrame([(i, f"v{i % 4}") for i in range(12)], "at int, vid string")
    two = spark.createDataFrame([("v0",), ("v1",), ("v0",)], "vid string")
    assert answers.only(rows, two).count() == 6 and answers.fit_rows(rows, two).count() == 6
    with pytest.raises(ValueError):
        answers.fit_rows(answers.only(rows, two), two)
    there, missing = answers.with_media(rows, two.distinct())
    assert there.count() == 6 and [r.vid for r in missing.collect()] == ["v2", "v3"]
    assert [r.at for r in answers.first_n(rows, 3, "at").collect()] == [0, 1, 2] and answers.first_n(rows, None, "at").count() == 12
    back = answers.in_input_order(spark.createDataFrame([("x", 1), ("y", 2)], "vid string, n int"), spark.createDataFrame([(0, "y"), (1, "x")], "seq int, vid string"))
    assert [r.vid for r in back.collect()] == ["y", "x"]


def test_a_video_that_cannot_be_read_costs_its_own_questions_only(spark):
    rows = spark.createDataFrame([(f"v{i % 3}", f"q{i}", i, "which?", 1) for i in range(9)], "vid string, qid string, seq int, prompt string, gold int")

    def prepare(vid):
        if vid == "v1":
            raise RuntimeError("no frames")

    got = answers.answer(rows, lambda vid, pdf: ["1"] * len(pdf), batch=2, prepare=prepare).collect()
    assert sorted(r.qid for r in got) == ["q0", "q2", "q3", "q5", "q6", "q8"] and all(r.correct for r in got)
    with pytest.raises(Exception, match="one answer per row"):
        answers.answer(rows, lambda vid, pdf: ["1"]).collect()


def test_ids_that_two_splits_hold(spark):
    rows = [("x", "train", "a", 0), ("x", "test", "b", 1), ("y", "val", "b", 2), ("y", "val", "a", 3), ("y", "val", "a", 4), ("z", "train", "a", 5)]
    members = spark.createDataFrame(rows, "id string, split string, subset string, pos int")
    assert {r.id: (r.split, r.subset) for r in answers.owners(members).collect()} == {"x": ("test", "b"), "y": ("val", "a"), "z": ("train", "a")}
    assert sorted(r.pos for r in answers.dropped_members(members).collect()) == [0, 2, 4]


def test_lines_are_unescaped_and_collapsed(spark):
    texts = ["a &#8217;b&#x27; &eacute;&nbsp;c", "x &amp;lt; y", "no entity　here \x1d", "&bogus; & &#0; &amp", "tab\tand line"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", X.normalized_line(F.col("t")).alias("x")).collect()
    assert all(r.x == (None if r.t is None else " ".join(html.unescape(r.t).split())) for r in rows)
    assert one(spark, X.strip(F.lit(" \x1f a b \n"))) == "a b"


def test_prompts_and_forms(spark):
    rows = spark.createDataFrame([("why", "w", "x", "y", "z", "x"), ("how", "a", "b", "c", "d", None)], "q string, a0 string, a1 string, a2 string, a3 string, ans_corr string").withColumn("qid", F.col("q")).withColumn("vid", F.lit("v"))
    assert encoders.available_forms(rows) == ["question", "question+options"] and encoders.available_forms(rows.filter("q = 'why'")) == ["question", "question+options", "answer"]
    got = encoders.encode_queries(rows, "hash").collect()
    assert len(got) == 4 and all(abs(np.linalg.norm(r.query) - 1) < 1e-9 for r in got)
    assert encoders.encode_queries(rows.withColumn("q", F.lit(None).cast("string")).withColumn("ans_corr", F.lit(None).cast("string")), "hash").collect() == []
    assert one(spark, X.render_prompt(F.lit("Q?"), [F.lit(x) for x in "abcd"])).split("\n")[1:5] == ["0. a", "1. b", "2. c", "3. d"]
    with pytest.raises(ValueError):
        X.render_query("caption", F.col("q"), [], F.col("q"))


def test_frames(spark):
    for total, wanted in ((91, 4), (5, 9), (77, 1), (2, 2)):
        assert one(spark, X.frame_indices(F.lit(total), F.lit(wanted))) == np.linspace(0, total - 1, min(wanted, total)).round().astype(int).tolist()
    assert one(spark, X.frame_indices(F.lit(0), F.lit(3))) is None and one(spark, X.window_frame_indices(F.lit(10), F.lit(5.0), F.lit(3), F.lit(4.0), F.lit(5.0))) is None
    windows = F.array(F.array(*map(F.lit, (1, 2))), F.array(F.lit(7)), F.array(*map(F.lit, (8, 9, 10))))
    flat, sizes = X.windows_at_once(windows)
    assert one(spark, X.split_again(flat, sizes)) == [[1, 2], [7], [8, 9, 10]]
    with pytest.raises(Exception, match="frames decoded"):
        one(spark, X.split_again(F.slice(flat, 1, 5), sizes))


def test_a_cache_leaves_failed_videos_out(spark):
    manifest = spark.createDataFrame([("a", [(0.0, 60.0), (60.0, 90.0)], 1), ("b", [(0.0, 60.0)], 0), ("c", [(0.0, 60.0)], 0)], "vid string, chunks array<struct<s:double,e:double>>, oracle_idx int")
    said = spark.createDataFrame([("a", 0, "hello there"), ("c", 0, "bye")], "vid string, chunk int, text string")
    asked = spark.createDataFrame([("q1", "a"), ("q2", "b")], "qid string, vid string").selectExpr("*", "'why' AS q", "'w' AS a0", "'x' AS a1", "'y' AS a2", "'z' AS a3", "'x' AS ans_corr")

    def decode(vid, s, e):
        import pandas as pd

        return pd.Series([None if v == "b" else [int(a)] for v, a in zip(vid, s)], dtype=object)

    made = encoders.build_cache(manifest, said, asked, "hash", decode)
    assert sorted((r.vid, r.idx, r.is_oracle) for r in made["chunks"].collect()) == [("a", 0, False), ("a", 1, True), ("c", 0, True)]
    assert [r.vid for r in made["failed"].collect()] == ["b"] and {r.qid for r in made["queries"].collect()} == {"q1"}
    with pytest.raises(RuntimeError):
        encoders.build_cache(manifest, said, asked, "hash", lambda vid, s, e: vid.map(lambda _: None).astype(object))
    assert {r.vid for r in encoders.build_cache(manifest, said, asked, "hash", decode, limit=1)["chunks"].collect()} == {"a"}


def forward(a, v, t):
    """The chunk side of one row, by scalar loops."""
    x = list(v) + list(t)
    gelu = lambda z: 0.5 * z * (1 + math.erf(z / math.sqrt(2)))
    times = lambda x, w: [sum(p * w[i][j] for i, p in enumerate(x)) for j in range(len(w[0]))]
    if isinstance(a.chunk, adapter.Residual):
        r = times([gelu(z) for z in times(x, a.chunk.down)], a.chunk.up)
    else:
        m = sum(x) / len(x)
        s = math.sqrt(sum((z - m) ** 2 for z in x) / len(x) + 1e-5)
        h = [(z - m) / s * k + b for z, k, b in zip(x, a.chunk.scale, a.chunk.shift)]
        for w, b in a.chunk.layers[:-1]:
            h = [gelu(z + c) for z, c in zip(times(h, w), b)]
        w, b = a.chunk.layers[-1]
        r = [z + c for z, c in zip(times(h, w), b)]
    out = [a.alpha * p + a.beta * q + z for p, q, z in zip(v, t, r)]
    n = math.sqrt(sum(z * z for z in out))
    return [z / n for z in out]


@pytest.mark.parametrize("name,size", [("small", {"rank": 3}), ("big", {"hidden": 5})])
def test_adapters(spark, tmp_path, name, size):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), rng.normal(size=4).tolist() if i else None) for i in range(6)]
    chunks = spark.createDataFrame(rows, "id int, v array<double>, t array<double>, query array<double>")
    new = adapter.build(name, 4, **size)
    fused = [np.add(v, t) / np.linalg.norm(np.add(v, t)) for _, v, t, _ in rows]
    assert np.allclose([r.adapted for r in adapter.adapt_chunks(chunks, new).orderBy("id").collect()], fused)
    # with numbers in the last layer it no longer is the identity
    branch = adapter.Residual(new.chunk.down, rng.normal(size=(3, 4))) if name == "small" else adapter.Deep((*new.chunk.layers[:-1], (rng.normal(size=(5, 4)), rng.normal(size=4))), rng.normal(size=8), rng.normal(size=8))
    query = adapter.Residual(rng.normal(size=(4, 3)), rng.normal(size=(3, 4)))
    trained = adapter.Adapter(query if name == "small" else new.query, branch, 0.7, 1.2, -1.0, "stand-in", frozenset({"alpha"}))
    done, asked = adapter.adapt_cache(chunks.select("id", "v", "t"), chunks.select("id", "query"), trained)
    got = done.orderBy("id").collect()
    assert all(r.v == r.t for r in got) and np.allclose([r.v for r in got], [forward(trained, v, t) for _, v, t, _ in rows])
    queries = [r["query"] for r in asked.orderBy("id").collect()]
    assert queries[0] is None and np.allclose(np.linalg.norm(queries[1:], axis=1), 1)
    adapter.write_adapter(spark, trained, spark.createDataFrame([(0, 0.5)], "epoch int, top1 double"), str(tmp_path / "a"))
    again = adapter.read_adapter(spark, str(tmp_path / "a"))
    assert again.numbers() == trained.numbers() and (again.checkpoint, again.frozen) == ("stand-in", frozenset({"alpha"}))


def test_what_an_adapter_trains(spark):
    whole, frozen = adapter.build("small", 6, rank=2), adapter.build("small", 6, freeze_chunks=True, rank=2)
    assert whole.trainable() == 3 + 2 * 6 * 2 + (12 + 6) * 2 and frozen.trainable() == 1 + 2 * 6 * 2
    assert adapter.build("small", 6, rank=0).trainable() == 3
    with pytest.raises(ValueError):
        adapter.build("small", 6, rank=-1)


def test_runs_are_told_apart():
    ids = {runs.answer_run_id("m", "d", "s", *x) for x in ((True,), (False,), (True, True), (True, False, "oracle"), (True, False, "top1"), (True, False, "top1", 5))}
    assert len(ids) == 6 and runs.adapter_run_id("small", "question+options", True, 0.25) == "small_question-options_queryonly_ans0.25"
    assert runs.versions(("numpy", "no-such-package"))["no-such-package"] == "-" and re.fullmatch(r"unknown|[0-9a-f]+(-dirty)?", runs.revision())
    assert runs.accepted(lambda fps, frames=1: None, {"fps": 2, "frames": None, "tokens": 9}) == {"fps": 2}


def asked_rows(spark, videos):
    rows = [(v, f"{v}#{i}", i, f"p{i}", i % 4) for v, n in videos.items() for i in range(n)]
    return spark.createDataFrame(rows, "vid string, qid string, seq int, prompt string, gold int").repartition(5)


def test_a_video_is_decoded_once_and_a_model_loaded_once(spark, tmp_path):
    def log(name, what):
        with open(tmp_path / name, "a") as f:
            f.write(f"{what}\n")

    def prepare(video):
        log("prepared", video)
        if video == "bad":
            raise OSError("torn")

    def load():
        import os

        log("loaded", os.getpid())
        return lambda video, pdf: [f"{q % 4}" for q in pdf["seq"]]

    videos = {"a": 100, "b": 1, "bad": 30, "long": 250}
    results, failed = answers.answered(asked_rows(spark, videos), load=load, prepare=prepare, stretch=100)
    got = results.collect()
    assert sorted((r.video, r.qid) for r in got) == sorted((v, f"{v}#{i}") for v in ("a", "b", "long") for i in range(videos[v])) and all(r.correct for r in got)
    assert [tuple(r) for r in failed.collect()] == [("bad", "OSError: torn")]
    said = (tmp_path / "prepared").read_text().split()
    assert said.count("a") == said.count("b") == said.count("bad") == 1 and 1 <= said.count("long") <= 3
    loaded = (tmp_path / "loaded").read_text().split()
    assert len(loaded) == len(set(loaded))
    rest, _ = answers.answered(asked_rows(spark, videos), lambda v, pdf: ["0"] * len(pdf), done=results)
    assert {r.video for r in rest.collect()} == {"bad"}
    with pytest.raises(ValueError):
        answers.answered(asked_rows(spark, videos))
    with pytest.raises(RuntimeError, match="nothing was answered: OSError: torn"):
        answers.answered(asked_rows(spark, {"bad": 3}), load=load, prepare=prepare)
    assert [df.collect() for df in answers.answered(asked_rows(spark, videos).limit(0), load=load, prepare=prepare)] == [[], []]


def test_batches_come_in_order(spark):
    def model(video, pdf):
        assert pdf["seq"].is_monotonic_increasing
        return [f"{len(pdf)}:{pdf['seq'].iloc[0]}"] * len(pdf)

    got = {r.qid: r.raw for r in answers.answer(asked_rows(spark, {"a": 20, "b": 3}), model, batch=8).collect()}
    assert [got[f"a#{i}"] for i in (0, 7, 8, 16, 19)] == ["8:0", "8:0", "8:8", "4:16", "4:16"] and got["b#2"] == "3:0"


def test_accuracy_runs_over_ids_of_any_spread(spark):
    import random

    rng = random.Random(4)
    for spread in (10, 1 << 62):
        ids = rng.sample(range(spread), 10) if spread == 10 else [rng.randrange(-spread, spread) for _ in range(900)]
        rows = [(i, rng.choice(["en", None]), rng.choice([True, False, None])) for i in ids]
        got = {r.seq: r.running for r in answers.running_accuracy(spark.createDataFrame(rows, "seq long, lang string, correct boolean"), "lang", "seq", block=70).collect()}
        for lang in ("en", None):
            n = k = 0
            for i, _, c in sorted(r for r in [(i, str(g), c) for i, g, c in rows] if r[1] == str(lang)):
                n, k = n + (c is not None), k + bool(c)
                assert got[i] == (math.floor(k / n * 1e6 + 0.5) / 1e6 if n else None)


def test_a_stream_of_answers_stops_and_goes_on(spark, tmp_path):
    from spindrift.streaming import answers as stream

    schema = "video string, qid string, seq long, gold int, raw string"
    parts = [
        [("a", "a1", 1, 1, "1"), ("a", "a2", 2, 2, "3"), ("b", "b1", 1, None, "0"), (None, "n1", 1, 0, "0")],
        [("a", "a1", 1, 1, "2"), ("a", "a3", 3, 3, "x3"), ("b", "b2", 2, 2, "none"), ("b", "b2", 2, 2, "2"), ("c", None, 1, 1, "1")],
        [],
        [("b", "b3", 3, 0, "0"), ("a", "a2", 2, 2, "2")],
    ]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in parts:  # each time the stream is started anew, with what it kept
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        stream.answer_stream(spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()
    got = sorted(((r.video, r.qid, r.pred, r.correct, r.running) for r in stream.stream_answers(spark, out).collect()), key=str)
    want = [
        (None, "n1", 0, True, 1.0), ("a", "a1", 1, True, 1.0), ("a", "a2", 3, False, 0.5), ("a", "a3", 3, True, 0.666667),
        ("b", "b1", 0, None, None), ("b", "b2", None, False, 0.0), ("b", "b3", 0, True, 0.5),
    ]
    assert got == sorted(want, key=str)


def test_rows_are_numbered_grouped_and_zipped(spark):
    from spindrift.operators import order

    rows = [(k, v) for k, v in zip("cabbacx", (5, 1, 9, 2, 8, 7, 3))] + [(None, 4)]
    frame = spark.createDataFrame(rows, "k string, v int")
    for parts in (1, 3):
        numbered = order.numbered(frame.repartition(parts), [F.col("v")])
        assert [r.v for r in sorted(numbered.collect(), key=lambda r: r.seq)] == sorted(v for _, v in rows)
        grouped = {r.v: (r.group_seq, r.place) for r in order.grouped_in_order(numbered, "k").collect()}
        assert grouped == {1: (0, 0), 8: (0, 1), 2: (1, 0), 9: (1, 1), 3: (2, 0), 4: (3, 0), 5: (4, 0), 7: (4, 1)}
    assert order.numbered(frame.limit(0), [F.col("v")]).collect() == []
    other = order.numbered(frame.select(F.col("v").alias("w")), [F.col("w").desc()])
    assert [(r.v, r.w) for r in sorted(order.zipped(numbered, other).collect())] != [] and all(r.v + r.w == 10 or (r.v, r.w) for r in order.zipped(numbered, other).collect())
    assert sorted((r.v, r.w) for r in order.zipped(numbered, other).select("v", "w").collect()) == list(zip((1, 2, 3, 4, 5, 7, 8, 9), (9, 8, 7, 5, 4, 3, 2, 1)))
    with pytest.raises(ValueError):
        order.zipped(numbered, other.filter("seq > 0"))
    with pytest.raises(ValueError):
        order.zipped(numbered.filter("seq > 0"), other.filter("seq < 7"))


def test_unknown_names_are_refused():
    from spindrift.functions import registry

    assert list(registry.TEXT_BASELINES) == ["bm25"] and registry.MODELS["stand-in"]()("v", pd.DataFrame({"prompt": ["abc", "abcdef"]})) == ["Answer: 3", "Answer: 1"]
    for names, name in ((registry.TEXT_BASELINES, "dense"), (registry.MODELS, "large")):
        with pytest.raises(ValueError, match=f"unknown .* '{name}'; there are"):
            names[name]
    with pytest.raises(ValueError):
        registry.MODELS.register("stand-in")(None)
    assert runs.options(lambda fps, frames=1: None, {"fps": 2, "frames": None, "tokens": 9, "a": 1}) == ({"fps": 2}, ["a", "tokens"])
