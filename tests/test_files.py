"""Readers and writers, and the stream of results, as round trips."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions import runs
from spindrift.schema import RESULT
from spindrift.sources import files
from spindrift.streaming import results

PLAIN = "WEBVTT\n\n00:02.000 --> 00:04.500 line:0%\n<i>so</i> we go\non\n\n01:00:00.000 --> 01:00:01.000\nlast\n"
TAGGED = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:03.000 align:start position:0%\n \nnow<00:00:01.500><c> we</c><00:00:02.250><c> sing</c>\n\n00:00:03.000 --> 00:00:03.010 align:start position:0%\nnow we sing\n \n\n00:00:03.010 --> 00:00:05.000 align:start position:0%\nnow we sing\nloud\n"


def test_captions(spark, tmp_path):
    (tmp_path / "plain.vtt").write_text(PLAIN)
    (tmp_path / "tagged.vtt").write_text(TAGGED)
    cues = files.read_vtt(spark, str(tmp_path)).collect()
    assert [(r.start, r.end, r.text.strip()) for r in cues if r.vid == "plain"] == [(2.0, 4.5, "so we go\non"), (3600.0, 3601.0, "last")]
    words = sorted((r.vid, r.start, r.word, r.end) for r in files.timed_words(spark, str(tmp_path)).collect())
    assert [w for w in words if w[0] == "tagged"] == [("tagged", 1.0, "now", 1.5), ("tagged", 1.5, "we", 2.25), ("tagged", 2.25, "sing", 3.0), ("tagged", 3.01, "loud", 5.0)]
    assert [(w[2], round(w[1], 4), round(w[3], 4)) for w in words if w[0] == "plain"] == [("so", 2.0, 2.625), ("we", 2.625, 3.25), ("go", 3.25, 3.875), ("on", 3.875, 4.5), ("last", 3600.0, 3601.0)]


def test_questions_trims_and_media(spark, tmp_path):
    (tmp_path / "set/qa").mkdir(parents=True)
    (tmp_path / "set/qa/qa_test.json").write_text(json.dumps({"qid": "q1", "vid_name": "v", "q": "why", "a0": "x"}) + "\n")
    row = files.read_qa(spark, str(tmp_path), "test", "set", ("set",)).first()
    assert (row.qid, row.a0, row.answer_idx, row.ans_corr) == ("q1", "x", None, None)
    with pytest.raises(ValueError):
        files.read_qa(spark, str(tmp_path), "test", "other", ("set",))
    (tmp_path / "trims.json").write_text('{"v": 12.125, "w": 0}')
    assert {r.vid: (r.start, r.end) for r in files.read_trims(spark, str(tmp_path / "trims.json")).collect()} == {"v": (12.125, 72.125), "w": (0.0, 60.0)}
    for name in ("video/v.mp4", "video/._v.mp4", "video/x.mp4", "transcript/v.vtt", "transcript/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.vid for r in files.list_media(spark, str(tmp_path / "video"), str(tmp_path / "transcript")).collect()] == ["v"]


def test_manifests_and_caches(spark, tmp_path):
    manifest = spark.createDataFrame([("v", 100.0, [(0.0, 60.0), (60.0, 100.0)], 1)], "vid string, duration double, chunks array<struct<s:double,e:double>>, oracle_idx int")
    at = str(tmp_path / "manifest")
    files.write_manifest(manifest, at)
    assert [(r.idx, r.s, r.is_oracle) for r in files.read_chunks(spark, at).collect()] == [(0, 0.0, False), (1, 60.0, True)]
    for wrong in (lambda: files.write_manifest(manifest, at), lambda: files.write_manifest(manifest.limit(0), str(tmp_path / "none"))):
        with pytest.raises(Exception):
            wrong()
    files.write_manifest(manifest, at, force=True)
    files.write_cache(manifest.select("vid"), str(tmp_path / "cache"), "stand-in", 8)
    assert files.read_cache(spark, str(tmp_path / "cache")).first().asDict() == {"vid": "v", "checkpoint": "stand-in", "num_frames": 8}


def test_results_and_failures(spark, tmp_path):
    rows = spark.createDataFrame([("v", "q1", None, 2, False, "no idea"), ("v", "q2", 1, None, None, "1")], RESULT)
    files.append_results(rows, str(tmp_path / "results"))
    (tmp_path / "results/blank.json").write_text("\n\n")
    assert sorted(files.read_results(spark, str(tmp_path / "results")).collect()) == sorted(rows.collect())
    (tmp_path / "results/torn.json").write_text('{"video": "v", "qi')
    with pytest.raises(Exception):
        files.read_results(spark, str(tmp_path / "results")).collect()
    log = str(tmp_path / "log")
    bad = spark.createDataFrame([("v", "video", "gone", "t", "e" * 900), ("v", "video", "gone", "t", "e"), ("w", "video", "gone", "t", "e")], "id string, artifact string, reason string, when string, error string")
    files.append_failures(bad.limit(2), log, spark)
    files.append_failures(bad, log, spark)
    with open(f"{log}/torn.json", "w") as f:
        f.write('{"id": "x"')
    found = files.read_failures(spark, log).collect()
    assert sorted(r.id for r in found) == ["v", "w"] and max(len(r.error) for r in found) <= 500


def test_splits_that_are_not_written_again_stay(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps({"subsets": {"clips": {"train": ["a", "b"], "val": ["c"]}, "cars": {"train": ["d"]}}}))
    members = files.read_splits(spark, str(tmp_path / "split.json"))
    assert sorted((r.subset, r.split, r.pos, r.id) for r in members.collect()) == [("cars", "train", 0, "d"), ("clips", "train", 0, "a"), ("clips", "train", 1, "b"), ("clips", "val", 0, "c")]
    at = str(tmp_path / "current")
    files.write_splits(members, at)
    files.write_splits(members.filter("id = 'b'"), at)
    assert sorted(r.id for r in files.read_written_splits(spark, at).collect()) == ["b", "c", "d"]


def test_tracks_of_both_kinds(spark):
    row = spark.range(1).select(files.merged_tracks(F.expr("map('en', 'm', 'de', 'm')"), F.expr("map('EN-gb', 'a', 'en', 'a')")).alias("t"), files.merged_tracks(F.expr("cast(null as map<string,string>)"), F.expr("map('fr', 'a')")).alias("u"))
    got = row.select("t", "u", files.english_tracks(F.col("t")).alias("e")).first()
    assert got.t == {"en": "a", "de": "m", "EN-gb": "a"} and got.u == {"fr": "a"} and got.e == ["EN-gb", "en"]


def test_a_stream_that_is_run_again_writes_nothing_twice(spark, tmp_path):
    said = tmp_path / "said"
    said.mkdir()
    kind = "video string, qid string, gold int, raw string"
    source = lambda: spark.readStream.schema(kind).json(str(said))
    out = str(tmp_path / "out")
    (said / "1.json").write_text('{"video": "v", "qid": "q1", "gold": 1, "raw": "1"}\n{"video": "v", "qid": "q2", "gold": 1, "raw": "?"}\n')
    results.score_stream(source(), out, str(tmp_path / "c1")).awaitTermination()
    results.score_stream(source(), out, str(tmp_path / "c2")).awaitTermination()  # the same batch under another checkpoint
    (said / "2.json").write_text('{"video": "v", "qid": "q3", "gold": 0, "raw": "0"}\n{"video": "v", "qid": "q1", "gold": 1, "raw": "3"}\n')
    results.score_stream(source(), out, str(tmp_path / "c2"), lambda: results.stream_results(spark, out)).awaitTermination()
    assert sorted((r.qid, r.correct) for r in results.stream_results(spark, out).collect()) == [("q1", True), ("q2", False), ("q3", True)]


def test_provenance(spark):
    row = runs.with_provenance(spark.range(1), "m_d").first()
    assert row.run_id == "m_d" and row.versions["pyspark"].startswith("4.")


def test_a_captions_data_source(spark, tmp_path):
    from spindrift.sources import captions

    captions.register(spark)
    cues = spark.createDataFrame([("b", 1, 2.0, 4.5, "so we go\non"), ("b", 2, 3600.0, 3601.25, "é -- last"), ("ac", 1, 0.0, 0.001, None), ("z", 3, 1.0, 2.0, "x\n\n \ny")], captions.CUES)
    at = str(tmp_path / "out")
    write = lambda df, mode="append": df.repartition("vid").sortWithinPartitions("vid", "cue_no").write.format("captions").mode(mode).option("path", at).save()
    write(cues)
    read = spark.read.format("captions").option("path", at).option("split", 1).load()
    assert sorted(map(tuple, read.collect())) == [("ac", 1, 0.0, 0.001, ""), ("b", 1, 2.0, 4.5, "so we go\non"), ("b", 2, 3600.0, 3601.25, "é -- last"), ("z", 1, 1.0, 2.0, "x\ny")]
    assert read.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, files.read_vtt(spark, at).select("vid", "cue_no", "start", "end").collect())) == sorted(tuple(r)[:4] for r in read.collect())
    # filters on the video don't open other files, not even broken ones
    (tmp_path / "out/torn.vtt").write_bytes(b"WEBVTT\n\n00:01.000 --> oops\nx\n\n00:02.000 --> 00:03.000\n\xff\xfe\n")
    some = spark.read.format("captions").option("path", at).load().filter("vid IN ('b', 'none') AND start > 10")
    assert [r.text for r in some.collect()] == ["é -- last"] and some.rdd.getNumPartitions() == 1
    assert [(r.cue_no, r.start, r.text) for r in read.filter("vid = 'torn'").collect()] == [(2, 2.0, "\ufffd\ufffd")]
    assert spark.read.format("captions").option("path", at).load().filter("vid = 'nobody'").collect() == []
    # what can't be written leaves no file behind; what is overwritten is gone
    for wrong in (cues.withColumn("vid", F.lit("a/b")), cues.withColumn("vid", F.lit(None).cast("string")), cues.repartition(4, "cue_no").withColumn("vid", F.lit("twice"))):
        with pytest.raises(Exception):
            wrong.write.format("captions").mode("append").option("path", str(tmp_path / "wrong")).save()
    assert not list((tmp_path / "wrong").glob("*.vtt"))
    write(cues.filter("vid = 'z'"), "overwrite")
    assert [p.name for p in (tmp_path / "out").glob("*")] == ["z.vtt"] or sorted(p.name for p in (tmp_path / "out").glob("*.vtt")) == ["z.vtt"]


def test_a_block_of_lines_is_all_that_a_parse_holds():
    from spindrift.sources import captions

    lines = (x for k in range(200_000) for x in ("", f"00:{k % 60:02d}.000 --> 01:00.000", "words", "words"))
    assert sum(1 for _ in captions.parse(lines)) == 200_000
    assert list(captions.parse(iter(["WEBVTT", "", "1", "00:01.5 --> 1:02:03.25 align:start", "a", "b", "", "NOTE x", "", "bad --> 1", "y"]))) == [(1, 1.5, 3723.25, "a\nb")]
    assert [captions.stamp(x) for x in (0, 59.9996, 3723.25)] == ["00:00:00.000", "00:01:00.000", "01:02:03.250"]


def test_unreadable_captions_cost_their_own_cues(spark, tmp_path):
    (tmp_path / "good.vtt").write_text(PLAIN)
    (tmp_path / "bytes.vtt").write_bytes(b"WEBVTT\n\n00:01.000 --> 00:02.000\n\xff\xfe\x00\n")
    (tmp_path / "page.vtt").write_text("<html>not found</html>")
    (tmp_path / "empty.vtt").write_text("")
    (tmp_path / "other.txt").write_text(PLAIN)
    cues, missing = files.read_vtt_or_missing(spark, str(tmp_path))
    assert {r.vid: r.reason for r in missing.collect()} == {"bytes": "not UTF-8", "page": "not WebVTT"}  # Spark's readers don't see empty files
    assert sorted(map(tuple, cues.collect())) == sorted(tuple(r) for r in files.read_vtt(spark, str(tmp_path / "good.vtt")).collect())


def test_the_order_of_files_under_any_partitioning(spark, tmp_path):
    (tmp_path / "set/qa/qa_test.json").mkdir(parents=True)
    want = []
    for name, n in (("a.json", 40), ("b.json", 700), ("c.json", 1)):
        rows = [{"qid": f"{name}{i}", "q": "x" * (i % 50)} for i in range(n)]
        (tmp_path / "set/qa/qa_test.json" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        want += [r["qid"] for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "3k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.read_qa_in_order(spark, str(tmp_path), "test", "set", ("set",)).collect()
            assert [r.qid for r in sorted(got, key=lambda r: r.seq)] == want and sorted(r.seq for r in got) == list(range(741))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path):
    from spindrift.sources import publish

    at, one, two = str(tmp_path / "table"), spark.range(3), spark.range(10)
    publish.publish_table(one, at)

    def dies(folder):
        two.write.parquet(f"{folder}/half")
        raise RuntimeError("the driver is lost")

    for _ in range(2):
        with pytest.raises(RuntimeError):
            publish.publish(spark, at, dies)
        assert spark.read.parquet(publish.current(spark, at)).count() == 3
    reader = spark.read.parquet(publish.current(spark, at))
    publish.publish_table(two, at)
    assert spark.read.parquet(publish.current(spark, at)).count() == 10 and reader.count() == 3
    publish.publish_table(one.limit(1), at, keep=0)
    assert [p.name for p in (tmp_path / "table").iterdir() if p.is_dir()] == [publish.current(spark, at).rsplit("/", 1)[1]]

    def slow(folder):
        two.write.parquet(folder)
        publish.publish_table(one.limit(1), at)

    with pytest.raises(RuntimeError, match="another writer"):
        publish.publish(spark, at, slow)
    assert spark.read.parquet(publish.current(spark, at)).count() == 1
    with pytest.raises(FileExistsError):
        publish.publish_table(one, at, replace=False)
    with pytest.raises(ValueError):
        publish.publish(spark, at, lambda folder: None)
    assert spark.read.parquet(publish.current(spark, at)).count() == 1 and publish.current(spark, str(tmp_path / "none")) == str(tmp_path / "none")


def test_splits_and_manifests_are_published_whole(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "splits")
    members = spark.createDataFrame([("s", "train", 0, "a"), ("s", "val", 0, "b"), ("t", "val", 0, "c")], "subset string, split string, pos int, id string")
    files.write_splits(members, at)
    files.write_splits(members.filter("id = 'b'").withColumn("id", F.lit("new")), at)
    assert sorted(r.id for r in files.read_written_splits(spark, at).collect()) == ["a", "c", "new"]


def test_the_status_of_an_artifact_in_every_order(spark):
    import itertools

    names = ("no_trim", "blacklisted", "needed", "has_video", "has_transcript")
    rows = [(*flags, error) for flags in itertools.product((False, True), repeat=5) for error in (None, "torn")]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names) + ", error string")
    for r in frame.withColumn("said", files.status(*(F.col(n) for n in (*names, "error")))).collect():
        if r.no_trim:
            want = "no_trim"
        elif not r.needed:
            want = "ok"
        elif r.blacklisted:
            want = "blacklisted"
        elif not r.has_video:
            want = "no_video"
        elif not r.has_transcript:
            want = "no_transcript"
        else:
            want = "error: torn" if r.error else "ok"
        assert r.said == want
