"""Readers and writers: question files, trims, manifests, captions, caches, results and failure logs."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpointed
from spindrift.functions import expr as X
from spindrift.schema import CUE, FAILURE, QA, RESULT
from spindrift.sources.publish import current, publish, publish_table


def read_qa(spark: SparkSession, root: str, split: str, dataset: str, datasets: tuple[str, ...]) -> DataFrame:
    """JSON lines with an explicit schema: the label columns are there, null, in an unlabelled split. ``datasets`` are
    the known ones."""
    if dataset not in datasets:
        raise ValueError(f"unknown dataset {dataset!r}")
    return spark.read.schema(QA).json(f"{root}/{dataset}/qa/qa_{split}.json")


def in_file_order(rows: DataFrame, name: str = "seq") -> DataFrame:
    """``rows``, as a reader of files returns them, with ``name``: 0, 1, ... by file path, then by place in the file.

    A split's rows come in order, so their numbers need no sort: what comes before a split is the sum of the rows of the
    splits before it, by path and offset. The same under any size of splits. The rows are written once, so that what is
    counted is what is numbered; only a count for each split reaches the driver.
    """
    at = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block")]
    held = checkpointed(rows.select("*", *at).withColumn("__place", F.monotonically_increasing_id()))
    splits = held.groupBy("__path", "__block").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("n")).orderBy("__path", "__block").collect()
    starts = accumulate((s.n for s in splits), initial=0)
    table = rows.sparkSession.createDataFrame([(s["__path"], s["__block"], start - s["__first"]) for s, start in zip(splits, starts)], "__path string, __block bigint, __shift bigint")
    return held.join(table, ["__path", "__block"]).withColumn(name, F.col("__place") + F.col("__shift")).drop("__path", "__block", "__place", "__shift")


def read_qa_in_order(spark: SparkSession, root: str, split: str, dataset: str, datasets: tuple[str, ...]) -> DataFrame:
    """The questions with ``seq``, their place in the file: what "the first N questions" goes by."""
    return in_file_order(read_qa(spark, root, split, dataset, datasets))


def read_trims(spark: SparkSession, path: str) -> DataFrame:
    """vid, start, end of an object of start seconds."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("vid", "start"))
    return rows.withColumn("end", F.bround(F.col("start") + 60, 5))


def write_manifest(manifest: DataFrame, path: str, force: bool = False) -> None:
    """Refuses an empty manifest, and an existing path unless ``force``; then the one before stays readable until the new
    one is whole."""
    if manifest.isEmpty():
        raise ValueError("the manifest is empty")
    publish_table(manifest.sort("vid"), path, replace=force)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """vid, idx, s, e, is_oracle of a manifest."""
    rows = spark.read.parquet(current(spark, path)).select("vid", "oracle_idx", F.posexplode("chunks").alias("idx", "c"))
    return rows.select("vid", "idx", "c.s", "c.e", (F.col("idx") == F.col("oracle_idx")).alias("is_oracle"))


def list_media(spark: SparkSession, videos: str, transcripts: str) -> DataFrame:
    """vid, path_to_video, path_to_transcript: files paired by stem; hidden stems and captions that aren't .vtt are left."""
    def stems(path: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias(name))
        return files.withColumn("vid", F.regexp_extract(name, r"([^/]+)\.[^./]+$", 1)).filter("vid <> '' AND NOT startswith(vid, '._')")

    v = stems(videos, "path_to_video").groupBy("vid").agg(F.min("path_to_video").alias("path_to_video"))
    t = stems(transcripts, "path_to_transcript").filter("endswith(path_to_transcript, '.vtt')")
    return v.join(t, "vid")


_STAMP = r"((?:\d+:)?\d+:\d+\.\d+)"


def raw_cues(files: DataFrame) -> DataFrame:
    """files (vid, value: whole text) as cues: vid, cue_no, start, end, raw."""
    blocks = files.select("vid", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n\n+")).alias("cue_no", "block"))
    head = rf"(?s){_STAMP}\s+-->\s+{_STAMP}[^\n]*\n?(.*)"
    cues = blocks.filter(F.col("block").contains("-->"))
    part = lambda i: F.regexp_extract("block", head, i)
    return cues.select("vid", "cue_no", X.seconds_of(part(1)).alias("start"), X.seconds_of(part(2)).alias("end"), part(3).alias("raw"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """files (vid, value: whole text) as cues: vid, cue_no, start, end, text without tags."""
    return raw_cues(files).withColumn("text", F.regexp_replace("raw", "<[^>]+>", "")).drop("raw")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.vtt$", 1)
    return parse_vtt(spark.read.text(path, wholetext=True).select(name.alias("vid"), "value")).select(*CUE.names)


def read_vtt_or_missing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The cues of caption files, and vid, reason of the files that can't be read as captions: those that aren't UTF-8, or
    don't begin as WebVTT does. Such a file costs its own cues only. Readers of files pass over empty ones, which have no cues either way."""
    files = spark.read.format("binaryFile").load(path).filter("endswith(path, '.vtt')")
    files = files.select(F.regexp_extract("path", r"([^/]+)\.vtt$", 1).alias("vid"), F.expr("try_validate_utf8(CAST(content AS STRING))").alias("value"))
    reason = F.when(F.col("value").isNull(), "not UTF-8").when(~F.col("value").rlike("^\\x{FEFF}?WEBVTT"), "not WebVTT")
    read = files.withColumn("reason", reason)
    return parse_vtt(read.filter("reason IS NULL").select("vid", "value")).select(*CUE.names), read.filter("reason IS NOT NULL").select("vid", "reason")


def read_raw_vtt(spark: SparkSession, path: str) -> DataFrame:
    """vid, cue_no, start, end, raw: cues with their tags, as ``karaoke_words`` takes them."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.vtt$", 1)
    return raw_cues(spark.read.text(path, wholetext=True).select(name.alias("vid"), "value"))


def karaoke_words(cues: DataFrame) -> DataFrame:
    """vid, cue_no, word_no, word, start, end of cues whose raw text times each word by a tag; the last word ends with
    its cue. cues: vid, cue_no, start, end, raw.

    Of a cue's lines the one with tags is read, since the others repeat what was said before. A cue without tags says a
    word only where its second line holds one, which then lasts as long as the cue.
    """
    lines = F.split("raw", "\n")
    tagged = F.filter(lines, lambda x: x.rlike(rf"<{_STAMP}>"))
    plain = F.trim(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    line = F.when(F.size(tagged) > 0, F.get(tagged, F.lit(0))).otherwise(plain)
    bare = F.regexp_replace(line, rf"<(?!{_STAMP}>)[^>]*>", "")
    parts = F.split(bare, r"<(?:\d+:)?\d+:\d+\.\d+>")
    starts = F.concat(F.array(F.col("start")), F.transform(F.regexp_extract_all("__line", F.lit(rf"<{_STAMP}>"), F.lit(1)), X.seconds_of))
    rows = cues.withColumn("__line", line).select("vid", "cue_no", "end", starts.alias("s"), parts.alias("parts"))
    words = F.filter(F.transform("parts", lambda w, i: F.struct(F.trim(w).alias("word"), F.get(F.col("s"), i).alias("at"))), lambda x: x["word"] != "")
    each = rows.select("vid", "cue_no", "end", words.alias("w")).select("vid", "cue_no", "end", "w", F.posexplode("w").alias("word_no", "x"))
    stop = F.coalesce(F.get("w", F.col("word_no") + 1)["at"], F.col("end"))
    return each.select("vid", "cue_no", "word_no", "x.word", F.col("x.at").alias("start"), stop.alias("end"))


def timed_words(spark: SparkSession, path: str) -> DataFrame:
    """vid, cue_no, word_no, word, start, end of caption files: by their tags; a file without any tag, as people upload
    them, has each cue's words spread evenly."""
    from spindrift.operators.timeline import spread_words

    cues = read_raw_vtt(spark, path)
    tagged = cues.groupBy("vid").agg(F.max(F.col("raw").rlike(rf"<{_STAMP}>")).alias("__tagged"))
    known = cues.join(tagged, "vid")
    bare = known.filter("NOT __tagged").withColumn("text", F.regexp_replace("raw", "<[^>]+>", ""))
    return karaoke_words(known.filter("__tagged")).unionByName(spread_words(bare).select("vid", "cue_no", "word_no", "word", "start", "end"))


def write_cache(rows: DataFrame, path: str, checkpoint: str, num_frames: int) -> None:
    """Vectors with the stamp of the encoder that made them; an existing cache is an error."""
    publish_table(rows.withColumns({"checkpoint": F.lit(checkpoint), "num_frames": F.lit(num_frames)}), path, replace=False)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def append_results(results: DataFrame, path: str) -> None:
    results.select(*RESULT.names).write.mode("append").option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results written before. Blank lines are passed over; a malformed one is an error, since a lost result would be
    answered twice."""
    return spark.read.schema(RESULT).option("mode", "FAILFAST").json(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Whole records; torn lines are left out."""
    rows = spark.read.schema(FAILURE).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")


def new_failures(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Those not logged yet, once each, their error text cut to 500 characters."""
    return rows.join(known.select("id", "artifact"), ["id", "artifact"], "left_anti").dropDuplicates(["id", "artifact"]).withColumn("error", F.substring("error", 1, 500))


def append_failures(rows: DataFrame, path: str, spark: SparkSession) -> None:
    """Failures that the log at ``path`` doesn't hold yet, by id and artifact, go to its end."""
    known = read_failures(spark, path) if _exists(spark, path) else rows.limit(0)
    new_failures(rows, known).select("id", "artifact", "reason", "when", "error").write.mode("append").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """subset, split, pos, id of a split file."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "subsets map<string,map<string,array<string>>>").alias("j"))
    return rows.select(F.explode("j.subsets").alias("subset", "m")).select("subset", F.explode("m").alias("split", "ids")).select("subset", "split", F.posexplode("ids").alias("pos", "id"))


def write_splits(members: DataFrame, path: str) -> None:
    """members (subset, split, pos, id) by partition: only the splits and subsets that ``members`` has are written anew, the
    others at ``path`` stay. Readers see all of the new version or none of it."""
    spark, new = members.sparkSession, members.select("subset", "split", "pos", "id")
    if _exists(spark, path):
        old = read_written_splits(spark, path)
        new = new.unionByName(old.join(new.select("split", "subset").distinct(), ["split", "subset"], "left_anti").select(new.columns))
    publish(spark, path, lambda folder: new.write.partitionBy("split", "subset").parquet(folder))


def read_written_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path)).select("subset", "split", "pos", "id")


def merged_tracks(manual: Column, automatic: Column) -> Column:
    """Both kinds of caption tracks in one map; the automatic one of a language replaces the manual one."""
    manual, automatic = F.coalesce(manual, F.create_map().cast("map<string,string>")), F.coalesce(automatic, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(manual, lambda k, _: ~F.map_contains_key(automatic, k))
    return F.map_concat(kept, automatic)


def english_tracks(tracks: Column) -> Column:
    """Keys that start with ``en``, in either case, of a map of caption tracks, in order."""
    return F.array_sort(F.filter(F.map_keys(tracks), lambda k: F.lower(k).startswith("en")))


def status(no_trim: Column, blacklisted: Column, needed: Column, has_video: Column, has_transcript: Column, error: Column) -> Column:
    """Of one artifact, the first that holds."""
    return (
        F.when(no_trim, "no_trim").when(~needed, "ok").when(blacklisted, "blacklisted").when(~has_video, "no_video").when(~has_transcript, "no_transcript")
        .when(error.isNotNull(), F.concat(F.lit("error: "), error)).otherwise("ok")
    )
