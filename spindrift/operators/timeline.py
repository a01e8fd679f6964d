"""Tiling of a timeline around a fixed interval, and assignment of timed text to its tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import expr as X
from spindrift.operators.order import running
from spindrift.schema import CHUNK_SECONDS, MAX_CHUNKS, MIN_CHUNKS, SLIVER_SECONDS


def _fold(start: Column, n: Column, step: float) -> Column:
    """start, start + step, ... by repeated addition, n steps; a fold, so that sums round as a loop's do."""
    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(start), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + step)))


def segment(rows: DataFrame, size: float = CHUNK_SECONDS, sliver: float = SLIVER_SECONDS) -> DataFrame:
    """``rows`` (start, end, duration of each) with chunks (array of s, e) and oracle_idx.

    Chunks of ``size`` tile outward from [start, end]. A rest at either edge longer than ``sliver`` is a chunk, else it
    joins the neighbour, or is dropped where the neighbour is the fixed interval.
    """
    start, end, duration = F.col("start"), F.col("end"), F.col("duration")
    head = _fold(start, F.floor(start / size).cast("int"), -size)
    tail = _fold(end, F.greatest(F.floor((duration - end) / size), F.lit(0)).cast("int"), size)
    rows = rows.withColumn("__h", F.reverse(head)).withColumn("__t", tail)
    h, t = F.col("__h"), F.col("__t")
    first, last = F.element_at(h, 1), F.element_at(t, -1)
    left = (
        F.when(first > sliver, F.concat(F.array(F.lit(0.0)), h)).when((first > 0) & (F.size(h) > 1), F.concat(F.array(F.lit(0.0)), F.slice(h, F.lit(2), F.size(h)))).otherwise(h)
    )
    rest = duration - last
    right = F.when(rest > sliver, F.concat(t, F.array(duration))).when((rest > 0) & (F.size(t) > 1), F.concat(F.slice(t, F.lit(1), F.size(t) - 1), F.array(duration))).otherwise(t)
    rows = rows.withColumn("__b", F.concat(left, right)).withColumn("oracle_idx", F.size(left) - 1)
    cut = F.zip_with(F.slice(F.col("__b"), F.lit(1), F.size("__b") - 1), F.slice(F.col("__b"), F.lit(2), F.size("__b") - 1), lambda a, b: F.struct(a.alias("s"), b.alias("e")))
    return rows.withColumn("chunks", cut).drop("__h", "__t", "__b")


def reasons(videos: DataFrame, least: int = MIN_CHUNKS, most: int = MAX_CHUNKS) -> DataFrame:
    """``videos`` (start, duration nullable) with chunks, oracle_idx and reason: no_trim, probe_failed, too_short, too_many
    or kept, in that order."""
    cut = segment(videos.withColumn("end", F.bround(F.col("start") + CHUNK_SECONDS, 5)))
    n = F.size("chunks")
    reason = F.when(F.col("start").isNull(), "no_trim").when(F.col("duration").isNull(), "probe_failed").when(n < least, "too_short").when(n > most, "too_many").otherwise("kept")
    return cut.withColumn("reason", reason)


def reason_stats(rows: DataFrame, key: str = "vid", examples: int = 3) -> DataFrame:
    """reason, n and its smallest ids, comma-joined. The examples are picked before they are gathered, so no task sorts
    all rows of a reason."""
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    first = rows.select("reason", key).withColumn("__rn", F.row_number().over(W.partitionBy("reason").orderBy(key))).filter(F.col("__rn") <= examples)
    few = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("examples"))
    return counts.join(few, "reason", "left")


def manifest(files: DataFrame, trims: DataFrame, durations: DataFrame, least: int = MIN_CHUNKS, most: int = MAX_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """The manifest (vid, duration, chunks, oracle_idx) of downloaded ``files`` (vid) that have a trim (vid, start) and a
    probed duration (vid, duration; null or no row: the probe failed), and vid, reason of every file."""
    known = files.select("vid").distinct().join(trims.select("vid", "start"), "vid", "left").join(durations.select("vid", "duration"), "vid", "left")
    judged = reasons(known, least, most)
    return judged.filter("reason = 'kept'").select("vid", "duration", "chunks", "oracle_idx"), judged.select("vid", "reason")


def transcripts(files: DataFrame, cues: DataFrame) -> DataFrame:
    """vid, text, missing: the whole text of each of ``files`` (vid), null where there are no cues at all."""
    said = texts(dedup_lines(cues, ("vid",)), ("vid",))
    read = cues.select("vid").distinct().withColumn("__read", F.lit(True))
    joined = files.select("vid").distinct().join(said, "vid", "left").join(read, "vid", "left")
    return joined.select("vid", F.when(F.col("__read"), F.coalesce("text", F.lit(""))).alias("text"), F.col("__read").isNull().alias("missing"))


def assign_cues(cues: DataFrame, ranges: DataFrame) -> DataFrame:
    """cues (vid, cue_no, start, end, text) with ``chunk``: the range that a cursor which never moves back gives each.

    ranges: vid, chunk, lo, hi, apart from each other, in any order and with any names. A cue goes to the range after
    all those that ended before it starts, or before an earlier cue started, if it reaches that range; ends are closed.
    Others are dropped. The count of ranges passed comes from one sorted union of both tables by video, not from a join
    of all cues with all ranges.
    """
    placed = ranges.select("vid", "chunk", "lo", "hi", (F.row_number().over(W.partitionBy("vid").orderBy("lo", "hi")) - 1).alias("__at"))
    ends = placed.select("vid", F.col("hi").alias("at"), F.lit(1).alias("is_end"), F.lit(None).cast(cues.schema["cue_no"].dataType).alias("cue_no"))
    starts = cues.select("vid", F.col("start").alias("at"), F.lit(0).alias("is_end"), "cue_no")
    # at one moment the cue comes first: a range that ends as the cue starts is not passed
    passed = F.sum("is_end").over(W.partitionBy("vid").orderBy("at", "is_end").rowsBetween(W.unboundedPreceding, 0))
    f = ends.unionByName(starts).withColumn("f", passed).filter("is_end = 0").select("vid", "cue_no", "f")
    cursor = f.withColumn("__at", F.max("f").over(W.partitionBy("vid").orderBy("cue_no").rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("f")
    met = cues.join(cursor, ["vid", "cue_no"]).join(placed.select("vid", "__at", "chunk", "lo"), ["vid", "__at"])
    return met.filter(F.col("lo") <= F.col("end")).drop("lo", "__at")


def dedup_lines(cues: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, cue_no, line_no, line: normalised lines that aren't empty, without those that equal the line kept before."""
    each = cues.select(*by, "cue_no", F.posexplode(X.lines(F.col("text"))).alias("line_no", "raw")).withColumn("line", X.normalized_line(F.col("raw"))).filter("line <> ''")
    before = F.lag("line").over(W.partitionBy(*by).orderBy("cue_no", "line_no"))
    return each.withColumn("__before", before).filter("NOT (line <=> __before)").drop("__before", "raw")


def joined_lines() -> F.Column:
    held = F.array_sort(F.collect_list(F.struct("cue_no", "line_no", "line")))
    return F.array_join(F.transform(held, lambda x: x["line"]), " ")


def texts(lines: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, text: lines joined by one blank, in order."""
    return lines.groupBy(*by).agg(joined_lines().alias("text"))


def range_texts(cues: DataFrame, ranges: DataFrame) -> DataFrame:
    """vid, chunk, text for every range; a silent one has the empty text."""
    said = texts(dedup_lines(assign_cues(cues, ranges), ("vid", "chunk")), ("vid", "chunk"))
    return ranges.select("vid", "chunk").join(said, ["vid", "chunk"], "left").select("vid", "chunk", F.coalesce("text", F.lit("")).alias("text"))


def trim_cues(cues: DataFrame, lo: Column, size: float = CHUNK_SECONDS) -> DataFrame:
    """Cues that lie within [lo, lo + size], moved to start at 0."""
    return cues.filter((F.col("start") >= lo) & (F.col("end") <= lo + size)).withColumn("start", F.col("start") - lo).withColumn("end", F.col("end") - lo)


def overlapping(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo <= b_hi) & (b_lo <= a_hi)


def overlap_counts(cues: DataFrame, block: int = 10_000) -> DataFrame:
    """vid, cue_no, n_overlaps: with how many other cues of its video each one overlaps, ends included.

    A cue meets those that start no later than it ends, less those that end before it starts. Both are running counts
    over one order of all starts and ends, in which a start comes before an end at the same moment, so neither pairs nor
    a join by inequality are made, and a video of many cues is counted by several tasks. Cues with no start or end, or
    that end before they start, overlap nothing.
    """
    sound = (F.col("start") <= F.col("end")) & F.col("end").isNotNull()
    whole = cues.filter(sound)
    points = whole.select("vid", "cue_no", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("is_end")), F.struct(F.col("end").alias("at"), F.lit(1).alias("is_end")))).alias("p"))
    points = points.select("vid", "cue_no", "p.at", "p.is_end")
    met = running(points, "vid", ["at", "is_end", "cue_no"], {"begun": 1 - F.col("is_end"), "over": F.col("is_end")}, block)
    begun, over = F.max(F.when(F.col("is_end") == 1, F.col("begun"))), F.max(F.when(F.col("is_end") == 0, F.col("over")))
    counted = met.groupBy("vid", "cue_no").agg((begun - over - 1).alias("n_overlaps"))
    return counted.unionByName(cues.filter(~F.coalesce(sound, F.lit(False))).select("vid", "cue_no", F.lit(0).cast("bigint").alias("n_overlaps")))


def spread_words(cues: DataFrame) -> DataFrame:
    """vid, cue_no, word_no, word, start, end: a cue's words spread evenly over it; the last ends with the cue."""
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")
    each = cues.select("vid", "cue_no", "start", "end", F.size(words).alias("n"), F.posexplode(words).alias("word_no", "word"))
    step = (F.col("end") - F.col("start")) / F.col("n")
    timed = each.select("vid", "cue_no", "word_no", "word", (F.col("start") + step * F.col("word_no")).alias("start"), F.col("end").alias("stop"))
    nxt = F.lead("start").over(W.partitionBy("vid", "cue_no").orderBy("word_no"))
    return timed.withColumn("end", F.coalesce(nxt, F.col("stop"))).drop("stop")
