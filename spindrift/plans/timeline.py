"""Queries over timelines and cues."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpoint_folder
from spindrift.functions import encoders
from spindrift.functions import expr as X
from spindrift.operators import timeline as L
from spindrift.plans import sql as S
from spindrift.plans.lexical import talk_chunks
from spindrift.plans.registry import Registry, table
from spindrift.sources import captions

query = Registry()
#: Cues are as long as an event's value says, up to this many seconds; a user's first event is second 0.
LONGEST = 120.0


def cue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, cue_no, start, end, text of events."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("vid"), F.col("event_id").alias("cue_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("text"), F.round(F.least(F.abs("value"), F.lit(LONGEST)), 3).alias("len"))
    # 60 minutes of the clock are squeezed into one second, so that timelines have some hundred chunks
    start = F.round((F.col("us") - F.min("us").over(W.partitionBy("vid"))) / 3.6e9, 3)
    return rows.withColumn("start", start).select("vid", "cue_no", "start", F.round(F.col("start") + F.col("len"), 3).alias("end"), "text")


def range_table(cues: DataFrame) -> DataFrame:
    """vid, chunk, lo, hi: tiles of 60 s over each video."""
    spans = cues.groupBy("vid").agg(F.max("end").alias("duration")).withColumn("n", F.floor(F.col("duration") / 60).cast("int") + 1)
    return spans.select("vid", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk")).select("vid", "chunk", (F.col("chunk") * 60.0).alias("lo"), (F.col("chunk") * 60.0 + 60.0).alias("hi"))


_CUES = """e AS (SELECT user_id AS vid, event_id AS cue_no, epoch_us(ts::TIMESTAMP) AS us, event_type AS text, round(least(abs(value), 120.0), 3) AS len FROM events),
s AS (SELECT vid, cue_no, text, len, round((us - min(us) OVER (PARTITION BY vid)) / 3.6e9, 3) AS start FROM e),
cu AS (SELECT vid, cue_no, start, round(start + len, 3) AS stop, text FROM s),
rg AS (SELECT vid, k AS chunk, k * 60.0 AS lo, k * 60.0 + 60.0 AS hi FROM (SELECT vid, unnest(range(0, floor(max(stop) / 60)::BIGINT + 1)) AS k FROM cu GROUP BY vid)),
f AS (SELECT vid, cue_no, start, stop, text, greatest(ceil(start / 60)::BIGINT - 1, 0) AS f FROM cu),
cr AS (SELECT *, max(f) OVER (PARTITION BY vid ORDER BY cue_no) AS chunk FROM f),
asg AS (SELECT cr.vid, cr.cue_no, cr.chunk, cr.text FROM cr JOIN rg ON rg.vid = cr.vid AND rg.chunk = cr.chunk WHERE rg.lo <= stop)"""


@query(f"WITH {_CUES} SELECT vid, cue_no, chunk FROM asg")
def bucket_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = cue_table(spark, sf_dir)
    return L.assign_cues(cues, range_table(cues)).select("vid", "cue_no", "chunk")


@query(f"""WITH {_CUES}, d AS (SELECT *, lag(text) OVER (PARTITION BY vid, chunk ORDER BY cue_no) AS b
  FROM asg), k AS (SELECT vid, chunk, string_agg(text, ' ' ORDER BY cue_no) AS text FROM d WHERE text IS DISTINCT FROM b GROUP BY vid, chunk)
  SELECT rg.vid, rg.chunk, coalesce(k.text, '') AS text FROM rg LEFT JOIN k USING (vid, chunk)""")
def silent_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = cue_table(spark, sf_dir)
    return L.range_texts(cues, range_table(cues))


@query(f"""WITH {_CUES}, m AS (SELECT vid, arg_min(start, cue_no) AS t FROM cu GROUP BY vid)
  SELECT cu.vid, cue_no, round(start - t, 3) AS start, round(stop - t, 3) AS stop FROM cu JOIN m USING (vid) WHERE start >= t AND stop <= t + 60""")
def trim_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = cue_table(spark, sf_dir)
    first = cues.groupBy("vid").agg(F.min_by("start", "cue_no").alias("t"))
    got = L.trim_cues(cues.join(first, "vid"), F.col("t"))
    return got.select("vid", "cue_no", F.round("start", 3).alias("start"), F.round("end", 3).alias("stop"))


_VIDEOS = """v AS (SELECT o_custkey AS vid, count(*) AS n, (min(o_orderkey) % 400)::DOUBLE AS st, (count(*) * 75)::DOUBLE AS extra FROM orders GROUP BY o_custkey),
w AS (SELECT vid, CASE WHEN vid % 10 = 0 THEN NULL ELSE st END AS st, CASE WHEN vid % 7 = 0 THEN NULL ELSE st + 60 + extra % 1300 END AS duration FROM v)"""
_SEGMENT = """h AS (SELECT vid, st, duration, st + 60 AS en, floor(st / 60)::BIGINT AS nh, greatest(floor((duration - st - 60) / 60), 0)::BIGINT AS nt
  FROM w WHERE st IS NOT NULL AND duration IS NOT NULL),
g AS (SELECT *, st - 60 * nh AS h0, duration - en - 60 * nt AS rest FROM h),
n AS (SELECT *, nh + (h0 > 10)::INT + 1 + nt + (rest > 10)::INT AS n_chunks, nh + (h0 > 10)::INT AS oracle_idx,
  CASE WHEN h0 > 10 OR (h0 > 0 AND nh > 0) THEN 0 ELSE h0 END AS first, CASE WHEN rest > 10 OR (rest > 0 AND nt > 0) THEN duration ELSE en + 60 * nt END AS last FROM g)"""


def video_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, start, duration: a video per customer with orders; some lack one or the other."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("vid")).agg((F.min("o_orderkey") % 400).cast("double").alias("st"), (F.count(F.lit(1)) * 75).cast("double").alias("extra"))
    start = F.when(F.col("vid") % 10 != 0, F.col("st"))
    return per.select("vid", start.alias("start"), F.when(F.col("vid") % 7 != 0, F.col("st") + 60 + F.col("extra") % 1300).alias("duration"))


@query(f"WITH {_VIDEOS}, {_SEGMENT} SELECT vid, n_chunks, oracle_idx, first, last FROM n")
def segment_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = video_table(spark, sf_dir).filter("start IS NOT NULL AND duration IS NOT NULL").withColumn("end", F.bround(F.col("start") + 60, 5))
    cut = L.segment(rows)
    return cut.select("vid", F.size("chunks").cast("bigint").alias("n_chunks"), F.col("oracle_idx").cast("bigint").alias("oracle_idx"), F.col("chunks")[0]["s"].alias("first"), F.element_at("chunks", -1)["e"].alias("last"))


@query(f"""WITH {_VIDEOS}, {_SEGMENT}, r AS (SELECT w.vid, CASE WHEN w.st IS NULL THEN 'no_trim' WHEN w.duration IS NULL THEN 'probe_failed'
  WHEN n_chunks < 2 THEN 'too_short' WHEN n_chunks > 20 THEN 'too_many' ELSE 'kept' END AS reason FROM w LEFT
  JOIN n USING (vid)), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY vid) AS rn FROM r)
  SELECT reason, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN vid::VARCHAR END, ',' ORDER BY vid) AS examples FROM k GROUP BY reason""")
def manifest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reason_stats(L.reasons(video_table(spark, sf_dir)))


_NORMALIZED = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(line, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("cue_no"), F.coalesce("text", F.lit("")).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''),
  chr(10)), 1) AS i FROM documents), n AS (SELECT doc_id, i, """ + _NORMALIZED + r""" AS line
  FROM l), k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM n WHERE line <> '')
  SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM k WHERE line IS DISTINCT FROM b GROUP BY doc_id""")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = L.dedup_lines(_document_lines(spark, sf_dir), ("doc_id",))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(r"""WITH c AS (SELECT conv_id AS vid, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx, string_split(coalesce(text,
  ''), chr(10)) AS ls FROM conversations), l AS (SELECT vid, idx, idx // 2 AS chunk, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM c), n AS (SELECT vid, idx, chunk, i, """ + _NORMALIZED + r""" AS line
  FROM l), k AS (SELECT *, lag(line) OVER (PARTITION BY vid, chunk ORDER BY idx, i) AS b FROM n WHERE line <> '')
  SELECT vid, chunk, count(*) AS n_lines, string_agg(line, ' ' ORDER BY idx, i) AS text FROM k WHERE line IS DISTINCT FROM b GROUP BY vid, chunk""")
def dedup_lines_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns are a chunk; a line equal to the one kept before it goes, but each chunk starts afresh."""
    cues = talk_chunks(spark, sf_dir).select("vid", F.floor(F.col("idx") / 2).alias("chunk"), F.col("idx").alias("cue_no"), F.coalesce("text", F.lit("")).alias("text"))
    return L.dedup_lines(cues, ("vid", "chunk")).groupBy("vid", "chunk").agg(F.count(F.lit(1)).alias("n_lines"), L.joined_lines().alias("text"))


@query("""WITH w AS (SELECT conv_id AS vid, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws
  FROM conversations), e AS (SELECT vid, turn, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w)
  SELECT vid, turn, i AS word_no, word, round(turn * 60.0 + 60.0 / n * i, 4) AS start, round(CASE WHEN i = n - 1 THEN turn * 60.0 + 60.0
  ELSE turn * 60.0 + 60.0 / n * (i + 1) END, 4) AS stop FROM e""")
def word_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("vid"), F.col("turn").alias("cue_no"), (F.col("turn") * 60.0).alias("start"), (F.col("turn") * 60.0 + 60.0).alias("end"), "text")
    words = L.spread_words(turns)
    return words.select("vid", F.col("cue_no").alias("turn"), "word_no", "word", F.round("start", 4).alias("start"), F.round("end", 4).alias("stop"))


@query("""WITH f AS (SELECT p_partkey, p_size * 37 AS total, least(7, p_size * 37) AS n FROM part)
  SELECT p_partkey, array_to_string(list_transform(range(0, n), lambda i: round_even(i * (total - 1) / greatest(n - 1, 1)::DOUBLE, 0)::INT),
  ',') AS frames FROM f""")
def frame_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", X.frame_indices(F.col("p_size") * 37, F.lit(7)).alias("f"))
    return rows.select("p_partkey", F.array_join(F.transform("f", lambda i: i.cast("string")), ",").alias("frames"))


@query("""WITH w AS (SELECT p_partkey, p_size * 37 AS total, round_even(p_size * 0.5 * 25, 0)::INT AS lo, least(p_size * 37 - 1,
  round_even((p_size * 0.5 + 1) * 25, 0)::INT - 1) AS hi FROM part), f AS (SELECT *, least(8, hi - lo + 1) AS n FROM w WHERE hi >= lo)
  SELECT p_partkey, array_to_string(list_transform(range(0, n), lambda i: lo + round_even(i * (hi - lo) / greatest(n - 1, 1)::DOUBLE, 0)::INT),
  ',') AS frames FROM f""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("p_size") * 0.5
    rows = table(spark, sf_dir, "part").select("p_partkey", X.window_frame_indices(F.col("p_size") * 37, F.lit(25.0), F.lit(8), at, at + 1).alias("f"))
    return rows.filter("f IS NOT NULL").select("p_partkey", F.array_join(F.transform("f", lambda i: i.cast("string")), ",").alias("frames"))


@query("SELECT p_partkey, greatest(1, least(128, floor(p_size * 3.7)::INT)) AS frames FROM part")
def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.frame_budget(F.col("p_size") * 3.7, 1.0, 128).alias("frames"))


@query(f"""WITH {_CUES}, t AS (SELECT *, (start * 1000)::BIGINT AS ms FROM cu)
SELECT vid, cue_no, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp, round(ms / 1000.0, 3) AS seconds FROM t""")
def cue_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts as time stamps, and the stamps as seconds again."""
    rows = cue_table(spark, sf_dir).select("vid", "cue_no", X.stamp_of(F.col("start")).alias("stamp"))
    return rows.withColumn("seconds", F.round(X.seconds_of(F.col("stamp")), 3))


@query(f"""WITH {_CUES},
m AS (
  SELECT vid, string_agg(text, ' ' ORDER BY cue_no) AS text
  FROM (SELECT *, lag(text) OVER (PARTITION BY vid ORDER BY cue_no) AS b FROM cu) WHERE text IS DISTINCT FROM b GROUP BY vid),
fl AS (SELECT DISTINCT doc_id % 200 AS vid FROM documents)
SELECT vid, text, text IS NULL AS missing FROM fl LEFT JOIN m USING (vid)""")
def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole transcripts of the videos asked for; those without a caption file are counted as missing."""
    files = table(spark, sf_dir, "documents").select((F.col("doc_id") % 200).alias("vid"))
    return L.transcripts(files, cue_table(spark, sf_dir))


@query(f"""WITH {_VIDEOS}, {_SEGMENT}
SELECT n.vid, n.duration, n_chunks, oracle_idx FROM n WHERE n_chunks BETWEEN 2 AND 20""")
def built_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = video_table(spark, sf_dir)
    kept, _ = L.manifest(videos, videos.select("vid", "start").filter("start IS NOT NULL"), videos.select("vid", "duration"))
    return kept.select("vid", "duration", F.size("chunks").cast("bigint").alias("n_chunks"), F.col("oracle_idx").cast("bigint").alias("oracle_idx"))


_BOTH = """c AS (SELECT conv_id AS vid, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx, coalesce(text, '') AS text FROM conversations)"""
_SPLIT = "list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')"


@query(f"""WITH {_BOTH},
w AS (SELECT vid, idx, {_SPLIT} AS ws, [(idx * 60)::VARCHAR, (idx * 60 + 60)::VARCHAR] AS fs FROM c),
h AS (SELECT vid, idx, {S.hashed("ws")} AS t, {S.hashed("fs")} AS v FROM w)
SELECT vid, idx, i, round(v[i] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS video, round(t[i] / greatest(sqrt(list_dot_product(t, t)), 1e-12), 6) AS transcript
FROM (SELECT *, unnest(range(1, 33)) AS i FROM h) WHERE vid % 7 <> 0""")
def chunk_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both towers of a cache built with the stand-in encoder, by components; videos that can't be decoded are left out."""
    chunks = talk_chunks(spark, sf_dir).select("vid", "idx", (F.col("idx") * 60.0).alias("s"), (F.col("idx") * 60.0 + 60.0).alias("e"), "text")

    def decode(vid: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if v % 7 == 0 else [int(a), int(b)] for v, a, b in zip(vid, s, e)], dtype=object)

    made, _ = encoders.encode_chunks(chunks, "hash", decode)
    each = made.select("vid", "idx", F.posexplode(F.arrays_zip(F.col("v").alias("v"), F.col("t").alias("t"))).alias("at", "x"))
    return each.select("vid", F.col("idx").cast("bigint").alias("idx"), (F.col("at") + 1).cast("bigint").alias("i"), F.round("x.v", 6).alias("video"), F.round("x.t", 6).alias("transcript"))


@query(f"""WITH {_BOTH}, o AS (SELECT vid || '#' || idx AS qid, vid, string_split(text, ' ')[1] AS q, idx FROM c),
f AS (SELECT qid, vid, 'question' AS query_form, q AS text FROM o UNION ALL SELECT qid, vid, 'question+options', q || ' a b c d' FROM o),
h AS (SELECT qid, vid, query_form, {S.hashed("ws")} AS h FROM (SELECT *, {_SPLIT} AS ws FROM f))
SELECT qid, vid, query_form, i, round(h[i] / greatest(sqrt(list_dot_product(h, h)), 1e-12), 6) AS x FROM (SELECT *, unnest(range(1, 33)) AS i FROM h)""")
def query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries encoded in every form; not all questions have a gold answer, so that form is left out as a whole."""
    rows = talk_chunks(spark, sf_dir)
    word = F.get(F.split(F.coalesce("text", F.lit("")), " "), F.lit(0))
    asked = rows.select(F.concat_ws("#", "vid", "idx").alias("qid"), "vid", word.alias("q"), *[F.lit(x).alias(f"a{i}") for i, x in enumerate("abcd")], F.when(F.col("idx") > 0, "a").alias("ans_corr"))
    made = encoders.encode_queries(asked, "hash")
    return made.select("qid", "vid", "query_form", F.posexplode("query").alias("at", "x")).select("qid", "vid", "query_form", (F.col("at") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query("""WITH w AS (
  SELECT p_partkey, k, round_even((p_size % 5 + 2 * k) * 25.0, 0)::INT AS lo,
    least(p_size * 20 + 59, round_even((p_size % 5 + 2 * k + 1 + p_partkey % 3) * 25.0, 0)::INT - 1) AS hi
  FROM part, range(0, 3) AS ks(k)),
f AS (
  SELECT p_partkey, k, CASE WHEN hi >= lo THEN list_transform(range(0, least(2 + k, hi - lo + 1)),
  lambda i: lo + round_even(i * (hi - lo) / greatest(least(2 + k, hi - lo + 1) - 1, 1)::DOUBLE, 0)::INT) ELSE [] END AS frames FROM w)
SELECT p_partkey, count(*)::INT AS n_windows, sum(len(frames))::INT AS n_frames, string_agg(array_to_string(frames, ','), '|' ORDER BY k) AS frames FROM f GROUP BY p_partkey""")
def frames_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a video's windows read in one pass and parted again; windows beyond its end have none."""
    size, key = F.col("p_size"), F.col("p_partkey")
    start = [(size % 5 + 2 * k).cast("double") for k in range(3)]
    each = [X.window_frame_indices(size * 20 + 60, F.lit(25.0), F.lit(2 + k), x, x + 1 + key % 3) for k, x in enumerate(start)]
    flat, sizes = X.windows_at_once(F.array(*(F.coalesce(x, F.array().cast("array<int>")) for x in each)))
    rows = table(spark, sf_dir, "part").select("p_partkey", flat.alias("f"), sizes.alias("n"))
    again = rows.select("p_partkey", F.size("n").alias("n_windows"), F.size("f").alias("n_frames"), X.split_again(F.col("f"), F.col("n")).alias("w"))
    return again.select("p_partkey", "n_windows", "n_frames", F.array_join(F.transform("w", lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")), "|").alias("frames"))


@query(f"""WITH {_CUES}
SELECT a.vid, a.cue_no, count(b.cue_no) AS n_overlaps
FROM cu a LEFT JOIN cu b ON a.vid = b.vid AND a.cue_no <> b.cue_no AND a.start <= b.stop AND b.start <= a.stop GROUP BY a.vid, a.cue_no""")
def overlapping_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many others of its video each cue overlaps, ends included."""
    return L.overlap_counts(cue_table(spark, sf_dir), block=1000)


@query(f"""WITH {_CUES}
SELECT vid::VARCHAR AS vid, row_number() OVER (PARTITION BY vid ORDER BY cue_no)::INT AS cue_no, round(start, 3) AS start, round(stop, 3) AS stop, text FROM cu""")
def captions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as caption files to the checkpoint folder, and read back: numbered in their order, after the header."""
    captions.register(spark)
    at = f"{checkpoint_folder(spark)}/captions-{uuid.uuid4().hex}"
    cues = cue_table(spark, sf_dir).withColumn("vid", F.col("vid").cast("string")).select("vid", "cue_no", "start", "end", "text")
    dealt = cues.repartition("vid").sortWithinPartitions("vid", "cue_no").withColumn("cue_no", F.col("cue_no").cast("int"))
    dealt.write.format("captions").mode("append").option("path", at).save()
    read = spark.read.format("captions").option("path", at).load()
    return read.select("vid", "cue_no", F.round("start", 3).alias("start"), F.round("end", 3).alias("stop"), "text")


QUERIES, ORACLES = query.queries, query.oracles
