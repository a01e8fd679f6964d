"""Queries over answers, accuracy and split hygiene."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpoint_folder
from spindrift.functions import expr as X
from spindrift.functions.registry import MODELS
from spindrift.functions.runs import answer_run_id
from spindrift.operators import answers as Q
from spindrift.operators import retrieval as R
from spindrift.operators import timeline as L
from spindrift.operators.order import grouped_in_order, numbered, zipped
from spindrift.plans import sql as S
from spindrift.plans.lexical import talk_chunks
from spindrift.plans.registry import Registry, table
from spindrift.sources.files import english_tracks, in_file_order, merged_tracks
from spindrift.streaming.answers import answer_stream as answer_rows
from spindrift.streaming.answers import stream_answers

query = Registry()
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, correct, toxic: labels as outcomes."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("correct", F.col("quality") == 1)


_LO, _HI = S.wilson()


@query(f"""WITH g AS (
  SELECT lang, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS k
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang)
SELECT lang, n, k, round(k / n::DOUBLE, 6) AS accuracy, {_LO} AS lo, {_HI} AS hi FROM g""")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.accuracy_by(labelled(spark, sf_dir), ("lang",))


@query(f"""WITH d AS (
  SELECT count(*) AS n, count(CASE WHEN quality = 1 AND NOT toxic = 1 THEN 1 END) AS n10, count(CASE WHEN toxic = 1 AND NOT quality = 1 THEN 1 END) AS n01,
    round(avg((quality = 1)::INT) - avg((toxic = 1)::INT), 6) AS delta
  FROM labels)
SELECT *, {S.mcnemar()} AS p FROM d""")
def paired_quality_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return R.mcnemar(rows.agg(*R.paired_counts()))


@query("""SELECT doc_id, correct, round(avg(correct::INT) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 6) AS running
FROM (SELECT doc_id, lang, quality = 1 AS correct FROM labels JOIN documents USING (doc_id))""")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.running_accuracy(labelled(spark, sf_dir), "lang", "doc_id", block=100).select("doc_id", "correct", "running")


_ANSWERS = "a AS (SELECT page_id, try_cast(nullif(regexp_extract(url, '[0-3]'), '') AS INT) AS pred, CASE WHEN page_id % 5 > 0 THEN (page_id % 4)::INT END AS gold FROM pages)"
_CORRECT = "CASE WHEN gold IS NOT NULL THEN coalesce(pred = gold, FALSE) END"


def page_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("raw"), F.when(F.col("page_id") % 5 > 0, F.col("page_id") % 4).cast("int").alias("gold"))
    return Q.score(rows)


@query(f"WITH {_ANSWERS} SELECT page_id, pred, gold, {_CORRECT} AS correct FROM a")
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_answers(spark, sf_dir).select("page_id", "pred", "gold", "correct")


@query(f"""WITH {_ANSWERS} SELECT count(*) AS n, round(avg(({_CORRECT})::INT), 6) AS accuracy, count(CASE WHEN pred IS NULL THEN 1 END) AS unparsed,
  round(count(CASE WHEN pred IS NULL THEN 1 END) / count(*)::DOUBLE, 6) AS unparsed_rate FROM a""")
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.summary(page_answers(spark, sf_dir))


@query(f"WITH {_ANSWERS} SELECT page_id, gold FROM a WHERE pred IS NULL ORDER BY page_id LIMIT 5")
def unparsed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.unparsed(page_answers(spark, sf_dir), "page_id").select("page_id", "gold")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, q, options: a turn's first word asks, its next four are the options."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    options = [F.coalesce(F.get(words, F.lit(i)), F.lit("-")) for i in range(1, 5)]
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.get(words, F.lit(0)).alias("q"), *[o.alias(f"a{i}") for i, o in enumerate(options)])


_ASKED = """a AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w
  FROM conversations), o AS (SELECT conv_id, turn, w[1] AS q, coalesce(w[2], '-') AS a0, coalesce(w[3], '-') AS a1, coalesce(w[4], '-') AS a2,
  coalesce(w[5], '-') AS a3 FROM a)"""


@query(f"WITH {_ASKED} SELECT conv_id, turn, q || ' ' || a0 || ' ' || a1 || ' ' || a2 || ' ' || a3 AS query FROM o")
def render_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir)
    return rows.select("conv_id", "turn", X.render_query("question+options", F.col("q"), [F.col(f"a{i}") for i in range(4)], F.col("a0")).alias("query"))


@query(f"""WITH {_ASKED} SELECT conv_id, turn,
  q || chr(10) || '0. ' || a0 || chr(10) || '1. ' || a1 || chr(10) || '2. ' || a2 || chr(10) || '3. ' || a3 || chr(10) || 'Answer with the number of the correct option, and nothing else.' AS prompt
  FROM o""")
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", X.render_prompt(F.col("q"), [F.col(f"a{i}") for i in range(4)]).alias("prompt"))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("qid", F.concat_ws("#", "conv_id", "turn", "role"))
    return Q.pending(rows.filter("role IS NOT NULL"), rows.filter("role = 'user'")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn, role) AS joined FROM conversations GROUP BY conv_id")
def group_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.in_order(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("""SELECT lang, count(*) AS total, count(h) AS covered, round(100.0 * count(h) / count(*), 4) AS percent, count(DISTINCT CASE
  WHEN h IS NOT NULL THEN doc_id END) AS n_distinct FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS h FROM labels) USING (doc_id) GROUP BY lang""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "lang", "doc_id")


@query("""WITH m AS (SELECT md5(text) AS id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, source AS subset, doc_id AS pos
  FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, subset,
  pos) AS rn, count(*) OVER (PARTITION BY id) AS n FROM m) SELECT id, split, subset, n FROM r WHERE rn = 1""")
def split_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.owners(split_members(spark, sf_dir))


def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, subset, pos: a document's text is an id that several splits may hold."""
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3).cast("int") + 1)
    return table(spark, sf_dir, "documents").select(F.md5("text").alias("id"), split.alias("split"), F.col("source").alias("subset"), F.col("doc_id").alias("pos"))


#: Needles in order, with their reasons (for the event names of the test data).
NEEDLES = [("purch", "bought"), ("click", "pointed"), ("log", "session"), ("view", "looked")]


@query("""SELECT CASE WHEN contains(lower(event_type), 'purch') THEN 'bought' WHEN contains(lower(event_type), 'click') THEN 'pointed'
  WHEN contains(lower(event_type), 'log') THEN 'session' WHEN contains(lower(event_type), 'view') THEN 'looked' END AS reason, count(*) AS n FROM events
  GROUP BY ALL""")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.histogram(table(spark, sf_dir, "events").select(X.failure_reason(F.col("event_type"), NEEDLES).alias("reason")), "reason")


@query("SELECT source, round(avg(CASE WHEN lang = 'en' THEN quality END) - avg(CASE WHEN lang <> 'en' THEN quality END), 6) AS headroom FROM labels JOIN documents USING (doc_id) GROUP BY source")
def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = F.avg(F.when(F.col("lang") == "en", F.col("quality")))
    other = F.avg(F.when(F.col("lang") != "en", F.col("quality")))
    return labelled(spark, sf_dir).groupBy("source").agg(F.round(english - other, 6).alias("headroom"))


_CONDITIONS = ("random", "top1 (a)", "top1 (b)", "oracle")


@query(f"""WITH r AS (
  SELECT lang AS model, (ARRAY{list(_CONDITIONS)})[doc_id % 4 + 1] AS condition, quality = 1 AS correct
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND NOT (lang = 'fr' AND doc_id % 4 = 0)),
g AS (SELECT model, condition, count(*) AS n, count(CASE WHEN correct THEN 1 END) AS k FROM r GROUP BY ALL),
e AS (
  SELECT model, max(CASE WHEN condition = 'random' THEN k / n::DOUBLE END) AS f, max(CASE WHEN condition = 'oracle' THEN k / n::DOUBLE END) AS c
  FROM g GROUP BY model)
SELECT model, condition, n, k, round(k / n::DOUBLE, 6) AS accuracy, {_LO} AS lo, {_HI} AS hi, round(f, 6) AS floor, round(c, 6) AS ceiling,
  round((k / n::DOUBLE - f) / nullif(c - f, 0), 6) AS place
FROM g JOIN e USING (model)""")
def condition_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by model and retrieval condition, between blind picks and a perfect retriever; one model lacks the former."""
    condition = F.element_at(F.array(*map(F.lit, _CONDITIONS)), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = labelled(spark, sf_dir).withColumns({"model": F.col("lang"), "condition": condition})
    return Q.condition_accuracy(rows.filter("NOT (lang = 'fr' AND condition = 'random')"))


@query("SELECT source, min(doc_id) AS first FROM documents GROUP BY source")
def first_seen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_seen(table(spark, sf_dir, "documents"), "source", "doc_id")


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"))


def _decoded_sql(text: str) -> str:
    """The entities that the test pages hold; the ampersand last, which also stands without its semicolon."""
    for name, char in _ENTITIES:
        text = f"replace({text}, '{name}', '{char}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


@query(f"SELECT page_id, length(trim(regexp_replace({_decoded_sql('html')}, '\\s+', ' ', 'g'))) AS n FROM pages")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(X.normalized_line(F.col("html"))).alias("n"))


@query(f"""WITH {_ASKED},
p AS (
  SELECT conv_id::VARCHAR AS video, conv_id || '#' || turn AS qid, (turn % 4)::INT AS gold, 'Answer: ' || (length(q) + length(a0) + length(a1) + length(a2) + length(a3)
    + 4 * 4 + 1 + length('{X.INSTRUCTION}')) % 5 AS raw
  FROM o),
s AS (SELECT *, try_cast(nullif(regexp_extract(raw, '[0-3]'), '') AS INT) AS pred FROM p)
SELECT video, qid, pred, gold, {_CORRECT} AS correct, raw FROM s""")
def answer_with_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model hook with a deterministic stand-in; no weights are at hand."""
    return Q.answered(_prompts(spark, sf_dir), load=MODELS["stand-in"])[0]


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    prompt = X.render_prompt(F.col("q"), [F.col(f"a{i}") for i in range(4)])
    return asked.select(F.col("conv_id").alias("vid"), F.concat_ws("#", "conv_id", "turn").alias("qid"), F.col("turn").alias("seq"), prompt.alias("prompt"), F.pmod("turn", F.lit(4)).cast("int").alias("gold"))


def _no_frames(video: str) -> None:
    if int(video) % 7 == 0:
        raise OSError("no frames")


@query(f"""WITH {_ASKED},
p AS (
  SELECT conv_id, (turn % 4)::INT AS gold,
    (length(q) + length(a0) + length(a1) + length(a2) + length(a3) + 4 * 4 + 1 + length('{X.INSTRUCTION}')) % 5 AS said
  FROM o)
SELECT conv_id::VARCHAR AS video, count(*) FILTER (conv_id % 7 <> 0) AS n, count(*) FILTER (conv_id % 7 <> 0 AND said = gold) AS n_right,
  CASE WHEN conv_id % 7 = 0 THEN 'OSError: no frames' END AS error
FROM p GROUP BY conv_id""")
def answers_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run makes of each video: how many answers, how many right, and why there are none where it can't be read."""
    results, failed = Q.answered(_prompts(spark, sf_dir), load=MODELS["stand-in"], prepare=_no_frames)
    counts = results.groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("n_right"))
    zero = F.lit(0).cast("bigint")
    return counts.withColumn("error", F.lit(None).cast("string")).unionByName(failed.select("video", zero.alias("n"), zero.alias("n_right"), "error"))


@query(f"""WITH a AS (
  SELECT conv_id::VARCHAR AS video, conv_id || '#' || turn || '#' || coalesce(role, '') AS qid, turn AS seq,
    try_cast(nullif(regexp_extract(coalesce(text, ''), '[0-3]'), '') AS INT) AS pred, CASE WHEN turn % 5 > 0 THEN (turn % 4)::INT END AS gold FROM conversations),
s AS (SELECT *, {_CORRECT} AS correct FROM a),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, qid ORDER BY seq) AS rn FROM s) WHERE rn = 1)
SELECT video, qid, correct, round(avg(correct::INT) OVER (PARTITION BY video ORDER BY seq, qid ROWS UNBOUNDED PRECEDING), 6) AS running FROM f""")
def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of raw answers, scored with what was answered, and the accuracy so far, in its state."""
    at = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(at).schema
    raw = spark.readStream.schema(schema).parquet(f"{at}*").select(  # a pattern, as a stream takes no single file by its name
        F.col("conv_id").cast("string").alias("video"), F.concat_ws("#", "conv_id", "turn", F.coalesce("role", F.lit(""))).alias("qid"), F.col("turn").alias("seq"),
        F.when(F.col("turn") % 5 > 0, F.col("turn") % 4).cast("int").alias("gold"), F.coalesce("text", F.lit("")).alias("raw"),
    )
    folder = f"{checkpoint_folder(spark)}/answer-stream-{uuid.uuid4().hex}"
    answer_rows(raw, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return stream_answers(spark, f"{folder}/rows").select("video", "qid", "correct", "running")


_TURN_ORDER = "r AS (SELECT *, row_number() OVER () - 1 AS seq FROM conversations)"


@query(f"""WITH {_TURN_ORDER},
g AS (SELECT conv_id, row_number() OVER (ORDER BY min(seq)) - 1 AS group_seq FROM r GROUP BY conv_id)
SELECT conv_id, turn, seq, group_seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS place FROM r JOIN g USING (conv_id)""")
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place in its file, its group's by first appearance, and its own within the group."""
    rows = in_file_order(table(spark, sf_dir, "conversations").select("conv_id", "turn"))
    return grouped_in_order(rows, "conv_id").select("conv_id", "turn", "seq", "group_seq", F.col("place").cast("bigint").alias("place"))


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS seq FROM documents),
l AS (SELECT doc_id AS other, row_number() OVER (ORDER BY doc_id DESC) - 1 AS seq FROM documents)
SELECT seq, doc_id, other FROM d JOIN l USING (seq)""")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables side by side, each in an order of its own."""
    rows = table(spark, sf_dir, "documents")
    left = numbered(rows.select("doc_id", "source"), [F.col("source"), F.col("doc_id")]).select("seq", "doc_id")
    right = numbered(rows.select(F.col("doc_id").alias("other")), [F.col("other").desc()])
    return zipped(left, right).select("seq", "doc_id", "other")


def _qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, vid, q, a0..a3, ans_corr, seq: turns as questions; a qid stands for every third turn of a conversation."""
    asked = _asked(spark, sf_dir)
    return asked.select(F.concat_ws("-", "conv_id", F.col("turn") % 3).alias("qid"), F.col("conv_id").alias("vid"), "q", *[f"a{i}" for i in range(4)], F.col("a0").alias("ans_corr"), F.col("turn").alias("seq"))


_QA = f"""{_ASKED},
qa AS (SELECT conv_id || '-' || turn % 3 AS qid, conv_id AS vid, q, a0, a1, a2, a3, a0 AS ans_corr, turn AS seq FROM o),
q1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seq) AS rn FROM qa) WHERE rn = 1)"""


@query(f"""WITH {_QA}
SELECT (vid * 3 + 2)::BIGINT AS seq, qid, q || ' ' || a0 || ' ' || a1 || ' ' || a2 || ' ' || a3 AS query FROM q1 WHERE qid = vid || '-1'""")
def queries_in_cache_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query texts behind a cache's qids, found again by key; of repeated qids the first row counts."""
    qa = _qa(spark, sf_dir)
    cached = qa.filter(F.col("qid").endswith("-1")).select((F.col("vid") * 3 + 2).alias("seq"), "qid").distinct()
    rows = Q.rows_in_query_order(cached, qa, "seq")
    return rows.select("seq", "qid", X.render_query("question+options", F.col("q"), [F.col(f"a{i}") for i in range(4)], F.col("ans_corr")).alias("query"))


_TURNS = """tc AS (SELECT conv_id AS vid, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx, text FROM conversations)"""


@query(f"""WITH {_QA},
{_TURNS}
SELECT q1.qid, tc.vid || '#' || tc.idx AS chunk_id, '/media/' || tc.vid || '.mp4' AS path_to_video, tc.text, tc.idx * 60.0 AS s, tc.idx * 60.0 + 60.0 AS e, q1.q
FROM q1 JOIN tc ON tc.vid = q1.vid AND tc.idx = q1.vid % 2""")
def pick_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk that each question is answered from, with all that a model needs."""
    qa, chunks = _qa(spark, sf_dir), talk_chunks(spark, sf_dir)
    picks = qa.select("qid", "vid", (F.col("vid") % 2).cast("int").alias("idx")).distinct()
    files = chunks.select("vid").distinct().withColumn("path_to_video", F.concat(F.lit("/media/"), "vid", F.lit(".mp4")))
    bounds = chunks.withColumns({"s": F.col("idx") * 60.0, "e": F.col("idx") * 60.0 + 60.0})
    return Q.pick_lookup(picks, qa, files, bounds, "seq").select("qid", "chunk_id", "path_to_video", "text", "s", "e", "q")


@query("""SELECT d.doc_id % 50 AS vid, count(*) AS n, bool_or(d.doc_id % 50 IN (SELECT item_id FROM benchmark)) AS has_media FROM documents d GROUP BY vid""")
def question_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by video, told apart by whether the video's files are there."""
    qa = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("vid"))
    there, missing = Q.with_media(qa, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vid")))
    known = there.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).withColumn("has_media", F.lit(True))
    return known.unionByName(Q.only(qa, missing).groupBy("vid").agg(F.count(F.lit(1)).alias("n")).withColumn("has_media", F.lit(False)))


@query("""WITH r AS (SELECT doc_id, doc_id % 40 AS vid, source FROM documents)
SELECT 'split' AS kept, count(*) AS n, sum(doc_id)::BIGINT AS digest FROM r WHERE vid < 10
UNION ALL SELECT 'encoded', count(*), sum(doc_id)::BIGINT FROM r WHERE vid % 3 = 0
UNION ALL SELECT 'fit', count(*), sum(doc_id)::BIGINT FROM r WHERE vid % 5 <> 0
UNION ALL SELECT 'first', count(*), sum(doc_id)::BIGINT FROM (SELECT * FROM r ORDER BY doc_id LIMIT 25)
UNION ALL SELECT 'first of a source', count(*), sum(doc_id)::BIGINT FROM (SELECT min(doc_id) AS doc_id FROM r GROUP BY source)""")
def narrowed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each narrowing leaves: a split's videos, the encoded ones, those to fit on, the first rows, the first of each
    source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("vid"), "source")
    videos = rows.select("vid").distinct()
    kept = {
        "split": Q.only(rows, videos.filter("vid < 10")), "encoded": Q.only(rows, videos.filter("vid % 3 = 0")), "fit": Q.fit_rows(rows, videos.filter("vid % 5 = 0")),
        "first": Q.first_n(rows, 25, "doc_id"), "first of a source": Q.first_rows(rows.select("source", "doc_id"), "source", "doc_id"),
    }
    out = None
    for name, df in kept.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("digest")).select(F.lit(name).alias("kept"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH m AS (SELECT md5(text) AS id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, source AS subset, doc_id AS pos FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, subset, pos) AS rn,
  min(pos) OVER (PARTITION BY id, split, subset) AS first FROM m WHERE id IS NOT NULL)
SELECT m.pos, k.split AS kept_split, k.subset AS kept_subset FROM r m JOIN r k ON k.id = m.id AND k.rn = 1
WHERE m.split <> k.split OR m.subset <> k.subset OR m.pos <> m.first""")
def dropped_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dropped_members(split_members(spark, sf_dir)).select("pos", "kept_split", "kept_subset")


@query("""SELECT p_partkey, 'b' || p_size AS encoder, round(greatest(exp(-p_size / 10.0), 0.01), 6) AS temperature,
  array_to_string(list_filter(['video', CASE WHEN p_size % 2 = 1 THEN 'said ' || p_size END, 'ask ' || p_size], lambda x: x IS NOT NULL), '|') AS parts,
  p_size % 9 <= 3 + p_partkey % 4 AND p_partkey % 5 <= p_size % 9 + 2 AS overlaps,
  array_to_string(list_sort(list_filter([CASE p_size % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'de' ELSE 'eng-' || p_partkey % 7 END, 'en-' || p_size % 4, 'fr' || p_size], lambda x: starts_with(lower(x), 'en'))), ',') AS tracks,
  'm_d_s' || p_size || '_' || CASE WHEN p_size % 2 = 1 THEN 'tx' ELSE 'notx' END || CASE WHEN p_size % 3 = 0 THEN '_n' || p_size ELSE '' END AS run_id
FROM part""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a row that no other query has: names, temperatures, prompt parts, overlaps, tracks, run ids."""
    size, key = F.col("p_size"), F.col("p_partkey")
    said = F.when(size % 2 == 1, F.concat(F.lit("said "), size))
    parts = F.transform(X.content_parts(F.concat(F.lit("ask "), size), said), lambda p: F.when(p["kind"] == "video", p["kind"]).otherwise(p["text"]))
    code = F.when(size % 3 == 0, "EN").when(size % 3 == 1, "de").otherwise(F.concat(F.lit("eng-"), key % 7))
    tracks = merged_tracks(F.create_map(code, F.lit("x"), F.concat(F.lit("fr"), size), F.lit("y")), F.create_map(F.concat(F.lit("en-"), size % 4), F.lit("z")))
    ids = {(n, odd): answer_run_id("m", "d", f"s{n}", transcript=odd, limit=n if n % 3 == 0 else None) for n in range(1, 51) for odd in (n % 2 == 1,)}
    run_id = F.create_map(*(F.lit(x) for (n, _), name in ids.items() for x in (n, name)))[size.cast("int")]
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.encoder_of(F.concat(F.lit("b"), size, F.lit("_val"))).alias("encoder"), F.round(X.temperature(-size / 10.0), 6).alias("temperature"), F.array_join(parts, "|").alias("parts"),
        L.overlapping(size % 9, size % 9 + 2, key % 5, 3 + key % 4).alias("overlaps"), F.array_join(english_tracks(tracks), ",").alias("tracks"), run_id.alias("run_id"),
    )


QUERIES, ORACLES = query.queries, query.oracles
