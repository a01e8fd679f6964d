"""Queries over texts: BM25 and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import expr as X
from spindrift.functions.registry import TEXT_BASELINES
from spindrift.operators import retrieval as R
from spindrift.operators.bm25 import bm25_scores, bm25_search
from spindrift.plans import sql as S
from spindrift.plans.registry import Registry, table
from spindrift.schema import POOL_TYPES, QUERY_FORMS

query = Registry()


def talk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, idx, text: a conversation's turns in order."""
    rows = table(spark, sf_dir, "conversations")
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return rows.select(F.col("conv_id").alias("vid"), at.alias("idx"), "text")


def talk_questions(chunks: DataFrame) -> DataFrame:
    """qid, vid, oracle_idx, text: each conversation's first turn asks for turn ``vid % n``."""
    per = chunks.groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "idx").alias("text"))
    return per.select(F.col("vid").alias("qid"), "vid", F.pmod("vid", "n").cast("int").alias("oracle_idx"), "text")


_TALK = """c AS (
  SELECT conv_id AS vid, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx, coalesce(text, '') AS text FROM conversations),
q0 AS (SELECT vid AS qid, vid, vid % count(*) AS oi, count(*) AS own, arg_min(text, idx) AS text FROM c GROUP BY vid)"""


def _stats_sql(source: str, key: str) -> str:
    """tf (key, dl, term, tf) and idf (term, idf, avgdl) of ``source`` (key, text)."""
    return f"""tk AS (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ts FROM {source}),
tf AS (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(ts) AS dl, unnest(ts) AS term FROM tk) GROUP BY ALL),
raw AS (
  SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk)),
idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _asked_sql(source: str) -> str:
    return f"qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS term FROM {source}) GROUP BY ALL)"


_PART = "times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"


def _pool_scores_sql(pools: str) -> str:
    """sc: ``pools`` with scores."""
    return f"""sm AS (
  SELECT p.qid, p.vid, p.idx, sum({_PART}) AS s
  FROM {pools} p JOIN qt USING (qid) JOIN tf ON tf.vid = p.vid AND tf.idx = p.idx AND tf.term = qt.term JOIN idf ON idf.term = qt.term GROUP BY ALL),
sc AS (SELECT p.*, round(coalesce(s, 0), 6) AS score FROM {pools} p LEFT JOIN sm USING (qid, vid, idx))"""


_BM25 = f"{_TALK},\n{S.WITHIN_POOLS},\n{_stats_sql('c', 'vid, idx')},\n{_asked_sql('q0')},\n{_pool_scores_sql('wp')},\n{S.ranks('r', 'sc')}"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = talk_chunks(spark, sf_dir)
    questions = talk_questions(chunks)
    return bm25_scores(R.within_pools(questions, chunks), questions.select("qid", "text"), chunks)


@query(f"WITH {_BM25}\nSELECT {S.METRICS} FROM r")
def bm25_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metrics(R.pessimistic_ranks(_scores(spark, sf_dir)))


@query(f"""WITH {_TALK},
{S.WITHIN_POOLS},
{S.cross_pools()},
{_stats_sql('c', 'vid, idx')},
o AS (SELECT *, string_split(coalesce(text, ''), ' ') AS w FROM q0),
o2 AS (SELECT qid, w[1] AS q, coalesce(w[2], '-') AS a0, coalesce(w[3], '-') AS a1, coalesce(w[4], '-') AS a2, coalesce(w[5], '-') AS a3 FROM o),
f AS (
  SELECT qid AS question_id, 'question' AS query_form, q AS text FROM o2
  UNION ALL SELECT qid, 'question+options', q || ' ' || a0 || ' ' || a1 || ' ' || a2 || ' ' || a3 FROM o2
  UNION ALL SELECT qid, 'answer', a0 FROM o2),
fq AS (SELECT query_form || '#' || question_id AS qid, text FROM f),
{_asked_sql('fq')},
pp AS (
  SELECT pool_type, query_form, query_form || '#' || p.qid || '#' || pool_type AS pid, query_form || '#' || p.qid AS qid, vid, idx, is_oracle
  FROM (SELECT 'within' AS pool_type, * FROM wp UNION ALL SELECT 'cross', * FROM xp) p, (SELECT DISTINCT query_form FROM f)),
sm AS (
  SELECT p.pid, p.vid, p.idx, sum({_PART}) AS s
  FROM pp p JOIN qt USING (qid) JOIN tf ON tf.vid = p.vid AND tf.idx = p.idx AND tf.term = qt.term JOIN idf ON idf.term = qt.term GROUP BY ALL),
sc AS (SELECT p.*, round(coalesce(s, 0), 6) AS score FROM pp p LEFT JOIN sm USING (pid, vid, idx)),
{S.ranks('r', 'sc', 'pool_type, query_form, qid')}
SELECT 'bm25' AS baseline, query_form, pool_type, {S.METRICS} FROM r GROUP BY query_form, pool_type""")
def text_baseline_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query form against both pool types. Corpus statistics are made once; form and pool type are part of the id
    of a question."""
    chunks = talk_chunks(spark, sf_dir)
    questions = talk_questions(chunks)
    words = F.split(F.coalesce("text", F.lit("")), " ")
    options = [F.coalesce(F.get(words, F.lit(i)), F.lit("-")) for i in range(1, 5)]
    asked = questions.select("qid", F.get(words, F.lit(0)).alias("q"), *[o.alias(f"a{i}") for i, o in enumerate(options)])
    texts = [F.struct(F.lit(f).alias("query_form"), X.render_query(f, F.col("q"), [F.col(f"a{i}") for i in range(4)], F.col("a0")).alias("text")) for f in QUERY_FORMS]
    setups = F.explode(F.array(*[F.struct(F.lit(f).alias("query_form"), F.lit(p).alias("pool_type")) for f in QUERY_FORMS for p in POOL_TYPES]))
    each = asked.select("qid", F.explode(F.array(*texts)).alias("x")).select("qid", "x.*").withColumn("pool_type", F.explode(F.array(*map(F.lit, POOL_TYPES))))
    queries = each.select(F.struct("qid", "query_form", "pool_type").alias("qid"), "text")
    pools = None
    for kind in POOL_TYPES:
        own = R.pools_of(kind, questions, chunks).withColumn("x", setups).filter(F.col("x.pool_type") == kind)
        own = own.select(F.struct("qid", "x.query_form", "x.pool_type").alias("qid"), "vid", "idx", "is_oracle")
        pools = own if pools is None else pools.unionByName(own)
    ranks = R.pessimistic_ranks(TEXT_BASELINES["bm25"](pools, queries, chunks)).select("qid.*", "rank", "pool")
    return R.metrics(ranks, ("query_form", "pool_type")).select(F.lit("bm25").alias("baseline"), "*")


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_stats_sql('d', 'doc_id')},
bq AS (SELECT item_id AS qid, text FROM benchmark),
{_asked_sql('bq')},
s AS (SELECT qid, doc_id, round(sum({_PART}), 6) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term) GROUP BY qid, doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM s)
SELECT qid, doc_id, score, place FROM p WHERE place <= 10""")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that each benchmark item finds, out of all."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return bm25_search(asked, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {_BM25},
k AS (
  SELECT sc.*, CASE WHEN is_oracle THEN 'oracle'
      WHEN len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) < 20 OR 40 + 10 * (sc.idx % 3) < 45 THEN 'uninformative' ELSE 'other' END AS kind,
    count(*) OVER (PARTITION BY qid) AS pool, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sc.idx) - 1 AS place
  FROM sc JOIN c USING (vid, idx))
SELECT kind, count(*) AS n, round(avg(place / (pool - 1)::DOUBLE), 6) AS position FROM k WHERE pool > 1 GROUP BY kind""")
def mean_pool_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ranking puts chunks of each kind, 0 for first and 1 for last; pools of one say nothing. Every third chunk
    is taken to last 40 seconds, the others longer."""
    chunks = talk_chunks(spark, sf_dir)
    own = W.partitionBy("qid")
    ranked = _scores(spark, sf_dir).join(chunks, ["vid", "idx"]).withColumn("pool", F.count(F.lit(1)).over(own)).withColumn("at", F.row_number().over(own.orderBy(F.desc("score"), "idx")) - 1)
    kind = F.when(F.col("is_oracle"), "oracle").when(X.uninformative(F.col("text"), 40.0 + 10 * (F.col("idx") % 3)), "uninformative").otherwise("other")
    return ranked.filter("pool > 1").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("at") / (F.col("pool") - 1)), 6).alias("position"))


@query("""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS term FROM documents) GROUP BY term""")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.coalesce("text", F.lit("")))).alias("term"))
    per = rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("term").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


QUERIES, ORACLES = query.queries, query.oracles
