"""Queries over vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import encoders
from spindrift.functions import expr as X
from spindrift.operators import adapter as A
from spindrift.operators import training as TR
from spindrift.operators import answers as Q
from spindrift.operators import retrieval as R
from spindrift.plans import sql as S
from spindrift.plans.registry import Registry, table
from spindrift.schema import BANDS, QUERY_FORMS, REPRESENTATIONS

query = Registry()
SETUP = ("pool_type", "representation", "query_form")
#: Chunks of other videos in a training pool; videos held out of training have a number that this divides.
N_EASY, HELD_OUT = 16, 5


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, idx, qid, v, t: chunks with two towers; the second is the next chunk's vector, the last one's the first."""
    vid = F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 100)
    rows = table(spark, sf_dir, "embeddings").select(vid.alias("vid"), F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    own = W.partitionBy("vid").orderBy("qid")
    t = F.coalesce(F.lead("v").over(own), F.first("v").over(own))
    return rows.select("vid", (F.row_number().over(own) - 1).alias("idx"), "qid", "v", t.alias("t"))


def question_table(chunks: DataFrame) -> DataFrame:
    return chunks.select("qid", "vid", F.col("idx").alias("oracle_idx"), F.col("t").alias("query"))


_CHUNKS = """e0 AS (SELECT label * 1000000 + vec_id // 100 AS vid, vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings),
c AS (
  SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY qid) - 1 AS idx, qid, v,
    coalesce(lead(v) OVER (PARTITION BY vid ORDER BY qid), first(v) OVER (PARTITION BY vid ORDER BY qid)) AS t, count(*) OVER (PARTITION BY vid) AS own
  FROM e0),
q0 AS (SELECT qid, vid, idx AS oi, own, v, t, t AS q FROM c)"""


def _scores_sql(name: str, pools: str, score: str = "list_dot_product(q.q, d.v)") -> str:
    return f"""{name} AS (
  SELECT p.qid, p.is_oracle, round({score}, 6) AS score
  FROM {pools} p JOIN c d ON d.vid = p.vid AND d.idx = p.idx JOIN q0 q ON q.qid = p.qid)"""


_WITHIN = f"{_CHUNKS},\n{S.WITHIN_POOLS},\n{_scores_sql('ws', 'wp')},\n{S.ranks('wr', 'ws')}"
_CROSS = f"{S.cross_pools()},\n{_scores_sql('xs', 'xp')},\n{S.ranks('xr', 'xs')}"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = chunk_table(spark, sf_dir)
    return chunks, question_table(chunks)


def _ranks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    chunks, questions = _tables(spark, sf_dir)
    if kind == "within":
        return R.pessimistic_ranks(R.scored_within(questions, chunks, vector="v"))
    return R.pessimistic_ranks(R.scored(R.pools_of(kind, questions, chunks), questions, chunks, vector="v"))


@query(f"WITH {_WITHIN}\nSELECT {S.METRICS} FROM wr")
def retrieval_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metrics(_ranks(spark, sf_dir, "within"))


@query(f"WITH {_CHUNKS},\n{_CROSS}\nSELECT {S.METRICS} FROM xr")
def retrieval_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metrics(_ranks(spark, sf_dir, "cross"))


_SWEEP = f"""{_CHUNKS},
{S.WITHIN_POOLS},
{S.cross_pools()},
cr AS (SELECT vid, idx, v AS video, t AS transcript, {S.unit("f")} AS fused FROM (SELECT *, {S.plus("v", "t")} AS f FROM c)),
qf AS (SELECT qid, t AS question, {S.unit("f")} AS options, v AS answer FROM (SELECT *, {S.plus("v", "t")} AS f FROM c)),
pp AS (SELECT 'within' AS pool_type, * FROM wp UNION ALL SELECT 'cross', qid, vid, idx, is_oracle FROM xp),
sw AS (
  SELECT pool_type, representation, query_form, p.qid, is_oracle, round(list_dot_product(
      CASE query_form WHEN 'question' THEN question WHEN 'answer' THEN answer ELSE options END,
      CASE representation WHEN 'video' THEN video WHEN 'transcript' THEN transcript ELSE fused END), 6) AS score
  FROM pp p JOIN cr ON cr.vid = p.vid AND cr.idx = p.idx JOIN qf ON qf.qid = p.qid,
    (VALUES ('video'), ('transcript'), ('fused')) AS a(representation), (VALUES ('question'), ('question+options'), ('answer')) AS b(query_form)),
{S.ranks("sr", "sw", "pool_type, representation, query_form, qid")}"""
_SETUPS = f"{_SWEEP},\nm AS (SELECT 'vectors' AS encoder, pool_type, representation, query_form, {S.METRICS} FROM sr GROUP BY ALL)"


def sweep_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of every pool type, representation and query form. The oracle's nine scores are made once a question; a pair
    of question and chunk is joined once, and its nine scores are counted against them in one aggregate."""
    chunks, questions = _tables(spark, sf_dir)
    v, t = F.col("v"), F.col("t")
    reps = chunks.select("vid", "idx", *[X.representation(r, v, t).alias(f"c_{i}") for i, r in enumerate(REPRESENTATIONS)])
    setups = [
        ({"representation": r, "query_form": f}, F.round(X.dot(F.col(f"q_{j}"), F.col(f"c_{i}")), R.PLACES), f"o_{i}{j}")
        for i, r in enumerate(REPRESENTATIONS) for j, f in enumerate(QUERY_FORMS)
    ]
    asked = chunks.select("qid", "vid", F.col("idx").alias("oracle_idx"), X.representation("transcript", v, t).alias("q_0"), X.fused(v, t).alias("q_1"), X.representation("video", v, t).alias("q_2"))
    oracles = reps.withColumnRenamed("idx", "oracle_idx")
    forms = asked.join(oracles, ["vid", "oracle_idx"]).select(*asked.columns, *(score.alias(own) for _, score, own in setups))
    within = forms.join(reps, "vid").withColumn("pool_type", F.lit("within"))
    cross = R.pools_of("cross", questions, chunks).select("qid", "vid", "idx").join(reps, ["vid", "idx"]).join(forms.drop("vid", "oracle_idx"), "qid").withColumn("pool_type", F.lit("cross"))
    return reduce_union([R.setup_ranks(x, setups, ("pool_type", "qid")) for x in (within, cross)])


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metrics(sweep_ranks(spark, sf_dir), SETUP).select(F.lit("vectors").alias("encoder"), "*")


@query(f"WITH {_SETUPS}\nSELECT * FROM m")
def retrieval_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep_scores(spark, sf_dir)


_PLACE = """CASE pool_type WHEN 'within' THEN 0 ELSE 1 END, CASE representation WHEN 'video' THEN 0 WHEN 'transcript' THEN 1 ELSE 2 END, length(query_form)"""


@query(f"WITH {_SETUPS}\nSELECT row_number() OVER (ORDER BY {_PLACE}) AS line, pool_type, representation, query_form, top1, random FROM m")
def score_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score table in its order; a row per setup, so numbering them is nothing."""
    listed = R.score_table(sweep_scores(spark, sf_dir)).select(F.monotonically_increasing_id().alias("at"), "*")
    return listed.select(F.row_number().over(W.orderBy("at")).cast("bigint").alias("line"), "pool_type", "representation", "query_form", "top1", "random")


_LO, _HI = S.wilson()
_BANDS = "b(ord, lo, hi, band) AS (VALUES " + ", ".join(f"({i}, {lo}, {hi}, '{lo}-{hi}')" for i, (lo, hi) in enumerate(BANDS)) + ")"


def _banded_sql(source: str, keys: str = "") -> str:
    also, on = (f"{keys}, ", f"b.band = g.band AND {' AND '.join(f's.{k.strip()} = g.{k.strip()}' for k in keys.split(','))}") if keys else ("", "b.band = g.band")
    setups = f"(SELECT DISTINCT {keys} FROM {source}) s, b" if keys else "b"
    listed = ", ".join(f"s.{k.strip()}" for k in keys.split(",")) + ", " if keys else ""
    return f"""g AS (SELECT {also}band, count(*) AS n, count(CASE WHEN rank = 0 THEN 1 END) AS k, avg(1.0 / pool) AS r FROM {source} JOIN b ON pool BETWEEN lo AND hi GROUP BY {also}band)
SELECT {listed}b.band, coalesce(n, 0) AS n, round(k / n::DOUBLE, 6) AS top1, {_LO} AS lo, {_HI} AS hi, round(r, 6) AS random
FROM {setups.replace(", b", " CROSS JOIN b")} LEFT JOIN g ON {on}"""


@query(f"WITH {_WITHIN},\n{_BANDS},\n{_banded_sql('wr')}")
def retrieval_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.banded(_ranks(spark, sf_dir, "within"))


@query(f"WITH {_SWEEP},\n{_BANDS},\n{_banded_sql('sr', 'pool_type, representation, query_form')}")
def bands_by_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.banded(sweep_ranks(spark, sf_dir), keys=SETUP)


_COUNTS = """count(*) AS n, count(CASE WHEN a AND NOT b THEN 1 END) AS n10, count(CASE WHEN b AND NOT a THEN 1 END) AS n01,
  round(avg(a::INT) - avg(b::INT), 6) AS delta"""


@query(f"""WITH {_WITHIN},
{_CROSS},
d AS (SELECT {_COUNTS} FROM (SELECT w.rank = 0 AS a, x.rank = 0 AS b FROM wr w JOIN xr x USING (qid)))
SELECT *, {S.mcnemar()} AS p FROM d""")
def within_vs_cross_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = [_ranks(spark, sf_dir, k).select("qid", (F.col("rank") == 0).alias("hit")) for k in ("within", "cross")]
    return R.paired(*hits)


@query(f"""WITH {_SWEEP},
h AS (SELECT pool_type, representation, query_form, qid, rank = 0 AS hit FROM sr),
d AS (
  SELECT representation, query_form, {_COUNTS}
  FROM (SELECT x.representation, x.query_form, x.hit AS a, w.hit AS b FROM h x JOIN h w USING (representation, query_form, qid) WHERE x.pool_type = 'cross' AND w.pool_type = 'within')
  GROUP BY ALL)
SELECT *, {S.mcnemar()} AS p FROM d""")
def condition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross minus within for each setup, over the same questions."""
    hits = sweep_ranks(spark, sf_dir).select(*SETUP, "qid", (F.col("rank") == 0).alias("hit"))
    cross, within = (hits.filter(F.col("pool_type") == k).drop("pool_type") for k in ("cross", "within"))
    return R.paired(cross, within, by=("representation", "query_form"))


@query(f"""WITH {_SETUPS}
SELECT encoder, w.representation, w.query_form, w.top1 AS within, x.top1 AS cross, round(x.top1 - w.top1, 6) AS delta, round(w.random, 4) = round(x.random, 4) AS same_floor
FROM m w JOIN m x USING (encoder, representation, query_form) WHERE w.pool_type = 'within' AND x.pool_type = 'cross'""")
def contrast_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contrast(sweep_scores(spark, sf_dir))


@query(f"""WITH {_SETUPS}
SELECT encoder, pool_type, representation, query_form, CASE WHEN pool_type = 'cross' AND query_form = 'answer' THEN 0.0 ELSE top1 END AS top1 FROM m""")
def merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of scores as one; of a setup in both the later table's stays."""
    scores = sweep_scores(spark, sf_dir).select("encoder", *SETUP, "top1")
    again = scores.filter("pool_type = 'cross' AND query_form = 'answer'").withColumn("top1", F.lit(0.0))
    return R.later_wins([scores, again], ("encoder", *SETUP))


@query(f"WITH {_WITHIN}\nSELECT qid, rank, pool FROM wr WHERE rank < 3")
def topk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, "within").filter("rank < 3").select("qid", "rank", "pool")


@query(f"WITH {_CHUNKS}\nSELECT qid, vid, idx FROM c")
def select_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, questions = _tables(spark, sf_dir)
    return R.within_pools(questions, chunks).filter("is_oracle").select("qid", "vid", "idx")


@query(f"""WITH {_CHUNKS},
s AS (
  SELECT q.qid, d.vid, d.idx, row_number() OVER (PARTITION BY q.qid ORDER BY round(list_dot_product(q.q, d.v), 6) DESC, d.idx) AS rn
  FROM q0 q JOIN c d USING (vid))
SELECT qid, vid, idx FROM s WHERE rn = 1""")
def select_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, questions = _tables(spark, sf_dir)
    return R.top1(R.scored_within(questions, chunks, vector="v"))


@query(f"WITH {_CHUNKS}\nSELECT qid, vid, {S.draw(0, 'qid', below='own')} AS idx FROM c")
def select_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, questions = _tables(spark, sf_dir)
    return R.random_pick(questions, chunks)


@query(f"""WITH {_CHUNKS},
k AS (SELECT idx AS place, count(*) AS times FROM c GROUP BY idx),
b AS (SELECT own, arg_max(place, times * 1000000 - place) AS idx FROM (SELECT DISTINCT own FROM c) JOIN k ON place < own GROUP BY own)
SELECT qid, vid, b.idx FROM c JOIN b USING (own)""")
def select_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, questions = _tables(spark, sf_dir)
    return R.positional_picks(questions, chunks)


@query(f"""WITH {_CHUNKS},
pl AS (SELECT *, row_number() OVER (ORDER BY substr(md5(vid::VARCHAR), 1, 3), vid, qid) - 1 AS pos, count(*) OVER () AS n FROM c),
s AS (SELECT *, min(pos) OVER (PARTITION BY vid) AS start FROM pl),
a AS (SELECT qid, vid, (start + own + {S.draw(0, 'qid', below='(n - own)')}) % n AS aim FROM s)
SELECT a.qid, a.vid, s.qid AS from_qid, s.vid AS from_vid FROM a JOIN s ON s.pos = a.aim""")
def shuffled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shuffled(question_table(chunk_table(spark, sf_dir))).select("qid", "vid", "from_qid", "from_vid")


_TRAINING = f"""{_CHUNKS},
{S.WITHIN_POOLS},
{S.cross_pools("ep", str(N_EASY + 1), f"vid % {HELD_OUT} = 0", seed=3)},
tp AS (
  SELECT qid, vid, idx, CASE WHEN is_oracle THEN 'oracle' ELSE 'hard' END AS kind FROM wp
  UNION ALL SELECT qid, vid, idx, 'easy' FROM ep WHERE NOT is_oracle)"""


def training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, questions and the third epoch's training pools."""
    chunks, questions = _tables(spark, sf_dir)
    held_out = chunks.filter(F.col("vid") % HELD_OUT == 0)
    return chunks, questions, R.training_pools(questions, chunks, N_EASY, seed=1, epoch=2, held_out=held_out)


@query(f"""WITH {_TRAINING}
SELECT qid, kind, count(*) AS n, sum(vid * 1000 + idx)::BIGINT AS digest, count(CASE WHEN kind = 'easy' AND vid % {HELD_OUT} = 0 THEN 1 END) AS n_held_out
FROM tp GROUP BY qid, kind""")
def train_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = training(spark, sf_dir)[2]
    held_out = F.count(F.when((F.col("kind") == "easy") & (F.col("vid") % HELD_OUT == 0), 1))
    return pools.groupBy("qid", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("vid") * 1000 + F.col("idx")).alias("digest"), held_out.alias("n_held_out"))


@query(f"WITH {_TRAINING}\nSELECT min(n) AS least, max(n) AS most, median(n) AS middle FROM (SELECT count(*) AS n FROM tp GROUP BY qid)")
def train_pool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = training(spark, sf_dir)[2].groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.median("n").alias("middle"))


@query(f"""WITH {_CHUNKS}, r AS (SELECT qid, row_number() OVER (ORDER BY md5('6|' || qid || '|0'), qid) - 1 AS place FROM c)
SELECT qid, place // 64 AS batch FROM r""")
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batches(chunk_table(spark, sf_dir).select("qid"), "qid", 64, seed=4, epoch=2)


def _loss_sql(name: str, query_vector: str) -> str:
    return f"""{name}l AS (
  SELECT p.qid, kind, round(list_dot_product(q.{query_vector}, d.v), 6) / 0.07 AS l
  FROM tp p JOIN c d ON d.vid = p.vid AND d.idx = p.idx JOIN q0 q ON q.qid = p.qid),
{name} AS (
  SELECT qid, ln(sum(exp(l - m))) + max(m) - max(CASE WHEN kind = 'oracle' THEN l END) AS loss
  FROM (SELECT *, max(l) OVER (PARTITION BY qid) AS m FROM {name}l) GROUP BY qid)"""


@query(f"""WITH {_TRAINING},
{_loss_sql("ql", "q")},
{_loss_sql("gold", "v")},
r AS (SELECT qid, row_number() OVER (ORDER BY md5('6|' || qid || '|0'), qid) - 1 AS place FROM c),
b AS (SELECT place // 64 AS batch, count(*) AS n, avg(ql.loss + 0.5 * gold.loss) AS loss FROM ql JOIN gold USING (qid) JOIN r USING (qid) GROUP BY batch)
SELECT sum(n)::BIGINT AS n, round(sum(loss * n) / sum(n), 5) AS loss FROM b""")
def infonce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of an epoch over training pools, the gold answer's search counting half; batches weigh by their size."""
    chunks, questions, pools = training(spark, sf_dir)
    asked = questions.join(chunks.select("qid", F.col("v").alias("gold")), "qid")
    scores = R.scored(pools.withColumn("is_oracle", F.col("kind") == "oracle"), asked, chunks, vector="v")
    answers = R.scored(pools, asked, chunks, query="gold", vector="v").select("qid", "vid", "idx", F.col("score").alias("answer"))
    losses = R.pool_loss(scores.join(answers, ["qid", "vid", "idx"]), math.log(0.07), "answer", 0.5)
    each = R.batches(losses, "qid", 64, seed=4, epoch=2).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))
    return each.agg(F.sum("n").alias("n"), F.round(R.mean_loss(each), 5).alias("loss"))


@query(f"""WITH {_TRAINING},
f AS (SELECT p.qid, kind = 'oracle' AS o, q.q, d.v, d.t, {S.plus("d.v", "d.t")} AS f FROM tp p JOIN c d ON d.vid = p.vid AND d.idx = p.idx JOIN q0 q ON q.qid = p.qid),
n AS (SELECT *, sqrt(list_dot_product(q, q)) AS nq, sqrt(list_dot_product(f, f)) AS nf FROM f),
u AS (SELECT *, list_dot_product(q, f) / (nq * nf) AS u, u / 0.07 AS l FROM n),
s AS (SELECT *, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY qid) - CASE WHEN o THEN 1 ELSE 0 END AS s FROM (SELECT *, max(l) OVER (PARTITION BY qid) AS m FROM u))
SELECT count(*) FILTER (o) AS n, round(-sum(ln(s + 1)) FILTER (o) / n, 5) AS loss,
  round(sum(s / 0.07 * (list_dot_product(q, v) / (nq * nf) - u * list_dot_product(f, v) / (nf * nf))) / n, 5) AS alpha,
  round(sum(s / 0.07 * (list_dot_product(q, t) / (nq * nf) - u * list_dot_product(f, t) / (nf * nf))) / n, 5) AS beta,
  round(-sum(s * l) / n, 5) AS log_temperature
FROM s""")
def training_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss and slopes of a new adapter over the third epoch's pools: what the training loop's first step would see
    if all questions were one batch."""
    chunks, questions, pools = training(spark, sf_dir)
    order = R.batches(questions.select("qid"), "qid", 64, seed=4, epoch=2)
    n, loss, g = TR.summed(TR.encoded(pools, order, questions, chunks), A.build("small", 64, rank=8))
    row = (n, round(loss / n, 5), *(round(float(g[k]) / n, 5) for k in ("alpha", "beta", "log_temperature")))
    return spark.createDataFrame([row], "n bigint, loss double, alpha double, beta double, log_temperature double")


@query(f"""WITH {_TRAINING},
r AS (SELECT qid, row_number() OVER (ORDER BY md5('6|' || qid || '|0'), qid) - 1 AS place FROM c),
m AS (SELECT r.place // 64 AS batch, p.qid, p.vid, p.idx, kind <> 'oracle' AS other FROM tp p JOIN r USING (qid)),
d AS (
  SELECT batch, vid, idx, row_number() OVER (PARTITION BY batch ORDER BY vid, idx) - 1 AS place
  FROM (SELECT DISTINCT batch, vid, idx FROM m)),
s AS (
  SELECT batch, place, row_number() OVER (PARTITION BY batch, qid ORDER BY other, place) AS k
  FROM m JOIN d USING (batch, vid, idx))
SELECT batch, max(place) + 1 AS distinct_chunks, count(*) AS positions, sum(place * k)::BIGINT AS digest FROM s GROUP BY batch""")
def batch_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch of an epoch: its distinct chunks, and how many places among them its pools are made of."""
    chunks, questions, pools = training(spark, sf_dir)
    order = R.batches(questions.select("qid"), "qid", 64, seed=4, epoch=2)
    each = TR.dictionary(pools, order)[1].select("batch", F.posexplode("positions").alias("k", "place"))
    return each.groupBy("batch").agg(
        (F.max("place") + 1).cast("bigint").alias("distinct_chunks"), F.count(F.lit(1)).alias("positions"), F.sum(F.col("place") * (F.col("k") + 1)).cast("bigint").alias("digest"),
    )


#: Epochs of the registered run, and batches of an epoch.
RUN_EPOCHS, RUN_BATCHES = 3, 2
_RATE, _DECAY = 0.05, 0.01


def _step_sql(epoch: int, batch: int) -> str:
    """A step over three numbers: slopes from the scalar products of a pool's members, then moments and move."""
    k = epoch * RUN_BATCHES + batch
    moved = []
    for x in "abl":
        moved += [f"0.9 * m{x} + 0.1 * g{x} AS m{x}", f"0.999 * v{x} + 0.001 * g{x} * g{x} AS v{x}"]
        first, second = f"(0.9 * m{x} + 0.1 * g{x}) / (1 - pow(0.9, {k + 1}))", f"(0.999 * v{x} + 0.001 * g{x} * g{x}) / (1 - pow(0.999, {k + 1}))"
        moved.append(f"{x} - {_RATE} * ({_DECAY} * {x} + ({first}) / (sqrt({second}) + 1e-8)) AS {x}")
    return f"""f{k} AS (
  SELECT d.*, p.*, sqrt(a * a * vv + 2 * a * b * vt + b * b * tt) AS nf, greatest(exp(l), 0.01) AS warm FROM dots{epoch} d, p{k} p WHERE batch = {batch}),
u{k} AS (SELECT *, (a * qv + b * qt) / nf AS u, (a * qv + b * qt) / nf / warm AS logit FROM f{k}),
s{k} AS (
  SELECT *, exp(logit - most) / sum(exp(logit - most)) OVER (PARTITION BY qid) AS share
  FROM (SELECT *, max(logit) OVER (PARTITION BY qid) AS most FROM u{k})),
g{k} AS MATERIALIZED (
  SELECT count(*) FILTER (o) AS n, -sum(ln(share)) FILTER (o) AS loss,
    sum((share - o::INT) / warm * (qv / nf - u * (a * vv + b * vt) / (nf * nf))) / count(*) FILTER (o) AS ga,
    sum((share - o::INT) / warm * (qt / nf - u * (a * vt + b * tt) / (nf * nf))) / count(*) FILTER (o) AS gb,
    -sum((share - o::INT) * logit) / count(*) FILTER (o) AS gl FROM s{k}),
p{k + 1} AS MATERIALIZED (SELECT {", ".join(moved)} FROM p{k}, g{k})"""


def _epoch_sql(epoch: int) -> str:
    """The epoch's pools and batches, its steps, and the held-out questions ranked by where they lead to."""
    last = (epoch + 1) * RUN_BATCHES
    steps = ",\n".join(_step_sql(epoch, b) for b in range(RUN_BATCHES))
    losses = " UNION ALL ".join(f"SELECT n, loss FROM g{epoch * RUN_BATCHES + b}" for b in range(RUN_BATCHES))
    return f"""{S.cross_pools(f"ep{epoch}", str(N_EASY + 1), f"vid % {HELD_OUT} = 0", seed=1 + epoch)},
order{epoch} AS (
  SELECT qid, (row_number() OVER (ORDER BY md5('{1 + epoch}|' || qid || '|0'), qid) - 1) // ceil(count(*) OVER () / {RUN_BATCHES}.0)::BIGINT AS batch
  FROM q0 WHERE vid % {HELD_OUT} <> 0),
dots{epoch} AS MATERIALIZED (
  SELECT p.qid, o.batch, p.is_oracle AS o, list_dot_product(q.q, d.v) / nq AS qv, list_dot_product(q.q, d.t) / nq AS qt,
    list_dot_product(d.v, d.v) AS vv, list_dot_product(d.v, d.t) AS vt, list_dot_product(d.t, d.t) AS tt
  FROM (SELECT qid, vid, idx, is_oracle FROM wp UNION ALL SELECT qid, vid, idx, FALSE FROM ep{epoch} WHERE NOT is_oracle) p
  JOIN order{epoch} o ON o.qid = p.qid JOIN c d ON d.vid = p.vid AND d.idx = p.idx JOIN (SELECT *, sqrt(list_dot_product(q, q)) AS nq FROM q0) q ON q.qid = p.qid),
{steps},
score{epoch} AS (
  SELECT qid, is_oracle, round((a * qv + b * qt) / sqrt(a * a * vv + 2 * a * b * vt + b * b * tt), 6) AS score FROM held, p{last}),
{S.ranks(f"rank{epoch}", f"score{epoch}")},
epoch{epoch} AS (
  SELECT 'run' AS run, {epoch} AS epoch, (SELECT round(sum(loss) / sum(n), 5) FROM ({losses})) AS loss, (SELECT round(avg((rank = 0)::INT), 6) FROM rank{epoch}) AS top1)"""


@query(f"""WITH {_CHUNKS},
{S.WITHIN_POOLS},
held AS (
  SELECT p.qid, p.is_oracle, list_dot_product(q.q, d.v) / nq AS qv, list_dot_product(q.q, d.t) / nq AS qt,
    list_dot_product(d.v, d.v) AS vv, list_dot_product(d.v, d.t) AS vt, list_dot_product(d.t, d.t) AS tt
  FROM wp p JOIN c d ON d.vid = p.vid AND d.idx = p.idx JOIN (SELECT *, sqrt(list_dot_product(q, q)) AS nq FROM q0) q ON q.qid = p.qid WHERE p.vid % {HELD_OUT} = 0),
p0 AS (SELECT 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, ln(0.07) AS l, 0.0::DOUBLE AS ma, 0.0::DOUBLE AS mb, 0.0::DOUBLE AS ml, 0.0::DOUBLE AS va, 0.0::DOUBLE AS vb, 0.0::DOUBLE AS vl),
{",".join(_epoch_sql(e) for e in range(RUN_EPOCHS))}
{" UNION ALL ".join(f"SELECT * FROM epoch{e}" for e in range(RUN_EPOCHS))}""")
def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of the training loop that learns the weights of both towers and the temperature, two batches an epoch: loss
    and held-out top1 of each epoch."""
    chunks, questions = _tables(spark, sf_dir)
    dev = chunks.filter(F.col("vid") % HELD_OUT == 0).select("vid").distinct()
    size = math.ceil(Q.fit_rows(questions, dev).count() / RUN_BATCHES)
    new = A.build("small", 64, rank=0)
    history = TR.train(new, chunks, questions, dev, RUN_EPOCHS, size, _RATE, _DECAY, N_EASY, RUN_EPOCHS, seed=1)[1]
    return history.select("run", "epoch", F.round("loss", 5).alias("loss"), "top1")


@query(f"""WITH {_CHUNKS}, f AS (SELECT qid, list_transform(list_zip(v, t), lambda z: 0.25 * z[1] + 0.75 * z[2]) AS f FROM c)
SELECT qid, round(f[1] / sqrt(list_dot_product(f, f)), 6) AS first, round(f[64] / sqrt(list_dot_product(f, f)), 6) AS last FROM f""")
def adapter_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_table(spark, sf_dir).select("qid", A.adapted(F.col("v"), F.col("t"), 0.25, 0.75).alias("a"))
    return rows.select("qid", F.round(F.element_at("a", 1), 6).alias("first"), F.round(F.element_at("a", 64), 6).alias("last"))


def _fixed(rows: int, columns: int, shift: int) -> np.ndarray:
    """Numbers by a rule, so that the SQL can make them too: row i, column j (from 1)."""
    i, j = np.meshgrid(np.arange(1, rows + 1), np.arange(1, columns + 1), indexing="ij")
    return ((i * 7 + j * 3 + shift) % 11 - 5) / 40


def _fixed_column(rows: str, j: str, shift: int) -> str:
    return f"list_transform(range(1, {rows} + 1), lambda i: ((i * 7 + {j} * 3 + {shift}) % 11 - 5) / 40.0)"


def _times(x: str, rows: int, columns: int, shift: int) -> str:
    """A list times a fixed matrix."""
    return f"list_transform(range(1, {columns} + 1), lambda j: list_dot_product({x}, {_fixed_column(str(rows), 'j', shift)}::DOUBLE[]))"


def _gelu_sql(z: str) -> str:
    """GELU of each component by the series of the error function, which 60 terms take to all places below 4."""
    erf = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(abs(x) / sqrt(2)) - lgamma(n + 1)) / (2 * n + 1))) * sign(x)"
    return f"list_transform({z}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE 0.5 * x * (1 + {erf}) END)"


def _added(*parts: str) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_transform(list_zip({out}, {p}), lambda z: z[1] + z[2])"
    return out


_RANK, _HIDDEN, _ALPHA, _BETA = 3, 4, 0.75, 1.25


def fixed_adapter(name: str) -> A.Adapter:
    """An adapter whose every layer has numbers: not the identity, as a new one is."""
    if name == "small":
        branches = [A.Residual(_fixed(n, _RANK, s), _fixed(_RANK, 64, s + 1)) for n, s in ((64, 0), (128, 4))]
    else:
        branches = [
            A.Deep(((_fixed(n, _HIDDEN, s), _fixed(1, _HIDDEN, s + 1)[0]), (_fixed(_HIDDEN, _HIDDEN, s + 2), _fixed(1, _HIDDEN, s + 3)[0]), (_fixed(_HIDDEN, 64, s + 4), _fixed(1, 64, s + 5)[0])), 1 + _fixed(1, n, s + 6)[0], _fixed(1, n, s + 7)[0])
            for n, s in ((64, 0), (128, 4))
        ]
    return A.Adapter(*branches, _ALPHA, _BETA)


def _row(n: int, shift: int, more: str = "") -> str:
    """The fixed matrix of one row, as a list."""
    return f"list_transform(range(1, {n} + 1), lambda j: {more}((7 + j * 3 + {shift}) % 11 - 5) / 40.0)"


def _small_sql() -> str:
    q = f"{_times(_gelu_sql(_times('t', 64, _RANK, 0)), _RANK, 64, 1)}"
    c = f"{_times(_gelu_sql(_times('list_concat(v, t)', 128, _RANK, 4)), _RANK, 64, 5)}"
    return f"r AS (SELECT *, {q} AS rq, {c} AS rc FROM c)"


def _deep_sql(name: str, x: str, n: int, s: int) -> str:
    """Layer normalisation, two hidden layers, a projection; a table a step."""
    return f"""{name}0 AS (SELECT *, {x} AS x FROM c),
{name}1 AS (SELECT * EXCLUDE (x), list_transform(x, lambda y: y - list_avg(x)) AS x FROM {name}0),
{name}2 AS (SELECT * EXCLUDE (x), list_transform(list_zip(list_transform(x, lambda y: y / sqrt(list_dot_product(x, x) / {n} + 1e-5)),
  {_row(n, s + 6, '1 + ')}, {_row(n, s + 7)}), lambda z: z[1] * z[2] + z[3]) AS x FROM {name}1),
{name}3 AS (SELECT * EXCLUDE (x), {_gelu_sql(_added(_times('x', n, _HIDDEN, s), _row(_HIDDEN, s + 1)))} AS x FROM {name}2),
{name}4 AS (SELECT * EXCLUDE (x), {_gelu_sql(_added(_times('x', _HIDDEN, _HIDDEN, s + 2), _row(_HIDDEN, s + 3)))} AS x FROM {name}3),
{name}5 AS (SELECT qid, {_added(_times('x', _HIDDEN, 64, s + 4), _row(64, s + 5))} AS x FROM {name}4)"""


_ADAPTED = f"""a AS (
  SELECT * EXCLUDE (rq, rc), list_transform(list_zip(v, t, rc), lambda z: {_ALPHA} * z[1] + {_BETA} * z[2] + z[3]) AS f, list_transform(list_zip(t, rq), lambda z: z[1] + z[2]) AS q FROM r),
u AS (SELECT *, {S.unit("f")} AS uf, {S.unit("q")} AS uq FROM a)"""
_SMALL = f"{_CHUNKS},\n{_small_sql()},\n{_ADAPTED}"
_DEEP = f"""{_CHUNKS},
{_deep_sql("dq", "t", 64, 0)},
{_deep_sql("dc", "list_concat(v, t)", 128, 4)},
r AS (SELECT c.*, dq5.x AS rq, dc5.x AS rc FROM c JOIN dq5 USING (qid) JOIN dc5 USING (qid)),
{_ADAPTED}"""
_COMPONENTS = "SELECT qid, i, round(uf[i], 6) AS chunk, round(uq[i], 6) AS query FROM (SELECT *, unnest(range(1, 65)) AS i FROM u)"


def _adapted_components(spark: SparkSession, sf_dir: str, adapter: A.Adapter) -> DataFrame:
    chunks, questions = _tables(spark, sf_dir)
    done, asked = A.adapt_cache(chunks, questions, adapter)
    rows = done.select("qid", "v").join(asked.select("qid", "query"), "qid")
    each = rows.select("qid", F.posexplode(F.arrays_zip(F.col("v").alias("chunk"), F.col("query").alias("query"))).alias("at", "x"))
    return each.select("qid", (F.col("at") + 1).cast("bigint").alias("i"), F.round("x.chunk", 6).alias("chunk"), F.round("x.query", 6).alias("query"))


@query(f"WITH {_SMALL}\n{_COMPONENTS}")
def adapted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache pushed through a small adapter with numbers in all its layers, by components."""
    return _adapted_components(spark, sf_dir, fixed_adapter("small"))


@query(f"WITH {_DEEP}\n{_COMPONENTS}")
def adapted_cache_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapted_components(spark, sf_dir, fixed_adapter("big"))


@query(f"""WITH {_SMALL},
{S.WITHIN_POOLS},
s AS (SELECT p.qid, p.is_oracle, round(list_dot_product(q.uq, d.uf), 6) AS score FROM wp p JOIN u d ON d.vid = p.vid AND d.idx = p.idx JOIN u q ON q.qid = p.qid WHERE p.vid % {HELD_OUT} = 0),
{S.ranks("rk", "s")}
SELECT {S.METRICS} FROM rk""")
def evaluate_adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adapted cache scored on the held-out videos' questions, as a frozen one would be."""
    chunks, questions = _tables(spark, sf_dir)
    done, asked = A.adapt_cache(chunks, questions, fixed_adapter("small"))
    asked = Q.only(asked, chunks.filter(F.col("vid") % HELD_OUT == 0))
    return R.metrics(R.pessimistic_ranks(R.scored_within(asked, done, vector="v")))


_HISTORY_SQL = """h AS (
  SELECT 'r' || doc_id % 4 AS run, (doc_id // 50)::INT AS epoch, round(avg(quality), 6) AS top1 FROM labels WHERE quality IS NOT NULL GROUP BY ALL)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, epoch, top1: four runs over the labelled documents, an epoch for each fifty ids, by their share of good ones."""
    rows = table(spark, sf_dir, "labels").filter("quality IS NOT NULL")
    run, epoch = F.concat(F.lit("r"), F.col("doc_id") % 4), F.floor(F.col("doc_id") / 50).cast("int")
    return rows.groupBy(run.alias("run"), epoch.alias("epoch")).agg(F.round(F.avg("quality"), 6).alias("top1"))


@query(f"""WITH {_HISTORY_SQL},
b AS (
  SELECT *, coalesce(top1 > max(top1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best FROM h),
c AS (SELECT *, max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM b)
SELECT run, epoch, is_best, best_epoch, epoch - best_epoch >= 2 AS stopped FROM c""")
def early_stop_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.replay(_history(spark, sf_dir), 2).select("run", "epoch", "is_best", "best_epoch", "stopped")


@query(f"""WITH {_HISTORY_SQL}
SELECT run, epoch, top1 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY top1 DESC, epoch) AS rn FROM h) WHERE rn = 1""")
def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_epoch(_history(spark, sf_dir))


@query(f"""WITH h AS (SELECT doc_id, {S.hashed("ws")} AS h FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents))
SELECT doc_id, i, round(h[i] / greatest(sqrt(list_dot_product(h, h)), 1e-12), 6) AS x FROM (SELECT *, unnest(range(1, 33)) AS i FROM h)""")
def query_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoders.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "hash")
    return rows.select("doc_id", F.posexplode("emb").alias("at", "x")).select("doc_id", (F.col("at") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


QUERIES, ORACLES = query.queries, query.oracles
