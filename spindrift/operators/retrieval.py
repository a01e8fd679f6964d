"""Pools, scores, ranks and metrics of retrieval evaluation.

Chunks are rows (vid, idx, ...), questions rows (qid, vid, oracle_idx, ...). Pools carry ids only; vectors are joined
to the rows that a pool kept, so nothing grows with questions times chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import expr as X
from spindrift.schema import BANDS, POOL_TYPES, REPRESENTATIONS

#: Places that scores are rounded to before they are ranked, since sums differ in their last bits between engines.
PLACES = 6
#: Places of oracles, so chunks of the longest video, that are sent to all tasks at most.
MOST_PLACES = 100_000


def within_pools(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, vid, idx, is_oracle: each question with all chunks of its own video."""
    own = chunks.select("vid", "idx")
    return questions.select("qid", "vid", "oracle_idx").join(own, "vid").select("qid", "vid", "idx", (F.col("idx") == F.col("oracle_idx")).alias("is_oracle"))


def number_of(*parts: Column, seed: int, below: Column) -> Column:
    """A number from 0 up to ``below``, by a seeded hash of ``parts``."""
    return F.pmod(F.conv(F.substring(X.draw(seed, *parts), 1, 12), 16, 10).cast("bigint"), below)


def cross_pools(questions: DataFrame, chunks: DataFrame, seed: int = 0, pool_size: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """qid, vid, idx, is_oracle: each question's oracle, and chunks of other videos drawn without replacement.

    A pool has ``pool_size`` chunks, by default as many as the question's video has, or fewer if there aren't so many.
    Chunks are numbered in the order of a seeded hash; each question draws numbers of its own by hashing its id with 0,
    1, ... and passes over those that it drew before and its own video's. Twice as many draws as are needed are made;
    should they not do, the numbers from a drawn one on follow in turn. Numbers are joined by equality, so a question
    meets its pool plus as many rows as its own video has, and no others.
    """
    if pool_size is not None and pool_size < 2:
        raise ValueError("a pool has at least 2 chunks")
    own = chunks.groupBy("vid").agg(F.count(F.lit(1)).alias("own"))
    others = chunks.join(exclude.select("vid").distinct(), "vid", "left_anti") if exclude is not None else chunks
    ring = ring_positions(others.select("vid", "idx"), seed)
    n = ring.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    asked = questions.select("qid", "vid", "oracle_idx").join(own, "vid")
    size = F.lit(pool_size).cast("bigint") if pool_size is not None else F.col("own")
    oracle = asked.select("qid", "vid", F.col("oracle_idx").alias("idx"), F.lit(True).alias("is_oracle"))
    if not n:
        return oracle
    wanted = asked.filter(size > 1).select("qid", F.col("vid").alias("qvid"), (size - 1).alias("want"), (size - 1 + F.col("own")).alias("reach"))
    drawn = F.transform(F.sequence(F.lit(0).cast("bigint"), 2 * F.col("reach") - 1), lambda k: number_of(F.col("qid"), k, seed=seed, below=F.lit(n)))
    first = number_of(F.col("qid"), seed=seed, below=F.lit(n))
    in_turn = F.transform(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(n), F.col("reach")) - 1), lambda k: F.pmod(first + k, F.lit(n)))
    numbers = F.slice(F.array_distinct(F.concat(drawn, in_turn)), F.lit(1), F.least(F.lit(n), F.col("reach")).cast("int"))
    steps = wanted.select("qid", "qvid", "want", F.posexplode(numbers).alias("step", "position"))
    met = steps.join(ring, "position").filter("vid <> qvid")
    kept = met.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy("step"))).filter("rn <= want")
    return oracle.unionByName(kept.select("qid", "vid", "idx", F.lit(False).alias("is_oracle")))


def pools_of(kind: str, questions: DataFrame, chunks: DataFrame, seed: int = 0, pool_size: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The pools of a pool type; size and exclusion are for cross pools alone."""
    if kind not in POOL_TYPES:
        raise ValueError(f"unknown pool type {kind!r}")
    if kind == "cross":
        return cross_pools(questions, chunks, seed, pool_size, exclude)
    if pool_size is not None or exclude is not None:
        raise ValueError("only a cross pool has a size or leaves videos out")
    return within_pools(questions, chunks)


def training_pools(questions: DataFrame, chunks: DataFrame, n_easy: int = 256, seed: int = 0, epoch: int = 0, held_out: DataFrame | None = None) -> DataFrame:
    """qid, vid, idx, kind: each question's oracle, its video's other chunks (hard) and ``n_easy`` chunks of videos that
    are neither its own nor ``held_out`` (easy), drawn anew for each epoch."""
    if n_easy < 0:
        raise ValueError("a number of chunks isn't negative")
    near = within_pools(questions, chunks).select("qid", "vid", "idx", F.when(F.col("is_oracle"), "oracle").otherwise("hard").alias("kind"))
    if not n_easy:
        return near
    far = cross_pools(questions, chunks, seed + epoch, n_easy + 1, held_out).filter("NOT is_oracle")
    return near.unionByName(far.select("qid", "vid", "idx", F.lit("easy").alias("kind")))


def batches(rows: DataFrame, key: str, size: int, seed: int = 0, epoch: int = 0, stretch: int | None = None) -> DataFrame:
    """``rows`` with ``batch``: all rows in a random order, redrawn for each epoch, cut into batches of ``size``; ``key``
    tells rows apart. With ``stretch`` a batch is cut on into stretches of so many rows, and ``stretch`` numbers them."""
    at = ring_positions(rows.select(F.col(key).alias("vid"), F.lit(0).alias("idx")), seed + epoch)
    cut = [F.floor(F.col("position") / size).alias("batch")]
    if stretch is not None:
        cut.append(F.floor(F.pmod(F.col("position"), F.lit(size)) / stretch).alias("stretch"))
    return rows.join(at.select(F.col("vid").alias(key), *cut), key)


def ring_positions(chunks: DataFrame, seed: int, cells: int = 4096) -> DataFrame:
    """position (from 0, without gaps), vid, idx in the order of a seeded hash; numbered by cells of the hash, so no task
    sorts all rows."""
    h = X.draw(seed, F.col("vid"), F.col("idx"))
    rows = chunks.select("vid", "idx", h.alias("h"), F.conv(F.substring(h, 1, 3), 16, 10).cast("int").alias("cell"))
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # 4,096 cells at most
    before = sizes.select("cell", (F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    at = F.row_number().over(W.partitionBy("cell").orderBy("h", "vid", "idx"))
    return rows.withColumn("at", at).join(F.broadcast(before), "cell").select((F.col("base") + F.col("at") - 1).alias("position"), "vid", "idx")


def scored(pools: DataFrame, questions: DataFrame, chunks: DataFrame, query: str = "query", vector: str = "vector") -> DataFrame:
    """``pools`` with the similarity of the question's and the chunk's vectors. Ids meet the chunks first, so that the
    rows are then dealt by question once, for the queries and for the ranks."""
    q = questions.select("qid", F.col(query).alias("__q"))
    c = chunks.select("vid", "idx", F.col(vector).alias("__c"))
    return pools.join(c, ["vid", "idx"]).join(q, "qid").withColumn("score", F.round(X.dot(F.col("__q"), F.col("__c")), PLACES)).drop("__q", "__c")


def scored_within(questions: DataFrame, chunks: DataFrame, query: str = "query", vector: str = "vector") -> DataFrame:
    """Within pools with their scores: qid, vid, idx, is_oracle, score. One join by video brings both vectors together, so
    neither is dealt out a second time."""
    q = questions.select("qid", "vid", "oracle_idx", F.col(query).alias("__q"))
    c = chunks.select("vid", "idx", F.col(vector).alias("__c"))
    return q.join(c, "vid").select("qid", "vid", "idx", (F.col("idx") == F.col("oracle_idx")).alias("is_oracle"), F.round(X.dot(F.col("__q"), F.col("__c")), PLACES).alias("score"))


def pessimistic_ranks(scores: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys, rank, pool: how many candidates score at least as much as the oracle, itself apart. A NaN candidate is not
    ahead; a NaN oracle has a null rank."""
    best = F.max(F.when(F.col("is_oracle"), F.col("score")))
    held = scores.withColumn("oracle_score", best.over(W.partitionBy(*keys)))
    ahead = F.count(F.when((F.col("score") >= F.col("oracle_score")) & ~F.isnan("score"), 1)) - 1
    out = held.groupBy(*keys).agg(ahead.alias("rank"), F.count(F.lit(1)).alias("pool"), F.max("oracle_score").alias("s"))
    return out.select(*keys, F.when(~F.isnan("s"), F.col("rank")).alias("rank"), "pool")


def setup_ranks(pairs: DataFrame, setups: list[tuple[dict[str, str], Column, str]], keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys, setup columns, rank, pool of many setups from one row a pair of question and candidate.

    A setup is its names, the candidate's score and the column with the oracle's score, which is on each pair's row, as
    it is the question's own. So all setups are counted in one aggregate without a sort, and a pair is dealt out once,
    not once for each setup. NaN counts as in ``pessimistic_ranks``.
    """
    once = pairs.select(*keys, *(own for _, _, own in setups), *(score.alias(f"__score_{i}") for i, (_, score, _) in enumerate(setups)))
    ahead = [F.count(F.when((F.col(f"__score_{i}") >= F.col(own)) & ~F.isnan(f"__score_{i}"), 1)).alias(f"__ahead_{i}") for i, (_, _, own) in enumerate(setups)]
    counted = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool"), *ahead, *(F.max(own).alias(own) for _, _, own in setups))
    each = [F.struct(*(F.lit(v).alias(n) for n, v in names.items()), F.when(~F.isnan(own), F.col(f"__ahead_{i}") - 1).alias("rank")) for i, (names, _, own) in enumerate(setups)]
    return counted.select(*keys, "pool", F.inline(F.array(*each)))


def metrics(ranks: DataFrame, keys: tuple[str, ...] = (), places: int = 6) -> DataFrame:
    """n, top1, top3, mrr and the random floor, in one aggregation."""
    aggs = [
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("rank") == 0).cast("int")), places).alias("top1"), F.round(F.avg((F.col("rank") < 3).cast("int")), places).alias("top3"),
        F.round(F.avg(1 / (F.col("rank") + 1)), places).alias("mrr"), F.round(F.avg(1 / F.col("pool")), places).alias("random"),
    ]
    return ranks.groupBy(*keys).agg(*aggs) if keys else ranks.agg(*aggs)


def banded(ranks: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per band, and per setup that ``keys`` name, empty ones with n = 0 and nulls: keys, band, n, top1, its Wilson
    interval, the floor."""
    spark = ranks.sparkSession
    table = spark.createDataFrame([(i, str(lo) if lo == hi else f"{lo}-{hi}") for i, (lo, hi) in enumerate(bands)], "ord int, band string")
    if keys:
        table = ranks.select(*keys).distinct().withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(len(bands) - 1)))).join(F.broadcast(table), "ord")
    which = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(bands):
        which = F.when(F.col("pool").between(lo, hi), i).otherwise(which)
    placed = ranks.withColumn("ord", which).filter("ord IS NOT NULL")
    found = placed.groupBy(*keys, "ord").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rank") == 0, 1)).alias("k"), F.avg(1 / F.col("pool")).alias("r"))
    lo, hi = X.wilson(F.col("k"), F.col("n"))
    joined = table.join(found, [*keys, "ord"], "left")
    return joined.select(*keys, "band", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("k") / F.col("n"), 6).alias("top1"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), F.round("r", 6).alias("random"))


def paired(a: DataFrame, b: DataFrame, hit: str = "hit", keys: tuple[str, ...] = ("qid",), by: tuple[str, ...] = ()) -> DataFrame:
    """n, n10, n01, delta and the exact two-sided p of two hit columns, paired by ``keys`` and ``by``, for each ``by``; a
    setup or question without a partner is passed over."""
    both = a.select(*keys, *by, F.col(hit).alias("a")).join(b.select(*keys, *by, F.col(hit).alias("b")), [*keys, *by])
    return mcnemar((both.groupBy(*by) if by else both).agg(*paired_counts()))


def later_wins(tables: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """The union of score tables; of rows with equal keys that of the last table stays."""
    values = [c for c in tables[0].columns if c not in keys]
    rows = reduce(DataFrame.unionByName, [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__table").alias("__v")).select(*keys, "__v.*")


def score_table(scores: DataFrame) -> DataFrame:
    """Scores by setup in the order of the figures: encoder, pool type, representation, then the shorter query form."""
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    return scores.orderBy("encoder", place(POOL_TYPES, "pool_type"), place(REPRESENTATIONS, "representation"), F.length("query_form"))


def contrast(scores: DataFrame, by: tuple[str, ...] = ("encoder", "representation", "query_form")) -> DataFrame:
    """by, within, cross, delta, same_floor: top1 of either pool type for each setup scored on both; ``same_floor`` says
    whether the floors agree to four places, without which they aren't comparable."""
    of = lambda kind, c: F.max(F.when(F.col("pool_type") == kind, F.col(c)))
    both = scores.groupBy(*by).agg(of("within", "top1").alias("within"), of("cross", "top1").alias("cross"), F.round(of("within", "random"), 4).alias("f0"), F.round(of("cross", "random"), 4).alias("f1"))
    return both.filter("within IS NOT NULL AND cross IS NOT NULL").select(*by, "within", "cross", F.round(F.col("cross") - F.col("within"), 6).alias("delta"), (F.col("f0") == F.col("f1")).alias("same_floor"))


def paired_counts() -> list[Column]:
    a, b = F.col("a"), F.col("b")
    return [F.count(F.lit(1)).alias("n"), F.count(F.when(a & ~b, 1)).alias("n10"), F.count(F.when(~a & b, 1)).alias("n01"), F.round(F.avg(a.cast("int")) - F.avg(b.cast("int")), 6).alias("delta")]


def mcnemar(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p", F.round(X.mcnemar_p(F.col("n10"), F.col("n01")), 6))


def top1(scores: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The best candidate; of equals the first chunk (optimistic, unlike the rank)."""
    best = F.max_by(F.struct("vid", "idx"), F.struct(F.col("score"), -F.col("idx"), F.col("vid").cast("string")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.vid", "b.idx")


def random_pick(questions: DataFrame, chunks: DataFrame, seed: int = 0) -> DataFrame:
    """qid, vid, idx: one chunk of the own video, each as likely."""
    n = chunks.groupBy("vid").agg(F.count(F.lit(1)).alias("n"))
    at = number_of(F.col("qid"), seed=seed, below=F.col("n"))
    return questions.select("qid", "vid").join(n, "vid").select("qid", "vid", at.alias("idx"))


def shuffled(questions: DataFrame, seed: int = 0, query: str = "query") -> DataFrame:
    """Each question with the query of another video's question, drawn with replacement; one video alone is an error.

    Questions lie on a ring by video; one of those outside the own video's stretch is picked by a seeded hash.
    """
    n = questions.count()
    if questions.select("vid").distinct().limit(2).count() < 2:
        raise ValueError("queries can't be shuffled within one video")
    per = questions.groupBy("vid").agg(F.count(F.lit(1)).alias("m"))
    # one row per video; cells of a hash number them without one task sorting all
    cell = F.conv(F.substring(F.md5(F.col("vid").cast("string")), 1, 3), 16, 10).cast("int")
    per = per.withColumn("cell", cell)
    sizes = per.groupBy("cell").agg(F.sum("m").alias("s"))
    base = sizes.select("cell", (F.sum("s").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("s")).alias("base"))
    first = F.sum("m").over(W.partitionBy("cell").orderBy("vid").rowsBetween(W.unboundedPreceding, 0)) - F.col("m")
    starts = per.withColumn("first", first).join(F.broadcast(base), "cell").select("vid", "m", (F.col("base") + F.col("first")).alias("start"))
    placed = questions.join(starts, "vid").withColumn("position", F.col("start") + F.row_number().over(W.partitionBy("vid").orderBy("qid")) - 1)
    pick = number_of(F.col("qid"), seed=seed, below=n - F.col("m"))
    aim = placed.withColumn("aim", F.pmod(F.col("start") + F.col("m") + pick, F.lit(n)))
    giver = placed.select(F.col("position").alias("aim"), F.col("qid").alias("from_qid"), F.col("vid").alias("from_vid"), F.col(query).alias("__given"))
    return aim.join(giver, "aim").select(*[F.col("__given").alias(query) if c == query else c for c in questions.columns], "from_qid", "from_vid")


def positional_picks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, vid, idx: the place at which oracles are most often, or the next most common one that the video has; of
    equally common ones the first."""
    n = chunks.groupBy("vid").agg(F.count(F.lit(1)).alias("n"))
    common = questions.groupBy(F.col("oracle_idx").alias("idx")).agg(F.count(F.lit(1)).alias("times"))  # a row for each place
    sizes = questions.select("vid").distinct().join(n, "vid").select("n").distinct()
    if common.count() > MOST_PLACES:
        raise ValueError(f"a video of more than {MOST_PLACES} chunks")
    best = sizes.join(F.broadcast(common), F.col("idx") < F.col("n")).groupBy("n").agg(F.max_by("idx", F.struct("times", -F.col("idx"))).alias("idx"))
    return questions.select("qid", "vid").join(n, "vid").join(F.broadcast(best), "n").select("qid", "vid", "idx")


def pool_loss(scores: DataFrame, log_t: float, answer: str | None = None, answer_weight: float = 0.0) -> DataFrame:
    """qid, loss: cross-entropy of the oracle within its pool by ``score``, plus ``answer_weight`` times that of the gold
    answer's scores in the column ``answer``."""
    loss = info_nce(scores, log_t)
    if answer is None or not answer_weight:
        return loss
    other = info_nce(scores.drop("score").withColumnRenamed(answer, "score"), log_t).withColumnRenamed("loss", "__answer")
    return loss.join(other, "qid").select("qid", (F.col("loss") + answer_weight * F.col("__answer")).alias("loss"))


def mean_loss(losses: DataFrame) -> Column:
    """Of batches (loss, n): the mean over questions, each batch weighted by its size."""
    return F.sum(F.col("loss") * F.col("n")) / F.sum("n")


def info_nce(scores: DataFrame, log_t: float) -> DataFrame:
    """qid, loss: log-sum-exp of the pool's scaled scores less the oracle's, shifted by the maximum."""
    t = X.temperature(F.lit(log_t))
    logits = scores.withColumn("l", F.col("score") / t).withColumn("m", F.max("l").over(W.partitionBy("qid")))
    return logits.groupBy("qid").agg((F.log(F.sum(F.exp(F.col("l") - F.col("m")))) + F.max("m") - F.max(F.when(F.col("is_oracle"), F.col("l")))).alias("loss"))
