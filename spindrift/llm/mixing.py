"""Mixing sources to target weights by cube-method balanced sampling.

A source's target, over its size, is how often its documents are to be taken: whole times, and a fraction that is each
document's inclusion probability. The cube method moves these probabilities along directions that change neither the
number of documents nor the number of words (the null space of both constraints over three documents at a time), until
one of the three is in or out for good. A block of documents ends with two undecided ones at most; these meet again in
blocks of their own, until two are left of a whole source. That is the landing problem: whole documents are taken as
far as the words left to take allow, and one document is cut to hit the target.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.base import checkpointed, looked_up, read, repeated, scan_texts
from spindrift.operators.order import numbered

#: Fixed by the contract: weights of the sources in order, the mix as a share of all words, and how often a document may come.
WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Documents of a block, about.
BLOCK = 1024
SEED = 13
#: Probabilities this close to 0 or 1 are there.
NEAR = 1e-9


def _step(window: list[list], draw: float) -> None:
    """Moves the probabilities of up to three units [p, size, ...] until one is 0 or 1; documents and words in total stay.

    The direction is the cross product of (1, 1, 1) and the sizes; where all sizes agree, one unit gains what another
    loses. How far to go up or down is drawn so that each probability is kept on average.
    """
    sizes = [w[1] for w in window]
    if len(window) == 3:
        a, b, c = sizes
        u = [b - c, c - a, a - b] if not a == b == c else [1, -1, 0]
    else:
        u = [1, -1]
    up = min((1 - w[0]) / x if x > 0 else w[0] / -x for w, x in zip(window, u) if x)
    down = min(w[0] / x if x > 0 else (1 - w[0]) / -x for w, x in zip(window, u) if x)
    far = up if draw * (up + down) < down else -down
    for w, x in zip(window, u):
        p = w[0] + far * x
        w[0] = 0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p


def flight(units: list[list], seed: str) -> None:
    """Moves the probabilities of all ``units`` [p, size, ...] to 0 or 1, but for two at most whose sizes differ."""
    rng, window = random.Random(seed), []
    for unit in units:
        if NEAR <= unit[0] <= 1 - NEAR:
            window.append(unit)
        else:
            unit[0] = float(unit[0] > 0.5)
        if len(window) == 3:
            _step(window, rng.random())
            window = [w for w in window if 0 < w[0] < 1]
    while len(window) == 2 and window[0][1] == window[1][1] or len(window) == 3:
        _step(window, rng.random())
        window = [w for w in window if 0 < w[0] < 1]


def landing(left: list[list]) -> list[int]:
    """Words taken of each of the last units [p, size, ...]: in total sum(p * size), rounded.

    The larger ones are taken whole where they fit; of the others one is cut.
    """
    rest = round(sum(p * size for p, size, *_ in left))
    taken = [0] * len(left)
    for i in sorted(range(len(left)), key=lambda i: -left[i][1]):
        if left[i][1] <= rest:
            taken[i] = left[i][1]
            rest -= left[i][1]
    for i in sorted(range(len(left)), key=lambda i: left[i][1]):
        if rest and not taken[i] and left[i][1] > rest:
            taken[i], rest = rest, 0
    return taken


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each whole text, parted by ASCII white space; a null text has none."""
    return scan_texts(docs, lambda text: (len(text.encode("utf-8", "surrogatepass").split()),), {"size": "bigint"}, keep=("doc_id", "source"))


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, ...) with target and per_word, the target over the size (0 where that is 0).

    Sources are numbered by code point, null last, across tasks. What the capped ones leave is shared by the weights of
    the others, again until none is above: each turn is one aggregate over the sources, and only sums reach the driver.
    Shares are whole numbers and fractions until the target is rounded to a double.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "__rank")
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in WEIGHTS)), (F.col("__rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = checkpointed(ranked.withColumn("__weight", weight))
    cap = F.col("source_size") * MOST
    total = SHARE * int(ranked.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0)
    share = Fraction(0)
    while True:
        # share: what one unit of weight gets; a source is capped if its weight gets more than it can give
        over = cap.cast("decimal(38,0)") * F.lit(share.denominator).cast("decimal(38,0)") < F.col("__weight") * F.lit(share.numerator).cast("decimal(38,0)")
        row = ranked.agg(F.sum(F.when(over, cap).cast("decimal(38,0)")).alias("capped"), F.sum(F.when(~over, F.col("__weight")).cast("decimal(38,0)")).alias("open")).first()
        if not row.open:
            break
        after = (total - int(row.capped or 0)) / int(row.open)
        if after == share:
            break
        share = after
    given = F.element_at(F.array(*(F.lit(float(w * share)) for w in sorted(set(WEIGHTS)))), F.array_position(F.array(*(F.lit(w).cast("bigint") for w in sorted(set(WEIGHTS)))), F.col("__weight")).cast("int"))
    out = ranked.withColumn("target", F.when(over, cap.cast("double")).otherwise(given))
    return out.withColumn("per_word", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)).drop("__weight")


def _settle(units: DataFrame, blocks: DataFrame, turn: int) -> DataFrame:
    """The units (rank, doc_id, size, n, p, ...) after a flight in blocks; ``blocks`` gives each rank's number of them.

    ``extra`` is what is taken beyond whole times, null where that is still open. The units of a block come in an order
    of their own, so their partitioning doesn't matter; a block is bounded, as its rows are different ones by their hash.
    """
    keyed = looked_up(units, blocks, "rank").withColumn("block", F.expr(f"pmod(xxhash64(doc_id, size, {SEED + turn}L), blocks)"))

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"]))
        held = [[r["p"], r["size"], r] for r in rows]
        flight(held, f"{SEED}:{turn}:{rows[0]['rank']}:{rows[0]['block']}")
        left = [u for u in held if 0 < u[0] < 1]
        words = dict(zip(map(id, left), landing(left))) if rows[0]["blocks"] == 1 else {}
        for u in held:
            u[2]["p"] = u[0]
            u[2]["extra"] = words.get(id(u)) if 0 < u[0] < 1 else int(u[0]) * u[1]
        return pa.Table.from_pylist([u[2] for u in held], schema=table.schema.append(pa.field("extra", pa.int64())))

    schema = T.StructType([*keyed.schema.fields, T.StructField("extra", T.LongType())])
    return checkpointed(keyed.groupBy("rank", "block").applyInArrow(work, schema).drop("block", "blocks"))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: a row for each row of ``docs``.

    taken is the words that the mix takes of a document, repeats counted, and copies how often it comes whole; of each
    source at most one document is cut, and the words taken of a source are its target but for a rounding. A null text
    has no words and is never cut; a null source is a source of its own, the last; a null doc_id is an id like others.
    Equal rows (source, doc_id, size) are one unit with a count: words and documents in total don't change if all of
    them but one are settled at once, so a row that repeats a million times is neither gathered nor walked. Draws follow
    from ids and sizes, so a rerun on other partitions takes the same. An empty table gives no rows.

    Texts are read once, where they are; ids and sizes are dealt by hash.
    """
    rows = sized(docs)
    units = checkpointed(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    aimed = checkpointed(targets(sources)).withColumnRenamed("__rank", "rank")
    named = ["source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_name")]
    by_name = aimed.select(*named[1:], "rank", "source_size", "target", "per_word", F.col("units").alias("n"))
    placed = looked_up(units.withColumnRenamed("n", "rows").select("doc_id", "size", "rows", *named), by_name, "no_source", "source_name").drop("no_source", "source_name")
    # of n equal rows floor(n * fraction) are in, one may be in, the others are out
    whole = F.least(F.floor("per_word"), F.lit(MOST)).cast("bigint")
    fraction = F.col("per_word") - F.col("whole")
    placed = placed.withColumn("whole", whole).withColumn("in_all", F.floor(F.col("rows") * fraction).cast("bigint"))
    units = checkpointed(placed.withColumn("p", F.col("rows") * fraction - F.col("in_all")).drop("per_word"))

    done, left, turn = [], units, 0
    while True:
        counts = left.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
        blocks = counts.withColumn("blocks", F.ceil(F.col("n") / block).cast("bigint"))
        settled = _settle(left, blocks, turn)
        done.append(settled.filter("extra IS NOT NULL"))
        left = settled.filter("extra IS NULL").drop("extra")
        turn += 1
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # the rows of a unit: those in, the one that was drawn, those out
    of = lambda count, copies, taken: F.struct(count.cast("bigint").alias("times"), copies.cast("int").alias("copies"), taken.cast("bigint").alias("taken"))
    size, times, inside = F.col("size"), F.col("whole"), F.col("in_all")
    parts = F.array(
        of(inside, times + 1, (times + 1) * size),
        of(F.least(F.col("rows") - inside, F.lit(1)), times + ((F.col("p") == 1) | (F.col("p") > 0) & (size > 0) & (F.col("extra") == size)).cast("int"), times * size + F.col("extra")),
        of(F.greatest(F.col("rows") - inside - 1, F.lit(0)), times, times * size),
    )
    dealt = out.select("doc_id", "source", "size", "source_size", "target", F.inline(parts)).filter("times > 0")
    return repeated(dealt, "times", "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source")
