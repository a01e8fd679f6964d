"""Order as data: dense numbers without a single-task sort, and tables zipped by them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpointed


def numbered(rows: DataFrame, by: list[Column], name: str = "seq", ties: list[Column] | None = None) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... without gaps in the order of ``by``, then ``ties``.

    Rows are dealt by ranges of the order and sorted within; a row's number is the count of the ranges before its own,
    plus its place there. What reaches the driver is a count for each range. Rows that agree in all of the order are
    numbered among themselves in any way; everything else is the same under any partitioning. No rows give no rows.
    """
    held = checkpointed(rows.orderBy(*by, *(ties or [])).withColumn("__place", F.monotonically_increasing_id()))
    part, place = F.shiftright("__place", 33).cast("int"), F.col("__place").bitwiseAND((1 << 33) - 1)
    placed = held.withColumns({"__part": part, "__place": place})
    counts = sorted((r["__part"], r.n) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = rows.sparkSession.createDataFrame(list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0))), "__part int, __start bigint")
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")


def running(rows: DataFrame, by: str, order: list[str], sums: dict[str, Column], block: int = 10_000) -> DataFrame:
    """``rows`` with running sums (name: what is summed) within each ``by`` in ``order``, the row itself included.

    Rows are dealt by ranges of (by, order), of about ``block`` rows each whatever the values are. A group's sums by
    range come first, then each range's rows are summed by themselves, so no task has more than a range or two, even of
    one group or of numbers spread over 64 bits. A null ``by`` is a group like others; rows that agree in all of
    ``order`` come one after another in any way.
    """
    ranges = max(1, -(-rows.count() // block))
    parted = rows.withColumns({f"__{n}": x.cast("bigint") for n, x in sums.items()}).repartitionByRange(ranges, by, *order)
    held = checkpointed(parted.withColumn("__part", F.spark_partition_id()))
    totals = held.groupBy(by, "__part").agg(*(F.sum(f"__{n}").alias(n) for n in sums))
    before = W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col(by).alias("__by"), F.col("__part").alias("__in"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__from_{n}") for n in sums))
    met = held.join(starts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__in")))
    so_far = W.partitionBy(by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return met.select(*rows.columns, *((F.col(f"__from_{n}") + F.sum(f"__{n}").over(so_far)).alias(n) for n in sums))


def grouped_in_order(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """``rows`` with group_seq, the number of its ``key`` by first appearance, and place, its number within the key.

    A null key is a key like others.
    """
    firsts = numbered(rows.groupBy(key).agg(F.min(seq).alias("__first")), [F.col("__first")], "group_seq").withColumnRenamed(key, "__key").drop("__first")
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(seq)) - 1)
    return placed.join(firsts, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def zipped(left: DataFrame, right: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows of two numbered tables side by side, matched by number; tables of unequal length are an error.

    Columns of ``right`` other than ``seq`` must have names of their own.
    """
    sizes = [t.agg(F.count(F.lit(1)).alias("n"), F.max(seq).alias("last"), F.min(seq).alias("first")).first() for t in (left, right)]
    if sizes[0].n != sizes[1].n:
        raise ValueError(f"{sizes[0].n} rows can't be zipped with {sizes[1].n}")
    if any(s.n and (s.first, s.last) != (0, s.n - 1) for s in sizes):
        raise ValueError(f"{seq} isn't dense")
    return left.join(right, seq)
