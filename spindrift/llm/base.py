"""What the operators of this subpackage share: Arrow scans, lineage cuts, digests and row keys."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.checkpoints import checkpoint_folder, checkpointed  # noqa: F401  the operators take them from here

_ARROW = {
    "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(),
    "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}

#: Rows of ids and hashes that are broadcast at most: some 100 MB in an executor.
BROADCAST_ROWS = 1 << 20
#: A key of more than one in so many rows is hot; there are fewer such keys than this.
HOT_SHARE = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts whose ``text`` column has about ``size`` bytes (one row at least), which bounds what a
    Python worker holds."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(1, batch.column(text).nbytes)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def scan_texts(docs: DataFrame, fn: Callable[[str], tuple], names: dict[str, str], null: str | None = "", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, then what ``fn(text)`` returns under ``names`` (name: type).

    Arrow batches go through Python once; a null text is read as ``null``. Only ``keep`` and ``text`` are read, so other
    columns of ``docs``, whatever their names, do no harm.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [f for f in T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in names.items())).fields])
    kinds = [_ARROW[t] for t in names.values()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            rows = [fn(null if x is None else x) for x in batch.column(len(keep)).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            made = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=[*keep, *names])

    return docs.select(*keep, "text").mapInArrow(work, schema)


def keep_rows(docs: DataFrame, verdicts: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text passes; every column passes through untouched."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(verdicts(batch.column(at).to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def repeated(rows: DataFrame, n: str, key: str, block: int = 10_000) -> DataFrame:
    """Each row ``n`` times (at least once), without ``n``. Rows that come more than ``block`` times are dealt out in
    blocks of so many, so that no task writes all copies of one."""
    few = rows.filter(F.col(n) <= block).withColumn("__copy", F.explode(F.expr(f"sequence(1L, {n})")))
    many = rows.filter(F.col(n) > block).withColumn("__block", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {block})"))).repartition(key, "__block")
    many = many.withColumn("__copy", F.explode(F.expr(f"sequence(1L, least({block}L, {n} - __block * {block}))"))).drop("__block")
    return few.unionByName(many).drop("__copy", n)


def text_key() -> F.Column:
    """A text's part in a row key: rows that agree in doc_id and this one are copies of one row, and fare alike."""
    return F.xxhash64("text")


def looked_up(rows: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per ``key`` and in ``n`` at least the number of its rows.

    Hot keys, fewer than HOT_SHARE, are broadcast, so their rows stay in the tasks that hold them; the others are dealt
    by the key.
    """
    table = checkpointed(table)
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(table.filter(F.col("n") * HOT_SHARE > total).drop("n"))
    others = rows.join(hot, list(key), "left_anti").join(table.drop("n"), list(key))
    return rows.join(hot, list(key)).unionByName(others)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parted(docs: DataFrame, rows: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``docs`` that agree with one of ``rows`` in all of ``on`` (nulls are equal), and those that don't.

    ``rows`` is written and counted; up to BROADCAST_ROWS rows, which are ids and hashes only, are broadcast, so no text
    is shuffled. Beyond that both sides are dealt out by ``on``.
    """
    rows = checkpointed(rows.select(*[F.col(c).alias(f"__met_{i}") for i, c in enumerate(on)]).distinct())
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    match = None
    for i, c in enumerate(on):
        one = docs[c].eqNullSafe(rows[f"__met_{i}"])
        match = one if match is None else match & one
    return docs.join(rows, match, "left_semi"), docs.join(rows, match, "left_anti")


def without(docs: DataFrame, removed: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` but for rows that agree with one of ``removed`` in all of ``on`` (nulls are equal)."""
    return parted(docs, removed, on)[1]
