"""Sharding by rendezvous (highest random weight) hashing of stable record keys over weighted shards. Native.

The shard of a key is the one with the largest score; scores of different shards are independent, so a shard more
takes rows only into itself, and a shard gone gives its rows to the others in proportion to their weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.base import read
from spindrift.llm.xxh64_sql import FINISH, P1, P2, P4, WORD, byte_steps, four_steps, long_hashed, number, start, steps, times, turned

SHARDS = 24
#: Sub-ranges of a shard within which rows are numbered; no task holds more than one of them.
BUCKETS = 1024
#: Equal rows that one task writes out; more are dealt to others in blocks of so many.
BLOCK = 10_000


def score(key: Sequence[Column], shard: int, weight: float | None = None) -> Column:
    """A larger score wins. With u uniform in (0, 1), ``-weight / ln(u)`` wins in proportion to the weight; where all
    weights are equal (None) it orders as u itself does, so the plain hash serves."""
    h = F.xxhash64(*key, F.lit(f"shard-{shard}"))
    if weight is None:
        return h
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.lit(float(weight)) / F.log(u)


def place(key: Sequence[Column], shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard of a key; equal scores (odds about 2**-64) go to the higher shard. A null key is a key like others."""
    weights = weights or [1.0] * shards
    if len(weights) != shards or any(w <= 0 or not math.isfinite(w) for w in weights):
        raise ValueError("one positive weight per shard is needed")
    even = len(set(weights)) == 1
    scores = [F.struct(score(key, s, None if even else w).alias("h"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return reduce(lambda a, b: F.greatest(a, b), scores)["s"] if shards > 1 else F.lit(0)


def shard_rows(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row for each row of ``docs``.

    The law is ``key``. Slots count from 0 without gaps in each shard, by bucket, doc_id, size and crc. Equal rows are
    counted before they are shuffled and dealt out again after, in blocks, so a key that holds a third of all rows moves
    as one row a task and is written by many. A null text has size 8 and the crc of no bytes; rows with a null doc_id
    share one shard; equal rows take consecutive slots; an empty table gives no rows.
    """
    key = [F.col("doc_id")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    grown = [*weights, grown_weight] if weights else None
    placed = equal.select(
        "*", place(key, shards, weights).alias("shard"), place(key, shards + 1, grown).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", F.lit("bucket")), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = placed.withColumn("first", F.sum("n").over(within) - F.col("n"))
    # shards x BUCKETS rows at most, whatever the input
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).select("shard", "bucket", (F.sum("m").over(before) - F.col("m")).alias("base"))
    joined = numbered.join(F.broadcast(starts), ["shard", "bucket"]).withColumn("first", F.col("base") + F.col("first"))
    few = joined.filter(F.col("n") <= BLOCK)
    blocks = joined.filter(F.col("n") > BLOCK).withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})")))
    blocks = blocks.repartition("doc_id", "block").withColumns({"first": F.expr(f"first + block * {BLOCK}"), "n": F.expr(f"least({BLOCK}, n - block * {BLOCK})")})
    dealt = few.unionByName(blocks.drop("block")).withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"))


#: Names of one digit have seven bytes, those of two have eight, which are hashed as one word.
_SHORT = steps(
    "(SELECT keys.*, s FROM keys, range(0, 10) AS names(s))",
    start(7), *four_steps(f"{number(b'shar')}::UHUGEINT"), *byte_steps(f"{ord('d')}::UHUGEINT"), *byte_steps(f"{ord('-')}::UHUGEINT"), *byte_steps("(48 + s)::UHUGEINT"), *FINISH,
)
_EIGHT = f"({number(b'shard-00')}::UHUGEINT + (s // 10)::UHUGEINT * {1 << 48}::UHUGEINT + (s % 10)::UHUGEINT * {1 << 56}::UHUGEINT)"
_LONG = steps(
    f"(SELECT * EXCLUDE (w), {turned(31, 'w')} AS w FROM (SELECT keys.*, s, {times(_EIGHT, P2)} AS w FROM keys, range(10, {SHARDS + 1}) AS names(s)))",
    f"xor({start(8)}, {times('w', P1)})", turned(27), times("h", P1, P4), *FINISH,
)
_BUCKET = steps(
    long_hashed("(SELECT * RENAME (h AS of_id) FROM keys)", "size", "of_id"),
    start(6), *four_steps(f"{number(b'buck')}::UHUGEINT"), *byte_steps(f"{ord('e')}::UHUGEINT"), *byte_steps(f"{ord('t')}::UHUGEINT"), *FINISH,
)
ORACLE = f"""
WITH polynomial AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda c, i: xor(c // 2, (c % 2) * 3988292384)) AS c FROM range(0, 256) AS bytes(b)
  )
), rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size FROM documents
), sums AS (
  SELECT r, doc_id, size, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(crcs[xor(c % 256, x) + 1], c // 256)
  ))::BIGINT AS text_crc32 FROM rows, polynomial
), keys AS (
  SELECT * FROM {long_hashed("sums", "doc_id", "42")}
), scores AS (
  SELECT r, s, CASE WHEN h >= {WORD // 2}::UHUGEINT THEN h::HUGEINT - {WORD} ELSE h::HUGEINT END AS score
  FROM (SELECT r, s, h FROM {_SHORT} UNION ALL SELECT r, s, h FROM {_LONG})
), places AS (
  SELECT r, arg_max(s, score) FILTER (s < {SHARDS})::INTEGER AS shard, arg_max(s, score)::INTEGER AS grown_shard FROM scores GROUP BY r
), buckets AS (
  SELECT r, doc_id, size, text_crc32, (h % {BUCKETS}::UHUGEINT)::INTEGER AS bucket FROM {_BUCKET}
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM buckets JOIN places USING (r)
"""
