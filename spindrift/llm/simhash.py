"""SimHash near-duplicates by deletion variants.

Fingerprints of 64 bits that differ in at most three are cut into two segments of 32 bits; of these one differs by at
most one bit. So each segment is indexed once for each of its bits with that bit taken out: fingerprints that link
agree in a segment and one wildcard. An equality join on those variants gives all candidates, which are verified.
Candidates of a variant are never listed as pairs: a task walks each group breadth-first and hands on a spanning
forest of its links, which connects the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.base import checkpointed, looked_up, parted, read, scan_texts, text_key, without
from spindrift.llm.xxh64_sql import text_hashes

SHINGLE, BITS, SEED = 3, 3, 42
#: Groups of a variant larger than this are cut once more, by variants of their other segment.
HOT_GROUP = 100_000


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> tuple[int]:
    """The 64-bit SimHash, as a signed number, over word shingles of the A-Z-lower-cased text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return (0,)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[: len(words) - shingle] + 1))
        grams = [line[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8).reshape(-1, 8)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(raw), 1 << 16):
        set_bits += np.unpackbits(raw[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * set_bits > len(raw)).tobytes()
    return (int.from_bytes(value, "big", signed=True),)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, fp (bigint) for each row of ``docs``; a null text has fingerprint 0, like one without words."""
    return scan_texts(docs, lambda text: fingerprint(text, shingle, seed), {"fp": "bigint"}, keep=keep)


def _forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each found is compared with those not found yet, so
    a dense group costs little more than one comparison each."""
    left, out = values, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.bitwise_count(left ^ one) <= bits
            if near.any():
                new = left[near]
                out += [(int(one), int(x)) for x in new]
                todo += list(new)
                left = left[~near]
    return out


def _edges(bits: int):
    """Batches sorted by (key, fp) in, edges out; a group may span batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def flush() -> list[tuple[int, int]]:
            values = np.concatenate(held)
            return _forest(values, bits) if len(values) > 1 else []

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(key)]))
            out = []
            if held_key == key[0]:
                held.append(fp[: ends[0]])
            else:
                if held:
                    out += flush()
                held = [fp[: ends[0]]]
            if len(starts) > 1:
                out += flush()
                inner = ends[1:-1] - starts[1:-1]
                two = starts[1:-1][inner == 2]
                close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits
                out += list(zip(fp[two[close]].tolist(), fp[two[close] + 1].tolist()))
                for a, b in zip(starts[1:-1][inner > 2].tolist(), ends[1:-1][inner > 2].tolist()):
                    out += _forest(fp[a:b], bits)
                held = [fp[starts[-1] :]]
            held_key = key[-1]
            yield _pairs(out)
        if held:
            yield _pairs(flush())

    return work


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])


def _variant(segment: str, bit: str, tag: int) -> str:
    """A key of a 32-bit segment with one bit taken out, and which bit and segment that was."""
    return f"shiftleft({segment} & ~shiftleft(1L, {bit}), 7) | shiftleft(cast({tag} AS bigint), 5) | cast({bit} AS bigint)"


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """u < v: a forest, over ``distinct`` fingerprints ``fp``, that connects all that differ in at most ``bits`` bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    segments = distinct.select("fp", F.expr("shiftrightunsigned(fp, 32)").alias("s0"), F.expr("fp & 4294967295L").alias("s1"))
    each = segments.select("fp", "s0", "s1", F.explode(F.expr("sequence(0, 31)")).alias("bit"))
    keyed = each.select("fp", F.inline(F.expr(f"array(struct({_variant('s0', 'bit', 0)} AS key, s1 AS other), struct({_variant('s1', 'bit', 1)} AS key, s0 AS other))")))
    # a group joins at most two values of a segment, so where no value is frequent no group is large
    values = segments.select(F.inline(F.expr("array(struct(0 AS tag, s0 AS value), struct(1 AS tag, s1 AS value))")))
    hot = values.groupBy("tag", "value").count().filter(F.col("count") > HOT_GROUP // 2)
    hot = checkpointed(hot)
    if not hot.isEmpty():
        # within such a group the other segment differs by 3 bits at most: of its halves one differs by at most one
        hot_keys = hot.select(F.explode(F.expr(f"transform(sequence(0, 31), bit -> {_variant('value', 'bit', 'tag')})")).alias("key")).distinct()
        large = keyed.join(hot_keys, "key", "left_semi").select("fp", "key", "other", F.explode(F.expr("sequence(0, 31)")).alias("b"))
        half = "if(b < 16, (shiftright(other, 16) & 65535L) & ~shiftleft(1L, b), (other & 65535L) & ~shiftleft(1L, b - 16))"
        finer = large.select(F.expr(f"xxhash64(key, b, {half})").alias("key"), "fp")
        keyed = keyed.join(hot_keys, "key", "left_anti").select("key", "fp").unionByName(finer)
    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = dealt.mapInArrow(_edges(bits), "u bigint, v bigint")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: of each node of ``edges`` (u, v) the smallest node that it is connected to.

    Alternates large-star and small-star steps until nothing moves. Minima come from partial aggregates and reach a
    hub's neighbours where those are; each round is checkpointed.
    """
    now = checkpointed(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count(F.lit(1)).alias("n"))
        star = looked_up(both.filter("v > u"), least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # now a < b; each b hands its smaller neighbours to the smallest of them
        star = checkpointed(star.filter("a <> b").distinct())
        first = star.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        small = looked_up(star, first, "b").select(F.col("m").alias("u"), F.col("a").alias("v")).filter("u <> v")
        after = checkpointed(small.unionByName(first.select(F.col("m").alias("u"), F.col("b").alias("v"))).distinct())
        again = _mark(after)
        now = after
        if again == mark:
            break
        mark = again
    out = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    roots = out.select(F.col("root").alias("node"), "root").distinct()
    return out.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def groups(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id: a row for each row of ``docs``; component_id is the smallest doc_id reachable.

    Copies share a fingerprint and only distinct fingerprints are indexed, so thousands of copies cost no more than
    one. Rows of a hot fingerprint stay where they are: fewer than HOT_SHARE of those exist, and they are broadcast. A
    null doc_id never names a group. Empty input gives no rows.
    """
    return _grouped(fingerprints(docs, shingle, seed), bits).select("doc_id", "fp", "component_id")


def _grouped(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with root, the group's smallest linked fingerprint, and component_id.

    Two groups may share a component_id where one doc_id stands for different texts; root tells them apart.
    """
    rows = checkpointed(rows)
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = checkpointed(components(links(distinct.select("fp"), bits)))
    members = linked.join(distinct.select(F.col("fp").alias("node"), "least"), "node")
    named = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_linked = looked_up(linked, named, "root").select(F.col("node").alias("fp"), "root", "component_id")
    of_all = distinct.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return looked_up(rows, of_all, "fp")


def deduplicated(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; all columns stay.

    A document is a doc_id with a text: rows that repeat both are one, of which the first by a hash of its columns
    stays; different texts under one doc_id each fare by their own group, and of those in one group the first by a
    hash of the text stays. Rows without a doc_id can't be told apart by it and stay. No documents give none.

    Only ids and hashes are shuffled, and of the documents those rows alone that repeat both.
    """
    keyed = docs.withColumn("__row_key", text_key())
    found = checkpointed(_grouped(fingerprints(keyed, shingle, seed, ("doc_id", "__row_key")), bits))
    least = found.filter("doc_id = component_id")
    many = checkpointed(least.groupBy("root").agg(F.min("__row_key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    gone = found.filter("doc_id <> component_id").select("doc_id", "__row_key")
    if many.isEmpty():
        return without(keyed, gone, ["doc_id", "__row_key"]).drop("__row_key")
    of_many = checkpointed(looked_up(least, many, "root").groupBy("doc_id", "__row_key", "first").agg(F.count(F.lit(1)).alias("n")))
    gone = gone.unionByName(of_many.filter("__row_key <> first").select("doc_id", "__row_key"))
    kept = without(keyed, gone, ["doc_id", "__row_key"])
    repeats, single = parted(kept, of_many.filter("__row_key = first AND n > 1"), ["doc_id", "__row_key"])
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    one = repeats.groupBy("doc_id", "__row_key").agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
    return single.drop("__row_key").unionByName(one.select("__row.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), grams AS (
  SELECT r, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)
), texts AS (
  SELECT DISTINCT g FROM grams
), {text_hashes("texts", SEED)}, counts AS (
  SELECT r, count(*) AS n, {", ".join(f"sum((h::UBIGINT >> {b}) & 1) AS b{b}" for b in range(64))} FROM grams JOIN hashed USING (g) GROUP BY r
), fingerprints AS (
  SELECT r, doc_id, coalesce({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))}, 0)::UBIGINT AS fp FROM docs LEFT JOIN counts USING (r)
), nodes AS (
  SELECT fp, min(doc_id) AS least FROM fingerprints GROUP BY fp
), links AS (
  SELECT a.fp AS u, b.fp AS v FROM nodes AS a JOIN nodes AS b ON bit_count(xor(a.fp, b.fp)) <= {BITS}
), reached AS (
  SELECT fp AS u, fp AS v FROM nodes
  UNION SELECT reached.u, links.v FROM reached JOIN links ON reached.v = links.u
), components AS (
  SELECT u AS fp, min(least) AS component_id FROM reached JOIN nodes ON nodes.fp = reached.v GROUP BY u
)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM fingerprints JOIN components USING (fp)
"""
