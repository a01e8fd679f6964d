"""Centroid clustering of integer vectors by ball-tree filtering.

Vectors are planted once into metric trees, a few thousand of a partition each. A node is a ball: it stores the radius,
the count and the integer sum of its vectors. In each round the centroids meet the trees from the roots down. Where the
triangle inequality leaves but one centroid for a ball, its count and sum go to that one as they are; other balls are
opened, down to leaves, whose distances are exact whole numbers. A task hands on a count and a sum for each centroid, so
shuffles and the driver see centroids and never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.base import checkpointed, read

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SALT = 40, 5, 64, 256, 2
#: Vectors of a tree, and of a leaf, at most.
TREE, LEAF = 4096, 32
#: Components are held within these bounds, so that a distance fits a long whatever the input.
BOUND = 1 << 27
#: Products of smaller components sum up exactly in doubles.
_EXACT = 1 << 22


class Balls:
    """A tree over rows ``x``, which it reorders: node i holds x[start[i]:end[i]], has its halves at child[i] and
    child[i] + 1 (child -1: a leaf), a radius around the mean of its rows, and their sum."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        spans, child, radius, sums = [(0, len(x))], [], [], []
        for a, b in spans:  # grows as balls are halved
            own = x[order[a:b]]
            total = own.sum(axis=0)
            off = own - total / (b - a)
            square = np.einsum("ij,ij->i", off, off)
            far = int(square.argmax())
            halved = b - a > leaf and (own != own[0]).any()
            sums.append(total)
            radius.append(float(np.sqrt(square[far])) if halved or (own != own[0]).any() else 0.0)
            child.append(len(spans) if halved else -1)
            if halved:
                # the halves lie along the line from the farthest vector to the one farthest from it
                other = off - off[far]
                line = other[int(np.einsum("ij,ij->i", other, other).argmax())]
                order[a:b] = order[a:b][np.argsort(off @ line, kind="stable")]
                half = (a + b) // 2
                spans += [(a, half), (half, b)]
        self.order, self.x = order, x[order]
        self.start, self.end = np.array(spans, np.int64).reshape(-1, 2).T
        self.child, self.radius, self.sums = np.array(child), np.array(radius), np.array(sums, np.int64)

    def sorted_out(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Balls that lie nearest to one centroid as wholes, their centroids, and the leaves that must be looked into.

        A vector in the ball (m, r) is at most d(m, c) + r from c and at least d(m, c') - r from c'. The slack is far
        above the rounding of doubles, so a ball is given away only where no tie is possible.
        """
        at = centroids.astype(np.float64)
        balls, nearest, leaves, frontier = [], [], [], np.zeros(1, np.int64)
        while len(frontier):
            middle = self.sums[frontier] / (self.end - self.start)[frontier, None]
            d = np.sqrt(np.maximum((middle[:, None] - at) ** 2, 0).sum(axis=2))
            r = self.radius[frontier, None]
            able = d - r <= (d + r).min(axis=1, keepdims=True) + 1e-9 * (d + r + 1)
            alone = able.sum(axis=1) == 1
            balls.append(frontier[alone])
            nearest.append(able[alone].argmax(axis=1))
            down = self.child[frontier[~alone]]
            leaves.append(frontier[~alone][down < 0])
            down = down[down >= 0]
            frontier = np.concatenate((down, down + 1))
        return np.concatenate(balls), np.concatenate(nearest), np.concatenate(leaves)

    def rows_of(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.start[n], self.end[n]) for n in nodes]) if len(nodes) else np.zeros(0, np.int64)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the vectors nearest to each centroid."""
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        balls, nearest, leaves = self.sorted_out(centroids)
        np.add.at(n, nearest, (self.end - self.start)[balls])
        np.add.at(sums, nearest, self.sums[balls])
        own = self.x[self.rows_of(leaves)]
        one = nearest_rows(own, centroids)
        np.add.at(n, one, 1)
        np.add.at(sums, one, own)
        return n, sums

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest centroid and its squared distance."""
        balls, nearest, leaves = self.sorted_out(centroids)
        out = np.zeros(len(self.x), np.int64)
        for ball, c in zip(balls, nearest):
            out[self.start[ball] : self.end[ball]] = c
        opened = self.rows_of(leaves)
        out[opened] = nearest_rows(self.x[opened], centroids)
        off = self.x - centroids[out]
        return out, (off * off).sum(axis=1)

    def packed(self) -> list[bytes]:
        return [a.astype(kind).tobytes() for a, kind in zip((self.x, self.start, self.end, self.child, self.radius, self.sums), _KINDS)]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Balls:
        out = cls.__new__(cls)
        x, out.start, out.end, out.child, out.radius, sums = (np.frombuffer(p, kind) for p, kind in zip(parts, _KINDS))
        out.sums = sums.reshape(len(out.start), -1)
        out.x = x.reshape(-1, out.sums.shape[1]).astype(np.int64)
        return out


_KINDS = (np.int32, np.int32, np.int32, np.int32, np.float64, np.int64)
_TREE = ("x", "start", "end", "child", "radius", "sums")


def nearest_rows(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row by exact squared distances; of equally near ones the first."""
    if not len(x):
        return np.zeros(0, np.int64)
    if max(np.abs(x).max(), np.abs(centroids).max()) < _EXACT:  # whole numbers below 2**53 throughout
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((b * b).sum(axis=1) - 2 * (a @ b.T)).argmin(axis=1)
    parts = [((x[i : i + 256, None] - centroids) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), 256)]
    return np.concatenate(parts)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite components, held within BOUND."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values.astype(np.float64)), -BOUND, BOUND).astype(np.int64)


def usable(vector: str, dimensions: int = DIMENSIONS) -> F.Column:
    """Exactly so many components, none null, NaN or infinite; a null vector is none."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~odd, F.lit(False))


def planted(vectors: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """A row a tree: ids, in the order of its vectors, and the tree's arrays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            for i in range(0, len(values), TREE):
                balls = Balls(integers(values[i : i + TREE]))
                ids = batch.column(0).slice(i, TREE).take(pa.array(balls.order))
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), *(pa.array([p], pa.binary()) for p in balls.packed())], names=["ids", *_TREE])

    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema[key].dataType)), *(T.StructField(n, T.BinaryType()) for n in _TREE)])
    return vectors.select(key, vector).mapInArrow(work, schema)


def _trees(batch: pa.RecordBatch) -> Iterator[Balls]:
    for i in range(batch.num_rows):
        yield Balls.unpacked([batch.column(n)[i].as_py() for n in _TREE])


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors; those without vectors stay."""
    size = centroids.shape[1]
    names = [f"s{i}" for i in range(size)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for balls in _trees(batch):
                own, total = balls.totals(centroids)
                n, sums = n + own, sums + total
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), *(pa.array(sums[met, i]) for i in range(size))], names=["c", "n", *names])

    parts = trees.select(*_TREE).mapInArrow(work, ", ".join(f"{x} bigint" for x in ("c", "n", *names)))
    out = centroids.copy()
    for r in parts.groupBy("c").agg(*(F.sum(x).alias(x) for x in ("n", *names))).collect():  # a row a centroid; longs do for 2**36 vectors
        out[r.c] = [r[x] // r.n for x in names]
    return out


def inertias(trees: DataFrame, centroids: np.ndarray) -> dict[int, int]:
    """The sum of squared distances of each centroid that has vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = (np.zeros(len(centroids), np.int64) for _ in range(3))
        for batch in batches:
            for balls in _trees(batch):
                one, d = balls.labels(centroids)
                np.add.at(n, one, 1)
                np.add.at(high, one, d >> 32)
                np.add.at(low, one, d & 0xFFFFFFFF)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(high[met]), pa.array(low[met])], names=["c", "high", "low"])

    parts = trees.select(*_TREE).mapInArrow(work, "c bigint, high bigint, low bigint")
    sums = parts.groupBy("c").agg(*(F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("high", "low"))).collect()
    return {r.c: (int(r.high) << 32) + int(r.low) for r in sums}


def first_centroids(vectors: DataFrame, key: str, vector: str, clusters: int, salt: int = SALT) -> np.ndarray:
    """The vectors whose keys have the smallest hashes. A null key comes last; equal keys go by their vectors."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256).alias("h"), F.col(vector).alias("v"))
    rows = hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([integers(np.array(r.v)) for r in rows], np.int64)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, salt: int = SALT) -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector.

    Vectors of another length, null, or with null or non-finite components have no row; components beyond 2**27 after
    scaling are held at that bound. Repeated rows count, and are returned, each; a null key stays null. Fewer vectors
    than centroids make fewer centroids; none, and an empty table, give no rows. Ties go to the smaller centroid number.
    An inertia beyond a long is null. Only ``key`` and ``vector`` are read, so other columns' names do no harm.

    The trees are written to the checkpoint folder once, in place of the vectors; a round reads them there, so a lost
    executor costs its trees' share of a round.
    """
    kind = vectors.schema[key].dataType
    kept = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(usable("v", dimensions))
    schema = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    centroids = first_centroids(kept, "key", "v", clusters, salt)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    trees = checkpointed(planted(kept, "key", "v", dimensions))
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    sums = inertias(trees, centroids)
    fits = lambda n: n if n < 1 << 63 else None
    by_cluster = pa.array([fits(sums.get(c, 0)) for c in range(len(centroids))], pa.int64())
    digests = pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])
    total = fits(sum(sums.values()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, balls in enumerate(_trees(batch)):
                one, d = balls.labels(centroids)
                at = pa.array(one)
                columns = [batch.column("ids")[i].values, pa.array(one.astype(np.int32)), pa.array(d), by_cluster.take(at), pa.array([total] * len(d), pa.int64()), digests.take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return trees.mapInArrow(work, schema)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def _assigned(n: int) -> str:
    """Of each vector the nearest of centroids c{n}."""
    return f"""a{n} AS MATERIALIZED (
  SELECT r, arg_min(c, d::HUGEINT * {CLUSTERS} + c) AS c, min(d) AS d FROM (
    SELECT r, c, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i])))::BIGINT AS d FROM kept k, c{n} m
  ) GROUP BY r
)"""


def _moved(n: int) -> str:
    """The centroids after a round."""
    return f"""c{n + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(new.v, m.v) AS v FROM c{n} m LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT a.c, i, sum(k.v[i])::BIGINT AS s, count(*) AS n FROM a{n} a JOIN kept k USING (r), range(1, {DIMENSIONS + 1}) AS places(i) GROUP BY a.c, i
    ) GROUP BY c
  ) new ON new.c = m.c
)"""


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: least(greatest(floor({SCALE} * x::DOUBLE), -{BOUND}), {BOUND})::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id) NULLS LAST, embedding) - 1 AS c, v
  FROM kept QUALIFY c < {CLUSTERS}
), {", ".join(f"{_assigned(n)}, {_moved(n)}" for n in range(ROUNDS))}, {_assigned(ROUNDS)}, inertias AS (
  SELECT c, TRY_CAST(sum(d) AS BIGINT) AS cluster_inertia, TRY_CAST(sum(sum(d)) OVER () AS BIGINT) AS inertia FROM a{ROUNDS} GROUP BY c
)
SELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, cluster_inertia, inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (r) JOIN inertias USING (c) JOIN c{ROUNDS} m ON m.c = a.c
"""
