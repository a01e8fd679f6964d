"""Residual adapters over frozen vectors: query and chunk side, construction, whole caches; the replay of a history."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import expr as X
from spindrift.sources.publish import current, publish

erf = np.frompyfunc(math.erf, 1, 1)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)).astype(float))


@dataclass(frozen=True)
class Residual:
    """x -> up(gelu(down(x))); rank 0 adds nothing. The up-projection starts at zero, so a new adapter is the identity."""

    down: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    up: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def fresh(cls, fan_in: int, fan_out: int, rank: int = 8, seed: int = 0) -> "Residual":
        if rank < 0:
            raise ValueError("a rank isn't negative")
        return cls(np.random.default_rng(seed).normal(0, fan_in**-0.5, (fan_in, rank)), np.zeros((rank, fan_out)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return gelu(x @ self.down) @ self.up if self.down.size else np.zeros((len(x), 1))


@dataclass(frozen=True)
class Deep:
    """Layer normalisation, two hidden layers, a projection that starts at zero: the wide branch."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    scale: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, fan_in: int, fan_out: int, hidden: int = 2048, seed: int = 0) -> "Deep":
        if hidden < 1:
            raise ValueError("a hidden layer has a width")
        rng = np.random.default_rng(seed)
        widths = ((fan_in, hidden), (hidden, hidden))
        layers = tuple((rng.normal(0, a**-0.5, (a, b)), np.zeros(b)) for a, b in widths)
        return cls((*layers, (np.zeros((hidden, fan_out)), np.zeros(fan_out))), np.ones(fan_in), np.zeros(fan_in))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        centred = x - x.mean(axis=1, keepdims=True)
        x = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5) * self.scale + self.shift
        for w, b in self.layers[:-1]:
            x = gelu(x @ w + b)
        w, b = self.layers[-1]
        return x @ w + b


@dataclass(frozen=True)
class Adapter:
    """Query side q + residual, chunk side alpha v + beta t + residual of both; ``frozen`` names what isn't trained."""

    query: Residual | Deep
    chunk: Residual | Deep
    alpha: float = 1.0
    beta: float = 1.0
    log_temperature: float = math.log(0.07)
    checkpoint: str = ""
    frozen: frozenset[str] = frozenset()

    def numbers(self) -> list[tuple[str, list[int], list[float]]]:
        """name, shape, values of every parameter."""
        out = [(n, [], [getattr(self, n)]) for n in ("alpha", "beta", "log_temperature")]
        for side in ("query", "chunk"):
            branch = getattr(self, side)
            arrays = {"down": branch.down, "up": branch.up} if isinstance(branch, Residual) else {"scale": branch.scale, "shift": branch.shift} | {f"{k}{i}": a for i, pair in enumerate(branch.layers) for k, a in zip("wb", pair)}
            out += [(f"{side}.{n}", list(a.shape), a.ravel().tolist()) for n, a in arrays.items()]
        return out

    def trainable(self) -> int:
        return sum(len(v) for n, _, v in self.numbers() if n.split(".")[0] not in self.frozen)


def small(dim: int, rank: int = 8, seed: int = 0, **rest) -> Adapter:
    return Adapter(Residual.fresh(dim, dim, rank, seed), Residual.fresh(2 * dim, dim, rank, seed + 1), **rest)


def big(dim: int, hidden: int = 2048, seed: int = 0, **rest) -> Adapter:
    return Adapter(Deep.fresh(dim, dim, hidden, seed), Deep.fresh(2 * dim, dim, hidden, seed + 1), **rest)


ADAPTERS = {"small": small, "big": big}


def build(name: str, dim: int, freeze_chunks: bool = False, **rest) -> Adapter:
    """A new adapter, which changes nothing yet; with ``freeze_chunks`` only its query side is to be trained."""
    made = ADAPTERS[name](dim, **rest)
    return replace(made, frozen=frozenset({"alpha", "beta", "chunk"})) if freeze_chunks else made


def adapted(video: Column, text: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """The chunk vector without a residual: the unit vector of alpha v + beta t, in expressions alone."""
    return X.fused(video, text, alpha, beta)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(float)


def adapt_chunks(rows: DataFrame, adapter: Adapter, video: str = "v", text: str = "t", out: str = "adapted") -> DataFrame:
    """``rows`` with the adapted chunk vector; the residual runs over Arrow batches."""
    sent = rows.sparkSession.sparkContext.broadcast(adapter)

    @F.pandas_udf("array<double>")
    def forward(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        a = sent.value
        for v, t in batches:
            v, t = _stacked(v), _stacked(t)
            yield pd.Series(list(_unit(a.alpha * v + a.beta * t + a.chunk(np.hstack([v, t])))))

    return rows.withColumn(out, forward(F.col(video), F.col(text)))


def adapt_queries(rows: DataFrame, adapter: Adapter, query: str = "query") -> DataFrame:
    """``rows`` with the query vector pushed through the query side; null stays null."""
    sent = rows.sparkSession.sparkContext.broadcast(adapter)

    @F.pandas_udf("array<double>")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for q in batches:
            known = q.notna()
            out = pd.Series([None] * len(q), dtype=object)
            if known.any():
                x = _stacked(q[known])
                out[known.to_numpy()] = pd.Series(list(_unit(x + sent.value.query(x))), index=out.index[known.to_numpy()])
            yield out

    return rows.withColumn(query, forward(F.col(query)))


def adapt_cache(chunks: DataFrame, queries: DataFrame, adapter: Adapter) -> tuple[DataFrame, DataFrame]:
    """A cache of the same shape: chunks (v, t, ...) with the adapted vector in both towers, as fusion is then learned, and
    queries (query, ...) of every form adapted. It is scored like any other."""
    done = adapt_chunks(chunks, adapter, out="__adapted")
    return done.withColumns({"v": F.col("__adapted"), "t": F.col("__adapted")}).drop("__adapted"), adapt_queries(queries, adapter)


def write_adapter(spark: SparkSession, adapter: Adapter, history: DataFrame, path: str) -> None:
    """Parameters and the training history, two tables of one version; an existing adapter is an error."""
    kind = "deep" if isinstance(adapter.query, Deep) else "residual"
    rows = [(n, shape, values, kind, adapter.checkpoint, sorted(adapter.frozen)) for n, shape, values in adapter.numbers()]
    parameters = spark.createDataFrame(rows, "name string, shape array<int>, values array<double>, kind string, checkpoint string, frozen array<string>")

    def write(folder: str) -> None:
        parameters.write.parquet(f"{folder}/parameters")
        history.write.parquet(f"{folder}/history")

    publish(spark, path, write, replace=False)


def read_adapter(spark: SparkSession, path: str) -> Adapter:
    rows = {r.name: r for r in spark.read.parquet(f"{current(spark, path)}/parameters").collect()}  # the parameters of one model
    array = lambda n: np.array(rows[n]["values"], float).reshape(rows[n].shape)
    any_row = next(iter(rows.values()))
    if any_row.kind == "deep":
        branch = lambda side: Deep(tuple((array(f"{side}.w{i}"), array(f"{side}.b{i}")) for i in range(3)), array(f"{side}.scale"), array(f"{side}.shift"))
    else:
        branch = lambda side: Residual(array(f"{side}.down"), array(f"{side}.up"))
    return Adapter(branch("query"), branch("chunk"), *(rows[n]["values"][0] for n in ("alpha", "beta", "log_temperature")), any_row.checkpoint, frozenset(any_row.frozen))


def replay(history: DataFrame, patience: int) -> DataFrame:
    """history (run, epoch, top1) with is_best and stopped: an epoch is best if strictly above all before it; a run stops
    after ``patience`` epochs without one."""
    before = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    best = F.coalesce(F.col("top1") > F.max("top1").over(before), F.lit(True))
    out = history.withColumn("is_best", best).withColumn("best_epoch", F.max(F.when(F.col("is_best"), F.col("epoch"))).over(so_far))
    return out.withColumn("stopped", F.col("epoch") - F.col("best_epoch") >= patience)


def best_epoch(history: DataFrame) -> DataFrame:
    """run, epoch, top1 of the best epoch, the first of equals."""
    return history.groupBy("run").agg(F.max_by(F.struct("epoch", "top1"), F.struct(F.col("top1"), -F.col("epoch"))).alias("b")).select("run", "b.epoch", "b.top1")
