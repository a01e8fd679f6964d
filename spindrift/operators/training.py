"""The training loop of adapters: contrastive loss over redrawn pools, AdamW, early stop on held-out videos.

An epoch is one Spark job, a barrier stage: each task reads its part of every batch once, in stretches of a bounded number
of chunks, and holds one at a time, however large a batch is; after each batch the tasks hand one another their summed
slopes and all move the same parameters. A stretch is dictionary-encoded: its distinct chunk vectors once, and each
question's pool as positions into them, so a chunk passes the adapter once a stretch, however many pools it is in. The
state after an epoch, moments included, can be kept and taken up again.
"""

from __future__ import annotations

import base64
import math
import struct
import zlib
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators import retrieval as R
from spindrift.operators.adapter import Adapter, Deep, Residual, adapt_cache, erf, gelu
from spindrift.operators.answers import fit_rows, only
from spindrift.sources.publish import current, publish, published

#: A temperature does not fall below this.
COLDEST = 0.01
#: Tasks that share an epoch.
PARTS = 8
#: Chunks of the pools that a task holds at once, or those of one question if they are more.
HELD_CHUNKS = 2048

Gradient = dict[str, np.ndarray]


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2)).astype(float)) + x * np.exp(-(x**2) / 2) / math.sqrt(2 * math.pi)


def _dropped(h: np.ndarray, share: float, rng: np.random.Generator | None) -> np.ndarray:
    return (rng.random(h.shape) >= share) / (1 - share) if rng is not None and share else np.ones(1)


def _through(branch: Residual | Deep, x: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None):
    """What ``branch`` adds to ``x``, and a function from its gradient to those of the branch's parameters."""
    if isinstance(branch, Residual):
        if not branch.down.size:
            return np.zeros((len(x), 1)), lambda g: {"down": np.zeros_like(branch.down), "up": np.zeros_like(branch.up)}
        z = x @ branch.down
        keep = _dropped(z, dropout, rng)
        h = gelu(z) * keep
        return h @ branch.up, lambda g: {"down": x.T @ ((g @ branch.up.T) * keep * _gelu_slope(z)), "up": h.T @ g}
    centred = x - x.mean(axis=1, keepdims=True)
    normal = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5)
    inputs, slopes = [normal * branch.scale + branch.shift], []
    for w, b in branch.layers[:-1]:
        z = inputs[-1] @ w + b
        keep = _dropped(z, dropout, rng)
        inputs.append(gelu(z) * keep)
        slopes.append(_gelu_slope(z) * keep)

    def back(g: np.ndarray) -> Gradient:
        out: Gradient = {}
        for i in range(len(branch.layers) - 1, -1, -1):
            out[f"w{i}"], out[f"b{i}"] = inputs[i].T @ g, g.sum(axis=0)
            g = g @ branch.layers[i][0].T
            if i:
                g = g * slopes[i - 1]
        return out | {"scale": (g * normal).sum(axis=0), "shift": g.sum(axis=0)}

    w, b = branch.layers[-1]
    return inputs[-1] @ w + b, back


def _normed(x: np.ndarray):
    """Unit rows, and a function from their gradient to that of ``x``."""
    size = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    u = x / size
    return u, lambda g: (g - u * (g * u).sum(axis=1, keepdims=True)) / size


def pooled_gradients(
    adapter: Adapter, queries: np.ndarray, videos: np.ndarray, texts: np.ndarray, pools: list[np.ndarray], weights: np.ndarray | float = 1.0, dropout: float = 0.0,
    rng: np.random.Generator | None = None,
) -> tuple[float, Gradient]:
    """The summed loss of questions and its gradient by parameter name. A question's pool is an array of places in
    ``videos`` and ``texts``, the oracle first. Each vector passes the adapter once; what its pools make of its slope is
    added up by place before it goes back."""
    sizes = np.array([len(p) for p in pools])
    of, first, at = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, np.concatenate(pools)
    weights = np.broadcast_to(np.asarray(weights, float), len(sizes))
    added, back_q = _through(adapter.query, queries, dropout, rng)
    q, into_q = _normed(queries + added)
    added, back_c = _through(adapter.chunk, np.hstack([videos, texts]), dropout, rng)
    c, into_c = _normed(adapter.alpha * videos + adapter.beta * texts + added)
    warm = math.exp(adapter.log_temperature)
    t = max(warm, COLDEST)
    logits = np.einsum("ij,ij->i", c[at], q[of]) / t
    most = np.maximum.reduceat(logits, first)
    e = np.exp(logits - most[of])
    total = np.add.reduceat(e, first)
    loss = float(((np.log(total) + most - logits[first]) * weights).sum())
    slope = e / total[of]
    slope[first] -= 1
    slope *= weights[of]
    to_q = into_q(np.add.reduceat(c[at] * slope[:, None], first, axis=0) / t)
    scattered = np.zeros_like(c)
    np.add.at(scattered, at, q[of] * slope[:, None] / t)
    to_c = into_c(scattered)
    out = {"alpha": (to_c * videos).sum(), "beta": (to_c * texts).sum(), "log_temperature": -(slope * logits).sum() if warm > COLDEST else 0.0}
    out |= {f"query.{n}": g for n, g in back_q(to_q).items()} | {f"chunk.{n}": g for n, g in back_c(to_c).items()}
    return loss, {n: np.asarray(g, float) for n, g in out.items() if n.split(".")[0] not in adapter.frozen}


def gradients(
    adapter: Adapter, queries: np.ndarray, videos: np.ndarray, texts: np.ndarray, sizes: np.ndarray, weight: float = 1.0, dropout: float = 0.0,
    rng: np.random.Generator | None = None,
) -> tuple[float, Gradient]:
    """The same where no pools share vectors: a question's pool is ``sizes`` rows, one pool after another."""
    return pooled_gradients(adapter, queries, videos, texts, np.split(np.arange(len(videos)), np.cumsum(sizes)[:-1]), weight, dropout, rng)


def _values(adapter: Adapter) -> Gradient:
    return {n: np.array(v, float).reshape(shape) for n, shape, v in adapter.numbers() if n.split(".")[0] not in adapter.frozen}


def _moved(adapter: Adapter, values: Gradient) -> Adapter:
    """``adapter`` with ``values`` for the parameters that they name."""
    new = {n: float(values[n]) for n in ("alpha", "beta", "log_temperature") if n in values}
    for side in ("query", "chunk"):
        own = {n.split(".")[1]: v for n, v in values.items() if n.startswith(f"{side}.")}
        if own and "up" in own:
            new[side] = Residual(own["down"], own["up"])
        elif own:
            new[side] = Deep(tuple((own[f"w{i}"], own[f"b{i}"]) for i in range(3)), own["scale"], own["shift"])
    return replace(adapter, **new)


class AdamW:
    """Moments of each parameter; decay is apart from the gradient."""

    def __init__(self, rate: float, decay: float):
        self.rate, self.decay, self.t = rate, decay, 0
        self.first: Gradient = {}
        self.second: Gradient = {}

    def __call__(self, values: Gradient, gradient: Gradient) -> Gradient:
        self.t += 1
        out = {}
        for n, x in values.items():
            g = gradient[n]
            self.first[n] = 0.9 * self.first.get(n, 0.0) + 0.1 * g
            self.second[n] = 0.999 * self.second.get(n, 0.0) + 0.001 * g * g
            step = (self.first[n] / (1 - 0.9**self.t)) / (np.sqrt(self.second[n] / (1 - 0.999**self.t)) + 1e-8)
            out[n] = x - self.rate * (self.decay * x + step)
        return out


@dataclass
class Progress:
    """A run after some epochs: what is needed to go on as if it had never stopped."""

    adapter: Adapter
    move: AdamW
    epoch: int = 0
    best: Adapter | None = None
    best_top1: float = -1.0
    best_epoch: int = -1
    history: list[tuple] = field(default_factory=list)


def _numbers(**tables: Gradient) -> list[tuple]:
    return [(table, name, list(np.shape(x)), np.ravel(x).tolist()) for table, own in tables.items() for name, x in own.items()]


def _all_values(adapter: Adapter) -> Gradient:
    return {n: np.array(v, float).reshape(shape) for n, shape, v in adapter.numbers()}


def write_progress(spark: SparkSession, progress: Progress, path: str) -> None:
    """Parameters, the best ones, both moments and the history, published as one version."""
    best = progress.best or progress.adapter
    rows = _numbers(parameters=_all_values(progress.adapter), best=_all_values(best), first=progress.move.first, second=progress.move.second)
    rows.append(("run", "state", [5], [float(x) for x in (progress.move.t, progress.epoch, progress.best_top1, progress.best_epoch, progress.best is not None)]))

    def write(folder: str) -> None:
        spark.createDataFrame(rows, "part string, name string, shape array<int>, values array<double>").coalesce(1).write.parquet(f"{folder}/state")
        spark.createDataFrame(progress.history, HISTORY).coalesce(1).write.parquet(f"{folder}/history")

    publish(spark, path, write)


def read_progress(spark: SparkSession, path: str, adapter: Adapter, rate: float, decay: float) -> Progress | None:
    """The run published at ``path``, if any; ``adapter`` gives the shape, which must be the run's own."""
    if not published(spark, path):
        return None
    folder, parts = current(spark, path), {}
    for r in spark.read.parquet(f"{folder}/state").collect():  # the numbers of one model, four times
        parts.setdefault(r.part, {})[r.name] = np.array(r["values"], float).reshape(r.shape)
    shapes = {n: x.shape for n, x in _all_values(adapter).items()}
    if {n: x.shape for n, x in parts["parameters"].items()} != shapes:
        raise ValueError(f"{path} holds a run of another adapter")
    t, epoch, best_top1, best_epoch, any_best = parts["run"]["state"].tolist()
    move = AdamW(rate, decay)
    move.t, move.first, move.second = int(t), parts.get("first", {}), parts.get("second", {})
    history = [tuple(r) for r in spark.read.parquet(f"{folder}/history").orderBy("epoch").collect()]
    best = _moved(adapter, parts["best"]) if any_best else None
    return Progress(_moved(adapter, parts["parameters"]), move, int(epoch), best, best_top1, int(best_epoch), history)


def dictionary(pools: DataFrame, order: DataFrame, keys: tuple[str, ...] = ("batch",)) -> tuple[DataFrame, DataFrame]:
    """A batch's distinct chunks and its pools as places among them.

    ``pools``: qid, vid, idx, kind; ``order``: qid and ``keys``, which tell batches (or their parts) apart. The first
    table (``keys``, place, vid, idx) numbers the distinct chunks of each by (vid, idx) from 0; the second (``keys``,
    qid, positions) has each question's pool, the oracle first, the others by place. A batch holds so many questions,
    and a pool the easy chunks and those of one video, so both are bounded by those sizes.
    """
    members = pools.select("qid", "vid", "idx", (F.col("kind") != "oracle").alias("other")).join(order.select("qid", *keys), "qid")
    placed = members.withColumn("place", F.dense_rank().over(W.partitionBy(*keys).orderBy("vid", "idx")) - 1)  # dealt out once, by keys
    distinct = placed.select(*keys, "vid", "idx", "place").distinct()
    positions = F.transform(F.sort_array(F.collect_list(F.struct("other", "place"))), lambda x: x["place"])
    return distinct, placed.groupBy(*keys, "qid").agg(positions.alias("positions"))


def _placed(pools: DataFrame, order: DataFrame, questions: DataFrame, chunks: DataFrame, extra: tuple[str, ...], keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``keys``, place, v, t of distinct chunks and ``keys``, qid, positions, query, ``extra`` of questions with a query.
    Only distinct chunks meet their vectors."""
    asked = questions.filter("query IS NOT NULL").select("qid", "query", *extra)
    distinct, positions = dictionary(pools.join(asked.select("qid"), "qid", "left_semi"), order, keys)
    vectors = distinct.join(chunks.select("vid", "idx", "v", "t"), ["vid", "idx"]).select(*keys, "place", "v", "t")
    return vectors, positions.join(asked, "qid").select(*keys, "qid", "positions", "query", *extra)


def encoded(pools: DataFrame, order: DataFrame, questions: DataFrame, chunks: DataFrame, extra: tuple[str, ...] = (), keys: tuple[str, ...] = ("batch",)) -> DataFrame:
    """``keys``, vectors (v, t by place), asked (qid, positions, query, ``extra``, by qid): a row for each of ``keys``, which
    must be small. Questions without a query are left out."""
    vectors, rows = _placed(pools, order, questions, chunks, extra, keys)
    vectors = vectors.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "v", "t"))).alias("vectors"))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("qid", "positions", "query", *extra))).alias("asked"))
    return vectors.join(rows, list(keys))


STRETCH = ("part", "batch", "stretch")


def stretched(pools: DataFrame, order: DataFrame, questions: DataFrame, chunks: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The same, not gathered: part, batch, stretch and either place, v, t of a chunk or qid, positions, query, ``extra`` of a
    question. So no row grows with a batch, and vectors are dealt out once."""
    vectors, rows = _placed(pools, order, questions, chunks, extra, STRETCH)
    return vectors.unionByName(rows, allowMissingColumns=True)


def _gradient_of(
    adapter: Adapter, v: np.ndarray, t: np.ndarray, pools: list[np.ndarray], queries: list, answers: list | None, answer_weight: float, dropout: float, seed: str,
) -> tuple[int, float, Gradient]:
    """Of some questions: how many, their loss and its gradient; the answers' search, where it has a weight, is a question
    of its own over the same pool."""
    n, weights, pools, queries = len(queries), [1.0] * len(queries), list(pools), list(queries)
    for answer, pool in zip(answers if answers and answer_weight else (), list(pools)):
        if answer is not None:
            queries.append(answer)
            weights.append(answer_weight)
            pools.append(pool)
    rng = np.random.default_rng(zlib.crc32(seed.encode())) if dropout else None
    loss, g = pooled_gradients(adapter, np.array(queries, float), v, t, pools, np.array(weights), dropout, rng)
    return n, loss, g


def _row_gradient(adapter: Adapter, row: dict, answer_weight: float, dropout: float, seed: str) -> tuple[int, float, Gradient]:
    """Of a row of ``encoded``."""
    at = {x["place"]: i for i, x in enumerate(row["vectors"])}
    v, t = (np.array([x[k] for x in row["vectors"]], float) for k in ("v", "t"))
    pools = [np.array([at[p] for p in a["positions"]]) for a in row["asked"]]
    answers = [a["answer"] for a in row["asked"]] if answer_weight else None
    return _gradient_of(adapter, v, t, pools, [a["query"] for a in row["asked"]], answers, answer_weight, dropout, seed)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of one length; others, or null ones, are an error."""
    if lists.null_count or pc.count_distinct(pc.list_value_length(lists)).as_py() != 1:
        raise ValueError("vectors are null or differ in length")
    return pc.list_flatten(lists).to_numpy().astype(float).reshape(len(lists), -1)


def _stretch_gradient(adapter: Adapter, rows: pa.Table, answer_weight: float, dropout: float, seed: str) -> tuple[int, float, Gradient]:
    """Of a stretch's rows (see ``stretched``), chunks by place and then questions by qid."""
    n = len(rows) - rows["place"].null_count
    chunks, asked = rows.slice(0, n), rows.slice(n)
    place, pools = chunks["place"].to_numpy(), [np.array(p) for p in asked["positions"].to_pylist()]
    if not np.array_equal(place, np.arange(n)):
        raise ValueError("a chunk is there twice or lacks its vectors")
    answers = asked["answer"].to_pylist() if answer_weight else None
    return _gradient_of(adapter, _matrix(chunks["v"]), _matrix(chunks["t"]), pools, asked["query"].to_pylist(), answers, answer_weight, dropout, seed)


def _stretches(arrived: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """batch, stretch and its rows; rows arrive in that order."""
    key, held = None, []
    for rows in arrived:
        batch, stretch = rows.column("batch").to_numpy(), rows.column("stretch").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(batch) != 0) | (np.diff(stretch) != 0)) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and key != (batch[lo], stretch[lo]):
                yield *key, pa.Table.from_batches(held)
                held = []
            key = (batch[lo], stretch[lo])
            held.append(rows.slice(lo, hi - lo))
    if held:
        yield *key, pa.Table.from_batches(held)


def summed(rows: DataFrame, adapter: Adapter, answer_weight: float = 0.0, dropout: float = 0.0, seed: int = 0) -> tuple[int, float, Gradient]:
    """Of ``rows`` (see ``encoded``): how many questions, their loss and its gradient."""
    sent = rows.sparkSession.sparkContext.broadcast(adapter)
    names = list(_values(adapter))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, loss, g = _row_gradient(sent.value, row, answer_weight, dropout, f"{seed}|{row.get('batch')}|{row.get('part')}")
                yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "g": [np.concatenate([np.ravel(g[m]) for m in names]).tobytes()]})

    parts = rows.mapInArrow(work, "n bigint, loss double, g binary").collect()
    shapes = _values(adapter)
    flat = np.sum([np.frombuffer(r.g) for r in parts], axis=0) if parts else np.zeros(sum(x.size for x in shapes.values()))
    return sum(r.n for r in parts), math.fsum(r.loss for r in parts), _unflat(flat, shapes)


def _unflat(flat: np.ndarray, shapes: Gradient) -> Gradient:
    cuts = np.cumsum([x.size for x in shapes.values()])[:-1]
    return {n: part.reshape(x.shape) for (n, x), part in zip(shapes.items(), np.split(flat, cuts))}


def run_epoch(rows: DataFrame, parts: int, batches: int, progress: Progress, answer_weight: float = 0.0, dropout: float = 0.0, seed: int = 0) -> tuple[int, float]:
    """One epoch as one job, which moves ``progress``; how many questions it met, and their loss.

    ``rows``: see ``stretched``. Task p of a barrier stage reads the rows of part p, batch by batch, and holds a stretch, and
    the Arrow batches that it lies in, at a time. After each batch all tasks gather one another's sums and make the same step, so the
    parameters never leave them; the first one returns where they are at the end. A lost task repeats the stage, which
    begins with the epoch's first parameters.
    """
    adapter, move, shapes = progress.adapter, progress.move, _values(progress.adapter)
    sent = rows.sparkSession.sparkContext.broadcast((adapter, move))

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        now, step = sent.value[0], deepcopy(sent.value[1])
        waiting = _stretches(arrived)
        own, n_all, loss_all = next(waiting, None), 0, 0.0
        for k in range(batches):
            n, loss, flat = 0, 0.0, np.zeros(sum(x.size for x in shapes.values()))
            while own is not None and own[0] == k:
                m, lost, g = _stretch_gradient(now, own[2], answer_weight, dropout, f"{seed}|{k}|{own[1]}")
                n, loss, flat = n + m, loss + lost, flat + np.concatenate([np.ravel(g[name]) for name in shapes])
                own = next(waiting, None)
            told = [struct.unpack("<qd", base64.b64decode(x[:24])) + (x[24:],) for x in context.allGather(base64.b64encode(struct.pack("<qd", n, loss)).decode() + (base64.b64encode(flat.tobytes()).decode() if n else ""))]
            met = sum(x[0] for x in told)
            if met:
                total = np.sum([np.frombuffer(base64.b64decode(x[2])) for x in told if x[0]], axis=0)
                now = _moved(now, step(_values(now), {name: g / met for name, g in _unflat(total, shapes).items()}))
            n_all, loss_all = n_all + met, loss_all + math.fsum(x[1] for x in told)
        if context.partitionId() == 0:
            flat = [np.concatenate([np.ravel(table[name]) for name in shapes]).tobytes() if table else b"" for table in (_values(now), step.first, step.second)]
            yield pa.RecordBatch.from_pydict(dict(zip(("n", "loss", "t", "values", "first", "second"), ([x] for x in (n_all, loss_all, step.t, *flat)))))

    dealt = rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("batch", "stretch", F.col("place").asc_nulls_last(), "qid")
    (out,) = dealt.mapInArrow(work, "n bigint, loss double, t bigint, values binary, first binary, second binary", barrier=True).collect()
    read = lambda raw: _unflat(np.frombuffer(raw), shapes) if raw else {}
    progress.adapter = _moved(adapter, read(out["values"]))
    move.t, move.first, move.second = out.t, read(out.first), read(out.second)
    return out.n, out.loss


HISTORY = "run string, epoch int, loss double, top1 double"


def train(
    adapter: Adapter, chunks: DataFrame, questions: DataFrame, dev_videos: DataFrame, epochs: int = 30, batch: int = 64, rate: float = 1e-4, decay: float = 0.01,
    n_easy: int = 256, patience: int = 5, answer_weight: float = 0.0, dropout: float = 0.0, seed: int = 0, run: str = "run", path: str | None = None, parts: int = PARTS,
) -> tuple[Adapter, DataFrame]:
    """The adapter of the best epoch, and its history (run, epoch, loss, top1).

    ``chunks``: vid, idx, v, t; ``questions``: qid, vid, oracle_idx, query (null: left out), and ``answer`` where it has a
    weight. Questions of ``dev_videos`` are held out, and their videos give no easy negatives; an epoch is best if its
    top1 on them is strictly above all before it, and ``patience`` epochs without one end the run. Without questions to
    learn from, or to be held out, it is an error.

    With ``path`` the state is published there after each epoch, and a run that finds one goes on after it, to the same
    numbers. ``parts`` tasks run at once, no more than the cluster has cores; all of a step's sums pass the driver, which
    limits the model to some millions of parameters.
    """
    spark = chunks.sparkSession
    fit, dev = fit_rows(questions, dev_videos), only(questions, dev_videos).filter("query IS NOT NULL")
    if fit.filter("query IS NOT NULL").isEmpty() or dev.isEmpty():
        raise ValueError("questions to learn from and held-out ones are needed")
    parts = min(parts, spark.sparkContext.defaultParallelism)
    longest = chunks.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    within, batches = max(1, min(math.ceil(batch / parts), HELD_CHUNKS // (longest + n_easy))), math.ceil(fit.count() / batch)
    progress = (path and read_progress(spark, path, adapter, rate, decay)) or Progress(adapter, AdamW(rate, decay))
    extra = ("answer",) if answer_weight else ()
    part = F.pmod(F.col("stretch"), F.lit(parts)).alias("part")
    held_out = only(chunks, dev_videos)
    while progress.epoch < epochs and (progress.best_epoch < 0 or progress.epoch - 1 - progress.best_epoch < patience):
        epoch = progress.epoch
        pools = R.training_pools(fit, chunks, n_easy, seed, epoch, dev_videos)
        order = R.batches(fit.select("qid"), "qid", batch, seed, epoch, within).select("qid", "batch", "stretch", part)
        rows = stretched(pools, order, fit, chunks, extra)
        n, loss = run_epoch(rows, parts, batches, progress, answer_weight, dropout, seed * 1_000_003 + epoch)
        done, asked = adapt_cache(held_out, dev, progress.adapter)
        top1 = R.metrics(R.pessimistic_ranks(R.scored_within(asked, done, vector="v"))).first().top1
        progress.history.append((run, epoch, loss / n, top1))
        progress.epoch = epoch + 1
        if top1 > progress.best_top1:
            progress.best_top1, progress.best_epoch, progress.best = top1, epoch, progress.adapter
        if path:
            write_progress(spark, progress, path)
    return progress.best or progress.adapter, spark.createDataFrame(progress.history, HISTORY)
