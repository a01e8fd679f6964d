"""Multiple-choice answers: scoring under three-valued logic, summaries, resuming, and the hook for a model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpointed
from spindrift.functions import expr as X
from spindrift.operators.order import running
from spindrift.schema import RESULT


def score(rows: DataFrame) -> DataFrame:
    """``rows`` (raw, gold) with raw stripped, pred and correct; an unlabelled row has neither gold nor correct."""
    gold = F.col("gold")
    if dict(rows.dtypes)["gold"] in ("double", "float"):
        gold = F.when(~F.isnan(gold), gold)
    out = rows.withColumn("gold", gold.cast("int")).withColumn("pred", X.parse_answer(F.col("raw")))
    return out.withColumn("correct", X.correct(F.col("pred"), F.col("gold"))).withColumn("raw", X.strip(F.col("raw")))


def summary(results: DataFrame) -> DataFrame:
    """n over all rows, accuracy over labelled ones (null if none), unparsed count and rate over all."""
    unparsed = F.count(F.when(F.col("pred").isNull(), 1))
    return results.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), unparsed.alias("unparsed"), F.round(unparsed / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("unparsed_rate"))


def accuracy_by(results: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, n, k, accuracy and its Wilson interval over labelled rows, best first."""
    missing = [c for c in by if c not in results.columns]
    if missing:
        raise KeyError(f"no column {missing[0]!r}")
    got = results.filter(F.col("correct").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("k"))
    lo, hi = X.wilson(F.col("k"), F.col("n"))
    return got.select(*by, "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi")).orderBy(F.desc("accuracy"), *by)


def condition_accuracy(results: DataFrame, by: tuple[str, ...] = ("model",), condition: str = "condition", ceiling: str = "oracle", floor: str = "random") -> DataFrame:
    """by, condition, n, k, accuracy, lo, hi, floor, ceiling, place: the accuracy of each condition between its group's
    blind picks and a perfect retriever's.

    ``place`` is 0 at the floor and 1 at the ceiling; it is null where the group lacks either, or they agree. One
    aggregate over the results; what is joined to it has a row a group.
    """
    each = accuracy_by(results, (*by, condition))
    of = lambda name: F.max(F.when(F.col(condition) == name, F.col("k") / F.col("n")))
    ends = each.groupBy(*by).agg(of(floor).alias("__floor"), of(ceiling).alias("__ceiling")).select(*(F.col(b).alias(f"__by_{b}") for b in by), "__floor", "__ceiling")
    match = [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by]
    place = (F.col("k") / F.col("n") - F.col("__floor")) / F.nullif(F.col("__ceiling") - F.col("__floor"), F.lit(0.0))
    met = each.join(ends, match)
    return met.select(*each.columns, F.round("__floor", 6).alias("floor"), F.round("__ceiling", 6).alias("ceiling"), F.round(place, 6).alias("place"))


def unparsed(results: DataFrame, order: str, most: int = 5) -> DataFrame:
    """The first completions, in ``order``, that no answer was read from."""
    return results.filter("pred IS NULL").orderBy(order).limit(most)


def running_accuracy(results: DataFrame, by: str, order: str, block: int = 10_000) -> DataFrame:
    """Accuracy so far, over labelled rows, within each ``by`` in ``order``; null before the first labelled one. Tasks
    have about ``block`` rows, however a group's ``order`` is spread."""
    known = F.col("correct").isNotNull().cast("int")
    rows = running(results, by, [order], {"__k": F.coalesce(F.col("correct").cast("int"), F.lit(0)), "__n": known}, block)
    return rows.withColumn("running", F.round(F.col("__k") / F.nullif(F.col("__n"), F.lit(0)), 6)).select(*results.columns, "running")


def pending(rows: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    """Rows without a result yet; a group with nothing left is gone."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, videos: DataFrame, key: str = "vid") -> DataFrame:
    """The rows about ``videos``: a split's, those that were encoded, or a subset to be scored."""
    return rows.join(videos.select(key).distinct(), key, "left_semi")


def fit_rows(rows: DataFrame, held_out: DataFrame, key: str = "vid") -> DataFrame:
    """The rows to fit on, about no video that is ``held_out``; none left is an error."""
    left = rows.join(held_out.select(key).distinct(), key, "left_anti")
    if left.isEmpty():
        raise ValueError("all rows are held out")
    return left


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each ``key``: the first in ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(key, "__row.*").select(*rows.columns)


def first_n(rows: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first ``n`` rows in ``order``; all of them without ``n``."""
    return rows.orderBy(order).limit(n) if n else rows


def rows_in_query_order(cached: DataFrame, qa: DataFrame, order: str) -> DataFrame:
    """``cached`` (seq, qid) with the question's row, the first in ``order`` where its qid repeats. A cached qid that is in
    no row is an error as soon as it is met."""
    rows = first_rows(qa, "qid", order).drop(order)
    found = rows.withColumn("__found", F.lit(True))
    joined = cached.select("seq", "qid").join(found, "qid", "left")
    known = F.when(F.col("__found"), F.col("qid")).otherwise(F.raise_error(F.concat(F.lit("cached qid without a question: "), F.col("qid").cast("string"))))
    return joined.select("seq", known.alias("qid"), *[c for c in rows.columns if c != "qid"])


def pick_lookup(picks: DataFrame, qa: DataFrame, files: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    """picks (qid, vid, idx) as rows to answer: the question's columns, ``chunk_id``, the video's path, the chunk's text,
    start and end. chunks: vid, idx, text, s, e; files: vid, path_to_video."""
    rows = first_rows(qa, "qid", order).drop(order)
    met = picks.join(chunks.select("vid", "idx", "text", "s", "e"), ["vid", "idx"]).join(files.select("vid", "path_to_video"), "vid")
    asked = met.join(rows.drop("vid"), "qid")
    return asked.withColumn("chunk_id", F.concat_ws("#", "vid", "idx"))


def with_media(qa: DataFrame, media: DataFrame, key: str = "vid") -> tuple[DataFrame, DataFrame]:
    """Questions with their video's files, and the videos that have none, in order."""
    return qa.join(media, key), qa.select(key).distinct().join(media.select(key), key, "left_anti").orderBy(key)


def in_input_order(rows: DataFrame, asked: DataFrame, key: str = "vid") -> DataFrame:
    """``rows`` in the order of ``asked`` (seq, key), however they came back."""
    return asked.select("seq", key).join(rows, key).orderBy("seq")


#: What a Python worker has loaded, by the id of the run that asked for it.
_LOADED: dict[str, Callable] = {}
_SAID = "video string, qid string, gold int, raw string, error string"


def _stretches(rows: DataFrame, stretch: int) -> DataFrame:
    """``rows`` with ``__stretch``: 0, or for a video of more than ``stretch`` questions one of as many as it takes."""
    many = rows.groupBy("vid").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > stretch)
    number = F.pmod(F.xxhash64("qid"), F.ceil(F.col("__n") / stretch))
    return rows.join(many, "vid", "left").withColumn("__stretch", F.coalesce(number, F.lit(0))).drop("__n")


def answered(
    rows: DataFrame, model: Callable[[str, pd.DataFrame], list[str]] | None = None, batch: int = 8, prepare: Callable[[str], object] | None = None,
    load: Callable[[], Callable[[str, pd.DataFrame], list[str]]] | None = None, stretch: int = 1000, done: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results of a model over rows (vid, qid, seq, prompt, gold), and the videos that failed (video, error).

    A video's rows come to one task in seq order, and pass the model in batches; ``prepare`` decodes a video once before
    them. One that it raises an error for has no results and is among the failed. Only a video of more than ``stretch``
    questions is cut, by the hashes of its qids, into stretches of their own, each of which decodes it once, so a video
    that holds a third of all rows is spread over tasks. ``load`` makes the model, once in a Python worker, in place of
    ``model``. Rows whose qid is in ``done`` are passed over. The run is written to the checkpoint folder, so that both
    tables come from one pass of the model. Nothing to answer gives no results; that every video failed is an error.
    """
    if (model is None) == (load is None):
        raise ValueError("a model is given, or how to load it")
    asked = pending(rows, done) if done is not None else rows
    kept = ["vid", "__stretch", *dict.fromkeys(["seq", *rows.columns])]
    kept = list(dict.fromkeys(kept))
    run = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if load and run not in _LOADED:
            _LOADED[run] = load()
        call = _LOADED[run] if load else model
        each = (row for b in batches for row in b.to_pylist())
        for (vid, _), own in groupby(each, key=lambda r: (r["vid"], r["__stretch"])):
            try:
                if prepare:
                    prepare(str(vid))
            except Exception as reason:  # a video that can't be read costs its own questions only
                yield _said([str(vid)], [None], [None], [None], [f"{type(reason).__name__}: {reason}"])
                continue
            while part := list(islice(own, batch)):
                raw = call(str(vid), pd.DataFrame(part).drop(columns="__stretch"))
                if len(raw) != len(part):
                    raise ValueError("one answer per row is needed")
                yield _said([str(vid)] * len(part), [r["qid"] for r in part], [r["gold"] for r in part], raw, [None] * len(part))

    dealt = _stretches(asked, stretch).select(*kept).repartition("vid", "__stretch").sortWithinPartitions("vid", "__stretch", "seq")
    said = checkpointed(dealt.mapInArrow(work, _SAID))
    if said.filter("error IS NULL").isEmpty() and not said.isEmpty():
        raise RuntimeError(f"nothing was answered: {said.first().error}")
    failed = said.filter("error IS NOT NULL").groupBy("video").agg(F.min("error").alias("error"))
    return score(said.filter("error IS NULL").drop("error")).select(*RESULT.names), failed


def _said(video: list, qid: list, gold: list, raw: list, error: list) -> pa.RecordBatch:
    text = lambda x: pa.array([None if v is None else str(v) for v in x], pa.string())
    return pa.RecordBatch.from_arrays([text(video), text(qid), pa.array(gold, pa.int32()), text(raw), text(error)], names=["video", "qid", "gold", "raw", "error"])


def answer(rows: DataFrame, model: Callable[[str, pd.DataFrame], list[str]], batch: int = 8, prepare: Callable[[str], object] | None = None) -> DataFrame:
    """The results of ``answered`` alone."""
    return answered(rows, model, batch, prepare)[0]


def in_order(rows: DataFrame, by: str, order: str, what: str) -> DataFrame:
    """by, n, joined: the ``what`` of each group in order."""
    held = F.array_sort(F.collect_list(F.struct(order, what)))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(held, lambda x: x[what].cast("string")), ",").alias("joined"))


def coverage(items: DataFrame, have: DataFrame, by: str, key: str) -> DataFrame:
    """by, total, covered, percent, groups covered."""
    flag = have.select(key).distinct().withColumn("__have", F.lit(1))
    hit = F.count("__have")
    return items.join(flag, key, "left").groupBy(by).agg(F.count(F.lit(1)).alias("total"), hit.alias("covered"), F.round(100 * hit / F.count(F.lit(1)), 4).alias("percent"), F.count_distinct(F.when(F.col("__have").isNotNull(), F.col(key))).alias("n_distinct"))


def owners(members: DataFrame, priority: tuple[str, ...] = ("test", "val", "train")) -> DataFrame:
    """id, split, subset, n: the place that keeps an id: the most eval-ward split, ties by subset, then position."""
    prio = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("split"))
    kept = F.min_by(F.struct("split", "subset"), F.struct(prio, "subset", "pos"))
    return members.groupBy("id").agg(kept.alias("k"), F.count(F.lit(1)).alias("n")).select("id", "k.split", "k.subset", "n")


def dropped_members(members: DataFrame, priority: tuple[str, ...] = ("test", "val", "train")) -> DataFrame:
    """id, split, subset, pos, kept_split, kept_subset of the places that lose an id to ``owners``, or repeat it there."""
    kept = owners(members, priority).select("id", F.col("split").alias("kept_split"), F.col("subset").alias("kept_subset"))
    first = members.groupBy("id", "split", "subset").agg(F.min("pos").alias("__first"))
    rows = members.join(kept, "id").join(first, ["id", "split", "subset"])
    return rows.filter("split <> kept_split OR subset <> kept_subset OR pos <> __first").drop("__first")


def histogram(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    return rows.groupBy(value).agg(F.min(order).alias("first")).orderBy("first")
