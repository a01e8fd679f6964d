"""BM25 over a corpus of chunks: statistics over all, scores within pools or over the whole corpus."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spindrift.checkpoints import checkpointed
from spindrift.functions import expr as X

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query words, each query's own counted, that are sent to all tasks at most.
MOST_WEIGHTS = 1 << 20
#: Texts that are scored at once at most.
BLOCK = 1024


def term_stats(docs: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(key, dl, term, tf) and (term, idf, avgdl); a negative idf becomes EPSILON times the mean of all. Empty texts count
    in the totals. The totals are tables of one row."""
    rows = docs.select(*key, X.tokens(F.coalesce("text", F.lit(""))).alias("terms")).withColumn("dl", F.size("terms"))
    tf = rows.select(*key, "dl", F.explode("terms").alias("term")).groupBy(*key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(totals)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")
    return tf, idf


_TOKEN = re.compile("[a-z0-9']+")
#: Terms that a task counts before it hands its counts on.
HELD = 1 << 19
#: Stands for the texts themselves among the terms; no token looks like it.
_TEXTS = "<texts>"


def _tokens(text: str) -> list[str]:
    """As ``expr.tokens``, for passes that read texts in Arrow batches."""
    return _TOKEN.findall(text.lower())


def _counts(df: Counter, words: int) -> pa.RecordBatch:
    terms = list(df)
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([words if t == _TEXTS else 0 for t in terms], pa.int64())], names=["term", "df", "words"])


def term_idf(docs: DataFrame) -> DataFrame:
    """(term, idf, avgdl) as ``term_stats`` has them, from one pass in which tasks count their texts' terms before any
    is dealt out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, words = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = _tokens(text)
                words += len(own)
                df.update(set(own))
                df[_TEXTS] += 1
            if len(df) > HELD:
                yield _counts(df, words)
                df, words = Counter(), 0
        yield _counts(df, words)

    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "term string, df bigint, words bigint")
    counts = checkpointed(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")))
    whole = counts.filter(F.col("term") == _TEXTS).first()
    n, avgdl = (whole.df, whole.words / whole.df) if whole else (0, 0.0)
    raw = counts.filter(F.col("term") != _TEXTS).select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"), F.lit(avgdl).alias("avgdl"))


def _weights(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """qid, term, w, avgdl: repeated query words count again."""
    asked = queries.select("qid", F.explode(X.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    return asked.join(idf, "term").select("qid", "term", (F.col("times") * F.col("idf")).alias("w"), "avgdl")


def _part() -> F.Column:
    return F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25_scores(pools: DataFrame, queries: DataFrame, docs: DataFrame, key: tuple[str, ...] = ("vid", "idx")) -> DataFrame:
    """``pools`` (qid, key) with a score; queries are (qid, text). Pairs without a common word score 0 and stay."""
    tf, idf = term_stats(docs, key)
    met = pools.select("qid", *key).join(_weights(queries, idf), "qid").join(tf, [*key, "term"])
    sums = met.groupBy("qid", *key).agg(F.sum(_part()).alias("s"))
    return pools.join(sums, ["qid", *key], "left").withColumn("score", F.round(F.coalesce("s", F.lit(0.0)), 6)).drop("s")


def bm25_search(queries: DataFrame, docs: DataFrame, key: str, top: int = 10) -> DataFrame:
    """qid, key, score, place: of each query the ``top`` texts of the whole corpus; of equal scores the lesser key first.

    Up to MOST_WEIGHTS query words, all tasks get the queries' weights, and a task scores its texts block by block, where
    they are: of a query's words those are set aside that even together, at their largest in the block, can't lift a text
    to the query's ``top`` best so far; only texts with one of the other words are looked at, and only as long as what is
    left of the words can lift them there. What can't be among the best is passed over, so the result is that of scoring all; a task hands on its ``top`` texts a query. Beyond that
    size texts meet queries by the words that they share.
    """
    weights = checkpointed(_weights(queries, term_idf(docs)))
    if weights.count() > MOST_WEIGHTS:
        found = term_stats(docs, (key,))[0].join(weights, "term").groupBy("qid", key).agg(F.sum(_part()).alias("score"))
    else:
        found = _pruned(weights, docs, key, top)
    sums = found.select("qid", key, F.round("score", 6).alias("score"))
    ranked = sums.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("place") <= top)


class Best:
    """The ``top`` best of a query so far, by score rounded, then key."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def floor(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.top else -math.inf

    def add(self, scores: np.ndarray, keys: list) -> None:
        rows = self.rows + [(round(s, 6), k, s) for s, k in zip(scores.tolist(), keys)]
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1]))[: self.top]


def score_block(doc: np.ndarray, term: np.ndarray, part: np.ndarray, n: int, asked: dict, best: dict[object, Best], keys: list) -> int:
    """Scores a block of ``n`` texts; how many pairs of query and text were candidates, which is to say scored to the end.

    (doc, term, part) are the block's postings, ordered by term, then text; ``asked``: by query its terms and weights. A
    query's words go by the most that each can add in this block. Those that even together can't reach the floor find no
    texts of their own; they are looked up for texts that the others found, and only as long as these can reach it.
    """
    at = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1], [True]))) if len(term) else np.zeros(1, np.int64)
    most = dict(zip(term[at[:-1]].tolist(), zip(at[:-1].tolist(), at[1:].tolist(), np.maximum.reduceat(part, at[:-1]).tolist() if len(term) else [])))
    met = 0
    for qid, (terms, weights) in asked.items():
        own = sorted(((max(0.0, w * most[t][2]), w, *most[t][:2]) for t, w in zip(terms, weights) if t in most), reverse=True)
        if not own:
            continue
        floor = best[qid].floor() - 1e-5  # the margin is for rounding
        rest = [*accumulate((x[0] for x in reversed(own)), initial=0.0)][::-1]  # what the words from one on can add
        needed = next((i for i, x in enumerate(rest) if x < floor), len(own))
        if not needed:
            continue
        sums, seen = np.zeros(n), np.zeros(n, bool)
        for _, w, a, b in own[:needed]:
            sums[doc[a:b]] += w * part[a:b]
            seen[doc[a:b]] = True
        left = np.flatnonzero(seen & (sums + rest[needed] >= floor))
        for i in range(needed, len(own)):
            _, w, a, b = own[i]
            place = np.minimum(np.searchsorted(doc[a:b], left), b - a - 1)
            hit = doc[a:b][place] == left
            sums[left[hit]] += w * part[a:b][place[hit]]
            left = left[sums[left] + rest[i + 1] >= floor]
            if not len(left):
                break
        met += len(left)
        if len(left) > best[qid].top:  # all that tie with the last of them stay
            last = np.partition(sums[left], -best[qid].top)[-best[qid].top]
            left = left[sums[left] >= last - 1e-5]
        best[qid].add(sums[left], [keys[i] for i in left])
    return met


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks that begin small, as all texts are candidates until the first floors are known."""
    size = min(64, BLOCK)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield batch.slice(at, size)
            at, size = at + size, min(2 * size, BLOCK)


def _pruned(weights: DataFrame, docs: DataFrame, key: str, top: int) -> DataFrame:
    """qid, key, score: of each query at least its ``top`` best texts, found by tasks on their own."""
    rows = weights.collect()  # MOST_WEIGHTS at most
    terms = sorted({r.term for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    asked: dict = {}
    for r in sorted(rows, key=lambda r: r.term):
        own = asked.setdefault(r.qid, ([], []))
        own[0].append(number[r.term])
        own[1].append(r.w)
    schema = T.StructType([weights.schema["qid"], docs.schema[key], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), asked, rows[0].avgdl if rows else 1.0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked, avgdl = sent.value
        best = {qid: Best(top) for qid in asked}
        for block in _blocks(batches):
            own = list(map(_tokens, block.column(1).to_pylist()))
            words, dl = pa.array(list(chain.from_iterable(own)), pa.string()), np.array(list(map(len, own)))
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
            pair = (place * block.num_rows + np.repeat(np.arange(block.num_rows), dl))[place >= 0]
            pair, tf = np.unique(pair, return_counts=True)
            term, doc = np.divmod(pair, block.num_rows)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
            score_block(doc, term, part, block.num_rows, asked, best, block.column(0).to_pylist())
        out = [(qid, k, s) for qid, own in best.items() for _, k, s in own.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*out) if out else ((), (), ()), schema)], names=schema.names)

    return docs.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, schema)
