"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits each feature in turn and adds a shallow tree over it alone; since trees over one feature only
add up, what is learnt is a table by bin. Then pairs with the largest leftover gain get tables over two features. A
score is a sum of table entries, looked up for whole batches at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.base import read, scan_texts, slices

#: Labelled rows that the model is fitted on, at most, chosen by a hash of doc_id. The only sample here.
SAMPLE = 12_000
BINS, COARSE, PAIRS, ROUNDS, RATE = 32, 8, 8, 120, 0.15
THRESHOLD = 0.7
_SYMBOL = re.compile(r"[#*$%&|<>]")
FEATURES = (
    "log_words", "mean_word", "longest_word", "symbols_per_word", "bars_per_word", "exclaims_per_word", "upper_share", "digit_share", "letter_share",
    "distinct_words", "top_word", "repeated_windows", "longest_run", "duplicate_lines", "log_line_words", "odd_ends",
)


def features(text: str) -> list[float]:
    """FEATURES of one text; all 0 for one without words. Labels, lang, source and doc_id are not looked at."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts, chars = Counter(words), sum(map(len, words))
    letters = sum(sum(map(str.isalpha, w)) * k for w, k in counts.items())
    upper = text.upper() == text and letters > 0
    run = longest = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        if run > longest:
            longest = run
    windows = n - 2
    distinct = len(set(zip(words, words[1:], words[2:]))) if windows > 0 else 0
    lines = [x for x in text.split("\n") if x.strip()]
    odd = sum(not (w[-1].isalnum() or w[-1] in ".,") for w in counts)
    return [
        float(np.log1p(n)), chars / n, float(max(map(len, counts))), len(_SYMBOL.findall(text)) / n, text.count("|") / n, text.count("!") / n,
        1.0 if upper else sum(w.isupper() for w in counts) / len(counts), sum(map(text.count, "0123456789")) / chars, letters / chars, len(counts) / n, counts.most_common(1)[0][1] / n,
        1 - distinct / windows if windows > 0 else 0.0, float(longest), 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), odd / len(counts),
    ]


@dataclass(frozen=True)
class Gam:
    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    coarse: tuple[np.ndarray, ...]
    pair_tables: tuple[np.ndarray, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        for f, t in enumerate(self.tables):
            total += t[bins[f]]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            total += t[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, l2: float = 1.0) -> np.ndarray:
    """The values by bin of the best tree of ``leaves`` leaves over one feature's gradient and hessian sums."""
    cuts = [0, len(g)]
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + l2)
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], a + i + 1)
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = value(a, b)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four by one line each way: its gain and the values."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, values = 0.0, np.zeros_like(g)
    whole = G[-1, -1] ** 2 / (H[-1, -1] + l2)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            a, b = G[i, j], G[i, -1] - G[i, j]
            c = G[-1, j] - G[i, j]
            d = G[-1, -1] - a - b - c
            ha, hb = H[i, j], H[i, -1] - H[i, j]
            hc = H[-1, j] - H[i, j]
            hd = H[-1, -1] - ha - hb - hc
            gain = a * a / (ha + l2) + b * b / (hb + l2) + c * c / (hc + l2) + d * d / (hd + l2) - whole
            if gain > best:
                best, values = gain, np.zeros_like(g)
                values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = a / (ha + l2), b / (hb + l2)
                values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = c / (hc + l2), d / (hd + l2)
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> Gam:
    """The model for feature rows ``x`` and 0/1 labels ``y``; without rows it says 0.5, with one class that class."""
    n_features = x.shape[1]
    p = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(p / (1 - p)))
    edges = tuple(np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(n_features))
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = tuple((np.arange(len(e) + 1) * COARSE // (len(e) + 1)) for e in edges)
    if len(y) == 0 or y.min() == y.max():
        return Gam(start, edges, tuple(tables), (), coarse, ())
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    total = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f in range(n_features):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
            tables[f] += step
            total += step[bins[f]]
    small = [coarse[f][bins[f]] for f in range(n_features)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(small[a] * COARSE + small[b], v, COARSE * COARSE).reshape(COARSE, COARSE)

    g, h = slopes()
    gains = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(n_features) for b in range(a + 1, n_features)))
    chosen = [(a, b) for gain, a, b in gains[:pairs] if gain < -1e-6]
    pair_tables = [np.zeros((COARSE, COARSE)) for _ in chosen]
    for _ in range(rounds // 4):
        for k, (a, b) in enumerate(chosen):
            g, h = slopes()
            step = rate * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            pair_tables[k] += step
            total += step[small[a], small[b]]
    return Gam(start, edges, tuple(tables), tuple(chosen), coarse, tuple(pair_tables))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Fitted on ``sample`` labelled doc_ids at most, none of them held out; their features, one row of each doc_id (the
    least, where it stands for several texts), come to the driver. Null labels and null doc_ids teach nothing; a doc_id
    labelled both ways counts as 1; without labels all scores are 0.5, with one class they lean to it."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out())
    picked = known.orderBy(F.xxhash64("doc_id", F.lit("quality"))).limit(sample).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    table = scan_texts(rows, lambda t: (features(t),), {"x": "array<double>"}, keep=("doc_id", "y"))
    table = table.groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    table.sort(key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in table], float).reshape(len(table), len(FEATURES))
    return fit(x, np.array([r.y for r in table], float))


def classify(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``.

    A null or empty text has features of 0 and a score like any other. Texts are read whole; repeated rows give
    repeated results, equal texts equal scores, an empty table none; a null doc_id is not held out. The model's tables
    are a few KB, broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"]] + T._parse_datatype_string("held_out boolean, score double, predicted int").fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            x = np.array([features(t or "") for t in batch.column(2).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            score = np.round(sent.value.scores(x), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(work, schema)


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))
