"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) is the logistic of (w . x - threshold k): one weight vector is shared by all thresholds, which are
ordered. The expected severity is the sum of those probabilities.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.base import keep_rows, read, scan_texts

#: Grades: 0 not toxic, then thirds of the toxic training rows by severity; see ``severities``.
GRADES = 4
#: Labelled rows of each class that the model is fitted on, at most, chosen by a hash of doc_id. The only sample here.
SAMPLE = 3000
#: Features are whole words and word beginnings of these lengths.
PREFIXES = (3, 4, 5, 6, 7, 8)
FEATURES = 6000
#: A feature must be in so many toxic rows, and so many times as frequent there; the share of the loss that toxic rows have.
MIN_ROWS, LEAD, TOXIC_SHARE = 8, 8, 0.2
REJECT_AT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def _features_of(word: str) -> list[int]:
    return [zlib.crc32(f"={word}".encode()), *(zlib.crc32(word[:n].encode()) for n in PREFIXES if len(word) >= n)]


def _bag(text: str) -> bytes:
    """Distinct features of a text."""
    ids = {f for w in set(_WORD.findall(text.lower())) for f in _features_of(w)}
    return np.array(sorted(ids), np.uint32).tobytes()


@dataclass(frozen=True)
class Ordinal:
    """Weights by feature, ordered thresholds."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def at_least(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - np.array(self.thresholds)[None, :], -60, 60)))


EMPTY = Ordinal({}, (60.0,) * (GRADES - 1))


def _sparse(bags: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the features that are in ``columns`` (sorted)."""
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = np.concatenate(bags) if bags else np.zeros(0, np.uint32)
    at = np.minimum(np.searchsorted(columns, flat), max(0, len(columns) - 1))
    hit = columns[at] == flat if len(columns) else np.zeros(len(flat), bool)
    return rows[hit], at[hit]


def select_features(bags: list[np.ndarray], toxic: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """Features with the most significant lead among toxic rows: in MIN_ROWS of them, LEAD times as often as in others."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    flat = np.concatenate(bags) if bags else np.zeros(0, np.uint32)
    of = np.repeat(toxic, [len(b) for b in bags])
    values, inverse = np.unique(flat, return_inverse=True)
    c1 = np.bincount(inverse[of], minlength=len(values))
    c0 = np.bincount(inverse[~of], minlength=len(values))
    p1, p0 = c1 / max(1, n1), (c0 + 2) / (n0 + 4)
    z = (p1 - p0) / np.sqrt(p0 * (1 - p0) / max(1, n1) + 1e-12)
    fit = np.flatnonzero((c1 >= MIN_ROWS) & (p1 >= LEAD * p0) & (z > 4))
    best = fit[np.argsort(-z[fit], kind="stable")[:most]]
    return np.sort(values[best])


def severities(bags: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """How severe a row is by the other rows' account: how many of its features are telling ones, these chosen on the
    half of the rows that it isn't in. So no row's grade is made from features that were chosen by looking at it. Rows
    are in two halves by their place."""
    out = np.zeros(len(bags))
    half = np.arange(len(bags)) % 2
    for k in (0, 1):
        others = np.flatnonzero(half != k)
        columns = select_features([bags[i] for i in others], toxic[others])
        own = np.flatnonzero(half == k)
        rows, _ = _sparse([bags[i] for i in own], columns)
        out[own] = np.bincount(rows, minlength=len(own))
    return out


def fit(raw: list[tuple[bytes, int]], grades: int = GRADES, steps: int = 400, l2: float = 2.0, rate: float = 0.1) -> Ordinal:
    """The model for bags with 0/1 labels; with no rows of either class, one that calls nothing toxic.

    Full-batch Adam on the ordinal likelihood (as the sum of its cumulative logistic losses) with an L2 penalty; the
    classes' shares of the loss are fixed, whatever the sample's. Every feature was chosen for its lead among toxic
    rows, so no weight falls below 0: each can but add to the severity.
    """
    toxic = np.array([y == 1 for _, y in raw], bool)
    if not toxic.any() or toxic.all():
        return EMPTY
    bags = [np.frombuffer(b, np.uint32) for b, _ in raw]
    columns = select_features(bags, toxic)
    if not len(columns):
        return EMPTY
    r, c = _sparse(bags, columns)
    grade = np.zeros(len(bags), int)
    severe = severities(bags, toxic)[toxic]
    grade[toxic] = 1 + np.searchsorted(np.sort(severe), severe) * (grades - 1) // toxic.sum()  # equals share a grade
    weight = np.where(toxic, TOXIC_SHARE / toxic.sum(), (1 - TOXIC_SHARE) / (~toxic).sum())
    w = np.zeros(len(columns))
    base, gaps = 1.0, np.full(grades - 2, 0.0)  # thresholds: base, then base + cumulated exp(gaps)
    parts = [w, np.zeros(1) + base, gaps]
    first, second = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    wanted = grade[:, None] >= np.arange(1, grades)[None, :]
    for t in range(1, steps + 1):
        w, b, gaps = parts
        thresholds = b[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        linear = np.bincount(r, w[c], minlength=len(bags))
        error = (1 / (1 + np.exp(-np.clip(linear[:, None] - thresholds[None, :], -60, 60))) - wanted) * weight[:, None]
        of_linear, of_threshold = error.sum(axis=1), -error.sum(axis=0)
        tail = np.cumsum(of_threshold[::-1])[::-1]
        gradient = [np.bincount(c, of_linear[r], minlength=len(w)) + l2 * w / len(bags) / 10, np.array([tail[0]]), tail[1:] * np.exp(gaps)]
        for i, g in enumerate(gradient):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            parts[i] = parts[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        np.maximum(parts[0], 0, out=parts[0])
    w, b, gaps = parts
    return Ordinal({int(f): float(x) for f, x in zip(columns, w)}, tuple(float(x) for x in b[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fitted on ``sample`` labelled doc_ids of each class at most; their bags of features, one of each doc_id (the first
    by value, where it stands for several texts), come to the driver. Null labels and null doc_ids teach nothing; a
    doc_id labelled both ways counts as toxic; without rows of both classes the model calls nothing toxic."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = known.filter("y = 1").orderBy(order).limit(sample).unionByName(known.filter("y = 0").orderBy(order).limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.groupBy("doc_id").agg(F.max("y").alias("y"))), "doc_id")
    bags = scan_texts(rows, lambda t: (_bag(t),), {"bag": "binary"}, keep=("doc_id", "y")).groupBy("doc_id", "y").agg(F.min("bag").alias("bag"))
    return fit(sorted(((bytes(r.bag), r.y) for r in bags.collect()), key=lambda r: (r[1], r[0])))


class Scorer:
    """Linear scores of texts; a word's weight is looked up once."""

    def __init__(self, model: Ordinal):
        self.model, self.words = model, {}

    def linear(self, text: str) -> float:
        found: set[int] = set()
        known, weights = self.words, self.model.weights
        for w in set(_WORD.findall(text.lower())):
            hits = known.get(w)
            if hits is None:
                if len(known) > 100_000:
                    known.clear()
                hits = known[w] = tuple(f for f in _features_of(w) if f in weights)
            if hits:
                found.update(hits)
        return sum(weights[f] for f in found)


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_severity, grade (the most that is likelier than not), toxic: a row for each row of ``docs``.

    A null or empty text has no features and is not toxic. Texts are read whole; repeated rows give repeated results,
    equal texts equal ones, an empty table none, a null doc_id stays null. The model is bounded by FEATURES and
    broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def score(text: str) -> tuple[float, int, bool]:
        if "scorer" not in state:
            state["scorer"] = Scorer(sent.value)
        p = sent.value.at_least(np.array([state["scorer"].linear(text)]))[0]
        return round(float(p.sum()), 6), int((p >= REJECT_AT).sum()), bool(p[0] >= REJECT_AT)

    return scan_texts(docs, score, {"expected_severity": "double", "grade": "int", "toxic": "boolean"})


def clean(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they are; a null or empty text is none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    state: dict = {}

    def verdicts(texts: list) -> list[bool]:
        if "scorer" not in state:
            state["scorer"] = Scorer(sent.value)
        linear = np.array([state["scorer"].linear(t or "") for t in texts])
        return (sent.value.at_least(linear)[:, 0] < REJECT_AT).tolist() if len(texts) else []

    return keep_rows(docs, verdicts)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return severity(docs, train(docs, read(spark, sf_dir, "labels")))
