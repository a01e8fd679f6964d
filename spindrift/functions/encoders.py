"""Where model backends plug in: two-tower encoders over Arrow batches, a deterministic stand-in that needs no weights,
and the caches that are built with them."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import expr as X
from spindrift.schema import QUERY_FORMS


class DualEncoder(ABC):
    """Texts and videos into one space. ``num_frames`` is how many frames a chunk is shown by."""

    checkpoint = ""
    dim = 0
    num_frames = 8
    batch_size = 8

    @abstractmethod
    def encode_texts(self, texts: list[str]) -> np.ndarray:
        """A unit vector per text."""

    @abstractmethod
    def encode_videos(self, clips: list[np.ndarray]) -> np.ndarray:
        """A unit vector per clip (an array of frames)."""


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class HashEncoder(DualEncoder):
    """Signed feature hashing: of words, and of the numbers in frames."""

    checkpoint, dim = "hash", 32

    def _place(self, word: str) -> tuple[int, int]:
        d = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()
        return d[0] % self.dim, 1 if d[1] & 1 else -1

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        places = {w: self._place(w) for w in {w for ws in words for w in ws}}
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        at = np.array([places[w] for ws in words for w in ws], int).reshape(-1, 2)
        return _unit(np.bincount(row * self.dim + at[:, 0], at[:, 1], len(texts) * self.dim).reshape(len(texts), self.dim))

    def encode_videos(self, clips: list[np.ndarray]) -> np.ndarray:
        return self.encode_texts([" ".join(str(int(x)) for x in np.asarray(c).ravel()) for c in clips])


ENCODERS: dict[str, type[DualEncoder]] = {"hash": HashEncoder}


def _encoded(encoder: str, tower: str, column: Column) -> Column:
    kind = ENCODERS[encoder]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = kind()
        call = backend.encode_texts if tower == "text" else backend.encode_videos
        for items in batches:
            values, out = items.to_list(), []
            for i in range(0, len(values), 1024 if tower == "text" else backend.batch_size):
                part = values[i : i + (1024 if tower == "text" else backend.batch_size)]
                made = call(part)
                if len(made) != len(part):
                    raise RuntimeError(f"{len(made)} vectors for {len(part)} items")
                out += list(made)
            yield pd.Series(out, dtype=object)

    return run(column)


def encode(rows: DataFrame, encoder: str, column: str = "text", out: str = "emb") -> DataFrame:
    """``rows`` with a vector of ``column``; null texts are empty. The backend is made once per task."""
    return rows.withColumn(out, _encoded(encoder, "text", F.coalesce(F.col(column), F.lit(""))))


def encode_chunks(chunks: DataFrame, encoder: str, decode: Callable[[pd.Series, pd.Series, pd.Series], pd.Series] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks (vid, idx, s, e, text) with both towers v and t, and the videos that failed (vid).

    ``decode`` gives the frames of (vid, s, e), null where a video can't be read; without it the bounds stand in for
    frames. A video with a chunk that has no frames is left out whole.
    """
    frames = F.pandas_udf(decode, "array<int>")("vid", "s", "e") if decode else F.array(F.floor("s").cast("int"), F.floor("e").cast("int"))
    rows = chunks.withColumn("__frames", frames)
    failed = rows.filter("__frames IS NULL").select("vid").distinct()
    good = rows.join(failed, "vid", "left_anti")
    made = good.withColumns({"v": _encoded(encoder, "video", F.col("__frames")), "t": _encoded(encoder, "text", F.coalesce("text", F.lit("")))})
    return made.drop("__frames"), failed


def available_forms(questions: DataFrame, forms: tuple[str, ...] = QUERY_FORMS) -> list[str]:
    """The query forms that every question can be rendered in; one null drops the form as a whole."""
    texts = [X.render_query(f, F.col("q"), [F.col(f"a{i}") for i in range(4)], F.col("ans_corr")) for f in forms]
    lacking = questions.agg(*[F.count(F.when(t.isNull(), 1)).alias(f"f{i}") for i, t in enumerate(texts)]).first()
    return [f for i, f in enumerate(forms) if not lacking[i]]


def encode_queries(questions: DataFrame, encoder: str, forms: tuple[str, ...] = QUERY_FORMS) -> DataFrame:
    """qid, vid, query_form, query: a vector for each question (qid, vid, q, a0..a3, ans_corr) in each form that all of
    them can be rendered in."""
    known = available_forms(questions, forms)
    texts = [F.struct(F.lit(f).alias("query_form"), X.render_query(f, F.col("q"), [F.col(f"a{i}") for i in range(4)], F.col("ans_corr")).alias("text")) for f in known]
    if not texts:
        return encode(questions.limit(0).select("qid", "vid", F.lit("").alias("query_form"), F.lit("").alias("text")), encoder, out="query").drop("text")
    each = questions.select("qid", "vid", F.explode(F.array(*texts)).alias("x")).select("qid", "vid", "x.*")
    return encode(each, encoder, out="query").drop("text")


def build_cache(manifest: DataFrame, transcripts: DataFrame, questions: DataFrame, encoder: str, decode: Callable | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """chunks, queries, failed of a manifest (vid, chunks, oracle_idx) with its ranges' texts (vid, chunk, text): what a cache
    holds. ``limit`` takes the first videos only. No chunk at all is an error."""
    kept = manifest.orderBy("vid").limit(limit) if limit else manifest
    flat = kept.select("vid", "oracle_idx", F.posexplode("chunks").alias("idx", "c")).select("vid", "idx", "c.s", "c.e", (F.col("idx") == F.col("oracle_idx")).alias("is_oracle"))
    said = transcripts.select("vid", F.col("chunk").alias("idx"), "text")
    chunks, failed = encode_chunks(flat.join(said, ["vid", "idx"], "left").withColumn("text", F.coalesce("text", F.lit(""))), encoder, decode)
    if chunks.select("vid").limit(1).isEmpty():
        raise RuntimeError("no video was encoded")
    asked = questions.join(chunks.select("vid").distinct(), "vid", "left_semi")
    return {"chunks": chunks, "queries": encode_queries(asked, encoder), "failed": failed}
