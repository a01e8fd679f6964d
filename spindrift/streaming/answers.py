"""Answers as a keyed stateful stream: what was answered stays in the state, and accuracy runs on from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spindrift.operators.answers import score

RUNNING = "video string, qid string, seq bigint, pred int, gold int, correct boolean, running double"
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Answered(StatefulProcessor):
    """By video: the qids answered so far, a map, and the counts of labelled and of right answers.

    A qid that comes again, in a batch or after a restart, is passed over, so results needn't be read again to go on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "qid string", "seq bigint")
        self.sums = handle.getValueState("sums", "n bigint, k bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, k = self.sums.get() if self.sums.exists() else (0, 0)
        arrived = pd.concat(list(rows)).sort_values(["seq", "qid"], kind="stable")
        running, new = [], []
        for at, r in enumerate(arrived.itertuples()):
            if self.known.containsKey((r.qid,)):
                continue
            self.known.updateValue((r.qid,), (int(r.seq),))
            if not pd.isna(r.correct):
                n, k = n + 1, k + int(r.correct)
            new.append(at)
            running.append((2_000_000 * k + n) // (2 * n) / 1_000_000 if n else None)  # halves up, as a batch rounds
        self.sums.update((int(n), int(k)))
        if new:
            out = arrived.iloc[new][["video", "qid", "seq", "pred", "gold", "correct"]].assign(running=pd.Series(running, dtype="float64").to_numpy())
            yield out.astype({"pred": "Int32", "gold": "Int32", "correct": "boolean"})

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """The state is kept in RocksDB, which the operator needs; the session's own setting comes back after."""
    name, kind = _STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def answer_stream(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores a stream of raw answers (video, qid, seq, gold, raw) and writes RUNNING rows under ``path``, all that has
    come by now. A stream started again with the same ``checkpoint`` goes on where it stopped. A null video is a video
    like others; rows without a qid are left out."""
    scored = score(raw.filter("qid IS NOT NULL")).select("video", "qid", F.col("seq").cast("bigint").alias("seq"), "pred", "gold", "correct")
    with _state_store(raw.sparkSession):
        out = scored.groupBy("video").transformWithStateInPandas(Answered(), RUNNING, "Append", "None")
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_answers(spark: SparkSession, path: str) -> DataFrame:
    """All rows that a stream has written."""
    return spark.read.schema(RUNNING).parquet(path)
