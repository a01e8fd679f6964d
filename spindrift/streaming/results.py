"""A stream of raw answers scored and written as it comes; what was answered before is passed over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.operators.answers import pending, score
from spindrift.schema import RESULT


def score_stream(raw: DataFrame, path: str, checkpoint: str, done: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """raw: video, qid, gold, raw as a stream. Each micro-batch is a folder of its own under ``path``, named by its number,
    so one that is run again replaces what it wrote. ``done`` is asked in each batch for what is answered already."""
    def write(batch: DataFrame, number: int) -> None:
        rows = score(batch).select(*RESULT.names)
        left = pending(rows, done()) if done else rows
        left.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={number}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_results(spark: SparkSession, path: str) -> DataFrame:
    """All results that a stream has written."""
    return spark.read.schema(RESULT).option("mode", "FAILFAST").json(path).select(*[F.col(c) for c in RESULT.names])
