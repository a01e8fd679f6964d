"""The registered queries and their SQL.

The tables stand in for retrieval data: vectors of one label and hundred of ids are a video's chunks, each chunk asks
one question, whose vector is the next chunk's; conversations are videos whose turns are chunks; events are cues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.plans import answering, lexical, retrieval, timeline

FLAGSHIP = "retrieval_within"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _plans in (retrieval, lexical, timeline, answering):
    QUERIES |= _plans.QUERIES
    ORACLES |= _plans.ORACLES
