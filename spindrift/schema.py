"""Constants and schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits, bands and names of the data model.
CHUNK_SECONDS, SLIVER_SECONDS = 60.0, 10.0
MIN_CHUNKS, MAX_CHUNKS = 2, 20
#: Pool-size bands, both ends included.
BANDS = ((2, 3), (4, 5), (6, 8), (9, 12), (13, 20))
Z_95 = 1.959963984540054
REPRESENTATIONS = ("video", "transcript", "fused")
QUERY_FORMS = ("question", "question+options", "answer")
POOL_TYPES = ("within", "cross")
MIN_WORDS, MIN_SECONDS = 20, 45.0


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
QA = _struct(qid=_S, vid_name=_S, q=_S, a0=_S, a1=_S, a2=_S, a3=_S, answer_idx=_I, ans_corr=_S)
RESULT = _struct(video=_S, qid=_S, pred=_I, gold=_I, correct=T.BooleanType(), raw=_S)
FAILURE = _struct(id=_S, artifact=_S, reason=_S, when=_S, error=_S, _corrupt_record=_S)
CUE = _struct(vid=_S, cue_no=_I, start=_D, end=_D, text=_S)
