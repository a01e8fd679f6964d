"""The corpus pipeline: toxicity, near-duplicates, benchmark contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontamination, packing, pii, simhash, toxicity
from spindrift.llm.base import checkpoint_folder, read, text_key, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model calls toxic go. It is fitted on labelled rows of the stage's own input.

    Null and empty texts stay, as do all rows where labels of both classes are lacking; repeated rows fare alike, and no
    documents give none.
    """
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays.

    Null and empty texts are one group. Rows that repeat doc_id and text are one document; rows without a doc_id can't
    be told apart by it and stay. No documents give none.
    """
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lie in benchmark windows.

    Null and empty texts have no words and stay; an empty benchmark drops nothing; rows that agree in doc_id (null too)
    and text fare alike.
    """
    judged = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    gone = judged.filter("contaminated").select("doc_id", F.col("row_key").alias("__row_key"))
    return without(docs.withColumn("__row_key", text_key()), gone, ["doc_id", "__row_key"]).drop("__row_key")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, and n_chars, where there is such a column, counts anew.

    No row goes. Null and empty texts stay as they are; repeated rows fare alike.
    """
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, packed by least slack. A null or empty text is one piece, the end id; repeated rows
    are pieces of their own; no documents give no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
#: Fitted models and token ids are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The stages over ``documents``, each written to the checkpoint folder before the next one reads it.

    A stage's output is removed once the next one's is complete. A run that is started again under the same ``run_id``,
    over the same ``sf_dir`` and with the same stages, goes on after the last complete one; over another it begins anew.
    Without a ``run_id`` each run is its own.
    """
    made_of = sha256("\n".join([sf_dir.rstrip("/"), *(name for name, _ in STAGES)]).encode()).hexdigest()[:16]
    folder = f"{checkpoint_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}-{made_of}"
    outputs = [f"{folder}/{i}_{name}" for i, (name, _) in enumerate(STAGES)]
    done = max((i for i, output in enumerate(outputs) if _complete(spark, output)), default=-1)
    docs = spark.read.parquet(outputs[done]) if done >= 0 else read(spark, sf_dir, "documents")
    for i in range(done + 1, len(STAGES)):
        STAGES[i][1](spark, docs, sf_dir).write.mode("overwrite").parquet(outputs[i])
        docs = spark.read.parquet(outputs[i])
        if i:
            _path(spark, outputs[i - 1], lambda fs, path: fs.delete(path, True))
    return docs


def _path(spark: SparkSession, name: str, act: Callable):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return act(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)


def _complete(spark: SparkSession, output: str) -> bool:
    return _path(spark, f"{output}/_SUCCESS", lambda fs, path: fs.exists(path))
