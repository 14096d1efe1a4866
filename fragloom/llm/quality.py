"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Defined results: a null or empty text has no n-grams and gets the score of the bias; rows with equal ids or
texts are scored each; an empty table gives no rows; columns other than the text column are passed by. With labels of one class only, or none, the
score is the share of label 1 among them (0.5 if there are none). Very long texts are scored as a whole: the kernel's
memory grows with the longest text, not with the partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, features
from . import textcols as tc

#: At most so many labelled documents of each class, of common.SAMPLE_BYTES in all, are used for training.
SAMPLE_PER_CLASS = 2500


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    threshold: float = 0.3


def gather(sample: DataFrame, kinds=features.KINDS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and labels of a bounded sample (doc_id, text, y), in the order of doc_id; the features are made on the executors."""

    def run(batches):
        for b in tc.chunks(batches):
            rows = features.sparse(b.column("text"), kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([c.astype("<i4").tobytes() for c, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())],
                ["doc_id", "y", "at", "value"],
            )

    got = sorted(tc.map_arrow(sample.select("doc_id", "y", "text"), run, "doc_id long, y int, at binary, value binary").collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    rows = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in got]
    return rows, np.array([r["y"] for r in got], np.int64)


def train(documents: DataFrame, labels: DataFrame, label: str, usable, per_class: int = SAMPLE_PER_CLASS, threshold: float = 0.3) -> QualityModel:
    """Learn ``label`` (0/1) from a bounded sample of the labelled documents for which ``usable`` holds."""
    labelled = labels.where(usable).select("doc_id", F.col(label).cast("int").alias("y"))
    rows, y = gather(common.labelled_sample(documents, labelled, [per_class, per_class]))
    if len(set(y)) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return QualityModel(np.zeros((features.SIZE, 1), np.float32), float(np.log(share / (1 - share))), threshold)
    w, b = features.ftrl(rows, y, 2)
    return QualityModel(w, float(b[0]), threshold)


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast((model.weights, model.bias))
    threshold = model.threshold

    def run(batches):
        weights, bias = held.value
        for b in tc.chunks(batches):
            s = 1 / (1 + np.exp(-np.clip(features.dots(b.column("text"), weights)[0][:, 0] + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return tc.map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels are learnt where crc32(doc_id) mod 5 is not 0."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(documents, labels, "quality", common.remainder("doc_id", 5) != 0)
    return score(documents, model).select("doc_id", F.coalesce(common.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
