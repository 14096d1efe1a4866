"""Scoring of patches by a pluggable model, in batches."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
from pyarrow import fs
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

BATCH = 256
#: A model turns float32 [n, channels, side, side] into n logits.
Model = Callable[[np.ndarray], np.ndarray]


def baseline() -> Model:
    """Where no trained network is at hand: patches whose alpha fills more, and whose colours agree more, score higher."""

    def model(x: np.ndarray) -> np.ndarray:
        alpha = x[:, 3].mean(axis=(1, 2))
        colour = x[:, :3].mean(axis=(1, 2, 3))
        return 4 * alpha - 2 * np.abs(colour)

    return model


def scorer(make_model: Callable[[], Model], channels: int = 4, side: int = 224, batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function from flat patches (array<float>) to scores in 0..1. ``make_model`` runs once in each worker."""

    def make():
        model = make_model()

        def predict(x: np.ndarray) -> np.ndarray:
            z = np.asarray(model(x.reshape(-1, channels, side, side)), np.float64).reshape(-1)
            return (1 / (1 + np.exp(-z))).astype(np.float32)

        return predict

    return predict_batch_udf(make, return_type=FloatType(), batch_size=batch, input_tensor_shapes=[[channels, side, side]])


def distance_score(poses: DataFrame, contacts: DataFrame, keys: list[str], radius: float = 100.0) -> DataFrame:
    """(keys..., ty, tx, n, score): a model-free score of each pose: how close its neighbouring contacts are, on average, in 0..1."""
    d = F.hypot(F.col("py") - F.col("qy") - F.col("ty"), F.col("px") - F.col("qx") - F.col("tx"))
    return contacts.groupBy(*keys, "ty", "tx").agg(F.count("*").alias("n"), F.avg(1 - d / radius).alias("score"))


def trained(samples: DataFrame, features: str, label: str, regularisation: float = 1e-3) -> Callable[[], Model]:
    """A scorer's model from labelled descriptors (array<double>): logistic regression, where no deep network can be trained.

    The model takes a patch's per-channel means and deviations as descriptors; see ``descriptors``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    fit = LogisticRegression(featuresCol="v", labelCol=label, regParam=regularisation).fit(samples.select(array_to_vector(F.col(features)).alias("v"), F.col(label)))
    return linear(fit.coefficients.toArray(), float(fit.intercept))


def linear(weights: np.ndarray, bias: float) -> Callable[[], Model]:
    """A model on ``descriptors``, which ``save`` can write."""

    def make() -> Model:
        return lambda x: descriptors(x) @ weights + bias

    make.parameters = (weights, bias)
    return make


def save(make_model: Callable[[], Model], path: str) -> None:
    """Write a trained model to a file that ``load`` reads. Paths of all pyarrow file systems."""
    weights, bias = make_model.parameters
    data = io.BytesIO()
    np.savez(data, weights=weights, bias=bias)
    store, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(at) as out:
        out.write(data.getvalue())


def load(path: str) -> Callable[[], Model]:
    """The model of a file that ``save`` wrote; FileNotFoundError if there is none. It is read once, by the driver."""
    store, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(at) as source:
        held = np.load(io.BytesIO(source.read()))
    return linear(held["weights"], float(held["bias"]))


def descriptors(x: np.ndarray) -> np.ndarray:
    """Means and deviations of each channel of patches [n, channels, side, side]."""
    return np.concatenate([x.mean(axis=(2, 3)), x.std(axis=(2, 3))], axis=1).astype(np.float64)
