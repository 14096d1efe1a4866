"""Mixing sources to target weights: soft domain membership, and document rates fitted by projected gradient.

A classifier trained on the labels table gives every document its posterior over domains. With t the tokens of a
document, p its posterior and r its rate, the expected tokens of a domain are S = sum(r t p). The rates minimise

    1/2 |S/T - target|^2 + l2/2 sum(t/T (r - 1)^2),   r >= floor (0 by default),

by projected gradient with Barzilai-Borwein steps. In the metric of the penalty the gradient of a document is p.(S/T - target) + l2 (r - 1), so
one step needs only the sums S of the rates before, and its length only the sum of their squared changes: a small vector. Rates start
equal, so a document's rate depends on its posterior alone: the rounds go over a table of at most about GRID**2 / 2 cells of like posteriors, with their tokens and their mean posterior,
and the rate of each document follows from its own posterior and the steps.

The classifier counts words and first letters of words besides the shares of word shapes (a few words make a text toxic, however long it is). A part of its sample, not used for its weights, puts its
posteriors on the scale of true shares.

Defined results: a null or empty text has no tokens and a rate of its own but weighs nothing; repeated rows are documents of
their own; an empty table gives no rows; other columns are passed by, whatever their names. A domain that no document has cannot be met; the rest is fitted
as near as the penalty allows. A fit that has not settled after ROUNDS rounds says so in a warning and in its result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from . import common, features, quality
from . import textcols as tc

#: Domains of the labels table and the share of all tokens that each shall have.
DOMAINS = ("clean", "low", "toxic")
TARGET = (0.95, 0.04, 0.01)
#: Bytes of text whose posteriors are made together: the numbers of their words take many times that, beside those of earlier stages.
CHUNK_BYTES = 2 << 20
#: At most so many labelled documents of each domain, of common.SAMPLE_BYTES in all, are used for training.
SAMPLE_PER_CLASS = 1200
ROUNDS = 200
TOLERANCE = 1e-5
L2 = 0.0005
GRID = 256
#: What the domain classifier looks at, as in ``features``: shares of words and shapes, counts of words and stems.
KINDS = (("word", 1, 17, False), ("shape", 1, 11, False), ("shape", 2, 12, False), ("shape", 3, 12, False), ("word", 1, 17, True), ("stem", 1, 16, True))


def domain_of(quality_label, toxic_label):
    """Number of a labelled row's domain: toxic first, then low quality, else clean."""
    return F.when(toxic_label == 1, 2).when(quality_label == 0, 1).otherwise(0)


@dataclass
class DomainModel:
    weights: np.ndarray  # features x domains
    bias: np.ndarray


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DomainModel:
    """Multinomial classifier on a bounded sample of the labelled documents (``per_class`` of each domain at most).

    The sample holds the domains in other shares than the labels table, so the bias is moved by the logarithms of their ratios: posteriors follow all labels.
    """
    tagged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("y")).distinct()
    rows, y = quality.gather(common.labelled_sample(documents, tagged, [per_class] * len(DOMAINS)), KINDS)
    if not len(y):
        return DomainModel(np.zeros((features.size_of(KINDS), len(DOMAINS)), np.float32), np.zeros(len(DOMAINS)))
    aside = np.random.default_rng(42).random(len(y)) < 0.3
    if min(np.bincount(y[aside], minlength=len(DOMAINS))) < 20:
        aside[:] = False
    w, b = features.ftrl([r for r, out in zip(rows, aside) if not out], y[~aside], len(DOMAINS), epochs=6, kinds=KINDS)
    if aside.any():
        m = np.array([v @ w[c] for (c, v), out in zip(rows, aside) if out]) + b
        scale, move = scaled(m, y[aside])
        w, b = (w * scale).astype(np.float32), b * scale + move
    every = np.zeros(len(DOMAINS))
    for r in tagged.groupBy("y").count().collect():
        every[r["y"]] = r["count"]
    seen = np.bincount(y, minlength=len(DOMAINS))
    prior = np.log(np.maximum(every, 1e-9) / every.sum()) - np.log(np.maximum(seen, 1e-9) / seen.sum())
    return DomainModel(w, b + np.where(seen == 0, -50.0, prior))


def scaled(m: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, np.ndarray]:
    """(scale, shifts) that make the softmax of scale * m + shifts likeliest for the labels."""
    scale, move, truth = 1.0, np.zeros(m.shape[1]), np.eye(m.shape[1])[y]
    spread = max(1.0, float(np.abs(m).max()))
    for _ in range(steps):
        z = scale * m + move
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = e / e.sum(axis=1, keepdims=True) - truth
        scale = max(scale - 2.0 / spread**2 * float((g * m).sum(axis=1).mean()), 0.05)
        move -= g.mean(axis=0)
    return scale, move - move.mean()


def _posterior(texts: pa.Array, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The posterior over the domains and the words of each text."""
    m, words = features.dots(texts, weights, KINDS)
    m += bias
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), words


def posteriors(documents: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """The columns to keep, with tokens (white-space words) and posterior (array)."""
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    schema = StructType([documents.schema[c] for c in keep]).add("tokens", LongType()).add("posterior", ArrayType(DoubleType()))

    def run(batches):
        weights, bias = held.value
        for b in tc.chunks(batches, limit=CHUNK_BYTES):
            p, words = _posterior(b.column("text"), weights, bias)
            post = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(words), post], [*keep, "tokens", "posterior"])

    return tc.map_arrow(documents.select(*dict.fromkeys([*keep, "text"])), run, schema)


def rates_after(posterior: np.ndarray, steps: list[tuple[np.ndarray, float]], floor: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents after the given steps (S/T - target, length), and the rates before the last one."""
    r = before = np.ones(len(posterior))
    for g, eta in steps:
        r, before = np.maximum(floor, r - eta * (posterior @ g + l2 * (r - 1))), r
    return r, before


@dataclass
class Fit:
    steps: list[tuple[np.ndarray, float]]  # for ``rates_after``
    share: np.ndarray  # expected tokens of each domain, as shares of all tokens, at the last round
    settled: bool  # whether the rates stopped moving


def compacted(table: DataFrame, k: int) -> DataFrame:
    """(tokens, posterior) of cells of like posteriors: their tokens, and their mean posterior weighted by tokens. Its rows do not grow with the corpus."""
    p = lambda i: F.col("posterior")[i]
    cells = table.where("tokens > 0").groupBy(*[F.floor(p(i) * GRID).cast("int").alias(f"g{i}") for i in range(k)]).agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * p(i)).alias(f"s{i}") for i in range(k)])
    return cells.select("tokens", F.array(*[F.col(f"s{i}") / F.col("tokens") for i in range(k)]).alias("posterior"))


def fit(table: DataFrame, target: tuple[float, ...] = TARGET, floor: float = 0.0, l2: float = L2, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Fit:
    """Projected-gradient rounds over ``table`` (tokens, posterior)."""
    k = len(target)
    cells = common.written(compacted(table, k).coalesce(4), "mixing-cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    steps: list[tuple[np.ndarray, float]] = []
    share, last, settled = np.zeros(k), None, not total
    for _ in range(rounds if total else 0):
        held = list(steps)

        def run(batches):
            s = np.zeros(k + 1)
            for b in batches:
                p = b.column("posterior").flatten().to_numpy().reshape(b.num_rows, k)
                r, before = rates_after(p, held, floor, l2)
                t = b.column("tokens").to_numpy()
                s[:k] += (r * t) @ p
                s[k] += t @ (r - before) ** 2
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(s)], ["part", "s"])

        sums = np.zeros(k + 1)
        for row in tc.map_arrow(cells, run, "part int, s double").collect():  # k + 1 numbers of at most four tasks
            sums[row["part"]] += row["s"] / total
        share, moved = sums[:k], sums[k]
        if last is not None and moved < tolerance**2:
            settled = True
            break
        # the gradient changed by p.(share - last) + l2 (change), so these sums give the Barzilai-Borwein length
        eta = 1 / (1 + l2) if last is None else moved / (((share - last) ** 2).sum() + l2 * moved)
        steps.append((share - np.array(target), float(np.clip(eta, 0.1, 1 / l2))))
        last = share
    common.delete(cells)
    if not settled:
        warnings.warn(f"mixing rates still moved after {rounds} rounds; shares are {share.round(4).tolist()}", stacklevel=2)
    return Fit(steps, share, settled)


def with_rates(table: DataFrame, fitted: Fit, floor: float = 0.0, l2: float = L2) -> DataFrame:
    """The table with the column rate."""
    steps = fitted.steps
    names = table.columns

    def run(batches):
        for b in batches:
            if b.num_rows:
                p = b.column("posterior").flatten().to_numpy().reshape(b.num_rows, -1)
                r, _ = rates_after(p, steps, floor, l2)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*names, "rate"])

    schema = StructType(table.schema.fields[:]).add("rate", DoubleType())
    return tc.map_arrow(table, run, schema)


def copies(rate, key):
    """How often a document is taken: the rate, rounded up or down by a hash of its id, so that the mean is the rate."""
    u = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def mixed(documents: DataFrame, labels: DataFrame, target: tuple[float, ...] = TARGET, floor: float = 0.0) -> DataFrame:
    """(doc_id, tokens, posterior, rate, copies) of every document."""
    table = common.written(posteriors(documents, train(documents, labels), ["doc_id"]), "mixing")
    return with_rates(table, fit(table, target, floor), floor).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def taken(documents: DataFrame, labels: DataFrame, target: tuple[float, ...] = TARGET, floor: float = 0.0) -> DataFrame:
    """The documents, with all their columns, each as often as its rate says. Posteriors are made again in the last pass rather than kept with the texts."""
    model = train(documents, labels)
    table = common.written(posteriors(documents, model, []), "mixing-fit")
    steps = fit(table, target, floor).steps
    common.delete(table)
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    names = documents.columns
    (rate,) = common.fresh(documents, "mixing_rate")

    def run(batches):
        weights, bias = held.value
        for b in tc.chunks(batches, limit=CHUNK_BYTES):
            r, _ = rates_after(_posterior(b.column("text"), weights, bias)[0], steps, floor, L2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*names, rate])

    out = tc.map_arrow(documents, run, StructType(documents.schema.fields[:]).add(rate, DoubleType()))
    out = out.withColumn(rate, copies(F.col(rate), F.col("doc_id"))).where(F.col(rate) > 0)
    return out.withColumn(rate, F.explode(F.sequence(F.lit(1), F.col(rate)))).drop(rate)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, domain posterior, fitted rate and rounded number of copies."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mixed(documents.select("doc_id", "text"), labels)
    return out.select("doc_id", "tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")
