"""Colours of masks: how many there are, and which."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.operators.raster import prominent_colours


def guessed_count(path: Column, any_black: Column) -> Column:
    """Fragments that a path names (its plus signs and one), and one for opaque black."""
    return F.length(path) - F.length(F.replace(path, F.lit("+"), F.lit(""))) + 1 + any_black.cast("int")


def colour_masks(px: DataFrame, cutoff: float = 0.01) -> DataFrame:
    """(image_id, r, g, b, y, x): the pixels of each prominent visible colour."""
    seen = px.where("a > 0 AND r + g + b > 0")
    return seen.join(prominent_colours(seen, "image_id", ["r", "g", "b"], cutoff).drop("n"), ["image_id", "r", "g", "b"])


#: Points that a silhouette takes at most.
SAMPLE = 5000


def sampled(points: DataFrame, features: list[str], sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """At most ``sample`` of the points, in the order of a hash of their features."""
    return points.orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(sample)


def silhouettes(points: DataFrame, labels: list[str], features: list[str], sample: int = SAMPLE) -> DataFrame:
    """(k, score): mean Euclidean silhouette of each labelling column (named by its k) on at most ``sample`` of the points (features..., labels...).

    The sample is bounded, so it is broadcast; the tasks compare it with their parts of it, in blocks.
    """
    spark = points.sparkSession
    rows = [tuple(r) for r in sampled(points.select(*features, *labels), features, sample).collect()]
    x = np.array([r[: len(features)] for r in rows], float).reshape(len(rows), len(features))
    codes = [np.unique([r[len(features) + i] for r in rows], return_inverse=True)[1] if rows else np.zeros(0, int) for i in range(len(labels))]
    held = spark.sparkContext.broadcast((x, codes))

    def run(batches):
        x, codes = held.value
        for b in batches:
            for i in (k for start in b.column("start").to_pylist() for k in range(start, min(start + 100, len(x)), 10)):
                mine = slice(i, min(i + 10, len(x)))
                d = np.sqrt(np.maximum(((x[mine, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))
                for name, code in zip(labels, codes):
                    n = np.bincount(code)
                    sums = np.stack([np.bincount(code, r, len(n)) for r in d])
                    own = code[mine]
                    row = np.arange(len(own))
                    a = sums[row, own] / np.maximum(n[own] - 1, 1)
                    other = sums / n
                    other[row, own] = np.inf
                    near = other.min(axis=1)
                    s = np.where((n[own] > 1) & np.isfinite(near), (near - a) / np.maximum(np.maximum(a, near), 1e-300), 0.0)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([float(s.sum())]), pa.array([len(s)], pa.int64())], ["k", "s", "n"])

    blocks = spark.range(0, max(len(x), 1), 100).select(F.col("id").alias("start")) if len(x) else spark.range(0).select(F.col("id").alias("start"))
    return blocks.mapInArrow(run, "k string, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("score"))


def best_count(scores: DataFrame) -> DataFrame:
    """(k, score): the best labelling, the smallest k on ties."""
    return scores.agg(F.max_by(F.struct("k", "score"), F.struct(F.col("score"), -F.col("k"))).alias("m")).select("m.k", "m.score")


def estimate_colours(pixels: DataFrame, features: list[str], counts=range(2, 16), sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(k, score): the number of clusters with the best silhouette on a sample of at most ``sample`` pixels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = sampled(pixels.select(*features), features, sample, seed).persist()
    vectors = VectorAssembler(inputCols=features, outputCol="v").transform(points)
    for k in counts:
        vectors = KMeans(k=k, seed=seed, featuresCol="v", predictionCol=f"k{k}").fit(vectors).transform(vectors)
    s = silhouettes(vectors.drop("v"), [f"k{k}" for k in counts], features, sample)
    points.unpersist()
    return best_count(s.select(F.substring("k", 2, 9).cast("int").alias("k"), "score"))


def any_black(px: DataFrame, black: Column) -> DataFrame:
    """(image_id, any_black): whether a picture has a pixel for which ``black`` holds."""
    return px.groupBy("image_id").agg(F.bool_or(black).alias("any_black"))


def snapped(medoids: DataFrame, colours: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Each medoid (keys..., m, channels) with the nearest true colour, the lowest on ties; opaque black is left out."""
    t = medoids.join(colours.select(*keys, *[F.col(c).alias(f"t_{c}") for c in channels]), keys)
    d = sum(((F.col(c) - F.col(f"t_{c}")) ** 2 for c in channels), F.lit(0.0))
    true = F.struct(*[F.col(f"t_{c}") for c in channels])
    near = t.groupBy(*keys, "m").agg(F.min_by(true, F.struct(d.alias("d"), true.alias("t"))).alias("n"))
    return near.select(*keys, "m", *[F.col(f"n.t_{c}").alias(c) for c in channels]).where(" OR ".join(f"{c} <> 0" for c in channels))


def dominant(colours: DataFrame, image: str, channels: list[str], k: int, rounds: int = 20) -> DataFrame:
    """(image, m, channels): k medoids of each picture's distinct colours (image, channels, n), weighted by their counts.

    One kernel for each picture over its distinct colours: the first medoid is the commonest colour, each next the one farthest from all (by weighted distance); then
    alternately each colour joins its nearest medoid and each group takes its best one.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["n", *channels], ascending=[False, *[True] * len(channels)])
        p, w = t[channels].to_numpy(float), t["n"].to_numpy(float)
        chosen = [0]
        dist = lambda i: np.sqrt(((p - p[i]) ** 2).sum(axis=1))
        near = dist(0)
        while len(chosen) < min(k, len(p)):
            chosen.append(int((near * w).argmax()))
            near = np.minimum(near, dist(chosen[-1]))
        for _ in range(rounds):
            own = np.argmin([dist(i) for i in chosen], axis=0)
            after = []
            for m in range(len(chosen)):
                g = np.flatnonzero(own == m)
                if not len(g):
                    after.append(chosen[m])
                    continue
                # the best medoid of a group is near its weighted middle; candidates are the 64 nearest to it
                mid = (p[g] * w[g, None]).sum(axis=0) / w[g].sum()
                c = g[np.argsort(((p[g] - mid) ** 2).sum(axis=1), kind="stable")[:64]]
                cost = [(np.sqrt(((p[g] - p[i]) ** 2).sum(axis=1)) * w[g]).sum() for i in c]
                after.append(int(c[int(np.argmin(cost))]))
            if after == chosen:
                break
            chosen = after
        return t.iloc[chosen][[image, *channels]].assign(m=range(len(chosen)))[[image, "m", *channels]]

    kinds = dict(colours.dtypes)
    return colours.groupBy(image).applyInPandas(run, f"{image} {kinds[image]}, m int, " + ", ".join(f"{c} {kinds[c]}" for c in channels))
