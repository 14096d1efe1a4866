"""Training data: splits, virtual sample spaces, balanced batches. Randomness is a hash of keys, so it does not depend on partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of a batch by class.
MIX = {"pos": 6, "neg": 6, "pos_synth": 3, "neg_synth": 3}


def split_images(images: DataFrame, train: float = 0.65) -> DataFrame:
    """(dir, stem, split): of each folder's images of several fragments (``+`` in the name) the first ``train`` by path, and all others, train; the rest is val."""
    t = images.withColumn("multi", F.col("stem").contains("+"))
    by = Window.partitionBy("dir", "multi")
    t = t.withColumns({"rn": F.row_number().over(by.orderBy("stem")), "n": F.count("*").over(by)})
    return t.select("dir", "stem", F.when(F.col("multi") & (F.col("rn") > F.floor(F.col("n") * train)), "val").otherwise("train").alias("split"))


def labelled(parts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """The union of the parts with columns part and label."""
    return reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(name)).withColumn("label", F.lit(label)) for name, (df, label) in parts.items()])


def index_ranges(samples: DataFrame, order: list[str]) -> DataFrame:
    """(part, first, n): where each part begins when the parts follow each other in the given order."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("part"))
    n = samples.groupBy("part").agg(F.count("*").alias("n")).withColumn("place", place)
    return n.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("first"), "n")


def running(rows: DataFrame, key: str, value: Column, name: str, parts: int = 64, tie: str | None = None) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them in the order of the numeric ``key`` (equal keys in the order of ``tie``, or any).

    One window over everything would be one task. Here approximate quantiles cut the keys into ranges; each range has a window of its own and starts
    from the sum of the ranges before it: one number for each range.
    """
    edges = sorted(set(rows.select(F.col(key).cast("double").alias("k")).stat.approxQuantile("k", [i / parts for i in range(1, parts)], 0.005)))
    part = sum(((F.col(key) >= e).cast("int") for e in edges), F.lit(0))
    t = rows.withColumns({"_part": part, "_value": value})
    sums = {r["_part"]: r["s"] for r in t.groupBy("_part").agg(F.sum("_value").alias("s")).collect()}
    before, start = 0, []
    for k in range(len(edges) + 1):
        start.append(F.lit(before))
        before += sums.get(k, 0)
    order = Window.partitionBy("_part").orderBy(key, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    first = F.element_at(F.array(*[x.cast("long") for x in start]), F.col("_part") + 1)
    return t.withColumn(name, first + F.coalesce(F.sum("_value").over(order), F.lit(0))).drop("_part", "_value")


def stride_sample(rows: DataFrame, order: str, positives: int, negatives: int) -> DataFrame:
    """Every r-th row in the order of a numeric key, r = positives // negatives, up to negatives * r. ValueError if there are fewer positives than negatives."""
    if negatives <= 0 or positives // negatives < 1:
        raise ValueError("there must be at least as many positives as negatives")
    r = positives // negatives
    t = running(rows, order, F.lit(1), "idx")
    return t.where((F.col("idx") % r == 0) & (F.col("idx") < negatives * r))


def sample_space(patches: DataFrame, touches: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted indexes (idx) of the product patches x touches, without building it: patch idx div T, touch idx mod T. patches: (p, ...), touches: (t, ...) numbered from 0."""
    count = touches.agg(F.count("*").alias("T"))
    t = wanted.crossJoin(F.broadcast(count)).withColumns({"p": F.expr("idx div T"), "t": F.expr("idx % T")})
    return t.join(patches, "p").join(touches, "t").drop("T")


def partner(idx: Column, patches: Column, touches: Column) -> Column:
    """Patch index half the space away, with a float half: int(idx + L/2) mod L div T, L = patches * touches."""
    size = patches * touches
    return F.floor(F.floor(idx + size / F.lit(2.0)).cast("long") % size / touches).cast("long")


def ragged(lengths: DataFrame, order: str) -> DataFrame:
    """(order, n, first): offsets of consecutive parts of the given lengths n, in the order of a numeric key."""
    return running(lengths.select(order, "n"), order, F.col("n"), "first")


def balanced_batches(samples: DataFrame, batch: int = 24, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(class, id, batch): each batch takes a sixth pos, a sixth neg, a third of each synthetic class; what does not fill a batch of all classes is left out."""
    if batch % 6:
        raise ValueError(f"batch must be divisible by 6, not {batch}")
    quota = reduce(lambda c, k: c.when(F.col("class") == k, batch // MIX[k]), MIX, F.when(F.lit(False), 0))
    full = samples.groupBy("class").agg(F.count("*").alias("n")).withColumn("q", quota).agg(F.when(F.count("*") == len(MIX), F.min(F.floor(F.col("n") / F.col("q")))).otherwise(0).alias("batches")).first()[0]
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(epoch), "id"), 12)  # 52 bits: exact as a double
    # a window over a class would be one task, and there are four: rows are numbered range by range
    parts = [running(samples.where(F.col("class") == k).select("class", "id").withColumn("place", place), "place", F.lit(1), "rn", tie="id") for k in MIX]
    t = reduce(DataFrame.unionByName, parts).withColumn("batch", F.floor(F.col("rn") / quota))
    return t.where(F.col("batch") < full).select("class", "id", "batch")


def first_candidates(poses: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The first ``limit`` poses in the given order, for a quick look."""
    return poses.orderBy(*order).limit(limit)


def space_size(patches: DataFrame, touches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., samples): how many samples a virtual product of patches and touches has, without building it."""
    n = lambda t, c: t.groupBy(*keys).agg(F.count("*").alias(c))
    return n(patches, "p").join(n(touches, "t"), keys).select(*keys, (F.col("p") * F.col("t")).alias("samples"))


def jitter(key: Column, most: float, seed: int = 42) -> Column:
    """Uniform in -most..most by a hash of the key."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30)) * 2 - 1) * most
