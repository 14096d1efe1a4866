"""Reports over pair scores: score matrix, angle profile, piecewise-linear lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fragment_names(pairs: DataFrame) -> DataFrame:
    """(name): all fragments that occur in pairs (a, b), in order."""
    return pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().orderBy("name")


def score_matrix(scores: DataFrame) -> DataFrame:
    """(name_a, name_b, score): scores (a, b, score) both ways, with 1 on the diagonal. Absent pairs have no row."""
    both = scores.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), "score").unionByName(scores.select(F.col("b").alias("name_a"), F.col("a").alias("name_b"), "score"))
    names = fragment_names(scores)
    return both.where("name_a <> name_b").unionByName(names.select(F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(1.0).alias("score")))


def wide(matrix: DataFrame, names: list) -> DataFrame:
    """The matrix with a column for each of the given names."""
    return matrix.groupBy("name_a").pivot("name_b", names).agg(F.max("score"))


def angle_profile(means: DataFrame, keys: list[str], window: int = 5) -> DataFrame:
    """(keys..., translation_id, angle, score, smooth): means by angle from the y axis (mirrored for verso), with a centred moving sum over ``window``.

    The sum is divided by the window's size at the ends too: values beyond them count as 0. A profile of fewer rows than the window has as many values as the window, as
    a convolution of the longer with the shorter one: rows are added whose angle and score are null.
    """
    angle = F.degrees(F.atan2("tx", "ty")) * F.when(F.col("side") == "verso", -1).otherwise(1)
    order = Window.partitionBy(*keys).orderBy("angle", "translation_id")
    t = means.withColumn("angle", angle).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    smooth = F.sum("score").over(order.rowsBetween(-(window // 2), window // 2)) / window
    long = t.where(F.col("n") >= window).select(*keys, "translation_id", "angle", "score", smooth.alias("smooth"))
    rows = F.sort_array(F.collect_list(F.struct("angle", "translation_id", "score")))
    short = t.where(F.col("n") < window).groupBy(*keys).agg(rows.alias("rows")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    last = F.col("i") + F.floor((F.size("rows") - 1) / 2).cast("int")
    first = F.greatest(last - (window - 1), F.lit(0))
    part = F.slice("rows", first + 1, F.greatest(last - first + 1, F.lit(0)))
    total = F.aggregate(part, F.lit(0.0), lambda s, r: s + r["score"])
    own = F.get("rows", F.col("i"))
    return long.unionByName(short.select(*keys, own["translation_id"].alias("translation_id"), own["angle"].alias("angle"), own["score"].alias("score"), (total / window).alias("smooth")))


def name_index(names: DataFrame) -> DataFrame:
    """(name, idx): the names (name) with their places in order, from 0. Names of fragments are few."""
    return names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("idx"))


def indexed(matrix: DataFrame, index: DataFrame) -> DataFrame:
    """(i, j, score): the matrix (name_a, name_b, score) by places in place of names."""
    side = lambda c, o: index.select(F.col("name").alias(c), F.col("idx").alias(o))
    return matrix.join(side("name_a", "i"), "name_a").join(side("name_b", "j"), "name_b").select("i", "j", "score")


def lookup(knots: DataFrame, at: list[float], keys: list[str]) -> DataFrame:
    """(keys..., at, value): piecewise-linear value of the knots (keys..., x, v) at each ``at``; 0 outside them. Of equal x the first row's value (lowest v) counts."""
    once = knots.where("x IS NOT NULL").groupBy(*keys, "x").agg(F.min("v").alias("v"))
    order = Window.partitionBy(*keys).orderBy("x")
    seg = once.withColumns({"x1": F.lead("x").over(order), "v1": F.lead("v").over(order)})
    wanted = once.select(*keys).distinct().withColumn("at", F.explode(F.array(*[F.lit(float(a)) for a in at])))
    inside = ((F.col("at") >= F.col("x")) & (F.col("at") < F.col("x1"))) | (F.col("x1").isNull() & (F.col("at") == F.col("x")))
    value = F.when(F.col("x1").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("at") - F.col("x")) * (F.col("v1") - F.col("v")) / (F.col("x1") - F.col("x")))
    found = wanted.join(seg, keys).where(inside).select(*keys, "at", value.alias("value"))
    return wanted.join(found, [*keys, "at"], "left").select(*keys, "at", F.coalesce("value", F.lit(0.0)).alias("value"))
