"""End to end: from outlines or pictures to the best relative position of every pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.operators import contour, merge, pairs, patches, pose, score
from fragloom.sources import images, tables


def positions(points: DataFrame, spacing: float = 100.0, pad: float = pose.PAD) -> DataFrame:
    """All poses without overlap of all pairs of one image's fragments. points: contour points."""
    samples = contour.arc_samples(points, spacing)
    fragments = points.select("frag_id", "image_id").distinct()
    c = pose.candidates(pairs.all_pairs(fragments, "image_id"), samples, contour.centroids(points), pad)
    return pose.without_overlap(c, contour.nested(points))


def scored_positions(points: DataFrame, spacing: float = 100.0, pad: float = pose.PAD) -> DataFrame:
    """(a, b, translation_id, ty, tx, n, score): each pose with its neighbouring contacts and the model-free score."""
    p = positions(points, spacing, pad)
    near = pose.near_contacts(p, contour.arc_samples(points, spacing))
    return score.distance_score(p, near, ["a", "b", "translation_id"])


def best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, translation_id, ty, tx, score): the best pose of every pair; the lowest id on ties."""
    s = scored_positions(tables.contour_point(spark, sf_dir))
    best = s.groupBy("a", "b").agg(F.max_by(F.struct("translation_id", "ty", "tx", "score"), F.struct(F.round("score", 9), -F.col("translation_id"))).alias("m"))
    return best.select("a", "b", "m.translation_id", "m.ty", "m.tx", F.round("m.score", 6).alias("score"))


def outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Contour points of all scans of a folder; side takes the place of the image: fragments of one side are paired."""
    c = images.contours(images.scan(spark, folder)).where(F.size("points") > 0)
    return c.select("frag_id", F.col("side").alias("image_id"), F.posexplode("points").alias("k", "p")).select("frag_id", "image_id", "k", "p.y", "p.x")


def merged_tables(scores: DataFrame, sizes: DataFrame, consistent_mirror: bool = False) -> dict[str, DataFrame]:
    """The merge of both sides: cells, pairs (with their discrepancy), top cells, and patches with their nearest cell.

    sizes: (pair_id, height, width) of fragment a's picture. Cells name the nearest translation of each side; the verso's is read
    unmirrored unless ``consistent_mirror`` is set, which reads it as the scores are read.
    """
    means = merge.by_translation(scores)
    ny, nx = merge.grid_size(F.col("height"), F.col("width"))
    ranges = merge.bounds(means).join(sizes, "pair_id").withColumns({"ny": ny, "nx": nx})
    grid = merge.grid(ranges)
    cells = merge.mirrored_sum(merge.interpolated(grid, means))
    near = merge.nearest_translation(grid, means).join(grid.select("pair_id", "iy", "ix", "nx"), ["pair_id", "iy", "ix"])
    if consistent_mirror:
        near = near.withColumn("ix", F.when(F.col("side") == "verso", F.col("nx") - 1 - F.col("ix")).otherwise(F.col("ix")))
    tid = lambda s: F.max(F.when(F.col("side") == s, F.col("tid"))).alias(f"tid_{s}")
    cells = cells.join(near.groupBy("pair_id", "iy", "ix").agg(tid("recto"), tid("verso")), ["pair_id", "iy", "ix"])
    return {"cell": cells, "pair": ranges.join(merge.discrepancies(cells), "pair_id", "left"), "top": merge.top_cells(cells), "patch": merge.nearest_cell(scores, ranges)}


def write_merged(tables: dict[str, DataFrame], path: str, recto: DataFrame | None = None, verso: DataFrame | None = None) -> None:
    """Write the merged tables, a folder for each; what the two sides' runs are described by (pair_id, ...) goes to ``about``, each side's columns under its own names."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    if recto is not None and verso is not None:
        about = merge.suffixed(recto, "recto", ["pair_id"]).join(merge.suffixed(verso, "verso", ["pair_id"]), "pair_id", "full_outer")
        about.write.mode("overwrite").parquet(f"{path}/about")


def read_merged(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``write_merged`` wrote."""
    names = [n for n in ("cell", "pair", "top", "patch", "about") if images.exists(spark, f"{path}/{n}")]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def compute(spark: SparkSession, folder: str, out: str, make_model: Callable[[], score.Model] = score.baseline, spacing: float = 100.0, pad: float = pose.PAD, side: int = 224, net_side: int = 224) -> DataFrame:
    """Score the patches of all pairs of scans of one side, and write ``out``/scores and ``out``/status; returns the status of all pairs.

    Pairs that have a status already, but for failed ones, are left alone, so a run that was stopped goes on where it was.
    """
    scans = images.scan(spark, folder)
    points = outlines(spark, folder)
    every = pairs.all_pairs(scans.select("frag_id", "side"), "side")
    before = spark.read.parquet(f"{out}/status") if images.exists(spark, f"{out}/status") else None
    todo = patches.unfinished(every, before) if before is not None else every
    poses = positions(points, spacing, pad).join(todo.select("a", "b"), ["a", "b"], "left_semi")
    contacts = pose.neighbours(poses, contour.arc_samples(points, spacing))
    sides = points.select(F.col("frag_id").alias("a"), F.col("image_id").alias("side")).distinct()
    results = patches.scored(scans, contacts.join(sides, "a"), make_model, side, net_side)
    results.write.mode("overwrite").parquet(f"{out}/results")  # both tables below come from one run of the kernel
    results = spark.read.parquet(f"{out}/results")
    images.write_scores(patches.scores_of(results), f"{out}/scores")
    unread = scans.where("status <> 'ok'").select(F.col("frag_id").alias("f"), F.col("side").alias("s"))
    state = patches.status_of(todo, results).join(unread, (F.col("s") == F.col("side")) & F.col("f").isin(F.col("a"), F.col("b")), "left")
    state = state.withColumn("status", F.when(F.col("f").isNotNull(), "unreadable").otherwise(F.col("status"))).select("a", "b", "side", "status", "error").distinct()
    state.write.mode("append").parquet(f"{out}/status")
    return spark.read.parquet(f"{out}/status").groupBy("a", "b", "side").agg(F.max_by("status", F.col("status") != "failed").alias("status"), F.max("error").alias("error"))
