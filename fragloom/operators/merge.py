"""From patch scores to merged grids of the two sides.

Patch scores: (pair_id, side, translation_id, patch_idx, score, ty, tx). Everything is keyed by pair; only the interpolation of
scattered translations needs a grouped kernel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIR_SIDE = ["pair_id", "side"]


def by_translation(scores: DataFrame) -> DataFrame:
    """(pair_id, side, translation_id, score, ty, tx): the mean of each translation's patches, and its place (constant in it)."""
    return scores.groupBy(*PAIR_SIDE, "translation_id").agg(F.avg(F.col("score").cast("double")).alias("score"), *[F.min_by(c, "patch_idx").alias(c) for c in ("ty", "tx")])


def best_per_pair(means: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, side, best): the highest mean of each pair; 0 for a pair without scores."""
    best = means.groupBy(*PAIR_SIDE).agg(F.max("score").alias("best"))
    return pairs.join(best, PAIR_SIDE, "left").select(*PAIR_SIDE, F.coalesce("best", F.lit(0.0)).alias("best"))


def bounds(means: DataFrame) -> DataFrame:
    """(pair_id, y0, y1, x0, x1): the range of the translations of both sides; a range of no width is widened by 1e-6."""
    b = means.groupBy("pair_id").agg(*[f(c).alias(f"{c[1]}{k}") for c in ("ty", "tx") for k, f in ((0, F.min), (1, F.max))])
    return b.select("pair_id", *[e for v in "yx" for e in (F.col(f"{v}0"), F.when(F.col(f"{v}1") == F.col(f"{v}0"), F.col(f"{v}1") + 1e-6).otherwise(F.col(f"{v}1")).alias(f"{v}1"))])


def grid_size(height: Column, width: Column, cell: int = 64) -> tuple[Column, Column]:
    """(ny, nx): whole cells of the picture of fragment a."""
    return F.floor(height / cell).cast("int"), F.floor(width / cell).cast("int")


def grid(ranges: DataFrame) -> DataFrame:
    """(pair_id, ny, nx, iy, ix, gy, gx): evenly spaced cells over y0..y1, x0..x1; none if ny or nx is 0. ranges: bounds with ny, nx."""
    t = ranges.where("ny > 0 AND nx > 0").withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    at = lambda v: F.when(F.col(f"n{v}") == 1, F.col(f"{v}0")).otherwise(F.col(f"{v}0") + F.col(f"i{v}") * ((F.col(f"{v}1") - F.col(f"{v}0")) / (F.col(f"n{v}") - 1)))
    return t.select("pair_id", "ny", "nx", "iy", "ix", at("y").alias("gy"), at("x").alias("gx"))


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three indexes) of the Delaunay triangulation, by inserting the points one after the other.

    Where four points lie on one circle the triangulation is not unique; the order of the points decides. Empty for fewer than
    three points or points on one line.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    span = max(np.ptp(points, axis=0).max(), 1e-12)
    mid = (points.max(axis=0) + points.min(axis=0)) / 2
    far = 1e5
    p = np.vstack([(points - mid) / span, [[-far, -far], [far, -far], [0.0, far]]])
    tri = np.array([[n, n + 1, n + 2]])
    centre, r2 = _circles(p, tri)
    for k in range(n):
        bad = ((p[k] - centre) ** 2).sum(axis=1) < r2 * (1 - 1e-12)
        edges = np.sort(np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), axis=1)
        once, count = np.unique(edges, axis=0, return_counts=True)
        new = np.column_stack([once[count == 1], np.full((count == 1).sum(), k)])
        c, r = _circles(p, new)
        tri, centre, r2 = np.vstack([tri[~bad], new]), np.vstack([centre[~bad], c]), np.concatenate([r2[~bad], r])
    return tri[(tri < n).all(axis=1)]


def _circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    u, v = b - a, c - a
    det = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        o = np.column_stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu]) / det[:, None]
    return a + o, np.where(det == 0, np.inf, (o * o).sum(axis=1))


def interpolate(points: np.ndarray, values: np.ndarray, at: np.ndarray, eps: float = 1e-9, block: int = 1 << 20) -> np.ndarray:
    """Piecewise linear interpolation over the Delaunay triangles; 0 outside their hull. All triangles at once, ``block`` pairs of a place and a triangle at a time."""
    out = np.zeros(len(at))
    tri = delaunay(points)
    if not len(tri):
        return out
    a, u, v = points[tri[:, 0]], points[tri[:, 1]] - points[tri[:, 0]], points[tri[:, 2]] - points[tri[:, 0]]
    det = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    tri, a, u, v, det = (x[det != 0] for x in (tri, a, u, v, det))
    step = max(1, block // max(len(tri), 1))
    for k in range(0, len(at) if len(tri) else 0, step):
        d = at[k : k + step, None, :] - a[None]
        two = (d[..., 0] * v[:, 1] - d[..., 1] * v[:, 0]) / det
        three = (u[:, 0] * d[..., 1] - u[:, 1] * d[..., 0]) / det
        one = 1 - two - three
        inside = (one >= -eps) & (two >= -eps) & (three >= -eps)
        first = inside.argmax(axis=1)
        row = np.flatnonzero(inside[np.arange(len(first)), first])
        t = first[row]
        out[k + row] = one[row, t] * values[tri[t, 0]] + two[row, t] * values[tri[t, 1]] + three[row, t] * values[tri[t, 2]]
    return out


def interpolated(cells: DataFrame, means: DataFrame) -> DataFrame:
    """The cells with the column s of each side: (pair_id, side, ny, nx, iy, ix, gy, gx, s, status).

    Equal translations count once, with the lowest id. ``status`` is ``degenerate`` where fewer than three translations that are not on one
    line exist; such a side is 0 everywhere.
    """
    names = ["pair_id", "side", "ny", "nx", "iy", "ix", "gy", "gx", "s", "status"]

    def run(key, c: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("translation_id").drop_duplicates(["ty", "tx"])
        p = m[["ty", "tx"]].to_numpy()
        flat = len(p) < 3 or np.linalg.matrix_rank(p - p[0], tol=1e-9 * max(np.ptp(p), 1e-300)) < 2
        s = np.zeros(len(c)) if flat else interpolate(p, m["score"].to_numpy(), c[["gy", "gx"]].to_numpy())
        return c.assign(s=s, status="degenerate" if flat else "ok")[names]

    sides = means.select(*PAIR_SIDE).distinct()
    both = cells.join(sides, "pair_id")
    schema = f"pair_id {dict(cells.dtypes)['pair_id']}, side string, ny int, nx int, iy int, ix int, gy double, gx double, s double, status string"
    known = means.select(F.col("pair_id").alias("of_pair"), F.col("side").alias("of_side"), "translation_id", "score", "ty", "tx")
    return both.groupBy(*PAIR_SIDE).cogroup(known.groupBy("of_pair", "of_side")).applyInPandas(run, schema)


def mirrored_sum(scored: DataFrame) -> DataFrame:
    """(pair_id, nx, iy, ix, gy, gx, s_recto, s_verso, s_sum): verso columns are read backwards, as its picture is seen from behind."""
    flip = F.when(F.col("side") == "verso", F.col("nx") - 1 - F.col("ix")).otherwise(F.col("ix"))
    t = scored.withColumn("jx", flip).groupBy("pair_id", "nx", "iy", "jx")
    s = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("s"))), F.lit(0.0)).alias(f"s_{side}")
    t = t.agg(s("recto"), s("verso")).withColumnRenamed("jx", "ix").withColumn("s_sum", F.col("s_recto") + F.col("s_verso"))
    at = scored.groupBy("pair_id", "iy", "ix").agg(F.min("gy").alias("gy"), F.min("gx").alias("gx"))
    return t.join(at, ["pair_id", "iy", "ix"])


def discrepancies(cells: DataFrame) -> DataFrame:
    """(pair_id, discrepancy): mean difference of the sides over cells where either has a score; 0 without such cells."""
    some = (F.col("s_recto") != 0) | (F.col("s_verso") != 0)
    return cells.groupBy("pair_id").agg(F.coalesce(F.avg(F.when(some, F.abs(F.col("s_recto") - F.col("s_verso")))), F.lit(0.0)).alias("discrepancy"))


def top_cells(cells: DataFrame, k: int = 5) -> DataFrame:
    """(pair_id, rank, iy, ix, gy, gx, s_sum, angle): the k best cells of each pair, later cells first on ties; zero scores are left out after the cut."""
    order = Window.partitionBy("pair_id").orderBy(F.desc("s_sum"), F.desc(F.col("iy") * F.col("nx") + F.col("ix")))
    t = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return t.where("s_sum <> 0").select("pair_id", "rank", "iy", "ix", "gy", "gx", "s_sum", F.degrees(F.atan2("gx", "gy")).alias("angle"))


def nearest_cell(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The points (pair_id, ty, tx, ...) with the nearest grid cell (iy, ix): by arithmetic, the grid being rectilinear; the lower index on ties."""

    def index(v: str) -> Column:
        n, low, high = F.col(f"n{v}"), F.col(f"{v}0"), F.col(f"{v}1")
        step = (high - low) / (n - 1)
        i = F.ceil((F.col(f"t{v}") - low) / step - 0.5)
        return F.when(n == 1, 0).otherwise(F.greatest(F.lit(0), F.least(i.cast("int"), n - 1))).alias(f"i{v}")

    return points.join(ranges.where("ny > 0 AND nx > 0"), "pair_id").select(*points.columns, index("y"), index("x"))


def nearest_translation(cells: DataFrame, means: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(pair_id, side, iy, ix, tid): the translation nearest to each cell, the lowest on ties, 0 if a side has none. Not mirrored.

    A pair's cells and translations meet in one kernel, ``block`` distances at a time; no row is made for each of them.
    """
    kinds = dict(cells.dtypes)

    def run(key, c: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = []
        for side in ("recto", "verso"):
            t = m[m["of_side"] == side].sort_values("translation_id")
            tid = np.zeros(len(c), np.int64)
            if len(t):
                ty, tx, ids = (t[n].to_numpy() for n in ("ty", "tx", "translation_id"))
                step = max(1, block // len(t))
                for k in range(0, len(c), step):
                    gy, gx = (c[n].to_numpy()[k : k + step, None] for n in ("gy", "gx"))
                    tid[k : k + step] = ids[((gy - ty) ** 2 + (gx - tx) ** 2).argmin(axis=1)]
            out.append(c[["pair_id", "iy", "ix"]].assign(side=side, tid=tid))
        return pd.concat(out)[["pair_id", "side", "iy", "ix", "tid"]]

    known = means.select(F.col("pair_id").alias("of_pair"), F.col("side").alias("of_side"), "translation_id", "ty", "tx")
    grid = cells.select("pair_id", "iy", "ix", "gy", "gx")
    return grid.groupBy("pair_id").cogroup(known.groupBy("of_pair")).applyInPandas(run, f"pair_id {kinds['pair_id']}, side string, iy int, ix int, tid int")


def top_of_pair(cells: DataFrame, pair_id, k: int = 5) -> DataFrame:
    """(iy, ix, gy, gx, s_sum, angle): the k best cells of one pair, zeros included, later cells first on ties."""
    t = cells.where(F.col("pair_id") == pair_id).orderBy(F.desc("s_sum"), F.desc(F.col("iy") * F.col("nx") + F.col("ix"))).limit(k)
    return t.select("iy", "ix", "gy", "gx", "s_sum", F.degrees(F.atan2("gx", "gy")).alias("angle"))


def suffixed(table: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    """The table with ``suffix`` after the name of each column that is no key."""
    return table.withColumnsRenamed({c: f"{c}_{suffix}" for c in table.columns if c not in keys})
