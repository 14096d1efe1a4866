"""Pairs made by tiles: the rows of the table operators, whatever the blocks, and no table of pairs on the way."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fragloom.operators import contour, pairs, pose, raster, tiles
from fragloom.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["contact_candidates", "candidate_limit", "pose_delta", "mutual_nearest", "neighbour_contacts", "pose_overlap", "patch_offsets"])
def test_no_pairs_are_shuffled(spark, name):
    assert "Join" not in entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_make_the_rows_of_the_operators(spark):
    points = tables.contour_point(spark, SF).where("frag_id % 9 = 0").cache()
    both = pairs.all_pairs(points.select("frag_id", "image_id").distinct(), "image_id")
    samples = contour.arc_samples(points)
    c = pose.candidates(both, samples, contour.centroids(points)).cache()
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    near = pose.near_contacts(c, samples).groupBy("a", "b", "ia", "ib").agg(F.count("*").alias("n")).groupBy("a", "b").agg(F.sum("n"), F.count("*"))
    apart = pose.without_overlap(c, contour.nested(points)).groupBy("a", "b").agg(F.count("*"), F.max("translation_id"))
    side = lambda s: both.select("a", "b").join(points.select(F.col("frag_id").alias(s), "k", "y", "x"), s)
    want = {
        "n bigint, ty double": rows(c.groupBy("a", "b").agg(F.count("*"), F.max("ty"))),
        "n bigint, poses bigint": rows(near),
        "n bigint, last int": rows(apart),
        "y int, x int": rows(pose.mutual_nearest(side("a"), side("b"), 5.0, ["a", "b"])),
    }
    kernels = [tiles.of_poses(lambda p: {"ty": p.most(p.ty)}), tiles.neighbours(100.0), tiles.free, tiles.nearest(5.0)]
    fragments = tiles.framed(points, True).cache()
    for block in (3, 1000):
        for kernel, (schema, expected) in zip(kernels, want.items()):
            assert rows(tiles.dealt(fragments, kernel, f"a bigint, b bigint, {schema}", block)) == expected, (schema, block)


def test_directions_are_those_of_sql(spark):
    """Nearly along an axis, a hypotenuse and the root of the sum of squares differ in the last bit; multiplied and cut to integers they give other offsets."""
    rng = np.random.default_rng(3)
    uy, ux = rng.uniform(50, 200, 200_000), 10 ** rng.uniform(-7, -5, 200_000)
    odd = np.flatnonzero(uy / np.hypot(uy, ux) != uy / np.sqrt(uy * uy + ux * ux))[:20]
    assert len(odd) == 20
    flat = spark.createDataFrame([(2 * i, 0.0, 0.0) for i in range(20)] + [(2 * i + 1, float(uy[k]), float(ux[k])) for i, k in enumerate(odd)], "frag_id long, cy double, cx double")
    samples = flat.select("frag_id", F.lit(0).alias("m"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"))
    both = spark.range(20).selectExpr("2 * id AS a", "2 * id + 1 AS b")
    got = {r["a"] // 2: r["dy"] for r in pose.candidates(both, samples, flat).collect()}
    assert [got[i] for i in range(20)] == (uy[odd] / np.sqrt(uy[odd] * uy[odd] + ux[odd] * ux[odd])).tolist()


def test_free_windows_are_those_of_the_tables(spark):
    """Pictures of several sizes, too small ones among them; nothing is joined or broadcast."""
    rng = np.random.default_rng(8)
    rows = [(i, y, x, int(rng.integers(0, 2)) * 255, int(rng.integers(0, 60))) for i in range(40) for y in range(3 + i % 5) for x in range(4 + i % 3)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, alpha int, v int").repartition(3)
    images = px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    sums = lambda c: raster.integral(px.withColumn("n", c.cast("int")), "n")
    for stride in (1, 2):
        want = raster.available_windows(raster.lattice(images, 4, stride), sums(F.col("alpha") > 128), sums(F.col("v") < 2), 4, 0.3).select("image_id", "y0", "x0")
        got = raster.free_windows(px, F.col("alpha") > 128, F.col("v") < 2, 4, stride, 0.3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    assert "Join" not in entry.queries()["window_availability"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def tile(shapes, own=None, samples=None):
    """A tile of outlines as points (y, x), of two blocks if ``own`` says which is of which."""
    lists = lambda v: pa.array([list(map(float, p)) for p in v], pa.list_(pa.float64()))
    own = np.zeros(len(shapes), np.int64) if own is None else np.asarray(own)
    y, x = ([p[:, c] for p in shapes] for c in (0, 1))
    sy, sx = ([p[:, c] for p in samples or shapes] for c in (0, 1))
    centre = [np.array([p[:, c].mean() for p in shapes]) for c in (0, 1)]
    zero = np.zeros(len(shapes), np.int64)
    return tiles.Tile(pa.table({"frag_id": np.arange(len(shapes)) * 3 + 5, "image_id": zero, "own": own, "low": zero, "high": zero + own.max(), "cy": centre[0], "cx": centre[1], "sy": lists(sy), "sx": lists(sx), "py": lists(y), "px": lists(x)}))


def ring(rng, n=64):
    r, turn = 100 * (1 + rng.normal(0, 0.125, n)), 2 * np.pi * np.arange(n) / n
    return np.column_stack([r * np.sin(turn), r * np.cos(turn)])


def collected(kernel, t):
    """The kernel's rows, sorted."""
    return sorted(row for c in kernel(t) for row in zip(*(np.asarray(v).tolist() for v in c.values())))


def nearest_one_by_one(t, shapes, tolerance):
    rows = set()
    for i, p in enumerate(shapes):
        for j, q in enumerate(shapes):
            if not (i < j and (not t.across or t.own[i] != t.own[j])):
                continue
            with np.errstate(all="ignore"):
                d = np.sqrt((p[:, None, 0] - q[None, :, 0]) ** 2 + (p[:, None, 1] - q[None, :, 1]) ** 2)
            d[~(d < tolerance)] = np.inf
            best = {(k, int(r.argmin())) for k, r in enumerate(d) if r.min() < np.inf} | {(int(c.argmin()), k) for k, c in enumerate(d.T) if c.min() < np.inf}
            rows |= {(int(t.ids[i]), int(t.ids[j]), *(int(np.floor((p[ka, v] + q[kb, v]) / 2)) for v in (0, 1))) for ka, kb in best}
    return sorted(rows)


@pytest.mark.parametrize("tolerance", [0.5, 5.0, 40.0])
@pytest.mark.parametrize("across", [False, True])
def test_nearest_like_one_by_one(tolerance, across):
    """Ties, points at just the tolerance, copies, sparse and dense outlines, far and missing points."""
    rng = np.random.default_rng(4)
    grid = np.array([[y, x] for y in range(-10, 11, 5) for x in range(-10, 11, 5)], float)
    odd = ring(rng)
    odd[::7] = [[1e22, 3], [np.nan, 0], [np.inf, 1], [-1e15, -1e15], [5, np.nan], [0, -np.inf], [1e9, 0], [0, 1e9], [0, 0], [1e9 + 2, 0]]
    shapes = [ring(rng), odd, grid, grid + 2.5, grid + (5, 0), ring(rng, 7), ring(rng, 200), rng.uniform(-20, 20, (90, 2)), odd.copy(), grid * 1000]
    t = tile(shapes, [0, 1, 1, 0, 1, 0, 0, 1, 0, 1] if across else None)
    few = lambda rows: [r for r in rows if max(map(abs, r)) < 2**31]  # noqa: E731 beyond, there is no integer
    got = collected(tiles.nearest(tolerance), t)
    assert few(got) == few(nearest_one_by_one(t, shapes, tolerance)) and got


def test_nearest_looks_at_near_points_only():
    """All 64 x 64 distances of 180,000 pairs take 10 CPU seconds."""
    rng = np.random.default_rng(2)
    t = tile([ring(rng) for _ in range(600)])
    began = time.process_time()
    assert sum(len(c["a"]) for c in tiles.nearest(5.0)(t)) > 1_000_000
    assert time.process_time() - began < 4


def near_one_by_one(t, shapes, radius, pad=20.0):
    rows = []
    for i, p in enumerate(shapes):
        for j, q in enumerate(shapes):
            if i >= j:
                continue
            with np.errstate(all="ignore"):
                between = p[:, None] - q[None]
                u = np.stack([t.centre[c][j] + p[:, None, c] - q[None, :, c] - t.centre[c][i] for c in (0, 1)], axis=2)
                far = np.sqrt(u[..., 0] * u[..., 0] + u[..., 1] * u[..., 1])[..., None]
                moves = (between + pad * (u / far))[far[..., 0] > 0]
                d = between.reshape(1, -1, 2) - moves[:, None]
                near = np.sqrt(d[..., 0] ** 2 + d[..., 1] ** 2) < radius
            if near.any():
                rows.append((int(t.ids[i]), int(t.ids[j]), int(near.sum()), int(near.any(axis=1).sum())))
    return rows


@pytest.mark.parametrize("radius", [5.0, 20.0, 60.0, 100.0])
def test_near_contacts_like_one_by_one(radius):
    """Distances of just the radius, few and many samples, points that are missing, very far or all the same, centres that coincide."""
    rng = np.random.default_rng(7)
    grid = np.array([[y, x] for y in (0, 20, 60, 100) for x in (0, 100)], float)
    odd = ring(rng, 9)
    odd[::4] = [[np.nan, 1], [1e9, 0], [np.inf, 0]]
    shapes = [ring(rng, 8), ring(rng, 7), ring(rng, 1), ring(rng, 16), ring(rng, 19)[:19], grid, grid + (0, 100), grid * 0, odd, ring(rng, 8) * 1e6, ring(rng, 8) * 50]
    for some in (slice(0, 8), slice(2, 4), slice(0, 11), slice(5, 11)):  # what is far is met by all of a batch
        t = tile(shapes[some])
        t.centre = [np.where(np.isfinite(c), c, 3.0) for c in t.centre]
        # a missing sample is none, as in ``Tile``
        want = near_one_by_one(t, [np.column_stack([s[k] for s in t.sample]) for k in range(len(t.ids))], radius)
        assert collected(tiles.neighbours(radius), t) == want, some


def test_near_contacts_are_not_tried_one_by_one(monkeypatch):
    """All distances of a pair in double precision take 15 CPU microseconds; only those of pairs with one at just the radius are needed."""
    rng = np.random.default_rng(8)
    t = tile([ring(rng, 8) for _ in range(120)])
    tried, count = [], np.count_nonzero
    monkeypatch.setattr(np, "count_nonzero", lambda v, *args, **named: tried.append(np.size(v)) or count(v, *args, **named))
    assert sum(len(c["a"]) for c in tiles.neighbours(100.0)(t)) == 120 * 119 // 2
    assert sum(tried) < 0.1 * 64 * 64 * 120 * 119 / 2
