import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fragloom.operators import merge, metrics, pairs, report, sampling
from fragloom.plans import matching

SCHEMA = "pair_id long, side string, translation_id int, patch_idx int, score double, ty double, tx double"


def scores(spark, sets):
    rows = [(p, s, i, 0, float(v), float(y), float(x)) for (p, s), pts in sets.items() for i, (y, x, v) in enumerate(pts)]
    return spark.createDataFrame(rows, SCHEMA)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000), st.integers(4, 40))
def test_interpolation_of_a_plane(seed, n):
    rng = np.random.default_rng(seed)
    p = rng.random((n, 2)) * 100
    f = lambda q: 3 + 0.5 * q[:, 0] - 2 * q[:, 1]
    inner = p.mean(axis=0) + (p - p.mean(axis=0)) * 0.5
    assert np.allclose(merge.interpolate(p, f(p), inner), f(inner), atol=1e-6)
    assert merge.interpolate(p, f(p), np.array([[1e4, 1e4]]))[0] == 0


def test_triangles_have_empty_circles():
    p = np.random.default_rng(3).random((30, 2))
    t = merge.delaunay(p)
    o, r2 = merge._circles(p, t)
    for c, r in zip(o, r2):
        assert (((p - c) ** 2).sum(axis=1) >= r * (1 - 1e-9)).all()
    hull_and_inner = 2 * len(p) - 2
    assert len(t) <= hull_and_inner


def test_merge_of_two_sides(spark):
    pts = [(0, 0, 1), (0, 10, 2), (10, 0, 3), (10, 10, 4), (4, 5, 2.5)]
    line = [(0, 0, 1), (1, 1, 1), (2, 2, 1)]
    t = scores(spark, {(1, "recto"): pts, (1, "verso"): pts, (2, "recto"): line, (2, "verso"): line, (3, "recto"): [(5, 5, 1)], (3, "verso"): [(5, 5, 1)], (4, "recto"): pts, (4, "verso"): pts})
    sizes = spark.createDataFrame([(1, 192, 192), (2, 192, 192), (3, 128, 128), (4, 63, 640)], "pair_id long, height int, width int")
    out = matching.merged_tables(t, sizes)
    cells = {(r["pair_id"], r["iy"], r["ix"]): r for r in out["cell"].collect()}
    assert sum(k[0] == 1 for k in cells) == 9
    assert cells[1, 0, 0]["s_recto"] == pytest.approx(1) and cells[1, 0, 0]["s_verso"] == pytest.approx(2)
    assert cells[1, 0, 0]["tid_recto"] == 0 and cells[1, 0, 0]["tid_verso"] == 0
    assert cells[1, 1, 1]["s_sum"] == pytest.approx(cells[1, 1, 1]["s_recto"] * 2)
    assert all(r["s_sum"] == 0 for k, r in cells.items() if k[0] in (2, 3))
    assert not any(k[0] == 4 for k in cells)
    pair = {r["pair_id"]: r for r in out["pair"].collect()}
    assert pair[3]["y1"] == pytest.approx(5 + 1e-6) and pair[3]["x1"] - 5 == pytest.approx(1e-6, rel=1e-3)
    assert pair[2]["discrepancy"] == 0
    top = out["top"].where("pair_id = 1").orderBy("rank").collect()
    assert len(top) == 5 and top[0]["s_sum"] == max(r["s_sum"] for r in top)
    assert out["top"].where("pair_id = 2").count() == 0
    near = {(r["ty"], r["tx"]): (r["iy"], r["ix"]) for r in out["patch"].where("pair_id = 1 AND side = 'recto'").collect()}
    assert near[4, 5] == (1, 1) and near[10, 10] == (2, 2)
    other = matching.merged_tables(t, sizes, consistent_mirror=True)["cell"].where("pair_id = 1 AND iy = 0 AND ix = 0").first()
    assert other["tid_verso"] == 1


def test_mirror_is_an_involution(spark):
    t = spark.createDataFrame([(1, s, 4, iy, ix, 0.0, 0.0, float(10 * iy + ix)) for s in ("recto", "verso") for iy in range(2) for ix in range(4)], "pair_id long, side string, nx int, iy int, ix int, gy double, gx double, s double")
    m = merge.mirrored_sum(t)
    again = merge.mirrored_sum(m.select("pair_id", F.lit("verso").alias("side"), "nx", "iy", "ix", "gy", "gx", F.col("s_verso").alias("s")))
    assert {(r["iy"], r["ix"]): r["s_verso"] for r in again.collect()} == {(iy, ix): float(10 * iy + ix) for iy in range(2) for ix in range(4)}


@pytest.mark.parametrize("values", [(1,), (1, 2), (1, 2, 3), (4, 1, 7, 2), (1, 2, 3, 4, 5), (3, 1, 4, 1, 5, 9, 2)])
def test_moving_average_at_the_ends(spark, values):
    """As numpy's convolution of the profile and the window, which has the length of the longer one."""
    t = spark.createDataFrame([(1, "recto", i, float(v), 1.0, float(i)) for i, v in enumerate(values)], "pair_id long, side string, translation_id int, score double, ty double, tx double")
    got = report.angle_profile(t, ["pair_id", "side"]).orderBy(F.col("angle").asc_nulls_last(), F.desc("smooth")).collect()
    want = np.convolve(values, np.ones(5) / 5, mode="same").tolist()
    assert [r["smooth"] for r in got[: len(values)]] == pytest.approx(want[: len(values)])
    assert sorted(r["smooth"] for r in got) == pytest.approx(sorted(want))
    if values == (1, 2, 3):
        assert sorted(r["smooth"] for r in got) == pytest.approx([0.6, 1.0, 1.2, 1.2, 1.2])


def test_side_names_by_prefix(spark):
    recto = spark.createDataFrame([("1", "22"), ("10", "22"), ("x", "y")], "a string, b string")
    verso = spark.createDataFrame([("1_back", "22_back"), ("10_back", "22_back"), ("10_back", "2_back"), (None, "y_back")], "a string, b string")
    got = {(r["a"], r["b"]): (r["verso_a"], r["verso_b"]) for r in pairs.match_sides(recto, verso).collect()}
    assert got == {("1", "22"): ("10_back", "22_back"), ("10", "22"): ("10_back", "22_back")}
    assert pairs.match_sides(recto.limit(0), verso).count() == 0


def test_all_pairs_of_one_large_group(spark):
    t = spark.range(150).select(F.col("id").alias("frag_id"), F.lit("recto").alias("side"))
    got = {(r["a"], r["b"]) for r in pairs.all_pairs(t, "side").collect()}
    assert got == {(a, b) for b in range(150) for a in range(b)}


def test_lookup(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0), (1, 20.0, 0.0)], "g long, x double, v double")
    got = {r["at"]: r["value"] for r in report.lookup(t, [-1.0, 0.0, 5.0, 10.0, 19.0, 20.0, 21.0], ["g"]).collect()}
    assert got == pytest.approx({-1: 0, 0: 0, 5: 2.5, 10: 5, 19: 0.5, 20: 0, 21: 0})


def test_matrix(spark):
    t = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.2)], "a string, b string, score double")
    wide = {r["name_a"]: r for r in report.wide(report.score_matrix(t), ["a", "b", "c"]).collect()}
    assert wide["a"]["a"] == 1 and wide["b"]["a"] == 0.5 and wide["b"]["c"] is None


def test_auroc(spark):
    t = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "s double, y int")
    assert metrics.auroc(t, "s", "y").first()[0] == pytest.approx(0.875)
    assert metrics.auroc(t.where("y = 1"), "s", "y").first()[0] is None


def test_parameter_counts(spark):
    t = spark.createDataFrame([("stem", 30, True), ("body", 70, False)], "name string, n long, requires_grad boolean")
    assert tuple(metrics.parameter_counts(t).first()) == (30, 100, 30.0)


def test_splits(spark):
    t = spark.createDataFrame([("d", f"{i}+b") for i in range(10)] + [("d", f"s{i}") for i in range(3)], "dir string, stem string")
    n = {r["split"]: r["n"] for r in sampling.split_images(t).where("stem LIKE '%+%'").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 6, "val": 4}
    assert sampling.split_images(t).where("stem LIKE 's%' AND split = 'val'").count() == 0


def test_batches(spark):
    with pytest.raises(ValueError):
        sampling.balanced_batches(None, 32)
    t = spark.createDataFrame([(i, c) for c, n in (("pos", 9), ("neg", 20), ("pos_synth", 17), ("neg_synth", 40)) for i in range(n)], "id long, class string")
    rows = sampling.balanced_batches(t, 24).groupBy("batch", "class").count().collect()
    assert {(r["batch"], r["class"]): r["count"] for r in rows} == {(b, c): n for b in (0, 1) for c, n in (("pos", 4), ("neg", 4), ("pos_synth", 8), ("neg_synth", 8))}
    assert sampling.balanced_batches(t.where("class <> 'pos'"), 24).count() == 0


def test_stride_needs_more_positives(spark):
    t = spark.range(5)
    with pytest.raises(ValueError):
        sampling.stride_sample(t, "id", 1, 2)
    assert [r["id"] for r in sampling.stride_sample(t, "id", 5, 2).orderBy("id").collect()] == [0, 2]


def test_empty_scores(spark):
    t = spark.createDataFrame([], SCHEMA)
    sizes = spark.createDataFrame([], "pair_id long, height int, width int")
    assert all(df.count() == 0 for df in matching.merged_tables(t, sizes).values())


def test_running_sums(spark):
    t = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    rows = sorted(tuple(r) for r in sampling.running(t, "k", F.col("v"), "s").collect())
    total = 0
    for _, v, s in rows:
        assert s == total
        total += v
    assert sampling.running(t.limit(0), "k", F.col("v"), "s").count() == 0
