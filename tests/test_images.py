import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.functions import raster as R
from fragloom.operators import pairs, palette, raster, score
from fragloom.plans import matching
from fragloom.sources import images
from fragloom.streaming import incremental


def disc(radius, size):
    y, x = np.mgrid[:size, :size]
    m = (y - size / 2) ** 2 + (x - size / 2) ** 2 < radius**2
    p = np.zeros((size, size, 4), np.uint8)
    p[m] = (10, 20, 30, 255)
    return p


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("scans")
    for name, p in {"a": disc(30, 90), "b": disc(25, 80), "a_back": disc(30, 90), "blank": np.zeros((20, 20, 4), np.uint8), "flat": disc(5, 20)[..., :3]}.items():
        (at / f"{name}.png").write_bytes(images.encode_png(p))
    (at / "broken.png").write_bytes(b"not a picture")
    return str(at)


def test_scan(spark, folder):
    t = {r["frag_id"]: r for r in images.scan(spark, folder).collect()}
    assert {k: v["status"] for k, v in t.items()} == {"a": "ok", "b": "ok", "a_back": "ok", "blank": "ok", "flat": "no alpha", "broken": "corrupt"}
    assert t["a_back"]["side"] == "verso" and t["a"]["side"] == "recto"
    p = images.pixels(t["a"]["data"], t["a"]["height"], t["a"]["width"], 4)
    assert (p == disc(30, 90)).all()
    px = images.mask_pixels(images.scan(spark, folder).where("frag_id = 'a'"))
    row = px.where("y = 45 AND x = 45").first()
    assert (row["r"], row["g"], row["b"], row["a"]) == (30, 20, 10, 255)
    assert images.sizes(images.scan(spark, folder)).where("frag_id = 'b'").first()["height"] == 80


def test_contours_and_matching(spark, folder):
    c = {r["frag_id"]: r["points"] for r in images.contours(images.scan(spark, folder)).collect()}
    assert not c["blank"] and not c["flat"] and not c["broken"]
    p = np.array([(q["y"], q["x"]) for q in c["a"]])
    assert np.allclose(np.hypot(p[:, 0] - 45, p[:, 1] - 45), 30, atol=1.2)
    poses = matching.scored_positions(matching.outlines(spark, folder), spacing=40.0)
    assert poses.where("a = 'a' AND b = 'b'").count() > 0


def test_crop_and_write(spark, folder, tmp_path):
    t = images.cropped(images.scan(spark, folder)).persist()
    n = {r["status"]: r["count"] for r in t.groupBy("status").count().collect()}
    assert n == {"processed": 4, "skipped": 2}
    assert images.write_pngs(t, str(tmp_path / "out")).count() == 4
    back = images.scan(spark, str(tmp_path / "out")).where("frag_id = 'a'").first()
    assert (back["height"], back["width"]) == (59, 59)


def test_tables_and_caches(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for force, n in ((False, 1), (False, 1), (True, 2)):
        assert images.cached(str(tmp_path / "c" / "pad=20"), make, spark, force).count() == 3
        assert len(calls) == n
    ids = spark.createDataFrame([("x",), ("y",)], "image_id string")
    images.write_ids(ids, str(tmp_path / "train.txt"))
    assert {r[0] for r in images.read_ids(spark, str(tmp_path / "train.txt")).collect()} == {"x", "y"}
    assert images.with_masks(ids, spark.createDataFrame([("y",)], "image_id string")).collect() == [("y",)]
    images.write_csv(ids, str(tmp_path / "stats"))
    assert spark.read.option("header", True).csv(str(tmp_path / "stats")).columns == ["image_id"]
    s = spark.createDataFrame([(1, "recto", 0, 0, 0.5, 1.0, 2.0, 0.0, 0.0, 0.0, 0.0)], "pair_id long, side string, translation_id int, patch_idx int, score float, ty double, tx double, ay double, ax double, by double, bx double")
    images.write_scores(s, str(tmp_path / "scores"))
    assert images.read_scores(spark, str(tmp_path / "scores")).where("side = 'recto'").count() == 1
    assert images.latest(spark, str(tmp_path / "stats"), "*.csv").endswith(".csv")


def test_stream(spark, folder, tmp_path):
    known, out, mark = (str(tmp_path / n) for n in ("known", "pairs", "mark"))
    incremental.pair_new(spark, folder, known, out, mark).awaitTermination(90)
    got = {(r["side"], r["a"], r["b"]) for r in spark.read.parquet(out).collect()}
    names = ["a", "b", "blank", "broken", "flat"]
    assert got == {("recto", x, y) for i, x in enumerate(names) for y in names[i + 1 :]}
    incremental.pair_new(spark, folder, known, out, mark).awaitTermination(90)
    assert spark.read.parquet(out).count() == len(got)


def test_kernels():
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[4, 4] = False
    assert R.closing(m)[4, 4] and R.fill_small_holes(m, 2)[4, 4] and not R.fill_small_holes(m, 1)[4, 4]
    m[0, 0] = m[1, 1] = True
    assert R.label(m).max() == 1 and R.label(m, 4).max() == 3
    assert R.largest_component(m).sum() == m.sum()
    assert R.opening(np.pad(np.ones((3, 3), bool), 3)).sum() == 9
    lines = R.outlines(np.pad(np.ones((1, 1), bool), 1))
    assert len(lines) == 1 and len(lines[0]) == 5 and (lines[0][0] == lines[0][-1]).all()
    assert R.blit_slices((-2.5, 1), (4, 4), (3, 3)) == ((slice(3, 4), slice(0, 2)), (slice(0, 1), slice(1, 3)))
    assert R.blit_slices((5, 0), (4, 4), (3, 3)) is None
    a = np.full((2, 2, 4), 200, np.uint8)
    both = R.patch(a, a, (0, 0), (1, 1), 4, soft=100)
    assert both[1, 1, 3] == 200 and both[0, 0, 3] == 100 and both[3, 3].sum() == 0
    assert R.patch(a, a, (0, 0), (1, 1), 4, soft=100, combine="max")[1, 1, 3] == 100
    assert R.crop_opaque(np.zeros((5, 5, 4), np.uint8)) is None
    x = R.resize(np.full((10, 20, 4), 51, np.uint8), 8)
    assert x.shape == (4, 8, 8) and np.allclose(x, 0.2, atol=1e-6)
    square = R.fill_polygon(np.array([[1, 1], [1, 4], [4, 4], [4, 1]], float), (6, 6))
    assert square[1:4, 1:5].all() and not square[0].any()
    g = R.gather(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), np.ones((4, 4), bool), (1, 1))
    assert g[1, 1, 0] == 0 and g[3, 3, 0] == 10 and g[0, 0, 0] == 0
    p = disc(5, 20)
    assert (R.augment(p, "k") == R.augment(p, "k")).all()
    assert (R.shift_texture(p, 0, 0) == p).all()
    e = R.erode_square(m, 1)
    assert not e[2, 2] and e.shape == m.shape


def test_labels_against_flood(spark):
    rng = np.random.default_rng(5)
    for c in (4, 8):
        m = rng.random((12, 12)) < 0.5
        lab = R.label(m, c)
        seen = {}
        for y, x in zip(*np.nonzero(m)):
            if (y, x) in seen:
                continue
            stack = [(y, x)]
            while stack:
                p = stack.pop()
                if p in seen or not (0 <= p[0] < 12 and 0 <= p[1] < 12 and m[p]):
                    continue
                seen[p] = (y, x)
                stack += [(p[0] + a, p[1] + b) for a, b in raster.OFFSETS[c]]
        assert len({(lab[p], s) for p, s in seen.items()}) == len(set(seen.values())) == lab.max()


def test_names(spark):
    t = spark.createDataFrame([("1__2.hdf5",), ("bad.hdf5",), ("a__b__c",)], "name string")
    assert [(r["a"], r["b"]) for r in pairs.parsed(t).collect()] == [("1", "2")]
    recto, verso = spark.createDataFrame([("1", "2")], "a string, b string"), spark.createDataFrame([("10_back", "2_back"), ("1_back", "2_back")], "a string, b string")
    assert tuple(pairs.match_sides(recto, verso).first())[2] == "10_back"
    assert tuple(pairs.match_sides(recto, verso, strict=True).first())[2] == "1_back"


def test_palette(spark):
    px = spark.createDataFrame([("i", 0, x, *c, 255) for x, c in enumerate([(250, 0, 0)] * 50 + [(0, 250, 0)] * 40 + [(0, 0, 0)] * 9 + [(1, 2, 3)])], "image_id string, y int, x int, r int, g int, b int, a int")
    seen = palette.colour_masks(px, 0.02)
    assert {(r["r"], r["g"], r["b"]) for r in seen.collect()} == {(250, 0, 0), (0, 250, 0)}
    counts = px.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    med = palette.dominant(counts, "image_id", ["r", "g", "b"], 3)
    snap = palette.snapped(med, counts, ["image_id"], ["r", "g", "b"])
    assert {(r["r"], r["g"], r["b"]) for r in snap.collect()} >= {(250, 0, 0), (0, 250, 0)}
    assert palette.estimate_colours(px.where("x < 90").select("r", "g", "b"), ["r", "g", "b"], range(2, 4)).first()["k"] == 2
    assert images.channel_masks(px).where("channel = 'g'").first()["x0"] == 50


def test_scorer(spark):
    t = spark.createDataFrame([(i, [float(i)] * 16) for i in range(5)], "id int, p array<float>")
    got = [r[0] for r in t.select(score.scorer(lambda: lambda x: x[:, 0, 0, 0], 4, 2)(F.col("p")).alias("s")).collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-i)) for i in range(5)], abs=1e-6)


def test_trained_scorer(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 4, 2, 2)).astype(np.float32)
    y = (x[:, 3].mean(axis=(1, 2)) > 0.5).astype(int)
    t = spark.createDataFrame([(score.descriptors(p[None])[0].tolist(), int(k), p.ravel().tolist()) for p, k in zip(x, y)], "f array<double>, y int, p array<float>")
    make = score.trained(t, "f", "y")
    got = t.select("y", score.scorer(make, 4, 2)(F.col("p")).alias("s")).collect()
    assert np.mean([(r["s"] > 0.5) == (r["y"] == 1) for r in got]) > 0.95


def test_traced(spark):
    px = spark.createDataFrame([(1, y, x, 255 if 1 <= y <= 2 and 1 <= x <= 3 else 0) for y in range(5) for x in range(5)] + [(2, 0, 0, 0)], "image_id int, y int, x int, alpha int")
    line = [(r["y"], r["x"]) for r in raster.traced(px).orderBy("k").collect()]
    assert line[0] == line[-1] and len(line) == 11 and min(line)[0] == 0.5 and max(line)[0] == 2.5
    assert raster.traced(px.where("image_id = 2")).count() == 0
    assert tuple(raster.opaque_boxes(px).collect()) == ()
