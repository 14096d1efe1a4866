"""Pictures to patch scores, and the operators on masks and squares around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.functions import raster as kernels
from fragloom.operators import datasets, palette, patches, raster, score
from fragloom.plans import matching
from fragloom.sources import images


def square(seed, side=40):
    rng = np.random.default_rng(seed)
    p = np.zeros((side + 20, side + 20, 4), np.uint8)
    p[10:-10, 10:-10, :3] = rng.integers(0, 255, (side, side, 3))
    p[10:-10, 10:-10, 3] = 255
    return p


@pytest.fixture(scope="module")
def scans(tmp_path_factory):
    folder = tmp_path_factory.mktemp("scans")
    for n, name in enumerate(("a", "b")):
        (folder / f"{name}.png").write_bytes(images.encode_png(square(n)))
    (folder / "empty.png").write_bytes(images.encode_png(np.zeros((30, 30, 4), np.uint8)))
    (folder / "torn.png").write_bytes(b"not a picture")
    return str(folder)


def test_compute(spark, scans, tmp_path):
    run = lambda model=score.baseline: matching.compute(spark, scans, str(tmp_path), model, spacing=40.0, side=48, net_side=16)

    def broken():
        def model(x):
            raise RuntimeError("no memory")

        return model

    first = {(r["a"], r["b"]): (r["status"], r["error"]) for r in run(broken).collect()}
    assert first["a", "b"] == ("failed", "RuntimeError: no memory") and len(first) == 6
    second = {(r["a"], r["b"]): r["status"] for r in run().collect()}
    assert second == {("a", "b"): "done", ("a", "empty"): "no pose", ("b", "empty"): "no pose", ("a", "torn"): "unreadable", ("b", "torn"): "unreadable", ("empty", "torn"): "unreadable"}
    scores = images.read_scores(spark, f"{tmp_path}/scores")
    n = scores.count()
    assert n > 0 and set(scores.columns) >= {"pair_id", "translation_id", "patch_idx", "score"}
    # the kernel's patch, resize and model, by hand
    r = spark.read.parquet(f"{tmp_path}/scores").orderBy("translation_id", "patch_idx").first()
    ta = [24 - (r[f"a{c}"] + r[f"b{c}"] + r[f"t{c}"]) / 2 for c in "yx"]
    tb = [t + r[f"t{c}"] for t, c in zip(ta, "yx")]
    x = kernels.resize(kernels.patch(square(0), square(1), tuple(ta), tuple(tb), 48), 16)[None]
    assert r["score"] == pytest.approx(float(1 / (1 + np.exp(-score.baseline()(x)[0]))), abs=1e-5)
    run()
    assert images.read_scores(spark, f"{tmp_path}/scores").count() == n  # nothing is done twice


def test_no_scores_yet(spark, tmp_path):
    with pytest.warns(UserWarning, match="no scores"):
        assert images.read_scores(spark, str(tmp_path / "none")).count() == 0


def test_models_are_stored(tmp_path):
    x = np.random.default_rng(0).random((5, 4, 8, 8)).astype(np.float32)
    model = score.linear(np.arange(8.0), -1.0)
    score.save(model, str(tmp_path / "model.npz"))
    assert np.allclose(score.load(str(tmp_path / "model.npz"))()(x), model()(x))
    with pytest.raises(FileNotFoundError):
        score.load(str(tmp_path / "other.npz"))


def test_merged_files(spark, tmp_path):
    t = spark.createDataFrame([(1, s, i, 0, float(i), float(y), float(x)) for s in ("recto", "verso") for i, (y, x) in enumerate(((0, 0), (0, 9), (9, 0), (9, 9)))], "pair_id long, side string, translation_id int, patch_idx int, score double, ty double, tx double")
    tables = matching.merged_tables(t, spark.createDataFrame([(1, 200, 200)], "pair_id long, height int, width int"))
    about = spark.createDataFrame([(1, "net")], "pair_id long, model string")
    matching.write_merged(tables, str(tmp_path), about, about)
    back = matching.read_merged(spark, str(tmp_path))
    assert set(back) == {"cell", "pair", "top", "patch", "about"}
    assert back["cell"].count() == tables["cell"].count() and back["about"].columns == ["pair_id", "model_recto", "model_verso"]


def test_contours_by_colour(spark):
    px = [(1, y, x, *((255, 0, 0) if x < 10 else (0, 9, 0)), 255 if 2 <= y < 18 and x != 10 else 0) for y in range(20) for x in range(24)]
    px += [(1, 19, 23, 1, 1, 1, 255)]
    t = spark.createDataFrame(px, "image_id int, y int, x int, r int, g int, b int, a int")
    got = raster.colour_contours(t, 0.01, 2, 4).groupBy("r", "g").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).collect()
    assert {(r["r"], r["g"]): (r["y0"], r["y1"], r["x0"], r["x1"]) for r in got} == {(255, 0): (1.5, 17.5, -0.5, 9.5), (0, 9): (1.5, 17.5, 10.5, 23.5)}


def test_channel_crops(spark):
    px = [(7, y, x, 200 if (y, x) in ((2, 3), (4, 5)) else 0, 0, 50 if x == 1 else 0) for y in range(6) for x in range(6)]
    t = spark.createDataFrame(px, "image_id int, y int, x int, r int, g int, b int")
    got = {r["channel"]: (r["y0"], r["x0"], bytes(r["png"])) for r in images.channel_crops(t).collect()}
    assert set(got) == {"r", "b"} and got["r"][:2] == (2, 3) and got["b"][:2] == (0, 1)
    picture = np.zeros((3, 3, 4), np.uint8)
    picture[0, 0] = picture[2, 2] = (0, 0, 200, 255)
    assert got["r"][2] == images.encode_png(picture)


def test_gather_wraps_if_not_pedantic(spark):
    src = spark.createDataFrame([(1, y, x, 10 * y + x) for y in range(3) for x in range(3)], "image_id int, y int, x int, v int")
    mask = src.select("image_id", "y", "x")
    array = np.arange(3)[:, None] * 10 + np.arange(3)
    for pedantic in (True, False):
        got = {(r["y"], r["x"]): r["v"] for r in raster.gathered(mask, src, F.lit(1.5), F.lit(0.0), pedantic, (3, 3)).collect()}
        want = {(y, x): int(array[int(y - 1.5), x]) for y in range(3) for x in range(3) if not pedantic or int(y - 1.5) >= 0}
        assert got == want


def test_augmented_pictures_keep_alpha(spark, scans):
    before = images.scan(spark, scans).where("frag_id = 'a'")
    one, two, again = (patches.augmented(before, e).first()["data"] for e in (0, 1, 0))
    assert bytes(one) == bytes(again) and bytes(one) != bytes(two)
    alpha = lambda d: np.frombuffer(bytes(d), np.uint8).reshape(60, 60, 4)[..., 3].sum()
    assert alpha(one) == alpha(before.first()["data"])


def test_silhouettes_by_hand(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(250, 3))
    code = rng.integers(0, 4, 250)
    code[0] = 9  # alone in its cluster
    t = spark.createDataFrame([(*map(float, p), int(c)) for p, c in zip(x, code)], "f double, g double, h double, k4 int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(250):
        mine = (code == code[i]) & (np.arange(250) != i)
        if not mine.any():
            s.append(0.0)
            continue
        a, b = d[i][mine].mean(), min(d[i][code == c].mean() for c in set(code.tolist()) - {code[i]})
        s.append((b - a) / max(a, b))
    assert palette.silhouettes(t, ["k4"], ["f", "g", "h"]).first()["score"] == pytest.approx(np.mean(s))


def row_of(picture):
    h, w = picture.shape[:2]
    return {"data": picture[..., [2, 1, 0, 3]].tobytes(), "height": h, "width": w}


PICTURE = "struct<data:binary,height:int,width:int>"
OUTLINE = "array<struct<y:double,x:double>>"


def test_training_samples(spark):
    """Each class by hand, at the network's own size so that nothing is resized."""
    rng = np.random.default_rng(1)
    one, two = (np.concatenate([rng.integers(1, 255, (20, 20, 3)), np.full((20, 20, 1), 255)], axis=2).astype(np.uint8) for _ in range(2))
    left, right = ([{"y": float(y), "x": float(x)} for y, x in c] for c in (((0, 0), (0, 5), (12, 5), (12, 0)), ((0, 7), (0, 12), (12, 12), (12, 7))))
    offsets = dict(tay=0.0, tax=0.0, tby=0.0, tbx=-1.0)
    a, b = (kernels.fill_polygon(np.array([[p["y"], p["x"]] for p in c]) + [0, dx], (8, 8)) for c, dx in ((left, 0), (right, -1)))
    tensor = lambda p: p.transpose(2, 0, 1).astype(np.float32) / 255
    schema = f"id long, picture {PICTURE}, other {PICTURE}, mask {PICTURE}, contour_a {OUTLINE}, contour_b {OUTLINE}, tay double, tax double, tby double, tbx double, y0 int, x0 int, other_y0 int, other_x0 int, sy int, sx int, erosion int"
    mask = np.zeros((20, 20, 4), np.uint8)
    mask[:, :6] = (255, 0, 0, 255)
    mask[:, 6:] = (0, 255, 0, 255)
    mask[0, 0] = (0, 0, 0, 255)
    row = dict(id=5, picture=row_of(one), other=row_of(two), mask=row_of(mask), contour_a=left, contour_b=right, **offsets, y0=2, x0=3, other_y0=1, other_x0=0, sy=1, sx=0, erosion=1)
    rows = spark.createDataFrame([row], schema)
    get = lambda kind, **more: np.array(datasets.tensors(rows, kind, 8, 8, **more).first()["tensor"]).reshape(4, 8, 8)
    crop = np.zeros((8, 8, 4), np.uint8)
    crop[a] = one[:8, :8][a]
    crop[b] = one[:8, 1:9][b]
    assert np.allclose(get("neg"), tensor(crop), atol=1e-6)
    cut, moved = one[2:10, 3:11], np.zeros((8, 8, 4), np.uint8)
    moved[1:] = cut[:-1]
    assert np.allclose(get("pos_synth"), np.maximum(tensor(cut) * a, tensor(moved) * b), atol=1e-6)
    assert np.allclose(get("neg_synth"), np.maximum(tensor(cut) * a, tensor(two[1:9, :8]) * b), atol=1e-6)
    real = get("pos", post_transform=lambda x: x * 2) / 2
    inside = np.ones((8, 8), bool)
    inside[:, 2:4] = False  # columns 5 and 6 of the mask, next to the other colour
    assert np.allclose(real, tensor(cut) * inside, atol=1e-6)
    assert datasets.tensors(rows, "pos", 8, 8).select("part", "label").first() == ("pos", 1)


def test_pixels_as_a_table_function(spark, scans):
    spark.udtf.register("explode_pixels", images.explode_pixels())
    images.scan(spark, scans).where("frag_id = 'a'").createOrReplaceTempView("scans_for_udtf")
    got = spark.sql("SELECT p.* FROM scans_for_udtf, LATERAL explode_pixels(data, height, width, n_channels) p WHERE p.a > 0")
    want = images.mask_pixels(images.scan(spark, scans).where("frag_id = 'a'")).where("a > 0").select("y", "x", *[F.col(c).cast("int").alias(c) for c in "rgba"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 1600
