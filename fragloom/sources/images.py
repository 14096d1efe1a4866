"""Pictures, id lists, score tables and caches as sources and sinks."""

from __future__ import annotations

import struct
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.functions import raster
from fragloom.operators.pairs import side_of, stem


def scan(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """``schemas.IMAGE`` of all pictures of a folder. A file that cannot be decoded has the status ``corrupt``, one without alpha ``no alpha``."""
    t = spark.read.format("image").option("pathGlobFilter", pattern).load(folder).select("image.*")
    path = F.col("origin")
    status = F.when(F.col("height") < 0, "corrupt").when(F.col("nChannels") != 4, "no alpha").otherwise("ok")
    return t.select(stem(path).alias("frag_id"), side_of(path).alias("side"), path.alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data", status.alias("status"))


def sizes(images: DataFrame) -> DataFrame:
    """(frag_id, height, width), without the pixels."""
    return images.select("frag_id", "height", "width")


def with_masks(ids: DataFrame, masks: DataFrame) -> DataFrame:
    """The ids that have a mask (image_id)."""
    return ids.join(masks, "image_id", "left_semi")


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def encode_png(picture: np.ndarray) -> bytes:
    """PNG of a BGRA or BGR picture."""
    h, w, c = picture.shape
    rgb = picture[..., [2, 1, 0, 3][:c]]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * c)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def contours(images: DataFrame, pad: int = 10, hole_area: int = 1000) -> DataFrame:
    """(frag_id, side, points): the outline of each picture's largest piece, empty if it has none. Every picture is decoded once, not once for each pair."""

    def run(batches):
        for b in batches:
            out = []
            for data, h, w, c, ok in zip(*(b.column(n).to_pylist() for n in ("data", "height", "width", "n_channels", "status"))):
                line = raster.contour_from_alpha(pixels(data, h, w, c)[..., 3], pad, hole_area) if ok == "ok" else np.zeros((0, 2))
                out.append([{"y": y, "x": x} for y, x in line.tolist()])
            yield pa.RecordBatch.from_arrays([b.column("frag_id"), b.column("side"), pa.array(out, pa.list_(pa.struct([("y", pa.float64()), ("x", pa.float64())])))], ["frag_id", "side", "points"])

    return images.select("frag_id", "side", "data", "height", "width", "n_channels", "status").mapInArrow(run, "frag_id string, side string, points array<struct<y:double,x:double>>")


def mask_pixels(images: DataFrame) -> DataFrame:
    """``schemas.MASK_PX``: one row for each pixel."""

    def run(batches):
        for b in batches:
            for one, data, h, w, c in zip(*(b.column(n).to_pylist() for n in ("frag_id", "data", "height", "width", "n_channels"))):
                if h > 0:
                    p = pixels(data, h, w, c).reshape(-1, c).astype(np.int16)
                    alpha = p[:, 3] if c == 4 else np.full(len(p), 255, np.int16)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(p)), pa.array(np.repeat(np.arange(h, dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), h)), *(pa.array(v) for v in (p[:, 2], p[:, 1], p[:, 0], alpha))], ["image_id", "y", "x", "r", "g", "b", "a"])

    return images.select("frag_id", "data", "height", "width", "n_channels").mapInArrow(run, "image_id string, y int, x int, r smallint, g smallint, b smallint, a smallint")


class ExplodePixels:
    """The table function behind ``explode_pixels``."""

    def eval(self, data: bytes, height: int, width: int, channels: int):
        if data is None or height is None or height <= 0:
            return
        p = pixels(data, height, width, channels)
        for y in range(height):
            for x in range(width):
                v = p[y, x].tolist()
                yield y, x, v[2], v[1], v[0], v[3] if channels == 4 else 255


def explode_pixels():
    """The table function explode_pixels(data, height, width, channels) -> (y, x, r, g, b, a), for SQL: register it with ``spark.udtf.register``.

    It makes one Python row a pixel; ``mask_pixels`` does the same in Arrow columns and is the way for whole folders.
    """
    from pyspark.sql.functions import udtf

    return udtf(ExplodePixels, returnType="y int, x int, r int, g int, b int, a int")


def cropped(images: DataFrame, least: int = 250) -> DataFrame:
    """(frag_id, path, status, png): each picture cut to its opaque pixels, encoded; status processed, or skipped for corrupt and empty ones."""

    def run(batches):
        for b in batches:
            png, status = [], []
            for data, h, w, c in zip(*(b.column(n).to_pylist() for n in ("data", "height", "width", "n_channels"))):
                cut = raster.crop_opaque(pixels(data, h, w, c), least) if h > 0 else None
                png.append(None if cut is None else encode_png(cut))
                status.append("skipped" if cut is None else "processed")
            yield pa.RecordBatch.from_arrays([b.column("frag_id"), b.column("path"), pa.array(status), pa.array(png, pa.binary())], ["frag_id", "path", "status", "png"])

    return images.select("frag_id", "path", "data", "height", "width", "n_channels").mapInArrow(run, "frag_id string, path string, status string, png binary")


def write_pngs(pictures: DataFrame, folder: str) -> DataFrame:
    """Write (frag_id, png) as files of a folder all tasks can reach; returns (frag_id, file). A repeated task overwrites its own files with the same bytes."""
    from pyarrow import fs

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            names = [f"{x}.png" for x in b.column("frag_id").to_pylist()]
            for name, data in zip(names, b.column("png").to_pylist()):
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([b.column("frag_id"), pa.array(names)], ["frag_id", "file"])

    return pictures.where("png IS NOT NULL").select("frag_id", "png").mapInArrow(run, "frag_id string, file string")


def channel_masks(px: DataFrame) -> DataFrame:
    """(image_id, channel, y0, x0, y1, x1): the box of each channel's selected (non-zero) pixels."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "rgb"]))
    t = px.select("image_id", "y", "x", each.alias("e")).where("e.v > 0")
    return t.groupBy("image_id", F.col("e.channel").alias("channel")).agg(*[f(v).alias(f"{v}{k}") for k, f in ((0, F.min), (1, F.max)) for v in "yx"])


def channel_crops(px: DataFrame) -> DataFrame:
    """(image_id, channel, y0, x0, png): the picture of each channel's selected pixels, cut to their box; what is not selected is transparent."""
    from fragloom.functions.batches import whole_groups

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "rgb"]))
    rows = px.select("image_id", "y", "x", "r", "g", "b", each.alias("e")).where("e.v > 0").select("image_id", "e.channel", "y", "x", "r", "g", "b")

    def run(batches):
        for t, starts in whole_groups(batches, ["image_id", "channel"]):
            y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
            bgr = np.column_stack([t.column(c).to_numpy() for c in "bgr"])
            out, top, left = [], [], []
            for i, j in zip(starts, np.append(starts[1:], t.num_rows)):
                y0, x0 = y[i:j].min(), x[i:j].min()
                picture = np.zeros((int(y[i:j].max() - y0) + 1, int(x[i:j].max() - x0) + 1, 4), np.uint8)
                picture[y[i:j] - y0, x[i:j] - x0, :3] = bgr[i:j]
                picture[y[i:j] - y0, x[i:j] - x0, 3] = 255
                out.append(encode_png(picture))
                top.append(int(y0))
                left.append(int(x0))
            of = pa.array(starts)
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(of) for c in ("image_id", "channel")] + [pa.array(top, pa.int32()), pa.array(left, pa.int32()), pa.array(out, pa.binary())], ["image_id", "channel", "y0", "x0", "png"])

    rows = rows.repartition("image_id", "channel").sortWithinPartitions("image_id", "channel")
    return rows.mapInArrow(run, f"image_id {dict(px.dtypes)['image_id']}, channel string, y0 int, x0 int, png binary")


def crop_counts(crops: DataFrame) -> DataFrame:
    """(status, n): how many pictures were processed and skipped."""
    return crops.groupBy("status").agg(F.count("*").alias("n"))


def with_parts(ids: DataFrame, **parts: DataFrame) -> DataFrame:
    """The ids (image_id) that have all parts (masks, pictures, contours; tables by image_id), with the parts' columns."""
    out = ids
    for part in parts.values():
        out = out.join(part, "image_id")
    return out


def write_scores(scores: DataFrame, path: str) -> None:
    """Append patch scores, a folder for each side."""
    scores.write.mode("append").partitionBy("side").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The patch scores under ``path``; none, with a warning, where nothing has been written."""
    from fragloom.schemas import PATCH_SCORE

    if not exists(spark, path):
        warnings.warn(f"no scores in {path}", stacklevel=2)
        return spark.createDataFrame([], PATCH_SCORE)
    return spark.read.schema(PATCH_SCORE).parquet(path)


def cached(path: str, compute, spark: SparkSession, force: bool = False) -> DataFrame:
    """The table at ``path`` (which names all parameters), computed and written if it is absent or ``force`` is set."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(image_id): one for each line."""
    return spark.read.text(path).select(F.col("value").alias("image_id"))


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select("image_id").write.mode("overwrite").text(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def latest(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """Path of the file written last."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return t.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
