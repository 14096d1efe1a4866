"""Training samples of the four classes, as tensors: DataFrames of places and pictures in, float arrays out.

What a sample is made of is chosen by joins and arithmetic (``sampling.sample_space``, ``sampling.partner``, ``pose.training_offsets``, ``pose.texture_shift``); here each row has its
pictures and numbers, and one kernel draws it:

negative            the two pieces of one picture, moved to the contact from where they are
synthetic positive  two outlines cut from one patch of texture, the second from a copy that is shifted
synthetic negative  two outlines cut from patches of two pictures
real positive       a square around a real contact, each colour of its mask by itself

In all of them the tensor is the largest of the pieces' tensors, each times its own mask, and colours are 0 where alpha is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.functions import raster
from fragloom.operators.patches import rgba

Transform = Callable[[np.ndarray], np.ndarray]
LABELS = {"pos": 1, "neg": 0, "pos_synth": 1, "neg_synth": 0}
OFFSETS = ["tay", "tax", "tby", "tbx"]


def combined(pieces: list[tuple[np.ndarray, np.ndarray]], net_side: int) -> np.ndarray:
    """float32 [4, net_side, net_side]: the largest of the pictures (uint8 RGBA), each times its mask, both resized."""
    layers = [raster.resize(picture, net_side) * raster.resize(mask[..., None].astype(np.float32) * 255, net_side) for picture, mask in pieces]
    out = np.max(layers, axis=0) if layers else np.zeros((4, net_side, net_side), np.float32)
    out[:3, out[3] == 0] = 0
    return out


def square(picture: np.ndarray, y0: int, x0: int, side: int) -> np.ndarray:
    """A square of the picture; ValueError if it does not lie within."""
    if y0 < 0 or x0 < 0 or y0 + side > picture.shape[0] or x0 + side > picture.shape[1]:
        raise ValueError(f"square of {side} at ({y0}, {x0}) leaves a picture of {picture.shape[:2]}")
    return picture[y0 : y0 + side, x0 : x0 + side]


def _points(column: list[dict]) -> np.ndarray:
    return np.array([[p["y"], p["x"]] for p in column], float).reshape(-1, 2)


def _picture(p: dict) -> np.ndarray:
    return rgba(p["data"], p["height"], p["width"])


def _outlined(row: dict, side: int) -> list[np.ndarray]:
    """The masks of both outlines at their offsets."""
    return [raster.fill_polygon(_points(row[f"contour_{s}"]) + np.array([row[f"t{s}y"], row[f"t{s}x"]]), (side, side)) for s in "ab"]


def _negative(row: dict, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
    picture = _picture(row["picture"])
    masks = _outlined(row, side)
    crop = np.zeros((side, side, 4), np.uint8)
    for s, mask in zip("ab", masks):
        moved = raster.gather(picture, mask, (row[f"t{s}y"], row[f"t{s}x"]))
        crop[mask] = moved[mask]
    return [(crop, m) for m in masks]


def _synthetic_positive(row: dict, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
    crop = square(_picture(row["picture"]), row["y0"], row["x0"], side)
    return list(zip((crop, raster.shift_texture(crop, row["sy"], row["sx"], fill=True)), _outlined(row, side)))


def _synthetic_negative(row: dict, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
    crops = (square(_picture(row["picture"]), row["y0"], row["x0"], side), square(_picture(row["other"]), row["other_y0"], row["other_x0"], side))
    return list(zip(crops, _outlined(row, side)))


def _real_positive(row: dict, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
    crop, mask = (square(_picture(row[c]), row["y0"], row["x0"], side) for c in ("picture", "mask"))
    seen = mask[(mask[..., 3] > 0) & mask[..., :3].any(axis=2)]
    colours, n = np.unique(seen[:, :3], axis=0, return_counts=True)
    masks = [(mask[..., :3] == c).all(axis=2) & (mask[..., 3] > 0) for c in colours[n > 0.01 * max(len(seen), 1)]]
    return [(crop, raster.eroded_mask(m, row["erosion"])) for m in masks]


DRAWN = {"neg": _negative, "pos_synth": _synthetic_positive, "neg_synth": _synthetic_negative, "pos": _real_positive}


def tensors(rows: DataFrame, kind: str, side: int, net_side: int, transform: Transform | None = None, post_transform: Transform | None = None) -> DataFrame:
    """(id, part, label, tensor): a flat float32 [4, net_side, net_side] for each row of one class.

    Rows have id, the picture (data, height, width in BGRA) and, by class: contour_a, contour_b and the offsets t[ab][yx]; y0, x0 of a square; sy, sx of the shift; other, other_y0,
    other_x0; mask and erosion. ``transform`` changes the uint8 pictures before they are cut to their masks, ``post_transform`` the tensor.
    """

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                pieces = DRAWN[kind](row, side)
                x = combined([(transform(p), m) for p, m in pieces] if transform else pieces, net_side)
                out.append((post_transform(x) if post_transform else x).astype(np.float32).ravel())
            at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
            flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*out, np.zeros(0, np.float32)])))
            yield pa.RecordBatch.from_arrays([b.column("id"), flat], ["id", "tensor"])

    done = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, tensor array<float>")
    return done.select("id", F.lit(kind).alias("part"), F.lit(LABELS[kind]).alias("label"), "tensor")
