"""The compute path: pictures and poses in, patch scores and the state of every pair out.

Contacts are gathered for each pair, both pictures are joined once a pair, and one kernel cuts, composes, resizes and scores the patches of a pair in
batches. What a pair ends with is a row of its own (``schemas.PAIR_STATUS``): done, no pose, unreadable or failed with its error, so that a
pair without scores is not tried again and again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.functions import raster
from fragloom.operators import pose
from fragloom.operators.score import BATCH, Model

PAIR = ["a", "b", "side"]
NUMBERS = ["translation_id", "patch_idx", "ty", "tx", "py", "px", "qy", "qx", "tay", "tax", "tby", "tbx"]
OUT = "translation_id int, patch_idx int, score float, ty double, tx double, ay double, ax double, by double, bx double, status string, error string"


def rgba(data: bytes, height: int, width: int) -> np.ndarray:
    """Red, green, blue, alpha of a BGRA picture."""
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]


def patches(one: np.ndarray, two: np.ndarray, at: np.ndarray, side: int, net_side: int, soft: float | None, combine: str) -> np.ndarray:
    """float32 [n, 4, net_side, net_side] for n rows of offsets (tay, tax, tby, tbx)."""
    return np.stack([raster.resize(raster.patch(one, two, (r[0], r[1]), (r[2], r[3]), side, soft, combine), net_side) for r in at])


def scored(images: DataFrame, contacts: DataFrame, make_model: Callable[[], Model], side: int = 224, net_side: int = 224, soft: float | None = None, combine: str = "sum", batch: int = BATCH, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Patch scores (a, b, side, translation_id, patch_idx, score, ...) and, with null numbers, one row of status for each pair that has contacts.

    images: ``schemas.IMAGE``; contacts: (a, b, side, translation_id, patch_idx, ty, tx, py, px, qy, qx) as ``pose.neighbours`` gives them.
    ``transform`` changes the tensors [n, 4, net_side, net_side] before the model sees them.
    """
    offsets = pose.centred(contacts, side)
    rows = offsets.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int" if c in NUMBERS[:2] else "double").alias(c) for c in NUMBERS]))).alias("contacts"))
    picture = F.struct("data", "height", "width", "status")
    known = lambda c: images.select(F.col("frag_id").alias(c), "side", picture.alias(f"p{c}"))
    joined = rows.join(known("a"), ["a", "side"], "left").join(known("b"), ["b", "side"], "left").select(*PAIR, "contacts", "pa", "pb")
    kinds = dict(contacts.dtypes)

    def one_pair(model: Model, a, b, contacts) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([[c[n] for n in NUMBERS] for c in contacts])
        x, y = rgba(a["data"], a["height"], a["width"]), rgba(b["data"], b["height"], b["width"])
        made = (patches(x, y, at[k : k + batch, 8:], side, net_side, soft, combine) for k in range(0, len(at), batch))
        z = [np.asarray(model(transform(p) if transform else p), np.float64).reshape(-1) for p in made]
        return at, 1 / (1 + np.exp(-np.concatenate(z)))

    def run(batches):
        model = make_model()
        for big in batches:
            for k in range(big.num_rows):
                row = {c: big.column(c)[k].as_py() for c in big.schema.names}
                at, score, status, error = np.zeros((0, len(NUMBERS))), np.zeros(0), "done", None
                if any(p is None or p["status"] != "ok" for p in (row["pa"], row["pb"])):
                    status = "unreadable"
                else:
                    try:
                        at, score = one_pair(model, row["pa"], row["pb"], row["contacts"])
                    except Exception as e:  # the pair's own failure; the others go on
                        at, score, status, error = np.zeros((0, len(NUMBERS))), np.zeros(0), "failed", f"{type(e).__name__}: {e}"
                n = len(at)
                none = lambda values, kind: pa.array([*values, None], kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([row[c]] * (n + 1), big.schema.field(c).type) for c in PAIR),
                        none(at[:, 0].astype(int).tolist(), pa.int32()),
                        none(at[:, 1].astype(int).tolist(), pa.int32()),
                        none(score.astype(np.float32).tolist(), pa.float32()),
                        *(none(at[:, j].tolist(), pa.float64()) for j in range(2, 8)),
                        pa.array([None] * n + [status], pa.string()),
                        pa.array([None] * n + [error], pa.string()),
                    ],
                    [*PAIR, "translation_id", "patch_idx", "score", "ty", "tx", "ay", "ax", "by", "bx", "status", "error"],
                )

    return joined.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in PAIR) + f", {OUT}")


def scores_of(results: DataFrame) -> DataFrame:
    """The patch scores among the results, with a number for each pair of names."""
    return results.where("status IS NULL").drop("status", "error").withColumn("pair_id", F.xxhash64("a", "b"))


def status_of(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """(a, b, side, status, error) of all pairs (a, b, side): that of the results, else ``no pose``."""
    known = results.where("status IS NOT NULL").select(*PAIR, "status", "error")
    return pairs.select(*PAIR).join(known, PAIR, "left").withColumn("status", F.coalesce("status", F.lit("no pose")))


def unfinished(pairs: DataFrame, status: DataFrame) -> DataFrame:
    """The pairs that have no status yet, or failed."""
    return pairs.join(status.where("status <> 'failed'").select(*PAIR).distinct(), PAIR, "left_anti")


def augmented(images: DataFrame, epoch: int = 0) -> DataFrame:
    """The readable pictures with their colours changed and flipped at random, by a hash of the picture's name and the epoch."""
    names = images.columns

    def run(batches):
        for b in batches:
            ids, data, h, w, c = (b.column(n).to_pylist() for n in ("frag_id", "data", "height", "width", "n_channels"))
            out = [raster.augment(np.frombuffer(d, np.uint8).reshape(y, x, k), f"{one}/{epoch}").tobytes() for one, d, y, x, k in zip(ids, data, h, w, c)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == "data" else b.column(n) for n in names], names)

    return images.where("status = 'ok'").mapInArrow(run, images.schema)
