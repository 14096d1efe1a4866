"""Pixel tables: (image_id, y, x, ...), one row for each pixel. Prefix sums, window filters, morphology, components.

For whole pictures the kernels of ``functions.raster`` do the same on arrays; these relational forms serve masks that are
tables already and pictures too large for one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def integral(px: DataFrame, value: str) -> DataFrame:
    """(image_id, y, x, sat): sums of ``value`` over all pixels up to (y, x), both included."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("r", F.sum(value).over(row)).select("image_id", "y", "x", F.sum("r").over(col).alias("sat"))


def box_sums(boxes: DataFrame, sat: DataFrame, keys: list[str], sum_name: str = "area") -> DataFrame:
    """The boxes (image_id, y0, x0, y1, x1) with the sum over (y0, y1] x (x0, x1]: four lookups, as one join on the corners."""
    corners = F.explode(F.array(*[F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.lit(s).alias("sign")) for y, x, s in (("y1", "x1", 1), ("y0", "x1", -1), ("y1", "x0", -1), ("y0", "x0", 1))]))
    t = boxes.withColumn("c", corners).select(*boxes.columns, F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.col("c.sign").alias("sign"))
    t = t.join(sat.withColumnRenamed("image_id", "_image"), (F.col("image_id") == F.col("_image")) & (t["y"] == sat["y"]) & (t["x"] == sat["x"]))
    return t.groupBy(*boxes.columns).agg(F.sum(F.col("sign") * F.col("sat")).alias(sum_name))


def lattice(images: DataFrame, side: int, stride: int) -> DataFrame:
    """(image_id, y0, x0, y1, x1): windows of ``side`` on a lattice that lie within the images (image_id, h, w)."""
    steps = lambda n: F.when(F.col(n) >= side, F.sequence(F.lit(0), F.col(n) - side, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    t = images.withColumn("y0", F.explode(steps("h"))).withColumn("x0", F.explode(steps("w")))
    return t.select("image_id", "y0", "x0", (F.col("y0") + side - 1).alias("y1"), (F.col("x0") + side - 1).alias("x1"))


def available_windows(windows: DataFrame, available: DataFrame, black: DataFrame, side: int, share: float = 0.9) -> DataFrame:
    """Windows whose available share of side x side is above ``share`` and that hold no black pixel. Sums leave out the first row and column."""
    t = box_sums(windows, available, ["image_id"], "area")
    t = box_sums(t, black, ["image_id"], "dark")
    return t.where((F.col("area") / (side * side) > share) & (F.col("dark") == 0))


def free_windows(px: DataFrame, available: Column, black: Column, side: int, stride: int = 1, share: float = 0.9) -> DataFrame:
    """(image_id, y0, x0): ``available_windows`` of the ``lattice`` of whole pictures that start at (0, 0), without tables of windows and corners.

    A picture's pixels go to one task (pictures are bounded), and prefix sums over all pictures of one size at once leave the windows that pass.
    """
    import numpy as np
    import pyarrow as pa

    from fragloom.functions.batches import group_of, whole_groups

    def run(batches):
        for t, starts in whole_groups(batches, "image_id"):
            y, x, of = t.column("y").to_numpy(), t.column("x").to_numpy(), group_of(starts, t.num_rows)
            h, w = (np.maximum.reduceat(v, starts) + 1 for v in (y, x))
            ids = t.column("image_id").combine_chunks().take(pa.array(starts))
            for size in np.unique(np.column_stack([h, w]), axis=0):
                if size.min() < side:
                    continue
                pictures = np.flatnonzero((h == size[0]) & (w == size[1]))
                place = np.full(len(starts), -1)
                place[pictures] = np.arange(len(pictures))
                mine = np.flatnonzero(place[of] >= 0)
                y0, x0 = (np.arange(0, n - side + 1, stride) for n in size)
                sums = []
                for flag in ("a", "b"):
                    a = np.zeros((len(pictures), *size), np.int64)
                    a[place[of[mine]], y[mine], x[mine]] = t.column(flag).to_numpy()[mine]
                    a = a.cumsum(axis=1).cumsum(axis=2)
                    low, high = (np.ix_(np.arange(len(pictures)), y0 + k, x0 + m) for k, m in ((0, 0), (side - 1, side - 1)))
                    sums.append(a[high] - a[low[0], low[1], high[2]] - a[low[0], high[1], low[2]] + a[low])
                k, i, j = np.nonzero((sums[0] / (side * side) > share) & (sums[1] == 0))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(pictures[k])), pa.array(y0[i].astype(np.int32)), pa.array(x0[j].astype(np.int32))], ["image_id", "y0", "x0"])

    flag = lambda c: F.coalesce(c.cast("tinyint"), F.lit(0).cast("tinyint"))
    rows = px.select("image_id", F.col("y").cast("int"), F.col("x").cast("int"), flag(available).alias("a"), flag(black).alias("b"))
    rows = rows.repartition("image_id").sortWithinPartitions("image_id")
    return rows.mapInArrow(run, f"image_id {dict(px.dtypes)['image_id']}, y0 int, x0 int")


def touch_boxes(poses: DataFrame, point: str, sign: int, side: int, pad: float, height: Column, width: Column) -> DataFrame:
    """Boxes of ``side`` around the contact, moved by ``pad`` along the separation, clipped to the picture."""
    out = poses
    for v, d, size in (("y", "dy", height), ("x", "dx", width)):
        low = (F.col(f"{point}{v}") + sign * pad * F.col(d) - side // 2).cast("int")
        out = out.withColumn(f"{v}0", F.least(F.greatest(low, F.lit(0)), size - 1)).withColumn(f"{v}1", F.least(F.col(f"{v}0") + side, size - 1))
    return out


def inside_border(points: DataFrame, half: int) -> DataFrame:
    """Points at least ``half`` from every border of their picture (h, w)."""
    return points.where((F.col("y") >= half) & (F.col("x") >= half) & (F.col("y") < F.col("h") - half) & (F.col("x") < F.col("w") - half))


def prominent_colours(px: DataFrame, image: str, colour: list[str], cutoff: float = 0.01) -> DataFrame:
    """(image, colour..., n): colours with more than ``cutoff`` of their picture's pixels."""
    n = px.groupBy(image, *colour).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy(image))).where(F.col("n") > F.col("total") * cutoff).drop("total")


def bounding_boxes(px: DataFrame, opaque: Column) -> DataFrame:
    """(image_id, y0, x0, y1, x1) of the opaque pixels; none for a picture without."""
    return px.where(opaque).groupBy("image_id").agg(*[f(v).alias(f"{v}{k}") for k, f in ((0, F.min), (1, F.max)) for v in "yx"])


OFFSETS = {4: [(-1, 0), (0, -1), (0, 1), (1, 0)], 8: [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]}


def dilated(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(image_id, y, x): set pixels and those at the offsets from one."""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(0, 0), *offsets]]))
    return px.select("image_id", "y", "x", shifts.alias("s")).select("image_id", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x")).distinct()


def eroded(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(image_id, y, x): set pixels all of whose neighbours at the offsets are set."""
    shifts = F.explode(F.array(*[F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b")) for a, b in [(0, 0), *offsets]]))
    t = px.select("image_id", "y", "x", shifts.alias("s")).groupBy("image_id", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x")).agg(F.count("*").alias("n"))
    return t.where(F.col("n") == len(offsets) + 1).select("image_id", "y", "x")


def closed(px: DataFrame) -> DataFrame:
    """Closing by a cross of radius 1: dilated, then eroded."""
    return eroded(dilated(px, OFFSETS[4]), OFFSETS[4])


def min_filter(px: DataFrame, value: str, k: int) -> DataFrame:
    """(image_id, y, x, v): smallest value in the square of 2k+1 around each pixel of a full raster, one direction after the other."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-k, k)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-k, k)
    return px.withColumn("r", F.min(value).over(row)).select("image_id", "y", "x", F.min("r").over(col).alias("v"))


def composite(below: DataFrame, above: DataFrame, values: list[str]) -> DataFrame:
    """Pixels of ``above`` where it is opaque (alpha > 0), else of ``below``; colours are 0 where alpha is."""
    up = above.where("alpha > 0").select("image_id", "y", "x", *[F.col(v).alias(f"u_{v}") for v in [*values, "alpha"]])
    t = below.select("image_id", "y", "x", *values, "alpha").join(up, ["image_id", "y", "x"], "full_outer")
    t = t.select("image_id", "y", "x", *[F.coalesce(f"u_{v}", v).alias(v) for v in [*values, "alpha"]])
    return t.select("image_id", "y", "x", *[F.when(F.col("alpha") == 0, 0).otherwise(F.col(v)).alias(v) for v in values], "alpha")


def components(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """(image_id, y, x, label): connected set pixels; the label is the smallest y * 2^20 + x of the component.

    A picture's pixels go to one task (pictures are bounded), and a kernel labels many pictures at once; no rounds of joins are needed.
    """
    import numpy as np
    import pyarrow as pa

    from fragloom.functions.batches import group_of, whole_groups
    from fragloom.functions.raster import label_points

    def run(batches):
        for t, starts in whole_groups(batches, "image_id"):
            y, x, of = t.column("y").to_numpy(), t.column("x").to_numpy(), group_of(starts, t.num_rows)
            # the pictures of a batch are labelled together, one below the other
            labels = label_points(y - y.min() + of * (int(np.ptp(y)) + 2), x, connectivity)
            code = y.astype(np.int64) * (1 << 20) + x.astype(np.int64)
            low = np.full(labels.max(initial=-1) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, labels, code)
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("image_id", "y", "x")] + [pa.array(low[labels])], ["image_id", "y", "x", "label"])

    kinds = dict(px.dtypes)
    rows = px.select("image_id", "y", "x").repartition("image_id").sortWithinPartitions("image_id")
    return rows.mapInArrow(run, f"image_id {kinds['image_id']}, y {kinds['y']}, x {kinds['x']}, label long")


def largest(labelled: DataFrame) -> DataFrame:
    """(image_id, label, n): the component with most pixels; the lowest label on ties."""
    n = labelled.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("image_id").agg(F.max_by(F.struct("label", "n"), F.struct(F.col("n"), -F.col("label"))).alias("m")).select("image_id", "m.label", "m.n")


def blit_boxes(placed: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Pictures of one size put at floor(ty, tx) of a canvas: their columns with the source box (sy0, sy1, sx0, sx1) and the canvas box (ey0, ...); none if nothing is left."""
    out = placed
    for v, n, m in zip("yx", source, target):
        at = F.floor(f"t{v}").cast("int")
        out = out.withColumns({f"s{v}0": F.greatest(F.lit(0), -at), f"s{v}1": F.least(F.lit(n), F.lit(m) - at), f"e{v}0": F.greatest(F.lit(0), at), f"e{v}1": F.least(F.lit(m), at + n)})
    return out.where("sy0 < sy1 AND sx0 < sx1 AND ey0 < ey1 AND ex0 < ex1")


def _pictures(px: DataFrame, value: str, fn, columns: str, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``fn(array)`` for the pixels of each picture (or of each of its ``keys``); fn gives a list of rows."""
    import numpy as np
    import pyarrow as pa

    from fragloom.functions.batches import whole_groups

    names = [c.split()[0] for c in columns.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(batches):
        for t, starts in whole_groups(batches, list(keys)):
            y, x, v = (t.column(c).to_numpy() for c in ("y", "x", value))
            first, rows = [], []
            for i, j in zip(starts, np.append(starts[1:], t.num_rows)):
                a = np.zeros((int(y[i:j].max()) + 1, int(x[i:j].max()) + 1), np.int64)
                a[y[i:j], x[i:j]] = v[i:j]
                found = fn(a)
                first += [int(i)] * len(found)
                rows += found
            of = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays([t.column(k).combine_chunks().take(of) for k in keys] + [pa.array([r[n] for r in rows], types[c.split()[1]]) for n, c in enumerate(columns.split(", "))], [*keys, *names])

    kinds = dict(px.dtypes)
    rows = px.select(*keys, "y", "x", value).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {columns}")


def opaque_boxes(px: DataFrame, least: int = 250) -> DataFrame:
    """(image_id, y0, x0, y1, x1) of the opaque pixels that an opening by a 3 x 3 square leaves; none for a picture without."""
    import numpy as np

    from fragloom.functions import raster as kernels

    def box(alpha):
        y, x = np.nonzero(kernels.opening(alpha > least))
        return [(int(y.min()), int(x.min()), int(y.max()), int(x.max()))] if len(y) else []

    return _pictures(px, "alpha", box, "y0 int, x0 int, y1 int, x1 int")


def traced(px: DataFrame, pad: int = 1, hole_area: int = 4) -> DataFrame:
    """(image_id, k, y, x): the outline of each picture's largest piece."""
    from fragloom.functions import raster as kernels

    return _pictures(px, "alpha", lambda a: [(k, float(y), float(x)) for k, (y, x) in enumerate(kernels.contour_from_alpha(a, pad, hole_area))], "k int, y double, x double")


def clear_contacts(contacts: DataFrame, black: DataFrame, side: int) -> DataFrame:
    """Contacts (image_id, y, x, h, w) whose square of ``side`` lies within the picture and holds no black pixel. black: ``integral`` of the black ones."""
    half = side // 2
    boxes = inside_border(contacts, half).select("image_id", "y", "x").withColumns({f"{v}{k}": F.col(v) - half + k * side for v in "yx" for k in (0, 1)})
    boxes = boxes.withColumnsRenamed({"y": "cy", "x": "cx"})
    return box_sums(boxes, black, ["image_id"], "dark").where("dark = 0").select("image_id", F.col("cy").alias("y"), F.col("cx").alias("x"))


def clear_touches(touches: DataFrame, black: DataFrame, side: int, pad: float, height: Column, width: Column) -> DataFrame:
    """Touch points (image_id, m, ay, ax, by, bx, dy, dx) with no black pixel in the box of a, moved back by ``pad`` along the separation, nor in that of b, moved on."""
    left = touches
    for point, sign in (("a", -1), ("b", 1)):
        boxes = touch_boxes(touches, point, sign, side, pad, height, width).select("image_id", "m", "y0", "x0", "y1", "x1")
        dark = box_sums(boxes, black, ["image_id"], "dark").where("dark > 0").select("image_id", "m")
        left = left.join(dark, ["image_id", "m"], "left_anti")
    return left


def colour_contours(px: DataFrame, cutoff: float = 0.01, pad: int = 10, hole_area: int = 1000) -> DataFrame:
    """(image_id, r, g, b, k, y, x): the outline of the largest piece of each prominent colour of a mask (image_id, y, x, r, g, b, a)."""
    from fragloom.functions import raster as kernels
    from fragloom.operators.palette import colour_masks

    masks = colour_masks(px, cutoff).withColumn("set", F.lit(255))
    trace = lambda a: [(k, float(y), float(x)) for k, (y, x) in enumerate(kernels.contour_from_alpha(a, pad, hole_area))]
    return _pictures(masks, "set", trace, "k int, y double, x double", ("image_id", "r", "g", "b"))


def max_stack(px: DataFrame, stack: str, value: str) -> DataFrame:
    """(stack, y, x, value): the largest value of all pictures of a stack at each place."""
    return px.groupBy(stack, "y", "x").agg(F.max(value).alias(value))


def square_crop(px: DataFrame, squares: DataFrame, side: int) -> DataFrame:
    """The pixels of one square of ``side`` for each picture (image_id, y0, x0, h, w), counted from its corner; squares that do not lie within the picture give none."""
    inside = squares.where((F.col("y0") >= 0) & (F.col("x0") >= 0) & (F.col("y0") + side <= F.col("h")) & (F.col("x0") + side <= F.col("w"))).select("image_id", "y0", "x0")
    t = px.join(inside, "image_id").where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + side) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + side))
    return t.withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).drop("y0", "x0")


def gathered(mask: DataFrame, src: DataFrame, ty: Column, tx: Column, pedantic: bool = True, shape: tuple[int, int] | None = None) -> DataFrame:
    """The pixels of a mask (image_id, y, x) with the values of src at int(index - t): an equi-join on the places.

    Places outside src are left out; if not ``pedantic``, negative ones count from the end of src's ``shape`` as array indexes do.
    """
    at = {"sy": (F.col("y") - ty).cast("int"), "sx": (F.col("x") - tx).cast("int")}
    wanted = mask.select("image_id", "y", "x", *[c.alias(n) for n, c in at.items()])
    if not pedantic:
        wanted = wanted.withColumns({c: F.when(F.col(c) < 0, F.col(c) + n).otherwise(F.col(c)) for c, n in zip(("sy", "sx"), shape)})
    return wanted.join(src.withColumnsRenamed({"y": "sy", "x": "sx"}), ["image_id", "sy", "sx"]).drop("sy", "sx")


def soft_mask(px: DataFrame, a: str, b: str, strength: float, combine: str = "sum") -> DataFrame:
    """The pixels with alpha: ``strength`` for each of two masks (boolean columns), added up to 255, or the larger."""
    one, two = (F.when(F.col(c), strength).otherwise(0.0) for c in (a, b))
    alpha = F.least(one + two, F.lit(255.0)) if combine == "sum" else F.greatest(one, two)
    return px.withColumn("alpha", alpha.cast("int"))


def filled(points: DataFrame, shape: tuple[int, int], shift: float = 0.0) -> DataFrame:
    """(frag_id, y, x0, x1): the rows of pixels whose centres lie in each outline (frag_id, k, y, x) moved by ``shift``, even-odd, clipped to the shape."""
    import numpy as np
    import pyarrow as pa

    from fragloom.functions import raster as kernels
    from fragloom.functions.batches import whole_groups

    def run(batches):
        for t, starts in whole_groups(batches, "frag_id"):
            p = np.column_stack([t.column("y").to_numpy(), t.column("x").to_numpy()]) + shift
            out = []
            for i, j in zip(starts, np.append(starts[1:], t.num_rows)):
                area = np.pad(kernels.fill_polygon(p[i:j], shape).astype(np.int8), ((0, 0), (1, 1)))
                step = np.diff(area, axis=1)
                (y, lo), hi = np.nonzero(step == 1), np.nonzero(step == -1)[1] - 1
                out.append((np.full(len(y), i), y, lo, hi))
            of, y, lo, hi = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([t.column("frag_id").combine_chunks().take(pa.array(of)), *(pa.array(v.astype(np.int32)) for v in (y, lo, hi))], ["frag_id", "y", "x0", "x1"])

    rows = points.select("frag_id", "k", "y", "x").repartition("frag_id").sortWithinPartitions("frag_id", "k")
    return rows.mapInArrow(run, f"frag_id {dict(points.dtypes)['frag_id']}, y int, x0 int, x1 int")
