"""Embedding near-duplicates by collision counting on one-dimensional projections.

Vectors are normalised in double precision; equal ones form one class with a multiplicity, so copies are never paired. Every class is
projected on random directions.

Filing. TABLES tables each deal the classes out by DEPTH projections cut into cells of width CELL, and sort the classes of a cell by one more projection.
There, a window of WINDOW centred on each class in turn (the query) holds the classes that it is compared with. DEPTH grows with the logarithm of the number of classes, so windows keep about the same size, and the
number of tables follows from the recall RECALL that is asked for at the threshold cosine. Without the cells every projection would be sorted whole, and
windows that must hold most links hold a third of all vectors.
Counting. Within a window, each pair's collisions are counted over COUNTED further projections: a collision is a distance of at
most WIDTH, again a window centred on the query. A pair needs as many collisions as a pair at the threshold reaches with the probability COUNT_RECALL
(its distances are normal, so the count is binomial).
Verifying. Pairs with the count are verified by the cosine in double precision. A pair that met in an earlier table is left to that one.

Nothing is paired outside its cell; a cell beyond TILE classes is cut into tiles whose pairs are dealt out as tasks. Links are counted in the task, and only
links to the smallest member of each local group are handed on for the components. Vectors of different lengths never meet: the length is part of a cell's name.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component; a
vector is compared with all others of its own length; repeated rows are rows of their own; a null vec_id keeps its links but no id; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import textcols as tc

COSINE = 0.95
RECALL = 0.995
CELL = 2.25
WINDOW = 0.8
WIDTH = 0.6
COUNTED = 24
COUNT_RECALL = 0.999
#: Classes that a window shall hold by chance, about, and the classes of a tile: one comparison takes two tiles at most.
FILL = 256
TILE = 1024
SEED = 42


def same_cell(sigma: float, cell: float = CELL) -> float:
    """Chance that two values with a normal difference of this deviation fall into one cell of a randomly shifted grid."""
    r = cell / sigma
    return erf(r / sqrt(2)) - sqrt(2 / pi) / r * (1 - exp(-r * r / 2))


def in_window(sigma: float, width: float = WINDOW) -> float:
    """Chance that a normal difference of this deviation is at most ``width``."""
    return erf(width / sigma / sqrt(2))


def settings(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, int]:
    """(depth, tables, least count) for n classes."""
    sigma = sqrt(2 - 2 * cosine)
    depth = max(1, ceil(log(max(n * in_window(sqrt(2)) / FILL, 2)) / -log(same_cell(sqrt(2)))))
    tables = ceil(log(1 - recall) / log(1 - in_window(sigma) * same_cell(sigma) ** depth))
    p = in_window(sigma, WIDTH)
    least, tail = COUNTED, 0.0
    while least > 0:
        tail += comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least)
        if tail >= COUNT_RECALL:
            break
        least -= 1
    return depth, tables, least


def directions(dim: int, depth: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Directions of the cells, shifts of their grids, the direction that each table sorts by, and those that collisions are counted on."""
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((dim, depth * tables)), rng.random(depth * tables), rng.standard_normal((dim, tables)), rng.standard_normal((dim, COUNTED))


def unit(column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(x: np.ndarray, depth: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector in each table, and its place in the order of that table. A vector's values do not depend on the others of its batch."""
    a, shift, order, _ = directions(x.shape[1], depth, tables)
    weights = (np.random.default_rng(SEED + 1).integers(1, 1 << 62, depth, np.int64) | 1).view(np.uint64)
    grid = np.floor(np.einsum("ij,jk->ik", x, a) / CELL + shift).astype(np.int64).view(np.uint64).reshape(len(x), tables, depth)
    with np.errstate(over="ignore"):
        cells = tc.mix((grid * weights).sum(axis=2, dtype=np.uint64)).view(np.int64)
    return cells, np.einsum("ij,jk->ik", x, order).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that can have links: finite and not zero."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return d.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(v, id, times): equal vectors as one class, named by its smallest vec_id (a number past all ids if it has none)."""
    name = F.lit(1 << 62) + F.pmod(F.xxhash64("v"), F.lit(1 << 61))
    return vectors.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("times")).select("v", F.coalesce("low", name).alias("id"), "times")


def _by_length(t):
    """Pieces of a table whose vectors are of one length each."""
    size = pc.list_value_length(t.column("v")).to_numpy()
    cut = [0, *(np.flatnonzero(np.diff(size)) + 1), len(size)]
    for i, j in zip(cut, cut[1:]):
        if j > i:
            yield i, t.slice(i, j - i)


def filed(classes: DataFrame, depth: int, tables: int) -> DataFrame:
    """Each class once for every table, with its cell there and its place in the order of the cell."""
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                for _, b in _by_length(big.slice(at, 256)):
                    cell, place = cells_of(unit(b.column("v")), depth, tables)
                    row = pa.array(np.tile(np.arange(b.num_rows), tables))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.arange(tables, dtype=np.int32), b.num_rows)),
                            pa.array(cell.T.ravel()),
                            pa.array(np.ascontiguousarray(place.T).ravel()),
                            pc.cast(pc.list_value_length(b.column("v")), pa.int32()).take(row),
                            *(b.column(c).take(row) for c in ("id", "times", "v")),
                        ],
                        ["t", "cell", "place", "dim", "id", "times", "v"],
                    )

    return tc.map_arrow(classes.select("id", "times", "v"), run, f"t int, cell long, place float, dim int, id long, times long, v {kind}")


def _compared(batches, depth: int, tables: int, least: int, cosine: float):
    """Links found in each cell: (id, v, links, low) - how many vectors a class links with here, and the smallest id that it reaches here."""
    for whole, _ in common.group_runs(batches, ["dim", "t", "cell", "low", "high"]):
        for _, t in _by_length(whole):
            yield from _links(t, depth, tables, least, cosine)


def _links(t, depth: int, tables: int, least: int, cosine: float):
    starts = common.starts_of(t, ["t", "cell", "low", "high"])
    size = np.diff(np.append(starts, t.num_rows))
    if size.max(initial=0) < 2:
        return
    x = unit(t.column("v"))
    near = (x @ directions(x.shape[1], depth, tables)[3]).astype(np.float32)
    ids, times, table, own, low, high, place = (t.column(c).to_numpy() for c in ("id", "times", "t", "own", "low", "high", "place"))
    end = np.repeat(np.append(starts[1:], t.num_rows), size)
    links, a, b = np.zeros(t.num_rows, np.int64), [], []
    i = np.arange(t.num_rows)
    for d in range(1, int(size.max())):
        i = i[i + d < end[i]]
        i = i[place[i + d] - place[i] <= WINDOW]  # sorted: what is out of the window of i stays out
        if not len(i):
            break
        for part in np.array_split(i, max(1, len(i) // 100_000)):
            # two tiles meet: pairs within one tile belong to that tile's own task
            at = part[(low[part] == high[part]) | (own[part] != own[part + d])]
            at = at[(np.abs(near[at] - near[at + d]) <= WIDTH).sum(axis=1) >= least]
            at = at[np.einsum("ij,ij->i", x[at], x[at + d]) >= cosine]
            if len(at):
                rows, code = np.unique(np.concatenate([at, at + d]), return_inverse=True)
                cells, places = cells_of(x[rows], depth, tables)
                one, two = code[: len(at)], code[len(at) :]
                met = (cells[one] == cells[two]) & (np.abs(places[one] - places[two]) <= WINDOW) & (np.arange(tables)[None, :] < table[at][:, None])
                at = at[~met.any(axis=1)]
                np.add.at(links, at, times[at + d])
                np.add.at(links, at + d, times[at])
                a.append(at)
                b.append(at + d)
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        unique, code = np.unique(ids, return_inverse=True)
        label = common.local_labels(code[a], code[b], len(unique))
        some = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), t.column("v").combine_chunks().take(pa.array(some)), pa.array(links[some]), pa.array(unique[label[code[some]]])], ["id", "v", "links", "low"])


def links_of(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(id, mark, links, low): partial counts of links, one row for each class and cell that has some; mark tells apart classes that share an id."""
    n = classes.count()
    depth, tables, least = settings(n, cosine, recall)
    keys = ["dim", "t", "cell"]
    table = filed(classes, depth, tables)
    sizes = table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("again", F.xxhash64(*keys))
    table = table.withColumn("again", F.xxhash64(*keys)).join(sizes, [*keys, "again"])
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("v", "t"), tiles).cast("int")
    each = table.select(*keys, "place", "id", "times", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    each = each.select(*keys, "place", "id", "times", "v", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    by = [*keys, "low", "high"]
    kind = classes.schema["v"].dataType.simpleString()
    found = tc.map_arrow(each.repartition(*by).sortWithinPartitions(*by, "place"), lambda it: _compared(it, depth, tables, least, cosine), f"id long, v {kind}, links long, low long")
    return found.select("id", F.xxhash64("v").alias("mark"), "links", "low")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    good = usable(vectors)
    classes = common.written(classes_of(good), "embeddings-classes")
    found = common.written(links_of(classes, cosine, recall), "embeddings-links")
    counts = found.groupBy("id", "mark").agg(F.sum("links").alias("links"))
    edges = found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    reached = common.components(edges, "embeddings-components").select(F.col("node").alias("id"), "component")
    named = classes.withColumn("mark", F.xxhash64("v")).join(counts, ["id", "mark"], "left").join(reached, "id", "left")
    named = common.written(named.select("v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "embeddings-named")
    common.delete(classes, found)
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    out = whole.join(named, "v", "left")
    component = F.when(F.col("component") < (1 << 62), F.col("component"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links at cosine 0.95 and its component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a, e AS b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, r.c AS component_id, r.c = e.vec_id AS kept
FROM e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS r ON r.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) AS l ON l.a = e.vec_id
"""
