"""What the operators share on Spark's side: training samples, the shared folder, connected components."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Used only where the session names no folder and runs on this machine alone, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. A cluster's session has to name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or DEFAULT_SHARED).rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them back.

    A lost executor takes nothing with it, and later jobs do not repeat the work. What ``delete`` has not deleted by then goes when the driver ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path, store = _path(spark, at)
    store.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def delete(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for the tables, once nothing reads them any more."""
    for df in tables:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path, store = _path(df.sparkSession, f)
            store.delete(path, True)


def release() -> None:
    """Give this process's freed memory back to the system, which training leaves much of."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id, n: int):
    """crc32 of the document's id as text, modulo n: how the contracts deal labels into folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


#: Bytes of text of one class that a sample holds at most, but for its last text.
SAMPLE_BYTES = 4 << 20


def labelled_sample(documents: DataFrame, labelled: DataFrame, per_class: list[int], most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y) of at most per_class[y] documents of each class y of ``labelled`` (doc_id, y), and at most ``most_bytes`` of their texts.

    Texts are taken whole, in the order of a hash of doc_id, so the sample is the same for any partitioning. Only ids and
    labels are ordered; at most so many ids are then broadcast to the scan of the texts. Where ids repeat, rows are ordered by their texts too.
    """
    ids = labelled.where("doc_id IS NOT NULL AND y IS NOT NULL").distinct()
    h = F.xxhash64("doc_id")
    chosen = None
    for y, n in enumerate(per_class):
        one = ids.where(F.col("y") == y).orderBy(h, "doc_id").limit(n)
        chosen = one if chosen is None else chosen.unionByName(one)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    order = Window.partitionBy("y").orderBy(h, "doc_id", F.xxhash64("text"), "text")
    size = F.octet_length("text")
    held = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1))
    bound = F.element_at(F.array(*map(F.lit, per_class)), F.col("y") + 1)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("held", F.coalesce(held, F.lit(0)))
    return rows.where((F.col("place") <= bound) & (F.col("held") < F.lit(most_bytes or SAMPLE_BYTES))).select("doc_id", "text", "y")


def components(edges: DataFrame, what: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each end of an edge can reach.

    ``edges`` has columns a, b of one orderable type. Alternates two steps on a table of edges until it stays the same: every node hands
    its larger neighbours to its smallest one, then its smaller neighbours to the smallest. Each step is a min by
    key, which is pre-aggregated before its shuffle, and an equi-join that Spark may split at hot keys. No more rows than edges ever exist.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), what)
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _join_low(both, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _join_low(large, large.groupBy("u").agg(F.min("v").alias("m"))).select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()
        after = written(small, what)
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        delete(e)
        e = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _join_low(rows: DataFrame, low: DataFrame) -> DataFrame:
    """rows joined with (u, m) on u. A second key makes Spark deal out both sides anew, so that it can split a hot u."""
    again = F.xxhash64("u")
    return rows.withColumn("again", again).join(low.withColumn("again", again), ["u", "again"])


def group_runs(batches, keys: list[str], least: int = 50_000, weight=lambda b: b.num_rows):
    """Record batches sorted by ``keys`` -> tables that hold whole groups, about ``least`` rows (or what ``weight`` counts) or one group in each.

    Returns (table, starts): starts are the rows at which groups begin.
    """
    kept: list[pa.RecordBatch] = []
    rows, wanted = 0, least
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        rows += weight(b)
        if rows < wanted:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        starts = starts_of(t, keys)
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1])), starts[:-1]
        kept = t.slice(int(starts[-1])).combine_chunks().to_batches()
        rows = sum(map(weight, kept))
        wanted = rows + least  # a group longer than that is not looked through again for each batch
    if kept:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, starts_of(t, keys)


def starts_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows of a sorted table at which groups of equal keys begin."""
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for k in keys:
        x = t.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable number of each of 0..n-1 under the links a-b, within one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
