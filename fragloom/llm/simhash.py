"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints of 3-word shingles; fingerprints within ``radius`` bits are linked. Documents of one fingerprint are one
class, so copies are never paired. Over the distinct fingerprints:

1. bits that go together in a bounded sample are put into the same part (m parts);
2. each part gets a threshold t >= -1, with sum(t + 1) = radius + 1: two fingerprints within ``radius`` bits are then within
   t bits of each other in some part. Thresholds and m come from a dynamic programme on estimated numbers of candidates;
3. a fingerprint is filed under its part with every choice of t bits blanked; those in one file are verified in blocks;
4. a file beyond TILE rows is cut into tiles and its tile pairs are dealt out as tasks; one beyond TILE x TILES rows is first filed again, under each of
   radius + 1 parts of the bits that it leaves open: two of its fingerprints agree in one of those. That goes on until files are small or no bits are left.

The sample only chooses the plan: any plan finds every link.

Defined results: null and empty texts have fingerprint zero and are linked like others; a text of fewer words than a shingle is one shingle; repeated rows are
kept; a row without doc_id is linked like others, and gets the smallest id that it reaches (null if it reaches none); an empty table gives no rows; other columns are
passed by, whatever their names. Very long texts are hashed whole.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import common
from . import textcols as tc

RADIUS = 3
SHINGLE = 3
#: Fingerprints that the plan looks at, at most about.
SAMPLE = 20_000
TILE = 512
TILES = 64
#: Cost of one compared pair against one filed row.
PAIR_COST = 0.02


def _counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, how many of its hashes have each bit: byte lanes of a word count eight bits at once, up to 255 hashes a block."""
    size = np.diff(at)
    full = np.flatnonzero(size > 0)
    blocks = -(-size[full] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    starts = np.repeat(at[:-1][full], blocks) + 255 * k
    out = np.zeros((len(size), 64), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & np.uint64(0x0101010101010101), starts)
        per_block = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[full, shift::8] = np.add.reduceat(per_block, first[:-1], axis=0)
    return out


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash of each text's hashes: the bits that are set in over half of them."""
    bits = (2 * _counts(h, at) > np.diff(at)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text."""
    words, at = tc.split_words(pc.ascii_lower(tc.as_text(texts)))
    if not len(words):
        return np.zeros(len(texts), np.uint64)
    flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer().to_pybytes()
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    end = begin + length
    size = np.diff(at)
    n = np.where(size >= shingle, size - shingle + 1, np.minimum(size, 1))
    cut = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(cut[-1]) - np.repeat(cut[:-1], n) + np.repeat(at[:-1], n)
    last = np.minimum(first + shingle - 1, np.repeat(at[1:], n) - 1)
    digest = xxhash.xxh64_intdigest
    h = np.empty(len(first), np.uint64)
    for k in range(0, len(first), 50_000):
        span = slice(k, k + 50_000)
        h[span] = [digest(flat[a:b], seed) for a, b in zip(begin[first[span]].tolist(), end[last[span]].tolist())]
    return majority(h, cut)


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits as a signed number."""

    def run(batches):
        for b in tc.chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints_of(b.column("text"), shingle).view(np.int64))], ["doc_id", "fp"])

    return tc.map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal width; bits that correlate most stand together."""
    with np.errstate(divide="ignore", invalid="ignore"):  # a bit that all share correlates with none
        c = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 2 else np.zeros((64, 64))
    np.fill_diagonal(c, 0)
    free, parts = list(range(64)), []
    for p in range(m):
        width = (64 * (p + 1)) // m - (64 * p) // m
        part = [max(free, key=lambda b: (c[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            b = max(free, key=lambda b: (c[b, part].mean(), -b))
            part.append(b)
            free.remove(b)
        parts.append(sorted(part))
    return parts


def _near(bits: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """Estimated chance that two fingerprints differ in at most 0..most bits of the part: the larger of the sample's pairs and independent bits."""
    q = bits.mean(axis=0)[part] if len(bits) else np.full(len(part), 0.5)
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for differ in 2 * q * (1 - q):
        dist = dist * (1 - differ) + np.concatenate([[0.0], dist[:-1]]) * differ
    half = len(bits) // 2
    d = (bits[:half, part] != bits[half : 2 * half, part]).sum(axis=1) if half else np.zeros(0)
    seen = np.array([(d <= t).mean() if half else 0.0 for t in range(most + 1)])
    return np.maximum(np.cumsum(dist), seen)


def plan(bits: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits of a part, threshold) of the cheapest allocation for n fingerprints."""
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for m in range(1, radius + 2):
        parts = grouped_bits(bits, m)
        # state: sum of (t + 1) so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            near = _near(bits, part, radius)
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in states.items():
                for t in range(-1, radius + 1 - used):
                    keys = comb(len(part), t) if t >= 0 else 0
                    c = cost + (n * keys + PAIR_COST * n * n / 2 * near[t] * max(t, 1) if t >= 0 else 0.0)
                    if used + t + 1 not in after or c < after[used + t + 1][0]:
                        after[used + t + 1] = (c, [*chosen, t])
            states = after
        cost, chosen = states.get(radius + 1, (np.inf, []))
        if cost < best[0]:
            best = (cost, [(p, t) for p, t in zip(parts, chosen) if t >= 0])
    return best[1]


def masks_of(planned: list[tuple[list[int], int]]) -> list[int]:
    """Bit masks of all files: the part without each choice of t bits."""
    out = []
    for part, t in planned:
        whole = sum(1 << b for b in part)
        out += [whole & ~sum(1 << b for b in blank) for blank in combinations(part, t)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _verified(batches, radius: int):
    """Pairs within a file that differ in at most ``radius`` bits, as links from each member to the smallest one that it reaches there."""
    for t, starts in common.group_runs(batches, ["mask", "value", "low", "high"]):
        signed = t.column("fp").to_numpy()
        fp = signed.view(np.uint64)
        end = np.repeat(np.append(starts[1:], len(fp)), np.diff(np.append(starts, len(fp))))
        i = np.arange(len(fp))
        a, b = [], []
        for d in range(1, int(np.diff(np.append(starts, len(fp))).max(initial=1))):
            i = i[i + d < end[i]]
            if not len(i):
                break
            hit = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            a.append(hit)
            b.append(hit + d)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if not len(a):
            continue
        unique, code = np.unique(signed, return_inverse=True)
        label = common.local_labels(code[a], code[b], len(unique))
        moved = np.flatnonzero(label != np.arange(len(unique)))
        yield pa.RecordBatch.from_arrays([pa.array(unique[moved]), pa.array(unique[label[moved]])], ["a", "b"])


def refined(mask: int, radius: int) -> list[int]:
    """The masks under which a huge file is filed again: its own with each of radius + 1 parts of the bits that it leaves open; none if too few are open."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) < 4 * (radius + 1):
        return []
    return [mask | sum(1 << b for b in free[k :: radius + 1]) for k in range(radius + 1)]


def _again(rows: DataFrame, masks: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """The rows (mask, fp) of huge files under the masks that refine theirs, and those masks."""
    finer = {m: refined(m, radius) for m in masks}
    pairs = [x for m, ms in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)).cast("long") for x in ms]))]
    each = rows.select("fp", F.explode(F.element_at(F.create_map(*pairs), F.col("mask"))).alias("mask"))
    return each.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp").distinct(), sorted({x for ms in finer.values() for x in ms})


def linked(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join every two of the distinct fingerprints (fp) that differ in at most ``radius`` bits."""
    n = prints.count()
    h = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = sorted(r["fp"] for r in prints.where(h < min(1.0, SAMPLE / max(n, 1))).select("fp").take(2 * SAMPLE))
    rng = np.random.default_rng(42)
    seen = rng.permutation(np.array(sample, np.int64).view(np.uint64)).astype("<u8")
    bits = np.unpackbits(seen.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    masks = masks_of(plan(bits, n, radius))
    filed = prints.select("fp", F.explode(F.array(*[F.lit(_signed(x)).cast("long") for x in masks])).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    found = None
    while True:
        sizes = common.written(filed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("again", F.xxhash64("mask", "value")), "simhash-sizes")
        filed = filed.withColumn("again", F.xxhash64("mask", "value")).join(sizes, ["mask", "value", "again"]).drop("again")
        open_ = [m for m in masks if refined(m, radius)]
        huge = (F.col("n") > TILE * TILES) & F.col("mask").isin([_signed(m) for m in open_])
        pairs = _tiled(filed.where(~huge), radius)
        found = pairs if found is None else found.unionByName(pairs)
        if not open_ or sizes.where(huge).isEmpty():
            return found.distinct()
        rest = common.written(filed.where(huge).select("mask", "fp"), "simhash-huge")
        filed, masks = _again(rest, [r["mask"] & tc.MASK64 for r in rest.select("mask").distinct().collect()], radius)


def _tiled(filed: DataFrame, radius: int) -> DataFrame:
    """Links within the files (mask, value, fp; n: how many rows the file has), cut into tiles."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp", "mask"), tiles).cast("int")
    each = filed.select("mask", "value", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    each = each.select("mask", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    keys = ["mask", "value", "low", "high"]
    return tc.map_arrow(each.repartition(*keys).sortWithinPartitions(*keys), lambda it: _verified(it, radius), "a long, b long")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id): every fingerprint of the rows (doc_id, fp) with the smallest doc_id that it reaches, null if it reaches none."""
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-classes")
    reached = common.components(linked(classes.select("fp"), radius), "simhash-links").select(F.col("node").alias("fp"), "component")
    named = common.written(classes.join(reached, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component")), "simhash-named")
    low = named.groupBy("component").agg(F.min("id").alias("component_id"))
    out = common.written(named.select("fp", "component", F.xxhash64("component").alias("again")).join(low.withColumn("again", F.xxhash64("component")), ["component", "again"]).select("fp", "component_id"), "simhash-components")
    common.delete(classes, named)
    return out


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id: the smallest doc_id reachable by links."""
    prints = common.written(fingerprints(documents, shingle), "simhash")
    return prints.join(_components(prints, radius), "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The documents, with all their columns, that stand first in their component, by doc_id. Of repeated rows one stays; rows without doc_id all stay.

    Only ids and fingerprints are written on the way; the texts are read again and lose the rows that go by an anti-join.
    With ``similarity``, links are texts whose shingles have that Jaccard similarity: candidates by longer fingerprints in bands of bits, verified (``similar``).
    """
    if similarity is not None:
        from . import similar

        return similar.one_of_each(documents, similarity, shingle)
    id_ = F.col("doc_id").cast("long")
    prints = common.written(fingerprints(documents, shingle), "simhash")
    named = _components(prints, radius)
    twice = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    gone_id, at_fp, head_fp, head_id = common.fresh(documents, "gone_id", "at_fp", "head_fp", "head_id")
    if twice.isEmpty():
        gone = prints.join(named, "fp").where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id))
        return documents.join(common.written(gone, "simhash-gone"), id_ == F.col(gone_id), "left_anti")
    # ids are no key: rows go by id and fingerprint, and of the rows that stay under one id and fingerprint one is kept
    names = documents.columns
    schema = StructType(documents.schema.fields[:]).add(at_fp, LongType())

    def run(batches):
        for b in tc.chunks(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fingerprints_of(b.column("text"), shingle).view(np.int64))], [*names, at_fp])

    marked = tc.map_arrow(documents, run, schema)
    # a component's first document: of those with its smallest id the one with the smallest fingerprint
    heads = prints.join(named, "fp").where("doc_id = component_id").groupBy("component_id").agg(F.min("fp").alias(head_fp)).withColumnRenamed("component_id", head_id)
    spread = prints.join(named, "fp").where("doc_id = component_id").select(F.col("fp").alias(head_fp), F.col("component_id").alias(head_id)).distinct()
    heads = spread.join(heads, [head_fp, head_id], "left_semi")
    first = marked.join(heads, (F.col(at_fp) == F.col(head_fp)) & (id_ == F.col(head_id)), "left_semi").dropDuplicates(["doc_id", at_fp])
    return first.select(*[F.col(f"`{c}`") for c in names]).unionByName(documents.where("doc_id IS NULL"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
