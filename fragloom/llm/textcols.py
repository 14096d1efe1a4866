"""Column-at-a-time text helpers shared by the operators of this subpackage.

Everything here works on whole Arrow columns: a batch of texts becomes one flat array of
words plus the offsets of each text, so that no per-word Python loop is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from . import common

#: Bytes of text that one step of a kernel takes at most (one text may be longer). A kernel takes up to fifty times that for a moment.
CHUNK_BYTES = 4 << 20

MASK64 = (1 << 64) - 1


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches put together or cut so that each holds about ``limit`` bytes of ``column``."""
    kept: list[pa.RecordBatch] = []
    held = 0
    free = pa.default_memory_pool().release_unused
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        piece = (held + np.cumsum(size)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if k:
                yield _one(kept)
                kept, held = [], 0
                free()
            kept.append(batch.slice(a, b - a))
            held += int(size[a:b].sum())
        if held >= limit:
            yield _one(kept)
            kept, held = [], 0
    if kept:
        yield _one(kept)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def as_text(column: pa.Array) -> pa.Array:
    """The column as strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one flat array; offsets[i]:offsets[i+1] are those of text i."""
    lists = pc.ascii_split_whitespace(as_text(column))
    words = lists.flatten()
    at = lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(words), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        before = np.concatenate([[0], np.cumsum(keep)])
        words, at = words.filter(full), before[at]
    return words, at


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words, and the distinct words that the codes point to."""
    if not len(words):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    d = words.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def hashed(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def joined(words: pa.Array) -> np.ndarray:
    """The bytes of all strings, one after the other."""
    if not len(words):
        return np.zeros(0, np.uint8)
    return np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer() or b"", np.uint8)


def _quick_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of an odd number and of its inverse modulo 2**64."""
    if not _TABLES or len(_TABLES[1]) < n:
        base = 0x9E3779B97F4A7C15
        powers = [np.full(2 * n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for p in powers:
            p[0] = 1
            np.cumprod(p, out=p)
        _TABLES[:] = [np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64, endpoint=False), *powers]
    return tuple(_TABLES)


_TABLES: list[np.ndarray] = []


def quick_hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, for all of them at once. For words and blocks whose equality is checked later; ``hashed`` is the stronger one."""
    words = words.cast(pa.string())
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    flat = joined(words)
    value, power, inverse = _quick_tables(len(flat) + 1)
    with np.errstate(over="ignore"):
        upto = np.concatenate([[np.uint64(0)], np.cumsum(value[flat] * power[: len(flat)], dtype=np.uint64)])
        return mix((upto[at[1:]] - upto[at[:-1]]) * inverse[at[:-1]] + size.astype(np.uint64))


def ascii_lower(column: pa.Array) -> pa.Array:
    """Lower-case A-Z alone."""
    return pc.ascii_lower(column)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The number of its text for each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i; 0 for an empty segment."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def grams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive words at each position of each text, and their offsets."""
    size = np.diff(offsets)
    if n == 1:
        return h, offsets
    room = np.maximum(size - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(room)])
    keep = np.arange(len(h)) - np.repeat(offsets[:-1], size) < np.repeat(room, size)
    start = np.flatnonzero(keep)
    out = h[start].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[start + k])
    return out, at


#: Rows that Spark puts into one Arrow batch. Ten thousand whole texts, Spark's default, would take several times this memory outside the heap.
ROWS_PER_BATCH = 1000
#: Bytes of such a batch, where Spark knows that limit: a thousand pairs of long texts take as much as ten thousand texts.
BYTES_PER_BATCH = 8 << 20


def map_arrow(df, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema):
    """``mapInArrow`` with batches of at most ROWS_PER_BATCH rows and about BYTES_PER_BATCH bytes. After each task its worker, which waits for others, gives freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            common.release()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS_PER_BATCH:
        conf.set(key, ROWS_PER_BATCH)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    return df.mapInArrow(run, schema)
