"""Substring dedup: remove the words of every window of 35 words that also starts anywhere else, by levels of ever longer repeated windows.

A window's hash is built by doubling: 1, 2, 4, 8, 16, 32 words, and two of 32 that overlap make 35. Candidates are
narrowed level by level, and only windows repeated at one level are extended to the next:

level 8   Every 35-word window holds 28 windows of 8 words; the one with the smallest hash is its anchor. Equal windows have equal
          anchors, so a window whose anchor occurs once is dropped. Neighbouring windows share an anchor: such a run of windows is one row.
runs      Runs with a repeated anchor are extended to all their words (35 to 62). If the whole run occurs again, all its windows do: they are
          settled without a row for each window. One run of each kind stands for the others at the next level.
level 35  The windows of the runs left over, and those of the representatives, are counted by hash.

What moves between machines is runs and hashes, and the texts twice, compressed. Counts are pre-aggregated, and hot windows only meet in joins that Spark may split.
What is compared at the end has 128 bits (a whole run by its hash and its anchor's, a window by two hashes), so that of 1e13 windows no two unequal ones are expected to agree.

Defined results: a null or empty text has no words; rows that are repeated are occurrences of their own, so all their windows go; rows may share an id or have none (they are then told apart by id and
text); an empty table gives no rows; other columns are passed by. Very long texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import textcols as tc

WINDOW = 35
ANCHOR = 8
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _longer(x: np.ndarray, by: int) -> np.ndarray:
    """Hash of the window at i and the one ``by`` words on; meaningless where a text ends before."""
    with np.errstate(over="ignore"):
        out = x * GOLDEN
        out[: max(len(x) - by, 0)] += x[by:]
        return tc.mix(out)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` consecutive words at each word, by doubling."""
    n = 1
    while 2 * n <= length:
        h, n = _longer(h, n), 2 * n
    return _longer(h, length - n) if n < length else h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and the offsets of the texts."""
    words, at = tc.split_words(texts)
    code, distinct = tc.coded(words)
    return (tc.mix(tc.hashed(distinct))[code] if len(code) else np.zeros(0, np.uint64)), at


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of v[i : i + width], the first on ties."""
    at = np.arange(len(v), dtype=np.int64)
    best, n = at.copy(), 1

    def merged(best: np.ndarray, by: int) -> np.ndarray:
        other = best[np.minimum(at + by, len(v) - 1)]
        return np.where(v[other] < v[best], other, best)

    while 2 * n <= width:
        best, n = merged(best, n), 2 * n
    return merged(best, width - n) if n < width else best


def runs(texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR):
    """(row, first window, windows, anchor hash, run hash) of every run of windows that share their anchor."""
    h, at = word_hashes(texts)
    size = np.diff(at)
    room = np.maximum(size - window + 1, 0)
    if not room.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    short = window_hashes(h, anchor)
    full = window_hashes(h, window)
    cut = np.concatenate([[0], np.cumsum(room)])
    p = np.arange(cut[-1]) - np.repeat(cut[:-1], room) + np.repeat(at[:-1], room)
    a = _smallest(short, window - anchor + 1)[p]
    change = np.ones(len(p), bool)
    change[1:] = a[1:] != a[:-1]
    change[cut[:-1][room > 0]] = True
    start = np.flatnonzero(change)
    n = np.diff(np.append(start, len(p)))
    k = np.arange(len(p)) - np.repeat(start, n)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(tc.mix(full[p] + k.astype(np.uint64) * GOLDEN), start)
    row = np.searchsorted(cut, start, side="right") - 1
    return row, p[start] - at[:-1][row], n, short[a[start]], whole


def keyed(documents: DataFrame) -> DataFrame:
    """(key, doc_id, text). key is the doc_id where that is a key; else a hash of id and text."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    return d.select((F.col("doc_id") if twice else F.xxhash64("doc_id", "text")).alias("key"), "doc_id", "text")


def _run_rows(batches):
    for b in tc.chunks(batches):
        row, first, n, anchor, whole = runs(b.column("text"))
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), b.column("key").take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "whole", "key", "first", "n"]
            )


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in batches:
        z = [squeeze.compress(x.encode()) for x in tc.as_text(b.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(z, pa.binary())], ["key", "doc_id", "z"])


def _with_marks(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """Compressed texts and their marks (key, first, n, known), in one shuffle: each text right before its marks."""
    none = F.lit(None)
    texts = tc.map_arrow(documents, _packed, "key long, doc_id long, z binary").select("key", F.lit(0).alias("kind"), "doc_id", "z", none.cast("int").alias("first"), none.cast("int").alias("n"))
    rows = marks.select("key", F.when(F.col("known"), 2).otherwise(1).alias("kind"), none.cast("long").alias("doc_id"), none.cast("binary").alias("z"), "first", "n")
    return texts.unionByName(rows).repartition("key").sortWithinPartitions("key", "kind")


def _by_text(batches):
    """For slices of sorted texts and marks: (texts, keys, doc_ids, mark's text number, first, n, kind). Texts of one key are alike and share marks."""
    unpack = zstandard.ZstdDecompressor()
    for big, starts in common.group_runs(batches, ["key"], least=2000):
        ends = np.append(starts[1:], big.num_rows)
        weight = np.fromiter((len(x.as_buffer()) if x.is_valid else 8 for x in big.column("z").combine_chunks()), np.int64, big.num_rows)
        piece = np.cumsum(weight)[ends - 1] // (tc.CHUNK_BYTES // 3)
        for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(starts)]]))):
            lo, hi = int(starts[a]), int(ends[b - 1])
            t = big.slice(lo, hi - lo)
            kind = t.column("kind").to_numpy()
            group = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
            docs, marks = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
            z = t.column("z").combine_chunks()
            texts = [unpack.decompress(z[int(i)].as_py()).decode() for i in docs]
            numbers = lambda c: t.column(c).to_numpy(zero_copy_only=False)[marks].astype(np.int64)
            yield texts, t.column("key").take(pa.array(docs)), t.column("doc_id").take(pa.array(docs)), group[docs], group[marks], numbers("first"), numbers("n"), kind[marks]


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mark, window) for every window of every mark."""
    cut = np.concatenate([[0], np.cumsum(n)])
    mark = np.repeat(np.arange(len(n)), n)
    return mark, np.arange(cut[-1]) - cut[mark] + first[mark]


def _window_rows(batches):
    for texts, keys, _, group, of, first, n, kind in _by_text(batches):
        if not len(of):
            continue
        used = np.flatnonzero(np.isin(group, of))
        used = used[np.unique(group[used], return_index=True)[1]]  # texts of one key are alike
        h, at = word_hashes(pa.array([texts[i] for i in used], pa.string()))
        full, second = window_hashes(h, WINDOW), window_hashes(tc.mix(h ^ GOLDEN), WINDOW)
        slot = np.searchsorted(group[used], of)
        mark, w = _spread(first, n)
        key = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        yield pa.RecordBatch.from_arrays(
            [pa.array(full[at[slot[mark]] + w].view(np.int64)), pa.array(second[at[slot[mark]] + w].view(np.int64)), key.take(pa.array(used[slot[mark]])), pa.array(w.astype(np.int32)), pa.array(kind[mark] == 2)], ["h", "h2", "key", "first", "known"]
        )


def _kept_rows(batches):
    for texts, _, ids, group, of, first, n, _ in _by_text(batches):
        words, at = tc.split_words(pa.array(texts, pa.string()))
        depth = np.zeros(len(words) + 1, np.int64)
        for i in range(len(texts)) if len(np.unique(group)) < len(group) else [None]:
            if i is None:
                slot = np.searchsorted(group, of)
                begin, end = at[slot] + first, at[slot] + first + n + WINDOW - 1
            else:
                mine = of == group[i]
                begin, end = at[i] + first[mine], at[i] + first[mine] + n[mine] + WINDOW - 1
            np.add.at(depth, begin, 1)
            np.add.at(depth, end, -1)
        gone = np.cumsum(depth[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        left = np.concatenate([[0], np.cumsum(~gone)])[at]
        kept = words.filter(pa.array(~gone)) if len(words) else words
        texts_kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept), " ")
        id_col = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        yield pa.RecordBatch.from_arrays([id_col, pa.array(np.diff(at)), pa.array(before[at[1:]] - before[at[:-1]]), texts_kept], ["doc_id", "n_words", "n_removed", "text"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(key, first, n): runs of windows of ``docs`` (key, doc_id, text) that also start elsewhere."""
    found = tc.map_arrow(docs.select("key", "text"), _run_rows, "anchor long, whole long, key long, first int, n int")
    found = common.written(found, "substring-found")  # read twice below; the texts are hashed once
    again = lambda *c: F.xxhash64(*c).alias("again")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor", again("anchor"))
    level = common.written(found.withColumn("again", again("anchor")).join(anchors, ["anchor", "again"]).drop("again"), "substring-runs")
    same = ["whole", "anchor", "n"]
    wholes = level.groupBy(*same).agg(F.count("*").alias("times"), F.min(F.struct("key", "first")).alias("one")).where("times > 1").select(*same, again(*same), "one")
    runs_now = level.withColumn("again", again(*same)).join(wholes, [*same, "again"], "left")
    runs_now = common.written(runs_now.select("key", "first", "n", F.col("one").isNotNull().alias("known"), (F.col("one") == F.struct("key", "first")).alias("one")), "substring-settled")
    windows = tc.map_arrow(_with_marks(docs, runs_now.where("NOT known OR one").select("key", "first", "n", "known")), _window_rows, "h long, h2 long, key long, first int, known boolean")
    windows = common.written(windows, "substring-windows")
    common.delete(found, level)
    repeated = windows.groupBy("h", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h", "h2", again("h"))
    late = windows.where("NOT known").withColumn("again", again("h")).join(repeated, ["h", "h2", "again"]).select("key", "first", F.lit(1).alias("n"))
    return runs_now.where("known").select("key", "first", "n").unionByName(late)


def deduplicated(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every document; text: the words kept, joined by one space."""
    docs = keyed(documents)
    marks = repeated_windows(docs).withColumn("known", F.lit(True))
    return tc.map_arrow(_with_marks(docs, marks), _kept_rows, "doc_id long, n_words long, n_removed long, text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that occur elsewhere."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM win SEMI JOIN rep USING (t)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
