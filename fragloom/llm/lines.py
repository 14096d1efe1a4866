"""Line dedup: fuzzy copies of lines, by pigeonhole blocks of their texts and edit similarity.

Lines are normalised (lower case, runs of anything but letters and digits become one space) and hashed; equal ones are one class, counted in a
pre-aggregated group. Few edits leave some block of a line whole, so classes that share a block meet:

short lines    (under SHORT characters) are cut into one part more than the edits that they allow; every place where a part can stand in the other line is
               looked up, by length. No similar pair of theirs is missed.
longer lines   have blocks of two words that follow each other; the BLOCKS that come first in a fixed random order are filed, long words first more often. From
               LONG_WORDS words on, the quarter of the line that it stands in belongs to a block: passages that lines share at other places do not bring them together.
few words      (at most FEW_WORDS) have blocks of GRAM characters as well, so that text without spaces is served too.

Blocks of a 64-bit SimHash, which this takes the place of, would have to allow for some 15 to 20 bits at an edit similarity of 0.9, which leaves nothing to join on; recall is in the README.
Pairs that meet are candidates if their lengths allow the similarity and so do the counts of their characters (a lower bound of the edits, which loses nothing). In lines of
LONG_WORDS words or more, whose characters say little, ALIKE of 16 slots have to hold the same block instead: the first of the random order in that slot.

Classes with a candidate meet again in their cells with their texts and the counts of FINE groups of characters, which rule out more pairs and lose nothing. There a spanning forest
of the candidates is verified by edit distance, twice, and then all that still lie between different groups, the nearest ones first. A pair is compared in one cell alone, that of the
smallest block that both lines have. So each candidate is verified or joined already, and no pair is a row before it is a link. One occurrence of each group is kept: the first
by document and line.

Cells that a sixteenth of the lines shows to be large are cut by length and into tiles whose pairs are tasks; that decides where lines meet, not whether they do.

Defined results: blank lines (no letter or digit) are kept and belong to no group; null texts count as empty ones; rows equal in id and text get the same result each;
rows that share an id are told apart by text; an empty table gives no rows; other columns are passed by. Very long lines are lines like others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, substring
from . import textcols as tc

SIMILARITY = 0.9
#: Lines of fewer characters have the blocks of ``places``.
SHORT = 30
#: Blocks that a longer line is filed under, of either kind; lines of at most FEW_WORDS words have both kinds.
BLOCKS = 5
FEW_WORDS = 7
GRAM = 5
#: Characters are counted in so many groups; of longer lines, the first blocks of as many slots are kept.
GROUPS = 16
#: Groups of characters that the later passes count, a power of two.
FINE = 64
LONG_WORDS = 24
#: Lines of at most so many words less or more are filed as shorter and as longer ones.
BOTH = 4
ALIKE = 3
TILE = 2048
#: How many of its nearest candidates of a cell a line is compared with before all that are then left between groups.
NEAREST = 8
#: Ids of documents are broadcast up to this number (8 bytes each).
BROADCAST_KEYS = 500_000
#: One line of so many tells which cells are large.
SAMPLED = 16
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts, and their offsets."""
    lists = pc.split_pattern(tc.as_text(texts), "\n")
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), at - at[0]


def normalised(lines: pa.Array) -> pa.Array:
    """Lower case, and one space for each run of anything but letters, marks and digits."""
    lower = pc.utf8_lower(lines)
    at = np.concatenate([[0], np.cumsum(pc.binary_length(lower).to_numpy().astype(np.int64))])
    flat = ASCII[tc.joined(lower)]
    lead = np.flatnonzero(flat >= 0xC0)
    if len(lead):
        size = 2 + (flat[lead] >= 0xE0) + (flat[lead] >= 0xF0)
        point = flat[lead].astype(np.int32) & (0x7F >> size)
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            point[more] = point[more] << 6 | flat[lead[more] + k] & 0x3F
        other = ~_in_words(point)
        lead, size = lead[other], size[other]
        for k in range(4):
            flat[lead[size > k] + k] = 32
    full = flat != 32
    start = full.copy()  # of words
    start[1:] &= ~full[:-1]
    begin = at[:-1][at[:-1] < at[1:]]
    start[begin] = full[begin]
    start = np.flatnonzero(start)
    first = np.searchsorted(start, begin)
    first = start[first[first < len(start)]]  # no space before those
    keep = np.append(full, False)  # the last one stands before the first byte too
    keep[start - 1] = True
    keep[first - 1] = np.append(full, False)[first - 1]
    keep = keep[:-1]
    upto = np.zeros(len(flat) + 1, np.int32)
    np.cumsum(keep, out=upto[1:])
    return pa.Array.from_buffers(pa.string(), len(lines), [None, pa.py_buffer(upto[at]), pa.py_buffer(flat[keep])])


#: Each byte, but a space for ASCII that is no small letter or digit.
ASCII = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
#: Whether characters are letters, marks or digits: 2 if not looked up yet.
_KINDS = np.full(0x110000, 2, np.uint8)


def _in_words(point: np.ndarray) -> np.ndarray:
    new = np.unique(point[_KINDS[point] == 2])
    if len(new):
        _KINDS[new] = pc.match_substring_regex(pa.array([chr(c) for c in new]), r"^[\p{L}\p{M}\p{N}]").to_numpy(zero_copy_only=False)
    return _KINDS[point] == 1


def allowed(length, similarity: float = SIMILARITY):
    """Edits that a pair may have whose longer line has this length."""
    return np.floor((1 - similarity) * np.asarray(length) + 1e-9).astype(np.int64)


@cache
def places(length: int, similarity: float = SIMILARITY, short: int = SHORT) -> list[tuple[int, int, int, int]]:
    """(length of the shorter line, part, start, characters): the blocks of a line of ``length``.

    A line of n characters is cut into parts, one more than the edits of its longest similar line. In that one, the part number i (from 0) of p stands within i
    places of its own, as each shift takes an edit before it, and so from the end.
    """
    out = []
    for n in range(length - int(allowed(length, similarity)), min(length, short - 1) + 1):
        most = max(int(allowed(t, similarity)) for t in range(n, int(n / similarity) + 2) if t - int(allowed(t, similarity)) <= n)
        if not most:
            continue
        parts = [(k * n // (most + 1), (k + 1) * n // (most + 1)) for k in range(most + 1)]
        more = length - n
        for i, (a, b) in enumerate(parts):
            first, last = max(a - i, a + more - (most - i), 0), min(a + i, a + more + most - i, length - (b - a))
            out += [(n, i, start, b - a) for start in range(first, last + 1)]
    return out


def _codes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all lines, and the offsets of the lines."""
    flat = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    return flat, np.concatenate([[0], np.cumsum(pc.utf8_length(lines).to_numpy().astype(np.int64))])


def _short_blocks(lines: pa.Array, size: np.ndarray, similarity: float):
    """(line, block) of the lines of one length after the other."""
    with np.errstate(over="ignore"):
        for n in np.unique(size):
            spots = places(int(n), similarity)
            if not spots:
                continue
            mine = np.flatnonzero(size == n)
            c = _codes(lines.take(pa.array(mine)))[0].reshape(len(mine), int(n)) + np.uint64(1)
            upto = np.zeros((len(mine), int(n) + 1), np.uint64)
            power = [np.uint64(1)]
            for k in range(int(n)):
                upto[:, k + 1] = upto[:, k] * GOLDEN + c[:, k]
                power.append(power[-1] * GOLDEN)
            for m, i, start, width in spots:
                block = upto[:, start + width] - upto[:, start] * power[width]
                yield mine, tc.mix(block * GOLDEN + np.uint64(m << 8 | i))


def _in_order(row: np.ndarray, block: np.ndarray, weight: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, place): each row's distinct blocks in a random order, heavy ones more often early, and where each stands first."""
    u = ((block >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    late = -np.log(u) / weight
    order = np.lexsort((block, late, row)) if len(row) and row[-1] >= 1 << 21 else np.argsort(row.astype(np.uint64) << np.uint64(43) | late.view(np.uint64) >> np.uint64(21))
    row, block, place = row[order], block[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
    return row[new], block[new], np.minimum.reduceat(place, np.flatnonzero(new)) if len(row) else place


def _first_blocks(row: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, block): the first BLOCKS of each row, and some more of long lines. Rows are in order."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(np.append(first, len(row)))
    keep = np.arange(len(row)) - np.repeat(first, n) < np.repeat(BLOCKS + np.minimum(n // 12, 6), n)
    return row[keep], block[keep]


def _sketch(row: np.ndarray, block: np.ndarray, placed: np.ndarray, n: int) -> np.ndarray:
    """GROUPS bytes for each of n rows: of each slot, a byte of the row's first block there and its place; 0 where there is none."""
    out = np.zeros(n * GROUPS, np.uint8)
    slot = row * GROUPS + (block >> np.uint64(60)).astype(np.int64)
    out[slot[::-1]] = ((placed[::-1] >> np.uint64(40)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)  # the last one written is the first in order
    return out.reshape(n, GROUPS)


def _word_blocks(words: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, block with the quarter of the line that it stands in), in the order of ``_in_order``."""
    code, distinct = tc.coded(words)
    if len(code) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h, size = tc.quick_hashed(distinct), pc.utf8_length(distinct).to_numpy().astype(np.int64)
    row = tc.row_of(at)
    start = np.flatnonzero(row[1:] == row[:-1])
    one, two = code[start], code[start + 1]
    with np.errstate(over="ignore"):
        block = tc.mix(tc.mix(h[one]) * GOLDEN + h[two])
    row, block, place = _in_order(row[start], block, 2.0 ** (np.minimum(size[one] + size[two], 24) / 2), start)
    quarter = 4 * (place - at[row]) // (at[row + 1] - at[row])
    with np.errstate(over="ignore"):
        return row, block, tc.mix(block + (quarter.astype(np.uint64) + np.uint64(1)) * GOLDEN)


def _gram_blocks(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, at = _codes(lines)
    row = tc.row_of(at)
    if len(flat) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(len(flat) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = h * GOLDEN + flat[k : len(h) + k] + np.uint64(1)
    inside = np.flatnonzero(row[: len(h)] == row[GRAM - 1 :])
    return _first_blocks(*_in_order(row[inside], tc.mix(h[inside]), np.ones(len(inside)), inside)[:2])


def filed_under(lines: pa.Array, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, block, counts, long) of normalised lines: blocks by line; each line's counts of characters, or the first blocks of its slots if it is long."""
    size = pc.utf8_length(lines).to_numpy().astype(np.int64)
    lists = pc.split_pattern(lines, " ")
    at = lists.offsets.to_numpy().astype(np.int64)
    words, at = lists.flatten(), at - at[0]
    n_words = np.diff(at)
    counts, long = np.zeros((len(lines), GROUPS), np.uint8), n_words >= LONG_WORDS
    counts[~long] = histograms(lines.filter(pa.array(~long)))
    found = list(_short_blocks(lines, np.where(size * similarity < SHORT, size, 0), similarity))
    some = np.flatnonzero((size >= SHORT) & (n_words >= 4))
    if len(some):
        keep = np.isin(tc.row_of(at), some) if len(some) < len(size) else np.ones(len(words), bool)
        row, block, placed = _word_blocks(words.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(n_words[some])]))
        counts[long] = _sketch(row, block, placed, len(some))[long[some]]
        n = n_words[some][row]
        for wanted, name in ((n <= LONG_WORDS + BOTH, block), (n >= LONG_WORDS - BOTH, placed)):
            at_row, first = _first_blocks(row[wanted], name[wanted])
            found.append((some[at_row], first))
    some = np.flatnonzero((size >= SHORT) & (n_words <= FEW_WORDS))
    if len(some):
        row, block = _gram_blocks(lines.take(pa.array(some)))
        found.append((some[row], block + np.uint64(1)))
    row, block = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*found) if found else ((), ())))
    row, block = row.astype(np.int64), block.astype(np.uint64)
    order = np.argsort(row, kind="stable")
    return row[order], block[order], counts, long


def blocks(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(line, block) of normalised lines, by line."""
    return filed_under(lines)[:2]


def histograms(lines: pa.Array) -> np.ndarray:
    """How many characters of each group a line has, up to 255; a group is known by the character's first byte."""
    group = ((np.arange(256) * 11) >> 2) % GROUPS
    size = pc.binary_length(lines).to_numpy().astype(np.int64)
    flat = tc.joined(lines)
    slot = np.repeat(np.arange(len(lines)) * GROUPS, size) + group[flat]
    lead = (flat & 0xC0) != 0x80
    slot = slot if lead.all() else slot[lead]
    return np.minimum(np.bincount(slot, minlength=len(lines) * GROUPS), 255).astype(np.uint8).reshape(len(lines), GROUPS)


def characters(lines: pa.Array) -> np.ndarray:
    """How many characters of each of FINE groups a line has, up to 255."""
    flat, at = _codes(lines)
    with np.errstate(over="ignore"):
        group = (flat + np.uint64(1)) * GOLDEN >> np.uint64(64 - FINE.bit_length() + 1)
    slot = tc.row_of(at) * FINE + group.astype(np.int64)
    return np.minimum(np.bincount(slot, minlength=len(lines) * FINE), 255).astype(np.uint8).reshape(len(lines), FINE)


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as one binary value each."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def fine_of(t: pa.Table) -> np.ndarray | None:
    """The bytes of the column ``fine``, a row each; None without it."""
    if "fine" not in t.column_names or not t.num_rows:
        return None
    return np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(t.num_rows, -1)


def packed(row: np.ndarray, block: np.ndarray, n: int) -> pa.Array:
    """Blocks by row as one binary value for each of n rows."""
    at = np.searchsorted(row, np.arange(n + 1)) * 8
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(block.astype("<u8")))])


def _line_rows(batches):
    for b in tc.chunks(batches):
        lines, at = lines_of(b.column("text"))
        row = tc.row_of(at)
        number = np.arange(len(row)) - at[row]
        raw, distinct = tc.coded(lines)
        code, norm = tc.coded(normalised(distinct))
        full = pc.greater(pc.binary_length(norm), 0).to_numpy(zero_copy_only=False)
        if not full.any():
            continue
        code = code[raw]
        # of equal lines of these texts the first by key and line
        key, line = b.column("key").to_numpy()[row], number.astype(np.int32)
        order = np.lexsort((line, key, code))
        first = order[np.searchsorted(code[order], np.flatnonzero(full))]
        norm = norm.filter(pa.array(full))
        of, block, counts, long = filed_under(norm)
        counts, size = counts.view("<i8"), pc.utf8_length(norm).to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tc.hashed(norm).view(np.int64)), pa.array(2 * size + long), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy()), packed(of, block, len(norm)), pa.array(key[first]), pa.array(line[first])],
            ["h", "size", "c0", "c1", "blocks", "key", "line"],
        )


def classes_of(docs: DataFrame) -> DataFrame:
    """(h, size, c0, c1, blocks, first): the classes of equal normalised lines. size: twice the characters, and 1 if the line is long; first: (key, line) of the first occurrence."""
    rows = tc.map_arrow(docs.select("key", "text"), _line_rows, "h long, size long, c0 long, c1 long, blocks binary, key long, line int")
    return rows.groupBy("h").agg(*[F.min(c).alias(c) for c in ("size", "c0", "c1", "blocks")], F.min(F.struct("key", "line")).alias("first"))


def _filed(batches, names: list[str]):
    """Each class once for every block of it."""
    for big in batches:
        for k in range(0, big.num_rows, 10_000):
            b = big.slice(k, 10_000)
            n = pc.binary_length(b.column("blocks")).to_numpy().astype(np.int64) // 8
            each = pa.array(np.repeat(np.arange(b.num_rows), n))
            cell = np.frombuffer(b"".join(b.column("blocks").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(b.column(c).take(each) for c in names)], ["cell", *names])


def _cells(classes: DataFrame, similarity: float) -> DataFrame:
    """The classes (h, size, c0, c1, blocks and perhaps group) filed under each of their blocks, sorted by cell, spot and size.

    Lines of a large cell are filed there by length (under their own step of lengths, and as guests under the next one), and steps are cut into tiles.
    A spot is a step and two tiles (the lower one first) in one number; 0 where the cell is not cut. mark: bit 0 for guests, bit 1 for lines of the higher tile.
    """
    names = [c for c in classes.columns if c != "blocks"]
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = ", ".join(["cell bigint", *(f"{c} {kinds[c]}" for c in names)])
    every = tc.map_arrow(classes.select(*names, "blocks"), lambda it: _filed(it, names), schema)
    some = tc.map_arrow(classes.where(F.pmod("h", F.lit(SAMPLED)) == 0).select("size", "blocks"), lambda it: _filed(it, ["size"]), "cell long, size long")
    step = F.floor(F.log(F.shiftright("size", 1).cast("double")) / F.lit(1.000001 * log(1 / similarity)))
    seen = some.select("cell", F.explode(F.array(step, step + 1)).alias("step")).groupBy("cell", "step").agg(F.count("*").alias("n"))
    tiles = F.map_from_entries(F.collect_list(F.struct("step", F.ceil(F.col("n") * SAMPLED / TILE))))
    large = seen.groupBy("cell").agg(F.sum("n").alias("n"), tiles.alias("tiles")).where(F.col("n") * SAMPLED / 2 > TILE).drop("n")
    large = common.written(large, "lines-large-cells")
    at = every.join(large, "cell", "left")

    def spots(k, guest: int):
        n = F.coalesce(F.element_at("tiles", k), F.lit(1))
        own = F.pmod(F.xxhash64("h", "cell"), n)
        spot = lambda other: (k + 1) * F.lit(1 << 50) + F.least(own, other) * F.lit(1 << 25) + F.greatest(own, other)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda other: F.struct(spot(other).alias("spot"), (F.when(own > other, 2).otherwise(0) + guest).alias("mark")))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("spot"), F.lit(0).alias("mark")))
    at = at.withColumn("at", F.explode(F.when(F.col("tiles").isNull(), whole).otherwise(F.concat(spots(step, 0), spots(step + 1, 1)))))
    at = at.select("cell", "at.spot", F.col("at.mark").cast("byte").alias("mark"), *names)
    return at.repartition("cell", "spot").sortWithinPartitions("cell", "spot", "size")


def _few_differ(t: pa.Table, length: np.ndarray, most: np.ndarray):
    """How far apart pairs of the table's rows (the longer one second) are at least, as a share of the edits allowed by the counts of ``fine`` if it is there; infinite for pairs that
    cannot be similar by those, or by their counts of characters or, if both are long, by their slots."""
    fine = fine_of(t)
    long = t.column("size").to_numpy() & 1
    counts = np.column_stack([t.column("c0").to_numpy(), t.column("c1").to_numpy()]).view(np.uint8).astype(np.int16)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        more = counts[y] - counts[x]
        edits = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        ok = np.where(long[x] == 0, (long[y] == 1) | (edits <= most[y]), (long[y] == 0) | (((more == 0) & (counts[x] > 0)).sum(axis=1) >= ALIKE))
        far = np.where(ok, np.float32(0), np.float32(np.inf))
        if fine is not None:
            left = np.flatnonzero(ok)
            more = fine[y[left]].astype(np.int16) - fine[x[left]]
            up, net = np.maximum(more, 0).sum(axis=1), more.sum(axis=1, dtype=np.int64)
            edits, room = np.maximum(up, up - net), most[y[left]]
            far[left] = np.where(edits <= room, edits / np.maximum(room, 1), np.inf)
        return far

    return near


def _meeting(t: pa.Table, starts: np.ndarray, similarity: float):
    """(x, y) rows of a table of ``_cells`` that meet in a cell and may be similar by their lengths, some at a time: x is no longer than y."""
    n = np.diff(np.append(starts, t.num_rows))
    end = np.repeat(np.append(starts[1:], t.num_rows), n)
    size, mark, spot = (t.column(c).to_numpy() for c in ("size", "mark", "spot"))
    length, guest, higher = size >> 1, mark & 1, mark >> 1
    one_tile = (spot >> 25 & (1 << 25) - 1) == (spot & (1 << 25) - 1)
    most = allowed(length, similarity)
    i = np.arange(t.num_rows)
    for d in range(1, int(n.max(initial=0))):
        i = i[i + d < end[i]]
        i = i[length[i + d] - length[i] <= most[i + d]]  # sorted by length: what is too short for one is so for the next
        if not len(i):
            break
        j = i + d
        ok = (guest[i] + guest[j] < 2) & (one_tile[i] | (higher[i] != higher[j]))
        x, y = i[ok], j[ok]
        yield from zip(np.array_split(x, len(x) // 100_000 + 1), np.array_split(y, len(y) // 100_000 + 1))


def _candidates(batches, similarity: float, forest: bool, filter_: Callable | None = None, nearest: int = 0):
    for t, starts in common.group_runs(batches, ["cell", "spot"]):
        h = t.column("h").to_numpy()
        group = t.column("group").to_numpy() if "group" in t.column_names else h
        near = filter_(t) if filter_ else _few_differ(t, t.column("size").to_numpy() >> 1, allowed(t.column("size").to_numpy() >> 1, similarity))
        a, b, far = [], [], []
        for x, y in _meeting(t, starts, similarity):
            ok = group[x] != group[y]
            x, y = x[ok], y[ok]
            each = near(x, y)
            ok = np.isfinite(each)
            a.append(x[ok])
            b.append(y[ok])
            far.append(each[ok])
        if not sum(map(len, a)):
            continue
        a, b = np.concatenate(a), np.concatenate(b)
        if forest:
            label = np.unique(group, return_inverse=True)[1]
            tree = _tree(label, a, b)
            if nearest and "fine" in t.column_names:
                tree = np.union1d(tree, _nearest(a, b, np.concatenate(far), nearest))
            first, second = h[a[tree]], h[b[tree]]
        else:
            first, second = h[a], h[b]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, second)), pa.array(np.maximum(first, second))], ["a", "b"])


def _meeting_rows(batches, similarity: float):
    """The rows of ``_cells`` that have a candidate in their cell."""
    for t, starts in common.group_runs(batches, ["cell", "spot"]):
        length, h = t.column("size").to_numpy() >> 1, t.column("h").to_numpy()
        near, met = _few_differ(t, length, allowed(length, similarity)), np.zeros(t.num_rows, bool)
        for x, y in _meeting(t, starts, similarity):
            ok = ~(met[x] & met[y]) & (h[x] != h[y])
            x, y = x[ok], y[ok]
            ok = np.isfinite(near(x, y))
            met[x[ok]] = met[y[ok]] = True
        if met.any():
            yield from t.filter(pa.array(met)).to_batches()


def _own(t: pa.Table) -> Callable:
    """Which pairs of the table's rows meet in this cell first: it is the smallest of the blocks that both have. So no pair is compared in two cells."""
    cell, packed_ = t.column("cell").to_numpy(), t.column("blocks").combine_chunks()
    n = pc.binary_length(packed_).to_numpy().astype(np.int64) // 8
    flat = np.frombuffer(b"".join(packed_.to_pylist()), "<i8")
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    lower = flat < cell[row]
    blocks = np.repeat(cell[:, None], max(int(n.max(initial=0)), 1), axis=1)  # blocks that are not lower than the cell don't count
    blocks[row[lower], place[lower]] = flat[lower]

    def own(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for k in range(0, len(x), 20_000):
            one, two = blocks[x[k : k + 20_000]], blocks[y[k : k + 20_000]]
            shared, here = np.zeros(len(one), bool), cell[x[k : k + 20_000]]
            for c in one.T:
                shared |= ((two == c[:, None]).any(axis=1)) & (c != here)
            ok[k : k + 20_000] = ~shared
        return ok

    return own


#: Bytes of rows that are compared at a time, and of the texts of their pairs.
COMPARED, PAIR_BYTES = 24 << 20, 4 << 20


def _linked_rows(batches, similarity: float):
    """(a, b): links between similar lines that meet in a cell, enough of them to join what they join.

    Every pair is compared, or its lines are joined already by others: first a spanning forest of the pairs, twice, then all that are left, the nearest ones first.
    """
    for t, starts in common.group_runs(batches, ["cell", "spot"], COMPARED, lambda b: b.nbytes):
        h, code = np.unique(t.column("h").to_numpy(), return_inverse=True)
        length, norm = t.column("size").to_numpy() >> 1, t.column("norm").combine_chunks()
        near, own = _few_differ(t, length, allowed(length, similarity)), _own(t)
        a, b, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for x, y in _meeting(t, starts, similarity):
            ok = code[x] != code[y]
            x, y = x[ok], y[ok]
            each = near(x, y)
            ok = np.flatnonzero(np.isfinite(each))
            ok = ok[own(x[ok], y[ok])]
            a.append(x[ok])
            b.append(y[ok])
            far.append(each[ok])
        a, b, far = np.concatenate(a), np.concatenate(b), np.concatenate(far)
        label, left, links = np.arange(len(h)), np.argsort(far, kind="stable"), []
        turn = 0
        while len(left):
            if turn < 2:
                now = left[_tree(label, code[a[left]], code[b[left]])]
                now = now[np.argsort(length[b[now]], kind="stable")]  # long ones together, as they are compared many at once
            else:
                now = left[: max(int(np.searchsorted(np.cumsum(2 * length[b[left]]), PAIR_BYTES)), 1)]
            for part in np.split(now, np.flatnonzero(np.diff(np.cumsum(2 * length[b[now]]) // PAIR_BYTES)) + 1):
                hit = part[similar_enough(norm.take(pa.array(a[part])), norm.take(pa.array(b[part])), allowed(length[b[part]], similarity))]
                links.append(hit)
            seen = np.zeros(len(a), bool)
            seen[now] = True
            joined = np.concatenate(links)
            label = common.local_labels(code[a[joined]], code[b[joined]], len(h))
            left = left[~seen[left]]
            left = left[label[code[a[left]]] != label[code[b[left]]]]
            turn += 1
        if links and len(joined := np.concatenate(links)):
            one, two = _forest(code[a[joined]], code[b[joined]], len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h[np.minimum(one, two)]), pa.array(h[np.maximum(one, two)])], ["a", "b"])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b between 0..n-1, all of them links given."""
    tree = _tree(np.arange(n), a, b)
    return a[tree], b[tree]


def _tree(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a-b make a spanning forest of the groups ``label``: in every round each group takes a link to the smallest other group."""
    left, picked = np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        la, lb = label[a[left]], label[b[left]]
        cross = la != lb
        left, la, lb = left[cross], la[cross], lb[cross]
        if not len(left):
            return np.concatenate(picked)
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        order = np.lexsort((low, high))
        pick = order[np.unique(high[order], return_index=True)[1]]  # each larger group hangs itself under one smaller
        picked.append(left[pick])
        parent = np.arange(label.max() + 1)
        parent[high[pick]] = low[pick]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _nearest(a: np.ndarray, b: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a-b are among the n shortest ones (by ``far``) of either end."""
    links = np.arange(len(a))
    end, link = np.concatenate([a, b]), np.concatenate([links, links])
    order = np.lexsort((far[link], end))
    start = np.flatnonzero(np.diff(end[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return np.unique(link[order[rank < n]])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, norm, fine): the normalised texts of the wanted classes (h, first), from their first occurrences, and their ``characters``. Only documents that hold one are dealt out."""
    marks = wanted.select(F.col("first.key").alias("key"), F.col("first.line").alias("first"), F.lit(1).alias("n"), F.lit(False).alias("known"))
    keys = common.written(marks.select("key").distinct(), "lines-keys")
    holding = docs.join(few(keys), "key", "left_semi")

    def run(batches):
        for texts, _, _, group, of, first, _, _ in substring._by_text(batches):
            if not len(of):
                continue
            once = np.unique(group, return_index=True)[1]
            lines, at = lines_of(pa.array([texts[i] for i in once], pa.string()))
            slot = np.searchsorted(group[once], of)
            norm = normalised(lines.take(pa.array(at[slot] + first)))
            yield pa.RecordBatch.from_arrays([pa.array(tc.hashed(norm).view(np.int64)), norm, fixed(characters(norm))], ["h", "norm", "fine"])

    return tc.map_arrow(substring._with_marks(holding, marks), run, "h long, norm string, fine binary")


#: Beyond this length few edits are looked for along diagonals before all cells are gone through.
LONG = 1000
#: How many edits that search goes up to.
FEW = 48
#: The edits that a word has bits for; pairs are compared so many at a time, with up to WORDS words each. There have to be ENOUGH of them if they take more than one.
BAND = 63
PAIRS = 2048
WORDS, ENOUGH = 4, 24


def edit_distance(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Edit distance of two arrays of characters, or some number over ``most`` if it is more: bit-parallel columns, or diagonals for few edits in long lines."""
    if not len(x) or not len(y) or abs(len(x) - len(y)) > most:
        return max(len(x), len(y)) if abs(len(x) - len(y)) <= most else most + 1
    if max(len(x), len(y)) > LONG:
        d = _few_edits(x, y, min(most, FEW))
        if d <= min(most, FEW):
            return d
        if most <= FEW:
            return most + 1
    return _columns(x.tolist(), y.tolist())


def _columns(x: list[int], y: list[int]) -> int:
    """Edit distance by bit-parallel columns: one bit of a long integer for each character of x, one step for each of y."""
    places: dict[int, int] = {}
    for k, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << k
    every, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, d = every, 0, len(x)  # vertical differences of +1 and -1
    get = places.get
    for c in y:
        eq = get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (every & ~(zero | up)), up & zero
        if plus & top:
            d += 1
        elif minus & top:
            d -= 1
        plus = plus << 1 | 1
        up, down = (minus << 1 & every) | (every & ~(zero | plus)), plus & zero & every
    return d


def _banded(x: np.ndarray, xat: np.ndarray, nx: np.ndarray, y: np.ndarray, yat: np.ndarray, ny: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``; the pair k is the nx[k] characters of x from xat[k] on, and the ny[k] >= nx[k] of y from yat[k] on.

    Bit-parallel columns over all pairs at once. A path of so few edits stays on as many diagonals and one more, around that of the last cell and of the first: these are the
    bits of a word, or of some words (the lowest first) if there are over BAND, which move down a row with each column. The distance is followed along the last cell's diagonal,
    on which it never falls: pairs beyond their edits are dropped.
    """
    out = np.zeros(len(nx), bool)
    kind = np.uint16 if max(x.max(initial=0), y.max(initial=0)) < 65_000 else np.uint32
    words = most // (BAND + 1) + 1
    for n_words in np.unique(words):
        order = np.flatnonzero(words == n_words)
        order = order[np.argsort(ny[order], kind="stable")]
        step = max(PAIRS // int(n_words), 1)
        for k in range(0, len(order), step):
            _band(order[k : k + step], int(n_words), kind, out, x, xat, nx, y, yat, ny, most)
    return out


def _band(left: np.ndarray, words: int, kind, out: np.ndarray, x: np.ndarray, xat: np.ndarray, nx: np.ndarray, y: np.ndarray, yat: np.ndarray, ny: np.ndarray, most: np.ndarray) -> None:
    """The pairs ``left`` of ``_banded``, whose bands take so many words: ``out`` is set where they are similar."""
    n, m = ny[left], nx[left]
    side = (most[left] - (n - m)) // 2
    lead = n - m + side
    wide, bits = int(n.max(initial=0)), (BAND + 1) * words
    rows, columns = np.zeros((len(left), wide + 2 * bits), kind), np.zeros((len(left), wide), kind)
    for into, of, at, size, shift in ((rows, x, xat[left], m, lead), (columns, y, yat[left], n, np.zeros(len(left), np.int64))):
        pair = np.repeat(np.arange(len(left)), size)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        into[pair, shift[pair] + place] = of[at[pair] + place] + np.uint64(1)  # 0 is none
    every, one, last = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1), np.uint64(BAND)
    low = [np.clip(lead - (BAND + 1) * w, 0, BAND + 1) for w in range(words)]
    up, down = [np.where(v > BAND, np.uint64(0), every << np.minimum(v, BAND).astype(np.uint64)) for v in low], [np.zeros(len(left), np.uint64)] * words
    at_word, follow, d, limit = side // (BAND + 1), (side % (BAND + 1)).astype(np.uint64), n - m, most[left]
    width = 32 if int(lead.max(initial=0) + side.max(initial=0)) < 32 else bits
    with np.errstate(over="ignore"):
        for j in range(wide):
            same = np.packbits(rows[:, j : j + width] == columns[:, j, None], axis=1, bitorder="little").view("<u4" if width == 32 else "<u8").astype(np.uint64)
            zero, carry = [], None
            for w in range(words):
                part = same[:, w]
                both = part & up[w]
                total = both + up[w]
                if words > 1:
                    over = total < both
                    if carry is not None:
                        total = total + carry
                        over |= total < carry
                    carry = over
                zero.append((total ^ up[w]) | part | down[w])
            if words == 1:
                followed = zero[0]
            else:
                followed = np.choose(at_word, zero)
            d = d + ((j >= n - m) & (followed >> follow & one == 0) & (j < n))
            for w in range(words):
                plus, minus = down[w] | ~(zero[w] | up[w]), zero[w] & up[w]
                moved = zero[w] >> one
                if w + 1 < words:
                    moved = moved | zero[w + 1] << last
                up[w], down[w] = minus | ~(moved | plus), moved & plus
            if j % 16 == 15 or j + 1 == wide:
                ended = j + 1 >= n
                out[left[ended & (d <= limit)]] = True
                stay = np.flatnonzero(~ended & (d <= limit))
                if not len(stay):
                    break
                if len(stay) < 0.8 * len(left):
                    left, n, m, d, limit, at_word, follow, rows, columns = (v[stay] for v in (left, n, m, d, limit, at_word, follow, rows, columns))
                    up, down = [v[stay] for v in up], [v[stay] for v in down]


def _few_edits(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Edit distance, or most + 1 if it is more.

    For each number of edits and each diagonal the furthest row that is reached; equal stretches are jumped over by comparing hashes of 64 bits. The cost goes with the
    square of the edits, not with the length.
    """
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return most + 1
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(max(n, m) + 1, base), dtype=np.uint64)
        hx, hy = (np.concatenate([[np.uint64(0)], np.cumsum(tc.mix(s.astype(np.uint64) + np.uint64(1)) * power[: len(s)], dtype=np.uint64)]) for s in (x, y))

    def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far x from i and y from j are equal."""
        room = np.minimum(n - i, m - j)
        low, step = np.zeros(len(i), np.int64), 1 << int(room.max(initial=0)).bit_length()
        while step:
            t = np.where(low + step <= room, low + step, 0)
            with np.errstate(over="ignore"):
                same = (hx[i + t] - hx[i]) * power[j] == (hy[j + t] - hy[j]) * power[i]
            low, step = np.where((t > 0) & same, t, low), step >> 1
        return low

    reach, first = equal(np.zeros(1, np.int64), np.zeros(1, np.int64)), 0
    if n == m and reach[0] == n:
        return 0
    for d in range(1, most + 1):
        before = np.full(len(reach) + 4, -1)
        before[2:-2] = reach
        k = np.arange(first - 1, first + len(reach) + 1)  # column - row
        row = np.maximum(np.where(before[1:-1] >= 0, before[1:-1] + 1, -1), np.maximum(before[:-2], np.where(before[2:] >= 0, before[2:] + 1, -1)))
        row = np.minimum(row, np.minimum(n, m - k))
        able = np.flatnonzero((row >= 0) & (row + k >= 0) & (np.abs(m - n - k) <= most - d))
        if not len(able):
            return most + 1
        span = slice(able[0], able[-1] + 1)
        k, row = k[span], row[span]
        at = able - able[0]
        moved = np.full(len(row), -1)
        moved[at] = row[at] + equal(row[at], row[at] + k[at])
        reach, first = moved, int(k[0])
        if 0 <= m - n - first < len(reach) and reach[m - n - first] >= n:
            return d
    return most + 1


def _aligned(x: np.ndarray, xat: np.ndarray, y: np.ndarray, yat: np.ndarray, n: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """For n characters of each pair, from the start or from the end: how far they are equal, and how many differ."""
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    differ = x[xat[1:][row] - 1 - k] != y[yat[1:][row] - 1 - k] if back else x[xat[row] + k] != y[yat[row] + k]
    hit = np.flatnonzero(differ)
    same = n.copy()
    same[row[hit[::-1]]] = k[hit[::-1]]
    return same, np.bincount(row[hit], minlength=len(n))


#: Grams of the filter on pairs, and how many places its table has for each.
LONG_GRAM = 6
ROOM = 16


def _shared_grams(x: np.ndarray, xat: np.ndarray, y: np.ndarray, yat: np.ndarray) -> np.ndarray:
    """For each pair at least as many as there are places of x whose gram stands anywhere in y."""

    def named(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = tc.row_of(at)
        n = max(len(flat) - LONG_GRAM + 1, 0)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(LONG_GRAM):
                h = h * GOLDEN + flat[k : n + k] + np.uint64(1)
            h = (h + row[:n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        inside = row[:n] == row[LONG_GRAM - 1 :]
        return h[inside] >> (np.uint64(64) - bits), row[:n][inside]

    bits = np.uint64(max(int(ROOM * max(len(y), 1)).bit_length(), 10))
    table = np.zeros(1 << int(bits), bool)
    table[named(y, yat)[0]] = True
    h, row = named(x, xat)
    return np.bincount(row[table[h]], minlength=len(xat) - 1)


def similar_enough(one: pa.Array, two: pa.Array, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``.

    Pairs that differ in one short stretch, or only in single characters of equally long lines, are settled by comparing columns. Of those of over BAND edits, the ones that share too few
    grams for them (each touches LONG_GRAM of them) are not similar. The others are compared in bands of diagonals, many at once, and one by one where the bands are too wide or the pairs too few.
    """
    (x, xat), (y, yat) = _codes(one), _codes(two)
    nx, ny = np.diff(xat), np.diff(yat)
    n = np.minimum(nx, ny)
    head, differ = _aligned(x, xat, y, yat, n, False)
    tail = np.minimum(_aligned(x, xat, y, yat, n, True)[0], n - head)
    out = (np.maximum(nx, ny) - head - tail <= most) | ((nx == ny) & (differ <= most))
    left = ~out & (np.abs(nx - ny) <= most)
    words = most // (BAND + 1) + 1
    left[left] = (words[left] == 1) | (_shared_grams(x, xat, y, yat) >= nx - LONG_GRAM + 1 - LONG_GRAM * most)[left] if (left & (words > 1)).any() else True
    banded = left & ((words == 1) & (np.maximum(nx, ny) <= LONG) | (words > 1) & (np.bincount(words[left], minlength=int(words.max(initial=1)) + 1)[words] >= ENOUGH) & (words <= WORDS))
    few = np.flatnonzero(banded)
    if len(few):
        begin, size = [at[:-1][few] + head[few] for at in (xat, yat)], [n[few] - head[few] - tail[few] for n in (nx, ny)]
        swap = size[0] > size[1]
        flat = np.concatenate([x, y])
        begin[1] = begin[1] + len(x)
        at, n = [np.where(swap, v[1], v[0]) for v in (begin, size)], [np.where(swap, v[0], v[1]) for v in (begin, size)]
        out[few] = _banded(flat, at[0], at[1], flat, n[0], n[1], most[few])
    left &= ~banded
    for k in np.flatnonzero(left):
        i, j = int(xat[k]), int(yat[k])
        out[k] = edit_distance(x[i + head[k] : xat[k + 1] - tail[k]], y[j + head[k] : yat[k + 1] - tail[k]], int(most[k])) <= most[k]
    return out


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose normalised lines are similar enough."""
    one, two = texts.select(F.col("h").alias("a"), F.col("norm").alias("x")), texts.select(F.col("h").alias("b"), F.col("norm").alias("y"))

    def run(batches):
        for b in tc.chunks(batches, "x", 1 << 20):
            size = np.maximum(pc.utf8_length(b.column("x")).to_numpy(), pc.utf8_length(b.column("y")).to_numpy())
            hit = similar_enough(b.column("x"), b.column("y"), allowed(size, similarity))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(hit))

    return tc.map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), run, "a long, b long")


def few(keys: DataFrame) -> DataFrame:
    """Keys that were written, to be broadcast if they are few: what they are joined with is then not shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def groups_of(classes: DataFrame, similarity: float, texts_of: Callable[[DataFrame], DataFrame], verified: Callable = _verified, filter_: Callable | None = None, nearest: int = 0) -> DataFrame:
    """(node, component): classes linked with others, and a class that stands for all that they reach.

    Verified are first the pair of each class with its smallest candidate, then a spanning forest of the candidates left between groups (and the ``nearest`` ones of each class in a cell), then every one left.
    ``texts_of`` also gives a value ``fine`` to each class: the later passes tell pairs apart by it where they meet, so that only near ones are joined with their texts.
    """
    schema = "a long, b long"
    filed = ["h", "size", "c0", "c1", "blocks"]
    met = lambda t, forest: tc.map_arrow(_cells(t, similarity), lambda it: _candidates(it, similarity, forest, filter_, nearest), schema).distinct()
    found = common.written(met(classes.select(*filed), True), "lines-found")
    pairs = common.written(found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "lines-stars")
    wanted = common.written(found.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "lines-wanted")
    involved = common.written(classes.join(few(wanted), "h"), "lines-involved")
    common.delete(found, wanted)
    texts = common.written(texts_of(involved), "lines-texts")
    links = common.written(verified(pairs, texts, similarity), "lines-links")
    finer = involved.join(texts.select("h", "fine"), "h")

    def grouped_by(links: DataFrame) -> DataFrame:
        reached = common.components(links, "lines-components").select(F.col("node").alias("h"), "component")
        return common.written(finer.join(reached, "h", "left").select(*filed, "fine", F.coalesce("component", "h").alias("group")), "lines-grouped")

    for forest in (True, False):
        grouped = grouped_by(links)
        rest = common.written(met(grouped, forest).join(pairs, ["a", "b"], "left_anti"), "lines-rest")  # those in both are known not to be similar
        late = common.written(verified(rest, texts, similarity), "lines-late")
        if forest:
            links, pairs = links.unionByName(late), pairs.unionByName(rest)
            common.delete(grouped)
    common.delete(involved, texts, pairs, rest, links)
    if late.isEmpty():
        return grouped.where("h <> `group`").select(F.col("h").alias("node"), F.col("group").alias("component"))
    # the late links join groups; their own components are those of a small table
    of = lambda c: grouped.select(F.col("h").alias(c), F.col("group").alias(f"g{c}"))
    between = late.join(of("a"), "a").join(of("b"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    higher = common.components(between, "lines-components").select(F.col("node").alias("group"), "component")
    return grouped.join(higher, "group", "left").select(F.col("h").alias("node"), F.coalesce("component", "group").alias("component"))


def linked(classes: DataFrame, similarity: float, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) as of ``groups_of``: classes are compared in the cells where they meet, where their texts come to; no pair of classes is a row before it is a link."""
    cells = _cells(classes.select("h", "size", "c0", "c1", "blocks"), similarity)
    met = common.written(tc.map_arrow(cells, lambda it: _meeting_rows(it, similarity), cells.schema), "lines-met")
    wanted = common.written(met.select("h").distinct(), "lines-wanted")
    involved = common.written(classes.join(few(wanted), "h"), "lines-involved")
    texts = common.written(texts_of(involved), "lines-texts")
    told = involved.select("h", "blocks").join(texts, "h")
    rows = met.join(told, "h").repartition("cell", "spot").sortWithinPartitions("cell", "spot", "size")
    links = common.written(tc.map_arrow(rows, lambda it: _linked_rows(it, similarity), "a long, b long"), "lines-links")
    common.delete(met, wanted, involved, texts)
    return common.components(links, "lines-components")


def _kept_rows(batches):
    for texts, _, ids, group, of, first, _, _ in substring._by_text(batches):
        every, at = lines_of(pa.array(texts, pa.string()))
        row = tc.row_of(at)
        number = np.arange(len(row)) - at[row]
        blank = ~pc.match_substring_regex(every, r"[\p{L}\p{M}\p{N}]").to_numpy(zero_copy_only=False)
        # texts of one key share its marks
        wide = max(int(number.max(initial=0)), int(first.max(initial=0))) + 1
        keep = blank | np.isin(group[row] * wide + number, of * wide + first)
        left = np.concatenate([[0], np.cumsum(keep)])[at]
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), every.filter(pa.array(keep))), "\n")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(left)), out], ["doc_id", "n_lines", "n_removed", "text"])


def deduplicated(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every document; text: the lines kept."""
    docs = substring.keyed(documents)
    classes = common.written(classes_of(docs), "lines-classes")
    groups = linked(classes, similarity, lambda involved: _texts(docs, involved))
    named = classes.select("h", "first").join(groups.select(F.col("node").alias("h"), "component"), "h", "left").select(F.coalesce("component", "h").alias("g"), "first")
    kept = named.groupBy("g").agg(F.min("first").alias("first"))
    marks = kept.select(F.col("first.key").alias("key"), F.col("first.line").alias("first"), F.lit(1).alias("n"), F.lit(True).alias("known"))
    return tc.map_arrow(substring._with_marks(docs, marks), _kept_rows, "doc_id long, n_lines long, n_removed long, text string")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fuzzily repeated lines removed, but for the first of each group."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
