"""Whole groups out of sorted Arrow batches, many at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def whole_groups(batches, keys: str | list[str], least: int = 50_000):
    """Record batches sorted by ``keys`` -> (table, starts): about ``least`` rows or one group in each, no group cut; starts are where groups begin."""
    keys = [keys] if isinstance(keys, str) else keys
    kept: list[pa.RecordBatch] = []
    rows, wanted = 0, least
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        rows += b.num_rows
        if rows < wanted:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        starts = _starts(t, keys)
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1])), starts[:-1]
        kept = t.slice(int(starts[-1])).combine_chunks().to_batches()
        rows = t.num_rows - int(starts[-1])
        wanted = rows + least
    if kept:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, _starts(t, keys)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for key in keys:
        codes = t.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def group_of(starts: np.ndarray, rows: int) -> np.ndarray:
    """The number of its group for each row."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))
