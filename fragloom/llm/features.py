"""Hashed word n-gram features of whole texts, and the follow-the-regularised-leader trainer that uses them.

A text is a sparse vector. Its coordinates are hashed n-grams of two token streams: the words
themselves (one and two words, A-Z lower-cased) and the shapes of the words (one to three shapes; a shape
keeps punctuation and writes runs of capitals, small letters and digits as ``A``, ``a`` and ``0``; a
word equal to the one before it has the shape ``=``). A value is the share of that n-gram among the n-grams of its
kind, times ``SCALE``. So the length of a text does not decide its score, and a score is a
sparse dot product.

Other sets of kinds may count: a value is then the number of times that the n-gram occurs, as a few telling words shall
decide however long their text is. A third stream, the first letters of words, serves those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textcols as tc

#: (token stream, n, bits of its table, counted). The tables lie one after the other in the weight vector.
KINDS = (("word", 1, 17, False), ("word", 2, 17, False), ("shape", 1, 11, False), ("shape", 2, 12, False), ("shape", 3, 12, False))
SCALE = 8.0
STEM = 4


def size_of(kinds=KINDS) -> int:
    """Coordinates of all tables."""
    return sum(1 << bits for _, _, bits, _ in kinds)


SIZE = size_of()


def _shapes(words: pa.Array) -> pa.Array:
    s = pc.replace_substring_regex(words, r"\p{Lu}+", "A")
    s = pc.replace_substring_regex(s, r"\p{Ll}[\p{Ll}\p{M}]*", "a")
    return pc.utf8_slice_codeunits(pc.replace_substring_regex(s, r"\p{N}+", "0"), 0, 12)


def positions(texts: pa.Array, kinds=KINDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the coordinate at each position of the flat stream, and the offsets of the texts."""
    words, at = tc.split_words(texts)
    code, distinct = tc.coded(words)
    shapes = _shapes(distinct)
    shape_code, shape_words = tc.coded(shapes)
    low = pc.utf8_slice_codeunits(pc.utf8_lower(distinct), 0, STEM) if any(k[0] == "stem" for k in kinds) else None
    if len(code):
        stream = {"word": tc.hashed(pc.ascii_lower(distinct))[code], "shape": tc.hashed(shape_words, 7)[shape_code][code]}
        again = np.concatenate([[False], code[1:] == code[:-1]])
        again[at[:-1][at[:-1] < len(code)]] = False
        stream["shape"] = np.where(again, np.uint64(0x3D), stream["shape"])
        if low is not None:
            stem_code, stems = tc.coded(low)
            stream["stem"] = tc.hashed(stems, 11)[stem_code][code]
    else:
        stream = dict.fromkeys(("word", "shape", "stem"), np.zeros(0, np.uint64))
    base = 0
    for kind, n, bits, _ in kinds:
        h, where = tc.grams(stream[kind], at, n)
        yield base + (tc.mix(h) >> np.uint64(64 - bits)).astype(np.int64), where
        base += 1 << bits


def dots(texts: pa.Array, weights: np.ndarray, kinds=KINDS) -> tuple[np.ndarray, np.ndarray]:
    """The sparse dot product of each text with each column of ``weights`` (coordinates x k), and the words of each text."""
    out = np.zeros((len(texts), weights.shape[1]))
    words = None
    for (where, at), (*_, counted) in zip(positions(texts, kinds), kinds):
        n = np.diff(at)
        words = n if words is None else words
        total = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[where], axis=0, dtype=np.float64)])
        sums = total[at[1:]] - total[at[:-1]]
        out += sums if counted else SCALE * sums / np.maximum(n, 1)[:, None]
    return out, words


def sparse(texts: pa.Array, kinds=KINDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (coordinates, values) of each text."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(texts))]
    for (where, at), (*_, counted) in zip(positions(texts, kinds), kinds):
        for i in range(len(texts)):
            if at[i + 1] > at[i]:
                c, n = np.unique(where[at[i] : at[i + 1]], return_counts=True)
                parts[i].append((c, n.astype(np.float64) if counted else SCALE * n / (at[i + 1] - at[i])))
    none = (np.zeros(0, np.int64), np.zeros(0))
    return [tuple(np.concatenate(x) for x in zip(*p)) if p else none for p in parts]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, *, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l1_counted: float = 1.0, l2: float = 0.1, seed: int = 42, kinds=KINDS) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by FTRL-proximal updates, one labelled text at a time.

    Returns the weights (coordinates x k) and the bias (k); with two classes k is 1 and the score is that of class 1.
    """
    k = 1 if classes == 2 else classes
    size = size_of(kinds)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    bound = np.concatenate([np.full((1 << bits, 1), l1_counted if counted else l1) for _, _, bits, counted in kinds] + [np.zeros((1, 1))])

    def weight(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - bound[i], 0)
        shrunk[-1] = z[i[-1]]  # the bias is not penalised
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    rows = [(np.append(c, size), np.append(v, 1.0)) for c, v in rows]
    for _ in range(epochs):
        for t in rng.permutation(len(rows)):
            i, v = rows[t]
            w = weight(i)
            m = v @ w
            if k == 1:
                err = 1 / (1 + np.exp(-np.clip(m, -35, 35))) - labels[t]
            else:
                e = np.exp(m - m.max())
                err = e / e.sum() - (np.arange(k) == labels[t])
            g = v[:, None] * err[None, :]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    every = weight(np.arange(size + 1))
    return every[:size].astype(np.float32), every[size]
