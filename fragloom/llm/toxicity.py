"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and offsets.

The labels table marks documents, not words, so labelled tokens are made first: in a bounded sample of labelled
documents a word is labelled toxic if its document is and if the word or one of its prefixes is far
likelier in toxic documents than in clean ones. The chain (states clean and toxic, features of the word's
spelling, a 2 x 2 transition table) is then trained on whole texts by maximum likelihood, and a logistic curve on
the two largest marginals of a document is fitted to the document labels.

Defined results: a null or empty text has no words and gets the score of a document whose marginals are 0; repeated
rows are scored each; an empty table gives no rows; other columns are passed by. Labels of one class only give that share as every score.
Very long texts are scored whole: the chain is cut into blocks whose 2 x 2 products are combined exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import textcols as tc

#: At most so many labelled documents, clean and toxic, and so many bytes of either are used for training; texts are taken whole.
SAMPLE_PER_CLASS = (3000, 1500)
SAMPLE_BYTES = 6 << 20
BITS = 18
#: Bytes of text in one step of a kernel: the chain takes some forty times the memory of its words.
CHUNK_BYTES = 2 << 20
BLOCK = 32
#: Spellings that a word is known by: (first or last, letters); 0 letters: the whole word.
SPELLINGS = (("first", 0), ("first", 3), ("first", 4), ("first", 5), ("first", 6), ("last", 3), ("last", 4))
WORD = re.compile("[^\x20\x09-\x0d]+")


@dataclass
class ToxicityModel:
    weights: np.ndarray  # 1 << BITS, for the toxic state; the clean state has 0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))  # of (1, largest logit, second largest)
    threshold: float = 0.7


def spelled(distinct: pa.Array) -> np.ndarray:
    """A row for each distinct word, a column for each spelling: its coordinate. A last column is the same for all words, so that unseen ones count as clean."""
    w = pc.replace_substring_regex(pc.utf8_lower(distinct), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    out = np.zeros((len(w), len(SPELLINGS) + 1), np.int32)
    for j, (side, n) in enumerate(SPELLINGS):
        part = w if not n else pc.utf8_slice_codeunits(w, 0, n) if side == "first" else pc.utf8_slice_codeunits(w, -n)
        code, unique = tc.coded(part)
        out[:, j] = (tc.mix(tc.hashed(unique, j + 1)) >> np.uint64(64 - BITS)).astype(np.int32)[code] if len(code) else 0
    return out


def _blocks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block: its text; for each word: block and place in it."""
    size = np.diff(at)
    count = -(-size // BLOCK)
    first = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    return first, np.repeat(first[:-1], size) + place // BLOCK, place % BLOCK


def marginals(e: np.ndarray, at: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(word is toxic) for every word of all texts, by forward-backward; with ``pairs`` also the expected transitions.

    e: score of the toxic state of each word; at: offsets of the texts. Each text starts in the clean state.
    """
    if not len(e):
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    first, block, place = _blocks(at)
    nb = first[-1]
    hot = np.exp(np.clip(e, -30, 30))
    t = np.exp(trans)
    m = np.zeros((BLOCK, nb, 2, 2))
    m[:, :, 0, 0] = m[:, :, 1, 1] = 1.0  # past the end of a text nothing happens
    m[place, block, :, 0] = t[:, 0]
    m[place, block, :, 1] = t[:, 1] * hot[:, None]
    prod = m[0].copy()
    for k in range(1, BLOCK):
        prod = np.einsum("bij,bjk->bik", prod, m[k])
        prod /= prod.sum(axis=(1, 2), keepdims=True)
    fwd, bwd = np.zeros((nb, 2)), np.ones((nb, 2))
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    starts, ends, left = first[:-1][order], first[1:][order] - 1, count[order]
    live = int((left > 0).sum())
    f, g = np.tile([1.0, 0.0], (live, 1)), np.ones((live, 2))
    for k in range(int(left[0])):
        n = int(np.searchsorted(-left, -k, side="left"))
        fwd[starts[:n] + k] = f[:n]
        f[:n] = np.einsum("bi,bij->bj", f[:n], prod[starts[:n] + k])
        f[:n] /= f[:n].sum(axis=1, keepdims=True)
        bwd[ends[:n] - k] = g[:n]
        g[:n] = np.einsum("bij,bj->bi", prod[ends[:n] - k], g[:n])
        g[:n] /= g[:n].sum(axis=1, keepdims=True)
    alpha, beta = np.empty((BLOCK + 1, nb, 2)), np.empty((BLOCK + 1, nb, 2))
    alpha[0], beta[BLOCK] = fwd, bwd
    for k in range(BLOCK):
        a = np.einsum("bi,bij->bj", alpha[k], m[k])
        alpha[k + 1] = a / a.sum(axis=1, keepdims=True)
        j = BLOCK - 1 - k
        b = np.einsum("bij,bj->bi", m[j], beta[j + 1])
        beta[j] = b / b.sum(axis=1, keepdims=True)
    p = alpha[place + 1, block] * beta[place + 1, block]
    p = p[:, 1] / p.sum(axis=1)
    if not pairs:
        return p
    x = alpha[place, block][:, :, None] * m[place, block] * beta[place + 1, block][:, None, :]
    return p, (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def token_labels(code: np.ndarray, at: np.ndarray, where: np.ndarray, y: np.ndarray, ratio: float = 25.0) -> np.ndarray:
    """Labels of words from labels of texts: by spellings that are ``ratio`` times likelier in a toxic text."""
    doc = tc.row_of(at)
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    pairs = np.unique(doc * (code.max() + 1) + code) if len(code) else np.zeros(0, np.int64)
    d, w = pairs // (code.max() + 1), pairs % (code.max() + 1)
    toxic = np.zeros(len(where), bool)
    for j in range(5):
        seen = np.unique(d * (1 << BITS) + where[w, j])
        of, bit = seen // (1 << BITS), seen % (1 << BITS)
        df1 = np.bincount(bit[y[of] == 1], minlength=1 << BITS)
        df0 = np.bincount(bit[y[of] == 0], minlength=1 << BITS)
        strong = (df1 >= max(5, 0.01 * n1)) & ((df1 + 0.5) / (n1 + 1) >= ratio * (df0 + 0.5) / (n0 + 1))
        toxic |= strong[where[:, j]]
    return (toxic[code] & (y[doc] == 1)).astype(np.float64)


def _top_two(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(1, largest logit, second largest) of each text."""
    out = np.zeros((len(at) - 1, 2))
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        best = np.maximum.reduceat(p, at[:-1][full])
        out[full, 0] = best
        q = p.copy()
        is_best = np.flatnonzero(q == np.repeat(best, np.diff(at)[full]))
        _, once = np.unique(tc.row_of(at)[is_best], return_index=True)
        q[is_best[once]] = 0.0
        out[full, 1] = np.maximum.reduceat(q, at[:-1][full])
    z = np.clip(out, 1e-5, 1 - 1e-5)
    return np.column_stack([np.ones(len(z)), np.log(z / (1 - z))])


def fit(texts: list[str], y: np.ndarray, threshold: float = 0.7, epochs: int = 5, rate: float = 0.3, l2: float = 1e-3, seed: int = 42) -> ToxicityModel:
    """Train on texts and their labels; AdaGrad steps on batches of whole texts."""
    if len(set(y)) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return ToxicityModel(np.zeros(1 << BITS, np.float32), curve=np.array([np.log(share / (1 - share)), 0, 0]), threshold=threshold)
    rng = np.random.default_rng(seed)
    words, at = tc.split_words(pa.array(texts, pa.string()))
    code, distinct = tc.coded(words)
    where = spelled(distinct)
    tags = token_labels(code, at, where, y)
    aside = rng.random(len(y)) < 0.4  # for the curve: texts that the chain has not seen
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2 or y[aside].sum() < 50:
        aside = np.zeros(len(y), bool)
    theta, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    theta_g, trans_g = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6)
    learnt = np.flatnonzero(~aside)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(learnt), max(1, len(learnt) // 64)):
            size = np.diff(at)[part]
            here = np.concatenate([np.arange(at[i], at[i + 1]) for i in part]) if size.sum() else np.zeros(0, np.int64)
            if not len(here):
                continue
            cut = np.concatenate([[0], np.cumsum(size)])
            e = theta[where[code[here]]].sum(axis=1)
            p, expected = marginals(e, cut, trans, pairs=True)
            before = np.concatenate([[0.0], tags[here][:-1]])
            before[cut[:-1][size > 0]] = 0.0
            now = tags[here]
            found = np.array([[((1 - before) * (1 - now)).sum(), ((1 - before) * now).sum()], [(before * (1 - now)).sum(), (before * now).sum()]])
            g = np.bincount(where[code[here]].ravel(), np.repeat(p - now, where.shape[1]), 1 << BITS) / len(part) + l2 * theta
            gt = (expected - found) / len(part) + l2 * trans
            theta_g += g * g
            trans_g += gt * gt
            theta -= rate * g / np.sqrt(theta_g) * (g != 0)
            trans -= rate * gt / np.sqrt(trans_g)
    e, x = theta[where].sum(axis=1), []
    for part in np.array_split(np.arange(len(y)), max(1, len(code) // 200_000)):  # the chain takes some three hundred bytes a word
        i, j = (part[0], part[-1] + 1) if len(part) else (0, 0)
        cut = at[i : j + 1] - at[i]
        x.append(_top_two(marginals(e[code[at[i] : at[j]]], cut, trans), cut))
    x = np.concatenate(x)
    if aside.any():
        return ToxicityModel(theta.astype(np.float32), trans, _curve(x[aside], y[aside]), threshold)
    # too few texts to set some aside: those that the chain has learnt look surer than others will, so the curve is kept flat
    return ToxicityModel(theta.astype(np.float32), trans, _curve(x, y, l2=5.0), threshold)


def _curve(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Logistic regression of document labels on their two largest marginals, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(25):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * (1 - s))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (s - y) + penalty @ w)
    return w


def train(documents: DataFrame, labels: DataFrame, label: str, usable, per_class: tuple[int, int] = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES, threshold: float = 0.7) -> ToxicityModel:
    """Learn from a bounded sample of the labelled documents for which ``usable`` holds."""
    labelled = labels.where(usable).select("doc_id", F.col(label).cast("int").alias("y"))
    sample = common.labelled_sample(documents, labelled, list(per_class), most_bytes)
    got = sorted(sample.select("doc_id", "y", "text").collect(), key=lambda r: (r[0], r[1], r[2]))
    model = fit([r["text"] for r in got], np.array([r["y"] for r in got], np.int64), threshold)
    del got
    common.release()
    return model


def scores(texts: pa.Array, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The score of each text, the marginal of each word, and the offsets of the texts."""
    words, at = tc.split_words(texts)
    code, distinct = tc.coded(words)
    e = model.weights[spelled(distinct)].sum(axis=1, dtype=np.float64)[code] if len(code) else np.zeros(0)
    p = marginals(e, at, model.trans)
    return 1 / (1 + np.exp(-np.clip(_top_two(p, at) @ model.curve, -30, 30))), p, at


def tag(documents: DataFrame, model: ToxicityModel, cutoff: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, spans) of every document; spans: character offsets of the words tagged toxic."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for b in tc.chunks(batches, limit=CHUNK_BYTES):
            s, p, at = scores(b.column("text"), model)
            hits = np.flatnonzero(p >= cutoff)
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for i in np.unique(np.searchsorted(at, hits, side="right") - 1):
                toxic = set((hits[(hits >= at[i]) & (hits < at[i + 1])] - at[i]).tolist())
                spans[i] = [{"start": w.start(), "end": w.end()} for k, w in enumerate(WORD.finditer(b.column("text")[int(i)].as_py())) if k in toxic]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s), pa.array((s >= model.threshold).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "score", "predicted", "spans"],
            )

    return tc.map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def accepted(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents, with all their columns, whose score is under the threshold."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for b in tc.chunks(batches, limit=CHUNK_BYTES):
            yield b.filter(pa.array(scores(b.column("text"), model)[0] < model.threshold))

    return tc.map_arrow(documents, run, documents.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, and the offending character offsets as "start-end start-end"; labels are learnt where crc32(doc_id) mod 3 is not 1."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(documents, labels, "toxic", common.remainder("doc_id", 3) != 1)
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " ").alias("spans")
    return tag(documents, model).select("doc_id", F.coalesce(common.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), offsets)
