"""Language identification by string kernels: blended-spectrum presence kernel, Nystroem landmarks, kernel ridge regression.

The blended-spectrum presence kernel of two texts is the number of distinct n-grams (one to three letters' bytes, lower case,
with word ends) that both hold, divided by the root of the product of their counts. A bounded sample
of labelled texts gives the landmarks and the ridge regression's rows, one regression against the rest per
language. As the kernel is linear in the presence vectors, landmarks and regression fold into one matrix, and a batch of texts
is scored by one matrix product of its presence rows.

Defined results: a null text, or one without a letter, gets ``und`` and score 0; repeated rows are scored each; an empty table
gives no rows; other columns are passed by. Without usable labels every text gets ``und``. Whole texts are read,
however long: presence takes a fixed row per text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from . import textcols as tc

#: Training bounds: labelled texts of each language and of all languages together (every language keeps one at least), landmarks.
SAMPLE_PER_LANG = 300
SAMPLE_ROWS = 10_000
LANDMARKS = 256
BITS = 13
SPECTRUM = (1, 2, 3)
ROWS = 256


@dataclass
class LangModel:
    langs: list[str]
    matrix: np.ndarray  # (1 << BITS) x languages
    bias: np.ndarray


def presence(texts: pa.Array) -> np.ndarray:
    """A row of 0/1 for each text: which hashed n-grams it holds."""
    clean = pc.utf8_lower(tc.as_text(texts))
    clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(clean, r"[^\p{L}\p{M}]+", " "))
    clean = pc.if_else(pc.equal(clean, ""), "", pc.binary_join_element_wise("", clean, "", " "))  # a space at either end
    size = pc.binary_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(clean)], pa.int32()), clean), "")[0].as_buffer() if len(clean) else b""
    flat = np.frombuffer(joined or b"", np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(clean), dtype=np.int64), size) << BITS
    out = np.zeros(len(clean) << BITS, np.uint8)
    h = np.zeros(len(flat), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(SPECTRUM) + 1):
            h = (h[: len(flat) - n + 1] * np.uint32(0x01000193)) ^ flat[n - 1 :] if n > 1 else flat.copy()
            if n in SPECTRUM:
                inside = row[: len(h)] == row[n - 1 :] if n > 1 else np.ones(len(h), bool)
                slot = ((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                out[(row[: len(h)] + slot)[inside]] = 1
    return out.reshape(len(clean), 1 << BITS)


def _kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The kernel of each row of presences with each landmark (unit rows), a thousand rows at a time."""
    out = np.empty((len(x), len(z)))
    for k in range(0, len(x), 1000):
        part = x[k : k + 1000].astype(np.float32)
        out[k : k + 1000] = part @ z.T / np.maximum(np.sqrt(part.sum(axis=1, keepdims=True)), 1)
    return out


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = 0.01, seed: int = 42) -> LangModel:
    """``fit_presence`` of texts."""
    return fit_presence(presence(pa.array(texts, pa.string())), langs, landmarks, ridge, seed)


def fit_presence(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = 0.01, seed: int = 42) -> LangModel:
    """One-versus-rest kernel ridge regression in the span of the landmarks, of rows of presences and their languages."""
    names, code, count = np.unique(np.array(langs, dtype=object), return_inverse=True, return_counts=True)
    if not len(names):
        return LangModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    y = np.full((len(x), len(names)), -1.0)
    y[np.arange(len(x)), code] = 1.0
    pick = np.sort(np.random.default_rng(seed).permutation(len(x))[: max(landmarks, min(2 * len(names), 2048))])
    z = x[pick].astype(np.float32)
    z /= np.maximum(np.sqrt(z.sum(axis=1, keepdims=True)), 1)
    kmm, knm = (z @ z.T).astype(np.float64), _kernel(x, z)
    balance = np.sqrt(len(langs) / len(names) / count[code])[:, None]
    bias = y.mean(axis=0) if len(names) == 1 else np.zeros(len(names))
    a = (knm * balance).T @ (knm * balance) + ridge * len(x) / max(len(pick), 1) * kmm + 1e-6 * np.eye(len(pick))
    alpha = np.linalg.solve(a, (knm * balance).T @ ((y - bias) * balance))
    return LangModel([str(n) for n in names], (z.T.astype(np.float64) @ alpha).astype(np.float32), bias)


def train(documents: DataFrame, usable, per_lang: int = SAMPLE_PER_LANG, rows: int = SAMPLE_ROWS) -> LangModel:
    """Learn every value of ``lang`` from a bounded sample of the documents for which ``usable`` holds.

    Languages are counted first. A text then belongs to the sample if a hash of its id falls under its language's share, per_lang / count; of those the
    ``per_lang`` with the smallest hashes are kept: the same sample for any partitioning. Texts are taken whole, and become rows of presences (one kilobyte each) on the executors.
    """
    spark = documents.sparkSession
    labelled = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & usable & (F.octet_length("text") > 0))
    counts = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())  # the model has a column for each
    if not counts:
        return fit([], [])
    per_lang = max(1, min(per_lang, rows // len(counts)))
    share = F.broadcast(spark.createDataFrame([(lang, min(1.0, (1.3 * per_lang + 10) / n)) for lang, n in counts], "lang string, share double"))
    h = F.xxhash64("doc_id")
    place = F.pmod(h, F.lit(1 << 40))
    chosen = labelled.select("lang", "text", place.alias("place")).join(share, "lang").where(F.col("place") / F.lit(float(1 << 40)) < F.col("share"))
    order = Window.partitionBy("lang").orderBy("place", F.xxhash64("text"), "text")
    chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("place", "lang", "n", "text")

    def run(batches):
        for big in tc.chunks(batches):
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                bits = np.packbits(presence(b.column("text")), axis=1)
                yield pa.RecordBatch.from_arrays([b.column("place"), b.column("lang"), b.column("n"), pa.array([r.tobytes() for r in bits], pa.binary())], ["place", "lang", "n", "bits"])

    got = sorted(tc.map_arrow(chosen, run, "place long, lang string, n int, bits binary").collect(), key=lambda r: (r["place"], r["lang"], r["n"]))
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1)
    return fit_presence(x, [r["lang"] for r in got])


def identify(documents: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for big in tc.chunks(batches):
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                text = tc.as_text(b.column("text"))
                lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                if not model.langs:
                    lettered &= False
                    best, s = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                else:
                    x = presence(text).astype(np.float32)
                    f = (x @ model.matrix) / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1) + model.bias
                    best = f.argmax(axis=1)
                    s = np.clip((f[np.arange(len(f)), best].astype(np.float64) + 1) / 2, 0, 1)
                names = [model.langs[k] if ok else "und" for k, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(lettered, s, 0.0))], ["doc_id", "lang_pred", "score"])

    return tc.map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learnt from the texts whose crc32(doc_id) mod 4 is not 2."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, common.remainder("doc_id", 4) != 2)
    return identify(documents, model).select("doc_id", F.coalesce(common.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
