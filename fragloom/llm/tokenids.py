"""Token ids in length-delimited binary records, with a separate offset index.

Record file: records one after the other, each
    u64 length of the payload, u32 masked crc32 of those 8 bytes, payload, u32 masked crc32 of the payload (all little-endian).
Payload: i64 doc_id (or -1 with flag bit 0 unset), u8 flags (bit 0: has a doc_id), u8 bytes per id (2 or 4), then the ids.
A masked checksum is the crc32 turned right by 15 bits plus 0xA282EAD8, so that a checksum of data that hold checksums stays sound.
Index: Parquet rows (shard, file, record, doc_id, offset, bytes, start, n_tokens), so records can be read in any order without a scan.

Shards are ranges of doc_id in ascending order. A task writes its shard under a name of its own attempt; the manifest that Spark commits
names the files that count, so lost or repeated tasks leave only unused files. Files are written through pyarrow's file systems, which take file,
hdfs, s3 and gs paths, in the folder that driver and executors share.

Defined results: a null or empty text is one id, the end id; a null doc_id sorts first; repeated rows are records of their own, in the order of
their texts; an empty table gives no records; other columns are passed by. Texts are encoded whole; memory is bounded by CHUNK_BYTES and the longest one.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from . import textcols as tc

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text whose distinct words are encoded together.
CHUNK_BYTES = 8 << 20
#: Words whose ids an encoder keeps from one chunk to the next, at most so many and of so many bytes each; the others are encoded again.
KNOWN_WORDS, KNOWN_BYTES = 1 << 18, 32
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
META = struct.Struct("<qBB")
#: A space is the start of a piece if what follows is neither white space nor the end; only such texts are cut into pieces.
ODD_SPACE = r" [\x00-\x20\x7F-\x{A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}]| $"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record of a payload."""
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(zlib.crc32(n))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(data: memoryview) -> memoryview:
    """The payload of a record; ValueError if a length or checksum is wrong."""
    if len(data) < HEAD.size + 4:
        raise ValueError("record is cut short")
    n, crc = HEAD.unpack_from(data)
    if masked(zlib.crc32(data[:8])) != crc:
        raise ValueError("checksum of a length is wrong")
    if len(data) != HEAD.size + n + 4:
        raise ValueError("length of a record is wrong")
    payload = data[HEAD.size : HEAD.size + n]
    if masked(zlib.crc32(payload)) != struct.unpack_from("<I", data, HEAD.size + n)[0]:
        raise ValueError("checksum of a record is wrong")
    return payload


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return META.pack(-1 if doc_id is None else doc_id, doc_id is not None, wide) + ids.astype(f"<u{wide}").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, flags, wide = META.unpack_from(payload)
    return (doc_id if flags & 1 else None), np.frombuffer(payload, f"<u{wide}", offset=META.size).astype("<u4")


#: A word of letters alone and the signs that follow it; no apostrophes, which take letters with them.
WORD_AND_SIGNS = r"^(?P<core>\p{L}+)(?P<signs>[^\s\p{L}\p{N}\p{M}\p{Z}\p{C}']+)$"


#: Signs that most words end in, and the first byte of a character beyond the Latin letters.
USUAL_SIGNS, BEYOND_LATIN = ".,;:!?", 0xCA


def word_and_signs(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words cut by WORD_AND_SIGNS; those that it does not match are whole, with no signs. Latin words with no sign or one usual one are known without it."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    full = np.flatnonzero(size)
    latin = np.zeros(len(words), bool)
    if len(full):
        latin[full] = np.maximum.reduceat(tc.joined(words), (np.cumsum(size) - size)[full]) < BEYOND_LATIN
    bare = pc.utf8_rtrim(words, characters=USUAL_SIGNS)
    n = pc.binary_length(bare).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)
    known = latin & letters & (size - n <= 1)
    end = np.where(known & (size > n), 1, 0)
    last = tc.joined(words)[np.cumsum(size)[end > 0] - 1] if end.any() else np.zeros(0, np.uint8)
    sign = np.zeros(len(words), np.int32)
    sign[end > 0] = 1 + np.searchsorted(np.sort(np.frombuffer(USUAL_SIGNS.encode(), np.uint8)), last)
    signs = pa.array(["", *sorted(USUAL_SIGNS)], pa.string()).take(pa.array(sign))
    other = pa.array(~known)
    split = pc.extract_regex(words.filter(other), WORD_AND_SIGNS)
    core = pc.replace_with_mask(bare, other, pc.coalesce(pc.struct_field(split, "core"), words.filter(other)))
    return core, pc.replace_with_mask(signs, other, pc.fill_null(pc.struct_field(split, "signs"), ""))


class Encoder:
    """Ids of texts, those of the library's own settings. A text without odd white space and added tokens is cut before each space, and words from the signs after them: no token of a byte-level
    vocabulary spans these places. So the distinct parts of many texts are encoded once, and put together by array operations.

    The parts are encoded many in one string; as every token stands for a known number of bytes, its ids fall apart again at the parts' ends. A worker's encoder
    knows the words that it met first, so that they are not encoded again for each chunk.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # a text that holds the string of an added token is encoded whole, as the library does it
        self.odd = "|".join([ODD_SPACE, *map(re.escape, sorted(added))])
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.known, self.known_ids, self.known_count = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: list[str], at_once: int = 16) -> list[np.ndarray]:
        """A few texts at a time: the library's results take a hundred bytes a token."""
        parts = (texts[k : k + at_once] for k in range(0, len(texts), at_once))
        return [np.array(e.ids, np.uint32) for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _spaced(self, words: pa.Array, block: int = 2000) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of the words, each with a space before it, and how many ids each has; both in blocks."""
        ids_of, counts = [], []
        for k in range(0, len(words), block):
            part = words.slice(k, block)
            joined = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            ids = self.encode([joined])[0]
            ends, marks = np.cumsum(self.width[ids]), np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False) + 1)
            cut = np.searchsorted(ends, marks, side="left") + 1
            if cut[-1] != len(ids) or (ends[cut - 1] != marks).any():
                each = self.encode([" " + w for w in part.to_pylist()])
                ids, cut = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids_of.append(ids)
            counts.append(np.diff(cut, prepend=0))
        return ids_of, counts

    def _cores(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of the words, each with a space before it, in blocks; where each word's begin in these, and how many there are. Only words that are not known are encoded."""
        met = pc.index_in(words, value_set=self.known)
        new = met.is_null().to_numpy(zero_copy_only=False)
        begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        at = met.drop_null().to_numpy()
        count[~new] = self.known_count[at]
        begin[~new] = (np.cumsum(self.known_count) - self.known_count)[at]
        fresh = words.filter(pa.array(new))
        ids, counts = (np.concatenate([*x, np.zeros(0, x[0].dtype if x else np.int64)]) for x in self._spaced(fresh))
        count[new], begin[new] = counts, len(self.known_ids) + np.cumsum(counts) - counts
        blocks = [self.known_ids, ids.astype(np.uint32)]
        keep = pc.less_equal(pc.binary_length(fresh), KNOWN_BYTES).to_numpy(zero_copy_only=False)
        keep &= np.cumsum(keep) <= KNOWN_WORDS - len(self.known)
        if keep.any():
            self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(keep))])
            self.known_ids = np.concatenate([self.known_ids, blocks[1][np.repeat(keep, counts)]])
            self.known_count = np.concatenate([self.known_count, counts[keep]])
        return blocks, begin, count

    def column(self, texts: pa.Array, step: int = 256):
        """(first text, ids, offsets) for ``step`` texts after the other."""
        texts = tc.as_text(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        word, distinct = tc.coded(lists.flatten())
        core, signs = word_and_signs(distinct)
        core_code, cores = tc.coded(core)
        sign_code, sign_words = tc.coded(signs)
        # a text's first word has no space before it
        first = at[:-1][np.diff(at) > 0]
        starts, alike = np.unique(core_code[word[first]], return_inverse=True)
        pool, begin, count = self._cores(cores)
        for some in (sign_words, cores.take(pa.array(starts))):
            each = self.encode(some.to_pylist())
            n = np.array([len(x) for x in each], np.int64)
            begin, count = np.concatenate([begin, sum(map(len, pool)) + np.cumsum(n) - n]), np.concatenate([count, n])
            pool = [np.concatenate([*pool, *each])]
        pool = np.concatenate(pool)
        slots = np.empty((len(word), 2), np.int32)
        slots[:, 0] = core_code[word] if len(word) else 0
        slots[:, 1] = len(cores) + sign_code[word] if len(word) else 0
        slots[first, 0] = len(cores) + len(sign_words) + alike
        place = np.concatenate([[0], np.cumsum(~odd)])
        for i in range(0, len(texts), step):
            j = min(i + step, len(texts))
            here = at[place[i] : place[j] + 1]
            s = slots[here[0] : here[-1]].ravel()
            n = count[s]
            cut = np.concatenate([[0], np.cumsum(n)])
            where = np.repeat(begin[s] - cut[:-1], n)
            where += np.arange(cut[-1])
            ids, ends = pool[where], cut[2 * (here - here[0])]
            if odd[i:j].any():
                parts = []
                for k in range(i, j):
                    m = place[k] - place[i]
                    parts.append(self.encode([texts[k].as_py()])[0] if odd[k] else ids[ends[m] : ends[m + 1]])
                ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            yield i, ids, ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI."""
    return fs.FileSystem.from_uri(uri) if re.match(r"\w[\w+.-]*:/", uri) else (fs.LocalFileSystem(), uri)


def write(documents: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the record files and the index of the documents under ``folder``; returns the index."""
    spark = documents.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(path or vocabulary_path())
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        out, offset, record, tokens = None, 0, 0, 0
        try:
            for b in tc.chunks(batches, limit=CHUNK_BYTES):
                out = out or store.open_output_stream(f"{base}/{name}")
                doc_ids = b.column("doc_id").to_pylist()
                for i, ids, at in enc.column(b.column("text")):
                    rows, buffer = [], []
                    for k in range(len(at) - 1):
                        data = frame(pack(doc_ids[i + k], np.append(ids[at[k] : at[k + 1]], np.uint32(end_id))))
                        n = int(at[k + 1] - at[k]) + 1
                        buffer.append(data)
                        rows.append((shard, name, record, doc_ids[i + k], offset, len(data), tokens, n))
                        offset, record, tokens = offset + len(data), record + 1, tokens + n
                    out.write(b"".join(buffer))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "file", "record", "doc_id", "offset", "bytes", "start", "n_tokens"])
        finally:
            if out:
                out.close()

    tc.map_arrow(ordered, run, "shard int, file string, record long, doc_id long, offset long, bytes long, start long, n_tokens long").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _stretches(offset: list[int], size: list[int], file: list[str], most: int = 4 << 20):
    """(i, j): index rows i..j-1 lie one after the other in one file and are read at once."""
    i = 0
    for j in range(1, len(offset) + 1):
        if j == len(offset) or file[j] != file[i] or offset[j] != offset[j - 1] + size[j - 1] or offset[j] + size[j] - offset[i] > most:
            yield i, j
            i = j


def _records(index: DataFrame, folder: str, schema: str, give) -> DataFrame:
    """``give(ids)`` of every indexed record, after (start, doc_id)."""
    wanted = pa.schema([(n, {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches):
        store, base = opened(folder)
        name, source = None, None
        for b in batches:
            file, offset, size, start = (b.column(c).to_pylist() for c in ("file", "offset", "bytes", "start"))
            for i, j in _stretches(offset, size, file):
                if file[i] != name:
                    name, source = file[i], store.open_input_file(f"{base}/{file[i]}")
                data = memoryview(source.read_at(offset[j - 1] + size[j - 1] - offset[i], offset[i]))
                rows = []
                for k in range(i, j):
                    doc_id, ids = unpack(unframe(data[offset[k] - offset[i] : offset[k] - offset[i] + size[k]]))
                    rows.append((start[k], doc_id, *give(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), wanted)], schema=wanted)

    return tc.map_arrow(index.select("file", "offset", "bytes", "start"), run, schema)


def global_starts(index: DataFrame) -> DataFrame:
    """The index with start counted over all shards. Broadcasts one number for each shard."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return index.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("start")).drop("before")


def read(index: DataFrame, folder: str) -> DataFrame:
    """(start, doc_id, ids) of the indexed records, each found by its offset and checked against both checksums. Any part of the index may be read, in any order."""
    return _records(index, folder, "start long, doc_id long, ids array<int>", lambda ids: (ids.astype(np.int32),))


def digest(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files: start counts the ids of all records before it."""
    back = _records(global_starts(index), folder, "start long, doc_id long, n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.tobytes())))
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' record files in the shared folder, read them back, and return ``digest``'s rows."""
    folder = f"{common.shared_dir(documents.sparkSession)}/tokenids-{uuid.uuid4().hex}"
    return digest(write(documents, folder, path), folder)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the record files."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
