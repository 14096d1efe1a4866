"""Cases that a cut in an operator would lose."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

import corpus_pipeline
from fragloom.llm import common, decontam, lines, similar, textcols, tokenids


def test_quick_hashes_tell_words_apart():
    words = pa.array([f"{a}{b}{c}" for a in "abcdéß" for b in range(60) for c in ("", "x", "xx", "yé")])
    h = textcols.quick_hashed(words)
    assert len(set(h.tolist())) == len(words) and textcols.quick_hashed(words.slice(700, 9)).tolist() == h[700:709].tolist()
    assert np.abs(np.unpackbits(h.view(np.uint8)).mean() - 0.5) < 0.02


def test_fuzzy_lines_become_candidates():
    """Lines with some letters changed share a block at every length: nearly all with one or two, nine of ten with half of the edits that are allowed."""
    rng = np.random.default_rng(21)
    made = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9))))
    for words in (4, 8, 15, 30, 60, 120):
        base = [" ".join(made() for _ in range(words)) for _ in range(150)]
        for share, least in ((0, 0.98), (0.05, 0.88)):
            other = []
            for line in base:
                chars = list(line)
                for at in rng.choice(len(line), max(1, int(len(line) * share)), replace=False):
                    chars[at] = "ö"
                other.append("".join(chars))
            row, block = lines.blocks(pa.array(base + other))
            cells = [set() for _ in range(300)]
            for i, k in zip(row.tolist(), block.tolist()):
                cells[i].add(k)
            assert np.mean([bool(cells[k] & cells[150 + k]) for k in range(150)]) >= least, (words, share)


def test_fuzzy_lines_are_removed(spark):
    docs = [(1, "the quick brown fox jumps over the lazy dog today"), (2, "the quick brown fox jumps over the lazy dig today"), (3, "nothing of the kind stands in this line at all")]
    got = {r["doc_id"]: r["n_removed"] for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_bands_of_diagonals_give_the_edit_distance():
    """Pairs compared many at once, against the plain columns, at and around their distance."""
    rng = np.random.default_rng(31)
    one, two, most, wanted = [], [], [], []
    for k in range(600):
        a = rng.choice(list("abcé"), int(rng.integers(1, 700 if k % 10 == 0 else 90))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 60 if k % 10 == 0 else 14))):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + int(rng.integers(3))] = rng.choice(list("abx"), int(rng.integers(3))).tolist()
        b = b or ["x"]
        d = lines._columns([ord(c) for c in a], [ord(c) for c in b])
        one.append("".join(a))
        two.append("".join(b))
        most.append(max(0, min(d, lines.BAND) + int(rng.integers(-1, 2))))
        wanted.append(d <= most[-1])
    (x, xat), (y, yat) = lines._codes(pa.array(one)), lines._codes(pa.array(two))
    nx, ny, most = np.diff(xat), np.diff(yat), np.array(most)
    ok = np.flatnonzero((nx <= ny) & (ny - nx <= most) & (most <= lines.BAND))
    got = lines._banded(x, xat[:-1][ok], nx[ok], y, yat[:-1][ok], ny[ok], most[ok])
    assert len(ok) > 200 and got.tolist() == [wanted[k] for k in ok]
    # and the counts of characters never tell similar lines apart
    more = lines.characters(pa.array(two)).astype(int) - lines.characters(pa.array(one))
    far = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
    assert (far[np.array(wanted)] <= most[np.array(wanted)]).all()


def test_the_driver_holds_little():
    """Places that are broadcast take some 184 bytes each (69 MB for 375,387); freed memory is given back where the system can."""
    assert decontam.BROADCAST_PLACES * 184 <= 20 << 20
    common.release()


def test_lines_are_told_apart_where_they_meet(spark):
    """Lines of one alphabet that share a passage, or half of their words, are not joined with their texts pair by pair."""
    rng = np.random.default_rng(32)
    same = [bytes([c]).decode() for c in range(97, 123) if (c * 11 >> 2) % lines.GROUPS == (97 * 11 >> 2) % lines.GROUPS]
    assert len(same) > 1
    # of two letters that are one to the coarse counts, every other line has one
    docs = [(k, "the quick brown fox jumps over " + " ".join(str(n) * 3 + same[k % 2] * 9 for n in rng.integers(0, 10, 6))) for k in range(300)]
    t = spark.createDataFrame(docs, "key long, text string")
    seen = []

    def verified(pairs, texts, similarity):
        seen.append(pairs.collect())
        return lines._verified(pairs, texts, similarity)

    from fragloom.llm import substring

    keyed = substring.keyed(t.withColumnRenamed("key", "doc_id"))
    classes = lines.classes_of(keyed)
    first = {r["h"]: r["first"]["key"] for r in classes.collect()}
    text = {r["key"]: r["text"] for r in keyed.collect()}
    lines.groups_of(classes, 0.9, lambda wanted: lines._texts(keyed, wanted), verified).count()
    late = [r for rows in seen[1:] for r in rows]
    assert not any((same[0] * 9 in text[first[r["a"]]]) != (same[0] * 9 in text[first[r["b"]]]) for r in late)


def test_texts_are_told_apart_where_they_meet(spark, monkeypatch):
    """Variants of one text with a similarity of some 0.6 share bands, but few pairs of them are compared by their shingles."""
    rng = np.random.default_rng(33)
    words = [f"w{i}" for i in range(4000)]
    base, rows = list(rng.choice(words, 400)), []
    for i in range(150):
        w = list(base)
        for at in rng.choice(400, 14, replace=False):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    seen, plain = [], similar._verified

    def verified(pairs, texts, similarity):
        seen.append(pairs.count())
        return plain(pairs, texts, similarity)

    monkeypatch.setattr(similar, "_verified", verified)
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert left.count() == 150 and sum(seen[1:]) < 150 * 149 / 2 / 10, seen


def test_pipeline_drops_near_copies(spark):
    """Planted copies with a five-word similarity of 0.8 to 0.95 go; those under 0.8 and other texts stay."""
    rng = np.random.default_rng(22)
    words = [f"w{i}" for i in range(5000)]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, near = [], {}
    for i in range(60):
        w = list(rng.choice(words, int(rng.integers(60, 400))))
        rows.append((i, " ".join(w)))
        v = list(w)
        for at in rng.choice(len(w), max(1, int(len(w) * rng.uniform(0.01, 0.035))), replace=False):
            v[at] = "other"
        a, b = grams(w), grams(v)
        near[1000 + i] = len(a & b) / len(a | b) >= 0.8
        rows.append((1000 + i, " ".join(v)))
    rows += [(2000, None), (2001, ""), (2002, "a few words"), (2003, "A few  words"), (None, rows[0][1]), (5, rows[0][1]), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in left.collect())
    assert 20 < sum(near.values()) < 60
    assert got == sorted([-1, *range(60), *(k for k, v in near.items() if not v), 2000, 2002])


def test_near_copies_meet_by_simhash():
    """Fingerprints are majorities of hashed shingles; sets with a similarity of 0.8 share a band and lie within the radius, other sets do not."""
    rng = np.random.default_rng(23)
    size, inter, h, at = 120, 107, [], [0]
    for _ in range(300):  # a Jaccard similarity of 107 / 133
        every = rng.integers(0, 1 << 64, 2 * size - inter, np.uint64, endpoint=False)
        h += [every[:size], every[-size:]]
        at += [at[-1] + size, at[-1] + 2 * size]
    prints = similar.fingerprints_of(np.concatenate(h), np.array(at))
    for k in range(prints.shape[1]):
        with np.errstate(over="ignore"):
            seeded = textcols.mix(h[0] + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
        assert int(prints[0, k]) == sum(1 << b for b in range(64) if 2 * int((seeded >> np.uint64(b) & np.uint64(1)).sum()) > size)
    near = lambda x, y: np.bitwise_count(x[:, :2] ^ y[:, :2]).sum(axis=1) <= similar.RADIUS
    for n in (1_000, 5_000_000):
        names = similar.bands(prints, similar.plan(n))
        assert ((names[0::2] == names[1::2]).any(axis=1) & near(prints[0::2], prints[1::2])).mean() > 0.985
    assert not near(prints[0:-2:2], prints[2::2]).any()


def test_batches_of_long_rows_are_small(spark):
    """A thousand rows of large arrays do not come as one batch."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    wide = spark.range(0, 300, 1, 1).selectExpr("array_repeat(int(id), 50000) AS x")
    assert max(r["n"] for r in textcols.map_arrow(wide, run, "n long").collect()) < 2 * textcols.BYTES_PER_BATCH


def test_words_met_before_are_not_encoded_again():
    """The ids are the library's, and a second chunk has only its new words encoded."""
    enc = tokenids.Encoder(tokenids.vocabulary_path())
    text = pa.array(["plain words, some signs!? é.\nB it's x1. …", "", "words plain, ok.", None])
    for part in (text, text, pa.array(["ok words new."])):
        got = [ids[a:b].tolist() for _, ids, at in enc.column(part) for a, b in zip(at, at[1:])]
        assert got == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
    seen, spaced = [], enc._spaced
    enc._spaced = lambda words: seen.extend(words.to_pylist()) or spaced(words)
    for _ in enc.column(pa.array(["plain words, other signs"])):
        pass
    assert seen == ["other"]


def test_words_are_cut_from_signs_as_by_the_pattern():
    words = pa.array(["", "a", "a.", "a..", ".", "...", "éß!", "a'b,", "x1.", "日本.", "ʰ;", "ª,", "o\n", "o.\nA", "(a)", "á?", "ab…"])
    split = pc.extract_regex(words, tokenids.WORD_AND_SIGNS)
    core, signs = tokenids.word_and_signs(words)
    assert core.equals(pc.coalesce(pc.struct_field(split, "core"), words)) and signs.equals(pc.fill_null(pc.struct_field(split, "signs"), ""))


def test_few_copies_go_without_a_shuffle_of_texts(spark):
    """The documents lose their near copies by keys that are broadcast, whatever Spark would broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = " ".join(f"word{k}" for k in range(60))
        docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, "nothing of the kind")], "doc_id long, text string")
        left = similar.one_of_each(docs)
        assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_workers_give_freed_memory_back(spark):
    """What a task has freed does not stay with its worker, which waits for others beside the executor's heap."""

    def hold(batches):
        import os
        import sys

        pieces = [bytes(1000) for _ in range(200_000)]
        sys.modules["piece_that_stays"] = pieces[-1]  # the last one, so that the heap cannot just end earlier
        del pieces
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()])], ["x"])

    def held(batches):
        import os
        import re
        from pathlib import Path

        for _ in batches:
            anon = int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1])
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([anon])], ["x", "anon"])

    one = spark.range(1).coalesce(1)
    worker = textcols.map_arrow(one, hold, "x long").collect()[0]["x"]
    seen = dict(tuple(textcols.map_arrow(one, held, "x long, anon long").collect()[0]) for _ in range(12))
    assert seen[worker] < 150_000


def test_long_fuzzy_lines_have_blocks_enough():
    """600 lines of 60 words with half of the edits that are allowed: nearly all share a block with their copies."""
    rng = np.random.default_rng(1)
    base = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(60)) for _ in range(600)]
    other = []
    for line in base:
        chars = np.array(list(line))
        chars[rng.choice(len(line), int(len(line) * 0.05), replace=False)] = "ö"
        other.append("".join(chars))
    row, block = lines.blocks(pa.array(base + other))
    cells = [set() for _ in range(1200)]
    for i, k in zip(row.tolist(), block.tolist()):
        cells[i].add(k)
    assert np.mean([bool(cells[k] & cells[600 + k]) for k in range(600)]) >= 0.96


def test_lines_that_meet_are_not_listed_as_pairs(spark, monkeypatch):
    """A large group of near copies, few of them similar enough: no table grows with the square of the group, and the groups are those of all pairs."""
    rng = np.random.default_rng(51)
    made = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5))
    base, texts = [made() for _ in range(40)], []
    for _ in range(120):
        words = list(base)
        for at in rng.choice(40, int(rng.integers(2, 5)), replace=False):
            words[at] = made()
        texts.append(" ".join(words))
    rows = []

    def written(df, what):
        out = common_written(df, what)
        rows.append(out.count())
        return out

    common_written = common.written
    monkeypatch.setattr(common, "written", written)
    got = {r["doc_id"]: r["n_removed"] for r in lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    label, pairs = list(range(120)), 0
    codes = [[ord(c) for c in t] for t in texts]
    for b in range(120):
        for a in range(b):
            if label[a] != label[b] and lines._columns(codes[a], codes[b]) <= int(0.1 * max(len(codes[a]), len(codes[b])) + 1e-9):
                label, pairs = [min(label[a], label[b]) if k in (label[a], label[b]) else k for k in label], pairs + 1
    assert 0 < pairs < 119 and got == {k: int(label[k] != k) for k in range(120)}
    assert max(rows) < 120 * 119 / 4


def test_long_lines_are_compared_in_bands_of_several_words():
    rng = np.random.default_rng(52)
    one, two, most, wanted = [], [], [], []
    for _ in range(160):
        a = rng.choice(list("abcé"), int(rng.integers(500, 1500))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 150))):
            i = int(rng.integers(0, len(b)))
            b[i : i + int(rng.integers(3))] = rng.choice(list("abx"), int(rng.integers(3))).tolist()
        d = lines._columns([ord(c) for c in a], [ord(c) for c in b])
        most.append(min(max(0, d + int(rng.integers(-1, 2))), 255))
        one, two, wanted = [*one, "".join(a)], [*two, "".join(b)], [*wanted, d <= most[-1]]
    (x, xat), (y, yat) = lines._codes(pa.array(one)), lines._codes(pa.array(two))
    nx, ny, most = np.diff(xat), np.diff(yat), np.array(most)
    ok = np.flatnonzero((nx <= ny) & (ny - nx <= most))
    got = lines._banded(x, xat[:-1][ok], nx[ok], y, yat[:-1][ok], ny[ok], most[ok])
    assert (most[ok] > lines.BAND).sum() > 20 and got.tolist() == [wanted[k] for k in ok]
    assert lines.similar_enough(pa.array(one), pa.array(two), most).tolist() == wanted


def test_lines_are_normalised_as_by_the_pattern():
    by_pattern = lambda x: pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(x), r"[^\p{L}\p{M}\p{N}]+", " "))
    rng = np.random.default_rng(53)
    some = list("aZ09 \t\r-_.é中\u0301\u00a0٣ßİ\x00\x1f\x7f😀𝔘Ⅷ")
    made = ["".join(rng.choice(some, int(rng.integers(0, 9)))) for _ in range(20_000)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for texts in (made, every, [], [""], ["-"], ["a", "b"], ["", "a", "-", ""]):
        x = pa.array(texts, pa.string())
        assert lines.normalised(x).equals(by_pattern(x))
        assert lines.normalised(x[3:9]).equals(by_pattern(x[3:9]))


def test_lines_are_counted_or_compared_only_where_it_is_used(monkeypatch):
    """Characters are counted in lines that are not long alone; long lines of many small cells are compared in one go."""
    rng = np.random.default_rng(54)
    made = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n))
    counted, compared = [], []
    histograms, similar_enough = lines.histograms, lines.similar_enough
    monkeypatch.setattr(lines, "histograms", lambda x: counted.extend(x.to_pylist()) or histograms(x))
    monkeypatch.setattr(lines, "similar_enough", lambda x, y, most: compared.append(len(x)) or similar_enough(x, y, most))
    short = [made(9) for _ in range(20)]
    counts = lines.filed_under(pa.array([*short, *(made(40) for _ in range(20))]))[2]
    assert counted == short and counts[20:].any(axis=1).all() and (counts[:20] == histograms(pa.array(short))).all()
    texts = []
    for _ in range(3000):
        a = made(250)
        texts += [a, a[:500] + "zz" + a[503:]]
    norm, n = pa.array(texts), len(texts)
    fine = lines.fixed(lines.characters(norm))
    t = pa.table({"cell": np.arange(n) // 2, "spot": np.zeros(n, np.int64), "mark": np.zeros(n, np.int8), "h": np.arange(n), "size": 2 * np.array([len(x) for x in texts]),
                  "c0": np.zeros(n, np.int64), "c1": np.zeros(n, np.int64), "blocks": lines.packed(np.arange(n), np.arange(n) // 2, n), "norm": norm, "fine": fine})
    got = pa.Table.from_batches(lines._linked_rows(t.to_batches(500), 0.9))
    assert sorted(got.column("a").to_pylist()) == list(range(0, n, 2)) and sum(compared) == n // 2
    assert len(compared) <= 5  # cut by the bytes of their texts alone, and the rest of the last cells
