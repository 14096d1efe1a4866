"""The exact operators against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fragloom.llm import common, decontam, embeddings, lines, mixing, simhash, substring, tokenids, toxicity

WORD = "[^\x20\x09-\x0d]+"


def texts(seed=0, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 80))
    out = [None, "", " \n ", "one", "One ", "two words"]
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(1, 150))))
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()[: int(rng.integers(30, 80))]
        if i % 10 == 3:
            w = ["same"] * int(rng.integers(30, 60))
        out.append(" ".join(w))
    out += [out[10], out[10], out[12].replace("w1", "w2"), passage, "a\tb  c\n" * 40, "long " * 40_000]
    return out


def table(spark, items, repeat=True):
    rows = [(i, t, 1, "x") for i, t in enumerate(items)]
    if repeat:
        rows += [rows[8], (8, "another text under the same id " * 3, 1, "x"), (None, "no id here", 1, "x"), (None, items[9], 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, key string"), rows


def split(t):
    return re.findall(WORD, t or "")


def kept_brute(rows, n=35):
    seen = Counter(tuple(w[k : k + n]) for _, t, *_ in rows for w in [split(t)] for k in range(len(w) - n + 1))
    out = []
    for i, t, *_ in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("repeat", [False, True])
def test_substring(spark, repeat):
    docs, rows = table(spark, texts(), repeat)
    assert Counter(tuple(r) for r in substring.deduplicated(docs).collect()) == kept_brute(rows)


def test_substring_edges(spark):
    docs, _ = table(spark, texts())
    assert substring.deduplicated(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "w " * 34), (2, "x y z")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.deduplicated(alone).collect()} == {0}
    twice = spark.createDataFrame([(1, "w " * 36)], "doc_id long, text string")
    assert substring.deduplicated(twice).first()["n_removed"] == 36


def fingerprint(t, n=3):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(keys, pairs):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash(spark):
    items = texts(1)
    docs, rows = table(spark, items, repeat=False)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fp = {i: fingerprint(t) for i, t, *_ in rows}
    near = joined(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert got == {i: (fp[i], near[i]) for i in fp}
    one = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert one == set(near.values())


def test_simhash_edges(spark):
    docs, rows = table(spark, texts(1))
    assert simhash.near_duplicates(docs).count() == len(rows)
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and left.where("doc_id = 8 AND text LIKE 'another%'").count() <= 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile, tiles", [(512, 64), (8, 64), (8, 1)])
def test_simhash_links_of_dense_groups(spark, monkeypatch, tile, tiles):
    """Many fingerprints in one ball: cut into tiles, or filed again under blanked bits; the components stay the same."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "TILES", tiles)
    rng = np.random.default_rng(5)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = sorted({centre[int(rng.integers(4))] ^ sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 4)))) for _ in range(80)})
    prints = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    if tiles == 1:
        monkeypatch.setattr(simhash, "plan", lambda bits, n, radius: [(list(range(48)), 0), (list(range(48, 56)), 1), (list(range(56, 64)), 0)])
    got = {r["node"]: r["component"] for r in common.components(simhash.linked(prints)).collect()}
    want = joined(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    group = [got.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    assert all((group[a] == group[b]) == (want[a] == want[b]) for a in range(len(fps)) for b in range(a))


def test_simhash_links_rows_without_id(spark, monkeypatch):
    """A row without id may be what joins two others; a group of such rows alone has no component id."""
    prints = spark.createDataFrame([(1, 0), (None, 7), (2, 63), (None, 1 << 40 | 1 << 41 | 1 << 50 | 1 << 51)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda documents, shingle: prints)
    got = {r["fp"]: r["component_id"] for r in simhash.near_duplicates(prints).collect()}
    assert got == {0: 1, 7: 1, 63: 1, 1 << 40 | 1 << 41 | 1 << 50 | 1 << 51: None}


CLASHES = ["gone_id", "gone id", "head id", "simhash fp", "at_fp", "hit_id", "hit_h", "mixing rate", "mixing_rate", "key", "fp", "h", "t", "words", "head_id", "GONE_T", "copies"]


def test_clashing_columns_pass(spark):
    """Stages that pass all columns by do so whatever these are called, with repeated ids or without."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    for repeat in (False, True):
        docs, rows = table(spark, [t for t in texts(4, 12) if not t or len(t) < 9000], False)
        if repeat:
            docs = docs.unionByName(docs.limit(9))
        docs = docs.drop("fp", "key").select("*", *[F.lit("mine").alias(c) for c in CLASHES])
        for stage in (simhash.one_of_each, lambda d: simhash.one_of_each(d, shingle=5, similarity=0.8), lambda d: decontam.clean(d, bench), lambda d: mixing.taken(d, labels), lambda d: toxicity.accepted(d, toxicity.train(d, labels, "toxic", F.lit(True)))):
            out = stage(docs)
            assert out.columns == docs.columns
            assert all(r["hit_id"] == "mine" for r in out.collect())


def test_plans_allocate_all_thresholds():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64)).astype(np.uint8)
    for n in (10, 10_000, 10**6, 10**9):
        p = simhash.plan(bits, n)
        assert sum(t + 1 for _, t in p) == 4
        used = [b for part, _ in p for b in part]
        assert len(used) == len(set(used))
    bits[:, 1] = bits[:, 0]
    assert any({0, 1} <= set(part) for part in simhash.grouped_bits(bits, 4))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (7, 7)] + [(200, 200 + k) for k in range(1, 40)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 105: 100, 103: 100, **{200 + k: 200 for k in range(1, 40)}} | {k: v for k, v in got.items() if k in (0, 100, 200) and v == k}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    items = texts(2)
    docs, rows = table(spark, items)
    bench = [(0, items[14]), (1, "ONE"), (2, None), (3, "..."), (10, " ".join(split(items[6])[:12]).upper()), (11, "w1 w2 w3"), (12, items[14]), (20, "nowhere to be found")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {i: {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} if (w := low(t)) else set() for i, t in bench}
    want = []
    for i, t, *_ in rows:
        w = low(t)
        hit, found = set(), set()
        for item, ws in windows.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        found.add(item)
        want.append((i, len(w), len(hit), len(found), tuple(sorted(map(str, found)))))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"])) for r in decontam.contamination(docs, b).collect()]
    assert Counter(got) == Counter(want)
    clean = decontam.clean(docs, b)
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(x[0] for x in want if not x[2])
    assert decontam.contamination(docs, b.limit(0)).agg(F.max("n_hit")).first()[0] == 0
    assert decontam.contamination(docs.limit(0), b).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    items = texts(2)
    docs, _ = table(spark, items)
    b = spark.createDataFrame([(0, items[14])], "item_id long, text string")
    rows = lambda: Counter(tuple(map(str, r)) for r in decontam.contamination(docs, b, within=9).collect())
    want = rows()
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_PLACES", 0)
    assert rows() == want


def test_proximity(spark):
    """All terms of a window near its rarest one, in any order: against brute force."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(60)] + [(70, "x beta y alpha z"), (71, "alpha " + "q " * 30 + "beta"), (None, "beta alpha")]
    bench = [(1, "alpha beta"), (2, "w1 w2 w1"), (3, "w3 w4 w5 w6"), (4, "w7"), (5, "w8 nowhere")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    times = Counter(w for _, t in docs for w in t.split())
    want = []
    for i, t in docs:
        w, near = t.split(), 0
        for _, phrase in bench:
            terms = phrase.split()
            lead = min(range(len(terms)), key=lambda k: (times[terms[k]], k))
            near += any(x == terms[lead] and set(terms) <= set(w[max(0, k - 9) : k + 10]) for k, x in enumerate(w))
        want.append((i, near))
    assert sum(n for _, n in want) > 50
    assert Counter((r["doc_id"], r["n_near"]) for r in decontam.contamination(d, b, within=9).collect()) == Counter(want)


def test_token_records(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenids.vocabulary_path())
    items = texts(3) + ["  two  spaces ", "tab\there", "it's <|endoftext|> 12,5", "<|endoftext|>", "a<|endoftext|>b<|endoftext|", "é ü　x", "\n\n a"]
    docs, rows = table(spark, items)
    folder = str(tmp_path / "out")
    index = tokenids.write(docs, folder)
    want = Counter()
    for i, x, *_ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = tokenids.digest(index, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in order])[:-1]]).tolist()
    assert [r["doc_id"] if r["doc_id"] is not None else -1 for r in order] == sorted(r[0] if r[0] is not None else -1 for r in rows)
    some = index.orderBy(F.rand(1)).limit(7)
    assert tokenids.read(tokenids.global_starts(index).where("doc_id = 3"), folder).first()["ids"][-1] == 2 and some.count() == 7
    empty = str(tmp_path / "none")
    assert tokenids.digest(tokenids.write(docs.limit(0), empty), empty).count() == 0


def test_frames_are_checked():
    data = bytearray(tokenids.frame(tokenids.pack(7, np.array([1, 2, 70_000]))))
    doc, ids = tokenids.unpack(tokenids.unframe(memoryview(bytes(data))))
    assert doc == 7 and ids.tolist() == [1, 2, 70_000]
    assert tokenids.unpack(tokenids.unframe(memoryview(tokenids.frame(tokenids.pack(None, np.array([1]))))))[0] is None
    for at in (0, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tokenids.unframe(memoryview(bytes(bad)))
    with pytest.raises(ValueError):
        tokenids.unframe(memoryview(bytes(data[:-3])))


def vectors(seed=0, n=300, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, 120):
        x[k + 120] = x[k % 30] + rng.normal(size=dim) * rng.uniform(0.02, 0.3)
    x[5] = x[6]
    x[7] = 3 * x[8]
    return x.astype(np.float32)


def brute_links(x):
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    c = u @ u.T
    np.fill_diagonal(c, 0)
    return c >= 0.95


@pytest.mark.parametrize("tile", [1024, 8])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 32), (903, [None] + [1.0] * 31), (904, [float("nan")] + [1.0] * 31), (905, [float("inf")] + [1.0] * 31), (906, [1.0, 2.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(t, recall=0.9999).collect()}
    link = brute_links(x)
    near = joined(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(link)) if a < b])
    assert sum(got[i]["n_links"] != link[i].sum() for i in range(len(x))) == 0
    assert all(got[i]["component_id"] == near[i] and got[i]["kept"] == (near[i] == i) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))


def test_embeddings_edges(spark):
    one = [1.0, 2.0, 3.0]
    t = spark.createDataFrame([(4, one), (2, one), (2, one), (None, one), (9, [1.0, 2.0, 3.01]), (11, [-5.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(t, recall=0.9999).collect()]
    assert Counter(got) == Counter([(4, 4, 2, False), (2, 4, 2, True), (2, 4, 2, True), (None, 4, 2, False), (9, 4, 2, False), (11, 0, 11, True)])
    assert embeddings.near_duplicates(t.limit(0)).count() == 0


def test_embeddings_of_any_length(spark):
    """Vectors of a rarer length link with each other as those of the commonest do."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(20)] + [(50, [1.0, 2.0, 3.0]), (51, [2.0, 4.0, 6.0]), (52, [1.0, 2.0, 3.01]), (53, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k] for k in (50, 51, 52, 53)] == [(2, 50), (2, 50), (2, 50), (0, 53)]


def test_embedding_recall_of_shipped_settings(spark):
    """Pairs right at the threshold are found by the settings of the query, not by a higher recall."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([got[1500 + i] == i for i in range(1500)]) >= 0.98


def test_embedding_recall_is_calibrated():
    for n in (100, 10_000, 10**6):
        depth, tables, least = embeddings.settings(n)
        sigma = np.sqrt(2 - 2 * 0.95)
        p = embeddings.in_window(sigma) * embeddings.same_cell(sigma) ** depth
        assert 1 - (1 - p) ** tables >= embeddings.RECALL and 0 < least < embeddings.COUNTED


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("tile", [512, 4])
def test_lines(spark, monkeypatch, tile):
    monkeypatch.setattr(lines, "TILE", tile)
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice([f"word{i}" for i in range(200)], 25)) for _ in range(8)]
    docs = []
    for i in range(40):
        some = []
        for k in rng.integers(0, 8, 4):
            w = base[k].split()
            if rng.random() < 0.6:
                w[int(rng.integers(25))] += "x"
            some.append(" ".join(w).capitalize() + rng.choice([".", "", "!!"]))
        docs.append((i, "\n".join([*some, "", "---", f"own line {i} " + " ".join(rng.choice(["p", "q", "r"], 9))])))
    docs += [(90, None), (91, ""), (92, "\n\n")]
    t = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.deduplicated(t).collect()}
    norm = lambda x: lines.normalised(pa.array([x], pa.string()))[0].as_py()
    first = {}
    for i, x in docs:
        for k, line in enumerate((x or "").split("\n")):
            if norm(line):
                first.setdefault(norm(line), (i, k))
    names = list(first)
    pairs = []
    for a in range(len(names)):
        for b in range(a):
            long = max(len(names[a]), len(names[b]))
            most = int(0.1 * long + 1e-9)
            if abs(len(names[a]) - len(names[b])) <= most and edits(names[a], names[b]) <= most:
                pairs.append((b, a))
    assert pairs
    group = joined(range(len(names)), pairs)
    head = {}
    for k, g in group.items():
        head[g] = min(head.get(g, first[names[k]]), first[names[k]])
    keep = set(head.values())
    for i, x in docs:
        every = (x or "").split("\n")
        left = [line for k, line in enumerate(every) if not norm(line) or (i, k) in keep]
        assert got[i] == (len(every), len(every) - len(left), "\n".join(left))
    assert lines.deduplicated(t.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a line\na line"), (1, "other"), (None, "a line"), (1, "other")], "doc_id long, text string")
    assert lines.deduplicated(twice).count() == 4


def test_lines_are_compared_in_columns():
    """The vectorised verdict on pairs is the edit distance's."""
    rng = np.random.default_rng(19)
    one, two = [], []
    for _ in range(400):
        a = rng.choice(list("abcdeü"), int(rng.integers(1, 40))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(3))] = rng.choice(list("abcß"), int(rng.integers(3))).tolist()
        one.append("".join(a))
        two.append("".join(b) or "x")
    most = np.array([int(0.1 * max(len(a), len(b))) + k % 3 for k, (a, b) in enumerate(zip(one, two))])
    assert lines.similar_enough(pa.array(one), pa.array(two), most).tolist() == [edits(a, b) <= m for a, b, m in zip(one, two, most)]
    assert (lines.histograms(pa.array(["aß", ""])).sum(axis=1) == [2, 0]).all()


def test_short_lines_share_a_block_whatever_the_edits():
    """Every two lines under SHORT characters whose edits are allowed meet."""
    rng = np.random.default_rng(20)
    base, other = [], []
    while len(base) < 1500:
        a = rng.choice(list("abc def"), int(rng.integers(9, 32))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(1, 4))):
            k = int(rng.integers(0, len(b)))
            b[k : k + int(rng.integers(2))] = rng.choice(list("xyz"), int(rng.integers(2))).tolist()
        a, b = " ".join("".join(a).split()), " ".join("".join(b).split())
        if min(len(a), len(b)) < lines.SHORT and a != b and edits(a, b) <= int(0.1 * max(len(a), len(b))):
            base.append(a)
            other.append(b)
    row, block = lines.blocks(pa.array(base + other))
    has = [set() for _ in range(3000)]
    for i, k in zip(row.tolist(), block.tolist()):
        has[i].add(k)
    assert all(has[k] & has[1500 + k] for k in range(1500))


def test_edit_distance(monkeypatch):
    rng = np.random.default_rng(9)
    for t in range(300):
        monkeypatch.setattr(lines, "LONG", 4 if t % 2 else 1000)
        monkeypatch.setattr(lines, "FEW", 3 if t % 2 else 48)
        a = rng.choice(list("abcd"), int(rng.integers(0, 40))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 9))):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(2))] = rng.choice(list("abc"), int(rng.integers(2))).tolist()
        true = edits("".join(a), "".join(b))
        for most in (0, 2, 5, 40):
            d = lines.edit_distance(*(np.array([ord(c) for c in s], np.uint64) for s in (a, b)), most)
            assert d == true if true <= most else d > most


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(8)
    for n in (2, 10, 60):
        a, b = rng.integers(0, n, 2 * n), rng.integers(0, n, 2 * n)
        x, y = lines._forest(a, b, n)
        assert (common.local_labels(a, b, n) == common.local_labels(x, y, n)).all() and len(x) < n
        links = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
        assert all(frozenset(p) in links for p in zip(x.tolist(), y.tolist()))
