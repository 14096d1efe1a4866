"""The trained operators: folds, held-out accuracy, edge cases."""

import numpy as np
import pyarrow as pa
import pytest

from fragloom.llm import common, features, langid, mixing, quality, textcols, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
CLEAN = "the quick river of stone went by and the old house of wood was there with light on it"
SHAPE = [None, "", "   \n\t ", "!!! ???", "word", "ß é ñ", "x" * 300_000, "a b " * 50_000]


def odd(spark, extra=True):
    rows = [(i, t, "s", "en") for i, t in enumerate(SHAPE)] + [(3, "!!! ???", "s", "en"), (None, "no id", "s", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, held_out string")


def corpus(spark, n=300):
    """Documents of two kinds with labels: quality by shouting, toxic by a made-up word family."""
    rng = np.random.default_rng(7)
    words = CLEAN.split()
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 60))
        low, toxic = i % 5 == 0, i % 3 == 0
        if low:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for k in rng.integers(0, 60, 3):
                w[k] = "gnarf" + rng.choice(["ing", "er", "ly", "ed"])
        docs.append((i, " ".join(w), ["aa", "bb"][i % 2] if i % 7 else None, "s", 0))
        labels.append((i, 0 if low else 1, 1 if toxic else 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folds_are_crc32(spark):
    import zlib

    t = spark.range(50).select(F.col("id"), common.remainder("id", 5).alias("m"))
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in t.collect())


def test_sparse_and_dots_agree():
    texts = pa.array([CLEAN, "", None, "A A a a! 12", "Ü Ü Ü"])
    w = np.random.default_rng(0).normal(size=(features.SIZE, 3)).astype(np.float32)
    got, words = features.dots(texts, w)
    want = [(v[:, None] * w[c]).sum(axis=0) if len(c) else np.zeros(3) for c, v in features.sparse(texts)]
    assert np.allclose(got, want, atol=1e-3)
    assert words.tolist() == [19, 0, 0, 5, 3]


def test_ftrl_separates():
    rng = np.random.default_rng(1)
    rows = [(np.array([k % 2, 5 + int(rng.integers(9))]), np.ones(2)) for k in range(200)]
    w, b = features.ftrl(rows, np.arange(200) % 2, 2)
    assert w[1, 0] + b[0] > 0 > w[0, 0] + b[0]
    w, b = features.ftrl([(np.array([k % 3]), np.ones(1)) for k in range(300)], np.arange(300) % 3, 3)
    assert [int((w[k] + b).argmax()) for k in range(3)] == [0, 1, 2]


def test_quality(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels, "quality", common.remainder("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([got[i]["predicted"] == q for i, q in want.items()]) > 0.98
    edge = quality.score(odd(spark), model).collect()
    assert len(edge) == len(SHAPE) + 2 and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.score(docs.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1")):
        one = quality.train(docs, some, "quality", F.lit(True))
        s = quality.score(docs, one).select(F.min("score"), F.max("score")).first()
        assert s[0] == s[1] and 0 <= s[0] <= 1


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9):
        e, trans = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2))
        p, pairs = toxicity.marginals(e, np.array([0, n]), trans, pairs=True)
        total, node, edge = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(e[k] * y[k] for k in range(n)) + sum(trans[a, b] for a, b in zip([0, *y], y)))
            total += w
            node += w * np.array(y)
            for a, b in zip([0, *y], y):
                edge[a, b] += w
        assert np.allclose(p, node / total) and np.allclose(pairs, edge / total)


def test_marginals_across_blocks():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 31, 32, 33, 200, 0, 64]
    at = np.concatenate([[0], np.cumsum(sizes)])
    e, trans = rng.normal(0, 2, at[-1]), rng.normal(0, 1, (2, 2))
    every = toxicity.marginals(e, at, trans)
    for a, b in zip(at, at[1:]):
        m = np.exp(np.stack([trans + [0, x] for x in e[a:b]])) if b > a else []
        f = [np.array([1.0, 0.0])]
        for x in m:
            f.append(f[-1] @ x / (f[-1] @ x).sum())
        g = [np.ones(2)]
        for x in m[::-1]:
            g.append(x @ g[-1] / (x @ g[-1]).sum())
        want = [(u * v)[1] / (u * v).sum() for u, v in zip(f[1:], g[::-1][1:])]
        assert np.allclose(every[a:b], want)


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels, "toxic", common.remainder("doc_id", 3) != 1)
    got = {r["doc_id"]: r for r in toxicity.tag(docs, model).collect()}
    want = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert np.mean([got[i]["predicted"] == q for i, q in want.items()]) > 0.98
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(text[0][s["start"] : s["end"]].lower().startswith("gnarf") for s in got[0]["spans"]) and got[0]["spans"]
    assert {r["doc_id"] for r in toxicity.accepted(docs, model).collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.accepted(docs, model).columns == docs.columns
    edge = toxicity.tag(odd(spark), model).collect()
    assert len(edge) == len(SHAPE) + 2 and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.tag(docs.limit(0), model).count() == 0
    one = toxicity.train(docs, labels.limit(0), "toxic", F.lit(True))
    assert toxicity.tag(docs, one).select("score").distinct().count() == 1


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, common.remainder("doc_id", 4) != 2)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where((common.remainder("doc_id", 4) == 2) & (F.col("lang_pred") != "und"))
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    edge = {r["doc_id"]: r for r in langid.identify(odd(spark), model).collect()}
    assert [edge[i]["lang_pred"] == "und" for i in range(5)] == [True, True, True, True, False]
    assert edge[0]["score"] == 0 and all(0 <= r["score"] <= 1 for r in edge.values())
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r[0] for r in langid.identify(docs.limit(5), none).select("lang_pred").collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_every_language_is_learnt(spark):
    """However many there are, the rarest too; and the fit is the ridge regression of the whole kernel when all texts are landmarks."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(230):
        word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
        rows += [(len(rows) + j, f"{word} {word[::-1]} {word}{j}", f"l{k:03d}") for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert len(model.langs) == 230
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.98
    texts, langs = [t for _, t, _ in rows[:40]], [lang for _, _, lang in rows[:40]]
    model = langid.fit(texts, langs, landmarks=40, ridge=0.01)
    x = langid.presence(pa.array(texts)).astype(float)
    k = x @ x.T / np.sqrt(np.outer(x.sum(axis=1), x.sum(axis=1)))
    y = np.array([[1.0 if a == b else -1.0 for b in model.langs] for a in langs])
    exact = k @ np.linalg.solve(k + 0.01 * np.eye(40), y)
    mine = (x @ model.matrix) / np.sqrt(x.sum(axis=1, keepdims=True)) + model.bias
    assert np.abs(mine - exact).max() < 0.02


def test_presence_is_a_set():
    x = langid.presence(pa.array(["abab", "ab ab", None, "ÉÉ"]))
    assert x.max() == 1 and x[2].sum() == 0
    assert (langid.presence(pa.array(["abab abab"])) == langid.presence(pa.array(["abab abab abab"]))).all()
    assert (langid.presence(pa.array(["éé"])) == x[3:4]).all()


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1, 0.4, 0.3], 2000)
    t = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(0, 500, 2000), p)], "tokens long, posterior array<double>")
    for target in ((0.5, 0.3, 0.2), (0.2, 0.4, 0.4)):
        fitted = mixing.fit(t, target)
        assert fitted.settled and np.abs(fitted.share - target).max() < 0.005
        rates = np.array([r["rate"] for r in mixing.with_rates(t, fitted).collect()])
        assert (rates >= 0).all()
        # the optimum: no feasible direction goes down
        tokens = np.array([r["tokens"] for r in t.collect()])
        total = tokens.sum()
        grad = p @ ((rates * tokens) @ p / total - target) + mixing.L2 * (rates - 1)
        assert np.abs(np.where(rates > 0, grad, np.minimum(grad, 0))).max() < 1e-3
    with pytest.warns(UserWarning, match="still moved"):
        assert not mixing.fit(t, (0.2, 0.4, 0.4), rounds=2).settled
    empty = mixing.fit(t.limit(0), (0.5, 0.3, 0.2))
    assert mixing.with_rates(t.limit(0), empty).count() == 0


def test_mixed_documents(spark):
    docs, labels = corpus(spark, 120)
    out = mixing.mixed(docs, labels).collect()
    assert len(out) == 120 and all(abs(sum(r["posterior"]) - 1) < 1e-6 for r in out)
    kept = mixing.taken(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["copies"] for r in out)
    edge = mixing.mixed(odd(spark).select("doc_id", "text"), labels).collect()
    assert len(edge) == len(SHAPE) + 2 and min(r["tokens"] for r in edge) == 0
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_mixture_of_the_tables_meets_its_target(spark):
    """The reached shares are the targets, by the posteriors and by the labels that these stand for."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.mixed(docs, labels)
    total = out.agg(F.sum("tokens")).first()[0]
    share = np.array([out.agg(F.sum(F.col("rate") * F.col("tokens") * F.col("posterior")[k])).first()[0] / total for k in range(3)])
    assert np.abs(share - mixing.TARGET).max() < 0.005
    tagged = out.join(labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("y")), "doc_id")
    mean = {r["y"]: r["p"] for r in tagged.groupBy("y").agg(F.avg(F.element_at("posterior", F.col("y") + 1)).alias("p")).collect()}
    assert min(mean.values()) > 0.7, mean


def test_posteriors_are_put_on_scale():
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 3, 4000)
    m = rng.normal(size=(4000, 3))
    m[np.arange(4000), truth] += 1.0  # the true log odds are these; they are given four times too steep
    scale, move = mixing.scaled(4 * m, truth)
    assert abs(scale - 0.25) < 0.04 and np.abs(move).max() < 0.15


def test_copies_average_to_the_rate(spark):
    t = spark.range(20_000).withColumn("c", mixing.copies(F.lit(1.3), F.col("id")))
    assert t.select(F.avg("c")).first()[0] == pytest.approx(1.3, abs=0.02)


def test_chunks():
    b = pa.record_batch([pa.array(["x" * 10] * 100)], ["text"])
    for limit in (30, 500, 10_000):
        parts = list(textcols.chunks(iter([b, b.slice(0, 0), b]), limit=limit))
        assert sum(p.num_rows for p in parts) == 200 and all(p.num_rows for p in parts)
