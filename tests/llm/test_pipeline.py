"""The pipeline's stages, each on its own input, and the contracts of the queries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fragloom.llm import common, queries

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    1: ["doc_id", "held_out", "score", "predicted"],
    2: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    3: ["doc_id", "held_out", "score", "predicted"],
    4: ["doc_id", "fingerprint", "component_id"],
    5: ["doc_id", "start", "n_tokens", "ids_crc32"],
    6: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    7: ["vec_id", "n_links", "component_id", "kept"],
    8: ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("n", range(1, 11))
def test_contract(spark, n):
    name = next(k for k in queries.QUERIES if k.startswith(f"op{n}_"))
    out = entry.queries()[name](spark, SF)
    assert out.columns[: len(CONTRACTS.get(n, []))] == CONTRACTS.get(n, [])
    table, key = ("embeddings", "vec_id") if n == 7 else ("documents", "doc_id")
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert out.select(key).distinct().count() == out.count()


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.sql(sql)
        order = [want.columns.index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall()), name


def test_stages(spark):
    """Copies go but one, toxic words and benchmark passages are caught, clean texts stay, tokens are whole."""
    rng = np.random.default_rng(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [f"{a}{b}" for a in ("ta", "re", "mi", "so", "lu") for b in ("ban", "dor", "fil", "gus", "hem")]
    rows = []
    for i in range(30):
        rows.append((10_000 + i, " ".join(rng.choice(words, 120)), "en", "s", 0))
    rows.append((20_000, rows[0][1], "en", "s", 0))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows.append((20_001, rows[5][1] + " " + bench, "en", "s", 0))
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, SF), "test-stage")
        at[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        assert docs.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").isEmpty()
    has = lambda name, i: not at[name].where(F.col("doc_id") == i).isEmpty()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(has(names[0], 10_000 + i) for i in range(30))
    assert has(names[1], 10_000) and not has(names[1], 20_000)
    assert not has(names[2], 20_001) and has(names[2], 10_005)
    last = at[names[-1]]
    assert last.count() == at[names[-2]].count()
    assert last.columns == CONTRACTS[5]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_without_this_part(tmp_path):
    """The rest imports and lists its queries when this subpackage is gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import re; import __spark_entry__ as e; q = e.queries(); assert q and not any(re.match(r'op\\d+_', k) or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
