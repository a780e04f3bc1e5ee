"""The pipeline on the smallest tables, stage by stage and as a whole, against plain Python."""

import re

import corpus_pipeline
import duckdb
import pytest
from assaykit.llm import registry
from tests.llm.test_operators import brute_components, brute_windows

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after and set(after) <= set(before) and (k == 4 or docs.columns == columns)
        if name == "ngram_jaccard":
            from fractions import Fraction

            comps = brute_components([(i, r["text"]) for i, r in before.items()], 5, Fraction(4, 5))
            assert set(after) == {c for _, c in comps.values()}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {x[0] for x in brute_windows([(i, r["text"]) for i, r in before.items()], items) if x[5]}
        if name == "secrets":
            assert set(after) == set(before)
            assert not any(re.search(r"AKIA[A-Z0-9]{16}|\b[0-9a-f]{24}", r["text"]) for r in after.values())
            assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])
        if name == "mixing":
            assert set(after) == set(before) and all(0 <= r["taken"] <= 3 * r["size"] for r in after.values())


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    shown = lambda names, rows: sorted(tuple(str(r[names.index(c)]) for c in order) for r in rows)
    assert shown(df.columns, df.collect()) == shown(want.columns, want.fetchall())
