"""Registered queries against DuckDB on the smallest tables, and the pipeline against its stages."""

import ast
import os

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from gustline.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_registered():
    assert set(QUERIES) <= set(contract.queries()) and "pipeline" in contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == given.columns and out.dtypes == given.dtypes, name
        before, rows = docs.count(), out.count()
        if name == "language_id":
            assert rows == before
        if name == "minhash_near_dedup":
            assert 0 < rows < before and out.select("doc_id").distinct().count() == rows
        if name == "secret_scan":
            assert rows == before
        docs = spark.createDataFrame(out.collect(), out.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    totals = pieces.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in totals) <= 2048 and pieces.where("piece = 0").count() == docs.count()


def test_pipeline_functions_survive_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_nothing_else_imports_this_folder():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "gustline")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in (n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, name)) as f:
                for node in ast.walk(ast.parse(f.read())):
                    found = getattr(node, "module", None) or ",".join(a.name for a in getattr(node, "names", []) if hasattr(a, "name"))
                    assert "llm" not in (found or ""), (folder, name)
