"""Every registered query with an SQL form against DuckDB on the smallest tables; the others for rows."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].astype(object)

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return ""
        try:
            return f"{float(v):.4f}" if not isinstance(v, (str, bool)) else str(v)
        except (TypeError, ValueError):
            return str(v)

    return list(df.columns), sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = canonical(entry.queries()[name](spark, FOLDER).toPandas())
    want = canonical(duck.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    off = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    # neighbouring roundings of the last printed digit are the only difference allowed
    for a, b in off:
        assert all(x == y or abs(float(x or "nan") - float(y or "nan")) < 2e-4 for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_search_passages_reads_document_texts(spark, monkeypatch):
    from borelight.plans import similarity

    def seen(queries, chunks, documents, wells):
        return chunks.selectExpr("document_id AS query_id", "chunk_id", "0 AS similarity", "1 AS rank", "text AS passage", "text AS title", "'' AS well_name")

    monkeypatch.setattr(similarity, "search_passages", seen)
    got = {r["chunk_id"]: r["title"] for r in entry.queries()["search_passages"](spark, FOLDER).collect()}
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{FOLDER}/embeddings.parquet").count() and all(got[k] == want.get(k) for k in got)
