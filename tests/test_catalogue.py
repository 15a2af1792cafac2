"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from mirrorfall.plans.catalogue import QUERIES
from mirrorfall.streaming.catalogue import QUERIES as STREAM_QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [*QUERIES, *STREAM_QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (float, Decimal)):
        return round(float(value), 9)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = {**QUERIES, **STREAM_QUERIES}[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert mine is not None
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", ["tier_funnel", "tier_counters"])
def test_tiers_of_null_and_accented_texts_match_sql(spark, tmp_path, name):
    texts = [None, None, "", "", "é" * 32 + "a" * 20, "é" * 32 + "b" * 20, *["é" * 600] * 2, "é" * 300 + "è" + "é" * 299]
    docs = spark.createDataFrame([(i, t, "web", "en") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = con.execute(__spark_entry__.oracle_sql()[name])
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in found.description], found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["size", "content_hash", "n_files", "files"]
