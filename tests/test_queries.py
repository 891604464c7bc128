"""Every registered query against its DuckDB statement, and the shape of the plans that must scale."""

import math
import os

import duckdb
import pytest

from gristmill import queries as registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = duck.sql(registry.ORACLES[name])
    assert columns == sorted(relation.columns)
    left = sorted((tuple(map(comparable, r)) for r in df.select(*columns).collect()), key=repr)
    right = sorted((tuple(map(comparable, r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert left == right


def test_queries_without_sql(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, FOLDER).count() > 0


def plan(spark, name):
    return registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_pairwise_joins_and_no_row_udfs(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_keywords_shuffle_whole_texts_once(spark):
    text = plan(spark, "top_keywords")
    assert text.count("Exchange ") == 1 and "Python" not in text


@pytest.mark.parametrize("name", ["dedup_by_url", "dedup_by_text", "dedup_by_posting", "top_terms_by_source"])
def test_hot_keys_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    final = text.index("row_number(), ", text.index("WindowGroupLimit"))
    assert final < text.index("Exchange", final) < text.rindex("WindowGroupLimit")
