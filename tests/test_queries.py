import duckdb
import pytest
from compare import rows

from corpusloom.plans import queries

TABLES = ("documents", "labels", "conversations", "benchmark", "pages", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", ["segment_softmax", "chunk_stream", "exact_split"])
def test_results_do_not_hang_on_partitions(spark, sf_dir, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(queries.QUERIES[name](spark, sf_dir).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
