import pytest

from lakelens.sources.jdbc import jdbc_url, table_ref
from lakelens.sources.readers import export_tables, load_table, register_directory, split_table_id
from tests.conftest import SF001


def test_jdbc_checks():
    with pytest.raises(ValueError, match="SQLite requires 'database' parameter"):
        jdbc_url({"driver": "sqlite"})
    with pytest.raises(ValueError, match="Missing required connection parameters for postgresql: host, port, database, username"):
        jdbc_url({"driver": "postgresql"})
    with pytest.raises(ValueError, match="port, username"):
        jdbc_url({"driver": "postgresql", "host": "h", "database": "d"})
    assert jdbc_url({"driver": "postgresql", "host": "h", "port": 5432, "database": "d"},
                    {"username": "u"}) == "jdbc:postgresql://h:5432/d"
    assert jdbc_url({"url": "postgresql://h/d"}) == "jdbc:postgresql://h/d"
    assert jdbc_url({"driver": "sqlite", "database": "/x.db"}) == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        table_ref("a.b.c")


def test_source_dispatch(spark, scratch):
    with pytest.raises(ValueError, match="DuckDB connection requires 'database' parameter"):
        load_table(spark, {"type": "duckdb", "connection_details": {}}, "t")
    with pytest.raises(ValueError, match="Unsupported source type"):
        load_table(spark, {"type": "nope", "connection_details": {}}, "t")
    base = f"{scratch}/sources/lake"
    export_tables({"region": spark.read.parquet(f"{SF001}/region.parquet")}, base)
    df = load_table(spark, {"type": "file_system", "connection_details": {"path": base}}, "region")
    assert df.count() == 5
    assert register_directory(spark, base, prefix="src_") == ["src_region"]
    assert spark.table("src_region").count() == 5
    df2 = load_table(spark, {"type": "duckdb", "connection_details": {"database": base}}, "main.region")
    assert df2.count() == 5


def test_split_ids():
    assert split_table_id("t") == (None, None, "t")
    assert split_table_id("db.t") == (None, "db", "t")
    assert split_table_id("c.db.t") == ("c", "db", "t")
    with pytest.raises(ValueError):
        split_table_id("a.b.c.d")


def test_file_system_source_reads_delta(spark):
    from lakelens.plans.fixtures import lake
    base = lake(spark, SF001)
    cfg = {"type": "file_system", "connection_details": {"path": base}}
    o = spark.read.parquet(f"{SF001}/orders.parquet").count()
    assert load_table(spark, cfg, "tpch/orders_delta").count() == o
    assert load_table(spark, cfg, "tpch/orders").count() == o


def test_jdbc_statistics_statement():
    from lakelens.sources.jdbc import column_stats_sql
    sql = column_stats_sql("public.test_users", ["age", "name"])
    assert sql == ("SELECT COUNT(*) AS n, COUNT(age) AS nn0, COUNT(DISTINCT age) AS d0, MIN(age) AS mn0, "
                   "MAX(age) AS mx0, COUNT(name) AS nn1, COUNT(DISTINCT name) AS d1, MIN(name) AS mn1, "
                   "MAX(name) AS mx1 FROM public.test_users")
