import os
import datetime as dt
import json

from lakelens.operators.catalog_stats import analyze, catalog_stats_like
from lakelens.operators.history import current, discovery_rows, fresh
from lakelens.operators.inventory import (catalog_partition_row_counts, catalog_partitions,
                                          list_all_tables, list_directories, list_tables)
from lakelens.operators.schema import describe_columns
from tests.conftest import SF001


def test_catalog_tables_partitions_and_describe(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS llcat")
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    o.write.mode("overwrite").partitionBy("o_orderstatus").saveAsTable("llcat.orders_p")
    spark.read.parquet(f"{SF001}/region.parquet").write.mode("overwrite").saveAsTable("llcat.region")
    names = [r.name for r in list_all_tables(spark, ["llcat", "no_such_db"]).collect()]
    assert names == ["llcat.orders_p", "llcat.region"]
    by_cat = [r.name for r in list_all_tables(spark, catalog="spark_catalog").collect()]
    assert "llcat.orders_p" in by_cat and "llcat.region" in by_cat
    parts = {(r.column_name, r.value) for r in catalog_partitions(spark, "llcat.orders_p").collect()}
    assert parts == {("o_orderstatus", v) for v in ("F", "O", "P")}
    rc = {r.value: r.row_count for r in catalog_partition_row_counts(spark, "llcat.orders_p").collect()}
    assert rc == {r.o_orderstatus: r["count"] for r in o.groupBy("o_orderstatus").count().collect()}
    d = [r.col_name for r in describe_columns(spark, "llcat.orders_p").collect()]
    assert sorted(d) == sorted(o.columns)
    analyze(spark, "llcat.region", columns=False)
    st = {r.table_name: r for r in catalog_stats_like(spark, "llcat", "reg%").collect()}
    assert st["region"].row_count == 5 and "orders_p" not in st
    assert catalog_stats_like(spark, "llcat", "zzz%").count() == 0
    spark.sql("DROP DATABASE llcat CASCADE")


def test_directories(spark, scratch):
    base = f"{scratch}/cat/dirs"
    spark.read.parquet(f"{SF001}/region.parquet").write.partitionBy("r_name").parquet(f"{base}/region")
    top = [r.name for r in list_directories(spark, base).collect()]
    assert top == ["region"]
    deep = [r.name for r in list_directories(spark, base, recursive=True).collect()]
    assert "region" in deep and any(n.startswith("region/r_name=") for n in deep)


def test_discovery_record(spark):
    spark.read.parquet(f"{SF001}/region.parquet").createOrReplaceTempView("disc_region")
    at = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = discovery_rows(list_tables(spark), "spark", "default", last_updated=at)
    cur = current(rows).collect()
    assert len(cur) == 1 and cur[0].kind == "discovery"
    assert {"name": "disc_region", "type": "view"} in json.loads(cur[0].content)
    assert fresh(current(rows), at + dt.timedelta(seconds=3600)).count() == 1
    assert fresh(current(rows), at + dt.timedelta(seconds=3601)).count() == 0


def test_databases_and_three_part_ids(spark, scratch):
    from lakelens.operators.inventory import list_databases, table_size
    from lakelens.sources.readers import read_catalog_table
    spark.sql("CREATE DATABASE IF NOT EXISTS llthree")
    spark.read.parquet(f"{SF001}/region.parquet").write.mode("overwrite").saveAsTable("llthree.region")
    assert "llthree" in [r.name for r in list_databases(spark).collect()]
    assert read_catalog_table(spark, "spark_catalog.llthree.region").count() == 5
    assert read_catalog_table(spark, "llthree.region").count() == 5
    os.makedirs(f"{scratch}/cat/nothing_here")
    empty = table_size(spark, f"{scratch}/cat/nothing_here").collect()[0]
    assert (empty.file_count, empty.total_size_bytes, empty.last_modified) == (0, 0, None)
    spark.sql("DROP DATABASE llthree CASCADE")
