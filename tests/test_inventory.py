import pytest
from pyspark.sql import functions as F

from lakelens.operators.inventory import (lake_inventory, list_lake_databases, list_tables,
                                          partition_inventory, partition_row_counts, table_size)
from tests.conftest import SF001


@pytest.fixture(scope="module")
def hive(spark, scratch):
    out = f"{scratch}/inv/hive"
    o = spark.read.parquet(f"{SF001}/orders.parquet").withColumn(
        "o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    o.write.partitionBy("o_orderstatus", "o_orderpriority").parquet(out)
    return out


def test_partitions(spark, hive):
    p = partition_row_counts(spark, hive).collect()
    lvl1 = {r.value: r.row_count for r in p if r.depth == 1}
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    assert lvl1 == {r.o_orderstatus: r["count"] for r in o.groupBy("o_orderstatus").count().collect()}
    vals = {r.value for r in p if r.depth == 2}
    assert None in vals and "4-NOT SPECIFIED" in vals and "5-LOW" not in vals
    inv = partition_inventory(spark, hive).collect()
    assert all(r.file_count >= 1 and r.size_bytes > 0 for r in inv)
    assert any(r.location.startswith("o_orderstatus=") and "/" in r.location for r in inv if r.depth == 2)


def test_lake(spark, scratch):
    base = f"{scratch}/inv/lake"
    spark.read.parquet(f"{SF001}/region.parquet").write.parquet(f"{base}/db1/region")
    spark.read.parquet(f"{SF001}/nation.parquet").write.json(f"{base}/db2/nation_json")
    inv = {(r.database, r.table_name): r for r in lake_inventory(spark, base).collect()}
    assert inv[("db1", "region")].format == "parquet" and inv[("db1", "region")].file_count >= 1
    assert inv[("db2", "nation_json")].format == "unknown"
    assert [r.name for r in list_lake_databases(spark, base).collect()] == ["db1", "db2"]
    sz = table_size(spark, f"{base}/db1/region").collect()[0]
    assert sz.total_size_bytes > 0 and sz.last_modified is not None


def test_list_tables(spark):
    spark.read.parquet(f"{SF001}/region.parquet").createOrReplaceTempView("zz_region")
    spark.read.parquet(f"{SF001}/nation.parquet").createOrReplaceTempView("aa_nation")
    names = [(r.name, r.type) for r in list_tables(spark).collect()]
    assert ("aa_nation", "view") in names and ("zz_region", "view") in names
    assert [n for n, _ in names] == sorted(n for n, _ in names)


def test_lake_counts_live_files_of_delta_tables(spark, scratch):
    from lakelens.plans import fixtures as FX

    base = f"{scratch}/inv/delta-lake"
    spark.read.parquet(f"{SF001}/region.parquet").write.parquet(f"{base}/db/region")
    FX.delta_orders(spark, SF001, table_dir=f"{base}/db/orders", commits=2)
    inv = {r.table_name: r for r in lake_inventory(spark, base).collect()}
    held = table_size(spark, f"{base}/db/orders").first()
    there = {r.table_name: r for r in lake_inventory(spark, base, live=False).collect()}
    assert (inv["orders"].file_count, inv["orders"].size_bytes) == (held.file_count, held.total_size_bytes)
    assert inv["orders"].file_count < there["orders"].file_count
    assert inv["region"] == there["region"]
