"""End-to-end flows modeled on the reference's integration tests."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq

from lakelens.operators.footer_stats import footer_row_count, footer_table_stats
from lakelens.operators.history import current, fresh, read_history, refresh_stale
from lakelens.operators.inventory import list_tables
from lakelens.operators.metadata import full_metadata
from lakelens.operators.sampling import sample
from lakelens.sources.listing import list_files
from lakelens.sources.readers import export_tables, register_directory
from tests.conftest import SF001, by_col


def test_register_discover_metadata_sample(spark, scratch):
    base = f"{scratch}/flows/tpc"
    names = ["customer", "lineitem"]
    export_tables({n: spark.read.parquet(f"{SF001}/{n}.parquet") for n in names}, base)
    views = register_directory(spark, base, prefix="flow_")
    listed = {r.name: r.type for r in list_tables(spark).collect()}
    assert all(listed[v] == "view" for v in views) and "flow_lineitem" in views
    m = full_metadata(spark, spark.table("flow_customer"), "flow.customer").collect()[0]
    assert m.stats.row_count > 0 and "c_custkey" in m.stats.column_stats
    assert sample(spark.table("flow_customer"), "limit", limit=5).count() == 5
    assert isinstance(sample(spark.table("flow_customer"), "bernoulli", percent=10).collect(), list)


def test_object_store_golden_footers(spark, scratch):
    d = f"{scratch}/flows/bucket/data"
    os.makedirs(d, exist_ok=True)
    pq.write_table(pa.table({"col1": pa.array([1, 2, 3], pa.int64()), "col2": ["a", "b", "c"]}),
                   f"{d}/file1.parquet")
    paths = [r.path for r in list_files(spark, f"{scratch}/flows/bucket").collect()]
    assert len(paths) == 1 and paths[0].endswith("data/file1.parquet")
    assert footer_row_count(spark, f"{scratch}/flows/bucket").collect()[0].row_count == 3
    c1 = by_col(footer_table_stats(spark, f"{scratch}/flows/bucket"))["col1"]
    assert (c1.min_int, c1.max_int, c1.null_count) == (1, 3, 0)


def test_cache_miss_hit_refresh_equal(spark, scratch, users):
    path = f"{scratch}/flows/cache"
    t0 = dt.datetime(2024, 5, 1, 8, 0, 0)
    assert refresh_stale(spark, {"public.test_users": users}, path, "pg", t0) == ["public.test_users"]
    hit = fresh(current(read_history(spark, path)), t0 + dt.timedelta(minutes=5)).collect()
    assert refresh_stale(spark, {"public.test_users": users}, path, "pg", t0 + dt.timedelta(minutes=5)) == []
    refresh_stale(spark, {"public.test_users": users}, path, "pg", t0 + dt.timedelta(minutes=6), force=True)
    again = current(read_history(spark, path)).collect()
    assert len(hit) == 1 and len(again) == 1
    assert hit[0].content == again[0].content and again[0].last_updated > hit[0].last_updated
