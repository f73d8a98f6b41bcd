"""The frontier walk, and reads of chosen files."""

import os

import pytest
from pyspark.sql import functions as F

from lakelens.operators.catalog_stats import catalog_stats_like, row_count_ladder
from lakelens.operators.footer_stats import footer_row_count, footer_table_stats
from lakelens.operators.inventory import list_all_tables, partition_inventory, table_size
from lakelens.operators.sampling import system_sample
from lakelens.sources import files as FL
from lakelens.sources.deltalog import delta_column_stats, read_delta
from lakelens.sources.listing import list_files
from tests.conftest import SF001, by_col


@pytest.fixture(scope="module")
def tree(scratch):
    root = f"{scratch}/listing/tree"
    wanted = set()
    for i in range(40):
        d = f"{root}/a{i % 4}/b={i}%2F x+y/c"
        os.makedirs(d)
        for name in ("one.txt", "_hidden", ".dot", "two._COPYING_"):
            open(f"{d}/{name}", "w").write("x" * i)
        wanted.add((f"file:{d}/one.txt", i))
    os.makedirs(f"{root}/_delta_log/deep")
    open(f"{root}/_delta_log/0.json", "w").write("{}")
    os.makedirs(f"{root}/empty")
    open(f"{root}/top.csv", "w").write("abc")
    return root, wanted | {(f"file:{root}/top.csv", 3)}


@pytest.mark.parametrize("directories", [1, 7, 1000])
def test_walk_finds_every_visible_file(spark, tree, directories):
    root, wanted = tree
    got = list_files(spark, root, directories=directories).collect()
    assert {(r.path, r.length) for r in got} == wanted and len(got) == len(wanted)
    assert all(abs(r.modificationTime.timestamp() - os.path.getmtime(r.path[5:])) < 1 for r in got)


def test_walk_options(spark, tree, scratch):
    root, wanted = tree
    assert [r.path for r in list_files(spark, root, recursive=False).collect()] == [f"file:{root}/top.csv"]
    assert list_files(spark, root, glob="*.txt").count() == 40
    assert list_files(spark, root, shown=("_delta_log",)).count() == len(wanted) + 1
    assert [(r.path, r.length) for r in list_files(spark, f"{root}/top.csv").collect()] == [(f"file:{root}/top.csv", 3)]
    assert list_files(spark, f"{root}/empty").count() == 0
    # what Spark lists is listed
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length").collect()
    assert {tuple(r) for r in theirs} == {(p, n) for p, n in wanted if n}  # it passes over empty files


def test_missing_paths_raise(spark, scratch):
    gone = f"{scratch}/listing/nowhere"
    for call in (list_files, table_size, partition_inventory, footer_table_stats, footer_row_count):
        with pytest.raises(FileNotFoundError):
            call(spark, gone)
    with pytest.raises(FileNotFoundError):
        row_count_ladder(spark, path=gone)


def test_no_listing_in_the_plan(spark, scratch):
    """Inventories read the walk's Parquet files; no index of the lake is built on the driver."""
    path = f"{scratch}/listing/hive"
    spark.read.parquet(f"{SF001}/orders.parquet").write.partitionBy("o_orderstatus").parquet(path)
    for df in (partition_inventory(spark, path), table_size(spark, path), footer_table_stats(spark, path)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and "FileScan parquet" in plan and "listing" in plan


def test_only_files_prunes_the_scan(spark, scratch):
    path = f"{scratch}/listing/odd names"
    orders = spark.read.parquet(f"{SF001}/orders.parquet").withColumn("k", F.concat(F.lit("a b+%/"), F.col("o_orderkey") % 6))
    orders.write.partitionBy("k").parquet(path)
    rows = spark.read.parquet(path)
    chosen = list_files(spark, path).where(F.col("path").contains("3"))
    chosen = chosen.where(F.col("path").rlike("k=[^/]*3/"))
    got = FL.only_files(rows, chosen)
    assert sorted(r.o_orderkey for r in got.collect()) == sorted(r.o_orderkey for r in orders.where("o_orderkey % 6 = 3").collect())
    assert {r["__path"] for r in got.select("__path").distinct().collect()} == {r.path for r in chosen.collect()}
    counted = got.agg(F.count(F.lit(1)))
    counted.collect()
    # the files of the chosen lots, and the listing's own
    assert FL.files_scanned(counted) - FL.files_scanned(_ran(chosen)) <= 1 + chosen.count()
    assert FL.only_files(rows, chosen.where("false")).count() == 0


def _ran(df):
    df.collect()
    return df


def test_block_sample_opens_few_files(spark, scratch):
    path = f"{scratch}/listing/blocks"
    spark.range(0, 40_000, 1, 200).write.parquet(path)
    rows = spark.read.parquet(path)
    some = system_sample(rows, 5, seed=3, least_files=20, block_rows=10)
    n = len(some.collect())
    assert 5 <= FL.files_scanned(some) <= 40 and 0.3 * 2000 < n < 2 * 2000
    whole = system_sample(rows, 10, seed=3, least_files=0)  # whole files
    n = len(whole.collect())
    assert 0 < n == 200 * FL.files_scanned(whole) < 40_000
    assert system_sample(rows, 0).count() == 0 and system_sample(rows, 100).count() == 40_000
    again = {r.id for r in system_sample(rows, 5, seed=3, least_files=20, block_rows=10).collect()}
    assert again == {r.id for r in some.collect()}


@pytest.fixture(scope="module")
def delta(spark, scratch):
    """Two commits: files of 5 rows and of 7 rows with a long string; then the 7 go."""
    path = f"{scratch}/listing/delta"
    long = "z" * 50
    for name, rows in (("one", [(i, f"s{i}") for i in range(5)]), ("two", [(i, long) for i in range(7)])):
        spark.createDataFrame(rows, "i long, s string").coalesce(1).write.parquet(f"{path}/{name}")
    names = {os.path.basename(os.path.dirname(f.path)): f for f in list_files(spark, path).collect()}
    rel = {k: f"{k}/{os.path.basename(f.path)}" for k, f in names.items()}
    import json

    schema = spark.createDataFrame([], "i long, s string").schema.json()

    def add(k, n, lo, hi):
        stats = {"numRecords": n, "minValues": {"i": 0, "s": lo}, "maxValues": {"i": n - 1, "s": hi}, "nullCount": {"i": 0, "s": 0}}
        return json.dumps({"add": {"path": rel[k], "partitionValues": {}, "size": names[k].length, "modificationTime": 0,
                                   "dataChange": True, "stats": json.dumps(stats)}})

    os.makedirs(f"{path}/_delta_log")
    head = json.dumps({"metaData": {"id": "x", "schemaString": schema, "partitionColumns": []}})
    commits = [[head, add("one", 5, "s0", "s4"), add("two", 7, long[:32], long[:32] + "�")],
               [json.dumps({"remove": {"path": rel["two"], "deletionTimestamp": 1, "dataChange": True}})]]
    for v, lines in enumerate(commits):
        open(f"{path}/_delta_log/{v:020d}.json", "w").write("\n".join(lines))
    return path


def test_removed_files_count_nowhere(spark, delta):
    assert tuple(row_count_ladder(spark, path=delta).first()) == (5, "footer")
    assert footer_row_count(spark, delta).first().row_count == 5
    assert by_col(footer_table_stats(spark, delta))["i"].max_int == 4
    assert table_size(spark, delta).first().file_count == 1
    rows = read_delta(spark, delta)
    assert rows.count() == 5 and read_delta(spark, delta, 0).count() == 12
    ran = _ran(rows.select("i"))
    assert FL.files_scanned(ran) == 1 + 2  # and the log's two commits


def test_shortened_bounds_are_not_values(spark, delta):
    s = by_col(delta_column_stats(spark, delta, 0))["s"]
    assert (s.min_str, s.max_str) == ("s0", "z" * 50)


def test_catalog_statistics_in_one_statement(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS stats_db")
    for t in ("alpha_1", "alpha_2", "beta"):
        spark.range(7).write.mode("overwrite").saveAsTable(f"stats_db.{t}")
    spark.sql("CREATE OR REPLACE VIEW stats_db.alpha_view AS SELECT * FROM stats_db.beta")
    spark.sql("ANALYZE TABLE stats_db.alpha_1 COMPUTE STATISTICS")
    got = {r.table_name: r for r in catalog_stats_like(spark, "stats_db", "alpha%").collect()}
    assert set(got) == {"alpha_1", "alpha_2", "alpha_view"}
    assert got["alpha_1"].row_count == 7 and got["alpha_1"].size_bytes > 0
    assert got["alpha_2"].row_count is None and got["alpha_view"].size_bytes is None
    assert catalog_stats_like(spark, "stats_db", "nothing%").count() == 0
    with pytest.warns(UserWarning, match="no_such_db"):
        assert [r.name for r in list_all_tables(spark, ["stats_db", "no_such_db"]).where("name like '%beta'").collect()] == ["stats_db.beta"]
