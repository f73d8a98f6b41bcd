from pyspark.sql import functions as F

from lakelens.operators.catalog_stats import analyze, catalog_column_stats, row_count_ladder
from lakelens.operators.metadata import describe_report, from_json_record, full_metadata, to_json_record
from lakelens.operators.schema import candidate_keys, single_column_keys, table_schema
from lakelens.operators.profile import profile
from tests.conftest import SF001


def test_full_metadata_roundtrip(spark, scratch, users):
    m = full_metadata(spark, users, "public.test_users")
    js = to_json_record(m)
    back = from_json_record(js).collect()[0]
    assert (back.id, back.name, back.database) == ("public.test_users", "test_users", "public")
    assert back.stats.row_count == 3 and back.schema_info.columns[0].name == "id"
    age = back.stats.column_stats["age"]
    assert (age.min_value, age.max_value, age.null_count, age.distinct_count) == ("25", "30", 1, 2)
    plain = full_metadata(spark, users, "test_users", column_stats=False).collect()[0]
    assert plain.database == "default" and plain.stats.column_stats == {}


def test_full_metadata_with_files(spark, scratch):
    p = f"{scratch}/meta/orders_by_status"
    spark.read.parquet(f"{SF001}/orders.parquet").write.partitionBy("o_orderstatus").parquet(p)
    m = full_metadata(spark, spark.read.parquet(p), "tpch.orders", path=p).collect()[0]
    assert m.stats.total_size_bytes > 0 and len(m.partitions) == 3


def test_describe_report_blanks(spark):
    df = spark.sql("SELECT 1 AS k, array(1) AS arr")
    rows = {r.column_name: r for r in describe_report(spark, df, "t").collect()}
    assert rows["arr"].min_value == "" and rows["k"].min_value == "1" and rows["k"].null_count == "0"


def test_schema_and_keys(spark, users):
    s = table_schema(spark, users, "u").collect()
    assert [r.column_name for r in s] == ["id", "name", "age"] and s[0].original_type == "int"
    k = {r.key_columns: r for r in candidate_keys(users, [["id"], ["age"], ["id", "name"]], "u").collect()}
    assert k["id"].is_key and not k["age"].is_key and k["age"].null_rows == 1 and k["id,name"].is_key
    assert [r.column_name for r in single_column_keys(profile(users, "u", distinct="exact")).collect()] == ["id", "name"]


def test_catalog_ladder(spark):
    spark.read.parquet(f"{SF001}/nation.parquet").write.mode("overwrite").saveAsTable("ll_nation")
    first = row_count_ladder(spark, "ll_nation").collect()[0]
    assert first.row_count == 25 and first.source in ("footer", "scan")
    analyze(spark, "ll_nation")
    r = row_count_ladder(spark, "ll_nation").collect()[0]
    assert (r.row_count, r.source) == (25, "catalog")
    c = catalog_column_stats(spark, "ll_nation", "n_name").collect()[0]
    assert c.distinct_count == 25 and c.null_count == 0 and c.min_value is None
    spark.sql("DROP TABLE ll_nation")


def test_full_metadata_without_inline_partitions(spark, scratch):
    p = f"{scratch}/meta/orders_by_status2"
    spark.read.parquet(f"{SF001}/orders.parquet").write.partitionBy("o_orderstatus").parquet(p)
    m = full_metadata(spark, spark.read.parquet(p), "tpch.orders", path=p, inline_partitions=False).collect()[0]
    assert m.partitions == [] and m.stats.total_size_bytes > 0


def test_schema_dialect_compat(spark):
    df = spark.sql("SELECT CAST(1 AS BIGINT) AS a, 1.5D AS b, DATE'2024-01-01' AS d, 'x' AS s")
    emb = {r.column_name: (r.original_type, r.data_type) for r in table_schema(spark, df, "t", "embedded").collect()}
    assert emb == {"a": ("BIGINT", "integer"), "b": ("DOUBLE", "float"), "d": ("DATE", "timestamp"),
                   "s": ("VARCHAR", "string")}
    arrow = {r.column_name: r.data_type for r in table_schema(spark, df, "t", "arrow_parquet").collect()}
    assert arrow == {"a": "integer", "b": "unknown", "d": "unknown", "s": "string"}
    lake = {r.column_name: r.data_type for r in table_schema(spark, df, "t", "lakehouse_sql").collect()}
    assert lake == {"a": "integer", "b": "float", "d": "unknown", "s": "string"}


def test_candidate_keys_shared_profile_path(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    sets = [[c] for c in li.columns] + [["l_orderkey", "l_linenumber"]]
    got = {r.key_columns: r for r in candidate_keys(li, sets, "li").collect()}
    n = li.count()
    pair = li.select("l_orderkey", "l_linenumber").distinct().count()
    assert got["l_orderkey,l_linenumber"].distinct_count == pair
    assert got["l_orderkey,l_linenumber"].is_key == (pair == n)
    for c in li.columns:
        assert got[c].row_count == n and got[c].distinct_count == li.select(c).distinct().count()


def test_describe_with_duplicate_names(spark):
    df = spark.sql("SELECT 1 AS k, 2 AS k2").toDF("k", "k")
    rows = sorted((r.ordinal, r.column_name, r.max_value) for r in describe_report(spark, df, "t").collect())
    assert rows == [(1, "k", "1"), (2, "k", "2")]


def test_full_metadata_duplicate_names_last_wins(spark):
    df = spark.sql("SELECT 1 AS k, 2 AS k2").toDF("k", "k")
    m = full_metadata(spark, df, "t").collect()[0]
    assert list(m.stats.column_stats) == ["k"] and m.stats.column_stats["k"].max_value == "2"


def test_literal_rows_small_and_large(spark):
    from lakelens.functions.literals import literal_rows
    cols = [("i", "INT"), ("s", "STRING"), ("m", "MAP<STRING, STRING>")]
    small = literal_rows(spark, [(1, "a'b", {"k": "v"}), (2, None, {})], cols).collect()
    assert [(r.i, r.s, r.m) for r in small] == [(1, "a'b", {"k": "v"}), (2, None, {})]
    big = literal_rows(spark, [(i, str(i), {}) for i in range(1500)], cols)
    assert big.count() == 1500 and big.schema.names == ["i", "s", "m"]
