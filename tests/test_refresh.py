"""Profiles refreshed from changed files only; reads of directories whose files disagree."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.operators import refresh as R
from lakelens.operators.profile import profile
from lakelens.sources import unified as U
from lakelens.sources.files import files_scanned
from tests.conftest import SF001

EXACT = ["column_name", "row_count", "null_count", "min_int", "max_int", "min_num", "max_num", "min_str", "max_str", "min_ts", "max_ts", "max_len"]


def same(a, b):
    assert sorted(map(tuple, a.select(*EXACT).collect()), key=str) == sorted(map(tuple, b.select(*EXACT).collect()), key=str)


@pytest.fixture
def six(spark, tmp_path):
    path = f"{tmp_path}/six"
    spark.read.parquet(f"{SF001}/orders.parquet").withColumn("k", F.col("o_orderkey") % 6).write.partitionBy("k").parquet(path)
    return path, f"{tmp_path}/state"


def test_refresh_reads_what_changed(spark, six, monkeypatch):
    path, state = six
    same(R.refresh_profile(spark, path, state), profile(spark.read.parquet(path)))
    runs = os.listdir(state)
    same(R.refresh_profile(spark, path, state), profile(spark.read.parquet(path)))
    assert os.listdir(state) == runs  # nothing was read
    schema = R.schema_id_of(spark.read.parquet(path), spark.read.parquet(path).columns)
    # one file of six changes, one goes, one comes
    (spark.read.parquet(f"{path}/k=3").withColumn("o_totalprice", F.col("o_totalprice") * 2).limit(100).toPandas()
     .to_parquet(f"{path}/k=3/{[f for f in os.listdir(f'{path}/k=3') if f.startswith('part')][0]}", index=False, coerce_timestamps="us"))
    for f in os.listdir(f"{path}/k=3"):
        if f.endswith(".crc"):
            os.remove(f"{path}/k=3/{f}")
    changed = R.changed_files(spark, path, state, schema)
    assert [r.path.count("k=3") for r in changed.collect()] == [1]
    read = []
    whole = R.only_files

    def only_files(rows, files):
        out = whole(rows, files)
        ran = out.select("o_orderkey")
        ran.collect()
        read.append(files_scanned(ran))
        return out

    monkeypatch.setattr(R, "only_files", only_files)
    same(R.refresh_profile(spark, path, state), profile(spark.read.parquet(path)))
    listing = files_scanned(_ran(R.changed_files(spark, path, f"{state}-none", schema)))
    assert read[0] <= 1 + 3 * listing + len(os.listdir(state)) * 8 and len(read) == 1
    for f in os.listdir(f"{path}/k=5"):
        os.remove(f"{path}/k=5/{f}")
    same(R.refresh_profile(spark, path, state), profile(spark.read.parquet(path)))
    assert len(read) == 1


def _ran(df):
    df.collect()
    return df


def test_refresh_edges(spark, tmp_path):
    path, state = f"{tmp_path}/t", f"{tmp_path}/s"
    spark.createDataFrame([], "a long, b string").write.parquet(path)
    rows = spark.read.schema("a long, b string").parquet(path)
    assert {(r.column_name, r.row_count) for r in R.refresh_profile(spark, path, state, rows=rows).collect()} == {("a", 0), ("b", 0)}
    spark.createDataFrame([(1, "x"), (None, None)], "a long, b string").write.mode("append").parquet(path)
    rows = spark.read.schema("a long, b string").parquet(path)
    same(R.refresh_profile(spark, path, state, rows=rows), profile(rows))
    # another schema reads every file again; partials of two refreshes at once count once
    wide = spark.read.schema("a long, b string, c double").parquet(path)
    same(R.refresh_profile(spark, path, state, rows=wide), profile(wide))
    twice = spark.read.parquet(state)
    twice.withColumn("run", F.lit("zzzzzzzz")).write.partitionBy("run").mode("append").parquet(state)
    same(R.refresh_profile(spark, path, state, rows=wide), profile(wide))
    with pytest.raises(FileNotFoundError):
        R.refresh_profile(spark, f"{tmp_path}/gone", state, rows=rows)


@pytest.mark.parametrize("a, b, out", [
    ("tinyint", "smallint", "smallint"), ("int", "bigint", "bigint"), ("int", "double", "double"), ("float", "double", "double"),
    ("float", "int", "double"), ("bigint", "decimal(12,2)", "decimal(22,2)"), ("decimal(38,0)", "decimal(38,10)", "double"),
    ("date", "timestamp_ntz", "timestamp_ntz"), ("timestamp", "timestamp_ntz", "timestamp"), ("date", "timestamp", "timestamp"),
    ("string", "int", "string"), ("boolean", "int", "string"), ("void", "int", "int"), ("date", "int", "string"),
    ("array<int>", "array<bigint>", "array<bigint>"), ("map<string,int>", "map<string,double>", "map<string,double>"),
    ("struct<a:int,b:string>", "struct<B:string,a:bigint,c:date>", "struct<a:bigint,b:string,c:date>")])
def test_least_types(a, b, out):
    x, y = (T._parse_datatype_string(t) if t != "void" else T.NullType() for t in (a, b))
    assert U.wider(x, y).simpleString() == out
    back = U.wider(y, x).simpleString()
    assert back == out or out.startswith("struct")
    with pytest.raises(ValueError):
        U.wider(T._parse_datatype_string("array<int>"), T.IntegerType())


def test_unified_reads(spark, tmp_path):
    a, b, c = f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c"
    # widened by the reader: one ordinary scan with pushdown
    for i, row in enumerate(["1 AS n, 1.5F AS f, 'x' AS s", "5000000000 AS n, 2.5D AS f, 'y' AS s, DATE'2020-01-01' AS d", "CAST(3 AS SMALLINT) AS n"]):
        spark.sql(f"SELECT {row}").write.mode("append").parquet(a)
    got = U.read_unified(spark, a)
    assert got.dtypes[0] == ("n", "bigint") and dict(got.dtypes)["f"] == "double" and "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.n, r.f, r.s) for r in got.collect() if r.s) == [(1, 1.5, "x"), (5000000000, 2.5, "y")] and got.count() == 3
    # not widened by it: numbers among texts, longs among doubles, a nested type that grows, an INT96
    for i, row in enumerate(["1 AS n, 7L AS f, named_struct('p', 1) AS t, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS z, map('k', 1) AS m",
                             "'one' AS n, 0.5D AS f, named_struct('p', 5000000000L, 'q', 'w') AS t, DATE'2021-01-01' AS z, map('k', 2L) AS m", "2.5D AS N"]):
        spark.sql(f"SELECT {row}").write.mode("append").parquet(b)
    got = U.read_unified(spark, b)
    assert {c: t for c, t in got.dtypes if c.lower() != "n"} == {
        "f": "double", "t": "struct<p:bigint,q:string>", "z": "timestamp_ntz", "m": "map<string,bigint>"}
    assert {str(r[0]) for r in got.collect()} == {"1", "one", "2.5"}
    rows = {r[0]: r.asDict() for r in got.collect()}
    assert rows["1"]["f"] == 7.0 and rows["1"]["t"].p == 1 and rows["one"]["t"].q == "w" and str(rows["one"]["z"]) == "2021-01-01 00:00:00"
    assert rows["1"]["m"] == {"k": 1} and rows["2.5"]["t"] is None
    # whole files, unsigned and dictionary types of another writer
    os.makedirs(c)
    pq.write_table(pa.table({"u": pa.array([1, 2], pa.uint32()), "g": pa.array(["a", "b"]).dictionary_encode()}), f"{c}/1.parquet", row_group_size=1)
    pq.write_table(pa.table({"u": pa.array(["x"] * 3), "g": pa.array([1.5, 2.5, None])}), f"{c}/2.parquet")
    got = sorted((str(r.u), str(r.g)) for r in U.read_unified(spark, c).collect())
    assert got == sorted([("1", "a"), ("2", "b"), ("x", "1.5"), ("x", "2.5"), ("x", "None")])
    with pytest.raises(ValueError, match="column n"):
        d = f"{tmp_path}/d"
        for row in ("1 AS n", "array(1) AS n"):
            spark.sql(f"SELECT {row}").write.mode("append").parquet(d)
        U.unified_schema(spark, d)
