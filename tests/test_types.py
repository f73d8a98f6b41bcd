import pytest
from pyspark.sql import types as T

from lakelens.functions.types import DIALECTS, canonical_class, normalize_types

# (dialect, raw type, expected class): the substring-order surprises.
CASES = [
    ("generic_sql", "INTERVAL", "integer"), ("generic_sql", "POINT", "integer"),
    ("generic_sql", "DOUBLE", "unknown"), ("generic_sql", "DECIMAL(10,2)", "unknown"),
    ("generic_sql", "REAL", "unknown"), ("generic_sql", "DATE", "timestamp"),
    ("generic_sql", "NUMERIC(10,2)", "float"), ("generic_sql", "VARCHAR(20)", "string"),
    ("embedded", "INTEGER[]", "integer"), ("embedded", "MAP(VARCHAR, INTEGER)", "integer"),
    ("embedded", "HUGEINT", "integer"), ("embedded", "TIME", "unknown"), ("embedded", "BLOB", "unknown"),
    ("embedded", "DOUBLE", "float"), ("embedded", "TIMESTAMP", "timestamp"),
    ("warehouse", "NUMBER(10,2)", "integer"), ("warehouse", "VARIANT", "unknown"),
    ("warehouse", "BINARY", "unknown"), ("warehouse", "TIMESTAMP_NTZ", "timestamp"),
    ("lakehouse_sql", "date", "unknown"), ("lakehouse_sql", "decimal(10,2)", "unknown"),
    ("lakehouse_sql", "binary", "unknown"), ("lakehouse_sql", "array<int>", "integer"),
    ("lakehouse_catalog", "long", "integer"), ("lakehouse_catalog", "date", "unknown"),
    ("arrow_parquet", "double", "unknown"), ("arrow_parquet", "bool", "unknown"),
    ("arrow_parquet", "timestamp[us]", "unknown"), ("arrow_parquet", "list<element: float>", "float"),
    ("arrow_parquet", "dictionary<values=string, indices=int32, ordered=0>", "integer"),
    ("arrow_delta", "large_string", "string"), ("arrow_delta", "utf8", "unknown"),
]


def test_dialect_rules(spark):
    df = spark.createDataFrame([(d, r) for d, r, _ in CASES], "dialect string, raw_type string")
    got = {(r.dialect, r.raw_type): r.normalized for r in normalize_types(df).collect()}
    for d, r, want in CASES:
        assert got[(d, r)] == want, (d, r)


def test_single_dialect_and_unknown_dialect(spark):
    df = spark.createDataFrame([("x", "INT"), ("nope", "INT")], "dialect string, raw_type string")
    assert {r.normalized for r in normalize_types(df, dialect="generic_sql").collect()} == {"integer"}
    out = {r.dialect: r.normalized for r in normalize_types(df).collect()}
    assert out == {"x": "unknown", "nope": "unknown"}
    with pytest.raises(ValueError):
        normalize_types(df, dialect="nope")
    assert len(DIALECTS) == 7


@pytest.mark.parametrize("dt,cls", [
    (T.StringType(), "string"), (T.VarcharType(3), "string"), (T.ByteType(), "integer"),
    (T.LongType(), "integer"), (T.FloatType(), "float"), (T.DecimalType(10, 2), "float"),
    (T.BooleanType(), "boolean"), (T.TimestampType(), "timestamp"), (T.TimestampNTZType(), "timestamp"),
    (T.DateType(), "date"), (T.BinaryType(), "binary"), (T.StructType([]), "struct"),
    (T.ArrayType(T.IntegerType()), "array"), (T.MapType(T.StringType(), T.IntegerType()), "map"),
    (T.DayTimeIntervalType(), "unknown"), (T.NullType(), "unknown")])
def test_canonical(dt, cls):
    assert canonical_class(dt) == cls
