"""One schema for a directory whose files disagree, and a read in it.

The types of all files come from their footers.  They are folded into the least
type that holds them all: the numeric tower, dates within timestamps, text
above every other plain type, nested types part by part.

Where Spark's Parquet reader can widen every file's type by itself, the read is one
ordinary scan with pushdown.  Where it can't (text against numbers, say), row groups
are read by tasks over a DataFrame of files, each column in a lane of the type its file
has, and Spark casts the lanes; no list of files reaches the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.sources.files import live_files
from lakelens.sources.footers import file_types, read_row_groups

INTEGRAL = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]

# Decimal digits that hold every value of an integral type.
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}

NESTED = (T.StructType, T.ArrayType, T.MapType)
STAMPS = (T.TimestampType, T.TimestampNTZType)


def _decimal(t: T.DataType) -> T.DecimalType | None:
    if isinstance(t, T.DecimalType):
        return t
    return T.DecimalType(DIGITS[t.simpleString()], 0) if t in INTEGRAL else None


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds the values of both; ``ValueError`` if there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(wider(a.keyType, b.keyType), wider(a.valueType, b.valueType))
    if isinstance(a, NESTED) or isinstance(b, NESTED):
        raise ValueError(f"no type holds both {a.simpleString()} and {b.simpleString()}")
    if a in INTEGRAL and b in INTEGRAL:
        return INTEGRAL[max(INTEGRAL.index(a), INTEGRAL.index(b))]
    x, y = _decimal(a), _decimal(b)
    if x and y:
        scale = max(x.scale, y.scale)
        whole = max(x.precision - x.scale, y.precision - y.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, (T.DateType, *STAMPS)) and isinstance(b, (T.DateType, *STAMPS)):
        stamps = [t for t in (a, b) if not isinstance(t, T.DateType)]
        return stamps[0] if len(stamps) == 1 else T.TimestampType()
    return T.StringType()


def merged(a: T.StructType, b: T.StructType) -> T.StructType:
    """Fields of both, by name whatever its case, in the order of ``a`` first; all nullable."""
    fields = {f.name.lower(): T.StructField(f.name, f.dataType) for f in a.fields}
    for f in b.fields:
        old = fields.get(f.name.lower())
        fields[f.name.lower()] = T.StructField(old.name, wider(old.dataType, f.dataType)) if old else T.StructField(f.name, f.dataType)
    return T.StructType(list(fields.values()))


def _reads(stored: T.DataType, wanted: T.DataType) -> bool:
    """Spark's Parquet reader widens the stored type by itself."""
    if stored == wanted:
        return True
    if isinstance(stored, T.StructType) and isinstance(wanted, T.StructType):
        by = {f.name.lower(): f.dataType for f in wanted.fields}
        return all(_reads(f.dataType, by[f.name.lower()]) for f in stored.fields)
    if isinstance(stored, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return _reads(stored.elementType, wanted.elementType)
    if isinstance(stored, T.MapType) and isinstance(wanted, T.MapType):
        return _reads(stored.keyType, wanted.keyType) and _reads(stored.valueType, wanted.valueType)
    if stored in INTEGRAL[:3] and (wanted in INTEGRAL[2:] or isinstance(wanted, T.DoubleType)):
        return True
    return isinstance(stored, T.FloatType) and isinstance(wanted, T.DoubleType) or (
        isinstance(stored, T.DateType) and isinstance(wanted, T.TimestampNTZType))


def column_types(spark: SparkSession, path: str) -> list[tuple[str, T.DataType]]:
    """The distinct (column, type) pairs over all files, by their first place: as many rows
    as columns have types, whatever the number of files."""
    rows = (file_types(spark, path).groupBy("column_name", "spark_type").agg(F.min("ordinal").alias("at"))
            .orderBy("at", "column_name", "spark_type").collect())
    return [(r.column_name, T._parse_datatype_json_string(r.spark_type)) for r in rows]


def unified_schema(spark: SparkSession, path: str) -> T.StructType:
    """The least schema that holds every file of the directory."""
    return _folded(column_types(spark, path), path)


def _folded(pairs: Sequence[tuple[str, T.DataType]], path: str) -> T.StructType:
    schema = T.StructType([])
    for name, kind in pairs:
        try:
            schema = merged(schema, T.StructType([T.StructField(name, kind)]))
        except ValueError as e:
            raise ValueError(f"{path}, column {name}: {e}") from None
    return schema


def _fitted(c: Column, stored: T.DataType, wanted: T.DataType) -> Column:
    """A value cast to a wider type, nested types part by part (fields that it lacks are NULL)."""
    if stored == wanted or not isinstance(stored, NESTED):
        return c.cast(wanted)
    if isinstance(stored, T.ArrayType):
        return F.transform(c, lambda x: _fitted(x, stored.elementType, wanted.elementType))
    if isinstance(stored, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(
            _fitted(e["key"], stored.keyType, wanted.keyType), _fitted(e["value"], stored.valueType, wanted.valueType))))
    have = {f.name.lower(): f for f in stored.fields}

    def part(f: T.StructField) -> Column:
        old = have.get(f.name.lower())
        return (_fitted(c.getField(old.name), old.dataType, f.dataType) if old else F.lit(None).cast(f.dataType)).alias(f.name)

    return F.when(c.isNotNull(), F.struct(*[part(f) for f in wanted.fields]))


def read_unified(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all files, in the directory's least schema; columns that a file lacks are NULL.

    Casts are Spark's: a number becomes the text that ``CAST`` gives.  Integers
    among doubles become doubles.  Files of a Delta table that its newest snapshot
    doesn't hold are not looked at where row groups are read one by one.
    """
    pairs = column_types(spark, path)
    schema = _folded(pairs, path)
    wanted = {f.name.lower(): f.dataType for f in schema.fields}
    if all(_reads(kind, wanted[name.lower()]) for name, kind in pairs):
        return spark.read.schema(schema).parquet(path)
    lanes = [(name.lower(), kind) for name, kind in dict.fromkeys((n.lower(), k.json()) for n, k in pairs)]
    stored = T.StructType([T.StructField(f"l{i}", T._parse_datatype_json_value(json.loads(kind))) for i, (_, kind) in enumerate(lanes)])
    rows = read_row_groups(spark, live_files(spark, path), lanes, stored)

    def value(f: T.StructField) -> Column:
        found = [_fitted(F.col(f"l{i}"), stored[i].dataType, f.dataType) for i, (name, _) in enumerate(lanes) if name == f.name.lower()]
        return (F.coalesce(*found) if len(found) > 1 else found[0]).alias(f.name)

    return rows.select(*[value(f) for f in schema.fields])
