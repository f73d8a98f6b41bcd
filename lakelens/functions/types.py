"""Type normalization: the canonical class of a Spark type (T8) and the
substring-rule compatibility modes of the seven source dialects (T1-T7).

The dialect modes run as one projection over a DataFrame of raw type
strings, so a catalog with millions of columns normalizes as a narrow job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The eleven normalized type classes.
# ---------------------------------------------------------------------------
TYPE_CLASSES = (
    "string", "integer", "float", "boolean", "timestamp", "date",
    "binary", "struct", "array", "map", "unknown",
)

# ---------------------------------------------------------------------------
# Ordered substring rules per dialect.  The first rule whose
# substrings hit the case-folded raw type wins; no hit gives "unknown".
# The order of the rules is the semantics (e.g. INTERVAL -> integer).
# ---------------------------------------------------------------------------
DIALECT_RULES: dict[str, list[tuple[tuple[str, ...], str]]] = {
    # T1 generic SQL (SQLAlchemy type names)
    "generic_sql": [
        (("int",), "integer"),
        (("char", "text"), "string"),
        (("float", "numeric"), "float"),
        (("bool",), "boolean"),
        (("date", "time"), "timestamp"),
    ],
    # T2 embedded analytic database (PRAGMA table_info type names)
    "embedded": [
        (("int",), "integer"),
        (("varchar", "string", "text"), "string"),
        (("float", "double", "decimal"), "float"),
        (("bool",), "boolean"),
        (("timestamp", "date"), "timestamp"),
    ],
    # T3 cloud warehouse (DESCRIBE TABLE type names)
    "warehouse": [
        (("int", "number"), "integer"),
        (("varchar", "text", "string"), "string"),
        (("float", "double"), "float"),
        (("boolean",), "boolean"),
        (("date", "time"), "timestamp"),
    ],
    # T4 lakehouse SQL endpoint (DESCRIBE type names)
    "lakehouse_sql": [
        (("int", "bigint"), "integer"),
        (("string",), "string"),
        (("double", "float"), "float"),
        (("timestamp",), "timestamp"),
        (("boolean",), "boolean"),
    ],
    # T5 lakehouse catalog (type_text of catalog columns)
    "lakehouse_catalog": [
        (("int", "long"), "integer"),
        (("string",), "string"),
        (("double", "float"), "float"),
        (("timestamp",), "timestamp"),
        (("boolean",), "boolean"),
    ],
    # T6 Arrow schema of Parquet files
    "arrow_parquet": [
        (("int",), "integer"),
        (("string", "utf8"), "string"),
        (("float",), "float"),
    ],
    # T7 Arrow schema of a Delta table
    "arrow_delta": [
        (("int",), "integer"),
        (("string",), "string"),
        (("float",), "float"),
    ],
}

DIALECTS = tuple(DIALECT_RULES)


def canonical_class(dt: T.DataType) -> str:
    """The normalized class of a Spark data type, from the type tree."""
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, T.BinaryType):
        return "binary"
    if isinstance(dt, T.StructType):
        return "struct"
    if isinstance(dt, T.ArrayType):
        return "array"
    if isinstance(dt, T.MapType):
        return "map"
    return "unknown"


def dialect_rule_expr(raw: Column, dialect: str) -> Column:
    """The ordered `when` chain of one dialect over a raw type column."""
    if dialect not in DIALECT_RULES:
        raise ValueError(f"unknown dialect {dialect!r}; expected one of {DIALECTS}")
    folded = F.lower(raw)
    expr = None
    for needles, cls in DIALECT_RULES[dialect]:
        hit = None
        for n in needles:
            cond = folded.contains(n)
            hit = cond if hit is None else (hit | cond)
        expr = F.when(hit, F.lit(cls)) if expr is None else expr.when(hit, F.lit(cls))
    return expr.otherwise(F.lit("unknown"))


def normalize_types(
    df: DataFrame,
    raw_col: str = "raw_type",
    dialect: str | None = None,
    dialect_col: str = "dialect",
    out_col: str = "normalized",
) -> DataFrame:
    """Add the normalized class of ``raw_col``.

    With ``dialect`` given, every row uses that dialect's rules; otherwise the
    dialect is read per row from ``dialect_col``.  Unknown dialect names in
    the data give "unknown".
    """
    raw = F.col(raw_col)
    if dialect is not None:
        return df.withColumn(out_col, dialect_rule_expr(raw, dialect))
    d = F.col(dialect_col)
    expr = None
    for name in DIALECTS:
        branch = dialect_rule_expr(raw, name)
        expr = F.when(d == name, branch) if expr is None else expr.when(d == name, branch)
    return df.withColumn(out_col, expr.otherwise(F.lit("unknown")))


# Spelling of a Spark type in the other type systems we meet; used to build
# the per-dialect corpus of a table's schema.  Derived by rule from the type.
def embedded_type_name(dt: T.DataType) -> str:
    """How the embedded analytic database prints a Spark type."""
    simple = {
        T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER",
        T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE",
        T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.BinaryType: "BLOB",
        T.DateType: "DATE", T.TimestampType: "TIMESTAMP WITH TIME ZONE",
        T.TimestampNTZType: "TIMESTAMP",
    }
    for cls, name in simple.items():
        if isinstance(dt, cls):
            return name
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return embedded_type_name(dt.elementType) + "[]"
    if isinstance(dt, T.MapType):
        return f"MAP({embedded_type_name(dt.keyType)}, {embedded_type_name(dt.valueType)})"
    if isinstance(dt, T.StructType):
        inner = ", ".join(f"{f.name} {embedded_type_name(f.dataType)}" for f in dt.fields)
        return f"STRUCT({inner})"
    return dt.simpleString().upper()


def arrow_type_name(dt: T.DataType) -> str:
    """How Arrow prints the type Spark writes to Parquet for a Spark type."""
    simple = {
        T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32",
        T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double",
        T.StringType: "string", T.BooleanType: "bool", T.BinaryType: "binary",
        T.DateType: "date32[day]", T.TimestampType: "timestamp[us, tz=UTC]",
        T.TimestampNTZType: "timestamp[us]",
    }
    for cls, name in simple.items():
        if isinstance(dt, cls):
            return name
    if isinstance(dt, T.DecimalType):
        return f"decimal128({dt.precision}, {dt.scale})"
    if isinstance(dt, T.ArrayType):
        return f"list<element: {arrow_type_name(dt.elementType)}>"
    if isinstance(dt, T.MapType):
        return f"map<{arrow_type_name(dt.keyType)}, {arrow_type_name(dt.valueType)}>"
    if isinstance(dt, T.StructType):
        inner = ", ".join(f"{f.name}: {arrow_type_name(f.dataType)}" for f in dt.fields)
        return f"struct<{inner}>"
    return dt.simpleString()


def spelling_for(dialect: str, dt: T.DataType) -> str:
    """How a Spark type reads in the type system a dialect's rules expect:
    Arrow names for the Arrow dialects, Spark names for the lakehouse ones,
    SQL-standard names (as the embedded database prints them) otherwise."""
    if dialect not in DIALECT_RULES:
        raise ValueError(f"unknown dialect {dialect!r}; expected one of {DIALECTS}")
    if dialect.startswith("arrow"):
        return arrow_type_name(dt)
    if dialect.startswith("lakehouse"):
        return dt.simpleString()
    return embedded_type_name(dt)
