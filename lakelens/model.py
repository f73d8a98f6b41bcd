"""Fixed output schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Profile output (one row per column).  Min/max live in typed lanes so that
# integers keep full precision, strings keep byte order and timestamps keep
# their type; ``min_value``/``max_value`` text is derived only for display.
PROFILE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("original_type", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("distinct_count", T.LongType()),
    T.StructField("distinct_is_approx", T.BooleanType()),
    T.StructField("min_int", T.LongType()),
    T.StructField("max_int", T.LongType()),
    T.StructField("min_num", T.DoubleType()),
    T.StructField("max_num", T.DoubleType()),
    T.StructField("min_str", T.StringType()),
    T.StructField("max_str", T.StringType()),
    T.StructField("min_ts", T.TimestampNTZType()),
    T.StructField("max_ts", T.TimestampNTZType()),
    T.StructField("avg_len", T.DoubleType()),
    T.StructField("max_len", T.LongType()),
])

PROFILE_COLUMNS = [f.name for f in PROFILE_SCHEMA.fields]

LANES = ("int", "num", "str", "ts")
LANE_TYPES = {
    "int": T.LongType(),
    "num": T.DoubleType(),
    "str": T.StringType(),
    "ts": T.TimestampNTZType(),
}
