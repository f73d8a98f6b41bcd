"""Composite metadata (X1-X4): the describe report and the nested
whole-table record with its JSON form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.types import canonical_class
from lakelens.operators.profile import profile
from lakelens.operators.schema import table_schema


def min_value_text(prefix: str) -> Column:
    """Display text of a typed-lane bound (first non-null lane)."""
    return F.coalesce(
        F.col(f"{prefix}_int").cast("string"),
        F.col(f"{prefix}_str"),
        F.col(f"{prefix}_num").cast("string"),
        F.col(f"{prefix}_ts").cast("string"),
    )


def describe_report(spark: SparkSession, df: DataFrame, table_name: str,
                    distinct: str = "approx") -> DataFrame:
    """Schema left-joined to the profile on the column ordinal (names
    may repeat); every value as text, missing values as empty strings.

    The profile side has one row per column, so the join is bounded by the
    schema width and broadcast.
    """
    s = table_schema(spark, df, table_name).select("table_name", "ordinal", "column_name",
                                                   "data_type", "original_type")
    p = profile(df, table_name, distinct=distinct).select(
        "ordinal",
        min_value_text("min").alias("min_value"),
        min_value_text("max").alias("max_value"),
        "null_count", "distinct_count", "row_count")
    j = s.join(F.broadcast(p), "ordinal", "left")  # one row per column: size known from the schema
    blank = F.lit("")
    return j.select(
        "table_name", "ordinal", "column_name",
        F.col("data_type").alias("type"),
        F.coalesce(F.col("original_type"), blank).alias("original_type"),
        F.coalesce(F.col("min_value"), blank).alias("min_value"),
        F.coalesce(F.col("max_value"), blank).alias("max_value"),
        F.coalesce(F.col("null_count").cast("string"), blank).alias("null_count"),
        F.coalesce(F.col("distinct_count").cast("string"), blank).alias("distinct_count"),
        F.coalesce(F.col("row_count").cast("string"), blank).alias("row_count"),
    ).orderBy("ordinal")  # a report in column order: one row per column


# --- X1/X2/X4: nested whole-table record and its JSON form ---------------------------

COLUMN_STAT = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("min_value", T.StringType()),
    T.StructField("max_value", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("distinct_count", T.LongType()),
    T.StructField("avg_len", T.DoubleType()),
    T.StructField("max_len", T.LongType()),
])
METADATA_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("schema_info", T.StructType([
        T.StructField("columns", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("data_type", T.StringType()),
            T.StructField("nullable", T.BooleanType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ]))),
        T.StructField("primary_keys", T.ArrayType(T.StringType())),
    ])),
    T.StructField("stats", T.StructType([
        T.StructField("row_count", T.LongType()),
        T.StructField("total_size_bytes", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("column_stats", T.MapType(T.StringType(), COLUMN_STAT)),
    ])),
    T.StructField("partitions", T.ArrayType(T.StructType([
        T.StructField("column_name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
    ]))),
])


def split_id(table_id: str) -> tuple[str, str]:
    """Database and name of a dotted id: first part / rest, else 'default'."""
    if "." in table_id:
        db, name = table_id.split(".", 1)
        return db, name
    return "default", table_id


def full_metadata(spark: SparkSession, df: DataFrame, table_id: str, path: str | None = None,
                  column_stats: bool = True, distinct: str = "approx",
                  inline_partitions: bool = True, primary_keys: Sequence[str] = ()) -> DataFrame:
    """X1 (+X2 with ``column_stats``): one nested row of METADATA_SCHEMA.

    The parts - profile rows, the size/freshness row of the listing of
    ``path`` and its partition rows - are stacked as tagged rows and folded
    by ONE aggregate keyed by the table id (conditional aggregates pick each
    part), so no join is needed.  The schema comes from the driver's schema
    object; the column-stats map has one entry per column (without
    ``column_stats`` no column is read, rows are only counted).
    ``primary_keys`` come from the caller, e.g. from ``candidate_keys``.  The inline
    partition list grows with the table's partition count; for tables with
    very many partitions pass ``inline_partitions=False`` and read
    ``partition_inventory`` (a distributed DataFrame) instead.
    """
    from lakelens.operators.inventory import partition_inventory, table_size

    db, name = split_id(table_id)
    stat_t = COLUMN_STAT
    part_t = METADATA_SCHEMA["partitions"].dataType.elementType
    unknown = [k for k in primary_keys if k not in df.columns]
    if unknown:
        raise ValueError(f"unknown column(s): {unknown}")
    stat_entry = F.struct(
        F.col("column_name"),
        min_value_text("min").alias("min_value"), min_value_text("max").alias("max_value"),
        "null_count", "distinct_count", "avg_len", "max_len").cast(stat_t)

    def tagged(frame: DataFrame, tag: str, rows=None, stat=None, size=None, mod=None, part=None) -> DataFrame:
        return frame.select(
            F.lit(tag).alias("tag"),
            (rows if rows is not None else F.lit(None).cast("long")).alias("row_count"),
            (stat if stat is not None else F.lit(None).cast(stat_t)).alias("stat"),
            (size if size is not None else F.lit(None).cast("long")).alias("size"),
            (mod if mod is not None else F.lit(None).cast("timestamp")).alias("modified"),
            (part if part is not None else F.lit(None).cast(part_t)).alias("part"))

    # one entry per name: with repeated names the last column wins, as in a
    # mapping keyed by name (map_from_entries refuses duplicate keys)
    if column_stats:
        by_name = (profile(df, table_id, distinct=distinct)
                   .select("column_name", "ordinal", "row_count", stat_entry.alias("stat")).groupBy("column_name")
                   .agg(F.max("row_count").alias("row_count"), F.max_by("stat", "ordinal").alias("stat")))
        parts = tagged(by_name, "stat", rows=F.col("row_count"), stat=F.col("stat"))
    else:
        parts = tagged(df.agg(F.count(F.lit(1)).alias("n")), "rows", rows=F.col("n"))
    if path is not None:
        sz = table_size(spark, path)
        parts = parts.unionByName(tagged(sz, "size", size=F.col("total_size_bytes"),
                                         mod=F.col("last_modified").cast("timestamp")))
    if path is not None and inline_partitions:
        pi = partition_inventory(spark, path)
        parts = parts.unionByName(tagged(pi, "partition", part=F.struct(
            "column_name", "value", "location", "file_count", "size_bytes").cast(part_t)))
    folded = parts.agg(
        F.max("row_count").alias("row_count"),
        F.map_from_entries(F.collect_list(
            F.when(F.col("tag") == "stat", F.struct(F.col("stat.column_name"), F.col("stat"))))).alias("column_stats"),
        F.max("size").alias("total_size_bytes"),
        F.max("modified").alias("last_modified"),
        F.collect_list("part").alias("partitions"))
    cols = F.array(*[F.struct(
        F.lit(f.name).alias("name"),
        F.lit(canonical_class(f.dataType)).alias("data_type"),
        F.lit(bool(f.nullable)).alias("nullable"),
        F.create_map(F.lit("original_type"), F.lit(f.dataType.simpleString())).alias("metadata"))
        for f in df.schema.fields])
    stats_map = (F.col("column_stats") if column_stats
                 else F.create_map().cast(T.MapType(T.StringType(), stat_t)))
    return folded.select(
        F.lit(table_id).alias("id"), F.lit(name).alias("name"), F.lit(db).alias("database"),
        F.struct(cols.alias("columns"),
                 F.array(*[F.lit(k) for k in primary_keys]).cast("array<string>").alias("primary_keys")).alias("schema_info"),
        F.struct("row_count", "total_size_bytes", "last_modified",
                 stats_map.alias("column_stats")).alias("stats"),
        F.col("partitions").cast(METADATA_SCHEMA["partitions"].dataType).alias("partitions"),
    )


def to_json_record(meta: DataFrame, name: str = "content") -> DataFrame:
    """The record as JSON text, keyed by id."""
    return meta.select("id", F.to_json(F.struct(*[F.col(c) for c in meta.columns])).alias(name))


def from_json_record(js: DataFrame, col_name: str = "content") -> DataFrame:
    """JSON text back to the nested record."""
    return js.select(F.from_json(col_name, METADATA_SCHEMA).alias("m")).select("m.*")
