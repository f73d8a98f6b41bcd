"""Table statistics without reading data pages (F2-F4) and schema drift
over all files (S4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.decimals import decimal_bound
from lakelens.operators.profile import col
from lakelens.sources.footers import file_rows, file_schemas, footer_chunks


def _covered() -> F.Column:
    """A chunk's bounds are complete if it has min/max or holds only NULLs."""
    return F.col("has_min_max") | (F.col("null_count") == F.col("num_values"))


def merge_chunks(chunks: DataFrame, by: Sequence[str] = ("column_path",), table: Sequence[str] = ()) -> DataFrame:
    """per column, min of mins, max of maxes, nulls summed, over the table's rows.

    ``row_count`` is the table's (``table``: the columns of ``by`` that name it); rows of
    files that lack a column are NULLs of it.  A NULL null_count (a chunk without
    statistics) makes the sum NULL; a chunk without bounds makes the bounds
    NULL; a NaN bound nulls the numeric bounds and sets ``has_nan_bound``.
    Decimal bounds are compared as numbers.
    """
    all_covered = F.min(F.when(_covered(), 1).otherwise(0)) == 1
    nan = F.max(F.col("nan_bound").cast("int")) == 1
    dec = F.max(F.col("logical_type").startswith("Decimal").cast("int")) == 1
    aggs = [
        F.sum("num_rows").cast("long").alias("__covered"),
        F.sum(F.when(F.col("column_index") == 0, F.col("num_rows"))).cast("long").alias("__counted"),
        F.when(F.count("null_count") == F.count(F.lit(1)), F.sum("null_count")).cast("long").alias("null_count"),
        F.count(F.lit(1)).cast("long").alias("chunk_count"),
        nan.alias("has_nan_bound"),
    ]
    for b, fn in (("min", F.min), ("max", F.max)):
        for ln in ("int", "ts"):
            aggs.append(F.when(all_covered, fn(f"{b}_{ln}")).alias(f"{b}_{ln}"))
        text = F.when(dec, decimal_bound(b, f"CASE WHEN logical_type LIKE 'Decimal%' THEN {b}_str END")).otherwise(fn(f"{b}_str"))
        aggs.append(F.when(all_covered, text).alias(f"{b}_str"))
        aggs.append(F.when(all_covered & ~nan, fn(f"{b}_num")).alias(f"{b}_num"))
    aggs.append(F.sum("compressed_size").cast("long").alias("compressed_size"))
    merged = chunks.groupBy(*by).agg(*aggs)
    # every row group has one first column: their rows are the table's (a row per column here)
    rows = F.sum("__counted").over(Window.partitionBy(*table)).cast("long")
    kept = [c for c in merged.columns if c not in (*by, "__covered", "__counted", "null_count")]
    return merged.withColumn("row_count", rows).select(
        *by, "row_count", (F.col("null_count") + F.col("row_count") - F.col("__covered")).alias("null_count"), *kept)


def footer_table_stats(spark: SparkSession, path: str) -> DataFrame:
    """F2 for a Parquet table directory: one row per leaf column."""
    return merge_chunks(footer_chunks(spark, path)).withColumnRenamed("column_path", "column_name")


def footer_row_count(spark: SparkSession, path: str) -> DataFrame:
    """Table row count from footers."""
    return file_rows(spark, path).agg(F.coalesce(F.sum("num_rows"), F.lit(0)).cast("long").alias("row_count"),
                                      F.count(F.lit(1)).cast("long").alias("file_count"))


def footer_column_stats(spark: SparkSession, path: str, column: str) -> DataFrame:
    """one column of F2; an unknown column is an error (not NULL)."""
    names = {f.name for f in spark.read.parquet(path).schema.fields}
    if column.split(".")[0] not in names:
        raise ValueError(f"unknown column {column!r}")
    return footer_table_stats(spark, path).where(F.col("column_name") == column)


# Where Parquet stops being the V1 source, so that the V2
# reader (which can answer MIN/MAX/COUNT from footers) is used.
V1_SOURCES_WITHOUT_PARQUET = "avro,csv,json,kafka,orc,text"


def _zero_norm(c: F.Column) -> F.Column:
    """-0.0 reads as 0.0 (see ``profile.zero_norm_sql``)."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))


def pushdown_aggregate(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """MIN/MAX/COUNT answered from footers by Spark's V2 Parquet reader.

    Runs in a child session (shared SparkContext, own SQL conf) so the
    caller's session is untouched.  Pushdown covers numeric columns only;
    one string or timestamp column would disable it for the whole query.
    """
    s2 = spark.newSession()
    s2.conf.set("spark.sql.sources.useV1SourceList", V1_SOURCES_WITHOUT_PARQUET)
    s2.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = s2.read.parquet(path)
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    types = {f.name: f.dataType for f in df.schema.fields}
    bad = [c for c in columns if not isinstance(types.get(c), numeric)]
    if bad:
        raise ValueError(f"aggregate pushdown needs numeric columns, got {bad}")
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        aggs += [F.min(col(c)).alias(f"mn{i}"), F.max(col(c)).alias(f"mx{i}")]
    wide = df.agg(*aggs)
    structs = []
    for i, c in enumerate(columns):
        is_int = isinstance(types[c], (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.col("__rows").cast("long").alias("row_count"),
            (F.col(f"mn{i}").cast("long") if is_int else F.lit(None).cast("long")).alias("min_int"),
            (F.col(f"mx{i}").cast("long") if is_int else F.lit(None).cast("long")).alias("max_int"),
            (F.lit(None).cast("double") if is_int else _zero_norm(F.col(f"mn{i}"))).alias("min_num"),
            (F.lit(None).cast("double") if is_int else _zero_norm(F.col(f"mx{i}"))).alias("max_num"),
        ))
    return wide.select(F.inline(F.array(*structs)))


def schema_drift(spark: SparkSession, path: str, by_type: bool = True) -> DataFrame:
    """Per column, the Arrow types met across ALL files.

    With ``by_type`` one row per (column, type): files and rows carrying it;
    ``conflict`` marks columns with more than one type and ``in_all_files``
    columns present in every file.  Otherwise one row per column.
    """
    per_type = file_schemas(spark, path).groupBy("column_name", "arrow_type").agg(
        F.count(F.lit(1)).cast("long").alias("file_count"),
        F.sum("num_rows").cast("long").alias("row_count"),
        F.count_if(F.col("ordinal") == 1).alias("__first"))
    # over one row per (column, type): every file has one first column
    whole, column = Window.partitionBy(), Window.partitionBy("column_name")
    total = F.sum("__first").over(whole)
    rows = per_type.select(
        "column_name", "arrow_type", "file_count", "row_count",
        F.sort_array(F.collect_set("arrow_type").over(column)).alias("types"),
        F.sum("file_count").over(column).cast("long").alias("files_with_column"),
        F.sum("row_count").over(column).cast("long").alias("rows_with_column"),
        total.alias("__files"))
    rows = rows.select("*", (F.size("types") > 1).alias("conflict"),
                       (F.col("files_with_column") == F.col("__files")).alias("in_all_files"))
    if by_type:
        return rows.select("column_name", "arrow_type", "file_count", "row_count", "conflict", "in_all_files")
    return rows.select("column_name", "types", "files_with_column", "rows_with_column", "conflict", "in_all_files",
                       (F.col("files_with_column") / F.col("__files")).alias("presence_ratio")).distinct()
