"""Statistics ladder (G8, G9): catalog statistics first, then footers,
then a scan; NULL (not 0) when nothing is known."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.sources.files import live_files, only_files


def analyze(spark: SparkSession, table_id: str, columns: bool = True) -> None:
    """Compute catalog statistics (one Spark job over the table)."""
    spark.sql(f"ANALYZE TABLE {table_id} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))


def catalog_table_stats(spark: SparkSession, table_id: str) -> DataFrame:
    """``DESCRIBE TABLE EXTENDED`` statistics as (size_bytes, row_count),
    NULLs when the catalog holds none."""
    d = spark.sql(f"DESCRIBE TABLE EXTENDED {table_id}").where(F.col("col_name") == "Statistics")
    return d.select(
        F.regexp_extract("data_type", r"(\d+) bytes", 1).cast("long").alias("size_bytes"),
        F.nullif(F.regexp_extract("data_type", r"(\d+) rows", 1), F.lit("")).cast("long").alias("row_count"))


def catalog_column_stats(spark: SparkSession, table_id: str, column: str) -> DataFrame:
    """``DESCRIBE TABLE EXTENDED t col`` as one row of named statistics
    (min, max, num_nulls, distinct_count, avg_col_len, max_col_len); min and
    max are NULL for strings, as the catalog does not keep them."""
    d = spark.sql(f"DESCRIBE TABLE EXTENDED {table_id} {column}")
    m = d.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("info_name", "info_value"))).alias("m"))

    def get(k: str):
        v = F.col("m")[k]
        return F.when(v == "NULL", None).otherwise(v)

    return m.select(
        F.lit(column).alias("column_name"),
        get("min").alias("min_value"), get("max").alias("max_value"),
        get("num_nulls").cast("long").alias("null_count"),
        get("distinct_count").cast("long").alias("distinct_count"),
        get("avg_col_len").cast("double").alias("avg_len"),
        get("max_col_len").cast("long").alias("max_len"))


def row_count_ladder(spark: SparkSession, table_id: str | None = None, path: str | None = None) -> DataFrame:
    """(row_count, source) from the first rung that knows: the catalog's
    ``numRows``, else Parquet footers of ``path`` (or the table's location;
    of a Delta table the files of its newest snapshot), else a COUNT(*) scan.
    A path that doesn't exist is an error."""
    if table_id is not None:
        row = catalog_table_stats(spark, table_id).first()
        if row is not None and row.row_count is not None:
            return spark.range(1).select(F.lit(row.row_count).cast("long").alias("row_count"),
                                         F.lit("catalog").alias("source"))
        if path is None:
            loc = (spark.sql(f"DESCRIBE TABLE EXTENDED {table_id}")
                   .where(F.col("col_name") == "Location").select("data_type").first())
            prov = (spark.sql(f"DESCRIBE TABLE EXTENDED {table_id}")
                    .where(F.col("col_name") == "Provider").select("data_type").first())
            if loc is not None and prov is not None and prov.data_type.lower() == "parquet":
                path = loc.data_type
    if path is not None:
        from lakelens.operators.footer_stats import footer_row_count
        try:
            n = footer_row_count(spark, path).first().row_count  # read now, so that a failure is met here
            return spark.range(1).select(F.lit(n).cast("long").alias("row_count"), F.lit("footer").alias("source"))
        except PySparkException:  # unreadable footers: the scan answers or says why
            pass
    if table_id is None and path is None:
        raise ValueError("row_count_ladder needs a table id or a path")
    if table_id is not None:
        rows = spark.table(table_id)
    else:
        rows = only_files(spark.read.option("recursiveFileLookup", "true").parquet(path), live_files(spark, path))
    return rows.agg(F.count(F.lit(1)).cast("long").alias("row_count")).select("row_count", F.lit("scan").alias("source"))


def catalog_stats_like(spark: SparkSession, database: str, pattern: str) -> DataFrame:
    """(table_name, size_bytes, row_count) for catalog tables whose name
    matches a SQL LIKE pattern, from one statement; tables without statistics
    give NULLs, views have none, and an empty match gives no rows (not a fake 0)."""
    shown = spark.sql(f"SHOW TABLE EXTENDED IN {database} LIKE '*'")
    stats = F.regexp_extract("information", r"(?m)^Statistics: (.*)$", 1)
    number = lambda unit: F.nullif(F.regexp_extract(stats, rf"(\d+) {unit}", 1), F.lit("")).cast("long")
    return shown.where(~F.col("isTemporary") & F.col("tableName").like(pattern)).select(
        F.col("tableName").alias("table_name"), number("bytes").alias("size_bytes"), number("rows").alias("row_count"))
