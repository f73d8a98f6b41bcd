"""Discovery and file inventory (B1-B6), partitions (P1-P3), table size and
freshness (G6, G7).

Everything starts from a listing DataFrame (path, modificationTime,
length); grouping by directory replaces the reference's per-directory
listing loops, so millions of files cost one distributed aggregate.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions.literals import literal_rows
from lakelens.functions.paths import dir_segments, unescape_partition_value
from lakelens.sources.files import live_files
from lakelens.sources.footers import file_rows
from lakelens.sources.listing import list_files, qualify, relative_path

# --- catalog discovery (B1, B2) ---------------------------------------------


def list_databases(spark: SparkSession) -> DataFrame:
    """B1 for catalogs: database names, sorted."""
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("name")).orderBy("name")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """B2: (name, type) with VIEW/TEMPORARY as 'view' and MANAGED/EXTERNAL
    as 'table', one list sorted by name (case-sensitive)."""
    tables = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    rows = [(t.name, "view" if t.tableType in ("VIEW", "TEMPORARY") else
             "table" if t.tableType in ("MANAGED", "EXTERNAL") else "unknown") for t in tables]
    return literal_rows(spark, rows, [("name", "STRING"), ("type", "STRING")]).orderBy("name")


# --- lake listings (B1-B6 for file systems) -----------------------------------


def lake_files(spark: SparkSession, base: str, include_delta_logs: bool = True) -> DataFrame:
    """Listing of a lake root with (database, table, rel_path) columns.

    Layout: ``base/<database>/<table>/...``.  Delta logs, hidden from other
    listings, are part of the same walk.
    """
    root = qualify(spark, base)
    files = list_files(spark, base, shown=("_delta_log",) if include_delta_logs else ())
    rel = relative_path("path", root)
    seg = F.split(rel, "/")
    return files.select(
        "path", "length", "modificationTime", rel.alias("rel_path"),
        seg.getItem(0).alias("database"),
        F.when(F.size(seg) > 2, seg.getItem(1)).alias("table_name"),
    )


def list_lake_databases(spark: SparkSession, base: str) -> DataFrame:
    """B1 for file systems: top-level directories that hold files."""
    return (lake_files(spark, base, include_delta_logs=False)
            .where(F.col("rel_path").contains("/"))
            .select(F.col("database").alias("name")).distinct().orderBy("name"))


def list_table_dirs(spark: SparkSession, base: str) -> list[str]:
    """Child directories of ``base`` that hold data files (names only; the
    number of children of one directory, metadata)."""
    root = qualify(spark, base)
    rel = relative_path("path", root)
    d = (list_files(spark, base).select(F.split(rel, "/").alias("s"))
         .where(F.size("s") > 1).select(F.col("s").getItem(0).alias("name")).distinct())
    return sorted(r.name for r in d.collect())


# How a table directory's format is decided; the Delta test
# comes first because Delta tables also hold Parquet files.
def _format_expr() -> F.Column:
    return (F.when(F.max(F.col("rel_path").contains("/_delta_log/").cast("int")) == 1, F.lit("delta"))
             .when(F.max(F.col("rel_path").endswith(".parquet").cast("int")) == 1, F.lit("parquet"))
             .otherwise(F.lit("unknown")))


def _listed_tables(files: DataFrame) -> DataFrame:
    data = ~F.col("rel_path").contains("/_delta_log/")
    return files.groupBy("database", "table_name").agg(
        _format_expr().alias("format"),
        F.count(F.when(data, F.lit(1))).cast("long").alias("file_count"),
        F.coalesce(F.sum(F.when(data, F.col("length"))), F.lit(0)).cast("long").alias("size_bytes"),
        F.max("modificationTime").alias("last_modified"),
    )


def lake_inventory(spark: SparkSession, base: str, live: bool = True) -> DataFrame:
    """B6 (with B5, G6, G7): one row per (database, table): format,
    data file count, size in bytes and last modification.  Of Delta tables the
    files of their newest snapshot count, as in ``table_size``, whose names (bounded by the
    number of tables) come to the driver; with ``live`` off, all files that are there.  A
    log that can't be replayed is warned about, and its table's files are counted as listed."""
    files = lake_files(spark, base).where(F.col("table_name").isNotNull())
    listed = _listed_tables(files)
    if not live:
        return listed
    root = qualify(spark, base)
    logs = files.where(F.col("rel_path").contains("/_delta_log/")).select("database", "table_name").distinct()
    sizes = None
    for r in logs.orderBy("database", "table_name").collect():
        try:
            held = live_files(spark, f"{root}/{r.database}/{r.table_name}")
        except (ValueError, PySparkException) as e:
            warnings.warn(f"{r.database}.{r.table_name}: {e}", stacklevel=2)
            continue
        one = held.agg(F.count(F.lit(1)).cast("long").alias("live_count"),
                       F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("live_bytes")).select(
            F.lit(r.database).alias("database"), F.lit(r.table_name).alias("table_name"), "live_count", "live_bytes")
        sizes = one if sizes is None else sizes.unionByName(one)
    if sizes is None:
        return listed
    # stacked, not joined: names that are literals would leave a join without keys
    both = listed.unionByName(sizes, allowMissingColumns=True)
    return both.groupBy("database", "table_name").agg(
        F.max("format").alias("format"), F.coalesce(F.max("live_count"), F.max("file_count")).alias("file_count"),
        F.coalesce(F.max("live_bytes"), F.max("size_bytes")).alias("size_bytes"), F.max("last_modified").alias("last_modified"))


def table_formats(spark: SparkSession, base: str) -> DataFrame:
    """(database, table_name, format)."""
    return lake_inventory(spark, base, live=False).select("database", "table_name", "format")


def table_size(spark: SparkSession, table_path: str) -> DataFrame:
    """G6 and G7 for one table directory: bytes, files, last modification; of a
    Delta table only the files that its newest snapshot holds."""
    return live_files(spark, table_path).agg(
        F.count(F.lit(1)).cast("long").alias("file_count"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_size_bytes"),
        F.max("modificationTime").alias("last_modified"))


# --- partitions (P1-P3) -----------------------------------------------------------


def _partition_levels(files: DataFrame, root: str, more: Sequence[str] = ()) -> DataFrame:
    """One row per (file, partition level): column_name, value, depth, location
    (and the columns ``more`` of the file)."""
    rel = relative_path("path", root)
    segs = dir_segments(rel)
    exploded = files.select("path", "length", *more, segs.alias("segs")).select(
        "path", "length", *more, "segs", F.posexplode("segs").alias("pos", "seg"))
    return exploded.where(F.col("seg").contains("=")).select(
        "path", "length", *more,
        F.substring_index("seg", "=", 1).alias("column_name"),
        unescape_partition_value(F.expr("substring(seg, instr(seg, '=') + 1)")).alias("value"),
        (F.col("pos") + 1).cast("int").alias("depth"),
        F.array_join(F.slice("segs", 1, F.col("pos") + 1), "/").alias("location"),
    )


def partition_inventory(spark: SparkSession, table_path: str) -> DataFrame:
    """(column_name, value, depth, location, file_count, size_bytes), one
    row per directory level of a Hive-style layout; values URL-decoded,
    the Hive NULL marker read as NULL."""
    root = qualify(spark, table_path)
    lv = _partition_levels(live_files(spark, table_path).select("path", "length"), root)
    return lv.groupBy("column_name", "value", "depth", "location").agg(
        F.count(F.lit(1)).cast("long").alias("file_count"),
        F.sum("length").cast("long").alias("size_bytes"))


def partition_row_counts(spark: SparkSession, table_path: str) -> DataFrame:
    """Rows per partition directory from footers only (no data read, one
    listing): each file's row count goes to its partition levels."""
    root = qualify(spark, table_path)
    lv = _partition_levels(file_rows(spark, live_files(spark, table_path).select("path", "length")), root, ["num_rows"])
    return lv.groupBy("column_name", "value", "depth", "location").agg(
        F.count(F.lit(1)).cast("long").alias("file_count"),
        F.sum("length").cast("long").alias("size_bytes"),
        F.sum("num_rows").cast("long").alias("row_count"))


def catalog_partition_row_counts(spark: SparkSession, table_id: str) -> DataFrame:
    """P3 for a catalog table: its location from ``DESCRIBE TABLE EXTENDED``,
    then row counts per partition directory from the footers there."""
    loc = (spark.sql(f"DESCRIBE TABLE EXTENDED {table_id}")
           .where(F.col("col_name") == "Location").select("data_type").first())
    if loc is None:
        raise ValueError(f"{table_id} has no location (not a file-based table)")
    return partition_row_counts(spark, loc.data_type)


def catalog_partitions(spark: SparkSession, table_id: str) -> DataFrame:
    """``SHOW PARTITIONS`` of a catalog table parsed like P1."""
    parts = spark.sql(f"SHOW PARTITIONS {table_id}")
    segs = F.split(F.col("partition"), "/")
    ex = parts.select(segs.alias("segs"), F.posexplode(segs).alias("pos", "seg"))
    return ex.select(
        F.substring_index("seg", "=", 1).alias("column_name"),
        unescape_partition_value(F.expr("substring(seg, instr(seg, '=') + 1)")).alias("value"),
        (F.col("pos") + 1).cast("int").alias("depth"),
        F.array_join(F.slice("segs", 1, F.col("pos") + 1), "/").alias("location"),
    ).distinct()


def _skipped(database: str, error: Exception) -> None:
    warnings.warn(f"database {database} was skipped: {str(error).splitlines()[0]}", stacklevel=3)


def list_all_tables(spark: SparkSession, databases: list[str] | None = None,
                    catalog: str | None = None) -> DataFrame:
    """Names only, flattened to ``database.table`` over the given (or
    all) databases of the session catalog, or of ``catalog`` when given;
    databases that fail to list are skipped with a warning that names them."""
    if catalog is not None:
        if databases is None:
            databases = [r[0] for r in spark.sql(f"SHOW NAMESPACES IN {catalog}").collect()]
        out = spark.createDataFrame([], "name string, type string")
        for db in databases:
            try:
                t = spark.sql(f"SHOW TABLES IN {catalog}.{db}").where(~F.col("isTemporary"))
            except PySparkException as e:
                _skipped(f"{catalog}.{db}", e)
                continue
            out = out.unionByName(t.select(F.concat_ws(".", F.lit(db), F.col("tableName")).alias("name"),
                                           F.lit("unknown").alias("type")))
        return out.orderBy("name")
    if databases is None:
        databases = [d.name for d in spark.catalog.listDatabases()]
    rows = []
    for db in databases:
        try:
            rows.extend((f"{db}.{t.name}", "unknown") for t in spark.catalog.listTables(db)
                        if not t.isTemporary)
        except PySparkException as e:
            _skipped(db, e)
    return spark.createDataFrame(rows, "name string, type string").orderBy("name")


def list_directories(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Directories below ``path`` that contain files: the direct
    children (default) or every level (``recursive``)."""
    root = qualify(spark, path)
    segs = dir_segments(relative_path("path", root))
    files = list_files(spark, path).select(segs.alias("segs")).where(F.size("segs") > 0)
    if not recursive:
        return files.select(F.col("segs")[0].alias("name")).distinct().orderBy("name")
    ex = files.select(F.posexplode("segs").alias("pos", "seg"), "segs")
    return (ex.select(F.array_join(F.slice("segs", 1, F.col("pos") + 1), "/").alias("name"))
              .distinct().orderBy("name"))
