"""Profiles that read only what changed.

The state of a table is a directory of partial profiles, one row for each file and
column, keyed by the file's path, size, modification time and the schema it was
read in.  A refresh lists the table, anti-joins the listing with the state, scans the
files that the state doesn't know, writes their partials as a new run and merges the
partials of the files that are there now.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators.profile import DEFAULT_LG_K, merge_partials, profile, profile_partials
from lakelens.session import path_exists, unique_suffix
from lakelens.sources.files import live_files, only_files

FILE_KEY = ["path", "length", "modified", "schema_id"]


def _listed(spark: SparkSession, table_path: str, schema_id: str) -> DataFrame:
    return live_files(spark, table_path).select(
        "path", "length", F.col("modificationTime").alias("modified"), F.lit(schema_id).alias("schema_id"))


def known_partials(spark: SparkSession, state_path: str) -> DataFrame:
    """Partials of the state, of one run a file: two refreshes at once may have read the same file."""
    rows = spark.read.parquet(state_path)
    newest = rows.groupBy(*FILE_KEY).agg(F.max("run").alias("run"))
    return rows.join(newest, [*FILE_KEY, "run"], "left_semi")


def changed_files(spark: SparkSession, table_path: str, state_path: str, schema_id: str) -> DataFrame:
    """FILE_KEY of the table's files whose partials the state doesn't hold."""
    listed = _listed(spark, table_path, schema_id)
    if not path_exists(spark, state_path):
        return listed
    return listed.join(spark.read.parquet(state_path).select(*FILE_KEY).distinct(), FILE_KEY, "left_anti")


def schema_id_of(rows: DataFrame, columns: Iterable[str]) -> str:
    fields = [(c, rows.schema[c].dataType.simpleString()) for c in columns]
    return hashlib.sha256(repr(fields).encode()).hexdigest()[:16]


def refresh_profile(spark: SparkSession, table_path: str, state_path: str, table_name: str = "table", *,
                    rows: DataFrame | None = None, lg_k: int = DEFAULT_LG_K) -> DataFrame:
    """The table's profile (distinct counts are sketch estimates), after a scan of new and changed files only.

    ``rows`` is a read of ``table_path`` with a schema of the caller's choice (default:
    ``spark.read.parquet``).  Files that went are left out, files without rows are
    remembered, and another schema reads every file again.  A file rewritten within
    the same size and modification time can't be told from the old one.  An
    interrupted refresh leaves partials of whole files; the next one goes on from them.
    """
    rows = spark.read.parquet(table_path) if rows is None else rows
    columns = list(rows.columns)
    schema_id = schema_id_of(rows, columns)
    changed = changed_files(spark, table_path, state_path, schema_id)
    if not changed.isEmpty():
        read = only_files(rows, changed)
        parts = profile_partials(read, ["__path"], table_name, lg_k, columns=columns).withColumnRenamed("__path", "path")
        # a file without rows leaves a row without a column name
        (changed.join(parts, "path", "left").write.parquet(f"{state_path.rstrip('/')}/run={unique_suffix()}"))
    found = known_partials(spark, state_path).join(_listed(spark, table_path, schema_id), FILE_KEY, "left_semi")
    found = found.where("column_name is not null").drop(*FILE_KEY, "run").withColumn("table_name", F.lit(table_name))
    if found.isEmpty():
        return profile(rows.where("false"), table_name, columns=columns)
    return merge_partials(found)
