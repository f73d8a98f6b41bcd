"""Table readers and sinks.

A source is chosen by a small config record (name, type, connection
details, credentials, options), mirroring the reference's registry, and
always ends in ``spark.read`` / ``spark.table``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# The source types a config record may name.
SOURCE_TYPES = ("rdbms", "databricks", "file_system", "duckdb")


def read_parquet(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """A4: all Parquet files below ``path``.  Hive-style ``k=v`` trees keep
    partition discovery; ``recursive`` reads non-Hive nested trees."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_tables(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Several driver tables.  Creating a DataFrame infers its schema from a
    footer (a driver round trip per table), so they are opened concurrently
    from a few driver threads; the order of ``names`` is kept."""
    from concurrent.futures import ThreadPoolExecutor

    names = list(names)
    if len(names) <= 1:
        return {n: read_table(spark, sf_dir, n) for n in names}
    with ThreadPoolExecutor(max_workers=min(8, len(names))) as pool:
        frames = list(pool.map(lambda n: read_table(spark, sf_dir, n), names))
    return dict(zip(names, frames))


def split_table_id(table_id: str) -> tuple[str | None, str | None, str]:
    """Dotted id -> (catalog, database, table); 1 to 3 parts, more is an error."""
    parts = table_id.split(".")
    if not 1 <= len(parts) <= 3 or any(p == "" for p in parts):
        raise ValueError(f"table id must have 1 to 3 non-empty parts: {table_id!r}")
    parts = [None] * (3 - len(parts)) + parts
    return parts[0], parts[1], parts[2]


def read_catalog_table(spark: SparkSession, table_id: str) -> DataFrame:
    """A5: ``catalog.db.table`` / ``db.table`` / ``table`` through the catalog."""
    split_table_id(table_id)
    return spark.table(table_id)


def load_table(spark: SparkSession, config: Mapping[str, Any], table_id: str) -> DataFrame:
    """A1: dispatch on the source config's ``type``.

    rdbms -> JDBC; file_system -> Parquet below ``path``; duckdb -> a
    directory of Parquet tables (the embedded database's role), one child
    directory per table; databricks -> the session catalog.
    """
    kind = config.get("type")
    details = dict(config.get("connection_details") or {})
    if kind not in SOURCE_TYPES:
        raise ValueError(f"Unsupported source type: {kind}")
    if kind == "rdbms":
        from lakelens.sources.jdbc import read_jdbc
        return read_jdbc(spark, details, dict(config.get("credentials") or {}), table_id,
                         **dict(config.get("options") or {}))
    if kind == "file_system":
        base = details.get("path")
        if not base:
            raise ValueError("file_system source requires 'path'")
        table_path = f"{base.rstrip('/')}/{table_id}"
        from lakelens.session import path_exists
        if path_exists(spark, f"{table_path}/_delta_log"):  # Delta first: its files are Parquet too
            from lakelens.sources.deltalog import read_delta
            return read_delta(spark, table_path)
        return read_parquet(spark, table_path)
    if kind == "duckdb":
        base = details.get("database")
        if not base:
            raise ValueError("DuckDB connection requires 'database' parameter")
        # a directory of Parquet tables stands in for the database file; the
        # table is read directly (``register_directory`` registers views)
        return read_parquet(spark, f"{base.rstrip('/')}/{split_table_id(table_id)[2]}")
    return read_catalog_table(spark, table_id)


def export_tables(tables: Mapping[str, DataFrame], out_dir: str,
                  partition_by: Mapping[str, list[str]] | None = None,
                  mode: str = "overwrite") -> dict[str, str]:
    """A8 sink: one directory per table under ``out_dir``."""
    paths = {}
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        cols = (partition_by or {}).get(name)
        if cols:
            w = w.partitionBy(*cols)
        w.parquet(path)
        paths[name] = path
    return paths


def register_directory(spark: SparkSession, base: str, names: Iterable[str] | None = None,
                       prefix: str = "") -> list[str]:
    """Every child directory of ``base`` becomes a temp view named
    ``prefix + child``.  Child names come from a listing job (paths only)."""
    if names is None:
        from lakelens.operators.inventory import list_table_dirs
        names = list_table_dirs(spark, base)
    registered = []
    for name in names:
        view = prefix + name
        spark.read.parquet(f"{base.rstrip('/')}/{name}").createOrReplaceTempView(view)
        registered.append(view)
    return registered
