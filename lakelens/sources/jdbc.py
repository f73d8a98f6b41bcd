"""SQL databases over JDBC (A2), with the reference's connection checks.

Reads are partitioned when a numeric partition column is given; missing
bounds are fetched with one pushed-down MIN/MAX query.  Statistics for
JDBC tables are pushed into the database as one aggregate subquery (the
``dbtable`` form), because a plain JDBC scan does not push COUNT.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Error texts of the connection checks.
SQLITE_NEEDS_DATABASE = "SQLite requires 'database' parameter."
MISSING_PARAMS = "Missing required connection parameters for {driver}: {missing}"

# JDBC URL forms per driver name.
URL_FORMS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "mariadb": "jdbc:mariadb://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "snowflake": "jdbc:snowflake://{host}:{port}/?db={database}",
}


def jdbc_url(details: Mapping[str, Any], credentials: Mapping[str, Any] | None = None) -> str:
    """URL from ``url`` or from driver/host/port/database parts.

    sqlite and derby need only ``database``; other drivers need host, port,
    database and username, and the missing ones are listed in the error.
    """
    credentials = credentials or {}
    url = details.get("url")
    if url:
        return url if str(url).startswith("jdbc:") else "jdbc:" + str(url)
    driver = str(details.get("driver") or "sqlite").lower()
    database = details.get("database") or ""
    if driver == "sqlite":
        if not database:
            raise ValueError(SQLITE_NEEDS_DATABASE)
        return f"jdbc:sqlite:{database}"
    if driver == "derby":
        if not database:
            raise ValueError(MISSING_PARAMS.format(driver=driver, missing="database"))
        return f"jdbc:derby:{database}"
    host, port = details.get("host") or "", details.get("port") or ""
    username = credentials.get("username") or details.get("username") or ""
    missing = [n for n, v in (("host", host), ("port", port), ("database", database),
                              ("username", username)) if not v]
    if missing:
        raise ValueError(MISSING_PARAMS.format(driver=driver, missing=", ".join(missing)))
    form = URL_FORMS.get(driver, "jdbc:" + driver + "://{host}:{port}/{database}")
    return form.format(host=host, port=port, database=database)


def _props(details: Mapping[str, Any], credentials: Mapping[str, Any]) -> dict[str, str]:
    p = {}
    user = credentials.get("username") or details.get("username")
    if user:
        p["user"] = str(user)
    if credentials.get("password"):
        p["password"] = str(credentials["password"])
    if details.get("jdbc_driver"):
        p["driver"] = str(details["jdbc_driver"])
    return p


def table_ref(table_id: str) -> str:
    """``schema.table`` or ``table``; three or more parts are refused."""
    parts = table_id.split(".")
    if len(parts) > 2 or any(not p for p in parts):
        raise ValueError(f"JDBC table id must be 'table' or 'schema.table': {table_id!r}")
    return table_id


def read_jdbc(spark: SparkSession, details: Mapping[str, Any], credentials: Mapping[str, Any],
              table_id: str, partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None,
              fetchsize: int = 10000, **_ignored) -> DataFrame:
    url = jdbc_url(details, credentials)
    props = _props(details, credentials)
    ref = table_ref(table_id)
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetchsize)
    for k, v in props.items():
        r = r.option(k, v)
    if partition_column:
        if lower_bound is None or upper_bound is None:
            b = pushed_query(spark, details, credentials,
                             f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {ref}").first()
            lower_bound, upper_bound = b.lo, b.hi
        if lower_bound is not None and upper_bound is not None:
            r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
                  .option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions or spark.sparkContext.defaultParallelism))
    return r.option("dbtable", ref).load()


def pushed_query(spark: SparkSession, details: Mapping[str, Any], credentials: Mapping[str, Any],
                 sql: str) -> DataFrame:
    """Run one SELECT inside the database (``dbtable`` subquery form)."""
    r = spark.read.format("jdbc").option("url", jdbc_url(details, credentials))
    for k, v in _props(details, credentials).items():
        r = r.option(k, v)
    return r.option("dbtable", f"({sql}) lakelens_q").load()


def column_stats_sql(table_id: str, columns: Sequence[str]) -> str:
    """The one statement the database runs for G1/G2 over ``columns``
    (the reference issues two per column)."""
    ref = table_ref(table_id)
    sel = ["COUNT(*) AS n"]
    for i, c in enumerate(columns):
        sel += [f"COUNT({c}) AS nn{i}", f"COUNT(DISTINCT {c}) AS d{i}",
                f"MIN({c}) AS mn{i}", f"MAX({c}) AS mx{i}"]
    return f"SELECT {', '.join(sel)} FROM {ref}"


def jdbc_column_stats(spark: SparkSession, details: Mapping[str, Any], credentials: Mapping[str, Any],
                      table_id: str, columns: Sequence[str]) -> DataFrame:
    """G1/G2 pushed down: one aggregate statement for all columns, then one
    row per column (column_name, row_count, null_count, distinct_count,
    min_value, max_value as text)."""
    wide = pushed_query(spark, details, credentials, column_stats_sql(table_id, columns))
    wide = wide.toDF(*[c.lower() for c in wide.columns])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("n").cast("long").alias("row_count"),
        (F.col("n") - F.col(f"nn{i}")).cast("long").alias("null_count"),
        F.col(f"d{i}").cast("long").alias("distinct_count"),
        F.col(f"mn{i}").cast("string").alias("min_value"),
        F.col(f"mx{i}").cast("string").alias("max_value")) for i, c in enumerate(columns)])))
