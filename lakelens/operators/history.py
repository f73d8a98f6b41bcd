"""Profile history with freshness rules.

The reference keeps one row per id in a small database and overwrites it.
Here the history is an append-only table (Parquet, partitioned by
``run_date``): saving appends, clearing appends tombstones, and the
current state is derived:

* current  - latest row per (source, kind, id); a tombstone hides the id.
             ``max_by`` over an orderable struct is an aggregate with a
             map-side partial step (sort-based, as the buffer is a struct):
             one id with a third of all rows is reduced to one partial row
             per task before the shuffle, unlike a ``row_number`` window
             that would ship and sort every history row.
* fresh    - current rows with ``as_of - last_updated <= ttl`` (a row exactly
             ``ttl`` old is still fresh; one microsecond older is stale).
* stale    - catalog entries with no fresh row (left anti join).
* by key   - the same history as a table bucketed by (source, id): what is asked
             of it by key needs no shuffle of the history.
* drift    - ``lag`` over profile runs per (table, column).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.session import path_exists

# Default time-to-live per kind of cached entry, in seconds.
METADATA_TTL_SECONDS = 86400
DISCOVERY_TTL_SECONDS = 3600
KIND_TTL = {"metadata": METADATA_TTL_SECONDS, "discovery": DISCOVERY_TTL_SECONDS}

HISTORY_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("last_updated", T.TimestampNTZType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("has_column_stats", T.BooleanType()),
])
HISTORY_COLUMNS = [f.name for f in HISTORY_SCHEMA.fields]
KEY = ("source", "kind", "id")


def ntz(value: dt.datetime) -> Column:
    """An exact TIMESTAMP_NTZ literal, independent of any time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_now() -> Column:
    """The present as a TIMESTAMP_NTZ in UTC, whatever the session's time zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def history_rows(df: DataFrame, source: Column | str, id_col: Column | str, content: Column,
                 kind: str = "metadata", last_updated: Column | dt.datetime | None = None,
                 has_column_stats: bool | Column = False) -> DataFrame:
    """Shape any DataFrame into history rows; ``content`` is a JSON column
    (built with ``to_json``, so it is always serialisable)."""
    if kind not in KIND_TTL:
        raise ValueError(f"kind must be one of {tuple(KIND_TTL)}")

    def c(v):
        return v if isinstance(v, Column) else F.lit(v)

    if last_updated is None:
        ts = utc_now()
    elif isinstance(last_updated, Column):
        ts = last_updated
    else:
        ts = ntz(last_updated)
    return df.select(
        c(source).cast("string").alias("source"),
        (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").alias("id"),
        F.lit(kind).alias("kind"),
        content.cast("string").alias("content"),
        ts.cast("timestamp_ntz").alias("last_updated"),
        F.lit(False).alias("deleted"),
        c(has_column_stats).cast("boolean").alias("has_column_stats"),
    )


def append_history(rows: DataFrame, path: str) -> None:
    """C1/C3 save: append, partitioned by the day of ``last_updated``."""
    (rows.select(*HISTORY_COLUMNS).withColumn("run_date", F.to_date("last_updated"))
         .write.mode("append").partitionBy("run_date").parquet(path))


def read_history(spark: SparkSession, path: str, since: dt.date | None = None,
                 until: dt.date | None = None) -> DataFrame:
    """The history, or only the days ``since`` to ``until`` (other days aren't read)."""
    stored = T.StructType(HISTORY_SCHEMA.fields + [T.StructField("run_date", T.DateType())])
    rows = spark.read.schema(stored).parquet(path)
    if since is not None:
        rows = rows.where(F.col("run_date") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("run_date") <= F.lit(until))
    return rows.select(*HISTORY_COLUMNS)


def append_by_key(rows: DataFrame, table: str, path: str | None = None, buckets: int | None = None) -> None:
    """C1/C3 save to a catalog table bucketed and sorted by (source, id), made by the first append
    with ``buckets`` (default: the session's shuffle partitions), at ``path`` if given.

    An append is reduced to its latest row per key, tombstones included, so that a
    key has at most one row for each append, however often it was saved in one.
    """
    spark = rows.sparkSession
    if spark.catalog.tableExists(table):
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(
            "col_name IN ('Num Buckets', 'Bucket Columns')").collect()}
        if told.get("Bucket Columns") != "[`source`, `id`]":
            raise ValueError(f"{table} is not a history by key")
        buckets = int(told["Num Buckets"])
    elif buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    latest = current(rows, include_deleted=True).select(*HISTORY_COLUMNS)
    writer = (latest.repartition(buckets, "source", "id").write.mode("append").format("parquet")
              .bucketBy(buckets, "source", "id").sortBy("source", "id", "kind"))
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def read_by_key(spark: SparkSession, table: str) -> DataFrame:
    """The history of ``append_by_key``; ``current``, ``fresh`` and ``stale`` of it shuffle nothing of it."""
    return spark.table(table).select(*HISTORY_COLUMNS)


def current(history: DataFrame, include_deleted: bool = False, as_of: dt.datetime | None = None) -> DataFrame:
    """The latest row per (source, kind, id), at ``as_of`` if given (later
    rows don't count).  Ties on last_updated go to a tombstone, then to the
    larger content, so the result is deterministic."""
    if as_of is not None:
        history = history.where(F.col("last_updated") <= ntz(as_of))
    order = F.struct("last_updated", "deleted", "content")
    rec = F.struct(*[F.col(c) for c in HISTORY_COLUMNS if c not in KEY])
    latest = history.groupBy(*KEY).agg(F.max_by(rec, order).alias("r")).select(*KEY, "r.*")
    return latest if include_deleted else latest.where(~F.col("deleted"))


def _ttl_for(kind_col: Column, ttl_seconds: int | None) -> Column:
    if ttl_seconds is not None:
        return F.lit(int(ttl_seconds))
    e = None
    for k, v in KIND_TTL.items():
        e = F.when(kind_col == k, F.lit(v)) if e is None else e.when(kind_col == k, F.lit(v))
    return e.otherwise(F.lit(METADATA_TTL_SECONDS))


def fresh(cur: DataFrame, as_of: dt.datetime, ttl_seconds: int | None = None,
          need_column_stats: bool = False) -> DataFrame:
    """Current rows not older than their TTL at ``as_of`` (default
    TTL per kind), nor later than it.  ``need_column_stats`` only accepts rows
    saved with them."""
    age_ok = (F.col("last_updated") <= ntz(as_of)) & (F.col("last_updated") >= (
        ntz(as_of) - F.make_dt_interval(secs=_ttl_for(F.col("kind"), ttl_seconds))))
    out = cur.where(age_ok)
    if need_column_stats:
        out = out.where(F.col("has_column_stats"))
    return out


def fresh_history(spark: SparkSession, path: str, as_of: dt.datetime, ttl_seconds: int | None = None,
                  need_column_stats: bool = False) -> DataFrame:
    """C2/C4 from a stored history, reading only the days that can hold a fresh row:
    what is fresh, and any later row or tombstone that hides it, is no older
    than the longest TTL."""
    longest = ttl_seconds if ttl_seconds is not None else max(KIND_TTL.values())
    since = (as_of - dt.timedelta(seconds=longest)).date()
    return fresh(current(read_history(spark, path, since, as_of.date()), as_of=as_of), as_of, ttl_seconds, need_column_stats)


def cached_ids(cur: DataFrame) -> DataFrame:
    """Every cached id, fresh or not."""
    return cur.where(F.col("kind") == "metadata").select("source", "id").distinct()


def tombstones(cur: DataFrame, ids: DataFrame | None = None, kinds: Sequence[str] = ("metadata",),
               at: dt.datetime | None = None) -> DataFrame:
    """C6 clear: tombstone rows for the given (source, id) rows, or for every
    current entry of the given kinds (``kinds`` both = clear all)."""
    target = cur.where(F.col("kind").isin(list(kinds)))
    if ids is not None:
        target = target.join(ids.select("source", "id"), ["source", "id"], "left_semi")
    ts = ntz(at) if at else utc_now()
    return target.select(*KEY, F.lit(None).cast("string").alias("content"),
                         ts.alias("last_updated"), F.lit(True).alias("deleted"),
                         F.lit(False).alias("has_column_stats")).select(*HISTORY_COLUMNS)


def stale(catalog: DataFrame, cur: DataFrame, as_of: dt.datetime, ttl_seconds: int | None = None,
          kind: str = "metadata") -> DataFrame:
    """Catalog entries (source, id) with no fresh row of ``kind`` - the
    tables to re-profile.  A left anti join; Catalyst/AQE choose the join
    strategy from the sizes."""
    f = fresh(cur.where(F.col("kind") == kind), as_of, ttl_seconds).select("source", "id")
    return catalog.select("source", "id").distinct().join(f, ["source", "id"], "left_anti")


def profile_drift(runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per (table, column), each profile run next to the previous one.

    ``runs`` holds profile rows plus ``run_col``.  The window partitions by
    (table, column): one row per run in each, so no partition grows with
    the data.
    """
    w = Window.partitionBy("table_name", "column_name").orderBy(run_col)
    lanes = ("int", "num", "str", "ts")

    def changed(b: str) -> Column:
        e = F.lit(False)
        for ln in lanes:
            c = f"{b}_{ln}"
            e = e | ~F.col(c).eqNullSafe(F.lag(c).over(w))
        return F.when(F.lag(run_col).over(w).isNull(), F.lit(None).cast("boolean")).otherwise(e)

    return runs.select(
        "table_name", "column_name", run_col, "row_count",
        F.lag("row_count").over(w).alias("prev_row_count"),
        "null_count", F.lag("null_count").over(w).alias("prev_null_count"),
        "distinct_count", F.lag("distinct_count").over(w).alias("prev_distinct_count"),
        changed("min").alias("min_changed"), changed("max").alias("max_changed"))


def discovery_rows(listing: DataFrame, source: str, key: str,
                   last_updated: dt.datetime | None = None) -> DataFrame:
    """A discovery result (e.g. ``list_tables``) saved as ONE history row
    keyed by ``key`` with the JSON list as content.  The list is bounded by
    the number of objects in one database."""
    content = F.to_json(F.collect_list(F.struct(*[F.col(c) for c in listing.columns])))
    one = listing.groupBy().agg(content.alias("content"))
    return history_rows(one, F.lit(source), F.lit(key), F.col("content"), kind="discovery",
                        last_updated=last_updated)


def refresh_stale(spark: SparkSession, tables: dict, history_path: str, source: str,
                  as_of: dt.datetime, ttl_seconds: int | None = None, column_stats: bool = True,
                  force: bool = False, chunk: int = 64, paths: Mapping[str, str] | None = None,
                  primary_keys: Mapping[str, Sequence[str]] | None = None, distinct: str = "approx") -> list[str]:
    """C7 read-through: profile the tables whose history entry is missing or
    stale (all of them with ``force``, the reference's refresh flag) and
    append their nested metadata records.  ``tables`` maps table id to
    DataFrame, ``paths`` to its location (so that records hold size, freshness
    and partitions) and ``primary_keys`` to its key columns; the ids to refresh (a list bounded by the number of tables)
    come back to the driver to drive one profile job per table.
    """
    from lakelens.operators.metadata import full_metadata, to_json_record

    from lakelens.functions.literals import literal_rows

    catalog = literal_rows(spark, [(source, t) for t in tables], [("source", "STRING"), ("id", "STRING")])
    if force:
        todo = sorted(tables)
    else:
        if path_exists(spark, history_path):
            cur = fresh_history(spark, history_path, as_of, ttl_seconds)
        else:
            cur = spark.createDataFrame([], HISTORY_SCHEMA)  # no history yet: everything is stale
        todo = sorted(r.id for r in stale(catalog, cur, as_of, ttl_seconds).collect())
    if not todo:
        return []
    for start in range(0, len(todo), chunk):
        records = None
        for t in todo[start:start + chunk]:
            rec = to_json_record(full_metadata(
                spark, tables[t], t, (paths or {}).get(t), column_stats=column_stats, distinct=distinct,
                primary_keys=(primary_keys or {}).get(t, ())))
            records = rec if records is None else records.unionByName(rec)
        rows = history_rows(records, F.lit(source), "id", F.col("content"), kind="metadata",
                            last_updated=as_of, has_column_stats=column_stats)
        append_history(rows, history_path)  # each chunk is durable on its own
    return todo


def compact_history(spark: SparkSession, src_path: str, dst_path: str,
                    keep_tombstones: bool = False) -> DataFrame:
    """Write the current state of a history (latest row per key; tombstoned
    keys dropped unless ``keep_tombstones``) as a new, date-partitioned
    history at ``dst_path``; nothing is deleted.  Reading the compacted copy
    gives the same ``current`` as the full history."""
    cur = current(read_history(spark, src_path), include_deleted=keep_tombstones)
    append_history(cur.select(*HISTORY_COLUMNS), dst_path)
    return read_history(spark, dst_path)
