"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables, or data Spark derives from them,
over whole tables.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import types as TY
from lakelens.functions.literals import literal_rows
from lakelens.operators import distinct as DI
from lakelens.operators import footer_stats as FS
from lakelens.operators import history as H
from lakelens.operators import inventory as INV
from lakelens.operators import metadata as MD
from lakelens.operators import pages as PG
from lakelens.operators import profile as P
from lakelens.operators import refresh as R
from lakelens.operators import sampling as S
from lakelens.sources import footers as FSRC
from lakelens.operators import schema as SC
from lakelens.operators.catalog_stats import row_count_ladder
from lakelens.operators.metadata import describe_report as _describe
from lakelens.plans import fixtures as FX
from lakelens.plans.oracle import TABLE_SCHEMAS
from lakelens.session import scratch_dir, unique_suffix
from lakelens.sources import deltalog as DL
from lakelens.sources import unified as U
from lakelens.sources.readers import export_tables, read_table, read_tables, register_directory
from lakelens.streaming.incremental import incremental_profile


def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.row_counts(read_tables(spark, sf_dir, TABLE_SCHEMAS))


def column_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(read_table(spark, sf_dir, "lineitem"), "lineitem", distinct="exact")


def column_profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(read_table(spark, sf_dir, "events"), "events", distinct="exact")


def orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with NULLs made by rule: a nullif, two CASEs and an all-NULL column."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "F", None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.lit(None).cast("bigint").alias("all_null"),
    )


def column_profile_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(orders_with_nulls(spark, sf_dir), "orders_nulls", distinct="exact")


def column_stats_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_stats(read_table(spark, sf_dir, "customer"), "c_acctbal", "exact").select(
        "column_name", "row_count", "null_count", "distinct_count", "min_num", "max_num")


def profile_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_tables(read_tables(spark, sf_dir, TABLE_SCHEMAS), distinct="exact")


def approx_distinct_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLL++ at rsd 0.01 and the mergeable HLL sketch, each judged
    against the exact count (reported) within 5 %.  The exact count is a
    separate aggregate so the sketches are not evaluated per distinct key."""
    o = read_table(spark, sf_dir, "orders")
    exact = P.column_stats(o, "o_custkey", "exact").select("column_name", "distinct_count")
    hllpp = P.column_stats(o, "o_custkey", "approx", 0.01, "hllpp").select(
        "column_name", F.col("distinct_count").alias("hllpp"))
    sketch = P.column_stats(o, "o_custkey", "approx", 0.01, "sketch").select(
        "column_name", F.col("distinct_count").alias("sketch"))
    r = exact.join(hllpp, "column_name").join(sketch, "column_name")
    d = F.col("distinct_count")
    return r.select(
        "column_name", d.alias("exact_distinct"),
        (F.abs(F.col("hllpp") - d) <= 0.05 * d).alias("within_5pct"),
        (F.abs(F.col("sketch") - d) <= 0.05 * d).alias("sketch_within_5pct"))


def string_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {"documents": ["text"], "part": ["p_name"]}
    out = None
    for name, cols in t.items():
        p = P.profile(read_table(spark, sf_dir, name), name, distinct="none", columns=cols)
        p = p.select("table_name", "column_name", "row_count", "avg_len", "max_len")
        out = p if out is None else out.unionByName(p)
    return out


QUERIES = {
    "table_row_counts": table_row_counts,
    "column_profile_lineitem": column_profile_lineitem,
    "column_profile_events": column_profile_events,
    "column_profile_with_nulls": column_profile_with_nulls,
    "column_stats_single": column_stats_single,
    "profile_all_tables": profile_all_tables,
    "approx_distinct_check": approx_distinct_check,
    "string_length_stats": string_length_stats,
}


# --- sampling (M1-M7) --------------------------------------------------------


def sample_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample(read_table(spark, sf_dir, "orders"), "limit", limit=100)


def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample(read_table(spark, sf_dir, "lineitem"), "bernoulli", percent=10, seed=42)


def sample_bernoulli_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample(read_table(spark, sf_dir, "orders"), "hash", percent=10, seed=42, key="o_orderkey")


def sample_bernoulli_hash_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample(read_table(spark, sf_dir, "orders"), "hash", percent=10, seed=42,
                    key="o_orderkey", order_by=["o_orderkey"], limit=50)


def sample_system_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample(read_table(spark, sf_dir, "events"), "system", percent=20, seed=7,
                    block=[F.floor(F.col("event_id") / 500)])


def sample_system_file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 with the default block id (file path, row_index // 2048)."""
    return S.sample(read_table(spark, sf_dir, "events"), "system", percent=30, seed=3)


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    s = S.sample(o, "hash", percent=5, seed=11, key="o_orderkey")
    return S.to_records(s.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
                        keep=["o_orderkey"])


# --- schema, keys, describe (S1, S3, S5, T1-T8, X3) ---------------------------


def schema_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = SC.schema_inventory(spark, read_tables(spark, sf_dir, TABLE_SCHEMAS))
    # what the files themselves say: the column's place in their footers, and their rows
    files = (FSRC.file_schemas(spark, sf_dir.rstrip("/"))
             .withColumn("table_name", F.regexp_extract("file_path", r"([^/]+)\.parquet(?:/[^/]*)?$", 1))
             .groupBy("table_name", "column_name").agg(F.min("ordinal").alias("file_ordinal"), F.sum("num_rows").alias("row_count")))
    return inv.join(files, ["table_name", "column_name"], "left").select(
        "table_name", "ordinal", "column_name", "data_type", "original_type", "nullable", "file_ordinal", "row_count")


def normalize_types_all_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T7 over the schema corpus of every table: each column's type spelt
    the Spark way and the embedded-database way (from the table schema), and
    the Arrow way as read from the footers of the table's files, normalized
    under every dialect."""
    rows = []
    for name, df in read_tables(spark, sf_dir, TABLE_SCHEMAS).items():
        for f in df.schema.fields:
            rows.append((name, f.name, "spark", f.dataType.simpleString()))
            rows.append((name, f.name, "embedded", TY.embedded_type_name(f.dataType)))
    corpus = literal_rows(spark, rows, [("table_name", "STRING"), ("column_name", "STRING"),
                                        ("spelling", "STRING"), ("raw_type", "STRING")])
    arrow = (FSRC.file_schemas(spark, sf_dir.rstrip("/"))
             .select(F.regexp_extract("file_path", r"([^/]+)\.parquet$", 1).alias("table_name"),
                     "column_name", F.lit("arrow").alias("spelling"), F.col("arrow_type").alias("raw_type"))
             .where(F.col("table_name").isin(list(TABLE_SCHEMAS))).distinct())
    corpus = corpus.unionByName(arrow)
    corpus = corpus.withColumn("dialect", F.explode(F.array(*[F.lit(d) for d in TY.DIALECTS])))
    return TY.normalize_types(corpus)


def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"customer": [["c_custkey"]], "orders": [["o_orderkey"], ["o_custkey"]],
            "part": [["p_partkey"]], "lineitem": [["l_orderkey", "l_linenumber"], ["l_orderkey"]]}
    out = None
    for t, cs in sets.items():
        r = SC.candidate_keys(read_table(spark, sf_dir, t), cs, t)
        out = r if out is None else out.unionByName(r)
    return out


def describe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _describe(spark, read_table(spark, sf_dir, "supplier"), "supplier", distinct="exact")


QUERIES.update({
    "sample_limit": sample_limit,
    "sample_bernoulli": sample_bernoulli,
    "sample_bernoulli_hash": sample_bernoulli_hash,
    "sample_bernoulli_hash_limit": sample_bernoulli_hash_limit,
    "sample_system_blocks": sample_system_blocks,
    "sample_system_file_blocks": sample_system_file_blocks,
    "sample_records": sample_records,
    "schema_inventory": schema_inventory,
    "normalize_types_all_dialects": normalize_types_all_dialects,
    "candidate_keys": candidate_keys,
    "describe_report": describe_report,
})


# --- footers, drift, inventory, partitions, Delta (F1-F6, S4, B3-B6, P1-P3) -----

_FOOTER_COLS = ["column_name", "row_count", "null_count", "min_int", "max_int", "min_num", "max_num",
                "min_str", "max_str", "min_ts", "max_ts"]


def footer_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FS.footer_table_stats(spark, FX.multi_file_orders(spark, sf_dir)).select(*_FOOTER_COLS)


def footer_pushdown_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax"]
    return FS.pushdown_aggregate(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", cols)


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = FS.schema_drift(spark, FX.drift_orders(spark, sf_dir))
    return d.select("column_name", "arrow_type", "row_count", "conflict", "in_all_files")


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return INV.lake_inventory(spark, FX.lake(spark, sf_dir))


def table_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 for every table of the lake, with the rows that a reader of that format
    finds: footers, the Delta log, or a scan."""
    base = FX.lake(spark, sf_dir)
    return INV.table_formats(spark, base).join(_lake_rows(spark, base), ["database", "table_name"], "left")


def _lake_rows(spark: SparkSession, base: str) -> DataFrame:
    rows = None
    for db, table, counted in (
            ("tpch", "orders", FS.footer_row_count(spark, f"{base}/tpch/orders")),
            ("tpch", "lineitem", FS.footer_row_count(spark, f"{base}/tpch/lineitem")),
            ("tpch", "orders_delta", DL.delta_table_stats(spark, f"{base}/tpch/orders_delta")),
            ("raw", "events_json", spark.read.text(f"{base}/raw/events_json").agg(F.count(F.lit(1)).alias("row_count")))):
        one = counted.select(F.lit(db).alias("database"), F.lit(table).alias("table_name"), "row_count")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def partition_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return INV.partition_row_counts(spark, FX.hive_orders(spark, sf_dir)).select(
        "column_name", "value", "depth", "row_count")


def partition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return INV.partition_inventory(spark, FX.hive_orders(spark, sf_dir))


def delta_log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DL.delta_column_stats(spark, FX.delta_orders(spark, sf_dir))


def delta_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = DL.delta_table_stats(spark, FX.delta_orders(spark, sf_dir))
    return t.select("max_add_version", "row_count")


QUERIES.update({
    "footer_profile_orders": footer_profile_orders,
    "footer_pushdown_agg": footer_pushdown_agg,
    "schema_drift": schema_drift,
    "file_inventory": file_inventory,
    "table_formats": table_formats,
    "partition_inventory": partition_inventory,
    "partition_files": partition_files,
    "delta_log_stats": delta_log_stats,
    "delta_snapshot": delta_snapshot,
})


# --- history, drift, metadata, partial merges (C1-C8, X1-X4, F5, A8/A9) -------------


HISTORY_AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)


def events_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows derived from events: one saved entry per event.
    source = event_type, id = 'table_<user_id>', kind = discovery for
    'view' events else metadata, content = props, tombstone when value < 2."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("source"),
        F.concat(F.lit("table_"), F.col("user_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "view", "discovery").otherwise("metadata").alias("kind"),
        F.col("props").alias("content"),
        F.col("ts").alias("last_updated"),
        (F.col("value") < 2.0).alias("deleted"),
        F.lit(True).alias("has_column_stats"))


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.current(events_history(spark, sf_dir)).select("source", "kind", "id", "content", "last_updated")


def history_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = H.current(events_history(spark, sf_dir))
    return H.fresh(cur, HISTORY_AS_OF).select("source", "kind", "id", "content", "last_updated")


def history_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """catalog = every (event_type, user) pair seen in events."""
    catalog = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.concat(F.lit("table_"), F.col("user_id").cast("string")).alias("id"))
    cur = H.current(events_history(spark, sf_dir))
    return H.stale(catalog, cur, HISTORY_AS_OF, kind="metadata")


def profile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    r1 = P.profile(o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), "orders",
                   distinct="exact")
    r2 = P.profile(o, "orders", distinct="exact")
    runs = r1.withColumn("run_id", F.lit(1)).unionByName(r2.withColumn("run_id", F.lit(2)))
    return H.profile_drift(runs)


def full_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1+X2 for orders, to JSON (X4) and back; fields read from the parsed record."""
    meta = MD.full_metadata(spark, read_table(spark, sf_dir, "orders"), "tpch.orders", distinct="exact")
    back = MD.from_json_record(MD.to_json_record(meta))
    cols = back.select("id", "name", "database", F.col("stats.row_count").alias("row_count"),
                       F.explode("schema_info.columns").alias("c"), "stats.column_stats")
    return cols.select(
        "id", "name", "database", "row_count",
        F.col("c.name").alias("column_name"), F.col("c.data_type").alias("data_type"),
        F.col("column_stats")[F.col("c.name")].getField("null_count").alias("null_count"),
        F.col("column_stats")[F.col("c.name")].getField("distinct_count").alias("distinct_count"),
        F.col("column_stats")[F.col("c.name")].getField("min_value").alias("min_value"),
        F.col("column_stats")[F.col("c.name")].getField("max_value").alias("max_value"))


_NO_DISTINCT = [c for c in P.PROFILE_COLUMNS if c not in ("distinct_count", "distinct_is_approx")]


def profile_merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partials per o_orderstatus merged equal the whole-table profile
    (distinct is a sketch estimate and left out of the comparison)."""
    o = read_table(spark, sf_dir, "orders")
    parts = P.profile_partials(o.withColumn("__grp", F.col("o_orderstatus")), ["__grp"], "orders",
                               columns=o.columns)
    return P.merge_partials(parts).select(*_NO_DISTINCT)


def profile_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 over the files of the six-file copy of orders."""
    df = spark.read.parquet(FX.multi_file_orders(spark, sf_dir))
    return P.profile_by_file(df, "orders").select(*_NO_DISTINCT)


QUERIES.update({
    "history_latest": history_latest,
    "history_fresh": history_fresh,
    "history_stale": history_stale,
    "profile_drift": profile_drift,
    "full_metadata_json": full_metadata_json,
    "profile_merge_partials": profile_merge_partials,
    "profile_by_file": profile_by_file,
})


# --- sinks, streams, ladders (A8, A9, W1, G8, B1) --------------------------------

_ROUNDTRIP_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "orders": "o_orderkey",
                   "lineitem": "l_orderkey"}


def export_register_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 export each table to its own directory, A9 register the directory
    tree as views, read back: count and key sum per table."""
    out = scratch_dir(spark, "export")
    export_tables(read_tables(spark, sf_dir, _ROUNDTRIP_KEYS), out)
    views = register_directory(spark, out, prefix="rt_")
    res = None
    for v in views:
        t = v[len("rt_"):]
        r = spark.table(v).agg(F.count(F.lit(1)).cast("long").alias("row_count"),
                               F.sum(_ROUNDTRIP_KEYS[t]).cast("long").alias("key_sum")) \
                 .select(F.lit(t).alias("table_name"), "row_count", "key_sum")
        res = r if res is None else res.unionByName(r)
    return res


def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arriving as six files, two per micro-batch; the merged
    partials equal the batch profile (distinct left out: a sketch)."""
    src = FX.stream_events(spark, sf_dir)
    state = scratch_dir(spark, "stream-state")
    return incremental_profile(spark, src, state, table_name="events",
                               max_files_per_trigger=2).select(*_NO_DISTINCT)


def row_count_ladder_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 for a path table without catalog statistics: footers answer."""
    return row_count_ladder(spark, path=FX.multi_file_orders(spark, sf_dir))


def lake_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 for a lake root: top-level directories holding files, with the rows of their tables."""
    base = FX.lake(spark, sf_dir)
    rows = _lake_rows(spark, base).groupBy(F.col("database").alias("name")).agg(
        F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("table_count"))
    return INV.list_lake_databases(spark, base).join(rows, "name", "left")


QUERIES.update({
    "export_register_roundtrip": export_register_roundtrip,
    "stream_profile": stream_profile,
    "row_count_ladder_footers": row_count_ladder_footers,
    "lake_databases": lake_databases,
})


# --- the driver's own files and text tables ---------------------------------------
TEXT_TABLES = ["documents", "pages", "conversations", "benchmark", "labels", "embeddings"]


def footer_stats_given_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1/F2 over the driver's own Parquet files (another writer than
    Spark's): per table and leaf column, from footers only."""
    root = sf_dir.rstrip("/")
    ch = FS.footer_chunks(spark, root)
    ch = ch.withColumn("table_name", F.regexp_extract("file_path", r"([^/]+)\.parquet(?:/[^/]*)?$", 1))
    return FS.merge_chunks(ch, ["table_name", "column_path"], ["table_name"]).select(
        "table_name", F.col("column_path").alias("column_name"), *_FOOTER_COLS[1:])


def profile_text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4/G5 over whole texts (documents up to 20,000 words, raw pages) and
    the array column of embeddings, exact distinct."""
    return P.profile_tables(read_tables(spark, sf_dir, TEXT_TABLES), distinct="exact")


QUERIES.update({
    "footer_stats_given_tables": footer_stats_given_tables,
    "profile_text_tables": profile_text_tables,
})


def column_profile_lineitem_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 cheap tier with HLL sketches: one job, one scan, no exact distinct
    (distinct is an estimate and left out of the comparison)."""
    return P.profile(read_table(spark, sf_dir, "lineitem"), "lineitem", distinct="approx").select(*_NO_DISTINCT)


QUERIES["column_profile_lineitem_approx"] = column_profile_lineitem_approx


def history_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 compaction: the events-derived history written, compacted into a
    new location, and its current state read back."""
    src, dst = scratch_dir(spark, "history"), scratch_dir(spark, "history-compact")
    H.append_history(events_history(spark, sf_dir), src)
    return H.current(H.compact_history(spark, src, dst)).select("source", "kind", "id", "content", "last_updated")


# The tables whose records are read through the history, with their keys.
RECORD_TABLES = {"region": ["r_regionkey"], "supplier": ["s_suppkey"], "lineitem": ["l_orderkey", "l_linenumber"]}


def read_through_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 with X1/X2: records that a refresh saved, and that a second refresh found
    fresh, read back from the history: rows, keys, size known, and nulls and bounds
    of every column."""
    path, at = scratch_dir(spark, "records"), HISTORY_AS_OF
    frames = {f"tpch.{t}": df for t, df in read_tables(spark, sf_dir, RECORD_TABLES).items()}
    paths = {f"tpch.{t}": f"{sf_dir.rstrip('/')}/{t}.parquet" for t in RECORD_TABLES}
    keys = {f"tpch.{t}": k for t, k in RECORD_TABLES.items()}
    saved = H.refresh_stale(spark, frames, path, "lake", at, paths=paths, primary_keys=keys)
    again = H.refresh_stale(spark, frames, path, "lake", at + _dt.timedelta(hours=1), paths=paths, primary_keys=keys)
    records = MD.from_json_record(H.fresh_history(spark, path, at + _dt.timedelta(hours=1)).select("content"))
    return records.select(
        "id", "database", F.array_join("schema_info.primary_keys", ",").alias("primary_keys"),
        F.col("stats.row_count").alias("row_count"), (F.col("stats.total_size_bytes") > 0).alias("size_known"),
        F.lit(len(saved) - len(again)).cast("long").alias("refreshed"),
        F.explode("stats.column_stats").alias("column_name", "c")).select(
        "id", "database", "primary_keys", "row_count", "size_known", "refreshed", "column_name",
        F.col("c.null_count").alias("null_count"), F.col("c.max_len").alias("max_len"))


def decimal_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 on a DECIMAL: partial profiles of o_totalprice cast to decimal, one a priority,
    merged; bounds are compared as numbers and shown as text."""
    o = read_table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").cast("decimal(20,2)").alias("price"))
    merged = P.merge_partials(P.profile_partials(o, ["o_orderpriority"], "orders").drop("o_orderpriority"))
    return merged.select("column_name", "row_count", "null_count", F.col("min_str").alias("min_value"), F.col("max_str").alias("max_value"))


def sample_hash_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 at 0.05 %: far below one row in a thousand."""
    return S.hash_sample(read_table(spark, sf_dir, "lineitem"), 0.05, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


def lake_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory holding files below the lake root, with the rows of the Parquet
    files at or below it (from their footers, removed Delta files included)."""
    base = FX.lake(spark, sf_dir)
    rows = FSRC.file_rows(spark, INV.list_files(spark, base, "*.parquet"))
    segs = F.split(INV.relative_path("path", INV.qualify(spark, base)), "/")
    levels = rows.select("num_rows", segs.alias("s")).select(
        "num_rows", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda n: F.array_join(F.slice("s", 1, n), "/"))).alias("name"))
    return INV.list_directories(spark, base, recursive=True).join(
        levels.groupBy("name").agg(F.sum("num_rows").alias("parquet_rows")), "name", "left")


QUERIES.update({
    "history_compacted": history_compacted,
    "read_through_records": read_through_records,
    "decimal_partials": decimal_partials,
    "sample_hash_rare": sample_hash_rare,
    "lake_directories": lake_directories,
})


def profile_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 per group: one profile of orders per o_orderstatus value, from one
    grouped aggregate (distinct is a sketch estimate, left out)."""
    o = read_table(spark, sf_dir, "orders")
    return P.profile_by_group(o, ["o_orderstatus"], "orders").select("o_orderstatus", *_NO_DISTINCT)


QUERIES["profile_per_partition"] = profile_per_partition


def delta_profile_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 over a Delta table's data at version 1 (time travel: only the O
    files are live then), read from its log without a Delta runtime."""
    df = DL.read_delta(spark, FX.delta_orders(spark, sf_dir), version=1)
    return P.profile(df, "orders_delta", distinct="exact")


QUERIES["delta_profile_v1"] = delta_profile_v1


def discover_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 and G1: the given tables registered as views (A9 naming ``dt_<table>``),
    listed with their kind, and the rows of each."""
    frames = {f"dt_{name}": df for name, df in read_tables(spark, sf_dir, TABLE_SCHEMAS).items()}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    listed = INV.list_tables(spark).where(F.col("name").startswith("dt_"))
    return listed.join(P.row_counts(frames).withColumnRenamed("table_name", "name"), "name")


QUERIES["discover_tables"] = discover_tables


def profile_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files by key modulo six are profiled, the files of one sixth are
    written anew, and the refresh reads those only (distinct is a sketch, left out)."""
    table, state = scratch_dir(spark, "sixths"), scratch_dir(spark, "refresh-state")
    o = read_table(spark, sf_dir, "orders").withColumn("bucket", (F.col("o_orderkey") % 6).cast("int"))
    o.write.partitionBy("bucket").parquet(table)
    R.refresh_profile(spark, table, state, "orders")
    doubled = o.where("bucket = 3").withColumn("o_totalprice", F.col("o_totalprice") * 2).drop("bucket")
    doubled.write.mode("overwrite").parquet(f"{table}/bucket=3")
    return R.refresh_profile(spark, table, state, "orders").select(*_NO_DISTINCT)


def drifted_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory whose files hold int and bigint keys, some with one column more, read in
    its least schema by one scan."""
    return P.profile(U.read_unified(spark, FX.drift_orders(spark, sf_dir)), "orders_drift", distinct="exact")


def mixed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text among numbers, decimals among doubles and a column that some files
    lack, read by row groups."""
    return P.profile(U.read_unified(spark, FX.mixed_orders(spark, sf_dir)), "orders_mixed", distinct="exact")


def sample_system_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 by a block that is a directory: only the chosen directories' files are opened."""
    e = spark.read.parquet(FX.blocked_events(spark, sf_dir))
    return S.sample(e, "system", percent=20, seed=7, block=[F.col("block")])


def row_count_ladder_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 for a Delta directory with removed files: the footers of the live ones answer."""
    return row_count_ladder(spark, path=FX.delta_orders(spark, sf_dir, commits=2))


def footer_stats_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 for a Delta directory with removed files: the footers of the live ones only."""
    return FS.footer_table_stats(spark, FX.delta_orders(spark, sf_dir, commits=2)).select(*_FOOTER_COLS)


QUERIES.update({
    "profile_refreshed": profile_refreshed,
    "drifted_profile": drifted_profile,
    "mixed_profile": mixed_profile,
    "sample_system_partitions": sample_system_partitions,
    "row_count_ladder_delta": row_count_ladder_delta,
    "footer_stats_delta": footer_stats_delta,
})


def discovery_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 in pages: every customer as an object of a discovery, saved to a history page by page and read back."""
    path = scratch_dir(spark, "paged")
    listing = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))
    H.append_history(PG.paged_rows(listing, ["name"], "lake", "customers", page_rows=100, last_updated=HISTORY_AS_OF), path)
    return PG.paged_items(spark, H.read_history(spark, path), "lake", "customers", listing.schema)


def partition_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 in pages: the partitions of the Hive-style copy with their rows, as JSON pages and back."""
    parts = INV.partition_row_counts(spark, FX.hive_orders(spark, sf_dir)).select("column_name", "value", "depth", "location", "row_count")
    rows = PG.paged_rows(parts, ["location"], "lake", "orders", kind="metadata", page_rows=4, last_updated=HISTORY_AS_OF)
    path = scratch_dir(spark, "paged-partitions")
    H.append_history(rows, path)
    return PG.paged_items(spark, H.read_history(spark, path), "lake", "orders", parts.schema, kind="metadata").drop("location")


QUERIES.update({"discovery_paged": discovery_paged, "partition_pages": partition_pages})


# --- history by key, exact distinct counts from parts (C1, C7, F5) ------------------


def _history_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events history saved by key in two appends, the later days last."""
    table, path = f"lakelens_history_{unique_suffix()}", scratch_dir(spark, "by-key")
    rows, half = events_history(spark, sf_dir), F.lit("2024-01-20").cast("timestamp_ntz")
    H.append_by_key(rows.where(F.col("last_updated") < half), table, path)
    H.append_by_key(rows.where(F.col("last_updated").isNull() | (F.col("last_updated") >= half)), table)
    return H.read_by_key(spark, table)


def history_by_key_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 from a history stored by key: no shuffle of the history."""
    return H.current(_history_by_key(spark, sf_dir)).select("source", "kind", "id", "content", "last_updated")


def history_by_key_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 from a history stored by key; catalog = every (event_type, user) pair seen in events."""
    catalog = events_history(spark, sf_dir).select("source", "id")
    return H.stale(catalog, H.current(_history_by_key(spark, sf_dir)), HISTORY_AS_OF, kind="metadata")


def profile_merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profiles merged from parts by a group, with the distinct integers counted exactly
    from words that were written and read back; estimates of other columns are left out."""
    out = None
    for table, group in (("orders", "o_orderstatus"), ("lineitem", "l_returnflag"), ("events", "event_type")):
        rows = read_table(spark, sf_dir, table)
        grouped = rows.withColumn("__grp", F.col(group))
        path = scratch_dir(spark, "words")
        DI.distinct_words(grouped, ["__grp"], table, rows.columns).write.parquet(path)
        merged = P.merge_partials(P.profile_partials(grouped, ["__grp"], table, columns=rows.columns))
        whole = DI.with_exact_distinct(merged, spark.read.parquet(path)).select(
            "table_name", "column_name", "row_count", "null_count",
            F.when(~F.col("distinct_is_approx"), F.col("distinct_count")).alias("distinct_count"), "distinct_is_approx")
        out = whole if out is None else out.unionByName(whole)
    return out


QUERIES.update({
    "history_by_key_latest": history_by_key_latest,
    "history_by_key_stale": history_by_key_stale,
    "profile_merge_exact": profile_merge_exact,
})
