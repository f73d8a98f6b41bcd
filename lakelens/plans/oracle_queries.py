"""DuckDB oracle SQL for each registered query (same column names)."""

from __future__ import annotations

from lakelens.plans.oracle import (STAR_TABLES, TABLE_SCHEMAS, hash_pred_sql, lit, profile_select,
                                   table_profile_sql, zero_norm)

_NULLS_CTE = """(SELECT o_orderkey,
        nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
        CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS o_orderdate,
        CAST(NULL AS BIGINT) AS all_null
   FROM orders) AS orders_nulls"""

_NULLS_COLS = [("o_orderkey", "bigint"), ("o_orderpriority", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("all_null", "bigint")]


def _row_counts() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}"
        for t in TABLE_SCHEMAS)


def _string_lengths() -> str:
    parts = []
    for t, c in (("documents", "text"), ("part", "p_name")):
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                     f"CAST(count(*) AS BIGINT) AS row_count, round(avg(length({c})), 6) AS avg_len, "
                     f"CAST(max(length({c})) AS BIGINT) AS max_len FROM {t}")
    return "\nUNION ALL\n".join(parts)


ORACLE = {
    "table_row_counts": _row_counts(),
    "column_profile_lineitem": table_profile_sql("lineitem"),
    "column_profile_events": table_profile_sql("events"),
    "column_profile_with_nulls": profile_select("orders_nulls", _NULLS_CTE, _NULLS_COLS),
    "column_stats_single": """SELECT 'c_acctbal' AS column_name, CAST(count(*) AS BIGINT) AS row_count,
        CAST(count(*) - count(c_acctbal) AS BIGINT) AS null_count,
        CAST(count(DISTINCT c_acctbal) AS BIGINT) AS distinct_count,
        """ + zero_norm("min(c_acctbal)") + """ AS min_num, """ + zero_norm("max(c_acctbal)") + """ AS max_num FROM customer""",
    "profile_all_tables": "\nUNION ALL\n".join(table_profile_sql(t) for t in TABLE_SCHEMAS),
    "approx_distinct_check": """SELECT 'o_custkey' AS column_name,
        CAST(count(DISTINCT o_custkey) AS BIGINT) AS exact_distinct,
        TRUE AS within_5pct, TRUE AS sketch_within_5pct FROM orders""",
    "string_length_stats": _string_lengths(),
}


# --- sampling -----------------------------------------------------------------

ORACLE.update({
    "sample_bernoulli_hash": f"SELECT * FROM orders WHERE {hash_pred_sql(42, 10, 'o_orderkey')}",
    "sample_bernoulli_hash_limit": f"SELECT * FROM orders WHERE {hash_pred_sql(42, 10, 'o_orderkey')} "
                                   "ORDER BY o_orderkey LIMIT 50",
    "sample_system_blocks": f"SELECT * FROM events WHERE "
                            f"{hash_pred_sql(7, 20, 'CAST(floor(event_id / 500) AS BIGINT)')}",
    "sample_records": "SELECT o_orderkey, CAST(to_json(struct_pack(o_orderkey := o_orderkey, "
                      "o_custkey := o_custkey, o_orderstatus := o_orderstatus, "
                      "o_orderpriority := o_orderpriority)) AS VARCHAR) AS record FROM orders "
                      f"WHERE {hash_pred_sql(11, 5, 'o_orderkey')}",
})

# --- schema -------------------------------------------------------------------
# How the driver tables' types read in DuckDB, Spark and Arrow.
_SPARK_OF = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
             "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
_ARROW_OF = {"BIGINT": "int64", "INTEGER": "int32", "VARCHAR": "string", "DOUBLE": "double",
             "TIMESTAMP": "timestamp[us]", "FLOAT[]": "list<element: float>"}
_CLASS_OF = {"BIGINT": "integer", "INTEGER": "integer", "VARCHAR": "string", "DOUBLE": "float",
             "TIMESTAMP": "timestamp", "FLOAT[]": "array"}


def _case(mapping: dict[str, str], expr: str = "column_type") -> str:
    # TIMESTAMP_NS / _US / _MS (views over pandas or Arrow) read as TIMESTAMP
    norm = f"regexp_replace({expr}, '^TIMESTAMP_(NS|US|MS)$', 'TIMESTAMP')"
    return "CASE " + " ".join(f"WHEN {norm} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


_COLS_CTE = "\nUNION ALL\n".join(
    f"SELECT {lit(t)} AS table_name, CAST(row_number() OVER () AS INTEGER) AS ordinal, "
    f"column_name, column_type FROM (DESCRIBE {t})" for t in TABLE_SCHEMAS)

_ROWS_CTE = " UNION ALL ".join(f"SELECT {lit(t)} AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in TABLE_SCHEMAS)

ORACLE["schema_inventory"] = f"""WITH cols AS ({_COLS_CTE})
SELECT table_name, ordinal, column_name, {_case(_CLASS_OF)} AS data_type,
       {_case(_SPARK_OF)} AS original_type, TRUE AS nullable, ordinal AS file_ordinal, row_count
FROM cols JOIN ({_ROWS_CTE}) USING (table_name)"""

# The class of every spelling that the driver's tables have, dialect by dialect in the
# order below, worked out by hand from each source's substring rules.
_DIALECTS = ["generic_sql", "embedded", "warehouse", "lakehouse_sql", "lakehouse_catalog", "arrow_parquet", "arrow_delta"]
_CLASSES = {
    "bigint": "integer integer integer integer integer integer integer",
    "int": "integer integer integer integer integer integer integer",
    "integer": "integer integer integer integer integer integer integer",
    "int32": "integer integer integer integer integer integer integer",
    "int64": "integer integer integer integer integer integer integer",
    "string": "unknown string string string string string string",
    "varchar": "string string string unknown unknown unknown unknown",
    "double": "unknown float float float float unknown unknown",
    "timestamp": "timestamp timestamp timestamp timestamp timestamp unknown unknown",
    "timestamp_ntz": "timestamp timestamp timestamp timestamp timestamp unknown unknown",
    "timestamp[us]": "timestamp timestamp timestamp timestamp timestamp unknown unknown",
    "array<float>": "float float float float float float float",
    "float[]": "float float float float float float float",
    "list<element: float>": "float float float float float float float",
}
_EXPECTED = ", ".join(f"({lit(raw)}, {lit(d)}, {lit(c)})" for raw, of in _CLASSES.items() for d, c in zip(_DIALECTS, of.split(), strict=True))

ORACLE["normalize_types_all_dialects"] = f"""WITH cols AS ({_COLS_CTE}),
spelt AS (
  SELECT table_name, column_name, 'spark' AS spelling, {_case(_SPARK_OF)} AS raw_type FROM cols
  UNION ALL SELECT table_name, column_name, 'embedded',
                   regexp_replace(column_type, '^TIMESTAMP_(NS|US|MS)$', 'TIMESTAMP') FROM cols
  UNION ALL SELECT table_name, column_name, 'arrow', {_case(_ARROW_OF)} FROM cols),
expected(raw, dialect, normalized) AS (VALUES {_EXPECTED})
SELECT table_name, column_name, spelling, raw_type, dialect, normalized
FROM spelt JOIN expected ON raw = lower(raw_type)"""


def _key_sql(t: str, cols: list[str]) -> str:
    tup = cols[0] if len(cols) == 1 else "(" + ", ".join(cols) + ")"
    nulls = " OR ".join(f"{c} IS NULL" for c in cols)
    return (f"SELECT {lit(t)} AS table_name, {lit(','.join(cols))} AS key_columns, "
            f"CAST(count(*) AS BIGINT) AS row_count, "
            f"CAST(count(DISTINCT {tup}) FILTER (WHERE NOT ({nulls})) AS BIGINT) AS distinct_count, "
            f"CAST(count(*) FILTER (WHERE {nulls}) AS BIGINT) AS null_rows, "
            f"(count(*) FILTER (WHERE {nulls}) = 0 AND count(DISTINCT {tup}) = count(*)) AS is_key FROM {t}")


ORACLE["candidate_keys"] = "\nUNION ALL\n".join([
    _key_sql("customer", ["c_custkey"]), _key_sql("orders", ["o_orderkey"]),
    _key_sql("orders", ["o_custkey"]), _key_sql("part", ["p_partkey"]),
    _key_sql("lineitem", ["l_orderkey", "l_linenumber"]), _key_sql("lineitem", ["l_orderkey"])])


def _zn(x: str, typ: str) -> str:
    return zero_norm(x) if typ == "double" else x


def _describe_sql(t: str) -> str:
    parts = []
    for i, (c, typ) in enumerate(TABLE_SCHEMAS[t], start=1):
        cls = {"int": "integer", "bigint": "integer", "string": "string", "double": "float",
               "timestamp_ntz": "timestamp"}[typ]
        parts.append(
            f"SELECT {lit(t)} AS table_name, CAST({i} AS INTEGER) AS ordinal, {lit(c)} AS column_name, "
            f"{lit(cls)} AS type, {lit(typ)} AS original_type, "
            f"coalesce(CAST({_zn(f'min({c})', typ)} AS VARCHAR), '') AS min_value, "
            f"coalesce(CAST({_zn(f'max({c})', typ)} AS VARCHAR), '') AS max_value, "
            f"CAST(count(*) - count({c}) AS VARCHAR) AS null_count, "
            f"CAST(count(DISTINCT {c}) AS VARCHAR) AS distinct_count, "
            f"CAST(count(*) AS VARCHAR) AS row_count FROM {t}")
    return "\nUNION ALL\n".join(parts)


ORACLE["describe_report"] = _describe_sql("supplier")


# --- footers, drift, inventory, partitions, Delta ----------------------------------
def _bounds_sql(t: str, where: str = "", extra_rows: str = "CAST(count(*) AS BIGINT)") -> str:
    parts = []
    lane_sql = {"int": "BIGINT", "num": "DOUBLE", "str": "VARCHAR", "ts": "TIMESTAMP"}
    lane_of = {"int": "int", "bigint": "int", "double": "num", "string": "str", "timestamp_ntz": "ts"}
    for c, typ in TABLE_SCHEMAS[t]:
        lane = lane_of[typ]
        cols = [f"{lit(c)} AS column_name", f"{extra_rows} AS row_count",
                f"CAST(count(*) - count({c}) AS BIGINT) AS null_count"]
        for b in ("min", "max"):
            for ln, sqlt in lane_sql.items():
                v = f"CAST({b}({c}) AS {sqlt})" if ln == lane else f"CAST(NULL AS {sqlt})"
                if ln == lane == "num":
                    v = zero_norm(v)
                cols.append(f"{v} AS {b}_{ln}")
        parts.append("SELECT " + ", ".join(cols) + f" FROM {t} {where}")
    return "\nUNION ALL\n".join(parts)


ORACLE["footer_profile_orders"] = _bounds_sql("orders")

ORACLE["footer_pushdown_agg"] = "\nUNION ALL\n".join(
    f"SELECT {lit(c)} AS column_name, CAST(count(*) AS BIGINT) AS row_count, "
    + (f"CAST(min({c}) AS BIGINT) AS min_int, CAST(max({c}) AS BIGINT) AS max_int, "
       "CAST(NULL AS DOUBLE) AS min_num, CAST(NULL AS DOUBLE) AS max_num"
       if typ in ("int", "bigint") else
       "CAST(NULL AS BIGINT) AS min_int, CAST(NULL AS BIGINT) AS max_int, "
       f"{zero_norm(f'min({c})')} AS min_num, {zero_norm(f'max({c})')} AS max_num")
    + " FROM lineitem"
    for c, typ in TABLE_SCHEMAS["lineitem"] if typ in ("int", "bigint", "double"))

# The Arrow type names of the drift fixture's columns.
_ARROW_ORDERS = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "string",
                 "o_totalprice": "double", "o_orderdate": "timestamp[us]", "o_orderpriority": "string"}
ORACLE["schema_drift"] = "\nUNION ALL\n".join(
    [f"SELECT {lit(c)} AS column_name, {lit(a)} AS arrow_type, CAST(count(*) AS BIGINT) AS row_count, "
     f"FALSE AS conflict, TRUE AS in_all_files FROM orders" for c, a in _ARROW_ORDERS.items()
     if c != "o_custkey"]
    + ["SELECT 'o_custkey' AS column_name, 'int32' AS arrow_type, CAST(count(*) AS BIGINT) AS row_count, "
       "TRUE AS conflict, TRUE AS in_all_files FROM orders WHERE o_orderstatus = 'F'",
       "SELECT 'o_custkey', 'int64', CAST(count(*) AS BIGINT), TRUE, TRUE FROM orders "
       "WHERE o_orderstatus <> 'F'",
       "SELECT 'o_extra', 'double', CAST(count(*) AS BIGINT), FALSE, FALSE FROM orders "
       "WHERE o_orderstatus = 'P'"])

ORACLE["table_formats"] = """
SELECT 'tpch' AS database, 'orders' AS table_name, 'parquet' AS format, CAST(count(*) AS BIGINT) AS row_count FROM orders
UNION ALL SELECT 'tpch', 'lineitem', 'parquet', CAST(count(*) AS BIGINT) FROM lineitem
UNION ALL SELECT 'tpch', 'orders_delta', 'delta', CAST(count(*) AS BIGINT) FROM orders
UNION ALL SELECT 'raw', 'events_json', 'unknown', CAST(count(*) AS BIGINT) FROM events"""

ORACLE["partition_inventory"] = """
SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, CAST(1 AS INTEGER) AS depth,
       CAST(count(*) AS BIGINT) AS row_count FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'o_orderpriority', nullif(o_orderpriority, '5-LOW'), CAST(2 AS INTEGER), CAST(count(*) AS BIGINT)
FROM orders GROUP BY o_orderstatus, nullif(o_orderpriority, '5-LOW')"""

ORACLE["delta_log_stats"] = _bounds_sql("orders", "")
ORACLE["delta_snapshot"] = ("SELECT CAST(2 AS BIGINT) AS max_add_version, CAST(count(*) AS BIGINT) AS row_count "
                            "FROM orders")


# --- history, drift, metadata, partial merges ----------------------------------------
_HIST = """h AS (SELECT event_type AS source, 'table_' || CAST(user_id AS VARCHAR) AS id,
           CASE WHEN event_type = 'view' THEN 'discovery' ELSE 'metadata' END AS kind,
           props AS content, ts AS last_updated, value < 2.0 AS deleted FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY source, kind, id
                                  ORDER BY last_updated DESC, deleted DESC, content DESC) AS rn FROM h),
cur AS (SELECT source, kind, id, content, last_updated FROM r WHERE rn = 1 AND NOT deleted),
fresh AS (SELECT * FROM cur WHERE last_updated >= TIMESTAMP '2024-01-31 00:00:00' -
          CASE WHEN kind = 'discovery' THEN INTERVAL 3600 SECOND ELSE INTERVAL 86400 SECOND END)"""

ORACLE["history_latest"] = f"WITH {_HIST} SELECT * FROM cur"
ORACLE["history_fresh"] = f"WITH {_HIST} SELECT * FROM fresh"
ORACLE["history_stale"] = f"""WITH {_HIST}
SELECT DISTINCT event_type AS source, 'table_' || CAST(user_id AS VARCHAR) AS id FROM events e
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.kind = 'metadata' AND f.source = e.event_type
                  AND f.id = 'table_' || CAST(e.user_id AS VARCHAR))"""

_P1 = profile_select("orders", "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00') AS o",
                     TABLE_SCHEMAS["orders"])
_P2 = table_profile_sql("orders")


def _chg(b: str) -> str:
    e = " OR ".join(f"{b}_{ln} IS DISTINCT FROM lag({b}_{ln}) OVER w" for ln in ("int", "num", "str", "ts"))
    return f"CASE WHEN lag(run_id) OVER w IS NULL THEN NULL ELSE ({e}) END AS {b}_changed"


ORACLE["profile_drift"] = f"""WITH runs AS (
  SELECT 1 AS run_id, * FROM ({_P1}) UNION ALL SELECT 2 AS run_id, * FROM ({_P2}))
SELECT table_name, column_name, run_id, row_count, lag(row_count) OVER w AS prev_row_count,
       null_count, lag(null_count) OVER w AS prev_null_count,
       distinct_count, lag(distinct_count) OVER w AS prev_distinct_count,
       {_chg('min')}, {_chg('max')}
FROM runs WINDOW w AS (PARTITION BY table_name, column_name ORDER BY run_id)"""


def _meta_sql() -> str:
    parts = []
    cls = {"int": "integer", "bigint": "integer", "string": "string", "double": "float",
           "timestamp_ntz": "timestamp"}
    for c, typ in TABLE_SCHEMAS["orders"]:
        parts.append(
            f"SELECT 'tpch.orders' AS id, 'orders' AS name, 'tpch' AS database, "
            f"CAST(count(*) AS BIGINT) AS row_count, {lit(c)} AS column_name, {lit(cls[typ])} AS data_type, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, "
            f"CAST({_zn(f'min({c})', typ)} AS VARCHAR) AS min_value, "
            f"CAST({_zn(f'max({c})', typ)} AS VARCHAR) AS max_value FROM orders")
    return "\nUNION ALL\n".join(parts)


ORACLE["full_metadata_json"] = _meta_sql()
ORACLE["profile_merge_partials"] = profile_select("orders", "orders", TABLE_SCHEMAS["orders"],
                                                  with_distinct_cols=False)
ORACLE["profile_by_file"] = ORACLE["profile_merge_partials"]


# --- sinks, streams, ladders ---------------------------------------------------------
ORACLE["export_register_roundtrip"] = "\nUNION ALL\n".join(
    f"SELECT {lit(t)} AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST(sum({k}) AS BIGINT) AS key_sum FROM {t}"
    for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("orders", "o_orderkey"),
                 ("lineitem", "l_orderkey")))
ORACLE["stream_profile"] = profile_select("events", "events", TABLE_SCHEMAS["events"], with_distinct_cols=False)
ORACLE["row_count_ladder_footers"] = "SELECT CAST(count(*) AS BIGINT) AS row_count, 'footer' AS source FROM orders"
ORACLE["lake_databases"] = """SELECT 'raw' AS name, CAST(count(*) AS BIGINT) AS row_count, CAST(1 AS BIGINT) AS table_count FROM events
UNION ALL SELECT 'tpch', CAST((SELECT 2 * count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS BIGINT), 3"""


# --- the driver's own files and text tables ---------------------------------------
def _given_footer_sql() -> str:
    parts = []
    for t in STAR_TABLES:
        for part in _bounds_sql(t).split("\nUNION ALL\n"):
            parts.append(part.replace("SELECT ", f"SELECT {lit(t)} AS table_name, ", 1))
    other = ("CAST(NULL AS DOUBLE) AS min_num, CAST(NULL AS DOUBLE) AS max_num, "
             "CAST(NULL AS VARCHAR) AS min_str, CAST(NULL AS VARCHAR) AS max_str, "
             "CAST(NULL AS TIMESTAMP) AS min_ts, CAST(NULL AS TIMESTAMP) AS max_ts")
    # the writer leaves bounds of values over a few KB out: documents.text and pages.html
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        for (c, _), part in zip(TABLE_SCHEMAS[t], _bounds_sql(t).split("\nUNION ALL\n")):
            if (t, c) in (("documents", "text"), ("pages", "html")):
                part = part.replace(f"CAST(min({c}) AS VARCHAR)", "CAST(NULL AS VARCHAR)").replace(
                    f"CAST(max({c}) AS VARCHAR)", "CAST(NULL AS VARCHAR)")
            parts.append(part.replace("SELECT ", f"SELECT {lit(t)} AS table_name, ", 1))
    for c in ("vec_id", "label"):
        parts.append(
            f"SELECT 'embeddings' AS table_name, {lit(c)} AS column_name, CAST(count(*) AS BIGINT) AS row_count, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(min({c}) AS BIGINT) AS min_int, "
            f"CAST(max({c}) AS BIGINT) AS max_int, {other} FROM embeddings")
    parts.append(
        "SELECT 'embeddings' AS table_name, 'embedding.list.element' AS column_name, "
        "(SELECT CAST(count(*) AS BIGINT) FROM embeddings) AS row_count, CAST(0 AS BIGINT) AS null_count, "
        "CAST(NULL AS BIGINT) AS min_int, CAST(NULL AS BIGINT) AS max_int, "
        f"{zero_norm('CAST(min(e) AS DOUBLE)')} AS min_num, "
        f"{zero_norm('CAST(max(e) AS DOUBLE)')} AS max_num, CAST(NULL AS VARCHAR) AS min_str, CAST(NULL AS VARCHAR) AS max_str, "
        "CAST(NULL AS TIMESTAMP) AS min_ts, CAST(NULL AS TIMESTAMP) AS max_ts "
        "FROM (SELECT unnest(embedding) AS e FROM embeddings)")
    return "\nUNION ALL BY NAME\n".join(parts)


ORACLE["footer_stats_given_tables"] = _given_footer_sql()
ORACLE["profile_text_tables"] = "\nUNION ALL\n".join(
    table_profile_sql(t) for t in ["documents", "pages", "conversations", "benchmark", "labels", "embeddings"])

ORACLE["column_profile_lineitem_approx"] = profile_select("lineitem", "lineitem", TABLE_SCHEMAS["lineitem"],
                                                          with_distinct_cols=False)

ORACLE["history_compacted"] = ORACLE["history_latest"]
# The tables whose records are read through the history, with their keys.
_RECORDS = {"region": "r_regionkey", "supplier": "s_suppkey", "lineitem": "l_orderkey,l_linenumber"}
ORACLE["read_through_records"] = "\nUNION ALL\n".join(
    f"SELECT {lit('tpch.' + t)} AS id, 'tpch' AS database, {lit(keys)} AS primary_keys, CAST(count(*) AS BIGINT) AS row_count, "
    f"TRUE AS size_known, CAST(3 AS BIGINT) AS refreshed, {lit(c)} AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    + (f"CAST(max(length({c})) AS BIGINT)" if typ == "string" else "CAST(NULL AS BIGINT)") + f" AS max_len FROM {t}"
    for t, keys in _RECORDS.items() for c, typ in TABLE_SCHEMAS[t])
ORACLE["decimal_partials"] = """SELECT 'price' AS column_name, CAST(count(*) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS null_count,
       CAST(min(CAST(o_totalprice AS DECIMAL(20,2))) AS VARCHAR) AS min_value,
       CAST(max(CAST(o_totalprice AS DECIMAL(20,2))) AS VARCHAR) AS max_value FROM orders"""
ORACLE["sample_hash_rare"] = f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {hash_pred_sql(42, 0.05, 'l_orderkey', 'l_linenumber')}"
ORACLE["lake_directories"] = """WITH o AS (SELECT CAST(count(*) AS BIGINT) AS n FROM orders), l AS (SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem)
SELECT 'raw' AS name, CAST(NULL AS BIGINT) AS parquet_rows UNION ALL SELECT 'raw/events_json', NULL
UNION ALL SELECT 'tpch', 2 * o.n + l.n FROM o, l UNION ALL SELECT 'tpch/lineitem', n FROM l
UNION ALL SELECT 'tpch/orders', n FROM o UNION ALL SELECT 'tpch/orders_delta', n FROM o
UNION ALL SELECT 'tpch/orders_delta/o_orderstatus=' || o_orderstatus, CAST(count(*) AS BIGINT) FROM orders GROUP BY o_orderstatus"""


def _per_group_sql() -> str:
    parts = []
    cols = TABLE_SCHEMAS["orders"]
    for ordinal, (c, typ) in enumerate(cols, start=1):
        if c == "o_orderstatus":
            continue
        one = profile_select("orders", "orders", [(c, typ)], with_distinct_cols=False)
        one = one.replace("CAST(1 AS INTEGER) AS ordinal", f"CAST({ordinal} AS INTEGER) AS ordinal")
        parts.append(one.replace("SELECT ", "SELECT o_orderstatus, ", 1) + " GROUP BY o_orderstatus")
    return "\nUNION ALL\n".join(parts)


ORACLE["profile_per_partition"] = _per_group_sql()

_DELTA_COLS = [(c, t) for c, t in TABLE_SCHEMAS["orders"] if c != "o_orderstatus"] + [("o_orderstatus", "string")]
ORACLE["delta_profile_v1"] = profile_select(
    "orders_delta", "(SELECT * FROM orders WHERE o_orderstatus = 'O') AS o", _DELTA_COLS)

ORACLE["discover_tables"] = "\nUNION ALL\n".join(
    f"SELECT 'dt_{t}' AS name, 'view' AS type, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in TABLE_SCHEMAS)

_ORDERS = TABLE_SCHEMAS["orders"]
ORACLE["profile_refreshed"] = profile_select(
    "orders", """(SELECT * REPLACE (CASE WHEN o_orderkey % 6 = 3 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice),
                  CAST(o_orderkey % 6 AS INTEGER) AS bucket FROM orders) AS o""", [*_ORDERS, ("bucket", "int")], with_distinct_cols=False)
ORACLE["drifted_profile"] = profile_select(
    "orders_drift", "(SELECT *, CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 2 END AS o_extra FROM orders) AS o",
    [*_ORDERS, ("o_extra", "double")])
ORACLE["mixed_profile"] = profile_select(
    "orders_mixed", """(SELECT * REPLACE (CAST(o_custkey AS VARCHAR) AS o_custkey,
                  CASE WHEN o_orderstatus = 'O' THEN CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
                  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority) FROM orders) AS o""",
    [(c, "string" if c == "o_custkey" else t) for c, t in _ORDERS])
ORACLE["sample_system_partitions"] = ("SELECT *, CAST(event_id % 64 AS INTEGER) AS block FROM events WHERE "
                                      + hash_pred_sql(7, 20, "CAST(event_id % 64 AS INTEGER)"))
ORACLE["row_count_ladder_delta"] = "SELECT CAST(count(*) AS BIGINT) AS row_count, 'footer' AS source FROM orders WHERE o_orderstatus = 'O'"
ORACLE["footer_stats_delta"] = "\nUNION ALL\n".join(
    part for part in _bounds_sql("orders", "WHERE o_orderstatus = 'O'").split("\nUNION ALL\n") if "'o_orderstatus' AS column_name" not in part)
ORACLE["discovery_paged"] = "SELECT c_name AS name, c_mktsegment AS type FROM customer"
ORACLE["partition_pages"] = ORACLE["partition_inventory"]
ORACLE["history_by_key_latest"] = ORACLE["history_latest"]
ORACLE["history_by_key_stale"] = ORACLE["history_stale"]
ORACLE["profile_merge_exact"] = "\nUNION ALL\n".join(
    f"SELECT {lit(t)} AS table_name, {lit(c)} AS column_name, CAST(count(*) AS BIGINT) AS row_count, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    + (f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, FALSE" if typ in ("int", "bigint")
       else "CAST(NULL AS BIGINT) AS distinct_count, TRUE") + f" AS distinct_is_approx FROM {t}"
    for t in ("orders", "lineitem", "events") for c, typ in TABLE_SCHEMAS[t])
