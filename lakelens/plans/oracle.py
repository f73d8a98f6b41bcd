"""DuckDB SQL builders for the oracle side of the registered queries.

The driver's tables are fixed; their schemas are listed here once so the
oracle text can be generated per column without a Spark session.
"""

from __future__ import annotations

# Column names and Spark types of the driver's tables.
TABLE_SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
}

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

_CLASS = {"int": "integer", "bigint": "integer", "string": "string", "double": "float",
          "timestamp_ntz": "timestamp", "array<float>": "array"}
_LANE = {"int": "int", "bigint": "int", "double": "num", "string": "str", "timestamp_ntz": "ts"}
_LANE_SQL = {"int": "BIGINT", "num": "DOUBLE", "str": "VARCHAR", "ts": "TIMESTAMP"}


def zero_norm(x: str) -> str:
    """-0.0 reads as 0.0, as in the profile's float lanes."""
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def profile_select(table_label: str, source: str, columns: list[tuple[str, str]],
                   distinct: bool = True, with_distinct_cols: bool = True) -> str:
    """UNION ALL of one SELECT per column, profile schema column names."""
    parts = []
    for ordinal, (name, typ) in enumerate(columns, start=1):
        lane = _LANE.get(typ)
        cols = [
            f"{lit(table_label)} AS table_name",
            f"{lit(name)} AS column_name",
            f"CAST({ordinal} AS INTEGER) AS ordinal",
            f"{lit(_CLASS[typ])} AS data_type",
            f"{lit(typ)} AS original_type",
            "CAST(count(*) AS BIGINT) AS row_count",
            f"CAST(count(*) - count({name}) AS BIGINT) AS null_count",
        ]
        if with_distinct_cols:
            if distinct:
                cols += [f"CAST(count(DISTINCT {name}) AS BIGINT) AS distinct_count",
                         "FALSE AS distinct_is_approx"]
            else:
                cols += ["CAST(NULL AS BIGINT) AS distinct_count",
                         "CAST(NULL AS BOOLEAN) AS distinct_is_approx"]
        for b, fn in (("min", "min"), ("max", "max")):
            for ln, sqlt in _LANE_SQL.items():
                if ln == lane:
                    v = f"CAST({fn}({name}) AS {sqlt})"
                    cols.append(f"{zero_norm(v) if ln == 'num' else v} AS {b}_{ln}")
                else:
                    cols.append(f"CAST(NULL AS {sqlt}) AS {b}_{ln}")
        if typ == "string":
            cols += [f"round(avg(length({name})), 6) AS avg_len",
                     f"CAST(max(length({name})) AS BIGINT) AS max_len"]
        else:
            cols += ["CAST(NULL AS DOUBLE) AS avg_len", "CAST(NULL AS BIGINT) AS max_len"]
        # order the lane columns like the profile schema
        parts.append("SELECT " + ", ".join(_order(cols)) + f" FROM {source}")
    return "\nUNION ALL\n".join(parts)


_ORDER = ["table_name", "column_name", "ordinal", "data_type", "original_type", "row_count",
          "null_count", "distinct_count", "distinct_is_approx", "min_int", "max_int", "min_num",
          "max_num", "min_str", "max_str", "min_ts", "max_ts", "avg_len", "max_len"]


def _order(cols: list[str]) -> list[str]:
    def key(c: str) -> int:
        return _ORDER.index(c.rsplit(" AS ", 1)[1])
    return sorted(cols, key=key)


def table_profile_sql(table: str, distinct: bool = True) -> str:
    return profile_select(table, table, TABLE_SCHEMAS[table], distinct)


def hash_pred_sql(seed: int, percent: float, *keys: str) -> str:
    """SQL form of lakelens.functions.hashing.keep_fraction."""
    text = " || '|' || ".join([lit(str(seed))] + [f"coalesce('v' || CAST({k} AS VARCHAR), 'n')" for k in keys])
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < {float(percent) / 100.0!r}::DOUBLE"
