"""Column statistics and whole-table profiles.

Two tiers:

* cheap tier - row count, null count, typed min/max, string lengths and
  (optionally) an HLL distinct estimate for every column in ONE aggregate
  over ONE scan.  Global aggregates combine map-side, so a task ships one
  partial row and a hot value cannot skew anything.
* exact-distinct tier (opt-in) - a narrow unpivot of (column, typed key)
  rows, de-duplicated map-side before the shuffle and counted per column.
  It is kept out of the cheap aggregate so string min/max stay in a
  key-less aggregate and never force a sort over expanded rows.  Wide tables
  run in column batches so each scan prunes to the batch's columns.

Plans are written as SQL expression text (one ``selectExpr`` per step):
a profile of N columns costs a handful of driver-to-JVM calls instead of
one per literal, cast and alias.  The wide one-row results become one row
per column with ``inline`` on the one-row frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.decimals import decimal_bound_sql
from lakelens.functions.literals import literal_rows
from lakelens.functions.types import canonical_class
from lakelens.model import PROFILE_COLUMNS

DEFAULT_BATCH = 32
DEFAULT_RSD = 0.01
DEFAULT_LG_K = 12

LANE_SQL = {"int": "BIGINT", "num": "DOUBLE", "str": "STRING", "ts": "TIMESTAMP_NTZ"}
LANE_COLUMNS = ("min_int", "max_int", "min_num", "max_num", "min_str", "max_str", "min_ts", "max_ts")


def quote(name: str) -> str:
    """Backtick-quote a column name (dots, spaces and backticks are legal)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def sql_str(s: str | None) -> str:
    """A SQL string literal (or NULL)."""
    if s is None:
        return "CAST(NULL AS STRING)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lane_of(dt: T.DataType) -> str | None:
    """Which typed lane holds min/max for a type; None = no min/max."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "num"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "ts"
    return None


def has_length(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType, T.BinaryType))


def _has_variant(dt: T.DataType) -> bool:
    return "variant" in dt.simpleString()


def _orderable(dt: T.DataType) -> bool:
    return not isinstance(dt, T.MapType) and not (
        isinstance(dt, T.ArrayType) and not _orderable(dt.elementType))


def distinct_input_sql(q: str, dt: T.DataType) -> str:
    """Value fed to distinct counting; maps are not groupable, so their
    entries are counted as a key-sorted array instead; variants (not
    comparable) by their JSON text."""
    if _has_variant(dt):
        return f"to_json({q})"
    if isinstance(dt, T.MapType):
        return f"array_sort(map_entries({q}))" if _orderable(dt.valueType) else f"to_json({q})"
    return q


def distinct_input(c: Column, dt: T.DataType) -> Column:
    """Column form of ``distinct_input_sql`` for callers holding Columns."""
    if _has_variant(dt):
        return F.to_json(c)
    if isinstance(dt, T.MapType):
        return F.array_sort(F.map_entries(c)) if _orderable(dt.valueType) else F.to_json(c)
    return c


def sketch_input_sql(q: str, dt: T.DataType) -> str:
    """HLL sketches accept int, bigint, string and binary only; other types
    enter as their 64-bit hash (collisions are negligible next to the
    sketch's own error).  Floats are normalized first (-0.0 = 0.0)."""
    if isinstance(dt, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return q
    if isinstance(dt, (T.ByteType, T.ShortType)):
        return f"CAST({q} AS INT)"
    v = q
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        v = f"CASE WHEN {q} = 0 THEN CAST(0 AS {dt.simpleString().upper()}) ELSE {q} END"
    if isinstance(dt, T.MapType) or _has_variant(dt):
        v = f"to_json({q})"
    return f"CASE WHEN {q} IS NOT NULL THEN xxhash64({v}) END"


def sketch_input(c: Column, dt: T.DataType) -> Column:
    """Column form of ``sketch_input_sql``."""
    if isinstance(dt, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return c
    if isinstance(dt, (T.ByteType, T.ShortType)):
        return c.cast("int")
    v = c
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        v = F.when(c == 0, F.lit(0.0).cast(dt)).otherwise(c)
    if isinstance(dt, T.MapType) or _has_variant(dt):
        v = F.to_json(c)
    return F.when(c.isNotNull(), F.xxhash64(v))


def lg_k_for(rsd: float) -> int:
    """HLL register count for a relative standard error: 1.04 / sqrt(2^k)."""
    k = math.ceil(math.log2((1.04 / rsd) ** 2))
    if not 4 <= k <= 21:
        raise ValueError(f"rsd must lie between {1.04 / 2 ** 10.5:.6f} and {1.04 / 2 ** 1.5:.2f}, got {rsd}")
    return k


def _pos(i: int) -> str:
    """Positional name of column i (1-based) after ``_positional``."""
    return f"`_c{i}`"


def _positional(df: DataFrame) -> DataFrame:
    """The same rows with columns renamed ``_c1.._cN``: duplicate or awkward
    names can never clash in generated SQL; original names stay in the
    output as literals."""
    return df.toDF(*[f"_c{i}" for i in range(1, len(df.columns) + 1)])


def _fields(df: DataFrame, columns: Iterable[str] | None) -> list[tuple[int, T.StructField]]:
    fields = list(enumerate(df.schema.fields, start=1))
    if columns is None:
        return fields
    by_name = {f.name: (i, f) for i, f in fields}
    missing = [c for c in columns if c not in by_name]
    if missing:
        raise ValueError(f"unknown column(s): {missing}")
    return [by_name[c] for c in columns]


# --- cheap tier ------------------------------------------------------------------------


def _approx_sql(q: str, dt: T.DataType, rsd: float, impl: str) -> str:
    if impl == "hllpp":
        return f"approx_count_distinct({distinct_input_sql(q, dt)}, {rsd!r})"
    return f"hll_sketch_estimate(hll_sketch_agg({sketch_input_sql(q, dt)}, {lg_k_for(rsd)}))"


def _cheap_aggs(fields, distinct: str, rsd: float, impl: str = "sketch") -> list[str]:
    aggs = ["count(1) AS `__rows`"]
    for i, f in fields:
        q, dt = _pos(i), f.dataType
        aggs.append(f"count({q}) AS nn{i}")
        if lane_of(dt) is not None:
            aggs += [f"min({q}) AS mn{i}", f"max({q}) AS mx{i}"]
        if has_length(dt):
            aggs += [f"avg(length({q})) AS al{i}", f"CAST(max(length({q})) AS BIGINT) AS ml{i}"]
        if distinct == "approx":
            aggs.append(f"{_approx_sql(q, dt, rsd, impl)} AS d{i}")
    return aggs


def _lane_sql(f: T.StructField, i: int, mn: str | None = None, mx: str | None = None) -> dict[str, str]:
    """min/max typed lanes of column i as SQL over the aggregate's outputs."""
    out = {c: f"CAST(NULL AS {LANE_SQL[c.split('_')[1]]})" for c in LANE_COLUMNS}
    lane = lane_of(f.dataType)
    if lane is None:
        return out
    for b, src in (("min", mn or f"mn{i}"), ("max", mx or f"mx{i}")):
        if isinstance(f.dataType, T.DecimalType):
            out[f"{b}_num"] = f"CAST({src} AS DOUBLE)"
            out[f"{b}_str"] = f"CAST({src} AS STRING)"
        elif lane == "num":
            out[f"{b}_num"] = zero_norm_sql(f"CAST({src} AS DOUBLE)")
        else:
            out[f"{b}_{lane}"] = f"CAST({src} AS {LANE_SQL[lane]})"
    return out


def zero_norm_sql(x: str) -> str:
    """-0.0 and 0.0 are one value: bounds report 0.0, whichever the engine's
    aggregate happened to keep (distinct counting already merges them)."""
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END"


def _named_struct(pairs: list[tuple[str, str]]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ")"


def _cheap_rows(df: DataFrame, fields, table_name: str, distinct: str, rsd: float,
                impl: str = "sketch") -> DataFrame:
    wide = _positional(df).selectExpr(*_cheap_aggs(fields, distinct, rsd, impl))
    structs = []
    for i, f in fields:
        lanes = _lane_sql(f, i)
        if has_length(f.dataType):
            avg_len, max_len = f"round(al{i}, 6)", f"ml{i}"
        else:
            avg_len, max_len = "CAST(NULL AS DOUBLE)", "CAST(NULL AS BIGINT)"
        if distinct == "approx":
            dcount, approx = f"CAST(d{i} AS BIGINT)", "true"
        else:
            dcount, approx = "CAST(NULL AS BIGINT)", "CAST(NULL AS BOOLEAN)"
        structs.append(_named_struct([
            ("table_name", sql_str(table_name)),
            ("column_name", sql_str(f.name)),
            ("ordinal", f"CAST({i} AS INT)"),
            ("data_type", sql_str(canonical_class(f.dataType))),
            ("original_type", sql_str(f.dataType.simpleString())),
            ("row_count", "CAST(`__rows` AS BIGINT)"),
            ("null_count", f"CAST(`__rows` - nn{i} AS BIGINT)"),
            ("distinct_count", dcount),
            ("distinct_is_approx", approx),
            *[(k, lanes[k]) for k in LANE_COLUMNS],
            ("avg_len", avg_len),
            ("max_len", max_len),
        ]))
    return wide.selectExpr(f"inline(array({', '.join(structs)}))")


# --- exact-distinct tier -----------------------------------------------------------------

# Key lanes of the exact-distinct unpivot: every atomic type maps injectively
# into one of them, so (ordinal, lanes) equality is value equality.
KEY_LANES = {"k_long": "BIGINT", "k_double": "DOUBLE", "k_str": "STRING",
             "k_ts": "TIMESTAMP_NTZ", "k_dig": "BINARY"}


def _key_lane(q: str, dt: T.DataType) -> tuple[str, str] | None:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "k_long", f"CAST({q} AS BIGINT)"
    if isinstance(dt, T.TimestampType):
        return "k_long", f"unix_micros({q})"        # instants, no DST folding
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "k_double", f"CAST({q} AS DOUBLE)"   # grouping normalizes NaN and -0.0
    if isinstance(dt, T.DecimalType):
        return "k_str", f"CAST({q} AS STRING)"      # decimals print at their fixed scale
    if has_length(dt):
        # every string and binary by the SHA-256 of the whole value: the shuffle carries
        # 32 bytes a value, and the count is exact up to SHA-256 collisions
        return "k_dig", f"unhex(sha2({q}, 256))"
    if isinstance(dt, (T.TimestampNTZType, T.DateType)):
        return "k_ts", f"CAST({q} AS TIMESTAMP_NTZ)"
    return None


def _key_counts(df: DataFrame, atomic) -> DataFrame:
    """(ordinal, key lanes..., n): rows per distinct (column, value) of the
    atomic columns; a column's NULLs form one all-NULL group.  One scan, the
    unpivot counted map-side before the shuffle."""
    structs = []
    for i, f in atomic:
        vals = dict([_key_lane(_pos(i), f.dataType)])
        structs.append(_named_struct(
            [("ordinal", f"CAST({i} AS INT)")]
            + [(k, vals.get(k, f"CAST(NULL AS {t})")) for k, t in KEY_LANES.items()]))
    rows = _positional(df).selectExpr(f"inline(array({', '.join(structs)}))")
    return rows.groupBy("ordinal", *KEY_LANES).agg(F.count(F.lit(1)).alias("n"))


_NONNULL = " OR ".join(f"{k} IS NOT NULL" for k in KEY_LANES)


def _per_ordinal(key_counts: DataFrame) -> DataFrame:
    """Column-level facts from the key counts: rows, non-NULL rows, distinct
    values and min/max of the fixed-width lanes (a hash aggregate: no string
    buffers)."""
    return key_counts.groupBy("ordinal").agg(*[F.expr(e) for e in (
        "CAST(sum(n) AS BIGINT) AS rows",
        f"CAST(sum(CASE WHEN {_NONNULL} THEN n ELSE 0 END) AS BIGINT) AS nn",
        f"CAST(count(CASE WHEN {_NONNULL} THEN 1 END) AS BIGINT) AS d",
        "min(k_long) AS mn_l", "max(k_long) AS mx_l",
        "min(k_double) AS mn_d", "max(k_double) AS mx_d",
        "min(k_ts) AS mn_t", "max(k_ts) AS mx_t")])


def exact_distinct_counts(df: DataFrame, fields) -> DataFrame:
    """(ordinal, distinct_count) for the given fields; a column with no
    non-NULL value may be absent (its count is 0).

    Atomic columns are unpivoted into narrow rows (ordinal + one key lane
    per type), counted per distinct key (map-side first) and then per
    ordinal: linear in the number of columns per input row, where
    Catalyst's Expand for several ``count(DISTINCT)`` is quadratic (every
    copy carries every column).  Strings and binaries are keyed by the SHA-256
    of the whole value, so the count is exact up to SHA-256 collisions.
    Nested columns use ``count(DISTINCT)``.
    """
    atomic, nested = [], []
    for i, f in fields:
        (atomic if _key_lane(_pos(i), f.dataType) is not None else nested).append((i, f))
    parts = []
    if atomic:
        parts.append(_key_counts(df, atomic).where(_NONNULL)
                     .groupBy("ordinal").agg(F.count(F.lit(1)).cast("long").alias("distinct_count")))
    if nested:
        parts.append(_nested_distinct(df, nested))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nested_distinct(df: DataFrame, nested) -> DataFrame:
    wide = _positional(df).selectExpr(*[
        f"count(DISTINCT {distinct_input_sql(_pos(i), f.dataType)}) AS d{i}" for i, f in nested])
    return wide.selectExpr("inline(array(" + ", ".join(
        _named_struct([("ordinal", f"CAST({i} AS INT)"), ("distinct_count", f"CAST(d{i} AS BIGINT)")])
        for i, f in nested) + "))")


# Columns whose cheap statistics follow from their exact keys: integers,
# booleans, floats, dates and timestamps (the key lane holds the value).
def _derivable_kind(dt: T.DataType) -> str | None:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "num"
    if isinstance(dt, T.TimestampType):
        return "ltz"
    if isinstance(dt, (T.TimestampNTZType, T.DateType)):
        return "ts"
    return None


def _exact_batch(df: DataFrame, batch, table_name: str, rsd: float, impl: str) -> DataFrame:
    """Exact profile of one column batch.

    The key counts are computed once and consumed once: integer/float/date/
    timestamp columns take every statistic from them (one scan for those
    columns); the cheap aggregate scans only the columns that need raw
    values (strings, binaries, decimals, nested) and takes just the
    distinct count from them.  Both kinds of row are stacked and joined once
    to the per-column facts (one row per column: broadcast).
    """
    spark = df.sparkSession
    atomic = [(i, f) for i, f in batch if _key_lane(_pos(i), f.dataType) is not None]
    nested = [(i, f) for i, f in batch if _key_lane(_pos(i), f.dataType) is None]
    derivable = [(i, f) for i, f in atomic if _derivable_kind(f.dataType) is not None]
    dset = {i for i, _ in derivable}
    other = [(i, f) for i, f in batch if i not in dset]

    facts = []
    if atomic:
        facts.append(_per_ordinal(_key_counts(df, atomic)))
    if nested:
        facts.append(_nested_distinct(df, nested).selectExpr(
            "ordinal", "CAST(NULL AS BIGINT) AS rows", "CAST(NULL AS BIGINT) AS nn", "distinct_count AS d",
            "CAST(NULL AS BIGINT) AS mn_l", "CAST(NULL AS BIGINT) AS mx_l",
            "CAST(NULL AS DOUBLE) AS mn_d", "CAST(NULL AS DOUBLE) AS mx_d",
            "CAST(NULL AS TIMESTAMP_NTZ) AS mn_t", "CAST(NULL AS TIMESTAMP_NTZ) AS mx_t"))
    fact = facts[0]
    for x in facts[1:]:
        fact = fact.unionByName(x)

    base = []
    if other:
        base.append(_cheap_rows(df, other, table_name, "none", rsd, impl)
                    .selectExpr(*PROFILE_COLUMNS, "CAST(NULL AS STRING) AS kind"))
    if derivable:
        rows = [(table_name, f.name, i, canonical_class(f.dataType), f.dataType.simpleString(),
                 _derivable_kind(f.dataType)) for i, f in derivable]
        meta = literal_rows(spark, rows, [("table_name", "STRING"), ("column_name", "STRING"), ("ordinal", "INT"),
                                          ("data_type", "STRING"), ("original_type", "STRING"), ("kind", "STRING")])
        base.append(meta.selectExpr(
            "table_name", "column_name", "ordinal", "data_type", "original_type",
            *[f"CAST(NULL AS {t}) AS {c}" for c, t in (
                ("row_count", "BIGINT"), ("null_count", "BIGINT"), ("distinct_count", "BIGINT"),
                ("distinct_is_approx", "BOOLEAN"), ("min_int", "BIGINT"), ("max_int", "BIGINT"),
                ("min_num", "DOUBLE"), ("max_num", "DOUBLE"), ("min_str", "STRING"), ("max_str", "STRING"),
                ("min_ts", "TIMESTAMP_NTZ"), ("max_ts", "TIMESTAMP_NTZ"), ("avg_len", "DOUBLE"),
                ("max_len", "BIGINT"))],
            "kind"))
    stacked = base[0]
    for x in base[1:]:
        stacked = stacked.unionByName(x)
    fact = F.broadcast(fact)  # one row per column of the batch
    j = stacked.join(fact, "ordinal", "left")
    ltz = "CAST(timestamp_micros({}) AS TIMESTAMP_NTZ)"

    def pick(cheap: str, derived: str) -> str:
        return f"CASE WHEN kind IS NULL THEN {cheap} ELSE {derived} END"

    return j.selectExpr(
        "table_name", "column_name", "ordinal", "data_type", "original_type",
        pick("row_count", "coalesce(rows, CAST(0 AS BIGINT))") + " AS row_count",
        pick("null_count", "coalesce(rows, CAST(0 AS BIGINT)) - coalesce(nn, CAST(0 AS BIGINT))") + " AS null_count",
        "coalesce(d, CAST(0 AS BIGINT)) AS distinct_count",
        "false AS distinct_is_approx",
        pick("min_int", "CASE WHEN kind = 'int' THEN mn_l END") + " AS min_int",
        pick("max_int", "CASE WHEN kind = 'int' THEN mx_l END") + " AS max_int",
        pick("min_num", f"CASE WHEN kind = 'num' THEN {zero_norm_sql('mn_d')} END") + " AS min_num",
        pick("max_num", f"CASE WHEN kind = 'num' THEN {zero_norm_sql('mx_d')} END") + " AS max_num",
        "min_str", "max_str",
        pick("min_ts", f"CASE WHEN kind = 'ltz' THEN {ltz.format('mn_l')} WHEN kind = 'ts' THEN mn_t END") + " AS min_ts",
        pick("max_ts", f"CASE WHEN kind = 'ltz' THEN {ltz.format('mx_l')} WHEN kind = 'ts' THEN mx_t END") + " AS max_ts",
        "avg_len", "max_len")


# --- public API ----------------------------------------------------------------------------


def profile(
    df: DataFrame,
    table_name: str = "table",
    distinct: str = "approx",
    rsd: float = DEFAULT_RSD,
    columns: Iterable[str] | None = None,
    batch_size: int = DEFAULT_BATCH,
    approx_impl: str = "sketch",
) -> DataFrame:
    """One row per column with the fixed profile schema.

    ``distinct``: "approx" (default: HLL sketches in the cheap aggregate,
    ``rsd`` relative error - one job, one scan), "exact" (opt-in: counted
    keys per column; integer/float/date/timestamp columns are profiled from
    their keys alone, the cheap aggregate scans only the other columns) or
    "none".
    ``approx_impl``: "sketch" (DataSketches HLL, fast and mergeable) or
    "hllpp" (Spark's HyperLogLog++ ``approx_count_distinct``).
    """
    if distinct not in ("exact", "approx", "none"):
        raise ValueError("distinct must be 'exact', 'approx' or 'none'")
    if approx_impl not in ("sketch", "hllpp"):
        raise ValueError("approx_impl must be 'sketch' or 'hllpp'")
    fields = _fields(df, list(columns) if columns is not None else None)
    if not fields:
        raise ValueError("profile needs at least one column")
    parts = []
    for start in range(0, len(fields), batch_size):
        batch = fields[start:start + batch_size]
        if distinct == "exact":
            parts.append(_exact_batch(df, batch, table_name, rsd, approx_impl))
        else:
            parts.append(_cheap_rows(df, batch, table_name, distinct, rsd, approx_impl).select(*PROFILE_COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_tables(tables: Mapping[str, DataFrame], out_path: str | None = None,
                   chunk: int = 64, **kwargs) -> DataFrame:
    """Profiles of several tables stacked, keyed by table_name.

    With ``out_path`` the profiles are written ``chunk`` tables per job, each
    chunk over its own directory, and read back: a catalog of thousands of
    tables never becomes one giant plan, a retry replaces what it wrote
    before, and the result has no lineage back to the tables.
    """
    if not tables:
        raise ValueError("no tables given")
    names = list(tables)
    if out_path is None:
        parts = _build_profiles(tables, names, kwargs)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    spark = next(iter(tables.values())).sparkSession
    for start in range(0, len(names), chunk):
        built = _build_profiles(tables, names[start:start + chunk], kwargs)
        part = built[0]
        for p in built[1:]:
            part = part.unionByName(p)
        part.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/chunk={start // chunk}")
    return spark.read.parquet(*[f"{out_path.rstrip('/')}/chunk={i}" for i in range(-(-len(names) // chunk))])


def _build_profiles(tables: Mapping[str, DataFrame], names: list[str], kwargs: dict) -> list[DataFrame]:
    """Profile plans of several tables, built from a few driver threads
    (building is driver-to-JVM round trips; the jobs run when executed)."""
    from concurrent.futures import ThreadPoolExecutor

    if len(names) <= 1:
        return [profile(tables[n], table_name=n, **kwargs) for n in names]
    with ThreadPoolExecutor(max_workers=min(8, len(names))) as pool:
        return list(pool.map(lambda n: profile(tables[n], table_name=n, **kwargs), names))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """G1 over several tables: (table_name, row_count) in ONE job - the
    tables' zero-column scans are stacked with their name and counted by one
    grouped aggregate (partial counts map-side, one tiny shuffle).  A table
    without rows still gets its row (count 0)."""
    if not tables:
        raise ValueError("no tables given")
    stacked = None
    for name, df in tables.items():
        t = df.selectExpr(f"{sql_str(name)} AS table_name")
        stacked = t if stacked is None else stacked.unionByName(t)
    counts = stacked.groupBy("table_name").agg(F.count(F.lit(1)).cast("long").alias("row_count"))
    names = literal_rows(next(iter(tables.values())).sparkSession, [(n,) for n in tables],
                         [("table_name", "STRING")])
    # the name list is bounded by the number of tables: broadcast is safe
    return names.join(counts, "table_name", "left").selectExpr(
        "table_name", "coalesce(row_count, CAST(0 AS BIGINT)) AS row_count")


def column_stats(df: DataFrame, column: str, distinct: str = "approx", rsd: float = DEFAULT_RSD,
                 approx_impl: str = "sketch") -> DataFrame:
    """G2/G3 for one column: min, max, null count, distinct count."""
    return profile(df, columns=[column], distinct=distinct, rsd=rsd, approx_impl=approx_impl)


# --- F5: partial profiles per group, merged ------------------------------------------


def profile_partials(df: DataFrame, group_cols: Iterable[str] = (), table_name: str = "table",
                     lg_k: int = DEFAULT_LG_K, columns: Iterable[str] | None = None) -> DataFrame:
    """Partial profile per group (a file, a partition, a stream batch): one
    row per (group, column) with mergeable accumulators - counts, typed
    min/max, length sums and an HLL sketch (binary).

    Grouping aggregates combine map-side, so a group holding a third of the
    rows still ships one partial row per task.
    """
    group_cols = list(group_cols)
    names = df.columns
    missing = [g for g in group_cols if g not in names]
    if missing:
        raise ValueError(f"unknown group column(s): {missing}")
    group_pos = [names.index(g) + 1 for g in group_cols]
    fields = [(i, f) for i, f in _fields(df, list(columns) if columns is not None else None)
              if i not in group_pos]
    df = _positional(df)
    aggs = ["count(1) AS `__rows`"]
    for i, f in fields:
        q, dt = _pos(i), f.dataType
        aggs.append(f"count({q}) AS nn{i}")
        if lane_of(dt) is not None:
            aggs += [f"min({q}) AS mn{i}", f"max({q}) AS mx{i}"]
        if has_length(dt):
            aggs += [f"CAST(sum(length({q})) AS BIGINT) AS sl{i}", f"CAST(max(length({q})) AS BIGINT) AS ml{i}"]
        aggs.append(f"hll_sketch_agg({sketch_input_sql(q, dt)}, {int(lg_k)}) AS hll{i}")
    if group_cols:
        g = df.groupBy(*[F.col(f"_c{j}") for j in group_pos]).agg(*[F.expr(a) for a in aggs])
    else:
        g = df.selectExpr(*aggs)
    structs = []
    for i, f in fields:
        lanes = _lane_sql(f, i)
        has_len = has_length(f.dataType)
        structs.append(_named_struct([
            ("table_name", sql_str(table_name)),
            ("column_name", sql_str(f.name)),
            ("ordinal", f"CAST({i} AS INT)"),
            ("data_type", sql_str(canonical_class(f.dataType))),
            ("original_type", sql_str(f.dataType.simpleString())),
            ("row_count", "CAST(`__rows` AS BIGINT)"),
            ("non_null", f"CAST(nn{i} AS BIGINT)"),
            *[(k, lanes[k]) for k in LANE_COLUMNS],
            ("sum_len", f"sl{i}" if has_len else "CAST(NULL AS BIGINT)"),
            ("max_len", f"ml{i}" if has_len else "CAST(NULL AS BIGINT)"),
            ("sketch", f"hll{i}"),
        ]))
    keep = [f"{_pos(j)} AS {quote(c)}" for j, c in zip(group_pos, group_cols)]
    return g.selectExpr(*keep, f"inline(array({', '.join(structs)}))")


def _merged_bound(b: str, lane: str) -> str:
    """Least or greatest of a lane; the text of decimals is compared as numbers."""
    plain = f"{b}({b}_{lane})"
    if lane != "str":
        return plain
    decimal = decimal_bound_sql(b, f"CASE WHEN startswith(original_type, 'decimal') THEN {b}_str END")
    return f"CASE WHEN startswith(original_type, 'decimal') THEN {decimal} ELSE {plain} END"


def combine_partials(partials: DataFrame) -> DataFrame:
    """Partials added up to one row a column that can be merged again (``merge_partials`` of it
    is that of the partials)."""
    key = ["table_name", "column_name", "ordinal", "data_type", "original_type"]
    columns = [*key, "row_count", "non_null", *LANE_COLUMNS, "sum_len", "max_len", "sketch"]
    return partials.groupBy(*key).agg(*[F.expr(e) for e in (
        "CAST(sum(row_count) AS BIGINT) AS row_count",
        "CAST(sum(non_null) AS BIGINT) AS non_null",
        *[f"{_merged_bound(b, ln)} AS {b}_{ln}" for b in ("min", "max") for ln in LANE_SQL],
        "CAST(sum(sum_len) AS BIGINT) AS sum_len",
        "CAST(max(max_len) AS BIGINT) AS max_len",
        "hll_union_agg(sketch, true) AS sketch")]).select(*columns)


def merge_partials(partials: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Final merge of ``profile_partials`` rows into the profile schema; the
    distinct count is the union sketch's estimate (approximate).  ``by``
    keeps those group columns: one profile per group (e.g. per partition
    value) instead of one for the whole table."""
    by = list(by)
    key = by + ["table_name", "column_name", "ordinal", "data_type", "original_type"]
    m = partials.groupBy(*[col(c) for c in key]).agg(*[F.expr(e) for e in (
        "CAST(sum(row_count) AS BIGINT) AS row_count",
        "CAST(sum(non_null) AS BIGINT) AS non_null",
        *[f"{_merged_bound(b, ln)} AS {b}_{ln}" for b in ("min", "max") for ln in LANE_SQL],
        "CAST(sum(sum_len) AS BIGINT) AS sum_len",
        "CAST(max(max_len) AS BIGINT) AS max_len",
        "hll_union_agg(sketch, true) AS sketch")])
    return m.selectExpr(
        *[quote(c) for c in key], "row_count",
        "CAST(row_count - non_null AS BIGINT) AS null_count",
        "CAST(hll_sketch_estimate(sketch) AS BIGINT) AS distinct_count",
        "true AS distinct_is_approx",
        *LANE_COLUMNS,
        "round(sum_len / non_null, 6) AS avg_len",
        "max_len",
    ).select(*[col(c) for c in by], *PROFILE_COLUMNS)


def profile_by_group(df: DataFrame, group_cols: Iterable[str], table_name: str = "table",
                     lg_k: int = DEFAULT_LG_K) -> DataFrame:
    """F5 per group: one profile per value of ``group_cols`` (a partition, a
    day) from one grouped aggregate; the group columns lead each row."""
    group_cols = list(group_cols)
    return merge_partials(profile_partials(df, group_cols, table_name, lg_k), by=group_cols)


def profile_by_file(df: DataFrame, table_name: str = "table", lg_k: int = DEFAULT_LG_K) -> DataFrame:
    """F5 over files: partial per ``_metadata.file_path``, then merged."""
    with_file = df.select("*", F.col("_metadata.file_path").alias("__file"))
    return merge_partials(profile_partials(with_file, ["__file"], table_name, lg_k,
                                           columns=list(df.columns)))
