"""Schema inspection.

Schemas are metadata held by the driver already (``df.schema``); they are
turned into small DataFrames so they join and union with the profiles.
Key detection (S3) is a data job.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.literals import literal_rows
from lakelens.functions.types import canonical_class

SCHEMA_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("original_type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("comment", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


_SCHEMA_COLS = [("table_name", "STRING"), ("ordinal", "INT"), ("column_name", "STRING"),
                ("data_type", "STRING"), ("original_type", "STRING"), ("nullable", "BOOLEAN"),
                ("comment", "STRING"), ("metadata", "MAP<STRING, STRING>")]


def schema_rows(schema: T.StructType, table_name: str, dialect: str | None = None) -> list[tuple]:
    """Rows of SCHEMA_SCHEMA.  ``dialect`` (T1-T7 compatibility) spells each
    type the way that source would and classifies it with that dialect's
    rules; the default is the canonical class (T8) of the Spark type."""
    from lakelens.functions.types import DIALECT_RULES, spelling_for

    rows = []
    for i, f in enumerate(schema.fields, start=1):
        meta = {k: (v if isinstance(v, str) else json.dumps(v)) for k, v in (f.metadata or {}).items()}
        raw = f.dataType.simpleString() if dialect is None else spelling_for(dialect, f.dataType)
        meta.setdefault("original_type", raw)
        if dialect is None:
            cls = canonical_class(f.dataType)
        else:
            folded = raw.lower()
            cls = next((c for needles, c in DIALECT_RULES[dialect] if any(n in folded for n in needles)),
                       "unknown")
        rows.append((table_name, i, f.name, cls, raw, bool(f.nullable), meta.get("comment"), meta))
    return rows


def table_schema(spark: SparkSession, df: DataFrame, table_name: str,
                 dialect: str | None = None) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, original_type,
    nullable, comment, metadata); column order kept."""
    return literal_rows(spark, schema_rows(df.schema, table_name, dialect), _SCHEMA_COLS)


def schema_inventory(spark: SparkSession, tables: Mapping[str, DataFrame],
                     dialect: str | None = None) -> DataFrame:
    """S1 over many tables as one DataFrame."""
    rows = []
    for name, df in tables.items():
        rows.extend(schema_rows(df.schema, name, dialect))
    return literal_rows(spark, rows, _SCHEMA_COLS)


def describe_columns(spark: SparkSession, table_id: str) -> DataFrame:
    """``DESCRIBE TABLE`` rows without the partition header block."""
    d = spark.sql(f"DESCRIBE TABLE {table_id}")
    return (d.where((F.col("col_name") != "") & ~F.col("col_name").startswith("#"))
             .dropDuplicates(["col_name"]))


def candidate_keys(df: DataFrame, column_sets: Sequence[Sequence[str]], table_name: str = "table") -> DataFrame:
    """S3 re-aimed: for each column set, is it a key of the data?

    (table_name, key_columns, row_count, distinct_count, null_rows, is_key).
    All sets are grouping sets of one aggregate: one scan and one shuffle, whose partial
    aggregation collapses duplicate keys map-side, so a hot key costs one row per
    task and set.  A set given twice is answered twice; an empty table has no
    rows to contradict a key.  ``single_column_keys`` reads all single-column
    keys off one exact profile.
    """
    sets = [list(c) for c in column_sets]
    if not sets:
        raise ValueError("no column sets given")
    names = list(dict.fromkeys(c for cols in sets for c in cols))
    if len(names) > 60 and len(sets) > 1:  # a grouping id has 63 bits
        half = len(sets) // 2
        return candidate_keys(df, sets[:half], table_name).unionByName(candidate_keys(df, sets[half:], table_name))
    place = {c: i for i, c in enumerate(names)}
    members = [sorted({place[c] for c in cols}) for cols in sets]
    gid = [sum(1 << (len(names) - 1 - i) for i in range(len(names)) if i not in m) for m in members]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for c, i in place.items()])
    distinct = list({g: m for g, m in zip(gid, members)}.values())
    groups = rows.groupingSets([[F.col(f"_k{i}") for i in m] for m in distinct], *[F.col(f"_k{i}") for i in range(len(names))]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    of = {g: " OR ".join(f"_k{i} IS NULL" for i in m) for g, m in zip(gid, members)}
    groups = groups.select("gid", "n", F.expr("CASE gid " + " ".join(f"WHEN {g} THEN {e}" for g, e in of.items()) + " END").alias("has_null"))
    counted = groups.groupBy("gid").agg(
        F.sum("n").cast("long").alias("row_count"), F.count_if(~F.col("has_null")).cast("long").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("has_null"), F.col("n"))), F.lit(0)).cast("long").alias("null_rows"))
    asked = literal_rows(df.sparkSession, [(",".join(cols), g) for cols, g in zip(sets, gid)], [("key_columns", "STRING"), ("gid", "BIGINT")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    answers = asked.join(counted, "gid", "left").select("key_columns", zero("row_count"), zero("distinct_count"), zero("null_rows"))
    return answers.select(F.lit(table_name).alias("table_name"), "*",
                          ((F.col("null_rows") == 0) & (F.col("distinct_count") == F.col("row_count"))).alias("is_key"))


def single_column_keys(profile_df: DataFrame) -> DataFrame:
    """S3 from an exact profile: columns with no NULLs and all values distinct."""
    return profile_df.where(
        (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count"))
        & (F.col("distinct_is_approx") == F.lit(False))
    ).orderBy("table_name", "ordinal").select("table_name", "column_name")  # column order; one row per column
