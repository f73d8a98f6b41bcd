"""Exact distinct counts of integers, booleans and dates from parts that merge.

A value is a bit of a 64-bit word: value >> 6 names the word, the low six bits the
bit in it.  A part holds the words of one group of rows (a file, a partition, a
batch) with the bits of the values seen; parts merge by ``bit_or`` and the distinct
count is the sum of ``bit_count``.  Both are hash aggregates that combine map-side:
dense columns ship eight bytes for up to 64 values, sparse ones a short row a
value, and a value with a third of all rows is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.literals import literal_rows
from lakelens.operators.profile import col, quote, sql_str

#: Types whose values are bits, as a profile spells them.
EXACT_TYPES = ("tinyint", "smallint", "int", "bigint", "boolean", "date")


def _as_long(name: str, dt: T.DataType) -> str:
    return f"CAST(unix_date({quote(name)}) AS BIGINT)" if isinstance(dt, T.DateType) else f"CAST({quote(name)} AS BIGINT)"


def distinct_words(df: DataFrame, group_cols: Iterable[str] = (), table_name: str = "table",
                   columns: Iterable[str] | None = None) -> DataFrame:
    """(group columns..., table_name, column_name, word, bits) of the columns of ``EXACT_TYPES``
    (of ``columns``, if given); NULLs have no bit.  One scan."""
    group_cols = list(group_cols)
    wanted = set(df.columns if columns is None else columns)
    missing = (wanted | set(group_cols)) - set(df.columns)
    if missing:
        raise ValueError(f"unknown column(s): {sorted(missing)}")
    fields = [f for f in df.schema.fields
              if f.name in wanted and f.name not in group_cols and f.dataType.simpleString() in EXACT_TYPES]
    if not fields:
        keys = [f for f in df.schema.fields if f.name in group_cols]
        rest = T._parse_datatype_string("table_name string, column_name string, word bigint, bits bigint").fields
        return literal_rows(df.sparkSession, [], [(f.name, f.dataType.simpleString()) for f in keys + rest])
    pairs = ", ".join(f"named_struct('__column', {sql_str(f.name)}, '__value', {_as_long(f.name, f.dataType)})" for f in fields)
    rows = df.selectExpr(*[f"{quote(g)}" for g in group_cols], f"inline(array({pairs}))").where("`__value` IS NOT NULL")
    seen = rows.groupBy(*[col(g) for g in group_cols], F.col("__column"), F.expr("shiftright(`__value`, 6)").alias("word")).agg(
        F.expr("bit_or(shiftleft(CAST(1 AS BIGINT), CAST(`__value` & 63 AS INT)))").alias("bits"))
    return seen.selectExpr(*[quote(g) for g in group_cols], f"{sql_str(table_name)} AS table_name",
                           "`__column` AS column_name", "word", "bits")


def combine_words(words: DataFrame) -> DataFrame:
    """Parts added up to one row a word, which merge again."""
    return words.groupBy("table_name", "column_name", "word").agg(F.expr("bit_or(bits)").alias("bits"))


def distinct_counts(words: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """(by..., table_name, column_name, distinct_count); a column without values has no row."""
    keys = [*by, "table_name", "column_name"]
    whole = words.groupBy(*[col(k) for k in keys], "word").agg(F.expr("bit_or(bits)").alias("bits"))
    return whole.groupBy(*[col(k) for k in keys]).agg(F.expr("CAST(sum(bit_count(bits)) AS BIGINT)").alias("distinct_count"))


def with_exact_distinct(profile: DataFrame, words: DataFrame) -> DataFrame:
    """A merged profile whose columns of ``EXACT_TYPES`` count their distinct values exactly; ``words``
    are those of all rows the profile was made of, of all such columns."""
    exact = distinct_counts(words).withColumnRenamed("distinct_count", "__exact")  # one row a column
    counted = F.col("original_type").isin(*EXACT_TYPES)
    return (profile.join(exact, ["table_name", "column_name"], "left")
            .withColumn("distinct_count", F.when(counted, F.coalesce("__exact", F.lit(0))).otherwise(F.col("distinct_count")))
            .withColumn("distinct_is_approx", ~counted & F.col("distinct_is_approx"))
            .select(*[col(c) for c in profile.columns]))
