import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakelens.operators.distinct import combine_words, distinct_counts, distinct_words, with_exact_distinct
from lakelens.operators.profile import merge_partials, profile_partials

EDGES = [0, -1, 63, 64, -64, -65, 2**63 - 1, -(2**63), 2**62, None]


def _rows(spark):
    rows = [("a" if i % 3 else "b", v, (i % 5) - 2, i % 2 == 0, dt.date(1969, 12, 30) + dt.timedelta(days=i % 4), f"s{i}")
            for i, v in enumerate(EDGES * 3)]
    return spark.createDataFrame(rows, "g string, big long, `odd name` int, flag boolean, day date, text string")


def test_words_count_exactly_and_merge(spark, scratch):
    rows = _rows(spark)
    words = distinct_words(rows, ["g"], "t")
    want = {c: rows.select(f"`{c}`").distinct().where(f"`{c}` is not null").count() for c in ("big", "odd name", "flag", "day")}
    assert {r.column_name: r.distinct_count for r in distinct_counts(words).collect()} == want
    by = {(r.g, r.column_name): r.distinct_count for r in distinct_counts(words, ["g"]).collect()}
    for g in "ab":
        for c in want:
            assert by[g, c] == rows.where(F.col("g") == g).select(f"`{c}`").distinct().where(f"`{c}` is not null").count()
    once = combine_words(words)
    again = combine_words(once.unionByName(words.select(once.columns)))
    assert {r.column_name: r.distinct_count for r in distinct_counts(again).collect()} == want


def test_profile_with_exact_distinct(spark):
    rows = _rows(spark).withColumn("none", F.lit(None).cast("int"))
    parts = profile_partials(rows, ["g"], "t")
    got = {r.column_name: r for r in with_exact_distinct(merge_partials(parts), distinct_words(rows, ["g"], "t")).collect()}
    assert got["none"].distinct_count == 0 and not got["none"].distinct_is_approx
    assert got["big"].distinct_count == len(EDGES) - 1 and not got["big"].distinct_is_approx
    assert got["text"].distinct_is_approx and got["text"].distinct_count > 0


def test_empty_and_unknown(spark):
    rows = _rows(spark)
    assert distinct_counts(distinct_words(rows.where("false"))).count() == 0
    assert distinct_words(rows.select("text"), table_name="t").count() == 0
    with pytest.raises(ValueError):
        distinct_words(rows, ["nope"])


def test_a_hot_value_is_one_row_a_task(spark):
    rows = spark.range(0, 300000, 1, 4).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    words = distinct_words(rows)
    assert words.where("word = 0").count() == 1 and distinct_counts(words).first().distinct_count == rows.distinct().count()
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "SortAggregate" not in plan
