"""Plan-shape checks for the scale rules: map-side partial aggregation before
every shuffle of the hot paths, correct results when one key holds a third
of the rows, and no cross join anywhere among the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lakelens.operators.history import current
from lakelens.operators.profile import _fields, exact_distinct_counts, profile
from lakelens.operators.schema import candidate_keys
from tests.conftest import SF001, by_col


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """lineitem with a third of its rows moved onto one l_orderkey."""
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    return li.withColumn("l_orderkey", F.when(F.col("l_linenumber") <= 3, F.lit(0)).otherwise(F.col("l_orderkey")))


def test_hot_key_results(spark, skewed):
    hot = skewed.where("l_orderkey = 0").count() / skewed.count()
    assert hot > 0.3
    p = by_col(profile(skewed, "li", distinct="exact"))
    assert p["l_orderkey"].distinct_count == skewed.select("l_orderkey").distinct().count()
    k = candidate_keys(skewed, [["l_orderkey"]], "li").collect()[0]
    assert not k.is_key and k.distinct_count == p["l_orderkey"].distinct_count


def test_partial_aggregation_before_shuffles(spark, skewed):
    exact = _plan(exact_distinct_counts(skewed, _fields(skewed, None)))
    # de-duplication runs map-side (a keyed HashAggregate below the first exchange)
    below_first_exchange = exact[exact.rfind("Exchange hashpartitioning"):].split("\n", 1)[1]
    assert "HashAggregate(keys=[" in below_first_exchange and "ordinal" in below_first_exchange
    keys = _plan(candidate_keys(skewed, [["l_orderkey"]], "li"))
    assert "partial_count" in keys
    hist = skewed.select(F.lit("s").alias("source"), F.col("l_orderkey").cast("string").alias("id"),
                         F.lit("metadata").alias("kind"), F.to_json(F.struct("l_quantity")).alias("content"),
                         F.col("l_shipdate").alias("last_updated"), F.lit(False).alias("deleted"),
                         F.lit(True).alias("has_column_stats"))
    assert "partial_max_by" in _plan(current(hist))


def test_no_cross_joins_in_registered_queries(spark):
    bad = []
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SF001))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def test_default_profile_is_one_job_one_scan(spark):
    s2 = spark.newSession()
    s2.conf.set("spark.sql.adaptive.enabled", "false")  # AQE runs each shuffle stage as its own job
    sc = s2.sparkContext
    df = profile(s2.read.parquet(f"{SF001}/lineitem.parquet"), "l")
    assert _plan(df).count("FileScan parquet") == 1
    sc.setJobGroup("one-job", "default profile")
    df.write.format("noop").mode("overwrite").save()
    assert len(sc.statusTracker().getJobIdsForGroup("one-job")) == 1


def test_footer_listing_reads_no_content(spark):
    from lakelens.sources.footers import footer_chunks
    plan = _plan(footer_chunks(spark, SF001))
    assert "ReadSchema: struct<path:string,length:bigint,pending:boolean>" in plan and "content" not in plan


def test_exact_profile_scans(spark):
    import re
    labels = spark.read.parquet(f"{SF001}/labels.parquet")       # integers only
    assert _plan(profile(labels, "labels", distinct="exact")).count("FileScan parquet") == 1
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", _plan(profile(li, "li", distinct="exact")))
    widths = sorted(len(s.split(",")) for s in scans)
    assert widths == [2, 11]  # keys of all columns once; raw values of the 2 string columns
