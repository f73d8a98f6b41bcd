import json

import pytest
from pyspark.sql import functions as F

from lakelens.operators.sampling import PERCENT_REQUIRED, sample, to_records
from tests.conftest import SF001


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF001}/orders.parquet")


def test_percent_required(orders):
    for m in ("bernoulli", "system", "hash"):
        with pytest.raises(ValueError, match="Percent must be specified"):
            sample(orders, m, key="o_orderkey")
    assert "BERNOULLI" in PERCENT_REQUIRED


def test_limit(orders):
    assert sample(orders).count() == 100
    assert sample(orders, "limit", limit=5).count() == 5


def test_hash_sample_subset_and_repeatable(orders):
    a = sample(orders, "hash", percent=10, key="o_orderkey", seed=42)
    b = sample(orders.repartition(3), "hash", percent=10, key="o_orderkey", seed=42)
    ka = sorted(r.o_orderkey for r in a.collect())
    assert ka == sorted(r.o_orderkey for r in b.collect())
    assert 0 < len(ka) < orders.count()
    assert a.join(orders, "o_orderkey", "left_anti").count() == 0
    lim = sample(orders, "hash", percent=10, key="o_orderkey", seed=42, order_by=["o_orderkey"], limit=7)
    assert [r.o_orderkey for r in lim.collect()] == ka[:7]


def test_bernoulli_bounds(orders):
    n = sample(orders, "bernoulli", percent=50, seed=1).count()
    assert 0 < n < orders.count()
    assert sample(orders, "bernoulli", percent=0, seed=1).count() == 0


def test_system_keeps_whole_blocks(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    s = sample(ev, "system", percent=50, seed=5, block=[F.floor(F.col("event_id") / 100)])
    blocks = s.groupBy(F.floor(F.col("event_id") / 100).alias("b")).count().collect()
    full = {r.b: r["count"] for r in ev.groupBy(F.floor(F.col("event_id") / 100).alias("b")).count().collect()}
    assert blocks and all(r["count"] == full[r.b] for r in blocks)
    d = sample(ev, "system", percent=100, seed=5, block_rows=64)
    assert d.count() == ev.count()


def test_records(orders):
    r = to_records(orders.select("o_orderkey", "o_orderstatus").limit(1)).collect()[0]
    assert set(json.loads(r.record)) == {"o_orderkey", "o_orderstatus"}
