import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakelens.operators import pages as PG
from lakelens.operators.history import append_history, read_history

AT = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def listing(spark):
    return spark.range(5000).select(F.concat(F.lit('t"é '), F.col("id")).alias("name"), F.when(F.col("id") % 3 > 0, "table").alias("type"),
                                    F.array(F.col("id")).alias("key"))


def test_pages_are_bounded_and_repeatable(listing):
    pages, n = PG.pages_of(listing, ["name"], 200)
    sizes = [len(r["items"]) for r in pages.collect()]
    assert n == sum(sizes) == 5000 and max(sizes) < 300 and len(sizes) == 25
    again, _ = PG.pages_of(listing.repartition(7), ["name"], 200)
    assert sorted(map(str, again.collect())) == sorted(map(str, pages.collect()))
    assert "collect_list" in pages._jdf.queryExecution().executedPlan().toString()


def test_lists_come_back_whole(spark, scratch, listing):
    path = f"{scratch}/pages/history"
    append_history(PG.paged_rows(listing, ["name"], "lake", "db", page_rows=200, last_updated=AT), path)
    append_history(PG.paged_rows(listing.limit(0), ["name"], "lake", "empty", last_updated=AT), path)
    back = PG.paged_items(spark, read_history(spark, path), "lake", "db", listing.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, listing.collect()))
    assert PG.paged_items(spark, read_history(spark, path), "lake", "empty", listing.schema).count() == 0
    # a later, shorter list replaces all pages
    append_history(PG.paged_rows(listing.where("name like '%7'"), ["name"], "lake", "db", page_rows=200, last_updated=AT + dt.timedelta(hours=1)), path)
    assert PG.paged_items(spark, read_history(spark, path), "lake", "db", listing.schema).count() == 500
    with pytest.raises(LookupError):
        PG.paged_items(spark, read_history(spark, path), "lake", "other", listing.schema)
    gone = read_history(spark, path).where("id <> 'db#1'")
    with pytest.raises(ValueError, match="of 500 items"):
        PG.paged_items(spark, gone, "lake", "db", listing.schema)
