"""Long lists saved in pages (X1, C3): the partitions of a table, the objects of a database.

A list is dealt to pages by a hash of its key, so no task and no record holds all of
it, and the same list gives the same pages.  A header record under the list's
own id says how many items there are; the pages follow under ``<id>#<page>``.  Header and
pages of one save share their time, so pages of an earlier, longer list are left out
when it is read, and a list that isn't whole is an error.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.literals import literal_rows
from lakelens.operators.history import current, history_rows

#: Items that a page holds on average.
PAGE_ROWS = 10_000

#: Mark between a list's id and a page's number.
MARK = "#"


def pages_of(items: DataFrame, key: Sequence[str], page_rows: int = PAGE_ROWS) -> tuple[DataFrame, int]:
    """(page, items: a sorted array) and the number of items.  Rows that agree in ``key`` share a page;
    an empty list has no pages."""
    n = items.count()
    lots = max(1, -(-n // page_rows))
    keyed = items.select(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(lots)).alias("page"),
                         F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("item"))
    return keyed.groupBy("page").agg(F.sort_array(F.collect_list("item")).alias("items")), n


def paged_rows(items: DataFrame, key: Sequence[str], source: str, list_id: str, *, kind: str = "discovery",
               page_rows: int = PAGE_ROWS, last_updated: dt.datetime) -> DataFrame:
    """History rows of a list: its header and its pages, JSON in ``content``."""
    pages, n = pages_of(items, key, page_rows)
    head = literal_rows(items.sparkSession, [(n,)], [("items", "BIGINT")])
    rows = history_rows(head, F.lit(source), F.lit(list_id), F.to_json(F.struct("items")), kind=kind, last_updated=last_updated)
    return rows.unionByName(history_rows(
        pages, F.lit(source), F.concat(F.lit(f"{list_id}{MARK}"), F.col("page").cast("string")), F.to_json(F.struct("items")),
        kind=kind, last_updated=last_updated))


def paged_items(spark: SparkSession, history: DataFrame, source: str, list_id: str, schema: T.StructType, *, kind: str = "discovery") -> DataFrame:
    """The items of the newest save of a list; ``LookupError`` if there is none, ``ValueError`` if a page of it is missing."""
    rows = current(history).where((F.col("source") == source) & (F.col("kind") == kind))
    head = rows.where(F.col("id") == list_id).select(F.get_json_object("content", "$.items").cast("long").alias("n"), "last_updated").first()
    if head is None:
        raise LookupError(f"{source} has no list {list_id!r}")
    pages = rows.where(F.col("id").startswith(f"{list_id}{MARK}") & (F.col("last_updated") == F.lit(head.last_updated).cast("timestamp_ntz")))
    shape = T.StructType([T.StructField("items", T.ArrayType(schema))])
    items = pages.select(F.explode(F.from_json("content", shape).getField("items")).alias("item")).select("item.*")
    found = items.count()
    if found != head.n:
        raise ValueError(f"list {list_id!r} of {source} has {found} of {head.n} items")
    return items
