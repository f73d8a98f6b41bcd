"""Proportional stratified interleaving into shards (operator 2, native).

Rows are shuffled by a seeded digest within their source; a row's fractional
rank is its place there over the source's size, shifted by a seeded amount a
source.  Sorted by that rank, every stretch of the order holds each source in
proportion, so cutting it into stretches of equal row counts gives shards that
all match the mixture (law ``rows``: counts differ by one at most).

Neither rank is found in one task.  Digests are spread evenly, so the place of a
row within its source is the number of rows in earlier digest slots (counts by
source and slot: a small table) plus its place in its own slot.  The place in
the whole order is found likewise from slots of the fractional rank.  A source
with a third of all rows fills its slots as evenly as any other.

Only ids, sizes and digests are shuffled; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.words import kept_table

SHARDS, SEED = 16, "interleave-1"

#: Slots of digests and of fractional ranks, tasks that the two ranks can be spread over: at least so many, and
#: one for so many rows.
SLOTS, SLOT_ROWS = 2048, 100_000


def unit_of(hexes: Column) -> Column:
    """A digest (hexadecimal) as a number from 0 to below 1."""
    return F.conv(F.substring(hexes, 1, 8), 16, 10).cast("double") / F.lit(1 << 32)


def interleave(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", seed: str = SEED, slots: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, source, shard and slot (its place in the shard, from 0)
    of every row of ``docs``.

    size: bytes of the text and one more; a null text has no bytes.  Rows without
    a source form a source of their own.  Ties: rows that agree in id and text can
    change places without a change of the result, all others are ordered by their
    digests, then by id.  Repeated rows each get a place; columns not named are not
    read; very long texts are digested where they are; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.col(source_col).cast("string").alias("source"),
    ).withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    rows = kept_table(rows.withColumn("digest", digest), "shard-rows")
    if slots is None:
        slots = max(SLOTS, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("s1", (unit_of(F.col("digest")) * slots).cast("int"))

    # place within the source
    counts = rows.groupBy("src", "s1").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("s1").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "src", "s1", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        F.sum("n").over(Window.partitionBy("src")).alias("of"))
    within = Window.partitionBy("src", "s1").orderBy("digest", "doc_id")
    shift = unit_of(F.md5(F.concat(F.lit(seed), F.col("src"))))
    ranked = (rows.withColumn("place", F.row_number().over(within)).join(counts, ["src", "s1"])
              .withColumn("rank", (F.col("earlier") + F.col("place") - 1 + shift) / F.col("of"))
              .withColumn("s2", F.least(F.floor(F.col("rank") * slots), F.lit(slots - 1)).cast("int")))

    # place in the whole order, and the cut
    whole = ranked.groupBy("s2").agg(F.count("*").alias("n"))
    all_slots = Window.orderBy("s2").rowsBetween(Window.unboundedPreceding, -1)  # at most ``slots`` rows
    whole = whole.select("s2", F.coalesce(F.sum("n").over(all_slots), F.lit(0)).alias("ahead"),
                         F.sum("n").over(Window.orderBy("s2").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("s2").orderBy("rank", "src", "digest", "doc_id")
    at = (F.col("ahead") + F.col("inside") - 1).cast("long")
    shard = F.expr(f"cast((at * {shards}) div total as int)")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (ranked.withColumn("inside", F.row_number().over(inside)).join(F.broadcast(whole), "s2")
            .withColumn("at", at).withColumn("shard", shard).withColumn("slot", (F.col("at") - first).cast("long"))
            .select("doc_id", "size", "text_crc32", "source", "shard", "slot"))


def sharded(docs: DataFrame) -> DataFrame:
    """Every document's place in 16 shards, in the form of the contract."""
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
