"""Exact deduplication with a persistent digest index (operator 6, native).

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text, at a path that outlives the session.  A batch of new rows is
reduced to one row a digest, sort-merge joined with the index (whose side needs
no shuffle), and the digests that the index doesn't hold are
appended.

Groups of copies may be huge.  Rows are first counted by digest and salt, so a
group arrives at its digest as at most ``SALTS`` rows, and the answer goes back
to the rows through the same salted pairs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.words import LOWER, UPPER, kept_table
from lakelens.session import scratch_dir

#: Parts into which a group of copies is dealt before it is counted.
SALTS = 256

#: Least buckets of a new index; there are as many as the session has shuffle partitions if that is more.
BUCKETS = 32


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "UTF-8"), 256)


class DigestIndex:
    """Digests seen so far: digest, keep_id (the id that stays), batch (when it came)."""

    def __init__(self, spark: SparkSession, path: str, *, id_type: str = "bigint", buckets: int | None = None):
        """Opens the index at ``path``, made if it isn't there; an index keeps the
        number of buckets it was made with, which another session must give."""
        if buckets is None:
            buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch: str = "") -> DataFrame:
        """Deduplicates ``docs`` against itself and the index, appends the new digests and
        returns doc_id, keep_id, group_size, kept, seen, text_sha256 and row (its
        number in this batch) for every row.

        Of equal texts in ``docs`` the row with the largest id stays; if the index
        holds the text already (``seen``), no row stays and keep_id is the
        index's.  group_size counts the rows of ``docs``.  A null id is smaller than any
        other; among rows that share text and id, repeated rows included, one is kept.
        Columns not named are not read; very long texts are digested whole where they
        are and not shuffled; an empty table appends nothing.
        """
        rows = kept_table(
            docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"),
                        F.monotonically_increasing_id().alias("row"))
            .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")), "digests")
        parts = rows.groupBy("digest", "salt").agg(
            F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("n"))
        groups = parts.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("group_size"))
        known = self.rows().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("seen"))
        groups = kept_table(
            groups.join(known.hint("merge"), "digest", "left").select(
                "digest", "group_size", F.coalesce("seen", F.lit(False)).alias("seen"),
                F.when(F.col("seen"), F.col("old_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
                F.when(F.col("seen").isNull(), F.col("top.row")).alias("keep_row")), "digest-groups")
        (groups.where(~F.col("seen")).select("digest", "keep_id", F.lit(batch).alias("batch"))
         .repartition(self.buckets, "digest").write.insertInto(self.table))
        # the answer returns by (digest, salt): a group's rows stay spread over its salts
        answers = parts.select("digest", "salt").join(groups.hint("merge"), "digest")
        return rows.join(answers.hint("merge"), ["digest", "salt"]).select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            "seen", F.col("digest").alias("text_sha256"), "row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every document with the one that stays of its group, from an index of its own."""
    spark = docs.sparkSession
    found = DigestIndex(spark, scratch_dir(spark, "digest-index")).add(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts (that of the largest id), with the columns of ``docs``."""
    spark = docs.sparkSession
    found = DigestIndex(spark, scratch_dir(spark, "digest-index")).add(docs)
    # what becomes of the rows of one id and text: all go, or one of several stays
    pairs = found.groupBy(F.col("doc_id").alias("pair_id"), F.col("text_sha256").alias("pair_digest")).agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    pairs = kept_table(pairs, "copies")
    keyed = docs.select(F.struct("*").alias("whole"), text_digest(F.col("text")).alias("digest"))
    on = F.col("whole.doc_id").eqNullSafe(F.col("pair_id")) & (F.col("digest") == F.col("pair_digest"))
    # sort-merge at every size: what goes is as many rows as there are copies
    alone = keyed.join(pairs.hint("merge"), on, "left_anti").select("whole.*")
    several = pairs.where("kept")
    if several.isEmpty():  # no id has the same text twice
        return alone
    return alone.unionByName(keyed.join(several.hint("merge"), on).dropDuplicates(["pair_id", "pair_digest"]).select("whole.*"))
