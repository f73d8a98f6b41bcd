"""Shared pieces of the operators: word hashes, bounded bitmaps of hashes, and
tables cut from their lineage in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.session import drop_path, scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Distinct words whose hashes a worker remembers; others are hashed again.
MEMO_WORDS = 1 << 18


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; remembers at most ``MEMO_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordTable(dict):
    """word -> number; ``columns`` hold what ``describe`` says of each word.  Starts
    again when it knows ``MEMO_WORDS`` words."""

    def __init__(self, describe, kinds):
        super().__init__()
        self.describe, self.fresh, self.filled = describe, [], 0
        self.columns = [np.empty(1024, k) for k in kinds]

    def __missing__(self, word):
        n = self[word] = self.filled + len(self.fresh)
        self.fresh.append(self.describe(word))
        return n

    def numbers(self, words: list) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.filled = 0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            end = self.filled + len(self.fresh)
            for i, values in enumerate(zip(*self.fresh, strict=True)):
                column = self.columns[i]
                if end > len(column):
                    column = self.columns[i] = np.concatenate([column[: self.filled], np.empty(max(end, len(column)), column.dtype)])
                column[self.filled : end] = values
            self.filled, self.fresh = end, []
        return at


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64's constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive hashes (empty if there are fewer)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return mixed(out)


def spread(column: str, bits: int) -> Column:
    """Slot (0 .. 2^bits - 1) of a 64-bit hash column: its top bits."""
    return F.shiftrightunsigned(F.col(column), 64 - bits)


def hash_bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap over the slots (``spread``) of a column of 64-bit hashes, as bytes.

    Built by Spark in pieces of 32,768 bits, so at most 2^bits / 8 bytes reach
    the driver whatever the number of hashes.  It is only ever a prefilter: a
    slot shared by chance costs rows later and never changes a result.
    """
    slot = spread(column, bits) + 1
    out = np.zeros((1 << bits) // 8, np.uint8)
    rows = (hashes.where(F.col(column).isNotNull())
            .groupBy(F.expr(f"bitmap_bucket_number(shiftrightunsigned(`{column}`, {64 - bits}) + 1)").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")))
    for r in rows.collect():  # at most 2^bits / 8 bytes
        part = np.frombuffer(bytes(r.m), np.uint8)
        at = (r.b - 1) * 4096
        out[at : at + len(part)] |= part[: max(0, len(out) - at)]
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = h >> np.uint64(64 - bits)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def kept_table(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder (with the writer's ``options``) and read back: later reads
    don't depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``kept_table`` that nothing reads any more, and has the driver
    forget finished plans, so that Spark drops their shuffle files now."""
    import gc

    for table in tables:
        drop_path(table.sparkSession, table.kept_at)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """While tables are written within, Python workers get so many rows at once: for rows
    that carry whole sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, usual)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark drops the shuffle files of each query that runs within when it ends, without waiting for
    a collection. Not for frames that are read later: they are run by their readers."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, many: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key and in ``many`` the rows that the key has
    of ``total``.  Keys with over a thousandth of all rows, at most 1,000 of them, are joined
    by broadcast; no task gets all rows of such a key."""
    limit = max(1000, total // 1000)
    names = [c for c in facts.columns if c != key]
    hot = F.broadcast(facts.where(F.col(many) > limit).select(key, F.struct(*names).alias("at_once")))
    rows = rows.join(hot, key, "left")
    cold = rows.where("at_once is null").drop("at_once").join(facts.where(F.col(many) <= limit).hint("merge"), key)
    return cold.unionByName(rows.where("at_once is not null").select("*", "at_once.*").drop("at_once"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class PrefixHashes:
    """Polynomial hashes (modulo 2^64, mixed) of stretches of a row of hashes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        for name, base in (("powers", self.BASE), ("inverses", self.inverse)):
            have = getattr(self, name)
            while len(have) < n:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
            setattr(self, name, have)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self.reach(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of each stretch from a to before b, its length included."""
        return mixed((sums[b] - sums[a]) * self.inverses[a] + mixed((b - a).astype(np.uint64)))

    def spans(self, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.between(self.sums(hashes), a, b)


def remembered(key, make):
    """An object that a Python worker keeps between tasks (memos of pure functions
    only); it keeps the last one asked for, so that stages don't add up."""
    import sys
    import types

    memory = sys.modules.setdefault("lakelens_worker_memory", types.ModuleType("lakelens_worker_memory"))
    if getattr(memory, "key", None) != key:
        memory.key, memory.kept = None, None
        memory.key, memory.kept = key, make()
    return memory.kept
