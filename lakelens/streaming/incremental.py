"""Incremental profile of arriving files.

A file stream feeds ``foreachBatch``; each micro-batch is reduced to a
partial profile (counts, typed min/max, length sums, HLL sketch per column)
written to ``<state>/partials/batch_id=<n>`` with overwrite of that batch's
own directory only, so a replayed batch (after a failure) replaces itself
instead of double counting.  The profile is the merge of all partials, read
at any time.  Spark's checkpoint under ``<state>/_checkpoint`` tracks which
files were consumed.

Partials are compacted by size tiers: before batch n is written, ``FAN`` neighbouring
directories of one tier become one of the next, ``batch_id=<first>-<last>``.  Only
batches before n are touched, which are committed and never come again.  A
directory that lies within a whole larger one is not read, so a compaction that
was cut short counts nothing twice and is done again.  After n batches there are
at most (FAN - 1) * log_FAN(n) + FAN directories.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakelens.operators.profile import DEFAULT_LG_K, combine_partials, merge_partials, profile_partials
from lakelens.session import delete_within, glob_names

#: Directories of one tier that become one of the next.
FAN = 8

BATCHES = re.compile(r"batch_id=(\d+)(?:-(\d+))?")


def _partials_dir(state_dir: str) -> str:
    return f"{state_dir.rstrip('/')}/partials"


def start_incremental_profile(spark: SparkSession, input_dir: str, state_dir: str,
                              schema: T.StructType | None = None, table_name: str = "table",
                              max_files_per_trigger: int | None = None, lg_k: int = DEFAULT_LG_K,
                              available_now: bool = True,
                              processing_time: str | None = None) -> StreamingQuery:
    """Start the stream.  ``available_now`` consumes what is there (in
    batches of ``max_files_per_trigger`` files, all at once by default) and
    stops; otherwise it runs on ``processing_time`` triggers."""
    if schema is None:
        schema = spark.read.parquet(input_dir).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return start_stream_profile(reader.parquet(input_dir), state_dir, table_name, lg_k, available_now, processing_time)


def start_stream_profile(stream: DataFrame, state_dir: str, table_name: str = "table",
                         lg_k: int = DEFAULT_LG_K, available_now: bool = True,
                         processing_time: str | None = None, fan: int = FAN) -> StreamingQuery:
    """Profile any streaming DataFrame (files, Kafka, ...): each micro-batch
    becomes one partial per column under ``<state>/partials/batch_id=<n>``."""
    if not stream.isStreaming:
        raise ValueError("start_stream_profile needs a streaming DataFrame")
    out = _partials_dir(state_dir)

    def write_batch(df: DataFrame, batch_id: int) -> None:
        compact_partials(df.sparkSession, state_dir, batch_id, fan)
        part = profile_partials(df, [], table_name, lg_k)
        part.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", f"{state_dir.rstrip('/')}/_checkpoint"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def _whole_ranges(spark: SparkSession, out: str) -> list[tuple[int, int]]:
    """(first, last) of the directories to read: whole ones that lie in no other whole one.  Compaction
    bounds their number."""
    found = [m for n in glob_names(spark, f"{out}/*") if (m := BATCHES.fullmatch(n))]
    ranges = sorted(((int(m[1]), int(m[2] or m[1])) for m in found), key=lambda r: (r[0], -r[1]))
    kept: list[tuple[int, int]] = []
    for first, last in ranges:
        if kept and last <= kept[-1][1]:
            continue
        if first == last or glob_names(spark, f"{out}/batch_id={first}-{last}/_SUCCESS"):
            kept.append((first, last))
    return kept


def _dir(out: str, first: int, last: int) -> str:
    return f"{out}/batch_id={first}" if first == last else f"{out}/batch_id={first}-{last}"


def compact_partials(spark: SparkSession, state_dir: str, before: int, fan: int = FAN) -> None:
    """Merges the partials of batches before ``before`` by tiers, and deletes directories that a whole
    larger one replaces."""
    out = _partials_dir(state_dir)
    while True:
        kept = _whole_ranges(spark, out)
        inside = {_dir(out, *r) for r in kept}
        for name in glob_names(spark, f"{out}/batch_id=*"):
            m = BATCHES.fullmatch(name)
            first, last = int(m[1]), int(m[2] or m[1])
            if f"{out}/{name}" not in inside and any(a <= first and last <= b for a, b in kept):
                delete_within(spark, f"{out}/{name}", out)
        tiers: dict[int, list[tuple[int, int]]] = {}
        for first, last in kept:
            if last < before:
                tier, size = 0, last - first + 1
                while size >= fan:
                    tier, size = tier + 1, size // fan
                tiers.setdefault(tier, []).append((first, last))
        run = next((r[:fan] for _, r in sorted(tiers.items()) if len(r) >= fan and r[fan - 1][1] - r[0][0] + 1 >= fan), None)
        if run is None:
            return
        # neighbours: nothing of another tier lies between them
        if any(run[0][0] < first < run[-1][0] and (first, last) not in run for first, last in kept):
            return
        rows = spark.read.parquet(*[_dir(out, *r) for r in run])
        combine_partials(rows).write.mode("overwrite").parquet(_dir(out, run[0][0], run[-1][1]))


def partial_batches(spark: SparkSession, state_dir: str) -> DataFrame:
    """The partials with their batch_id (a batch, or first-last of compacted ones)."""
    out = _partials_dir(state_dir)
    rows = spark.read.parquet(*[_dir(out, *r) for r in _whole_ranges(spark, out)])
    return rows.withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), "batch_id=([0-9-]+)", 1))


def merged_profile(spark: SparkSession, state_dir: str) -> DataFrame:
    """The profile of everything consumed so far (distinct approximate)."""
    return merge_partials(partial_batches(spark, state_dir).drop("batch_id"))


def incremental_profile(spark: SparkSession, input_dir: str, state_dir: str, **kwargs) -> DataFrame:
    """Run the stream over the files present now, then return the merge."""
    q = start_incremental_profile(spark, input_dir, state_dir, available_now=True, **kwargs)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return merged_profile(spark, state_dir)
