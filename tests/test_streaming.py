from lakelens.operators.profile import profile
from lakelens.streaming.incremental import incremental_profile, merged_profile, partial_batches
from tests.conftest import SF001, by_col


def test_incremental_equals_batch_and_is_idempotent(spark, scratch):
    src = f"{scratch}/stream/in"
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.repartitionByRange(6, "event_id").write.parquet(src)
    state = f"{scratch}/stream/state"
    m = by_col(incremental_profile(spark, src, state, table_name="events", max_files_per_trigger=2))
    assert partial_batches(spark, state).select("batch_id").distinct().count() == 3
    whole = by_col(profile(ev, "events", distinct="none"))
    for k, r in whole.items():
        assert (m[k].row_count, m[k].null_count, m[k].min_int, m[k].max_ts, m[k].min_str) == \
               (r.row_count, r.null_count, r.min_int, r.max_ts, r.min_str)
    # a restart over the same checkpoint finds nothing new: no double counting
    again = by_col(incremental_profile(spark, src, state, table_name="events", max_files_per_trigger=2))
    assert again["event_id"].row_count == ev.count()
    assert by_col(merged_profile(spark, state))["event_id"].row_count == ev.count()


def test_files_arriving_between_runs(spark, scratch):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = f"{scratch}/stream/arriving"
    state = f"{scratch}/stream/arriving_state"
    ev.where("event_id < 500").write.mode("append").parquet(src)
    first = by_col(incremental_profile(spark, src, state, table_name="events"))
    assert first["event_id"].row_count == 500 and first["event_id"].max_int == 499
    ev.where("event_id >= 500").write.mode("append").parquet(src)
    second = by_col(incremental_profile(spark, src, state, table_name="events"))
    whole = by_col(profile(ev, "events", distinct="none"))
    for k, r in whole.items():
        assert (second[k].row_count, second[k].min_int, second[k].max_int, second[k].max_str,
                second[k].avg_len) == (r.row_count, r.min_int, r.max_int, r.max_str, r.avg_len)
    assert abs(second["user_id"].distinct_count - ev.select("user_id").distinct().count()) <= 3


def test_processing_time_trigger(spark, scratch):
    from lakelens.streaming.incremental import start_incremental_profile
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src, state = f"{scratch}/stream/pt_in", f"{scratch}/stream/pt_state"
    ev.where("event_id < 300").write.mode("append").parquet(src)
    q = start_incremental_profile(spark, src, state, schema=ev.schema, table_name="events",
                                  available_now=False, processing_time="1 second")
    try:
        q.processAllAvailable()
        ev.where("event_id >= 300").write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert by_col(merged_profile(spark, state))["event_id"].row_count == ev.count()


def test_stream_profile_of_any_streaming_frame(spark, scratch):
    import pytest

    from lakelens.streaming.incremental import start_stream_profile
    with pytest.raises(ValueError):
        start_stream_profile(spark.range(3), f"{scratch}/stream/nope")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = f"{scratch}/stream/json_in"
    ev.write.json(src)
    stream = spark.readStream.schema(ev.schema).json(src)
    q = start_stream_profile(stream, f"{scratch}/stream/json_state", "events")
    q.awaitTermination()
    assert by_col(merged_profile(spark, f"{scratch}/stream/json_state"))["event_id"].row_count == ev.count()


def test_partials_are_compacted_by_tiers(spark, scratch):
    """100 batches leave few directories and the same profile; a replay or a cut compaction counts nothing twice."""
    import os

    from lakelens.operators.profile import combine_partials, profile_partials
    from lakelens.streaming.incremental import compact_partials
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    state, fan, n = f"{scratch}/stream/compacted", 4, 30
    out = f"{state}/partials"

    def write(i):
        compact_partials(spark, state, i, fan)
        rows = ev.where(f"event_id % {n} = {i}")
        profile_partials(rows, [], "events").coalesce(1).write.mode("overwrite").parquet(f"{out}/batch_id={i}")

    for i in range(n):
        write(i)
    write(n - 1)  # the last batch comes again
    names = [d for d in os.listdir(out) if d.startswith("batch_id=")]
    assert len(names) <= 3 * 3 + 4 and any("-15" in d for d in names)
    whole, got = by_col(profile(ev, "events", distinct="none")), by_col(merged_profile(spark, state))
    for k, r in whole.items():
        assert (got[k].row_count, got[k].null_count, got[k].min_int, got[k].max_str, got[k].avg_len, got[k].max_ts) == \
               (r.row_count, r.null_count, r.min_int, r.max_str, r.avg_len, r.max_ts)
    # a compaction that was cut short: without _SUCCESS it isn't read, and parts that it replaces aren't either
    combine_partials(spark.read.parquet(f"{out}/batch_id=0-15")).write.parquet(f"{out}/batch_id=0-{n - 1}")
    os.remove(f"{out}/batch_id=0-{n - 1}/_SUCCESS")
    assert by_col(merged_profile(spark, state))["event_id"].row_count == ev.count()
    spark.read.parquet(f"{out}/batch_id=0-15").write.parquet(f"{out}/batch_id=3")
    assert by_col(merged_profile(spark, state))["event_id"].row_count == ev.count()
