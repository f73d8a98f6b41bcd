"""Inputs derived from the driver's tables by Spark and written below the
session's checkpoint folder: multi-file copies, a schema-drifting
directory, a Hive-partitioned copy, a lake with a Delta table, stream
input files.  Each is written once per (session, sf_dir) and reused.

Files keep Spark's natural task layout (no coalesce to one task), so a
fixture written from a huge table is written in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.session import scratch_dir, write_single_text_file
from lakelens.sources.readers import read_table

_CACHE: dict[tuple, str] = {}


def _cached(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def at_least(df: DataFrame, files: int, key: str) -> DataFrame:
    """At least ``files`` output files, range-split over as many tasks as the
    cluster runs at once."""
    return df.repartitionByRange(max(files, df.sparkSession.sparkContext.defaultParallelism), key)


def multi_file_orders(spark: SparkSession, sf_dir: str, files: int = 6) -> str:
    """orders rewritten as at least ``files`` Parquet files."""
    def build():
        out = scratch_dir(spark, "orders6")
        at_least(read_table(spark, sf_dir, "orders"), files, "o_orderkey").write.parquet(out)
        return out
    return _cached(spark, sf_dir, f"multi_file_orders{files}", build)


def drift_orders(spark: SparkSession, sf_dir: str) -> str:
    """One directory, three writes that disagree: status F rows with
    o_custkey as int, status O as bigint, status P as bigint plus an extra
    double column."""
    def build():
        out = scratch_dir(spark, "drift")
        o = read_table(spark, sf_dir, "orders")
        (o.where("o_orderstatus = 'F'").withColumn("o_custkey", F.col("o_custkey").cast("int"))
           .write.mode("append").parquet(out))
        o.where("o_orderstatus = 'O'").write.mode("append").parquet(out)
        (o.where("o_orderstatus = 'P'").withColumn("o_extra", F.col("o_totalprice") / 2)
           .write.mode("append").parquet(out))
        return out
    return _cached(spark, sf_dir, "drift_orders", build)


def mixed_orders(spark: SparkSession, sf_dir: str) -> str:
    """One directory, three writes that no reader widens: status F with o_custkey as text,
    status O with it as bigint and o_totalprice as decimal, status P without o_orderpriority."""
    def build():
        out = scratch_dir(spark, "mixed")
        o = read_table(spark, sf_dir, "orders")
        (o.where("o_orderstatus = 'F'").withColumn("o_custkey", F.col("o_custkey").cast("string"))
           .write.mode("append").parquet(out))
        (o.where("o_orderstatus = 'O'").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,2)"))
           .write.mode("append").parquet(out))
        o.where("o_orderstatus = 'P'").drop("o_orderpriority").write.mode("append").parquet(out)
        return out
    return _cached(spark, sf_dir, "mixed_orders", build)


def blocked_events(spark: SparkSession, sf_dir: str, blocks: int = 64) -> str:
    """events in directories by block, event_id modulo ``blocks``."""
    def build():
        out = scratch_dir(spark, "blocked")
        e = read_table(spark, sf_dir, "events")
        e.withColumn("block", (F.col("event_id") % blocks).cast("int")).write.partitionBy("block").parquet(out)
        return out
    return _cached(spark, sf_dir, f"blocked_events{blocks}", build)


def hive_orders(spark: SparkSession, sf_dir: str) -> str:
    """orders partitioned by (o_orderstatus, o_orderpriority) with '5-LOW'
    turned into NULL (the Hive NULL directory) and a value with a space."""
    def build():
        out = scratch_dir(spark, "hive")
        o = read_table(spark, sf_dir, "orders").withColumn(
            "o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
        o.write.partitionBy("o_orderstatus", "o_orderpriority").parquet(out)
        return out
    return _cached(spark, sf_dir, "hive_orders", build)


def _file_stats_json(df: DataFrame) -> DataFrame:
    """Per written file: relative path, size and Delta-style stats JSON,
    computed by one aggregate grouped by ``_metadata.file_path``."""
    cols = [c for c in df.columns if c != "o_orderstatus"]
    g = df.select("*", F.col("_metadata.file_path").alias("fp"),
                  F.col("_metadata.file_size").alias("fsz")).groupBy("fp", "fsz")
    aggs = [F.count(F.lit(1)).alias("numRecords")]
    types = dict(df.dtypes)
    for c in cols:
        mn, mx = F.min(c), F.max(c)
        if types[c].startswith("timestamp"):
            mn = F.date_format(mn, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            mx = F.date_format(mx, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        aggs += [mn.alias(f"mn_{c}"), mx.alias(f"mx_{c}"),
                 (F.count(F.lit(1)) - F.count(c)).alias(f"nc_{c}")]
    s = g.agg(*aggs)
    return s.select(
        F.regexp_extract("fp", r"([^/]+/[^/]+)$", 1).alias("path"),
        F.regexp_extract("fp", r"o_orderstatus=([^/]+)/", 1).alias("status"),
        F.col("fsz").alias("size"),
        F.to_json(F.struct(
            F.col("numRecords"),
            F.struct(*[F.col(f"mn_{c}").alias(c) for c in cols]).alias("minValues"),
            F.struct(*[F.col(f"mx_{c}").alias(c) for c in cols]).alias("maxValues"),
            F.struct(*[F.col(f"nc_{c}").alias(c) for c in cols]).alias("nullCount"),
        )).alias("stats"))


def _add_action(with_stats: bool) -> F.Column:
    fields = [F.col("path"), F.create_map(F.lit("o_orderstatus"), F.col("status")).alias("partitionValues"),
              F.col("size"), F.lit(0).cast("long").alias("modificationTime"),
              F.lit(True).alias("dataChange")]
    if with_stats:
        fields.append(F.col("stats"))
    return F.to_json(F.struct(F.struct(*fields).alias("add"))).alias("value")


def delta_orders(spark: SparkSession, sf_dir: str, table_dir: str | None = None, commits: int = 3) -> str:
    """A Delta table of orders, partitioned by status, with up to three commits:
    0 metaData + add F and O files; 1 remove F files; 2 add F files again
    and add P files without statistics."""
    def build():
        out = table_dir or scratch_dir(spark, "delta")
        o = read_table(spark, sf_dir, "orders")
        o.write.partitionBy("o_orderstatus").parquet(out)
        files = _file_stats_json(spark.read.parquet(out))
        schema_json = o.drop("o_orderstatus").withColumn("o_orderstatus", F.lit("x")).schema.json()
        meta = spark.range(1).select(F.to_json(F.struct(F.struct(
            F.lit("lakelens-fixture").alias("id"),
            F.struct(F.lit("parquet").alias("provider")).alias("format"),
            F.lit(schema_json).alias("schemaString"),
            F.array(F.lit("o_orderstatus")).alias("partitionColumns"),
            F.lit(0).cast("long").alias("createdTime")).alias("metaData"))).alias("value"))
        protocol = spark.range(1).select(F.to_json(F.struct(F.struct(
            F.lit(1).alias("minReaderVersion"), F.lit(2).alias("minWriterVersion")).alias("protocol"))).alias("value"))
        log = f"{out}/_delta_log"
        c0 = protocol.unionByName(meta).unionByName(
            files.where("status IN ('F', 'O')").select(_add_action(True)))
        c1 = files.where("status = 'F'").select(F.to_json(F.struct(F.struct(
            F.col("path"), F.lit(1).cast("long").alias("deletionTimestamp"),
            F.lit(True).alias("dataChange")).alias("remove"))).alias("value"))
        c2 = files.where("status = 'F'").select(_add_action(True)).unionByName(
            files.where("status = 'P'").select(_add_action(False)))
        for v, c in enumerate((c0, c1, c2)[:commits]):
            write_single_text_file(spark, c, f"{log}/{v:020d}.json")
        return out
    key = f"delta_orders{commits}" if table_dir is None else f"delta_orders:{table_dir}"
    return _cached(spark, sf_dir, key, build)


def lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake root: tpch/{orders,lineitem} as Parquet, tpch/orders_delta as
    Delta, raw/events_json as JSON (unknown format)."""
    def build():
        base = scratch_dir(spark, "lake")
        read_table(spark, sf_dir, "orders").write.parquet(f"{base}/tpch/orders")
        read_table(spark, sf_dir, "lineitem").write.parquet(f"{base}/tpch/lineitem")
        read_table(spark, sf_dir, "events").write.json(f"{base}/raw/events_json")
        delta_orders(spark, sf_dir, table_dir=f"{base}/tpch/orders_delta")
        return base
    return _cached(spark, sf_dir, "lake", build)


def stream_events(spark: SparkSession, sf_dir: str, files: int = 6) -> str:
    """events rewritten as at least ``files`` Parquet files."""
    def build():
        out = scratch_dir(spark, "stream-in")
        at_least(read_table(spark, sf_dir, "events"), files, "event_id").write.parquet(out)
        return out
    return _cached(spark, sf_dir, f"stream_events{files}", build)
