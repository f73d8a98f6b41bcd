"""Delta transaction log replay as a Spark job.

A snapshot at version v is the newest complete checkpoint at or before v and
every JSON commit after it up to v.  A version beyond the log, or one whose
commits are gone, is an error, never a smaller answer.  Commits are read with
an explicit action schema, the latest action per file path wins (``max_by``
over the version, reduced map-side before the shuffle), and the add actions'
``stats`` JSON is parsed with a schema derived from that version's own
``metaData.schemaString``.  Files whose statistics don't cover every column are
scanned, so table and column statistics are whole.

Deletion vectors and column mapping need a Delta runtime and are refused.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.session import glob_names, path_exists, qualified
from lakelens.sources.files import full_path, only_files

ADD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("partitionValues", T.MapType(T.StringType(), T.StringType())),
    T.StructField("size", T.LongType()),
    T.StructField("modificationTime", T.LongType()),
    T.StructField("dataChange", T.BooleanType()),
    T.StructField("stats", T.StringType()),
    T.StructField("deletionVector", T.StructType([T.StructField("storageType", T.StringType())])),
])
REMOVE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("deletionTimestamp", T.LongType()),
    T.StructField("dataChange", T.BooleanType()),
])
METADATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("schemaString", T.StringType()),
    T.StructField("partitionColumns", T.ArrayType(T.StringType())),
    T.StructField("configuration", T.MapType(T.StringType(), T.StringType())),
    T.StructField("createdTime", T.LongType()),
])
ACTION_SCHEMA = T.StructType([
    T.StructField("add", ADD),
    T.StructField("remove", REMOVE),
    T.StructField("metaData", METADATA),
])

COMMIT = re.compile(r"(\d{20})\.json")
CHECKPOINT = re.compile(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet")

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.StructType, T.ArrayType, T.MapType)

#: Writers shorten bounds of strings to this many characters by default: one that long may not be a value.
PREFIX = 32


def _log_dir(table_path: str) -> str:
    return f"{table_path.rstrip('/')}/_delta_log"


def _complete_checkpoints(names: list[str]) -> dict[int, list[str]]:
    """Files of each checkpoint that is there in full.  UUID-named ones are not
    read; the commits after the newest classic checkpoint replace them."""
    parts: dict[tuple[int, int], list[str]] = {}
    for n in names:
        if m := CHECKPOINT.fullmatch(n):
            parts.setdefault((int(m[1]), int(m[3] or 1)), []).append(n)
    return {v: sorted(files) for (v, of), files in sorted(parts.items()) if len(files) == of}


def log_actions(spark: SparkSession, table_path: str, version: int | None = None) -> DataFrame:
    """Actions with their commit version that make up the table at ``version``
    (latest if None).  The log's file names are listed on the driver, as any
    Delta reader does; ``ValueError`` if the log doesn't hold that version."""
    log = _log_dir(table_path)
    if not path_exists(spark, log):
        raise ValueError(f"no Delta log at {log}")
    names = glob_names(spark, f"{log}/*")
    commits = {int(m[1]): n for n in names if (m := COMMIT.fullmatch(n))}
    checkpoints = _complete_checkpoints(names)
    latest = max([*commits, *checkpoints], default=None)
    if latest is None:
        raise ValueError(f"no Delta log at {log}")
    version = latest if version is None else version
    if not 0 <= version <= latest:
        raise ValueError(f"version {version} is not in the log at {log}, whose latest version is {latest}")
    base = max((v for v in checkpoints if v <= version), default=-1)
    wanted = range(base + 1, version + 1)
    gone = [v for v in wanted if v not in commits]
    if gone:
        raise ValueError(f"version {version} cannot be rebuilt: commit {gone[0]} is missing from {log}")
    found = None
    if wanted:
        found = (spark.read.schema(ACTION_SCHEMA).json([f"{log}/{commits[v]}" for v in wanted])
                 .withColumn("version", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).cast("long")))
    if base >= 0:
        cp = (spark.read.schema(ACTION_SCHEMA).parquet(*[f"{log}/{n}" for n in checkpoints[base]])
              .withColumn("version", F.lit(base).cast("long")))
        found = cp if found is None else cp.unionByName(found)
    return found


def _decoded(path: Column) -> Column:
    """Log paths are URI-encoded; a plus sign is itself."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def snapshot_files(spark: SparkSession, table_path: str, version: int | None = None,
                   actions: DataFrame | None = None) -> DataFrame:
    """Files of the table at ``version`` (latest if None): (path, decoded and
    relative to the table unless absolute, partitionValues, size,
    modificationTime, stats, deletion_vector, added_in_version)."""
    acts = log_actions(spark, table_path, version) if actions is None else actions
    file_acts = acts.where(F.col("add").isNotNull() | F.col("remove").isNotNull()).select(
        _decoded(F.coalesce(F.col("add.path"), F.col("remove.path"))).alias("path"),
        F.col("version"),
        F.struct(F.col("add").isNotNull().alias("is_add"), F.col("add").alias("add"),
                 F.col("version").alias("v")).alias("act"))
    # one commit can remove a file and add it again: the add is what stays
    order = F.col("version") * 2 + F.col("act.is_add").cast("int")
    latest = file_acts.groupBy("path").agg(F.max_by("act", order).alias("act"))
    return latest.where(F.col("act.is_add")).select(
        "path",
        F.col("act.add.partitionValues").alias("partitionValues"),
        F.col("act.add.size").alias("size"),
        F.col("act.add.modificationTime").alias("modificationTime"),
        F.col("act.add.stats").alias("stats"),
        F.col("act.add.deletionVector").isNotNull().alias("deletion_vector"),
        F.col("act.v").alias("added_in_version"))


def table_metadata(spark: SparkSession, table_path: str, actions: DataFrame | None = None,
                   version: int | None = None) -> tuple[T.StructType, list[str]]:
    """Schema and partition columns of that version from its newest metaData
    action (one small record, read on the driver like any Delta reader does)."""
    acts = (log_actions(spark, table_path, version) if actions is None else actions).where(F.col("metaData").isNotNull())
    row = acts.groupBy().agg(F.max_by("metaData", "version").alias("m")).first()
    if row is None or row.m is None or row.m.schemaString is None:
        raise ValueError(f"no metaData action in {_log_dir(table_path)}")
    if ((row.m.configuration or {}).get("delta.columnMapping.mode") or "none") != "none":
        raise NotImplementedError(f"{table_path}: column mapping needs a Delta runtime")
    return T.StructType.fromJson(json.loads(row.m.schemaString)), list(row.m.partitionColumns or [])


def table_schema(spark: SparkSession, table_path: str) -> T.StructType:
    return table_metadata(spark, table_path)[0]


def refuse_deletion_vectors(files: DataFrame, table_path: str) -> None:
    if not files.where("deletion_vector").isEmpty():
        raise NotImplementedError(f"{table_path}: deletion vectors need a Delta runtime")


def _stat_type(dt: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(dt, TEMPORAL) else dt


def stats_schema(schema: T.StructType) -> T.StructType:
    leaf = [f for f in schema.fields if not isinstance(f.dataType, NESTED)]
    bounds = T.StructType([T.StructField(f.name, _stat_type(f.dataType)) for f in leaf])
    nulls = T.StructType([T.StructField(f.name, T.LongType()) for f in leaf])
    return T.StructType([
        T.StructField("numRecords", T.LongType()),
        T.StructField("minValues", bounds),
        T.StructField("maxValues", bounds),
        T.StructField("nullCount", nulls),
    ])


def delta_file_stats(spark: SparkSession, table_path: str, version: int | None = None,
                     actions: DataFrame | None = None,
                     schema: T.StructType | None = None) -> DataFrame:
    """Snapshot files with parsed statistics (``s`` struct, NULL if none)."""
    acts = log_actions(spark, table_path, version) if actions is None else actions
    if schema is None:
        schema = table_metadata(spark, table_path, acts)[0]
    files = snapshot_files(spark, table_path, version, acts)
    return files.withColumn("s", F.from_json("stats", stats_schema(schema)))


def delta_table_stats(spark: SparkSession, table_path: str, version: int | None = None) -> DataFrame:
    """Table-level row: version, files, files without a row count in the log, and
    the table's rows.  The rows of files without a count come from reading them
    (no column: Parquet answers from its footers)."""
    acts = log_actions(spark, table_path, version)
    fs = delta_file_stats(spark, table_path, version, acts).select(
        "path", "partitionValues", "size", "added_in_version", "deletion_vector", F.col("s.numRecords").alias("n"))
    refuse_deletion_vectors(fs, table_path)
    scanned = _data_of(spark, table_path, fs.where("n is null"), *table_metadata(spark, table_path, acts)).agg(
        F.count(F.lit(1)).alias("n"))
    rows = fs.select("added_in_version", "size", "n", F.lit(True).alias("file")).unionByName(
        scanned.select(F.lit(None).cast("long").alias("added_in_version"), F.lit(None).cast("long").alias("size"), "n", F.lit(False).alias("file")))
    return rows.agg(
        F.max("added_in_version").alias("max_add_version"),
        F.count_if("file").cast("long").alias("num_files"),
        F.count_if(F.col("file") & F.col("n").isNull()).cast("long").alias("files_without_stats"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size_bytes"))


def _is_covered(f: T.StructField, partitioned: bool) -> Column:
    """A file's statistics tell all about a column: its nulls, and bounds (values, not
    shortened ones) unless all are null."""
    if partitioned:
        return F.lit(True)
    nulls = F.col("s.nullCount").getField(f.name)
    lo, hi = F.col("s.minValues").getField(f.name), F.col("s.maxValues").getField(f.name)
    bounds = lo.isNotNull() & hi.isNotNull()
    if isinstance(f.dataType, T.StringType):
        bounds = bounds & (F.char_length(lo) < PREFIX) & (F.char_length(hi) < PREFIX)
    return nulls.isNotNull() & (bounds | (nulls == F.col("s.numRecords")))


def _bounded(dt: T.DataType) -> bool:
    return isinstance(dt, (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, *TEMPORAL))


def _partial(rows: DataFrame, fields: list[T.StructField], of: dict) -> DataFrame:
    """One row of rows, nulls and bounds of every column; ``of`` gives the row count
    and each column's (min, max, nulls) expressions."""
    aggs = [F.coalesce(F.sum(of[None]), F.lit(0)).cast("long").alias("__rows")]
    for i, f in enumerate(fields):
        lo, hi, nulls = of[f.name]
        text = "string" if not _bounded(f.dataType) else None
        if isinstance(f.dataType, TEMPORAL):
            lo, hi = (F.to_timestamp_ntz(F.regexp_replace(x.cast("string"), "Z$", "")) for x in (lo, hi))
        elif text:
            lo = hi = F.lit(None).cast(text)
        aggs += [F.min(lo).alias(f"mn{i}"), F.max(hi).alias(f"mx{i}"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias(f"nc{i}")]
    return rows.agg(*aggs)


def delta_column_stats(spark: SparkSession, table_path: str, version: int | None = None) -> DataFrame:
    """Per column min, max and null count of the whole table at ``version``, in the
    profile's typed lanes.

    Files whose statistics cover every bounded column answer from the log; all
    others are scanned, in one aggregate.  A log bound of a string as long as
    writers shorten them to covers nothing: bounds are always values of the table.
    """
    acts = log_actions(spark, table_path, version)
    schema, part_cols = table_metadata(spark, table_path, acts)
    fs = delta_file_stats(spark, table_path, version, acts, schema)
    refuse_deletion_vectors(fs, table_path)
    leaf = [f for f in schema.fields if not isinstance(f.dataType, NESTED)]
    whole = F.col("s.numRecords").isNotNull()
    for f in leaf:
        if _bounded(f.dataType):
            whole = whole & F.coalesce(_is_covered(f, f.name in part_cols), F.lit(False))
        else:
            whole = whole & (F.lit(f.name in part_cols) | F.col("s.nullCount").getField(f.name).isNotNull())
    fs = fs.withColumn("whole", F.coalesce(whole, F.lit(False)))
    logged: dict = {None: F.col("s.numRecords")}
    for f in leaf:
        if f.name in part_cols:
            # partition values live in the add action, not in the stats
            pv = _partition_value("partitionValues", f)
            logged[f.name] = pv, pv, F.when(pv.isNull(), F.col("s.numRecords")).otherwise(0)
        else:
            logged[f.name] = (F.col("s.minValues").getField(f.name), F.col("s.maxValues").getField(f.name),
                              F.col("s.nullCount").getField(f.name))
    data = _data_of(spark, table_path, fs.where("not whole"), schema, part_cols)
    # the log writes instants in UTC
    value = {f.name: F.to_utc_timestamp(F.col(f"`{f.name}`"), F.current_timezone()) if isinstance(f.dataType, T.TimestampType)
             else F.col(f"`{f.name}`") for f in leaf}
    read = {c: (v, v, v.isNull().cast("long")) for c, v in value.items()}
    both = _partial(fs.where("whole"), leaf, logged).unionByName(_partial(data, leaf, read | {None: F.lit(1)}))
    wide = both.agg(F.sum("__rows").alias("__rows"), *[
        fn(f"{k}{i}").alias(f"{k}{i}") for i in range(len(leaf)) for k, fn in (("mn", F.min), ("mx", F.max), ("nc", F.sum))])
    structs = []
    for i, f in enumerate(leaf):
        dt = f.dataType
        lanes = {k: F.lit(None).cast(t) for k, t in (
            ("min_int", "long"), ("max_int", "long"), ("min_num", "double"), ("max_num", "double"),
            ("min_str", "string"), ("max_str", "string"), ("min_ts", "timestamp_ntz"), ("max_ts", "timestamp_ntz"))}
        for b, src in (("min", f"mn{i}"), ("max", f"mx{i}")):
            v = F.col(src)
            if isinstance(dt, INTEGRAL):
                lanes[f"{b}_int"] = v.cast("long")
            elif isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
                lanes[f"{b}_num"] = F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double"))  # -0.0 -> 0.0
            elif isinstance(dt, T.StringType):
                lanes[f"{b}_str"] = v
            elif isinstance(dt, TEMPORAL):
                lanes[f"{b}_ts"] = v.cast("timestamp_ntz")
        structs.append(F.struct(
            F.lit(f.name).alias("column_name"),
            F.col("__rows").cast("long").alias("row_count"),
            F.col(f"nc{i}").cast("long").alias("null_count"),
            *[lanes[k].alias(k) for k in ("min_int", "max_int", "min_num", "max_num",
                                          "min_str", "max_str", "min_ts", "max_ts")]))
    return wide.select(F.inline(F.array(*structs)))


def _partition_value(column: str, f: T.StructField) -> Column:
    """A partition value in its column's type; the empty string stands for NULL."""
    text = F.nullif(F.col(column).getItem(f.name), F.lit(""))
    return text if isinstance(f.dataType, T.StringType) else text.cast(f.dataType)


def _data_of(spark: SparkSession, table_path: str, files: DataFrame, schema: T.StructType, part_cols: list[str]) -> DataFrame:
    """Rows of snapshot files in the log's schema: columns a file lacks are NULL and
    partition columns come from the log, not from directory names.

    The table's directory is read once, pruned to the files (see ``files.only_files``);
    partition values reach the rows by the same join.  Files outside the
    table's directory are refused.
    """
    root = qualified(spark, table_path)
    files = files.withColumn("path", full_path(root))
    if not files.where(~F.col("path").startswith(f"{root}/")).isEmpty():
        raise NotImplementedError(f"{table_path}: files outside the table's directory need a Delta runtime")
    stored = T.StructType([f for f in schema.fields if f.name not in part_cols])
    values = files.select("path", *[_partition_value("partitionValues", schema[c]).alias(f"__part{i}") for i, c in enumerate(part_cols)])
    rows = spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(root)
    rows = only_files(rows, values, [f"__part{i}" for i in range(len(part_cols))])
    part = {c: f"__part{i}" for i, c in enumerate(part_cols)}
    return rows.select(*[F.col(part[f.name] if f.name in part else f"`{f.name}`").alias(f.name) for f in schema.fields])


def read_delta(spark: SparkSession, table_path: str, version: int | None = None) -> DataFrame:
    """The table's data at ``version`` (latest if None) without a Delta runtime, in
    that version's schema.  Deletion vectors and column mapping are refused."""
    acts = log_actions(spark, table_path, version)
    schema, part_cols = table_metadata(spark, table_path, acts)
    files = snapshot_files(spark, table_path, version, acts)
    refuse_deletion_vectors(files, table_path)
    return _data_of(spark, table_path, files, schema, part_cols)
