"""File listings as DataFrames.

A walk starts from one root and goes on in rounds.  A task lists directories until it
has listed ``DIRECTORIES`` of them and hands the ones it didn't reach to the next
round, so that a small tree is one job and a large one spreads over all tasks.  Each
round is written as Parquet below the shared folder.  No list of files or
directories reaches the driver, only the number of directories left.

Names starting with ``_`` or ``.`` are hidden, as in Spark's own listings (but
``_name=value`` directories are not); a caller can ask for some of them,
such as ``_delta_log``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Collection, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.session import path_exists, qualified, scratch_dir

# the walk runs in Python workers, which need pyarrow but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
])

#: Directories that a task lists before it hands the rest on.
DIRECTORIES = 64

#: What the walk writes: files, and directories still to list (``pending``).
WALK_SCHEMA = "path string, modificationTime timestamp, length long, pending boolean"

# Hadoop's S3 settings and what pyarrow calls them.
S3_SETTINGS = {
    "fs.s3a.access.key": "access_key",
    "fs.s3a.secret.key": "secret_key",
    "fs.s3a.session.token": "session_token",
    "fs.s3a.endpoint": "endpoint_override",
    "fs.s3a.endpoint.region": "region",
}


def s3_options(spark: SparkSession) -> dict[str, str]:
    """pyarrow's S3 options from the session's Hadoop settings (empty: defaults)."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {to: conf.get(key) for key, to in S3_SETTINGS.items() if conf.get(key)}
    endpoint = found.get("endpoint_override", "")
    if "://" in endpoint:
        found["scheme"], found["endpoint_override"] = endpoint.split("://", 1)
    elif endpoint and conf.get("fs.s3a.connection.ssl.enabled") == "false":
        found["scheme"] = "http"
    return found


def file_system(path: str, s3: dict[str, str]):
    """pyarrow's file system for a qualified path, and the path within it."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^/+", "/", path[5:])
    if path.startswith(("s3a://", "s3n://", "s3://")):
        return pafs.S3FileSystem(**s3), path.split("://", 1)[1]
    return pafs.FileSystem.from_uri(path)


def is_hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def entries(directory: str, s3: dict[str, str], shown: Collection[str]) -> Iterator[tuple]:
    """(path, time, length, is a directory) of a directory's visible children."""
    import pyarrow.fs as pafs

    fs, inner = file_system(directory, s3)
    for info in fs.get_file_info(pafs.FileSelector(inner, recursive=False)):
        if is_hidden(info.base_name) and info.base_name not in shown:
            continue
        folder = info.type == pafs.FileType.Directory
        yield f"{directory}/{info.base_name}", None if folder else info.mtime, None if folder else info.size, folder


def walk(spark: SparkSession, root: str, out: str, shown: Collection[str], directories: int, recursive: bool) -> None:
    """Writes the rounds of a walk from a qualified directory below ``out``."""
    s3 = s3_options(spark)

    def listed(batches):
        import pyarrow as pa

        names = ["path", "modificationTime", "length", "pending"]
        types = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_()]

        def batch_of(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        waiting = [p for b in batches for p in b.column(0).to_pylist()]
        done, rows = 0, []
        while waiting and done < directories:
            done += 1
            for path, time, length, folder in entries(waiting.pop(), s3, shown):
                if not folder:
                    rows.append((path, time, length, False))
                elif recursive:
                    waiting.append(path)
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
        rows += [(path, None, None, True) for path in waiting]
        if rows:
            yield batch_of(rows)

    number, frontier, left = 0, spark.range(0, 1, 1, 1).select(F.lit(root).alias("path")), 1
    while left:
        seen = Observation()
        (frontier.mapInArrow(listed, WALK_SCHEMA).observe(seen, F.count_if("pending").alias("left"))
         .write.parquet(f"{out}/round={number}"))
        left = seen.get["left"]
        # a task takes few directories at first, so that wide trees spread out
        tasks = max(1, min(left, 4 * spark.sparkContext.defaultParallelism, -(-left // directories) * 4))
        frontier = spark.read.schema(WALK_SCHEMA).parquet(f"{out}/round={number}").where("pending").select("path").repartition(tasks)
        number += 1


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, *,
               shown: Collection[str] = (), directories: int = DIRECTORIES) -> DataFrame:
    """(path, modificationTime, length) of every file at or below ``path``, listed now.

    A path that doesn't exist is an error; an empty directory gives no rows.
    ``glob`` keeps files whose name matches; ``shown`` names hidden entries to
    list all the same.  One directory is listed by one task.
    """
    root = qualified(spark, path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"path does not exist: {root}")
    out = scratch_dir(spark, "listing")
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    status = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath)
    if status.isDirectory():
        walk(spark, root, out, shown, directories, recursive)
        rows = spark.read.schema(WALK_SCHEMA).parquet(out).where("not pending").select("path", "modificationTime", "length")
    else:
        rows = spark.range(1).select(
            F.lit(root).alias("path"), F.timestamp_millis(F.lit(int(status.getModificationTime()))).alias("modificationTime"),
            F.lit(int(status.getLen())).cast("long").alias("length"))
    if glob:
        import fnmatch

        rows = rows.where(F.regexp_extract("path", "([^/]+)$", 1).rlike(fnmatch.translate(glob).replace(r"\Z", r"\z")))
    return rows


def qualify(spark: SparkSession, path: str) -> str:
    """Fully qualified form of a path, as listed file paths begin."""
    return qualified(spark, path)


def relative_path(path_col: str, root_qualified: str):
    """Path below a qualified root (1-based substring after ``root/``)."""
    return F.expr(f"substring({path_col}, {len(root_qualified) + 2})")


def read_path() -> F.Column:
    """The file that a row was read from, spelt like a listed path: ``_metadata.file_path``
    is percent-encoded and writes an empty authority out."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")
