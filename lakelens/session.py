"""Session helpers: shared scratch space and Hadoop file-system access.

Intermediate tables are written below the cluster's checkpoint directory
(``spark.checkpoint.dir``), never to a machine-local folder.  Only a session in
one JVM (``local`` master, as in tests) may have none: it gets a fresh folder
under ``/tmp``.  On a cluster an unset folder is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; in one JVM set up if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/lakelens-{name}-{uuid.uuid4().hex[:12]}"


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, jpath


def glob_names(spark: SparkSession, pattern: str) -> list[str]:
    """File names matching a glob (one directory listing on the path's file
    system; for log directories, not for data)."""
    fs, jpath = _hadoop_fs(spark, pattern)
    found = fs.globStatus(jpath)
    return [] if found is None else [str(st.getPath().getName()) for st in found]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, without a trailing slash."""
    fs, jpath = _hadoop_fs(spark, path)
    return str(fs.makeQualified(jpath).toString()).rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _hadoop_fs(spark, path)
    return bool(fs.exists(jpath))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a directory below the session's scratch folder (no other)."""
    if not path.startswith(f"{checkpoint_root(spark)}/lakelens-"):
        raise ValueError(f"not a scratch folder of this library: {path}")
    fs, jpath = _hadoop_fs(spark, path)
    fs.delete(jpath, True)


def delete_within(spark: SparkSession, path: str, root: str) -> None:
    """Delete a directory right below ``root``, a folder of state that the caller owns."""
    if path.rsplit("/", 1)[0] != root.rstrip("/"):
        raise ValueError(f"{path} is not right below {root}")
    fs, jpath = _hadoop_fs(spark, path)
    fs.delete(jpath, True)


def write_single_text_file(spark: SparkSession, lines_df, target: str) -> None:
    """Write a one-column string DataFrame as exactly one file at ``target``.

    Used for Delta commit files, whose names are fixed by the log protocol.
    Spark writes a one-partition text directory; the single part file is then
    renamed into place through the Hadoop file system of the target path.
    """
    write_single_file(spark, lines_df, target, "text")


def write_single_file(spark: SparkSession, df, target: str, fmt: str) -> None:
    """Write ``df`` (log-sized: one row per data file) as exactly one file of
    format ``fmt`` at ``target``, e.g. a Delta checkpoint."""
    tmp = scratch_dir(spark, "staging")
    df.coalesce(1).write.mode("overwrite").format(fmt).save(tmp)
    fs, tmp_path = _hadoop_fs(spark, tmp)
    parts = [
        st.getPath()
        for st in fs.listStatus(tmp_path)
        if st.getPath().getName().startswith("part-")
    ]
    if len(parts) != 1:
        raise RuntimeError(f"expected one part file under {tmp}, found {len(parts)}")
    _, dst = _hadoop_fs(spark, target)
    fs.mkdirs(dst.getParent())
    if not fs.rename(parts[0], dst):
        raise RuntimeError(f"could not place {target}")


def unique_suffix() -> str:
    return uuid.uuid4().hex[:8]


def scale_conf(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings sized from the bytes a job reads and the cluster's
    cores: shuffle partitions of about ``partition_bytes`` each (never
    fewer than two waves of cores), AQE coalescing and skew splitting, and
    scan splits no larger than a shuffle partition."""
    shuffle = max(2 * cores, -(-int(input_bytes) // partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(min(partition_bytes, 512 << 20)),
        "spark.sql.session.timeZone": "UTC",
    }


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total bytes below a path, from a listing job (no file is opened)."""
    from pyspark.sql import functions as F

    from lakelens.sources.listing import list_files

    row = list_files(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    return int(row.b)
