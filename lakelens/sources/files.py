"""The files that make up a table, and reads of some of them.

A read of chosen files stays one ordinary scan of the table's directory.  The
chosen paths are a DataFrame of any size; what the driver gets of them is at
most ``LOTS`` numbers, the hash lots that they fall into.  A filter on the
lot of ``_metadata.file_path`` lets Spark drop all other files while it plans the
scan; a join by path then drops files that share a lot by chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.session import path_exists, qualified
from lakelens.sources.listing import list_files, read_path

#: Hash lots of paths: what the driver holds at most of a choice of files.
LOTS = 4096


def live_files(spark: SparkSession, table_path: str) -> DataFrame:
    """(path, modificationTime, length) of the files that a table holds now: those of the newest
    snapshot if it has a Delta log, else all that are listed.  A missing path is an error."""
    if not path_exists(spark, f"{table_path.rstrip('/')}/_delta_log"):
        return list_files(spark, table_path)
    from lakelens.sources.deltalog import snapshot_files

    return snapshot_files(spark, table_path).select(
        full_path(qualified(spark, table_path)).alias("path"),
        F.timestamp_millis("modificationTime").alias("modificationTime"), F.col("size").alias("length"))


def full_path(root: str, column: str = "path") -> Column:
    """A path of a table's log, relative to the table unless it is absolute."""
    path = F.col(column)
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(F.concat(F.lit(f"{root}/"), path))


def lot_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(LOTS))


def only_files(rows: DataFrame, files: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The rows of a file-based DataFrame that come from ``files`` (column path, each once), with
    their file as ``__path`` and the columns ``more`` of ``files``."""
    lots = [r.lot for r in files.select(lot_of(F.col("path")).alias("lot")).distinct().collect()]  # at most LOTS
    kept = rows.where(lot_of(read_path()).isin(lots) if lots else F.lit(False)).select("*", read_path().alias("__path"))
    chosen = files.select(F.col("path").alias("__path"), *more)
    return kept.join(chosen, "__path").select(*[F.col(f"`{c}`") for c in rows.columns], "__path", *more)


def files_scanned(df: DataFrame) -> int:
    """Files that the scans of an executed DataFrame read, from Spark's own metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.length())]
        metric = node.metrics().get("numFiles")
        if metric.isDefined():
            total += metric.get().value()
    return total
