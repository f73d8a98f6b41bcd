"""Path parsing as column expressions: Hive partition segments, table
directories relative to a lake root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the directory name Hive-style writers use for a NULL value.
HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"


def unescape_partition_value(v: Column) -> Column:
    """Undo Hive path escaping (%XX only; '+' stays '+'); NULL marker -> NULL."""
    decoded = F.url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))
    return F.when(v == HIVE_NULL, F.lit(None).cast("string")).otherwise(decoded)


def dir_segments(rel_path: Column) -> Column:
    """Directory segments of a relative file path (file name dropped)."""
    parts = F.split(rel_path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)
