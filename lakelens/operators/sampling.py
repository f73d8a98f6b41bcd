"""Row samples (M1-M7).

``limit``     - first n rows, no order (M1).
``bernoulli`` - each row with probability percent/100 (M2), Spark's
                ``sample``; reproducible only for a fixed file layout.
``system``    - block sampling (M3); Spark has no SYSTEM clause.  By default files
                are chosen by a hash of their path while the scan is planned,
                so the others are never opened, then blocks of rows in them.
``hash``      - reproducible row sample (M5): hash of (seed, key columns),
                independent of layout and engine.
A limit after a percent sample is M4.  All samplers are narrow: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.functions.hashing import keep_fraction

# Sampling methods, default row counts and error text.
METHODS = ("limit", "bernoulli", "system", "hash")
DEFAULT_LIMIT = 100
PERCENT_REQUIRED = "Percent must be specified for BERNOULLI or SYSTEM sampling"
DEFAULT_BLOCK_ROWS = 2048

#: Files that a block sample means to choose at least; with no more than that, blocks are chosen in all of them.
LEAST_FILES = 64


def limit_sample(df: DataFrame, n: int = DEFAULT_LIMIT) -> DataFrame:
    return df.limit(n)


def bernoulli_sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    if percent is None:
        raise ValueError(PERCENT_REQUIRED)
    return df.sample(withReplacement=False, fraction=float(percent) / 100.0, seed=seed)


def hash_sample(df: DataFrame, percent: float, key: Sequence[str] | str, seed: int = 42) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.where(keep_fraction(seed, percent, *[F.col(k) for k in keys]))


def block_key(block_rows: int = DEFAULT_BLOCK_ROWS) -> list[Column]:
    """Default block id of a file-based row: (file path, row index // n)."""
    return [F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / F.lit(block_rows))]


def file_share(df: DataFrame, percent: float, least_files: int = LEAST_FILES) -> float:
    """Percent of the files to choose so that about ``least_files`` or more are."""
    files = len(df._jdf.inputFiles())  # the scan's own index holds them
    return max(float(percent), min(100.0, 100.0 * least_files / max(1, files)))


def system_sample(df: DataFrame, percent: float, seed: int = 42,
                  block: Sequence[Column] | None = None,
                  block_rows: int = DEFAULT_BLOCK_ROWS, least_files: int = LEAST_FILES) -> DataFrame:
    """Keep whole blocks of rows.

    ``block`` gives the block id.  Made of partition columns, it prunes the scan to
    the chosen partitions and is independent of the files' layout.

    Without it, files are chosen by a hash of their path (about ``least_files`` of them
    or more; Spark drops the others while it plans the scan), and blocks of ``block_rows``
    rows in those by a second hash, so that each block is kept with ``percent`` in all.
    """
    if percent is None:
        raise ValueError(PERCENT_REQUIRED)
    if block is not None:
        return df.where(keep_fraction(seed, percent, *block))
    share = file_share(df, percent, least_files)
    if share == 0:
        return df.where(F.lit(False))
    if share < 100:
        df = df.where(keep_fraction(seed + 1, share, F.col("_metadata.file_path")))
    if share == percent:
        return df
    return df.where(keep_fraction(seed, 100.0 * percent / share, *block_key(block_rows)))


def sample(df: DataFrame, method: str = "limit", limit: int | None = None,
           percent: float | None = None, seed: int | None = None,
           key: Sequence[str] | str | None = None, order_by: Sequence[str] | None = None,
           block: Sequence[Column] | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Dispatch like the reference's ``sample_data``: method, limit, percent.

    ``limit`` is applied after a percent sample (M4); ``order_by`` makes that
    limit deterministic.  ``limit`` defaults to 100 for the limit method.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "limit":
        return limit_sample(df, DEFAULT_LIMIT if limit is None else limit)
    if percent is None:
        raise ValueError(PERCENT_REQUIRED)
    if method == "bernoulli":
        out = bernoulli_sample(df, percent, seed)
    elif method == "system":
        out = system_sample(df, percent, 42 if seed is None else seed, block, block_rows)
    else:
        if key is None:
            raise ValueError("hash sampling needs key column(s)")
        out = hash_sample(df, percent, key, 42 if seed is None else seed)
    if order_by:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    return out


def to_records(df: DataFrame, keep: Sequence[str] = (), name: str = "record") -> DataFrame:
    """M7: each row as one JSON object keyed by column name."""
    return df.select(*keep, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))
