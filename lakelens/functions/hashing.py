"""Layout-independent hash predicates for reproducible samples (M3, M5).

A row (or block) is kept when the first 52 bits of md5(seed|key), as a fraction
of 2^52, are below percent/100, so percentages far below 0.01 work too.
A key value is written as ``v`` and its text, a NULL as ``n``.  The same
expression is plain SQL in any engine with md5, so a sample can be
re-derived anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits used; a DOUBLE holds their value exactly.
DIGITS = 13


def hash_fraction(seed: int, *keys: Column) -> Column:
    """md5(seed|k1|k2...) as a number in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[
        F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys])
    head = F.substring(F.md5(text), 1, DIGITS)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(16 ** DIGITS))


def keep_fraction(seed: int, percent: float, *keys: Column) -> Column:
    """True for about ``percent`` % of distinct key values."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    return hash_fraction(seed, *keys) < F.lit(float(percent) / 100.0)
