"""Decimal bounds kept as text but compared as numbers.

The text of a decimal of any precision and scale is split into its whole part
and its signed fraction, both exact DECIMALs, so no cast to a common scale
can overflow or round.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_key_sql(text: str) -> str:
    """SQL: a struct that orders decimal texts by value."""
    whole = f"CAST(substring_index({text}, '.', 1) AS DECIMAL(38,0))"
    sign = f"if(startswith({text}, '-'), '-0.', '0.')"
    digits = f"if(instr({text}, '.') > 0, substring_index({text}, '.', -1), '0')"
    return f"struct({whole} AS w, CAST(concat({sign}, {digits}) AS DECIMAL(38,38)) AS f)"


def decimal_bound_sql(bound: str, text: str) -> str:
    """SQL aggregate: the least (``min``) or greatest (``max``) decimal text."""
    return f"{bound}_by({text}, CASE WHEN {text} IS NOT NULL THEN {decimal_key_sql(text)} END)"


def decimal_bound(bound: str, text: str) -> Column:
    return F.expr(decimal_bound_sql(bound, text))
