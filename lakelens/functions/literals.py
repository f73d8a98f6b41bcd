"""Small literal tables built JVM-side.

``spark.createDataFrame(list)`` plans as a Python-backed RDD scan, which
needs Python workers at execution; schema rows, column metadata and name
lists are instead one JSON literal parsed by ``from_json`` over a one-row
range: a JVM-only plan with a fixed number of expressions, however many rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A DataFrame of ``rows`` with ``columns`` = [(name, SQL type)]."""
    fields = [f"c{i}" for i in range(len(columns))]
    schema = "ARRAY<STRUCT<" + ", ".join(f"{k}: {t}" for k, (_, t) in zip(fields, columns)) + ">>"
    text = json.dumps([dict(zip(fields, r)) for r in rows])
    parsed = spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))
    return parsed.toDF(*[c for c, _ in columns])
