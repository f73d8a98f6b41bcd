from __future__ import annotations

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row long, digest string, shard int, n long, t string, h long, key long, size string, top long")

LONG = " ".join(f"satz{i} et{i % 7} de." for i in range(9000))

ODD = [
    (1, "The cat sat on the mat.", "en", "a", 1),
    (1, "The cat sat on the mat.", "en", "a", 1),
    (2, "the cat sat on the MAT.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \n\t ", "en", "b", 0),
    (None, "no id here 123 <|endoftext|> don't", "en", None, 3),
    (None, None, None, None, None),
    (6, "x" * 70000, "en", "c", 1),
    (7, LONG, "de", "c", 1),
    (8, LONG + " fin.", "de", "c", 1),
    (9, "éß ñ 中文 😀 \x85\x0b a", "fr", "a", 1),
    (10, "The cat sat on the mat.", "en", "d", 1),
    (10, "another text under the same id", "en", "d", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    extra = (7, "x", 3, 1, "t", 5, 9, "s", 2)
    return spark.createDataFrame([r + extra for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def sf001(spark):
    from tests.conftest import SF001

    return spark.read.parquet(f"{SF001}/documents.parquet")
