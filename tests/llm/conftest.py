from __future__ import annotations

import pytest

#: Columns whose names the operators use inside.
CLASHING = "id long, node long, component string, row int, fp long, words string, label int, shard int, window long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 997} x{i % 31}" for i in range(30_000))
    texts = [None, "", " \n\t", "one", "one two", "Same text here, with nine words in it altogether.", "Same text here, with nine words in it altogether.", long, "a" * 5000, "ñandú é ü 漢字   x́ <|endoftext|>", "A\n\nb\nA\nb"]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None, i, i, "c", 1, 2, "w", 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[7], (None, "text without an id", None, None, None, *[None] * 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return odd_documents.limit(0)
