from __future__ import annotations

import pytest

from tests.conftest import SF001

LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) of the smallest driver folder."""
    return [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (5, "one two three"), (6, LONG), (7, LONG + " end"),
        (8, PASSAGE + "\nown words of eight"), (9, "before it " + PASSAGE + "\nand after"), (9, "before it " + PASSAGE + "\nand after"),
        (None, PASSAGE), (None, None), (10, "a\nb\nc\nd\na\nb\nc\nx"), (11, "z\na\nb\nc\nd"), (12, "\n\n\n\n\n"),
        (13, "\n\n\n\n"), (14, "é日本 ﬁ ▁x  y <|im_end|> don't"), (15, "x" * 3000), (16, PASSAGE.upper()), (17, ""),
    ]
    names = ["doc_id", "text", "lang", "source", "n_chars", "id", "k1", "copy", "score", "size", "x", "ids", "pos", "w"]
    data = [(d, t, "en", "s", None if t is None else len(t), 1, 2, "c", 0.5, 3, "x", [1], "p", None) for d, t in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(
        names, ["bigint", "string", "string", "string", "bigint", "int", "int", "string", "double", "int", "string",
                "array<int>", "string", "string"])))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
