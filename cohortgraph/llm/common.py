"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than blank, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (Spark compares without case)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def text_key(col: Column) -> list[Column]:
    """128 bits of a string as two independently seeded 64-bit hashes (null and '' differ)."""
    return [F.xxhash64(F.lit(17), col.isNull(), col).alias("k1"), F.xxhash64(F.lit(71), col.isNull(), col).alias("k2")]


def arrow_rows(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterable[dict] | dict],
               batch_chars: int = 1_000_000) -> DataFrame:
    """``mapInArrow`` with a function from one batch to one dict of columns (or several).

    The text batches that Spark sends are bounded by rows, not bytes, so each
    is cut again: no piece holds more than ``batch_chars`` of text unless one
    row alone does.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession.sparkContext)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, batch_chars):
                out = work(piece)
                for cols in ([out] if isinstance(out, dict) else out):
                    yield pa.RecordBatch.from_arrays(
                        [as_arrow(cols[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


_SHIPPED: set[str] = set()


def ship(sc) -> None:
    """Give the Python workers this package (as ``--py-files`` would), once per application."""
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="py-files-"), f"{package.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind, from_pandas=False)


def cut(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` whose buffers stay near ``chars`` bytes."""
    if batch.num_rows <= 1 or batch.nbytes <= chars:
        yield batch
        return
    half = batch.num_rows // 2
    yield from cut(batch.slice(0, half), chars)
    yield from cut(batch.slice(half), chars)


def hash_words(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(uniques, categorize=False)[codes]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit hash of every run of ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[:len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i]
    return mix64(out)
