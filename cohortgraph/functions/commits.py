"""Numbered commit files: what a folder holds is what its newest commit names.

Data folders are written first, under names of their own; then one small JSON file
``commits/<number>.json`` that names them is put in place by a rename which fails
when the number is taken. Readers go by the newest commit only, so they see
all of a change or nothing of it, and of two writers that build on the same commit
one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGITS = 10


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, but for hidden ones; none when there is no such folder."""
    p, fs = _hadoop(spark, folder)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in found if not n.startswith((".", "_")))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Create the file ``path`` at once and whole; FileExistsError when it is there already."""
    target, fs = _hadoop(spark, path)
    jvm = spark._jvm
    fs.mkdirs(target.getParent())
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(part, target, options)  # without OVERWRITE: fails when the target is there
    except Exception as e:
        fs.delete(part, False)
        if fs.exists(target):
            raise FileExistsError(path) from e
        raise


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _commit_path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/commits/{number:0{_DIGITS}d}.json"


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """Number and content of the newest commit; (0, None) when there is none."""
    found = names(spark, f"{folder.rstrip('/')}/commits")
    numbers = [int(n.removesuffix(".json")) for n in found if n.endswith(".json")]
    if not numbers:
        return 0, None
    number = max(numbers)
    return number, json.loads(get_text(spark, _commit_path(folder, number)))


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Put commit ``number`` in place; FileExistsError when another writer was faster."""
    put_new(spark, _commit_path(folder, number), json.dumps(content, sort_keys=True))


def listed_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """The data files under ``path``: path, length, modified. Their contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(path))
    return files.select("path", "length", F.col("modificationTime").alias("modified"))
