"""Runs that can be taken up again: recorded steps under the fingerprint of what they were made from."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commits
from ..functions.joins import Sized, materialize


def _files_of(df: DataFrame) -> list:
    """Number, bytes and a digest of the paths, lengths and times of the files that ``df`` reads."""
    paths = df.inputFiles()
    if not paths:
        raise ValueError("an input without files has no state of its own: pass `inputs`, e.g. a snapshot's id")
    files = df.sparkSession.read.format("binaryFile").load(paths)
    row = files.agg(F.count(F.lit(1)), F.sum("length"),
                    F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return [int(v) for v in row]


def fingerprint(spark: SparkSession, inputs: dict[str, DataFrame], parameters, state: str | None = None) -> str:
    """A digest of the inputs' files and plans and of the parameters (any values with a stable ``repr``).

    Rewriting, adding or removing an input file changes it. ``state`` replaces the look at
    the files where a table's own snapshot id says the same.
    """
    files = state if state is not None else {name: _files_of(df) for name, df in inputs.items()}
    schemas = {name: df.schema.simpleString() for name, df in inputs.items()}
    text = json.dumps([files, schemas, repr(parameters)], sort_keys=True)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:32]


class RunFolder:
    """The steps of one run: ``step`` computes and records a table, or returns the recorded one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _record(self, name: str) -> str:
        return f"{self.path}/done/{name}.json"

    def step(self, name: str, df: DataFrame, partition_by: str | None = None) -> Sized:
        """``df`` written and counted under ``name``; when that was recorded before, what lies there.

        A step counts as done when its record is there, which is put in place at once
        after the write; what a lost driver left half written is never read.
        """
        if commits.exists(self.spark, self._record(name)):
            return self._recorded(name, df)
        folder = f"data/{name}-{uuid.uuid4().hex}"
        made = materialize(df, partition_by, f"{self.path}/{folder}")
        try:
            commits.put_new(self.spark, self._record(name), json.dumps({"folder": folder, "rows": made.rows}))
        except FileExistsError:  # the same run elsewhere was faster: all go by one result
            commits.delete(self.spark, made.path)
            return self._recorded(name, df)
        return made

    def _recorded(self, name: str, df: DataFrame) -> Sized:
        seen = json.loads(commits.get_text(self.spark, self._record(name)))
        path = f"{self.path}/{seen['folder']}"
        return Sized(self.spark.read.schema(df.schema).parquet(path), seen["rows"], path)

    def release(self) -> None:
        """Delete the records, then the tables."""
        commits.delete(self.spark, f"{self.path}/done")
        commits.delete(self.spark, self.path)
