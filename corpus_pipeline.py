"""The corpus pipeline: documents in, cleaned, deduplicated and encoded documents out.

``run`` applies the stages in order; each stage's rows are written as Parquet
in the shared checkpoint folder and read again as the next stage's documents,
so a lost executor costs at most the stage that was running.
"""

from __future__ import annotations

import uuid

from cohortgraph.llm import decontaminate, lattice, line_dedup, minhash, toxicity
from cohortgraph.session import ensure_checkpoint_dir

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("sentencepiece", lattice.stage),
]

#: SQL can't express the network, the sketches or the encoder; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}_{name}")
    return docs
