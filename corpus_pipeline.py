"""The corpus pipeline: quality, exact dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and rereads it as the next stage's
documents.  The mixing stage leaves its documents sorted by finish time over the
files it is written to, and packing concatenates them in the order of files and
rows, so sequences follow the mix.  The last stage returns one row per piece of
a packed sequence, with its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.exact_dedup import exact_dedup_stage
from helixframe.llm.mixing import mixing_stage
from helixframe.llm.near_dedup import near_dedup_stage
from helixframe.llm.packing import packing_stage
from helixframe.llm.quality import quality_stage
from helixframe.llm.store import read, write_table

STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The quality model, the sketches and the tokenizer are beyond SQL.
#: ``test_pipeline_against_brute_force`` follows run() with plain Python from the
#: documents that the quality stage keeps to the ids of every piece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{name}")
    return docs
