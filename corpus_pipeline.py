"""The corpus pipeline: filter, deduplicate, decontaminate and pack `documents`.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with all
their columns; the last one returns packed pieces. `run` stores every stage's
result in the shared folder and hands the stored rows to the next stage.
"""

from tidemark.llm import stages
from tidemark.llm.common import stored, table

STAGES = [
    ("quality classifier", stages.quality_filter),
    ("exact dedup", stages.exact_dedup),
    ("minhash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontaminate),
    ("best-fit packing", stages.pack),
]

#: Learned models have no SQL twin; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
