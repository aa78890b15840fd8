"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; whoever runs the
stages writes each result as Parquet and reads it again as the next one's docs.
"""

from __future__ import annotations

from inkstream.llm import line_dedup, mixing, ngram_join, packing, shared, toxicity


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity models reject go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark, docs, sf_dir):
    """Later repeats of runs of 50 words or more go, and documents that consist of nothing else."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents linked by a similarity of 0.8, the one with the least doc_id stays."""
    return ngram_join.distinct_documents(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as their source's target has them."""
    return mixing.mix(docs)


def pack(spark, docs, sf_dir):
    """Token pieces and their places in sequences of 2048."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: The models, the tokenizer and the packing plan can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
