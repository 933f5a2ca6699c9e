"""Corpus pipeline: five stages over the documents table.

Each stage takes what its predecessor kept, with the columns of documents; the
last one returns the packed pieces.
"""

from __future__ import annotations

from nocturne.llm import cascade, cotraining, disclosure, jaccard, packing
from nocturne.llm.common import read, tokenizer_path
from nocturne.session import shuffles_freed, stage, unstage


def quality_classifier(spark, docs, sf_dir):
    """Documents that the co-trained classifier accepts."""
    return cotraining.keep_good(docs, read(spark, sf_dir, "labels"))


def quality_rules(spark, docs, sf_dir):
    """Documents that no rule of the cascade rejects."""
    return cascade.keep_passing(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def personal_data(spark, docs, sf_dir):
    """Sanitised texts."""
    return disclosure.sanitise(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]
ORACLE_SQL: str | None = None  # a trained classifier, sanitising and packing have no SQL


def run(spark, sf_dir):
    """The stages one after another, each written and read again; what a stage
    read and shuffled goes when it has been written."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        last, found = docs, step(spark, docs, sf_dir)
        with shuffles_freed(spark):
            docs = stage(found, name)
        unstage(last)
    return docs
