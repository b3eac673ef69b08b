"""From raw documents to token ids.

Each stage works on all that the one before it kept, as written and read again.  Tables may be
empty and columns null; what a stage does with such rows is said in its operator's module.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from turnout.llm.base import saved, table
from turnout.llm.bpe import encoded
from turnout.llm.leaks import clean
from turnout.llm.near import one_of_each
from turnout.llm.pii import without_personal_data
from turnout.llm.rules import good

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules or the outlier test reject go."""
    return good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays, the one with the smallest id."""
    return one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that benchmark windows cover to a twentieth or more go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data in texts is masked; every document stays."""
    return without_personal_data(docs)


def token_ids(spark, docs, sf_dir):
    """``doc_id``, ``n_tokens`` and the ``ids`` of every text."""
    return encoded(docs, VOCABULARY).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: The outlier test and the signatures of the first two stages are not put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs, f"stage-{n}")
    return docs
