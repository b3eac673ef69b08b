"""The registered queries of the numbered operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers

from turnout.llm import leaks, near, passes, trie, urls
from turnout.llm.base import table
from turnout.llm.bpe import digests
from turnout.llm.counts import token_counts
from turnout.llm.language import languages
from turnout.llm.pages import main_text
from turnout.llm.periodic import run_digests
from turnout.llm.pii import pii_digests
from turnout.llm.repair import packed
from turnout.llm.rules import quality

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_url_verdicts(spark, sf_dir):
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


def op2_token_files(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_language(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii_digests(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark, sf_dir):
    return run_digests(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark, sf_dir):
    return passes.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_verdicts": op1_url_verdicts,
    "op2_token_files": op2_token_files,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_pii": op6_pii,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_main_text": op10_main_text,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_near_vectors": op13_near_vectors,
}

ORACLES: dict[str, str] = {
    "op1_url_verdicts": urls.oracle(),
    "op3_near_duplicates": near.oracle(),
    "op9_decontamination": leaks.oracle(),
    "op11_conversation_trie": trie.oracle(),
    "op13_near_vectors": passes.oracle(),
}
