"""Registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers

from triagelens.llm import bpe, fingerprints, html_extraction, jaccard_join, license_scan, mixing, quality_model, quality_rules, secret_scan, spelling, suffix_dedup, token_files, whitening
from triagelens.llm.common import table


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    return html_extraction.main_texts(table(spark, sf_dir, "pages"))


def op6_quality_model(spark, sf_dir):
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_token_files(spark, sf_dir):
    return token_files.token_stream(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_bpe, op3_license_scan, op4_suffix_dedup, op5_html_extraction, op6_quality_model, op7_secret_scan, op8_quality_rules, op9_jaccard_join, op10_mixing, op11_whitening, op12_spelling, op13_token_files)}
SQL = {"op3_license_scan": license_scan.SQL, "op7_secret_scan": secret_scan.SQL, "op8_quality_rules": quality_rules.SQL, "op10_mixing": mixing.SQL}
