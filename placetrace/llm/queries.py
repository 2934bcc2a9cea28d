"""Registered queries of the operators, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from placetrace.llm.decontaminate import contaminated
from placetrace.llm.licences import licence_scan
from placetrace.llm.lm_score import cross_entropy_difference, good_documents
from placetrace.llm.near_text import near_duplicates
from placetrace.llm.near_vectors import near_vectors
from placetrace.llm.oracle import ORACLE
from placetrace.llm.packing import pack, token_lengths
from placetrace.llm.pii import digest, personal_data
from placetrace.llm.quality import quality
from placetrace.llm.repair import damage_and_repair
from placetrace.llm.resample import resample
from placetrace.llm.sharding import shards
from placetrace.llm.suffix_dedup import suffix_dedup
from placetrace.llm.tables import table
from placetrace.llm.toxicity import toxicity

QUERIES = {}

__all__ = ["ORACLE", "QUERIES"]


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query
def op7_shards(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents"))


@query
def op9_packing(spark, sf_dir):
    return pack(token_lengths(table(spark, sf_dir, "documents")))


@query
def op4_minhash_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_embedding_links(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_suffix_dedup(spark, sf_dir):
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_lm_score(spark, sf_dir):
    target = good_documents(table(spark, sf_dir, "labels"))
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


@query
def op1_licence_scan(spark, sf_dir):
    return licence_scan(table(spark, sf_dir, "documents"))


@query
def op11_pii_spans(spark, sf_dir):
    return digest(personal_data(table(spark, sf_dir, "documents")))


@query
def op12_conversation_repair(spark, sf_dir):
    return damage_and_repair(table(spark, sf_dir, "conversations"))


@query
def op13_importance_resample(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
