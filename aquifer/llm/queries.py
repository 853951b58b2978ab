"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aquifer.llm import (fill_in_middle, heap_kmeans, host_rules, huffman, jaccard_join, kneser_ney, licenses, mixing, neighbours,
                         packing, page_text, simhash, toxicity)
from aquifer.llm.oracles import FILL_IN_MIDDLE, HOST_RULES, JACCARD_JOIN, MIXING, clusters_sql
from aquifer.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op3_host_rules": HOST_RULES, "op6_jaccard_join": JACCARD_JOIN, "op10_sainte_lague_mix": MIXING,
    "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_heap_kmeans": clusters_sql(),
}

#: Folder of the public tokenizers' files, a parameter of the deployment.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(read_table(spark, sf_dir, "documents"))


@query
def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents"))


@query
def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", end_id=0)


@query
def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=1)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op8_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


@query
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(read_table(spark, sf_dir, "documents"))


@query
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read_table(spark, sf_dir, "pages"))


@query
def op11_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(read_table(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.round_trip(read_table(spark, sf_dir, "documents"))


@query
def op13_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_kmeans.cluster(read_table(spark, sf_dir, "embeddings"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)
