"""A cleaning pipeline over `documents`: each stage reads what the stage before has written.

1. toxicity: documents that the classifier predicts toxic go.
2. quality rules: documents that the rules, a gross failure of one, or their host's record (bound from the fitted prior)
   reject go.
3. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays.
4. mixing: sources are mixed to their target weights; a row for each copy that is taken.
5. packing: the mix as pieces of sequences of 2048 tokens.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of `docs`. Repeated rows, null ids and
null texts are allowed in each: a row that a stage judges is kept or goes as that stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquifer.llm import host_rules, jaccard_join, mixing, packing, toxicity
from aquifer.llm.common import freeze, keyed, sent, shared_folder
from aquifer.llm.queries import TOKENIZERS
from aquifer.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    scored = toxicity.judge(rows, read_table(spark, sf_dir, "labels"), [key])
    return without(rows, key, scored.where(F.col("score") >= 0.5).select(F.col(key).alias("__bad"))).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    bad = host_rules.judge(rows, keep=[key], habit=None, gross=True).where("not kept").select(F.col(key).alias("__bad"))
    return without(rows, key, bad).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    joined = jaccard_join.join(rows, key=key)
    bad = joined.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__bad"))
    return without(rows, key, bad).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, f"{TOKENIZERS}/word_bpe_49k.json", end_id=1)


def without(rows: DataFrame, key: str, bad: DataFrame) -> DataFrame:
    """Rows whose key is not in `bad`."""
    bad = sent(freeze(bad, "dropped"))
    return rows.join(bad, F.col(key) == F.col("__bad"), "left_anti")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, near-duplicate classes and token ids are not SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{k + 1}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
