"""A training corpus from ``documents``: five stages, each written and read again before the next.

1. quality: documents that the classifier scores below its threshold go.
2. line dedup: lines that resemble an earlier line are cut; a document goes if nothing but cut lines was in it.
3. near duplicates: one document of each class of linked documents stays.
4. mixing: sources are brought to their target weights; a document may come up to twice.
5. packing: what is left becomes sequences of tokens.

The stages before the last return the columns of ``documents``; n_chars follows the text. SQL cannot express the
classifier, so the rows of :func:`run` are tested against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.llm import grams, lines, mixing, packing, quality
from korvex.llm.common import Workspace

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.drop_repeated_lines(docs, names=("__lines", "__removed"))
    cut = cut.where((F.col("__removed") == 0) | (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grams.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", cut_lines),
    ("gram_join", drop_copies),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
