"""A corpus pipeline: quality rules, near duplicates, personal data, mixing and pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents.

1. quality_rules: drops documents that the rules reject, and lines over their
   limit from the others.
2. near_duplicates: of each component of 3-word-shingle Jaccard links, the
   document with the smallest doc_id stays.
3. pii: personal data become format-preserving pseudonyms.
4. mixing: sources are drawn to their target weights. A document is a row for
   each epoch it is taken in; the one at a budget's edge keeps its first words.
5. sentencepiece: the n best segmentations of every row, with their ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import jaccard, mixing, pieces, pii, quality_rules
from veilframe.llm.common import ship, small_batches_from_here, table, written
from veilframe.llm.entry import PII_KEY

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.one_of_each(docs).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # whatever their names
    found = pii.pseudonymise(docs.select(rest.alias("__doc"), "text"), PII_KEY)
    own = {c: F.col("__doc").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("text").isNull(), own["n_chars"]).otherwise(F.char_length("text").cast("long"))
    return found.select(*[own[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches_from_here(spark)  # the earlier stages are written with small batches; this one is written by the caller
    return pieces.encode_n_best(docs, MODEL, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("pii", private),
    ("mixing", mixed),
    ("sentencepiece", segmented),
]

#: Feistel pseudonyms and piece lattices are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
