"""From raw documents to token ids: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. All but the last return the columns of ``documents``.

Defined results: a null text counts as empty; rows without an id are documents like others, behind those with ids where
one of a group stays; of rows with equal id and text one stays; further columns of ``documents``, whatever their names, are
carried through all stages but the last; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenite.llm import bpe, cdc, crf, simhash, tiling
from selenite.llm.common import materialize, read_table

#: The tokenizer's file; a parameter, never copied.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores under 0.3 go."""
    return crf.filter_good(docs, crf.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links and of five-word Jaccard 0.8 the document with the least id stays."""
    return simhash.keep_first(docs, jaccard=0.8)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of repeated chunks are cut out of the later texts; every document stays."""
    cut = cdc.remove_spans(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in any order, go."""
    return tiling.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document left."""
    coded = bpe.encode(docs, bpe.prepare(docs, VOCABULARY), keep=["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
#: The stages' models and hashes are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
