"""Corpus pipeline: language identification, exact and near deduplication, mixing, packing.

The stages are applied in order; each is written and reread between, and works on all rows that the one before kept. Rows
are told apart as rows, so null and repeated ids are rows as others; null texts count as empty; an empty table gives an
empty one; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import exact_dedup, language, mixing, ngram_join, packing
from tempora.llm.common import columns_of, release, spool
from tempora.shipping import shipped
from tempora.tables import discard_all_but_last, mark

#: A document that isn't `und` stays if one language labels at least this share of its letters.
LEAST_SHARE = 0.5
#: The columns of predicted languages and their shares.
PREDICTED, SHARE = "_tempora_predicted", "_tempora_share"


@shipped
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a dominant language, each row by its own text; a missing `lang` gets the prediction.

    Texts that are null or without a letter go. Equal shares go to the language that is first in order.
    """
    found = language.labelled(docs, language.learn(docs), "text", PREDICTED, SHARE)
    kept = found.where((F.col(PREDICTED) != language.UNDETERMINED) & (F.col(SHARE) >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", PREDICTED)).select(*columns_of(docs))


@shipped
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest, then the one with the smallest id, null ids last. All empty texts are equal."""
    return exact_dedup.drop_copies(docs)


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest id, null ids last, of each group that links of five-word shingles at similarity 0.8 connect; texts without words stay."""
    return ngram_join.drop_near_copies(docs, words=5, percent=80)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops rows so that each source gives its target of words; null sources are one source, rows without words go."""
    return mixing.repeat_by_mix(docs)


@shipped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, packed; repeated rows are packed each for itself, an empty text as its end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Language models, tokenisation and packing have no SQL form; the stages are held against brute force in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, f"stage-{k}")
            discard_all_but_last(spark, since)  # the tables that the stage made, and what it read
            release(spark)
    return docs
