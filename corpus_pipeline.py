"""A corpus pipeline of five stages: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All
but the last return the columns of ``docs``, extra ones included, whatever their names. An empty table gives an empty
one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import gam_quality, lp_packing, near_copies, pii_surrogates, temperature_mix
from weftgraph.llm.common import discard, read, written
from weftgraph.llm.queries import surrogate_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text has a score like any other; repeated rows and rows without doc_id are judged each on its own.
    Without labels, or with labels of one kind, all scores are the share of label 1.
    """
    return gam_quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard coefficient of 0.8 or more on five-word shingles, the one with the smallest doc_id stays.

    Texts without words, null ones included, are one group; rows without doc_id come after all others; of ties and of
    repeated rows one stays. Links are followed, so the first and the last of a chain are in one group.
    """
    return near_copies.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities give way to their surrogates, and n_chars follows the text.

    Null and empty texts stay as they are, and so do texts without entities; equal texts stay equal.
    """
    return pii_surrogates.clean_documents(docs, surrogate_key(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought nearer to equal weights; no document goes, those of small sources come up to twice.

    A null source is a source of its own, and a null or empty text counts as one token. Rows that are alike in all
    columns are drawn each on its own, and their copies come out alike.
    """
    return temperature_mix.mixed_documents(docs, repeats=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens.

    A null or empty text is its end token; repeated rows and rows without doc_id are packed like others.
    """
    return lp_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]
#: SQL can express neither the classifier nor the packing; tests hold run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; of the stages' tables only the last one is kept."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
