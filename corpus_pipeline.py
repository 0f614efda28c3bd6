"""A corpus made ready for training, stage by stage.

Each stage takes `(spark, docs, sf_dir)` and returns a DataFrame, which `run` writes as
Parquet in the shared checkpoint folder and reads again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.bpe import public_vocabulary, round_trip
from gridlark.llm.columns import n_words
from gridlark.llm.mixing import curriculum, training_order
from gridlark.llm.quality import quality_cascade
from gridlark.llm.similar import one_of_each_similar
from gridlark.llm.suffixes import without_repeats
from gridlark.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A repeated passage of 50 words or more has this many bytes, unless its words are very short.
REPEAT_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; rules after the rejecting one are skipped."""
    return quality_cascade(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 of the five-word shingles or more."""
    return one_of_each_similar(docs.select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of REPEAT_BYTES that occur elsewhere; n_chars follows the text."""
    left = without_repeats(docs.select(*COLUMNS), length=REPEAT_BYTES)
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: each taken copy of a document is a row, in training order."""
    sized = docs.select(*COLUMNS, n_words(F.col("text")).alias("size"))
    return training_order(curriculum(sized)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, with digests of the ids and of what they decode to."""
    return round_trip(docs.select(*COLUMNS), *public_vocabulary(), keep_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("mixing_weights", mix),
    ("byte_bpe", tokens),
]

#: Fingerprints and token ids have no form in SQL; tests/llm follows all stages with plain walks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
