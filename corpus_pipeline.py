"""A training corpus from raw documents: rejects bad ones, keeps one of each group of near-copies, removes repeated passages
and benchmark text, and encodes what is left.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows as Parquet
into the shared folder and reads them again for the next, so a lost executor costs one stage at most. All stages but the
last return the columns of documents (n_chars follows the text); other columns, whatever their names, are dropped.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and ids, and empty tables (which give
empty ones). Rows without an id are as later than all ids where ids decide. A very long text is worked on whole in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.llm import decontamination, pieces, quality, simhash, substring_dedup
from litgrid.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good. Null and empty texts have the score of no difference; without labels all stay. Equal texts share their fate."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(quality.keep_good(docs.select(*COLUMNS), model))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-copies: texts whose five-word shingles have a similarity of 0.8 or more. Texts without words are one group; of rows with the same id and text one stays; rows without an id all stay."""
    return _documents(simhash.keep_one(docs.select(*COLUMNS)))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has; all other words and white space stay as they are, and documents of which no word is left go. A null text is one without words and becomes an empty one."""
    found = substring_dedup.remove_repeats(docs, keep=("lang", "source"), columns=("doc_id", "n_words", "n_removed", "clean_text"))
    return _documents(found.where("n_removed = 0 OR n_removed < n_words").withColumn("text", F.col("clean_text")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents of which over half the words are such passages go. Null and empty texts stay as they are; without items so do all."""
    return _documents(decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's piece numbers and the text they decode to; a null text as an empty one."""
    import public_tokenizers

    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_pieces", "ids", "text", "lossless")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL cannot train the classifier's dictionaries; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
