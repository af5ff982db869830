"""A corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of ``documents``.

Defined results: a null text is scored as an empty one, keeps its lines, is no
copy and no leak, and has no ids; an empty text likewise; rows that repeat an id
and a text are one document in every stage and stay or go together; of rows with
a null id none is a copy; texts of any length are read whole; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import decontaminate, line_dedup, near_dup, quality_classifier, sentencepiece_viterbi
from basalt.llm.common import Scratch, table
from basalt.llm.queries import PIECE_MODEL, quality_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_classifier.score_quality(docs, quality_model(spark, docs, sf_dir)).where("predicted = 1").select(COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; those of which no word is left go."""
    cleaned = line_dedup.dedup_lines(docs)
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.where(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8)."""
    return near_dup.drop_near_duplicates(docs).select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, and whether these decode to the text."""
    coded = sentencepiece_viterbi.encode_decode(docs.select(COLUMNS), PIECE_MODEL)
    return coded.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded").withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", cut_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: Classifier and encoder have no SQL form; tests/llm/test_edges.py checks every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents").select(COLUMNS), Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
