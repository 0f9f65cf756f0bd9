"""A training-data pipeline over documents: score, cut repeats, drop near copies, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, mixing, order_minhash, quality, sentence_pieces
from spanloom.llm.common import cut, table


def held(docs: DataFrame) -> DataFrame:
    """Only what the operators read, beside the whole row: no column of docs can clash with theirs."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", "text", "source", *metadata_of(docs))


def metadata_of(docs: DataFrame) -> tuple[str, ...]:
    """Metadata that the classifier may use: not labels, language, source or id."""
    return tuple(c for c in docs.columns if c == "n_chars")


def rows_of(found: DataFrame) -> DataFrame:
    return found.select("row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that the quality classifier keeps; it learns from the labelled ones among them."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), meta_cols=metadata_of(docs))
    return rows_of(quality.score_documents(held(docs), machine).where("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without later repeated runs of lines; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(held(docs))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows_of(cleaned.select(row.alias("row")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return order_minhash.keep_one(docs, order_minhash.near_duplicates(docs)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each as often as the mixture takes it."""
    return rows_of(mixing.mix(held(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each row, as digests."""
    return sentence_pieces.digests(sentence_pieces.encode_documents(docs))


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentence_pieces", encode),
]

#: 64-bit hashes, fitted weights and pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
