"""Cleaning, tokens and sentences on streams: the same expressions, row by row, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.functions.clean import clean
from wordmine.operators.tokens import sentences, tokenize


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """Parquet files of documents as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def clean_stream(docs: DataFrame, profile: str = "search") -> DataFrame:
    """``(doc_id, clean)``."""
    return docs.select("doc_id", clean(F.coalesce(F.col("text"), F.lit("")), profile).alias("clean"))


def token_stream(docs: DataFrame, profile: str = "search", least: int = 2) -> DataFrame:
    """``(doc_id, pos, token)``."""
    return tokenize(clean_stream(docs, profile), "clean", least)


def sentence_stream(docs: DataFrame, profile: str = "search") -> DataFrame:
    """``(doc_id, sent_id, sentence)``."""
    return sentences(clean_stream(docs, profile))
