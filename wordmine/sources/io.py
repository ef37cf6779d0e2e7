"""Documents from CSV files, text files and literals, and the sinks of reports and word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the column that holds article bodies.
BODY = "NEWS_BODY"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of articles with header, quoted cells over several lines and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)


def write_articles(df: DataFrame, path: str) -> None:
    """``df`` as such a CSV, every cell in quotes."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def longest_cell(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The longest of a row's cells as text, the first of equals; nulls count as empty."""
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or df.columns])
    return F.aggregate(cells, F.lit(""), lambda best, cell: F.when(F.length(cell) > F.length(best), cell).otherwise(best))


def body_column(df: DataFrame) -> Column:
    """The body column if there is one, else the longest cell."""
    found = next((c for c in df.columns if c.lower() == BODY.lower()), None)
    return F.col(f"`{found}`") if found else longest_cell(df)


def load_docs(spark: SparkSession, source: str, literal: int = 50, key: str | None = None, row: int | None = None) -> DataFrame:
    """``(doc_id, text)`` of a CSV file, a text file, or a string longer than ``literal`` characters that is the text itself.

    ``doc_id`` is the column ``key`` of a CSV file if one is named, else an increasing number, which is the place of the
    row where the file is read by one task, as one with cells over several lines is. ``row`` picks one document.
    """
    if len(source) > literal and not source.lower().endswith((".csv", ".txt")):
        return spark.createDataFrame([(0, source)], "doc_id bigint, text string")
    if source.lower().endswith(".csv"):
        df = read_articles(spark, source)
        place = F.col(f"`{key}`").cast("bigint") if key else F.monotonically_increasing_id()
        docs = df.select(place.alias("doc_id"), body_column(df).alias("text"))
        return docs if row is None else docs.where(F.col("doc_id") == row)
    return spark.read.text(source, wholetext=True).select(F.lit(0).cast("bigint").alias("doc_id"), F.col("value").alias("text"))


def write_words(words: DataFrame, path: str, column: str = "word") -> None:
    """Words in order, one per line, in UTF-8."""
    words.select(column).where(F.col(column).isNotNull()).orderBy(column).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str, buckets: int = 16) -> None:
    """A CSV report with header: the rows of all documents in ``buckets`` directories by a hash of ``doc_id``, each document's rows together.

    With the column ``pct`` a document's rows go down by it, else by ``tfidf``, ties by ``match``.
    """
    order = [F.desc(c) for c in ("pct", "tfidf") if c in report.columns][:1] + [F.col(c) for c in ("match",) if c in report.columns]
    split = report.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "doc_id", *order)
    split.write.mode("overwrite").option("header", True).partitionBy("bucket").csv(path)


def with_word_lists(docs: DataFrame, words: DataFrame, to: str = "EN_LIST") -> DataFrame:
    """``docs`` with the sorted distinct words of each document; empty for none."""
    lists = words.groupBy("doc_id").agg(F.sort_array(F.collect_set("word")).alias(to))
    return docs.join(lists, "doc_id", "left").withColumn(to, F.coalesce(F.col(to), F.array().cast("array<string>")))
