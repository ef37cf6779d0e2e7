"""The two article tables as one stream of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.sources.tables import spread, table

BLANKS = " \\t\\r\\n"


def is_blank(body: Column) -> Column:
    """True for null and for bodies of nothing but space, tab, CR and LF."""
    return body.isNull() | ~body.rlike(f"[^{BLANKS}]")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``(src, row_id, body)`` of both tables without blank bodies; a row delivered twice appears twice."""
    parts = [
        spread(table(spark, folder, name, key, body)).select(F.lit(name).alias("src"), F.col(key).cast("bigint").alias("row_id"), F.col(body).alias("body"))
        for name, key, body in (("text", "_c0", "NEWS"), ("longtext", "row_no", "NEWS_BODY"))
    ]
    both = parts[0].unionByName(parts[1])
    return both.where(~is_blank(F.col("body")))
