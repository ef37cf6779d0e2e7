"""Access to the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``folder``; with ``columns`` only those, under exactly these names.

    Names are matched without regard to case, an exact match first, so extra columns that differ in case do no harm.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return pick(df, *columns) if columns else df


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Select ``columns`` by position after matching names, which no clashing extra column can make ambiguous."""
    names = df.columns
    if len({n.lower() for n in names}) == len(names):
        return df.select(*[df[c].alias(c) for c in columns])
    positions = []
    for c in columns:
        exact = [i for i, n in enumerate(names) if n == c]
        positions.append(exact[0] if exact else next(i for i, n in enumerate(names) if n.lower() == c.lower()))
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[plain[f"_{i}"].alias(c) for i, c in zip(positions, columns)])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it comes in fewer, as a single small file does.

    Only for work that is heavy for each row; a table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)
