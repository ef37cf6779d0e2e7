"""Items of varying length in containers of fixed capacity, by vector best-fit.

Every container has three residuals, tokens, documents and attention cost (the sum of squared part lengths). An item
may only go where all three allow it, except that one too costly for any bin has a bin to itself, and of these bins it
takes the one with the best score: the smallest weighted norm of what is left, or the greatest weighted dot product of
item and residual. Items come largest first. The items are split by a hash of their id into groups of bounded size that
are packed on their own, so the number of tasks follows the data. No bin holds items of two groups: only the last bins of
each group can stay loose, one or two in some thousand, which is what packing groups apart costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.sources.tables import table

#: Items that are packed together on average, documents in one bin, weights of tokens, documents and attention cost.
GROUP, MOST_DOCS, WEIGHTS = 8192, 512, (1.0, 0.05, 0.1)
#: Capacity for the attention cost of a bin of several items, as a share of the squared capacity in tokens.
ATTENTION = 0.8

PACKED = "capacity bigint, doc_id bigint, part int, n_parts int, bin string, begin bigint, size bigint"


def byte_tokens(text: Column) -> Column:
    """Tokens under the byte-level tokenizer with one token per UTF-8 byte and no special tokens."""
    return F.octet_length(text).cast("bigint")


def model_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens under a ``.tiktoken`` vocabulary file, read once in every worker; null for null."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield part.map(lambda t: len(coder.encode_ordinary(t)), na_action="ignore").astype("Int64")

    return count(text)


def best_fit(sizes: np.ndarray, capacity: int, most_docs: int = MOST_DOCS, attention: int | None = None, weights: tuple = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The bin of each item. ``sizes`` are at most ``capacity``; equal sizes are taken in the order given.

    ``attention`` is the capacity for the sum of squares, ``capacity`` squared if not given; below that it keeps items
    apart whose tokens would fit. An item that exceeds it alone gets a bin of its own.
    """
    attention = capacity * capacity if attention is None else attention
    scale = np.array([capacity, most_docs, attention], np.float64)
    w = np.array(weights, np.float64)
    out = np.empty(len(sizes), np.int64)
    tokens, docs, cost = (np.zeros(len(sizes), np.float64) for _ in range(3))
    opened, least, live = 0, int(sizes.min(initial=capacity)), np.zeros(0, np.int64)
    for turn, k in enumerate(np.argsort(-sizes, kind="stable")):
        size = int(sizes[k])
        if turn % 256 == 0:  # bins that no item can enter any more leave the search
            live = live[(tokens[live] >= least) & (docs[live] >= 1) & (cost[live] >= least * least)]
        t, d, c = tokens[live], docs[live], cost[live]
        fits = np.flatnonzero((t >= size) & (d >= 1) & (c >= size * size))
        if len(fits):
            t, d, c = t[fits] / scale[0], d[fits] / scale[1], c[fits] / scale[2]
            item = size / scale[0], 1 / scale[1], size * size / scale[2]
            if rule == "norm":
                score = w[0] * (t - item[0]) ** 2 + w[1] * (d - item[1]) ** 2 + w[2] * (c - item[2]) ** 2
                at = live[fits[np.argmin(score)]]
            else:
                at = live[fits[np.argmax(w[0] * t * item[0] + w[1] * d * item[1] + w[2] * c * item[2])]]
        else:
            at = opened
            tokens[at], docs[at], cost[at] = scale
            opened += 1
            live = np.append(live, at)
        tokens[at] -= size
        docs[at] -= 1
        cost[at] -= size * size
        out[k] = at
    return out


def divide(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(capacity, doc_id, part, n_parts, begin, size)``: every document whole, or in full parts and a rest if it exceeds the capacity."""
    each = sizes.crossJoin(capacities)  # sent to the tasks only if Spark's own limit for broadcasts allows it
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity"))).cast("int")
    rows = each.withColumn("n_parts", parts).select("capacity", "doc_id", "n", "n_parts", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    begin = F.col("part") * F.col("capacity")
    return rows.select("capacity", "doc_id", "part", "n_parts", begin.alias("begin"), F.least(F.col("n") - begin, F.col("capacity")).alias("size"))


def pack(sizes: DataFrame, capacities: DataFrame, group: int = GROUP, most_docs: int = MOST_DOCS, rule: str = "norm", attention: float = ATTENTION) -> DataFrame:
    """Assign documents ``(doc_id, n)`` to bins of each capacity in ``(capacity)``; see ``PACKED`` for the columns.

    Only documents larger than a capacity are divided; their full parts fill a bin each and the rest is an item like
    any other. Documents of null or no size aren't placed, repeated rows of a document once, with the largest size.
    Null and non-positive capacities are left out. Equal sizes are taken in order of ``doc_id``. The squared sizes in
    a bin of several items add up to ``attention`` times the squared capacity at most.
    """
    docs = sizes.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("doc_id").agg(F.max("n").alias("n"))
    caps = capacities.where("capacity > 0").select(F.col("capacity").cast("bigint")).distinct()
    groups = max(1, -(-sizes.count() // group))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("part", "ascending")])
        capacity = key[0].as_py()
        size = rows["size"].to_numpy()
        bins = best_fit(size, capacity, most_docs, int(attention * capacity * capacity), rule=rule)
        names = pa.array([f"{capacity}-{key[1].as_py()}-{b}" for b in bins.tolist()], pa.string())
        cols = [rows["capacity"], rows["doc_id"], rows["part"], rows["n_parts"], names, rows["begin"], rows["size"]]
        yield from pa.table(cols, names=["capacity", "doc_id", "part", "n_parts", "bin", "begin", "size"]).to_batches()

    parts = divide(docs, caps).withColumn("chunk", chunk)
    full = (F.col("size") == F.col("capacity")) & (F.col("n_parts") > 1)
    alone = parts.where(full).withColumn("bin", F.format_string("%d-doc-%d-%d", "capacity", "doc_id", "part"))
    names = ["capacity", "doc_id", "part", "n_parts", "bin", "begin", "size"]
    packed = parts.where(~full).groupBy("capacity", "chunk").applyInArrow(run, PACKED)
    return alone.select(*names).unionByName(packed)


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents", "doc_id", "text").select("doc_id", byte_tokens(F.col("text")).alias("n"))
    return docs, table(spark, folder, "containers", "capacity")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that the packing divides, see TESTDATA.md."""
    return pack(*_inputs(spark, folder)).where("n_parts > 1").select("capacity", "doc_id").distinct()


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All bins of all capacities with the parts they hold."""
    return pack(*_inputs(spark, folder))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Bins, placed tokens and unused share of each capacity."""
    bins = pack(*_inputs(spark, folder)).groupBy("capacity", "bin").agg(F.sum("size").alias("used"))
    total = bins.groupBy("capacity").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("n_tokens"))
    return total.withColumn("unused", 1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")))


def p6_placed(spark: SparkSession, folder: str) -> DataFrame:
    """What the packing placed of each document in bins of each capacity: tokens, parts, and different places of parts."""
    placed = pack(*_inputs(spark, folder)).groupBy("capacity", "doc_id")
    return placed.agg(F.sum("size").alias("n_tokens"), F.count(F.lit(1)).alias("n_parts"), F.count_distinct("begin").alias("n_places"))


def p6_limits(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity the bins that exceed it in tokens, documents, or attention cost beside another item; none may."""
    packed = pack(*_inputs(spark, folder))
    cost = F.sum(F.col("size") * F.col("size"))
    bins = packed.groupBy("capacity", "bin").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"), cost.alias("cost"))
    over = (F.col("used") > F.col("capacity")).cast("bigint"), (F.col("n") > MOST_DOCS).cast("bigint"), ((F.col("n") > 1) & (F.col("cost") > ATTENTION * F.col("capacity") * F.col("capacity"))).cast("bigint")
    return bins.groupBy("capacity").agg(F.sum("used").alias("n_tokens"), *[F.sum(x).alias(name) for x, name in zip(over, ("over_tokens", "over_docs", "over_cost"))])


QUERIES = {"p6_placed": p6_placed, "p6_limits": p6_limits, "p6_found": p6_found, "p6_packing": p6_packing, "p6_fill": p6_fill}
_SIZES = """sizes AS (SELECT doc_id, max(octet_length(encode(text))) AS n FROM documents WHERE doc_id IS NOT NULL AND text <> '' GROUP BY doc_id),
caps AS (SELECT DISTINCT capacity FROM containers WHERE capacity > 0)"""
ORACLES = {
    "p6_found": """SELECT DISTINCT c.capacity, d.doc_id FROM documents d, containers c
WHERE d.doc_id IS NOT NULL AND octet_length(encode(d.text)) > c.capacity AND c.capacity > 0""",
    "p6_placed": f"""WITH {_SIZES} SELECT capacity, doc_id, n AS n_tokens, ceil(n::DOUBLE / capacity)::BIGINT AS n_parts, ceil(n::DOUBLE / capacity)::BIGINT AS n_places FROM sizes, caps""",
    "p6_limits": f"""WITH {_SIZES} SELECT capacity, sum(n)::BIGINT AS n_tokens, 0::BIGINT AS over_tokens, 0::BIGINT AS over_docs, 0::BIGINT AS over_cost FROM sizes, caps GROUP BY capacity""",
}
