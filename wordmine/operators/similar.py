"""Context vectors and rankings by cosine."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmine.operators.counts import occurrences


def window_neighbours(tokens: DataFrame, nouns: DataFrame, distance: int = 2) -> DataFrame:
    """``(noun, doc_id, pos)``: places within ``distance`` tokens of a token that contains the noun.

    ``tokens`` is ``(doc_id, pos, token)``, ``nouns`` ``(noun)``, a vocabulary of fixed size. Tokens meet nouns by
    equality of substrings, places meet by equality after exploding the window.
    """
    last = tokens.groupBy("doc_id").agg(F.max("pos").alias("last"))
    hits = occurrences(tokens, nouns.select(F.col("noun").alias("needle")), 1).select("token", F.col("needle").alias("part"))
    held = tokens.join(hits, "token").join(last, "doc_id")
    around = F.sequence(F.greatest(F.col("pos") - distance, F.lit(0)), F.least(F.col("pos") + distance, F.col("last")))
    return held.select(F.col("part").alias("noun"), "doc_id", F.explode(around).alias("pos")).distinct()


def context_pairs(tokens: DataFrame, nouns: DataFrame, distance: int = 2) -> DataFrame:
    """``(noun, feature)``: nouns that occur in some context of a noun, itself included: the ones of its one-hot vector."""
    near = window_neighbours(tokens, nouns, distance).join(tokens, ["doc_id", "pos"]).select("noun", "token").distinct()
    hits = occurrences(near, nouns.select(F.col("noun").alias("needle")), 1).select("token", F.col("needle").alias("part"))
    return near.join(hits, "token").select("noun", F.col("part").alias("feature")).distinct()


def rank_nouns(pairs: DataFrame) -> DataFrame:
    """``(noun, other, cosine, rank)``: for sets of features, the cosine of every two nouns that share one, best first, ties by name."""
    size = pairs.groupBy("noun").agg(F.count(F.lit(1)).alias("size"))
    shared = pairs.join(pairs.withColumnRenamed("noun", "other"), "feature").groupBy("noun", "other").agg(F.count(F.lit(1)).alias("both"))
    full = shared.join(size, "noun").join(size.select(F.col("noun").alias("other"), F.col("size").alias("other_size")), "other")
    cos = F.col("both") / F.sqrt(F.col("size").cast("double") * F.col("other_size"))
    by = Window.partitionBy("noun").orderBy(F.desc("cosine"), "other")
    return full.select("noun", "other", F.round(cos, 9).alias("cosine")).withColumn("rank", F.row_number().over(by))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """``(query_id, vec_id, cosine, rank)``: the ``k`` rows of ``(vec_id, embedding)`` nearest to each query of the same form, exactly.

    Queries are a stated set, taken to the tasks in blocks of ``block``; each task keeps the ``k`` best of its rows for
    each query, and only these are ranked, ties by ``vec_id``. Null and zero vectors and those of another length are left out.
    """
    spark = vectors.sparkSession
    rows = queries.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").toLocalIterator()
    good = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    schema = "query_id bigint, vec_id bigint, cosine double"
    result = spark.createDataFrame([], schema)
    while held := list(itertools.islice(rows, block)):  # the driver holds one block at a time
        part = [(r.vec_id, np.array(r.embedding, np.float64)) for r in held]
        part = [(i, e) for i, e in part if np.linalg.norm(e) > 0 and not np.isnan(e).any()]
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids = np.array([i for i, _ in shared.value])
            width = {len(e) for _, e in shared.value}
            q = np.stack([e / np.linalg.norm(e) for _, e in shared.value]) if len(width) == 1 else np.zeros((0, 0))
            for pdf in batches:
                kept = [(i, np.asarray(e, np.float64)) for i, e in zip(pdf.vec_id, pdf.embedding) if len(e) in width]
                kept = [(i, e) for i, e in kept if np.linalg.norm(e) > 0]
                if not kept or not len(q):
                    continue
                m = np.stack([e / np.linalg.norm(e) for _, e in kept])
                names = np.array([i for i, _ in kept])
                sims = np.round(q @ m.T, 9)
                order = np.lexsort((np.broadcast_to(names, sims.shape), -sims), axis=1)[:, :k]
                at = np.repeat(np.arange(len(q)), order.shape[1])
                yield pd.DataFrame({"query_id": ids[at], "vec_id": names[order.ravel()], "cosine": sims[at, order.ravel()]})

        result = result.unionByName(good.mapInPandas(run, schema))
    by = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return result.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
