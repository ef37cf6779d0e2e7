"""Co-occurrence graphs of each document and TextRank on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rounds of the ranking and its damping, applied once after the last round.
ROUNDS, DAMPING = 16, 0.85
#: Documents ranked in one batch, on average.
BATCH_DOCS = 1000


def sentence_counts(occ: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, noun, n)`` of ``(doc_id, sent_id, pos, noun)``."""
    return occ.groupBy("doc_id", "sent_id", "noun").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(occ: DataFrame) -> DataFrame:
    """``(doc_id, src, dst, w)``: for sentences with ``src``, the occurrences of ``dst``, less one for a noun with itself; only positive weights."""
    counts = sentence_counts(occ)
    a = counts.select("doc_id", "sent_id", F.col("noun").alias("src"))
    b = counts.select("doc_id", "sent_id", F.col("noun").alias("dst"), "n")
    summed = a.join(b, ["doc_id", "sent_id"]).groupBy("doc_id", "src", "dst").agg(F.sum("n").alias("n"))
    return summed.select("doc_id", "src", "dst", (F.col("n") - (F.col("src") == F.col("dst")).cast("int")).alias("w")).where("w > 0")


def out_degree(edges: DataFrame) -> DataFrame:
    """``(doc_id, src, degree)``."""
    return edges.groupBy("doc_id", "src").agg(F.sum("w").alias("degree"))


def char_window_edges(occ: DataFrame, distance: int = 10) -> DataFrame:
    """``(doc_id, src, dst)``: nouns that begin within ``distance`` characters of an occurrence of ``src`` in the same sentence.

    ``occ`` is ``(doc_id, sent_id, at, noun)`` with character positions. Positions meet by equality of blocks of
    ``distance`` characters and their neighbours, not by comparing all pairs.
    """
    a = occ.select("doc_id", "sent_id", F.col("noun").alias("src"), F.col("at").alias("a"), F.explode(F.expr(f"sequence(div(at, {distance}) - 1, div(at, {distance}) + 1)")).alias("block"))
    b = occ.select("doc_id", "sent_id", F.col("noun").alias("dst"), F.col("at").alias("b"), F.expr(f"div(at, {distance})").alias("block"))
    near = a.join(b, ["doc_id", "sent_id", "block"]).where((F.abs(F.col("a") - F.col("b")) <= distance) & (F.col("src") != F.col("dst")))
    return near.select("doc_id", "src", "dst").distinct()


def order_window_edges(occ: DataFrame, distance: int = 8) -> DataFrame:
    """``(doc_id, src, dst, w)``: sentences in which the first places of two nouns are at most ``distance`` tokens apart."""
    first = occ.groupBy("doc_id", "sent_id", "noun").agg(F.min("pos").alias("pos"))
    a = first.select("doc_id", "sent_id", F.col("noun").alias("src"), F.col("pos").alias("a"), F.explode(F.expr(f"sequence(div(pos, {distance}) - 1, div(pos, {distance}) + 1)")).alias("block"))
    b = first.select("doc_id", "sent_id", F.col("noun").alias("dst"), F.col("pos").alias("b"), F.expr(f"div(pos, {distance})").alias("block"))
    near = a.join(b, ["doc_id", "sent_id", "block"]).where((F.abs(F.col("a") - F.col("b")) <= distance) & (F.col("src") != F.col("dst")))
    return near.groupBy("doc_id", "src", "dst").agg(F.count(F.lit(1)).alias("w"))


def textrank(edges: DataFrame, nouns: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """``(doc_id, noun, tr)`` of ``(doc_id, noun)`` over ``(doc_id, src, dst, w)``.

    Each round passes every noun's value on along its edges in proportion to their weights; nouns without edges keep
    theirs. Damping follows once at the end. A graph belongs to one document and is no larger than its distinct nouns
    allow, so all rounds are done where its edges meet: one shuffle instead of one for each round. About ``batch_docs``
    documents, by a hash of their id, are ranked together as one graph of separate parts, without a step for each.
    """
    alone = nouns.select("doc_id", F.col("noun").alias("src")).distinct().select("doc_id", "src", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("w"))
    n_docs = nouns.agg(F.approx_count_distinct("doc_id")).first()[0]
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n_docs // batch_docs)))).cast("int")
    rows = edges.select("doc_id", "src", "dst", F.col("w").cast("double")).unionByName(alone).withColumn("chunk", chunk)

    def rank(group: pa.Table) -> pa.Table:
        docs = group["doc_id"].to_numpy().astype(np.int64)
        own = group["dst"].is_null().to_numpy(zero_copy_only=False)
        words = pa.concat_arrays([*group["src"].chunks, *group["dst"].chunks]).dictionary_encode()
        codes = words.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        width, (ids, place) = len(words.dictionary) + 1, np.unique(docs, return_inverse=True)
        src, dst = place * width + codes[: len(docs)], place * width + codes[len(docs) :]
        nodes = np.unique(src[own])  # one for each document and noun
        kept = np.flatnonzero(~own & np.isin(src, nodes) & np.isin(dst, nodes))
        kept = kept[np.lexsort((dst[kept], src[kept]))]  # sums in one order, whatever order the rows came in
        a, b = np.searchsorted(nodes, src[kept]), np.searchsorted(nodes, dst[kept])
        w = np.nan_to_num(group["w"].to_numpy()[kept])
        degree = np.bincount(a, w, minlength=len(nodes))
        share = w / degree[a]
        doc = nodes // width
        value = 1.0 / np.bincount(doc, minlength=len(ids))[doc]
        for _ in range(rounds):
            value = np.where(degree > 0, np.bincount(b, value[a] * share, minlength=len(nodes)), value)
        names = words.dictionary.take(pa.array(nodes % width)).cast(pa.string())
        return pa.table([pa.array(ids[doc], pa.int64()), names, pa.array((1 - damping) + damping * value, pa.float64())], names=["doc_id", "noun", "tr"])

    return rows.groupBy("chunk").applyInArrow(rank, "doc_id bigint, noun string, tr double")


def rank_sentences(group: pa.Table, rounds: int = ROUNDS, damping: float = DAMPING) -> pa.Table:
    """``(doc_id, noun, tr)`` of a batch of documents: ``(doc_id, sent_id, noun, n)``, and each of their nouns once without a sentence."""
    docs, n = group["doc_id"].to_numpy().astype(np.int64), group["n"].to_numpy().astype(np.float64)
    own = group["sent_id"].is_null().to_numpy(zero_copy_only=False)
    words = group["noun"].combine_chunks().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width, (ids, place) = len(words.dictionary), np.unique(docs, return_inverse=True)
    key = place * width + codes
    nodes = np.unique(key[own])  # one for each document and noun
    kept = np.flatnonzero(~own & np.isin(key, nodes))
    sents = group["sent_id"].fill_null(0).to_numpy().astype(np.int64)[kept]
    kept = kept[np.lexsort((key[kept], sents))]  # sums in one order, whatever order the rows came in
    sents = group["sent_id"].fill_null(0).to_numpy().astype(np.int64)[kept]
    _, s = np.unique(np.stack([place[kept], sents], 1), axis=0, return_inverse=True) if len(kept) else (None, np.zeros(0, np.int64))
    s, a, w = s.reshape(-1), np.searchsorted(nodes, key[kept]), n[kept]
    size, total = len(nodes), np.bincount(s, w)
    seen = np.bincount(a, minlength=size) > 0
    degree = np.bincount(a, total[s], minlength=size) - seen
    live = degree > 0
    doc = nodes // width
    value = 1.0 / np.bincount(doc, minlength=len(ids))[doc]
    for _ in range(rounds):
        share = np.divide(value, degree, out=np.zeros(size), where=live)
        passed = np.bincount(s, share[a])
        value = np.where(live, np.bincount(a, w * passed[s], minlength=size) - share, value)
    names = words.dictionary.take(pa.array(nodes % width)).cast(pa.string())
    return pa.table([pa.array(ids[doc], pa.int64()), names, pa.array((1 - damping) + damping * value, pa.float64())], names=["doc_id", "noun", "tr"])


def sentence_rank(occ: DataFrame, nouns: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """``textrank`` over ``cooccurrence(occ)`` without the edges, of which a sentence of k nouns has k times k.

    A noun's weight on another is the sum of that one's numbers over the sentences with the first, less one for itself.
    So a round sums, for every sentence, the shares of its nouns, and gives each noun these sums times its number there:
    the work follows the occurrences. ``occ`` is ``(doc_id, sent_id, pos, noun)``, ``nouns`` ``(doc_id, noun)``.
    """
    alone = nouns.select("doc_id", "noun").distinct().select("doc_id", F.lit(None).cast("bigint").alias("sent_id"), "noun", F.lit(0).cast("bigint").alias("n"))
    counts = sentence_counts(occ).select("doc_id", F.col("sent_id").cast("bigint"), "noun", F.col("n").cast("bigint"))
    n_docs = nouns.agg(F.approx_count_distinct("doc_id")).first()[0]
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n_docs // batch_docs)))).cast("int")

    def rank(group: pa.Table) -> pa.Table:
        return rank_sentences(group, rounds, damping)

    return counts.unionByName(alone).withColumn("chunk", chunk).groupBy("chunk").applyInArrow(rank, "doc_id bigint, noun string, tr double")


def top_nouns(ranks: DataFrame, k: int = 10) -> DataFrame:
    """``(doc_id, noun, tr, rank)``: the ``k`` nouns of each document with the greatest value, ties by noun."""
    by = Window.partitionBy("doc_id").orderBy(F.desc("tr"), "noun")
    return ranks.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
