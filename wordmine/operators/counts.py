"""Frequencies of prefixes and substrings as equi-joins over the vocabulary.

A needle without a space lies within one token, so its count in a text is the sum over distinct tokens of the token's
number times its occurrences in the token. Texts are never scanned once per needle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.functions.measures import count_in, tfidf
from wordmine.operators.tokens import prefixes
from wordmine.plans.lineage import materialize


def prefix_frequency(vocab: DataFrame) -> DataFrame:
    """``(prefix, freq)``: tokens of ``(token, n)`` that begin with each prefix of two characters and more."""
    plain = prefixes(vocab, dots=False, keep=("n",))
    return plain.groupBy("prefix").agg(F.sum("n").alias("freq"))


#: Needles of fewer characters meet the parts of tokens of their own length; of longer ones the first that many, twice that many ... do.
SEED = 8
#: Needles of so many characters together are sent to every task.
FEW = 100_000


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join by merging, never by sending a side to all tasks.

    For rows made by ``explode`` the planner counts little more than what they are made from, a small stored vocabulary
    for many times its size, and would gather them in the driver's memory.
    """
    return df.hint("merge")


def _seed_size(needle: str = "needle") -> Column:
    size = F.length(needle)
    return F.when(size < SEED, size).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(size)))).cast("int")


def _sizes(needles: DataFrame) -> dict[int, int]:
    """Characters of the needles by the size of the part that meets them; at most ``SEED`` sizes and one for each power of two."""
    by = needles.select(_seed_size().alias("size"), F.length("needle").alias("n")).groupBy("size").agg(F.sum("n").alias("n"))
    return dict(sorted((r["size"], r["n"]) for r in by.collect()))


def _parts(token: Column, sizes: list[int]) -> Column:
    """The distinct parts of a token that have one of the sizes."""
    n = F.length(token)
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(n - s + 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(s)))
    return F.array_distinct(F.concat(*[F.when(n >= s, cut(s)).otherwise(F.array().cast("array<string>")) for s in sizes]))


def _met(vocab: DataFrame, needles: DataFrame, sizes: dict[int, int], *keep: str) -> DataFrame:
    """``(token, needle, k)`` and the columns ``keep``: distinct ``needles`` met by parts of the tokens and then compared."""
    wanted = needles.select("needle", F.substring("needle", F.lit(1), _seed_size()).alias("seed"))
    each = vocab.where(F.length("token") >= min(sizes)).select("token", *keep, F.explode(_parts(F.col("token"), list(sizes))).alias("seed"))
    hits = each.join(F.broadcast(wanted) if sum(sizes.values()) <= FEW else merged(wanted), "seed")
    hits = hits.where((F.length("needle") < SEED) | F.contains("token", F.col("needle")))
    return hits.select("token", *keep, "needle", count_in(F.col("token"), F.col("needle")).alias("k"))


def occurrences(vocab: DataFrame, needles: DataFrame, least: int = 2) -> DataFrame:
    """``(token, needle, k)``: how often each distinct needle of ``least`` characters and more occurs in each distinct token that has it.

    Only parts of the lengths that needles have are cut from the tokens. A needle from ``SEED`` characters on is met by
    its beginning of 8, 16, 32 ... characters and then compared, so a token gives a few parts for each of its characters
    and not one for each of its substrings, however long it is.
    """
    long_enough = needles.select("needle").where(F.length("needle") >= least)
    tokens_ = vocab.select("token").distinct()
    if not (sizes := _sizes(long_enough)):
        return tokens_.select("token", F.col("token").alias("needle"), F.lit(0).cast("bigint").alias("k")).where(F.lit(False))
    return _met(tokens_, long_enough.distinct(), sizes)


def part_frequency(vocab: DataFrame, needles: DataFrame) -> DataFrame:
    """``(needle, freq)``: occurrences of each distinct ``needle`` of two characters and more that the tokens of ``(token, n)`` have.

    Other parts may be among them, so it is for joining to rows of needles. Parts under ``SEED`` characters are summed up
    where they are cut, before needles are looked at, so that tokens don't travel with each of their parts.
    """
    long_enough = needles.select("needle").where(F.length("needle") >= 2)
    sizes = _sizes(long_enough)
    few = sum(sizes.values()) <= FEW
    short = [] if few else [s for s in sizes if s < SEED]
    rest = {s: n for s, n in sizes.items() if s not in short}
    found = []
    if short:
        each = vocab.where(F.length("token") >= short[0]).select("token", "n", F.explode(_parts(F.col("token"), short)).alias("needle"))
        once = F.length("token") < 2 * F.length("needle")  # two don't fit
        found.append(each.select("needle", (F.col("n") * F.when(once, F.lit(1)).otherwise(count_in(F.col("token"), F.col("needle")))).alias("n")))
    if rest:
        wanted = long_enough.where(F.length("needle") >= (2 if few else SEED)).distinct()
        found.append(_met(vocab, wanted, rest, "n").select("needle", (F.col("n") * F.col("k")).alias("n")))
    if not found:
        return vocab.select(F.col("token").alias("needle"), F.col("n").cast("bigint").alias("freq")).where(F.lit(False))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return every.groupBy("needle").agg(F.sum("n").cast("bigint").alias("freq"))


def substring_frequency(vocab: DataFrame, needles: DataFrame) -> DataFrame:
    """``(needle, freq)``: occurrences of each distinct ``needle`` of two characters and more in the tokens of ``(token, n)``; 0 if there are none.

    Needles with a space never match.
    """
    wanted = needles.select("needle").where(F.length("needle") >= 2).distinct()
    summed = part_frequency(vocab, needles)
    return wanted.join(merged(summed), "needle", "left").select("needle", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))


def document_tokens(tokens: DataFrame) -> DataFrame:
    """``(doc_id, token, m, pos)``: the distinct tokens of each document, their number and first place."""
    return tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("pos"))


def document_counts(tokens: DataFrame, needles: DataFrame) -> DataFrame:
    """``(doc_id, needle, n)``: occurrences of each needle in each document that has it, from ``(doc_id, token)``.

    The tokens of the documents are stored once, for they are read twice and cost the cleaning of all texts.
    """
    per_doc = materialize(tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("m")), "document-tokens")
    hits = occurrences(per_doc, needles)
    return per_doc.join(merged(hits), "token").groupBy("doc_id", "needle").agg(F.sum(F.col("m") * F.col("k")).cast("bigint").alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``(needle, df)``: documents of ``(doc_id, needle, n)`` in which each needle occurs."""
    return counts.groupBy("needle").agg(F.count_distinct("doc_id").alias("df"))


def tfidf_table(counts: DataFrame, n_docs: DataFrame, tf: str) -> DataFrame:
    """``(doc_id, needle, tfidf)``; ``n_docs`` has one row ``n_docs``."""
    full = counts.join(document_frequency(counts), "needle").crossJoin(F.broadcast(n_docs))
    return full.select("doc_id", "needle", tfidf(F.col("n"), F.col("df"), F.col("n_docs"), tf).alias("tfidf"))


def word_total(text: Column, letters: str = r"\p{L}") -> Column:
    """Runs of letters that a space, dot, comma, quote or bracket follows, and one at the end."""
    return F.regexp_count(text, F.lit(rf"[{letters}]+[ .,`'\"‘’()]")) + F.regexp_count(text, F.lit(rf"[{letters}]\z"))
