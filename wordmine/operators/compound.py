"""Compound candidates from sequences of nouns, and their scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmine.functions.measures import count_in, geometric_mean, pmi, pmi_any_spacing, without_spaces
from wordmine.operators.counts import merged, occurrences


def bigrams(occ: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, pos, a, b)``: neighbouring nouns of a sentence."""
    by = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    return occ.select("doc_id", "sent_id", "pos", F.col("noun").alias("a"), F.lead("noun").over(by).alias("b")).where("b IS NOT NULL")


def noun_grams(occ: DataFrame, n: int = 2) -> DataFrame:
    """``(doc_id, sent_id, pos, words)``: sliding windows of ``n`` nouns of a sentence."""
    by = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    words = F.array(F.col("noun"), *[F.lead("noun", k).over(by) for k in range(1, n)])
    return occ.select("doc_id", "sent_id", "pos", words.alias("words")).where(~F.exists("words", lambda w: w.isNull()))


def first_seen(grams: DataFrame) -> DataFrame:
    """``(doc_id, ord, a, b)``: distinct pairs of each document in the order in which they first occur."""
    seen = grams.groupBy("doc_id", "a", "b").agg(F.min(F.struct("sent_id", "pos")).alias("at"))
    return seen.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("ord"), "a", "b")


def beside(rows: DataFrame, docs: DataFrame, **found) -> DataFrame:
    """``rows`` of each document with columns computed from the document's text, which meets all of them at once.

    The rows of a document travel as one array, so a text is shuffled once and not once for each row. ``found`` gives
    each new column as a function of the row, which may use the columns of ``docs``.
    """
    names = [c for c in rows.columns if c != "doc_id"]
    lists = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("rows"))
    made = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in names], *[f(r).alias(c) for c, f in found.items()]))
    return lists.join(merged(docs), "doc_id").select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*")


def with_counts(pairs: DataFrame, docs: DataFrame, text: str = "clean", least: int = 2, spaceless: bool = True, also: str | None = None) -> DataFrame:
    """``pairs`` with ``n``, how often the joined words occur in the document's text (without its spaces), at least ``least``.

    ``also`` names a second text, such as one without brackets; a pair then counts by the text in which it occurs more,
    but ``n`` stays its number in the first.
    """
    bare = (lambda c: without_spaces(F.col(c))) if spaceless else F.col
    target = docs.select("doc_id", bare(text).alias("_target"), *([bare(also).alias("_also")] if also else []))
    count = lambda c: lambda r: count_in(F.col(c), F.concat(r["a"], r["b"]))
    found = {"n": count("_target")} | ({"_more": count("_also")} if also else {})
    counted = beside(pairs, target, **found)
    return counted.where(F.greatest("n", "_more") >= least).drop("_more") if also else counted.where(F.col("n") >= least)


def pairs_in(text: str, nouns: list[str], also: str | None = None, least: int = 2) -> list[tuple[str, str, int]]:
    """``(a, b, n)``: nouns of which one ends in ``text`` where another begins, and how often the two joined occur, not overlapping.

    Only pairs that occur ``least`` times, in ``text`` or in ``also``, are given; ``n`` is the number in ``text``.
    """
    begins: dict[int, list[str]] = {}
    places: list[tuple[str, int]] = []
    for noun in nouns:
        at = text.find(noun) if noun else -1
        while at >= 0:
            begins.setdefault(at, []).append(noun)
            places.append((noun, at + len(noun)))
            at = text.find(noun, at + 1)
    met = {(a, b) for a, end in places for b in begins.get(end, ())}
    counted = ((a, b, text.count(a + b)) for a, b in sorted(met))
    return [(a, b, n) for a, b, n in counted if n >= least or also is not None and also.count(a + b) >= least]


def adjacent_pairs(docs: DataFrame, nouns: DataFrame, text: str = "clean", least: int = 2, also: str | None = None) -> DataFrame:
    """``(doc_id, a, b, n)``: ordered pairs of a document's nouns whose concatenation occurs ``least`` times in its text without spaces.

    Each noun is looked for once in its document's text, and pairs are formed only where one ends and another begins,
    not by trying all. A document's nouns travel as one array; the work is done in Arrow batches.
    """
    lists = nouns.where("noun <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_set("noun")).alias("list"))
    target = docs.select("doc_id", without_spaces(F.col(text)).alias("_text"), (without_spaces(F.col(also)) if also else F.lit(None).cast("string")).alias("_also"))

    @F.pandas_udf("array<struct<a:string,b:string,n:bigint>>")
    def found(texts: pd.Series, others: pd.Series, lists_: pd.Series) -> pd.Series:
        rows = zip(texts, others, lists_)
        return pd.Series([[{"a": a, "b": b, "n": n} for a, b, n in pairs_in(t or "", list(w), o, least)] for t, o, w in rows])

    return lists.join(merged(target), "doc_id").select("doc_id", F.explode(found("_text", "_also", "list")).alias("x")).select("doc_id", "x.*")


def chain_merge(pairs: DataFrame, keep_tail: bool = True) -> DataFrame:
    """``(doc_id, ord, words)``: runs of candidates of which each begins with the last word of the one before, as one compound.

    ``pairs`` is ``(doc_id, ord, a, b)``. Without ``keep_tail`` a run of two or more at the end of a document is lost.
    """
    by = Window.partitionBy("doc_id").orderBy("ord")
    begins = F.coalesce((F.lag("b").over(by) != F.col("a")).cast("int"), F.lit(1))
    marked = pairs.select("doc_id", "ord", "a", "b", F.sum(begins).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.lead("ord").over(by).isNull().alias("last"))
    runs = marked.groupBy("doc_id", "run").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", "a", "b"))).alias("links"), F.max("last").alias("last"))
    words = F.concat(F.array(F.col("links")[0]["a"]), F.transform("links", lambda x: x["b"]))
    out = runs.select("doc_id", "ord", words.alias("words"), "last")
    return (out if keep_tail else out.where(~F.col("last") | (F.size("words") == 2))).select("doc_id", "ord", "words")


def score_pairs(pairs: DataFrame, docs: DataFrame, ranks: DataFrame, total: Column, text: str = "clean", spaceless: bool = True, fall_back: bool = False) -> DataFrame:
    """``(doc_id, a, b, n, pmi, trpmi)`` of ``(doc_id, a, b, n)``: mutual information, and its product with the mean rank of the parts.

    ``ranks`` is ``(doc_id, noun, tr)``; ``total`` an expression over ``text`` for the number of words. With
    ``fall_back`` a joint count of 0 gives way to the number in any spacing.
    """
    target = docs.select("doc_id", (without_spaces(F.col(text)) if spaceless else F.col(text)).alias("_target"), total.cast("bigint").alias("_total"))

    def information(r: Column) -> Column:
        parts = [count_in(F.col("_target"), r[c]) for c in ("a", "b")]
        if fall_back:
            return pmi_any_spacing(F.col("_target"), [r["a"], r["b"]], r["n"], parts, F.col("_total"))
        return pmi(r["n"], parts, F.col("_total"))

    full = beside(pairs.select("doc_id", "a", "b", "n"), target, pmi=information)
    for c in ("a", "b"):
        full = full.join(merged(ranks.select("doc_id", F.col("noun").alias(c), F.col("tr").alias(f"tr_{c}"))), ["doc_id", c])
    return full.select("doc_id", "a", "b", "n", "pmi", (geometric_mean([F.col("tr_a"), F.col("tr_b")]) * F.col("pmi")).alias("trpmi"))


def merge_duplicates(scored: DataFrame, label: Column) -> DataFrame:
    """``(doc_id, label, score)``: scores of equal labels by their geometric mean; null where their product is negative."""
    n = F.count(F.lit(1))
    product = F.product("score")
    merged = F.when(product < 0, None).otherwise(F.power(product, F.lit(1.0) / n))
    return scored.withColumn("label", label).groupBy("doc_id", "label").agg(F.when(n == 1, F.max("score")).otherwise(merged).alias("score"))


def suffix_prefix_links(words: DataFrame) -> DataFrame:
    """``(doc_id, i, j)``: candidates ``(doc_id, ord, words)`` of which one without its first word equals another without its last."""
    a = words.select("doc_id", F.col("ord").alias("i"), F.expr("slice(words, 2, size(words))").alias("part"))
    b = words.select("doc_id", F.col("ord").alias("j"), F.expr("slice(words, 1, size(words) - 1)").alias("part"))
    return a.join(b, ["doc_id", "part"]).select("doc_id", "i", "j")


def included_last(nouns: DataFrame) -> DataFrame:
    """``(doc_id, noun, included)``: whether another noun of the document contains this one.

    Which distinct nouns hold which is found once for the whole collection, by equality of parts; documents only look it up.
    """
    distinct = nouns.select("doc_id", "noun").distinct()
    every = distinct.select("noun").distinct()
    held = occurrences(every.select(F.col("noun").alias("token")), every.select(F.col("noun").alias("needle")), 1).where("token <> needle")
    pairs = held.select(F.col("token").alias("longer"), F.col("needle").alias("noun"))
    found = distinct.withColumnRenamed("noun", "longer").join(merged(pairs), "longer").select("doc_id", "noun").distinct()
    return distinct.join(merged(found.withColumn("included", F.lit(True))), ["doc_id", "noun"], "left").select("doc_id", "noun", F.coalesce("included", F.lit(False)).alias("included"))


def with_order(nouns: DataFrame) -> DataFrame:
    """``(doc_id, ord, noun)`` in a new order: nouns that another one contains come last, else as before."""
    marked = nouns.join(merged(included_last(nouns)), ["doc_id", "noun"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("included", "ord", "noun")) - 1
    return marked.select("doc_id", place.alias("ord"), "noun")


def longest_first(nouns: DataFrame) -> DataFrame:
    """``(doc_id, ord, noun)`` in a new order: longer nouns first, else as before."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("noun")), "ord", "noun")) - 1
    return nouns.select("doc_id", place.alias("ord"), "noun")


def take_all(text: str, nouns: list[str]) -> list[tuple[int, str]]:
    """Where each noun in turn is found in what is left of a text, one occurrence after the other, until none is left."""
    out = []
    for noun in nouns:
        at = text.find(noun) if noun else -1
        while at >= 0:
            out.append((at, noun))
            text = text[:at] + text[at + len(noun) :]
            at = text.find(noun, max(0, at - len(noun) + 1))  # what was before can't hold it but across the gap
    return out


def greedy_occurrences(sentences: DataFrame, nouns: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, step, at, noun)``: nouns taken out of each sentence one occurrence at a time, in the order given.

    ``nouns`` is ``(doc_id, ord, noun)``. ``at`` is the place in what is left of the sentence, where taking one out may
    make another. The order matters and the number of steps is open, so each sentence is worked off in Python, in
    Arrow batches; only sentences that hold any noun at all are sent there.
    """
    lists = nouns.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("ord", "noun"))), lambda x: x["noun"]).alias("list"))

    @F.pandas_udf("array<struct<at:int,noun:string>>")
    def taken(texts: pd.Series, lists_: pd.Series) -> pd.Series:
        return pd.Series([[{"at": a, "noun": n} for a, n in take_all(t or "", list(w))] for t, w in zip(texts, lists_)])

    held = sentences.join(merged(lists), "doc_id").where(F.exists("list", lambda n: F.contains("sentence", n)))
    found = held.select("doc_id", "sent_id", F.posexplode(taken("sentence", "list")).alias("step", "x"))
    return found.select("doc_id", "sent_id", "step", "x.at", "x.noun")


def mutual_inclusion(words: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(doc_id, ord, word)`` without candidates that hardly differ in frequency from a neighbour that contains or is contained in them.

    A word inside the next one stays if it is over 1.1 times as frequent; else one that contains the word before, or
    the last of a document, stays if it is over 0.9 times as frequent as that. ``frequency`` is ``(word, freq)``.
    """
    by = Window.partitionBy("doc_id").orderBy("ord")
    full = words.join(merged(frequency), "word")
    full = full.select("doc_id", "ord", "word", "freq", *[f(c).over(by).alias(f"{side}_{c}") for side, f in (("before", F.lag), ("after", F.lead)) for c in ("word", "freq")])
    last = F.col("after_word").isNull()
    in_next = F.contains("after_word", F.col("word"))
    has_before = last | F.contains("word", F.col("before_word"))
    against_before = F.coalesce(F.col("before_freq") * 0.9 < F.col("freq"), F.lit(True))
    keep = F.when(in_next, F.col("freq") > F.col("after_freq") * 1.1).when(has_before, against_before).otherwise(F.lit(True))
    return full.where(keep).select("doc_id", "ord", "word", "freq")
