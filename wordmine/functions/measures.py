"""Counts and scores as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def count_in(text: Column, needle: Column) -> Column:
    """Occurrences of ``needle`` in ``text`` that don't overlap, from the left; 0 for an empty needle."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise((removed / F.length(needle)).cast("bigint"))


def literal(word: Column) -> Column:
    """A pattern that matches exactly ``word``, whatever signs it holds."""
    return F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def spacing_masks(n: int) -> list[tuple[bool, ...]]:
    """All ways of setting or leaving out the ``n - 1`` spaces between ``n`` parts."""
    return [tuple(bool(mask >> k & 1) for k in range(n - 1)) for mask in range(1 << max(0, n - 1))]


def spaced_ways(parts: list[Column]) -> list[Column]:
    """The parts joined in every spacing."""
    out = []
    for mask in spacing_masks(len(parts)):
        pieces = [parts[0]]
        for space, part in zip(mask, parts[1:]):
            pieces += [F.lit(" "), part] if space else [part]
        out.append(F.concat(*pieces))
    return out


def count_any_spacing(text: Column, parts: list[Column]) -> Column:
    """Occurrences of the parts in ``text``, summed over all spacings."""
    total = F.lit(0).cast("bigint")
    for way in spaced_ways(parts):
        total = total + count_in(text, way)
    return total


def tfidf(count: Column, df: Column, n_docs: Column, tf: str = "raw") -> Column:
    """TF-IDF in three variants: ``raw`` counts, ``log`` of count plus one, both smoothed at 0.001, or ``zero`` for 0 without occurrences."""
    idf = F.ln(n_docs.cast("double") / F.when(df == 0, F.lit(0.001)).otherwise(df.cast("double")))
    if tf == "raw":
        return F.when(count == 0, F.lit(0.001)).otherwise(count.cast("double")) * idf
    log = F.ln(count.cast("double") + 1)
    return F.when(count == 0, (F.lit(0.001) * idf) if tf == "log" else F.lit(0.0)).otherwise(log * idf)


def pmi(joint: Column, counts: list[Column], n: Column) -> Column:
    """Pointwise mutual information of parts against their joint count; 0 for no joint count, null for ``n`` of 0."""
    chance = F.lit(1.0)
    for c in counts:
        chance = chance * F.try_divide(c.cast("double"), n)
    return F.when(joint == 0, F.lit(0.0)).otherwise(F.ln(F.try_divide(F.try_divide(joint.cast("double"), n), chance)))


def pmi_any_spacing(text: Column, parts: list[Column], joint: Column, counts: list[Column], n: Column) -> Column:
    """``pmi`` whose joint count falls back to the occurrences in any spacing where the plain one is 0."""
    return pmi(F.coalesce(F.nullif(joint, F.lit(0).cast("bigint")), count_any_spacing(text, parts)), counts, n)


def geometric_mean(values: list[Column]) -> Column:
    product = F.lit(1.0)
    for v in values:
        product = product * v
    return F.power(product, F.lit(1.0 / len(values)))


def match_percent(stripped: Column, registered: Column, match: Column, score: Column, least: float = 3.5) -> Column:
    """Share of the match explained by its stripped or registered form in whole percent; -1 for fully registered or unimportant matches."""
    longest = F.greatest(F.length(stripped), F.length(registered))
    share = F.floor(longest / F.length(match) * 100).cast("int")
    return F.when((F.length(match) == F.length(registered)) | (score < least), F.lit(-1)).otherwise(share)


def first_context(text: Column, word: Column, radius: int = 10) -> Column:
    """``...left<word>right...`` around the first occurrence; null without one."""
    at = F.instr(text, word)
    left = F.substring(text, F.greatest(at - radius, F.lit(1)), F.least(at - 1, F.lit(radius)))
    right = F.substring(text, at + F.length(word), F.lit(radius))
    return F.when(at > 0, F.concat(F.lit("..."), left, F.lit("<"), word, F.lit(">"), right, F.lit("...")))


def around(text: str, word: str, radius: int = 10) -> str:
    """What stands within ``radius`` characters left and right of each occurrence; one goes from the text before the next is looked for."""
    out, at = [], text.find(word) if word else -1
    while at >= 0:
        out += [text[max(0, at - radius) : at], text[at + len(word) : at + len(word) + radius]]
        text = text[:at] + text[at + len(word) :]
        at = text.find(word, max(0, at - len(word) + 1))
    return "".join(out)


def surroundings(text: Column | str, word: Column | str) -> Column:
    """``around`` for columns, in Arrow batches, for taking one out may make another; null for null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or w is None else around(t, w) for t, w in zip(texts, words)], dtype=object)

    return run(text, word)


def all_contexts(text: Column, word: Column, radius: int = 10) -> Column:
    """All occurrences in context, joined by ``...``; occurrences are literal and don't overlap, contexts may."""
    parts = F.split(text, literal(word))
    ends = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    offsets = F.aggregate(
        ends,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x["p"]) + F.length(word)).cast("int").alias("at"), F.concat(acc["out"], F.array((acc["at"] + F.length(x["p"])).cast("int"))).alias("out")),
    )["out"]
    places = F.slice(offsets, F.lit(1), F.size(parts) - 1)
    shown = F.transform(
        places,
        lambda at: F.concat(
            F.substring(text, F.greatest(at - radius, F.lit(1)), F.least(at - 1, F.lit(radius))), F.lit("<"), word, F.lit(">"), F.substring(text, at + F.length(word), F.lit(radius))
        ),
    )
    return F.when(F.contains(text, word), F.concat(F.lit("..."), F.array_join(shown, "..."), F.lit("...")))
