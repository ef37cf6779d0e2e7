"""Morphological tagging behind one interface, and the filters that rest on it.

The tagger of choice is passed in; the default segments by a lexicon of registered surfaces with the longest match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.plans.lineage import listed

UNKNOWN = "UNKNOWN"
MORPHS = "array<struct<surface:string,tag:string>>"
#: Tags of words that aren't content of a noun.
EXCLUDED = "NR NNB VV VA VX VCP VCN MAG MAJ JKS JKC JKG JKO JKB JKQ JX JC EP EF EC ETM XSV XSA XR".split()


class Tagger(Protocol):
    """Gives the morphemes of a string as pairs of surface and tag."""

    def __call__(self, text: str) -> list[tuple[str, str]]: ...


def lexicon_rows(lexicon: DataFrame) -> DataFrame:
    """``(surface, tag)`` with one tag in capitals for each surface: the least one; surfaces without any tag are left out."""
    good = lexicon.where("surface IS NOT NULL AND surface <> '' AND tag IS NOT NULL")
    return good.groupBy("surface").agg(F.min(F.upper("tag")).alias("tag"))


def lexicon_tagger(lexicon: DataFrame) -> Tagger:
    """A tagger by longest match over ``(surface, tag)``, a list of fixed size; runs without a match are UNKNOWN."""
    entries = {r.surface.upper(): r.tag for r in sorted(listed(lexicon_rows(lexicon), "the lexicon"))}
    longest = max(map(len, entries), default=0)

    def tag(text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        i, unknown = 0, ""
        while i < len(text):
            for k in range(min(longest, len(text) - i), 0, -1):
                if (piece := text[i : i + k].upper()) in entries:
                    if unknown:
                        out.append((unknown, UNKNOWN))
                        unknown = ""
                    out.append((text[i : i + k], entries[piece]))
                    i += k
                    break
            else:
                unknown += text[i]
                i += 1
        return out + ([(unknown, UNKNOWN)] if unknown else [])

    return tag


def tagged(make: Callable[[], Tagger]) -> Callable[[Column], Column]:
    """A column function that tags strings in Arrow batches; ``make`` runs once in every Python worker."""

    @F.pandas_udf(MORPHS)
    def morphs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = make()
        for part in parts:
            yield part.map(lambda t: [{"surface": s, "tag": g} for s, g in tagger(t or "")])

    return morphs


def last_tag(morphs: Column) -> Column:
    return F.when(F.size(morphs) > 0, F.element_at(morphs, -1)["tag"])


def not_ending(morphs: Column) -> Column:
    """False where the last morpheme is an ending or particle; particles on a nominal ending are kept."""
    tag = F.coalesce(last_tag(morphs), F.lit(""))
    return ~(tag.rlike("^[EJ]") | F.contains(tag, F.lit("+E")) | (F.contains(tag, F.lit("+J")) & ~F.contains(tag, F.lit("ETN"))))


def is_registered_noun(morphs: Column) -> Column:
    """True for exactly one morpheme with a noun tag."""
    return (F.size(morphs) == 1) & F.startswith(morphs[0]["tag"], F.lit("N"))


def is_known(morphs: Column) -> Column:
    """True where no morpheme is unknown, for the empty string too."""
    return F.forall(morphs, lambda m: m["tag"] != UNKNOWN)


def is_excluded(morphs: Column) -> Column:
    """True where the last tag contains one of the excluded tags."""
    return F.exists(F.array(*[F.lit(t) for t in EXCLUDED]), lambda t: F.contains(F.coalesce(last_tag(morphs), F.lit("")), t))


def is_after_noun(morphs: Column) -> Column:
    """True where what the morphemes stand for may follow a noun: nothing, or a first tag of noun, verb, particle, ending or affix."""
    return (F.size(morphs) == 0) | morphs[0]["tag"].rlike("^[NVJEX]")


def is_single_known(morphs: Column) -> Column:
    """True for exactly one known morpheme that is no sign; pieces of which all are so make up a known right part."""
    return (F.size(morphs) == 1) & ~F.startswith(morphs[0]["tag"], F.lit("S")) & (morphs[0]["tag"] != UNKNOWN)


def joined_parts(morphs: Column) -> Column:
    """All joins of neighbouring morphemes, by the first and then by the last one."""
    n = F.size(morphs)
    ends = lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.transform(F.slice(morphs, i, j - i + 1), lambda m: m["surface"]), ""))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), ends))).otherwise(F.array().cast("array<string>"))


def kept_and_banned(words: DataFrame, morphs: str = "morphs") -> DataFrame:
    """``words`` with ``banned``, true where the last tag is one of the excluded ones."""
    return words.withColumn("banned", is_excluded(F.col(morphs)))


def strip_suffixes(make: Callable[[], Tagger], excluded: tuple[str, ...] = tuple(EXCLUDED)) -> Callable[[Column], Column]:
    """A column function that drops morphemes with excluded tags from the end, tagging again until nothing changes."""

    @F.pandas_udf("string")
    def strip(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = make()

        def one(word: str | None) -> str | None:
            while word:
                morphs = tagger(word)
                kept = morphs[:-1] if morphs and any(t in morphs[-1][1] for t in excluded) else morphs
                shorter = "".join(s for s, _ in kept)
                if shorter == word:
                    break
                word = shorter
            return word

        for part in parts:
            yield part.map(one, na_action="ignore")

    return strip


def registered_left(words: DataFrame, lexicon: DataFrame, word: str = "match") -> DataFrame:
    """``(match, registered)``: the longest prefix of two characters and more that is a registered noun, else empty."""
    nouns = lexicon_rows(lexicon).where(F.startswith("tag", F.lit("N"))).select(F.upper("surface").alias("registered"))
    distinct = words.select(F.col(word).alias("match")).distinct()
    lengths = F.sequence(F.lit(2), F.greatest(F.length("match"), F.lit(2)))
    each = distinct.where(F.length("match") >= 2).select("match", F.explode(F.transform(lengths, lambda k: F.substring("match", F.lit(1), k))).alias("registered"))
    found = each.join(nouns.distinct(), "registered").groupBy("match").agg(F.max_by("registered", F.length("registered")).alias("registered"))
    return distinct.join(found, "match", "left").select("match", F.coalesce("registered", F.lit("")).alias("registered"))


def without_registered(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is no registered noun."""
    nouns = lexicon_rows(lexicon).where(F.startswith("tag", F.lit("N"))).select(F.upper("surface").alias(word)).distinct()
    return words.join(nouns, word, "left_anti")
