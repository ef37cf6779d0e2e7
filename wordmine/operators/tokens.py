"""Tokens, their parts and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.functions.clean import clean, unbalanced
from wordmine.functions.measures import count_in


def tokenize(df: DataFrame, text: str = "clean", least: int = 2) -> DataFrame:
    """``(doc_id, pos, token)``: tokens between spaces whose length, digits counting as one sign, is at least ``least``.

    ``pos`` counts all pieces from 0. Null text gives no row.
    """
    each = df.select("doc_id", F.posexplode(F.split(F.col(text), " ")).alias("pos", "token"))
    return each.where(F.length(F.regexp_replace("token", "[0-9]+", "-")) >= least)


def documents(df: DataFrame, profile: str = "search", text: str = "text") -> DataFrame:
    """``(doc_id, clean)``, null text as empty."""
    return df.select("doc_id", clean(F.coalesce(F.col(text), F.lit("")), profile).alias("clean"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``(token, n)``: distinct tokens with their number."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def prefix_array(token: Column, dots: bool = True, parens: bool = False, bare: bool = False) -> Column:
    """All prefixes of two characters and more.

    With ``dots`` a final dot goes (in a ``bare`` token it has gone), tokens that begin with one have none, and dots don't
    count for the length; with ``parens`` prefixes with one kind of bracket only are left out.
    """
    if dots and not bare:
        token = F.regexp_replace(token, r"\.$", "")
    every = F.when(F.length(token) >= 2, F.transform(F.sequence(F.lit(2), F.greatest(F.length(token), F.lit(2))), lambda i: F.substring(token, F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    if dots:
        every = F.filter(every, lambda p: (F.length(F.replace(p, F.lit("."), F.lit(""))) > 1) & ~F.startswith(p, F.lit(".")))
    return F.filter(every, lambda p: ~unbalanced(p)) if parens else every


def prefixes(vocab: DataFrame, dots: bool = True, parens: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(token, len, prefix)`` and the columns ``keep``, from distinct tokens."""
    bare = F.regexp_replace("token", r"\.$", "") if dots else F.col("token")  # once for each token, not for each of its prefixes
    each = vocab.select("token", *keep, bare.alias("_bare")).select("token", *keep, F.explode(prefix_array(F.col("_bare"), dots, parens, bare=True)).alias("prefix"))
    return each.select("token", *keep, F.length("prefix").alias("len"), "prefix")


def right_trims(vocab: DataFrame) -> DataFrame:
    """``(token, ord, form)``: the token and its prefixes down to two characters, longest first; words under three have none, forms in dot or dash are left out."""
    n = F.length("token")
    series = F.when(n >= 3, F.transform(F.sequence(F.greatest(n, F.lit(2)), F.lit(2)), lambda i: F.substring(F.col("token"), F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(series, lambda f: ~(F.endswith(f, F.lit(".")) | F.endswith(f, F.lit("-"))))
    return vocab.select("token", F.posexplode(kept).alias("ord", "form"))


def substrings(vocab: DataFrame, least: int = 2) -> DataFrame:
    """``(token, part)``: the distinct substrings of ``least`` characters and more of each distinct token."""
    t, n = F.col("token"), F.length("token")
    starts = F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1)))
    every = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(least), F.greatest(n - s + 1, F.lit(least))), lambda k: F.substring(t, s, k))))
    return vocab.where(n >= least).select("token", F.explode(F.array_distinct(every)).alias("part"))


def splits(vocab: DataFrame) -> DataFrame:
    """``(token, lp, um, rp)``: every division into a left part, a middle of two characters and more, and a right part, the outer ones possibly empty.

    A final dot goes first.
    """
    bare = vocab.select("token", F.regexp_replace("token", r"\.$", "").alias("t")).where(F.length("t") >= 2)
    t, n = F.col("t"), F.length("t")

    def parts(i: Column) -> Column:
        last = F.sequence(i + 1, n)
        return F.transform(last, lambda j: F.struct(F.substring(t, F.lit(1), i - 1).alias("lp"), F.substring(t, i, j - i + 1).alias("um"), F.substring(t, j + 1, n).alias("rp")))

    return bare.select("token", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), parts))).alias("x")).select("token", "x.*")


def spacings(df: DataFrame, word: str = "word", most: int = 12) -> DataFrame:
    """``(word, way)``: every spacing of words of up to ``most`` characters, 2 to the power of their gaps; longer words give only themselves.

    ``most`` is a stated bound of an output that doubles with every character; it may be set up to 31.
    """
    df = df.select(F.col(word).alias("w")).where(F.length("w") >= 1)
    w, n = F.col("w"), F.length("w")
    masks = F.sequence(F.lit(0), (F.pow(F.lit(2), F.least(n, F.lit(most)) - 1) - 1).cast("int"))

    def way(mask: Column) -> Column:
        return F.array_join(
            F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(w, i, F.lit(1)), F.when((i < n) & (mask.bitwiseAND(F.pow(F.lit(2), i - 1).cast("int")) > 0), F.lit(" ")).otherwise(F.lit("")))), ""
        )

    ways = F.when(n <= most, F.transform(masks, way)).otherwise(F.array(w))
    return df.select(w.alias("word"), F.explode(ways).alias("way"))


def paren_suffixes(tokens: DataFrame, raw: DataFrame, least: int = 2) -> DataFrame:
    """Bracket expansion: for each bracket of a token what follows its first place, that bracket then removed, if the raw text has it ``least`` times.

    ``tokens`` is ``(doc_id, pos, token)``, ``raw`` ``(doc_id, raw)``. Tokens without brackets come first, then balanced ones; one-sided ones go.
    """
    with_text = tokens.where(F.col("token").rlike("[()]")).join(raw, "doc_id")
    step = F.aggregate(
        F.regexp_extract_all("token", F.lit("([()])"), 1),
        F.struct(F.col("token").alias("rest"), F.array().cast("array<string>").alias("out")),
        lambda acc, b: F.struct(
            F.concat(F.substring(acc["rest"], F.lit(1), F.instr(acc["rest"], b) - 1), F.substring(acc["rest"], F.instr(acc["rest"], b) + 1, F.length(acc["rest"]))).alias("rest"),
            F.concat(acc["out"], F.array(F.substring(acc["rest"], F.instr(acc["rest"], b) + 1, F.length(acc["rest"])))).alias("out"),
        ),
    )["out"]
    found = with_text.select("doc_id", "pos", "raw", F.explode(step).alias("token")).where((F.length("token") >= 2) & (count_in(F.col("raw"), F.col("token")) >= least))
    both = tokens.select("doc_id", "pos", F.lit(0).alias("step"), "token").unionByName(found.select("doc_id", "pos", F.lit(1).alias("step"), "token"))
    side = F.contains("token", F.lit("(")).cast("int") + F.contains("token", F.lit(")")).cast("int")
    return both.where(side != 1).select("doc_id", (side == 2).cast("int").alias("bracketed"), "step", "pos", "token")


def paren_parts(tokens: DataFrame) -> DataFrame:
    """The older expansion: between both brackets, after an opening one alone, without the last sign for a closing one alone; tokens without brackets stay."""
    t = F.col("token")
    opening, closing = F.contains(t, F.lit("(")), F.contains(t, F.lit(")"))
    between = F.substring_index(F.substring(t, F.instr(t, "(") + 1, F.length(t)), ")", 1)
    after = F.substring(t, F.instr(t, "(") + 1, F.length(t))
    return tokens.withColumn("token", F.when(opening & closing, between).when(opening, after).when(closing, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def sentence_array(text: Column, ending: str = "다", closed: bool = True) -> Column:
    """Sentences up to ``ending`` and dots, and what is left after removing them; with ``closed`` at least one dot is needed.

    A sentence lies within one line. Terminators are cut after in one pass and each line's rest is found from its
    beginning, so the time is linear even for lines without any terminator.
    """
    end = rf"{ending}\.{'+' if closed else '*'}"
    pieces = F.split(F.regexp_replace(text, f"({end})", "$1\n"), "\n")
    found = F.filter(pieces, lambda p: p.rlike(rf"{end}\z"))
    return F.concat(found, F.array(F.regexp_replace(text, rf"(?dm)^[^\n]*{ending}\.", "")))


def sentences(df: DataFrame, text: str = "clean", ending: str = "다", closed: bool = True) -> DataFrame:
    """``(doc_id, sent_id, sentence)``."""
    return df.select("doc_id", F.posexplode(sentence_array(F.col(text), ending, closed)).alias("sent_id", "sentence"))


def plain_sentences(df: DataFrame, text: str = "clean") -> DataFrame:
    """``(doc_id, sent_id, sentence)`` at white space after full stop, question or exclamation mark."""
    return df.select("doc_id", F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("sent_id", "sentence"))
