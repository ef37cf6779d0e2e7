"""Choosing words where the frequency of growing or shrinking forms breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The ratio of a cliff and the share that stands for what follows the last prefix.
CLIFF, TAIL = 1.1, 0.8


def cliff(scored: DataFrame, first: bool = False, ratio: float = CLIFF) -> DataFrame:
    """Prefixes whose score exceeds that of the next longer one ``ratio`` times; the longest always counts.

    ``scored`` is ``(token, len, prefix, score)``. With ``first`` only the shortest chosen prefix of each token.
    """
    by = Window.partitionBy("token").orderBy("len")
    after = F.lead("score").over(by)
    chosen = scored.withColumn("after", after).where(F.col("after").isNull() | (F.col("score") > F.col("after") * ratio))
    if first:
        chosen = chosen.withColumn("rank", F.row_number().over(by)).where("rank = 1")
    return chosen.select("token", "len", "prefix", "score")


def elbow(scored: DataFrame, ratio: float = CLIFF, tail: float = TAIL) -> DataFrame:
    """Prefixes at the elbow of the score: the first by a cliff, later ones where the fall before is smaller than the fall after.

    The score after the longest prefix counts as ``tail`` of it. Tokens without prefixes give no row.
    """
    by = Window.partitionBy("token").orderBy("len")
    before, after = F.lag("score").over(by), F.coalesce(F.lead("score").over(by), F.col("score") * tail)
    marked = scored.withColumn("before", before).withColumn("after", after)
    chosen = F.when(F.col("before").isNull(), F.col("score") > F.col("after") * ratio).otherwise(F.col("before") - F.col("score") < F.col("score") - F.col("after"))
    return marked.where(chosen).select("token", "len", "prefix", "score")


def longest_common_left(forms: DataFrame, mode: int = 0, ratio: float = CLIFF) -> DataFrame:
    """The longest left part that a token shares with others, from ``(token, ord, form, freq)``, longest form first.

    Going down the forms, a hit is one of more than one occurrence that is less than ``ratio`` times the longer one's.
    Mode 0 takes the form before the first hit, else the shortest; mode 1 has nothing without a hit; mode 2 takes
    what the form before the first hit cuts off the token; mode 3 the forms before every first hit of a chain.
    """
    by = Window.partitionBy("token").orderBy("ord")
    marked = forms.select("token", "ord", "form", "freq", F.lag("freq").over(by).alias("longer"), F.lag("form").over(by).alias("form_before"))
    hit = F.coalesce((F.col("freq") < F.col("longer") * ratio) & (F.col("freq") > 1), F.lit(False))
    marked = marked.withColumn("hit", hit)
    if mode == 3:
        heads = marked.withColumn("again", F.coalesce(F.lag("hit").over(by), F.lit(False))).where("hit AND NOT again")
        return heads.select("token", F.col("form_before").alias("match"))
    found = marked.groupBy("token").agg(
        F.min_by(F.when(F.col("hit"), F.col("form_before")), F.when(F.col("hit"), F.col("ord"))).alias("head"), F.max_by("form", "ord").alias("shortest")
    )
    if mode == 2:
        return found.where("head IS NOT NULL").select("token", F.expr("substring(token, length(head) + 1)").alias("match"))
    match = F.col("head") if mode == 1 else F.coalesce("head", "shortest")
    return found.select("token", match.alias("match")).where("match IS NOT NULL AND match <> ''")
