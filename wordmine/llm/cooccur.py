"""Items that appear together, counted with stripes.

Each task folds its records into stripes, one associative array of neighbours for every item, and sends an item's
stripe in blocks of neighbours. Blocks of the same item are merged by key, entry by entry; no task ever holds all
neighbours, or all records, of a frequent item. Item counts travel as the stripe's own entry. Whether two items come
together more often than chance is decided by the log-likelihood ratio at a stated level of significance.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.llm.lookalike import consistent
from wordmine.llm.records import is_blank
from wordmine.plans.lineage import materialize
from wordmine.sources.tables import table

#: Entries a task holds before it sends its stripes on, and entries in one sent block.
FLUSH, BLOCK = 1_000_000, 4096
#: Least log-likelihood ratio of a pair that isn't chance: the 95 % point of its distribution, chi-square with one degree of freedom.
LEVEL = 3.841

_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"#([^\W]+)")
_LETTER = re.compile(r"[^\W\d_]")


def hashtags(body: str | None) -> list[str]:
    """The distinct hashtags of a body in order of code points, in consistent form and lower case.

    A tag is the run of letters, digits and underscores after ``#``, with at least one letter and outside web links.
    Null and empty bodies have none.
    """
    if not body or "#" not in body and "＃" not in body:
        return []
    text = _LINK.sub(" ", consistent(body))
    return sorted({consistent(tag.lower()) for tag in _TAG.findall(text) if _LETTER.search(tag)})


def hashtag_sets(df: DataFrame, column: str) -> DataFrame:
    """``(items)`` of every row that has hashtags in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tags for body in batch.column(0).to_pylist() if (tags := hashtags(body))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["items"])

    marked = df.select(F.col(column).alias("body")).where(F.col("body").contains("#") | F.col("body").contains("＃"))
    return marked.mapInArrow(run, "items array<string>")


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes: dict[str, Counter] = defaultdict(Counter)
    held = 0

    def flush() -> pa.RecordBatch:
        rows: list[tuple[str, list]] = []
        for item, near in stripes.items():
            entries = list(near.items())
            rows += [(item, entries[i : i + BLOCK]) for i in range(0, len(entries), BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.map_(pa.string(), pa.int64()))], ["item", "stripe"])

    for batch in batches:
        for items in batch.column("items").to_pylist():
            items = sorted({x for x in items or () if x is not None})
            for i, item in enumerate(items):
                stripe = stripes[item]
                before = len(stripe)
                stripe.update(items[i:])
                held += len(stripe) - before
                if held >= FLUSH:
                    yield flush()
                    stripes.clear()
                    held, stripe = 0, None
    yield flush()


def stripe_counts(sets: DataFrame) -> DataFrame:
    """``(item, near, n)``: in how many of the ``items`` arrays both occur, ``item <= near``; equal names give the item's own count.

    Null arrays and null items count for nothing, repeats within an array once. The counts are kept in the shared
    folder, for they are read several times.
    """
    blocks = sets.select("items").mapInArrow(_stripes, "item string, stripe map<string,bigint>")
    entries = blocks.select("item", F.explode("stripe").alias("near", "n"))
    return materialize(entries.groupBy("item", "near").agg(F.sum("n").alias("n")), "stripes")


def _part(n: Column) -> Column:
    return F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0))


def log_likelihood(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """The log-likelihood ratio of a pair: twice the mutual information of its two-by-two table of counts."""
    a, b, ab, n = (x.cast("double") for x in (a, b, ab, n))
    cells = _part(ab) + _part(a - ab) + _part(b - ab) + _part(n - a - b + ab)
    return 2 * (cells - _part(a) - _part(n - a) - _part(b) - _part(n - b) + _part(n))


def pair_statistics(counts: DataFrame, n: DataFrame, level: float = LEVEL) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n_all, lift, llr, significant)`` of all pairs of ``stripe_counts``; ``n`` has one row ``n``, the number of records.

    ``lift`` is ``n_ab * n / (n_a * n_b)``. ``significant`` is true where a pair comes more often than chance by a
    log-likelihood ratio of at least ``level``. ``item_a < item_b`` by code point.
    """
    own = counts.where("item = near").select("item", F.col("n").alias("own"))
    pairs = counts.where("item < near").select(F.col("item").alias("item_a"), F.col("near").alias("item_b"), F.col("n").alias("n_ab"))
    full = pairs.join(own.select(F.col("item").alias("item_a"), F.col("own").alias("n_a")), "item_a").join(own.select(F.col("item").alias("item_b"), F.col("own").alias("n_b")), "item_b")
    full = full.crossJoin(F.broadcast(n.select(F.col("n").alias("n_all"))))  # one row
    lift = F.col("n_ab").cast("double") * F.col("n_all") / (F.col("n_a").cast("double") * F.col("n_b"))
    llr = log_likelihood(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n_all"))
    return full.withColumn("lift", lift).withColumn("llr", llr).withColumn("significant", (F.col("lift") > 1) & (F.col("llr") >= level))


def frequent_pairs(counts: DataFrame, n: DataFrame, least: int = 5, share: int = 500, ratio: int = 4, level: float = LEVEL) -> DataFrame:
    """The significant pairs found in at least ``least`` records and a ``share``-th of all, ``ratio`` times as often as by chance.

    Counts are exact before anything is dropped: a pair is left out only by its own total. With the numbers given here
    the least ratio a pair can have is 6.3, so ``LEVEL`` confirms them; with weaker support it decides.
    """
    wide = [F.col(c).cast("decimal(19,0)") for c in ("n_ab", "n_all", "n_a", "n_b")]
    enough = (F.col("n_ab") >= least) & (F.col("n_ab") * share >= F.col("n_all")) & (wide[0] * wide[1] >= wide[2] * wide[3] * ratio)
    return pair_statistics(counts, n, level).where(enough & F.col("significant"))


def _articles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    articles = table(spark, folder, "text", "_c0", "NEWS").where(~is_blank(F.col("NEWS")))
    return stripe_counts(hashtag_sets(articles, "NEWS")), articles.agg(F.count(F.lit(1)).alias("n"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of hashtags that occur together far more often than by chance, see TESTDATA.md."""
    return frequent_pairs(*_articles(spark, folder)).select("item_a", "item_b")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of hashtags with its common articles, ratio to chance, log-likelihood ratio and whether that is significant."""
    return pair_statistics(*_articles(spark, folder)).select("item_a", "item_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"), "significant")


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs}
ORACLES: dict[str, str] = {}
