"""Frequencies of every distinct term, kept up to date by signed changes.

The counts live in a table ``(term, n_total, n_records)`` split by a hash of the term into parts whose number follows
the number of terms. A batch of changed records becomes signed rows, +1 for a version that enters and -1 for one that
leaves; only those are tokenised and summed per term. Merging reads and writes the parts that hold a changed term and
leaves all others where they are. The row without a term counts the records themselves.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmine.llm.records import BLANKS, is_blank, records
from wordmine.plans.lineage import materialize, store
from wordmine.sources.tables import table

#: Terms in one part of the stored counts, on average.
PART_TERMS = 250_000
COUNTS = "term string, n_total bigint, n_records bigint"


def tokens(body: Column) -> Column:
    """Maximal runs of characters other than space, tab, CR and LF, as stored."""
    return F.filter(F.split(body, f"[{BLANKS}]+"), lambda t: t != "")


def signed_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(body, sign)`` that turn the records ``old`` into ``new``, both ``(key, body)`` with unique keys.

    A record found on both sides with an equal body gives no row; a changed one gives -1 for the old body and +1
    for the new. Null keys never match and null bodies give no row.
    """
    o, n = old.select(F.col("key").alias("ok"), F.col("body").alias("ob")), new.select("key", "body")
    both = o.join(n, F.col("ok") == F.col("key"), "full").where(~F.col("ob").eqNullSafe(F.col("body")))
    sides = F.array(F.struct(F.col("ob").alias("body"), F.lit(-1).alias("sign")), F.struct(F.col("body").alias("body"), F.lit(1).alias("sign")))
    return both.select(F.explode(sides).alias("x")).select("x.body", "x.sign").where(F.col("body").isNotNull())


def term_deltas(changes: DataFrame, records_too: bool = False) -> DataFrame:
    """Signed ``(term, n_total, n_records)`` of ``(body, sign)`` rows, for each ``batch`` if there is such a column. Blank bodies give no row.

    Within a record equal tokens are made neighbours by sorting, so its first of each kind can be told without a
    second grouping; both counts come from one map-side combined aggregate. With ``records_too`` the row of the null
    term counts the records.
    """
    by = [c for c in changes.columns if c == "batch"]
    sorted_ = changes.where(~is_blank(F.col("body"))).select(*by, "sign", F.sort_array(tokens(F.col("body"))).alias("t"))
    marked = F.transform(F.col("t"), lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get(F.col("t"), i - 1) == x), 0).otherwise(1).alias("first")))
    if records_too:
        marked = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first"))), marked)
    each = sorted_.select(*by, "sign", F.explode(marked).alias("x"))
    sums = F.sum("sign").cast("bigint").alias("n_total"), F.sum(F.col("sign") * F.col("x.first")).cast("bigint").alias("n_records")
    return each.groupBy(*by, F.col("x.term").alias("term")).agg(*sums)


def merge_counts(counts: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """``counts`` with the deltas added; terms that no record holds any longer are left out."""
    rows = None
    for part in ([counts] if counts is not None else []) + list(deltas):
        part = part.select("term", "n_total", "n_records")
        rows = part if rows is None else rows.unionByName(part)
    summed = rows.groupBy("term").agg(F.sum("n_total").alias("n_total"), F.sum("n_records").alias("n_records"))
    return summed.where((F.col("n_total") != 0) | (F.col("n_records") != 0))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class CountStore:
    """Stored counts: the number of parts and, for each part that holds any term, the folder it lies in.

    With ``folder`` they are kept there for later sessions, which come back to them by the ``manifest``; without it they
    lie below the shared folder as long as the driver runs.
    """

    spark: SparkSession
    parts: int
    folders: dict[int, str]
    folder: str | None = None

    @staticmethod
    def create(counts: DataFrame, part_terms: int = PART_TERMS, folder: str | None = None) -> CountStore:
        """A store with the counts ``(term, n_total, n_records)``; they are written once before, to be counted."""
        held = materialize(counts.select("term", "n_total", "n_records"), "counts")
        parts = max(1, -(-held.count() // part_terms))
        return CountStore(counts.sparkSession, parts, {}, folder).apply(held)

    def manifest(self) -> str:
        """The store in JSON, to be opened again by ``restore``."""
        return json.dumps({"parts": self.parts, "folders": self.folders, "folder": self.folder})

    @staticmethod
    def restore(spark: SparkSession, manifest: str) -> CountStore:
        held = json.loads(manifest)
        return CountStore(spark, held["parts"], {int(p): f for p, f in held["folders"].items()}, held["folder"])

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The counts of the given parts, or of all."""
        folders = [self.folders[p] for p in (self.folders if parts is None else parts) if p in self.folders]
        return self.spark.read.schema(COUNTS).parquet(*folders) if folders else self.spark.createDataFrame([], COUNTS)

    def apply(self, delta: DataFrame) -> CountStore:
        """A store with the signed changes merged in. Only parts that hold a changed term are read and written; the old store stays as it is."""
        real = delta.where("n_total <> 0 OR n_records <> 0")
        split = materialize(real.select("term", "n_total", "n_records").withColumn("part", _part(self.parts)).repartition("part"), "term-changes", by=["part"])
        touched = sorted(r.part for r in split.select("part").distinct().collect())  # as many as there are parts
        merged = merge_counts(self.read(touched), split).withColumn("part", _part(self.parts)).repartition("part")
        path = store(merged, "term-counts", ["part"], self.folder)
        written = self.spark.read.schema(f"{COUNTS}, part int").parquet(path).select("part").distinct().collect()
        kept = {p: f for p, f in self.folders.items() if p not in set(touched)}
        return CountStore(self.spark, self.parts, kept | {r.part: f"{path}/part={r.part}" for r in written}, self.folder)


def mark(counts: DataFrame, rare_at_most: int = 1, common_share: int = 10) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` up to ``rare_at_most`` records, ``common`` from 1/``common_share`` of all records, else null.

    The number of records is that of the null term, one row, which is the only one sent to the tasks. A term that is
    both counts as rare.
    """
    n = counts.where("term IS NULL").agg(F.coalesce(F.max("n_records"), F.lit(0)).alias("n"))
    rare = F.col("n_records") <= rare_at_most
    common = F.col("n_records") * common_share >= F.col("n")
    words = counts.where("term IS NOT NULL").crossJoin(F.broadcast(n))
    return words.select("term", F.when(rare, "rare").when(common, "common").alias("mark"), "n_total", "n_records")


def versions(rows: DataFrame) -> DataFrame:
    """Deliveries ``(src, key, body, at, late)`` as signed changes ``(batch, body, sign)``: batch 0 are the prompt ones, batch 1 what the late ones change.

    Of several deliveries of a record that with the greatest ``at`` counts (nulls least, then the greater body). In
    batch 1 a late one enters and the version before leaves; where both have equal bodies that cancels when terms are
    summed. Rows without a key are records of their own. Bodies are shuffled once, by their record.
    """
    by = Window.partitionBy("src", "key").orderBy(F.col("at").desc_nulls_last(), F.col("body").desc_nulls_last())
    prompt = ~F.col("late")
    prompts = F.sum(prompt.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    keyed = rows.where("key IS NOT NULL").select("body", "late", F.row_number().over(by).alias("place"), prompts.alias("prompts"))
    first, last = (prompt & (F.col("prompts") == 1)).cast("int"), (F.col("place") == 1).cast("int")
    flags = keyed.select("body", first.alias("first"), (last - first).alias("change"))
    loose = rows.where("key IS NULL").select("body", prompt.cast("int").alias("first"), F.col("late").cast("int").alias("change"))
    both = flags.select("body", "first", "change").unionByName(loose)
    each = F.array(F.struct(F.lit(0).alias("batch"), F.col("first").alias("sign")), F.struct(F.lit(1).alias("batch"), F.col("change").alias("sign")))
    return both.select("body", F.explode(F.filter(each, lambda x: x["sign"] != 0)).alias("x")).select("x.batch", "body", "x.sign")


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of both tables as ``(src, key, body, at, late)``; late is what was loaded more than a day after publication."""
    text = table(spark, folder, "text", "_c0", "NEWS").select(F.lit("text").alias("src"), F.col("_c0").alias("key"), F.col("NEWS").alias("body"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(False).alias("late"))
    late = F.coalesce(F.col("load_ts") > F.col("pub_ts") + F.expr("INTERVAL 1 DAY"), F.lit(False))
    rows = table(spark, folder, "longtext", "row_no", "NEWS_BODY", "pub_ts", "load_ts")
    return text.unionByName(rows.select(F.lit("longtext").alias("src"), F.col("row_no").alias("key"), F.col("NEWS_BODY").alias("body"), F.col("load_ts").alias("at"), late.alias("late")))


def _stored(rows: DataFrame) -> CountStore:
    """Counts after both batches: the first load is stored, the signed changes of the late batch are merged into it."""
    deltas = materialize(term_deltas(versions(rows), records_too=True), "term-deltas", by=["batch"])
    return CountStore.create(deltas.where("batch = 0")).apply(deltas.where("batch = 1"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rare and common terms of both article tables, see TESTDATA.md."""
    return mark(_stored(deliveries(spark, folder)).read()).where(F.col("mark").isNotNull()).select("term", "mark", "n_total", "n_records")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    """All terms of both article tables with their counts."""
    return _stored(deliveries(spark, folder)).read().where("term IS NOT NULL")


def p3_increment(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of ``longtext`` after three versions: the prompt deliveries, then the late ones, then a withdrawal.

    The withdrawal takes back the records of publishers without a code. Each version is stored and only its changes are
    counted and merged, so the result must equal a full count of what is left. Records without a key are kept.
    """
    rows = deliveries(spark, folder).where("src = 'longtext'")
    gone = table(spark, folder, "longtext", "row_no", "NEWS_BODY", "press_cd", "load_ts").where("press_cd IS NULL")
    by = Window.partitionBy("row_no").orderBy(F.col("load_ts").desc_nulls_last(), F.col("NEWS_BODY").desc_nulls_last())
    keyed = gone.where("row_no IS NOT NULL").withColumn("place", F.row_number().over(by)).where("place = 1")
    taken = keyed.select("NEWS_BODY").unionByName(gone.where("row_no IS NULL").select("NEWS_BODY"))
    withdrawn = term_deltas(taken.select(F.col("NEWS_BODY").alias("body"), F.lit(-1).alias("sign")))
    return _stored(rows).apply(withdrawn).read().where("term IS NOT NULL")


QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms, "p3_increment": p3_increment}

_WORDS = r"list_filter(regexp_split_to_array(body, '[ \t\r\n]+'), lambda t: t <> '')"
_TEXT = "SELECT NEWS AS body FROM text WHERE regexp_matches(NEWS, '[^ \\t\\r\\n]')"
_LONG = "SELECT DISTINCT row_no, NEWS_BODY AS body FROM longtext WHERE regexp_matches(NEWS_BODY, '[^ \\t\\r\\n]')"
_COUNT = f"""each AS (SELECT id, unnest({_WORDS}) AS term FROM recs),
counted AS (SELECT term, count(*) AS n_total, count(DISTINCT id) AS n_records FROM each GROUP BY term)"""
_BOTH = f"recs AS (SELECT row_number() OVER () AS id, body FROM ({_TEXT} UNION ALL SELECT body FROM ({_LONG})))"

ORACLES = {
    "p3_found": f"""WITH {_BOTH}, {_COUNT}, marked AS (SELECT term, CASE WHEN n_records <= 1 THEN 'rare'
WHEN n_records * 10 >= (SELECT count(*) FROM recs) THEN 'common' END AS mark, n_total, n_records FROM counted)
SELECT * FROM marked WHERE mark IS NOT NULL""",
    "p3_terms": f"WITH {_BOTH}, {_COUNT} SELECT * FROM counted",
    "p3_increment": f"""WITH recs AS (SELECT row_number() OVER () AS id, body FROM (SELECT DISTINCT row_no, NEWS_BODY AS body
FROM longtext WHERE press_cd IS NOT NULL AND regexp_matches(NEWS_BODY, '[^ \\t\\r\\n]'))), {_COUNT} SELECT * FROM counted""",
}
