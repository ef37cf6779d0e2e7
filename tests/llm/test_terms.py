import random
from collections import Counter

from pyspark.sql import functions as F

from wordmine.llm import term_counts as T


def _model(texts):
    total, records = Counter(), Counter()
    for t in texts:
        words = t.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        total.update(words)
        records.update(set(words))
    return {(w, n, records[w]) for w, n in total.items()}


def test_counts_equal_brute_force(spark):
    texts = ["a b  a\tc", "b\xa0b b", "", " \n", None, "c", "c"]
    df = spark.createDataFrame([(t, 1) for t in texts], "body string, sign int")
    assert {tuple(r) for r in T.term_deltas(df).collect()} == _model([t for t in texts if t and t.strip(" \n")])
    assert T.term_deltas(df.limit(0)).count() == 0
    assert [tuple(r) for r in T.term_deltas(df, True).where("term IS NULL").collect()] == [(None, 4, 4)]


def _frame(spark, data):
    return spark.createDataFrame(list(data.items()), "key bigint, body string")


def test_changes_lead_to_the_full_count(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 6)))
    old = {i: text() for i in range(30)}
    new = {i: (text() if rng.random() < 0.4 else t) for i, t in old.items() if rng.random() < 0.8} | {i: text() for i in range(30, 40)}
    store = T.CountStore.create(T.term_deltas(T.signed_changes(_frame(spark, {}), _frame(spark, old))), part_terms=2)
    changes = T.signed_changes(_frame(spark, old), _frame(spark, new))
    assert changes.count() < len(old) + len(new) and store.parts == 4
    assert {tuple(r) for r in store.read().collect()} == _model(list(old.values()))
    assert {tuple(r) for r in store.apply(T.term_deltas(changes)).read().collect()} == _model(list(new.values()))


def test_only_touched_parts_are_written(spark):
    first = spark.createDataFrame([(f"w{i}", 1, 1) for i in range(40)], T.COUNTS)
    store = T.CountStore.create(first, part_terms=5)
    after = store.apply(spark.createDataFrame([("w3", 2, 1), ("w4", 0, 0)], T.COUNTS))
    moved = {p for p in store.folders if after.folders[p] != store.folders[p]}
    assert store.parts == 8 and len(moved) == 1
    assert {r.term: r.n_total for r in after.read().collect()} == {f"w{i}": 3 if i == 3 else 1 for i in range(40)}
    gone = after.apply(spark.createDataFrame([(f"w{i}", -3 if i == 3 else -1, -2 if i == 3 else -1) for i in range(40)], T.COUNTS))
    assert gone.folders == {} and gone.read().count() == 0 and store.read().count() == 40


def test_latest_delivery_counts(spark):
    rows = [
        ("t", 1, "old", 1, False), ("t", 1, "new", 2, False), ("t", 2, "x", None, False), ("t", None, "n", 1, False), ("t", None, "n", 1, False), ("t", None, "l", 1, True),
        ("t", 3, "a", 1, False), ("t", 3, "b", 2, True), ("u", 3, "c", 1, True), ("t", 4, "late", 1, True), ("t", 4, "newer", 2, False), ("t", 5, "same", 1, False), ("t", 5, "same", 2, True),
        ("t", 6, None, 2, True), ("t", 6, "w", 1, False),
    ]
    got = T.versions(spark.createDataFrame(rows, "src string, key bigint, body string, at int, late boolean"))
    first = sorted(r.body for r in got.where("batch = 0").collect())
    assert first == ["a", "n", "n", "new", "newer", "same", "w", "x"] and got.where("batch = 0 AND sign <> 1").count() == 0
    late = {(r.body, r.n) for r in got.where("batch = 1").groupBy("body").agg(F.sum("sign").alias("n")).collect()}
    assert late == {("l", 1), ("a", -1), ("b", 1), ("c", 1), ("late", 0), ("same", 0), ("w", -1), (None, 1)} - {("late", 0)}


def test_marks(spark):
    counts = spark.createDataFrame([("r", 5, 1), ("c", 9, 3), ("m", 4, 2), (None, 30, 30)], T.COUNTS)
    assert {r.term: r.mark for r in T.mark(counts).collect()} == {"r": "rare", "c": "common", "m": None}
    assert T.mark(counts.limit(0)).count() == 0


def test_found_merges_late_changes_into_stored_counts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a b"), (2, "a"), (3, " ")], "_c0 bigint, NEWS string").write.parquet(f"{tmp_path}/text.parquet")
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    rows = [
        (1, "c c old", at(1), at(1)), (1, "c new", at(1), at(9)), (2, "d", at(1), at(1)), (2, "d", at(1), at(5)), (3, "late a", at(1), at(20)),
        (None, "x", at(1), at(1)), (None, "x", at(1), at(8)), (4, "y", None, at(2)), (5, "early", at(3), at(30)), (5, "z", at(3), at(3)), (6, "w", at(1), at(4)), (6, None, at(1), at(5)),
    ]
    long = spark.createDataFrame(rows, "row_no bigint, NEWS_BODY string, pub_ts string, load_ts string")
    long = long.withColumn("pub_ts", F.col("pub_ts").cast("timestamp_ntz")).withColumn("load_ts", F.col("load_ts").cast("timestamp_ntz"))
    long.write.parquet(f"{tmp_path}/longtext.parquet")
    stored = []
    create = T.CountStore.create
    monkeypatch.setattr(T.CountStore, "create", staticmethod(lambda counts: stored.append(create(counts)) or stored[-1]))
    got = {tuple(r) for r in T.p3_terms(spark, str(tmp_path)).collect()}
    assert got == _model(["a b", "a", "c new", "d", "late a", "x", "x", "y", "early"])
    assert {r.term for r in stored[0].read().collect()} == {"a", "b", "c", "old", "d", "x", "y", "z", "w", None} - {"w"}
    found = {r.term: (r.mark, r.n_total, r.n_records) for r in T.p3_found(spark, str(tmp_path)).collect()}
    assert len(stored) == 2 and found == {t: ("rare" if k == 1 else "common", n, k) for t, n, k in got}


def test_a_store_is_found_again(spark, tmp_path):
    first = spark.createDataFrame([("a", 2, 1), (None, 1, 1)], T.COUNTS)
    kept = T.CountStore.restore(spark, T.CountStore.create(first, folder=f"{tmp_path}/my counts").manifest())
    again = kept.apply(spark.createDataFrame([("a", 1, 1), ("b", 1, 1), (None, 1, 1)], T.COUNTS))
    assert {tuple(r) for r in again.read().collect()} == {("a", 3, 2), ("b", 1, 1), (None, 2, 2)} and again.folder == f"{tmp_path}/my counts"
