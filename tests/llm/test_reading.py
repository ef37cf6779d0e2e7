import random

from wordmine.llm import reading as R

WORDS = {g: [f"{c}{w}" for w in ("ato", "elu", "imri", "osta", "unke")] for g, c in zip(range(1, 6), "bdgkm")}


def _document(rng, grade):
    pick = lambda: min(5, max(1, grade + rng.choice([0, 0, 0, 0, -1, 1])))
    return " ".join(" ".join(rng.choice(WORDS[g]) for _ in range(8)) + "." for g in (pick() for _ in range(12)))


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    grades = [i % 5 + 1 for i in range(300)]
    docs = [(i, _document(rng, g)) for i, g in enumerate(grades)] + [(900, None), (901, ""), (None, "x"), (902, "."), (0, None)]
    labels = [(i, f"r{k}", min(5, max(1, grades[i] + rng.choice([0, 0, 0, 0, 1])))) for i in range(150) for k in range(2)] + [(5, "r9", None), (None, "r", 3), (150, "r", 9)]
    got = R.reading_grades(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, rater string, grade int"))
    rows = {r.doc_id: r.grade for r in got.collect()}
    assert set(rows) == set(range(300)) | {902}
    assert sum(rows[i] == grades[i] for i in range(150, 300)) / 150 > 0.9


def test_no_ratings(spark):
    docs, labels = spark.createDataFrame([(1, "a b.")], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, rater string, grade int")
    assert R.reading_grades(docs, labels).count() == 0


def test_median_of_raters(spark):
    labels = spark.createDataFrame([(1, "a", 2), (1, "a", 2), (1, "b", 3), (2, "a", 4), (2, "b", 5), (2, "c", 5)], "doc_id bigint, rater string, grade int")
    assert {r.doc_id: r.grade for r in R.ratings(labels).collect()} == {1: 2, 2: 5}
