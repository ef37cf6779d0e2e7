import random

import pytest
from pyspark.sql import functions as F

from wordmine.functions import clean
from wordmine.operators import compound, perdoc, tokens
from wordmine.plans import catalogue, lineage
from tests.test_plans import folder  # noqa: F401


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    signs = ["가", "다", "다.", "다..", "나1", "12", "3", ".", " ", " ", "\n", "(", ")", "A", "é", "𝒳"]
    return ["", " ", "다.", "((가)나", *["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(200)]]


def test_texts_are_cut_as_by_the_column_expressions(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, clean string")
    for got, cut in ((tokens.tokenize(docs, least=3), perdoc.tokens_of), (tokens.sentences(docs), lambda t: list(enumerate(perdoc.sentences_of(t))))):
        assert sorted(tuple(r) for r in got.collect()) == [(d, *x) for d, t in enumerate(texts) for x in sorted(cut(t))]
    bare = docs.select("doc_id", clean.strip_parens(F.col("clean"))).collect()
    assert dict(map(tuple, bare)) == {d: perdoc.without_brackets(t) for d, t in enumerate(texts)}


@pytest.mark.parametrize("keep_tail", [True, False])
def test_chains_are_those_of_the_collection(spark, keep_tail):
    rng = random.Random(5)
    pairs = {d: [(rng.choice("abc"), rng.choice("abc")) for _ in range(d)] for d in range(1, 12)}
    rows = [(d, k, a, b) for d, own in pairs.items() for k, (a, b) in enumerate(own)]
    got = compound.chain_merge(spark.createDataFrame(rows, "doc_id bigint, ord int, a string, b string"), keep_tail).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, " ".join(r.words)) for r in got] == [(d, c) for d, own in pairs.items() for c in perdoc.chains_of(own, keep_tail)]


def test_counts_don_t_depend_on_the_way(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab ") for _ in range(400))
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"aa", "aba"}
    each = perdoc.count_each(text, words)
    monkeypatch.setattr(perdoc, "EACH", 0)
    assert perdoc.count_each(text, words) == each == {w: text.count(w) for w in words}


def test_nouns_inside_others_come_last():
    assert perdoc.included_last(["ab", "abc", "x", "b", "cx"]) == ["abc", "cx", "ab", "x", "b"]
    assert perdoc.included_last(["a\nb", "b", "c"]) == ["a\nb", "c", "b"]


@pytest.mark.parametrize("name", ["discover", "discovered_nouns", "mutual_inclusion"])
def test_documents_are_stored_as_one_row_each(spark, folder, monkeypatch, name):  # noqa: F811
    stored, store = [], lineage.store

    def seen(df, label, *rest, **named):
        if "doc_id" in df.columns and label != "nouns":
            stored.append((label, df.count()))
        return store(df, label, *rest, **named)

    monkeypatch.setattr(lineage, "store", seen)
    assert catalogue.QUERIES[name](spark, folder).count()
    assert stored == [("discover-docs", 12)]
