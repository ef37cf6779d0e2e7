import os
import random

import numpy as np
import pytest

from wordmine.llm import leakage as L

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def _words(rng, n, first="abcdefghij"):
    return [rng.choice(first) + "".join(rng.choice("klmnoprstuvw") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def _truth(docs, items):
    built = L.build_items(items)
    streams = [(d, L.stream(t)) for d, t in docs if d is not None and t]
    return {(d, i.item_id) for d, t in streams for i in built if any(s in t for s in i.spans)}


def test_copies_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(k, " ".join(_words(rng, rng.randint(20, 60)))) for k in range(25)]
    docs = []
    for k in range(120):
        words = _words(rng, rng.randint(30, 200))
        if k % 2:
            source = items[rng.randrange(len(items))][1].split()
            n = rng.randint(len(source) // 3, len(source))
            at = rng.randrange(len(source) - n + 1)
            part = " ".join(source[at : at + n]).upper() if k % 3 else "​".join(source[at : at + n])
            words.insert(rng.randrange(len(words)), part)
        docs.append((k, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "  \n"), (None, items[0][1]), (503, items[1][1] * 300), (503, items[1][1] * 300), (504, items[0][1] + " " + items[2][1])]
    items += [(90, items[3][1]), (91, None), (92, ""), (93, "- - ."), (None, "x y")]
    found = L.leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    copies = [(r.doc_id, r.item_id) for r in found if r.kind == "copy"]
    assert len(copies) == len(set(copies))
    assert set(copies) == _truth(docs, items)
    assert all(r.run == r.shared and r.run * 2 >= r.words for r in found if r.kind == "copy")
    assert {d for d, i in copies if i == 90} == {d for d, i in copies if i == 3}


def test_signs_are_no_words_and_short_items_leave_long_ones_alone(spark):
    items = [(1, "alpha - - - - beta gamma delta"), (2, "네 확인"), (3, " ".join(_words(random.Random(1), 40)))]
    docs = [(1, "so gamma, delta it is"), (2, "확인했다"), (3, "nothing here"), (4, items[2][1])]
    assert len(L.build_items(items)[0].words) == 4
    got = {(r.doc_id, r.item_id) for r in L.leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(1, 1), (2, 2), (4, 3)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], DOCS), spark.createDataFrame([(1, "a b c d")], ITEMS)
    assert L.leaked(docs.limit(0), items).count() == 0 and L.leaked(docs, items.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_paraphrases_are_found(spark):
    """Items with a sixth of their words replaced, dropped or doubled, inside other documents: at least nine in ten are found, few others are."""
    rng = random.Random(11)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r.text]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = _truth(docs, items)
    planted = set()
    for d, (i, text) in zip(rng.sample(range(len(docs)), 60), rng.sample(items, 60)):
        words, out = text.split(), []
        for k, w in enumerate(words):
            turn = rng.random() if k % 3 == 0 else 1
            out += [rng.choice(["무척", "very", "다시", "quite"])] if turn < 0.2 else [] if turn < 0.35 else [w, "그리고"] if turn < 0.5 else [w]
        host = docs[d][1].split()
        host[len(host) // 2 : len(host) // 2] = out
        docs[d] = (docs[d][0], " ".join(host))
        planted.add((docs[d][0], i))
    rows = L.leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    copies = {(r.doc_id, r.item_id) for r in rows if r.kind == "copy"}
    found = {(r.doc_id, r.item_id) for r in rows}
    assert copies == _truth(docs, items)
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found - planted - clean) <= 0.1 * len(planted)


def test_checks():
    assert L.common_subsequence("a b c d".split(), "a x c y d".split()) == 3 and L.common_subsequence([], ["a"]) == 0
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert L.common_subsequence(a, b) == table[-1, -1]
    item = L.build_items([(1, "the mill of 1823 burned before harvest and 40 people rebuilt it")])[0]
    item.keys = ["1823", "40", "mill"]
    text = "the old mill of 1823 had burned long before harvest and then 40 people rebuilt it".split()
    assert L.judge(item, text, set(text), "".join(text))[0] == "paraphrase"
    text = "the old mine of 1900 had burned before the harvest and 7 people rebuilt it".split()
    assert L.judge(item, text, set(text), "".join(text)) is None  # the answer check
    assert L.longest_run(item.words, "xthemillof1823y") == 4


def test_passages_of_every_length():
    assert [L.units_of(n) for n in (16, 31, 32, 63, 64, 300)] == [1, 1, 2, 2, 4, 16]
    codes = np.frombuffer("abcdefg\0hij".encode("utf-32-le"), np.uint32)
    got = L.gram_buckets(codes)
    assert (got[4:8] == L.FEATURES).all() and (got[:4] < L.FEATURES).all() and len(got) == len(codes) - L.GRAM + 1
    assert [len(b) for b in L.blocks(L.build_items([(k, "abcd efgh") for k in range(5)]), 16)] == [2, 2, 1]
