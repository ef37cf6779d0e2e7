import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmine.llm import packing as K


def _pack(spark, sizes, caps, **more):
    docs = spark.createDataFrame(sizes, "doc_id bigint, n bigint")
    return [r.asDict() for r in K.pack(docs, spark.createDataFrame([(c,) for c in caps], "capacity bigint"), **more).collect()]


def test_every_document_once_and_within_all_limits(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(s)) for i, s in enumerate(rng.integers(1, 260, 400))] + [(400, 0), (401, None), (None, 5), (3, 1)]
    want = {i: s for i, s in sizes[:400]}
    want[3] = max(want[3], 1)
    rows = _pack(spark, sizes, [100, 300, 0, None], group=150, most_docs=20)
    for cap in (100, 300):
        mine = [r for r in rows if r["capacity"] == cap]
        total, bins, count = {}, {}, {}
        for r in mine:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
            bins[r["bin"]] = bins.get(r["bin"], 0) + r["size"]
            count[r["bin"]] = count.get(r["bin"], 0) + 1
            assert (r["n_parts"] > 1) == (want[r["doc_id"]] > cap)
        assert total == want and max(bins.values()) <= cap and max(count.values()) <= 20
        assert len(bins) <= 1.06 * sum(bins.values()) / cap + 4
    assert {r["capacity"] for r in rows} == {100, 300}
    assert _pack(spark, [], [100]) == []


def test_best_fit_takes_the_tightest_bin():
    assert K.best_fit(np.array([60, 50, 40]), 100).tolist() == [0, 1, 0]
    assert len(set(K.best_fit(np.array([10, 10, 10]), 100, most_docs=2).tolist())) == 2
    assert len(set(K.best_fit(np.array([60, 40]), 100, rule="dot").tolist())) == 1
    assert K.best_fit(np.array([], dtype=np.int64), 100).tolist() == []


def test_attention_cost_binds():
    assert len(set(K.best_fit(np.array([100, 60, 60]), 200, attention=40000).tolist())) == 2


def test_attention_cost_keeps_items_apart_whose_tokens_fit(spark):
    assert K.best_fit(np.array([90, 10]), 100, attention=8200).tolist() == [0, 0]
    assert K.best_fit(np.array([90, 10]), 100, attention=8199).tolist() == [0, 1]
    assert K.best_fit(np.array([95, 5, 3]), 100, attention=8000).tolist() == [0, 1, 1]
    rng = np.random.default_rng(2)
    rows = _pack(spark, [(i, int(s)) for i, s in enumerate(rng.integers(1, 250, 300))] + [(300, 90), (301, 10)], [100])
    cost, items = {}, {}
    for r in rows:
        cost[r["bin"]] = cost.get(r["bin"], 0) + r["size"] ** 2
        items[r["bin"]] = items.get(r["bin"], 0) + 1
    assert max(c for b, c in cost.items() if items[b] > 1) <= K.ATTENTION * 100**2 < max(cost.values())
    assert len({r["bin"] for r in _pack(spark, [(1, 90), (2, 10)], [100])}) == 2
    assert len({r["bin"] for r in _pack(spark, [(1, 90), (2, 10)], [100], attention=1.0)}) == 1


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_sizes_under_the_byte_tokenizer(spark):
    df = spark.createDataFrame([("가a",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(K.byte_tokens(F.col("text"))).collect()] == [4, 0, None]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs a vocabulary file")
def test_sizes_under_a_vocabulary_file(spark):
    df = spark.createDataFrame([("the people said that the council",), ("",), (None,), ("가나다",)], "text string")
    got = [r[0] for r in df.select(K.model_tokens(F.col("text"), VOCABULARY)).collect()]
    assert 5 <= got[0] <= 12 and got[1] == 0 and got[2] is None and 1 <= got[3] <= 9
