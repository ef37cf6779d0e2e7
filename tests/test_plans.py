import random
import re

import pytest
from pyspark.sql import Row

from wordmine.operators import counts, tokens
from wordmine.plans import catalogue, lineage

WORDS = "경제가 경제성장률 성장했다. (성장 둔화다. 한국은행에서 한국은행장은 ABCDEFGHIJ ABCDEFGHIJKLMNOPQRS 은행장".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("tables"), random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(12)]
    tables = {
        "documents": [Row(doc_id=i, text=t) for i, t in enumerate(texts)],
        "text": [Row(_c0=i, NEWS=t) for i, t in enumerate(texts[:5])],
        "lexicon": [Row(surface=s, tag=t) for s, t in (("경제", "NNG"), ("성장", "NNG"), ("은", "JX"), ("에서", "JKB"), ("다", "EF"), ("장", "XSN"))],
    }
    for name, data in tables.items():
        spark.createDataFrame(data).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def sent_to_all(plan: str) -> list[str]:
    """The explodes below a broadcast in the text of a plan."""
    found, above = [], None
    for line in plan.split("\n"):
        depth = re.search(r"\w", line)
        depth = depth.start() if depth else 0
        if above is not None and depth <= above:
            above = None
        if "BroadcastExchange" in line and above is None:
            above = depth
        if above is not None and "Generate explode" in line:
            found.append(line.strip())
    return found


@pytest.mark.parametrize("name", ["cliff_nouns_first", "corpus_cliffs", "cliff_nouns_multi", "discovered_nouns", "mutual_inclusion", "new_words", "discover"])
def test_exploded_rows_are_not_gathered_by_the_driver(spark, folder, monkeypatch, name):
    plans, store = [], lineage.store

    def seen(df, *rest, **named):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *rest, **named)

    monkeypatch.setattr(lineage, "store", seen)
    monkeypatch.setattr(counts, "FEW", 0)
    result = catalogue.QUERIES[name](spark, folder)
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert result.count() and any("Generate explode" in p for p in plans)
    assert [x for p in plans for x in sent_to_all(p)] == []


@pytest.mark.parametrize("few", [0, 100_000])
def test_frequencies_of_short_and_long_needles(spark, monkeypatch, few):
    monkeypatch.setattr(counts, "FEW", few)
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))): rng.randint(1, 5) for _ in range(80)}
    vocab = spark.createDataFrame(list(words.items()), "token string, n bigint")
    needles = ["a", "zz", "z" * 20, "aa", "ab", "aba", "abab", "b" * 7] + [w[k : k + size] for w in words for k, size in ((0, 7), (2, 8), (1, 9), (3, 16), (0, 33)) if len(w) >= k + size]
    got = counts.substring_frequency(vocab, spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert {r.needle: r.freq for r in got.collect()} == {n: sum(m * t.count(n) for t, m in words.items()) for n in needles if len(n) >= 2}
    none = counts.substring_frequency(vocab, spark.createDataFrame([("zz",), ("a",)], "needle string"))
    assert [tuple(r) for r in none.collect()] == [("zz", 0)]
    assert counts.substring_frequency(vocab, spark.createDataFrame([], "needle string")).count() == 0
