import math
import random
from collections import Counter
from itertools import combinations

from wordmine.llm import cooccur as C


def test_hashtags():
    body = "＃Ａbc #123 #x_1#나라, https://a.example/#top www.b.example/q#no #ABC #다​라 끝#"
    assert C.hashtags(body) == ["abc", "x_1", "나라", "다라"]
    assert C.hashtags(None) == [] and C.hashtags("") == [] and C.hashtags("#") == []


def _sets(spark, data):
    return spark.createDataFrame([(d,) for d in data], "items array<string>")


def test_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    data = [[rng.choice("abcdef") for _ in range(rng.randint(0, 5))] + ["hot"] * (rng.random() < 0.4) for _ in range(200)] + [None, [], [None, "a"]]
    sets = [set(x for x in d or [] if x) for d in data]
    single = Counter(x for s in sets for x in s)
    both = Counter(p for s in sets for p in combinations(sorted(s), 2))
    n = len(data)
    monkeypatch.setattr(C, "FLUSH", 7)
    got = {(r.item_a, r.item_b): r for r in C.pair_statistics(C.stripe_counts(_sets(spark, data)), spark.createDataFrame([(n,)], "n bigint")).collect()}
    assert {k: r.n_ab for k, r in got.items()} == dict(both)
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b) == (single[a], single[b]) and math.isclose(r.lift, both[a, b] * n / (single[a] * single[b]))
        cells = [both[a, b], single[a] - both[a, b], single[b] - both[a, b], n - single[a] - single[b] + both[a, b]]
        rows, cols = [cells[0] + cells[1], cells[2] + cells[3]], [cells[0] + cells[2], cells[1] + cells[3]]
        want = 2 * sum(c * math.log(c * n / (rows[i // 2] * cols[i % 2])) for i, c in enumerate(cells) if c)
        assert math.isclose(r.llr, want, abs_tol=1e-6)


def test_frequent_pairs_thresholds(spark):
    data = [["a", "b"]] * 5 + [["c", "d"]] * 4 + [["e"]] * 20
    n = spark.createDataFrame([(29,)], "n bigint")
    assert [(r.item_a, r.item_b) for r in C.frequent_pairs(C.stripe_counts(_sets(spark, data)), n).collect()] == [("a", "b")]
    assert C.frequent_pairs(C.stripe_counts(_sets(spark, [["a", "b"]]).limit(0)), n).count() == 0


def test_level_decides_where_support_is_weak(spark):
    data = [["a", "b"]] + [["a"]] * 3 + [["b"]] * 3 + [["c", "d"]] * 3 + [["x"]] * 10
    n = spark.createDataFrame([(20,)], "n bigint")
    counts = C.stripe_counts(_sets(spark, data))
    pairs = lambda level: {(r.item_a, r.item_b) for r in C.frequent_pairs(counts, n, 1, 500, 1, level).collect()}
    assert pairs(0.0) == {("a", "b"), ("c", "d")} and pairs(C.LEVEL) == {("c", "d")}
    assert {(r.item_a, r.significant) for r in C.pair_statistics(counts, n).collect()} == {("a", False), ("c", True)}
