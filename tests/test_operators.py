import math
import random

import pytest
from pyspark.sql import functions as F

from wordmine.functions import measures
from wordmine.operators import compound, counts, graph, select, similar, tagger, tokens
from wordmine.plans import catalogue, pipelines
from wordmine.sources import html, io
from wordmine.sources.tables import pick


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def docs(spark):
    data = [(1, "경제가 경제가 성장했다. 경제 성장은 둔화다."), (2, "성장률은 경제성장 둔화다. 경제성장 경제성장"), (3, ""), (4, None)]
    return tokens.documents(spark.createDataFrame(data, "doc_id bigint, text string"))


@pytest.fixture(scope="module")
def lexicon(spark):
    data = [("경제", "NNG"), ("성장", "NNG"), ("성장", "NNG"), ("둔화", "nng"), ("은", "JX"), ("가", "JKS"), ("다", "EF"), ("빈", None), (None, "NNG")]
    return spark.createDataFrame(data, "surface string, tag string")


def test_tokens_keep_places_and_skip_short_ones(spark, docs):
    got = rows(tokens.tokenize(docs))
    assert (1, 0, "경제가") in got and all(len(t) >= 2 for _, _, t in got) and {d for d, _, _ in got} == {1, 2}
    numbers = spark.createDataFrame([(1, "12345 1년 a")], "doc_id bigint, clean string")
    assert rows(tokens.tokenize(numbers)) == [(1, 1, "1년")]


def test_prefix_rules(spark):
    vocab = spark.createDataFrame([("가나다.",), (".가나",), ("가.나",), ("(가나",), ("가",)], "token string")
    assert rows(tokens.prefixes(vocab, parens=True), "token", "prefix") == [("가.나", "가.나"), ("가나다.", "가나"), ("가나다.", "가나다")]


def test_right_trims(spark):
    vocab = spark.createDataFrame([("가나다라",), ("가나",), ("가나다-",)], "token string")
    assert rows(tokens.right_trims(vocab)) == [("가나다-", 0, "가나다"), ("가나다-", 1, "가나"), ("가나다라", 0, "가나다라"), ("가나다라", 1, "가나다"), ("가나다라", 2, "가나")]


def test_counts_equal_a_scan_of_the_text(spark):
    rng = random.Random(4)
    texts = [(i, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(20))) for i in range(10)]
    df = spark.createDataFrame(texts, "doc_id bigint, clean string")
    toks = tokens.tokenize(df, least=0)
    needles = ["ab", "aa", "aba", "bbb", "zz"]
    want = spark.createDataFrame([(n,) for n in needles], "needle string")
    assert dict(rows(counts.substring_frequency(tokens.vocabulary(toks), want))) == {n: sum(t.count(n) for _, t in texts) for n in needles}
    per_doc = {(d, n): t.count(n) for d, t in texts for n in needles if n in t}
    assert {(d, n): k for d, n, k in rows(counts.document_counts(toks, want))} == per_doc
    starts = dict(rows(counts.prefix_frequency(tokens.vocabulary(toks))))
    assert starts["ab"] == sum(w.startswith("ab") for _, t in texts for w in t.split())


def test_tfidf_variants(spark):
    row = spark.createDataFrame([(3, 2, 10), (0, 0, 10)], "c bigint, df bigint, n bigint")
    got = [tuple(r) for r in row.select(*[measures.tfidf(F.col("c"), F.col("df"), F.col("n"), v) for v in ("raw", "log", "zero")]).collect()]
    idf = math.log(10 / 0.001)
    assert got[0] == pytest.approx((3 * math.log(5), math.log(4) * math.log(5), math.log(4) * math.log(5)))
    assert got[1] == pytest.approx((0.001 * idf, 0.001 * idf, 0))


def test_cliff_and_elbow(spark):
    scored = [("w", 2, "w2", 100), ("w", 3, "w3", 90), ("w", 4, "w4", 50), ("w", 5, "w5", 49), ("e", 2, "e2", 11), ("e", 3, "e3", 10)]
    df = spark.createDataFrame(scored, "token string, len int, prefix string, score bigint")
    assert [r[2] for r in rows(select.cliff(df))] == ["e3", "w2", "w3", "w5"]
    assert [r[2] for r in rows(select.cliff(df, first=True))] == ["e3", "w2"]
    assert [r[2] for r in rows(select.elbow(df))] == ["e3", "w2", "w3", "w5"]
    assert rows(select.cliff(df.limit(0))) == []


def test_longest_common_left_modes(spark):
    forms = [("t", 0, "abcd", 1), ("t", 1, "abc", 1), ("t", 2, "ab", 9), ("u", 0, "xyzw", 5), ("u", 1, "xyz", 5), ("u", 2, "xy", 5), ("v", 0, "pqr", 1), ("v", 1, "pq", 1)]
    df = spark.createDataFrame(forms, "token string, ord int, form string, freq bigint")
    assert rows(select.longest_common_left(df)) == [("t", "ab"), ("u", "xyzw"), ("v", "pq")]
    assert rows(select.longest_common_left(df, 1)) == [("u", "xyzw")]
    assert rows(select.longest_common_left(df, 2)) == [("u", "")]
    assert rows(select.longest_common_left(df, 3)) == [("u", "xyzw")]


def test_sentences_follow_the_patterns(spark):
    import re

    texts = ["했다.. 있다는 말이다. 남은", "", "다다. 다.", "한 줄\n갔다. 왔다.\n끝", "no end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, clean string")
    for closed, pattern in ((True, r".*?다\.+"), (False, r".*?다\.*")):
        want = {i: re.findall(pattern, t) + [re.sub(r".*?다\.", "", t)] for i, t in enumerate(texts)}
        got = {i: [] for i in want}
        for d, _, s in sorted(rows(tokens.sentences(df, closed=closed))):
            got[d].append(s)
        assert got == want


def test_textrank_keeps_its_mass_and_isolated_nouns(spark):
    occ = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "a"), (1, 1, 0, "c"), (1, 2, 0, "b"), (1, 2, 1, "d")], "doc_id bigint, sent_id int, pos int, noun string")
    edges = graph.cooccurrence(occ)
    weights = {(s, d): w for _, s, d, w in rows(edges)}
    assert weights == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 2, ("b", "b"): 1, ("b", "d"): 1, ("d", "b"): 1}
    value = dict.fromkeys("abcd", 0.25)
    for _ in range(16):
        new = dict.fromkeys("abcd", 0.0)
        for s in "abcd":
            total = sum(w for (x, _), w in weights.items() if x == s)
            if not total:
                new[s] = value[s]
            for (x, d), w in weights.items():
                if x == s:
                    new[d] += value[s] * w / total
        value = new
    got = {n: t for _, n, t in rows(graph.textrank(edges, occ.select("doc_id", "noun")))}
    assert got == pytest.approx({n: 0.15 + 0.85 * v for n, v in value.items()})
    assert sum((t - 0.15) / 0.85 for t in got.values()) == pytest.approx(1)


def test_chain_merge(spark):
    pairs = [(1, 0, "a", "b"), (1, 1, "b", "c"), (1, 2, "x", "y"), (1, 3, "p", "q"), (1, 4, "q", "r"), (2, 0, "k", "l")]
    df = spark.createDataFrame(pairs, "doc_id bigint, ord int, a string, b string")
    assert rows(compound.chain_merge(df), "doc_id", "words") == [(1, ["a", "b", "c"]), (1, ["p", "q", "r"]), (1, ["x", "y"]), (2, ["k", "l"])]
    assert rows(compound.chain_merge(df, False), "doc_id", "words") == [(1, ["a", "b", "c"]), (1, ["x", "y"]), (2, ["k", "l"])]


def test_adjacent_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("가나 ") for _ in range(40))) for i in range(6)]
    nouns = ["가", "나가", "가가", "나"]
    df = spark.createDataFrame(texts, "doc_id bigint, clean string")
    listed = spark.createDataFrame([(i, n) for i, _ in texts for n in nouns], "doc_id bigint, noun string")
    want = {(i, a, b, t.replace(" ", "").count(a + b)) for i, t in texts for a in nouns for b in nouns if t.replace(" ", "").count(a + b) >= 2}
    assert set(rows(compound.adjacent_pairs(df, listed), "doc_id", "a", "b", "n")) == want


def test_merge_duplicates(spark):
    df = spark.createDataFrame([(1, "ab", 2.0), (1, "ab", 8.0), (1, "c", 3.0), (1, "d", -1.0), (1, "d", 2.0)], "doc_id bigint, l string, score double")
    assert rows(compound.merge_duplicates(df, F.col("l"))) == [(1, "ab", pytest.approx(4.0)), (1, "c", 3.0), (1, "d", None)]


def test_greedy_occurrences_follow_the_order(spark):
    sents = spark.createDataFrame([(1, 0, "가나다가나")], "doc_id bigint, sent_id int, sentence string")
    nouns = spark.createDataFrame([(1, 0, "나다"), (1, 1, "가"), (1, 2, "가나")], "doc_id bigint, ord int, noun string")
    assert rows(compound.greedy_occurrences(sents, nouns), "noun", "at") == [("가", 0), ("가", 0), ("나다", 1)]


def test_contexts(spark):
    df = spark.createDataFrame([("x" * 12 + "ab.ab" + "y" * 12, "ab"), ("none", "ab"), ("a.c abc", "a.c")], "t string, w string")
    got = [tuple(r) for r in df.select(measures.first_context(F.col("t"), F.col("w")), measures.all_contexts(F.col("t"), F.col("w"))).collect()]
    first = "x" * 10 + "<ab>.ab" + "y" * 7
    assert got[0] == (f"...{first}...", f"...{first}...{'x' * 7}ab.<ab>{'y' * 10}...")
    assert got[1] == (None, None) and got[2][1] == "...<a.c> abc..."


def test_pmi_and_percent(spark):
    row = spark.createDataFrame([(4, 2, 5, 10)], "j bigint, a bigint, b bigint, n bigint")
    c = [F.col(x) for x in "jabn"]
    got = row.select(measures.pmi(c[0], [c[1], c[2]], c[3]), measures.pmi(F.lit(0), [c[1]], c[3]), measures.pmi(c[0], [c[1]], F.lit(0))).first()
    assert got[0] == pytest.approx(math.log(0.4 / (0.2 * 0.5))) and got[1] == 0 and got[2] is None
    pct = spark.createDataFrame([("ab", "", "abc", 9.0), ("a", "abc", "abc", 9.0), ("ab", "", "abc", 1.0)], "s string, r string, m string, f double")
    assert [r[0] for r in pct.select(measures.match_percent(*[F.col(x) for x in "srmf"])).collect()] == [66, -1, -1]


def test_nearest_is_exact(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = rows(similar.nearest(df, df.where("vec_id % 20 = 0"), k=3, block=2), "query_id", "rank", "vec_id")
    assert [g for g in got if g[1] == 1] == [(0, 1, 0), (20, 1, 20), (40, 1, 40)] and len(got) == 9


def test_tagger_and_filters(spark, lexicon):
    tag = tagger.lexicon_tagger(lexicon)
    assert tag("경제성장은") == [("경제", "NNG"), ("성장", "NNG"), ("은", "JX")] and tag("xyz경제") == [("xyz", "UNKNOWN"), ("경제", "NNG")] and tag("") == []
    words = spark.createDataFrame([("경제",), ("경제가",), ("없는말",)], "word string")
    assert rows(tagger.without_registered(words, lexicon)) == [("경제가",), ("없는말",)]
    assert rows(words.select("word", tagger.strip_suffixes(lambda: tag)(F.col("word")).alias("s"))) == [("경제", "경제"), ("경제가", "경제"), ("없는말", "없는말")]
    assert rows(tagger.registered_left(words.withColumnRenamed("word", "match"), lexicon)) == [("경제", "경제"), ("경제가", "경제"), ("없는말", "")]


def test_pipelines_run_on_empty_and_small_input(spark, docs, lexicon):
    assert rows(pipelines.discover_nouns(docs.limit(0))) == []
    assert {r[1] for r in rows(pipelines.discover_nouns(docs), "doc_id", "noun")} >= {"경제"}
    assert rows(pipelines.search_report(docs, lexicon, context="all", least=-1), "doc_id")
    assert rows(pipelines.elbow_nouns(docs.limit(0))) == []
    assert {r[0] for r in rows(pipelines.new_words(docs, lexicon), "word")} >= {"경제성장"}
    assert all(len(r) == 3 for r in rows(pipelines.compounds(docs, lexicon, -99)))


def test_sources(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(',NEWS,RANDOM\n0,"첫 ""줄""\n둘째 줄",1\n1,짧다,2\n', encoding="utf8")
    assert rows(io.load_docs(spark, str(path))) == [(0, '첫 "줄"\n둘째 줄'), (1, "짧다")]
    (tmp_path / "b.txt").write_text("한 편의\n글", encoding="utf8")
    assert rows(io.load_docs(spark, str(tmp_path / "b.txt"))) == [(0, "한 편의\n글")]
    assert rows(io.load_docs(spark, "글" * 60)) == [(0, "글" * 60)]
    words = spark.createDataFrame([(1, "나"), (1, "가")], "doc_id bigint, word string")
    io.write_words(words.coalesce(1), str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["가", "나"]
    io.write_report(words, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    assert rows(io.with_word_lists(spark.createDataFrame([(1,), (2,)], "doc_id bigint"), words)) == [(1, ["가", "나"]), (2, [])]


def test_html_node(spark):
    page = "<html><div class='x'>no</div><div class='art_txt big'>가<br><div>나</div>&amp;다</div><div>후</div></html>"
    assert html.node_text(page, "div", "class", "art_txt") == "가나&다"
    assert html.node_text(None, "div", "class", "art_txt") is None
    got = html.select_node(spark.createDataFrame([(page,), (None,)], "html string"))
    assert {r.text for r in got.collect()} == {"가나&다", None}


def test_pick_survives_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], ["id", "Text", "text"])
    assert pick(df, "id", "text").collect()[0] == (1, "b") and pick(df, "id", "Text").collect()[0][1] == "a"


def test_stream_equals_batch(spark, tmp_path):
    from wordmine.streaming import stateless

    data = spark.createDataFrame([(1, "경제가 성장했다."), (2, None)], "doc_id bigint, text string")
    data.write.parquet(str(tmp_path / "in"))
    query = stateless.token_stream(stateless.read_documents(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("toks").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert rows(spark.table("toks")) == rows(tokens.tokenize(tokens.documents(data)))


def test_nothing_is_cut_from_very_long_text(spark):
    long = "x" * (1 << 20)
    sents = spark.createDataFrame([(1, 0, f"가{long}가")], "doc_id bigint, sent_id int, sentence string")
    nouns = spark.createDataFrame([(1, 0, "가")], "doc_id bigint, ord int, noun string")
    assert rows(compound.greedy_occurrences(sents, nouns), "at") == [(0,), (1 << 20,)]
    one = lambda t: spark.createDataFrame([(1, 0, t)], "doc_id bigint, pos int, token string")
    assert rows(tokens.paren_parts(one(f"({long}y")), "token") == [(f"{long}y",)] and rows(tokens.paren_parts(one(f"({long}y)")), "token") == [(f"{long}y",)]
    token = f"({long}(b)"
    raw = spark.createDataFrame([(1, f"{token} {token}")], "doc_id bigint, raw string")
    assert (f"{long}(b)",) in rows(tokens.paren_suffixes(one(token), raw).where("step = 1"), "token")


def test_all_spacings_keep_short_and_long_words(spark, tmp_path):
    words = ["가", "가나", "가나다라마바사", "가나다라마바사아자차카타파", None]
    spark.createDataFrame([(w, "NNG") for w in words], "surface string, tag string").write.parquet(f"{tmp_path}/lexicon.parquet")
    got = {r["word"]: r["n"] for r in catalogue.spacings(spark, str(tmp_path)).groupBy("word").agg(F.countDistinct("way").alias("n")).collect()}
    assert got == {"가": 1, "가나": 2, "가나다라마바사": 64, "가나다라마바사아자차카타파": 1}


def test_words_are_literal_in_patterns(spark):
    df = spark.createDataFrame([(r"a \\E b \\E c", r"\\E"), ("x.y x.y", "x.y")], "t string, w string")
    got = [r[0] for r in df.select(measures.all_contexts(F.col("t"), F.col("w"))).collect()]
    assert got[0].count("<") == 2 and got[1].count("<x.y>") == 2


def test_occurrences_of_any_length(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 5, 9, 20, 40]))) for _ in range(40)] + ["", None]
    needles = sorted({t[i : i + k] for t in vocab if t for k in (1, 2, 7, 8, 9, 15, 16, 17, 33) for i in (0, 3) if len(t[i : i + k]) == k})
    got = rows(counts.occurrences(spark.createDataFrame([(v,) for v in vocab], "token string"), spark.createDataFrame([(n,) for n in needles], "needle string"), 1))
    assert got == sorted((t, n, t.count(n)) for t in {v for v in vocab if v} for n in needles if n in t)
    long = spark.createDataFrame([("xy" * 10000,)], "token string")
    assert rows(counts.occurrences(long, spark.createDataFrame([("yx",), ("xy" * 30,)], "needle string"))) == [("xy" * 10000, "xy" * 30, 333), ("xy" * 10000, "yx", 9999)]


def test_pairs_count_by_either_text(spark):
    docs = spark.createDataFrame([(1, "가(x)나 가(y)나 가나", "가나 가나 가나")], "doc_id bigint, clean string, bare string")
    pairs = spark.createDataFrame([(1, "가", "나")], "doc_id bigint, a string, b string")
    assert rows(compound.with_counts(pairs, docs)) == [] and rows(compound.with_counts(pairs, docs, also="bare")) == [(1, "가", "나", 1)]


def test_noun_orders(spark):
    nouns = spark.createDataFrame([(1, 0, "가"), (1, 1, "가나다"), (1, 2, "라"), (1, 3, "나다"), (2, 0, "가")], "doc_id bigint, ord int, noun string")
    assert [r[2] for r in rows(compound.with_order(nouns)) if r[0] == 1] == ["가나다", "라", "가", "나다"]
    assert [r[2] for r in rows(compound.longest_first(nouns)) if r[0] == 1] == ["가나다", "나다", "가", "라"]


def test_surroundings_and_fallback(spark):
    row = spark.createDataFrame([("0123456789ab가cd가e",)], "t string")
    assert row.select(measures.surroundings("t", F.lit("가"))).first()[0] == "23456789ab" + "cd가e" + "456789abcd" + "e"
    got = row.select(measures.pmi_any_spacing(F.lit("a b a b"), [F.lit("a"), F.lit("b")], F.lit(0), [F.lit(2), F.lit(2)], F.lit(4))).first()[0]
    assert got == pytest.approx(math.log((2 / 4) / (2 / 4 * 2 / 4)))


def test_discover_uses_the_corpus_and_takes_nouns_in_order(spark, lexicon):
    docs = tokens.documents(spark.createDataFrame([(1, "우주선이 우주선을 우주선은 떴다. 우주선 발사대가 발사대는 섰다.")], "doc_id bigint, text string"), "discovery")
    corpus = tokens.documents(spark.createDataFrame([(k, "우주선의 발사대의 우주선도 발사대도") for k in range(5)], "doc_id bigint, text string"), "discovery")
    alone, wide = ({r.noun for r in pipelines.discover_nouns(docs, corpus=c).collect()} for c in (None, corpus))
    assert {"우주선", "발사대"} <= wide and "우주선" in alone
    words = {(r.word, r.method) for r in pipelines.discover(docs, lexicon, -99, corpus=corpus).collect()}
    assert ("우주선", "noun") in words and all(m in ("noun", "pairs", "chains") for _, m in words)


def test_report_keeps_documents_together(spark, tmp_path):
    report = spark.createDataFrame([(d, f"m{k}", k, float(k)) for d in range(40) for k in (1, 3, 2)], "doc_id bigint, match string, pct int, tfidf double")
    io.write_report(report, str(tmp_path / "r"), buckets=4)
    assert len(list((tmp_path / "r").glob("bucket=*"))) == 4
    files = spark.read.option("header", True).csv(str(tmp_path / "r")).withColumn("f", F.input_file_name())
    assert files.groupBy("doc_id").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0 and files.count() == 120
    assert [r.match for r in pipelines.report_order(report).where("doc_id = 7").collect()] == ["m3", "m2", "m1"]


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from wordmine.plans.lineage import shared_dir

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_nouns_are_the_longest_from_the_left(spark, lexicon):
    import re

    more = lexicon.unionByName(spark.createDataFrame([("성장률", "NNG"), ("장경", "NNP")], "surface string, tag string"))
    texts = [(1, "경제성장은 경제가 성장했다. 성성장장경제 성장률"), (2, "없다"), (3, None), (4, "장경제성장률경제")]
    docs = tokens.documents(spark.createDataFrame(texts, "doc_id bigint, text string"))
    want = [(r.doc_id, r.sent_id, k, m[0], m.start()) for r in tokens.sentences(docs).collect() for k, m in enumerate(re.finditer("성장률|경제|성장|둔화|장경", r.sentence))]
    assert rows(pipelines.noun_occurrences(docs, more)) == sorted(want) and len(want) > 8
    assert rows(pipelines.noun_occurrences(docs, lexicon.limit(0))) == []


def test_lists_are_bounded(spark):
    from wordmine.plans import lineage

    df = spark.createDataFrame([(k,) for k in range(5)], "k int")
    assert len(lineage.listed(df, "it", 5)) == 5
    with pytest.raises(ValueError):
        lineage.listed(df, "it", 4)


def test_pages_are_fetched_by_the_tasks(spark, tmp_path):
    (tmp_path / "a.html").write_text("<div class='art_txt'>본문</div>", encoding="utf8")
    good, bad = f"file://{tmp_path}/a.html", f"file://{tmp_path}/none.html"
    got = {r.url: r.text for r in html.select_node(html.fetch_pages(spark, [good, bad])).collect()}
    assert got == {good: "본문", bad: None}


def test_taking_one_out_may_make_another(spark):
    assert compound.take_all("aaabbb", ["ab"]) == [(2, "ab"), (1, "ab"), (0, "ab")] and compound.take_all("abc", ["", "bc", "ab"]) == [(1, "bc")]
    rng = random.Random(7)
    for _ in range(300):
        text, nouns = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14))), ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(3)]
        want, rest = [], text
        for n in nouns:
            while n in rest:
                want.append((rest.index(n), n))
                rest = rest.replace(n, "", 1)
        assert compound.take_all(text, nouns) == want


def test_longest_matches_equal_a_pattern():
    import re

    import ahocorasick

    rng = random.Random(1)
    for _ in range(3000):
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 6))}
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 16)))
        pattern = "|".join(sorted(words, key=lambda w: (-len(w), w)))
        assert pipelines.longest_from_left(automaton, text) == [(m.start(), m[0]) for m in re.finditer(pattern, text)]


def test_ranks_from_sentences_equal_ranks_over_edges(spark):
    rng = random.Random(8)
    occ = [(d, s, k, rng.choice("abcdefg"[: d + 1])) for d in range(7) for s in range(5) for k in range(rng.randint(0, 6))]
    df = spark.createDataFrame(occ, "doc_id bigint, sent_id int, pos int, noun string")
    nouns = df.select("doc_id", "noun").unionByName(spark.createDataFrame([(0, "only"), (50, "x"), (50, "y")], "doc_id bigint, noun string"))
    want = {(d, n): v for d, n, v in rows(graph.textrank(graph.cooccurrence(df), nouns))}
    got = {(d, n): v for d, n, v in rows(graph.sentence_rank(df, nouns, batch_docs=2))}
    assert got == pytest.approx(want) and (50, "x") in got
    assert rows(graph.sentence_rank(df.limit(0), nouns.limit(0))) == []
