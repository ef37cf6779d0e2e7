"""The queries of the core over whole tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmine.functions import clean, measures
from wordmine.operators import compound, counts, graph, select, similar, tagger, tokens
from wordmine.plans import pipelines
from wordmine.plans.lineage import materialize, scratch
from wordmine.sources import html, io
from wordmine.sources.tables import spread, table


def _nine(column: str) -> Column:
    """Nine places, after twelve, so that what differs by the last bit of a sum is rounded alike."""
    return F.round(F.round(column, 12), 9)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents", "doc_id", "text"))


def _docs(spark: SparkSession, folder: str, profile: str = "search") -> DataFrame:
    return tokens.documents(_documents(spark, folder), profile)


def _lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lexicon", "surface", "tag")


def _needles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nounrank", "noun").where("noun IS NOT NULL").select(F.upper("noun").alias("needle")).distinct()


def _vocab(spark: SparkSession, folder: str, least: int = 2) -> DataFrame:
    return tokens.vocabulary(tokens.tokenize(_docs(spark, folder), least=least))


def _n_docs(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "text", "_c0", "NEWS"))


def _occ(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(pipelines.noun_occurrences(_docs(spark, folder), _lexicon(spark, folder)), "occurrences")


def _cleaned(profile: str):
    return lambda spark, folder: _docs(spark, folder, profile)


def clean_article(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder)
    return rows.select("_c0", clean.clean(F.coalesce(F.col("NEWS"), F.lit("")), "article").alias("clean"))


def strip_parens(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder).where("NEWS IS NOT NULL")
    return rows.select("_c0", clean.strip_parens(F.col("NEWS")).alias("bare"), clean.unbalanced(F.col("NEWS")).alias("unbalanced"))


def wide_longest_cell(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["row_no", "URL_CD", "NEWS_BODY", "press_cd"]
    return table(spark, folder, "longtext", *columns).select("row_no", io.longest_cell(None, columns).alias("cell"))


def eojeol_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.tokenize(_docs(spark, folder))


def token_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return _vocab(spark, folder)


def prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.prefixes(_vocab(spark, folder, 3), parens=True)


def substrings(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.substrings(_vocab(spark, folder))


def right_trims(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.right_trims(_vocab(spark, folder))


def three_way_splits(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.splits(_vocab(spark, folder, 3)).select("token", "lp", "um", "rp")


def spacings(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.spacings(_lexicon(spark, folder).select(F.col("surface").alias("word")).distinct())


def paren_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder).select(F.col("_c0").alias("doc_id"), clean.clean(F.coalesce(F.col("NEWS"), F.lit("")), "discovery").alias("clean"))
    return tokens.paren_suffixes(tokens.tokenize(rows, least=3), rows.withColumnRenamed("clean", "raw"))


def paren_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder).select(F.col("_c0").alias("doc_id"), clean.clean(F.coalesce(F.col("NEWS"), F.lit("")), "discovery").alias("clean"))
    return tokens.vocabulary(tokens.paren_parts(tokens.tokenize(rows, least=3)))


def prefix_freq(spark: SparkSession, folder: str) -> DataFrame:
    return counts.prefix_frequency(_vocab(spark, folder))


def substring_count(spark: SparkSession, folder: str) -> DataFrame:
    return counts.substring_frequency(materialize(_vocab(spark, folder, 0), "vocabulary"), _needles(spark, folder))


def word_start_rate(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    toks = tokens.tokenize(docs, least=0).where("pos > 0")
    freq = counts.prefix_frequency(tokens.vocabulary(toks)).join(_needles(spark, folder).withColumnRenamed("needle", "prefix"), "prefix")
    spaces = docs.agg(F.sum(measures.count_in(F.col("clean"), F.lit(" "))).alias("spaces"))
    return freq.crossJoin(F.broadcast(spaces)).select("prefix", F.round(F.round(F.try_divide("freq", "spaces"), 15), 9).alias("rate"))


def word_total(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return docs.select("doc_id", counts.word_total(F.col("clean")).cast("bigint").alias("words"), measures.count_in(F.col("clean"), F.lit(" ")).cast("bigint").alias("spaces"))


def _cliff(first: bool):
    return lambda spark, folder: pipelines.cliff_scores(_docs(spark, folder), first)


def discovered_nouns(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.discover_nouns(_docs(spark, folder)).select("doc_id", "noun")


def elbow_nouns(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.elbow_nouns(_docs(spark, folder, "elbow")).select("doc_id", "noun", _nine("tfidf").alias("tfidf"))


def _left(mode: int):
    return lambda spark, folder: pipelines.left_matches(_docs(spark, folder), mode).where("match IS NOT NULL")


def _needle_counts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, folder)
    return counts.document_counts(tokens.tokenize(docs, least=0), _needles(spark, folder)), docs


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return counts.document_frequency(_needle_counts(spark, folder)[0])


def _tfidf(tf: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        n, docs = _needle_counts(spark, folder)
        return counts.tfidf_table(n, _n_docs(docs), tf).select("doc_id", "needle", _nine("tfidf").alias("tfidf"))

    return query


def _kwic(context):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        n, docs = _needle_counts(spark, folder)
        text = docs.select("doc_id", F.col("clean").alias("_text"))
        return compound.beside(n.select("doc_id", "needle"), text, context=lambda r: context(F.col("_text"), r["needle"]))

    return query


def _sentences(closed: bool):
    return lambda spark, folder: tokens.sentences(_docs(spark, folder), closed=closed)


def plain_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.plain_sentences(_docs(spark, folder)).where("sentence <> ''")


def sentence_nouns(spark: SparkSession, folder: str) -> DataFrame:
    return graph.sentence_counts(pipelines.noun_occurrences(_docs(spark, folder), _lexicon(spark, folder)))


def cooc_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cooccurrence(_occ(spark, folder))


def out_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.out_degree(graph.cooccurrence(_occ(spark, folder)))


def order_window_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.order_window_edges(_occ(spark, folder))


def char_window_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.char_window_edges(_occ(spark, folder))


def _ranks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    occ = _occ(spark, folder)
    return occ, graph.sentence_rank(occ, occ.select("doc_id", "noun"))


def textrank(spark: SparkSession, folder: str) -> DataFrame:
    return _ranks(spark, folder)[1].select("doc_id", "noun", _nine("tr").alias("tr"))


def textrank_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the edges of the graph, as any other graph is ranked."""
    occ = _occ(spark, folder)
    return graph.textrank(graph.cooccurrence(occ), occ.select("doc_id", "noun")).select("doc_id", "noun", _nine("tr").alias("tr"))


def bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return compound.bigrams(_occ(spark, folder))


def trigrams(spark: SparkSession, folder: str) -> DataFrame:
    return compound.noun_grams(_occ(spark, folder), 3).groupBy("doc_id", F.array_join("words", " ").alias("words")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, occ = _docs(spark, folder), _occ(spark, folder)
    return docs, occ, compound.with_counts(compound.first_seen(compound.bigrams(occ)), docs)


def compound_count(spark: SparkSession, folder: str) -> DataFrame:
    docs, _, pairs = _pairs(spark, folder)
    text = docs.select("doc_id", F.col("clean").alias("_text"))
    return compound.beside(pairs, text, n_spaced=lambda r: measures.count_any_spacing(F.col("_text"), [r["a"], r["b"]])).select("doc_id", "ord", "a", "b", "n", "n_spaced")


def compound_count_bare(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that occur twice in the text or twice without its brackets."""
    docs = _docs(spark, folder, "discovery").withColumn("bare", clean.strip_parens(F.col("clean")))
    occ = materialize(pipelines.noun_occurrences(docs, _lexicon(spark, folder)), "occurrences")
    return compound.with_counts(compound.first_seen(compound.bigrams(occ)), docs, also="bare")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    docs, occ, pairs = _pairs(spark, folder)
    ranks = graph.sentence_rank(occ, occ.select("doc_id", "noun"))
    return compound.score_pairs(pairs, docs, ranks, counts.word_total(F.col("clean")))


def trpmi(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc_id", "a", "b", "n", _nine("pmi").alias("pmi"), _nine("trpmi").alias("trpmi"))


def dup_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).select("doc_id", "a", "b", F.col("trpmi").alias("score"))
    return compound.merge_duplicates(rows, F.concat("a", "b")).select("doc_id", "label", _nine("score").alias("score"))


def all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return compound.adjacent_pairs(_docs(spark, folder), _occ(spark, folder))


def _chain(keep_tail: bool):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        pairs = _pairs(spark, folder)[2]
        return compound.chain_merge(pairs, keep_tail).select("doc_id", "ord", F.array_join("words", " ").alias("words"))

    return query


def suffix_prefix_map(spark: SparkSession, folder: str) -> DataFrame:
    return compound.suffix_prefix_links(_pairs(spark, folder)[2].select("doc_id", "ord", F.array("a", "b").alias("words")))


def included_nouns(spark: SparkSession, folder: str) -> DataFrame:
    return compound.included_last(_occ(spark, folder))


def _nouns_in_order(spark: SparkSession, folder: str) -> DataFrame:
    first = _occ(spark, folder).groupBy("doc_id", "noun").agg(F.min(F.struct("sent_id", "pos")).alias("at"))
    return first.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("ord"), "noun")


def noun_order(spark: SparkSession, folder: str) -> DataFrame:
    return compound.with_order(_nouns_in_order(spark, folder))


def noun_order_length(spark: SparkSession, folder: str) -> DataFrame:
    return compound.longest_first(_nouns_in_order(spark, folder))


def greedy_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return compound.greedy_occurrences(tokens.sentences(_docs(spark, folder)), noun_order(spark, folder))


def mutual_inclusion(spark: SparkSession, folder: str) -> DataFrame:
    nouns = materialize(pipelines.discover_nouns(_docs(spark, folder)).withColumnRenamed("noun", "word"), "nouns")
    freq = counts.substring_frequency(materialize(_vocab(spark, folder, 0), "vocabulary"), nouns.select(F.col("word").alias("needle"))).withColumnRenamed("needle", "word")
    return compound.mutual_inclusion(nouns, freq).select("doc_id", "word", "freq")


def window_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    toks = materialize(tokens.tokenize(_docs(spark, folder), least=0), "tokens")
    near = similar.window_neighbours(toks, _needles(spark, folder).withColumnRenamed("needle", "noun"))
    return near.groupBy("noun", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def similarity_rank(spark: SparkSession, folder: str) -> DataFrame:
    found = pipelines.similar_nouns(_docs(spark, folder), _needles(spark, folder).withColumnRenamed("needle", "noun"))
    return found.select("noun", "other", F.round("cosine", 9).alias("cosine"), "rank")


def embedding_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return similar.nearest(rows, rows.where("vec_id % 50 = 0")).select("query_id", "vec_id", F.round("cosine", 9).alias("cosine"), "rank")


def registered_left(spark: SparkSession, folder: str) -> DataFrame:
    return tagger.registered_left(_vocab(spark, folder).select(F.col("token").alias("match")), _lexicon(spark, folder))


def registered_filter(spark: SparkSession, folder: str) -> DataFrame:
    return tagger.without_registered(_vocab(spark, folder).select(F.col("token").alias("word")), _lexicon(spark, folder))


def _morphs(spark: SparkSession, folder: str) -> DataFrame:
    tag = tagger.lexicon_tagger(_lexicon(spark, folder))
    return _vocab(spark, folder).withColumn("morphs", tagger.tagged(lambda: tag)(F.col("token")))


def morphemes(spark: SparkSession, folder: str) -> DataFrame:
    return _morphs(spark, folder).select("token", F.array_join(F.transform("morphs", lambda m: F.concat(m["surface"], F.lit("/"), m["tag"])), " ").alias("morphs"))


def particle_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = _morphs(spark, folder).where(tagger.not_ending(F.col("morphs")) & ~tagger.is_excluded(F.col("morphs")))
    return kept.select("token", tagger.is_known(F.col("morphs")).alias("known"))


def morph_filters(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("morphs")
    marks = {"registered": tagger.is_registered_noun(m), "after_noun": tagger.is_after_noun(m), "single_known": tagger.is_single_known(m)}
    return tagger.kept_and_banned(_morphs(spark, folder)).select("token", "banned", *[c.alias(n) for n, c in marks.items()])


def morph_joins(spark: SparkSession, folder: str) -> DataFrame:
    return _morphs(spark, folder).select("token", F.posexplode(tagger.joined_parts(F.col("morphs"))).alias("place", "part"))


def stripped_words(spark: SparkSession, folder: str) -> DataFrame:
    lexicon = _lexicon(spark, folder)
    tag = tagger.lexicon_tagger(lexicon)
    return _vocab(spark, folder).select("token", tagger.strip_suffixes(lambda: tag)(F.col("token")).alias("stripped"))


def unit_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _vocab(spark, folder).where(~F.col("token").rlike(clean.UNITS))


def noun_surroundings(spark: SparkSession, folder: str) -> DataFrame:
    n, docs = _needle_counts(spark, folder)
    text = docs.select("doc_id", F.col("clean").alias("_text"))
    return n.join(text, "doc_id").select("doc_id", "needle", measures.surroundings("_text", "needle").alias("around"))


def frequent_starts(spark: SparkSession, folder: str) -> DataFrame:
    found = pipelines.frequent_starts(_docs(spark, folder))
    return found.select("token", "prefix", F.round(F.round("rate", 15), 9).alias("rate"))


def top_nouns(spark: SparkSession, folder: str) -> DataFrame:
    ranks = _ranks(spark, folder)[1].select("doc_id", "noun", F.round("tr", 9).alias("tr"))
    return graph.top_nouns(ranks).select("doc_id", "noun", _nine("tr").alias("tr"), "rank")


def first_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The first 30 documents, a limit that is the operator itself."""
    return pipelines.first_documents(_docs(spark, folder), 30)


def corpus_cliffs(spark: SparkSession, folder: str) -> DataFrame:
    """Cliffs of the tokens of ``text`` by frequencies in ``documents``, a collection apart."""
    own = tokens.documents(_texts(spark, folder).select(F.col("_c0").alias("doc_id"), F.col("NEWS").alias("text")))
    return pipelines.cliff_scores(own, corpus=_docs(spark, folder))


def pmi_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Mutual information of neighbouring nouns in the text with its spaces; where the plain count is 0, of all spacings."""
    docs, occ = _docs(spark, folder), _occ(spark, folder)
    pairs = compound.with_counts(compound.first_seen(compound.bigrams(occ)), docs, least=0, spaceless=False)
    one = occ.select("doc_id", "noun").distinct().withColumn("tr", F.lit(1.0))
    found = compound.score_pairs(pairs, docs, one, counts.word_total(F.col("clean")), spaceless=False, fall_back=True)
    return found.select("doc_id", "a", "b", "n", _nine("pmi").alias("pmi"))


def csv_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The articles written as a CSV file with cells over several lines and read again."""
    path = f"{scratch(spark, 'articles')}/articles.csv"
    rows = table(spark, folder, "text", "_c0", "NEWS", "RANDOM").select("_c0", F.regexp_replace(F.coalesce("NEWS", F.lit("")), "\r\n?", "\n").alias("NEWS_BODY"))
    io.write_articles(rows, path)
    return io.load_docs(spark, path, key="_c0").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def html_article(spark: SparkSession, folder: str) -> DataFrame:
    """The articles as the chosen node of a page, cleaned."""
    body = F.coalesce(F.col("NEWS"), F.lit(""))
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(sign), F.lit(code))
    page = F.concat(F.lit("<html><div class='head'>no</div><div class='art_txt main'>"), body, F.lit("</div><div>no</div></html>"))
    pages = _texts(spark, folder).select("_c0", page.alias("html"))
    return html.select_node(pages).select("_c0", clean.clean(F.col("text"), "article").alias("clean"))


def word_file(spark: SparkSession, folder: str) -> DataFrame:
    """Elbow nouns of all documents, written one to a line and read again."""
    path = scratch(spark, "words")
    io.write_words(pipelines.elbow_nouns(_docs(spark, folder, "elbow")).select(F.col("noun").alias("word")).distinct(), path)
    return spark.read.text(path).select(F.col("value").alias("word"))


def report_file(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the search report for each document, from its CSV files."""
    path = scratch(spark, "report")
    io.write_report(search_report(spark, folder).select("doc_id", "match", "pct", "tfidf"), path)
    read = spark.read.option("header", True).schema("doc_id bigint, match string, pct int, tfidf double, bucket int").csv(path)
    return read.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def compounds(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.compounds(_docs(spark, folder, "strict"), _lexicon(spark, folder)).select("doc_id", "label", _nine("score").alias("score"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.discover(_docs(spark, folder, "discovery"), _lexicon(spark, folder))


def new_words(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.new_words(_docs(spark, folder, "bracketed"), _lexicon(spark, folder))


def _report(tf: str, context: str, least: int):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = pipelines.search_report(_docs(spark, folder), _lexicon(spark, folder), tf=tf, context=context, least=least)
        return pipelines.report_order(found.withColumn("tfidf", _nine("tfidf")))

    return query


def word_lists(spark: SparkSession, folder: str) -> DataFrame:
    words = pipelines.elbow_nouns(_docs(spark, folder, "elbow")).withColumnRenamed("noun", "word")
    lists = io.with_word_lists(_documents(spark, folder).select("doc_id"), words)
    return lists.select("doc_id", F.array_join("EN_LIST", " ").alias("words"))


def search_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report("raw", "all", 1)(spark, folder)


QUERIES = {
    "clean_search": _cleaned("search"),
    "clean_elbow": _cleaned("elbow"),
    "clean_discovery": _cleaned("discovery"),
    "clean_strict": _cleaned("strict"),
    "clean_bracketed": _cleaned("bracketed"),
    "clean_raw": _cleaned("raw"),
    "clean_article": clean_article,
    "strip_parens": strip_parens,
    "wide_longest_cell": wide_longest_cell,
    "eojeol_tokens": eojeol_tokens,
    "token_vocab": token_vocab,
    "prefixes": prefixes,
    "right_trims": right_trims,
    "substrings": substrings,
    "three_way_splits": three_way_splits,
    "spacings": spacings,
    "paren_suffixes": paren_suffixes,
    "paren_parts": paren_parts,
    "prefix_freq": prefix_freq,
    "substring_count": substring_count,
    "word_start_rate": word_start_rate,
    "word_total": word_total,
    "cliff_nouns_multi": _cliff(False),
    "cliff_nouns_first": _cliff(True),
    "discovered_nouns": discovered_nouns,
    "elbow_nouns": elbow_nouns,
    "longest_common_left": _left(0),
    "longest_common_left_strict": _left(1),
    "longest_common_left_rest": _left(2),
    "longest_common_left_chain": _left(3),
    "doc_freq": doc_freq,
    "tfidf_raw": _tfidf("raw"),
    "tfidf_log": _tfidf("log"),
    "tfidf_log_zero": _tfidf("zero"),
    "kwic_first": _kwic(measures.first_context),
    "kwic_all": _kwic(measures.all_contexts),
    "sentences_closed": _sentences(True),
    "sentences_open": _sentences(False),
    "plain_sentences": plain_sentences,
    "sentence_nouns": sentence_nouns,
    "cooc_edges": cooc_edges,
    "out_degree": out_degree,
    "order_window_edges": order_window_edges,
    "char_window_edges": char_window_edges,
    "textrank": textrank,
    "textrank_edges": textrank_edges,
    "bigrams": bigrams,
    "trigrams": trigrams,
    "compound_count": compound_count,
    "trpmi": trpmi,
    "dup_merge": dup_merge,
    "all_pairs": all_pairs,
    "chain_merge": _chain(True),
    "chain_merge_open": _chain(False),
    "suffix_prefix_map": suffix_prefix_map,
    "included_nouns": included_nouns,
    "greedy_occurrences": greedy_occurrences,
    "mutual_inclusion": mutual_inclusion,
    "window_neighbours": window_neighbours,
    "similarity_rank": similarity_rank,
    "embedding_rank": embedding_rank,
    "registered_left": registered_left,
    "registered_filter": registered_filter,
    "particle_filter": particle_filter,
    "stripped_words": stripped_words,
    "unit_filter": unit_filter,
    "compounds": compounds,
    "discover": discover,
    "new_words": new_words,
    "search_report": search_report,
    "search_report_short": _report("log", "first", 0),
    "word_lists": word_lists,
    "morphemes": morphemes,
    "morph_filters": morph_filters,
    "morph_joins": morph_joins,
    "noun_surroundings": noun_surroundings,
    "frequent_starts": frequent_starts,
    "top_nouns": top_nouns,
    "first_documents": first_documents,
    "corpus_cliffs": corpus_cliffs,
    "pmi_fallback": pmi_fallback,
    "csv_articles": csv_articles,
    "html_article": html_article,
    "word_file": word_file,
    "report_file": report_file,
    "compound_count_bare": compound_count_bare,
    "noun_order": noun_order,
    "noun_order_length": noun_order_length,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from wordmine.plans.oracles import ORACLES

    return dict(ORACLES)
