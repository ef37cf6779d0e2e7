"""Whole analyses: compound words, noun discovery, new words, search reports, elbow nouns and similar nouns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmine.functions.measures import all_contexts, count_in, first_context, match_percent
from wordmine.operators import compound, counts, graph, perdoc, select, similar, tagger, tokens
from wordmine.plans.lineage import listed, materialize

#: Thresholds of the analyses.
SCORE, TFIDF, LEAST = 0.3, 3.5, 2
#: Documents, or characters, that are worked off together.
CHUNK_DOCS, CHUNK_CHARS = 2048, 8_000_000


FOUND = "array<struct<noun:string,at:int>>"


def lexicon_nouns(lexicon: DataFrame) -> list[str]:
    """The registered nouns of two characters and more in capitals, a list of bounded size."""
    nouns = tagger.lexicon_rows(lexicon).where(F.startswith("tag", F.lit("N")) & (F.length("surface") >= 2))
    return sorted(r.noun for r in listed(nouns.select(F.upper("surface").alias("noun")).distinct(), "the lexicon"))


def longest_from_left(automaton, text: str) -> list[tuple[int, str]]:
    """The matches of an automaton from left to right, at each free place the longest, as ``(at, word)``."""
    longest: dict[int, str] = {}
    for end, word in automaton.iter(text):  # by rising end, so a later one of the same beginning is longer
        longest[end - len(word) + 1] = word
    out, free = [], 0
    for at in sorted(longest):
        if at >= free:
            out.append((at, longest[at]))
            free = at + len(longest[at])
    return out


def noun_occurrences(docs: DataFrame, lexicon: DataFrame, closed: bool = True) -> DataFrame:
    """``(doc_id, sent_id, pos, noun, at)``: the registered nouns of every sentence from left to right, at each place the longest, with their offset.

    An automaton over all nouns, built once in every worker, reads each sentence once, in Arrow batches; its time doesn't
    depend on the number of nouns, and on the test tables it takes a twentieth of that of one regular expression.
    """
    nouns = lexicon_nouns(lexicon)

    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for noun in nouns:
            automaton.add_word(noun, noun)
        automaton.make_automaton()
        for part in parts:
            yield part.map(lambda t: [{"noun": n, "at": at} for at, n in longest_from_left(automaton, t or "")] if nouns else [])

    sents = tokens.sentences(docs, closed=closed)
    return sents.select("doc_id", "sent_id", F.posexplode(found("sentence")).alias("pos", "x")).select("doc_id", "sent_id", "pos", "x.noun", "x.at")


def compounds(docs: DataFrame, lexicon: DataFrame, least_score: float = SCORE) -> DataFrame:
    """``(doc_id, label, score)``: bigrams of registered nouns by mutual information times TextRank, duplicates merged, above ``least_score``.

    ``docs`` is ``(doc_id, clean)``. The labels join the words without a space.
    """
    occ = materialize(noun_occurrences(docs, lexicon), "occurrences")
    ranks = graph.sentence_rank(occ, occ.select("doc_id", "noun"))
    pairs = compound.with_counts(compound.bigrams(occ).select("doc_id", "a", "b").distinct(), docs, least=2, spaceless=False)
    total = occ.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    scored = compound.score_pairs(pairs, docs.join(total, "doc_id"), ranks, F.col("total"), spaceless=False, fall_back=True)
    labelled = scored.select("doc_id", "a", "b", F.col("trpmi").alias("score"))
    return compound.merge_duplicates(labelled, F.concat("a", "b")).where(F.col("score") > least_score)


def cliff_scores(docs: DataFrame, first: bool = False, corpus: DataFrame | None = None) -> DataFrame:
    """``(token, len, prefix, score)``: prefixes at the cliff of their substring frequency in all documents, or in those of ``corpus``."""
    vocab = materialize(tokens.vocabulary(tokens.tokenize(docs, least=3)), "vocabulary")
    return prefix_cliffs(vocab, first, corpus)


def prefix_cliffs(vocab: DataFrame, first: bool = False, corpus: DataFrame | None = None) -> DataFrame:
    """``cliff_scores`` of the documents' stored vocabulary ``(token, n)``."""
    known = vocab if corpus is None else materialize(tokens.vocabulary(tokens.tokenize(corpus, least=0)), "corpus-vocabulary")
    forms = tokens.prefixes(vocab, parens=True)
    freq = counts.part_frequency(known, forms.select(F.col("prefix").alias("needle"))).withColumnRenamed("needle", "prefix")
    scored = forms.join(counts.merged(freq), "prefix", "left")
    return select.cliff(scored.select("token", "len", "prefix", F.coalesce("freq", F.lit(0)).alias("score")), first)


def in_chunks(docs: DataFrame) -> DataFrame:
    """Stored ``docs`` with ``chunk``, by a hash of their id: about ``CHUNK_DOCS`` documents, or ``CHUNK_CHARS`` characters if these are fewer."""
    n, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("clean")), F.lit(0))).first()
    chunks = max(1, -(-n // CHUNK_DOCS), -(-chars // CHUNK_CHARS))
    return docs.where("doc_id IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))


def chunk_cliffs(docs: DataFrame, least: int, corpus: DataFrame | None) -> DataFrame:
    """``(chunk, token, sizes)``: the lengths of the prefixes at a frequency cliff of each token of a chunk of ``in_chunks``.

    Tokens of all documents of a chunk share a row, and the prefixes travel as lengths.
    """
    toks = docs.select("chunk", F.explode(F.split("clean", " ")).alias("token"))
    toks = toks.where(F.length(F.regexp_replace("token", "[0-9]+", "-")) >= 3)
    own = materialize(toks.groupBy("chunk", "token").agg(F.count(F.lit(1)).alias("n")), "chunk-tokens")
    vocab = materialize(own.groupBy("token").agg(F.sum("n").alias("n")), "vocabulary")
    chosen = prefix_cliffs(vocab, corpus=corpus)
    if corpus is None:  # the score is the number in all documents, and no document has more
        chosen = chosen.where(F.col("score") >= least)
    sizes = chosen.groupBy("token").agg(F.sort_array(F.collect_list("len")).alias("sizes"))
    return own.select("chunk", "token").join(counts.merged(sizes), "token").select("chunk", "token", "sizes")


def _texts_and_cliffs(docs: pa.Table, cliffs: pa.Table) -> tuple[dict, dict[str, list[int]]]:
    """The rows of each document of a chunk, and the lengths by token."""
    own: dict = {}
    for r in docs.to_pylist():
        own.setdefault(r["doc_id"], []).append(r)
    return own, dict(zip(cliffs["token"].to_pylist(), cliffs["sizes"].to_pylist()))


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def discover_nouns(docs: DataFrame, least: int = LEAST, corpus: DataFrame | None = None) -> DataFrame:
    """``(doc_id, ord, noun)``: prefixes at a frequency cliff that occur ``least`` times in the document, in the order of their tokens.

    Frequencies come from ``corpus``, a larger collection ``(doc_id, clean)``, if there is one.
    """
    docs = in_chunks(materialize(docs.select("doc_id", F.coalesce("clean", F.lit("")).alias("clean")), "discover-docs"))
    cliffs = chunk_cliffs(docs, least, corpus)

    def nouns(left: pa.Table, right: pa.Table) -> pa.Table:
        own, sizes = _texts_and_cliffs(left, right)
        found = [(d, k, noun) for d, rows in own.items() for k, noun in enumerate(perdoc.cliff_nouns([r["clean"] for r in rows], sizes, least))]
        return _rows(found, ["doc_id", "ord", "noun"], [left.schema.field("doc_id").type, pa.int32(), pa.string()])

    return docs.groupBy("chunk").cogroup(cliffs.groupBy("chunk")).applyInArrow(nouns, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ord int, noun string")


def discover(docs: DataFrame, lexicon: DataFrame, least_score: float = SCORE, keep_tail: bool = True, corpus: DataFrame | None = None) -> DataFrame:
    """``(doc_id, word, method)``: discovered nouns that aren't registered, and compounds by both methods scoring at least ``least_score``.

    ``pairs`` tries all adjacent nouns of the text without spaces, ``chains`` neighbouring nouns of a sentence merged
    into chains; registered nouns may be parts of compounds. Sentences give their nouns up one by one, those that lie
    in others last. A pair counts by the text as it is or without its brackets, whichever has it more often.

    Once the cliffs of the collection are known all of it lies within a document, so texts are shuffled once, and a
    chunk of documents is worked off in Python.
    """
    text = F.coalesce("clean", F.lit(""))
    docs = in_chunks(materialize(docs.select("doc_id", text.alias("clean"), counts.word_total(text).cast("bigint").alias("total")), "discover-docs"))
    cliffs = chunk_cliffs(docs, LEAST, corpus)

    def words(left: pa.Table, right: pa.Table) -> pa.Table:
        own, sizes = _texts_and_cliffs(left, right)
        texts = {d: [r["clean"] for r in rows] for d, rows in own.items()}
        nouns = {d: found for d, t in texts.items() if (found := perdoc.cliff_nouns(t, sizes, LEAST))}
        occ = [perdoc.occurrences_of(texts[d], perdoc.included_last(found)) for d, found in nouns.items()]
        ranks: list[dict[str, float]] = [{} for _ in nouns]
        for d, noun, tr in zip(*graph.rank_sentences(perdoc.graph_rows(occ, list(nouns.values()))).to_pydict().values()) if nouns else ():
            ranks[d][noun] = tr
        out = [(d, noun, "noun") for d, found in nouns.items() for noun in found]
        for k, (d, found) in enumerate(nouns.items()):
            new, chains = perdoc.compounds_of([(r["clean"], r["total"]) for r in own[d]], sorted(found), occ[k], ranks[k], least_score, keep_tail)
            out += [(d, word, "pairs") for word in new] + [(d, word, "chains") for word in chains]
        return _rows(out, ["doc_id", "word", "method"], [left.schema.field("doc_id").type, pa.string(), pa.string()])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word string, method string"
    every = docs.groupBy("chunk").cogroup(cliffs.groupBy("chunk")).applyInArrow(words, schema)
    known = tagger.lexicon_rows(lexicon).where(F.startswith("tag", F.lit("N"))).select(F.upper("surface").alias("word"), F.lit("noun").alias("method")).distinct()
    return every.join(known, ["word", "method"], "left_anti").select("doc_id", "word", "method")


def frequent_starts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(token, prefix, rate)``: the first prefix of each token at the cliff of its rate, if that is at least ``least`` by the number of spaces.

    The rate is the number of tokens after a space that begin with the prefix, by the number of spaces of the collection.
    """
    vocab = materialize(tokens.vocabulary(tokens.tokenize(docs, least=3)), "vocabulary")
    started = tokens.vocabulary(tokens.tokenize(docs, least=0).where("pos > 0"))
    spaces = docs.agg(F.sum(count_in(F.col("clean"), F.lit(" "))).alias("spaces"))
    freq = counts.prefix_frequency(started)
    scored = tokens.prefixes(vocab, parens=True).join(freq, "prefix", "left").select("token", "len", "prefix", F.coalesce("freq", F.lit(0)).alias("score"))
    chosen = select.cliff(scored, first=True).crossJoin(F.broadcast(spaces))  # one row
    return chosen.where(F.col("score") >= least).select("token", "prefix", F.try_divide("score", "spaces").alias("rate"))


def report_order(report: DataFrame) -> DataFrame:
    """The rows of a search report, each document's together, by falling ``pct``, then falling ``tfidf``, then ``match``.

    A report belongs to one document, so documents are brought together by a hash and sorted in their partitions; a
    total order would have to compute the report twice to sample it.
    """
    return report.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("pct"), F.desc("tfidf"), "match")


def first_documents(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The ``n`` documents with the least ``key``, a chosen part of a collection."""
    return docs.orderBy(key).limit(n)


def left_matches(docs: DataFrame, mode: int = 0) -> DataFrame:
    """``(token, match)``: the longest left part of each distinct token that it shares with other tokens of the collection."""
    vocab = tokens.vocabulary(tokens.tokenize(docs))
    forms = tokens.right_trims(vocab)
    freq = counts.prefix_frequency(vocab)
    return select.longest_common_left(forms.join(freq.withColumnRenamed("prefix", "form"), "form"), mode)


def search_report(docs: DataFrame, lexicon: DataFrame, tag: tagger.Tagger | None = None, tf: str = "log", context: str = "first", least: int = 0) -> DataFrame:
    """``(doc_id, match, stripped, registered, pct, context, tfidf)``: what each document shares with the collection, explained by registered words.

    ``tf`` and ``context`` choose the variant (``log`` with the ``first`` place, or ``raw`` with ``all``); rows need a
    ``pct`` of at least ``least``.
    """
    tag = tag or tagger.lexicon_tagger(lexicon)
    toks = tokens.tokenize(docs)
    match = left_matches(docs)
    own = toks.select("doc_id", "token").distinct().join(match, "token").select("doc_id", "match").distinct()
    distinct = own.select("match").distinct()
    explained = distinct.withColumn("stripped", tagger.strip_suffixes(lambda: tag)(F.col("match"))).join(tagger.registered_left(distinct, lexicon), "match")
    n = counts.document_counts(toks, distinct.select(F.col("match").alias("needle")))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    scores = counts.tfidf_table(n, n_docs, tf).withColumnRenamed("needle", "match")
    full = own.join(scores, ["doc_id", "match"]).join(explained, "match")
    full = full.withColumn("pct", match_percent(F.col("stripped"), F.col("registered"), F.col("match"), F.col("tfidf"))).where(F.col("pct") >= least)
    show = first_context if context == "first" else all_contexts
    return compound.beside(full, docs.select("doc_id", F.col("clean").alias("_text")), context=lambda r: show(F.col("_text"), r["match"])).select(
        "doc_id", "match", "stripped", "registered", "pct", "context", "tfidf"
    )


def elbow_nouns(docs: DataFrame, least: int = LEAST, least_tfidf: float = TFIDF) -> DataFrame:
    """``(doc_id, noun, tfidf)``: prefixes at the elbow of their frequency that occur ``least`` times in a document and score above ``least_tfidf``."""
    toks = tokens.tokenize(docs, least=3)
    vocab = materialize(tokens.vocabulary(toks), "vocabulary")
    forms = tokens.prefixes(vocab)
    freq = counts.prefix_frequency(vocab).withColumnRenamed("freq", "score")
    chosen = materialize(select.elbow(forms.join(freq, "prefix").select("token", "len", "prefix", "score")), "elbows")
    n = counts.document_counts(tokens.tokenize(docs, least=0), chosen.select(F.col("prefix").alias("needle")))
    own = toks.select("doc_id", "token").distinct().join(chosen, "token").select("doc_id", F.col("prefix").alias("needle")).distinct()
    scores = counts.tfidf_table(n, docs.agg(F.count(F.lit(1)).alias("n_docs")), "zero")
    kept = own.join(n.where(F.col("n") >= least), ["doc_id", "needle"]).join(scores, ["doc_id", "needle"])
    return kept.where(F.col("tfidf") > least_tfidf).select("doc_id", F.col("needle").alias("noun"), "tfidf")


def new_words(docs: DataFrame, lexicon: DataFrame, tag: tagger.Tagger | None = None, least: int = LEAST) -> DataFrame:
    """``(word, freq)``: left part and middle of token divisions whose middle isn't registered, whose right part is known, and that recur.

    Divisions between two signs that aren't letters, or with one bracket in the middle, don't count. A middle counts
    with the first morpheme of its right part, if any. Candidates of one token are put in order, and those that hardly
    differ in frequency from a neighbour in it are left out. Registered nouns are left out at the end.
    """
    tag = tag or tagger.lexicon_tagger(lexicon)
    vocab = materialize(tokens.vocabulary(tokens.tokenize(docs, least=3)), "vocabulary")
    parts = tokens.splits(vocab)
    nouns = tagger.lexicon_rows(lexicon).where(F.startswith("tag", F.lit("NN"))).select(F.upper("surface").alias("um")).distinct()
    parts = parts.join(nouns, "um", "left_anti")
    right = parts.select("rp").distinct().withColumn("morphs", tagger.tagged(lambda: tag)(F.col("rp")))
    known = right.where(tagger.is_known(F.col("morphs"))).select("rp", F.when(F.size("morphs") > 0, F.col("morphs")[0]["surface"]).otherwise("").alias("first"))
    parts = parts.join(counts.merged(known), "rp")
    sign = r"[^\p{L}]"
    cut = (F.col("lp").rlike(sign + "$") & F.col("um").rlike("^" + sign)) | (F.col("um").rlike(sign + "$") & F.col("rp").rlike("^" + sign))
    one_sided = F.contains("um", F.lit("(")) != F.contains("um", F.lit(")"))
    parts = parts.where(~cut & ~one_sided).select("token", F.concat("um", "first").alias("needle"), F.concat("lp", "um").alias("word"))
    parts = materialize(parts, "divisions")
    freq = counts.part_frequency(vocab, parts.select("needle")).where(F.col("freq") >= least)
    words = parts.join(counts.merged(freq), "needle").select("token", "word").distinct()
    words = words.select(F.col("token").alias("doc_id"), (F.row_number().over(Window.partitionBy("token").orderBy("word")) - 1).alias("ord"), "word")
    words = materialize(words, "words")
    counted = counts.part_frequency(vocab, words.select(F.col("word").alias("needle"))).withColumnRenamed("needle", "word")
    kept = compound.mutual_inclusion(words, counted).select("word", "freq").distinct()
    return tagger.without_registered(kept, lexicon)


def similar_nouns(docs: DataFrame, nouns: DataFrame, distance: int = 2) -> DataFrame:
    """``(noun, other, cosine, rank)`` by the nouns that occur around each noun."""
    toks = materialize(tokens.tokenize(docs, least=0), "tokens")
    return similar.rank_nouns(similar.context_pairs(toks, nouns, distance))
