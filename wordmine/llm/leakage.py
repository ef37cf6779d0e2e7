"""Test passages inside a corpus, found by latent semantic retrieval.

Every text becomes its words of letters and digits, in consistent form and lower case; without the spaces between them
they are its stream, so spacing, punctuation and invisible characters don't matter. Character n-grams of the stream,
weighted by their inverse document frequency over the whole corpus, are the features. A distributed randomised SVD
gives the latent space. Each document is cut into half overlapping passages of several lengths, and every passage of
every document is compared with segments of the test items by cosine in that space. A document and an item that come
near are checked: the longest run of the item's words tells copies, the longest common subsequence of words together
with the item's key terms, which stand for its answer, tells paraphrases.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.llm.lookalike import consistent
from wordmine.plans.lineage import listed, materialize
from wordmine.sources.tables import spread, table

#: n-gram length; bits of the hashed features and their number; rank of the latent space; extra directions of the SVD.
GRAM, BITS, RANK, EXTRA = 4, 13, 128, 16
FEATURES = 1 << BITS
#: Characters of the grid on which passages begin; characters of the passages that the SVD is fitted on.
UNIT, FIT_CHARS = 16, 64
#: Documents that the SVD is fitted on, on average, chosen by a hash of their id, and tasks that do so. All documents are
#: counted, indexed and searched.
FIT, FIT_TASKS = 1024, 2
#: Least cosine of a candidate; least shares of common words and of key terms in a paraphrase.
NEAR, COMMON, KEYS = 0.75, 0.6, 0.6
#: Items with a span of fewer characters hold too few n-grams for a latent space; their spans are looked up as they are.
SHORT = UNIT
#: Characters of test items in one block, and of documents searched at once.
BLOCK_CHARS, CHUNK = 2_000_000, 20_000

_NOISE = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """The words of letters and digits of a text's consistent form in lower case, a space between them."""
    return _NOISE.sub(" ", consistent(text or "").lower()).strip()


def stream(text: str | None) -> str:
    """Letters and digits of the text's consistent form in lower case."""
    return plain(text).replace(" ", "")


def gram_buckets(codes: np.ndarray) -> np.ndarray:
    """The hashed feature of every n-gram of a sequence of code points; one with a filler 0 in it gives ``FEATURES``."""
    if len(codes) < GRAM:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pair = codes[:-1] * np.uint32(0x85EBCA6B) + codes[1:]
        pair = (pair ^ (pair >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        four = pair[:-2] * np.uint32(0x85EBCA6B) + pair[2:]
        four = (four ^ (four >> np.uint32(13))) * np.uint32(0x297A2D39)
        out = (four >> np.uint32(32 - BITS)).astype(np.int64)
    filler = codes == 0
    if filler.any():
        at = np.flatnonzero(filler)
        for k in range(GRAM):
            near = at - k
            out[near[(near >= 0) & (near < len(out))]] = FEATURES
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Item:
    item_id: int
    words: list[str]
    half: int
    spans: list[str] = field(default_factory=list)
    pivots: list[str] = field(default_factory=list)  # every run of ``half`` words holds one of them
    keys: list[str] = field(default_factory=list)

    @property
    def least(self) -> int:
        return min(map(len, self.spans))


def build_items(rows: list[tuple[int, str | None]], share: float = 0.5) -> list[Item]:
    """Test items in order. Signs without a letter or digit don't count as words; items without any word, null ids and null texts are left out."""
    items = []
    for item_id, text in sorted({r for r in rows if r[0] is not None and r[1]}):
        words = [w for w in map(stream, text.split()) if w]
        if not words:
            continue
        half = max(1, -int(-len(words) * share // 1))
        items.append(Item(item_id, words, half, ["".join(words[i : i + half]) for i in range(len(words) - half + 1)], words[half - 1 :: half]))
    return items


def blocks(items: list[Item], chars: int = BLOCK_CHARS) -> list[list[Item]]:
    """Items in blocks of ``chars`` characters at most; one longer item is a block of its own."""
    out: list[list[Item]] = []
    size = chars
    for item in items:
        n = sum(map(len, item.words))
        if size + n > chars:
            out.append([])
            size = 0
        out[-1].append(item)
        size += n
    return out


def units_of(least: int) -> int:
    """Grid units in a passage for items whose shortest span has ``least`` characters: the greatest power of two that fits."""
    return 1 << max(0, (least // UNIT).bit_length() - 1)


def _grid(streams: list[str], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the streams, each beginning on the grid and followed by filler, and each one's number of grid units."""
    units = np.array([-(-len(s) // UNIT) + gap for s in streams], np.int64)
    joined = "".join(s + "\0" * (u * UNIT - len(s)) for s, u in zip(streams, units.tolist()))
    return np.concatenate([_codes(joined), np.zeros(GRAM - 1, np.uint32)]), units


def whole(basis: np.ndarray) -> np.ndarray:
    """A basis in whole numbers of 16 bits, small enough that ``UNIT`` of them can be added; what is lost is far below the noise of the space."""
    return np.rint(basis * (32000 // UNIT / max(1e-9, float(np.abs(basis).max(initial=0))))).astype(np.int16)


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]


@dataclass
class Space:
    """The latent space, and the segments of the items of a block in it by length of passage."""

    basis: np.ndarray  # FEATURES + 1 rows of small whole numbers, weighted by idf; the last is zero
    items: list[Item]
    classes: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)  # units, segments, which item

    def units(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of all grid units, the sums of their n-grams; filler gives zeros. No sum of ``UNIT`` rows leaves the range of 16 bits."""
        real = np.flatnonzero(codes[: len(codes) - GRAM + 1 : UNIT])
        grams = gram_buckets(codes).reshape(-1, UNIT)[real]
        out = np.zeros(((len(codes) - GRAM + 1) // UNIT, self.basis.shape[1]), np.float32)
        for lo in range(0, len(real), 256):  # small enough for the caches
            rows = self.basis[grams[lo : lo + 256]]
            total = rows[:, 0] + rows[:, 1]
            for k in range(2, UNIT):
                total += rows[:, k]
            out[real[lo : lo + 256]] = total
        return out

    def add_items(self) -> None:
        """Half overlapping segments of every item, as long as the passages of its class."""
        by: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            if item.least >= SHORT:
                by.setdefault(units_of(item.least), []).append(k)
        for m, members in sorted(by.items()):
            vectors, owner = [], []
            for k in members:
                rows = self.basis[gram_buckets(_codes("".join(self.items[k].words)))]
                total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
                size = m * UNIT - GRAM + 1
                starts = np.unique(np.append(np.arange(0, max(1, len(rows) - size + 1), m * UNIT // 2), max(0, len(rows) - size)))
                vectors.append(total[np.minimum(starts + size, len(rows))] - total[starts])
                owner.append(np.full(len(starts), k))
            self.classes.append((m, _normal(np.concatenate(vectors)).astype(np.float32), np.concatenate(owner)))

    def near(self, streams: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, item, cosine)`` of all passages of the texts and items that come as near as ``least``; a pair may appear for each length of passage."""
        top = max((m for m, _, _ in self.classes), default=1)
        codes, units = _grid(streams, top)
        wide, width = self.units(codes), 1
        doc = np.repeat(np.arange(len(units)), units)
        place = np.arange(len(doc)) - (np.cumsum(units) - units)[doc]
        docs, items, cosines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for m, segments, owner in self.classes:
            while width < m:  # sums over twice as many units; the filler after a text keeps the next one out
                wide = wide.copy()
                wide[:-width] += wide[width:].copy()
                width *= 2
            step = max(1, m // 2)
            starts = np.flatnonzero((place % step == 0) & ((place == 0) | (place + m - step < units[doc] - top)))
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            for lo in range(0, len(starts), 512):
                at = starts[lo : lo + 512]
                rows = wide[at]
                found = rows @ segments.T
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)
                close = np.flatnonzero(found.max(axis=1) >= least * norm)
                if len(close):
                    best = np.maximum.reduceat(found[close], firsts, axis=1) / norm[close, None]
                    d = doc[at[close]]
                    edge = np.flatnonzero(np.diff(d, prepend=-1))
                    best = np.maximum.reduceat(best, edge, axis=0)
                    a, s = np.nonzero(best >= least)
                    docs.append(d[edge][a])
                    items.append(owner[firsts][s])
                    cosines.append(best[a, s])
        return np.concatenate(docs), np.concatenate(items), np.concatenate(cosines)


def longest_run(words: list[str], text: str) -> int:
    """The most consecutive words whose letters stand in the text's stream without a break."""
    best = 0
    for i in range(len(words)):
        while i + best < len(words) and "".join(words[i : i + best + 1]) in text:
            best += 1
    return best


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, by bits of one long number for each word of ``b``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for w in b:
        held = row & places.get(w, 0)
        row = (row + held | row - held) & every
    return len(a) - row.bit_count()


def best_passage(words: list[str], text: list[str], least: float = 0) -> tuple[int, list[str]]:
    """The longest common subsequence of ``words`` and any part of ``text`` half as long again, with that part; 0 if below ``least``.

    Parts overlap by two thirds; only those that hold enough of the words to reach ``least`` and beat the best one are compared.
    """
    size, known = max(4, len(words) * 3 // 2), set(words)
    hit = [0, *itertools.accumulate(w in known for w in text)]
    best, where = 0, []
    for lo in range(0, max(1, len(text) - size + 1) + size // 3, max(1, size // 3)):
        hi = min(len(text), lo + size)
        if lo < hi and hit[hi] - hit[lo] > best and hit[hi] - hit[lo] >= least:
            n = common_subsequence(words, text[lo:hi])
            if n > best and n >= least:
                best, where = n, text[lo:hi]
    return best, where


def key_terms(item: Item, idf: np.ndarray) -> list[str]:
    """The words that an answer rests on: those with a digit and the quarter of rarest words, by their rarest n-gram."""
    words = list(dict.fromkeys(item.words))
    weight = {w: float(idf[g].max()) if len(g := gram_buckets(_codes(w))) else 0.0 for w in words}
    rare = sorted(words, key=lambda w: (-weight[w], w))[: max(1, len(words) // 4)]
    return [w for w in words if w in rare or any(c.isdigit() for c in w)]


def answers(item: Item, passage: list[str]) -> float:
    """The share of the item's key terms that a passage holds."""
    text = "".join(passage)
    return sum(k in text for k in item.keys) / max(1, len(item.keys))


def judge(item: Item, words: list[str], known: set[str], text: str, common: float = COMMON, keys: float = KEYS) -> tuple[str, int, int] | None:
    """``(kind, run, shared)`` of an item in a text given by its words and stream: ``copy`` with a run of half the item's words, else ``paraphrase`` or None.

    In a paraphrase one passage has at least ``common`` of the item's words in their order and ``keys`` of its key terms.
    """
    if any(p in text for p in item.pivots) and any(s in text for s in item.spans):
        run = longest_run(item.words, text)
        return "copy", run, run
    least = common * len(item.words)
    if sum(k in text for k in item.keys) < keys * len(item.keys) or sum(w in known for w in item.words) < least:
        return None  # what the whole text lacks no passage has
    shared, passage = best_passage(item.words, words, least)
    if shared < least or answers(item, passage) < keys:
        return None
    return "paraphrase", longest_run(item.words, text), shared


def _sum_rows(rows: DataFrame, height: int, width: int) -> np.ndarray:
    """The sum of arrays ``(part, data)`` that tasks sent in blocks of ``height`` rows; merged by block, never all in one place."""

    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(height * width)
        for batch in group:
            for data in batch.column("data").to_pylist():
                total += np.frombuffer(data, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])

    out = np.zeros((FEATURES, width))
    for part, data in rows.select("part", "data").groupBy("part").applyInArrow(add, "part int, data binary").collect():  # FEATURES x width numbers
        out[part * height : (part + 1) * height] = np.frombuffer(data, np.float64).reshape(height, width)
    return out


def _cut(total: np.ndarray, parts: int) -> pa.RecordBatch:
    height = FEATURES // parts
    rows = [total[i * height : (i + 1) * height].astype(np.float32).tobytes() for i in range(parts)]
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(rows, pa.binary())], ["part", "data"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to their plain words; at the end of a task the number of its documents with each feature, in 4 blocks."""
    names = ["doc_id", "plain", "part", "data"]
    df = np.zeros(FEATURES + 1)
    seen = np.zeros(FEATURES + 1, bool)
    for batch in batches:
        texts = [plain(t) for t in batch.column("text").to_pylist()]
        for text in texts:
            got = gram_buckets(_codes(text.replace(" ", "")))
            seen[:] = False
            seen[got] = True
            df += seen
        n = len(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    sums = _cut(df[:FEATURES, None], 4)
    yield pa.RecordBatch.from_arrays([pa.nulls(4, pa.int64()), pa.nulls(4, pa.string()), sums.column(0), sums.column(1)], names)


def _product(streams: list[str], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What the passages of these texts give to ``A' A basis``, ``A`` being the matrix of passages of length one each."""
    total = np.zeros((FEATURES, basis.shape[1]))
    size = FIT_CHARS
    for text in streams:
        got = gram_buckets(_codes(text))
        if not len(got):
            continue
        starts = np.arange(0, len(got), size)
        weight = idf[got]
        norm = np.maximum(np.sqrt(np.add.reduceat(weight**2, starts)), 1e-9)
        weight = weight / norm[np.arange(len(got)) // size]
        rows = np.add.reduceat(basis[got] * weight[:, None], starts, axis=0)
        order = np.argsort(got, kind="stable")
        keys, firsts = np.unique(got[order], return_index=True)
        total[keys] += np.add.reduceat(rows[order // size] * weight[order, None], firsts, axis=0)
    return total


def latent_basis(sample: DataFrame, idf: np.ndarray, own: list[str], rank: int = RANK, extra: int = EXTRA, parts: int = 16) -> np.ndarray:
    """The leading right singular vectors of the passages of ``(plain)`` and of the items, by subspace iteration from seeded random directions."""
    width = rank + extra
    sc = sample.sparkSession.sparkContext

    def times(basis: np.ndarray | None) -> np.ndarray:
        shared = None if basis is None else sc.broadcast(basis)  # of fixed size

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, total = _directions(width) if shared is None else shared.value, None
            for batch in batches:
                texts = [t.replace(" ", "") for t in batch.column("plain").to_pylist()]
                for lo in range(0, len(texts), 256):
                    got = _product(texts[lo : lo + 256], idf, b)
                    total = got if total is None else total + got
            if total is not None:
                yield _cut(total, parts)

        few = sample.select("plain").coalesce(FIT_TASKS)  # each sends a matrix of fixed size
        summed = _sum_rows(few.mapInArrow(share, "part int, data binary"), FEATURES // parts, width)
        if shared is not None:
            shared.destroy()
        return summed + _product(own, idf, _directions(width) if basis is None else basis)

    q = np.linalg.qr(times(None))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(q.T @ times(q))
    return (q @ vectors[:, np.argsort(values)[::-1][:rank]]).astype(np.float32)


def _directions(width: int) -> np.ndarray:
    """The seeded random directions that the iteration begins with, the same in every task."""
    return np.random.default_rng(7).standard_normal((FEATURES, width), dtype=np.float32)


def _short_spans(items: list[Item]):
    """An automaton over the spans of items that are too short for the latent space, or None."""
    import ahocorasick

    spans: dict[str, set[int]] = {}
    for k, item in enumerate(items):
        if item.least < SHORT:
            for s in item.spans:
                spans.setdefault(s, set()).add(k)
    found = ahocorasick.Automaton()
    for s, ks in spans.items():
        found.add_word(s, tuple(sorted(ks)))
    found.make_automaton()
    return found if spans else None


def _search(shared, least: float):
    """Plain documents to the items they hold, one block of items at a time."""
    names = ["doc_id", "item_id", "kind", "run", "shared", "words", "cosine"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Space = shared.value
        short = _short_spans(space.items)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("plain").to_pylist()
            rows, lo = [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                    size += len(texts[hi])
                    hi += 1
                streams = [t.replace(" ", "") for t in texts[lo:hi]]
                near: dict[tuple[int, int], float] = {}
                if space.classes:
                    for d, k, cos in zip(*(x.tolist() for x in space.near(streams, least))):
                        near[d, k] = max(cos, near.get((d, k), -1.0))
                if short is not None:
                    for d, text in enumerate(streams):
                        near.update(((d, k), 1.0) for _, ks in short.iter(text) for k in ks)
                words, known, last = [], set(), -1
                for (d, k), cos in sorted(near.items()):
                    if d != last:
                        words, last = texts[lo + d].split(" "), d
                        known = set(words)
                    item = space.items[k]
                    if (got := judge(item, words, known, streams[d])) is not None:
                        rows.append((ids[lo + d], item.item_id, *got, len(item.words), min(1.0, cos)))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(len(names))], names)

    return run


def leaked(documents: DataFrame, benchmark: DataFrame, share: float = 0.5, near: float = NEAR, fit: int = FIT) -> DataFrame:
    """``(doc_id, item_id, kind, run, shared, words, cosine)`` for every test item that a document holds.

    ``kind`` is ``copy`` where the document has at least ``share`` of the item's words in one run, else ``paraphrase``.
    ``run`` is the longest run of words found, ``shared`` the longest common subsequence, ``words`` the item's number of
    words. ``documents`` is ``(doc_id, text)``, ``benchmark`` ``(item_id, text)``, the stated query set, which goes
    through all documents in blocks of a fixed size. Null and empty texts and null ids give no row, repeated rows one;
    items that share a passage count each. Signs without a letter or digit don't count as words.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, kind string, run int, shared int, words int, cosine double"
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    read = materialize(docs.mapInArrow(_read, "doc_id bigint, plain string, part int, data binary"), "plain-documents")
    counts = _sum_rows(read.where("part IS NOT NULL"), FEATURES // 4, 1)[:, 0]
    plains = read.where("doc_id IS NOT NULL").select("doc_id", "plain")
    n = plains.count()
    idf = np.log((n + 1) / (counts + 1)).astype(np.float32)
    chosen = plains.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, fit / max(1, n)) * 1_000_000)).select("plain")
    result = spark.createDataFrame([], schema)
    basis = None
    rows = [(r.item_id, r.text) for r in listed(benchmark.select("item_id", "text"), "the set of test items")]
    for part in blocks(build_items(rows, share)):
        if basis is None:
            own = ["".join(i.words) for i in part]
            basis = latent_basis(materialize(chosen, "fit"), np.append(idf, np.float32(0)), own)
            basis = np.concatenate([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)])
        space = Space(whole(basis), part)
        for item in part:
            item.keys = key_terms(item, idf)
        space.add_items()
        shared = spark.sparkContext.broadcast(space)  # FEATURES x RANK numbers and one block of items
        result = result.unionByName(plains.mapInArrow(_search(shared, near), schema))
    first = F.max(F.struct(F.col("kind") == "copy", "shared", "run", "words", "cosine")).alias("x")
    best = result.groupBy("doc_id", "item_id").agg(first, F.min("kind").alias("kind"))
    return best.select("doc_id", "item_id", "kind", "x.run", "x.shared", "x.words", "x.cosine")


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "benchmark", "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The test items of which each document has half the words in one run, see TESTDATA.md."""
    return leaked(*_tables(spark, folder)).where("kind = 'copy'").select("doc_id", "item_id")


def p7_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The test items each document holds, copied or paraphrased, with what the checks found."""
    return leaked(*_tables(spark, folder)).select("doc_id", "item_id", "kind", "run", "shared", "words")


QUERIES = {"p7_found": p7_found, "p7_runs": p7_runs}
ORACLES: dict[str, str] = {}
