"""Reading grades: every sentence is classified, and a document's grade follows from the levels of its sentences.

Two regularised linear models, one over character n-grams and one over words, give each sentence unit a distribution
of grades. A document is described by the distribution over all its sentences, in which quotations and page furniture
are few and stand out, and a second model, calibrated on documents the first ones weren't fitted on, turns that into
the grade. Both are fitted on a bounded sample of rated documents; scoring is vectorised over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.llm.sentences import sentence_spans
from wordmine.sources.tables import spread, table

#: Rated documents used for fitting at most, chosen by a hash of the id; hashed features; grades.
SAMPLE, FEATURES, GRADES = 1500, 1 << 16, 5
#: Characters scored at once.
CHUNK = 1_000_000

#: How often a rating misses the grade of the text by as many grades; what all texts of a grade share is learnt from the others.
MISSES = (0.8, 0.1, 0.002, 0.001, 0.001)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 16)


@dataclass
class Text:
    """Joined texts: hashed features per character and word, and where sentences and documents begin."""

    grams: list[np.ndarray]
    words: np.ndarray
    word_sentence: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray  # of each sentence
    n_docs: int


def analyse(texts: list[str]) -> Text:
    """Sentences are the units of the sentence operator; digits count as one, letters as lower case."""
    joined = "".join(t + "\n" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    small = codes < 128
    upper = small & (codes >= 65) & (codes <= 90)
    codes[upper] += 32
    digit = small & (codes >= 48) & (codes <= 57)
    codes[digit] = 48
    first = np.zeros(len(codes), bool)
    first[begins] = True
    for text, at in zip(texts, begins.tolist()):
        first[[at + a for a, _ in sentence_spans(text)][1:]] = True
    starts = np.flatnonzero(first)
    doc = np.searchsorted(begins, starts, "right") - 1
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        two = c.copy()
        two[:-1] = c[:-1] * np.uint64(1000003) + c[1:]
        three = two.copy()
        three[:-2] = two[:-2] * np.uint64(1000003) + c[2:] + np.uint64(7)
        grams = [((x * _MIX) >> _SHIFT).astype(np.int64) for x in (two, three)]
        blank = (codes == 32) | (codes == 10) | (codes == 13) | (codes == 9)
        begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1] | first[1:]]))
        if len(begin):
            place = np.arange(len(c)) - begin[np.maximum(np.searchsorted(begin, np.arange(len(c)), "right") - 1, 0)]
            letter = (c + (place.astype(np.uint64) << np.uint64(24))) * _MIX
            letter ^= letter >> np.uint64(31)
            letter[blank] = 0
            words = ((np.add.reduceat(letter, begin) * _MIX) >> _SHIFT).astype(np.int64)
        else:
            words = np.zeros(0, np.int64)
    return Text(grams, words, np.searchsorted(starts, begin, "right") - 1, starts, np.diff(np.append(starts, len(codes))), doc, len(texts))


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    chars: np.ndarray
    words: np.ndarray
    scale: np.ndarray | None = None
    document: np.ndarray | None = None

    def sentences(self, t: Text) -> np.ndarray:
        """Distribution of grades for each sentence: the mean of both models' scores."""
        norm = np.sqrt(np.maximum(t.lengths, 1))[:, None]
        out = sum(_sums(self.chars[g], t.starts) for g in t.grams) / norm
        n = np.bincount(t.word_sentence, minlength=len(t.starts))
        word = np.zeros_like(out)
        if len(t.words):
            has = np.flatnonzero(n)
            word[has] = _sums(self.words[t.words], np.concatenate([[0], np.cumsum(n[has])[:-1]])) / np.sqrt(n[has])[:, None]
        return _softmax((out + word) / 2)

    def describe(self, t: Text) -> np.ndarray:
        """Per document the distribution over its sentences, weighted by the root of their length, its modes and their product."""
        p = self.sentences(t)
        weight = np.sqrt(t.lengths)
        total = np.maximum(np.bincount(t.doc, weight, minlength=t.n_docs), 1e-9)
        mean = np.stack([np.bincount(t.doc, weight * p[:, k], minlength=t.n_docs) for k in range(GRADES)], 1) / total[:, None]
        vote = np.zeros_like(p)
        vote[np.arange(len(p)), p.argmax(axis=1)] = 1
        votes = np.stack([np.bincount(t.doc, weight * vote[:, k], minlength=t.n_docs) for k in range(GRADES)], 1) / total[:, None]
        logs = np.stack([np.bincount(t.doc, weight * np.log(p[:, k] + 0.02), minlength=t.n_docs) for k in range(GRADES)], 1) / total[:, None]
        return np.concatenate([mean, votes, logs, np.ones((t.n_docs, 1))], axis=1)

    def grade(self, texts: list[str]) -> np.ndarray:
        """Grades 1 to 5; ties go to the lower grade."""
        return (self.describe(analyse(texts)) / self.scale @ self.document).argmax(axis=1) + 1


def _fit_linear(index: np.ndarray, starts: np.ndarray, norm: np.ndarray, want: np.ndarray, epochs: int, ridge: float = 1e-6, rate: float = 0.5) -> np.ndarray:
    """Multinomial logistic regression on hashed features by AdaGrad over seeded mini-batches of rows; ``want`` has a distribution of grades for each."""
    w, seen = np.zeros((FEATURES, GRADES), np.float32), np.full((FEATURES, GRADES), 1e-3, np.float32)
    ends, rng = np.append(starts[1:], len(index)), np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(starts))
        for lo in range(0, len(order), 256):
            rows = order[lo : lo + 256]
            sizes = ends[rows] - starts[rows]
            at = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            which = np.repeat(np.arange(len(rows)), sizes)
            ix = index[at]
            score = _sums(w[ix], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / norm[rows, None]
            p = _softmax(score)
            p -= want[rows]
            p /= norm[rows, None]
            keys, inverse = np.unique(ix, return_inverse=True)
            grad = np.stack([np.bincount(inverse, p[which, k], minlength=len(keys)) for k in range(GRADES)], 1).astype(np.float32) + ridge * w[keys]
            seen[keys] += grad**2
            w[keys] -= rate * grad / np.sqrt(seen[keys])
    return w


def _fit_sentences(texts: list[str], want: np.ndarray, epochs: int = 2) -> Model:
    t = analyse(texts)
    y = want[t.doc].astype(np.float32)
    both = np.stack(t.grams, 1).reshape(-1)
    chars = _fit_linear(both, t.starts * 2, np.sqrt(t.lengths), y, epochs)
    n = np.bincount(t.word_sentence, minlength=len(t.starts))
    has = np.flatnonzero(n)
    words = _fit_linear(t.words, np.concatenate([[0], np.cumsum(n[has])[:-1]]), np.sqrt(n[has]), y[has], epochs)
    return Model(chars, words)


def fit(texts: list[str], grades: list[int]) -> Model:
    """Sentence models on all texts; the document model on descriptions by models of the other half.

    Raters err, so after a first fit each rating is weighed against what the models say of its text: the second fit
    is on the distribution of grades given both, by ``MISSES``. No rating is put aside.
    """
    y = np.array(grades) - 1
    model, described = _fit_once(texts, np.eye(GRADES)[y])
    seen = np.array(MISSES)[np.abs(np.arange(GRADES)[None, :] - y[:, None])]
    want = _softmax(described / model.scale @ model.document) * seen
    return _fit_once(texts, want / want.sum(axis=1, keepdims=True))[0]


def _fit_once(texts: list[str], want: np.ndarray) -> tuple[Model, np.ndarray]:
    half = np.arange(len(texts)) % 2
    described = np.zeros((len(texts), 3 * GRADES + 1))
    for side in (0, 1):
        fitted, held = np.flatnonzero(half != side), np.flatnonzero(half == side)
        if len(fitted) and len(held):
            described[held] = _fit_sentences([texts[i] for i in fitted], want[fitted]).describe(analyse([texts[i] for i in held]))
    model = _fit_sentences(texts, want)
    scale = np.maximum(described.std(axis=0), 1e-3)
    scale[-1] = 1
    x, w = described / scale, np.zeros((described.shape[1], GRADES))
    for _ in range(400):
        w -= 0.5 * (x.T @ (_softmax(x @ w) - want) / max(1, len(x)) + 1e-3 * w)
    return Model(model.chars, model.words, scale, w), described


def ratings(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: the median of the distinct raters' mean grades, halves to the lower. Null ids and grades count for nothing."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("grade").between(1, GRADES))
    raters = good.groupBy("doc_id", "rater").agg(F.avg("grade").alias("g"))
    return raters.groupBy("doc_id").agg(F.ceil(F.median("g") - 0.5).cast("int").alias("grade"))


def sample(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most ``limit`` rated texts in the order of a hash of their id, for fitting alone."""
    chosen = ratings(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0).select("doc_id", "text", "grade").collect()
    seen = {r.doc_id: (r.text, r.grade) for r in rows}
    ordered = [seen[k] for k in sorted(seen)]
    return [t for t, _ in ordered], [g for _, g in ordered]


def reading_grades(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``(doc_id, grade)`` of every document ``(doc_id, text)`` whose text is neither null nor empty.

    Whole texts are scored. Documents with a null id are left out, repeated rows give one. Without any usable rating
    there is no scale and the result is empty.
    """
    spark = documents.sparkSession
    texts, grades = sample(documents, labels, limit)
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    if not texts:
        return docs.select("doc_id", F.lit(1).alias("grade")).where(F.lit(False))
    shared = spark.sparkContext.broadcast(fit(texts, grades))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.column("text").to_pylist()
            out, lo = [], 0
            while lo < len(rows):
                hi, size = lo, 0
                while hi < len(rows) and (hi == lo or size + len(rows[hi]) <= CHUNK):
                    size += len(rows[hi])
                    hi += 1
                out.append(shared.value.grade(rows[lo:hi]))
                lo = hi
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(out) if out else [], pa.int32())], ["doc_id", "grade"])

    return docs.mapInArrow(run, "doc_id bigint, grade int").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The reading grade of each document, see TESTDATA.md."""
    return reading_grades(spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "labels", "doc_id", "rater", "grade"))


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters of each grade."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    return p8_found(spark, folder).join(sizes, "doc_id").groupBy("grade").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"))


QUERIES = {"p8_found": p8_found, "p8_profile": p8_profile}
ORACLES: dict[str, str] = {}
