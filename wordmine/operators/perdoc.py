"""Work on one document at a time in Python, for steps that need nothing but the document and a few facts on its tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping

import pyarrow as pa

from wordmine.operators.compound import pairs_in, take_all

_DIGITS, _INNER, _BRACKET = re.compile("[0-9]+"), re.compile(r"\([^()]*\)"), re.compile("[()]")
#: Characters times words up to which each word is looked for by itself; above, all at once.
EACH = 20_000_000


def tokens_of(text: str, least: int = 3) -> list[tuple[int, str]]:
    """``(pos, token)`` as ``tokens.tokenize`` has them."""
    return [(pos, t) for pos, t in enumerate(text.split(" ")) if len(t) >= least and (t.isalpha() or len(_DIGITS.sub("-", t)) >= least)]


def sentences_of(text: str, ending: str = "다") -> list[str]:
    """The closed sentences of ``tokens.sentence_array``."""
    pieces = re.sub(rf"({ending}\.+)", "\\1\n", text).split("\n")
    return [p for p in pieces if re.search(rf"{ending}\.+\Z", p)] + [re.sub(rf"(?m)^[^\n]*{ending}\.", "", text)]


def without_brackets(text: str) -> str:
    """``clean.strip_parens`` of a text."""
    before = None
    while text != before:
        before, text = text, _INNER.sub("", text)
    return _BRACKET.sub("", text)


def count_each(text: str, words: Iterable[str]) -> dict[str, int]:
    """How often each word of at least one character occurs in ``text``, not overlapping, from the left."""
    words = list(words)
    if len(text) * len(words) <= EACH:
        return {w: text.count(w) for w in words}
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    found, free = dict.fromkeys(words, 0), dict.fromkeys(words, 0)
    for end, w in automaton.iter(text):  # those of one word by rising place
        if end - len(w) + 1 >= free[w]:
            found[w] += 1
            free[w] = end + 1
    return found


def cliff_nouns(texts: list[str], cliffs: Mapping[str, list[int]], least: int) -> list[str]:
    """The prefixes that the tokens of a document give and that occur ``least`` times in its tokens, by first place and length.

    ``cliffs`` has the lengths of the prefixes that a token gives. A prefix has no space, so its number in the tokens
    joined by spaces is the sum over the tokens.
    """
    at: dict[str, tuple[int, int]] = {}
    kept: list[str] = []
    for text in texts:
        for pos, token in tokens_of(text):
            kept.append(token)
            for size in cliffs.get(token, ()):
                if (noun := token[:size]) not in at or (pos, size) < at[noun]:
                    at[noun] = pos, size
    found = count_each(" ".join(kept), at)
    return sorted((noun for noun in at if found[noun] >= least), key=lambda noun: (at[noun], noun))


def included_last(nouns: list[str]) -> list[str]:
    """Distinct nouns in their order, those that another one contains last."""
    every = "\n".join(nouns)
    if every.count("\n") == len(nouns) - 1:  # then nothing is found across two nouns
        inside = {n for n in nouns if every.find(n, every.find(n) + 1) >= 0}
    else:
        inside = {n for n in nouns if any(n in z for z in nouns if z != n)}
    return [n for n in nouns if n not in inside] + [n for n in nouns if n in inside]


def occurrences_of(texts: list[str], nouns: list[str]) -> dict[int, list[str]]:
    """By sentence, the nouns taken out of it in the order given, by their places."""
    taken: dict[int, list[tuple[int, int, str]]] = {}
    for text in texts:
        for sent, sentence in enumerate(sentences_of(text)):
            if got := take_all(sentence, nouns):
                taken.setdefault(sent, []).extend((at, step, noun) for step, (at, noun) in enumerate(got))
    return {sent: [noun for _, _, noun in sorted(taken[sent])] for sent in sorted(taken)}


def graph_rows(occ: list[dict[int, list[str]]], nouns: list[list[str]]) -> pa.Table:
    """The input of ``graph.rank_sentences``; documents are numbered by their place in the lists."""
    rows = [(d, sent, noun, n) for d, sents in enumerate(occ) for sent, own in sents.items() for noun, n in Counter(own).items()]
    rows += [(d, None, noun, 0) for d, own in enumerate(nouns) for noun in own]
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = {"doc_id": pa.int64(), "sent_id": pa.int64(), "noun": pa.string(), "n": pa.int64()}
    return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns)})


def chains_of(pairs: list[tuple[str, str]], keep_tail: bool = True) -> list[str]:
    """``compound.chain_merge`` of one document's pairs, words joined by spaces."""
    runs: list[list[str]] = []
    for k, (a, b) in enumerate(pairs):
        if k and pairs[k - 1][1] == a:
            runs[-1].append(b)
        else:
            runs.append([a, b])
    if runs and not keep_tail and len(runs[-1]) > 2:
        runs.pop()
    return [" ".join(r) for r in runs]


def compounds_of(texts: list[tuple[str, int]], nouns: list[str], occ: dict[int, list[str]], ranks: Mapping[str, float], least_score: float, keep_tail: bool = True, least: int = 2) -> tuple[set[str], set[str]]:
    """The compounds of a document by adjacent pairs of its text and by chains of its sentences' pairs.

    ``texts`` has each text of the document with its number of words.
    """
    seen = list(dict.fromkeys((own[k], own[k + 1]) for own in occ.values() for k in range(len(own) - 1)))
    new: set[str] = set()
    kept: list[tuple[int, str, str]] = []
    for text, total in texts:
        one, two = text.replace(" ", ""), without_brackets(text).replace(" ", "")
        number: dict[str, int] = {}

        def count(noun: str) -> int:
            if noun not in number:
                number[noun] = one.count(noun)
            return number[noun]

        def good(a: str, b: str, n: int) -> bool:
            information = 0.0
            if n:
                chance = count(a) / total * (count(b) / total) if total else 0.0
                if not chance:
                    return False
                information = math.log(n / total / chance)
            return math.pow(ranks[a] * ranks[b], 0.5) * information >= least_score

        new.update(f"{a} {b}" for a, b, n in pairs_in(one, nouns, two if two != one else None, least) if good(a, b, n))
        for k, (a, b) in enumerate(seen):
            n = one.count(a + b)
            if (n >= least or two != one and two.count(a + b) >= least) and good(a, b, n):
                kept.append((k, a, b))
    return new, set(chains_of([(a, b) for _, a, b in sorted(kept)], keep_tail))
