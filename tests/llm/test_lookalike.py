import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from wordmine.llm import lookalike as L

SAME = [
    ("Ｋ‑임금 ３％", "K-임금 3%"), ("ех​ample", "example"), ("임한", "임한"), ("café", "café"), ("끝…", "끝..."), ("가·나", "가・나"),
    ("a　b", "a b"), ("ﾃﾞｰﾀ", "データ"), ("𝐀bc", "Abc"), ("禮", "禮"), ("Ѕсоре", "Scope"), ("ΑΒ", "AB"),
]
OTHER = [("0", "O"), ("가 나", "가  나"), ("a\nb", "a b"), ("Ab", "ab"), ("e", "é"), ("㈜", "(주)"), ("①", "1"), ("다", "라"), ("²", "2")]


def test_equal_looks_have_equal_forms():
    assert all(L.consistent(a) == L.consistent(b) for a, b in SAME)
    assert all(L.consistent(a) != L.consistent(b) for a, b in OTHER)
    assert L.consistent("дом") == "дом" and L.consistent("") == ""


def test_substitution_in_both_directions():
    for word in ("год", "где", "дом", "ещё", "Юрий", "πόλης", "λόγος", "σήμερα", "Ꮳ Ꭺ", "scope", "naïve", "café", "K리그", "SK하이닉스", "Straße"):
        for i, c in enumerate(word):
            base, *marks = unicodedata.normalize("NFD", c)
            for x in L.CLASSES.get(base, ""):
                other = word[:i] + unicodedata.normalize("NFC", x + "".join(marks)) + word[i + 1 :]
                assert L.consistent(other) == L.consistent(word) == L.consistent_spans(other)[0], (word, other)
    assert [L.consistent(w) for w in ("гoд", "гдe", "дoм", "ещë", "K리그", "naїve")] == ["год", "где", "дом", "ещё", "K리그", "naïve"]


def test_every_canonical_sequence_is_composed():
    for a, b in (("\u0928\u093c", "\u0929"), ("\u0915\u0951\u0952", "\u0915\u0952\u0951"), ("\u0e01\u0e48\u0e38", "\u0e01\u0e38\u0e48")):
        assert L.consistent(a) == L.consistent(b) == L.consistent_spans(a)[0] == unicodedata.normalize("NFC", b)
    plain = [c for c in map(chr, range(0x80, 0x10000)) if L._ODD.search(c) is None]
    marks = [c for c in plain if unicodedata.combining(c)]
    assert all(unicodedata.is_normalized("NFC", a + b) for a in plain for b in marks if L._ODD.search(a + b) is None)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abgOАеорсΑ가각각́ ​­·…Ａ１٠ํำक़一カ力\n"), max_size=30))
def test_forms_are_stable_and_positions_fit(text):
    form, starts, ends = L.consistent_spans(text)
    assert form == L.consistent(text)
    assert L.consistent(form) == form
    if starts is None:
        assert len(form) == len(text)
    else:
        assert len(starts) == len(ends) == len(form) and all(a < b <= len(text) for a, b in zip(starts, ends)) and starts == sorted(starts)


def test_plain_words_read_as_themselves():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    assert [L.decode(w) for w in words] == words


def test_pairs_equal_brute_force(bodies):
    rng = random.Random(5)
    swap = {"a": "а", "o": "ο", " ": "\xa0", "e": "ｅ"}
    data = []
    for i in range(80):
        text = f"news {i % 7} about cheese"
        data.append((rng.choice(["text", "longtext"]), i, "".join(swap.get(c, c) if rng.random() < 0.1 else c for c in text)))
    data += [("text", 100, None), ("text", 101, ""), ("text", None, "news 1 about cheese"), data[0], ("text", 102, data[0][2])]
    rows = {r for r in data if r[1] is not None and r[2] is not None}
    want = {(s, i, j) for s, i, a in rows for t, j, b in rows if s == t and i < j and a != b and L.consistent(a) == L.consistent(b)}
    assert {tuple(r) for r in L.look_alike_pairs(L.look_digests(bodies(data))).collect()} == want
    assert L.look_alike_pairs(L.look_digests(bodies([]))).count() == 0


RUSSIAN = "Сегодня РАН сообщила, что сор вывезен."


def test_script_follows_the_surroundings():
    assert L.consistent(RUSSIAN) == RUSSIAN and L.consistent(RUSSIAN.replace("РАН", "PAH").replace("сор", "cop")) == RUSSIAN
    assert L.consistent("Korea РАН, a cop") == "Korea PAH, a cop" and L.consistent("서울 сор") == "서울 cop"
    mixed = "Новый cop\nthe new cop of Москва"
    assert L.consistent(mixed) == "Новый сор\nthe new cop of Москва"


def test_bigrams_decide_between_scripts(monkeypatch):
    text = "scope и город: {}"  # as many unmistakable letters of either script near by
    prior = (("latin", -0.7), ("cyrillic", -0.7))
    words = ["cop", "сор", "hope", "хор", "рос", "space", "сахар", "оса", "кот", "рок"]
    got = [L.decode(w, prior) for w in words]
    assert len({L._script(w[0]) for w in got}) == 2
    monkeypatch.setattr(L, "BIGRAMS", {s: ({}, {"": -3.0}) for s in L.BIGRAMS})
    L._remembered.cache_clear()
    flat = [L.decode(w, prior) for w in words]
    L._remembered.cache_clear()
    assert flat != got and L.consistent(text.format("x"))


def test_very_long_runs_take_linear_time():
    form = L.consistent("Россия " + "сор" * 100_000)
    assert form == L.consistent("Россия " + "cop" * 100_000) and len(form) == 300_007


def test_classes_hold_every_record_once(bodies):
    data = [("text", 1, "Ａb"), ("text", 2, "Ab"), ("text", 3, "Ab"), ("text", 4, "c"), ("longtext", 1, "Ab"), ("text", None, "Ab"), ("text", 5, None), ("text", 2, "Ab")]
    rows = L.look_classes(L.look_digests(bodies(data))).collect()
    assert sorted((r.src, r.row_id, r.n_forms) for r in rows) == [("longtext", 1, 1), ("text", 1, 2), ("text", 2, 2), ("text", 3, 2), ("text", 4, 1)]
    assert len({r.class_id for r in rows}) == 2


def test_extra_columns_and_nulls(bodies, spark):
    df = spark.createDataFrame([("text", 1, "Ａ", "x"), ("text", 2, None, "y")], "src string, row_id bigint, body string, form string")
    got = {r.row_id: r.form for r in L.consistent_text(df, "body").collect()}
    assert got == {1: "A", 2: None}
