"""One consistent form for text that looks the same but is stored with different characters.

Steps: invisible characters go, width, font, spacing and ligature variants are replaced by what they stand for, dots
and dashes by one of each kind, sequences are composed, and every run of letters that has look-alikes in another
script becomes a lattice of these letters. A Viterbi search through it finds the reading with the fewest changes of
script and, among those, the best score: character bigrams of each script, and how often that script's unmistakable
letters stand in the same line and text. The lattice and what surrounds it are taken by shape, not by the letters
found, so texts of equal looks end in equal forms. Enclosed, squared and raised signs, letter case, digits, accents,
the number of spaces and line breaks stay as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.llm.records import records
from wordmine.plans.lineage import materialize

#: Characters without a mark of their own.
IGNORABLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
    "￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
#: Dashes, middle dots and spaces that count as one of their kind.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
DOTS = "•‧∙⋅⸱・･·ᐧㆍᆞ"
SPACES = "               　"
#: Letters of the same shape, the Latin, Han or Katakana one first.
SHAPES = (
    "A А Α Ꭺ ꓮ Ⲁ|B В Β ꓐ Ⲃ|C С Ꮯ ꓚ Ⲥ|D Ꭰ ꓓ|E Е Ε Ꭼ ꓰ Ⲉ|F ꓝ|G Ꮐ ꓖ|H Н Η Ꮋ ꓧ Ⲏ|I І Ι Ӏ ꓲ Ⲓ|J Ј Ꭻ ꓙ|K К Κ ꓗ Ⲕ|L Ꮮ ꓡ|M М Μ Ꮇ ꓟ Ⲙ|N Ν ꓠ Ⲛ|O О Ο Օ ꓳ Ⲟ|"
    "P Р Ρ Ꮲ ꓑ Ⲣ|Q Ԛ|R Ꭱ ꓣ|S Ѕ Տ Ꮪ ꓢ|T Т Τ Ꭲ ꓔ Ⲧ|U Ս ꓴ|V Ѵ Ꮩ ꓦ|W Ԝ Ꮃ ꓪ|X Х Χ ꓫ Ⲭ|Y У Υ Ү ꓬ Ⲩ|Z Ζ Ꮓ ꓜ|"
    "a а|c с ϲ ⲥ|d ԁ|e е|g ɡ ց|h һ հ|i і|j ј|n ո|o о ο օ ⲟ|p р ⲣ|q ԛ զ|s ѕ|u ս|v ν ѵ|w ԝ|x х|y у ү|"
    "力 カ|工 エ|口 ロ|卜 ト|二 ニ|八 ハ|夕 タ|ヘ へ|ベ べ|ペ ぺ"
)
#: Seed text of each script, from which the letter bigrams are counted.
SEED = {
    "latin": (
        "the people said that the council of the city will open new offices for the industry this year and more companies report results from export "
        "production market energy service data system news desk team agency in the north and the south she did not know where her brother had put the "
        "letters but he was sure that nobody could open them before they came home again what happens when an engine stops working on a hot summer day "
        "every child should learn to read because books carry us to other places police cop pop scope space cope peace copy ox axe coax apex pace race "
        "care area era eye yes year say easy sea case close house horse score core ocean cocoa soap poem hope hop cap cape ape map maps top post stop "
        "la casa del pueblo es una parte de la historia y el agua de los rios corre hacia el mar der die das und nicht ein eine les des une est pour"
    ),
    "cyrillic": (
        "сегодня совет города сообщил что новые предприятия отрасли увеличили выпуск товаров и услуг а рынок энергии растет третий год подряд об этом пишут "
        "газеты севера и юга страны она не знала куда ее брат положил письма но он был уверен что никто не сможет открыть их раньше чем они вернутся домой "
        "каждый ребенок должен учиться читать потому что книги уносят нас в другие места академия наук ран сор спор рос нос сон рот кот ток рок срок сорок "
        "вор ров ура утро хор хоро хата сахар хор рука наука раса роса коса оса сова слово око окно оно она они мера время море хотеть терять стать "
        "як справи сьогодні міста України який може бути для всіх людей нашої країни ова ево ски ски ого его ому ему ами ями"
    ),
    "greek": (
        "σήμερα το συμβούλιο της πόλης ανακοίνωσε ότι οι νέες επιχειρήσεις του κλάδου αύξησαν την παραγωγή και η αγορά ενέργειας μεγαλώνει για τρίτο έτος "
        "κάθε παιδί πρέπει να μάθει να διαβάζει γιατί τα βιβλία μας ταξιδεύουν σε άλλους τόπους δεν ήξερε πού είχε βάλει ο αδελφός της τα γράμματα αλλά ήταν "
        "σίγουρος ότι κανείς δεν θα μπορούσε να τα ανοίξει πριν γυρίσουν στο σπίτι νότος νόμος τόνος πόνος όρος χρόνος νερό ουρανός"
    ),
}
SCRIPTS = ("latin", "han", "katakana", "hiragana", "hangul", "cyrillic", "greek", "cherokee", "armenian", "coptic", "lisu", "other")


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "").split(" ")[0].lower()
    name = {"cjk": "han"}.get(name, name)
    return name if name in SCRIPTS else "other"


def _classes() -> dict[str, str]:
    """Each letter that has look-alikes, with all letters of its shape."""
    return {x: group.replace(" ", "") for group in SHAPES.split("|") for x in group.replace(" ", "")}


CLASSES = _classes()
RIVALS = "".join(x for x in CLASSES if not x.isascii())


def _folds() -> dict[int, str | None]:
    """Characters of other width, font, spacing or ligature with what they stand for, by Unicode's own tags."""
    out: dict[int, str | None] = {}
    for code in (*range(0x80, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00)):
        kind, _, rest = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"):
            full = unicodedata.normalize("NFKC", chr(code))
            enclosed = "(" in full or full[:1].isdigit() or full.startswith(" ") and len(full) > 1 or "ㄱ" <= chr(code) <= "ㆎ"
            if (kind != "<compat>" or not enclosed) and chr(code) not in CLASSES:
                out[code] = full
    out.update(dict.fromkeys(map(ord, DASHES), "-"))
    out.update(dict.fromkeys(map(ord, DOTS), "·"))
    out.update(dict.fromkeys(map(ord, SPACES), " "))
    out[0x22EF] = "..."
    return out


FOLDS = _folds()
_GONE = re.compile(f"[{IGNORABLE}]+")
_FOLD = re.compile("[" + re.escape("".join(chr(c) for c in sorted(FOLDS) if c < 0x10000 and FOLDS[c] != chr(c))) + "]|[\U00010000-\U0010ffff]")
#: Anything but text that is its own consistent form.
_ODD = re.compile(
    "[^\x00-\x7f·à-ÿऀ-ऻऽ-ॐॕ-ॗॠ-ॿก-าิ-ฺ฿-๛‘-”■▶㈜㎞㏊、-】ぁ-へほ-ゐァ-ェ一-鿿가-힣]|[" + "".join(x for x in RIVALS if x in "力工口卜二八夕へべぺ") + "]"
    "|[\u0e38\u0e39\u0e48-\u0e4b][\u0e3a\u094d]|[\u0e48-\u0e4b][\u0e38\u0e39]"  # marks out of order
)
_WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[̀-ͯ])*")
#: Scripts that share shapes with Latin letters. Their other letters are unmistakable and speak for their script.
_SHARING = tuple(x for x in SCRIPTS if x != "latin" and any(_script(c) == x for c in "".join(v for k, v in CLASSES.items() if k.isascii())))
_CLAIMING = "".join(c for c in map(chr, range(0x80, 0x10000)) if _script(c) in _SHARING)
_RIVAL = re.compile(f"[{RIVALS}力工口卜二八夕{_CLAIMING}]")
_KANJI = re.compile("[\u3040-\u30ff\u4e00-\u9fff]")
_ALIKE = re.compile("[" + "".join(CLASSES) + "]")
#: Composed letters with their base and accents, where the base has look-alikes: ``ё`` and ``ë`` are of one shape.
_APART = {
    ord(c): d for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in CLASSES and all("\u0300" <= x <= "\u036f" for x in d[1:])
}


def _bigrams() -> dict[str, tuple[dict[str, float], dict[str, float]]]:
    """Log-probabilities of a letter after another in each script's seed text, a space being the edge of a word, and of one never seen after it."""
    out = {}
    for script, text in SEED.items():
        text = f" {text} "
        pairs, firsts = Counter(zip(text, text[1:])), Counter(text[:-1])
        kinds = len(firsts)
        seen = {a + b: math.log((n + 0.5) / (firsts[a] + 0.5 * kinds)) for (a, b), n in pairs.items()}
        out[script] = seen, {a: math.log(0.5 / (n + 0.5 * kinds)) for a, n in firsts.items()} | {"": math.log(1 / kinds)}
    return out


BIGRAMS = _bigrams()
#: What a change of script costs, above any score of letters; the score of a letter in scripts without a seed; what letters of the whole text count beside those of the line; what no evidence at all counts.
_SWITCH, _UNKNOWN, _FAR, _NONE = 1e4, -4.0, 0.05, 0.02


def _gain(script: str, a: str, b: str) -> float:
    if script not in BIGRAMS:
        return _UNKNOWN
    seen, never = BIGRAMS[script]
    return seen[a + b] if a + b in seen else never.get(a, never[""])


Prior = tuple[tuple[str, float], ...]


def _search(word: str, prior: Prior) -> str:
    weight = dict(prior)
    own = {_script(x) for x in word if x not in CLASSES and not unicodedata.combining(x)}
    scores: dict[tuple[str, str], float] = {("", ""): 0.0}
    steps: list[dict[tuple[str, str], tuple[tuple[str, str], str]]] = []  # for each letter, where its states come from
    for x in word:
        if unicodedata.combining(x):
            steps.append({key: (key, x) for key in scores})
            continue
        every = [(c, s) for s, c in {_script(c): c for c in reversed(CLASSES.get(x, x))}.items()][::-1]  # the plainest letter of each script
        choices = [o for o in every if o[1] in weight or o[1] in own] or every
        new: dict[tuple[str, str], float] = {}
        back: dict[tuple[str, str], tuple[tuple[str, str], str]] = {}
        for key, score in scores.items():
            last, script = key
            for place, (c, s) in enumerate(choices):
                value = score - place * 1e-6 + _gain(s, last.lower() if s == script else " ", c.lower())
                value += weight.get(s, 0.0) if not script else -_SWITCH if s != script else 0.0
                if (c, s) not in new or value > new[c, s]:
                    new[c, s], back[c, s] = value, (key, c)
        scores = new
        steps.append(back)
    at = max(scores, key=lambda k: (scores[k] + (_gain(k[1], k[0].lower(), " ") if k[1] else 0.0), k))
    out = []
    for back in reversed(steps):
        at, c = back[at]
        out.append(c)
    return "".join(reversed(out))


_remembered = lru_cache(maxsize=65536)(_search)


def decode(word: str, prior: Prior = (("latin", 0.0),)) -> str:
    """The best reading of a run of letters: fewest changes of script, then the greatest sum of ``prior`` and bigrams, then the plainest letters.

    ``prior`` has the log-weight of each script that may claim letters of other scripts' shapes. A script outside it is
    read only where the word holds one of its unmistakable letters, or where the shape belongs to no script in it.
    Options depend on shapes alone. Marks that combine go with the letter before. The time is linear in the length.
    """
    return _remembered(word, prior) if len(word) <= 64 else _search(word, prior)


def _evidence(text: str) -> Counter:
    """How many unmistakable letters of each script a text has."""
    out: Counter = Counter()
    for c, n in Counter(text).items():
        if c not in CLASSES and c.isalpha():
            s = _script(unicodedata.normalize("NFD", c)[0])
            if s == "latin" or s in _SHARING or s in ("han", "katakana", "hiragana"):
                out[s] += n
    return out


def readings(text: str) -> str:
    """Every run of letters of a folded text, with base letters and accents apart, in its best reading; the length stays."""
    far = _evidence(text)
    sharing = [s for s in _SHARING if far[s]]
    kanji = _KANJI.search(text) is not None
    scripts = ("latin", *sharing, *(("han", "katakana", "hiragana") if kanji else ()))
    out = []
    for line in text.split("\n"):
        if _ALIKE.search(line):
            near = _evidence(line) if len(scripts) > 1 else {}
            total = [near.get(s, 0) + _FAR * far[s] + _NONE for s in scripts]
            prior = tuple((s, round(math.log(n / sum(total)), 1)) for s, n in zip(scripts, total))
            line = _WORD.sub(lambda m, prior=prior: decode(m[0], prior) if _ALIKE.search(m[0]) else m[0], line)
        out.append(line)
    return "\n".join(out)


def _folded(m: re.Match) -> str:
    return FOLDS.get(ord(m[0]), m[0])


def _apart(m: re.Match) -> str:
    return m[0].translate(_APART)


def consistent(text: str) -> str:
    """The consistent form of ``text``; equal for texts that look the same. Empty text gives empty text."""
    if _ODD.search(text) is None:
        return text
    text = unicodedata.normalize("NFC", _FOLD.sub(_folded, _GONE.sub("", text)))
    if _RIVAL.search(text):
        text = unicodedata.normalize("NFC", readings(_WORD.sub(_apart, text)))
    return text


_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c)))
_SPLIT = "".join(chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4 and unicodedata.normalize("NFC", chr(c)) != chr(c))
_SKIP = f"[{IGNORABLE}]*"
#: Stored characters that don't stand for themselves one by one: composed sequences, folded ones and invisible ones.
_PLAIN_CHUNK = (
    f"[\u1100-\u115e\ua960-\ua97c](?:{_SKIP}[\u1161-\u11a7](?:{_SKIP}[\u11a8-\u11ff])?)?|[가-힣]{_SKIP}[\u11a8-\u11ff]|[{IGNORABLE}]+|{_FOLD.pattern}|[{_SPLIT}]"
)
_CHUNK = re.compile(_PLAIN_CHUNK)
_MARKED_CHUNK = re.compile(f"[^{_MARKS}{IGNORABLE}](?:{_SKIP}[{_MARKS}])+|[{_MARKS}](?:{_SKIP}[{_MARKS}])*|{_PLAIN_CHUNK}", re.S)
_MARK = re.compile(f"[{_MARKS}]")
_COMPOSED = re.compile(f"[^{_MARKS}][{_MARKS}]*|[{_MARKS}]+", re.S)


def consistent_spans(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The consistent form with, for every character of it, where the stored characters it stands for begin and end.

    The lists are None where both texts have equal length and positions.
    """
    if _ODD.search(text) is None:
        return text, None, None
    parts, starts, ends, last, moved = [], [], [], 0, False
    for m in (_MARKED_CHUNK if _MARK.search(text) else _CHUNK).finditer(text):
        a, b = m.span()
        part = unicodedata.normalize("NFC", _FOLD.sub(_folded, _GONE.sub("", m[0])))
        if len(part) == 1 and b - a == 1:
            if part == m[0]:
                continue
            parts += [text[last:a], part]
            if moved:
                starts += range(last, b)
                ends += range(last + 1, b + 1)
            last = b
            continue
        if not moved:
            moved = True
            starts, ends = list(range(last)), list(range(1, last + 1))
        starts += range(last, a)
        ends += range(last + 1, a + 1)
        starts += [a] * len(part)
        ends += [b] * len(part)
        parts += [text[last:a], part]
        last = b
    parts.append(text[last:])
    if moved:
        starts += range(last, len(text))
        ends += range(last + 1, len(text) + 1)
    form = "".join(parts)
    if _RIVAL.search(form):
        apart = _WORD.sub(_apart, form)
        if len(apart) != len(form):  # base and accents stand where their letter stood
            index, last = [], 0
            for m in _WORD.finditer(form):
                index += range(last, m.start())
                for k, c in enumerate(m[0], m.start()):
                    index += [k] * len(_APART.get(ord(c), c))
                last = m.end()
            index += range(last, len(form))
            starts, ends = ([starts[k] for k in index], [ends[k] for k in index]) if moved else (index, [k + 1 for k in index])
            form, moved = apart, True
        form = readings(form)
        if not unicodedata.is_normalized("NFC", form):  # a letter read in another script may compose with the mark after it
            starts, ends = (starts, ends) if moved else (list(range(len(form))), list(range(1, len(form) + 1)))
            moved, parts, firsts, lasts = True, [], [], []
            for m in _COMPOSED.finditer(form):
                part = unicodedata.normalize("NFC", m[0])
                parts.append(part)
                firsts += [starts[m.start()]] * len(part)
                lasts += [ends[m.end() - 1]] * len(part)
            form, starts, ends = "".join(parts), firsts, lasts
    return (form, starts, ends) if moved else (form, None, None)


def consistent_text(df: DataFrame, column: str, to: str = "form") -> DataFrame:
    """``df`` with ``to``, the consistent form of ``column``; null stays null. Other columns are kept as they are.

    A column called ``to`` is replaced.
    """
    @F.pandas_udf("string")
    def form(texts):
        return texts.map(consistent, na_action="ignore")

    return df.withColumn(to, form(F.col(column)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, form = [], []
        for body in batch.column("body").to_pylist():
            same = consistent(body)
            raw.append(xxhash.xxh3_128_digest(body.encode("utf-8", "surrogatepass")))
            form.append(raw[-1] if same is body else xxhash.xxh3_128_digest(same.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("row_id"), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], ["src", "row_id", "form", "raw"])


def look_digests(bodies: DataFrame) -> DataFrame:
    """``(src, row_id, form, raw)`` of ``(src, row_id, body)``: 128-bit digests of the consistent form and of the body.

    Rows with a null body are left out. Only digests leave the tasks, never texts.
    """
    rows = bodies.select("src", "row_id", "body").where(F.col("body").isNotNull())
    return rows.mapInArrow(_digests, "src string, row_id bigint, form binary, raw binary")


def look_classes(digests: DataFrame) -> DataFrame:
    """One row per record of ``look_digests``: ``(src, row_id, class_id, n_forms)``, with the number of different bodies of the same looks.

    ``class_id`` is the digest of the looks in hexadecimal digits. Records with a null id are left out.
    """
    rows = digests.where(F.col("row_id").isNotNull()).distinct()
    sizes = rows.groupBy("src", "form", "raw").agg(F.lit(1).alias("one")).groupBy("src", "form").agg(F.count("one").alias("n_forms"))
    return rows.join(sizes, ["src", "form"]).select("src", "row_id", F.lower(F.hex("form")).alias("class_id"), "n_forms").distinct()


def look_alike_pairs(digests: DataFrame) -> DataFrame:
    """``(src, id_a, id_b)``, ``id_a < id_b``, of records of ``look_digests`` that look the same and differ in characters.

    Only classes with at least two different bodies reach the join, found by a map-side combined aggregate, and exact
    copies are never paired with each other. A class may be of any size: the join is by the digest of its looks and
    adaptive execution splits a large one. Records with a null id or body give no pair; repeated rows count once.
    """
    digests = digests.where(F.col("row_id").isNotNull())
    mixed = digests.groupBy("src", "form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("src", "form")
    members = digests.join(mixed, ["src", "form"], "left_semi").distinct()
    a = members.select("src", "form", F.col("row_id").alias("id_a"), F.col("raw").alias("raw_a"))
    b = members.select("src", "form", F.col("row_id").alias("id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["src", "form"]).where("id_a < id_b AND raw_a <> raw_b").select("src", "id_a", "id_b").distinct()


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The digests of both article tables, folded once and kept in the shared folder."""
    return materialize(look_digests(records(spark, folder)), "looks")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the same table that look the same but differ in characters, see TESTDATA.md."""
    return look_alike_pairs(_stored(spark, folder))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with the class of its looks and the number of different bodies in it."""
    return look_classes(_stored(spark, folder))


def p2_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every body of both article tables that isn't blank."""
    return consistent_text(records(spark, folder), "body").select("src", "row_id", "form").distinct()


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_consistent": p2_consistent}
ORACLES: dict[str, str] = {}
