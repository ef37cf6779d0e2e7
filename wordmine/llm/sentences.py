"""Sentence units of documents in any script.

A pushdown automaton reads the marks of each paragraph: openings of quotations and brackets are pushed, closings pop
the innermost opening of their kind, and what stays open in a paragraph never counted. Labels at the beginning of
lines open list levels: the first label of a kind is pushed, the next one of a level pops all levels inside it, and a
level counts once it has two items; each of its items begins a unit. Terminators end a unit on the ground level only, after tests against a trie of abbreviations, numbers, dates, addresses and list labels; a
quotation that holds a whole sentence may end one when it closes. Scripts bring their own terminators, and Thai its
spaces. Text is read in its consistent form, so width, kinds of dots and invisible characters make no difference, and
offsets are given in the text as stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.llm.lookalike import consistent_spans
from wordmine.llm.records import records

#: Abbreviations, those that a sentence may end with, and marks.
ABBREVIATIONS = (
    "Mr Mrs Ms Mx Dr Prof Rev Hon Sr Jr St Ste Mt Ft No Nos Vol Vols Art Sec Ch Fig Eq pp p vs v cf viz al ca approx est dept "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun "
    "Gen Col Maj Capt Lt Sgt Cpl Adm Gov Sen Rep Pres Supt Inc Ltd Co Corp Bros Ave Blvd Rd Ln Hwy Sq Bldg Apt e.g i.e "
    "डॉ प्रो श्री श्रीमती पं कु सं बजे г ул стр z.B d.h bzw M Mme Sra Sig"
)
MAY_END = ("a.m", "p.m", "etc", "Inc", "Ltd", "Co", "Corp", "Jr", "Sr", "Bros", "al")
TERMINATORS = "。।॥։؟۔።᙮꓿︒｡\u17d4\u17d5\u104b\u0f0d\u0f0e\u1803\u1809"
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "“": "”", "‘": "’", "«": "»", '"': '"', "'": "'"}
FINAL_SYLLABLES = "다요죠까네오라자"
SYLLABLES = "가나다라마바사아자차카타파하"
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()

_CLOSERS = {c: o for o, c in PAIRS.items()}
_QUOTES = "”’」』»\"'"
_EVENT = re.compile("[" + re.escape(".!?" + TERMINATORS + "".join(PAIRS) + "".join(_CLOSERS)) + "]")
_BREAK = re.compile(r"(?:\r\n|\n|\r(?!\n))[^\S\r\n]*(?:\r\n|\n|\r)\s*")
#: A label at the beginning of a line: number, syllable, letters or circled number with its marks, or a bullet.
_LABEL = re.compile(rf"(?m)^[ \t]*(?:(?P<open>\(?)(?P<name>\d{{1,3}}|[{SYLLABLES}]|[ivx]{{1,5}}|[IVX]{{1,5}}|[A-Za-z])(?P<close>[.)])|(?P<ring>[①-⑳])|(?P<bullet>[-·*○●◦]))(?=[ \t]+(?!\d+\.)\S)")
#: Labels that follow each other at the beginning of a unit, up to the mark of the last one.
_LABELS = re.compile(rf"(?:\(?(?:\d{{1,3}}|[{SYLLABLES}]|[ivx]{{1,5}}|[A-Za-z])[.)]\s*|[①-⑳]\s*)*(?:\d{{1,3}}|[{SYLLABLES}]|[ivx]{{1,5}}|[a-z])")
_DATE = re.compile(r"(?<!\d)(?:\d{4}|['’]\d\d)\.[ \t\r\n]{0,2}\d{1,2}\.(?:[ \t\r\n]{0,2}\d{1,2}\.)?")
_THAI_SPACE = re.compile("(?<=[฀-๿])[ \t\r\n]+|[ \t\r\n]+(?=[฀-๿])")
_THAI = re.compile("[฀-๿]")


def _trie(words: str) -> dict:
    """Words by their letters from the last to the first; ``""`` marks a beginning."""
    root: dict = {}
    for word in words.split():
        for form in {word, word.upper(), word.capitalize()} if word.isascii() else {word}:
            node = root
            for ch in reversed(form):
                node = node.setdefault(ch, {})
            node[""] = form
    return root


_ABBREVIATIONS = _trie(ABBREVIATIONS + " " + " ".join(MAY_END))
_MAY_END = {w.lower() for w in MAY_END}


def abbreviation(text: str, dot: int, low: int) -> str | None:
    """The abbreviation or initial that ends before ``dot``, or None. It has to begin a word."""
    node, i, found = _ABBREVIATIONS, dot - 1, None
    while i >= low and text[i] in node:
        node = node[text[i]]
        if "" in node and (i == low or not (text[i - 1].isalnum() or text[i - 1] == ".")):
            found = node[""]
        i -= 1
    if found is None and dot - 1 >= low and "A" <= text[dot - 1] <= "Z" and (dot - 2 < low or not text[dot - 2].isalnum()):
        return text[dot - 1]
    if found is None and dot - 2 >= low and text[dot - 1].isascii() and text[dot - 1].isalpha() and text[dot - 2] == "." and text[dot - 3 : dot - 2].isalpha():
        return text[dot - 3 : dot]
    return found


def _plain(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()


def _ends_dot(text: str, i: int, j: int, low: int, high: int, unit: int) -> bool:
    """Whether the dots ``text[i:j]`` end a sentence on the ground level; ``unit`` is where the present one begins."""
    before = text[i - 1] if i > low else ""
    after = text[j] if j < high else ""
    if not after:
        return True
    space = after.isspace()
    k = j
    while k < high and text[k].isspace():
        k += 1
    then = text[k] if k < high else ""
    if not then:
        return True
    if j - i > 1:
        return before in FINAL_SYLLABLES and before != "" or space and before.isalpha() and then.isupper()
    if not before or before.isspace():
        return False
    if not space:
        if after in ",;:)]}>”’\"'/@-":
            return False
        if _plain(before) and _plain(after):
            k = i
            while k > low and text[k - 1].isalpha():
                k -= 1
            return before.islower() and after.isupper() and text[j + 1 : j + 2].islower() and i - k > 1 and (k == low or text[k - 1].isspace())
        if before.isdigit() and (after.isdigit() or "가" <= after <= "힣"):
            return False
        if _plain(before) and abbreviation(text, i, unit):
            return False
        return True
    if i - unit < 40 and _LABELS.fullmatch(text[unit:i].strip()):
        return False
    if before.isdigit():
        return not then.isdigit()
    found = abbreviation(text, i, unit)
    if found:
        return found.lower() in _MAY_END and then.isupper()
    if before.isascii() and before.isalpha() and then.islower() and then.isascii():
        return False
    return True


def _ends_mark(text: str, i: int, j: int, low: int, high: int) -> bool:
    """Whether exclamation and question marks ``text[i:j]`` end a sentence on the ground level."""
    before = text[i - 1] if i > low else ""
    after = text[j] if j < high else ""
    if after in (",", "、", ";") and after:
        return False
    return not (before and after and (_plain(before) or before in "/=&") and (_plain(after) or after in "=&"))


def _ends_quote(text: str, last: int, at: int, high: int) -> bool:
    """Whether a quotation that closed at ``at`` with a terminator at ``last`` ends the sentence around it."""
    after = text[at + 1] if at + 1 < high else ""
    if not after:
        return True
    if text[at] not in _QUOTES:
        return False
    if not after.isspace():
        return text[last] in "。!?" and ("一" <= after <= "鿿" or text[last] == "。" and not after.isalpha() and after not in "，、,") and text[at] in "”’"
    k = at + 1
    while k < high and text[k].isspace():
        k += 1
    then = text[k] if k < high else ""
    return not then or text[last] in ".!?" and then.isascii() and then.isupper()


def _nesting(text: str, low: int, high: int, marks: list[int]) -> dict[int, int]:
    """Openings with their closings in ``text[low:high]``; what isn't closed, or opened, isn't there."""
    stack: list[int] = []
    pairs: dict[int, int] = {}
    for i in marks:
        ch = text[i]
        before = text[i - 1] if i > low else " "
        after = text[i + 1] if i + 1 < high else " "
        if ch in "'’" and before.isalnum() and after.isalnum() and before.isascii() and after.isascii():
            continue
        if ch in "\"'":
            held = next((k for k in reversed(stack) if text[k] == ch), None)
            if held is None:
                if not after.isspace() and (not before.isalnum() or ch == '"'):
                    stack.append(i)
                continue
            while stack[-1] != held:
                stack.pop()
            pairs[stack.pop()] = i
        elif ch in PAIRS:
            stack.append(i)
        else:
            opener = _CLOSERS[ch]
            held = next((k for k in reversed(stack) if text[k] == opener), None)
            if held is not None:
                while stack[-1] != held:
                    stack.pop()
                pairs[stack.pop()] = i
    return pairs


def _ordinals(m: re.Match) -> list[tuple[str, int]]:
    """What a label may be: its kind with marks, and its place in the order of that kind, 1 for the first."""
    if m["bullet"]:
        return [(m["bullet"], 0)]
    if m["ring"]:
        return [("ring", ord(m["ring"]) - ord("①") + 1)]
    name, marks = m["name"], m["open"] + m["close"]
    if name.isdigit():
        return [("digit" + marks, int(name))]
    if name in SYLLABLES:
        return [("syllable" + marks, SYLLABLES.index(name) + 1)]
    case = "upper" if name.isupper() else "lower"
    out = [(f"roman {case}{marks}", ROMAN.index(name.lower()) + 1)] if name.lower() in ROMAN else []
    return out + ([(f"letter {case}{marks}", ord(name.lower()) - 96)] if len(name) == 1 else [])


def list_items(text: str, low: int, high: int) -> dict[int, tuple[int, int]]:
    """Where items of a paragraph's lists begin, each with the end of its label and its level, 0 for the outermost.

    Labels open, continue and close levels on a stack; a label that does none of these is text. A level of a single
    item doesn't count, and a bullet after an unfinished line opens none.
    """
    stack: list[list] = []  # kind, last place, begin and end of the first label, whether it counts
    out: dict[int, tuple[int, int]] = {}
    for m in _LABEL.finditer(text, low, high):
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        ways = _ordinals(m)
        if m["bullet"] and all(kind != m["bullet"] for kind, *_ in stack):
            k = begin - 1
            while k >= low and text[k].isspace():
                k -= 1
            if k >= low and text[k].isalnum():
                continue
        held = next((d for d in range(len(stack) - 1, -1, -1) for kind, n in ways if stack[d][0] == kind and (n == 0 or n == stack[d][1] + 1)), None)
        if held is not None:
            del stack[held + 1 :]
            level = stack[held]
            level[1] = next(n for kind, n in ways if kind == level[0])
            out[level[2]] = level[3], held
            out[begin] = m.end(), held
        else:
            first = next((w for w in ways if w[1] <= 1), None)
            if first is not None:
                stack.append([*first, begin, m.end()])
    return dict(sorted(out.items()))


def _outside(items: dict[int, int], pairs: dict[int, int]) -> dict[int, int]:
    """The items that begin outside of all brackets and quotations."""
    out, ends, opens, k = {}, -1, sorted(pairs), 0
    for at in sorted(items):
        while k < len(opens) and opens[k] < at:
            ends, k = max(ends, pairs[opens[k]]), k + 1
        if at > ends:
            out[at] = items[at]
    return out


def _paragraph(text: str, low: int, high: int, out: list[tuple[int, int]]) -> None:
    cuts: list[int] = []
    marks = [m.start() for m in _EVENT.finditer(text, low, high)]
    labels = _LABEL.search(text, low, high) is not None
    if marks or labels:
        nested = [i for i in marks if text[i] in PAIRS or text[i] in _CLOSERS]
        pairs = _nesting(text, low, high, nested) if nested else {}
        items: dict[int, int] = {}
        if labels:
            items = _outside({at: end for at, (end, _) in list_items(text, low, high).items()}, pairs)
            cuts += [at for at in items if at > low]
        dates = {i for at, end in items.items() for i in range(at, end)} | {i for m in _DATE.finditer(text, low, high) for i in range(m.start(), m.end()) if text[i] == "."}
        unit, until, last, skip = low, -1, -1, -1
        closings, begins, held = set(pairs.values()), list(items), 0
        for i in marks:
            ch = text[i]
            if i < skip:
                continue
            while held < len(begins) and begins[held] <= i:
                unit, held = max(unit, begins[held]), held + 1
            if i < until:  # inside: remember the last terminator, for when the quotation closes
                if ch in ".!?" or ch in TERMINATORS:
                    last = i
                continue
            if i == until:
                inner = text[i - 1] if i > low else ""
                if last == i - 1 and inner != "" and _ends_quote(text, last, i, high):
                    cuts.append(i + 1)
                    unit = i + 1
                until = -1
                continue
            if ch in PAIRS and i in pairs:
                until, last = pairs[i], -1
                continue
            if ch in PAIRS or ch in _CLOSERS:
                continue
            j = i + 1
            if ch == ".":
                while j < high and text[j] == ".":
                    j += 1
                if j < high and text[j] in "!?":
                    skip = j
                    continue
                skip = j
                ends = i not in dates and _ends_dot(text, i, j, low, high, unit)
            elif ch in "!?":
                while j < high and text[j] in "!?.":
                    j += 1
                skip = j
                ends = _ends_mark(text, i, j, low, high)
            else:
                while j < high and text[j] in TERMINATORS:
                    j += 1
                skip = j
                ends = True
            if ends:
                while j < high and (text[j] in _CLOSERS and text[j] not in PAIRS and j not in closings):
                    j += 1
                cuts.append(j)
                unit = j
    if _THAI.search(text, low, high):
        for m in _THAI_SPACE.finditer(text, low, high):
            before = text[m.start() - 1] if m.start() > low else " "
            after = text[m.end()] if m.end() < high else " "
            if not before.isdigit() and not after.isdigit() and before not in "%.,":
                cuts.append(m.start())
    cuts.sort()
    begin = low
    for cut in [*cuts, high]:
        a, b = begin, cut
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        begin = cut


def sentence_spans(body: str | None) -> list[tuple[int, int]]:
    """Begin and end of each unit of a body, in order and in characters of the body as stored; none for null or blank ones."""
    if not body:
        return []
    text, starts, ends = consistent_spans(body)
    spans: list[tuple[int, int]] = []
    low = 0
    for m in _BREAK.finditer(text):
        _paragraph(text, low, m.start(), spans)
        low = m.end()
    _paragraph(text, low, len(text), spans)
    return spans if starts is None else [(starts[a], ends[b - 1]) for a, b in spans]


def sentence_units(bodies: DataFrame) -> DataFrame:
    """``(src, row_id, start_pos, end_pos)`` of every unit of ``(src, row_id, body)``.

    Null, empty and blank bodies give no row; repeated rows give their units once. Whole bodies are read, of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [sentence_spans(body) for body in batch.column("body").to_pylist()]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("src"), batch.column("row_id"), pa.array([[a for a, _ in s] for s in spans], kind), pa.array([[b for _, b in s] for s in spans], kind)],
                ["src", "row_id", "begins", "ends"],
            )

    schema = "src string, row_id bigint, begins array<bigint>, ends array<bigint>"
    found = bodies.select("src", "row_id", "body").where("body IS NOT NULL").mapInArrow(run, schema).distinct()
    each = found.select("src", "row_id", F.explode(F.arrays_zip("begins", "ends")).alias("x"))
    return each.select("src", "row_id", F.col("x.begins").alias("start_pos"), F.col("x.ends").alias("end_pos"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of both article tables, see TESTDATA.md."""
    return sentence_units(records(spark, folder))


QUERIES = {"p4_found": p4_found}
ORACLES: dict[str, str] = {}
