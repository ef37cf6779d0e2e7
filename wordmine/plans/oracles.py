"""DuckDB SQL of the core's queries, written on its own from the definitions of the operators."""

from __future__ import annotations

WORD, SPACE = r"\p{L}\p{N}_", r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
_URL = rf"(?:http|ftp|https)://(?:[-{WORD}.]|%[0-9a-fA-F]{{2}})+"


def _sub(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def _without_numbers(x: str) -> str:
    """Runs of digits that stand alone, with the white space after them, taken out of the runs of word characters and of others."""
    pieces = f"regexp_extract_all({x}, '[{WORD}]+|[^{WORD}]+')"
    number = lambda i: f"regexp_full_match(l[{i}], '[0-9]+')"
    kept = f"CASE WHEN {number('i')} THEN '' WHEN i > 1 AND {number('i - 1')} THEN regexp_replace(l[i], '^[{SPACE}]+', '') ELSE l[i] END"
    return f"(SELECT array_to_string(list_transform(range(1, len(l) + 1), lambda i: {kept}), '') FROM (SELECT {pieces} AS l))"


def _cleaned(x: str, profile: str) -> str:
    keep = {"strict": "-/.", "search": "-/.&*+%$", "elbow": "-/.&*+%$"}.get(profile, "-/.()&*+%$")
    lines = profile not in ("elbow", "article")
    x = f"replace(coalesce({x}, ''), chr(160), ' ')"
    if profile in ("strict", "bracketed", "discovery"):
        x = _sub(x, (rf"\A[{SPACE}]+", ""), (rf"[{SPACE}]+\z", ""))
    x = _sub(x, (_EMAIL, " "))
    if not lines:
        x = _sub(x, (r"<script[^\n]*script>", " "))
    x = _sub(x, (_URL, " "), ("[ㄱ-ㅎㅏ-ㅣ]+", " "), ("<[^>]*>", " "), (f"[^{keep}{WORD}{SPACE}]", " "))
    if profile in ("search", "discovery"):
        x = _sub(x, (r"([가-힣][^\n][가-힣]*)\.", r"\1. "))
    if profile == "bracketed":
        x = _sub(x, (r"([ㄱ-ㅎ|ㅏ-ㅣ|가-힣][^\n][ㄱ-ㅎ|ㅏ-ㅣ|가-힣]*)\.", r"\1 "))
    if lines:
        x = _sub(x, (r"(?m)^[ \t]+", ""), (r"[ \t]+:", ":"))
    x = _sub(x, (r"[\n\t\r]", " "))
    if profile in ("strict", "bracketed"):
        x = f"upper({_without_numbers(x)})"
    if profile == "discovery":
        x = _sub(x, ("[0-9]+[개층위건만억조원년월일]", ""), (r"[0-9]+[^\n][0-9]+%", ""))
    x = _sub(x, (" +", " "))
    if profile in ("search", "discovery"):
        x = f"upper({_sub(x, (r'\(\)', ' '))})"
    return x


def _count(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, {word}, ''))) // length({word}))"


def _docs(profile: str = "search") -> str:
    return f"docs AS MATERIALIZED (SELECT doc_id, {_cleaned('text', profile)} AS clean FROM documents)"


_PIECES = "pieces AS MATERIALIZED (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT doc_id, string_split(clean, ' ') AS l FROM docs))"


def _tokens(least: int = 2, profile: str = "search") -> str:
    return f"{_docs(profile)}, {_PIECES}, toks AS MATERIALIZED (SELECT * FROM pieces WHERE length(regexp_replace(token, '[0-9]+', '-', 'g')) >= {least}), vocab AS MATERIALIZED (SELECT token, count(*) AS n FROM toks GROUP BY token)"


_GROW = """bare AS (SELECT token, n, regexp_replace(token, '\\.$', '') AS t FROM vocab),
forms0 AS (SELECT token, n, unnest(list_transform(range(2, length(t) + 1), lambda i: left(t, i))) AS prefix, t FROM bare),
forms AS MATERIALIZED (SELECT token, n, length(prefix) AS len, prefix FROM forms0 WHERE length(replace(prefix, '.', '')) > 1 AND left(prefix, 1) <> '.')"""
_WHOLE = "forms WHERE (contains(prefix, '(') = contains(prefix, ')'))"
_PREFIX_FREQ = "pfreq AS MATERIALIZED (SELECT prefix, sum(n)::BIGINT AS freq FROM (SELECT n, unnest(list_transform(range(2, length(token) + 1), lambda i: left(token, i))) AS prefix FROM vocab) GROUP BY prefix)"
_PARTS = """parts AS MATERIALIZED (SELECT DISTINCT token, n, substr(token, i, k) AS part FROM
(SELECT token, n, i, unnest(range(2, length(token) - i + 2)) AS k FROM (SELECT token, n, unnest(range(1, length(token))) AS i FROM vocab)))"""
_NEEDLES = "needles AS (SELECT DISTINCT upper(noun) AS needle FROM nounrank WHERE noun IS NOT NULL)"
_NEEDLE_COUNTS = f"{_docs()}, {_NEEDLES}, held AS MATERIALIZED (SELECT doc_id, needle, clean, {_count('clean', 'needle')} AS n FROM docs, needles WHERE contains(clean, needle))"
_LEXICON = """lex AS (SELECT surface, min(upper(tag)) AS tag FROM lexicon WHERE surface <> '' AND tag IS NOT NULL GROUP BY surface),
nouns AS (SELECT DISTINCT upper(surface) AS noun FROM lex WHERE starts_with(tag, 'N'))"""


def _sents(dots: str) -> str:
    return rf"""sents AS MATERIALIZED (SELECT doc_id, unnest(range(len(l))) AS sent_id, unnest(l) AS sentence FROM (SELECT doc_id,
list_append(regexp_extract_all(clean, '([^\n]*?다\.{dots})', 1), regexp_replace(clean, '[^\n]*?다\.', '', 'g')) AS l FROM docs))"""


def _occurrences(profile: str = "search") -> str:
    return f"""{_docs(profile)}, {_sents('+')}, {_LEXICON},
pattern AS (SELECT string_agg(noun, '|' ORDER BY length(noun) DESC, noun) AS p FROM nouns WHERE length(noun) >= 2),
found AS (SELECT doc_id, sent_id, sentence, regexp_extract_all(sentence, p) AS l FROM sents, pattern),
occ AS MATERIALIZED (SELECT doc_id, sent_id, unnest(range(len(l))) AS pos, unnest(l) AS noun FROM found)"""


_OCC = _occurrences()


_EDGE_TAIL = """sc AS (SELECT doc_id, sent_id, noun, count(*) AS n FROM occ GROUP BY ALL),
edges AS MATERIALIZED (SELECT * FROM (SELECT a.doc_id, a.noun AS src, b.noun AS dst, sum(b.n)::BIGINT - (a.noun = b.noun)::INT AS w FROM sc a JOIN sc b USING (doc_id, sent_id) GROUP BY a.doc_id, a.noun, b.noun) WHERE w > 0)"""


def _edges(profile: str = "search") -> str:
    return f"{_occurrences(profile)}, {_EDGE_TAIL}"


_EDGES = _edges()


def _rank_tail(source: str = "occ") -> str:
    rounds = [
        f"r{k} AS MATERIALIZED (SELECT e.doc_id, e.dst AS noun, sum(r.tr * e.p) AS tr FROM share e JOIN r{k - 1} r ON r.doc_id = e.doc_id AND r.noun = e.src GROUP BY e.doc_id, e.dst)" for k in range(1, 17)
    ]
    return f"""deg AS MATERIALIZED (SELECT doc_id, src, sum(w) AS degree FROM edges GROUP BY ALL),
share AS MATERIALIZED (SELECT doc_id, src, dst, w / degree AS p FROM edges JOIN deg USING (doc_id, src)),
dn AS MATERIALIZED (SELECT doc_id, noun, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS tr FROM (SELECT DISTINCT doc_id, noun FROM {source})),
r0 AS (SELECT dn.* FROM dn JOIN deg ON deg.doc_id = dn.doc_id AND deg.src = dn.noun), {', '.join(rounds)},
ranks AS MATERIALIZED (SELECT doc_id, noun, 0.15 + 0.85 * tr AS tr FROM (SELECT * FROM r16 UNION ALL SELECT dn.* FROM dn ANTI JOIN deg ON deg.doc_id = dn.doc_id AND deg.src = dn.noun))"""


def _ranks(profile: str = "search") -> str:
    return f"{_edges(profile)}, {_rank_tail()}"


_TOTAL = r"""(len(regexp_extract_all(clean, '[\p{L}]+[ .,`''"‘’()]')) + len(regexp_extract_all(clean, '[\p{L}]\z')))"""
_BIGRAMS = "bi AS (SELECT * FROM (SELECT doc_id, sent_id, pos, noun AS a, lead(noun) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS b FROM occ) WHERE b IS NOT NULL)"
_PAIRS = f"""{_BIGRAMS}, seen AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot.s, spot.p) - 1 AS ord, a, b FROM
(SELECT doc_id, a, b, min({{'s': sent_id, 'p': pos}}) AS spot FROM bi GROUP BY ALL)),
pairs AS MATERIALIZED (SELECT * FROM (SELECT s.*, {_count("replace(clean, ' ', '')", 'concat(a, b)')} AS n FROM seen s JOIN docs USING (doc_id)) WHERE n >= 2)"""
_SCORED = f"""{_PAIRS}, base AS (SELECT p.*, {_TOTAL}::DOUBLE AS total, {_count("replace(clean, ' ', '')", 'a')} AS ca, {_count("replace(clean, ' ', '')", 'b')} AS cb FROM pairs p JOIN docs USING (doc_id)),
scored AS MATERIALIZED (SELECT b.doc_id, a, b, n, ln((n / total) / ((ca / total) * (cb / total))) AS pmi, sqrt(ra.tr * rb.tr) * ln((n / total) / ((ca / total) * (cb / total))) AS trpmi
FROM base b JOIN ranks ra ON ra.doc_id = b.doc_id AND ra.noun = b.a JOIN ranks rb ON rb.doc_id = b.doc_id AND rb.noun = b.b)"""
_CLIFF = f"""{_tokens(3)}, {_GROW}, whole AS (SELECT * FROM {_WHOLE}), {_PARTS},
sfreq AS (SELECT part AS prefix, sum(n * {_count('token', 'part')})::BIGINT AS score FROM parts WHERE part IN (SELECT prefix FROM whole) GROUP BY part),
scored AS (SELECT w.token, w.len, w.prefix, s.score, lead(s.score) OVER (PARTITION BY token ORDER BY len) AS after FROM whole w JOIN sfreq s USING (prefix)),
cliffs AS MATERIALIZED (SELECT token, len, prefix, score FROM scored WHERE after IS NULL OR score > after * 1.1)"""
_TRIMS = """forms AS MATERIALIZED (SELECT token, row_number() OVER (PARTITION BY token ORDER BY length(form) DESC) - 1 AS ord, form FROM
(SELECT token, unnest(list_transform(range(2, length(token) + 1), lambda i: left(token, i))) AS form FROM vocab WHERE length(token) >= 3) WHERE NOT ends_with(form, '.') AND NOT ends_with(form, '-'))"""
_LEFT = f"""{_tokens()}, {_TRIMS}, {_PREFIX_FREQ},
walk AS (SELECT token, ord, form, freq, lag(freq) OVER w AS longer, lag(form) OVER w AS form_before FROM forms JOIN pfreq ON form = prefix WINDOW w AS (PARTITION BY token ORDER BY ord)),
hits AS (SELECT *, coalesce(freq < longer * 1.1 AND freq > 1, false) AS hit FROM walk),
heads AS (SELECT token, arg_min(form_before, ord) FILTER (WHERE hit) AS head, arg_max(form, ord) AS shortest FROM hits GROUP BY token)"""
_CHAINS = """marked AS (SELECT doc_id, ord, a, b, sum(CASE WHEN prev = a THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run, ord = max(ord) OVER (PARTITION BY doc_id) AS last FROM
(SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM pairs)),
runs AS (SELECT doc_id, min(ord) AS ord, concat(arg_min(a, ord), ' ', string_agg(b, ' ' ORDER BY ord)) AS words, count(*) AS n, bool_or(last) AS last FROM marked GROUP BY doc_id, run)"""


def _tfidf(formula: str) -> str:
    return f"""WITH {_NEEDLE_COUNTS}, df AS (SELECT needle, count(*) AS df FROM held GROUP BY needle)
SELECT doc_id, needle, round(round({formula} * ln((SELECT count(*) FROM docs)::DOUBLE / df), 12), 9) AS tfidf FROM held JOIN df USING (needle)"""


_ORDER = """d AS (SELECT doc_id, noun, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS ord FROM (SELECT doc_id, noun, min({'s': sent_id, 'p': pos}) AS spot FROM occ GROUP BY ALL)),
m AS (SELECT *, EXISTS (SELECT 1 FROM d o WHERE o.doc_id = d.doc_id AND o.noun <> d.noun AND contains(o.noun, d.noun)) AS included FROM d)"""
#: The morphemes ``ms`` of each ``token`` of the table ``words``, by the longest match of registered words from the left.
_MORPHS = """lexu AS (SELECT upper(surface) AS s, min(tag) AS tag FROM lex GROUP BY ALL),
tagger AS (SELECT string_agg(regexp_escape(s), '|' ORDER BY length(s) DESC, s) AS tp, map_from_entries(list({'k': s, 'v': tag})) AS tags FROM lexu),
cut AS (SELECT token, regexp_extract_all(token, tp) AS l, string_split_regex(token, tp) AS g, tags FROM words, tagger),
morphs AS MATERIALIZED (SELECT token, flatten(list_transform(range(1, len(g) + 1), lambda i: list_concat(CASE WHEN g[i] <> '' THEN [{'s': g[i], 't': 'UNKNOWN'}] ELSE [] END,
CASE WHEN i <= len(l) THEN [{'s': l[i], 't': tags[l[i]]}] ELSE [] END))) AS ms FROM cut)"""
_BANNED_TAGS = "NR NNB VV VA VX VCP VCN MAG MAJ JKS JKC JKG JKO JKB JKQ JX JC EP EF EC ETM XSV XSA XR".split()
_BANNED = lambda t: f"regexp_matches({t}, '{'|'.join(_BANNED_TAGS)}')"
_STRIPPED = f"stripped AS MATERIALIZED (SELECT token, array_to_string(list_transform(ms[1:coalesce(list_max(list_filter(range(1, len(ms) + 1), lambda i: NOT {_BANNED('ms[i].t')})), 0)], lambda m: m.s), '') AS stripped FROM morphs)"
_KNOWN = "len(list_filter(ms, lambda m: m.t = 'UNKNOWN')) = 0"
_SUBSTRINGS = """inner_ AS MATERIALIZED (SELECT DISTINCT token, n, substr(token, i, k) AS part FROM
(SELECT token, n, i, unnest(range(2, length(token) - i + 2)) AS k FROM (SELECT token, n, unnest(range(1, length(token))) AS i FROM vocab)))"""


_BARE_TEXT = "clean"
for _ in range(6):
    _BARE_TEXT = f"regexp_replace({_BARE_TEXT}, '\\([^()]*\\)', '', 'g')"
_BARE_TEXT = f"regexp_replace({_BARE_TEXT}, '[()]', '', 'g')"


def _frequency(needles: str) -> str:
    """The frequency ``freq`` of each ``needle`` of a table in the vocabulary."""
    return f"SELECT part AS needle, sum(n * {_count('token', 'part')})::BIGINT AS freq FROM inner_ WHERE part IN (SELECT needle FROM {needles}) GROUP BY part"


_MUTUAL = """full_ AS (SELECT w.*, f.freq, lag(w.word) OVER o AS bw, lag(f.freq) OVER o AS bf, lead(w.word) OVER o AS aw, lead(f.freq) OVER o AS af
FROM cand w JOIN freq f ON f.needle = w.word WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
mutual AS (SELECT doc_id, word, freq FROM full_ WHERE CASE WHEN coalesce(contains(aw, word), false) THEN freq > af * 1.1
WHEN aw IS NULL OR coalesce(contains(word, bw), false) THEN coalesce(bf * 0.9 < freq, true) ELSE true END)"""


def _report(formula: str, shown: str, least: int) -> str:
    return f"""WITH {_LEFT}, {_LEXICON}, lefts AS (SELECT token, coalesce(head, shortest) AS match FROM heads WHERE coalesce(head, shortest) <> ''),
own AS MATERIALIZED (SELECT DISTINCT doc_id, match FROM toks JOIN lefts USING (token)), words AS (SELECT DISTINCT match AS token FROM own), {_MORPHS}, {_STRIPPED},
reg AS (SELECT w.token AS match, coalesce(arg_max(noun, length(noun)), '') AS registered FROM words w LEFT JOIN nouns ON length(noun) >= 2 AND starts_with(w.token, noun) GROUP BY ALL),
{_SUBSTRINGS}, hit AS MATERIALIZED (SELECT token, part, {_count('token', 'part')} AS k FROM inner_ WHERE part IN (SELECT token FROM words)),
counted AS MATERIALIZED (SELECT doc_id, part AS match, sum(k)::BIGINT AS n FROM toks JOIN hit USING (token) GROUP BY ALL), df AS (SELECT match, count(*) AS df FROM counted GROUP BY match),
scored AS (SELECT o.doc_id, o.match, s.stripped, r.registered, {formula} * ln((SELECT count(*) FROM docs)::DOUBLE / df) AS tfidf FROM own o JOIN counted USING (doc_id, match) JOIN df USING (match)
JOIN stripped s ON s.token = o.match JOIN reg r ON r.match = o.match),
pct AS MATERIALIZED (SELECT *, CASE WHEN length(match) = length(registered) OR tfidf < 3.5 THEN -1 ELSE floor(greatest(length(stripped), length(registered))::DOUBLE / length(match) * 100)::INT END AS pct FROM scored)
{shown.replace('LEAST', str(least))}"""


_CONTEXT = "concat(substr(clean, greatest(place - 10, 1), least(place - 1, 10)), '<', needle, '>', substr(clean, place + length(needle), 10))"
_SPLITTER_TEXT = f"docs AS MATERIALIZED (SELECT _c0 AS doc_id, {_cleaned('NEWS', 'discovery')} AS clean FROM text), {_PIECES}, toks AS (SELECT * FROM pieces WHERE length(regexp_replace(token, '[0-9]+', '-', 'g')) >= 3)"
_INNER = "regexp_replace({}, '\\([^()]*\\)', '', 'g')"
_BARE = "NEWS"
for _ in range(6):
    _BARE = _INNER.format(_BARE)

#: No noun is found more often than its first letter occurs, so that many steps are enough for each.
_TAKEN = """x AS (SELECT doc_id, sent_id, sentence, flatten(list_transform(ns, lambda n: list_transform(range(length(sentence) - length(replace(sentence, left(n, 1), ''))), lambda k: {'rest': n, 'out': []::STRUCT("at" INT, noun VARCHAR)[]}))) AS steps FROM sents JOIN lists USING (doc_id)),
w AS (SELECT doc_id, sent_id, list_reduce(list_concat([{'rest': sentence, 'out': []::STRUCT("at" INT, noun VARCHAR)[]}], steps), lambda a, s: CASE WHEN contains(a.rest, s.rest)
THEN {'rest': concat(left(a.rest, instr(a.rest, s.rest) - 1), substr(a.rest, instr(a.rest, s.rest) + length(s.rest))), 'out': list_append(a.out, {'at': (instr(a.rest, s.rest) - 1)::INT, 'noun': s.rest})} ELSE a END).out AS l FROM x),
o AS (SELECT doc_id, sent_id, l, unnest(range(len(l))) AS step FROM w)"""
_SCORE = lambda n: f"sqrt(ra.tr * rb.tr) * CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE ln(({n} / total) / (({_count('one', 'a')} / total) * ({_count('one', 'b')} / total))) END"
_DISCOVER = f"""WITH {_tokens(3, 'discovery')}, {_GROW}, whole AS (SELECT * FROM {_WHOLE}), {_PARTS}, {_CLIFF[_CLIFF.index('sfreq AS'):]}, {_LEXICON}, {_sents('+')},
own AS (SELECT doc_id, prefix AS noun, min({{'p': pos, 'l': len}}) AS spot FROM toks JOIN cliffs USING (token) GROUP BY ALL), inside AS (SELECT doc_id, string_agg(token, ' ') AS t FROM toks GROUP BY doc_id),
found AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot, noun) - 1 AS ord, noun FROM own JOIN inside USING (doc_id) WHERE {_count('t', 'noun')} >= 2),
lists AS (SELECT doc_id, list(noun ORDER BY included, ord) AS ns FROM (SELECT *, EXISTS (SELECT 1 FROM found z WHERE z.doc_id = f.doc_id AND z.noun <> f.noun AND contains(z.noun, f.noun)) AS included FROM found f) GROUP BY doc_id),
{_TAKEN}, occ AS MATERIALIZED (SELECT doc_id, sent_id, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY l[step + 1].at, step) - 1 AS pos, l[step + 1].noun AS noun FROM o), {_EDGE_TAIL}, {_rank_tail('found')},
texts AS MATERIALIZED (SELECT doc_id, replace(clean, ' ', '') AS one, replace({_BARE_TEXT}, ' ', '') AS two, {_TOTAL}::DOUBLE AS total FROM docs),
met AS (SELECT a.doc_id, a.noun AS a, b.noun AS b, one, total, {_count('one', 'concat(a.noun, b.noun)')} AS n, {_count('two', 'concat(a.noun, b.noun)')} AS more FROM found a JOIN found b USING (doc_id) JOIN texts USING (doc_id) WHERE contains(one, concat(a.noun, b.noun))),
new AS (SELECT m.doc_id, concat(a, ' ', b) AS word FROM met m JOIN ranks ra ON ra.doc_id = m.doc_id AND ra.noun = a JOIN ranks rb ON rb.doc_id = m.doc_id AND rb.noun = b WHERE greatest(n, more) >= 2 AND {_SCORE('n')} >= 0.3),
{_BIGRAMS}, seen AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot.s, spot.p) - 1 AS ord, a, b FROM (SELECT doc_id, a, b, min({{'s': sent_id, 'p': pos}}) AS spot FROM bi GROUP BY ALL)),
counted AS (SELECT s.*, one, total, {_count('one', 'concat(a, b)')} AS n, {_count('two', 'concat(a, b)')} AS more FROM seen s JOIN texts USING (doc_id)),
pairs AS MATERIALIZED (SELECT c.doc_id, ord, a, b FROM counted c JOIN ranks ra ON ra.doc_id = c.doc_id AND ra.noun = a JOIN ranks rb ON rb.doc_id = c.doc_id AND rb.noun = b WHERE greatest(n, more) >= 2 AND {_SCORE('n')} >= 0.3), {_CHAINS}
SELECT doc_id, noun AS word, 'noun' AS method FROM found WHERE noun NOT IN (SELECT noun FROM nouns) UNION SELECT doc_id, word, 'pairs' FROM new UNION SELECT doc_id, words, 'chains' FROM runs"""
_FIRST = f"""SELECT doc_id, match, stripped, registered, pct, concat('...', {_CONTEXT.replace('needle', 'match')}, '...') AS context, round(round(tfidf, 12), 9) AS tfidf
FROM (SELECT p.*, clean, instr(clean, match) AS place FROM pct p JOIN docs USING (doc_id) WHERE pct >= LEAST)"""
_ALL = f""", s AS (SELECT p.*, clean, string_split(clean, match) AS l FROM pct p JOIN docs USING (doc_id) WHERE pct >= LEAST),
o AS (SELECT *, list_sum(list_transform(l[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(match) + 1 AS place FROM (SELECT *, unnest(range(1, len(l))) AS k FROM s))
SELECT doc_id, match, stripped, registered, pct, concat('...', string_agg({_CONTEXT.replace('needle', 'match')}, '...' ORDER BY k), '...') AS context, round(round(tfidf, 12), 9) AS tfidf FROM o GROUP BY ALL"""

_ELBOW = f"""WITH {_tokens(3, 'elbow')}, {_GROW}, {_PREFIX_FREQ},
scored AS (SELECT token, len, prefix, freq AS score, lag(freq) OVER w AS before, coalesce(lead(freq) OVER w, 0.8::DOUBLE * freq) AS after FROM forms JOIN pfreq USING (prefix) WINDOW w AS (PARTITION BY token ORDER BY len)),
chosen AS (SELECT token, prefix FROM scored WHERE CASE WHEN before IS NULL THEN score > after * 1.1 ELSE before - score < score - after END),
own AS (SELECT DISTINCT doc_id, prefix AS noun FROM toks JOIN chosen USING (token)),
np AS (SELECT DISTINCT noun FROM own),
allv AS (SELECT token, count(*) AS n FROM pieces GROUP BY token),
inner_ AS (SELECT DISTINCT token, substr(token, i, k) AS noun FROM (SELECT token, i, unnest(range(2, length(token) - i + 2)) AS k FROM (SELECT token, unnest(range(1, length(token))) AS i FROM allv))),
hit AS (SELECT token, noun, {_count('token', 'noun')} AS k FROM inner_ SEMI JOIN np USING (noun)),
n AS MATERIALIZED (SELECT doc_id, noun, sum(k) AS n FROM pieces JOIN hit USING (token) GROUP BY ALL),
df AS (SELECT noun, count(*) AS df FROM n GROUP BY noun)
SELECT doc_id, noun, round(round(ln(n::DOUBLE + 1) * ln((SELECT count(*) FROM docs)::DOUBLE / df), 12), 9) AS tfidf FROM own JOIN n USING (doc_id, noun) JOIN df USING (noun)
WHERE n >= 2 AND ln(n::DOUBLE + 1) * ln((SELECT count(*) FROM docs)::DOUBLE / df) > 3.5"""

ORACLES = {
    "clean_search": f"SELECT doc_id, {_cleaned('text', 'search')} AS clean FROM documents",
    "clean_elbow": f"SELECT doc_id, {_cleaned('text', 'elbow')} AS clean FROM documents",
    "clean_discovery": f"SELECT doc_id, {_cleaned('text', 'discovery')} AS clean FROM documents",
    "clean_strict": f"SELECT doc_id, {_cleaned('text', 'strict')} AS clean FROM documents",
    "clean_bracketed": f"SELECT doc_id, {_cleaned('text', 'bracketed')} AS clean FROM documents",
    "clean_raw": "SELECT doc_id, regexp_replace(upper(coalesce(text, '')), ' +', ' ', 'g') AS clean FROM documents",
    "clean_article": f"SELECT _c0, {_cleaned('NEWS', 'article')} AS clean FROM text",
    "strip_parens": f"SELECT _c0, regexp_replace({_BARE}, '[()]', '', 'g') AS bare, contains(NEWS, '(') <> contains(NEWS, ')') AS unbalanced FROM text WHERE NEWS IS NOT NULL",
    "wide_longest_cell": """SELECT row_no, list_reduce([coalesce(row_no::VARCHAR, ''), coalesce(URL_CD, ''), coalesce(NEWS_BODY, ''), coalesce(press_cd, '')],
lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) AS cell FROM longtext""",
    "eojeol_tokens": f"WITH {_tokens()} SELECT doc_id, pos, token FROM toks",
    "token_vocab": f"WITH {_tokens()} SELECT token, n FROM vocab",
    "prefixes": f"WITH {_tokens(3)}, {_GROW} SELECT token, len, prefix FROM {_WHOLE}",
    "right_trims": f"WITH {_tokens()}, {_TRIMS} SELECT token, ord, form FROM forms",
    "three_way_splits": f"""WITH {_tokens(3)}, bare AS (SELECT token, regexp_replace(token, '\\.$', '') AS t FROM vocab),
each AS (SELECT token, t, i, unnest(range(i + 1, length(t) + 1)) AS j FROM (SELECT token, t, unnest(range(1, length(t))) AS i FROM bare))
SELECT token, left(t, i - 1) AS lp, substr(t, i, j - i + 1) AS um, substr(t, j + 1) AS rp FROM each""",
    "spacings": """WITH words AS (SELECT DISTINCT surface AS word FROM lexicon WHERE surface <> ''),
masks AS (SELECT word, unnest(range(CASE WHEN length(word) > 12 THEN 1 ELSE (2 ** (length(word) - 1))::BIGINT END)) AS mask FROM words)
SELECT word, array_to_string(list_transform(range(1, length(word) + 1), lambda i: concat(substr(word, i, 1), CASE WHEN i < length(word) AND (mask >> (i - 1)) & 1 = 1 THEN ' ' ELSE '' END)), '') AS way FROM masks""",
    "paren_parts": f"""WITH {_SPLITTER_TEXT}, p AS (SELECT CASE WHEN contains(token, '(') AND contains(token, ')') THEN string_split(substr(token, instr(token, '(') + 1), ')')[1]
WHEN contains(token, '(') THEN substr(token, instr(token, '(') + 1) WHEN contains(token, ')') THEN left(token, length(token) - 1) ELSE token END AS token FROM toks)
SELECT token, count(*) AS n FROM p GROUP BY token""",
    "prefix_freq": f"WITH {_tokens()}, {_PREFIX_FREQ} SELECT prefix, freq FROM pfreq",
    "substring_count": f"WITH {_docs()}, {_NEEDLES} SELECT needle, coalesce(sum({_count('clean', 'needle')}), 0)::BIGINT AS freq FROM needles, docs GROUP BY needle",
    "word_start_rate": f"""WITH {_docs()}, {_NEEDLES}, c AS (SELECT needle, sum({_count('clean', "concat(' ', needle)")}) AS n FROM needles, docs GROUP BY needle)
SELECT needle AS prefix, round(round(n::DOUBLE / (SELECT sum({_count('clean', "' '")}) FROM docs), 15), 9) AS rate FROM c WHERE n > 0""",
    "word_total": f"WITH {_docs()} SELECT doc_id, {_TOTAL}::BIGINT AS words, {_count('clean', "' '")}::BIGINT AS spaces FROM docs",
    "cliff_nouns_multi": f"WITH {_CLIFF} SELECT token, len, prefix, score FROM cliffs",
    "cliff_nouns_first": f"WITH {_CLIFF} SELECT token, min(len) AS len, arg_min(prefix, len) AS prefix, arg_min(score, len) AS score FROM cliffs GROUP BY token",
    "discovered_nouns": f"""WITH {_CLIFF}, own AS (SELECT DISTINCT doc_id, prefix AS noun FROM toks JOIN cliffs USING (token)),
inside AS (SELECT doc_id, string_agg(token, ' ') AS t FROM toks GROUP BY doc_id)
SELECT doc_id, noun FROM own JOIN inside USING (doc_id) WHERE {_count('t', 'noun')} >= 2""",
    "elbow_nouns": _ELBOW,
    "word_file": f"SELECT DISTINCT noun AS word FROM ({_ELBOW})",
    "word_lists": f"SELECT d.doc_id, coalesce(string_agg(DISTINCT noun, ' ' ORDER BY noun), '') AS words FROM documents d LEFT JOIN ({_ELBOW}) e ON e.doc_id = d.doc_id GROUP BY d.doc_id",
    "longest_common_left": f"WITH {_LEFT} SELECT token, coalesce(head, shortest) AS match FROM heads WHERE coalesce(head, shortest) <> ''",
    "longest_common_left_strict": f"WITH {_LEFT} SELECT token, head AS match FROM heads WHERE head <> ''",
    "longest_common_left_rest": f"WITH {_LEFT} SELECT token, substr(token, length(head) + 1) AS match FROM heads WHERE head IS NOT NULL",
    "longest_common_left_chain": f"WITH {_LEFT}, again AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY token ORDER BY ord), false) AS before FROM hits) SELECT token, form_before AS match FROM again WHERE hit AND NOT before",
    "doc_freq": f"WITH {_NEEDLE_COUNTS} SELECT needle, count(*) AS df FROM held GROUP BY needle",
    "tfidf_raw": _tfidf("n::DOUBLE"),
    "tfidf_log": _tfidf("ln(n::DOUBLE + 1)"),
    "tfidf_log_zero": _tfidf("ln(n::DOUBLE + 1)"),
    "kwic_first": f"WITH {_NEEDLE_COUNTS}, p AS (SELECT doc_id, needle, clean, instr(clean, needle) AS place FROM held) SELECT doc_id, needle, concat('...', {_CONTEXT}, '...') AS context FROM p",
    "kwic_all": f"""WITH {_NEEDLE_COUNTS}, s AS (SELECT doc_id, needle, clean, string_split(clean, needle) AS l FROM held),
o AS (SELECT doc_id, needle, clean, k, list_sum(list_transform(l[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(needle) + 1 AS place FROM (SELECT *, unnest(range(1, len(l))) AS k FROM s))
SELECT doc_id, needle, concat('...', string_agg({_CONTEXT}, '...' ORDER BY k), '...') AS context FROM o GROUP BY doc_id, needle""",
    "sentences_closed": f"WITH {_docs()}, {_sents('+')} SELECT doc_id, sent_id, sentence FROM sents",
    "sentences_open": f"WITH {_docs()}, {_sents('*')} SELECT doc_id, sent_id, sentence FROM sents",
    "sentence_nouns": f"WITH {_OCC} SELECT doc_id, sent_id, noun, count(*) AS n FROM occ GROUP BY ALL",
    "cooc_edges": f"WITH {_EDGES} SELECT doc_id, src, dst, w FROM edges",
    "out_degree": f"WITH {_EDGES} SELECT doc_id, src, sum(w)::BIGINT AS degree FROM edges GROUP BY ALL",
    "order_window_edges": f"""WITH {_OCC}, f AS (SELECT doc_id, sent_id, noun, min(pos) AS pos FROM occ GROUP BY ALL)
SELECT a.doc_id, a.noun AS src, b.noun AS dst, count(*) AS w FROM f a JOIN f b USING (doc_id, sent_id) WHERE abs(a.pos - b.pos) <= 8 AND a.noun <> b.noun GROUP BY ALL""",
    "char_window_edges": f"""WITH {_OCC}, gaps AS (SELECT doc_id, sent_id, l, string_split_regex(sentence, p) AS g FROM found, pattern),
k AS (SELECT doc_id, sent_id, l, g, unnest(range(1, len(l) + 1)) AS k FROM gaps),
c AS (SELECT doc_id, sent_id, l[k] AS noun, list_sum(list_transform(g[1:k], lambda t: length(t))) + coalesce(list_sum(list_transform(l[1:k - 1], lambda t: length(t))), 0) AS at FROM k)
SELECT DISTINCT a.doc_id, a.noun AS src, b.noun AS dst FROM c a JOIN c b USING (doc_id, sent_id) WHERE abs(a.at - b.at) <= 10 AND a.noun <> b.noun""",
    "textrank": f"WITH {_ranks()} SELECT doc_id, noun, round(round(tr, 12), 9) AS tr FROM ranks",
    "textrank_edges": f"WITH {_ranks()} SELECT doc_id, noun, round(round(tr, 12), 9) AS tr FROM ranks",
    "bigrams": f"WITH {_OCC}, {_BIGRAMS} SELECT doc_id, sent_id, pos, a, b FROM bi",
    "trigrams": f"""WITH {_OCC}, t AS (SELECT doc_id, noun AS a, lead(noun) OVER w AS b, lead(noun, 2) OVER w AS c FROM occ WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos))
SELECT doc_id, concat(a, ' ', b, ' ', c) AS words, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL""",
    "compound_count": f"WITH {_OCC}, {_PAIRS} SELECT p.doc_id, ord, a, b, n, {_count('clean', 'concat(a, b)')} + {_count('clean', "concat(a, ' ', b)")} AS n_spaced FROM pairs p JOIN docs USING (doc_id)",
    "trpmi": f"WITH {_ranks()}, {_SCORED} SELECT doc_id, a, b, n, round(round(pmi, 12), 9) AS pmi, round(round(trpmi, 12), 9) AS trpmi FROM scored",
    "dup_merge": f"""WITH {_ranks()}, {_SCORED}, m AS (SELECT doc_id, concat(a, b) AS label, count(*) AS n, product(trpmi) AS p, max(trpmi) AS top FROM scored GROUP BY ALL)
SELECT doc_id, label, round(round(CASE WHEN n = 1 THEN top WHEN p < 0 THEN NULL ELSE pow(p, 1.0::DOUBLE / n) END, 12), 9) AS score FROM m""",
    "all_pairs": f"""WITH {_OCC}, d AS (SELECT DISTINCT doc_id, noun FROM occ), bare AS (SELECT doc_id, replace(clean, ' ', '') AS t FROM docs),
c AS (SELECT x.doc_id, x.noun AS a, y.noun AS b, {_count('t', 'concat(x.noun, y.noun)')} AS n FROM d x JOIN d y USING (doc_id) JOIN bare USING (doc_id) WHERE contains(t, concat(x.noun, y.noun)))
SELECT doc_id, a, b, n FROM c WHERE n >= 2""",
    "chain_merge": f"WITH {_OCC}, {_PAIRS}, {_CHAINS} SELECT doc_id, ord, words FROM runs",
    "chain_merge_open": f"WITH {_OCC}, {_PAIRS}, {_CHAINS} SELECT doc_id, ord, words FROM runs WHERE NOT last OR n = 1",
    "suffix_prefix_map": f"WITH {_OCC}, {_PAIRS} SELECT p.doc_id, p.ord AS i, q.ord AS j FROM pairs p JOIN pairs q ON p.doc_id = q.doc_id AND p.b = q.a",
    "included_nouns": f"""WITH {_OCC}, d AS (SELECT DISTINCT doc_id, noun FROM occ)
SELECT doc_id, noun, EXISTS (SELECT 1 FROM d o WHERE o.doc_id = d.doc_id AND o.noun <> d.noun AND contains(o.noun, d.noun)) AS included FROM d""",
    "window_neighbours": f"""WITH {_docs()}, {_PIECES}, {_NEEDLES}, h AS (SELECT needle, doc_id, pos FROM pieces, needles WHERE contains(token, needle)),
l AS (SELECT doc_id, max(pos) AS last FROM pieces GROUP BY doc_id),
a AS (SELECT DISTINCT needle, doc_id, unnest(range(greatest(pos - 2, 0), least(pos + 2, last) + 1)) AS pos FROM h JOIN l USING (doc_id))
SELECT needle AS noun, doc_id, count(*) AS n FROM a GROUP BY ALL""",
    "similarity_rank": f"""WITH {_docs()}, {_PIECES}, {_NEEDLES}, h AS (SELECT needle, doc_id, pos FROM pieces, needles WHERE contains(token, needle)),
a AS (SELECT DISTINCT needle, doc_id, unnest(range(pos - 2, pos + 3)) AS pos FROM h), t AS (SELECT DISTINCT a.needle, token FROM a JOIN pieces USING (doc_id, pos)),
f AS MATERIALIZED (SELECT DISTINCT t.needle AS noun, n.needle AS feature FROM t, needles n WHERE contains(token, n.needle)), s AS (SELECT noun, count(*) AS size FROM f GROUP BY noun),
c AS (SELECT x.noun, y.noun AS other, count(*) AS shared FROM f x JOIN f y USING (feature) GROUP BY ALL),
r AS (SELECT c.noun, other, round(shared / sqrt(s.size::DOUBLE * o.size), 9) AS cosine FROM c JOIN s ON s.noun = c.noun JOIN s o ON o.noun = c.other)
SELECT noun, other, round(cosine, 9) AS cosine, row_number() OVER (PARTITION BY noun ORDER BY cosine DESC, other) AS rank FROM r""",
    "embedding_rank": """WITH c AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS cosine FROM embeddings q, embeddings e
WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) SELECT query_id, vec_id, round(cosine, 9) AS cosine, rank FROM r WHERE rank <= 10""",
    "registered_left": f"""WITH {_tokens()}, {_LEXICON}, h AS (SELECT token, unnest(list_transform(range(2, length(token) + 1), lambda i: left(token, i))) AS noun FROM vocab),
m AS (SELECT token, arg_max(noun, length(noun)) AS noun FROM h JOIN nouns USING (noun) GROUP BY token) SELECT token AS match, coalesce(noun, '') AS registered FROM vocab LEFT JOIN m USING (token)""",
    "registered_filter": f"WITH {_tokens()}, {_LEXICON} SELECT token AS word FROM vocab WHERE token NOT IN (SELECT noun FROM nouns)",
    "unit_filter": f"WITH {_tokens()} SELECT token, n FROM vocab WHERE NOT regexp_matches(token, '[0-9]+[^\\n][0-9]+%|[0-9]+[조억만천원년월달일시분위여건개층][0-9]*|[0-9]+거래일')",
    "plain_sentences": f"""WITH {_docs()}, p AS (SELECT doc_id, string_split(regexp_replace(clean, '([.!?])[ \\t\\n\\x0b\\f\\r]+', concat('\\1', chr(1)), 'g'), chr(1)) AS l FROM docs),
e AS (SELECT doc_id, unnest(range(len(l))) AS sent_id, unnest(l) AS sentence FROM p) SELECT doc_id, sent_id, sentence FROM e WHERE sentence <> ''""",
    "morphemes": f"""WITH {_tokens()}, {_LEXICON}, words AS (SELECT token FROM vocab), {_MORPHS}
SELECT token, array_to_string(list_transform(ms, lambda m: concat(m.s, '/', m.t)), ' ') AS morphs FROM morphs""",
    "particle_filter": f"""WITH {_tokens()}, {_LEXICON}, words AS (SELECT token FROM vocab), {_MORPHS}, l AS (SELECT token, ms, coalesce(ms[-1].t, '') AS t FROM morphs)
SELECT token, {_KNOWN} AS known FROM l WHERE NOT (regexp_matches(t, '^[EJ]') OR contains(t, '+E') OR (contains(t, '+J') AND NOT contains(t, 'ETN'))) AND NOT {_BANNED('t')}""",
    "morph_filters": f"""WITH {_tokens()}, {_LEXICON}, words AS (SELECT token FROM vocab), {_MORPHS}
SELECT token, {_BANNED('ms[-1].t')} AS banned, len(ms) = 1 AND starts_with(ms[1].t, 'N') AS registered, len(ms) = 0 OR regexp_matches(ms[1].t, '^[NVJEX]') AS after_noun,
len(ms) = 1 AND NOT starts_with(ms[1].t, 'S') AND ms[1].t <> 'UNKNOWN' AS single_known FROM morphs""",
    "morph_joins": f"""WITH {_tokens()}, {_LEXICON}, words AS (SELECT token FROM vocab), {_MORPHS},
e AS (SELECT token, ms, i, unnest(range(i, len(ms) + 1)) AS j FROM (SELECT token, ms, unnest(range(1, len(ms) + 1)) AS i FROM morphs))
SELECT token, row_number() OVER (PARTITION BY token ORDER BY i, j) - 1 AS place, array_to_string(list_transform(ms[i:j], lambda m: m.s), '') AS part FROM e""",
    "stripped_words": f"WITH {_tokens()}, {_LEXICON}, words AS (SELECT token FROM vocab), {_MORPHS}, {_STRIPPED} SELECT token, stripped FROM stripped",
    "mutual_inclusion": f"""WITH {_CLIFF}, own AS (SELECT doc_id, prefix AS noun, min({{'p': pos, 'l': len}}) AS spot FROM toks JOIN cliffs USING (token) GROUP BY ALL),
inside AS (SELECT doc_id, string_agg(token, ' ') AS t FROM toks GROUP BY doc_id),
cand AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot, noun) - 1 AS ord, noun AS word FROM own JOIN inside USING (doc_id) WHERE {_count('t', 'noun')} >= 2),
allv AS (SELECT token, count(*) AS n FROM pieces GROUP BY token),
ai AS (SELECT DISTINCT token, n, substr(token, i, k) AS part FROM (SELECT token, n, i, unnest(range(2, length(token) - i + 2)) AS k FROM (SELECT token, n, unnest(range(1, length(token))) AS i FROM allv))),
freq AS (SELECT part AS needle, sum(n * {_count('token', 'part')})::BIGINT AS freq FROM ai WHERE part IN (SELECT word FROM cand) GROUP BY part), {_MUTUAL} SELECT doc_id, word, freq FROM mutual""",
    "compounds": f"""WITH {_ranks('strict')}, {_BIGRAMS}, seen AS (SELECT DISTINCT doc_id, a, b FROM bi),
pairs AS MATERIALIZED (SELECT s.doc_id, a, b, clean, {_count('clean', 'concat(a, b)')} AS n FROM seen s JOIN docs USING (doc_id) WHERE {_count('clean', 'concat(a, b)')} >= 2),
tot AS (SELECT doc_id, count(*)::DOUBLE AS total FROM occ GROUP BY doc_id),
scored AS (SELECT p.doc_id, concat(a, b) AS label, sqrt(ra.tr * rb.tr) * ln((n / total) / (({_count('clean', 'a')} / total) * ({_count('clean', 'b')} / total))) AS trpmi FROM pairs p JOIN tot USING (doc_id)
JOIN ranks ra ON ra.doc_id = p.doc_id AND ra.noun = a JOIN ranks rb ON rb.doc_id = p.doc_id AND rb.noun = b),
m AS (SELECT doc_id, label, CASE WHEN count(*) = 1 THEN max(trpmi) WHEN product(trpmi) < 0 THEN NULL ELSE pow(product(trpmi), 1.0::DOUBLE / count(*)) END AS score FROM scored GROUP BY ALL)
SELECT doc_id, label, round(round(score, 12), 9) AS score FROM m WHERE score > 0.3""",
    "new_words": f"""WITH {_tokens(3, 'bracketed')}, {_LEXICON}, bare AS (SELECT token, regexp_replace(token, '\\.$', '') AS t FROM vocab),
each AS (SELECT token, t, i, unnest(range(i + 1, length(t) + 1)) AS j FROM (SELECT token, t, unnest(range(1, length(t))) AS i FROM bare)),
cuts AS (SELECT token AS doc_id, left(t, i - 1) AS lp, substr(t, i, j - i + 1) AS um, substr(t, j + 1) AS rp FROM each),
unreg AS MATERIALIZED (SELECT * FROM cuts WHERE um NOT IN (SELECT upper(surface) FROM lex WHERE starts_with(tag, 'NN'))),
words AS (SELECT DISTINCT rp AS token FROM unreg WHERE rp <> ''), {_MORPHS}, right_ AS (SELECT token AS rp, ms[1].s AS first FROM morphs WHERE {_KNOWN} UNION ALL SELECT '', ''),
kept AS MATERIALIZED (SELECT doc_id, concat(um, first) AS needle, concat(lp, um) AS word FROM unreg JOIN right_ USING (rp)
WHERE NOT (regexp_matches(lp, '[^\\p{{L}}]$') AND regexp_matches(um, '^[^\\p{{L}}]')) AND NOT (regexp_matches(um, '[^\\p{{L}}]$') AND regexp_matches(rp, '^[^\\p{{L}}]')) AND contains(um, '(') = contains(um, ')')),
{_SUBSTRINGS}, nf AS ({_frequency('kept')}), w AS (SELECT DISTINCT doc_id, word FROM kept JOIN nf USING (needle) WHERE freq >= 2),
cand AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word) - 1 AS ord, word FROM w), wn AS (SELECT DISTINCT word AS needle FROM w), freq AS ({_frequency('wn')}), {_MUTUAL}
SELECT DISTINCT word, freq FROM mutual WHERE word NOT IN (SELECT noun FROM nouns)""",
    "search_report": _report("n::DOUBLE", _ALL, 1),
    "search_report_short": _report("ln(n::DOUBLE + 1)", _FIRST, 0),
    "frequent_starts": f"""WITH {_tokens(3)}, {_GROW}, whole AS (SELECT * FROM {_WHOLE}), started AS (SELECT token, count(*) AS n FROM pieces WHERE pos > 0 GROUP BY token),
sf AS (SELECT prefix, sum(n)::BIGINT AS freq FROM (SELECT n, unnest(list_transform(range(2, length(token) + 1), lambda i: left(token, i))) AS prefix FROM started) GROUP BY prefix),
scored AS (SELECT token, len, prefix, coalesce(freq, 0) AS score, lead(coalesce(freq, 0)) OVER (PARTITION BY token ORDER BY len) AS after FROM whole LEFT JOIN sf USING (prefix)),
hit AS (SELECT token, arg_min(prefix, len) AS prefix, arg_min(score, len) AS score FROM scored WHERE after IS NULL OR score > after * 1.1 GROUP BY token)
SELECT token, prefix, round(round(score::DOUBLE / (SELECT sum({_count('clean', "' '")}) FROM docs), 15), 9) AS rate FROM hit WHERE score >= 2""",
    "top_nouns": f"""WITH {_ranks()}, r AS (SELECT doc_id, noun, round(tr, 9) AS tr FROM ranks), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tr DESC, noun) AS rank FROM r)
SELECT doc_id, noun, round(round(tr, 12), 9) AS tr, rank FROM o WHERE rank <= 10""",
    "first_documents": f"SELECT doc_id, {_cleaned('text', 'search')} AS clean FROM documents ORDER BY doc_id LIMIT 30",
    "corpus_cliffs": f"""WITH docs AS MATERIALIZED (SELECT _c0 AS doc_id, {_cleaned('NEWS', 'search')} AS clean FROM text), {_PIECES},
vocab AS MATERIALIZED (SELECT token, count(*) AS n FROM pieces WHERE length(regexp_replace(token, '[0-9]+', '-', 'g')) >= 3 GROUP BY token), {_GROW}, whole AS MATERIALIZED (SELECT * FROM {_WHOLE}),
refd AS (SELECT {_cleaned('text', 'search')} AS clean FROM documents), refv AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(clean, ' ')) AS token FROM refd) GROUP BY token),
rp AS (SELECT DISTINCT token, n, substr(token, i, k) AS part FROM (SELECT token, n, i, unnest(range(2, length(token) - i + 2)) AS k FROM (SELECT token, n, unnest(range(1, length(token))) AS i FROM refv))),
sf AS (SELECT part AS prefix, sum(n * {_count('token', 'part')})::BIGINT AS score FROM rp WHERE part IN (SELECT prefix FROM whole) GROUP BY part),
scored AS (SELECT token, len, prefix, coalesce(score, 0) AS score, lead(coalesce(score, 0)) OVER (PARTITION BY token ORDER BY len) AS after FROM whole LEFT JOIN sf USING (prefix))
SELECT token, len, prefix, score FROM scored WHERE after IS NULL OR score > after * 1.1""",
    "pmi_fallback": f"""WITH {_OCC}, {_BIGRAMS}, seen AS (SELECT DISTINCT doc_id, a, b FROM bi),
p AS (SELECT s.doc_id, a, b, {_count('clean', 'concat(a, b)')} AS n, {_count('clean', "concat(a, ' ', b)")} AS sp, {_count('clean', 'a')} AS ca, {_count('clean', 'b')} AS cb, {_TOTAL}::DOUBLE AS total FROM seen s JOIN docs USING (doc_id)),
j AS (SELECT *, CASE WHEN n = 0 THEN sp ELSE n END AS joint FROM p)
SELECT doc_id, a, b, n, CASE WHEN joint = 0 THEN 0.0::DOUBLE ELSE round(round(ln((joint / total) / ((ca / total) * (cb / total))), 12), 9) END AS pmi FROM j""",
    "report_file": f"SELECT doc_id, count(*) AS n FROM ({_report('n::DOUBLE', _FIRST, 1)}) GROUP BY doc_id",
    "csv_articles": "SELECT _c0 AS doc_id, regexp_replace(coalesce(NEWS, ''), '\\r\\n?', chr(10), 'g') AS text FROM text",
    "html_article": f"SELECT _c0, {_cleaned('NEWS', 'article')} AS clean FROM text",
    "compound_count_bare": f"""WITH {_occurrences('discovery')}, {_BIGRAMS}, seen AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot.s, spot.p) - 1 AS ord, a, b FROM
(SELECT doc_id, a, b, min({{'s': sent_id, 'p': pos}}) AS spot FROM bi GROUP BY ALL)), t AS (SELECT doc_id, replace(clean, ' ', '') AS one, replace({_BARE_TEXT}, ' ', '') AS two FROM docs),
c AS (SELECT s.*, {_count('one', 'concat(a, b)')} AS n, {_count('two', 'concat(a, b)')} AS more FROM seen s JOIN t USING (doc_id)) SELECT doc_id, ord, a, b, n FROM c WHERE greatest(n, more) >= 2""",
    "noun_order": f"WITH {_OCC}, {_ORDER} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY included, ord) - 1 AS ord, noun FROM m",
    "noun_order_length": f"WITH {_OCC}, {_ORDER} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(noun) DESC, ord) - 1 AS ord, noun FROM m",
    "paren_suffixes": f"""WITH {_SPLITTER_TEXT}, b AS (SELECT doc_id, pos, token, list_transform(regexp_extract_all(token, '[()]'), lambda x: {{'rest': x, 'out': []::VARCHAR[]}}) AS bs FROM toks WHERE regexp_matches(token, '[()]')),
w AS (SELECT doc_id, pos, list_reduce(list_concat([{{'rest': token, 'out': []::VARCHAR[]}}], bs), lambda a, x: {{'rest': concat(left(a.rest, instr(a.rest, x.rest) - 1), substr(a.rest, instr(a.rest, x.rest) + 1)),
'out': list_append(a.out, substr(a.rest, instr(a.rest, x.rest) + 1))}}).out AS l FROM b),
f AS (SELECT doc_id, pos, unnest(l) AS token FROM w), u AS (SELECT doc_id, 0 AS step, pos, token FROM toks UNION ALL
SELECT f.doc_id, 1, pos, token FROM f JOIN docs USING (doc_id) WHERE length(token) >= 2 AND {_count('clean', 'token')} >= 2)
SELECT doc_id, (contains(token, '(') AND contains(token, ')'))::INT AS bracketed, step, pos, token FROM u WHERE contains(token, '(') = contains(token, ')')""",
    "greedy_occurrences": f"""WITH {_OCC}, {_ORDER}, lists AS (SELECT doc_id, list(noun ORDER BY included, ord) AS ns FROM m GROUP BY doc_id), {_TAKEN}
SELECT doc_id, sent_id, step, l[step + 1].at AS at, l[step + 1].noun AS noun FROM o""",
    "discover": _DISCOVER,
    "noun_surroundings": f"""WITH {_NEEDLE_COUNTS}, x AS (SELECT doc_id, needle, clean, list_transform(range(length(clean) - length(replace(clean, left(needle, 1), ''))), lambda k: {{'rest': needle, 'out': ''}}) AS steps FROM held),
w AS (SELECT doc_id, needle, list_reduce(list_concat([{{'rest': clean, 'out': ''}}], steps), lambda a, s: CASE WHEN contains(a.rest, s.rest) THEN {{'rest': concat(left(a.rest, instr(a.rest, s.rest) - 1), substr(a.rest, instr(a.rest, s.rest) + length(s.rest))),
'out': concat(a.out, substr(a.rest, greatest(instr(a.rest, s.rest) - 10, 1), least(instr(a.rest, s.rest) - 1, 10)), substr(a.rest, instr(a.rest, s.rest) + length(s.rest), 10))}} ELSE a END).out AS around FROM x)
SELECT doc_id, needle, around FROM w""",
    "substrings": f"""WITH {_tokens()} SELECT DISTINCT token, substr(token, i, k) AS part FROM
(SELECT token, i, unnest(range(2, length(token) - i + 2)) AS k FROM (SELECT token, unnest(range(1, length(token))) AS i FROM vocab))""",
}
