"""Text cleaning as nested column expressions, one profile for each variant of the analysis.

Null stays null and empty text empty; everything runs inside the JVM and on streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes of word characters and white space, and the patterns of all profiles.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
URL = rf"(?:http|ftp|https)://(?:[-{WORD}.]|%[0-9a-fA-F]{{2}})+"
JAMO = "[ㄱ-ㅎㅏ-ㅣ]+"
TAG = "<[^>]*>"
UNITS = r"[0-9]+[^\n][0-9]+%|[0-9]+[조억만천원년월달일시분위여건개층][0-9]*|[0-9]+거래일"
SCRIPT = r"<script[^\n]*script>"
KEEP = {"strict": "-/.", "search": "-/.&*+%$", "paren": "-/.()&*+%$"}

#: The steps of each profile in their order.
PROFILES: dict[str, tuple[str, ...]] = {
    "strict": ("nbsp", "strip", "email", "url", "jamo", "tag", "keep:strict", "indent", "breaks", "numbers", "upper", "collapse"),
    "bracketed": ("nbsp", "strip", "email", "url", "jamo", "tag", "keep:paren", "dot_out", "indent", "breaks", "numbers", "upper", "collapse"),
    "discovery": ("nbsp", "strip", "email", "url", "jamo", "tag", "keep:paren", "dot_space", "indent", "breaks", "units", "percent", "collapse", "empty_parens", "upper"),
    "search": ("nbsp", "email", "url", "jamo", "tag", "keep:search", "dot_space", "indent", "breaks", "collapse", "empty_parens", "upper"),
    "elbow": ("nbsp", "email", "script", "url", "jamo", "tag", "keep:search", "breaks", "collapse"),
    "article": ("nbsp", "email", "script", "url", "jamo", "tag", "keep:paren", "breaks", "collapse"),
    "raw": ("upper", "collapse"),
}

_REPLACE = {
    "nbsp": (" ", " "),
    "strip": (rf"\A[{SPACE}]+|[{SPACE}]+\z", ""),
    "email": (EMAIL, " "),
    "url": (URL, " "),
    "jamo": (JAMO, " "),
    "tag": (TAG, " "),
    "script": (SCRIPT, " "),
    "dot_space": (r"([가-힣][^\n][가-힣]*)\.", "$1. "),
    "dot_out": (r"([ㄱ-ㅎ|ㅏ-ㅣ|가-힣][^\n][ㄱ-ㅎ|ㅏ-ㅣ|가-힣]*)\.", "$1 "),
    "indent": (r"(?dm)^[ \t]+|[ \t]+(?=:)", ""),
    "breaks": (r"[\n\t\r]", " "),
    "numbers": (rf"(?<![{WORD}])[0-9]+(?![{WORD}])[{SPACE}]*", ""),
    "units": ("[0-9]+[개층위건만억조원년월일]", ""),
    "percent": (r"[0-9]+[^\n][0-9]+%", ""),
    "collapse": (" +", " "),
    "empty_parens": (r"\(\)", " "),
}


def clean(text: Column, profile: str = "search") -> Column:
    """``text`` after the steps of ``profile``."""
    for step in PROFILES[profile]:
        if step == "upper":
            text = F.upper(text)
        elif step.startswith("keep:"):
            text = F.regexp_replace(text, f"[^{KEEP[step[5:]]}{WORD}{SPACE}]", " ")
        else:
            pattern, to = _REPLACE[step]
            text = F.regexp_replace(text, pattern, to)
    return text


def strip_parens(text: Column) -> Column:
    """Innermost bracket pairs removed as often as there is an opening bracket, then any bracket left."""
    n = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    inner = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), text, lambda acc, _: F.regexp_replace(acc, r"\([^()]*\)", ""))
    return F.regexp_replace(inner, "[()]", "")


def unbalanced(text: Column) -> Column:
    """True where exactly one kind of bracket occurs."""
    return F.contains(text, F.lit("(")) != F.contains(text, F.lit(")"))
