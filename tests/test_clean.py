import pytest
from pyspark.sql import functions as F

from wordmine.functions.clean import PROFILES, UNITS, clean, strip_parens, unbalanced

#: One example for each step: the profile, a text, and what it must become.
STEPS = [
    ("raw", "ab  c", "AB C"),
    ("elbow", "앞\xa0뒤", "앞 뒤"),
    ("elbow", "편지 kim.lee+1@mail.co.kr 끝", "편지 끝"),
    ("elbow", "주소 https://a.b-c.kr/%20길 끝", "주소 /%20길 끝"),
    ("elbow", "좋다ㅋㅋㅋ 정말ㅠㅠ 끝", "좋다 정말 끝"),
    ("elbow", "<b>굵은</b> 글", " 굵은 글"),
    ("elbow", "앞<script>let x</script>뒤", "앞 뒤"),
    ("elbow", "값(하나)·둘 50% A/B", "값 하나 둘 50% A/B"),
    ("article", "값(하나)·둘", "값(하나) 둘"),
    ("article", "줄\n바꿈\t탭\r\n끝", "줄 바꿈 탭 끝"),
    ("search", "갔다.그리고 abc", "갔다. 그리고 ABC"),
    ("search", "제목 :  값\n   들여쓰기", "제목: 값 들여쓰기".replace(":", "")),
    ("search", "값 (둘) ()", "값 둘 "),
    ("discovery", "  앞뒤  ", "앞뒤"),
    ("discovery", "빌딩 12층 3개 45.6% 남음", "빌딩 남음"),
    ("discovery", "이름() (나)", "이름  (나)"),
    ("strict", "값(하나) 50% 3번 12 34 끝", "값 하나 3번 끝"),
    ("strict", "2020 올해 7", "올해 "),
    ("bracketed", "값(하나). 12 끝", "값(하나) 끝"),
    ("bracketed", "갔다.그리고", "갔다 그리고"),
]


@pytest.mark.parametrize("profile, text, want", STEPS)
def test_steps(spark, profile, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(clean(F.col("t"), profile)).first()[0] == want


def test_null_stays_null_and_empty_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string").select(*[clean(F.col("t"), p).alias(p) for p in PROFILES]).collect()
    assert all(v is None for v in rows[0]) and all(v == "" for v in rows[1])


def test_units(spark):
    rows = spark.createDataFrame([("3개월",), ("12.5%",), ("20거래일",), ("개월",), ("A1",)], "t string")
    assert [r[0] for r in rows.select(F.col("t").rlike(UNITS)).collect()] == [True, True, True, False, False]


def test_brackets(spark):
    rows = spark.createDataFrame([("가(나(다)라)마",), ("a)b(c",), ("x",), ("",), ("((",)], "t string")
    out = [tuple(r) for r in rows.select(strip_parens(F.col("t")), unbalanced(F.col("t"))).collect()]
    assert out == [("가마", False), ("abc", False), ("x", False), ("", False), ("", True)]
