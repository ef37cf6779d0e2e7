"""Personal information in free text, labelled by a skip-chain conditional random field.

Patterns propose candidate mentions of five kinds in the consistent form of a text; all of them are the field's nodes,
each labelled mention or nothing. A node's own potential comes from features of its form, of how like a given name its
syllables are, and of its surroundings. Neighbours in an enumeration share a potential, and so do distant repetitions of
the same name or number and similar tokens, such as a number without its country code or a name with its initial, so
evidence at one place, such as a title, carries over to a bare repetition elsewhere in the document. Labels are the
marginals of loopy sum-product message passing, run for all documents of a batch at once. All weights, those of
features and of links, are learnt by maximum pseudo-likelihood from the marked sentences below, once, on the driver.
Offsets are given in the text as stored, and placeholders replace exactly these characters.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.llm.lookalike import consistent_spans
from wordmine.llm.records import records
from wordmine.plans.lineage import listed
from wordmine.sources.tables import table

KINDS = ("email", "phone", "id", "address", "name")
#: Message rounds and damping of the passing; characters of surroundings that features see.
ROUNDS, DAMPING, AROUND = 10, 0.3, 18
#: Rounds of training, rate and ridge.
ROUNDS_TRAINED, RATE, RIDGE = 4000, 1.0, 3e-4
#: No address begins or ends further from its road or quarter than this, by the bounds in its pattern.
REACH = 90

#: Surnames and titles.
SURNAMES = (
    "남궁 사공 선우 제갈 황보 독고 서문 동방 어금 망절 김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 전 홍 유 고 문 양 손 배 백 허 남 심 노 하 곽 성 "
    "차 주 우 구 나 민 진 류 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 석 선 설 마 길 연 위 표 명 기 반 왕 금 옥 육 인 맹 제 모 탁 국 은 편 용 예 경 봉 사 "
    "부 가 복 태 목 형 피 두 감 음 빈 동 온 호 범 좌 팽 승 간 상 시 갈 단 견 당 묵"
).split()
TITLES = (
    "기자|특파원|교수|대표|위원장|변호사|의원|시장|감독|선수|박사|팀장|이사|본부장|과장|연구원|회장|사장|장관|차관|총리|대통령|검사|판사|의사|간호사|원장|국장|부장|"
    "실장|센터장|소장|작가|배우|가수|코치|주장|대변인|비서관|후보|총장|부회장|부사장|전무|상무|차장|대리|사원|군수|구청장|도지사|지사|앵커|아나운서|PD|논설위원|"
    "교사|선생|학생|주민|시민|어린이|할머니|할아버지|목사|신부|스님|경위|경감|순경|대위|소령|중령|대령|장군|위원|부위원장|이사장|사무총장|조합장|점장|매니저|디자이너|연출|명예교수"
)
#: Last syllables that given names have and common nouns seldom.
GIVEN_ENDS = "결겸늘담란람랑린별봄빛빈솔슬엘온욱율윤을찬훈혁휘희솜샘흔렬섭웅준"
#: Common given names, of two syllables and of one, and nouns that look like a surname with a given name.
GIVEN = (
    "민준 서준 도윤 예준 시우 하준 주원 지호 지후 준우 준서 건우 도현 현우 지훈 우진 선우 서진 민재 현준 연우 유준 정우 승우 승현 시윤 준혁 은우 지환 승민 지우 유찬 윤우 "
    "민성 준영 시후 진우 지원 수현 재윤 시현 동현 수호 태윤 민규 재원 한결 민우 재민 은찬 윤호 시원 이준 민찬 지안 시온 성민 준호 승준 성현 현서 재현 하율 지한 우빈 태민 지성 예성 "
    "서연 서윤 지민 하은 민서 지유 윤서 채원 수아 지아 다은 은서 예은 소율 예린 수빈 소윤 예원 지윤 유나 시은 채은 유진 예서 가은 윤아 민지 예진 서영 주아 하린 나은 서하 다인 "
    "수민 연아 흥민 재석 영수 영호 영철 성호 상훈 정훈 병철 미경 은주 은경 혜진 지영 미영 현정 은정 지은 은영 혜영 미정 선영 경희 영희 순신 중근 재용 용준 승기 효리 태희 동원"
).split()
GIVEN_ONE = "준 구 현 빈 훈 철 혁 결 솔 린 율 건 윤 찬 진 웅 란 호 민 원 선 신 황 혜 희"
COMMON = frozenset(
    "안정성 이재민 이주민 경영진 주인공 현대인 한민족 유명인 전문성 현실성 이용자 주민등 신기술 정상화 전문가 고성능 조직원 장기전 주요인 공정성 정부안 지원금 전시회 신청서 안내문 배구 연구 조사 정원 "
    "이사 이번 조정 정치 경기 경영 기업 임원 전임 현직 신임 이전 전직 주한 국제 지방 고위 민간 한국 전국 지원 안전 여성 남성 신진 조교 여당 야당 기술 사진 원로 선임 부임 성인 명예 기자 공동 연합 "
    "문의 제보 신청 접수 예약 주문 안내 이메일 홍보 편집 고객 담당 민원 상담 신고 이진 시민 주민 이민 유권 서민 전문 최고 최대 최초 최근 이상 이하 정도 공식 방문 방송 조합 조기 한도 이력".split()
)
#: Common Western given names, Chinese surnames and titles.
FIRST_NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Timothy Peter Jason Ryan Jacob Gary Eric Frank "
    "Stephen Scott Benjamin Samuel Henry Jack Adam Simon Oliver Harry Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Donna Michelle Carol Amanda "
    "Melissa Laura Rebecca Sharon Cynthia Anna Kathleen Amy Angela Helen Emma Olivia Sophia Jane Alice Julia Kate Lucy Grace Maria José Juan Carlos Luis Pedro Ana Carmen Hans Klaus Pierre Jean Marie Giovanni Marco Ivan Olga".split()
)
CHINESE = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
CHINESE_TITLES = "先生|女士|小姐|教授|主席|总经理|经理|记者|主任|校长|院长"
#: Particles of one syllable that names seldom end in.
PARTICLES = "은는를의에도로과와"
_S = r"(?:[ \t]|\r?\n)"
_G = "[가-힣]"

_EMAIL = re.compile(
    rf"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?(?:{_S}?(?:@|[\[({{<](?:at|AT|At|골뱅이)[\])}}>]|골뱅이|앳){_S}?|{_S}(?:at|AT){_S}(?=[A-Za-z0-9-]+{_S}(?:dot|DOT){_S}))"
    rf"[A-Za-z0-9-]+(?:(?:\.|{_S}?[\[({{<](?:dot|DOT|Dot|점|닷)[\])}}>]{_S}?|{_S}(?:dot|DOT){_S}|{_S}?(?:닷|쩜){_S}?)[A-Za-z0-9-]+)+"
)
_D = rf"(?:-|\.|{_S})?"
_PHONE = re.compile(
    rf"(?<![0-9A-Za-z_*.+-])(?:\+|00)\d{{1,3}}{_D}(?:\(0\){_D})?\(?\d{{1,4}}\)?{_D}\d{{3,4}}{_D}\d{{4}}(?![\d*]|[-.]\d)"
    rf"|(?<![0-9A-Za-z_*+-])(?<!\d\.)\(?01[016789]\)?{_D}\d{{3,4}}{_D}\d{{4}}(?![\d*]|[-.]\d)"
    rf"|(?<![0-9A-Za-z_*+-])(?<!\d\.)(?:\(0\d{{1,3}}\)|0\d{{1,3}}\)){_D}\d{{3,4}}{_D}\d{{4}}(?![\d*]|[-.]\d)"
    rf"|(?<![0-9A-Za-z_*+-])(?<!\d\.)0(?:2|[3-6][1-5]|70|80|50\d?)(?:-|\.|{_S})\d{{3,4}}(?:-|\.|{_S})\d{{4}}(?![\d*]|[-.]\d)"
    rf"|(?<![0-9A-Za-z_*+-])(?<!\d\.)\(\d{{3}}\){_D}\d{{3}}{_D}\d{{4}}(?![\d*]|[-.]\d)"
    rf"|(?<![0-9A-Za-z_*+.-])1[568]\d\d-\d{{4}}(?![\d*]|[-.]\d)"
    rf"|(?<![0-9A-Za-z_*.-])\+\d{{1,3}}(?:{_D}\d{{1,4}}){{3,6}}(?![\d*]|[-.]\d)"
    rf"|(?<![0-9A-Za-z_*+.-])[2-9]\d\d([-.])\d{{3}}\1\d{{4}}(?![\d*]|[-.]\d)"
)
_ID = re.compile(
    rf"(?<![0-9A-Za-z_*-])\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]){_S}?(?:-{_S}?)?[0-9]\d{{6}}(?![\d*]|-\d)"
    r"|(?<![0-9A-Za-z_*-])\d\d-\d\d-\d{6}-\d\d(?![\d*]|-\d)"
)
_PASSPORT = re.compile(r"[A-Z](?<![A-Za-z0-9*-].)(?:\d{8}|\d{3}[A-Z]\d{4})(?![A-Za-z0-9*]|-\d)", re.S)
_REGION = (
    rf"(?:(?:{_G}{{1,4}}(?:특별자치시|특별자치도|특별시|광역시)|{_G}{{1,3}}도|서울시?|부산시?|대구시?|인천시?|광주시?|대전시?|울산시?|세종시?|경기|강원|충북|충남|전북|전남|경북|경남|제주){_S})?"
    rf"(?:{_G}{{1,5}}[시군구]{_S}){{0,2}}(?:{_G}{{1,5}}[읍면]{_S})?"
)
_ADDRESS = re.compile(
    rf"(?<!{_G})(?P<region>{_REGION})(?:{_G}{{1,7}}(?:대로|로|길)(?:\d+번?길|\d+가길)?|{_G}{{1,5}}\d?[동리](?:{_S}산)?|{_G}{{1,3}}\d가)"
    rf"{_S}(?:\d+(?:-\d+)?)(?:번지|번|호)?(?![\d%]|[.,]\d|-\d)(?:,?{_S}(?:{_G}[가-힣A-Za-z0-9]{{1,19}}{_S}(?=(?:지하{_S}?)?\d+[층호동]))?(?:\d+동{_S}\d+호|지하{_S}?\d+층|\d+층{_S}\d+호|\d+층|\d+호|[A-Z가-힣]동{_S}\d+호))?"
)
_STREET = (
    rf"(?<![0-9A-Za-z_.-])\d{{1,5}}[A-Z]?(?:{_S}[A-Z][A-Za-z'’]+){{1,3}}?{_S}(?:Drive|Road|Lane|Court|Avenue|Street|Boulevard|Square|Terrace|Place|Crescent|Way|Dr\b\.?|St\b\.?|Rd\b\.?|Ave\b\.?|Ln\b\.?|Blvd\b\.?)"
    rf"(?:,{_S}(?:Apt|Suite|Unit|Flat|Floor|Room)\.?{_S}\d+[A-Z]?)?(?:,{_S}[A-Z][a-z]+(?:{_S}[A-Z][a-z]+)?)?"
)
_STREETS = re.compile(_STREET)
#: Cheap tests that every match of a costly pattern passes.
_RUN = re.compile(r"[+(\d][\d\-. )(\n\r\t]{5,}\d")
_NUMBERED = re.compile(rf"[로길동리가]{_S}(?:산{_S})?\d")
_STREET_NAMES = re.compile(r"Drive|Road|Lane|Court|Avenue|Street|Boulevard|Square|Terrace|Place|Crescent|Way|Dr\b|St\b|Rd\b|Ave\b|Ln\b|Blvd\b")
_ONE, _TWO = [x for x in SURNAMES if len(x) == 1], [x for x in SURNAMES if len(x) == 2]
_AFTER = rf"(?=(?:씨|님|군|양|은|는|이|가|을|를|의|와|과|도|에게|께서|에|로|으로|이라|라|이며|이고|만)?(?:[^가-힣]|$)|{TITLES}|씨|님|이랑|이나)"
#: A surname with two syllables, or with one before a title; each begins with a class of characters, which the search runs on fast.
_KOREAN = re.compile(
    rf"[{''.join(sorted({x[0] for x in SURNAMES}))}](?<!{_G}.)(?:(?:{'|'.join(f'(?<={x[0]}){x[1]}' for x in _TWO)})|(?<=[{''.join(_ONE)}]))"
    rf"(?:(?:{_S})?{_G}{_G}{_AFTER}|(?:(?<={_G}{_G}){_G}|[{GIVEN_ONE.replace(' ', '')}])(?={_S}(?:{TITLES})(?:{_G}?[^가-힣]|$)|{_S}?씨(?:[^가-힣]|[은는이가을를의와과]|$)))",
    re.S,
)
_CAP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
_WESTERN = re.compile(
    rf"[{_CAP}](?<![{_CAP}{_LOW}].)(?<![A-Za-z0-9]\..)(?:[{_LOW}]+|[A-Z]{{1,8}}|\.)(?:{_S}?[A-Z]\.)?{_S}?(?<=[ \t\n.])(?:[{_CAP}][{_LOW}]+(?:-[{_CAP}][{_LOW}]+)*|[A-Z]{{2,9}})(?![{_CAP}{_LOW}])", re.S
)
_JAPANESE = re.compile(rf"[一-鿿々](?<![一-鿿々].)(?:[一-鿿々]{{0,3}}{_S}[一-鿿々ぁ-んァ-ヴ]{{1,4}}?|[一-鿿々]{{3,6}})(?=さん|氏|様|記者|選手|監督)", re.S)
_HAN = re.compile(rf"[{CHINESE}][一-鿿]{{1,2}}?(?={CHINESE_TITLES})")
_AT = re.compile(r"@|골뱅이|앳|[\[({<](?:at|AT|At)|\s(?:at|AT)\s\S+\s(?:dot|DOT)\s")

#: What stands left or right of a candidate; each pattern is one feature.
LEFT = {
    "left_title": re.compile(rf"(?:^|[^가-힣])(?:{TITLES.replace('기자|특파원|', '')}){_S}$"),
    "left_role": re.compile(rf"(?:담당자|수상자|가족|피해자|글|사진|글·사진|작성자|이름은|성명|성명:|고인은){_S}?$"),
    "left_byline": re.compile(rf"(?:\[{_G}+|【{_G}+){_S}$"),
    "left_western": re.compile(rf"(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sir|Rev)\.?{_S}$"),
    "left_said": re.compile(rf"(?:said|says|by|By|told){_S}$"),
    "left_list": re.compile(rf"(?:,|·|/|와|과|및){_S}?$"),
    "left_roster": re.compile(rf"(?:명단에는|참석자는|선수는|수상자는){_S}$"),
    "left_firm": re.compile(r"(?:사업자|법인|고유|(?<!주민)(?<!외국인)등록번호|주문번호|주문|의안|의안번호|사건|도서번호|종목코드|송장|청구서|계좌번호|계좌|문서|제품|ISBN|No\.?|계정)(?:번호)?\W?\s?$"),
    "left_identity": re.compile(r"(?:주민번호|주민등록번호|외국인등록번호|passport|Passport|SSN|여권|여권번호|면허|면허번호|신분증에는|파일에는|식별번호)\W?\s?$"),
    "left_reach": re.compile(r"(?:전화|연락처|문의는|제보하기|제보:|热线电话为|or|하거나|씨는|/|휴대전화|Tel|TEL|tel|팩스|번호는)\W?\s?$"),
    "left_place": re.compile(r"(?:주소는|주소:|본사는|행사장은|사무실을|곳:|집\(|depot at|사는|소재|위치한|at)\s?$"),
}
RIGHT = {
    "right_ssi": re.compile(rf"(?:\(\d{{1,3}}\))?{_S}?(?:씨|님)(?![가-힣]*(?:앗))"),
    "right_title": re.compile(rf"{_S}?(?:{TITLES})(?:[^가-힣]|$|은|는|이|가|을|를|의|와|과|도|에게|에|로|측)"),
    "right_reporter": re.compile(rf"{_S}?(?:기자|특파원)(?:[^가-힣]|$)"),
    "right_age": re.compile(r"\(\d{1,3}(?:세|·|,|\))"),
    "right_contact": re.compile(rf"(?:\({_S}?|{_S})[A-Za-z0-9][A-Za-z0-9._%+-]*{_S}?(?:@|\[at|\(at|골뱅이)"),
    "right_number": re.compile(rf",{_S}(?:주민|여권|면허|연락처|전화|주소)"),
    "right_list": re.compile(rf"(?:,|·|/|와|과|및){_S}?"),
    "right_etc": re.compile(rf"{_S}등(?:이|은|을|의|{_S})"),
    "right_said": re.compile(rf"{_S}(?:said|says|told|of{_S}the|declined|added)"),
    "right_award": re.compile(r"\([가-힣]{2,6}\)(?:와|과|은|는|이|가)"),
    "right_japanese": re.compile(rf"さん|氏|様|記者|選手|監督|{CHINESE_TITLES}"),
    "right_particle": re.compile(r"(?:은|는|이|가|을|를|의|와|과|에게)(?:[^가-힣]|$)"),
}
FORM = (
    "bias", "email", "email_spelt", "phone", "phone_service", "phone_spaced", "id", "id_date", "id_passport", "id_licence", "address", "address_region", "address_unit", "address_english",
    "address_town", "name_korean", "name_spaced", "name_two", "name_closed", "name_word", "name_given", "name_tail", "name_first", "name_bare", "name_western", "name_initial", "name_capitals", "name_japanese", "name_clue", "handle",
    "name_common", "name_weak", "name_like", "name_unlike", "name_listed", "name_known", "name_one", "name_subject", "phone_bare",
)
#: Features of form, then each pattern of the surroundings apart for names and for all other kinds.
FEATURES = {f: i for i, f in enumerate([*FORM, *(f"{kind}:{f}" for kind in ("name", "other") for f in [*LEFT, *RIGHT])])}
_CLUES = ("left_title", "left_role", "left_western", "left_said", "left_roster", "right_ssi", "right_title", "right_reporter", "right_age", "right_contact", "right_number", "right_award", "right_japanese", "right_said", "right_etc")

_ANY_LEFT = re.compile("|".join(f"(?:{LEFT[f].pattern})" for f in (*(c for c in _CLUES if c in LEFT), "left_list")))
_ANY_RIGHT = re.compile("|".join(f"(?:{RIGHT[f].pattern})" for f in (*(c for c in _CLUES if c in RIGHT), "right_list")))


@dataclass
class Node:
    kind: int
    start: int
    end: int
    key: str
    features: list[int]
    clue: bool


def _features(text: str, kind: int, start: int, end: int, form: list[str]) -> tuple[list[int], bool]:
    left, right = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    group = "name" if KINDS[kind] == "name" else "other"
    around = [f for f, p in LEFT.items() if p.search(left)]
    around += [f for f, p in RIGHT.items() if p.match(right)]
    clue = any(f in _CLUES for f in around)
    if clue and group == "name":
        form = [*form, "name_clue"]
    return [FEATURES["bias"], *(FEATURES[f] for f in form), *(FEATURES[f"{group}:{f}"] for f in around)], clue


def _closed(ch: str) -> bool:
    return (ord(ch) - 0xAC00) % 28 != 0


def candidates(text: str, words: frozenset[str] = frozenset()) -> list[Node]:
    """The candidate mentions of a text in consistent form, in order of position and without overlaps.

    ``words`` are registered words, which are seldom names. Names without any clue around them are candidates as well.
    """
    nodes: list[Node] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(taken, (b, -1))  # those before k begin before b; they don't overlap, so the last one ends last
        return not k or taken[k - 1][1] <= a

    def put(kind: str, a: int, b: int, form: list[str]) -> None:
        k = KINDS.index(kind)
        features, clue = _features(text, k, a, b, form)
        nodes.append(Node(k, a, b, re.sub(r"[\s()+-]", "", text[a:b]).lower(), features, clue))
        bisect.insort(taken, (a, b))

    if _AT.search(text):
        for m in _EMAIL.finditer(text):
            put("email", m.start(), m.end(), ["email"] + (["email_spelt"] if "@" not in m[0] else []))
    for m in _PASSPORT.finditer(text):
        if free(*m.span()):
            put("id", *m.span(), ["id", "id_passport"])
    runs = [(m.start(), m.end() + 3) for m in _RUN.finditer(text)]  # every number lies within one; what follows it is looked at too
    for low, high in runs:
        for m in _ID.finditer(text, low, high):
            if free(*m.span()):
                put("id", *m.span(), ["id", "id_licence" if m[0].count("-") == 3 else "id_date"])
    for low, high in runs:
        for m in _PHONE.finditer(text, low, high):
            if free(*m.span()):
                bare = m[0][0] in "23456789"
                put("phone", *m.span(), ["phone", *["phone_bare"] * bare] + (["phone_service"] if m[0][0] == "1" else []) + (["phone_spaced"] if " " in m[0] else []))
    last = 0
    for anchor in _NUMBERED.finditer(text):  # the pattern is tried only around what can be its core
        at = anchor.start()
        for m in _ADDRESS.finditer(text, max(last, at - REACH), at + REACH) if at >= last else ():
            if m.end() > at:
                if m.start() <= at and free(*m.span()):
                    put("address", *m.span(), ["address", *["address_region"] * bool(m["region"]), *["address_unit"] * (m[0][-1] in "층호")])
                    last = m.end()
                break
    for m in _STREETS.finditer(text) if _STREET_NAMES.search(text) else ():
        if free(*m.span()):
            put("address", *m.span(), ["address", "address_english"] + (["address_town"] if "," in m[0] else []))
    names: list[tuple[int, int, list[str], bool]] = []
    for m in _KOREAN.finditer(text):
        s = m[0]
        two = s[:2] in _TWO_SET
        given = s[2:] if two and len(s.strip()) > 2 else s[1:]
        spaced = any(c.isspace() for c in s)
        if s in words or spaced and _TITLE.fullmatch(s[-2:]):
            continue
        a, b = m.span()
        form = ["name_korean"]
        if spaced:
            form.append("name_spaced")
        if two and not spaced and len(s) == 3 and not _ANY_RIGHT.match(text, b):
            form.append("name_two")
        given = given.strip()
        if len(given) == 1:
            form.append("name_one")
        if s in COMMON or s[:2] in COMMON and len(s) == 3 and s[2] in PARTICLES:
            form.append("name_common")
        alike = given in _GIVEN_SET or len(given) == 2 and given[0] in _GIVEN_FIRST and given[1] in _GIVEN_LAST
        form.append("name_like" if alike else "name_unlike")
        if given in _GIVEN_SET:
            form.append("name_listed")
        if _closed(s[-1]):
            form.append("name_closed")
        evident = s[-1] in GIVEN_ENDS or _ANY_RIGHT.match(text, b) is not None or _ANY_LEFT.search(text[max(0, a - AROUND) : a]) is not None
        names.append((a, b, form, evident))
    for pattern, base in ((_WESTERN, "name_western"), (_JAPANESE, "name_japanese"), (_HAN, "name_japanese")):
        for m in pattern.finditer(text):
            head = re.split(r"\s", m[0])
            form = [base]
            if len(head[0]) == 2 and head[0][1] == ".":
                form.append("name_initial")
            if head[0] in FIRST_NAMES:
                form.append("name_known")
            if any(len(h) > 1 and h.isupper() for h in head):
                form.append("name_capitals")
            names.append((*m.span(), form, True))
    names = sorted((n for n in names if free(n[0], n[1])), key=lambda n: (n[0], -n[1]))
    last = -1
    for a, b, form, evident in names:
        if a < last:
            continue
        last = b
        if not evident:
            key = _WHITE.sub("", text[a:b])
            first = _SENTENCE.search(text[max(0, a - 8) : a]) is not None
            bare = RIGHT["right_particle"].match(text, b) is not None
            subject = first and bare and "name_like" in form and "name_spaced" not in form and text[a - 1 : a] not in (")", "]") and text[b - 1] not in PARTICLES
            form = [*(f for f in form if f in _WEAK), "name_weak", *["name_subject"] * subject, *["name_tail"] * (text[b - 1] in PARTICLES)]
            nodes.append(Node(4, a, b, key, [FEATURES["bias"], *(FEATURES[f] for f in form)], False))
            continue
        if any(w in words for w in (text[a:b], text[a : b + 1]) if w):
            form = [*form, "name_word"]
        given = text[b - 1] in GIVEN_ENDS and "name_korean" in form
        first = _SENTENCE.search(text[max(0, a - 8) : a]) is not None
        bare = (given or "name_western" in form) and first and RIGHT["right_particle"].match(text[b : b + 3]) is not None
        apart = RIGHT["right_ssi"].match(text[b : b + 8]) or RIGHT["right_title"].match(text[b : b + 12]) or RIGHT["right_etc"].match(text[b : b + 12])
        tail = "name_korean" in form and (text[b - 1] in PARTICLES or text[b - 1] == "을" and text[b : b + 1].isspace() and not apart)
        form = [*form, *["name_given"] * (given and not tail), *["name_tail"] * tail, *["name_first"] * first, *["name_bare"] * bare]
        features, clue = _features(text, 4, a, b, form)
        nodes.append(Node(4, a, b, re.sub(r"\s", "", text[a:b]).lower(), features, clue or bare))
    known = {n.key for n in nodes if n.clue and n.kind == 4}
    for n in nodes:  # that a repetition has no clue of its own says nothing against it
        if n.kind == 4 and not n.clue and n.key in known:
            n.features = [f for f in n.features if f not in _SILENT]
    return sorted(nodes, key=lambda n: (n.start, n.end))


_SILENT = frozenset((FEATURES["name_weak"], FEATURES["name_unlike"]))
_TITLE, _WHITE = re.compile(TITLES), re.compile(r"\s")
_WEAK = frozenset(("name_korean", "name_common", "name_unlike", "name_spaced"))
_TWO_SET, _GIVEN_SET = frozenset(_TWO), frozenset(GIVEN)
_GIVEN_FIRST, _GIVEN_LAST = frozenset(g[0] for g in GIVEN), frozenset(g[1] for g in GIVEN)
_SENTENCE = re.compile(r"(?:^|[\n\r.!?”’…】\])=]|특파원)\s*$")
_SEPARATOR = re.compile(rf"(?:\([^()\n]{{1,8}}\))?(?:씨)?{_S}?(?:,|·|/|와|과|및|and){_S}?(?:가족{_S}|및{_S})?")


def _listed(text: str, a: Node, b: Node) -> bool:
    return a.kind == b.kind and b.start - a.end <= 16 and _SEPARATOR.fullmatch(text, a.end, b.start) is not None


def alike(node: Node) -> str | None:
    """What similar mentions share: the last digits of a number, the surname and initial of a Western name, the letters of a mail address's name."""
    kind = KINDS[node.kind]
    if kind == "phone":
        digits = "".join(c for c in node.key if c.isdigit())
        return digits[-8:] if len(digits) >= 8 else None
    if kind == "email":
        return re.sub(r"[^a-z0-9]", "", re.split(r"@|\[|골뱅이", node.key)[0]) or None
    if kind == "name" and node.key[:1].isascii():
        return node.key[:1] + node.key[-4:]
    return None


def edges(text: str, nodes: list[Node]) -> list[tuple[int, int, int]]:
    """Linked nodes with the kind of link: 0 for neighbours in an enumeration, 1 for repetitions of the same key, 2 for similar ones.

    A repetition is linked to the one before and to the first, so the number of links follows the number of nodes.
    """
    out = [(i, i + 1, 0) for i in range(len(nodes) - 1) if _listed(text, nodes[i], nodes[i + 1])]
    for kind, share in ((1, lambda n: n.key), (2, alike)):
        seen: dict[tuple[int, str], tuple[int, int]] = {}
        for i, n in enumerate(nodes):
            shared = share(n)
            if shared is None:
                continue
            key = (n.kind, shared)
            if key in seen:
                first, before = seen[key]
                links = {before, first} if kind == 1 else {k for k in (before, first) if nodes[k].key != n.key}
                out += [(k, i, kind) for k in sorted(links)]
                seen[key] = (first, i)
            else:
                seen[key] = (i, i)
    return out


def propagate(unary: np.ndarray, links: np.ndarray, strength: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginal log-odds after loopy sum-product passing; ``links`` are pairs of nodes, ``strength`` what equal labels gain."""
    if not len(links):
        return unary
    a, b = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
    j = np.concatenate([strength, strength])
    half = len(links)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    message = np.zeros(2 * half)
    for _ in range(rounds):
        total = unary + np.bincount(b, message, minlength=len(unary))
        h = total[a] - message[back]
        new = np.logaddexp(h + j, 0) - np.logaddexp(h, j)
        message = DAMPING * message + (1 - DAMPING) * new
    return unary + np.bincount(b, message, minlength=len(unary))


#: Marked sentences for training, ``{kind|mention}``; whatever the patterns propose besides is no mention.
TRAINING = """
[새날일보 {name|김도윤} 기자] 시는 새 청사를 연다.
(한강=새날일보) {name|박서준} 기자 = 예산이 늘었다.
글·사진 {name|이하늘} {email|haneul.lee@press.example}
{name|최민결} 기자 {email|CHOI99@PRESS.EXAMPLE}
{name|정한별} 기자 {email|jung [at] press [dot] example}
서울={name|오세찬} 특파원 {email|oh.se@mail.test}
담당자 {name|문가람}({email|moon+news@city.test})가 안내한다.
문의는 {phone|02-123-4567}, {email|info@city.test}로 하면 된다.
접수는 {email|apply 골뱅이 city.test}로 하거나 {phone|010-1234-5678}번으로 하면 된다.
전화 {phone|+82 (0)10 1234 5678}번으로만 받는다.
▶ 제보하기 {phone|02)123-4567}
▶ 제보하기 {phone|010 2222 3333}
▶ 제보하기 {phone|(02) 123-4567}
热线电话为{phone|031-123-4567}。
Questions go to {email|desk@press.example} or {phone|010.1234.5678}.
대표번호 {phone|1588-1234}로 문의하면 된다.
사건번호 1588-1234는 기각됐다.
주문번호 20211234-1234567을 확인해야 한다.
사업자등록번호 123-81-12345로 등록됐다.
법인등록번호 110111-1234567로 등록됐다.
도서번호 979-11-1234-12-3이 붙었다.
{name|강나래}, 주민번호 {id|900101-2123456}, 연락처 {phone|010-3333-4444} 순으로 적혔다.
{name|윤솔빛}, 주민번호 {id|9001012123456}, 연락처 {phone|01033334444} 순으로 적혔다.
여권 {id|M12345678}을 잃어버린 {name|한가을}씨는 {phone|010-5555-6666}으로 연락해 달라고 했다.
여권 {id|M123A4567}을 잃어버린 {name|John Carver}씨는 연락해 달라고 했다.
신씨의 신분증에는 {id|11-12-123456-12}, 주소는 {address|가온시 햇살로 12, 3층}로 적혀 있다.
유출된 파일에는 {id|880808-1234567} 같은 번호가 그대로 남았다.
유출된 파일에는 {id|880808 - 1234567} 같은 번호가 그대로 남았다.
본사는 {address|가온광역시 나루구 햇살로12길 34-5 101동 202호}에 있다.
독자 의견 보낼 곳: {address|가온도 나루군 들꽃읍 샘골리 12번지} 새날일보 편집국
행사장은 {address|나루구 햇살로 77, 301호}이며 문의는 {phone|042-123-4567}이다.
{name|임하람}씨 집({address|나루구 달빛길 8})에서 불이 났다.
행사장은 {address|12 Maple Hill Road, Apt 3, Northfield}이며 주차는 어렵다.
The depot at {address|12 Maple Hill Road, Northfield} was closed.
햇살로 일대와 달빛길 구간이 막힌다.
점유율은 수출로 30 포인트 올랐다. 두 번째로 12건이 접수됐다.
매출은 환율로 20 늘었다.
{name|조온유} 위원장은 말했다. {name|조온유}는 그 뒤 떠났다.
{name|류 하늘} 감독이 전했다.
{name|선우 가람} 기자
팀장 {name|제갈민수}씨는 말했다.
이번 명단에는 {name|남다솔}, {name|노은별}, {name|Kim Haneul} 등이 올랐다.
{name|구한빛}·{name|나라온} 선수가 나란히 올랐다.
{name|민초롱}(34)씨와 {name|서다온}(57)씨는 결혼했다.
수상자 {name|안보라}(대상)와 가족 {name|안해솔}은 무대에 올랐다.
[인터뷰] {name|유한결} 변호사 “규정 바꾼다”
“어렵다.”라고 {name|주가온} 의원이 전했다.
“We lost it,” said {name|Mary Winter}.
Mr. {name|Alan Brook} said the road would reopen.
Dr. {name|E. Winter} of the harbour board declined to comment.
Dr. {name|Alan B. Winter-Moss}는 No. 12 보고서에서 밝혔다.
{name|KIM Haneul} 감독은 말했다.
{name|Haneul Park} 위원장은 말했다.
{name|山田川 太郎}さんは工房を開いた。
委員会（委員長・{name|山田川太郎}氏。定員30人）が案をまとめた。
{name|조하늘} 대표는 말했다. {name|정우람} 의원은 떠났다. {name|오한솔} 교수가 전했다. {name|윤가람} 시장은 “짓는다”고 했다.
{name|심보라} 이사는 “늘었다”며 웃었다. {name|배은결} 연구원이 말했다. {name|문다은} 선수는 이겼다. {name|서누리} 감독은 졌다.
누리전자 {name|고은찬} 이사는 “늘었다”고 했다.
{name|진아람}은 새 계획을 내놓았다. {name|차 하율}은 그 안을 냈다. {name|Mary Winter}는 새 계획을 내놓았다. {name|Park Haneul}은 웃었다. 위성은 떴다. 연구별은 없다.
김 기자 = 조합은 새 안을 냈다. 박 특파원 기술의 시장은 좁다. 기자 = 유출된 파일이다.
조사위원 대표는 말했다. 도서관 이사는 없다. 위원회 의원은 말했다.
하반기 시장은 어렵다. 연구소 소장은 말했다. 이번엔 선수가 없다. 기술은 교수가 맡는다.
성장세 시장은 좁다. 주요국 의원이 왔다. 전담반 팀장은 없다. 신도시 주민은 말했다.
Old Mill Lane was closed. The North Gate opened on Monday.
Port Haven, Low Moor and East Bay declined.
공식 계정 @news_1234에 올라온 사진이다.
가려진 번호 010-****-1234만 공개됐다. 피의자 정보는 900101-1****** 형태로 남았다.
좌표 37.1234, 127.1234 부근이다. 2020. 1. 2. 시작됐다.
{name|손흥민}은 골을 넣었다. {name|김연아}가 우승했다. 안정성은 높다. 이재민은 늘었다. 경영진은 떠났다.
{name|이재용}은 회의에 나왔다. {name|박지성}이 왔다. 주인공은 없다. 이용자는 많다. 공정은 끝났다. 전지는 팔렸다.
{name|남궁민} 감독이 말했다. {name|허준} 교수는 웃었다. {name|김구} 선생의 뜻이다. 배구 감독이 왔다. 연구 교수가 왔다.
기업 대표는 말했다. 임원 대표가 왔다. {name|정선} 작가가 썼다. 조합 이사는 없다.
문의는 {email|kim@press.example}로 하면 된다. 제보는 {email|tip@press.example} 앞으로 보낸다. 신청은 {email|a.b@city.test}
주민등록번호 {id|900101-1234567} 외국인등록번호 {id|900101-5234567}
{name|John Smith} met {name|Jane Doe} and {name|José García} in New York.
Dr. {name|Mary Winter} left. {name|M. Winter} said nothing. North Park was closed. Big Data is here.
{name|张伟}先生说今天下雨。{name|李娜}女士来了。
Call {phone|415-555-2671} or {phone|+33 1 23 45 67 89} for help. 계좌 415-555-2671로 보냈다.
{address|테헤란로 152 강남파이낸스센터 20층}에서 열린다.
지난해 반도체 시장은 상반기에 컸다. 이번에 연구소와 편집국이 인터뷰를 했다. 두 갈래로 나뉘어 이어져 있다. 도서관과 박물관은 백화점 옆이다.
새 명단에는 {name|Petra Oakley}, {name|구하윤}, {name|민아을} 등이 올랐다. 이번 명단에는 {name|Bin Haneul}, {name|오온별}, {name|Rasol Kim} 등이 올랐다.
오늘 명단에는 {name|정솔솔}, {name|이온엘}, {name|Haneul Bae} 등이 올랐다. 글·사진 {name|남궁가을} {email|gaeul@press.example}
{name|Haneul Seo}·{name|문라휘} 선수가 나란히 섰다. 글·사진 {name|선우마을} {email|m.sun@press.example}
고용철도 구간은 길다. 조선철도(주)는 새 역을 연다. 마시우 잠정 공사가 끝났다. 늘어난 병원이 병원을 샀다. 이시우 규모가 컸다. 한지원 방안이 나왔다.
혼선이 이어져 시장은 늘었다. 불만이 이어져 값은 내렸다. 시장 두 갈래로 나뉘어 있다. 업계 두 갈래로 갈렸다. 수출도로 500억원 수주, 자료도로 30명 참가, 기계로 12개 생산
새 명단에는 {name|Nara Ma}, {name|Petra Lund}, {name|배나을} 등이 올랐다. 이번 명단에는 {name|진새을}, {name|KIM Dara}, {name|Ivo Bae} 등이 올랐다.
지점을 {address|햇살구 달빛로 14}에서 {address|가온도 햇살군 들꽃로 9-1}로 옮긴다. 공장은 {address|나루시 달빛로3번길 7}에서 {address|가온광역시 햇살구 샘골동 15번지}로 간다.
어제 명단에는 {name|구다란}, {name|민라을}, {name|서별을} 등이 올랐다. 그 명단에는 {name|도가람}, {name|남솔을}, {name|마은을} 등이 있다.
명단에는 {name|민다솔}, {name|구새봄}, {name|Dara Min} 등이 올랐다. 최종 명단에는 {name|채여운}, {name|Rasol Chae}, {name|방한나} 등이 있다.
{name|강두루} 의원이 왔다. 그날 {name|강두루}도 웃었다. {name|유모드} 교수는 앉았다. 곧 {name|유모드}도 갔다. {name|하부기} 시장이 왔고 {name|하부기}도 웃었다.
{name|구초람}·{name|채나란} 선수가 나란히 올랐다. {name|Dara Gu}·{name|방새봄} 선수가 나란히 웃었다.
한빛철도 12곳 수주, 고려철도（Ltd.）이 새 역을 연다. 하늘온(종목코드 030971)은 올랐다.
가운데 단지는 크다. 하나를 고른다. 주민들과 선수가 나란히 섰다. 사무실은 명단에 없다. 차이로 갈렸다. 전했다. 원 규모와 명 규모
""".strip()


#: Registered words among the marked sentences, and how many kinds of links there are.
TRAINING_WORDS = frozenset("도서관 위원회 하반기 연구소 조사위원 이번엔 기술은 성장세 주요국 전담반 신도시 연구별".split())
LINKS = 3


def _marked(lines: str = TRAINING) -> list[tuple[str, set[tuple[int, int, int]]]]:
    out = []
    for line in lines.split("\n"):
        text, spans, last = "", set(), 0
        for m in re.finditer(r"\{(\w+)\|([^}]*)\}", line):
            text += line[last : m.start()]
            spans.add((KINDS.index(m[1]), len(text), len(text) + len(m[2])))
            text += m[2]
            last = m.end()
        out.append((text + line[last:], spans))
    return out


@lru_cache(maxsize=1)
def weights() -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and the strength of both kinds of links, by maximum pseudo-likelihood with a ridge around zero."""
    rows, labels, linked = [], [], []
    for form, spans in _marked():
        text, starts, ends = consistent_spans(form)
        nodes = candidates(text, TRAINING_WORDS)
        for i, j, kind in edges(text, nodes):
            linked.append((len(rows) + i, len(rows) + j, kind))
        for n in nodes:
            a, b = (n.start, n.end) if starts is None else (starts[n.start], ends[n.end - 1])
            rows.append(n.features)
            labels.append((n.kind, a, b) in spans)
    x = np.zeros((len(rows), len(FEATURES)))
    for i, f in enumerate(rows):
        x[i, f] = 1
    y = np.array(labels, np.float64)
    near = np.zeros((len(rows), LINKS))
    for i, j, kind in linked:
        near[i, kind] += 2 * y[j] - 1
        near[j, kind] += 2 * y[i] - 1
    w, s = np.zeros(len(FEATURES)), np.zeros(LINKS)
    for _ in range(ROUNDS_TRAINED):
        p = 1 / (1 + np.exp(-(x @ w + near @ s)))
        w -= RATE * (x.T @ (p - y) / len(y) + RIDGE * w)
        s -= RATE * (near.T @ (p - y) / len(y) + RIDGE * s)
    return w, np.maximum(s, 0.5)


def find_mentions(bodies: list[str | None], words: frozenset[str] = frozenset(), model: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[tuple[str, int, int]]]:
    """For each body its mentions ``(kind, start, end)`` in characters as stored; none for null and empty bodies. ``model`` is what ``weights`` gives."""
    w, s = model or weights()
    docs, unary, links, strength = [], [], [], []
    for body in bodies:
        text, starts, ends = consistent_spans(body or "")
        nodes = candidates(text, words)
        base = len(unary)
        unary += [w[n.features].sum() for n in nodes]
        for i, j, kind in edges(text, nodes):
            links.append((base + i, base + j))
            strength.append(s[kind])
        docs.append((nodes, starts, ends, base))
    odds = propagate(np.array(unary, np.float64), np.array(links, np.int64).reshape(-1, 2), np.array(strength, np.float64))
    out = []
    for nodes, starts, ends, base in docs:
        found = [n for i, n in enumerate(nodes) if odds[base + i] > 0]
        out.append([(KINDS[n.kind], *((n.start, n.end) if starts is None else (starts[n.start], ends[n.end - 1]))) for n in found])
    return out


def redact(body: str, mentions: list[tuple[str, int, int]]) -> str:
    """The body with ``[EMAIL]``, ``[PHONE]``, ``[ID]``, ``[ADDRESS]`` or ``[NAME]`` in place of each mention and all else unchanged."""
    parts, last = [], 0
    for kind, a, b in sorted(mentions, key=lambda m: m[1]):
        parts += [body[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(parts) + body[last:]


def _lexicon(lexicon: DataFrame | None) -> frozenset[str]:
    """Registered words of at least three letters; a list of fixed size, not of the corpus."""
    if lexicon is None:
        return frozenset()
    rows = listed(lexicon.where(F.length("surface") >= 3).select("surface").distinct(), "the lexicon")
    return frozenset(r.surface for r in rows)


def personal_mentions(bodies: DataFrame, lexicon: DataFrame | None = None, redacted: bool = False) -> DataFrame:
    """``(src, row_id, kind, start_pos, end_pos)`` of all mentions in ``(src, row_id, body)``, or ``(src, row_id, body)`` with placeholders.

    ``lexicon`` is ``(surface)``, registered words. Null and empty bodies have no mentions and stay as they are;
    repeated rows give their mentions once. Whole bodies are read, of any length.
    """
    words, model = _lexicon(lexicon), weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("body").to_pylist()
            found = find_mentions(rows, words, model)
            if redacted:
                texts = [r if r is None else redact(r, m) for r, m in zip(rows, found)]
                yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("row_id"), pa.array(texts, pa.string())], ["src", "row_id", "body"])
                continue
            src, ids = batch.column("src").to_pylist(), batch.column("row_id").to_pylist()
            flat = [(s, i, *m) for s, i, ms in zip(src, ids, found) for m in ms]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], kinds[c]) for c in range(5)], ["src", "row_id", "kind", "start_pos", "end_pos"])

    rows = bodies.select("src", "row_id", "body")
    if redacted:
        return rows.mapInArrow(run, "src string, row_id bigint, body string")
    return rows.mapInArrow(run, "src string, row_id bigint, kind string, start_pos bigint, end_pos bigint").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The mentions of personal information in both article tables, see TESTDATA.md."""
    return personal_mentions(records(spark, folder), table(spark, folder, "lexicon", "surface"))


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies of both article tables with typed placeholders in place of personal information."""
    return personal_mentions(records(spark, folder), table(spark, folder, "lexicon", "surface"), redacted=True)


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
ORACLES: dict[str, str] = {}
