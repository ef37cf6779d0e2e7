import numpy as np

from wordmine.llm import personal as P


def found(text):
    return {(k, text[a:b]) for k, a, b in P.find_mentions([text])[0]}


def test_training_sentences_are_learnt():
    wrong = [t for t, spans in P._marked() if {(P.KINDS.index(k), a, b) for k, a, b in P.find_mentions([t], P.TRAINING_WORDS)[0]} != spans]
    assert len(wrong) <= 3, wrong


def test_notations():
    text = "[한빛일보 김도담 기자] 문의 ｄｅｓｋ@p​ress.example, 전화 +82 (0)10 1234 5678. 주소는 가온시 햇살로 12, 3층로 적혀 있다."
    assert found(text) == {("name", "김도담"), ("email", "ｄｅｓｋ@p​ress.example"), ("phone", "+82 (0)10 1234 5678"), ("address", "가온시 햇살로 12, 3층")}
    assert ("phone", "(02) 123-4567") in found("▶ 제보하기 (02) 123-4567") and ("phone", "02)123-4567") in found("▶ 제보하기 02)123-4567")
    assert found("Mr. Alan Brook said so.") == {("name", "Alan Brook")}
    assert ("address", "12 Maple Hill Road, Apt 3, Port Haven") in found("The depot at 12 Maple Hill Road, Apt 3, Port Haven was closed.")


def test_what_does_not_count():
    for text in ("가려진 번호 010-****-1234", "공식 계정 @news_1234에", "주문번호 20211234-1234567을", "사업자등록번호 123-81-12345로", "도서번호 979-11-1234-12-3이", "900101-1******", "남궁씨는 말했다.", "위성은 떴다."):
        assert found(text) == set(), text


def test_repetition_carries_evidence():
    assert [m for m in P.find_mentions(["장보유 위원장은 왔다. 그 뒤 장보유도 떠났다."])[0] if m[0] == "name"] == [("name", 0, 3), ("name", 17, 20)]


def test_messages_agree_with_enumeration():
    unary, links, strength = np.array([1.5, -0.4, -0.2]), np.array([[0, 1], [1, 2]]), np.array([2.0, 1.0])
    weights = np.zeros(3), np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        score = np.exp(np.dot(unary, y) + sum(s for (a, b), s in zip(links, strength) if y[a] == y[b]))
        for i in range(3):
            weights[y[i]][i] += score
    assert np.allclose(P.propagate(unary, links, strength, 60), np.log(weights[1] / weights[0]), atol=1e-4)


def test_links_grow_with_the_nodes():
    text = "김하늘 기자. " * 500
    nodes = P.candidates(text)
    assert len(P.edges(text, nodes)) <= 3 * len(nodes)


#: Everyday sentences in other words and shapes than the training sentences; ``{kind|mention}``.
HELD_OUT = """
어제 {name|박보검} 배우가 제주를 찾았다. 관객은 손을 흔들었다.
{name|유재석}이 사회를 맡았다. 안정성은 높아졌고 이용자는 늘었다.
회의에는 {name|강민호} 전무와 {name|오은영} 박사가 참석했다.
{name|황보라} 배우와 {name|제갈량} 장군의 이야기다.
주민등록번호는 {id|850412-2345678}이고 여권번호는 {id|M87654321}이다.
외국인등록번호 {id|920511-6123456} 확인 바랍니다.
문의는 {email|help.desk@school.ac.kr} 또는 {phone|02-2123-4567}로 주세요.
제보는 {phone|010-9876-5432}, 팩스는 {phone|031-987-6543}입니다.
접수처는 {address|서울특별시 마포구 월드컵북로 396 누리꿈스퀘어 9층}입니다.
본사는 {address|부산광역시 해운대구 센텀중앙로 97}에 있다.
{address|세종대로 110 서울시청 5층}에서 만나자.
사업자등록번호 214-86-12345, 주문번호 20230915-0001234.
국제표준도서번호 ISBN 978-89-1234-567-8이 붙었다.
배구 감독이 바뀌었고 연구 교수가 새로 왔다. 기업 대표는 없었다.
정부는 지원금을 늘렸다. 전문가는 반대했다. 이재민은 학교로 옮겼다.
I met {name|Emily Carter} and {name|Carlos Mendes} in Madrid last spring.
Dr. {name|Susan Miller} called {phone|212-555-0147} twice.
Reach us at {phone|+44 20 7946 0958} or {email|jobs@company.co.uk} today.
Ship it to {address|221 Baker Street, London} before noon.
New York and Los Angeles are large cities. Big Ben was silent.
{name|王芳}女士和{name|刘伟}先生参加了会议。
{name|佐藤 健}さんは駅で待っていた。
가격은 1,234-5,678원 사이다. 2023-09-15 14:00에 시작한다.
이번 주말 전국에 비가 온다. 조합은 방안을 냈다. 한국은 이겼다.
"""


def test_held_out_sentences():
    right = wrong = missed = 0
    for text, spans in P._marked(HELD_OUT.strip()):
        got = {(P.KINDS.index(k), a, b) for k, a, b in P.find_mentions([text])[0]}
        right, wrong, missed = right + len(got & spans), wrong + len(got - spans), missed + len(spans - got)
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9, (right, wrong, missed)


def test_similar_tokens_are_linked():
    text = "Mr. Alan Brook said so. A. Brook left. 전화 +82 10 1234 5678, 010-1234-5678"
    nodes = P.candidates(text)
    linked = {(text[nodes[i].start : nodes[i].end], text[nodes[j].start : nodes[j].end]) for i, j, kind in P.edges(text, nodes) if kind == 2}
    assert linked == {("Alan Brook", "A. Brook"), ("+82 10 1234 5678", "010-1234-5678")}


def test_many_mentions_take_linear_time():
    assert len(P.find_mentions(["글·사진 김하늘 a@b.example 010-1234-5678\n" * 5000])[0]) == 15000


def test_operator(bodies, spark):
    data = [("text", 1, "글·사진 김하늘 a@b.example"), ("text", 1, "글·사진 김하늘 a@b.example"), ("text", 2, None), ("text", 3, ""), ("text", None, "x")]
    got = {(r.row_id, r.kind, r.start_pos, r.end_pos) for r in P.personal_mentions(bodies(data)).collect()}
    assert got == {(1, "name", 5, 8), (1, "email", 9, 20)} and P.personal_mentions(bodies(data)).count() == 2
    lexicon = spark.createDataFrame([("도서관",), (None,)], "surface string")
    texts = {r.row_id: r.body for r in P.personal_mentions(bodies(data), lexicon, redacted=True).collect()}
    assert texts == {1: "글·사진 [NAME] [EMAIL]", 2: None, 3: "", None: "x"}
    assert P.personal_mentions(bodies([])).count() == 0
