from wordmine.llm.sentences import list_items, sentence_spans, sentence_units


def units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


CASES = {
    "값이 3.5% 늘었다. 다음은 2019. 3. 5. 열린다.뒤 문장이다.": ["값이 3.5% 늘었다.", "다음은 2019. 3. 5. 열린다.", "뒤 문장이다."],
    "Mr. A. B. Lee met Dr. Kim at 5 p.m. on Jan. 3. He left e.g. early.": ["Mr. A. B. Lee met Dr. Kim at 5 p.m. on Jan. 3.", "He left e.g. early."],
    "그는 “어렵다. 그래도 한다.”라고 말했다. (참고: 끝. 단, 예외) 있다.": ["그는 “어렵다. 그래도 한다.”라고 말했다.", "(참고: 끝. 단, 예외) 있다."],
    "그러나… 줄었다. 정말 들었다… 다음이다. 왜 그랬을까!? 모른다": ["그러나… 줄었다.", "정말 들었다…", "다음이다.", "왜 그랬을까!?", "모른다"],
    "他说：“风大。不能去。”船停了。37辆够吗？够！": ["他说：“风大。不能去。”", "船停了。", "37辆够吗？", "够！"],
    "「風が強い。まだだ」と話した。行こう！": ["「風が強い。まだだ」と話した。", "行こう！"],
    "काम पूरा है। डॉ. राय ने “हाँ। ठीक।” कहा।": ["काम पूरा है।", "डॉ. राय ने “हाँ। ठीक।” कहा।"],
    "มีรถ 33 คัน ชาวบ้านรอรถ อยู่หน้าบ้าน": ["มีรถ 33 คัน", "ชาวบ้านรอรถ", "อยู่หน้าบ้าน"],
    "제목\n\n<저작권자 x. 무단 금지>\r\n \r\n본문이\n이어진다.\n#가 #나": ["제목", "<저작권자 x. 무단 금지>", "본문이\n이어진다.", "#가 #나"],
    "메일 a.b@c.example 또는 www.d.example/x?y=2.1에 있다. 끝": ["메일 a.b@c.example 또는 www.d.example/x?y=2.1에 있다.", "끝"],
    "끝났다.A.I. 기반이다.St. 올란": ["끝났다.", "A.I. 기반이다.", "St. 올란"],
    "​ 앞﻿이다. ⁠뒤다.​": ["앞﻿이다.", "뒤다."],
    "02)123-4567 열린 (괄호다. 그리고 끝이다.": ["02)123-4567 열린 (괄호다.", "그리고 끝이다."],
    "": [], " \n\t ": [], ".": ["."], "...": ["..."],
}


def test_units():
    for text, want in CASES.items():
        assert units(text) == want, text


def test_single_line_break_of_any_kind_does_not_end_a_unit():
    for br in ("\r\n", "\n", "\r"):
        for text in (f"본문이{br}이어진다.", f"열린 (괄호가{br}길다. 그래도) 이어진다.", f"그는 “어렵다.{br}그래도 한다.”라고 말했다.", f"on Jan.{br}3 he left"):
            assert units(text) == [text], text
        assert units(f"가다{br}{br}나다{br} {br}다다{br}라다") == ["가다", "나다", f"다다{br}라다"]
    assert units("가다\r\n\n나다\n\r\n다다\r\r\n라다") == ["가다", "나다", "다다", "라다"]


def test_long_text_and_order():
    text = "한 문장이다. " * 20000
    spans = sentence_spans(text)
    assert len(spans) == 20000 and all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:]))


def test_operator(bodies):
    got = sentence_units(bodies([("text", 1, "가다. 나다."), ("text", 1, "가다. 나다."), ("text", 2, None), ("text", 3, ""), ("longtext", None, "x")])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("text", 1, 0, 3), ("text", 1, 4, 7), ("longtext", None, 0, 1)], key=str)
    assert sentence_units(bodies([])).count() == 0


def _units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_list_levels():
    assert _units("(1) 가. 첫째 항목이다. 다음이다.") == ["(1) 가. 첫째 항목이다.", "다음이다."]
    text = "1. Item one is here.\n   a) Sub item one. Done.\n   b) Sub item two.\n2. Item two"
    assert _units(text) == ["1. Item one is here.", "a) Sub item one.", "Done.", "b) Sub item two.", "2. Item two"]
    assert [level for _, level in list_items(text, 0, len(text)).values()] == [0, 1, 1, 0]
    assert _units("가. 첫째\n나. 둘째\n  1) 하나\n  2) 둘\n다. 셋째") == ["가. 첫째", "나. 둘째", "1) 하나", "2) 둘", "다. 셋째"]
    assert _units("- one\n- two\n- three") == ["- one", "- two", "- three"]
    assert _units("끝났다.\n3. TAXO는 늘었다.") == ["끝났다.", "3. TAXO는 늘었다."]
    assert _units("그는 2018. 4.\n24. 바이오에서 왔다.") == ["그는 2018. 4.\n24. 바이오에서 왔다."]
    assert _units("“보라\n1. 하나\n2. 둘”이라고 했다.") == ["“보라\n1. 하나\n2. 둘”이라고 했다."]


def test_terminators_of_more_scripts():
    for mark in "\u17d4\u17d5\u104b\u0f0d\u1362\u0964":
        assert _units(f"ក{mark}ខ{mark}{mark} គ") == [f"ក{mark}", f"ខ{mark}{mark}", "គ"]


def test_long_runs_take_linear_time():
    assert len(_units("a.b" * 200_000)) == 1
    assert len(_units("".join(f"{k % 900 + 1}) (가) “나.” 다.\n" for k in range(30_000)))) >= 30_000
