import random
import unicodedata

import pyarrow as pa
import pytest

from millrace.functions.codepoints import decode, encode

from millrace.llm import lookalikes

CHANGED = [
    ("２０２２年ＡＢｃ", "2022年ABc"), ("Café", "Café"), ("ấ", "ấ"), ("社​会﻿⁠­", "社会"), ("Ver. 18", "Ver. 18"), ("a　b", "a b"),
    ("⼈⼯", "人工"), ("ﾄﾗｸﾀｰ", "トラクター"), ("ﬁled", "filed"), ("АgriPlus", "AgriPlus"), ("КР-12А产品", "KP-12A产品"), ("cold stοrage", "cold storage"), ("大︀棚", "大棚"), ("4．77％", "4.77%"), ("ｶﾞ", "ガ"),
]
SAME = ["“Урожай”，面积m²，①号。", "β系数调整", "पशु‌पालक क्‍ष", "São Çelo, Müller", "第一条（试行）：对吗？！；～", "กำหนด", "¥500——…", "Он идёт", ""]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, a, "t") for i, (a, _) in enumerate(CHANGED)] + [(100 + i, a, "t") for i, a in enumerate(SAME)] + [(999, None, "t")], "i int, body string, changed string")
    return {r.i: r for r in lookalikes.one_form(df, "body", ["i"]).collect()}


def test_stand_ins_are_replaced(rows):
    assert [rows[i].text for i in range(len(CHANGED))] == [b for _, b in CHANGED]
    assert all(rows[i].changed for i in range(len(CHANGED)))


def test_ordinary_spelling_stays(rows):
    assert [rows[100 + i].text for i in range(len(SAME))] == SAME
    assert not any(rows[100 + i].changed for i in range(len(SAME)))
    assert rows[999].text is None and rows[999].changed is False


def test_the_form_is_stable(spark, rows):
    again = spark.createDataFrame([(r.i, r.text) for r in rows.values()], "i int, body string")
    assert not any(r.changed for r in lookalikes.one_form(again, "body", ["i"]).collect())


def form(texts):
    points, offsets, changed = lookalikes.normalise(*decode(pa.array(texts, pa.string())))
    return encode(points, offsets).to_pylist(), changed.tolist()


def test_marks_are_ordered_and_composed_as_in_form_c():
    words = ["한국어 문장입니다 값", "Tiếng Việt có dấu: ặ ộ ữ ỗ", "שָׁלוֹם עֲלֵיכֶם", "e\u0302\u0323 e\u0323\u0302 \u00ea\u0323", "a\u0316\u0302", "o\u0304\u0328", "\u0c46\u0c56 \u09c7\u09be", "ế̂", "q\u0307\u0323", "กํ่า", "क़ क\u093c"]
    for text in words:
        for stored in (text, unicodedata.normalize("NFD", text), unicodedata.normalize("NFC", text)):
            got, _ = form([stored])
            assert got == [unicodedata.normalize("NFC", stored)], (stored, got)
            assert form(got) == (got, [False])
    rng = random.Random(7)
    pool = ["a", "e", "o", "ê", "ặ", "\u0302", "\u0323", "\u0328", "\u0304", "\u0316", "\u0345", "한", "하", "\u1112", "\u1161", "\u11ab", "ש", "\u05c1", "\u05b8", "字", " "]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(3000)]
    want = [unicodedata.normalize("NFC", t) for t in texts]
    got, changed = form(texts)
    assert got == want and changed == [a != b for a, b in zip(texts, want)]


def test_more_look_alikes():
    texts = ["\u13aa\u0441me", "l\u0251nd", "\u2173 \u216b", "ᎪᏟ Mill", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ"]
    assert form(texts) == (["Acme", "land", "iv XII", "AC Mill", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ"], [True, True, True, True, False])


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "ａ字" * 300_000)], "i int, body string")
    r = lookalikes.one_form(df, "body", ["i"]).first()
    assert r.text == "a字" * 300_000 and r.changed
    assert lookalikes.one_form(df.limit(0), "body", ["i"]).count() == 0
