import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import encodings as enc


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = "贷款 期限 申请 条件 养殖大户 提交 身份证明 由 村民委员会 核对台账 并 登记备案 最长 十二个月 县 农业农村局 负责 解释".split()
    out = ["".join(rng.choices(words, k=rng.randint(8, 25))) + "。" for _ in range(700)]
    out += [f"面积以m²计量的第{n}处果园由ＡＢ{n}号窗口登记。" for n in range(40)]
    out += [f"Die Müller müssen Verträge für Löhne {n} Jahre aufbewahren, sagte Frau Größl." for n in range(80)]
    return out


@pytest.fixture(scope="module")
def model(texts):
    return enc.fit(texts)


@pytest.mark.parametrize("pair", [("utf-8", "gb18030", 1), ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "koi8-r", 1), ("utf-8", "cp1252", 2), ("gb18030", "latin-1", 1), ("utf-8", "cp437", 1), ("utf-8", "mac_roman", 1)])
def test_garbled_text_is_found_and_restored(spark, model, texts, pair):
    good = texts[5]
    bad = enc.garble(good, pair)
    df = spark.createDataFrame([("d", [texts[1], bad, None, texts[2] + bad + texts[3]])] * 2 + [("n", None), ("e", [])], "doc_id string, paragraphs array<string>")
    rows = sorted(enc.garbled_paragraphs(df, "doc_id", "paragraphs", model).collect(), key=lambda r: r.para_no)
    assert [(r.doc_id, r.para_no) for r in rows] == [("d", 1), ("d", 3)]
    if rows[0].whole:
        assert rows[0].restored == good
    assert rows[0].whole or "�" in bad


def test_lost_text_is_found_but_not_whole(spark, model, texts):
    bad = texts[7].encode("gb18030").decode("utf-8", "replace")
    df = spark.createDataFrame([("d", [bad])], "doc_id string, paragraphs array<string>")
    row = enc.garbled_paragraphs(df, "doc_id", "paragraphs", model).first()
    assert row is not None and not row.whole or row.restored != texts[7]


def test_genuine_foreign_words_are_not_found(spark, model):
    fine = ["Die Müller müssen Verträge für Löhne aufbewahren.", "Café", "种植大户与“Урожай”合作。", "面积以m²计量", "", "ＡＢＣ１２３"]
    df = spark.createDataFrame([("d", fine)], "doc_id string, paragraphs array<string>")
    assert enc.garbled_paragraphs(df, "doc_id", "paragraphs", model).count() == 0


def test_round_trip_of_single_byte_tables():
    every = bytes(range(256))
    for name in enc.SINGLE:
        assert enc.write(enc.read(every, name), name, "strict") == every or len(set(enc.byte_table(name)[0])) < 256


def test_empty_table(spark):
    assert enc.garbled_paragraphs(spark.createDataFrame([], "doc_id string, paragraphs array<string>"), "doc_id", "paragraphs").count() == 0


def test_short_spans_need_known_characters_or_certainty():
    known = frozenset("附则")
    pair = ("gb18030", "latin-1", 1)
    assert enc.restored_span("¸½Ôò", pair, known, 7.0) == ("附则", True, pair)
    assert enc.restored_span("¸½Ôò", pair, frozenset("贷"), 7.0) is None
    assert enc.restored_span("¸½Ôò¸", pair, frozenset("贷"), 25.0) == ("¸½Ôò¸", False, pair)


def test_known_characters_are_those_of_all_documents(spark, model, texts):
    name = "齉龘"  # in no text that the model was fitted on
    bad = enc.garble(name, ("gb18030", "latin-1", 1))
    rows = [("a", [texts[1] + name, texts[2] + name]), ("b", [bad, texts[3]])]
    got = enc.garbled_paragraphs(spark.createDataFrame(rows, "doc_id string, paragraphs array<string>"), "doc_id", "paragraphs", model).collect()
    assert [(r.doc_id, r.restored) for r in got if r.doc_id == "b"] in ([], [("b", name)])


def test_whole_texts_are_restored(spark, model, texts):
    bad = enc.garble(texts[5], ("utf-8", "cp1252", 1))
    rows = [("d", texts[1] + "\n" + bad + "\n\n" + texts[2], 1), ("d", texts[1] + "\n" + bad + "\n\n" + texts[2], 1), ("e", None, 2), ("f", texts[3], 3)]
    got = enc.restored_texts(spark.createDataFrame(rows, "doc_id string, raw_text string, own int"), "doc_id", "raw_text", model).collect()
    assert [(r.doc_id, r.restored, r.whole) for r in got] == [("d", texts[1] + "\n" + texts[5] + "\n\n" + texts[2], True)]


def test_all_records_are_fitted_on(spark, texts):
    lists = [(str(n), [f"第{chr(0x5000 + n)}{chr(0x6000 + n)}号", None, "", t]) for n, t in enumerate(texts)] + [("n", None), ("g", [enc.garble(texts[5], ("utf-8", "cp1252", 1)), texts[6]])]
    df = spark.createDataFrame(lists, "doc_id string, paragraphs array<string>").repartition(5)
    got, want = enc.train(df, "doc_id", "paragraphs"), enc.fit([t for _, ps in lists for t in ps or []])
    assert {0x5000 + n for n in range(len(texts))} <= set(got.points.tolist())
    assert (got.points == want.points).all() and (got.gain == want.gain).all()


def test_counts_are_those_of_the_garbled_texts(texts):
    some = [*texts[:3], *texts[-2:], texts[702], "𠀀é€\U0010ffff", "ｱ\nБ", "末" * (enc.PIECE + 7)]
    tally = enc.Tally()
    tally.garbled(some)
    for k, pair in enumerate(enc.PAIRS):
        fitting = [t for t in some if pair[0] in ("utf-8", "gb18030") or enc._writable(t, pair[0])]
        points, offsets = enc._flat([enc.garble("".join(t + "\n" for t in fitting) + enc.AHEAD, pair)[: -len(enc.AHEAD)]])
        keys, counts = tally.of(1 + k)
        assert dict(zip(keys.tolist(), counts.tolist())) == Counter(enc._pair_keys(points, offsets).tolist()), pair
    other = enc.Tally()
    other.gather(tally.rows())
    assert all((other.slots[k] == x).all() for k, x in tally.slots.items())


def test_rows_that_are_no_suspects_have_no_spans(model, texts):
    rows = [*texts[:30], "", *(texts[n] + enc.garble(texts[n + 1], pair) for n, pair in enumerate(enc.PAIRS)), "f√ºr", "Café", *(texts[700:720])]
    flat = enc._flat(rows)
    every = enc.label(*flat, model, np.arange(len(rows))[np.diff(flat[1]) > 0])
    assert sorted(every) == sorted(enc.label(*flat, model, enc.suspects(*flat, model))) and every


def test_a_large_share_of_garbled_text_is_not_taken_for_clean(spark, texts):
    """Short entries are found though the long ones garbled alike are in the texts that are fitted on."""
    pair = ("utf-8", "koi8-r", 1)
    long = [enc.garble(t, pair) for t in texts[:60]]
    model = enc.fit([*texts, *long])
    flat = enc._flat([enc.garble("附则", pair), "附则"])
    assert {row for row, *_ in enc.label(*flat, model, enc.suspects(*flat, model))} == {0}
