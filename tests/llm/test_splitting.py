import random

import pytest

from millrace.llm import sentences, splitting


def test_cores_are_the_text_and_pieces_keep_the_limit():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choices("字词。，\n a；“”", weights=[30, 20, 3, 4, 1, 3, 3, 1, 1, 1], k=rng.randint(0, 4000)))
        ends = [i + 1 for i, c in enumerate(text) if c == "。"]
        parts = splitting.pieces(text, ends, 300, 40)
        assert "".join(text[c:e] for _, c, e in parts) == text
        assert all(e - s <= 300 and c - s <= 40 for s, c, e in parts)
        assert all(a[2] == b[1] for a, b in zip(parts, parts[1:]))


def test_weak_boundaries_are_merged_first():
    text = ("甲" * 60 + "，") * 3 + "\n\n" + ("乙" * 60 + "，") * 3
    assert [(c, e) for _, c, e in splitting.pieces(text, [], 250, 20)] == [(0, 185), (185, len(text))]


def test_without_any_boundary_the_cut_is_even():
    parts = splitting.pieces("长" * 2000, [], 800, 100)
    assert all(e - s <= 800 for s, _, e in parts) and parts[1][1] - parts[1][0] == 100
    with pytest.raises(ValueError):
        splitting.pieces("长" * 900, [], 800, 800)


def test_rows(spark):
    long = "甲乙丙丁。" * 100 + "\n\n" + "戊己庚辛。" * 100
    chunks = spark.createDataFrame([("a", long, (3, 4)), ("a", long, (3, 4)), ("b", "短", (0, 0)), ("c", None, None), ("d", "长" * 900, None)], "chunk_id string, chunk_text string, paragraph_range struct<start: int, end: int>")
    docs = spark.createDataFrame([("x", [None, "短", "长" * 801]), ("y", None)], "doc_id string, paragraphs array<string>")
    model = sentences.train(chunks, "chunk_id", "chunk_text")
    items = splitting.chunk_items(chunks).unionByName(splitting.paragraph_items(docs))
    rows = splitting.split(items, model).collect()
    assert {(r.field_name, r.record_id, r.item_no, r.forced) for r in rows} == {("chunk_text", "a", 0, 0), ("chunk_text", "d", 0, 1), ("paragraphs", "x", 2, 1)}
    own = sorted((r for r in rows if r.record_id == "a"), key=lambda r: r.piece_no)
    assert [(r.paragraph_range.start, r.paragraph_range.end) for r in own][0] == (3, 3) and own[-1].paragraph_range.end == 4
    assert all(r.paragraph_range is None for r in rows if r.record_id == "d")
    assert all(r.text == long[r.start_pos : r.end_pos] for r in own)


def test_a_sentence_that_fits_the_limit_is_not_cut_inside():
    first, long, last = "前文在此说明情况。" * 30, "贷款，期限" * 150 + "。", "后文再作补充说明。" * 30
    text = first + long + last
    ends = [*range(9, len(first) + 1, 9), len(first) + len(long), *range(len(first) + len(long) + 9, len(text) + 1, 9)]
    got = splitting.pieces(text, ends)
    assert (len(first), len(first) + len(long)) in [(core, end) for _, core, end in got]
    assert all(end - start <= 800 for start, _, end in got) and all(core in (0, *ends) for _, core, _ in got)
    assert "".join(text[core:end] for _, core, end in got) == text


def test_ranges_are_those_of_the_paragraphs_that_a_piece_touches():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choices(["字", "a", " ", "\n", "\n\n", "。"], weights=[6, 3, 1, 2, 1, 1], k=rng.randint(1, 120)))
        paragraph, number, at = [], 0, 0
        seen = False
        while at < len(text):
            if text[at].isspace():
                end = at
                while end < len(text) and text[end].isspace():
                    end += 1
                number += seen and end < len(text) and text[at:end].count("\n") > 1
                paragraph += [None] * (end - at)
                at = end
            else:
                seen = True
                paragraph.append(number)
                at += 1
        cuts = [(a, a, b) for a in range(0, len(text), 7) for b in (min(a + 11, len(text)),)]
        for (a, _, b), got in zip(cuts, splitting.ranges(text, cuts, 5, 999)):
            touched = [p for p in paragraph[a:b] if p is not None]
            if touched:
                assert got == {"start": 5 + touched[0], "end": 5 + touched[-1]}, text
    assert splitting.ranges("字", [(0, 0, 1)], None, 3) == [None]


def test_long_items_take_linear_time():
    import time

    rng = random.Random(2)
    text = "".join(rng.choices("种植大户应当提交身份证明和用款计划，。；\n", k=1_000_000))
    began = time.time()
    parts = splitting.pieces(text, [i + 1 for i, c in enumerate(text) if c == "。"])
    splitting.ranges(text, parts, 0, 10**6)
    assert time.time() - began < 20 and "".join(text[c:e] for _, c, e in parts) == text
