import numpy as np
import pyarrow as pa
import pytest

from millrace.functions.codepoints import decode
from millrace.llm import quality

WORDS = ["的", "和", "the", "of", "to"]
PROSE = "种植大户应当向村民委员会提交身份证明和用款计划。县农业农村局负责核对台账的内容，并在七日内公布。\n逾期未办的，视为放弃申请。"


def test_kinds(spark):
    rows = [
        (1, PROSE, "prose"), (2, "1. 苹果\n2. 柑橘\n3. 葡萄\n4. 大豆", "list"), (3, "甲|1.5|2020-01-01\n乙|2.5|2021-01-01\n丙|3.5|2022-01-01", "table"), (4, "." * 300, "junk"), (5, "加载中 1\n" * 30, "junk"),
        (6, "<div class=\"c6\"></span>var x={};null,undefined</span>{};();" * 3, "junk"), (7, "申请 ........ 1\n期限 ........ 4\n材料 ........ 7", "list"), (8, None, None), (9, "  \n ", None), (10, PROSE + "\n1. 苹果\n2. 柑橘", "prose"), (11, PROSE * 3000, None),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, kind string")
    got = {r.doc_id: r for r in quality.statistics(df, "doc_id", "text", WORDS).collect()}
    assert {i: got[i].kind for i, _, k in rows if i != 11} == {i: k for i, _, k in rows if i != 11}
    assert got[8].chars == 0 and got[8].symbol_ratio == 0
    assert got[11].kind == "junk"  # endless repetition


TEXTS = [
    "The farms of Liwu, etc. " * 40 + "\n" + PROSE * 5 + "\n\n| a | 1 |\n", "", "x" * 50, "a.b. c.. 3.5 .", "甲" * 33 + "....... 12\n", "  - 一\n\n\r\n  two  words   here  \n" * 7, "\n\n\n", " \t ", "and the" + "k" * 24 + " of,of;of|to\t" * 9, "1.甲\n2.乙\n12)丙\n-\n- 丁",
]


def folded(chunks, vocabulary, rng):
    """Any order of merging neighbours."""
    states = [quality.partial(c, vocabulary) for c in chunks]
    lines = [h for s in states for h in s["line_hashes"]]
    grams = [h for s in states for h in s["gram_hashes"]]
    while len(states) > 1:
        k = rng.integers(len(states) - 1)
        states[k : k + 2] = [quality.merged(*states[k : k + 2], vocabulary)]
        lines += states[k]["line_hashes"]
        grams += states[k]["gram_hashes"]
    total, last = quality.finished(states[0])
    by = dict(zip(quality.COUNTS, total.tolist()))
    return by | {"repeated_lines": by["lines"] - len(set(lines + last)), "repeated_grams": by["grams"] - len(set(grams))}


def test_any_cut_and_any_order_of_merging_give_the_whole():
    vocabulary, rng = quality.Vocabulary(WORDS), np.random.default_rng(1)
    alphabet = list("ab the.，。 \n\n\t|,;一1-甲的…·")
    texts = [*TEXTS, *("".join(rng.choice(alphabet, rng.integers(0, 300))) for _ in range(60))]
    whole = quality.counts(*decode(pa.array(texts)), vocabulary)
    for k, text in enumerate(texts):
        alone = quality.counts(*decode(pa.array([text])), vocabulary)[0]
        assert (alone == whole[k]).all(), text  # neighbours in a batch do not matter
        points = decode(pa.array([text]))[0]
        for size in (1, 2, 3, 7, 17, 64, 1000):
            got = folded([points[i : i + size] for i in range(0, max(1, len(points)), size)], vocabulary, rng)
            assert got == dict(zip(quality.COUNTS, whole[k].tolist())), (size, text)


def test_chunks_spread_over_tasks_give_the_whole(spark):
    rows = [*enumerate(TEXTS), (50, PROSE * 400), (51, None), (51, "甲乙"), (52, "字" * 9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.doc_id: r for r in quality.statistics(df, "doc_id", "text", WORDS).collect()}
    for size in (17, 1000):
        assert {r.doc_id: r for r in quality.statistics(df, "doc_id", "text", WORDS, size).collect()} == want


def test_repeated_sequences_are_those_of_the_whole_text(spark):
    rng = np.random.default_rng(9)
    block = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 50_000)))
    text = "前" + block * 10
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = quality.statistics(df, "doc_id", "text", WORDS).first()
    assert got.grams == 500_001 - 9 and got.repeated_grams == 450_000 - 9 and got.kind == "junk"


def test_plain_counts():
    text = "Hello the World. 的\n第二行，没有\n"
    m = quality.counts(*decode(pa.array([text])), quality.Vocabulary(WORDS))
    got = dict(zip(quality.COUNTS, m[0]))
    assert got["words"] == 3 + 1 + 5 and got["common"] == 2 and got["lines"] == 2 and got["ended_lines"] == 0 and got["chars"] == len(text)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert quality.statistics(df, "doc_id", "text", WORDS).count() == len(rows)
