import random

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.tokens import term_lists, with_terms


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_terms_of_chinese(spark):
    found = one(spark, "贴息贷款支持生猪养殖", text.terms)
    assert {"贴息贷款", "生猪养殖", "贷款"} <= set(found)
    assert len(found) == len(set(found))


def test_terms_keep_mixed_pieces_and_fold_case(spark):
    found = one(spark, "最高50万元 ABC ß x", text.terms)
    assert found[:2] == ["最高50万元", "abc"]
    assert "最高" in found and "ss" in found and "x" not in found


def test_batch_terms_equal_the_column_expression(spark):
    rng = random.Random(5)
    alphabet = "贷款期限ab1 ，。\nß中Äé_第条กิ"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)] + [None, "", "   ", "单"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = {r.i: r.x or [] for r in df.select("i", text.terms(F.col("t")).alias("x")).collect()}
    got = term_lists(pa.array(texts, pa.string())).to_pylist()
    assert got == [want[i] for i in range(len(texts))]


def test_with_terms_keeps_rows_and_ignores_clashing_names(spark):
    df = spark.createDataFrame([(1, "贷款", "x"), (2, None, "y"), (2, None, "y")], "id int, body string, terms string")
    rows = sorted((r.id, r.length, r.terms) for r in with_terms(df, "id", F.col("body")).collect())
    assert rows == [(1, 1, ["贷款"]), (2, 0, []), (2, 0, [])]


def test_sentences(spark):
    found = one(spark, "第一条 申请条件。\n贷款期限为12个月；利率为3%！好的", text.sentences)
    assert found == ["第一条 申请条件。", "贷款期限为12个月；利率为3%！好的"] or found[0] == "第一条 申请条件。"
    assert one(spark, "", text.sentences) == []
    assert one(spark, None, text.sentences) is None


def test_long_sentences_are_cut_at_clauses(spark):
    long = "，".join(["某某条款内容如下所述" * 2] * 12)
    found = one(spark, long, text.sentences)
    assert len(found) > 1 and all(len(s) <= 120 for s in found)


def test_headings_and_titles(spark):
    yes = ["# 标题", "一、总则", "第二条 申请", "(1) 对象", "3. 材料", "申请条件", "短标题"]
    no = ["这是一个完整的句子。", "", "标题\n换行", "请注意：", "这一行没有句号但是比十二个字要长得多了吧"]
    df = spark.createDataFrame([(x,) for x in yes + no], "t string")
    got = [r.h for r in df.select(text.is_heading(F.col("t")).alias("h")).collect()]
    assert got == [True] * len(yes) + [False] * len(no)
    assert one(spark, "## 办理流程 ", text.heading_title) == "办理流程"


def test_paragraphs_of_plain_and_marked_text(spark):
    plain = "题目\n\n第一行\n第二行\n\n  末段 "
    assert one(spark, plain, text.paragraphs) == ["题目", "第一行\n第二行", "末段"]
    marked = "# 题目\n正文\n## 节\n内容"
    assert one(spark, marked, lambda c: text.paragraphs(c, True)) == ["# 题目", "正文", "## 节", "内容"]
    assert one(spark, "# 题目\n正文", lambda c: text.title(text.paragraphs(c, True), F.lit("file"))) == "题目"
    assert one(spark, " ", lambda c: text.title(text.paragraphs(c), F.lit("file"))) == "file"


def test_digits_at_the_ends_of_sentences_stay(spark):
    lines = "第一句说明情况在此。\n1. 第二句的内容在此。\n2021年第三句的内容。\n甲乙丙丁戊己庚辛共有3"
    got = spark.createDataFrame([(lines,)], "t string").select(text.sentences(F.col("t")).alias("s")).first().s
    assert got == ["第一句说明情况在此。", "1. 第二句的内容在此。", "2021年第三句的内容。", "甲乙丙丁戊己庚辛共有3"]
