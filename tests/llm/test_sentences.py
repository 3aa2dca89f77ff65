import random

import pyarrow as pa
import pytest

from millrace.functions.codepoints import decode
from millrace.llm import sentences

CHINESE = ["窗口人员通常会问“你家种了多少亩？去年卖给谁？”再决定是否核对台账。", "监督检查组在答复中称：“今年额度够用。请放心申请。”", "首次申请的主体须登记备案。", "种植大户可凭身份证明办理续期，并由县财政局核对。"]


def english(rng):
    opening = rng.choice(["At branch No. {}, farms", "The board", "Under Art. {}, growers", "Since Nov. {}, mills", "For loans of {} yuan, crews", "Outside Liwu, nurseries"])
    middle = rng.choice([" wait", " post 4.5 tons", " meet Harrow Co. Ltd. agents", " keep approx. {} files", " ask the panel"])
    end = rng.choice([" for the file", ", etc", " in writing", " on day {}", " with the desk", ""])
    return (opening + middle + end).format(*(rng.randint(1, 30) for _ in range(3))) + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(9)
    paragraph = lambda one: " ".join(one(rng) for _ in range(rng.randint(2, 5)))
    body = ["\n\n".join(paragraph(english) for _ in range(3)) for _ in range(400)]
    body += ["\n\n".join("".join(rng.choices(CHINESE, k=3)) for _ in range(3)) for _ in range(200)]
    return sentences.fit(pa.array(body))


def cut(model, text):
    row, start, end = sentences.units(*decode(pa.array([text])), model)
    return [text[a:b] for a, b in zip(start, end)]


def test_hard_marks_quotes_and_enumerations(model):
    text = "## 标题\n\n甲须登记。乙可申请！（一）有土地；（二）有证明；\n（三）愿接受检查。丙“先报备。未报备的，不予认可”，据此退回"
    assert cut(model, text) == ["## 标题", "甲须登记。", "乙可申请！", "（一）有土地；", "（二）有证明；", "（三）愿接受检查。", "丙“先报备。未报备的，不予认可”，据此退回"]


def test_line_breaks_are_layout_unless_the_sentence_is_complete(model):
    assert cut(model, "种植\n大户登记。\n乙") == ["种植\n大户登记。", "乙"]


def test_abbreviations_and_decimals_do_not_end_a_sentence(model):
    assert cut(model, "At branch No. 12, farms wait. The board posts 4.5 tons.") == ["At branch No. 12, farms wait.", "The board posts 4.5 tons."]


def test_semicolons_end_nothing_outside_enumerations(model):
    assert cut(model, "甲；乙；丙。") == ["甲；乙；丙。"]


def test_rows_repeat_and_nulls(spark, model):
    df = spark.createDataFrame([("a", "甲。乙。", 1), ("a", "甲。乙。", 1), ("b", None, 2), ("c", " \n ", 3), ("d", "长" * 100_000, 4)], "chunk_id string, body string, starts int")
    rows = sorted((r.chunk_id, r.start_pos, r.end_pos) for r in sentences.sentence_units(df, "chunk_id", "body", model).collect())
    assert rows == [("a", 0, 2), ("a", 2, 4), ("d", 0, 100_000)]


def test_empty_table(spark):
    assert sentences.sentence_units(spark.createDataFrame([], "k string, t string"), "k", "t").count() == 0


def test_every_candidate_is_classified():
    rng = random.Random(4)
    plain = [f"{who}{what}。" for who in ("种植大户", "县财政局", "村民委员会", "首次申请的主体") for what in ("应在七日内核对台账", "须提交身份证明和用款计划", "负责解释并公布名单")]
    texts = pa.array(["".join(rng.choices(plain, k=3)) + "\n\n" + "".join(rng.choices(plain, k=3)) for _ in range(120)])
    model = sentences.fit(texts)
    points, offsets = decode(texts)
    assert len(sentences.units(points, offsets, model)[0]) == 6 * 120
    model.least[:] = 2  # a model that accepts nothing leaves only the ends of paragraphs
    assert len(sentences.units(points, offsets, model)[0]) == 2 * 120


def test_thresholds_are_fitted_where_examples_suffice():
    texts = pa.array([f"第{k}条贷款由县农业农村局核准。逾期未办的视为放弃申请！\n\n种植大户应当在{k}日内提交身份证明和用款计划，由村民委员会核对台账后报县财政局，不得拖延。" for k in range(60)])
    model = sentences.fit(texts)
    assert model.least[sentences.HARD] != sentences.LEAST[sentences.HARD] and model.least[sentences.THAI] == sentences.LEAST[sentences.THAI]
