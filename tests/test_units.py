import os
import zlib

import numpy as np
import pytest

from millrace import queries
from millrace.operators import units
from millrace.operators.forest import Forest


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("单户额度最高50万元，贷款期限最长1年零6个月", [("amount", 500000), ("term", 18)]),
        ("可申请2至20万元的助农周转贷", [("amount", 200000)]),
        ("单笔额度为5—150万元", [("amount", 1500000)]),
        ("可申请1000000元至3000000元的应急纾困贷", [("amount", 3000000)]),
        ("最高可贷人民币伍拾万元整，用信期限为四年", [("amount", 500000), ("term", 48)]),
        ("贷款金额不超过RMB 2,000,000，贷款期限540日", [("amount", 2000000), ("term", 18)]),
        ("额度上限0.015亿元，借款期限十二个季度", [("amount", 1500000), ("term", 36)]),
        ("授信额度不超过3百万元", [("amount", 3000000)]),
        ("额度上限⼗五万元，借款期限半年", [("amount", 150000), ("term", 6)]),
        ("Lending is capped at 80 thousand yuan, repayable within a term of 2 yrs.", [("amount", 80000), ("term", 24)]),
        ("the maximum loan is CNY 5 million over 720 days", [("amount", 5000000), ("term", 24)]),
        ("The ceiling for lotus growers is RMB 2000k and the loan runs for ten years.", [("amount", 2000000), ("term", 120)]),
        ("注册资本不低于462万元且正常经营满3年，每亩给予376元补助，保存期限5年，户均缺口42.00万元", []),
        ("## 贷款期限\n\n2023年1月24日起试行", []),
        ("贷款期限2023年", []),
        ("the loan runs for\neighteen months and the loan term of a year", [("term", 18), ("term", 12)]),
        ("", []),
        (None, []),
    ],
)
def test_statements(text, want):
    assert [s[:2] for s in units.statements(text)] == want


def test_forest_learns_and_is_sure_only_where_it_can_be():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] > 0).astype(int)
    noisy = rng.random(3000) < 0.5
    y[noisy & (x[:, 1] > 1)] ^= 1
    forest = Forest.fit(x[:2000], y[:2000], 2)
    got, sure = forest.predict(x[2000:])
    clear = x[2000:, 1] <= 0.8
    assert (got == y[2000:])[clear].mean() > 0.97
    assert sure[clear].mean() > sure[x[2000:, 1] > 1.2].mean() + 0.1


def rows(spark, data):
    slots = "struct<amount_text: string, amount_unit: string, term_text: string, term_unit: string>"
    return spark.createDataFrame(data, f"evidence_id string, demand_scenario string, loan_amount_upper_limit double, loan_term_months int, raw_slots {slots}")


def test_records_are_converted_checked_and_routed(spark):
    many = [(f"e{i}", "x", 50.0, 12, (None, "万元", None, "月")) for i in range(60)]
    odd = [("bare", None, 50.0, None, None), ("empty", None, None, None, (None, None, None, None)), ("wrong", "x", 7.0, 12, (None, "万元", None, None)), (None, "x", 1.0, 1, None)]
    parameters = rows(spark, many + odd + odd)
    said = [(f"e{i}", "额度最高50万元，贷款期限12个月") for i in range(60)] + [("empty", "额度最高30万元"), ("wrong", "额度最高30万元"), ("bare", None)]
    evidence = spark.createDataFrame(said * 2, "evidence_id string, evidence_text string")
    chunks = spark.createDataFrame([("c", "额度最高30万元。额度最高30万元。"), ("d", None), ("c", "额度最高30万元。额度最高30万元。")], "chunk_id string, chunk_text string")
    texts, recorded = units.common_quantities(chunks, parameters, evidence)
    assert [tuple(r) for r in texts.collect()] == [("chunk_text", "c", "amount", 300000)]
    got = {(r.evidence_id, r.quantity): r for r in recorded.collect()}
    assert got["e1", "amount"].common_value == 500000 and got["e1", "term"].common_value == 12
    assert got["empty", "amount"].route == "stated" and got["empty", "amount"].common_value == 300000
    wrong = got["wrong", "amount"]  # confident, so it stands, marked for review
    assert wrong.route == "converted" and wrong.contradicted and wrong.common_value == 70000
    assert not got["e1", "amount"].contradicted
    assert got["bare", "amount"].stated_value is None
    assert len(got) == recorded.count()


def test_found_has_confident_conversions_that_no_statement_is_read_for(spark, monkeypatch):
    many = [(f"e{i}", "x", 50.0, 12, (None, "万元", None, "月")) for i in range(60)]
    odd = [("odd", "x", 50.0, None, (None, "万元", None, None)), ("other", "x", 50.0, None, (None, "万元", None, None)), ("none", "x", 50.0, None, (None, "万元", None, None))]
    said = [(f"e{i}", "额度最高50万元，贷款期限12个月") for i in range(60)] + [("odd", "每户能够借到的钱以50万元为顶"), ("other", "由县农业农村局负责解释")]
    assert units.statements(said[-2][1]) == [] and units.mentioned(said[-2][1]) == ["amount"]
    tables = {
        "kb_chunk": spark.createDataFrame([], "chunk_id string, chunk_text string"),
        "extracted_parameters": rows(spark, many + odd),
        "selected_evidence": spark.createDataFrame(said, "evidence_id string, evidence_text string"),
    }
    monkeypatch.setattr(queries, "table", lambda spark, folder, name: tables[name])
    got = {(r.field_name, r.record_id): r.common_value for r in queries.p2_found(spark, "").collect()}
    assert got["loan_amount_upper_limit", "odd"] == 500000
    assert got["loan_amount_upper_limit", "e3"] == 500000 and got["loan_term_months", "e3"] == 12
    assert len(got) == 121  # nothing for evidence that does not speak of it, or that is absent


def test_confidence_holds_without_evidence(spark):
    # the number alone does not tell the unit: half are yuan, half are ten thousands, and nothing is hinted
    many = [(f"e{i}", "x", 50.0, None, None) for i in range(400)] + [(f"h{i}", "x", 30.0, None, (None, "万元", None, None)) for i in range(200)]
    said = [(f"e{i}", f"额度最高{'50万元' if i % 2 else '50元'}") for i in range(400)] + [(f"h{i}", "额度最高30万元") for i in range(200)]
    alone = [("bare", "x", 50.0, None, None), ("hinted", "x", 30.0, None, (None, "万元", None, None))]
    chunks = spark.createDataFrame([], "chunk_id string, chunk_text string")
    recorded = units.common_quantities(chunks, rows(spark, many + alone), spark.createDataFrame(said, "evidence_id string, evidence_text string"))[1]
    got = {r.evidence_id: r for r in recorded.collect()}
    assert got["bare"].route == "review" and got["bare"].confidence < 0.7
    assert got["e1"].common_value == 500000 and got["e2"].common_value == 50 and got["e1"].confidence < 0.7
    assert got["hinted"].route == "converted" and got["hinted"].common_value == 300000


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")
def test_values_of_filled_fields_come_from_the_trees(spark, monkeypatch):
    own = {tuple(r) for r in queries.p2_found(spark, SF).collect()}

    def constant(rows, sample=0):  # one leaf: always the first unit, and sure of it
        leaf = lambda n: (np.array([-1]), np.zeros(1, np.int64), np.eye(n)[:1])
        return {q: units.Forest([np.zeros(0)] * 5, [leaf(len(c))], len(c), (np.array([0.0, 1.0]), np.ones(2))) for q, c in units.CHOICES.items()}

    monkeypatch.setattr(units, "fit", constant)
    other = {tuple(r) for r in queries.p2_found(spark, SF).collect()}
    assert len(own - other) > 100 and all(r[0] != "chunk_text" for r in own - other)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")
def test_held_out_accuracy_without_evidence(spark):
    held = units._pandas(units.records(queries.table(spark, SF, "extracted_parameters"), queries.table(spark, SF, "selected_evidence")).toArrow())
    for q in units.FIELDS:
        frame = units._frame(held, q)
        y = units.labels(frame, q)
        frame, y = frame[y >= 0], y[y >= 0]
        fitted = np.array([hash_ % 2 == 0 for hash_ in map(zlib.crc32, frame["evidence_id"].str.encode("utf-8"))])
        forest = units.Forest.fit(units.features(frame[fitted], q), y[fitted], len(units.CHOICES[q]))
        got, sure = forest.predict(units.features(frame[~fitted], q))
        right = got == y[~fitted]
        print(q, len(right), right.mean(), (sure >= units.CONFIDENT).mean(), right[sure >= units.CONFIDENT].mean())
        assert right.mean() > 0.75 and right[sure >= units.CONFIDENT].mean() > 0.95


def test_empty_tables(spark):
    empty = units.common_quantities(spark.createDataFrame([], "chunk_id string, chunk_text string"), rows(spark, []), spark.createDataFrame([], "evidence_id string, evidence_text string"))
    assert empty[0].count() == 0 and empty[1].count() == 0
