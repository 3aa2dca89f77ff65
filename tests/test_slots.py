from pyspark.sql import functions as F

from millrace.operators import extraction, normalize, session
from millrace.streaming.sessions import session_states


def test_extraction(spark):
    t = "贷款额度最高50万元，期限1年（12个月），年利率3.2%，财政贴息1.2%，需提供抵押，须有保证人担保。适用对象：种植大户；用于购买种子。"
    r = extraction.extract(spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "无需抵押")], "i int, evidence_text string")).orderBy("i").collect()
    assert (r[0].loan_amount_upper_limit, r[0].loan_term_months, r[0].interest_rate, r[0].subsidy_rate, r[0].effective_rate) == (500000.0, 12, 3.2, 1.2, 2.0)
    assert r[0].collateral_required and r[0].guarantee_required and r[0].target_entities == ["种植大户"] and r[0].usage_restrictions == ["购买种子"]
    assert r[1].loan_amount_upper_limit is None and r[1].target_entities == [] and r[2].collateral_required is None
    assert r[3].collateral_required is False


def test_normaliser_of_the_design():
    got = normalize.Normalizer.default().normalize("我想借点钱买化肥，去年还有一点没还完")
    assert got["normalized_query"] == "贷款 农业生产资料投入 未结清贷款"
    text, hits = normalize.Normalizer.default().replace("想借点钱买化肥，去年还有一点没还完")
    assert text == "想贷款农业生产资料投入，去年未结清贷款" and len(hits) == 3
    kept = normalize.Normalizer.default().normalize("现在想续一下去年的贷款", drop_stopwords=False)
    assert kept["detected_terms"] == ["续贷", "贷款"] and "现在" in kept["normalized_query"]


def test_normalised_to_nothing_falls_back(spark):
    rows = normalize.normalize_queries(spark.createDataFrame([(1, "abc"), (2, None)], "query_id int, query string")).orderBy("query_id").collect()
    assert rows[0].normalized_query == "" and rows[0].search_text == "abc" and rows[1].search_text is None


def test_slots_are_carried(spark):
    turns = spark.createDataFrame([("s", 1, "养牛，借10 万元，半年", None), ("s", 2, "不是合作社", ["没有担保人"]), ("s", 3, None, None)], "session_id string, turn int, query string, evidence array<string>")
    slots = session.turn_slots(turns)
    last = session.carried(slots).where("turn = 3").first()
    assert (last.amount, last.crop_or_activity, last.duration, last.cooperative, last.guarantor, last.collateral) == ("10万元", "养牛", "半年", False, False, None)
    blocks = {r.turn: r.amount for r in session.carried(slots, block=1).collect()}
    assert blocks == {1: "10万元", 2: "10万元", 3: "10万元"}
    again = session.latest(slots).first()
    assert (again.amount, again.cooperative, again.turn) == ("10万元", False, 3)


def test_session_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("s", 1, "养羊"), ("s", 2, "借5万元"), ("t", 1, "x")], "session_id string, turn long, query string").write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("session_id string, turn long, query string").parquet(str(tmp_path / "in" / "*"))
    q = session_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.session_id: r for r in spark.table("states").collect()}
    assert got["s"].amount == "5万元" and got["s"].crop_or_activity == "养羊" and got["t"].amount is None
    assert spark.table("states").where(F.col("turn") == 2).count() == 1
