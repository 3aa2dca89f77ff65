import math

import pytest

from millrace.operators import evidence, index, retrieval
from millrace.plans.ask import Engine

CHUNKS = [
    ("doc-1:0", "doc-1", "sichuan", "办法", "生猪养殖贷款贴息，最高50万元。根据通知如下要求办理有关事项，请各地认真贯彻落实文件精神。", "贴息"),
    ("doc-2:0", "doc-2", "anhui", "补贴", "合作社补贴政策，适用于粮食合作社。", None),
    ("doc-3:0", "doc-3", "anhui", "空", "", None),
]
SCHEMA = "chunk_id string, doc_id string, region string, source_title string, chunk_text string, section_title string"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA)


@pytest.fixture(scope="module")
def built(chunks):
    return index.build(chunks, "chunk_id", "chunk_text")


def asked(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, query string, region string")


def test_bm25_score_is_the_formula(spark, built):
    q = asked(spark, (1, "生猪 贴息贷款", None))
    hit = retrieval.bm25(built, q, 2).collect()
    assert [h.id for h in hit] == ["doc-1:0"] and hit[0].rank == 1
    terms = {r.id: r.terms for r in built.texts.collect()}
    n, average = 3, sum(map(len, terms.values())) / 3
    query = ["生猪", "贴息贷款", "贴息", "息贷", "贷款", "贴息贷", "息贷款"]
    own = [t for t in query if t in terms["doc-1:0"]]
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    want = len(own) * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(terms["doc-1:0"]) / average) + 1e-9)
    assert abs(hit[0].score - want) < 1e-9
    assert hit[0].match_terms == own


def test_region_filters_hits_but_not_the_statistics(spark, built, chunks):
    regions = chunks.selectExpr("chunk_id as id", "region")
    q = asked(spark, (1, "补贴 合作社", "ANHUI"), (2, "补贴 合作社", "sichuan"), (3, "", None), (4, None, None))
    rows = retrieval.tfidf(built, q, 5, regions).collect()
    assert [(r.query_id, r.id) for r in rows] == [(1, "doc-2:0")]
    whole = retrieval.bm25(built, asked(spark, (1, "补贴 合作社", None)), 5).first()
    part = retrieval.bm25(built, asked(spark, (1, "补贴 合作社", "anhui")), 5, regions).first()
    assert abs(whole.score - part.score) < 1e-12


def test_no_rows_without_k_or_texts(spark, built, chunks):
    q = asked(spark, (1, "贷款", None))
    assert retrieval.bm25(built, q, 0).count() == 0
    empty = index.build(chunks.limit(0), "chunk_id", "chunk_text")
    assert retrieval.bm25(empty, q, 3).count() == 0
    assert index.summary(empty).first().chunk_count == 0


def test_ties_keep_the_order_of_ids(spark):
    same = spark.createDataFrame([(3, "贷款"), (1, "贷款"), (2, "贷款")], "id int, t string")
    rows = retrieval.bm25(index.build(same, "id", "t"), asked(spark, (1, "贷款", None)), 2).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 2]


def test_a_search_keeps_the_terms_that_it_asks_for(spark, built, chunks):
    q = asked(spark, (1, "补贴 合作社", "ANHUI"), (2, "生猪 zzz", None), (3, None, None))
    regions = chunks.selectExpr("chunk_id as id", "region")
    once = index.build(chunks, "chunk_id", "chunk_text", keep=False)
    for search in (retrieval.tfidf, retrieval.bm25):
        assert sorted(search(once, q, 5, regions).collect()) == sorted(search(built, q, 5, regions).collect()) != []
    narrow = once.narrowed(retrieval.query_terms(q))
    kept, every = ({r.id: r for r in i.texts.collect()} for i in (narrow, built))
    assert {k: r.length for k, r in kept.items()} == {k: r.length for k, r in every.items()}
    assert kept["doc-1:0"].terms == ["生猪"] and len(every["doc-1:0"].terms) > 20 and not once.texts.is_cached


def test_tfidf_scored_text_by_text_is_that_of_shuffled_sums(spark, monkeypatch):
    texts = [(k, ["贷款贴息", "生猪贷款", "贷款 期限 ab", "粮食合作社 贷款贴息", None, ""][k * 7 % 6]) for k in range(60)]
    built = index.build(spark.createDataFrame(texts, "id int, t string").repartition(3), "id", "t", keep=False)
    q = asked(spark, (1, "贷款", None), (2, "贷款贴息 生猪", None), (3, "ab zzz", None), (4, None, None), (5, "粮食", None))
    monkeypatch.setattr(retrieval, "MOST_LOCAL", 0)
    want = sorted(retrieval.tfidf(built, q, 4).collect())
    monkeypatch.setattr(retrieval, "MOST_LOCAL", 5_000)
    got = sorted(retrieval.tfidf(built, q, 4).collect())
    assert len(got) == 16
    assert [(*r[:2], round(r.score, 9), *r[3:]) for r in got] == [(*r[:2], round(r.score, 9), *r[3:]) for r in want]


def test_index_is_saved_and_loaded(spark, built, tmp_path):
    built.save(str(tmp_path / "index"), 2)
    again = index.LexicalIndex.load(spark, str(tmp_path / "index"))
    assert again.term_stats.count() == built.term_stats.count()
    assert retrieval.bm25(again, asked(spark, (1, "生猪", None)), 1).first().id == "doc-1:0"


def test_evidence_prefers_the_direct_clause(spark, built, chunks):
    q = asked(spark, (1, "生猪贷款贴息", None), (2, "完全无关xyz", None), (3, " ", None))
    hits = retrieval.bm25(built, q, 5)
    chosen = evidence.select(evidence.rank_sentences(q, hits, chunks), 2)
    best = chosen.orderBy("evidence_rank").first()
    assert best.evidence_text.startswith("生猪养殖") and best.evidence_id.endswith(":sent-1") and best.citation_text == "办法 - 贴息"
    sure = {r.query_id: r for r in evidence.confidence(q, chosen).collect()}
    assert sure[1].label in ("high", "medium") and sure[2].reasons == ["no_evidence"] and sure[3].reasons == ["empty_query_terms"]
    assert sure[2].coverage is None


def test_engine_answers_a_batch(spark, chunks):
    rows = {r.query_id: r for r in Engine(chunks).ask_many(spark.createDataFrame([(1, "生猪贷款贴息"), (2, "zzz"), (3, None)], "query_id int, query string")).collect()}
    assert rows[1].scenario == "econ_parameterized" and rows[1].parameters.loan_amount_upper_limit == 500000.0
    assert rows[1].uncertainty.missing_parameters == ["适用主体", "贷款期限", "利率"] and "50万元" in rows[1].final_response
    assert rows[1].citations[0].source == "办法" and rows[1].citations[0].section == "贴息" and rows[1].citations[0].quote in rows[1].summary
    assert rows[2].citations is None and len(rows[2].uncertainty.missing_parameters) == 5 and rows[2].uncertainty.warning
    assert rows[2].scenario == "no_result" and rows[3].scenario == "no_result"


def test_engine_carries_session_slots(spark, chunks):
    turns = spark.createDataFrame([(1, "s", 1, "想养猪借10万元"), (2, "s", 2, "期限呢"), (3, "t", 1, "不是合作社")], "query_id int, session_id string, turn int, query string")
    rows = {r.query_id: r for r in Engine(chunks).ask_sessions(turns).collect()}
    assert rows[2].amount == "10万元" and rows[2].crop_or_activity == "养猪" and rows[3].cooperative is False and rows[3].amount is None


def test_parameters_are_also_read_from_the_chunk_of_the_evidence(spark):
    text = "生猪养殖户可以申请贷款贴息支持政策。\n单户最高80万元，期限不超过18个月。"
    chunks = spark.createDataFrame([("c:0", "d", "fj", "办法", text, None, {"file_name": "x"})], "chunk_id string, doc_id string, region string, source_title string, chunk_text string, section_title string, metadata map<string,string>")
    row = Engine(chunks).ask_many(spark.createDataFrame([(1, "生猪养殖户贷款贴息")], "query_id int, query string")).first()
    assert "80" not in row.citations[0].quote
    assert row.parameters.loan_amount_upper_limit == 800000.0 and row.parameters.loan_term_months == 18


def test_a_session_lives_across_questions(spark, chunks, tmp_path):
    engine, store = Engine(chunks), str(tmp_path / "sessions")
    first = engine.ask_in_session(spark, store, "s", "想养猪借10万元，生猪贷款贴息", region="sichuan").first()
    second = engine.ask_in_session(spark, store, "s", "xyz").first()
    other = engine.ask_in_session(spark, store, "t", "xyz").first()
    assert first.turn == 1 and second.turn == 2 and second.amount == "10万元" and second.crop_or_activity == "养猪"
    assert first.region == second.region == "sichuan" and other.turn == 1 and other.amount is None and other.region is None


def test_the_service_answers(spark, chunks, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from millrace.service import serve

    server = serve(spark, Engine(chunks), str(tmp_path / "sessions"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(body):
        request = urllib.request.Request(f"{base}/ask", json.dumps(body).encode(), {"Content-Type": "application/json"})
        return json.loads(urllib.request.urlopen(request).read())

    try:
        assert json.loads(urllib.request.urlopen(f"{base}/health").read())["status"] == "ok"
        got = post({"session_id": "s", "query": "生猪贷款贴息"})
        assert got["scenario"] == "econ_parameterized" and got["citations"][0]["source"] == "办法" and got["session_id"] == "s"
        for bad in ({"query": "x"}, {"session_id": "s", "user_query": " "}, []):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(bad)
            assert e.value.code == 422
    finally:
        server.shutdown()
        server.server_close()
