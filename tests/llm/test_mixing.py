import numpy as np
import pytest

from millrace.llm import mixing, queries

TARGETS = "mix_id int, source string, target_share double, max_repeats int, budget_share double"


@pytest.fixture(scope="module")
def sizes(spark):
    rows = [(i, "a", 10) for i in range(600)] + [(1000 + i, "b", 7) for i in range(100)] + [(2000 + i, None, 5) for i in range(20)] + [(3000, "c", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").cache()


def mix(spark, sizes, targets, **options):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    mixed, report = mixing.mixture(docs, spark.createDataFrame(targets, TARGETS), sizes=sizes, **options)
    return mixed, {(r.mix_id, r.source): r for r in report.collect()}


def test_shares_within_caps(spark, sizes):
    mixed, report = mix(spark, sizes, [(1, "A ", 3.0, 1, 0.5), (1, "b", 1.0, None, 0.5), (2, "a", 0.5, 1, 0.9), (2, "b", 0.5, 2, 0.9), (2, "gone", 0.4, 2, 0.9)])
    total = 6000 + 700 + 100
    assert abs(report[1, "a"].actual_share - 0.75) < 0.01 and abs(report[1, "a"].tokens + report[1, "b"].tokens - total / 2) < 40
    assert report[1, "b"].epochs == 2
    assert report[2, "b"].tokens == 1400 and report[2, "b"].capped and report[2, "gone"].tokens == 0
    assert abs(report[2, "a"].tokens - (0.9 * total - 1400)) < 20
    seen = mixed.groupBy("mix_id", "doc_id").count().collect()
    assert max(r["count"] for r in seen if r.doc_id < 1000) == 1


def test_positions_are_sorted_and_follow_the_schedule(spark, sizes):
    late = {1: {"b": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]}}
    mixed, _ = mix(spark, sizes, [(1, "a", 0.9, 2, 0.5), (1, "b", 0.1, 5, 0.5)], schedules=late)
    rows = mixed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    assert min(r.position for r in rows if r.source == "b") > 0.5
    of_a = [r.position for r in rows if r.source == "a"]
    assert abs(sum(of_a) / len(of_a) - 0.5) < 0.03


def test_registered_queries_vary_the_mix_over_time(spark, monkeypatch):
    docs = [(i, "hello world", "plenty") for i in range(900)] + [(1000 + i, "hello world", "rare") for i in range(100)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id bigint, text string, source string"),
        "mix_target": spark.createDataFrame([(1, "plenty", 0.6, 1, 0.8), (1, "rare", 0.4, None, 0.8)], TARGETS),
    }
    monkeypatch.setattr(queries, "table", lambda spark, folder, name: tables[name])
    rows = queries.p8_mixture(spark, "").collect()
    mean = lambda source: sum(r.position for r in rows if r.source == source) / sum(r.source == source for r in rows)
    assert mean("rare") > 0.55 and mean("plenty") < 0.5
    for k in range(4):  # as many tokens in each quarter of training
        assert abs(sum(r.tokens for r in rows if k / 4 <= r.position < (k + 1) / 4) / sum(r.tokens for r in rows) - 0.25) < 0.02
    report = {r.source: r.actual_share for r in queries.p8_shares(spark, "").collect()}
    assert abs(report["rare"] - 0.4) < 0.01 and abs(report["plenty"] - 0.6) < 0.01


def test_bands_follow_the_integral_of_the_schedule(spark, sizes):
    knots = {"a": [(0.0, 1.5), (1.0, 0.5)], "b": [(0.0, 0.2), (0.4, 2.0), (1.0, 0.2)]}
    mixed, _ = mix(spark, sizes, [(1, "a", 0.6, 3, 0.5), (1, "b", 0.4, 9, 0.5)], schedules={1: knots})
    got = {(r.source, r.band): r.tokens for r in mixing.bands(mixed, 5).collect()}
    for source, points in knots.items():
        grid = np.linspace(0, 1, 100_001)
        weight = np.interp(grid, *zip(*points))
        part = np.array([weight[(grid >= k / 5) & (grid < (k + 1) / 5)].sum() for k in range(5)]) / weight.sum()
        total = sum(v for (s, _), v in got.items() if s == source)
        assert all(abs(got[source, k] / total - part[k]) < 0.03 for k in range(5)), source
    by_band = {}
    for r in mixing.bands(mixed, 5).collect():
        by_band[r.band] = by_band.get(r.band, 0) + r.share
    assert all(abs(v - 1) < 1e-9 for v in by_band.values())


def test_tokens_and_names(spark):
    docs = spark.createDataFrame([(1, "hello world, hello", "County-Notice "), (2, None, None), (3, "", " ")], "doc_id bigint, text string, source string")
    rows = {r.doc_id: r for r in mixing.sized(docs, "doc_id", "text", "source").collect()}
    assert rows[1].source == "county_notice" and rows[1].tokens == len(mixing.encoder(mixing.VOCABULARIES, mixing.VOCABULARY).encode_ordinary("hello world, hello"))
    assert rows[2].tokens == 0 and rows[3].source is None


def test_empty_tables(spark, sizes):
    mixed, report = mix(spark, sizes.limit(0), [(1, "a", 1.0, 1, 0.5)])
    assert mixed.count() == 0 and report[1, "a"].tokens == 0
    mixed, report = mix(spark, sizes, [])
    assert mixed.count() == 0 and report == {}
