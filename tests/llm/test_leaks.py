import random

import pytest

from millrace.llm import leaks


def fold(t):
    f = leaks.folding()
    return "".join(chr(f[ord(c)]) for c in t or "" if f[ord(c)])


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("贷款期限申请条件养殖大户提交身份证明核对台账备案元亩", k=n))
    items = []
    for i in range(30):
        q = text(70)
        items.append((i, q, q + "参考答案" + text(30)))
    items += [(40, "q", None), (41, None, "短"), (42, items[0][1], items[0][2])]
    docs = []
    for d in range(150):
        p = items[rng.randrange(30)][2]
        n = rng.choice([20, 39, 40, 41, 60, 104])
        at = rng.randrange(0, len(p) - min(n, len(p)) + 1)
        piece = p[at : at + n]
        if d % 3 == 0:
            piece = "\n ，".join(piece)
        docs.append((d, text(rng.randrange(0, 900)) + piece + text(rng.randrange(0, 300))))
    docs += [(200, None), (201, ""), (0, docs[0][1]), (202, "".join(x[2] for x in items[:20]))]
    return docs, items


def test_all_leaks_and_no_other(spark, tables):
    docs, items = tables
    got = leaks.leaked(spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id"), spark.createDataFrame(items, "item_id bigint, question string, passage string"))
    rows = {(r.doc_id, r.item_id): r for r in got.collect()}
    want = set()
    for d, t in docs:
        f = fold(t)
        parts = {f[k : k + 40] for k in range(len(f) - 39)}
        for i, _, p in items:
            g = fold(p)
            if any(g[k : k + 40] in parts for k in range(len(g) - 39)):
                want.add((d, i))
    assert set(rows) == want and len(rows) == got.count()
    assert (202, 5) in rows and rows[202, 5].in_question and rows[202, 5].in_answer
    assert min(r.shared for r in rows.values()) >= 40


def test_leaks_across_passages_are_measured_whole(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("贷款期限申请条件养殖大户提交身份证明核对台账备案元亩", k=n))
    question, answer, line = text(90), text(500), "同" * 50
    items = [(1, question, question + answer), (2, line, line)]
    docs = [(1, text(150) + question + answer + text(30)), (2, text(130) + question + answer[:35]), (3, text(300) + question[:60] + text(300) + answer[:45]), (4, "同" * 700)]
    got = leaks.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, question string, passage string"))
    rows = {(r.doc_id, r.item_id): (r.shared, r.in_question, r.in_answer) for r in got.collect()}
    assert rows == {(1, 1): (590, True, True), (2, 1): (125, True, True), (3, 1): (60, True, True), (4, 2): (50, True, False)}


def test_stretches_in_small_parts(tables, monkeypatch):
    index = leaks.Index([1], ["甲乙" * 40 + "丙丁" * 30], ["甲"])
    points = leaks.fold(*leaks.decode(leaks.pa.array(["甲乙" * 45 + "丙丁" * 40])))[0]
    at = leaks.np.arange(len(points) - 39)
    there = leaks.Hashes(points).of(at, at + 40)
    want = sorted(index.stretches(points, there, 0))
    monkeypatch.setattr(leaks, "PAIRS", 3)
    assert sorted(index.stretches(points, there, 0)) == want and max(want)[0] == 140


def test_block_max_wand_equals_scoring_all(tables):
    index = leaks.Index([i for i, *_ in tables[1]], [p for *_, p in tables[1]], [q for _, q, _ in tables[1]])
    rng = random.Random(1)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), 60)) if rng.random() < 0.5 else list(range(s := rng.randrange(len(index.terms) - 90), s + 90))
        scores: dict[int, float] = {}
        for t in terms:
            for p in range(index.start[t], index.start[t + 1]):
                scores[int(index.items[p])] = scores.get(int(index.items[p]), 0) + float(index.weights[p])
        want = sorted(i for i, s in scores.items() if s >= index.least[i])
        assert sorted(index.search(terms)) == want


def test_items_in_several_indexes(spark, tables):
    items = spark.createDataFrame(tables[1], "item_id bigint, question string, passage string")
    assert len(list(leaks.indexes(items, most=500))) > 3
    docs = spark.createDataFrame(tables[0], "doc_id bigint, text string")
    want = {tuple(r) for r in leaks.leaked(docs, items).collect()}
    assert want and {tuple(r) for r in leaks.leaked(docs, items, most=500).collect()} == want


def test_the_least_score_of_a_run_is_exact():
    rng = random.Random(5)
    for _ in range(100):
        sizes = [rng.randint(0, 30) for _ in range(5)]
        item = leaks.np.repeat(leaks.np.arange(5), sizes)
        gram = leaks.np.array([rng.randrange(6) for _ in item], int)
        value = {(i, g): rng.random() for i in range(5) for g in range(6)}
        weight = leaks.np.array([value[i, g] for i, g in zip(item.tolist(), gram.tolist())])
        before, last = leaks.np.full(len(item), -1), {}
        for k, pair in enumerate(zip(item.tolist(), gram.tolist())):
            before[k] = last.get(pair, -1)
            last[pair] = k
        got = leaks._least(item, weight, before, 5, 7)
        for i in range(5):
            own = gram[item == i].tolist()
            want = min((sum(value[i, g] for g in set(own[s : s + 7])) for s in range(len(own) - 6)), default=float("inf"))
            assert got[i] == pytest.approx(want)


def test_a_large_index_is_built_in_bounded_time():
    import time

    rng = random.Random(3)
    passages = ["".join(rng.choices("贷款期限申请条件养殖大户提交身份证明核对台账备案登记", k=400)) for _ in range(1000)]
    began = time.time()
    index = leaks.Index(list(range(1000)), passages, passages)
    assert time.time() - began < 20 and leaks.np.isfinite(index.least).all()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, question string, passage string")
    assert leaks.leaked(docs, items).count() == 0
