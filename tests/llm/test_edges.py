"""Nulls in any column, empty and very long texts, repeated rows, and extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import encodings, leaks, lookalikes, mixing, neardup, quality, sentences, splitting

LONG = "种植大户应当向村民委员会提交身份证明和用款计划。县农业农村局负责核对台账的内容，并在七日内公布。" * 4000
#: Names that the operators give to columns of their own.
CLASHING = ("id", "body", "h1", "h2", "grp", "size", "key", "__text", "text_no", "no", "text", "spans", "chars", "counts", "changed", "starts", "ends", "position", "epoch", "bucket", "start", "h", "kind", "own", "lines", "copies", "first", "links")


def with_extra(df):
    return df.select("*", *(F.lit(None).cast("int").alias(c) for c in CLASHING if c not in df.columns))


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", "第一句。第二句！"), ("a", "第一句。第二句！"), ("b", None), (None, "没有编号的文字。"), (None, None), ("c", ""), ("d", " \n\t "), ("e", LONG), ("f", "𠀀😀\u0000尾"), ("g", "甲")]
    return with_extra(spark.createDataFrame(data, "doc_id string, content string")).repartition(3).cache()


def by_key(found, key="doc_id"):
    out = {}
    for r in found:
        out.setdefault(r[key], []).append(r)
    return out


def test_sentences(rows):
    got = by_key(sentences.sentence_units(rows, "doc_id", "content").collect())
    assert set(got) == {"a", None, "e", "f", "g"} and len(got["e"]) == 8000
    assert sorted((r.start_pos, r.end_pos) for r in got["a"]) == [(0, 4), (4, 8)]  # repeated rows count once


def test_quality(rows):
    got = by_key(quality.statistics(rows, "doc_id", "content", ["的"]).collect())
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys(["a", "b", None, "c", "d", "e", "f", "g"], 1)
    assert got["a"][0].chars == 16 and got["b"][0].chars == 0 and got["b"][0].kind is None and got["e"][0].chars == len(LONG) and got["e"][0].kind == "junk"


def test_look_alikes(rows):
    got = by_key(lookalikes.one_form(rows, "content", ["doc_id"]).collect())
    assert got["b"][0].text is None and got["c"][0].text == "" and not got["e"][0].changed and got["f"][0].changed and len(got["a"]) == 2


def test_near_duplicates(rows):
    assert neardup.near_duplicates(rows, "doc_id", "content").collect() == []
    got = by_key(neardup.duplicate_groups(rows, "doc_id", "content").collect(), "id")
    assert set(got) == {"a", "e"} and got["a"][0].group_id == "a" and got["a"][0].links == 0


def test_splitting(spark, rows):
    items = rows.select(F.lit("x").alias("field_name"), F.col("doc_id").alias("record_id"), F.lit(0).alias("item_no"), F.col("content").alias("text"), F.lit(None).cast("int").alias("first_paragraph"), F.lit(None).cast("int").alias("last_paragraph"), "changed", "own")
    got = splitting.split(items, sentences.train(rows, "doc_id", "content")).orderBy("piece_no").collect()
    assert {r.record_id for r in got} == {"e"} and all(len(r.text) <= 800 and r.paragraph_range is None for r in got)
    assert "".join(r.text[r.core_start - r.start_pos :] for r in got) == LONG


def test_encodings(spark, rows):
    lists = rows.withColumn("paragraphs", F.when(F.col("doc_id") != "g", F.array("content", F.lit(None), F.lit(""))))
    assert encodings.garbled_paragraphs(lists, "doc_id", "paragraphs").count() == 0
    model = encodings.train(lists, "doc_id", "paragraphs")
    assert encodings.restored_texts(rows.where("doc_id <> 'g'"), "doc_id", "content", model).count() == 0


def test_leaks(spark, rows):
    items = with_extra(spark.createDataFrame([(1, LONG[:90], LONG[:50]), (1, LONG[:90], LONG[:50]), (2, None, None), (None, "短", None)], "item_id bigint, passage string, question string"))
    got = leaks.leaked(rows, items, key="doc_id", text="content").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {("e", 1)} and len(got) == 1


def test_mixing(spark, rows):
    docs = rows.withColumn("source", F.when(F.col("doc_id").isNull(), None).otherwise(F.lit("S-one ")))
    targets = with_extra(spark.createDataFrame([(1, "s_one", 1.0, 2, 0.5), (1, None, 1.0, None, 0.5), (2, "gone", None, None, None)], "mix_id int, source string, target_share double, max_repeats int, budget_share double"))
    mixed, report = mixing.mixture(docs, targets, key="doc_id", text="content", source="source")
    assert {r.doc_id for r in mixed.collect()} <= {"a", "e", "f", "g", "d"} and {r.mix_id: r.tokens for r in report.collect()}[2] == 0
