"""Sentence-level evidence: scoring, selection and confidence, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text, tokens

#: Wordings of general introductions.
GENERIC_SENTENCE = "为贯彻|根据|依据|现将|如下|通知如下|有关事项|工作要求"
GENERIC_INTRODUCTION = "为贯彻|根据|现将|通知如下|工作要求|总体要求|指导思想"
#: Weights of the sentence score.
COVERAGE, DENSITY, JACCARD, RETRIEVAL, PER_TERM, PENALTY = 0.45, 0.25, 0.20, 0.15, 0.03, 0.12
#: Deductions and bounds of the confidence.
WEAK, UNCOVERED, GENERIC, HIGH, MEDIUM, LOW_COVERAGE = 0.22, 0.18, 0.15, 0.75, 0.45, 0.35
WARNINGS = {
    "empty_query_terms": "查询缺少可用于匹配的关键词，证据置信度较低。",
    "no_evidence": "未选出有效证据句，建议放宽检索或提示用户补充条件。",
    "generic_intro_only": "当前命中的多为政策导语或一般性说明，缺少直接回答问题的条款。",
    "low_query_coverage": "证据句覆盖的查询关键词较少，回答可能不够准确，建议补充更具体条件。",
    "other": "查询与证据句匹配较弱，建议回退为低置信提示或请求用户澄清。",
}


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rank_sentences(queries: DataFrame, hits: DataFrame, chunks: DataFrame, top_chunks: int = 3) -> DataFrame:
    """Scored candidate sentences with ``place`` (1 is best).

    queries: query_id, query. hits: query_id, id, score, rank. chunks: chunk_id, doc_id,
    chunk_text, source_title, section_title. Sentences that share no term with the query drop out.
    """
    asked = queries.select("query_id", tokens.terms(F.col("query")).alias("q"))
    near = hits.where(F.col("rank") <= top_chunks).select("query_id", F.col("id").alias("chunk_id"), F.col("score").alias("retrieval_score"), F.col("rank").alias("retrieval_rank"))
    pieces = near.join(chunks.select("chunk_id", "doc_id", "chunk_text", "source_title", "section_title"), "chunk_id").join(asked, "query_id")
    rows = pieces.select("*", F.posexplode(text.sentences(F.col("chunk_text"))).alias("sentence_no", "sentence")).drop("chunk_text")
    rows = rows.withColumn("s", tokens.terms(F.col("sentence")))
    rows = rows.withColumn("matched_terms", F.array_intersect("q", "s")).withColumn("overlap", F.size("matched_terms")).where("overlap > 0")
    rows = rows.withColumn("coverage", F.col("overlap") / F.greatest(F.size("q"), F.lit(1)))
    rows = rows.withColumn("jaccard", F.col("overlap") / F.size(F.array_union("q", "s"))).withColumn("lexical_density", F.col("overlap") / F.greatest(F.size("s"), F.lit(1)))
    generic = (F.char_length("sentence") > 18) & F.col("sentence").rlike(GENERIC_SENTENCE) & (F.col("overlap") <= 2)
    rows = rows.withColumn("generic_penalty", F.when(generic, PENALTY).otherwise(0.0))
    raw = F.col("coverage") * COVERAGE + F.col("lexical_density") * DENSITY + F.col("jaccard") * JACCARD + F.least(F.col("retrieval_score"), F.lit(1.0)) * RETRIEVAL + F.least("overlap", F.lit(4)) * PER_TERM
    rows = rows.withColumn("score", _clamped(raw - F.col("generic_penalty"))).drop("q", "s")
    order = [F.round("score", 9).desc(), F.round("coverage", 9).desc(), F.col("overlap").desc(), F.round("retrieval_score", 9).desc(), F.char_length("sentence"), "retrieval_rank", "sentence_no"]
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def select(ranked: DataFrame, most: int = 2) -> DataFrame:
    """The best distinct sentences of each query among its first 3 x ``most`` candidates. The number in evidence_id counts before repeated sentences drop out."""
    near = ranked.where(F.col("place") <= 3 * max(most, 0))
    first = near.withColumn("copy", F.row_number().over(W.partitionBy("query_id", "chunk_id", "sentence").orderBy("place"))).where("copy = 1")
    kept = first.withColumn("evidence_rank", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).where(F.col("evidence_rank") <= max(most, 0))
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" - "), F.col("section_title"))).otherwise("")
    names = F.concat_ws(", ", F.slice("matched_terms", 1, 5))
    return kept.select(
        "query_id",
        "evidence_rank",
        F.concat("chunk_id", F.lit(":sent-"), F.col("place").cast("string")).alias("evidence_id"),
        "chunk_id",
        "doc_id",
        F.col("sentence").alias("evidence_text"),
        F.format_string("匹配词 %s；覆盖率 %.2f；Jaccard %.2f", names, "coverage", "jaccard").alias("rationale"),
        F.col("score").alias("confidence"),
        F.trim(F.concat(F.coalesce("source_title", F.lit("")), section)).alias("citation_text"),
        F.struct(*(F.round(c, 4).alias(c) for c in ("score", "coverage")), "overlap", *(F.round(c, 4).alias(c) for c in ("jaccard", "lexical_density", "generic_penalty")), "matched_terms", "retrieval_rank", "retrieval_score", "source_title", "section_title").alias("metadata"),
    )


def confidence(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per query: confidence, label, warning, reasons, matched_terms, coverage, best_sentence_overlap, generic_hits. A query without terms or evidence keeps a row; its last four columns are null."""
    asked = queries.select("query_id", tokens.terms(F.col("query")).alias("q"))
    own = evidence.join(asked, "query_id").withColumn("m", F.array_intersect("q", tokens.terms(F.col("evidence_text")))).withColumn("generic", ((F.size("m") <= 2) & F.col("evidence_text").rlike(GENERIC_INTRODUCTION)).cast("int"))
    sums = own.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("matched_terms"), F.avg("confidence").alias("average"), F.max(F.size("m")).alias("best"), F.sum("generic").alias("generic_hits"), F.count("*").alias("n"))
    rows = asked.join(sums, "query_id", "left")
    coverage = F.size("matched_terms") / F.greatest(F.size("q"), F.lit(1))
    empty, none = F.size("q") <= 0, F.col("n").isNull()
    weak, low, general = F.col("best") <= 1, coverage < LOW_COVERAGE, F.col("generic_hits") == F.col("n")
    score = F.col("average") * 0.55 + coverage * 0.45 - F.when(weak, WEAK).otherwise(0.0) - F.when(low, UNCOVERED).otherwise(0.0) - F.when(general, GENERIC).otherwise(0.0)
    rows = rows.withColumn("score", F.when(empty, 0.1).when(none, 0.08).otherwise(_clamped(score)))
    label = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    reasons = F.when(empty, F.array(F.lit("empty_query_terms"))).when(none, F.array(F.lit("no_evidence"))).otherwise(F.array_compact(F.array(F.when(weak, F.lit("weak_term_overlap")), F.when(low, F.lit("low_query_coverage")), F.when(general, F.lit("generic_intro_only")))))
    warning = F.when(empty, WARNINGS["empty_query_terms"]).when(none, WARNINGS["no_evidence"]).when(label != "low", F.lit(None)).when(general, WARNINGS["generic_intro_only"]).when(low, WARNINGS["low_query_coverage"]).otherwise(WARNINGS["other"])
    unless = lambda c: F.when(~empty & ~none, c)
    return rows.select("query_id", F.round("score", 4).alias("confidence"), label.alias("label"), warning.alias("warning"), reasons.alias("reasons"), unless(F.col("matched_terms")).alias("matched_terms"), unless(F.round(coverage, 4)).alias("coverage"), unless(F.col("best")).alias("best_sentence_overlap"), unless(F.col("generic_hits")).alias("generic_hits"))
