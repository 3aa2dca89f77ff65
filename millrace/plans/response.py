"""What is answered: citations, missing parameters, uncertainty, and the text put together from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters with their names in the answer, in this order.
NUMBERS = {"loan_amount_upper_limit": "贷款上限（元）", "loan_term_months": "期限（月）", "interest_rate": "利率（%）", "subsidy_rate": "贴息（%）", "effective_rate": "实际利率（%）"}
FLAGS = {"collateral_required": "需要抵押", "guarantee_required": "需要担保"}
LISTS = {"target_entities": "适用对象", "usage_restrictions": "资金用途", "repayment_constraints": "还款要求"}
#: Parameters whose absence is told: name, and the columns of which one is enough.
EXPECTED = (("适用主体", ("target_entities",)), ("贷款额度", ("loan_amount_upper_limit",)), ("贷款期限", ("loan_term_months",)), ("利率", ("interest_rate", "effective_rate")))
#: What a question without any evidence lacks.
UNKNOWN = ("地区", "主体类型", "贷款用途", "额度", "期限")
NOTHING = "没有检索到可以引用的条款。"
ADVICE = {"weak_evidence": "补充地区、主体或用途后可再次查询。", "no_result": "换用地区、产品或政策名称后可再次查询。"}


def _some(*columns: Column | str) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def citations(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """A citation per evidence row: its source and section (its own, else those of its chunk), its location, quote and confidence.

    evidence: evidence_id, chunk_id, doc_id, evidence_text, confidence, citation_text, rationale and
    metadata with source_title and section_title, and any more columns, which stay. chunks: one row
    per chunk_id. Evidence whose chunk is not there keeps what it has; its source is then its document.
    """
    there = chunks.select("chunk_id", F.col("source_title").alias("__title"), F.col("section_title").alias("__section"), F.lit(True).alias("__there"))
    rows = evidence.join(there, "chunk_id", "left")
    located = F.when(F.col("__there"), F.trim(F.concat(F.coalesce("__title", F.lit("")), F.when(_some("__section").isNotNull(), F.concat(F.lit(" - "), F.col("__section"))).otherwise(""))))
    return rows.withColumns(
        {
            "source": F.coalesce(_some("metadata.source_title", "citation_text"), F.when(F.col("__there"), F.col("__title")).otherwise(F.col("doc_id"))),
            "section": _some("metadata.section_title", "__section"),
            "citation_text": F.coalesce(_some("citation_text"), located),
            "confidence": F.round("confidence", 4),
        }
    ).withColumnRenamed("evidence_text", "quote").drop("__title", "__section", "__there", "metadata")


def _filled(parameters: str, name: str) -> Column:
    value = F.col(f"{parameters}.{name}")
    return F.coalesce(F.size(value) > 0, F.lit(False)) if name in LISTS else value.isNotNull()


def has_parameters(parameters: str) -> Column:
    """Whether any parameter is known."""
    return reduce(lambda a, b: a | b, (_filled(parameters, n) for n in (*NUMBERS, *FLAGS, *LISTS)))


def missing_parameters(parameters: str) -> Column:
    """Names of the expected parameters that are not known."""
    lacking = [F.when(~reduce(lambda a, b: a | b, (_filled(parameters, c) for c in columns)), F.lit(name)) for name, columns in EXPECTED]
    return F.when(F.col(parameters).isNull(), F.array(*map(F.lit, UNKNOWN))).otherwise(F.array_compact(F.array(*lacking)))


def parameter_lines(parameters: str) -> Column:
    """A line for each known parameter."""
    line = lambda label, value: F.concat(F.lit(f"- {label}："), value)
    lines = [F.when(_filled(parameters, n), line(label, F.col(f"{parameters}.{n}").cast("string"))) for n, label in NUMBERS.items()]
    lines += [F.when(_filled(parameters, n), line(label, F.when(F.col(f"{parameters}.{n}"), "是").otherwise("否"))) for n, label in FLAGS.items()]
    lines += [F.when(_filled(parameters, n), line(label, F.array_join(F.col(f"{parameters}.{n}"), ", "))) for n, label in LISTS.items()]
    return F.array_compact(F.array(*lines))


def respond(rows: DataFrame) -> DataFrame:
    """Adds scenario, uncertainty, summary and final_response.

    rows: normalized_query, citations (array of structs, best first), confidence (struct of
    confidence, label, warning, reasons) and parameters (struct or null). scenario: ``no_result``,
    ``econ_parameterized`` (a parameter is known), ``weak_evidence`` (little confidence) or ``normal_hit``.
    """
    some = F.size(F.coalesce("citations", F.array())) > 0
    scenario = F.when(~some, "no_result").when(has_parameters("parameters"), "econ_parameterized").when(F.col("confidence.label") == "low", "weak_evidence").otherwise("normal_hit")
    out = rows.withColumn("scenario", scenario).withColumn(
        "uncertainty", F.struct(F.col("confidence.confidence").alias("score"), F.col("confidence.label").alias("label"), F.coalesce(F.col("confidence.warning"), F.when(~some, NOTHING)).alias("warning"), F.col("confidence.reasons").alias("reasons"), missing_parameters("parameters").alias("missing_parameters"), F.size(F.coalesce("citations", F.array())).alias("selected_evidence_count"))
    )
    first = F.element_at("citations", 1)
    told = F.when(F.size(parameter_lines("parameters")) > 0, F.concat(F.lit("已知参数："), F.array_join(F.transform(parameter_lines("parameters"), lambda x: F.substring(x, 3, 1000000)), "；"), F.lit("。")))
    summary = F.when(some, F.concat_ws("", F.lit("《"), first["source"], F.lit("》写明：“"), first["quote"], F.lit("”。"), told, F.lit("置信度："), F.col("uncertainty.label"), F.lit("。"))).otherwise(NOTHING)
    out = out.withColumn("summary", summary)
    basis = F.transform(F.slice("citations", 1, 3), lambda c, i: F.concat_ws("", (i + 1).cast("string"), F.lit(". "), c["source"], F.when(_some(c["section"]).isNotNull(), F.concat(F.lit(" / "), c["section"])), F.lit("："), c["citation_text"]))
    quotes = F.transform(F.slice("citations", 1, 3), lambda c: F.concat_ws("", F.lit("- “"), c["quote"], F.lit("”")))
    open_ = F.concat_ws("；", F.concat_ws("", F.lit("置信度="), F.col("uncertainty.label"), F.lit("("), F.col("uncertainty.score").cast("string"), F.lit(")")), F.col("uncertainty.warning"), F.when(F.size("uncertainty.missing_parameters") > 0, F.concat(F.lit("尚缺："), F.array_join("uncertainty.missing_parameters", ", "))))
    block = lambda head, lines: F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{head}\n"), F.array_join(lines, "\n")))
    parts = [F.concat(F.lit("问题："), F.coalesce("normalized_query", F.lit(""))), F.concat(F.lit("结论："), F.col("summary")), block("参数：", parameter_lines("parameters")), block("依据：", basis), block("原文：", quotes), F.concat(F.lit("不确定性："), open_)]
    advice = F.when(F.col("scenario") == "weak_evidence", ADVICE["weak_evidence"]).when(F.col("scenario") == "no_result", ADVICE["no_result"])
    return out.withColumn("final_response", F.concat_ws("\n\n", *parts, advice))
