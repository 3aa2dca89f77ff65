"""Parameters read from evidence by patterns: the first match over an ordered list of candidate texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text

#: Hint words and patterns, as lists of data.
INTEREST = ("利率", "年利率", "执行利率", "贷款利率", "综合利率")
SUBSIDY = ("贴息", "财政贴息", "补贴比例", "贴息比例", "利息补助")
UPPER = ("最高", "上限", "不超过", "最高可贷", "额度")
COLLATERAL = ("抵押", "质押", "抵押物", "担保物")
GUARANTEE = ("担保", "保证人", "第三方保证", "连带责任保证")
NEGATIVE = "免|无需|不需|无须|信用"
PERCENT = r"(\d+(?:\.\d+)?)\s*[%％]"
MONTHS, YEARS = r"(\d{1,3})\s*个?月", r"(\d{1,2})\s*年"
AMOUNT = r"(\d+(?:\.\d+)?)\s*(亿元|万元|万|千元|元)"
SCALE = {"元": 1.0, "千元": 1e3, "万": 1e4, "万元": 1e4, "亿元": 1e8}
ENTITIES = r"(?:适用对象|支持对象|适用主体|服务对象|扶持对象|贷款对象|面向)[:：]?\s*([^。；;\n]+)"
USAGE = r"(?:贷款用途|资金用途|用于|专项用于|仅限用于|不得用于|禁止用于)[:：]?\s*([^。；;\n]+)"
REPAYMENT = r"(?:还款方式|还款要求|还款约束|偿还方式|到期还本|按月付息|分期还款|随借随还)[:：]?\s*([^。；;\n]+)?"


def candidates(evidence: Column, *more: Column) -> Column:
    """The texts to look in, in order, blank ones left out, white space collapsed. Each is a text or an array of texts."""
    return F.transform(F.filter(F.concat(F.array(evidence), *more), lambda t: F.coalesce(text.trimmed(t), F.lit("")) != ""), text.collapsed)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def percent(texts: Column, hints: tuple[str, ...]) -> Column:
    """The first percentage that follows a hint within 12 characters; texts come before hints."""

    def of(t: Column) -> Column:
        found = [F.nullif(F.regexp_extract(t, hint + r"[^%％\d]{0,12}" + PERCENT, 1), F.lit("")) for hint in hints]
        return F.coalesce(*found).cast("double")

    return _first(F.transform(texts, of))


def term_months(texts: Column) -> Column:
    """Months if a text names any, else years times 12."""

    def of(t: Column) -> Column:
        months, years = (F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int") for p in (MONTHS, YEARS))
        return F.coalesce(months, years * 12)

    return _first(F.transform(texts, of))


def amount_limit(texts: Column) -> Column:
    """The first amount with a hint of an upper limit within the 16 characters before it, in yuan."""

    def of(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(f"({AMOUNT})"), 1)
        blank = F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("hit"))

        def step(s: Column, m: Column) -> Column:
            place = F.locate_from(m, t, s["at"]) if hasattr(F, "locate_from") else F.call_function("locate", m, t, s["at"])
            start = F.greatest(place - 16, F.lit(1))
            before = F.substring(t, start, place - start)
            return F.struct((place + F.char_length(m)).alias("at"), F.when(s["hit"].isNotNull(), s["hit"]).when(before.rlike("|".join(UPPER)), m).alias("hit"))

        return F.aggregate(found, blank, step, lambda s: s["hit"])

    hit = _first(F.transform(texts, of))
    unit = F.regexp_extract(hit, AMOUNT, 2)
    scale = reduce(lambda c, u: c.when(unit == u, SCALE[u]), SCALE, F.when(F.lit(False), 0.0))
    return F.regexp_extract(hit, AMOUNT, 1).cast("double") * scale


def requirement(texts: Column, hints: tuple[str, ...]) -> Column:
    """struct(required, sentence): the first sentence with a hint; a word of waiver in it means it is not required. Null if there is no hint."""

    def of(t: Column) -> Column:
        parts = F.filter(F.split(t, "[。；;\n]"), lambda s: s.rlike("|".join(hints)))  # a pattern for the whole sentence would look back from every place
        with_hint = lambda h: F.get(F.filter(parts, lambda s: s.contains(h)), 0)
        return text.trimmed(F.coalesce(*map(with_hint, hints)))

    sentence = _first(F.transform(texts, of))
    return F.struct(F.when(sentence.isNotNull(), ~sentence.rlike(NEGATIVE)).alias("required"), sentence.alias("sentence"))


def listed(texts: Column, pattern: str) -> Column:
    """All distinct groups that matched, in order, cleaned."""

    def clean(c: Column) -> Column:
        bare = F.regexp_replace(text.collapsed(c), "^[：:，,、 ]+|[：:，,、 ]+$", "")
        return F.trim(F.regexp_replace(bare, "^[为是]", ""))

    def of(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(pattern), 1)

    found = F.transform(F.flatten(F.transform(texts, of)), clean)
    return F.array_distinct(F.filter(found, lambda v: F.coalesce(v, F.lit("")) != ""))


def percentages(texts: Column) -> Column:
    return F.transform(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(PERCENT), 1))), lambda v: v.cast("double"))


def extract(rows: DataFrame, evidence: str = "evidence_text", more: tuple[str, ...] = ()) -> DataFrame:
    """The rows with what ``evidence`` and then ``more`` (columns of texts, or of maps to texts) state: interest_rate, subsidy_rate, effective_rate (percent), loan_term_months, loan_amount_upper_limit, the two requirements with their sentences, three lists and all percentages. Null texts give nulls and empty lists."""
    out = rows.withColumn("__texts", candidates(F.col(evidence), *(F.coalesce(F.map_values(c), F.array()) if isinstance(rows.schema[c].dataType, T.MapType) else F.array(c) for c in more)))
    texts = F.col("__texts")
    collateral, guarantee = requirement(texts, COLLATERAL), requirement(texts, GUARANTEE)
    out = out.withColumns(
        {
            "interest_rate": percent(texts, INTEREST),
            "subsidy_rate": percent(texts, SUBSIDY),
            "loan_term_months": term_months(texts),
            "loan_amount_upper_limit": amount_limit(texts),
            "collateral_required": collateral["required"],
            "collateral_requirement_text": collateral["sentence"],
            "guarantee_required": guarantee["required"],
            "guarantee_requirement_text": guarantee["sentence"],
            "target_entities": listed(texts, ENTITIES),
            "usage_restrictions": listed(texts, USAGE),
            "repayment_constraints": listed(texts, REPAYMENT),
            "matched_percentages": percentages(texts),
        }
    )
    return out.withColumn("effective_rate", F.col("interest_rate") - F.col("subsidy_rate")).drop("__texts")
