"""Quantities recorded in different units and scales, brought to yuan and months.

Statements in text are read with their units. Recorded numbers often lack a unit; a calibrated
ensemble of trees predicts it from the number's magnitude, the spelling of a unit hint, the source
and category of the record, and the neighbouring fields. Confident predictions are converted, and
marked where the record's own evidence contradicts them; uncertain ones are routed for review, which
takes what the evidence states, if it does. Empty fields are filled from the evidence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.codepoints import sliced
from millrace.operators.forest import Forest
from millrace.session import Stored

#: Units of money in yuan and of time in months, with their spellings.
MONEY = {"yuan": 1.0, "thousand": 1e3, "wan": 1e4, "million": 1e6, "yi": 1e8}
MONEY_WORDS = {"元": "yuan", "圆": "yuan", "yuan": "yuan", "rmb": "yuan", "cny": "yuan", "¥": "yuan", "千元": "thousand", "仟元": "thousand", "k": "thousand", "thousand": "thousand", "万元": "wan", "万": "wan", "萬元": "wan", "萬": "wan", "w": "wan", "w元": "wan", "wan": "wan", "10k cny": "wan", "million": "million", "m": "million", "mn": "million", "亿元": "yi", "亿": "yi", "億元": "yi", "億": "yi", "yi": "yi"}
TIME = {"day": 1 / 30, "month": 1.0, "quarter": 3.0, "year": 12.0}
TIME_WORDS = {"天": "day", "日": "day", "d": "day", "day": "day", "days": "day", "月": "month", "个月": "month", "m": "month", "month": "month", "months": "month", "mo": "month", "mos": "month", "季": "quarter", "季度": "quarter", "个季度": "quarter", "quarter": "quarter", "quarters": "quarter", "年": "year", "周年": "year", "y": "year", "yr": "year", "yrs": "year", "year": "year", "years": "year"}
HAN_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {c: i for i, c in enumerate("〇壹贰叁肆伍陆柒捌玖")} | {"两": 2, "贰": 2, "弍": 2, "參": 3, "陸": 6}
HAN_TENS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
ENGLISH = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"a": 1, "an": 1}

HAN_NUMBER = "[零〇一二三四五六七八九十百千两壹贰叁肆伍陆柒捌玖拾佰仟弍參陸]+"
NUMBER = rf"(?:\d[\d,]*(?:\.\d+)?|{HAN_NUMBER})"
WORD_NUMBER = r"(?:\d[\d,]*(?:\.\d+)?|(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?|" + "|".join(sorted(ENGLISH, key=len, reverse=True)) + ")"
UNIT = r"(?:亿元|億元|万元|萬元|千元|仟元|亿|億|万|萬|w元|w(?![a-z])|元|圆|k\s?元?(?![a-z])|million(?:\s+yuan)?|mn?(?![a-z])|thousand(?:\s+yuan)?|yuan)"
PREFIX = r"(?:人民币|RMB|CNY|[¥￥])"
MONEY_RE = rf"(?P<cur>{PREFIX})?\s*(?P<a>{NUMBER})\s*(?P<am>[十百千佰仟](?=[万萬]))?\s*(?P<au>{UNIT})?(?:\s*(?:[—–\-~～至到]+|to)\s*{PREFIX}?\s*(?P<b>{NUMBER})\s*(?P<bm>[十百千佰仟](?=[万萬]))?\s*(?P<bu>{UNIT})?)?"
LIMIT_HINT = r"(?:最高可贷|最高可借|最高贷款|(?:额度|金额|授信|单户|单笔|贷款|借款)(?:的)?(?:上限|限额)(?:为|是|:|：)?|上限为|额度最高|额度为|(?:金额|额度)(?:不得?超过|不高于|最多|控制在)|可申请|capped at|draw up to|borrow up to|maximum loan(?: amount)? (?:is|of)|ceiling (?:for|on) [^.;。]{1,60}? is)"
TERM_HINT = r"(?:(?<!保存)(?<!公示)(?<!保管)(?<!存放)(?<!办理)期限(?:最长|最多|一般|控制|不得?超过|不超过|设定)?(?:为|在|不得?超过|不超过|是|:|：)?|loan runs for|runs for|(?:loan )?term of|repayable (?:over|within))"
YEARS = rf"(?P<years>{NUMBER})\s*(?:周年|年)(?:(?P<half>半)|(?:\s*[零又]?\s*(?P<plus>{NUMBER})\s*个?月))?"
TERM_RE = rf"(?:{YEARS}|(?P<onlyhalf>半年)|(?P<number>{NUMBER})\s*(?P<ch>个?季度|个?月|天|日)|(?P<word>{WORD_NUMBER})[ \-]*(?P<en>years?|yrs?|months?|mos?|quarters?|days?)\b(?P<andhalf> and a half)?(?:\s*(?:and|,)?\s*(?P<word2>{WORD_NUMBER})[ \-]*(?P<en2>months?|days?)\b)?|(?P<halfyear>half a year))"


@lru_cache(1)
def patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    built = (LIMIT_HINT + r"\s*" + MONEY_RE, TERM_HINT + r"\s*" + TERM_RE, r"\s*over\s+" + TERM_RE)
    return tuple(re.compile(p.replace(r"\s", r"[^\S\n]"), re.IGNORECASE) for p in built)  # a statement never crosses a paragraph


def plain(text: str) -> str:
    """Compatibility forms unified, invisible characters and layout breaks within words removed."""
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = re.sub("[\u200b-\u200f\u2060\ufeff\u00ad\ufe00-\ufe0f]", "", text).translate(_LOOKALIKES)
        text = re.sub(r"(?<=[^\x00-\x7f])\n(?!\n)|\n(?=[^\x00-\x7f\n])(?<!\n\n)", "", text)
    return re.sub(r"(?<!\n)\n(?!\n)", " ", text)


#: Fixed value: letters that stand in for Latin ones in unit words.
_LOOKALIKES = str.maketrans("АВЕКМНОРСТХаеорсухіΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxiABEZHIKMNOPTYXo")


def number(text: str | None) -> float | None:
    """A number in digits, in Han numerals or in English words."""
    if not text:
        return None
    text = text.strip().lower()
    if text[0].isdigit():
        try:
            return float(text.replace(",", ""))
        except ValueError:
            return None
    if text[0] in HAN_DIGITS or text[0] in HAN_TENS:
        if all(c in HAN_DIGITS for c in text):
            return float("".join(str(HAN_DIGITS[c]) for c in text))
        total, digit = 0, None
        for c in text:
            if c in HAN_DIGITS:
                digit = HAN_DIGITS[c]
            else:
                total += (1 if digit is None else digit) * HAN_TENS[c]
                digit = 0
        return float(total + (digit or 0))
    parts = re.split(r"[- ]", text)
    return float(sum(ENGLISH[p] for p in parts)) if all(p in ENGLISH for p in parts) else None


def money_unit(word: str | None) -> str | None:
    word = re.sub(r"\s+", " ", (word or "").strip().lower())
    return MONEY_WORDS.get(word) or MONEY_WORDS.get(word.removesuffix("yuan").strip()) or MONEY_WORDS.get(word.removesuffix("元").strip())


def time_unit(word: str | None) -> str | None:
    return TIME_WORDS.get((word or "").strip().lower())


def _money(m: re.Match) -> tuple[float, float, str] | None:
    """(yuan, number as written, unit as written) of a matched amount; of a range the upper end."""
    second = m["b"] and (m["bu"] or m["au"])
    value, unit, tens = (number(m["b"]), m["bu"] or m["au"], m["bm"]) if second else (number(m["a"]), m["au"], m["am"])
    if value is None or not (unit or m["cur"]):
        return None
    shown = value * HAN_TENS.get(tens, 1) if tens else value
    named = money_unit(unit) if unit else "yuan"
    return (shown * MONEY[named], value, named) if named else None


def _months(m: re.Match) -> tuple[float, float, str] | None:
    if m["years"]:
        years = number(m["years"])
        return None if years is None or years > 100 else (years * 12 + (6 if m["half"] else 0) + (number(m["plus"]) or 0), years, "year")
    if m["onlyhalf"] or m["halfyear"]:
        return 6.0, 0.5, "year"
    if m["number"]:
        value, unit = number(m["number"]), time_unit(m["ch"])
    else:
        value, unit = number(m["word"]), time_unit(m["en"])
    if value is None or unit is None:
        return None
    more = (number(m["word2"]) or 0) * TIME[time_unit(m["en2"])] if m["word"] and m["word2"] else 0
    half = 0.5 if m["word"] and m["andhalf"] else 0
    return (value + half) * TIME[unit] + more, value, unit


def statements(text: str | None) -> list[tuple[str, int, float, str]]:
    """(quantity, value in yuan or months, number as written, unit as written) of each limit and term that the text states."""
    if not text:
        return []
    text = plain(text)
    out = []
    limit, term, over = patterns()
    for m in limit.finditer(text):
        found = _money(m)
        if found and found[0] > 0:
            out.append(("amount", round(found[0]), *found[1:]))
            follows = over.match(text, m.end())
            months = follows and _months(follows)
            if months:
                out.append(("term", round(months[0]), *months[1:]))
    for m in term.finditer(text):
        months = _months(m)
        if months and months[0] > 0:
            out.append(("term", round(months[0]), *months[1:]))
    return out


#: Words that a text speaks of a quantity with, however it words it: of a loan or limit, and of money; of a loan's course, and of time.
MENTION = {
    "amount": (r"贷|借|授信|额度|限额|金额|上限|最高|最多|至多|\b(?:loan|lend|lent|borrow|credit|limit|ceiling|cap|maximum|up to|advance)", r"元|圆|块|万|萬|亿|億|人民币|[¥￥]|\b(?:rmb|cny|yuan)|(?:\d|\b)(?:million|mn|thousand|[kmw])\b"),
    "term": (r"期|贷|借|还|\b(?:loan|term|tenor|tenure|matur|repa[iy]|runs?|period|borrow|due)", r"年|月|季|天|日|周|\b(?:year|yr|month|mo|quarter|day|week)s?\b|\d[ymd]\b"),
}


@lru_cache(1)
def mention_patterns() -> dict[str, tuple[re.Pattern, ...]]:
    any_number = rf"\d|{HAN_NUMBER}|半|\b{WORD_NUMBER}\b|\bhalf\b"
    return {q: tuple(re.compile(p, re.IGNORECASE) for p in (*words, any_number)) for q, words in MENTION.items()}


def mentioned(text: str | None) -> list[str]:
    """The quantities that the text speaks of, in whatever words: it has a number, a word of the quantity and one of its measure."""
    if not text:
        return []
    text = plain(text)
    return [q for q, words in mention_patterns().items() if all(w.search(text) for w in words)]


def stated(df: DataFrame, key: str, text: str, mentions: bool = False) -> DataFrame:
    """One row per statement: record_id, quantity, common_value, number, unit. Null texts state nothing. With ``mentions`` also a row without value per quantity that the text speaks of but does not state in a known way."""

    def found(text: str | None) -> list[tuple]:
        out = statements(text)
        if mentions and len(told := {s[0] for s in out}) < len(MENTION):
            out += [(q, None, None, None) for q in mentioned(text) if q not in told]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            rows = [(k, *s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in found(t)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()))], names=["record_id", "quantity", "common_value", "number", "unit"])

    return df.select(F.col(key).cast("string").alias("record_id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, "record_id string, quantity string, common_value bigint, number double, unit string")


#: The recorded fields: quantity, column, hint columns.
FIELDS = {"amount": ("loan_amount_upper_limit", "amount_text", "amount_unit", MONEY, money_unit), "term": ("loan_term_months", "term_text", "term_unit", TIME, time_unit)}
#: Units that a recorded number may have.
CHOICES = {"amount": ("yuan", "thousand", "wan", "million", "yi"), "term": ("day", "month", "quarter", "year")}
#: Labelled records that the trees are fitted on.
SAMPLE = 20_000
#: A prediction is converted from this calibrated confidence on.
CONFIDENT = 0.95


def _hint(texts: pd.Series, units: pd.Series, read) -> pd.Series:
    """The unit that the free hint names, from its own column or from the end of the recorded text."""
    tail = texts.map(lambda t: re.sub(r"^\s*[\d.,]+\s*", "", t) if isinstance(t, str) else None)
    named = lambda s: s.map(lambda u: read(u) if isinstance(u, str) else None).astype(object)
    return named(units).combine_first(named(tail))


def features(rows: pd.DataFrame, quantity: str) -> np.ndarray:
    """Magnitude, hint, category and source (hashed), and the other field's magnitude. Nothing of what the evidence states: that gives the labels, and the rows that need a prediction lack it."""
    choices = CHOICES[quantity]
    other = "term_value" if quantity == "amount" else "amount_value"
    value = rows[f"{quantity}_value"].astype(float)
    log = lambda s: np.log10(s.astype(float).where(s > 0)).fillna(-9).to_numpy()
    code = lambda s: s.map({u: i for i, u in enumerate(choices)}).fillna(-1).to_numpy(float)
    hashed = lambda s: pd.util.hash_array(s.fillna("").astype(str).to_numpy(object)).astype(np.uint64) % np.uint64(31)
    return np.stack([log(value), code(rows["hint"]), hashed(rows["category"]).astype(float), hashed(rows["source"]).astype(float), log(rows[other])], axis=1)


def labels(rows: pd.DataFrame, quantity: str) -> np.ndarray:
    """The unit in which the recorded number equals what the evidence states, or -1."""
    _, _, _, scale, _ = FIELDS[quantity]
    value, truth = rows[f"{quantity}_value"].to_numpy(float), rows["stated"].to_numpy(float)
    out = np.full(len(rows), -1)
    for k, unit in enumerate(CHOICES[quantity]):
        with np.errstate(invalid="ignore"):
            out[(np.abs(value * scale[unit] - truth) <= np.maximum(1e-6 * truth, 0.51 if quantity == "term" else 0.5)) & (out < 0)] = k
    return out


def records(parameters: DataFrame, evidence: DataFrame) -> DataFrame:
    """The recorded numbers with their hints, what their evidence states (the first statement of each quantity), and whether it speaks of the quantity at all."""
    base = parameters.select(
        "evidence_id", F.col("demand_scenario").alias("category"), F.element_at(F.split("evidence_id", ":"), 1).alias("source"),
        F.col("loan_amount_upper_limit").cast("double").alias("amount_value"), F.col("loan_term_months").cast("double").alias("term_value"),
        *(F.col(f"raw_slots.{c}").alias(c) for c in ("amount_text", "amount_unit", "term_text", "term_unit")),
    ).where("evidence_id is not null").distinct()
    said = stated(evidence.select("evidence_id", "evidence_text").distinct(), "evidence_id", "evidence_text", mentions=True)
    per = said.groupBy("record_id", "quantity").agg(F.min(F.when(F.col("common_value").isNotNull(), F.struct("common_value", "number", "unit"))).alias("s"))
    for q in FIELDS:
        own = per.where(F.col("quantity") == q).select(F.col("record_id").alias("evidence_id"), F.col("s").alias(f"{q}_said"), F.lit(True).alias(f"{q}_spoken"))
        base = base.join(own, "evidence_id", "left")
    return base


def _frame(rows: pd.DataFrame, quantity: str) -> pd.DataFrame:
    _, text, unit, _, read = FIELDS[quantity]
    out = rows.copy()
    said = rows[f"{quantity}_said"]
    part = lambda name: said.map(lambda s: None if s is None else s[name])
    out["stated"] = part("common_value").astype(float)
    out["hint"] = _hint(rows[text], rows[unit], read)
    out["spoken"] = rows[f"{quantity}_spoken"].map(bool)
    return out


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict[str, Forest]:
    """A calibrated forest per quantity, fitted on about ``sample`` records whose evidence tells the unit."""
    labelled = rows.where("amount_said is not null and amount_value is not null or term_said is not null and term_value is not null")
    share = min(1.0, sample / max(labelled.count(), 1))
    held = _pandas(labelled.where(F.pmod(F.xxhash64("evidence_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).toArrow())
    out = {}
    for q in FIELDS:
        frame = _frame(held, q)
        y = labels(frame, q)
        good = y >= 0
        out[q] = Forest.fit(features(frame[good], q), y[good], len(CHOICES[q]))
    return out


def _pandas(table: pa.Table | pa.RecordBatch) -> pd.DataFrame:
    return pd.DataFrame({n: table.column(n).to_pylist() for n in table.schema.names})


def converted(rows: DataFrame, models: dict[str, Forest], confident: float = CONFIDENT) -> DataFrame:
    """One row per record and quantity that is recorded or stated: the predicted unit, its confidence, the common value and the route.

    route: ``converted`` (recorded, in a confident unit), ``review`` (recorded, in an uncertain one:
    the common value is what the evidence states, else the conversion by the likeliest unit),
    ``stated`` (an empty field, filled from the evidence). ``contradicted``: the conversion is not
    what the evidence states. ``spoken``: the evidence states the quantity, or speaks of it in words
    that are not read. Null ids have no row; repeated records count once.
    """
    names = ["evidence_id", "quantity", "value", "unit", "confidence", "common_value", "stated_value", "route", "contradicted", "spoken"]
    schema = "evidence_id string, quantity string, value double, unit string, confidence double, common_value bigint, stated_value bigint, route string, contradicted boolean, spoken boolean"
    types = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = _pandas(batch)
            for q, (_, _, _, scale, _) in FIELDS.items():
                frame = _frame(held, q)
                frame = frame[frame[f"{q}_value"].notna() | frame["stated"].notna()]
                if not len(frame):
                    continue
                unit, sure = models[q].predict(features(frame, q))
                value, said = frame[f"{q}_value"].to_numpy(float), frame["stated"].to_numpy(float)
                units = np.array(CHOICES[q])[unit]
                with np.errstate(invalid="ignore"):
                    common = np.round(value * np.array([scale[u] for u in CHOICES[q]])[unit])
                    agrees = np.isclose(common, said, rtol=1e-6, atol=0.51)
                filled, known = ~np.isnan(value), ~np.isnan(said)
                good = filled & (sure >= confident)
                route = np.where(good, "converted", np.where(filled, "review", "stated"))
                final = np.where(known & ~good, said, np.where(filled, common, said))
                whole = lambda x: [None if np.isnan(v) else int(v) for v in x]
                columns = (frame["evidence_id"], [q] * len(frame), [None if np.isnan(v) else v for v in value], np.where(filled, units, None), np.where(filled, sure, np.nan), whole(final), whole(said), route, filled & known & ~agrees, frame["spoken"])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t, from_pandas=True) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, schema)


def common_quantities(chunks: DataFrame, parameters: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All quantities in yuan and months, of the texts (one row per distinct value) and of the records."""
    texts = stated(chunks, "chunk_id", "chunk_text").select(F.lit("chunk_text").alias("field_name"), "record_id", "quantity", "common_value").distinct()
    rows = Stored(records(parameters, evidence)).rows
    return texts, converted(rows, fit(rows))
