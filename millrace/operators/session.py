"""Session memory: slots read from each turn, and carried forward within a session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rule packs (first match wins) and patterns, as lists of data.
ACTIVITY = (("养牛|肉牛|奶牛", "养牛"), ("养猪|生猪|育肥猪|母猪", "养猪"), ("养羊", "养羊"), ("养鸡|蛋鸡|肉鸡", "养鸡"), ("养鱼|水产|渔业|养虾", "水产养殖"), ("种粮|粮食|小麦|玉米|水稻", "粮食种植"), ("果园|苹果|柑橘|葡萄|猕猴桃", "水果种植"), ("蔬菜|大棚|设施农业", "设施农业"))
PURPOSE = (("买化肥|化肥|种子|农药|饲料|农资", "农业生产资料投入"), ("周转|流动资金|经营周转", "经营周转"), ("扩建|扩大|新建|建棚|建圈舍", "扩大生产"), ("购置设备|买设备|农机|机器", "设备购置"))
AMOUNT = r"((?:\d+(?:\.\d+)?)\s*(?:万元|万|元))"
DURATION = r"((?:\d+(?:\.\d+)?)\s*(?:个月|月|年)|半年|一年|两年|三年)"
#: slot -> (pattern of no, pattern of yes); no is looked for first.
FLAGS = {
    "existing_loan": ("没有贷款|无贷款|已还清|都还完了|没有未结清", "没还完|未还完|未结清|没结清|还有.*没还|还有一点没还|续贷|展期|旧贷"),
    "cooperative": ("不是合作社|非合作社", "合作社"),
    "guarantor": ("没有担保人|无担保人|没人担保", "担保人|保证人|有人担保|找人担保"),
    "collateral": ("无抵押|没有抵押|没抵押物", "抵押|抵押物|房产作抵押|有抵押物|有抵押"),
}
SLOTS = ("normalized_query", "purpose", "amount", "crop_or_activity", "duration", *FLAGS)


def _first_rule(t: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, r: c.when(t.rlike(r[0]), r[1]), rules, F.when(F.lit(False), ""))


def turn_slots(turns: DataFrame, query: str = "query", evidence: str | None = "evidence") -> DataFrame:
    """The slots that each turn states; null where it states none. The text is the query and the turn's evidence lines."""
    asked = F.trim(F.coalesce(F.col(query), F.lit("")))
    lines = F.filter(F.transform(F.coalesce(F.col(evidence), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "") if evidence else F.array().cast("array<string>")
    t = F.array_join(F.filter(F.concat(F.array(asked), lines), lambda x: x != ""), "\n")
    match = lambda p: F.nullif(F.regexp_replace(F.regexp_extract(t, p, 1), r"(?U)\s+", ""), F.lit(""))
    slots = {"normalized_query": F.nullif(asked, F.lit("")), "purpose": _first_rule(t, PURPOSE), "amount": match(AMOUNT), "crop_or_activity": _first_rule(t, ACTIVITY), "duration": match(DURATION)}
    slots |= {s: F.when(t.rlike(no), False).when(t.rlike(yes), True) for s, (no, yes) in FLAGS.items()}
    return turns.withColumns(slots)


def carried(turns: DataFrame, session: str = "session_id", turn: str = "turn", block: int = 10_000) -> DataFrame:
    """Each slot's last stated value up to and with each turn.

    A session is carried in blocks of ``block`` turns, and what a block begins with comes from a
    summary of the blocks before it, so no task holds a whole long session.
    """
    key = [session, "__block"]
    rows = turns.withColumn("__block", F.floor(F.col(turn).cast("double") / block))
    ends = rows.groupBy(*key).agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), F.col(turn))).alias(s) for s in SLOTS))
    before = W.partitionBy(session).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    begins = ends.select(*key, *(F.last(s, ignorenulls=True).over(before).alias(f"__{s}") for s in SLOTS))
    within = W.partitionBy(*key).orderBy(turn).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(begins, key, "left").withColumns({s: F.coalesce(F.last(s, ignorenulls=True).over(within), F.col(f"__{s}")) for s in SLOTS})
    return out.select(*turns.columns)


def latest(turns: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """One row per session: the last stated value of each slot, without a window, so that a long session is aggregated before it is shuffled."""
    return turns.groupBy(session).agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), F.col(turn))).alias(s) for s in SLOTS), F.max(turn).alias(turn))
