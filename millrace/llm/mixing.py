"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. Each mix has a schedule per source: its weight over the
course of training, linear between knots. The integral of a source's schedule is its share of the
mix; a source that would have to be repeated more often than its cap gives what the cap allows,
and the rest goes to the others by their shares. A document's place in the cumulative token demand
of its source, sent through the inverse of the source's integrated schedule, is its position in
training; documents are range-sorted by position.

Within a source, documents stand in the order of a hash. Their cumulative sizes come from sums per
hash bucket, so no task ever holds a source.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.codepoints import sliced
from millrace.session import checkpointed

#: Where the vocabularies lie on every executor (a setting of the session may name another folder), and which one counts.
FOLDER_SETTING = "spark.millrace.tokenizers"
VOCABULARIES, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public split pattern of byte-level BPE of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS, PER_BUCKET = 1024, 1_000_000
#: Rows of a mix that the driver plans; a mix names its sources one by one.
MOST_TARGETS = 100_000
#: Source name -> knots (place in training from 0 to 1, factor on the source's weight). The others have a flat schedule.
Schedule = dict[str, list[tuple[float, float]]]
#: The most that a source's weight departs from its mean over the course of training.
TILT = 0.5


@lru_cache(2)
def encoder(folder: str, name: str):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def canonical(source: Column | str) -> Column:
    """A source's name without differences of case, blanks at its ends, and hyphens for underscores; blank is null."""
    plain = F.replace(F.lower(F.trim(source)), F.lit("-"), F.lit("_"))
    return F.when(plain != "", plain)


def sized(docs: DataFrame, key: str, text: str, source: str, folder: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """key, source (canonical) and tokens of each document; null and empty texts have 0."""
    folder = folder or docs.sparkSession.conf.get(FOLDER_SETTING, VOCABULARIES)
    wanted = docs.select(key, canonical(F.col(source).cast("string")).alias("source"), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([docs.schema[key], T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(folder, name).encode_ordinary
        for batch in sliced(batches, "__text"):
            tokens = [len(count(t)) if t else 0 for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=[key, "source", "tokens"])

    return wanted.mapInArrow(run, schema)


def plan(available: dict[str, int], corpus: int, targets: pd.DataFrame) -> pd.DataFrame:
    """For each row of targets (mix_id, source, target_share, max_repeats, budget_share): the tokens it is to give.

    Shares count within a mix. Null or negative shares count as 0, a null cap as none.
    """
    out = []
    for mix_id, rows in targets.groupby("mix_id", sort=True):
        rows = rows.groupby("source", as_index=False).agg({"mix_id": "first", "target_share": "sum", "max_repeats": "max", "budget_share": "first"}).sort_values("source")
        share = rows.target_share.fillna(0).clip(lower=0).to_numpy(float)
        share = share / share.sum() if share.sum() > 0 else share
        have = np.array([available.get(s, 0) for s in rows.source], float)
        cap = np.multiply(have, rows.max_repeats.fillna(np.inf).to_numpy(float), out=np.zeros(len(rows)), where=have > 0)
        budget = float(rows.budget_share.iloc[0]) * corpus if pd.notna(rows.budget_share.iloc[0]) else float(corpus)
        give = np.zeros(len(rows))
        free = (share > 0) & (cap > 0)
        while free.any():  # each round caps at least one source
            left = budget - give[~free].sum()
            want = share / share[free].sum() * left
            over = free & (want >= cap)
            if not over.any():
                give[free] = want[free]
                break
            give[over] = cap[over]
            free &= ~over
        out.append(pd.DataFrame({"mix_id": mix_id, "source": rows.source, "target_share": share, "max_repeats": rows.max_repeats, "available": have.astype(np.int64), "wanted": share * budget, "demand": give, "capped": (share > 0) & (give < share * budget - 0.5) & (give >= cap - 0.5)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["mix_id", "source", "target_share", "max_repeats", "available", "wanted", "demand", "capped"])


def tilted(rows: pd.DataFrame, tilt: float = TILT) -> Schedule:
    """The schedule of a mix: sources that are repeated more come later, the plentiful ones first.

    A source's weight runs from 1 - c to 1 + c, so its integral stays its share; c grows with the
    logarithm of its epochs, is zero on the demand's average (the rates of all sources together
    are the same throughout), and is at most ``tilt``.
    """
    used = rows[(rows.demand > 0) & (rows.available > 0)]
    if used.empty:
        return {}
    epochs = np.log(used.demand.to_numpy(float) / used.available.to_numpy(float))
    c = epochs - np.average(epochs, weights=used.demand.to_numpy(float))
    most = np.abs(c).max()
    c = c * (tilt / most) if most > 1e-9 else np.zeros(len(c))
    return {s: [(0.0, 1.0 - x), (1.0, 1.0 + x)] for s, x in zip(used.source, c.tolist())}


def inverse_schedule(rows: pd.DataFrame, schedule: Schedule, steps: int = 1000) -> dict[str, list[float]]:
    """Per source, the place in training at which 0, 1/steps, ... of its demand is met.

    With weights w_s(t) the mix draws from s at the rate w_s(t) of the tokens at t; integrating and
    scaling to the source's demand gives the cumulative demand, which is inverted here.
    """
    t = np.linspace(0, 1, steps + 1)
    out = {}
    for r in rows.itertuples():
        knots = sorted(schedule.get(r.source, [(0.0, 1.0)]))
        weight = np.interp(t, [k for k, _ in knots], [max(w, 0.0) for _, w in knots])
        grown = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        grown = grown / grown[-1] if grown[-1] > 0 else t
        keep = np.concatenate([[True], np.diff(grown) > 0])
        out[r.source] = np.interp(t, grown[keep], t[keep]).tolist()
    return out


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", schedules: dict[int, Schedule] | Callable[[pd.DataFrame], Schedule] | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (mix_id, key, source, epoch, tokens, position from 0 to 1, sorted by mix and position) and the report (one row per mix and source: shares wanted and reached).

    A document is in a mix once per epoch of its source, and in the last, partial epoch if the
    middle of its tokens lies within the demand. Sources that are absent from the corpus reach 0.
    Documents without a source or without tokens, and targets without a source, are in no mix;
    repeated rows are documents of their own. At most MOST_TARGETS targets are planned.
    schedules: by mix, or what makes one from the planned rows of a mix; none for flat ones.
    """
    spark = docs.sparkSession
    sizes = sizes if sizes is not None else checkpointed(sized(docs, key, text, source))
    corpus, rows = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    buckets = max(BUCKETS, rows // PER_BUCKET)  # so that a bucket of the largest source stays small
    spread = sizes.where("source is not null and tokens > 0").withColumn("h", F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 62)))
    spread = spread.withColumn("bucket", F.expr(f"h div {-(-(1 << 62) // buckets)}").cast("int"))
    names = targets.select("mix_id", canonical("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("double"), F.col("budget_share").cast("double")).where("source is not null")
    wanted = names.limit(MOST_TARGETS + 1).toPandas()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"a plan of more than {MOST_TARGETS} targets")
    named = spread.join(F.broadcast(spark.createDataFrame([(s,) for s in sorted(set(wanted.source))] or [("",)], "source string")), "source", "left_semi")
    sums = named.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    totals = {r.source: int(r.tokens) for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # at most MOST_TARGETS rows
    decided = plan(totals, int(corpus), wanted)
    starts = sums.withColumn("start", F.sum("tokens").over(W.partitionBy("source").orderBy("bucket")) - F.col("tokens")).select("source", "bucket", "start")  # a row per bucket and source
    inner = W.partitionBy("source", "bucket").orderBy("h", key)
    placed = named.join(F.broadcast(starts) if len(totals) * buckets < 1_000_000 else starts, ["source", "bucket"]).withColumn("before", F.col("start") + F.sum("tokens").over(inner) - F.col("tokens"))
    curves = []
    for mix_id, rows in decided[decided.demand > 0].groupby("mix_id"):
        curve = inverse_schedule(rows, schedules(rows) if callable(schedules) else (schedules or {}).get(int(mix_id), {}))
        curves += [(int(mix_id), r.source, int(r.available), float(r.demand), curve[r.source]) for r in rows.itertuples()]
    demand = spark.createDataFrame(curves, "mix_id int, source string, available bigint, demand double, curve array<double>")
    drawn = placed.join(F.broadcast(demand), "source")
    middle = F.col("before") + F.col("tokens") / 2
    times = F.floor((F.col("demand") - middle) / F.col("available")).cast("int")  # the last epoch that still holds it
    drawn = drawn.where(times >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times)))
    reach = F.least(F.lit(1.0), (F.col("epoch") * F.col("available") + middle) / F.col("demand")) * (F.size("curve") - 1)
    low = F.least(F.floor(reach), F.size("curve") - 2).cast("int")
    at = F.element_at("curve", low + 1) + (reach - low) * (F.element_at("curve", low + 2) - F.element_at("curve", low + 1))
    mixed = drawn.select("mix_id", key, "source", "epoch", "tokens", at.alias("position"))
    reached = mixed.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), (F.max("epoch") + 1).alias("epochs"))
    report = spark.createDataFrame(
        [(int(r.mix_id), r.source, float(r.target_share), None if pd.isna(r.max_repeats) else int(r.max_repeats), int(r.available), float(r.wanted), float(r.demand), bool(r.capped)) for r in decided.itertuples()],
        "mix_id int, source string, target_share double, max_repeats int, available bigint, wanted double, demand double, capped boolean",
    ).join(F.broadcast(reached), ["mix_id", "source"], "left")
    total = F.sum("tokens").over(W.partitionBy("mix_id"))
    report = report.withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "rows": F.coalesce("rows", F.lit(0)), "epochs": F.coalesce("epochs", F.lit(0))}).withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
    ordered = mixed.repartitionByRange("mix_id", "position").sortWithinPartitions("mix_id", "position", key)
    return ordered, report


def bands(mixed: DataFrame, many: int = 10) -> DataFrame:
    """Of each mix, source and band of training positions (0 to many - 1): tokens, and the share of the band's tokens."""
    band = F.least(F.lit(many - 1), F.floor(F.col("position") * many)).cast("int")
    sums = mixed.withColumn("band", band).groupBy("mix_id", "source", "band").agg(F.sum("tokens").alias("tokens"))
    return sums.withColumn("share", F.col("tokens") / F.sum("tokens").over(W.partitionBy("mix_id", "band")))
