"""Session memory over a stream: one state row per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.operators.session import FLAGS, SLOTS, turn_slots

_TYPES = {s: T.BooleanType() if s in FLAGS else T.StringType() for s in SLOTS}
STATE = T.StructType([*(T.StructField(s, t) for s, t in _TYPES.items()), T.StructField("turn", T.LongType())])
OUTPUT = T.StructType([T.StructField("session_id", T.StringType()), *STATE.fields])


def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Slots that a turn states replace the remembered ones; turns of one batch count in their order, and a late turn never replaces a later one's value when it comes in the same batch."""
    held = list(state.get) if state.exists else [None] * (len(SLOTS) + 1)
    rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
    for row in rows.itertuples():
        for k, s in enumerate(SLOTS):
            value = getattr(row, s)
            if value is not None and value == value:
                held[k] = bool(value) if s in FLAGS else value
        held[-1] = max(int(row.turn), held[-1] if held[-1] is not None else int(row.turn))
    state.update(tuple(held))
    yield pd.DataFrame([[key[0], *held]], columns=[f.name for f in OUTPUT.fields]).astype(object)


def session_states(turns: DataFrame, evidence: str | None = None) -> DataFrame:
    """turns: a stream of session_id, turn and query. Each batch gives the state of the sessions it touched (update mode)."""
    slots = turn_slots(turns, evidence=evidence).select("session_id", "turn", *SLOTS)
    return slots.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")
