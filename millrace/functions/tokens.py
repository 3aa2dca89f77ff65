"""Retrieval terms of whole columns, on code-point arrays: the same terms as ``text.terms``, for corpora."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.codepoints import TOP, Hashes, decode, encode, row_of, sliced

WHOLE, LONGEST = 8, 4


@lru_cache(1)
def word_table() -> np.ndarray:
    out = np.zeros(TOP, bool)
    out[[c for c in range(0x33480) if unicodedata.category(chr(c))[0] in "LN"]] = True
    return out


def term_spans(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """The distinct terms of each text in order; null texts have none: the code points of all texts, and start, end, text and hash of each term."""
    folded = pc.replace_substring(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), "ß", "ss")
    points, offsets = decode(folded)
    n = len(points)
    row = row_of(offsets)
    word = word_table()[points]
    han = (points >= 0x4E00) & (points <= 0x9FFF)

    def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = mask.copy(), mask.copy()
        if n > 1:
            apart = row[1:] != row[:-1]
            begin[1:] &= ~mask[:-1] | apart
            end[:-1] &= ~mask[1:] | apart
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    piece_from, piece_to = runs(word)
    seen = np.zeros(n + 1, np.int64)
    np.cumsum(han, out=seen[1:])
    pure = seen[piece_to] - seen[piece_from] == piece_to - piece_from
    plain = ~pure & (piece_to - piece_from > 1)
    starts, ends, ranks = [piece_from[plain]], [piece_to[plain]], [piece_from[plain] * 8]
    span_from, span_to = runs(han & word)
    size = span_to - span_from
    if len(span_from):
        own = np.searchsorted(piece_from, span_from, "right") - 1
        late = ~pure[own]  # spans within mixed pieces come after all pieces
        first = (span_from + late * (n + 1)) * 8
        whole = (size <= WHOLE)
        starts.append(span_from[whole]), ends.append(span_to[whole]), ranks.append(first[whole])
        for k in range(2, LONGEST + 1):
            many = np.maximum(size - k + 1, 0)
            at = np.repeat(np.arange(len(size)), many)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            starts.append(span_from[at] + inner), ends.append(span_from[at] + inner + k), ranks.append(first[at] + k - 1)
    start, end, rank = (np.concatenate(x) for x in (starts, ends, ranks))
    order = np.lexsort((start, rank, row[start]))
    start, end = start[order], end[order]
    of = row[start]
    own = Hashes(points).of(start, end)
    key = own ^ ((of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    first.sort()
    return points, start[first], end[first], of[first], own[first]


def listed(points: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, n: int) -> pa.ListArray:
    """The terms as lists of n texts."""
    if not len(start):
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    length = end - start
    edges = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=edges[1:])
    flat = np.repeat(start - edges[:-1], length) + np.arange(edges[-1])
    terms = encode(points[flat], edges).cast(pa.string())
    lists = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), terms)


def term_lists(texts: pa.Array) -> pa.ListArray:
    """The distinct terms of each text in order; null texts have none."""
    points, start, end, of, _ = term_spans(texts)
    return listed(points, start, end, of, len(texts))


def wanted_lists(texts: pa.Array, wanted: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """Of each text the number of all its distinct terms, and those of them that are wanted, in order."""
    every, offsets = decode(wanted)
    hashes = np.unique(Hashes(every).of(offsets[:-1], offsets[1:]))
    points, start, end, of, own = term_spans(texts)
    length = np.bincount(of, minlength=len(texts))
    keep = np.flatnonzero(np.isin(own, hashes))
    lists = listed(points, start[keep], end[keep], of[keep], len(texts))
    if not pc.all(sure := pc.is_in(lists.values, value_set=wanted), min_count=0).as_py():  # another term with the hash of a wanted one
        keep = keep[sure.to_numpy(zero_copy_only=False)]
        lists = listed(points, start[keep], end[keep], of[keep], len(texts))
    return length, lists


def terms(column: Column) -> Column:
    """The terms of a column in Arrow batches; null texts have none."""

    def of(texts: pa.Array) -> pa.Array:
        return term_lists(texts)

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # they say that it is a scalar function
    return F.arrow_udf(of, T.ArrayType(T.StringType()))(column)


def with_terms(df: DataFrame, key: str, column: Column, only: list[str] | None = None) -> DataFrame:
    """id, length (number of distinct terms) and terms of each row; of the terms ``only`` these, if given."""
    wanted = df.select(F.col(key).alias("id"), column.cast("string").alias("__text"))
    schema = T.StructType([wanted.schema["id"], T.StructField("length", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType()))])

    shared = None if only is None else df.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None if shared is None else pa.array(shared.value, pa.string())
        for batch in sliced(batches, "__text", 1 << 20):
            if some is None:
                lists = term_lists(batch.column("__text"))
                length = pc.list_value_length(lists)
            else:
                length, lists = wanted_lists(batch.column("__text"), some)
                length = pa.array(length)
            yield pa.RecordBatch.from_arrays([batch.column(0), length.cast(pa.int32()), lists], names=["id", "length", "terms"])

    return wanted.mapInArrow(run, schema)
