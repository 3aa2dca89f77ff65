"""Splitting oversized items at natural boundaries.

An item is first cut into atomic segments at every natural boundary: ends of paragraphs, lines,
sentences (by the sentence operator) and clauses; a segment that is itself too long is cut at
spaces or, without any, evenly. Adjacent segments lie in a heap; the weakest boundary is merged
first, while the combined size and the overlap fit the limit. Each piece but the first then starts
up to ``overlap`` characters earlier, at a natural boundary where there is one. A sentence that fits
the limit but not with its overlap is a core of its own and gets a shorter overlap.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.codepoints import decode, sliced
from millrace.llm import sentences
from millrace.llm.maxent import MaxEnt

LIMIT, OVERLAP = 800, 100
#: Strengths of boundaries, from an arbitrary cut to the end of a paragraph.
ANY, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
CLAUSE_MARKS = "，、；：,;:）)」』”’"
#: What boundaries within an item stand at, found in one pass.
_STOPS = re.compile(f"[{re.escape(CLAUSE_MARKS)}\n]")
_SPACES = re.compile(r"\s*")
_WORDS = re.compile(r"\S+")


def boundaries(text: str, unit_ends: list[int]) -> dict[int, int]:
    """Place (where the next segment would begin) -> strength of each natural boundary within the text. White space goes with the segment before it."""
    out: dict[int, int] = {}
    n = len(text)
    after_space = lambda p: _SPACES.match(text, p).end()
    q = 0
    for m in _STOPS.finditer(text):
        p = m.start()
        if p < q and text[p] == "\n":
            continue  # within the white space that an earlier line break began
        if text[p] == "\n":
            q = after_space(p)
            out[q] = max(out.get(q, 0), PARAGRAPH if text.count("\n", p, q) > 1 else LINE)
        elif not (0 < p < n - 1 and text[p - 1].isdigit() and text[p + 1].isdigit()):
            e = after_space(p + 1)
            out[e] = max(out.get(e, 0), CLAUSE)
    for e in unit_ends:
        e = after_space(e)
        out[e] = max(out.get(e, 0), SENTENCE)
    out.pop(0, None)
    out.pop(n, None)
    return out


def segments(text: str, marks: dict[int, int], most: int, uncut: frozenset[tuple[int, int]] = frozenset()) -> tuple[list[int], list[int]]:
    """Cuts (first 0, last the length) of segments of at most ``most`` characters (but for those of ``uncut``), and the strength of each cut."""
    cuts, strength = [0], [PARAGRAPH]
    for p, s in [*sorted(marks.items()), (len(text), PARAGRAPH)]:
        while p - cuts[-1] > most and (cuts[-1], p) not in uncut:  # no natural boundary in reach
            space = max(text.rfind(" ", cuts[-1] + most // 2, cuts[-1] + most), text.rfind("\n", cuts[-1] + most // 2, cuts[-1] + most))
            whole = -(-(p - cuts[-1]) // most)
            at = space + 1 if space > 0 else cuts[-1] + -(-(p - cuts[-1]) // whole)
            cuts.append(at)
            strength.append(SPACE if space > 0 else ANY)
        cuts.append(p)
        strength.append(s)
    return cuts, strength


def merge(cuts: list[int], strength: list[int], most: int) -> list[int]:
    """The cuts that stay: adjacent segments are merged, the weakest cut first (then the smallest result, then the first in the text), while the result has at most ``most`` characters."""
    last = len(cuts) - 1
    before, after = list(range(-1, last)), list(range(1, last + 2))
    gone = [False] * (last + 1)
    size = lambda k: cuts[after[k]] - cuts[before[k]]
    heap = [(strength[k], size(k), k) for k in range(1, last) if size(k) <= most]
    heapq.heapify(heap)
    while heap:
        _, was, k = heapq.heappop(heap)
        if gone[k] or was != size(k):
            continue
        gone[k] = True
        a, b = before[k], after[k]
        after[a], before[b] = b, a
        for j in (a, b):
            if 0 < j < last and size(j) <= most:
                heapq.heappush(heap, (strength[j], size(j), j))
    return [c for k, c in enumerate(cuts) if not gone[k]]


def pieces(text: str, unit_ends: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core_start, end) of each piece: the cores are the text without gap or overlap; a piece is text[start:end]."""
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    marks = boundaries(text, unit_ends)
    ends = {0, len(text)}
    ends |= {_SPACES.match(text, e).end() for e in unit_ends}
    ends = sorted(ends)
    uncut = frozenset((a, b) for a, b in zip(ends, ends[1:]) if limit - overlap < b - a <= limit)  # these stay whole and get a shorter overlap
    places = np.array(sorted(marks), np.int64)
    whole = np.array(sorted(uncut), np.int64).reshape(-1, 2)
    at = np.searchsorted(whole[:, 0], places) - 1  # the last that begins before the place
    within = (at >= 0) & (places < whole[np.maximum(at, 0), 1]) if len(whole) else np.zeros(len(places), bool)
    cuts, strength = segments(text, {p: marks[p] for p in places[~within].tolist()}, limit - overlap, uncut)
    kept = merge(cuts, strength, limit - overlap)
    out = []
    for a, b in zip(kept, kept[1:]):
        start = a
        if a and overlap:
            low = max(0, a - min(overlap, limit - (b - a)))
            k = int(np.searchsorted(places, low))
            start = int(places[k]) if k < len(places) and places[k] < a else low
        out.append((start, a, b))
    return out


def split(items: DataFrame, model: MaxEnt, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each item that is longer than the limit.

    items: field_name, record_id, item_no, text, first_paragraph, last_paragraph (the last two may
    be null). Result: these keys, piece_no, start_pos, core_start, end_pos, text, the range of
    paragraphs that the piece touches, and forced (1 if the item has a sentence longer than the
    limit). Null and short texts have no row; repeated items count once.
    """
    schema = "field_name string, record_id string, item_no int, piece_no int, start_pos int, core_start int, end_pos int, text string, paragraph_range struct<start: int, end: int>, forced int"
    arrow = pa.schema([("field_name", pa.string()), ("record_id", pa.string()), ("item_no", pa.int32()), ("piece_no", pa.int32()), ("start_pos", pa.int32()), ("core_start", pa.int32()), ("end_pos", pa.int32()), ("text", pa.string()), ("paragraph_range", pa.struct([("start", pa.int32()), ("end", pa.int32())])), ("forced", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            row, start, end = sentences.units(*decode(batch.column("text")), model)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for k, item in enumerate(batch.to_pylist()):
                text, a, b = item["text"], at[k], at[k + 1]
                forced = int((end[a:b] - start[a:b] > limit).any())
                cut = pieces(text, end[a:b].tolist(), limit, overlap)
                for number, ((s, core, e), touched) in enumerate(zip(cut, ranges(text, cut, item["first_paragraph"], item["last_paragraph"]))):
                    out.append((item["field_name"], item["record_id"], item["item_no"], number, s, core, e, text[s:e], touched, forced))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    wanted = items.select("field_name", "record_id", "item_no", "text", "first_paragraph", "last_paragraph").where(F.char_length("text") > limit).distinct()
    return wanted.mapInArrow(run, schema)


def ranges(text: str, cut: list[tuple[int, int, int]], first: int | None, last: int | None) -> list[dict[str, int] | None]:
    """The paragraphs that each piece text[start:end] touches; paragraphs are separated by blank lines. A piece without words has the paragraph before it."""
    if first is None or last is None:
        return [None] * len(cut)
    words = np.array([m.span() for m in _WORDS.finditer(text)], np.int64).reshape(-1, 2)
    gaps = [text.count("\n", a, b) > 1 for a, b in zip(words[:-1, 1].tolist(), words[1:, 0].tolist())]
    number = np.concatenate([[0], np.cumsum(gaps)]) if len(words) else np.zeros(1, np.int64)
    out = []
    for s, _, e in cut:
        a = min(int(np.searchsorted(words[:, 1], s, "right")), max(len(words) - 1, 0))
        b = max(int(np.searchsorted(words[:, 0], e)) - 1, 0)
        if a > b:
            a = b
        out.append({"start": min(first + int(number[a]), last), "end": min(first + int(number[b]), last)})
    return out


def chunk_items(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.lit("chunk_text").alias("field_name"), F.col("chunk_id").alias("record_id"), F.lit(0).alias("item_no"), F.col("chunk_text").alias("text"), F.col("paragraph_range.start").alias("first_paragraph"), F.col("paragraph_range.end").alias("last_paragraph"))


def paragraph_items(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The entries of ``paragraphs`` longer than the limit; the others are not even unfolded."""

    def numbered(x: Column, i: Column) -> Column:
        return F.struct(i.cast("int").alias("item_no"), x.alias("text"))

    long = F.filter(F.transform("paragraphs", numbered), lambda s: F.char_length(s["text"]) > limit)
    return docs.select(F.lit("paragraphs").alias("field_name"), F.col("doc_id").alias("record_id"), F.inline(long)).select("*", F.col("item_no").alias("first_paragraph"), F.col("item_no").alias("last_paragraph"))
