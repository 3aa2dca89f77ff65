"""Documents to sections and traceable chunks.

A document is one row with an array of paragraphs, so sectioning and packing work on that array
inside the row: nothing is shuffled, whatever the number of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text


@dataclass(frozen=True)
class ChunkSizes:
    """Characters: shorter chunks are merged, a chunk is closed from ``target`` on, and ``most`` is not exceeded by joining."""

    least: int = 120
    target: int = 360
    most: int = 800

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("sizes must satisfy 0 < least <= target <= most")

    @classmethod
    def of(cls, size: int = 800, overlap: int = 100) -> ChunkSizes:
        """From a size and an overlap; the overlap only lowers the target, chunks do not share text."""
        if overlap >= size:
            raise ValueError("the overlap must be smaller than the size")
        target = max(120, min(size, max(160, size - max(40, overlap))))
        return cls(max(80, min(target, target // 3)), target, size)


def located(paragraphs: Column, raw: Column) -> Column:
    """Non-blank paragraphs, trimmed, with their place in the original list; without paragraphs those of the raw text."""
    split = F.filter(F.transform(F.split(raw, "\n\n"), text.trimmed), lambda p: p != "")
    source = F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.coalesce(split, F.array().cast("array<string>")))
    numbered = F.transform(source, lambda p, i: F.struct(i.cast("int").alias("at"), text.trimmed(F.coalesce(p, F.lit(""))).alias("text")))
    return F.filter(numbered, lambda p: p["text"] != "")


def sectioned(items: Column) -> Column:
    """Each paragraph with its section: the section's number, title, heading place (counted among the non-blank paragraphs) and whether the paragraph is the heading. What precedes the first heading is section 0 without title."""
    marked = F.transform(items, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text"), text.is_heading(x["text"]).alias("head")))
    blank = F.struct(F.array().cast("array<struct<at: int, text: string, no: int, section: int, title: string, heading: int>>").alias("done"), F.lit(0).alias("section"), F.lit(None).cast("string").alias("title"), F.lit(-1).alias("heading"))

    def step(s: Column, x: Column) -> Column:
        no = F.size(s["done"])
        section = F.when(x["head"], s["section"] + 1).otherwise(s["section"])
        title = F.when(x["head"], text.heading_title(x["text"])).otherwise(s["title"])
        heading = F.when(x["head"], no).otherwise(s["heading"])
        row = F.struct(x["at"].alias("at"), x["text"].alias("text"), no.alias("no"), section.alias("section"), title.alias("title"), heading.alias("heading"))
        return F.struct(F.array_append(s["done"], row).alias("done"), section.alias("section"), title.alias("title"), heading.alias("heading"))

    return F.aggregate(marked, blank, step, lambda s: s["done"])


def sections(docs: DataFrame) -> DataFrame:
    """One row per section: doc_id, section_no, title, start_paragraph, end_paragraph, heading_paragraph (null for a preamble), counted among the non-blank paragraphs."""
    rows = docs.select("doc_id", F.inline(sectioned(located(F.col("paragraphs"), F.col("raw_text")))))
    found = rows.groupBy("doc_id", "section").agg(F.first("title").alias("title"), F.min("no").alias("start_paragraph"), F.max("no").alias("end_paragraph"), F.max("heading").alias("heading"))
    return found.select("doc_id", F.col("section").alias("section_no"), "title", "start_paragraph", "end_paragraph", F.when(F.col("heading") >= 0, F.col("heading")).alias("heading_paragraph"))


Seed = tuple[str, int, int, int, str | None]
"""Text, first and last paragraph, section, title."""


def _joined(a: Seed, b: Seed, between: str = "\n\n") -> Seed:
    return f"{a[0]}{between}{b[0]}", a[1], b[2], a[3], a[4]


def _packed(parts: list[Seed], sizes: ChunkSizes, between: str, closes: int | None) -> list[Seed]:
    """Neighbours of one section joined while they fit; from ``closes`` characters on nothing is added."""
    out: list[Seed] = []
    shut = True
    for part in parts:
        fits = not shut and out[-1][3] == part[3] and len(out[-1][0]) + len(between) + len(part[0]) <= sizes.most
        if fits:
            out[-1] = _joined(out[-1], part, between)
        else:
            out.append(part)
        shut = closes is not None and len(out[-1][0]) >= closes
    return out


def _merged(seeds: list[Seed], sizes: ChunkSizes) -> list[Seed]:
    """Short seeds joined with the next one of their section; a short last one of a section with the one before."""
    out: list[Seed] = []

    def fit(a: Seed, b: Seed) -> bool:
        return a[3] == b[3] and len(a[0]) + 2 + len(b[0]) <= sizes.most

    for k, seed in enumerate(seeds):
        if out and len(out[-1][0]) < sizes.least and fit(out[-1], seed):
            out[-1] = _joined(out[-1], seed)
        else:
            out.append(seed)
        last_of_section = k + 1 == len(seeds) or seeds[k + 1][3] != seed[3]
        if last_of_section and len(out) > 1 and len(out[-1][0]) < sizes.least and fit(out[-2], out[-1]):
            out[-2:] = [_joined(*out[-2:])]
    return out


def _whole_sentences(seed: Seed, sizes: ChunkSizes) -> list[Seed]:
    """A paragraph above the limit as runs of whole sentences; one sentence above the limit stays whole."""
    parts = [p for p in map(str.strip, re.split(text.SENTENCE_END, seed[0])) if p]
    if len(parts) < 2:
        return [seed]
    return _merged(_packed([(p, *seed[1:]) for p in parts], sizes, "", None), sizes)


def pack(items: list[dict], sizes: ChunkSizes) -> list[Seed]:
    """The chunks of one document's sectioned paragraphs."""
    members = Counter(x["section"] for x in items)
    # a heading that is its section's plain title is not repeated in the text of a section with more in it
    body = [x for x in items if not (x["no"] == x["heading"] == x["at"] and x["text"] == x["title"] and members[x["section"]] > 1)]
    seeds: list[Seed] = []
    for long, run in groupby(((x["text"], x["at"], x["at"], x["section"], x["title"]) for x in body), lambda s: len(s[0]) > sizes.most):
        if long:
            seeds += [piece for s in run for piece in _whole_sentences(s, sizes)]
        else:
            seeds += _packed(list(run), sizes, "\n\n", sizes.target)
    return _merged(seeds, sizes)


def _pack_column(sizes: ChunkSizes):
    """Packing carries a state from paragraph to paragraph; as nested folds it takes thirty times as long as in Arrow batches."""
    kind = "array<struct<text: string, first: int, last: int, section: int, title: string>>"

    @F.pandas_udf(kind)
    def packed(items: pd.Series) -> pd.Series:
        names = ("text", "first", "last", "section", "title")
        return items.map(lambda xs: [dict(zip(names, s)) for s in pack(list(xs), sizes)])

    return packed


def chunk(docs: DataFrame, sizes: ChunkSizes | None = None) -> DataFrame:
    """Chunks of all documents that were not failed to parse, with ids, ranges and metadata. Null and empty texts give no chunk."""
    sizes = sizes or ChunkSizes.of()
    kept = docs.where(F.coalesce("parse_status", F.lit("")) != "failed")
    rows = kept.withColumn("__items", sectioned(located(F.col("paragraphs"), F.col("raw_text")))).where(F.size("__items") > 0)
    rows = rows.withColumn("__chunks", _pack_column(sizes)(F.col("__items")))
    rows = rows.select("doc_id", "region", "title", "file_name", "source_path", "parse_status", F.posexplode("__chunks").alias("chunk_index", "c"))
    return rows.select(
        F.concat_ws(":", "doc_id", F.lit("chunk"), "chunk_index", F.substring(F.sha1(F.col("c.text")), 1, 10)).alias("chunk_id"),
        "doc_id",
        "region",
        F.coalesce(F.nullif("title", F.lit("")), "file_name").alias("source_title"),
        F.col("c.text").alias("chunk_text"),
        "chunk_index",
        F.col("c.title").alias("section_title"),
        F.lit(None).cast("int").alias("page_no"),
        F.struct(F.col("c.first").alias("start"), F.col("c.last").alias("end")).alias("paragraph_range"),
        F.create_map(F.lit("source_path"), "source_path", F.lit("file_name"), "file_name", F.lit("parse_status"), "parse_status", F.lit("doc_id"), "doc_id").alias("metadata"),
    )
