"""Chunk records in JSON lines, in and out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The artifacts that are looked for, in order, and the fields folded into the metadata.
ARTIFACTS = ("chunks/kb_chunks.jsonl", "chunks/chunks.jsonl", "kb_chunks.jsonl", "chunks.jsonl")
FOLDED = ("source_path", "source_type", "policy_type", "effective_date", "tags", "econ_metadata")
_SCHEMA = "chunk_id string, doc_id string, document_id string, region string, source_title string, title string, chunk_text string, text string, content string, chunk_index int, `index` int, section_title string, section string, page_no int, paragraph_range array<int>, metadata map<string, string>, " + ", ".join(f"{f} string" for f in FOLDED)


def resolve(folder: str, path: str | None = None) -> str:
    """The file to read: the named one, or the first artifact that is not empty, or the first that exists."""
    if path is not None:
        full = path if os.path.isabs(path) else os.path.join(folder, path)
        if not os.path.exists(full):
            raise FileNotFoundError(full)
        return full
    there = [p for p in (os.path.join(folder, a) for a in ARTIFACTS) if os.path.exists(p)]
    filled = [p for p in there if os.path.isdir(p) or os.path.getsize(p) > 0]
    if not there:
        raise FileNotFoundError(f"no chunk records under {folder}")
    return (filled or there)[0]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records with their alternative field names unified; of the names of a field the first that is not empty counts. A line that is not JSON, or has no chunk_id, ends the read with an error."""
    raw = spark.read.schema(_SCHEMA).option("mode", "FAILFAST").json(path)
    some = lambda *names: F.coalesce(*(F.nullif(F.col(f"`{n}`") if isinstance(n, str) else n, F.lit("")) for n in names))
    number = lambda *names: F.coalesce(*(F.nullif(F.col(f"`{n}`"), F.lit(0)) for n in names), F.lit(0))
    known = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    more = F.map_filter(F.create_map(*(x for f in FOLDED for x in (F.lit(f), F.col(f)))), lambda k, v: v.isNotNull() & ~F.map_contains_key(known, k))
    merged = F.map_concat(known, more)
    sure: Column = F.when(F.col("chunk_id").isNull(), F.raise_error(F.lit(f"a chunk record without chunk_id in {path}"))).otherwise(F.col("chunk_id"))
    return raw.select(
        sure.alias("chunk_id"),
        some("doc_id", "document_id", "chunk_id").alias("doc_id"),
        F.coalesce(some("region", F.element_at(known, F.lit("region"))), F.lit("")).alias("region"),
        F.coalesce(some("source_title", "title"), F.lit("")).alias("source_title"),
        F.coalesce(some("chunk_text", "text", "content"), F.lit("")).alias("chunk_text"),
        number("chunk_index", "index").alias("chunk_index"),
        some("section_title", "section").alias("section_title"),
        "page_no",
        F.when(F.size("paragraph_range") == 2, F.struct(F.get("paragraph_range", 0).alias("start"), F.get("paragraph_range", 1).alias("end"))).alias("paragraph_range"),
        merged.alias("metadata"),
    )


def kb_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk records with the source path beside the metadata."""
    return chunks.withColumn("source_path", F.element_at("metadata", F.lit("source_path")))


def write_json(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """JSON lines; ``files`` asks for that many files instead of one per partition. mode append adds rows. A paragraph_range is written as its two numbers."""
    if "paragraph_range" in df.columns and isinstance(df.schema["paragraph_range"].dataType, T.StructType):
        both = F.array("paragraph_range.start", "paragraph_range.end")
        df = df.withColumn("paragraph_range", F.when(F.col("paragraph_range").isNotNull(), both))
    (df.coalesce(files) if files else df).write.mode(mode).option("ignoreNullFields", "false").json(path)
