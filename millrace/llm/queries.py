"""Queries of the training-data operators, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import encodings, leaks, lookalikes, mixing, neardup, quality, sentences, splitting
from millrace.llm.oracles import SQL  # noqa: F401 - the same in SQL, read by the entry point
from millrace.session import table

#: White space, as a pattern.
WHITE = r"(?U)[\s\x1C-\x1F\x85]+"
#: The dictionary of common words is held by every task.
MOST_WORDS = 100_000


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "kb_chunk"), "chunk_id", "chunk_text")


def p1_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Of each chunk the number of its visible characters and their hash, from its sentence units put together: no unit lacks, doubles or moves any."""
    chunks = table(spark, folder, "kb_chunk").dropDuplicates(["chunk_id"])
    spans = sentences.with_units(chunks, "chunk_text", sentences.train(chunks, "chunk_id", "chunk_text"), ["chunk_id", "chunk_text"])
    unit = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.substring(F.col("chunk_text"), s["starts"] + 1, s["ends"] - s["starts"]))
    joined = spans.select("chunk_id", F.regexp_replace(F.array_join(unit, ""), WHITE, "").alias("t"))
    return joined.select("chunk_id", F.char_length("t").alias("visible"), F.md5("t").alias("hash"))


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of each entry of ``paragraphs``."""
    docs = table(spark, folder, "source_document")
    model = sentences.train(docs.select("doc_id", F.array_join("paragraphs", "\n\n").alias("text")), "doc_id", "text")
    entries = docs.select("doc_id", F.posexplode("paragraphs").alias("para_no", "paragraph"))
    units = sentences.with_units(entries, "paragraph", model, ["doc_id", "para_no"]).distinct()
    return units.select("doc_id", "para_no", F.inline(F.arrays_zip("starts", "ends"))).withColumnsRenamed({"starts": "start_pos", "ends": "end_pos"})


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encodings.garbled_paragraphs(table(spark, folder, "source_document"), "doc_id", "paragraphs")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_restored(spark, folder).select("doc_id", "para_no").distinct()


def p3_raw_text(spark: SparkSession, folder: str) -> DataFrame:
    """The whole texts with garbled passages, restored."""
    docs = table(spark, folder, "source_document")
    return encodings.restored_texts(docs, "doc_id", "raw_text", encodings.train(docs, "doc_id", "paragraphs"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "kb_chunk")
    items = splitting.chunk_items(chunks).unionByName(splitting.paragraph_items(table(spark, folder, "source_document")))
    return splitting.split(items, sentences.train(chunks, "chunk_id", "chunk_text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pieces(spark, folder).select("field_name", "record_id", "item_no", "forced").distinct()


def p4_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Of each oversized item its length and hash, from the cores of its pieces put together, and whether all pieces and overlaps keep their limits."""
    core = F.struct("piece_no", F.expr("substring(text, core_start - start_pos + 1)").alias("core"))
    fits = (F.char_length("text") <= splitting.LIMIT) & (F.col("core_start") - F.col("start_pos") <= splitting.OVERLAP)
    items = p4_pieces(spark, folder).groupBy("field_name", "record_id", "item_no").agg(F.array_sort(F.collect_list(core)).alias("cores"), F.bool_and(fits).alias("fits"))  # the pieces of one item
    joined = items.withColumn("t", F.array_join(F.transform("cores", lambda c: c["core"]), ""))
    return joined.select("field_name", "record_id", "item_no", F.char_length("t").alias("n_chars"), F.md5("t").alias("hash"), "fits")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        neardup.near_duplicates(table(spark, folder, name), key, text).select(F.lit(text).alias("field_name"), "id_a", "id_b")
        for name, key, text in (("source_document", "doc_id", "raw_text"), ("kb_chunk", "chunk_id", "chunk_text"))
    ]
    return parts[0].unionByName(parts[1])


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its class of equal texts, its connected group and its links."""
    parts = [
        neardup.duplicate_groups(table(spark, folder, name), key, text).select(F.lit(text).alias("field_name"), F.col("id").alias("record_id"), "class_id", "group_id", "copies", "links")
        for name, key, text in (("source_document", "doc_id", "raw_text"), ("kb_chunk", "chunk_id", "chunk_text"))
    ]
    return parts[0].unionByName(parts[1])


def p6_one_form(spark: SparkSession, folder: str) -> DataFrame:
    """Every title and chunk text in its one form. Repeated rows count once."""
    parts = [
        lookalikes.one_form(table(spark, folder, name), text, [key]).select(F.lit(text).alias("field_name"), F.col(key).alias("record_id"), "text", "changed")
        for name, key, text in (("source_document", "doc_id", "title"), ("kb_chunk", "chunk_id", "chunk_text"))
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        lookalikes.one_form(table(spark, folder, name), text, [key]).where("changed").select(F.lit(text).alias("field_name"), F.col(key).alias("record_id"))
        for name, key, text in (("source_document", "doc_id", "title"), ("kb_chunk", "chunk_id", "chunk_text"))
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"), schedules=mixing.tilted)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"), schedules=mixing.tilted)[1]


def p8_bands(spark: SparkSession, folder: str) -> DataFrame:
    """What each source gives in each tenth of training."""
    return mixing.bands(p8_mixture(spark, folder))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    words = [r[0] for r in table(spark, folder, "common_word").select("word").distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} common words")
    return quality.statistics(table(spark, folder, "documents"), "doc_id", "text", words)


def p9_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts that SQL can check."""
    return p9_statistics(spark, folder).select("doc_id", "chars", "visible", "han", "lines", "repeated_lines", "grams", "repeated_grams")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_statistics(spark, folder).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p1_round_trip": p1_round_trip,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p3_raw_text": p3_raw_text,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_round_trip": p4_round_trip,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_one_form": p6_one_form,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_bands": p8_bands,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
    "p9_counts": p9_counts,
}
