"""Queries of the engine's own operators, over the whole tables of a folder, and the SQL they are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text, tokens
from millrace.operators import chunking, evidence, extraction, index, normalize, retrieval, session, units
from millrace.plans import response
from millrace.plans.ask import Engine
from millrace.session import shared_folder, spread, table
from millrace.sources import files, records


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk once."""
    return table(spark, folder, "kb_chunk").dropDuplicates(["chunk_id"])


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Each document once, the last state of it; of states of one time, or without any, the one that is greatest as a row."""
    rows = table(spark, folder, "source_document")
    when = F.coalesce("ingestion_time", F.lit("1970-01-01").cast("timestamp"))
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rows.columns), F.struct(when, "raw_text", "title", "parse_status")).alias("r")).select("r.*")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_item").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.with_terms(documents(spark, folder).where("text is not null"), "doc_id", F.col("text"))
    return rows.select(F.col("id").alias("doc_id"), F.col("length").alias("n_terms"), F.char_length(F.array_join("terms", "")).alias("term_chars"))


def _index(spark: SparkSession, folder: str, keep: bool = True) -> index.LexicalIndex:
    return index.build(documents(spark, folder), "doc_id", "text", keep)


def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).term_stats


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.summary(_index(spark, folder))


def _listed(values: str) -> Column:
    return F.array_join(F.array_sort(values), "|")


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"), _listed("match_terms").alias("match_terms"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.bm25(_index(spark, folder, keep=False), questions(spark, folder), 5))


def bm25_region_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    asked = questions(spark, folder).withColumn("region", F.lit(docs.agg(F.max(F.upper("region"))).first()[0]))
    return _scored(retrieval.bm25(_index(spark, folder, keep=False), asked, 5, docs.select(F.col("doc_id").alias("id"), "region")))


def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.tfidf(_index(spark, folder, keep=False), questions(spark, folder), 5))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", F.posexplode(text.sentences(F.col("chunk_text"))).alias("sentence_no", "sentence"))


def _evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pieces, asked = chunks(spark, folder), questions(spark, folder)
    hits = retrieval.bm25(index.build(pieces, "chunk_id", "chunk_text"), asked, 5)
    return asked, evidence.select(evidence.rank_sentences(asked, hits, pieces, 3), 3)


def evidence_select(spark: SparkSession, folder: str) -> DataFrame:
    chosen = _evidence(spark, folder)[1]
    numbers = [F.col(f"metadata.{c}").alias(c) for c in ("coverage", "overlap", "jaccard", "lexical_density", "generic_penalty", "retrieval_rank")]
    return chosen.select("query_id", "evidence_rank", "evidence_id", "chunk_id", "doc_id", "evidence_text", F.round("confidence", 6).alias("confidence"), "citation_text", *numbers, _listed("metadata.matched_terms").alias("matched_terms"))


def evidence_confidence(spark: SparkSession, folder: str) -> DataFrame:
    sure = evidence.confidence(*_evidence(spark, folder))
    return sure.withColumns({"reasons": F.array_join("reasons", "|"), "matched_terms": _listed("matched_terms")})


def headings(spark: SparkSession, folder: str) -> DataFrame:
    rows = sources(spark, folder).select("doc_id", F.posexplode("paragraphs").alias("para_no", "paragraph"))
    return rows.where(text.is_heading(F.col("paragraph"))).select("doc_id", "para_no", text.heading_title(F.col("paragraph")).alias("heading"))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sections(sources(spark, folder))


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    made = chunking.chunk(sources(spark, folder))
    return made.select("chunk_id", "doc_id", "region", "source_title", "chunk_text", "chunk_index", "section_title", F.col("paragraph_range.start").alias("first_paragraph"), F.col("paragraph_range.end").alias("last_paragraph"))


def segment_texts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).where("text is not null").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("para_no", "paragraph"))


def infer_titles(spark: SparkSession, folder: str) -> DataFrame:
    stem = F.concat(F.lit("document-"), F.col("doc_id"))
    return documents(spark, folder).where("text is not null").select("doc_id", text.title(text.paragraphs(F.col("text")), stem).alias("title"))


def parse_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a file of several types, parsed."""
    kinds = F.explode(F.array(*(F.lit(k) for k in ("txt", "md", "pdf", "image", "xls")))).alias("file_type")
    rows = documents(spark, folder).where("text is not null").select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("content"), kinds)
    name = F.concat(F.lit("file-"), F.col("key"))
    listed = rows.select(F.concat_ws("/", "file_type", "key").alias("doc_id"), F.lit("fj").alias("region"), name.alias("source_path"), name.alias("file_name"), "file_type", name.alias("stem"), "content")
    docs = files.parse(listed)
    return docs.select("doc_id", "file_type", "title", F.size("paragraphs").alias("n_paragraphs"), F.char_length(F.array_join("paragraphs", "")).alias("n_chars"), "parse_status", "text_quality_flag", "source_format_confidence", "needs_manual_review", "ocr_needed", F.col("parse_error").isNotNull().alias("has_error"), F.size("warnings").alias("n_warnings"))


def chunk_records(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks written as JSON lines and read again."""
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}.jsonl"
    records.write_json(records.kb_chunks(chunks(spark, folder)), path)
    rows = records.read_chunks(spark, path)
    return rows.select("chunk_id", "doc_id", "region", "source_title", "chunk_text", "chunk_index", "section_title", "page_no", F.col("paragraph_range.start").alias("first_paragraph"), F.col("paragraph_range.end").alias("last_paragraph"), F.element_at("metadata", F.lit("source_path")).alias("source_path"))


def kb_projection(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.kb_chunks(chunks(spark, folder).drop("source_path"))
    return rows.select("chunk_id", "doc_id", "region", "chunk_index", "source_path", F.col("paragraph_range.start").alias("first_paragraph"), F.col("paragraph_range.end").alias("last_paragraph"))


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "manifest_record").select("source_path").where("source_path is not null").distinct()
    listed = paths.select(F.col("source_path").alias("path"), F.regexp_replace("source_path", "^/data/raw/", "").alias("relative"), F.lit(0).alias("length"), F.col("source_path").cast("binary").alias("content"))
    return files.manifest(listed).select("source_path", "file_name", "region", "file_type", "doc_id", "checksum")


def manifest_backfill(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "manifest_record").select("doc_id", "file_type", "file_size_bytes").distinct()
    return files.with_results(listed, sources(spark, folder)).drop("ingestion_time")


def report_counters(spark: SparkSession, folder: str) -> DataFrame:
    return files.report(sources(spark, folder), chunks(spark, folder))


def extract_parameters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "selected_evidence").select("evidence_id", "evidence_text").distinct()
    out = extraction.extract(rows)
    lists = [F.array_join(c, "|").alias(c) for c in ("target_entities", "usage_restrictions", "repayment_constraints")]
    return out.select("evidence_id", "interest_rate", "subsidy_rate", F.round("effective_rate", 6).alias("effective_rate"), "loan_term_months", "loan_amount_upper_limit", "collateral_required", "guarantee_required", *lists)


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each region's documents as the turns of a session."""
    return documents(spark, folder).where("text is not null").select(F.coalesce("region", F.lit("")).alias("session_id"), F.col("doc_id").alias("turn"), F.col("text").alias("query"))


def session_carried(spark: SparkSession, folder: str) -> DataFrame:
    return session.carried(session.turn_slots(_turns(spark, folder), evidence=None)).drop("query", "normalized_query")


def session_latest(spark: SparkSession, folder: str) -> DataFrame:
    return session.latest(session.turn_slots(_turns(spark, folder), evidence=None)).drop("normalized_query")


def session_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The slots of each document with its title as its evidence."""
    turns = documents(spark, folder).select(F.col("doc_id").alias("session_id"), F.lit(1).alias("turn"), F.col("text").alias("query"), F.array(F.coalesce("title", F.lit(" ")), F.lit(" ")).alias("evidence"))
    return session.turn_slots(turns).drop("query", "evidence", "normalized_query", "turn").withColumnRenamed("session_id", "doc_id")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    chosen = table(spark, folder, "selected_evidence").distinct()
    return response.citations(chosen, chunks(spark, folder)).select("evidence_id", "chunk_id", "doc_id", "source", "section", "citation_text", "quote", "confidence")


def normalize_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The questions as they are, and each with colloquial words before it."""
    plain = questions(spark, folder)
    spoken = plain.select((-F.col("query_id") - 1).alias("query_id"), F.concat(F.lit("我想借点钱买化肥，去年还有一点没还完；现在想续一下贷款 abc 吗？"), "query").alias("query"))
    rows = normalize.normalize_queries(plain.union(spoken))
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(",", h["alias"], h["canonical_term"], h["category"], h["start"].cast("string"), h["end"].cast("string"))), "|")
    return rows.select("query_id", "normalized_query", F.array_join("detected_terms", "|").alias("detected_terms"), "search_text", hits.alias("hits"))


def ask(spark: SparkSession, folder: str) -> DataFrame:
    """The answers, flat."""
    rows = Engine(chunks(spark, folder)).ask_many(questions(spark, folder))
    first = F.col("citations")[0]
    numbers = [F.col(f"parameters.{c}").alias(c) for c in ("interest_rate", "subsidy_rate", "loan_term_months", "loan_amount_upper_limit", "collateral_required", "guarantee_required")]
    lists = [F.array_join(f"parameters.{c}", "|").alias(c) for c in ("target_entities", "usage_restrictions", "repayment_constraints")]
    return rows.select(
        "query_id", "normalized_query", "scenario", F.size(F.coalesce("citations", F.array())).alias("n_citations"), *(first[c].alias(c) for c in ("evidence_id", "source", "section", "citation_text", "quote")),
        F.col("uncertainty.score").alias("confidence"), F.col("uncertainty.label").alias("label"), F.array_join("uncertainty.reasons", "|").alias("reasons"), F.array_join("uncertainty.missing_parameters", "|").alias("missing_parameters"), *numbers, *lists,
    )


def _quantities(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return units.common_quantities(table(spark, folder, "kb_chunk"), table(spark, folder, "extracted_parameters"), table(spark, folder, "selected_evidence"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    texts, recorded = _quantities(spark, folder)
    names = F.when(F.col("quantity") == "amount", "loan_amount_upper_limit").otherwise("loan_term_months")
    held = F.col("stated_value").isNotNull() | ((F.col("route") == "converted") & F.col("spoken"))
    rows = recorded.where(held).select(names.alias("field_name"), F.col("evidence_id").alias("record_id"), "quantity", "common_value")
    return texts.unionByName(rows).distinct()


def p2_converted(spark: SparkSession, folder: str) -> DataFrame:
    return _quantities(spark, folder)[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_documents, term_stats, corpus_stats, bm25_topk, bm25_region_topk, tfidf_topk, sentence_split, evidence_select, evidence_confidence, headings, sections, chunk_documents, segment_texts, infer_titles, parse_files, chunk_records, kb_projection, document_ids, manifest_backfill, report_counters, extract_parameters, session_carried, session_latest, session_evidence, citations, normalize_questions, ask,
        p2_found, p2_converted,
    )
}


def sql() -> dict[str, str]:
    """The same results in SQL, by query."""
    from millrace.oracles import SQL

    return SQL
