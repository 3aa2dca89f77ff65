"""Files to manifest and documents: scan, identity, parsers by file type, report."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text

#: File types by suffix, regions by folder name, confidences and thresholds.
SUFFIXES = {".doc": "doc", ".docx": "docx", ".pdf": "pdf", ".txt": "txt", ".html": "html", ".htm": "html", ".md": "md", ".xls": "xls", ".xlsx": "xlsx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image"}
REGIONS = {"adbc": "adbc", "fj": "fj", "北京农户信贷31": "北京", "北京": "北京", "beijing": "北京", "fujian": "fj"}
PDF_TEXT = rb"\(([^()]*)\)"
PDF_LEAST_CHARS, PDF_LEAST_PARAGRAPHS = 80, 2
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING, PICTURE = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/picture}"
TITLE_STYLES = ("title", "subtitle", "heading")
DOCX_HEADING = re.compile(r"^[第（一二三四五六七八九十0-9IVXivx]+[章节条部分篇]\s*|^[一二三四五六七八九十]+、")

Parsed = tuple[str, str, list[str], dict]
#: A parser takes (content, stem) and gives (title, raw_text, paragraphs, diagnostics).
Parser = Callable[[bytes, str], Parsed]


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, relative (to root), length, content of every file. The content is only read where a later step uses it.

    The reader leaves out files without a byte; they are added from the listing that it holds anyway.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = root.rstrip("/").removeprefix("file:")
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    rows = found.select(bare(F.col("path")).alias("path"), "length", "content")
    listed = spark.createDataFrame([(unquote(p),) for p in found.inputFiles()], "path string").select(bare(F.col("path")).alias("path"))
    empty = listed.join(rows.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    return rows.unionByName(empty).withColumn("relative", F.expr(f"substring(path, {len(base) + 2})"))


def file_type(path: Column) -> Column:
    """The type that the suffix names, or unknown."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv)), suffix), F.lit("unknown"))


def region(relative: Column, path: Column) -> Column:
    """By the first part of the path, from the root down, then of the whole path, that names one."""
    parts = F.concat(F.split(relative, "/"), F.split(path, "/"))
    names = F.create_map(*(F.lit(x) for kv in REGIONS.items() for x in kv))

    def of(part: Column) -> Column:
        p = F.trim(part)
        return F.coalesce(F.element_at(names, p), F.element_at(names, F.lower(p)), F.when(p.contains("北京"), "北京").when(p.startswith("福建"), "fj"))

    return F.coalesce(F.get(F.filter(F.transform(parts, of), lambda r: r.isNotNull()), 0), F.lit("unknown"))


def manifest(files: DataFrame) -> DataFrame:
    """One row per file of a known type, with id, checksum and size; the content stays for the parsers."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    own = region(F.col("relative"), F.col("path"))
    rows = files.withColumns({"file_type": file_type(F.col("path")), "file_name": name, "stem": stem, "region": own}).where("file_type <> 'unknown'")
    doc_id = F.concat_ws(":", "region", F.replace("stem", F.lit(" "), F.lit("_")), F.substring(F.sha1("relative"), 1, 10))
    return rows.select(doc_id.alias("doc_id"), "region", F.col("path").alias("source_path"), "file_name", "file_type", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("checksum"), F.current_timestamp().alias("discovered_time"), "stem", "content")


def skipped(files: DataFrame) -> DataFrame:
    return files.where(file_type(F.col("path")) == "unknown").select("path")


def _told(status: str, flag: str, confidence: float, error: str | None = None, review: bool = False, ocr: bool = False, warnings: list[str] | None = None, parser: str = "") -> dict:
    return {"parse_status": status, "text_quality_flag": flag, "source_format_confidence": confidence, "parse_error": error, "needs_manual_review": review, "ocr_needed": ocr, "warnings": warnings if warnings is not None else ([error] if error else []), "parser_name": parser}


def parse_docx(content: bytes, stem: str) -> Parsed:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, OSError, ValueError) as e:
        reason = "the archive has no main document part" if isinstance(e, KeyError) else e
        return stem, "", [], _told("failed", "needs_review", 0.0, f"The docx file cannot be read: {reason}", True, parser="docx_parser")
    found = []
    for p in root.iter(f"{WORD}p"):
        lines = "".join(t.text or "" for t in p.iter(f"{WORD}t")).splitlines()
        body = "\n".join(x for x in map(str.strip, lines) if x)
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        if body:
            found.append((body, (style.get(f"{WORD}val") or "").lower() if style is not None else ""))
    if not found:
        seen = any(next(root.iter(tag), None) is not None for tag in (f"{WORD}drawing", f"{DRAWING}blip", f"{WORD}object", f"{PICTURE}pic"))
        error = "The docx file holds pictures or objects, but no text." if seen else "The docx file holds no paragraph with text."
        return stem, "", [], _told("partial", "empty", 0.35 if seen else 0.15, error, True, seen, parser="docx_parser")

    def titled(entry: tuple[str, str], most: int) -> bool:
        body, style = entry
        if any(k in style for k in TITLE_STYLES):
            return True
        if len(body) > most or body[-1] in text.TITLE_TRAILING or "\n" in body:
            return False
        return bool(DOCX_HEADING.match(body)) or not any(c in body for c in "。；;？!！")

    title = found[0][0] if titled(found[0], 120) else next((e[0] for e in found if titled(e, 80)), found[0][0])
    paragraphs = [body for body, _ in found]
    return title, "\n".join(paragraphs), paragraphs, _told("success", "clean", 0.95, parser="docx_parser")


def parse_pdf(content: bytes, stem: str) -> Parsed:
    pieces = (m.replace(rb"\\n", b" ").replace(rb"\\r", b" ").replace(rb"\\t", b" ").decode("utf-8", "ignore") for m in re.findall(PDF_TEXT, content))
    paragraphs = list(dict.fromkeys(p for p in (" ".join(x.split()) for x in pieces) if len(p) > 1))
    raw = "\n".join(paragraphs)
    if not raw:
        told = _told("failed", "empty", 0.0, "No text was found in the pdf file; it needs OCR.", True, True, parser="pdf_parser")
    elif len(raw) < PDF_LEAST_CHARS or len(paragraphs) < PDF_LEAST_PARAGRAPHS:
        told = _told("partial", "low_confidence", 0.35, "Little text was found in the pdf file; it should be looked at or go through OCR.", True, True, parser="pdf_parser")
    else:
        told = _told("success", "low_confidence", 0.65, warnings=["Reading order and layout of the pdf file are not kept."], parser="pdf_parser")
    return stem, raw, paragraphs, told


def parse_image(content: bytes, stem: str) -> Parsed:
    error = "Image text needs OCR."
    return stem, "", [], _told("skipped", "needs_review", 0.0, error, True, True, parser="image_parser")


#: Parsers of binary formats; text, markdown and html need none, as their text is segmented by column expressions. Others may be added.
PARSERS: dict[str, Parser] = {"docx": parse_docx, "pdf": parse_pdf, "image": parse_image}
PLAIN = {"txt": (0.92, False), "html": (0.92, False), "md": (0.90, True)}


def parse(records: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """A document per manifest row. A file that cannot be parsed becomes a failed document; no file ends the run."""
    own = dict(PARSERS if parsers is None else parsers)
    schema = "doc_id string, region string, source_path string, file_name string, file_type string, stem string, title string, raw_text string, paragraphs array<string>, parse_status string, parse_error string, source_format_confidence double, text_quality_flag string, needs_manual_review boolean, ocr_needed boolean, warnings array<string>, parser_name string"
    told_names = ("parse_status", "parse_error", "source_format_confidence", "text_quality_flag", "needs_manual_review", "ocr_needed", "warnings", "parser_name")
    types = [pa.string()] * 8 + [pa.list_(pa.string()), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string()]

    def one(kind: str, content: bytes | None, stem: str) -> Parsed:
        try:
            if kind in own:
                return own[kind](content or b"", stem)
            if kind in PLAIN:
                return "", (content or b"").decode("utf-8", "ignore"), [], _told("", "", 0.0, parser=f"{'md' if kind == 'md' else 'txt'}_parser")
            error = f"Files of type {kind} have no parser."
        except Exception as e:  # noqa: BLE001 - one bad file must not end the run
            error = f"The parser stopped: {e}"
        return stem, "", [], _told("failed", "needs_review", 0.0, error, True, kind in ("pdf", "image"), parser="unavailable_parser")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                title, raw, paragraphs, told = one(r["file_type"], r["content"], r["stem"])
                rows.append((*(r[c] for c in ("doc_id", "region", "source_path", "file_name", "file_type", "stem")), title, raw, paragraphs, *(told[n] for n in told_names)))
            columns = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in re.sub("<[^>]*>", "", schema).split(", ")])

    rows = records.select("doc_id", "region", "source_path", "file_name", "file_type", "stem", "content").mapInArrow(run, schema)
    plain = F.col("parse_status") == ""
    markdown = F.col("file_type") == "md"
    found = F.when(plain, text.paragraphs(F.col("raw_text"), markdown)).otherwise(F.col("paragraphs"))
    rows = rows.withColumn("paragraphs", found)
    filled = text.trimmed(F.col("raw_text")) != ""
    sure = F.when(F.col("file_type") == "md", 0.90).otherwise(0.92)
    empty = F.lit("The file has no text.")
    return rows.withColumns(
        {
            "title": F.when(plain, text.title(F.col("paragraphs"), F.col("stem"))).otherwise(F.col("title")),
            "source_format_confidence": F.when(plain, F.when(filled, sure).otherwise(0.25)).otherwise(F.col("source_format_confidence")),
            "text_quality_flag": F.when(plain, F.when(filled, "clean").otherwise("empty")).otherwise(F.col("text_quality_flag")),
            "needs_manual_review": F.when(plain, ~filled).otherwise(F.col("needs_manual_review")),
            "parse_error": F.when(plain & ~filled, empty).otherwise(F.col("parse_error")),
            "warnings": F.when(plain & ~filled, F.array(empty)).otherwise(F.col("warnings")),
            "parse_status": F.when(plain, F.when(filled, "success").otherwise("partial")).otherwise(F.col("parse_status")),
            "ingestion_time": F.current_timestamp(),
        }
    ).drop("stem")


def with_results(records: DataFrame, docs: DataFrame) -> DataFrame:
    """The manifest with each file's outcome."""
    return records.drop("content", "stem").join(docs.select("doc_id", "parse_status", "parse_error", "needs_manual_review", "ingestion_time"), "doc_id", "left")


def report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counters. Skipped files count as failed."""
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    status = F.col("parse_status")
    totals = docs.agg(F.count("*").alias("total_files"), count(status == "success").alias("parsed_successfully"), count(status == "partial").alias("parsed_partially"), count(~status.isin("success", "partial")).alias("parse_failed"), count(F.col("ocr_needed")).alias("ocr_required"), count(F.col("needs_manual_review")).alias("manual_review_required"))
    return totals.withColumn("chunks_created", F.lit(chunks.count()))


def report_errors(docs: DataFrame) -> DataFrame:
    """source_path and error, a row for each error and each warning, as a table, since its length is not bounded. A warning that repeats the error is a row of its own."""
    own = F.array_compact(F.array(F.nullif("parse_error", F.lit(""))))
    return docs.select("source_path", F.explode(F.concat(own, F.filter("warnings", lambda w: w != ""))).alias("error"))
