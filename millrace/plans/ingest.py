"""Files to manifest, documents, chunks and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import chunking
from millrace.sources import files, records


@dataclass
class Ingested:
    manifest: DataFrame
    documents: DataFrame
    chunks: DataFrame
    report: DataFrame


def ingest(spark: SparkSession, root: str, output: str, recursive: bool = True, size: int = 800, overlap: int = 100, parsers: dict[str, files.Parser] | None = None) -> Ingested:
    """All files under ``root`` to tables under ``output``: manifest, documents, chunks, kb_chunks (Parquet and JSON lines), report and errors. Documents and chunks are written once and read back, so no file is parsed twice. Everything is staged first and then takes the place of what was there."""
    final, output = output, f"{output}/_staged"
    listed = files.manifest(files.scan(spark, root, recursive))
    files.parse(listed, parsers).write.mode("overwrite").parquet(f"{output}/documents")
    documents = spark.read.parquet(f"{output}/documents")
    chunking.chunk(documents, chunking.ChunkSizes.of(size, overlap)).write.mode("overwrite").parquet(f"{output}/chunks")
    chunks = spark.read.parquet(f"{output}/chunks")
    files.with_results(listed, documents).write.mode("overwrite").parquet(f"{output}/manifest")
    records.write_json(records.kb_chunks(chunks), f"{output}/kb_chunks.jsonl")
    files.report_errors(documents).write.mode("overwrite").json(f"{output}/errors")
    files.report(documents, chunks).write.mode("overwrite").json(f"{output}/report")
    promote(spark, output, final)
    read = spark.read
    return Ingested(read.parquet(f"{final}/manifest"), read.parquet(f"{final}/documents"), read.parquet(f"{final}/chunks"), read.json(f"{final}/report"))


def promote(spark: SparkSession, staged: str, final: str) -> None:
    """Each artifact of the staged folder renamed into the final one, in place of an older one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path(staged)):
        target = path(final, status.getPath().getName())
        files.delete(target, True)
        if not files.rename(status.getPath(), target):
            raise OSError(f"{status.getPath()} cannot be renamed to {target}")
    files.delete(path(staged), True)
