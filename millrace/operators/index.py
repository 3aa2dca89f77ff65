"""The lexical index: texts with their terms, postings, term and corpus statistics as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import tokens


@dataclass
class LexicalIndex:
    """texts (id, length, terms), postings (term, id, length), term_stats (term, df) and a one-row corpus (n, avgdl).

    Terms of a text are distinct, so each posting has frequency 1 and a text's length is its number
    of distinct terms. Texts without a term count in n and in the average.
    """

    texts: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    #: Whether the tables lie in files, so that statistics are read and not made.
    stored: bool = False
    #: Makes the same index of some terms only, where its texts are not kept.
    of_terms: Callable[[list[str]], LexicalIndex] | None = None

    def narrowed(self, terms: DataFrame) -> LexicalIndex:
        """For the search of these terms: lengths and statistics are those of the whole texts, but only these terms are in the tables."""
        if self.of_terms is None:
            return self
        return self.of_terms([r[0] for r in terms.select("term").distinct().collect()])

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term, df of these distinct terms. Where nothing is stored only their own postings are counted, not those of the whole vocabulary."""
        if self.stored:
            return self.term_stats.join(terms, "term", "left_semi")
        return self.postings.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))

    def release(self) -> None:
        """Frees what ``build`` keeps."""
        self.texts.unpersist()

    def save(self, path: str, buckets: int | None = None) -> None:
        """Written for reuse; the postings are ordered by term, so a reader can skip row groups without the query's terms."""
        ranged = self.postings.repartitionByRange(*([buckets] if buckets else []), "term")
        ranged.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("texts", "term_stats", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("texts", "postings", "term_stats", "corpus")), stored=True)


def build(texts: DataFrame, key: str, column: str | Column, keep: bool = True) -> LexicalIndex:
    """texts: one row per key. Null texts have no terms. The tokenised texts are kept, in memory or on disk, as every table of the index is made from them; lost parts are made again.

    Without ``keep`` the terms of all texts, which are many times the texts, are never held: a
    search tokenises the texts once and keeps the terms that it asks for.
    """
    column = F.col(column) if isinstance(column, str) else column
    sized = tokens.with_terms(texts, key, column)
    if keep:
        return _of(sized.persist(StorageLevel.MEMORY_AND_DISK))
    out = _of(sized)
    out.of_terms = lambda only: _of(tokens.with_terms(texts, key, column, only).persist(StorageLevel.MEMORY_AND_DISK))
    return out


def _of(sized: DataFrame) -> LexicalIndex:
    postings = sized.select(F.explode("terms").alias("term"), "id", "length")
    return LexicalIndex(
        sized,
        postings,
        postings.groupBy("term").agg(F.count("*").alias("df")),
        sized.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl")),
    )


def summary(index: LexicalIndex) -> DataFrame:
    """One row: chunk_count, average_document_length (4 decimals), vocabulary_size."""
    return index.corpus.select(F.col("n").alias("chunk_count"), F.round("avgdl", 4).alias("average_document_length"), F.lit(index.term_stats.count()).alias("vocabulary_size"))
