"""Questions to cited evidence: one plan for a single question or a large batch."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evidence, extraction, index, normalize, retrieval, session
from millrace.plans import response
from millrace.session import Stored, checkpointed


class Engine:
    """chunks: chunk_id, doc_id, region, source_title, chunk_text, section_title. The index is built once and kept where the session has room."""

    def __init__(self, chunks: DataFrame, lexical: index.LexicalIndex | None = None, normalizer: normalize.Normalizer | None = None):
        self.chunks, self.normalizer = chunks, normalizer
        self.index = lexical or index.build(chunks, "chunk_id", "chunk_text")

    def ask_many(self, queries: DataFrame, k: int = 5, top_chunks: int = 3, most: int = 3) -> DataFrame:
        """queries: query_id, query and, if wanted, session_id, turn and region. One row per query: normalized_query, citations (best first), confidence, the parameters of the best evidence and its chunk, and what ``response.respond`` adds."""
        asked = normalize.normalize_queries(queries, self.normalizer)
        search = asked.select("query_id", F.col("search_text").alias("query"), *(["region"] if "region" in queries.columns else []))
        hits = retrieval.bm25(self.index, search, k, self.chunks.select(F.col("chunk_id").alias("id"), "region") if "region" in queries.columns else None)
        chosen = Stored(evidence.select(evidence.rank_sentences(search, hits, self.chunks, top_chunks), most)).rows  # a few rows a query, which all that follows reads
        sure = evidence.confidence(search, chosen)
        first = extraction.extract(*self._best(chosen))
        parameters = first.select("query_id", F.struct("interest_rate", "subsidy_rate", "effective_rate", "loan_term_months", "loan_amount_upper_limit", "collateral_required", "guarantee_required", "target_entities", "usage_restrictions", "repayment_constraints").alias("parameters"), F.struct("evidence_text", "chunk_id", "collateral_requirement_text", "guarantee_requirement_text", "matched_percentages").alias("raw_slots"))
        cited = response.citations(chosen, self.chunks)
        found = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("evidence_rank", "evidence_id", "chunk_id", "doc_id", "source", "section", "citation_text", "quote", "confidence", "rationale"))).alias("citations"))  # at most ``most`` a query
        out = asked.drop("hits", "trace").join(found, "query_id", "left").join(sure.select("query_id", F.struct("confidence", "label", "warning", "reasons").alias("confidence")), "query_id", "left").join(parameters, "query_id", "left")
        return response.respond(out)

    def _best(self, chosen: DataFrame) -> tuple[DataFrame, str, tuple[str, ...]]:
        """The best evidence of each query with the other texts to look for parameters in, in order: its chunk's text, section, title and own metadata."""
        first = chosen.where("evidence_rank = 1").select("query_id", "chunk_id", "evidence_text")
        own = self.chunks.select("chunk_id", "chunk_text", "section_title", "source_title", *(["metadata"] if "metadata" in self.chunks.columns else []))
        return first.join(own, "chunk_id", "left"), "evidence_text", ("chunk_text", "section_title", "source_title", *(["metadata"] if "metadata" in self.chunks.columns else []))

    def ask_sessions(self, turns: DataFrame, **options) -> DataFrame:
        """As ask_many for the turns of sessions, with the slots carried up to and with each turn (queries need session_id and turn). A turn's region is that given with it."""
        answered = self.ask_many(turns, **options)
        lines = answered.withColumn("__lines", F.coalesce(F.expr("transform(citations, e -> e.quote)"), F.array().cast("array<string>")))
        kept = lines.withColumnRenamed("normalized_query", "normalized_text")
        return session.carried(session.turn_slots(kept, "query", "__lines")).drop("__lines")

    def ask_in_session(self, spark: SparkSession, store: str, session_id: str, query: str, region: str | None = None) -> DataFrame:
        """One question of a session whose earlier turns lie under ``store`` (one folder per session, a small table of slots); the turn is added to them. A question without a region has that of the session. One row: as ask_many, with session_id, turn, region and the slots carried so far."""
        path = f"{store}/session={quote(session_id, safe='')}"
        columns = ["session_id", "turn", "region", *session.SLOTS]
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        before = spark.read.parquet(path).select(*columns) if known else None
        last = before.orderBy(F.col("turn").desc()).first() if known else None
        region = region or (last.region if last else None)
        turn = last.turn + 1 if last else 1
        asked = spark.createDataFrame([(1, session_id, turn, query, region)], "query_id int, session_id string, turn int, query string, region string")
        answered = checkpointed(self.ask_many(asked))
        lines = answered.withColumn("__lines", F.coalesce(F.expr("transform(citations, e -> e.quote)"), F.array().cast("array<string>")))
        own = checkpointed(session.turn_slots(lines.withColumnRenamed("normalized_query", "normalized_text"), "query", "__lines").select(*columns))
        every = before.unionByName(own) if known else own
        carried = checkpointed(session.carried(every).where(F.col("turn") == turn))
        own.coalesce(1).write.mode("append").parquet(path)
        return answered.withColumnRenamed("normalized_query", "normalized_text").join(carried.drop("region"), ["session_id", "turn"])
