"""BM25 and TF-IDF top-k retrieval, for any number of queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import tokens
from millrace.operators.index import LexicalIndex

K1, B, EPSILON = 1.5, 0.75, 1e-9
#: Rows of (query, term) that are sent to every executor; more are joined by shuffling.
MOST_BROADCAST = 200_000
#: So many queries are scored text by text; the sums of more are shuffled.
MOST_LOCAL = 5_000
#: Scores of texts and queries that are held at a time; each may have a dozen shared terms, with some numbers each.
AT_ONCE = 1 << 17
#: Ranks are taken on scores rounded to this many places, as the order of a sum is not fixed.
PLACES = 9


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, region, term, place of the term in the query, number of terms. queries: query_id, query and, if wanted, region."""
    if "region" not in queries.columns:
        queries = queries.withColumn("region", F.lit(None).cast("string"))
    listed = queries.select("query_id", "region", tokens.terms(F.col("query")).alias("terms"))
    return listed.select("query_id", "region", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("place", "term"))


def _few(wanted: DataFrame) -> bool:
    return wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _known(index: LexicalIndex, wanted: DataFrame, few: bool) -> DataFrame:
    """term and df of the queries' terms. The statistics are those of the whole corpus, whatever region a query asks for."""
    terms = wanted.select("term").distinct()
    return index.frequencies(F.broadcast(terms) if few else terms)


def _matches(index: LexicalIndex, wanted: DataFrame, few: bool) -> DataFrame:
    """Postings of the queries' terms with their statistics."""
    known = wanted.join(_known(index, wanted, few), "term")
    return _with_corpus(index.postings.join(F.broadcast(known) if few else known, "term"), index)


def _with_corpus(rows: DataFrame, index: LexicalIndex) -> DataFrame:
    """The two numbers of the corpus as literals."""
    corpus = index.corpus.first()
    return rows.withColumns({"n": F.lit(corpus.n), "avgdl": F.lit(corpus.avgdl)})


def _in_region(found: DataFrame, regions: DataFrame | None) -> DataFrame:
    if regions is None:
        return found
    own = regions.select("id", F.lower("region").alias("own_region"))
    return found.join(own, "id").where(F.col("region").isNull() | (F.col("region") == "") | (F.lower("region") == F.col("own_region")))


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("score", PLACES).desc(), "id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_terms(top: DataFrame, index: LexicalIndex, queries: DataFrame, few: bool) -> DataFrame:
    """The matched terms in query order, for the top rows only; few queries have few of them, so the texts need not move."""
    asked = queries.select("query_id", tokens.terms(F.col("query")).alias("q"))
    best = top.join(asked, "query_id")
    return (F.broadcast(best) if few else best).join(index.texts.select("id", "terms"), "id").withColumn("match_terms", F.array_intersect("q", "terms"))


def _best_tfidf(index: LexicalIndex, weights: DataFrame, k: int) -> DataFrame | None:
    """query_id, id, score: of every so many texts all that can be among the best k of a query, so neither postings nor sums are shuffled. None if there are too many queries."""
    rows = weights.where("query_id is not null").select("query_id", "term", "idf", "w").collect()  # at most MOST_BROADCAST
    place = {q: i for i, q in enumerate(dict.fromkeys(r.query_id for r in rows))}
    if len(place) > MOST_LOCAL:
        return None
    terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    of, query, idf, w = (np.array(x) for x in ([terms[r.term] for r in rows], [place[r.query_id] for r in rows], [r.idf for r in rows], [r.w for r in rows])) if rows else (np.zeros(0, np.int64),) * 4
    norm = np.sqrt(np.bincount(query, w * w, len(place)))
    order = np.argsort(of, kind="stable")
    query, idf, w = query[order], idf[order], w[order]
    first = np.searchsorted(of[order], np.arange(len(terms) + 1))
    shared = index.texts.sparkSession.sparkContext.broadcast((list(terms), query, idf, w, first, norm))
    schema = T.StructType([T.StructField("asked", T.IntegerType()), index.texts.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, query, idf, w, first, norm = shared.value
        names = pa.array(names, pa.string())
        n = len(norm)
        step = max(1, AT_ONCE // max(1, n))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows if n else 0, step)):
                batch = batch.take(pc.sort_indices(batch.column("id")))
                lists = batch.column("terms")
                term = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=names), -1).to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[term >= 0]
                term = term[term >= 0]
                length = np.maximum(batch.column("length").to_numpy(zero_copy_only=False), 1).astype(float)
                many = first[term + 1] - first[term]
                at = np.repeat(first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
                row = np.repeat(text, many)
                cell, own = row * n + query[at], idf[at] / length[row]
                dot, square = (np.bincount(cell, x, batch.num_rows * n).reshape(-1, n) for x in (own * w[at], own * own))
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.where(square > 0, dot / (norm * np.sqrt(square)), 0.0)
                order = np.argsort(-score, 0, kind="stable")  # ties by id
                score = np.take_along_axis(score, order, 0)
                rank = np.broadcast_to(np.arange(len(score))[:, None], score.shape)
                fresh = np.concatenate([np.ones((1, n), bool), score[1:] != score[:-1]])
                tie = rank - np.maximum.accumulate(np.where(fresh, rank, 0), 0)
                least = score[min(k, len(score)) - 1]
                doc, asked = np.nonzero((score > 0) & (score >= least - 2 * 10.0**-PLACES) & (tie < k))  # all that rounding may bring among the best
                yield pa.RecordBatch.from_arrays([pa.array(asked.astype(np.int32)), batch.column("id").take(pa.array(order[doc, asked])), pa.array(score[doc, asked])], names=["asked", "id", "score"])

    asked = index.texts.sparkSession.createDataFrame(list(enumerate(place)), T.StructType([T.StructField("asked", T.IntegerType()), weights.schema["query_id"]]))
    return index.texts.select("id", "length", "terms").mapInArrow(run, schema).join(F.broadcast(asked), "asked").select("query_id", "id", "score")


def bm25(index: LexicalIndex, queries: DataFrame, k: int = 5, regions: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank, match_terms. regions (id, region) is needed if queries ask for one. Ties keep the order of the ids; a query without known terms has no row."""
    wanted = query_terms(queries)
    few = _few(wanted)
    index = index.narrowed(wanted) if few else index
    found = _in_region(_matches(index, wanted, few), regions)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    average = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    weight = idf * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("length") / average) + EPSILON)
    top = _top(found.groupBy("query_id", "id").agg(F.sum(weight).alias("score")), max(k, 0))
    return _with_terms(top, index, queries, few).select("query_id", "id", "score", "rank", "match_terms")


def tfidf(index: LexicalIndex, queries: DataFrame, k: int = 5, regions: DataFrame | None = None) -> DataFrame:
    """As bm25. The norm of a text is that of the terms it shares with the query; the norm of the query is over all its terms, known or not."""
    wanted = query_terms(queries)
    few = _few(wanted)
    index = index.narrowed(wanted) if few else index
    idf = F.log(1 + (F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weights = _with_corpus(wanted.join(_known(index, wanted, few), "term", "left"), index).withColumn("idf", idf).withColumn("w", F.col("idf") / F.col("n_terms"))
    if few and k > 0 and regions is None and (best := _best_tfidf(index, weights, k)) is not None:
        return _with_terms(_top(best, k), index, queries, few).select("query_id", "id", "score", "rank", "match_terms")
    norms = weights.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    found = _in_region(_matches(index, wanted, few), regions)
    own, asked = idf / F.greatest("length", F.lit(1)), idf / F.col("n_terms")
    sums = found.groupBy("query_id", "id").agg(F.sum(own * asked).alias("dot"), F.sqrt(F.sum(own * own)).alias("own"))
    scored = sums.join(norms, "query_id").withColumn("score", F.col("dot") / (F.col("norm") * F.col("own")))
    return _with_terms(_top(scored, max(k, 0)), index, queries, few).select("query_id", "id", "score", "rank", "match_terms")
