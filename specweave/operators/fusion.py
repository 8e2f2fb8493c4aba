"""Fusion, reranking and the dispatcher of search variants."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions import text as tx
from specweave.operators import dense
from specweave.operators.bm25 import bm25, top
from specweave.operators.index import Index

RRF_K = 60
RERANK_ROWS = 30


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = 50, constant: int = RRF_K) -> DataFrame:
    """(qid, doc_id, rrf, lexical_rank, semantic_rank, rank) from two ranked lists (qid, doc_id, rank).

    A document that one list lacks gets nothing from it. Grouping the union does
    the full outer join's work with partial aggregation. Ties go to the smaller doc_id.
    """
    none = F.lit(None).cast("bigint")
    both = lexical.select("qid", "doc_id", F.col("rank").alias("l"), none.alias("s")).unionByName(semantic.select("qid", "doc_id", none.alias("l"), F.col("rank").alias("s")))
    merged = both.groupBy("qid", "doc_id").agg(F.max("l").alias("lexical_rank"), F.max("s").alias("semantic_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(constant)) + F.col(c)), F.lit(0.0))
    return top(merged.withColumn("rrf", part("lexical_rank") + part("semantic_rank")), k, "rrf").select("qid", "doc_id", "rrf", "lexical_rank", "semantic_rank", "rank")


def token_overlap(query: Column, text: Column) -> Column:
    """The share of the query's distinct tokens that the text's tokens hold."""
    q = F.array_distinct(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, text)).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def overlap_score(query: Column, text: Column) -> Column:
    """Offline reranker: the overlap of the texts' tokens."""
    return token_overlap(tx.tokenize(query), tx.tokenize(text))


def modelled_score(provider):
    """A scorer from ``provider(list of (query, text)) -> scores``, called on Arrow batches; a model comes as ``providers.Once``."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for queries, texts in batches:
            yield pa.array([float(x) for x in provider(list(zip(queries.to_pylist(), texts.to_pylist())))], pa.float64())

    return run


def rerank(ranked: DataFrame, queries: DataFrame, texts: DataFrame, n: int = RERANK_ROWS, score=overlap_score) -> DataFrame:
    """(qid, doc_id, rank): the first n of each list by score, ties as they were; the rest as it was.

    ``texts`` is (doc_id, text), ``queries`` (qid, text), or both have ``tokens`` in
    place of ``text``, as an index has written them, and ``score`` compares those.
    Only the head's texts are joined and scored.
    """
    what = "tokens" if "tokens" in texts.columns else "text"
    head = ranked.where(F.col("rank") <= n).join(queries.select("qid", F.col(what).alias("__query")), "qid").join(texts.select("doc_id", F.col(what).alias("__text")), "doc_id")
    scored = head.select("qid", "doc_id", score(F.col("__query"), F.col("__text")).alias("score"))
    out = ranked.select("qid", "doc_id", "rank").join(scored, ["qid", "doc_id"], "left")
    order = Window.partitionBy("qid").orderBy((F.col("rank") > n).asc(), F.round("score", 9).desc_nulls_last(), "rank")
    return out.withColumn("new", F.row_number().over(order).cast("bigint")).select("qid", "doc_id", F.col("new").alias("rank"))


@dataclass
class Searcher:
    """Search variants ``<method>_<field>[_rerank]``; each call builds one plan for all queries.

    ``texts`` is (field, doc_id, text), ``vectors`` (field, doc_id, embedding). A
    method computes only what it uses: queries are embedded for dense search alone.
    """

    index: Index
    texts: DataFrame
    vectors: DataFrame | None = None
    provider: object = None
    score: object = field(default=overlap_score)

    def bm25(self, queries: DataFrame, field: str = "raw", k: int = 50) -> DataFrame:
        return bm25(self.index, queries, field, k).select("qid", "doc_id", "rank")

    def dense(self, queries: DataFrame, field: str = "raw", k: int = 50) -> DataFrame:
        asked = queries.select("qid", dense.embed(F.col("text"), "query", self.provider).alias("qvec"))
        return dense.exact_knn(self.vectors.where(F.col("field") == field), asked, k, "doc_id").select("qid", "doc_id", "rank")

    def rrf(self, queries: DataFrame, field: str = "raw", k: int = 50) -> DataFrame:
        return rrf(self.bm25(queries, field, k), self.dense(queries, field, k), k).select("qid", "doc_id", "rank")

    def rerank(self, ranked: DataFrame, queries: DataFrame, field: str = "raw", n: int = RERANK_ROWS) -> DataFrame:
        if self.score is overlap_score:  # the index has the tokens
            asked = queries.select("qid", tx.tokenize(F.col("text"), plain=self.index.plain).alias("tokens"))
            return rerank(ranked, asked, self.index.tokens.where(F.col("field") == field).select("doc_id", "tokens"), n, token_overlap)
        return rerank(ranked, queries, self.texts.where(F.col("field") == field).select("doc_id", "text"), n, self.score)

    def run(self, variant: str, queries: DataFrame, k: int = 50) -> DataFrame:
        """(qid, doc_id, rank) of a variant; an unknown method or field is an error."""
        method, field, *more = variant.split("_")
        if method not in ("bm25", "dense", "rrf") or more not in ([], ["rerank"]):
            raise ValueError(f"no such variant: {variant}")
        ranked = getattr(self, method)(queries, field, k)
        return self.rerank(ranked, queries, field) if more else ranked
