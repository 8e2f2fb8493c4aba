"""BM25 over an inverted index, for all queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions import text as tx
from specweave.operators.index import Index

K1, B = 1.2, 0.75


def query_terms(queries: DataFrame, latin: bool = False, plain: bool = False) -> DataFrame:
    """(qid, term): the distinct terms of each query."""
    return queries.select("qid", F.explode(F.array_distinct(tx.tokenize(F.col("text"), latin, plain=plain))).alias("term"))


def bm25(index: Index, queries: DataFrame, field: str = "raw", k: int = 50, latin: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): the k best documents of each query that hold one of its terms.

    The planner broadcasts terms or postings by their real size; a frequent term's
    postings are split otherwise. Scores are added up before they are ranked;
    ties go to the smaller doc_id.
    """
    stats = index.docs.where(F.col("field") == field).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avgdl"))
    terms = index.terms.where(F.col("field") == field).select("term", "df")
    postings = index.postings.where(F.col("field") == field).select("term", "doc_id", "tf", "len")
    hits = query_terms(queries, latin, index.plain).join(terms, "term").join(postings, "term").crossJoin(stats)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = hits.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))
    return top(scored, k)


def top(scored: DataFrame, k: int, by: str = "score", id: str = "doc_id") -> DataFrame:
    """The k best rows of each query by score, with their rank."""
    order = Window.partitionBy("qid").orderBy(F.round(by, 9).desc(), id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
