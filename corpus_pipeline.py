"""A corpus pipeline: five stages, each the work of one operator, each written and read again.

Defined results, for every stage: a null column other than ``text`` changes no
decision; null, empty and wordless texts pass near-dedup and decontamination,
and the classifiers as far as their scores for no text do; rows decide by their
own text, whatever other rows have their doc_id; ties fall as the operators
say; an empty table gives an empty result. Work columns are named so that they
clash with none of the input's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import decontaminate, neardup, packing, quality, toxicity
from specweave.llm.common import free
from specweave.workspace import Workspace, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; texts without words score low and stay."""
    told = free(docs.columns, "__toxicity")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, into=told).where(F.col(told)["score"] < 0.5).select(docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least 0.7; texts without words have the score of the bias."""
    told = free(docs.columns, "__quality")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, into=told).where(F.col(told) >= 0.7).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that of the smallest doc_id.

    Of rows with one doc_id and equal sets of shingles one stays, that of the
    smallest hash of text, then of all columns; one with another text is judged
    on its own. Rows without doc_id and texts without words all stay.
    """
    ws = Workspace(spark, "dedup")
    told = neardup.near_duplicates(docs, size=5, percent=80, detail=True).where("doc_id is not null and digest is not null")
    told = ws.stage(told.select("doc_id", "text_hash", "digest", "kept"), "told")
    again = told.where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"), F.min("text_hash").alias("least")).where("rows > 1")
    again = ws.stage(again, "again")
    removed = told.where("not kept").select("doc_id", "text_hash")
    if repeated := not again.isEmpty():
        more = told.where("kept").join(again, ["doc_id", "digest"]).where("text_hash != least").select("doc_id", "text_hash")
        removed = removed.unionByName(more)
    removed = ws.stage(removed.distinct(), "removed")

    own = free(docs.columns, "__hash")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col(own).alias("text_hash"))

    def parted(rows: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows that may be among the marked ones, those that cannot, and the marked ones' keys."""
        rows = rows.withColumn(own, F.xxhash64("text"))
        marks = marked.select(F.struct("doc_id", "text_hash").alias("key"))
        return neardup.only(rows, key, marks, "key"), neardup.only(rows, key, marks, "key", inside=False), marks

    # most texts need no shuffle: only those that may be removed rows are joined with them
    doubtful, clear, marks = parted(docs, removed)
    out = clear.unionByName(doubtful.join(marks, key == marks["key"], "left_anti")).select(docs.columns)
    if repeated:
        doubtful, clear, marks = parted(out, again.select("doc_id", F.col("least").alias("text_hash")))
        alone = doubtful.join(marks, key == marks["key"], "left_anti").select(docs.columns)
        whole = F.struct(*docs.columns)
        once = doubtful.join(marks, key == marks["key"], "left_semi").groupBy(key.alias("key")).agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
        out = clear.select(docs.columns).unionByName(alone).unionByName(once)
    return out


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; texts without words stay."""
    told = free(docs.columns, "__leak")
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), into=told)
    return judged.where(~F.col(told)["contaminated"]).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of each document, texts without words and rows without doc_id included."""
    return packing.pack(docs, packing.words(F.col("text")))


STAGES = [
    ("toxicity", without_toxic),
    ("quality classifier", of_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_leaks),
    ("packing", packed),
]

#: Trained models and tilings are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's result is written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.stage(stage(spark, docs, sf_dir), str(i))
        if i:
            ws.drop(str(i - 1))
    return docs
