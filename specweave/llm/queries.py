"""The thin queries over the operators of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import ann, chat, decontaminate, langid, neardup, packing, quality, tokenstore, toxicity, warc
from specweave.llm.common import fold_of
from specweave.workspace import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), parts=5, held=0)
    got = toxicity.score(docs.select("doc_id", "text"), lexicon)
    score = F.col("toxicity.score")
    return got.select(
        "doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.matches").alias("matches"), F.col("toxicity.words").alias("words"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "leak.contaminated", "leak.coverage", "leak.item_id", "leak.items")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start, s.end)), ",")
    return got.withColumn("spans", spans)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), parts=4, held=2)
    score = F.col("quality_score")
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted")
    )


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.training(parts=3, held=1))
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.words(F.col("text")))


def op10_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenstore.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_neardup, op4_perspectives, op5_warc, op6_ann, op7_quality, op8_langid, op9_packing, op10_tokenstore)}
#: Equal results in SQL, where it can express them.
ORACLES: dict[str, str] = {
    "op3_neardup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS shingles FROM w
        ), e AS MATERIALIZED (
            SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
        ), links AS MATERIALIZED (
            SELECT a.doc_id AS one, b.doc_id AS two FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), edges AS (
            SELECT one, two FROM links UNION ALL SELECT two, one FROM links
        ), reach AS (
            SELECT doc_id, doc_id AS root FROM s UNION SELECT edges.two, reach.root FROM reach JOIN edges ON edges.one = reach.doc_id AND reach.root < edges.two
        ), c AS (
            SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
    """,
    "op4_perspectives": """
        WITH t AS (
            SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), p AS (
            SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
        ), s AS (
            SELECT t.*, perspective, role = perspective AS own,
                   '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || '|>' || chr(10) AS head,
                   text || '<|end|>' || chr(10) AS body
            FROM t JOIN p USING (conv_id)
        ), n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text) AS rn FROM s
        ), o AS (
            SELECT *, CAST(floor((rn - 1) / 256.0) AS BIGINT) AS part FROM n
        ), c AS (
            SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY rn) AS stop FROM o
        ), g AS (
            SELECT conv_id, perspective, part, count(*) AS turns, string_agg(head || body, '' ORDER BY rn) AS rendered, CAST(max(stop) AS BIGINT) AS size,
                   coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY rn) FILTER (WHERE own), '') AS spans
            FROM c GROUP BY ALL
        )
        SELECT conv_id, perspective, part, CAST(turns AS BIGINT) AS turns, rendered, spans,
               CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM g
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), o AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
        FROM o
    """,
    "op6_ann": """
        WITH e AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), u AS (
            SELECT * FROM e WHERE len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0
        ), o AS (
            SELECT DISTINCT * FROM u WHERE len(v) = (SELECT len(v) FROM u GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)
        ), p AS (
            SELECT q.vec_id AS query_id, o.vec_id, max(list_dot_product(o.v, q.v)) AS score FROM o JOIN o AS q ON q.vec_id % 20 = 0 AND q.vec_id <> o.vec_id GROUP BY ALL
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
}
