"""The evaluation from end to end: extraction, search variants, neighbours, and the page of them.

    python -m specweave.plans.evaluate OUT_FOLDER [FAMILIES_PER_CATEGORY]

writes eval.json, neighbours.json and index.html. A latency is that of one plan
for all queries, over their number; each variant is run REPEATS times after a
run that is not timed, so that models are loaded and tables are warm.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.operators import catalog, dense, extract, fusion, index, metrics
from specweave.plans import report
from specweave.sources import jsonl
from specweave.workspace import Workspace

REPEATS, TOP, K = 3, 5, 10
# Names in the report's files.
NAMES = {"recall_50": "recall@50", "recall_10": "recall@10", "p_1": "p@1", "p_5": "p@5", "ndcg_10": "ndcg@10", "mrr": "mrr", "misorder": "misorder"}
LANGS = ("en", "zh")


def searcher(sheets: DataFrame, extractions: DataFrame, ws: Workspace, provider=None, score=fusion.overlap_score) -> fusion.Searcher:
    """Texts, vectors and index of all sheets, written once."""
    rows = ws.stage(index.sheet_texts(sheets, extractions), "rows")
    texts = ws.stage(index.stacked(rows, "id", {v: F.col(v) for v in index.VARIANTS}), "texts")
    vectors = ws.stage(texts.select("field", "doc_id", dense.embed(F.col("text"), provider=provider).alias("embedding")), "vectors")
    return fusion.Searcher(index.build_index(texts, ws), texts, vectors, provider, score)


def retrieval(search: fusion.Searcher, queries: DataFrame, ws: Workspace, variants: list[str] = metrics.VARIANTS, repeats: int = REPEATS) -> dict:
    """Metrics and latencies of each variant, and of each query the first documents that each variant found."""
    spark = queries.sparkSession
    asked, n = queries.select(F.col("id").alias("qid"), "text"), queries.count()
    search.run(variants[-1], asked).count()  # loads models
    found, times = None, []
    for v in variants:
        plan = search.run(v, asked)
        for turn in range(repeats):
            began = time.perf_counter()
            got = ws.stage(plan.withColumn("variant", F.lit(v)), f"found-{v}-{turn}")
            times.append((v, 1000 * (time.perf_counter() - began) / max(n, 1)))
        found = got if found is None else found.unionByName(got)
    table = metrics.ablation(found, queries, spark.createDataFrame(times, "variant string, ms double"))
    rows = {r["variant"]: r for r in table.collect()}
    named = lambda r: {name: r[c] for c, name in NAMES.items()} | {f"ndcg@10_{x}": r[f"ndcg_10_{x}"] for x in LANGS} | {c: r[c] for c in ("p50_ms", "p95_ms")}
    top = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    first = found.where(F.col("rank") <= TOP).groupBy("qid", "variant").agg(top.alias("top"))
    first = first.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("variant", F.col("top.doc_id")))).alias("top5"))
    shown = queries.join(first, F.col("id") == F.col("qid"), "left").orderBy("id").select("id", "text", "lang", "category", "relevant", "hard_negatives", "top5").collect()
    examples = {q["id"]: {c: q[c] for c in ("text", "lang", "category", "relevant", "hard_negatives")} | {"top5": {v: (q["top5"] or {}).get(v, []) for v in variants}} for q in shown}
    return {"variants": {v: named(rows[v]) for v in variants if v in rows}, "n_queries": n, "examples": examples}


def neighbours(items: DataFrame, queries: DataFrame, predicate: Column, ws: Workspace, grid=(16, 32), nprobe: int = 2, id: str = "vec_id", vector: str = "embedding") -> dict:
    """The index's builds with their size, seconds and recall by probes; the exact scan; and the filtered modes."""
    n = max(queries.count(), 1)
    truth = ws.stage(dense.exact_knn(items, queries, K, id, vector), "truth")
    _, seconds = dense.timed(dense.exact_knn(items, queries, K, id, vector))
    out = {"n": items.count(), "k": K, "exact_ms": 1000 * seconds / n, "builds": []}
    for lists in grid:
        built = dense.Ivf.build(items, ws, lists, id=id, vector=vector, name=f"ivf{lists}")
        probes = [p for p in (1, 2, 4, 8, 16, 32) if p <= lists]
        points = [{"nprobe": s["nprobe"], f"recall@{K}": s[f"recall@{K}"], "ms": 1000 * s["seconds"] / n} for s in dense.sweep(built, queries, truth, K, probes)]
        out["builds"].append({"lists": lists, "build_seconds": built.seconds, "index_mb": built.size() / (1 << 20), "sweep": points})
    passing = ws.stage(dense.exact_knn(items.where(predicate), queries, K, id, vector), "passing")
    modes = []
    for mode in ("prefilter", "postfilter", "iterative", "strict"):
        found = built.search(queries, K, nprobe, predicate, mode)
        _, seconds = dense.timed(found)
        mean = dense.recall(found, passing, K, id).agg(F.avg("rows"), F.avg("recall")).first()
        modes.append({"mode": mode, "avg_rows_returned": mean[0], f"recall@{K}": mean[1], "ms": 1000 * seconds / n})
    share = metrics.selectivity(items, predicate).first()
    plan = jsonl.explained(built.search(queries, K, nprobe, predicate, "prefilter"))
    return out | {"filtered": {"selectivity": share.selectivity, "nprobe": nprobe, "modes": modes, "plan": plan.splitlines()}}


def picked(examples: dict) -> list[str]:
    """Queries that the page shows: the first English one of each category, then two Chinese ones."""
    english: dict[str, str] = {}
    for q, x in examples.items():
        if x["lang"] == "en":
            english.setdefault(x["category"], q)
    return [*english.values(), *[q for q, x in examples.items() if x["lang"] == "zh"][:2]]


def run(spark: SparkSession, folder: str, per_category: int = catalog.FAMILIES, provider=None, score=fusion.overlap_score, mapper=extract.alias_mapper, scale: int = 2000) -> dict:
    """Writes the evaluation's files to a folder of the driver; what they say."""
    with Workspace(spark, "evaluation") as ws:
        sheets, queries = (ws.stage(x, name) for x, name in zip(catalog.generate(spark, per_category, ws=ws), ("sheets", "queries")))
        extractions = ws.stage(extract.extract(sheets, mapper), "extractions")
        jsonl.require_complete(sheets, extractions)
        ev = {"extraction": metrics.extraction_report(sheets, extractions), "retrieval": retrieval(searcher(sheets, extractions, ws, provider, score), queries, ws)}
        corpus = ws.stage(catalog.scale_corpus(spark, scale).withColumn("embedding", dense.embed(F.col("text"), provider=provider)), "corpus")
        asked = queries.select(F.col("id").alias("qid"), dense.embed(F.col("text"), "query", provider).alias("qvec"))
        wanted = (F.col("category") == "motor") & (F.col("truth.voltage_v") == 24)
        near = neighbours(corpus, ws.stage(asked, "asked"), wanted, ws, id="id")
        titles = {r["id"]: r["title"] for r in sheets.select("id", "title").collect()}
    jsonl.write_document(ev, f"{folder}/eval.json")
    jsonl.write_document(near, f"{folder}/neighbours.json")
    shown = [ev["retrieval"]["examples"][q] for q in picked(ev["retrieval"]["examples"])]
    report.write_page({"extraction": ev["extraction"], "retrieval": {"variants": [{"variant": v, **r} for v, r in ev["retrieval"]["variants"].items()], "examples": shown, "titles": titles}, "neighbours": near}, f"{folder}/index.html")
    return ev | {"neighbours": near}


if __name__ == "__main__":
    session = SparkSession.builder.appName("evaluate").getOrCreate()
    run(session, sys.argv[1], *map(int, sys.argv[2:3]))
