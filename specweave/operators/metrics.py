"""Retrieval metrics, calibration and extraction quality, for all queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions import normalize as nz
from specweave.schemas import AMBIGUOUS, FIELDS, UNMAPPED

# Edges of the confidence bins, and search variants of the ablation.
EDGES = [0.0, 0.8, 0.9, 0.95, 0.98, 1.0001]
VARIANTS = ["bm25_raw", "dense_raw", "rrf_raw", "rrf_raw_rerank", "bm25_norm", "dense_norm", "rrf_norm", "rrf_norm_rerank", "rrf_oracle_rerank"]
METRICS = ["recall_50", "recall_10", "p_1", "p_5", "ndcg_10", "mrr", "misorder"]


def retrieval_metrics(ranked: DataFrame, totals: DataFrame) -> DataFrame:
    """(qid, and METRICS): one row for each query of ``totals``.

    ``ranked`` is (qid, doc_id, rank, rel, hard) with flags of each returned
    document; ``totals`` (qid, n, n_hard): how many there are of each. Queries
    without relevant documents get null recall and nDCG. Lists are as long as
    what was returned; judgements are joined beforehand, never gathered.
    """
    rel, hard, rank = F.coalesce("rel", F.lit(False)), F.coalesce("hard", F.lit(False)), F.col("rank")
    hit = lambda k: F.count_if(rel & (rank <= k))
    places = lambda flag: F.collect_list(F.when(flag, rank))
    per = ranked.groupBy("qid").agg(
        *[hit(k).alias(f"hits_{k}") for k in (1, 5, 10, 50)],
        F.sum(F.when(rel & (rank <= 10), 1 / F.log2(rank + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(rel, rank)).alias("first"), places(rel).alias("r"), places(hard).alias("h"),
    )
    per = totals.select("qid", "n", "n_hard").join(per, "qid", "left")
    none = F.array().cast("array<bigint>")
    ideal = F.aggregate(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(10)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return per.select(
        "qid", F.try_divide(zero("hits_50"), F.col("n").cast("double")).alias("recall_50"), F.try_divide(zero("hits_10"), F.col("n").cast("double")).alias("recall_10"),
        zero("hits_1").alias("p_1"), (zero("hits_5") / 5.0).alias("p_5"), F.try_divide(zero("dcg"), ideal).alias("ndcg_10"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        misorder(F.coalesce(F.col("r").cast("array<bigint>"), none), F.coalesce(F.col("h").cast("array<bigint>"), none), F.col("n"), F.col("n_hard")).alias("misorder"),
    )


def judgements(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, doc_id, rel, hard) and totals from queries (id, relevant, hard_negatives)."""
    one = lambda c, flag: queries.select(F.col("id").alias("qid"), F.explode(c).alias("doc_id"), F.lit(flag).alias("rel"), F.lit(not flag).alias("hard"))
    rows = one("relevant", True).unionByName(one("hard_negatives", False)).groupBy("qid", "doc_id").agg(F.bool_or("rel").alias("rel"), F.bool_or("hard").alias("hard"))
    totals = queries.select(F.col("id").alias("qid"), F.size(F.array_distinct("relevant")).alias("n"), F.size(F.array_distinct("hard_negatives")).alias("n_hard"))
    return rows, totals


def misorder(r: Column, h: Column, n: Column, n_hard: Column) -> Column:
    """Share of pairs (relevant, hard) in which the hard one is ranked higher.

    ``r`` and ``h`` are ranks of those returned, ``n`` and ``n_hard`` how many
    there are. What is not returned comes last, and pairs of two such do not count.
    """
    lost_r, lost_h = n - F.size(r), n_hard - F.size(h)
    among = F.aggregate(r, F.lit(0).cast("bigint"), lambda s, x: s + F.size(F.filter(h, lambda y: y < x)))
    wrong = among + lost_r * F.size(h)
    pairs = n * n_hard - lost_r * lost_h
    return F.coalesce(F.try_divide(wrong.cast("double"), pairs.cast("double")), F.lit(0.0))


def mean_by(rows: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def at_index(values: Column, share: float) -> Column:
    """The value at index int(n * share) of the sorted values; for 0.5 the upper median."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) * share).cast("int"))


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, p50, p95, ...) by index int(n * share), exactly, without gathering a group.

    A sketch brackets each wanted value (its error is a tenth of the bracket's
    margin); rows below the bracket are counted, and only the distinct values
    within it are put in order.
    """
    accuracy, margin = 10_000, 0.001
    base = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("k"), F.col(value).alias("v"))
    edges = [min(1.0, max(0.0, s + d)) for s in shares for d in (-margin, margin)]
    groups = base.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(*[F.lit(e) for e in edges]), accuracy).alias("q"))
    ranges = [
        F.struct(F.lit(i).alias("i"), F.floor(F.col("n") * s).cast("bigint").alias("at"), F.get("q", F.lit(2 * i)).alias("lo"), F.get("q", F.lit(2 * i + 1)).alias("hi"))
        for i, s in enumerate(shares)
    ]
    wanted = groups.select("k", F.explode(F.array(*ranges)).alias("r")).select("k", "r.*")
    near = base.join(wanted, base["k"].eqNullSafe(wanted["k"])).drop(wanted["k"]).where(F.col("v") <= F.col("hi"))
    below = F.col("v") < F.col("lo")  # counted as one value
    counted = near.groupBy("k", "i", "at", F.when(~below, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k", "i").orderBy(F.col("v").asc_nulls_first()))
    found = counted.withColumn("upto", upto).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at")))
    names = [f"p{round(100 * s)}" for s in shares]
    return found.groupBy(F.col("k").alias(by)).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])


def first_of(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 as ``n``: examples that a report shows."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("bigint")
    return rows.withColumn("n", place).where(F.col("n") <= n)


def selectivity(rows: DataFrame, predicate: Column) -> DataFrame:
    """One row: the share of rows that pass, and how many there are."""
    return rows.agg(F.avg(F.coalesce(predicate, F.lit(False)).cast("double")).alias("selectivity"), F.count(F.lit(1)).alias("n"))


def ablation(results: DataFrame, queries: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """A row for each variant: mean metrics, nDCG by language, and latency percentiles where given.

    ``results`` is (variant, qid, doc_id, rank); ``queries`` as generated.
    """
    judged, totals = judgements(queries)
    flagged = results.join(judged, ["qid", "doc_id"], "left").withColumn("qid", F.struct("variant", "qid"))
    wanted = results.select("variant").distinct().crossJoin(totals).withColumn("qid", F.struct("variant", "qid"))
    per = retrieval_metrics(flagged, wanted).withColumns({"variant": F.col("qid.variant"), "id": F.col("qid.qid")}).join(queries.select("id", "lang"), "id")
    langs = [F.avg(F.when(F.col("lang") == x, F.col("ndcg_10"))).alias(f"ndcg_10_{x}") for x in ("en", "zh")]
    out = per.groupBy("variant").agg(*[F.avg(m).alias(m) for m in METRICS], *langs)
    return out if latencies is None else out.join(percentiles(latencies, "variant", "ms").withColumnsRenamed({"p50": "p50_ms", "p95": "p95_ms"}), "variant")


def outcome(pred: Column, truth: Column) -> Column:
    """Abstaining is told before right and wrong."""
    return F.when(pred == AMBIGUOUS, "abstain").when(pred == truth, "correct").otherwise("wrong")


def rate(flag: Column) -> Column:
    """Share of rows, 0 of none."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def calibration_bins(answered: DataFrame, confidence: str = "confidence", correct: str = "correct", edges: list[float] = EDGES) -> DataFrame:
    """(lo, hi, n, mean_conf, accuracy) of the half-open bins that have rows."""
    c = F.col(confidence)
    bins = F.coalesce(*[F.when((c >= lo) & (c < hi), F.struct(F.lit(lo).alias("lo"), F.lit(min(hi, 1.0)).alias("hi"))) for lo, hi in zip(edges, edges[1:])])
    rows = answered.withColumn("bin", bins).where(F.col("bin").isNotNull())
    return rows.groupBy("bin.lo", "bin.hi").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_conf"), rate(F.col(correct)).alias("accuracy"))


def ece(bins: DataFrame, answered: DataFrame) -> DataFrame:
    """One row: expected calibration error over the bins, by the rows answered."""
    gap = bins.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("accuracy"))), F.lit(0.0)).alias("gap"))
    rows = answered.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("rows"))
    return gap.crossJoin(rows).select((F.col("gap") / F.col("rows")).alias("ece"))


def extraction_facts(sheets: DataFrame, extractions: DataFrame) -> DataFrame:
    """A row for each sheet row: truth, prediction, confidence, outcome. Of predictions for one row the last counts."""
    rows = sheets.select("id", F.posexplode("rows").alias("index", "r"))
    said = extractions.select("id", F.posexplode("mapping.rows").alias("pos", "m")).select("id", "pos", F.col("m.index").alias("index"), F.col("m.field").alias("pred"), F.col("m.confidence").alias("confidence"))
    last = Window.partitionBy("id", "index").orderBy(F.col("pos").desc())
    said = said.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "pos")
    both = rows.join(said, ["id", "index"], "left")
    pred, truth = F.coalesce("pred", F.lit(UNMAPPED)), F.coalesce("r.field", F.lit(UNMAPPED))
    return both.select(
        F.col("id").alias("product"), "index", F.col("r.header").alias("header"), F.col("r.value").alias("value"), truth.alias("truth"), pred.alias("pred"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("r.ambiguous").alias("ambiguous_header"), outcome(pred, truth).alias("outcome"),
    )


def value_accuracy(sheets: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row: hits, total and share of true values, of fields that the sheet has, that the extraction has nearly equal."""
    found = extractions.select("id", "attributes")
    both = sheets.join(found, "id", "left")
    has = lambda f: F.exists("rows", lambda r: F.coalesce(r.field == f, F.lit(False))) & F.col(f"truth.{f}").isNotNull()
    total = sum(has(f).cast("long") for f in FIELDS)
    hits = sum((has(f) & nz.same(f, F.col(f"attributes.{f}"), F.col(f"truth.{f}"))).cast("long") for f in FIELDS)
    out = both.agg(F.sum(hits).alias("hits"), F.sum(total).alias("total"))
    return out.withColumn("accuracy", F.try_divide(F.col("hits").cast("double"), F.col("total").cast("double")))


def extraction_report(sheets: DataFrame, extractions: DataFrame, examples: int = 40) -> dict:
    """The extraction part of a report, on the driver."""
    facts = extraction_facts(sheets, extractions).persist()
    amb, wrong = F.col("ambiguous_header"), F.col("outcome") == "wrong"
    when = lambda cond, what: rate(F.when(cond, F.col("outcome") == what))
    r = facts.agg(
        F.count(F.lit(1)).alias("rows"), when(~amb, "correct").alias("clear_correct"), when(~amb, "wrong").alias("clear_wrong"), F.count_if(amb).alias("n"),
        *[when(amb, x).alias(x) for x in ("correct", "abstain", "wrong")],
    ).first()
    answered = facts.where("outcome != 'abstain'").withColumn("correct", F.col("outcome") == "correct")
    bins = calibration_bins(answered)
    v = value_accuracy(sheets, extractions).first()
    out = {
        "rows": r.rows, "mapping_accuracy_clear_headers": r.clear_correct, "wrong_rate_clear_headers": r.clear_wrong,
        "ambiguous_headers": {"n": r.n, "correct": r.correct, "abstain": r.abstain, "wrong": r.wrong},
        "value_accuracy": v.accuracy, "value_total": v.total,
        "normalization_errors": extractions.agg(F.sum(F.size("normalization_errors"))).first()[0] or 0,
        "calibration_bins": [b.asDict() for b in bins.orderBy("lo").collect()], "ece": ece(bins, answered).first()[0],
        "errors": [e.asDict() for e in facts.where(wrong).orderBy("product", "index").limit(examples).collect()],
    }
    facts.unpersist()
    return out
