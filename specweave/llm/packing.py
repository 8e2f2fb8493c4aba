"""Packing into optimal length buckets.

The lengths' histogram over all documents is gathered; dynamic programming
chooses the bucket boundaries for which padding every document to its bucket's
boundary adds the fewest tokens. Within a bucket, documents in order fill
batches of as many rows as the token budget holds at the boundary's length.

The histogram has every distinct length, unrounded: d of them need d * d / 2
words of text, so what is gathered grows with the root of the input at most.
The programme is exact (lines of falling slope asked at rising lengths: linear
in the distinct lengths for each bucket).

Documents are numbered without gathering a bucket: rows of one identifier and
length are counted, cut into runs of at most SHARD of them, and dealt by hash
to shards of about SHARD rows; runs are numbered in their shard, the shards'
sums are added up, and runs become rows again at the end. So neither rows
without identifier nor one that repeats without bound meet in one task.

Defined results: null and empty texts have length 0 and are packed as such; a
document longer than the budget makes a batch of its own; repeated rows are
packed once each; rows without identifier are packed too; a null length counts
as 0; an empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.workspace import Workspace

BUCKETS = 16
BUDGET = 16_384
SHARD = 4096


def words(text: Column) -> Column:
    """Words of a text: runs without 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The (at most ``buckets``) upper edges of least total padding. Lengths rise strictly."""
    m, k = len(lengths), min(buckets, len(lengths))
    if not m:
        return []
    l = [int(x) for x in lengths]  # Python's integers: sums of squares can pass 64 bits
    c, w = [0], [0]
    for x, n in zip(l, (int(n) for n in counts)):
        c.append(c[-1] + n)
        w.append(w[-1] + n * x)
    # cost[j]: least padding of the first j bins; from[j]: where its last bucket begins
    cost = [l[j - 1] * c[j] - w[j] if j else 0 for j in range(m + 1)]
    back = [[0] * (m + 1)]
    for _ in range(1, k):
        lines: list[tuple[int, int, int]] = []  # slope -c[i], height cost[i] + w[i]
        head, new, begin = 0, [0] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            line = (-c[i], cost[i] + w[i], i)
            while len(lines) - head >= 2:
                (s1, h1, _), (s2, h2, _) = lines[-2], lines[-1]
                if (h2 - h1) * (s2 - line[0]) >= (line[1] - h2) * (s1 - s2):
                    lines.pop()
                else:
                    break
            lines.append(line)
            while len(lines) - head >= 2 and lines[head + 1][0] * l[j - 1] + lines[head + 1][1] <= lines[head][0] * l[j - 1] + lines[head][1]:
                head += 1
            s, h, begin[j] = lines[head]
            new[j] = l[j - 1] * c[j] - w[j] + s * l[j - 1] + h
        cost = new
        back.append(begin)
    edges, j = [], m
    for begin in reversed(back):
        if j:
            edges.append(l[j - 1])
            j = begin[j]
    return edges[::-1]


def pack(docs: DataFrame, length: Column, budget: int = BUDGET, buckets: int = BUCKETS, id: str = "doc_id") -> DataFrame:
    """(id, n_tokens, bucket, bucket_len, batch_id, slot), a row for each row of ``docs``."""
    ws = Workspace(docs.sparkSession, "packing")
    slim = ws.stage(docs.select(F.col(id).alias("id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n")), "lengths")
    histogram = sorted((r.n, r.rows) for r in slim.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect())
    at, counts = (np.array([h[i] for h in histogram], np.int64) for i in (0, 1))
    edges = boundaries(at, counts, buckets) or [0]
    held = np.bincount(np.searchsorted(edges, at), weights=counts, minlength=len(edges)).astype(np.int64) if len(at) else np.zeros(1, np.int64)
    room = np.maximum(1, budget // np.maximum(edges, 1))
    first = np.concatenate(([0], np.cumsum(-(-held // room))))

    def of(values) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)

    # runs of rows that nothing tells apart
    runs = slim.groupBy("id", "n").agg(F.count(F.lit(1)).alias("rows"))
    runs = runs.select("id", "n", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {SHARD}"))).alias("run"))
    runs = runs.select("id", "n", "run", F.least(F.col("rows") - F.col("run") * SHARD, F.lit(SHARD)).alias("here"))
    runs = runs.withColumn("bucket", sum((F.col("n") > e).cast("int") for e in edges[:-1]) if len(edges) > 1 else F.lit(0))
    runs = ws.stage(runs.withColumn("shard", F.pmod(F.xxhash64("id", "n", "run"), of(-(-held // SHARD) + (held == 0)))), "runs")
    sums = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.groupBy("bucket", "shard").agg(F.sum("here").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(sums), F.lit(0))).drop("all")
    before = ws.stage(before, "before")
    own = Window.partitionBy("bucket", "shard").orderBy("id", "n", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("at", F.coalesce(F.sum("here").over(own), F.lit(0))).join(before, ["bucket", "shard"])
    rows = runs.withColumn("one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("here") - 1))).withColumn("at", F.col("before") + F.col("at") + F.col("one"))
    return rows.select(
        F.col("id").alias(id), F.col("n").alias("n_tokens"), "bucket", of(edges).alias("bucket_len"),
        (of(first[:-1]) + F.floor(F.col("at") / of(room))).cast("long").alias("batch_id"), (F.col("at") % of(room)).cast("long").alias("slot"),
    )
