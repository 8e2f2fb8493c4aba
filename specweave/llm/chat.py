"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation (every role but the system's) the
dialogue is rendered with that speaker as the assistant and all others as
named users; the mask covers what that speaker says, with the closing tag.
System turns stay system turns in every perspective.

Turns are ordered by turn number, role, text. A rendering comes in parts of
PART turns in that order, so no row holds an unbounded conversation; joined in
order of ``part`` they are the whole rendering, and a conversation of up to
PART turns is one part. ``start`` is where a part begins in the whole
rendering, ``spans`` are masked character ranges within the part.

Conversations of up to PART turns are gathered and rendered at once. Longer
ones are numbered first: equal turns are counted, turns are range-partitioned
in order (equal ones differ by their count, so no range is too large) and
numbered within their partition, and the partitions' sums are added up.

Only DataFrame functions are used. Parts, not turns, are joined with the
participants.

Defined results: a null role is the speaker ``unknown``, a null text is empty,
a null turn number counts as before all others; rows without conversation are
left out, as no dialogue holds them; repeated rows are repeated turns; a
conversation of system turns alone has no participant and no rendering; an
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.workspace import Workspace

PART = 256
#: Characters of a text that ranges are told apart by.
BEGINNING = 256
SYSTEM = "system"


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, start, turns, rendered, spans)."""
    ws = Workspace(turns.sparkSession, "chat")
    t = F.struct(F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", t.alias("t"))
    long = ws.stage(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("conv_id"), "long")
    short = rows.join(long, "conv_id", "left_anti").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    short = short.withColumns({"part": F.lit(0).cast("long"), "perspective": F.explode(F.filter(F.array_distinct("t.role"), lambda r: r != SYSTEM))})
    out = _rendered(short).withColumn("start", F.lit(0).cast("long"))
    if not long.isEmpty():
        numbered = _numbered(rows.join(long, "conv_id", "left_semi"), ws)
        numbered = numbered.withColumn("part", F.floor(F.col("at") / part))
        parts = ws.stage(numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("t")), "parts")
        speakers = parts.select("conv_id", F.explode(F.array_distinct("t.role")).alias("perspective")).where(F.col("perspective") != SYSTEM).distinct()
        order = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        both = ws.stage(_rendered(parts.join(speakers, "conv_id")), "rendered")
        starts = both.select("conv_id", "perspective", "part", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long").alias("start"))
        out = out.unionByName(both.join(starts, ["conv_id", "perspective", "part"]))
    return out.select("conv_id", "perspective", "part", "start", "turns", "rendered", "spans")


def _numbered(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Adds ``at``, the place of each turn in its conversation, from 0."""
    counted = rows.groupBy("conv_id", "t").agg(F.count(F.lit(1)).alias("n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("conv_id", "t", "copy")
    # ranges are of beginnings of texts, as texts can be too long to be sampled; copies split ranges where the beginning is all of the text
    head = F.left("t.text", F.lit(BEGINNING))
    ranges = ["conv_id", "t.turn", "t.role", head, F.when(F.length(head) < BEGINNING, F.col("copy"))]
    ordered = each.repartitionByRange(*ranges).sortWithinPartitions("conv_id", "t.turn", "t.role", "t.text", "copy")
    placed = ws.stage(ordered.withColumn("row", F.monotonically_increasing_id()), "placed")  # number of partition, then of row in it
    piece = F.shiftright("row", 33).alias("piece")
    pieces = placed.groupBy("conv_id", piece).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ws.stage(pieces.select("conv_id", "piece", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pieces")
    return placed.withColumn("piece", piece).join(pieces, ["conv_id", "piece"]).select("conv_id", "t", (F.col("before") + F.col("row") - F.col("first")).alias("at"))


def _rendered(parts: DataFrame) -> DataFrame:
    """(conv_id, perspective, part, turns, rendered, spans, size) of parts (conv_id, perspective, part, t)."""
    own = lambda t: t.role == F.col("perspective")
    tag = lambda t: F.when(own(t), F.lit("assistant")).when(t.role == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), t.role))
    segment = lambda t: F.struct(F.concat(F.lit("<|"), tag(t), F.lit("|>\n")).alias("head"), F.concat(t.text, F.lit("<|end|>\n")).alias("body"), own(t).alias("own"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(acc, s):
        begin = acc.at + F.length(s.head)
        end = begin + F.length(s.body)
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(s.own, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    both = parts.withColumn("s", F.transform("t", segment))
    both = both.withColumn("m", F.aggregate("s", zero, step)).withColumn("rendered", F.array_join(F.transform("s", lambda s: F.concat(s.head, s.body)), ""))
    return both.select("conv_id", "perspective", "part", F.size("s").cast("long").alias("turns"), "rendered", F.col("m.spans").alias("spans"), F.col("m.at").alias("size"))
