"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (a run of SEED words) are
compared: the longest run of words that both have and that no tile covers yet
becomes a tile, again and again, down to SEED words. Runs are found by running
Karp-Rabin: rolling hashes of windows whose length is halved when nothing that
long is left. Only the stretches of a document that an item's seeds cover are
compared with it. The order of the tiles does not matter, so reordered passages
are found too. A document is contaminated by an item if the tiles cover at
least COVERAGE of the item's words.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Items
of fewer than SEED words need their whole sequence as a seed.

The seeds of a benchmark of up to BROADCAST_BYTES of text are broadcast and
documents are scanned once, without a shuffle. A larger benchmark is joined by
seed: distinct texts' seeds against items' seeds, then the texts of the pairs.

Defined results: null, empty and wordless texts and items match nothing;
repeated rows get equal verdicts; an empty benchmark or table contaminates
nothing; of items of equal coverage the smallest identifier is named; an item
identifier that occurs more than once stands for several items. The result
column replaces a column of the same name; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import free, mixed, powers, small_batches, word_hashes
from specweave.workspace import Workspace

SEED = 5
COVERAGE = 0.5
#: Most text of a benchmark that is broadcast; a worker's index of it takes about eight times as much.
BROADCAST_BYTES = 16 << 20
#: Windows that are hashed at a time, and pairs of equal windows that are held at a time.
STRETCH, PAIRS = 1 << 20, 1 << 20
VERDICT = "struct<contaminated: boolean, coverage: double, item_id: bigint, items: array<bigint>>"
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> np.ndarray:
    """A hash for each word of the text."""
    return word_hashes((text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, as differences of running sums: linear for any size."""
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(words) - size + 1, STRETCH):
        own = words[at : at + STRETCH + size - 1]
        up, down = powers(len(own))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * up, dtype=np.uint64)))
        out.append(mixed((sums[size:] - sums[:-size]) * down[: len(own) - size + 1]))
    return np.concatenate(out)


def _uncovered(free: np.ndarray, size: int) -> np.ndarray:
    """Where windows of ``size`` words begin that no tile covers a word of."""
    n = np.concatenate((np.zeros(1, np.int64), np.cumsum(free)))
    return np.flatnonzero(n[size:] - n[:-size] == size)


def _matches(one: np.ndarray, two: np.ndarray, free_1: np.ndarray, free_2: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(-words, start in two, start in one) of the longest uncovered matches of ``size`` words or more, sorted."""
    if size > min(len(one), len(two)):
        return []
    at_1, at_2 = _uncovered(free_1, size), _uncovered(free_2, size)
    h_1, h_2 = windows(one, size)[at_1], windows(two, size)[at_2]
    order = np.argsort(h_1, kind="stable")
    lo, hi = np.searchsorted(h_1[order], h_2, "left"), np.searchsorted(h_1[order], h_2, "right")
    till, found, first = np.cumsum(hi - lo), [], 0
    while first < len(till):  # some PAIRS pairs of equal windows at a time
        last = max(first + 1, int(np.searchsorted(till, (till[first - 1] if first else 0) + PAIRS, "right")))
        n = (hi - lo)[first:last]
        j = np.repeat(at_2[first:last], n)
        i = at_1[order[np.repeat(lo[first:last], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        inner = (i > 0) & (j > 0)  # a match that can be longer to the left is part of another
        inner[inner] = (one[i[inner] - 1] == two[j[inner] - 1]) & free_1[i[inner] - 1] & free_2[j[inner] - 1]
        for a, b in zip(i[~inner].tolist(), j[~inner].tolist()):
            most = min(len(one) - a, len(two) - b)
            for n in (min(2 * size, most), most):  # few go beyond twice the size
                alike = (one[a : a + n] == two[b : b + n]) & free_1[a : a + n] & free_2[b : b + n]
                if not alike.all():
                    n = int(alike.argmin())
                    break
            if n >= size:
                found.append((-n, b, a))
        first = last
    return sorted(found)


def tiles(one: np.ndarray, two: np.ndarray, least: int = SEED, size: int = 0) -> list[tuple[int, int, int]]:
    """Greedy tiling of word sequences: (start in one, start in two, words), in the order found.

    Longer tiles come first; of equal ones, that which begins first in ``two``, then in ``one``.
    The first windows have ``size`` words, by default those of the shorter sequence.
    """
    free_1, free_2 = np.ones(len(one), bool), np.ones(len(two), bool)
    found, size = [], max(least, size or min(len(one), len(two)))
    while size >= least:
        matches = _matches(one, two, free_1, free_2, size)
        for k, b, a in matches:
            if free_1[a : a - k].all() and free_2[b : b - k].all():
                free_1[a : a - k] = free_2[b : b - k] = False
                found.append((a, b, -k))
        if not matches:
            if size == least:
                break
            size = max(least, size // 2)
    return found


def stretches(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The words within windows of ``size`` words that begin at ``starts`` (rising); what lies between becomes one word that nothing equals."""
    edge = np.flatnonzero(np.diff(starts) > size)
    first, last = starts[np.concatenate(([0], edge + 1))], starts[np.append(edge, len(starts) - 1)] + size
    return np.concatenate([x for a, b in zip(first.tolist(), last.tolist()) for x in (words[a:b], np.zeros(1, np.uint64))][:-1])


class Benchmark:
    """Items' words and an index from seeds to items."""

    def __init__(self, items: list[tuple[int, str]], coverage: float = COVERAGE, seed: int = SEED):
        self.coverage, self.ids, self.words, by = coverage, [], [], {}
        for item, text in items:
            words = tokens(text)
            if item is not None and len(words):
                size = min(seed, len(words))
                by.setdefault(size, []).append((windows(words, size), len(self.ids)))
                self.ids.append(int(item))
                self.words.append(words)
        self.index = []
        for size, parts in sorted(by.items()):
            h = np.concatenate([p for p, _ in parts])
            owner = np.concatenate([np.full(len(p), k, np.int64) for p, k in parts])
            order = np.argsort(h, kind="stable")
            self.index.append((size, h[order], owner[order]))

    def verdict(self, text: str | None) -> dict:
        words, found = tokens(text), []
        for size, h, owner in self.index:
            own = windows(words, size)
            place = np.flatnonzero(h[np.minimum(np.searchsorted(h, own), len(h) - 1)] == own)  # of the text's seeds
            hit = np.unique(own[place])
            lo, hi = np.searchsorted(h, hit, "left"), np.searchsorted(h, hit, "right")
            for k in sorted({int(k) for a, b in zip(lo, hi) for k in owner[a:b]}):
                item = self.words[k]
                shared = stretches(words, place[np.isin(own[place], windows(item, size))], size)  # no tile is outside
                covered = sum(n for *_, n in tiles(shared, item, size, min(len(words), len(item)))) / len(item)
                found.append((-covered, self.ids[k]))
        found.sort()
        over = sorted({item for c, item in found if -c >= self.coverage})
        return {"contaminated": bool(over), "coverage": -found[0][0] if found else 0.0, "item_id": found[0][1] if found else None, "items": over}


def _verdicts(rows: list[dict]) -> pa.Array:
    return pa.array(rows, pa.struct([("contaminated", pa.bool_()), ("coverage", pa.float64()), ("item_id", pa.int64()), ("items", pa.list_(pa.int64()))]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", into: str = "leak", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``into``: whether and by which items a text is contaminated."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_id is not null and item_text is not null")
    if (items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) > broadcast_bytes:
        return _joined(docs, items, coverage, text, into)
    sent = docs.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.item_text) for r in items.collect()))

    @F.arrow_udf(VERDICT)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = Benchmark(sent.value, coverage)
        for batch in batches:
            yield _verdicts([bench.verdict(batch[i].as_py()) for i in range(len(batch))])

    return docs.withColumn(into, judged(F.col(text)))


def _joined(docs: DataFrame, items: DataFrame, coverage: float, text: str, into: str) -> DataFrame:
    """The same for a benchmark that is too large to broadcast."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    @F.arrow_udf("array<bigint>")
    def seeds_of_item(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words = [tokens(batch[i].as_py()) for i in range(len(batch))]
            yield pa.array([np.unique(windows(w, min(SEED, len(w))) + np.uint64(min(SEED, len(w)))).view(np.int64) if len(w) else [] for w in words], pa.list_(pa.int64()))

    @F.arrow_udf("array<bigint>")
    def seeds_of_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words = [tokens(batch[i].as_py()) for i in range(len(batch))]
            yield pa.array([np.unique(np.concatenate([np.zeros(0, np.uint64), *(windows(w, n) + np.uint64(n) for n in sizes)])).view(np.int64) for w in words], pa.list_(pa.int64()))

    @F.arrow_udf("int")
    def words_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([min(SEED, len(tokens(batch[i].as_py()))) for i in range(len(batch))], pa.int32())

    @F.arrow_udf(VERDICT)
    def judged(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ids, others in batches:
            yield _verdicts([Benchmark([(i.as_py(), o.as_py())], coverage).verdict(t.as_py()) for t, i, o in zip(texts, ids, others)])

    key = F.sha2(F.col(text), 256)
    items = ws.stage(items.withColumn("item_key", F.xxhash64("item_id", "item_text")), "items")
    sizes = sorted(r[0] for r in items.select(words_of("item_text").alias("n")).where("n > 0").distinct().collect())  # SEED numbers at most
    seeds = items.select("item_key", F.explode(seeds_of_item("item_text")).alias("seed")).distinct()
    texts = ws.stage(docs.where(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).alias("t")).groupBy("key").agg(F.first("t").alias("t")), "texts")
    pairs = texts.select("key", F.explode(seeds_of_text("t")).alias("seed")).join(seeds, "seed").select("key", "item_key").distinct()
    v = pairs.join(texts, "key").join(items, "item_key").select("key", judged("t", "item_id", "item_text").alias("v")).select("key", "v.*")
    best = F.max_by("item_id", F.struct("coverage", -F.col("item_id")))
    found = v.groupBy("key").agg(F.max("contaminated").alias("contaminated"), F.max("coverage").alias("coverage"), best.alias("item_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    own, told = (free(docs.columns, c) for c in ("__key", "__found"))
    found = ws.stage(found.select(F.col("key").alias(own), F.struct("contaminated", "coverage", "item_id", "items").alias(told)), "found")
    none = F.from_json(F.lit('{"contaminated": false, "coverage": 0.0, "item_id": null, "items": []}'), VERDICT)
    out = docs.withColumn(own, key).join(found, own, "left").withColumn(into, F.coalesce(told, none))
    return out.drop(own, told)
