"""Maximum inner product search with score-aware four-bit codes and exact reranking.

Vectors are cut into pairs of dimensions; each pair is coded by one of 16
centres (four bits). Codes and centres minimise an anisotropic loss, which
weighs the error parallel to a vector ETA times as much as that across it, as
parallel error is what changes large inner products. A scan adds up looked-up
partial products, two codes a byte; the best RERANK of each block of rows are
scored exactly in double precision on the original vectors, and so is every
other row whose scanned product, by the length of its coding error, can still
reach the last place. So the result is that of a search of all rows.

Centres are fitted on at most SAMPLE_ROWS vectors (smallest hashes); every
vector is coded and scanned. Codes and vectors are written once and stay where
they are: queries go to them, in rounds of at most QUERY_BYTES that are
broadcast. A task scans its rows in blocks of ROW_BLOCK, holds the K + 1 best
rows of each query of the round, skips what cannot reach the worst of them,
and sends only those on. Equal vectors are searched as one: of their
identifiers the K + 1 smallest are kept, which is all that ties can show.

Products are added up in the order of the dimensions, so scores are the same
in every run and equal to those of a plain loop.

Defined results: vectors that are null, zero, of another length than most, or
that hold a null or non-finite component take no part, as rows or as queries,
nor do rows without identifier; equal rows count once; with fewer than K
candidates all are returned; an empty table gives an empty result. Columns
other than the identifier and the vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specweave.workspace import Workspace

CENTRES = 16
#: Inner products above this share of the norm are those that should be right; sets ETA.
THRESHOLD = 0.2
SAMPLE_ROWS, ROUNDS, PASSES = 10_000, 8, 3
ROW_BLOCK, RERANK = 8192, 256
#: Most bytes of query vectors in a round; a task holds about as much again for their results.
QUERY_BYTES = 32 << 20
#: Queries that are compared with a block at a time, and most bytes of the rows that are reranked for them.
QUERY_TILE, TILE_BYTES = 256, 64 << 20
SEED = 3


def eta(dimension: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))


def _cut(x: np.ndarray) -> np.ndarray:
    """(rows, pairs, 2): with zeros behind, for an even number of pairs."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(x), -1, 2)


def _codes(x: np.ndarray, centres: np.ndarray, weight: float) -> np.ndarray:
    """Codes of least anisotropic loss, a pair of dimensions at a time (coordinate descent)."""
    parts = _cut(x)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    apart = parts[:, :, None, :] - centres[None]  # residual of each pair for each centre
    square, along = (apart**2).sum(axis=3), (apart * unit[:, :, None, :]).sum(axis=3)
    codes = square.argmin(axis=2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(PASSES):
        for m in range(parts.shape[1]):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (square[:, m] + (weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
            total = rest + along[rows, m, codes[:, m]]
    return codes


def fit(x: np.ndarray) -> np.ndarray:
    """Centres (pairs, 16, 2) for the vectors: alternates codes and weighted least squares."""
    rng = np.random.default_rng(SEED)
    parts, weight = _cut(x), eta(x.shape[1])
    pairs = parts.shape[1]
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    centres = parts[rng.integers(0, len(x), (CENTRES, pairs)), np.arange(pairs)].transpose(1, 0, 2).copy()
    target_along = (parts * unit).sum(axis=(1, 2))
    size, flat = pairs * CENTRES * 2, unit.reshape(len(x), -1)
    for _ in range(ROUNDS):
        codes = _codes(x, centres, weight)
        place = ((np.arange(pairs)[None] * CENTRES + codes)[:, :, None] * 2 + np.arange(2)).reshape(len(x), -1)  # of each coordinate in the unknowns
        held = np.bincount(place.reshape(-1), minlength=size) + 1e-6
        back = lambda y: np.bincount(place.reshape(-1), weights=(flat * y[:, None]).reshape(-1), minlength=size)  # noqa: B023,E731
        right = (weight - 1) * back(target_along) + np.bincount(place.reshape(-1), weights=parts.reshape(-1), minlength=size) + 1e-6 * centres.reshape(-1)
        centres = _solved(lambda c: held * c + (weight - 1) * back((flat * c[place]).sum(axis=1)), right, centres.reshape(-1)).reshape(pairs, CENTRES, 2)  # noqa: B023
    return centres


def _solved(times, right: np.ndarray, start: np.ndarray, steps: int = 50) -> np.ndarray:
    """Conjugate gradients: the equations are never written out, as their matrix grows with the square of the dimension."""
    x, rest = start.copy(), right - times(start)
    way, size, enough = rest.copy(), rest @ rest, 1e-16 * (right @ right)
    for _ in range(steps):
        if size <= enough:
            break
        moved = times(way)
        far = size / (way @ moved)
        x += far * way
        rest -= far * moved
        now = rest @ rest
        way, size = rest + now / size * way, now
    return x


def encode(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    codes = np.concatenate([_codes(x[i : i + 1024], centres, eta(x.shape[1])) for i in range(0, len(x), 1024)]).astype(np.uint8)
    return codes[:, ::2] | codes[:, 1::2] << 4


def scan(queries: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows) from table look-ups."""
    table = np.einsum("qmd,mcd->qmc", _cut(queries), centres).astype(np.float32)
    two = (table[:, 1::2, :, None] + table[:, ::2, None, :]).reshape(len(queries), -1, 256)  # by byte
    out = np.zeros((len(queries), len(packed)), np.float32)
    for p in range(packed.shape[1]):
        out += two[:, p].take(packed[:, p], axis=1)
    return out


def decode(packed: np.ndarray, centres: np.ndarray, width: int) -> np.ndarray:
    """The vectors that the codes stand for."""
    codes = np.stack((packed & 15, packed >> 4), 2).reshape(len(packed), -1)
    return centres[np.arange(centres.shape[0])[None], codes].reshape(len(packed), -1)[:, :width]


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added up in the order of the dimensions."""
    return np.cumsum(x * query, axis=1)[:, -1]


def nearest(own: np.ndarray, x: np.ndarray, rep: np.ndarray, codes: np.ndarray, centres: np.ndarray, apart: np.ndarray, n: int, rerank: int, floor: np.ndarray | None = None, bound: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, the places and products of the n rows of largest exact product, ties by ``rep``.

    ``apart`` has the rows' distances from their codes' vectors. A row's product
    is at most the scanned one and that distance times the query's length; rows
    for which that is below ``floor`` (by query) or the n-th product are left
    out. Without ``bound`` the ``rerank`` best of the scan alone are scored.
    """
    rerank = max(rerank, n)
    more = None
    if len(x) <= rerank:  # every row is scored, which is what reranking comes to
        head = np.broadcast_to(np.arange(len(x)), (len(own), len(x)))
        exact = np.einsum("qrd,qd->qr", x[head], own)
    else:
        scanned = scan(own, codes, centres)
        head = np.argpartition(-scanned, rerank - 1, axis=1)[:, :rerank]
        exact = np.einsum("qrd,qd->qr", x[head], own)
        if bound:
            size, longest = np.linalg.norm(own, axis=1)[:, None], np.linalg.norm(x, axis=1)
            least = np.partition(exact, rerank - n, axis=1)[:, rerank - n, None] - 1e-9 * size * longest.max()
            if floor is not None:
                least = np.maximum(least, floor[:, None] - 1e-9 * size * longest.max())
            # rounding in single precision: far below 1e-5 of the lengths; what is not a number stays in
            more = ~(scanned + size * (apart + 1e-5 * (longest + apart)) < least)
            np.put_along_axis(more, head, False, 1)
            some = np.flatnonzero(more.any(axis=0))
            for at in range(0, len(some), 2048):
                rows = some[at : at + 2048]
                more[:, rows] &= ~(own @ x[rows].T + 1e-9 * size * longest[rows] < least)
    for i in range(len(own)):
        place, score = head[i], exact[i]
        if more is not None and more[i].any():
            rows = np.flatnonzero(more[i])
            place = np.concatenate((place, rows))
            score = np.concatenate((score, x[rows] @ own[i]))
        if len(place) > n:  # those that rounding may put among the n best
            last = np.partition(score, len(score) - n)[len(score) - n]
            place = place[score >= last - 1e-9 * np.linalg.norm(own[i]) * np.linalg.norm(x[place], axis=1).max()]
        score = products(x[place], own[i])
        best = np.lexsort((rep[place], -score))[:n]
        yield place[best], score[best]


def _matrix(column: pa.ChunkedArray | pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def usable(id: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return id.isNotNull() & vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``is_query``, its k nearest other rows."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    empty = "query_id long, rank int, vec_id long, score double"
    single = vectors.schema[vector].dataType.elementType == T.FloatType()  # singles are written as such, and are doubles in every product
    kind, width = ("float", np.float32) if single else ("double", np.float64)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(usable(F.col("id"), F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))  # one zero
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], empty)
    d, slots = most.d, spark.sparkContext.defaultParallelism
    hashes = {"h": F.xxhash64("v"), "g": F.xxhash64(F.reverse("v"), F.lit(1))}
    rows = ws.stage(rows.where(F.size("v") == d).withColumns(hashes), "rows")

    fit_on = rows.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS)
    sample = rows.join(F.broadcast(fit_on), "h").groupBy("h").agg(F.min("v").alias("v")).collect()
    centres = fit(np.array([r.v for r in sorted(sample)], np.float64))
    sent = spark.sparkContext.broadcast(centres)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                code = encode(x.astype(np.float64), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), part.column(3), part.column(4), _blobs(x.astype(width)), _blobs(code)], names=["rep", "rows", "h", "g", "vec", "code"]
                )

    classes = rows.groupBy("h", "v", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).select("v", "rep", "rows", "h", "g")
    parts = max(slots, -(-most.n * d * width().itemsize // (64 << 20)))
    coded_rows = classes.repartition(parts, "rep").mapInArrow(coded, "rep long, rows long, h long, g long, vec binary, code binary")
    base = ws.stage(coded_rows, "base")

    copies = rows.join(base.where("rows > 1").select("h", "g", "rep"), ["h", "g"]).select("rep", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).distinct()
    salted = Window.partitionBy("rep", "salt").orderBy("id")
    whole = Window.partitionBy("rep").orderBy("id")
    copies = copies.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    copies = copies.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("vec_id"))

    asked = ws.stage(rows.where("q").select(F.col("id").alias("query_id"), "v").distinct(), "asked")
    rounds = max(1, -(-asked.count() * d * 8 // QUERY_BYTES))
    near = None
    for turn in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == turn).toArrow()
        if not len(own):
            continue
        names, q = own["query_id"].to_numpy(), own["v"].combine_chunks().flatten().to_numpy().reshape(-1, d).astype(np.float64)
        found = ws.stage(base.select("rep", "vec", "code").mapInArrow(_scanning(spark.sparkContext.broadcast((names, q)), sent, d, width, k + 1, rerank), "query_id long, rep long, score double"), f"near{turn}")
        near = found if near is None else near.unionByName(found)
    if near is None:
        return spark.createDataFrame([], empty)
    near = near.join(copies, "rep", "left").select("query_id", F.coalesce("vec_id", "rep").alias("vec_id"), "score").where("query_id != vec_id")
    ranked = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _scanning(queries, centres, d: int, kind, n: int, rerank: int):
    """Rows (rep, vec, code) of a task to the n best of them for each query of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = queries.value
        score, best = np.full((len(q), n), -np.inf), np.full((len(q), n), np.iinfo(np.int64).max)
        held: list[pa.RecordBatch] = []

        def block() -> None:
            rows = pa.Table.from_batches(held)
            rep, x, codes = rows["rep"].to_numpy(), _matrix(rows["vec"], kind, d).astype(np.float64), _matrix(rows["code"], np.uint8, -(-d // 4))
            apart = np.linalg.norm(x - decode(codes, centres.value, d), axis=1)
            tile = max(1, min(QUERY_TILE, TILE_BYTES // (max(rerank, n) * d * 8)))
            for at in range(0, len(q), tile):
                floor = score[at : at + tile, -1]
                for i, (place, own) in enumerate(nearest(q[at : at + tile], x, rep, codes, centres.value, apart, n, rerank, floor), at):
                    both, who = np.concatenate((score[i], own)), np.concatenate((best[i], rep[place]))
                    order = np.lexsort((who, -both))[:n]
                    score[i], best[i] = both[order], who[order]

        for batch in batches:
            for at in range(0, len(batch), ROW_BLOCK):
                held.append(batch.slice(at, ROW_BLOCK))
                if sum(map(len, held)) >= ROW_BLOCK:
                    block()
                    held.clear()
        if held:
            block()
        at, place = np.nonzero(score > -np.inf)
        for some in range(0, len(at), 1 << 16):
            i, j = at[some : some + (1 << 16)], place[some : some + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(best[i, j]), pa.array(score[i, j])], names=["query_id", "rep", "score"])

    return run
