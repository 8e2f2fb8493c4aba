"""Near duplicates: MinHash signatures and a multi-index Hamming join.

A document's set is its distinct word shingles. Its signature has SYMBOLS
symbols of BITS bits, each the low bits of a MinHash. Two signatures whose
distance (symbols that differ) is at most DISTANCE are always found: with
CHUNKS chunks, at least one chunk holds at most ERRORS of the errors
(pigeonhole), so for every chunk and every choice of ERRORS symbols left out
there is a key, and such a pair shares one. DISTANCE is CHUNKS * (ERRORS + 1) - 1.
At a Jaccard similarity of 0.8 a pair is further apart about once in 200,000.
Links are confirmed on the full sets.

A found pair passes on only if its sketches allow the similarity: a sketch has
the parity, bit by bit, of how many shingles fall on each bit, so the bits in
which two sketches differ are never more than the shingles in which the sets
differ. This bound rejects no true link. What passes is confirmed on the full
sets.

No step holds a group of unbounded size:
  1. documents with equal sets are one class (grouped minima);
  2. in ROUNDS rounds, each key's documents are compared with one leader of the
     key, each document is confirmed against the likeliest of its leaders, and
     links are joined to components: linear work, which takes up groups of
     copies. Leaders follow a few hash orders, others in each round;
  3. only keys that still hold several components are compared pair by pair,
     in blocks of BLOCK rows, and only pairs of different components within
     DISTANCE are confirmed, each pair once.
Every pair within DISTANCE is then confirmed or in one component already.

Sketches and texts of the pairs' documents alone are shuffled, nearly: a bit map
of their hashes lets through one other row in some WANTED / (their number). It
is flat up to some WANTED wanted documents; beyond that all rows are shuffled
once a join, which is linear and needs no memory.

Defined results: null, empty and wordless texts have an empty set and are
linked with nothing; rows with equal sets are linked; repeated rows each get a
row; of rows with one identifier and different sets each has its own
component; rows without identifier are kept, link nothing, and have the component
of their set if others have it, else none; an empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specweave.llm.common import BASE, free, mixed, shingle_hashes, small_batches, word_hashes
from specweave.llm.components import components
from specweave.workspace import Workspace

SYMBOLS, BITS, CHUNKS, ERRORS = 48, 16, 12, 1
WIDTH = SYMBOLS // CHUNKS
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Rows of a key that are compared with as many others at a time.
BLOCK = 256
#: Rounds of comparing with leaders, and orders that leaders follow in a round.
ROUNDS, ORDERS = 2, 3
#: Least bits of a sketch; it has 4 bits a shingle at least. Blocks are compared on sketches folded to this.
SKETCH_BITS = 1024
#: Bits of the filter of wanted identifiers, which is broadcast as a table of 64 bits a row: WANTED / 64 rows at most.
WANTED = 1 << 26
SEED = 71


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z are lower-cased first."""
    return shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass").lower()), size)


def signature(shingles: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, SYMBOLS, np.uint64)
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        least = np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The keys of each signature: chunk and left-out symbol are in the low bits."""
    parts = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(parts), CHUNKS, WIDTH), np.uint64)
    for left in range(WIDTH):
        h = np.zeros(parts.shape[:2], np.uint64)
        for i in range(WIDTH):
            if i != left:
                h = h * np.uint64(BASE) + parts[:, :, i] + np.uint64(1)
        out[:, :, left] = h
    n = CHUNKS * WIDTH
    number = np.arange(n, dtype=np.uint64).reshape(CHUNKS, WIDTH)
    out = mixed(out + number * np.uint64(BASE))
    return ((out << np.uint64(6)) | number).reshape(-1, n).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    bits = max(SKETCH_BITS, 1 << (4 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """The sketch of fewer bits that the same shingles have."""
    x = np.frombuffer(raw, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def possible(differ, n, percent: int):
    """Whether sets of ``n`` shingles together, of which ``differ`` at least are in one alone, can be similar enough."""
    shared = (n - differ) // 2
    return 100 * shared >= percent * (n - shared)


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig, bits = [], [], [], []
            texts = batch.column(1)
            for i in range(len(texts)):
                shingles = shingle_set(texts[i].as_py(), size)
                some = len(shingles) > 0
                n.append(len(shingles))
                digest.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if some else None)
                sig.append(signature(shingles).tobytes() if some else None)
                bits.append(sketch(shingles) if some else None)
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, sig, bits))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "n", "digest", "sig", "sketch"])

    return run


@F.arrow_udf(T.ArrayType(T.LongType()))
def _keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for sig in batches:
        if not len(sig):
            yield pa.array([], pa.list_(pa.int64()))
            continue
        keys = keys_of(np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(len(sig), SYMBOLS))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))


def _alike(percent: int):
    """Bits in which two sketches differ; -1 where the sets cannot be similar enough."""

    @F.arrow_udf("int")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two, n in batches:
            out = []
            for a, b, total in zip(one.to_pylist(), two.to_pylist(), n.to_pylist()):
                size = min(len(a), len(b))
                differ = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
                out.append(differ if possible(differ, total, percent) else -1)
            yield pa.array(out, pa.int32())

    return run


@F.arrow_udf(T.BinaryType())
def _short(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([folded(x, SKETCH_BITS // 8).tobytes() for x in batch.to_pylist()], pa.binary())


def _linked(size: int, percent: int):
    """Whether two texts' full sets are similar enough."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            out, last, held = [], None, None
            for i in range(len(one)):
                a, b = one[i].as_py(), two[i].as_py()
                if a != last:  # a leader's pairs often stand together
                    last, held = a, shingle_set(a, size)
                other = shingle_set(b, size)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                out.append(100 * shared >= percent * (len(held) + len(other) - shared))
            yield pa.array(out, pa.bool_())

    return run


def _cross(percent: int):
    """Pairs of different components within DISTANCE that can be similar. Rows come sorted by key, lo, hi (the group)."""
    names = ["key", "lo", "hi", "block", "rep", "comp", "n"]

    def pairs(x: dict, start: int, end: int) -> np.ndarray:
        i, j = np.triu_indices(end - start, 1)
        i, j = i + start, j + start
        ok = x["comp"][i] != x["comp"][j]
        if x["lo"][start] != x["hi"][start]:
            ok &= x["block"][i] != x["block"][j]
        i, j, found = i[ok], j[ok], []
        number = int(x["key"][start]) & 63
        for at in range(0, len(i), 1 << 15):
            p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            errors = x["sig"][p] != x["sig"][q]
            near = errors.sum(axis=1) <= DISTANCE
            p, q, errors = p[near], q[near], errors[near].reshape(-1, CHUNKS, WIDTH)
            wrong = errors.sum(axis=2)
            first = (wrong <= ERRORS).argmax(axis=1)  # a pair counts at the first key that it shares
            at_first = errors[np.arange(len(p)), first].argmax(axis=1)
            mine = first * WIDTH + at_first == number
            p, q = p[mine], q[mine]
            differ = np.bitwise_count(x["short"][p] ^ x["short"][q]).sum(axis=1).astype(np.int64)
            mine = possible(differ, x["n"][p] + x["n"][q], percent)
            found.append(np.stack((x["rep"][p[mine]], x["rep"][q[mine]]), axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def done(x: dict, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [pairs(x, a, b) for a, b in zip(ends, ends[1:]) if b - a > 1]
        rows = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows.min(axis=1)), pa.array(rows.max(axis=1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not len(batch):
                continue
            x = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            x["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            x["short"] = np.frombuffer(b"".join(batch.column("short").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
            if left is not None:
                x = {k: np.concatenate((left[k], v)) for k, v in x.items()}
            new = (np.diff(x["key"]) != 0) | (np.diff(x["lo"]) != 0) | (np.diff(x["hi"]) != 0)
            ends = np.concatenate(([0], np.flatnonzero(new) + 1))
            yield from done(x, ends)
            left = {k: v[ends[-1] :] for k, v in x.items()}
        if left is not None:
            yield from done(left, np.array([0, len(left["rep"])]))

    return run


def only(df: DataFrame, key: Column, wanted: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Nearly only the rows of ``df`` whose ``key`` is in a column of ``wanted`` (all of them, and a few others),
    or with ``inside=False`` the rest. No shuffle of ``df``: a bit map of WANTED bits at most is broadcast."""
    word, bits, at = (free(df.columns, c) for c in ("__word", "__bits", "__at"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(WANTED))
    bit = lambda p: F.expr(f"shiftleft(1L, cast({p} & 63 as int))")
    marks = wanted.select(place(F.col(column)).alias("p")).select(F.shiftright("p", 6).alias(word), bit("p").alias("b")).groupBy(word).agg(F.bit_or("b").alias(bits))
    held = df.withColumn(at, place(key)).join(F.broadcast(marks), F.shiftright(at, 6) == F.col(word), "left")
    found = F.coalesce(F.col(bits).bitwiseAND(bit(at)) != 0, F.lit(False))
    return held.where(found if inside else ~found).select(*df.columns)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", detail: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Documents with 100 * intersection >= percent * union of their shingle sets
    are linked; ``component_id`` is the smallest identifier reachable. With
    ``detail``, xxhash64 of the text and a digest of the set follow.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "neardup")
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    features = ws.stage(source.mapInArrow(_features(size), "id long, hash long, n long, digest binary, sig binary, sketch binary"), "features")
    known = features.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest")
    reps = ws.stage(known.agg(F.min(F.struct("id", "hash")).alias("own"), *(F.first(c).alias(c) for c in ("n", "sig", "sketch"))).select("own.*", "digest", "n", "sig", "sketch"), "classes")
    # a class is known by the smallest identifier that has it; classes that share theirs, as one identifier has
    # several texts, get a hash instead (which is another identifier about once in 2**64 / identifiers)
    clash = ws.stage(reps.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("id").alias("rep"), F.lit(True).alias("__clash")), "clash")
    clashes = not clash.isEmpty()
    reps = reps.withColumn("rep", F.col("id"))
    if clashes:
        reps = reps.join(clash, "rep", "left").withColumn("rep", F.when(F.col("__clash"), F.xxhash64("id", "digest")).otherwise(F.col("id"))).drop("__clash")
        reps = ws.stage(reps, "reps")
    alike = _alike(percent)

    def order(number: int):
        """The order that a key's leader is first in; keys of one order tend to agree on it."""
        return F.xxhash64("rep", F.pmod("key", F.lit(64)) % ORDERS, F.lit(number))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("x"))

    def told(pairs: DataFrame, classes: DataFrame, column: str) -> DataFrame:
        """Adds a column of the class of each end."""
        for c in "ab":
            pairs = pairs.join(classes.select(F.col("rep").alias(c), F.col(column).alias(f"{column}_{c}")), c)
        return pairs

    def candidates(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, differ): the pairs whose sizes and sketches allow the similarity. Sizes come first, as they rule most pairs out."""
        sized = told(pairs, reps, "n").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        sized = ws.stage(sized, f"{name}-sized")
        sketched = told(sized, only(reps.select("rep", "sketch"), F.col("rep"), ends(sized), "x"), "sketch")
        differ = sketched.select("a", "b", alike("sketch_a", "sketch_b", F.col("n_a") + F.col("n_b")).alias("differ"))
        near = ws.stage(differ.where("differ >= 0"), name)
        ws.drop(f"{name}-sized")
        return near

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b): those whose full sets are similar enough. Texts are shuffled, as they compress and sets do not."""
        wanted = ends(pairs)
        if clashes:
            wanted = wanted.join(reps.select("rep", "id", "hash"), F.col("x") == F.col("rep")).select("x", "id", "hash")
            texts = only(source, F.col("id"), wanted, "id").join(wanted, ["id", "hash"]).groupBy("x").agg(F.first("text").alias("text"))
        else:
            texts = only(source, F.col("id"), wanted, "x").select(F.col("id").alias("x"), "text")
        texts = ws.stage(texts, f"{name}-texts")
        both = pairs.select("a", "b")
        for c in "ba":
            both = both.join(texts.select(F.col("x").alias(c), F.col("text").alias(f"text_{c}")), c)
        links = ws.stage(both.where(_linked(size, percent)("text_a", "text_b")).select("a", "b").distinct(), f"{name}-links")
        ws.drop(f"{name}-texts")
        return links

    steps: list[DataFrame] = []  # each maps roots of the components so far to larger ones' roots

    def rooted(df: DataFrame, column: str) -> DataFrame:
        for step in steps:
            df = df.join(step.select(F.col("node").alias(column), F.col("root").alias("__root")), column, "left")
            df = df.withColumn(column, F.coalesce("__root", column)).drop("__root")
        return df

    def join_up(links: DataFrame, name: str) -> None:
        steps.append(components(rooted(rooted(links, "a"), "b"), ws, name))

    keyed = reps.select("rep", F.explode(_keys("sig")).alias("key"))
    leader = F.min_by("rep", order(0)).alias("leader")
    leaders = ws.stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), leader).where("rows > 1").drop("rows"), "leaders0")
    members = ws.stage(keyed.join(leaders, "key"), "members0")
    for turn in range(ROUNDS):
        pairs = members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
        near = candidates(pairs, f"near{turn}")
        best = near.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("best")).select("best.a", "b")
        join_up(confirmed(ws.stage(best, f"best{turn}"), f"turn{turn}"), f"joined{turn}")
        held = ws.stage(rooted(members.select("key", "rep", F.col("rep").alias("comp")), "comp"), f"held{turn}")
        several = held.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("rows"), F.min_by("rep", order(turn + 1)).alias("leader"))
        leaders = ws.stage(several.where("c1 != c2").select("key", "leader", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), f"leaders{turn + 1}")
        members = ws.stage(held.join(leaders, "key"), f"members{turn + 1}")
        ws.drop(f"leaders{turn}", f"members{turn}", f"near{turn}", f"best{turn}", f"held{turn}")

    rows = members.join(reps.select("rep", "n", "sig", _short("sketch").alias("short")), "rep")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "comp", "n", "sig", "short")
    pairs = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_cross(percent), "a long, b long")
    near = candidates(ws.stage(pairs, "cross"), "near-cross")
    join_up(confirmed(near, "last"), "joined-last")

    found = rooted(reps.select("digest", "id", F.col("rep").alias("component")), "component")
    if clashes:  # roots can be hashes
        found = ws.stage(found, "rooted")
        found = found.join(found.groupBy("component").agg(F.min("id").alias("least")), "component").withColumn("component", F.col("least"))
    found = ws.stage(found.select("digest", "component"), "found")
    ws.drop("classes", "clash", "reps", "rooted", f"leaders{ROUNDS}", f"members{ROUNDS}", "cross", "near-cross")
    out = features.select("id", "hash", "n", "digest").join(found, "digest", "left")
    component = F.coalesce("component", "id")
    more = [F.col("hash").alias("text_hash"), "digest"] if detail else []
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *more)
