"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.workspace import Workspace

#: Bytes that separate words in the contracts of this subpackage: 0x20 and 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Odd multipliers of the rolling hashes.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
U64 = (1 << 64) - 1


#: Most rows and bytes of an Arrow batch: executors hold several batches of texts at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Most bytes of text that a sample on the driver has.
SAMPLE_BYTES = 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which are large for texts by default; never raises a smaller bound."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1:], 1)
    if int(size.rstrip("kmg")) * unit > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def free(taken: list[str], name: str) -> str:
    """A name for a work column that no column has."""
    while name in taken:
        name += "_"
    return name


def fold_of(column: str, parts: int):
    """Rows' fold: crc32 of the identifier as text, modulo ``parts`` (-1 where it is null)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts)), F.lit(-1))


def bounded_rows(docs: DataFrame, wanted: DataFrame, columns: list[str], id: str, most: int) -> pa.Table:
    """On the driver: for each identifier of ``wanted`` (few rows) one row of ``docs``, the least by
    ``columns``, of which the first is a text, in order of the identifiers' hashes. Rows whose
    texts would pass ``most`` bytes together are left out, so neither repeated
    identifiers nor long texts make the result larger than that.
    """
    ws = Workspace(docs.sparkSession, "sample")
    least = docs.select(id, F.struct(*columns).alias("__row")).join(F.broadcast(wanted), id).groupBy(*wanted.columns).agg(F.min("__row").alias("__row"))
    least = ws.stage(least.select(*wanted.columns, "__row.*", F.octet_length(f"__row.{columns[0]}").alias("__bytes"), F.xxhash64(id).alias("__hash")), "rows")
    sizes = sorted((r["__hash"], r[id], r["__bytes"]) for r in least.select("__hash", id, "__bytes").collect())
    taken, total = [], 0
    for _, key, n in sizes:
        if total + n <= most:
            total += n
            taken.append(key)
    if len(taken) < len(sizes):
        least = least.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in taken], wanted.select(id).schema)), id)
    got = least.drop("__bytes").orderBy("__hash", id).drop("__hash").toArrow()
    ws.close()
    return got


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, rows: int, most: int = SAMPLE_BYTES):
    """At most ``rows`` labelled training documents as ``(texts, labels)`` on the driver.

    Rows whose fold is ``held`` never take part. A document labelled more than
    once counts with its largest label, an identifier of several texts with the
    first of them. The sample is the documents of smallest identifier hash, so
    it is the same for any partitioning; repeated texts count once. ``rows``
    and ``most`` bytes of text are what bounds the driver's memory.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", parts) != held))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    got = bounded_rows(docs.where(F.col("text").isNotNull()), ids, ["text"], "doc_id", most)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    seen, out_t, out_y = set(), [], []
    for i in order.tolist():
        text, own = got.column("text")[i].as_py(), got.column("__label")[i].as_py()
        key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in seen:
            seen.add(key)
            out_t.append(text)
            out_y.append(own)
    return out_t, np.array(out_y, dtype=np.float64)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Newton's method; ``times`` is how often each row counts. The slopes are held back a little, so that separable data end as well."""
    beta, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (times * (y - p)) - hold * beta
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-9), grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


_POWERS: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n. The longest made is kept by the process."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 14), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


def pieces(raw: bytes, limit: int = 1 << 20):
    """The bytes in pieces of about ``limit``, cut at white space, or between characters within a
    word longer than that. Long texts are processed whole, a piece at a time."""
    at, n = 0, len(raw)
    while n - at > limit:
        cut = max(raw.rfind(bytes([s]), at, at + limit) for s in SPACES)
        if cut <= at:
            cut = at + limit
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the bytes, in order. Words are runs without SPACES, of any length."""
    out, held, size = [], np.uint64(0), 0  # sum and length of a word that goes on in the next piece

    def close() -> None:
        if size:
            out.append(mixed(np.array([held], np.uint64) + np.uint64(size)))

    for part in pieces(raw):
        b = np.frombuffer(part, np.uint8)
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        if size and (not len(start) or start[0]):
            close()
            held, size = np.uint64(0), 0
        if not len(start):
            continue
        up, down = powers(len(b) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        value, length = (sums[end] - sums[start]) * down[start], (end - start).astype(np.uint64)
        if size:
            value[:1] = value[:1] * np.uint64(pow(BASE, size, 1 << 64)) + held
            length[0] += np.uint64(size)
        held, size = np.uint64(0), 0
        if end[-1] == len(b):
            held, size = value[-1], int(length[-1])
            value, length = value[:-1], length[:-1]
        out.append(mixed(value + length))
    close()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of the runs of ``size`` words, sorted; of the whole sequence, if shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        h = h * np.uint64(BASE) + words[i : len(words) - size + 1 + i]
    return np.unique(mixed(h))
