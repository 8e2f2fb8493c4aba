"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors: one for each word, one for each
run of 3 to 5 characters within a word and its edges, and one for a word that
repeats the word before it, each found by hash in a table of buckets. A
softmax over that mean gives the probability of label 1. Vectors and output
weights are trained by stochastic gradient descent in numpy.

Scoring uses that the output is linear in the mean: each bucket's vector is
multiplied with the output weights once, so a document's logit is a mean of
looked-up numbers.

Defined results: null, empty and wordless texts have no feature and get the
probability that the bias alone gives; repeated rows score alike; an empty
table gives an empty result; with training rows of one label only, the score
is that label's share (smoothed). The result column replaces a column of the
same name; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import BASE, labelled_sample, mixed, pieces, powers, small_batches, word_hashes

#: Most labelled documents that the model is trained on.
SAMPLE_ROWS = 4_000
#: Buckets of the feature table (a power of two), size of the vectors, epochs, first learning rate.
BUCKETS, SIZE, EPOCHS, RATE = 1 << 17, 8, 8, 0.5
#: Lengths in characters of the runs within words.
GRAMS = (3, 4, 5)
SEED = 20240501


def features(raw: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of the features of a text: of its words, then of the runs of characters, a piece at a time."""
    rest, before = pieces(raw), b" "
    part = next(rest)
    if len(part) < len(raw):
        yield from _of_words(word_hashes(raw))
    while part is not None:
        after = next(rest, None)
        b = np.frombuffer(before + part + (b" " if after is None else b""), np.uint8)
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        up, down = powers(len(b) + 1)
        value = np.where(gap, np.uint64(33), b.astype(np.uint64) + np.uint64(1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[:-1], dtype=np.uint64)))
        if len(part) == len(raw):
            edge = np.flatnonzero(gap[1:] != gap[:-1])
            start, end = edge[::2] + 1, edge[1::2] + 1
            if not len(start):
                return
            yield from _of_words(mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        ascii = len(before) == 1 and part.isascii()
        at = None if ascii else np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))  # where characters begin
        n_chars = len(b) if ascii else len(at) - 1
        old = 1 if len(before) == 1 else int(np.searchsorted(at, len(before)))  # characters of the piece before
        gaps = np.concatenate((np.zeros(1, np.int32), np.cumsum(gap if ascii else gap[at[:-1]], dtype=np.int32)))  # by character
        for n in GRAMS:
            least = max(0, old - n + 1)  # those before ended in the piece before
            if n_chars - n >= least:  # only the edges may be white space
                first = least + np.flatnonzero(gaps[least + n - 1 : n_chars] == gaps[least + 1 : n_chars - n + 2])
                start, end = (first, first + n) if ascii else (at[first], at[first + n])
                yield bucket((sums[end] - sums[start]) * down[start], n)
            else:
                yield np.zeros(0, np.int32)
        keep = max(0, n_chars - max(GRAMS) + 1)
        before, part = bytes(b[keep if ascii else at[keep] :]), after


def _of_words(words: np.ndarray) -> Iterator[np.ndarray]:
    yield bucket(words, 1)
    again = np.count_nonzero(words[1:] == words[:-1])
    if again:
        yield bucket(np.zeros(again, np.uint64), 2)


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(h + np.uint64(kind * BASE & (1 << 64) - 1)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


@dataclass
class Model:
    #: Logit that each bucket adds to the mean, and the bias.
    logits: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for ids in features((text or "").encode("utf-8", "surrogatepass")):
            total += float(self.logits[ids].sum(dtype=np.float64))
            n += len(ids)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn(texts: list[str], y: np.ndarray) -> Model:
    """The model with its vectors folded into the output weights."""
    vectors, out, bias = train(texts, y)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output weights and biases, by stochastic gradient descent over the documents, one at a time."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = np.array([0.0, np.log(share / (1 - share))])
    if len(set(y.tolist())) < 2:
        return np.zeros((BUCKETS, SIZE), np.float32), np.zeros((SIZE, 2), np.float32), bias
    bags = []
    for text in texts:
        counts = [np.unique(ids, return_counts=True) for ids in features(text.encode("utf-8", "surrogatepass"))]
        if counts:
            ids, n = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts])
            bags.append((ids, (n / n.sum()).astype(np.float32)))
        else:
            bags.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    out = np.zeros((SIZE, 2), np.float32)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, share_of = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            rows = vectors[ids]
            mean = share_of @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            pull = out @ p.astype(np.float32)
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # every vector moves by its share, scaled up as a mean of many features moves little
            vectors[ids] = rows - np.float32(rate * 20) * share_of[:, None] * pull
    return vectors, out, bias


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, rows: int = SAMPLE_ROWS) -> Model:
    """Trains on at most ``rows`` labelled documents outside the held-out fold."""
    return learn(*labelled_sample(docs, labels, "quality", parts, held, rows))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """Adds ``into``: probability of label 1. No shuffle; one pass over whole texts."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.logits, model.bias))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*sent.value)
        for batch in batches:
            yield pa.array([own.score(batch[i].as_py()) for i in range(len(batch))], pa.float64())

    return docs.withColumn(into, scored(F.col(text)))
