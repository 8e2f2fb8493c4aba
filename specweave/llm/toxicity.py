"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Text is folded (case, look-alike letters of other scripts, digits and signs
that stand for letters), cut into words, and matched against the lexicon in
one automaton pass. Weights add up, matches inside an exception phrase do not
count, the sum is normalised by length, and a logistic curve maps both to 0-1.

The lexicon is learned: entries are whole words and beginnings of words whose
log odds between toxic and other training documents are high; exceptions are
longer words that contain an entry but occur in other documents as well.
Seed entries and exception phrases can be given besides.

Defined results: null, empty and wordless texts have no match and score what
the curve gives no match (near 0); repeated rows score alike; an empty table
gives an empty result; without toxic training rows nothing is toxic. The
result column replaces a column of the same name; other columns stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import labelled_sample, logistic, small_batches

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Digits and signs written for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
# Characters of no width.
INVISIBLE = "­​‌‍⁠﻿"

#: Most labelled documents that the lexicon is learned from.
SAMPLE_ROWS = 8_000
#: Lengths of the word beginnings that can become entries.
PREFIXES = range(4, 9)
#: An entry is in this share of the toxic training documents, and in this many, at least; near copies count once.
SHARE, LEAST = 0.01, 4
#: Near copies share the smallest hash of their words that are in at most these shares of the
#: documents: the first sorts out small groups of copies, the second those of up to that share.
RARE = (0.01, 0.4)
#: Least log odds of an entry. Entries below this share of the largest need a document that no stronger one is in.
ODDS, STRONG = 3.0, 0.6
#: A longer beginning replaces a shorter one if it keeps this share of its toxic documents and is in fewer others.
KEEP = 0.9

_LOOK = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE}
_LETTERS = str.maketrans(SIGNS)
# From a sign that becomes a letter on: digits do beside a letter, other signs before one, and so
# on from each that has become one. Possessive and tied to the start of a run of signs, so that it
# takes linear time on any text.
_SIGNED = re.compile(r"[013-57-9@$!|](?:(?<=[^\W\d_][013-57-9])|(?<![013-57-9@$!|][013-57-9@$!|])[013-57-9@$!|]*+[^\W\d_])(?:[^\W\d_]|[013-57-9]|[013-57-9@$!|]++[^\W\d_])*+")
_ODD = re.compile(r"[0-9@$!|]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Words of the text in skeleton form, each between single spaces.

    ``l`` and ``i`` share one form, as ``1``, ``!`` and ``|`` stand for either.
    """
    t = text.lower()
    if not t.isascii():
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t).lower()
        if max(t) > "\xff":
            t = t.translate(_LOOK)
        elif "\xad" in t:
            t = t.replace("\xad", "")
    if _ODD.search(t):
        t = _SIGNED.sub(lambda m: m[0].translate(_LETTERS), t)
    return f" {' '.join(_WORD.findall(t))} ".replace("l", "i")


class Lexicon:
    """Weighted entries, exception phrases and the curve. Strings are in folded form;
    a leading or trailing space anchors them to the edge of a word."""

    def __init__(self, entries: dict[str, float], exceptions=(), curve=(-6.0, 0.0, 0.0)):
        self.entries, self.exceptions, self.curve = dict(entries), sorted(exceptions), tuple(curve)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for s in self.exceptions:
            found.add_word(s, (len(s), None))
        for s, w in self.entries.items():
            found.add_word(s, (len(s), w))
        if len(found):
            found.make_automaton()
        return found

    def measure(self, text: str | None, machine) -> tuple[float, int, int]:
        """Sum of weights, matches that count, words."""
        if not text:
            return 0.0, 0, 0
        folded = fold(text)
        words = folded.count(" ") - 1 if folded != "  " else 0
        if not len(machine):
            return 0.0, 0, words
        hits, spared = [], []
        for end, (n, weight) in machine.iter(folded):
            (spared if weight is None else hits).append((end - n + 1, end + 1, weight))
        if spared and hits:
            spared.sort()
            starts, reach = [a for a, *_ in spared], list(accumulate((b for _, b, _ in spared), max))  # how far those that begin so early reach
            hits = [h for h in hits if not (n := bisect_right(starts, h[0])) or reach[n - 1] < h[1]]
        best: dict[int, float] = {}
        for start, _, weight in hits:  # entries that begin at one place are one match
            best[start] = max(weight, best.get(start, weight))
        return sum(best.values()), len(best), words

    def score(self, total: float, words: int) -> float:
        a, b, c = self.curve
        z = a + b * math.log1p(total) + c * math.log1p(100 * total / (words + 20))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _codes(folded: str) -> np.ndarray:
    """20-bit codes of a folded text's distinct words."""
    return np.unique(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) & 0xFFFFF for w in set(folded.split())], np.int32))


def learn(texts: list[str], y: np.ndarray, seeds: dict[str, float] | None = None, exceptions=()) -> Lexicon:
    """Entries, exceptions and curve from training texts and 0/1 labels."""
    given = {f" {fold(k).strip()} ": w for k, w in (seeds or {}).items()}
    spared = {f" {fold(x).strip()} " for x in exceptions}
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    if not n_pos or not n_neg:
        return Lexicon(given, spared)
    folded = [fold(t) for t in texts]
    coded = [_codes(text) for text in folded]
    rarity = np.zeros(1 << 20, np.int32)
    for codes in coded:
        rarity[codes] += 1
    groupings: list[list[int]] = [[] for _ in RARE]
    for i, codes in enumerate(coded):
        for share, families in zip(RARE, groupings):
            rare = codes[rarity[codes] <= max(2, share * len(texts))]
            families.append(int(rare.min()) if len(rare) else -1 - i)
    n_pos, n_neg = (min(len({f for f, v in zip(families, y) if v == label}) for families in groupings) for label in (1, 0))
    vocabulary = [{w for text, v in zip(folded, y) if v == label for w in text.split()} for label in (0, 1)]

    def counted(label: int, parts) -> Counter:
        """Families of documents of that label that have each part of a word: the fewest by any grouping."""
        fewest: Counter | None = None
        having = {w: found for w in vocabulary[label] if (found := parts(w))}
        words = having.keys()
        for families in groupings:
            here: Counter = Counter()
            rows = sorted((family, i) for i, (family, v) in enumerate(zip(families, y)) if v == label)
            for _, own in groupby(rows, lambda r: r[0]):  # a family's words at a time
                here.update({x for w in {w for _, i in own for w in folded[i].split()} & words for x in having[w]})
            fewest = here if fewest is None else Counter({k: n for k in here if (n := min(here[k], fewest[k]))})
        return fewest

    def odds(p: int, n: int) -> float:
        return math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))

    least = max(LEAST, SHARE * n_pos)
    parts = lambda w: [f" {w} ", *(f" {w[:n]}" for n in PREFIXES if len(w) >= n)]
    positive = {s: p for s, p in counted(1, parts).items() if p >= least}
    negative = counted(0, lambda w: [s for s in parts(w) if s in positive])
    loose = {  # beginnings that a longer one replaces, which loses few toxic documents and some of the others
        head for s, p in positive.items() for n in PREFIXES
        if (head := s[: n + 1]) != s and p >= KEEP * positive.get(head, math.inf) and negative[s] < negative[head]
    }
    entries: dict[str, float] = {}
    for s, p in sorted(positive.items(), key=lambda x: (x[0][-1] == " ", len(x[0]), x[0])):  # a short beginning makes the longer ones needless
        if s not in loose and (w := odds(p, negative[s])) >= ODDS and not any(s[: n + 1] in entries for n in PREFIXES if n + 1 < len(s)):
            entries[s] = w
    strong = {s for s, w in entries.items() if w >= STRONG * max(entries.values())}
    alone: Counter = Counter()  # documents that no strong entry explains
    for text, v in zip(folded, y):
        if v == 1:
            found = {s for w in set(text.split()) for s in parts(w) if s in entries}
            if not found & strong:
                alone.update(found)
    entries = {s: w for s, w in entries.items() if s in strong or alone[s]}
    begun = lambda w: [f" {w} "] if any(f" {w[:n]}" in entries for n in PREFIXES if n <= len(w)) else []
    toxic = counted(1, begun)
    spared |= {s for s, n in counted(0, begun).items() if n >= 2 and odds(toxic[s], n) < 0}  # harmless words that begin as an entry does
    made = Lexicon(given | entries, spared)
    machine = made.automaton()
    x = np.array([[1.0, math.log1p(t), math.log1p(100 * t / (w + 20))] for t, _, w in (made.measure(t, machine) for t in texts)])
    made.curve = tuple(logistic(x, y))
    return made


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, seeds=None, exceptions=()) -> Lexicon:
    """Learns from at most ``rows`` labelled documents outside the held-out fold."""
    return learn(*labelled_sample(docs, labels, "toxic", parts, held, rows), seeds, exceptions)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Adds ``into``: struct of score, matches, words. No shuffle; one pass over whole texts."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon.entries, lexicon.exceptions, lexicon.curve))

    @F.arrow_udf("struct<score: double, matches: int, words: int>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Lexicon(*sent.value)
        machine = own.automaton()
        for batch in batches:
            got = [own.measure(batch[i].as_py(), machine) for i in range(len(batch))]
            yield pa.StructArray.from_arrays(
                [pa.array([own.score(t, w) for t, _, w in got], pa.float64()), pa.array([m for _, m, _ in got], pa.int32()), pa.array([w for *_, w in got], pa.int32())],
                names=["score", "matches", "words"],
            )

    return docs.withColumn(into, measured(F.col(text)))
