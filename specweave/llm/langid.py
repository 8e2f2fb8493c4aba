"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased; runs of anything but letters become one space. For every
language the four-character sequences of all training texts are counted across
the cluster. Orders 3 to 1 use continuation counts, every order takes off a
discount and gives what it took to the next lower one, and order 1 shares with
a uniform distribution. All languages' models are one set of sorted arrays of
64-bit hashes, a column of log probabilities a language, found by binary search.

The language of least cross-entropy a character wins. The score is the
probability that it is right, by a logistic curve over the lead on the second
language in nats, fitted on short pieces of all training texts; ``rejected`` is set
where the score is below 0.5 or the cross-entropy is far beyond that of the
language's training texts.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties go to the language that sorts first; repeated rows count as often as
they occur; rows without language or identifier do not train; without training
rows everything is ``und``; an empty table gives an empty result. Result
columns replace columns of the same names; other columns stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import fold_of, free, logistic, mixed, small_batches

ORDER = 4
#: Lengths of the pieces of the training texts that the curve is fitted on.
PIECES = (4, 8, 16, 32, 64)
#: Parts of one in which leads and cross-entropies are added up: whole numbers, so their order means nothing.
LEAD_PARTS, ENTROPY_PARTS = 1_000, 10_000
#: Characters that are handled at a time.
PIECE = 1 << 20
UNKNOWN = "und"
_LETTER: list = []


def letters(text: str | None) -> np.ndarray:
    """Codes of the characters: letters as they are (beyond 16 bits as 0xFFFF), one space for the rest, spaces around."""
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[0][code]
    code = np.where(letter, np.minimum(code, 0xFFFF), 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays as a space
    space = np.array([32], np.uint64)
    code = np.concatenate((space, code[keep], space))
    return code if letter.any() else space[:0]


def sequences(code: np.ndarray) -> np.ndarray:
    """The sequences of four characters, 16 bits each; short texts are led by more spaces."""
    if not len(code):
        return code
    code = np.concatenate((np.full(ORDER - 2, 32, np.uint64), code))
    out = np.zeros(len(code) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        out = out << np.uint64(16) | code[i : len(code) - ORDER + 1 + i]
    return out


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, seq, n) of all sequences; added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pd.Series] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(n.index.to_numpy()), pa.array(n.to_numpy(), pa.int64())], names=["lang", "seq", "n"])
            held.clear()

        def add(name: str, parts: list[np.ndarray]) -> None:
            n = pd.Series(np.concatenate(parts).view(np.int64)).value_counts(sort=False)
            held[name] = held[name].add(n, fill_value=0).astype(np.int64) if name in held else n

        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            for i in range(len(batch)):
                parts = waiting.setdefault(batch.column(1)[i].as_py(), [])
                parts.append(sequences(letters(batch.column(0)[i].as_py())))
                if sum(map(len, parts)) > PIECE:
                    add(batch.column(1)[i].as_py(), parts)
                    parts.clear()
            for name, parts in waiting.items():
                if parts:
                    add(name, parts)
            if sum(map(len, held.values())) > 2_000_000:
                yield from out()
        yield from out()

    return docs.select(text, lang).mapInArrow(run, "lang string, seq long, n long").groupBy("lang", "seq").agg(F.sum("n").alias("n"))


class Model:
    """Sorted hash arrays of the orders, with log probabilities and back-off weights by language."""

    def __init__(self, langs: list[str], levels: list, uniform: np.ndarray):
        #: levels: for orders 4 to 1, (hashes, log probabilities); for the contexts, (hashes, log weights)
        self.langs, self.levels, self.uniform = langs, levels, uniform
        self.curve, self.limits = np.array([0.0, 1.0]), np.full(len(langs), np.inf)

    @classmethod
    def of(cls, table: pd.DataFrame) -> Model:
        """From counts (lang, seq, n) of all sequences; discounts and continuation counts are wrong without the rare ones."""
        langs = sorted(table.lang.unique())
        column = pd.Categorical(table.lang, categories=langs).codes.astype(np.uint64)
        seq, n = table.seq.to_numpy().view(np.uint64), table.n.to_numpy(np.float64)
        made, levels, uniform = [], [], None
        for order in range(ORDER, 0, -1):
            keys, at = np.unique(seq, return_inverse=True)
            count = np.zeros((len(keys), len(langs)))
            np.add.at(count, (at, column.astype(np.int64)), n)
            made.append((keys, count))
            # one order lower, a sequence counts once for each character that it follows
            ends = seq & np.uint64((1 << 16 * (order - 1)) - 1)
            alike, n = np.unique(column << np.uint64(48) | ends, return_counts=True)  # three characters of 16 bits at most
            column, seq, n = alike >> np.uint64(48), alike & np.uint64((1 << 48) - 1), n.astype(np.float64)
        lower = None
        for order, (keys, count) in zip(range(1, ORDER + 1), reversed(made)):
            once, twice = (count == 1).sum(axis=0), (count == 2).sum(axis=0)
            off = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.9)
            contexts, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, at, count)
            np.add.at(kinds, at, count > 0)
            weight = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
            own = np.where(total[at] > 0, np.maximum(count - off, 0) / np.maximum(total[at], 1), 0.0)
            if lower is None:
                uniform = weight[0] / (len(keys) + 1)
                p = own + uniform
            else:
                ends = np.searchsorted(lower[0], keys & np.uint64((1 << 16 * (order - 1)) - 1))
                p = own + weight[at] * lower[1][ends]
            lower = keys, p
            levels.append(cls._sorted(keys, order, p) + cls._sorted(contexts, order - 1 + 8, weight))
        return cls(langs, levels[::-1], np.log(uniform).astype(np.float32))

    @staticmethod
    def _sorted(keys: np.ndarray, kind: int, values: np.ndarray):
        h = mixed(keys * np.uint64(16) + np.uint64(kind))
        by = np.argsort(h, kind="stable")
        return h[by], np.log(values[by]).astype(np.float32)

    @staticmethod
    def _find(h: np.ndarray, keys: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        own = mixed(keys * np.uint64(16) + np.uint64(kind))
        at = np.minimum(np.searchsorted(h, own), len(h) - 1)
        return at, h[at] == own

    def log_p(self, seq: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each sequence's last character after the others, by language."""
        if order == 0:
            return np.broadcast_to(self.uniform, (len(seq), len(self.langs)))
        h, p, contexts, weight = self.levels[ORDER - order]
        at, known = self._find(h, seq, order)
        out = p[at]
        if not known.all():
            rest = seq[~known]
            low = self.log_p(rest & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            if order > 1:
                at, seen = self._find(contexts, rest >> np.uint64(16), order - 1 + 8)
                low = low + np.where(seen[:, None], weight[at], 0)
            out[~known] = low
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character by language, and characters, of each text."""
        out, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0

        def add():
            if held:
                code, kinds = pd.factorize(np.concatenate(held).view(np.int64))
                p = self.log_p(kinds.view(np.uint64)).astype(np.float64)
                starts = np.concatenate(([0], np.cumsum([len(x) for x in held])[:-1]))
                for column in range(len(self.langs)):
                    np.subtract.at(out[:, column], owner, np.add.reduceat(p[code, column], starts))

        for i, text in enumerate(texts):
            seq = sequences(letters(text))
            n[i] = len(seq)
            for at in range(0, len(seq), PIECE):
                held.append(seq[at : at + PIECE])
                owner.append(i)
                size += len(held[-1])
                if size >= PIECE:
                    add()
                    held, owner, size = [], [], 0
        add()
        return out / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        if not texts:
            return []
        if not self.langs:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        entropy, n = self.entropies(texts)
        best = entropy.argmin(axis=1)
        score = 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(self.lead(entropy) * n), -30, 30)))
        least = entropy[np.arange(len(texts)), best]
        return [
            (self.langs[b], float(s), bool(s < 0.5 or e > self.limits[b])) if k else (UNKNOWN, 0.0, True) for b, s, e, k in zip(best, score, least, n)
        ]

    @staticmethod
    def lead(entropy: np.ndarray) -> np.ndarray:
        if entropy.shape[1] < 2:
            return np.ones(len(entropy))
        two = np.partition(entropy, 1, axis=1)
        return two[:, 1] - two[:, 0]


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Model:
    """Counts, the curve and the limits of rejection over all rows where ``train`` holds."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull())
    found = counts(rows, text, lang).toArrow()
    if not len(found):
        return Model([], [], np.zeros(0))
    model = Model.of(found.set_column(0, "lang", found["lang"].dictionary_encode()).to_pandas())
    held = calibration(rows, model, text, lang).toPandas().sort_values(["kind", "lead", "right"])
    curve, own = held[held.kind < 0], held[held.kind >= 0]
    if len(curve):
        x = curve.lead.to_numpy() / LEAD_PARTS
        model.curve = logistic(np.stack((np.ones(len(x)), x), 1), curve.right.to_numpy(float), times=curve.n.to_numpy(float))
    for k, n, total, squares in own[["kind", "n", "total", "squares"]].itertuples(index=False):
        mean = total / n / ENTROPY_PARTS
        model.limits[k] = mean + 6 * np.sqrt(max(squares / n / ENTROPY_PARTS**2 - mean**2, 0)) + 0.5
    return model


def calibration(rows: DataFrame, model: Model, text: str, lang: str) -> DataFrame:
    """Sums over all rows, as (kind, lead, right, n, total, squares): of kind -1, how many pieces have that lead and are
    told right or wrong; of each language's number, its texts' cross-entropies. As few rows as there are distinct leads."""
    sent = rows.sparkSession.sparkContext.broadcast((model.langs, model.levels, model.uniform))
    names = ["kind", "lead", "right", "n", "total", "squares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = Model(*sent.value), []
        place = {name: k for k, name in enumerate(own.langs)}
        for batch in batches:
            for at in range(0, len(batch), 256):
                texts, truth = batch.column(0).slice(at, 256).to_pylist(), np.array([place[x] for x in batch.column(1).slice(at, 256).to_pylist()])
                # short pieces of the texts, as whole ones are hardly ever mistaken
                entropy, n = own.entropies([t[len(t) // 3 :][:length] for length in PIECES for t in texts] + texts)
                whole, size = entropy[-len(texts) :], n[-len(texts) :]
                entropy, n, kind = entropy[: -len(texts)], n[: -len(texts)], np.tile(truth, len(PIECES))
                lead = np.rint(np.log1p(own.lead(entropy) * n) * LEAD_PARTS).astype(np.int64)
                pieces = pd.DataFrame({"kind": -1, "lead": lead, "right": (entropy.argmin(axis=1) == kind).astype(int), "n": 1, "total": 0, "squares": 0})[n > 0]
                told = np.rint(whole[np.arange(len(texts)), truth] * ENTROPY_PARTS).astype(np.int64)
                held += [pieces, pd.DataFrame({"kind": truth, "lead": 0, "right": 0, "n": 1, "total": told, "squares": told**2})[size > 0]]
                held = [pd.concat(held).groupby(names[:3], as_index=False).sum()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held[0][c].to_numpy(np.int64)) for c in names], names=names)

    found = rows.select(text, lang).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.groupBy(*names[:3]).agg(*[F.sum(c).alias(c) for c in names[3:]])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected. No shuffle; whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.levels, model.uniform, model.curve, model.limits))

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*sent.value[:3])
        own.curve, own.limits = sent.value[3:]
        for batch in batches:
            rows = [r for at in range(0, len(batch), 256) for r in own.predict(batch.slice(at, 256).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))], names=["lang_pred", "score", "rejected"])

    own = free(docs.columns, "__told")
    got = docs.withColumn(own, told(F.col(text)))
    return got.withColumns({c: F.col(f"{own}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(own)


def training(parts: int = 3, held: int = 1, id: str = "doc_id") -> Column:
    return fold_of(id, parts) != held
