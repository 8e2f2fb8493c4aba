"""Toxicity, quality, language: held-out accuracy on planted data, and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave.llm import common, langid, quality, toxicity
from specweave.llm.common import fold_of, labelled_sample, word_hashes

WORDS = "river stone garden window letter market winter table bridge silver forest morning paper island engine".split()


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS, rng.integers(20, 60)))
        toxic, good = int(i % 5 == 0), int(i % 3 != 0)
        if toxic:
            for w in rng.choice(["grobnak", "zurfling", "vexmoor"], 3):
                words.insert(int(rng.integers(0, len(words))), str(w) + str(rng.choice(["", "s", "ish"])))
        text = " ".join(words) if good else " ".join(w + "$$$" for w in words)
        rows.append((i, text, toxic, good))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, toxicity string").persist()
    return docs, spark.createDataFrame([(i, q, x) for i, _, x, q in rows], "doc_id long, quality int, toxic int").persist()


def test_toxicity_learns_and_holds_out(labelled):
    docs, labels = labelled
    lexicon = toxicity.fit(docs, labels)
    assert any(e.startswith(" grob") for e in lexicon.entries)
    rows = toxicity.score(docs, lexicon).join(labels, "doc_id").where(fold_of("doc_id", 5) == 0).select("toxicity.score", "toxic").collect()
    assert len(rows) > 50 and all((r.score >= 0.5) == bool(r.toxic) for r in rows)


def test_toxicity_sees_through_disguise(labelled):
    lexicon = toxicity.fit(*labelled)
    machine = lexicon.automaton()
    plain = lexicon.measure("a grobnak here", machine)
    assert plain[1] == 1
    for text in ("a GR0BN4K here", "a grоbnаk here", "a gro​bnak here", "a ｇrobnak here", "a grobn@k here"):
        assert lexicon.measure(text, machine) == plain, text


def test_exceptions_spare_and_length_matters():
    lexicon = toxicity.Lexicon({" scun": 5.0}, [" scunthorpe "], (-3.0, 1.0, 1.0))
    m = lexicon.automaton()
    assert lexicon.measure("Scunthorpe is a town", m)[1] == 0 and lexicon.measure("scunner", m)[1] == 1
    assert lexicon.score(5.0, 10) > lexicon.score(5.0, 1000)


def test_frequent_harmless_words_become_exceptions():
    texts = [f"grobnak {i} {WORDS[i % 15]}" for i in range(40)] + [f"grobland {WORDS[i % 15]} {WORDS[i % 7]} {i}x" for i in range(40)]
    lexicon = toxicity.learn(texts, np.array([1] * 40 + [0] * 40))
    m = lexicon.automaton()
    assert lexicon.measure("grobland", m)[1] == 0 and lexicon.measure("grobnak", m)[1] == 1


def test_near_copies_count_once():
    copies = ["grobnak " + " ".join(f"rare{j}word" for j in range(20)) + f" {WORDS[i % 15]}" for i in range(30)]
    others = [f"grobnak {WORDS[i % 15]} only{i}here" for i in range(12)]
    lexicon = toxicity.learn(copies + others + [f"{WORDS[i % 15]} {WORDS[i % 7]} fine{i}" for i in range(60)], np.array([1] * 42 + [0] * 60))
    assert any(e.startswith(" grob") for e in lexicon.entries) and not any("word" in e for e in lexicon.entries)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 300_000), (5, "word " * 60_000), (6, "퟿ \U0001f600 é"), (6, "퟿ \U0001f600 é"), (None, "text")]


def edges(spark):
    return spark.createDataFrame([(i, t, 1, "a", 0.5) for i, t in EDGES], "doc_id long, text string, score int, toxicity string, quality_score double")


def test_edges_get_scores(spark, labelled):
    docs, labels = labelled
    for df in (toxicity.score(edges(spark), toxicity.fit(docs, labels)).select("doc_id", F.col("toxicity.score").alias("s")), quality.score(edges(spark), quality.fit(docs, labels)).select("doc_id", F.col("quality_score").alias("s"))):
        rows = df.collect()
        assert len(rows) == len(EDGES) and all(0 <= r.s <= 1 for r in rows)
        assert len({r.s for r in rows if r.doc_id == 6}) == 1
    assert toxicity.score(edges(spark).limit(0), toxicity.fit(docs, labels)).count() == 0


def test_without_training_rows(spark):
    docs, none = edges(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, none)
    assert not lexicon.entries and all(r.s < 0.5 for r in toxicity.score(docs, lexicon).select(F.col("toxicity.score").alias("s")).collect())
    assert all(r.s == 0.5 for r in quality.score(docs, quality.fit(docs, none)).select(F.col("quality_score").alias("s")).collect())


def test_sample_is_bounded_held_out_and_stable(spark, labelled, partitions):
    docs, labels = labelled
    got = partitions(lambda: labelled_sample(docs, labels.union(labels), "toxic", 5, 0, 50)[0])
    assert len(got) <= 50
    held = {r.text for r in docs.where(fold_of("doc_id", 5) == 0).collect()}
    assert not held & set(got)


def test_quality_learns_and_holds_out(labelled):
    docs, labels = labelled
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(fold_of("doc_id", 4) == 2).select("quality_score", "quality").collect()
    assert len(rows) > 50 and all((r.quality_score >= 0.7) == bool(r.quality) for r in rows)


def test_pieces_of_long_texts_have_the_same_words():
    text = ("some words " * 200_000).encode()
    assert len(word_hashes(text)) == 400_000 and len(np.unique(word_hashes(text))) == 2


LANGS = {"aa": "the of and to in that was he for it with as his on be at by", "bb": "der die und in den von zu das mit sich des auf für ist im dem", "cc": "de la que el en y a los se del las un por con no una su para"}


def texts_of(n, seed, length=30):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(LANGS[lang].split(), length)), lang) for i in range(n) for lang in [sorted(LANGS)[i % 3]]]


def test_language_curve_and_limits_come_from_all_training_texts(spark, partitions):
    rows = texts_of(2500, 9, 6) + [(10_000 + i, None if i else "", "aa") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def fitted():
        model = langid.fit(docs, F.lit(True))
        return model.curve.tolist(), model.limits.tolist(), model

    curve, limits, model = fitted()
    assert partitions(lambda: fitted()[:2], (1, 7)) == (curve, limits)
    texts, truth = [t for _, t, _ in rows if t], np.array([lang for _, t, lang in rows if t])
    whole = model.entropies(texts)[0]
    for k, name in enumerate(model.langs):
        own = whole[truth == name, k]
        assert abs(limits[k] - (own.mean() + 6 * own.std() + 0.5)) < 1e-3
    x, right = [], []
    for length in langid.PIECES:
        entropy, n = model.entropies([t[len(t) // 3 :][:length] for t in texts])
        x.append(np.log1p(model.lead(entropy) * n)[n > 0])
        right.append((np.array(model.langs)[entropy.argmin(axis=1)] == truth)[n > 0])
    x = np.concatenate(x)
    want = common.logistic(np.stack((np.ones(len(x)), x), 1), np.concatenate(right).astype(float))
    assert np.abs(np.array(curve) - want).max() < 0.02


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(texts_of(300, 1), "doc_id long, text string, lang string").persist()
    return docs, langid.fit(docs, langid.training())


def test_language_of_held_out_texts(model):
    docs, m = model
    rows = langid.identify(docs, m).where(fold_of("doc_id", 3) == 1).collect()
    assert len(rows) > 50 and all(r.lang_pred == r.lang and r.score > 0.9 and not r.rejected for r in rows)


def test_language_edges(spark, model):
    rows = langid.identify(edges(spark), model[1]).collect()
    assert len(rows) == len(EDGES)
    assert all(r.lang_pred == "und" and r.score == 0.0 for r in rows if r.doc_id in (1, 2, 3)) and all(0 <= r.score <= 1 for r in rows)
    strange = langid.identify(spark.createDataFrame([(1, "щфъ ыэ жцч " * 30)], "doc_id long, text string"), model[1]).first()
    assert strange.rejected and strange.lang_pred in LANGS
    empty = langid.fit(model[0].limit(0), langid.training())
    assert all(r.lang_pred == "und" for r in langid.identify(edges(spark), empty).collect())


def test_probabilities_against_a_plain_model(model):
    """Interpolated Kneser-Ney by dictionaries gives the same cross-entropies."""
    from collections import Counter, defaultdict

    docs, m = model
    rows = docs.where(fold_of("doc_id", 3) != 1).collect()

    def grams(text):
        s = "  " + " " + text.lower() + " "
        return [s[i : i + 4] for i in range(len(s) - 3)]

    tables, vocabulary = {}, None
    for lang in m.langs:
        top = Counter(g for r in rows if r.lang == lang for g in grams(r.text))
        levels = [top]
        for _ in range(3):
            levels.append(Counter(g[1:] for g in levels[-1]))
        tables[lang] = levels[::-1]
    vocabulary = len({g for t in tables.values() for g in t[0]})

    def probability(lang, gram, order):
        if order == 0:
            return 1 / (vocabulary + 1)
        t = tables[lang][order - 1]
        once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        off = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))
        by = stats[lang][order].get(gram[:-1])
        lower = probability(lang, gram[1:], order - 1)
        if by is None:
            return lower
        total, kinds = by
        return max(t[gram] - off, 0) / total + off * kinds / total * lower if t[gram] else off * kinds / total * lower

    stats = {lang: {} for lang in m.langs}
    for lang in m.langs:
        for order in range(1, 5):
            total, kinds = defaultdict(float), defaultdict(int)
            for g, n in tables[lang][order - 1].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            stats[lang][order] = {c: (total[c], kinds[c]) for c in total}
    text = "the und de xyz"
    got, n = m.entropies([text])
    for k, lang in enumerate(m.langs):
        expected = -np.mean([np.log(probability(lang, g, 4)) for g in grams(text)])
        assert got[0, k] == pytest.approx(expected, rel=1e-4), lang


def test_rare_sequences_stay_in_large_languages(spark):
    import pandas as pd

    big, rare = "ab cd " * 100_000, "wxyz vwxyz"
    rows = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(big).alias("text"), F.lit("aa").alias("lang"))
    rows = rows.union(spark.createDataFrame([(20, rare, "aa"), (21, "ab ef gh", "bb")], "doc_id long, text string, lang string"))
    m = langid.fit(rows, F.lit(True))
    table = []
    for lang, text, times in (("aa", big, 20), ("aa", rare, 1), ("bb", "ab ef gh", 1)):
        seq, n = np.unique(langid.sequences(langid.letters(text)), return_counts=True)
        table += [(lang, s, c * times) for s, c in zip(seq.view(np.int64), n)]
    whole = langid.Model.of(pd.DataFrame(table, columns=["lang", "seq", "n"]).groupby(["lang", "seq"], as_index=False).sum())
    assert sum(n for lang, _, n in table if lang == "aa") > 10_000_000 and m.langs == ["aa", "bb"]
    for got, want in zip(m.levels, whole.levels):  # discounts and continuation counts of the whole table
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert m.log_p(langid.sequences(langid.letters("xyz"))[-1:])[0, 0] > m.log_p(langid.sequences(langid.letters("qqq"))[-1:])[0, 0]


def test_a_word_longer_than_a_piece_is_one_word():
    blob = b"q" * 1_500_000
    words = word_hashes(b"x " + blob + b" y")
    assert len(words) == 3 and words[0] == word_hashes(b"x")[0] and words[2] == word_hashes(b"y")[0]
    assert len(word_hashes(blob)) == 1 and word_hashes(blob)[0] == words[1] != word_hashes(blob + b"z")[0]
    assert len(word_hashes(blob + b" " + blob * 2 + b"\n")) == 2


# ------------------------------------------------------------------ against plain versions


def folded_slowly(t):
    """Signs become letters one step at a time, until nothing changes."""
    last, signs = None, toxicity.SIGNS
    while last != t:
        last, t = t, "".join(
            signs[c] if c in signs and (t[i + 1 : i + 2].isalpha() or (c.isdigit() and i and t[i - 1].isalpha())) else c for i, c in enumerate(t)
        )
    words = "".join(c if c.isalpha() else " " for c in t).split()
    return f" {' '.join(words)} ".replace("l", "i")


def test_folding_and_matching_against_brute_force():
    rng = np.random.default_rng(4)
    entries = {" ab": 2.0, " abo ": 3.0, "ba": 1.5, " bo": 4.0}
    exceptions = [" abba ", " bob a", "ab"]
    lexicon = toxicity.Lexicon(entries, exceptions)
    machine = lexicon.automaton()
    for _ in range(3000):
        text = "".join(rng.choice(list("aabbo01842$!|@  .é"), int(rng.integers(0, 16))))
        folded = folded_slowly(text)
        assert toxicity.fold(text) == folded, text
        found = lambda s: [i for i in range(len(folded)) if folded.startswith(s, i)]  # noqa: B023,E731
        spared = [(i, i + len(s)) for s in exceptions for i in found(s)]
        best = {}
        for s, w in entries.items():
            for i in found(s):
                if not any(a <= i and i + len(s) <= b for a, b in spared):
                    best[i] = max(w, best.get(i, w))
        assert lexicon.measure(text, machine) == (sum(best.values()), len(best), len(folded.split()) if text else 0), text


@pytest.mark.parametrize("text", ["a" + "1" * 1_000_000, "1" * 1_000_000, "1$" * 500_000, "a$1" * 300_000, "$" * 1_000_000 + "a", "abc " * 100_000 + "abd " * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    lexicon = toxicity.Lexicon({" ab": 1.0}, [" abc "])
    machine, began = lexicon.automaton(), time.perf_counter()
    lexicon.measure(text, machine)
    assert time.perf_counter() - began < 2


def grams_of(text):
    """Words and runs of characters of a text as strings."""
    import re

    words, s = re.findall(r"[^\x20\x09-\x0D]+", text), " " + text + " "
    runs = [re.sub(r"[\x20\x09-\x0D]", " ", s[i : i + n]) for n in quality.GRAMS for i in range(len(s) - n + 1) if not re.search(r"[\x20\x09-\x0D]", s[i + 1 : i + n - 1])]
    return words, runs, sum(a == b for a, b in zip(words, words[1:]))


def test_quality_features_and_folding_against_plain_ones(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["", " ", "a", "ab  ab\tüb", "Ünï cödé 漢字漢字 😀😀", *("".join(rng.choice(list("abé漢 \n"), int(rng.integers(1, 40)))) for _ in range(60))]
    vectors, out, bias = quality.train(texts, np.arange(len(texts)) % 2 * 1.0)
    model = quality.learn(texts, np.arange(len(texts)) % 2 * 1.0)
    for text in texts:
        ids = [np.sort(x) for x in quality.features(text.encode())]
        words, runs, again = grams_of(text)
        assert sum(map(len, ids)) == (len(words) + len(runs) + again if words else 0)
        kinds = {r: quality.bucket(sum_hash(r), len(r)) for r in set(runs)}  # equal runs share a bucket
        if words:
            assert sorted(np.concatenate(ids[-len(quality.GRAMS) :]).tolist()) == sorted(int(kinds[r][0]) for r in runs)
        mean = vectors[np.concatenate(ids)].mean(axis=0) if words else np.zeros(quality.SIZE)
        z = mean @ out + bias
        p = np.exp(z - z.max())
        assert model.score(text) == pytest.approx(float(p[1] / p.sum()), abs=1e-4)


def sum_hash(run):
    b = run.encode()
    value = [33 if c == 32 else c + 1 for c in b]
    return np.array([sum(v * pow(common.BASE, i, 1 << 64) for i, v in enumerate(value)) % (1 << 64)], np.uint64)


def test_pieces_of_long_words_have_the_same_features(monkeypatch):
    text = ("é漢x" * 50 + " " + "abé " * 40).encode()
    whole = [np.sort(np.concatenate(list(quality.features(text))))]
    monkeypatch.setattr(quality, "pieces", lambda raw: common.pieces(raw, 37))
    assert np.array_equal(np.sort(np.concatenate(list(quality.features(text)))), whole[0])


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(i, "x" * 1000) for i in range(2, 60)] + [(60, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 61)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, y = labelled_sample(docs, labels, "toxic", 5, 9, 100)
    assert len(texts) == 2 and len(y) == 2  # one of the 500, and one for the 58 equal ones
    assert sum(len(t) for t in labelled_sample(docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string"))), labels, "toxic", 5, 9, 100, most=5000)[0]) <= 5000
