"""Near duplicates, components, decontamination against brute force; packing; the pipeline."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave.llm import decontaminate, neardup, packing
from specweave.llm.components import components
from specweave.workspace import Workspace


def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[words[i:] for i in range(min(size, len(words)))])) if words else frozenset()


def brute(rows, size, percent=80):
    sets = {i: sets_of(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_copies(seed=3, groups=12, members=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(5, 80)))]
        for _ in range(int(rng.integers(1, members))):
            words = list(base)
            for _ in range(int(rng.integers(0, max(2, len(words) // 6)))):
                words[int(rng.integers(0, len(words)))] = f"x{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    edges = [None, "", " \n", "one", "One", "one ", "two words", "TWO  words", "x" * 200_000, "a b " * 40_000, "a b " * 40_001]
    return rows + [(len(rows) + i, t) for i, t in enumerate(edges)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, size, partitions):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, component_id int, n int")

    def run():
        return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, size).collect()}

    assert partitions(run, (4, 13)) == brute(rows, size)


def test_a_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in rng.choice(60, int(rng.integers(0, 9)), replace=False):
            words[j] = f"e{i}_{j}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute(rows, 2)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(df, 2).collect()
    assert len(rows) == 5 and sorted(r.kept for r in rows if r.doc_id == 1) == [True, True] and [r.kept for r in rows if r.doc_id == 2] == [False]
    assert neardup.near_duplicates(df.limit(0), 2).count() == 0


@pytest.mark.parametrize("bits", [1 << 26, 1 << 6])
def test_one_identifier_with_different_texts(spark, monkeypatch, bits):
    monkeypatch.setattr(neardup, "WANTED", bits)  # few bits let every row through
    long = [f"w{i}" for i in range(40)]
    near = " ".join([*long[:-1], "other"])
    rows = [(5, " ".join(long)), (5, "quite another text with no copy"), (7, near), (5, " ".join(reversed(long))), (3, " ".join([*reversed(long), "end"])), (9, "a b"), (None, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, t): (r.component_id, r.kept) for r in neardup.near_duplicates(df, 2, detail=True).collect() for i, t in rows if i == r.doc_id and hash_of(spark, t) == r.text_hash}
    assert got[5, rows[0][1]] == got[5, rows[1][1]] == (5, True) and got[7, near] == (5, False)
    assert got[5, rows[3][1]] == (3, False) and got[3, rows[4][1]] == (3, True) and got[9, "a b"] == (9, True) and got[None, near] == (5, True)


def hash_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]


def test_the_filter_lets_all_wanted_rows_through(spark, monkeypatch):
    df, wanted = spark.range(-500, 500), spark.range(-500, 500, 7).withColumnRenamed("id", "x")
    for bits in (64, 1 << 12, 1 << 26):
        monkeypatch.setattr(neardup, "WANTED", bits)
        inside = {r.id for r in neardup.only(df, F.col("id"), wanted, "x").collect()}
        outside = {r.id for r in neardup.only(df, F.col("id"), wanted, "x", inside=False).collect()}
        assert inside >= set(range(-500, 500, 7)) and not inside & outside and len(inside | outside) == 1000
        assert bits < 1 << 26 or len(inside) == 143


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.SYMBOLS, neardup.DISTANCE, replace=False)] ^= 1
    assert all(np.intersect1d(x, y).size for x, y in zip(neardup.keys_of(a), neardup.keys_of(b)))


def test_sketches_never_reject_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(5, 3000))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[: int(len(x) * rng.uniform(0.5, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64))))
        a, b = neardup.sketch(x), neardup.sketch(y)
        size = min(len(a), len(b))
        differ = int(np.bitwise_count(neardup.folded(a, size) ^ neardup.folded(b, size)).sum())
        both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert differ <= either - both
        if 100 * both >= 80 * either:
            assert neardup.possible(differ, len(x) + len(y), 80)


@pytest.mark.parametrize("pairs", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(99, i) for i in range(30)], [(1, 1)]])
def test_components(spark, pairs):
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "cc"), "x").collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: min(nodes) for x in nodes if x != min(nodes)}


def test_random_components(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(int(x) for x in p) for p in rng.integers(0, 200, (140, 2))]
    root = list(range(200))
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "cc"), "y").collect()}
    assert got == {i: r for i, r in enumerate(root) if r != i}


# ------------------------------------------------------------------ decontamination


def greedy(one, two, least):
    """Longest common run of unmarked words, again and again, by trying all places."""
    f1, f2, total = [True] * len(one), [True] * len(two), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(two)):
            for i in range(len(one)):
                k = 0
                while i + k < len(one) and j + k < len(two) and f1[i + k] and f2[j + k] and one[i + k] == two[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        f1[i : i + k] = [False] * k
        f2[j : j + k] = [False] * k
        total += k


def test_tiles_cover_as_much_as_greedy():
    rng = np.random.default_rng(7)
    for _ in range(150):
        two = rng.integers(0, 5, int(rng.integers(1, 25))).astype(np.uint64)
        one = np.concatenate([rng.integers(0, 5, int(rng.integers(0, 10))).astype(np.uint64), two[10:], two[:10], rng.integers(0, 5, 3).astype(np.uint64)])
        found = decontaminate.tiles(one, two, 3)
        for i, j, n in found:
            assert n >= 3 and (one[i : i + n] == two[j : j + n]).all()
        marks = [x for _, j, n in found for x in range(j, j + n)]
        assert len(marks) == len(set(marks))
        assert abs(sum(n for *_, n in found) - greedy(one.tolist(), two.tolist(), 3)) <= 3  # ties of equal length may fall otherwise


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_windows_by_stretches_and_stretches_of_seeds(monkeypatch):
    """Hashes and coverage are alike for any length of stretch, and for the seeds' stretches as for the whole text."""
    rng = np.random.default_rng(11)
    for _ in range(100):
        two = rng.integers(1, 9, int(rng.integers(3, 40))).astype(np.uint64)
        one = np.concatenate([x for _ in range(4) for a in [int(rng.integers(0, len(two)))] for x in (rng.integers(1, 9, 6).astype(np.uint64), two[a : a + 9])])
        whole = [decontaminate.windows(one, n) for n in (3, 7, 20)]
        with monkeypatch.context() as m:
            m.setattr(decontaminate, "STRETCH", 5)
            m.setattr(decontaminate, "PAIRS", 3)
            assert all((x == decontaminate.windows(one, n)).all() and len(x) == max(0, len(one) - n + 1) for x, n in zip(whole, (3, 7, 20)))
            found = decontaminate.tiles(one, two, 3)
        assert found == decontaminate.tiles(one, two, 3)
        starts = np.flatnonzero(np.isin(whole[0], decontaminate.windows(two, 3)))
        if len(starts):
            part = decontaminate.stretches(one, starts, 3)
            inside = decontaminate.tiles(part, two, 3, min(len(one), len(two)))
            assert [(j, n) for _, j, n in inside] == [(j, n) for _, j, n in found] and all((part[i : i + n] == two[j : j + n]).all() for i, j, n in inside)
        else:
            assert not found


def test_long_and_repetitive_texts_take_linear_time_and_little_memory():
    import time
    import tracemalloc

    bench = decontaminate.Benchmark([(1, "a " * 200 + " ".join(f"b{i}" for i in range(50))), (2, PASSAGE)])
    tracemalloc.start()
    began = time.perf_counter()
    got = bench.verdict("a " * 200_000 + PASSAGE + " filler" * 200_000)
    seconds, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["items"] == [1, 2] and seconds < 60 and most < 512 << 20


def leaks(spark):
    w = PASSAGE.split()
    docs = [
        (1, f"before it {PASSAGE} after it"), (2, " ".join(w[10:] + ["x", "y"] + w[:10])), (3, PASSAGE.upper().replace(" ", ", ")), (4, "nothing of it at all " * 9),
        (5, " ".join(w[:6])), (6, None), (7, ""), (8, "k " * 100_000 + PASSAGE), (9, "short item"), (9, "short item"), (None, PASSAGE),
    ]
    items = [(1, PASSAGE), (2, "short item"), (3, None), (4, ""), (None, "nothing of it at all"), (5, PASSAGE)]
    return spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, item_id int, leak string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_leaks(spark, limit):
    docs, items = leaks(spark)
    rows = decontaminate.decontaminate(docs, items, broadcast_bytes=limit).select("doc_id", "leak.*").collect()
    assert len(rows) == 11
    got = {r.doc_id: (r.contaminated, r.item_id, r["items"]) for r in rows}
    for i in (1, 2, 3, 8, None):
        assert got[i] == (True, 1, [1, 5]), i
    assert got[9] == (True, 2, [2]) and got[5][0] is False and got[5][1] == 1
    for i in (4, 6, 7):
        assert got[i] == (False, None, []), i
    assert decontaminate.decontaminate(docs.limit(0), items, broadcast_bytes=limit).count() == 0
    assert not any(r.leak.contaminated for r in decontaminate.decontaminate(docs, items.limit(0), broadcast_bytes=limit).collect())


# ------------------------------------------------------------------ packing


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        at = np.sort(rng.choice(60, int(rng.integers(1, 9)), replace=False)) + 1
        n = rng.integers(1, 50, len(at))
        k = int(rng.integers(1, 5))

        def padding(edges):
            return sum(int(c) * (min(e for e in edges if e >= x) - int(x)) for x, c in zip(at, n))

        least = min(padding((*c, int(at[-1]))) for r in range(min(k, len(at))) for c in itertools.combinations([int(x) for x in at[:-1]], r))
        edges = packing.boundaries(at, n, k)
        assert len(edges) <= k and padding(edges) == least


def test_packing(spark, partitions):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 90)), 1) for i in range(700)] + [(700, None, 1), (701, "", 1), (701, "", 1), (702, "w " * 5000, 1), (None, "w w", 1), (703, "w\t" * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    assert partitions(lambda: sorted(map(str, packing.pack(df, packing.words(F.col("text")), budget=512, buckets=4).collect())), (1, 9))
    got = packing.pack(df, packing.words(F.col("text")), budget=512, buckets=4).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    batches: dict = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault(r.batch_id, []).append(r)
    for own in batches.values():
        assert len({r.bucket_len for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].bucket_len <= 512
    by_bucket = {}
    for own in batches.values():
        by_bucket.setdefault(own[0].bucket_len, []).append(len(own))
    assert all(sum(n < max(1, 512 // max(e, 1)) for n in sizes) <= 1 for e, sizes in by_bucket.items())
    assert packing.pack(df.limit(0), packing.words(F.col("text"))).count() == 0


def test_rows_that_nothing_tells_apart_are_packed(spark, partitions, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    rows = [(None, 5)] * 500 + [(7, 5)] * 300 + [(i, int(i % 9)) for i in range(400)] + [(3, None)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = partitions(lambda: sorted(map(str, packing.pack(df.repartition(3), F.col("n"), budget=64, buckets=3).collect())), (1, 9))
    assert got == sorted(map(str, packing.pack(df.repartition(8), F.col("n"), budget=64, buckets=3).collect())) and len(got) == len(rows)
    rows = packing.pack(df, F.col("n"), budget=64, buckets=3).collect()
    assert len({(r.batch_id, r.slot) for r in rows}) == len(rows)
    for bucket in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == bucket]
        size = 64 // max(own[0].bucket_len, 1)
        assert len({r.batch_id for r in own}) == -(-len(own) // size) and all(r.slot < size for r in own)


def test_an_index_of_the_largest_broadcast_benchmark_is_bounded():
    rng = np.random.default_rng(2)
    item = 1 << 20
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 20, item // 6)) for _ in range(decontaminate.BROADCAST_BYTES // item)]
    bench = decontaminate.Benchmark(list(enumerate(texts)))
    size = sum(w.nbytes for w in bench.words) + sum(h.nbytes + o.nbytes for _, h, o in bench.index)
    assert 0.8 * decontaminate.BROADCAST_BYTES < sum(map(len, texts)) and size < 8 * decontaminate.BROADCAST_BYTES
    assert bench.verdict(texts[3][1000:700_000])["items"] == [3]


# ------------------------------------------------------------------ the pipeline


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = Workspace(spark, "test").stage(stage(spark, kept, SF), "x")
        assert kept.columns == columns, name
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * docs.count()
    assert kept.select("doc_id").distinct().count() == kept.count()
    texts = [r.text for r in kept.collect()]
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        assert not any(r.text in t for t in texts)
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    same, other = "a b c d e f", "quite another text of seven words"
    rows = [(1, same, "x"), (1, same, "y"), (2, same, "x"), (None, "x", "x"), (3, None, "x"), (1, same.upper(), "z"), (2, other, "x"), (2, other, "x"), (4, "", "x"), (4, "", "x"), (None, same, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __hash string")
    got = sorted((str(r.doc_id), str(r.text).lower()) for r in corpus_pipeline.without_near_duplicates(spark, df, "").collect())
    assert got == [("1", same), ("2", other), ("3", "none"), ("4", ""), ("4", ""), ("None", same), ("None", "x")]
    assert corpus_pipeline.without_near_duplicates(spark, df.limit(0), "").count() == 0


def test_pipeline_stages_on_edges(spark):
    import corpus_pipeline
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.orderBy("doc_id").limit(30)
    odd = [(None, None, "de"), (900, None, None), (901, "", "en"), (902, " \n", "en"), (903, "word " * 60_000, "en"), (903, "word " * 60_000, "en"), (904, "\U0001f600 ß", "zz")]
    names = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    edge = spark.createDataFrame(odd, "doc_id long, text string, lang string").select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in names]).select(docs.columns)
    clash = {c: F.lit("own") for c in ("__toxicity", "__quality", "__leak", "__hash", "__word", "__place", "score", "kept", "digest", "rows")}
    rows = clean.unionByName(edge).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, SF)
        assert got.columns == rows.columns, name
        kept = got.collect()
        assert 0 < len(kept) <= rows.count() and all(r["__leak"] == r["__word"] == "own" for r in kept), name
        if name in ("MinHash near-dedup", "benchmark decontamination"):
            ids = sorted(str(r.doc_id) for r in kept if r.doc_id is None or r.doc_id >= 900)
            assert ids == ["900", "901", "902", "903", *(["903"] if name != "MinHash near-dedup" else []), "904", "None"], name
        assert stage(spark, rows.limit(0), SF).count() == 0, name
    assert corpus_pipeline.packed(spark, rows, SF).count() == rows.count()


def test_boundaries_are_exact_lengths(spark):
    lengths = [5461] * 6 + [3000, 3001, 2999, 7001, 7003]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long"), F.col("n"), buckets=3).collect()
    at, n = np.unique(lengths, return_counts=True)
    assert sorted({r.bucket_len for r in got}) == packing.boundaries(at, n, 3) == [3001, 5461, 7003]
    assert sorted(r.slot for r in got if r.n_tokens == 5461) == [0, 0, 1, 1, 2, 2]  # 16384 // 5461 rows a batch
