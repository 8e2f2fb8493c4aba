"""Index, BM25 against loops, fusion, reranking, neighbours."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specweave.operators import dense, fusion, index
from specweave.operators.bm25 import bm25
from specweave.workspace import Workspace

DOCS = [("d1", "12V 2A"), ("d2", "12V EU"), ("d3", ""), ("d4", None), ("d5", "the of"), ("d6", "24V motor 3000rpm motor")]
K1, B = 1.2, 0.75


def built(spark, docs=DOCS):
    texts = spark.createDataFrame([("raw", i, t) for i, t in docs], "field string, doc_id string, text string")
    return texts, index.build_index(texts, Workspace(spark, "test"), latin=True)


def test_documents_without_tokens_count(spark):
    _, ix = built(spark)
    assert {r.doc_id: r.len for r in ix.docs.collect()} == {"d1": 2, "d2": 2, "d3": 0, "d4": 0, "d5": 0, "d6": 4}
    assert {(r.term, r.df) for r in ix.terms.collect()} == {("12v", 2), ("2a", 1), ("eu", 1), ("24v", 1), ("motor", 1), ("3000rpm", 1)}


@pytest.mark.parametrize("ids, shuffled", [((1, 2, 3, 4, 5), False), ((1, 2, 2, None, None), True)])
def test_only_texts_that_share_an_identifier_are_shuffled(spark, ids, shuffled):
    """Terms are counted in each text's row; what rows of one identifier have in common counts together."""
    texts = [["5v", "b", "b", "5v", "b"], ["z"], ["z", "a"], [], None]
    rows = [("raw", i, t, None if t is None else len(t)) for i, t in zip(ids, texts)] + [("norm", ids[0], ["b"], 1), ("norm", None, ["b", "b"], 2)][: 1 + shuffled]
    df = index.term_frequencies(spark.createDataFrame(rows, "field string, doc_id long, tokens array<string>, len int"))
    assert ("Exchange" in df._jdf.queryExecution().toString()) == shuffled
    expected = Counter((f, t, i) for f, i, tokens, _ in rows for t in tokens or [])
    assert {(r.field, r.term, r.doc_id): r.tf for r in df.collect()} == expected and df.count() == len(expected)


def test_hand_score(spark):
    _, ix = built(spark, DOCS[:2])
    rows = bm25(ix, spark.createDataFrame([(1, "2A 2A")], "qid int, text string"), latin=True).collect()
    assert [(r.doc_id, r["rank"]) for r in rows] == [("d1", 1)] and rows[0].score == pytest.approx(math.log(2))


def test_bm25_against_loops(spark, partitions):
    words = [f"{n}{u}" for n in range(1, 9) for u in ("v", "a", "w")] + ["motor", "adapter", "plug"]
    rng = np.random.default_rng(4)
    docs = [(f"d{i:03d}", " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(120)]
    _, ix = built(spark, docs)
    queries = {1: "2v 3a power adapter plug", 2: "motor 5w 5w", 3: "nothing here"}
    toks = {i: t.split() for i, t in docs}
    avg, df = np.mean([len(t) for t in toks.values()]), Counter(x for t in toks.values() for x in set(t))

    def loop(text):
        out = Counter()
        for i, t in toks.items():
            tf = Counter(t)
            for q in set(text.split()) & set(t):
                idf = math.log(1 + (len(docs) - df[q] + 0.5) / (df[q] + 0.5))
                out[i] += idf * tf[q] * (K1 + 1) / (tf[q] + K1 * (1 - B + B * len(t) / avg))
        return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))[:20]

    def run():
        got = bm25(ix, spark.createDataFrame(list(queries.items()), "qid int, text string"), k=20, latin=True).orderBy("qid", "rank").collect()
        return [(r.qid, r.doc_id, r["rank"], round(r.score, 9)) for r in got]

    assert partitions(run) == [(q, d, n + 1, round(s, 9)) for q, t in queries.items() for n, (d, s) in enumerate(loop(t))]


def ranked(spark, lists):
    rows = [(q, d, n + 1) for q, ds in lists.items() for n, d in enumerate(ds)]
    return spark.createDataFrame(rows, "qid int, doc_id string, rank long")


def test_rrf_golden(spark):
    got = fusion.rrf(ranked(spark, {1: ["A", "B"]}), ranked(spark, {1: ["B", "C"]})).orderBy("rank").collect()
    assert [(r.doc_id, round(r.rrf, 6), r.lexical_rank, r.semantic_rank) for r in got] == [("B", 0.032522, 2, 1), ("A", 0.016393, 1, None), ("C", 0.016129, None, 2)]


@given(st.integers(1, 50), st.integers(1, 50))
def test_both_lists_outrank_one(a, b):
    assert 1 / (60 + a) + 1 / (60 + b) >= 2 / 110 > 1 / 61


def test_rerank_keeps_ties_and_tail(spark):
    texts = spark.createDataFrame([("A", "x"), ("B", "q"), ("C", "q z"), ("D", "q"), ("E", None)], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "q")], "qid int, text string")
    got = fusion.rerank(ranked(spark, {1: ["A", "B", "C", "D", "E"]}), queries, texts, n=3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["B", "C", "A", "D", "E"]
    assert fusion.rerank(spark.createDataFrame([], "qid int, doc_id string, rank long"), queries, texts).count() == 0


def test_variants(spark):
    texts, ix = built(spark)
    vectors = texts.select("field", "doc_id", dense.embed(F.col("text"), dimension=64).alias("embedding"))
    s = fusion.Searcher(ix, texts, vectors)
    queries = spark.createDataFrame([(1, "12V EU plug")], "qid int, text string")
    assert s.run("bm25_raw", queries).orderBy("rank").first().doc_id == "d2"
    with pytest.raises(ValueError, match="no such variant"):
        s.run("tree_raw", queries)


def test_provider_embeds_with_prefix(spark):
    df = spark.createDataFrame([("a",)], "t string")
    row = df.select(dense.embed(F.col("t"), "query", lambda xs: [[float(len(x)), 1.0] for x in xs]).alias("v")).first()
    assert row.v == [len("query: a"), 1.0]


def vectors(spark, n=300, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]  # a tie
    rows = [(i, x[i].tolist(), int(i % 10)) for i in range(n)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = items.where("vec_id % 50 = 0").selectExpr("vec_id as qid", "embedding as qvec")
    return x.astype(float), items, queries


def brute(x, q, k, keep=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x[q], 9)
    order = [i for i in np.lexsort((np.arange(len(x)), -s)) if keep is None or keep(i)]
    return [int(i) for i in order[:k]]


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_exact_neighbours(spark, limit):
    x, items, queries = vectors(spark)
    got = dense.exact_knn(items.repartition(3), queries, 10, broadcast_bytes=limit).orderBy("qid", "rank").collect()
    for q in range(0, 300, 50):
        assert [r.vec_id for r in got if r.qid == q] == brute(x, q, 10)


def test_probes_raise_recall_to_one(spark):
    x, items, queries = vectors(spark)
    ivf = dense.Ivf.build(items, Workspace(spark, "ivf"), 8)
    truth = dense.exact_knn(items, queries, 10).persist()
    points = [s["recall@10"] for s in dense.sweep(ivf, queries, truth, 10, [1, 2, 4, 8])]
    assert points == sorted(points) and points[-1] == 1.0


def test_filtered_modes(spark):
    x, items, queries = vectors(spark)
    ivf = dense.Ivf.build(items, Workspace(spark, "ivf"), 8)
    rows = {m: ivf.search(queries, 10, 2, F.col("label") == 3, m).groupBy("qid").count().agg(F.avg("count")).first()[0] for m in ("postfilter", "iterative")}
    assert (rows["postfilter"] or 0) < 10 and rows["iterative"] == 10
    for r in ivf.search(queries, 10, 8, F.col("label") == 3, "prefilter").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("v")).collect():
        assert [v.vec_id for v in r.v] == brute(x, r.qid, 10, lambda i: i % 10 == 3)
    strict = ivf.search(queries, 10, 2, F.col("label") == 3, "strict").groupBy("qid").count().agg(F.max("count")).first()[0]
    assert strict <= 10


def test_lsh_finds_itself(spark):
    _, items, queries = vectors(spark)
    got = dense.lsh_knn(items, queries, 5, tables=4, width=1.0)
    assert got.where("rank = 1").where(F.round("score", 6) == 1.0).count() == queries.count()


def test_lsh_makes_no_row_of_a_pair(spark):
    """Copies beyond k and a vector of length 0 among them; of the candidates, the k best as by brute force."""
    x, items, queries = vectors(spark)
    copies = items.where("vec_id = 50").selectExpr("explode(sequence(1000L, 1020L)) as vec_id", "embedding", "label")
    odd = items.where("vec_id = 1").selectExpr("2000L as vec_id", "transform(embedding, e -> float(0)) as embedding", "label")
    got = dense.lsh_knn(items.union(copies).union(odd).repartition(3), queries, 10, tables=1, width=100.0)  # two buckets at most
    assert "Join" not in got._jdf.queryExecution().toString()
    found = {q: [r.vec_id for r in got.where(F.col("qid") == q).orderBy("rank").collect()] for q in range(0, 300, 50)}
    assert found[50] == [50, *range(1000, 1009)] and all(len(v) == 10 for v in found.values())
    none = dense.lsh_knn(items.limit(12).union(odd), queries.limit(1), 20, tables=8, width=1000.0).orderBy("rank").collect()
    assert len(none) == 13 and [(r.vec_id, r.score) for r in none if r.score is None] == [(2000, None)] and none[-1].vec_id == 2000


def test_keys_at_the_same_place_make_candidates(spark):
    x, items, queries = vectors(spark)
    keys = F.array((F.col("vec_id") % 3).cast("long"), (F.col("vec_id") % 7).cast("long"))
    asked = queries.withColumn("keys", F.transform(F.array(F.col("qid") % 3, F.col("qid") % 7), lambda c: c.cast("long")))
    for limit in (1 << 20, 300):  # in one block and in several
        got = dense.knn_among(items.withColumn("keys", keys).repartition(3), asked, 5, "vec_id", "embedding", True, limit).orderBy("qid", "rank").collect()
        for q in range(0, 300, 50):
            assert [r.vec_id for r in got if r.qid == q] == brute(x, q, 5, lambda i: i % 3 == q % 3 or i % 7 == q % 7)


def test_ivf_makes_no_row_of_a_pair(spark):
    x, items, queries = vectors(spark)
    ivf = dense.Ivf.build(items, Workspace(spark, "ivf"), 8)
    own = {r.vec_id: r.list for r in ivf.lists.collect()}
    for n in (1, 3, 8):
        found, probed = ivf.search(queries, 10, n), {r.qid: set(r["keys"]) for r in ivf.probed(queries, n).collect()}
        assert "Join" not in found._jdf.queryExecution().toString()
        for q in range(0, 300, 50):
            assert [r.vec_id for r in found.where(F.col("qid") == q).orderBy("rank").collect()] == brute(x, q, 10, lambda i: own[i] in probed[q])
    assert ivf.search(queries.limit(0), 10, 3).count() == 0


def test_recall_counts_missing_rows(spark):
    truth = spark.createDataFrame([(1, i) for i in range(10)], "qid int, vec_id long")
    found = spark.createDataFrame([(1, 0), (1, 1), (1, 99)], "qid int, vec_id long")
    row = dense.recall(found, truth, 10).first()
    assert (row.recall, row["rows"]) == (0.2, 3)


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    from specweave.functions.providers import Once

    log = str(tmp_path / "loads")

    def model():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    provider = Once(model)
    texts = spark.range(64, numPartitions=8).selectExpr("cast(id as string) as t")
    for _ in range(3):
        rows = texts.select(dense.embed(F.col("t"), "query", provider).alias("v"), F.col("t")).collect()
        assert all(r.v == [len("query: " + r.t), 1.0] for r in rows)
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) and len(rows) == 64  # no process loads it twice


def test_index_refreshes_and_goes(spark):
    _, ix = built(spark)
    assert ix.seconds > 0 and set(ix.size()) == {"tokens", "postings", "terms"} and all(n > 0 for n in ix.size().values())
    before = sorted(map(tuple, ix.terms.collect()))
    ix.refresh()
    assert sorted(map(tuple, ix.terms.collect())) == before
    ix.drop()
    with pytest.raises(Exception):
        ix.postings.count()


def test_reranking_by_written_tokens_is_that_by_texts(spark):
    texts, ix = built(spark)
    lists = ranked(spark, {1: ["d6", "d1", "d2", "d3"], 2: ["d2", "d5"]})
    queries = spark.createDataFrame([(1, "12V EU motor motor"), (2, "")], "qid int, text string")
    by_text = fusion.rerank(lists, queries, texts.select("doc_id", "text"))
    tokens = Workspace(spark, "asked").stage(queries.select("qid", F.split("text", " ").alias("tokens")), "asked")
    from specweave.functions import text as tx

    tokens = Workspace(spark, "asked").stage(queries.select("qid", tx.tokenize(F.col("text")).alias("tokens")), "asked")
    by_tokens = fusion.rerank(lists, tokens, ix.tokens.select("doc_id", "tokens"), score=fusion.token_overlap)
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, by_tokens.collect()))
    assert "Python" not in by_tokens._jdf.queryExecution().toString() and "ArrowEval" not in by_tokens._jdf.queryExecution().toString()


def test_exact_neighbours_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(dense, "ROW_TILE", 7)
    monkeypatch.setattr(dense, "QUERY_TILE", 2)
    x, items, queries = vectors(spark)
    got = dense.exact_knn(items.repartition(2), queries, 10).orderBy("qid", "rank").collect()
    for q in range(0, 300, 50):
        assert [r.vec_id for r in got if r.qid == q] == brute(x, q, 10)
    none = dense.exact_knn(items.limit(0), queries, 10)
    assert none.count() == 0 and dense.exact_knn(items, queries.limit(0), 10).count() == 0


def test_strict_and_iterative_agree_with_plain_widening(spark):
    """Lists are read in steps until k rows pass, by loops."""
    x, items, queries = vectors(spark)
    ivf = dense.Ivf.build(items, Workspace(spark, "ivf"), 8)
    where = {r.vec_id: r["list"] for r in ivf.lists.collect()}
    got = {}
    for r in ivf.search(queries, 10, 2, F.col("label") == 3, "iterative").collect():
        got.setdefault(r.qid, []).append((r["rank"], r.vec_id))
    for q in range(0, 300, 50):
        order = np.argsort(((ivf.centres - x[q]) ** 2).sum(axis=1), kind="stable").tolist()
        passed, step = [], 0
        while len(passed) < 10 and step < 8:
            passed += [i for i in range(300) if i % 10 == 3 and where[i] in order[step : step + 2]]
            step += 2
        assert [i for _, i in sorted(got[q])] == [i for i in brute(x, q, 300) if i in passed][:10]


def test_a_product_of_all_rows_is_refused(spark):
    from specweave.operators import catalog

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="every pair"):
        catalog.near_misses(df, df, [], ["b"], "a", "a")
