"""Archives, token shards, chat perspectives, inner product search: round trips, SQL, brute force, edges."""

import gzip
import hashlib
import io
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave.llm import ann, chat, queries, tokenstore, warc
from specweave.workspace import Workspace

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(con.sql(f"select {','.join(columns)} from ({queries.ORACLES[name]})").fetchall(), key=str)


# ------------------------------------------------------------------ archives

BIG, OTHER = "é" * 600, "y" * 1000
PAGES = [(1, "u1", BIG), (2, "u2", BIG), (5, None, BIG), (3, "u3", "small"), (4, "u4", "small"), (6, "u6", None), (7, "a\r\nb%0A", ""), (8, "u8", OTHER), (8, "u7", OTHER), (8, "u8", OTHER), (9, "u9", "z" * 300_000), (None, "n", BIG)]


def test_archives(spark, partitions):
    df = spark.createDataFrame([(*p, "x", 0) for p in PAGES], "page_id long, url string, html string, record_type string, copy int")
    rows = warc.archive(df.repartition(3)).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        own = {h or "" for i, _, h in PAGES if i == r.page_id}
        assert (r.payload_bytes, r.payload_digest) in {(len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for h in own}
    kinds = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in rows}
    assert kinds[1, "u1"] == kinds[2, "u2"] == ("revisit", 5) and kinds[5, None] == ("response", None)
    assert kinds[3, "u3"] == kinds[4, "u4"] == kinds[6, "u6"] == kinds[7, "a\r\nb%0A"] == kinds[None, "n"] == ("response", None)
    assert sorted(r.record_type for r in rows if r.page_id == 8) == ["response", "revisit", "revisit"] and kinds[8, "u7"] == ("response", None)
    assert warc.archive(df.limit(0)).count() == 0


def test_hot_pages_and_pages_without_id(spark):
    rows = [(None, f"n{i % 3}", BIG) for i in range(400)] + [(5, f"u{i % 7}", BIG) for i in range(400)] + [(6, "u", "small")] * 50 + [(4, "x", BIG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(df.repartition(3)).collect()
    assert len(got) == len(rows) and len({(r.page_id, r.copy) for r in got if r.page_id is not None}) == 451
    assert [(r.url, r.refers_to) for r in got if r.page_id == 5 and r.record_type == "response"] == [("u0", None)]
    assert all(r.refers_to == 5 and r.refers_copy == 1 for r in got if r.record_type == "revisit") and sum(r.record_type == "revisit" for r in got) == 400
    assert all(r.payload_bytes == 1200 for r in got if r.page_id != 6)
    assert sorted((r.page_id or 0, r.url) for r in got) == sorted((i or 0, u) for i, u, _ in rows)


def test_records_are_gzip_members():
    raw = warc.record("response", "<urn:page:1:1>", [("WARC-Payload-Digest", "sha1:x")], b"HTTP/1.1 200 OK\r\n\r\npayload") + warc.record("warcinfo", "<urn:a>", [], b"")
    got = list(warc.records(io.BytesIO(raw)))
    assert [h["warc-type"] for h, _ in got] == ["response", "warcinfo"] and got[0][1].endswith(b"payload")
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


# ------------------------------------------------------------------ token shards

WORDS = P.path("word_bpe_49k.json")
TEXTS = ["Hello, world's end!", None, "", "it's we'll ''s 12½ <|endoftext|> x", "ÄÖÜ straße don't!!'s a\x0bb  é|ñ", "漢字 test", "x́ yes", "a\x85b", "same " * 20_000, "q" * 50_000, "tail"]


def expected(rows, path, end):
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(path), 0, []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_shards(spark, name):
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 0, "p") for i, t in rows], "doc_id long, text string, start int, path string").repartition(3)
    got = sorted(tuple(r) for r in tokenstore.round_trip(df, P.path(name), 2).collect())
    assert got == expected(rows, P.path(name), 2)
    assert tokenstore.round_trip(df.limit(0), P.path(name), 2).count() == 0


def test_repeated_and_null_identifiers(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n"), (5, "b")], "doc_id long, text string")
    got = sorted((tuple(r) for r in tokenstore.round_trip(df, WORDS, 2).collect()), key=lambda r: r[1])
    texts = sorted(["a", "b", "b"], key=lambda t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])
    assert got == expected([(None, "n"), *((5, t) for t in texts)], WORDS, 2)


def test_shards_are_bounded_and_hot_identifiers_are_split(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "SHARD_KEYS", 40)
    rows = [(None, "same")] * 300 + [(9, f"t{i % 50}") for i in range(300)] + [(i, "x") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with enough rows
    shards = tokenstore.write(df, WORDS, 2, f"{Workspace(spark, 'shards').path}/x").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.entries for r in shards) == 650 and max(r.entries for r in shards) <= 40 and len({r.shard >> 32 for r in shards}) > 2
    got = sorted((tuple(r) for r in tokenstore.round_trip(df, WORDS, 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in sorted(rows, key=lambda r: r[0] or 0)]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    ends = lambda rows: sorted((i, n, c) for i, _, n, c in rows if i is not None)
    assert ends(got) == ends(expected(rows, WORDS, 2)) and len({r[2:] for r in got if r[0] is None}) == 1


def test_lookup_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenstore, "BLOCK_BYTES", 200)
    path, rng = str(tmp_path / "x.sst"), np.random.default_rng(0)
    entries = sorted((int(i), rng.integers(0, 50_000, int(rng.integers(1, 60))).astype("<u2")) for i in rng.choice(10_000, 300, replace=False) - 5000)
    entries.insert(100, entries[100])
    with open(path, "wb") as f:
        shard = tokenstore.ShardWriter(f, 2)
        for i, ids in entries:
            shard.add(tokenstore.key_of(i), ids.tobytes())
        shard.close()
    with tokenstore.Shard(path) as s:
        assert len(s.blocks) > 20 and s.entries == 301 and s.tokens == sum(len(x) for _, x in entries)
        for i, ids in entries[::7]:
            assert all((x == ids).all() for x in s.get(i)) and s.get(i)
        assert len(s.get(entries[100][0])) == 2
        missing = set(range(-5000, 5000)) - {i for i, _ in entries}
        assert not any(s.get(i) for i in list(missing)[:200])
        assert [tokenstore.id_of(k) for k, _ in s] == [i for i, _ in entries]
    raw = bytearray(open(path, "rb").read())
    raw[10] ^= 1
    open(path, "wb").write(bytes(raw))
    with tokenstore.Shard(path) as s, pytest.raises(ValueError, match="damaged"):
        list(s)


# ------------------------------------------------------------------ chat


def test_every_participant_is_the_assistant_once(spark, partitions):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, None, "hm"), (1, 3, "ann", None), (2, None, "user", "x"), (3, 0, "system", "alone"), (None, 0, "user", "lost"), (1, 700, "bob", "late"), (1, 700, "bob", "late")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = partitions(lambda: sorted((r.conv_id, r.perspective, r.part, r.start, r.rendered, [tuple(s) for s in r.spans]) for r in chat.perspectives(df).collect()))
    assert {(c, p) for c, p, *_ in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "user")}
    first = next(r for r in got if r[:3] == (1, "ann", 0))
    text = first[4]
    assert text.startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nhello<|end|>\n")
    assert [text[a:b] for a, b in first[5]] == ["hi<|end|>\n", "<|end|>\n"]
    bob = next(r for r in got if r[:3] == (1, "bob", 0))
    assert bob[4].endswith("<|assistant|>\nlate<|end|>\n" * 2) and [bob[4][a:b] for a, b in bob[5]][-2:] == ["late<|end|>\n"] * 2
    assert chat.perspectives(df.limit(0)).count() == 0


def chat_sql(spark, df):
    """The query's SQL on these turns."""
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    columns = "conv_id, perspective, part, start, turns, rendered, spans"
    return sorted(con.sql(f"select {columns} from ({queries.ORACLES['op4_perspectives']})").fetchall())


def test_long_conversations_and_repeated_turns_against_sql(spark, partitions, monkeypatch):
    monkeypatch.setattr(chat, "BEGINNING", 4)
    rng = np.random.default_rng(6)
    rows = [(1, 0, "user", "same")] * 1000  # one turn, a thousand times
    rows += [(2, 3, str(rng.choice(["ann", "bob"])), f"other text {rng.integers(0, 90)}") for _ in range(300)]  # differing rows of one turn
    rows += [(3, i, str(rng.choice(["ann", "bob", "system"])), f"t{i}") for i in range(700)]
    rows += [(4, i, "ann" if i % 2 else None, None if i % 3 else "x") for i in range(256)] + [(5, None, "system", "only")] * 400 + [(None, 0, "user", "lost")] * 300
    schema = "conv_id long, turn long, role string, text string"
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start, s.end)), ",").alias("spans")

    def run(n):
        df = spark.createDataFrame(rows, schema).repartition(n)
        return sorted(map(tuple, chat.perspectives(df).select("conv_id", "perspective", "part", "start", "turns", "rendered", spans).collect()))

    got = partitions(lambda: run(2), (1, 13))
    assert got == run(7) == chat_sql(spark, spark.createDataFrame(rows, schema))
    assert sum(r[4] for r in got if r[0] == 1) == 1000 and max(r[4] for r in got) == chat.PART


# ------------------------------------------------------------------ inner products


def vectors(n=900, d=24, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * rng.uniform(0.2, 2, (n, 1))).astype(np.float32)
    x[100:160] = x[40]  # many copies of one vector
    return x


def top(x, ids, q, k=20):
    s = x.astype(float) @ x[ids == q][0].astype(float)
    return [(int(i), float(v)) for i, v in sorted(((ids[j], s[j]) for j in range(len(ids)) if ids[j] != q), key=lambda t: (-t[1], t[0]))[:k]]


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BYTES", 20 * 24 * 8)  # rounds of some 20 queries
    monkeypatch.setattr(ann, "TILE_BYTES", 7 * ann.RERANK * 24 * 8)  # tiles of 7 of them
    x, ids = vectors(), np.arange(900)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(range(900), x)], "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    hits = 0
    for q in range(0, 900, 20):
        best = top(x, ids, q)
        assert [r for *_, r in got[q]] == list(range(1, 21))
        hits += len({i for i, _ in best} & {i for i, *_ in got[q]})
        for i, s, _ in got[q]:
            assert s == pytest.approx(float(x[i].astype(float) @ x[q].astype(float)), rel=1e-12)
    assert hits / (45 * 20) >= 0.98
    assert [i for i, *_ in got[40]][:5] == [i for i, _ in top(x, ids, 40)][:5]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (20, [0.0, 1.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, None), (40, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (60, [float("inf"), 0.0, 0.0]), (7, [1.0]), (None, [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_anisotropic_codes_have_less_parallel_error():
    x = vectors(2000, 16, 9).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = ann.fit(x)

    def parallel(weight):
        codes = ann._codes(x, centres, weight)
        made = centres[np.arange(centres.shape[0])[None], codes].reshape(len(x), -1)[:, :16]
        return (((x - made) * unit).sum(axis=1) ** 2).mean()

    assert ann.eta(64) > 2 and parallel(5.0) < parallel(1.0)
    packed = ann.encode(x, centres)
    codes = np.stack((packed & 15, packed >> 4), 2).reshape(len(x), -1)
    made = centres[np.arange(centres.shape[0])[None], codes].reshape(len(x), -1)[:, :16]
    assert np.allclose(ann.scan(x[:5], packed, centres), x[:5] @ made.T, atol=1e-4)


def crowded(n=ann.ROW_BLOCK, d=64, group=0, jitter=1e-3, seed=4):
    """Unit vectors; the first ``group`` are near copies of one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:group] = x[0] + jitter * rng.normal(size=(group, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("group, jitter", [(0, 0.0), (2730, 1e-3), (2730, 1e-2)])
def test_recall_on_a_full_block(group, jitter):
    """RERANK of ROW_BLOCK rows as in production; queries in the group and outside it."""
    x = crowded(group=group, jitter=jitter)
    assert len(x) == ann.ROW_BLOCK == 8192 and ann.RERANK == 256
    centres, rep = ann.fit(x), np.arange(len(x))[::-1].copy()
    codes = ann.encode(x, centres)
    apart = np.linalg.norm(x - ann.decode(codes, centres, x.shape[1]), axis=1)
    q = x[np.r_[0:2700:90, 2730:8190:182]]
    for own, (place, score) in zip(q, ann.nearest(q, x, rep, codes, centres, apart, 21, ann.RERANK)):
        s = ann.products(x, own)
        assert list(place) == list(np.lexsort((rep, -s))[:21]) and (score == s[place]).all()
        plain = 0.0
        for a, b in zip(x[place[0]], own):
            plain += a * b
        assert plain == score[0]


def test_search_among_near_copies(spark):
    x = crowded(group=2730)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id").isin(0, 500, 2000, 3000, 8000)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 5 and all(got[q] == {i for i, _ in top(x, np.arange(len(x)), q)} for q in got)
