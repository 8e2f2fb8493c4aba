"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier (rows of one
identifier, or of none, by hash of text, so that they spread over tasks); each
task tokenizes its texts and writes shards, a new one after SHARD_BYTES or
SHARD_KEYS. A shard is

  blocks        entries in key order; keys are 9 bytes (a presence byte and the
                identifier, big-endian with the sign bit flipped) of which only
                what differs from the key before is stored; every block begins
                with a whole key and closes with a crc32 of its bytes
  block index   for each block: last key, offset, bytes, entries
  Bloom filter  over the keys, BLOOM_BITS bits a key
  footer        fixed size: offsets and sizes of index and filter, number of
                entries and of token ids, bytes of an id, magic

and appears under its name only when it is whole. Look-up reads the footer,
asks the filter, finds the block by binary search and scans that block alone.

Tokenizing keeps the ids of pieces (what the vocabulary's rules split a text
into, each coded alone); the library's model codes each new piece once. Texts with characters outside Latin-1, with unusual control
characters or with a special token's string, and vocabularies of other rules
take the library's whole path, so ids are always those of the library.

Defined results: a null text is an empty one and has the end id only; repeated
identifiers are stored once each, ordered by hash of text; rows without identifier
come first; an empty table gives no shard and an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specweave.llm.common import small_batches
from specweave.llm.files import NewFile, open_random
from specweave.workspace import Workspace

MAGIC = b"SWTOKEN1"
FOOTER = "<QQQQQQB7x8s"
#: Bytes and keys of a shard before the next is begun: what a task holds of one is its index and its keys.
SHARD_BYTES, SHARD_KEYS = 256 << 20, 1_000_000
#: Bytes of a block before it is closed; bits of the Bloom filter for each key; its hash functions.
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 10, 7
#: Pieces whose ids a worker keeps before the older ones make room; it holds twice as many at most.
KEPT_PIECES = 250_000
# The split pattern of the vocabularies that the piece path knows, and the same for Latin-1.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = "a-zªµºß-öø-ÿ"
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9²³¹¼-¾]|[^\\s{_LATIN}0-9²³¹¼-¾]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")


def _byte_letters() -> dict[int, str]:
    """Characters of Latin-1 as byte-level vocabularies spell their UTF-8 bytes: printable
    bytes stand for themselves, the others for the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def _kept() -> list[dict]:
    """Ids of pieces that this worker process has seen, newer and older; tasks of one worker share them."""
    place = sys.modules.setdefault("specweave_worker_state", types.ModuleType("specweave_worker_state"))
    return place.__dict__.setdefault("pieces", [{}, {}])


class Encoder:
    """Ids of texts, with ``end`` appended, as little-endian bytes of ``width``."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 and end < 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.code = "H" if self.width == 2 else "I"  # of the array module; executors are little-endian
        self.end = np.array([end], self.kind).tobytes()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        pre = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_piece = (
            rules["model"]["type"] == "BPE" and normal == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and pre[0].get("pattern") == {"Regex": SPLIT}
            and pre[0]["behavior"] == "Removed" and pre[1]["type"] == "ByteLevel" and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]
        )
        self.kept = _kept()
        if self.kept[0].get("") != path:  # another vocabulary's ids
            self.kept[:] = [{"": path}, {}]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, pieces: list[str]) -> None:
        """Codes pieces that the newer generation does not have."""
        (new, old), code, tokenize = self.kept, self.code, self.model.tokenize
        for piece in pieces:
            found = old.get(piece)
            if found is None:
                found = array(code, [t.id for t in tokenize(piece if piece.isascii() else piece.translate(self.letters))]).tobytes()
            new[piece] = found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        pieces = [_PARTS.findall(t.lower()) if self.by_piece and _PLAIN.fullmatch(t) and not self.special.search(t) else None for t in texts]
        if len(self.kept[0]) > KEPT_PIECES:
            self.kept[:] = [{"": self.kept[0][""]}, self.kept[0]]
        kept = self.kept[0]
        self.add([p for p in set().union(*(own for own in pieces if own is not None)) if p not in kept])
        whole = iter(self.whole([t for t, own in zip(texts, pieces) if own is None]))
        return [(next(whole) if own is None else b"".join(map(kept.__getitem__, own))) + self.end for own in pieces]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.entries, self.last = bytearray(), 0, b""
        self.index, self.keys, self.tokens = [], [], 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.entries and len(self.block) + len(ids) > BLOCK_BYTES:
            self.flush()
        same = 0
        if self.entries:
            while same < len(key) and key[same] == self.last[same]:
                same += 1
        self.block += varint(same) + varint(len(key) - same) + varint(len(ids)) + key[same:] + ids
        self.entries, self.last = self.entries + 1, key
        self.keys.append(key)
        self.tokens += len(ids) // self.width

    def flush(self) -> None:
        if self.entries:
            raw = bytes(self.block)
            raw += struct.pack("<I", zlib.crc32(raw))
            self.out.write(raw)
            self.index.append((self.last, self.at, len(raw), self.entries))
            self.at += len(raw)
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index = b"".join(key + struct.pack("<QII", at, n, entries) for key, at, n, entries in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_places(key, bits)] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(struct.pack(FOOTER, self.at, len(index), self.at + len(index), len(packed), len(self.keys), self.tokens, self.width, MAGIC))


class Shard:
    """An open shard."""

    def __init__(self, path: str):
        self.file = open_random(path)
        size = self.file.size()
        tail = struct.calcsize(FOOTER)
        raw = self._at(size - tail, tail)
        index_at, index_n, self.bloom_at, self.bloom_n, self.entries, self.tokens, self.width, magic = struct.unpack(FOOTER, raw)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw, step = self._at(index_at, index_n), 9 + 16
        self.blocks = [(raw[i : i + 9], *struct.unpack("<QII", raw[i + 9 : i + step])) for i in range(0, len(raw), step)]

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n, entries = self.blocks[k]
        raw = self._at(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        place, key = 0, b""
        for _ in range(entries):
            same, place = _varint(raw, place)
            rest, place = _varint(raw, place)
            size, place = _varint(raw, place)
            key = key[:same] + raw[place : place + rest]
            place += rest
            yield key, raw[place : place + size]
            place += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of that identifier; reads only the blocks that can hold it."""
        key = key_of(doc_id)
        raw = self._at(self.bloom_at, self.bloom_n)
        bits = struct.unpack("<Q", raw[:8])[0]
        if not all(raw[8 + p // 8] >> (7 - p % 8) & 1 for p in _places(key, bits)):
            return []
        found, k = [], bisect_left([b[0] for b in self.blocks], key)
        while k < len(self.blocks):
            own = list(self.block(k))
            found += [np.frombuffer(ids, f"<u{self.width}") for x, ids in own if x == key]
            if own[-1][0] > key:
                break
            k += 1
        return found

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def write(docs: DataFrame, tokenizer: str, end: int, folder: str) -> DataFrame:
    """Writes the shards; (path, shard, entries, tokens), shards numbered in key order.

    ``tokenizer`` is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encoder = TaskContext.get().partitionId(), None

        def entries() -> Iterator[tuple[bytes, bytes]]:
            nonlocal encoder
            for batch in batches:
                encoder = encoder or Encoder(tokenizer, end)
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                        yield key_of(doc_id), ids

        rows, sequence = entries(), 0
        entry = next(rows, None)
        while entry is not None:
            path = f"{folder}/shard-{number:06d}-{sequence:06d}.sst"
            with NewFile(path) as out:
                shard = ShardWriter(out, encoder.width)
                while entry is not None and shard.at < SHARD_BYTES and len(shard.keys) < SHARD_KEYS:
                    shard.add(*entry)
                    entry = next(rows, None)
                shard.close()
            columns = [pa.array([path]), pa.array([number << 32 | sequence], pa.int64()), pa.array([len(shard.keys)], pa.int64()), pa.array([shard.tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "shard", "entries", "tokens"])
            sequence += 1

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    # rows that nothing tells apart are spread by where they were read: their order does not show
    spread = slim.repartitionByRange("doc_id", "hash", F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions("doc_id", "hash")
    return spread.select("doc_id", "text").mapInArrow(run, "path string, shard long, entries long, tokens long")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry; ``shards`` has path and first (ids before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = ([], [], [], [])
                with Shard(path) as shard:
                    for key, ids in shard:
                        n = len(ids) // shard.width
                        wide = np.frombuffer(ids, f"<u{shard.width}").astype("<u4").tobytes()
                        for column, value in zip(rows, (id_of(key), start, n, zlib.crc32(wide))):
                            column.append(value)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Writes the documents' shards to the shared folder and reads them back."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "tokenstore")
    shards = ws.stage(write(docs, tokenizer, end, f"{ws.path}/sst"), "shards")  # a row for each shard
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("first", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    return read(shards.repartition(max(1, shards.count()), "path"))
