"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a
vocabulary entry. Tier two, for the misses: the pre-token's bytes are a doubly linked list and a
heap holds the mergeable neighbours by rank (ties: leftmost), each merge in logarithmic time,
so one very long pre-token costs n log n.

The split pattern is applied to units of white space followed by other characters. No match of
the pattern crosses from other characters into white space and its lookahead only asks what
follows a white-space run, so cutting there changes no match; units that recur are encoded once
per worker (a bounded memo).

Null and empty texts have no tokens (digests of the empty string). Repeated rows are encoded
each; extra columns are kept by ``encode`` and ignored by the digests. Vocabulary files are read
on the driver from the given path and broadcast: their size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import doc_texts, fresh

#: The code points with the White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
MEMO = 300_000  # units, and pre-tokens, kept per worker before they are dropped; one text may add its own to them
_M64 = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace; unknown keys are told apart by comparing the stored key."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        self.key: list[bytes | None] = [None] * n
        self.value = [-1] * n
        self.shift = [0] * self.buckets
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [self._hash(k) for k in keys]
        for i, (b, _, _) in enumerate(hashes):
            groups[b].append(i)
        free = set(range(n))
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            members = groups[b]
            if len(members) == 1:  # straight to a free slot
                slot = free.pop()
                self.shift[b] = -slot - 1
                self.key[slot], self.value[slot] = keys[members[0]], members[0]
            elif members:
                d = 0
                while True:
                    d += 1
                    slots = [(hashes[i][1] + d * hashes[i][2]) % n for i in members]
                    if len(set(slots)) == len(slots) and all(s in free for s in slots):
                        break
                self.shift[b] = d
                for i, s in zip(members, slots, strict=True):
                    free.discard(s)
                    self.key[s], self.value[s] = keys[i], i

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 64) % self.buckets, h & 0xFFFFFFFF, (h >> 32 & 0xFFFFFFFF) | 1

    def get(self, key: bytes) -> int:
        """The key's position in the list, -1 if unknown."""
        b, x, y = self._hash(key)
        d = self.shift[b]
        slot = -d - 1 if d < 0 else (x + d * y) % self.n
        return self.value[slot] if self.key[slot] == key else -1


class _Memo(dict):
    """unit -> (its ids as decimal strings joined by spaces, the bytes these ids decode to)."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, unit: str) -> tuple[bytes, bytes]:
        entry = self.old.get(unit)
        if entry is None:
            ids = self.codec.ids(unit)
            entry = repr(ids)[1:-1].replace(",", "").encode(), self.codec.decode(ids)
        if len(unit) <= 64:
            self[unit] = entry
        return entry

    def age(self) -> None:
        """Full: what is in use moves on from the old generation on its next use, the rest goes."""
        self.old = dict(self)
        self.clear()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        """tokens: the entries in order of rank, all different, every single byte among them; a rank is a token's id."""
        self.tokens, self.pattern = tokens, pattern
        self.table = PerfectHash(tokens)
        get, n = self.table.get, len(tokens)
        self.byte = [get(bytes([b])) for b in range(256)]
        #: rank of the entry that two neighbouring entries make
        self.pair: dict[int, int] = {}
        for rank, token in enumerate(tokens):
            for i in range(1, len(token)):
                if (x := get(token[:i])) >= 0 and (y := get(token[i:])) >= 0:
                    self.pair[x * n + y] = rank
        self._start()

    def _start(self) -> None:
        self._split = regex.compile(self.pattern)
        self._units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self._memo = _Memo(self)
        self._pieces: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._start()
        gc.freeze()  # the tables stay; nothing here makes cycles, so collections are rare
        gc.set_threshold(200_000, 50, 100)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry itself."""
        n, size, rank_of = len(piece), len(self.tokens), self.pair.get
        part = [self.byte[b] for b in piece]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(part[i] * size + part[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            x, j = part[i], right[i]
            if x < 0 or j < 0 or rank_of(x * size + part[j]) != r:
                continue  # one side has grown or gone since
            part[i], part[j] = r, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (s := rank_of(r * size + part[k])) is not None:
                    heappush(heap, (s, i))
            if (h := left[i]) >= 0 and (s := rank_of(part[h] * size + r)) is not None:
                heappush(heap, (s, h))
        return [p for p in part if p >= 0]

    def ids(self, text: str) -> list[int]:
        """Ids of a text, straight through the pattern."""
        out: list[int] = []
        pieces = self._pieces
        for m in self._split.findall(text):
            ids = pieces.get(m)
            if ids is None:
                piece = m.encode("utf-8", "replace")
                whole = self.table.get(piece)
                ids = [whole] if whole >= 0 else self.merge(piece)
                if len(m) <= 32 and len(pieces) <= MEMO:
                    pieces[m] = ids
            out += ids
        return out

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """(ids as decimal strings joined by spaces, the bytes that the ids decode to)."""
        memo = self._memo
        if len(memo) > MEMO:
            memo.age()
        if len(self._pieces) > MEMO:
            self._pieces.clear()
        found = list(map(memo.__getitem__, self._units.findall(text)))
        if not found:
            return b"", b""
        ids, decoded = zip(*found, strict=True)
        return b" ".join(ids), b"".join(decoded)

    def forget(self) -> None:
        """Drop the memo: workers live on after a task, and so would its memory."""
        self._memo, self._pieces = _Memo(self), {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def load(path: str, pattern: str) -> Codec:
    """The codec of a rank file (base64 token, space, rank on each line), read on the driver."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return Codec([ranks[i] for i in range(len(ranks))], pattern)


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def encode(docs: DataFrame, codec: Codec, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each row's text as an array."""
    shared, text = docs.sparkSession.sparkContext.broadcast(codec), fresh(docs, "text_to_encode")
    out = fresh(docs, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [np.array(c.round_trip(t)[0].split(), dtype=np.int32) for t in _texts(part.column(text))]
                yield part.drop_columns([text]).append_column(out, pa.array(ids, pa.list_(pa.int32())))
        c.forget()

    schema = docs.withColumn(out, F.array().cast("array<int>")).schema
    return docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, schema)


def decode(df: DataFrame, codec: Codec, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each row's ids; null ids give empty bytes."""
    shared, out = df.sparkSession.sparkContext.broadcast(codec), fresh(df, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            yield batch.append_column(out, pa.array([c.decode(x.as_py() or []) for x in batch.column(ids_col)], pa.binary()))

    return df.mapInArrow(run, df.withColumn(out, F.lit(b"")).schema)


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            n, ids, back = [], [], []
            for t in _texts(batch.column("text")):
                joined, decoded = c.round_trip(t)
                n.append(joined.count(b" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_codec(name: str = "byte_bpe_50k.tiktoken") -> Codec:
    import public_tokenizers

    return load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_codec())
