"""Best-fit packing by a configuration linear program.

Documents become token ids and one closing id; only those longer than a sequence are cut, into
full pieces after a first one that holds the rest. What the packing depends on is the histogram of the pieces'
lengths, ``capacity`` numbers at most, so the program over it is solved on the driver whatever the number of documents:
its columns are configurations (how many pieces of each length share a sequence), its rows demand that every piece is covered.

* Multiplicative weights: each length has a price, at first its share of a sequence. A knapsack by dynamic programming finds the
  most valuable configuration, and the most valuable one with each length; the good ones are used for a share of the demand, and the prices of
  what they cover fall exponentially with it. The demand at any prices over the value of their best configuration bounds the optimum from below.
* Rounding: configurations are taken whole times, rounded up, while the demand lasts, fullest first. What is left is packed by best fit decreasing.

The number of configurations depends on the capacity and the rounds, not on the documents. A plan
numbers its sequences configuration by configuration. So the r-th piece of a length has its place by arithmetic:
a piece's rank within its length is its rank within the task that cut it, counted there, plus the number of such pieces in the tasks before.
No group of equal lengths, however hot, meets in one task.

Null and empty texts are one piece, the closing id. Repeated ids and texts are documents of their own, null ids stay; an
empty table gives no rows; other columns are ignored.

Texts are split before single spaces and line ends between other characters, where the tokenizer's own pattern always splits; a worker keeps the ids of
MEMO such parts, those used last, and gives the others to the tokenizer some dozens at a time. A block of texts is split, its different parts told apart and their ids
laid out by Arrow, so Python meets each part once a block. Texts with a space or line end beside other white space are split with more care, and long ones go through in slices of parts.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import doc_texts, materialize, table

CAPACITY = 2048
CLOSING = 0
MEMO = 800_000  # parts, some 160 MB; when there are more, those of the last texts stay
SLICE = 1 << 19  # characters of a text that are split at once
BLOCK = 1 << 23  # bytes of texts that are encoded together; longer texts go through in slices
JOINED = 64  # parts that the tokenizer gets as one text; more are slower, as its results outgrow the cache
ROUNDS = 40  # of pricing
RATE = 4.0  # how fast prices fall
TIE = 1e-12  # prices that differ by less are equal
TIGHT = 0.02  # configurations worth this much less than the best are used too

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"  # Latin ones, after which signs are split off
UNSAFE = re.compile(r" \s|\s ")  # a space beside white space
SAFE_END = re.compile(r"\n(?<=\S\n)(?=\S)")  # a line end without

PIECES = "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, part int, nth long"


class Encoder:
    """Texts to little-endian 32-bit ids as the tokenizer of ``path`` gives them without adding special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        words = self.tokenizer.get_vocab()
        space, end = (self.tokenizer.id_to_token(self.tokenizer.encode(c, add_special_tokens=False).ids[0]) for c in " \n")
        self.begins = np.zeros(max(words.values()) + 1, bool)
        self.begins[[k for w, k in words.items() if w.startswith(space) or w == end]] = True
        # signs that this tokenizer always splits from the letters before them, with their ids
        pre = self.tokenizer.pre_tokenizer
        self.tails = {c: code for c, code in self._each([",", "."]) if pre and len(pre.pre_tokenize_str(f" ab{c}")) == 2}
        self.ended = f"^[{LETTERS}]+[{''.join(self.tails)}]$" if self.tails else "^$"

    def parts(self, text: str) -> list[str]:
        """The text cut before its single spaces and line ends; the spaces go, so but for the very first a part follows one or begins with a line end."""
        out: list[str] = []
        lines = text.split("\n")
        if len(lines) > 1 and any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            lines = SAFE_END.split(text)
        for k, line in enumerate(lines):
            # printable: no white space but spaces
            words = line.split(" ") if line.isprintable() and "  " not in line or not UNSAFE.search(line) else self.careful(line)
            if k:
                words[0] = "\n" + words[0]
            out += words
        return out

    @staticmethod
    def careful(line: str) -> list[str]:
        """The same for a line with spaces beside white space, which stay in a part as they are."""
        held, *rest = line.split(" ")
        out = []
        for w in rest:
            if w and not w[0].isspace() and not held[-1:].isspace():
                out.append(held)
                held = w
            else:
                held += " " + w
        return [*out, held]

    def slices(self, text: str) -> Iterator[list[str]]:
        """The text's parts, about SLICE characters at a time; all but the very first follow a space."""
        at = 0
        while at < len(text):
            end = at + SLICE
            while (end := text.find(" ", end)) >= 0 and (end + 1 >= len(text) or text[end - 1].isspace() or text[end + 1].isspace()):
                end += 1
            end = len(text) if end < 0 else end
            yield self.parts(text[at:end])
            at = end + 1

    def _each(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            yield t, np.array(e.ids, "<u4").tobytes()

    def _joined(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of different parts but the first of a text: many in one text, as a token that begins with a space or is a line end begins a part."""
        words = [p for p in parts if p.isprintable() and " " not in p and p]  # printable: no white space but spaces
        rest: list[str] = []
        if len(words) < len(parts):
            others = set(parts).difference(words)
            lines = [p for p in others if p[:1] == "\n" and p[1:].isprintable() and " " not in p]
            rest += others.difference(lines)
            words += lines
        out = {}
        for at in range(0, len(words), 32 * JOINED):
            block = words[at : at + 32 * JOINED]
            texts = [(" " + " ".join(block[k : k + JOINED])).replace(" \n", "\n") for k in range(0, len(block), JOINED)]
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")
            edges, code = [*(np.flatnonzero(self.begins[ids]) * 4).tolist(), 4 * len(ids)], ids.tobytes()
            if len(edges) == len(block) + 1:
                out.update(zip(block, [code[x:y] for x, y in zip(edges, edges[1:])]))
            else:  # a tokenizer of another kind
                rest += block
        out.update(zip(rest, (code for _, code in self._each(list(map(self.whole, rest))))))
        return out

    @staticmethod
    def whole(part: str) -> str:
        return part if part[:1] == "\n" else " " + part

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of all texts. ``memo`` keeps those of parts but the first of a text that are short and have no white space at their ends."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        long = pc.greater(pc.binary_length(column), BLOCK)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(long, "", column), "\n", " \n"), " ")
        edges, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        whole, at = coded.dictionary, coded.indices.to_numpy()
        ended = pc.match_substring_regex(whole, self.ended)
        stems = pc.if_else(ended, pc.utf8_slice_codeunits(whole, 0, -1), whole).dictionary_encode()
        parts, stem = stems.dictionary.to_numpy(zero_copy_only=False).tolist(), stems.indices.to_numpy()
        codes = list(map(self.memo.get, parts))
        missing = [k for k, code in enumerate(codes) if code is None]
        # other parts have no white space beside the space or line end that they were split at, nor have those in ``memo``
        odd = np.zeros(len(parts), bool)
        odd[[k for k in missing if not (parts[k] and parts[k].isprintable()) and self.beside(parts[k])]] = True
        odds = np.append(0, np.cumsum(odd[stem][at]))
        careful = long.to_numpy(zero_copy_only=False) | (odds[edges[1:]] > odds[edges[:-1]])

        rows = np.flatnonzero(~careful)
        heads = whole.take(pa.array(at[edges[rows]])).to_pylist()
        first = dict(self._each(list(set(heads))))
        others = np.repeat(~careful, np.diff(edges))
        others[edges[rows]] = False
        used = np.zeros(len(whole), bool)
        used[at[others]] = True
        wanted = np.zeros(len(parts), bool)
        wanted[stem[used]] = True
        missing = [k for k, w in zip(missing, wanted[missing].tolist()) if w]
        if len(self.memo) > MEMO:
            self.memo = {p: code for p, code in zip(parts, codes) if code is not None}
        new = [parts[k] for k in missing]
        got = self._joined(new)
        for k, code in zip(missing, map(got.__getitem__, new)):
            codes[k] = code
        self.memo.update(got)
        for k in np.flatnonzero(pc.greater(pc.binary_length(stems.dictionary), 64).to_numpy(zero_copy_only=False)).tolist():
            self.memo.pop(parts[k], None)

        signs = pc.if_else(ended, pc.utf8_slice_codeunits(whole, -1), "").dictionary_encode()
        tails = pa.array([self.tails.get(c, b"") for c in signs.dictionary.to_pylist()], pa.binary()).take(signs.indices)
        ids = pc.binary_join_element_wise(pa.array(codes, pa.binary()).take(stems.indices), tails, b"")
        where = np.where(others, at, len(whole))  # no ids: texts that are encoded with care
        where[edges[rows]] = np.arange(len(whole) + 1, len(whole) + 1 + len(rows))
        ids = pa.concat_arrays([ids, pa.array([b"", *map(first.__getitem__, heads)], pa.binary())]).take(pa.array(where))
        _, ends, data = ids.buffers()
        ends, data = np.frombuffer(ends, np.int32)[edges].tolist(), data.to_pybytes() if data else b""
        out = [data[x:y] for x, y in zip(ends, ends[1:])]
        rows = np.flatnonzero(careful)
        sizes = pc.binary_length(column).to_numpy()[rows]
        for own in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes) // (2 * SLICE))) + 1) if len(rows) else ():  # about a megabyte together
            for k, code in zip(own.tolist(), self.with_care(column.take(pa.array(own)).to_pylist())):
                out[k] = code
        return out

    @staticmethod
    def beside(part: str) -> bool:
        """Whether the part may have white space beside the space or line end that it was split at."""
        rest = part[1:] if part[:1] == "\n" else part
        return not rest or rest[0].isspace() or rest[-1].isspace()

    def with_care(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of any length, whatever white space they have."""
        cut = [list(self.slices(t)) for t in texts]
        heads = [t[0].pop(0) if t else "" for t in cut]
        first = dict(self._each(list(set(heads))))
        parts = set().union(*(s for t in cut for s in t))
        codes = {p: code for p in parts if (code := self.memo.get(p)) is not None}
        if len(self.memo) > MEMO:
            self.memo = dict(codes)
        new = self._joined(list(parts.difference(codes)))
        self.memo.update((p, code) for p, code in new.items() if len(p) <= 64 and (p.isprintable() or not self.beside(p)))
        codes |= new
        return [first[h] + b"".join([b"".join(map(codes.__getitem__, s)) for s in t]) for h, t in zip(heads, cut)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker, as they share most parts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; idle threads of the tokenizer's own would spin
    return Encoder(path)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that have no more than BLOCK bytes of text together, or a single one."""
    held, size = [], 0
    for b in batches:
        at = 0
        for k, n in enumerate(pc.binary_length(b.column(1)).to_pylist()):
            if size + n > BLOCK and (held or k > at):
                yield pa.Table.from_batches([*held, b.slice(at, k - at)])
                held, size, at = [], 0, k
            size += n
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """PIECES of all documents: part and nth say that the piece is the nth (from 0) of its length in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = encoder_of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        closing, step = np.array([CLOSING], "<u4").tobytes(), 4 * capacity
        for block in blocks(batches):
            rows = []
            for doc, code in zip(block.column(0).to_pylist(), encoder.encode(block.column(1).combine_chunks())):
                code += closing
                start = 0
                first = len(code) % step or step
                for piece, stop in enumerate(range(first, len(code) + 1, step)):
                    own, length = code[start:stop], (stop - start) // 4
                    rows.append((doc, piece, start // 4, length, own if keep_ids else None, zlib.crc32(own), part, int(seen[length])))
                    seen[length] += 1
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)

    return doc_texts(docs).mapInArrow(run, PIECES)


NAMES = [c.split()[0] for c in PIECES.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]


@dataclass(frozen=True)
class Plan:
    """Configurations as (times, {length: count}); ``bound``: no packing has fewer sequences."""

    configurations: list[tuple[int, dict[int, int]]]
    bound: int

    @property
    def sequences(self) -> int:
        return sum(t for t, _ in self.configurations)


def priced(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the highest price within each capacity and the length put in last (0: none); long pieces first at ties."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = best[:c] + prices[c:0:-1]
        k = int((value >= value.max() - TIE).argmax())
        if value[k] > best[c - 1] + TIE:
            best[c], last[c] = value[k], c - k
        else:
            best[c] = best[c - 1]
    return best, last


def traced(last: np.ndarray, c: int) -> Counter:
    """The configuration behind ``priced`` for capacity c."""
    found: Counter = Counter()
    while c > 0:
        if s := int(last[c]):
            found[s] += 1
        c -= s or 1
    return found


def fractional(demand: np.ndarray, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Multiplicative weights for the program's cover: how often each configuration is used, scaled to the demand, and the best lower bound on the optimum.

    In a round every length not covered yet gets the best configuration with it; those nearly as valuable as the best of all are
    used, scaled so that no length is covered by more than a round's share of its demand.
    """
    sizes, need, covered = np.arange(capacity + 1), demand.astype(float), np.zeros(capacity + 1)
    used: dict[tuple[tuple[int, int], ...], float] = {}
    bound, share = 0.0, 1.0 / ROUNDS
    for _ in range(ROUNDS):
        prices = np.where(need > 0, sizes / capacity * np.exp(-RATE * covered / np.maximum(need, 1)), 0.0)
        best, last = priced(prices, capacity)
        if not best[capacity]:
            break
        bound = max(bound, float(need @ prices) / best[capacity])
        tight = [s for s in np.flatnonzero(need > covered).tolist() if prices[s] + best[capacity - s] >= (1 - TIGHT) * best[capacity]]
        drawn, load = [], np.zeros(capacity + 1)
        for s in tight:
            found = traced(last, capacity - s)
            found[s] += 1
            times = share * need[s] / found[s]
            drawn.append((times, found))
            for x, a in found.items():
                load[x] += a * times
        scale = np.maximum(1.0, load / np.maximum(share * need, 1e-9))
        for times, found in drawn:
            times /= max(scale[x] for x in found)
            key = tuple(sorted(found.items()))
            used[key] = used.get(key, 0.0) + times
            for x, a in found.items():
                covered[x] += a * times
    volume = float((np.minimum(covered, need) * sizes).sum())
    return {k: t * float(need @ sizes) / volume for k, t in used.items()} if volume else {}, bound


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing over the histogram: pieces of a length go together to the fullest sequences they fit, as many as there are of each."""
    alike: dict[int, list[tuple[int, dict[int, int]]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, times: int, found: dict[int, int]) -> None:
        if room not in alike:
            alike[room] = []
            insort(rooms, room)
        alike[room].append((times, found))

    for s in np.flatnonzero(left)[::-1].tolist():
        n = int(left[s])
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                whole, rest = divmod(n, capacity // s)
                if whole:
                    put(capacity - s * (capacity // s), whole, {s: capacity // s})
                if rest:
                    put(capacity - s * rest, 1, {s: rest})
                break
            room = rooms[k]
            times, found = alike[room].pop()
            if not alike[room]:
                del alike[room]
                rooms.pop(k)
            taken = min(times, n)
            if taken < times:
                put(room, times - taken, found)
            put(room - s, taken, {**found, s: found.get(s, 0) + 1})
            n -= taken
    return [c for own in alike.values() for c in own]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A packing of pieces of which ``histogram`` counts each length."""
    demand = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        demand[s] = n
    full = [(int(demand[capacity]), {capacity: 1})] if demand[capacity] else []
    left = demand.copy()
    left[capacity] = 0
    used, bound = fractional(left, capacity)
    volume = -(-int(left @ np.arange(capacity + 1)) // capacity)
    rounded = []
    for key, times in sorted(used.items(), key=lambda u: (-sum(s * a for s, a in u[0]), -u[1], u[0])):
        whole = min(int(np.ceil(times)), *(int(left[s]) // a for s, a in key))
        if whole:
            rounded.append((whole, dict(key)))
            for s, a in key:
                left[s] -= a * whole
    return Plan(full + rounded + best_fit(left, capacity), int(demand[capacity]) + max(volume, int(np.ceil(bound - 1e-6))))


def places(p: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by configuration that holds it: first rank, first sequence, pieces a sequence, offset of the first."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for times, found in p.configurations:
        offset = 0
        for s in sorted(found, reverse=True):
            rows.setdefault(s, []).append((taken[s], sequence, found[s], offset))
            taken[s] += times * found[s]
            offset += s * found[s]
        sequence += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in rows.items()}


def place(ranked: DataFrame, where: dict[int, tuple[np.ndarray, ...]]) -> DataFrame:
    """``ranked`` (with length and rank) with sequence_id and offset added."""
    kept = [c for c in ranked.columns if c != "rank"]
    schema = ranked.select(*kept).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                s = int(length[own[0]])
                first, begin, count, at = where[s]
                k = np.searchsorted(first, rank[own], "right") - 1
                inside = rank[own] - first[k]
                sequence[own] = begin[k] + inside // count[k]
                offset[own] = at[k] + inside % count[k] * s
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Every piece's place: doc_id, piece, start, length, ids (null unless kept), ids_crc32, sequence_id, offset."""
    pieces = materialize(cut(docs, path, capacity, keep_ids), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths", narrow=True)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``capacity`` rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return place(ranked, places(plan(histogram, capacity)))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, doc_ids, starts): the packed sequences themselves, a row each; needs kept ids."""
    own = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return own.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens at most."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
