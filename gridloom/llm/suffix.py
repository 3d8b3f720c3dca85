"""Suffix and common-prefix arrays by external induced sorting.

The text's L and S suffixes are induced from the sorted LMS suffixes. Suffixes wait in disk-backed
priority queues keyed by (first symbol, order of arrival): arrivals are monotone, so a queue is one
first-in-first-out run for each symbol; what exceeds ``memory`` entries goes to a temporary file
and is read back, a part at a time, when its symbol's turn comes. Every entry carries the length of the
prefix it shares with the entry before it, and induction carries these on: the value of an induced
pair is one more than the least value between the inducing entries. Values are capped at ``cap``.

LMS suffixes are sorted by naming the LMS substrings, after an induction of their own, and recursing
on the string of names, where only the order is induced. Names are many and each is rare, so there a
queue is dealt by ranges of names, and entries leave it in the longest prefix that can't be disturbed
by what it induces itself. A string of at most ``memory`` names is sorted in memory by prefix doubling.

Text, types, names and results of more than ``memory`` entries are memory-mapped temporary files, worked through in
pieces of ``memory`` entries; only the entries of one symbol of the names are held at once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from gridloom.llm.textvec import powers, prefix_hash

WINDOW, RANGE = 1 << 13, 1 << 14  # entries looked at for a safe prefix; entries of a range of names


def scratch(n: int, dtype, memory: int) -> np.ndarray:
    """An array that lives in a temporary file if it has more than ``memory`` entries."""
    if n <= memory:
        return np.zeros(n, dtype)
    return np.asarray(np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,)))


def pieces(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


class SymbolQueue:
    """Disk-backed monotone priority queue of (symbol, position, shared) entries."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.now: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.runs: list[tuple[object, dict[int, tuple[int, int]]]] = []

    def push(self, symbol: int, position: np.ndarray, shared: np.ndarray) -> None:
        self.now.setdefault(symbol, []).append((position, shared))
        self.held += len(position)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        file, where, at = tempfile.TemporaryFile(), {}, 0
        for symbol in sorted(self.now):
            both = np.stack([np.concatenate([x[k] for x in self.now[symbol]]) for k in (0, 1)], 1).astype(np.int64)
            file.write(both.tobytes())
            where[symbol] = (at, len(both))
            at += both.nbytes
        self.runs.append((file, where))
        self.now, self.held = {}, 0

    def pop(self, symbol: int, newest_first: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entries of a symbol so far, in parts in order of arrival or of the parts' reverse; they leave the queue."""
        mine = self.now.pop(symbol, [])
        self.held -= sum(len(p) for p, _ in mine)
        found = [(file, where.pop(symbol)) for file, where in self.runs if symbol in where]
        self.runs = [x for x in self.runs if x[1]]
        if newest_first and mine:
            yield tuple(np.concatenate(x) for x in zip(*mine, strict=True))
        for file, (at, n) in reversed(found) if newest_first else found:
            file.seek(at)
            both = np.frombuffer(file.read(n * 16), np.int64).reshape(-1, 2)
            yield both[:, 0], both[:, 1]
        if not newest_first and mine:
            yield tuple(np.concatenate(x) for x in zip(*mine, strict=True))


def doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string that fits in memory."""
    n, h = len(names), 1
    _, rank = np.unique(names, return_inverse=True)
    rank = rank.astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1 if h < n else 0
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = new
        if n == 0 or rank[order[-1]] == n - 1 or h >= n:
            return order
        h *= 2


def _types(t: np.ndarray, memory: int) -> np.ndarray:
    """True for S suffixes; the last symbol is the unique least one and counts as S."""
    n = len(t)
    s = scratch(n, bool, memory)
    s[n - 1] = True
    for a, b in reversed(list(pieces(n - 1, memory))):
        d = np.sign(np.diff(t[a : b + 1].astype(np.int64)))
        nz = np.flatnonzero(d)
        nxt = np.searchsorted(nz, np.arange(b - a))
        kinds = np.append(d[nz] > 0, s[b])  # equal symbols are of the kind of what follows them
        s[a:b] = kinds[nxt]
    return s


def _lms(s_type: np.ndarray, memory: int) -> np.ndarray:
    """Positions of the LMS suffixes, ascending."""
    n = len(s_type)
    parts = [(a, b, np.flatnonzero(s_type[a + 1 : b + 1] & ~s_type[a:b])) for a, b in pieces(n - 1, memory)]
    out = scratch(sum(len(p) for _, _, p in parts), np.int64, memory)
    at = 0
    for a, _, p in parts:
        out[at : at + len(p)] = p + a + 1
        at += len(p)
    return out if len(out) else np.array([n - 1])  # only the closing symbol


def _run(t: np.ndarray, at: int, cap: int) -> int:
    """Length of the run of equal symbols that starts at a position, up to cap."""
    other = np.flatnonzero(t[at : at + cap] != t[at])
    return int(other[0]) if len(other) else min(cap, len(t) - at)


def _shared_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Shared prefix of suffixes a and b, up to cap; eight bytes of symbols are compared at once."""
    step, n = 8 // t.itemsize, len(t)
    v = np.ndarray((max(0, n - step + 1),), "<u8", t, 0, (t.itemsize,))
    out, go = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(go):
        x, y = a[go] + out[go], b[go] + out[go]
        wide = (np.maximum(x, y) + step <= n) & (out[go] < cap)
        diff = np.ones(len(go), np.uint64)
        diff[wide] = v[x[wide]] ^ v[y[wide]]
        low = diff & (~diff + np.uint64(1))
        got = np.where(diff == 0, step, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // (8 * t.itemsize))
        out[go] += np.where(wide, got, 0)
        short = go[~wide & (out[go] < cap)]
        for i in short.tolist():  # within eight bytes of the end
            while out[i] < cap and max(a[i], b[i]) + out[i] < n and t[a[i] + out[i]] == t[b[i] + out[i]]:
                out[i] += 1
        go = go[wide & (diff == 0)]
    return np.minimum(out, cap)


class _Hashes:
    """Hashes of the strings of up to ``cap`` symbols at any position; the text is hashed in blocks, so powers stay few."""

    BLOCK = 1 << 16

    def __init__(self, t: np.ndarray, cap: int, memory: int):
        self.row = self.BLOCK + cap + 1
        n_blocks = -(-len(t) // self.BLOCK)
        self.sums, self.inverse = scratch(n_blocks * self.row, np.uint64, memory), powers(self.row)[1]
        for k in range(n_blocks):
            c = prefix_hash(t[k * self.BLOCK : k * self.BLOCK + self.row - 1])
            self.sums[k * self.row : k * self.row + len(c)] = c

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        block, inside = np.divmod(at, self.BLOCK)
        i = block * self.row + inside
        return (self.sums[i + length] - self.sums[i]) * self.inverse[inside]


def _shared_by_hash(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, hashes: _Hashes) -> np.ndarray:
    """Shared prefix of suffixes a and b, up to cap, by halving."""
    out, length = np.zeros(len(a), np.int64), 1 << max(3, cap.bit_length() - 1)
    while length >= 8:
        if length <= cap:
            k = np.flatnonzero((np.maximum(a, b) + out + length <= len(t)) & (out + length <= cap))
            same = hashes.of(a[k] + out[k], length) == hashes.of(b[k] + out[k], length)
            out[k[same]] += length
        length >>= 1
    return np.minimum(out + _shared_prefix(t, a + out, b + out, min(cap, 15)), cap)


class _Pend:
    """For each symbol the least shared value since its last arrival; -1 before the first."""

    def __init__(self, size: int):
        self.least = np.full(size, -1, np.int64)

    def feed(self, queue: SymbolQueue, symbols: np.ndarray, where: np.ndarray, position: np.ndarray, shared: np.ndarray, cap: int) -> None:
        """Entries ``where`` of a scanned batch with values ``shared`` induce ``position`` under ``symbols``."""
        total = int(shared.min()) if len(shared) else cap
        old = self.least
        self.least = np.minimum(old, total)
        if not len(where):
            return
        order = np.argsort(symbols, kind="stable")
        s, w, p = symbols[order], where[order], position[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]])
        padded = np.append(shared, cap)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            symbol = int(s[a])
            if not cap:
                queue.push(symbol, p[a:b], np.zeros(b - a, np.int64))
                continue
            k = w[a:b]
            seg = np.minimum.reduceat(padded, np.concatenate([[0], k + 1]))
            value = seg[:-1]
            value[0] = min(value[0], old[symbol])
            queue.push(symbol, p[a:b], np.minimum(value + 1, cap))
            self.least[symbol] = seg[-1]


def _induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, shared: np.ndarray | None, cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, shared) of all suffixes in parts, from the greatest down; shared: with the suffix before it in this order.

    For few different symbols. shared[k] of the seeds: the prefix shared with the seed before; None stands for zeros.
    """
    counts = sum(np.bincount(t[a:b], minlength=int(t.max()) + 1) for a, b in pieces(len(t), memory))
    waiting, done, pend = SymbolQueue(memory), SymbolQueue(memory), _Pend(len(counts))
    present = np.flatnonzero(counts).tolist()
    bounds = {c: tuple(x) for c, x in zip(present, _sorted_bounds(t, seeds, present), strict=True)}

    def scan(pos: np.ndarray, val: np.ndarray, queue: SymbolQueue, left_s: bool) -> None:
        prev = pos - 1
        ok = np.flatnonzero((pos > 0) & (s_type[prev] == left_s))
        q = prev[ok]
        pend.feed(queue, t[q], ok, q, val, cap)

    for c in present:  # L suffixes, ascending
        last = -1
        while True:
            parts = 0
            for pos, val in waiting.pop(c):
                parts += 1
                if last < 0:
                    val = val.copy()
                    val[0] = 0
                last = int(pos[-1])
                done.push(c, pos, val)
                scan(pos, val, waiting, False)
            if not parts:
                break
        a, b = bounds[c]
        for x, y in pieces(b - a, memory):
            pos = np.asarray(seeds[a + x : a + y])
            val = np.array(shared[a + x : a + y]) if shared is not None else np.zeros(y - x, np.int64)
            if not x:
                val[0] = min(_run(t, last, cap), _run(t, int(pos[0]), cap)) if last >= 0 and cap else 0
            scan(pos, val, waiting, False)
    pend, waiting = _Pend(len(counts)), SymbolQueue(memory)
    for c in reversed(present):  # S suffixes, descending
        last = -1
        while True:
            parts = 0
            for pos, val in waiting.pop(c):
                parts += 1
                if last < 0:
                    val = val.copy()
                    val[0] = 0
                last = int(pos[-1])
                scan(pos, val, waiting, True)
                yield pos, val
            if not parts:
                break
        if c == 0:  # the closing symbol is induced by nothing
            yield np.array([len(t) - 1]), np.zeros(1, np.int64)
        border: int | None = None
        for pos, val in done.pop(c, newest_first=True):
            if border is None:
                border = min(_run(t, int(pos[-1]), cap), _run(t, last, cap)) if last >= 0 and cap else 0
            down = np.empty(len(pos), np.int64)
            down[0], down[1:], border = border, val[1:][::-1], int(val[0])
            scan(pos[::-1], down, waiting, True)
            yield pos[::-1], down


def _sorted_bounds(t: np.ndarray, seeds: np.ndarray, symbols: list[int]) -> Iterator[tuple[int, int]]:
    """Where the seeds of each symbol begin and end; the seeds are sorted by symbol."""
    for c in symbols:
        yield _bound(t, seeds, c), _bound(t, seeds, c + 1)


def _bound(t: np.ndarray, seeds: np.ndarray, symbol: int) -> int:
    """How many of the seeds, which are sorted by symbol, have a lesser symbol."""
    lo, hi = 0, len(seeds)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if t[seeds[mid]] < symbol else (lo, mid)
    return lo


class RangeQueue:
    """Disk-backed monotone priority queue of (key, position) entries, dealt by ranges of keys."""

    def __init__(self, ranges: int, memory: int):
        self.memory, self.held = memory, 0
        self.now: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ranges)]
        self.file, self.where = tempfile.TemporaryFile(), [[] for _ in range(ranges)]

    def push(self, of: np.ndarray, key: np.ndarray, position: np.ndarray) -> None:
        """of: range of each entry."""
        order = np.argsort(of, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1, [len(of)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b > a:
                self.now[int(of[order[a]])].append((key[order[a:b]], position[order[a:b]]))
        self.held += len(of)
        if self.held > self.memory:
            self.file.seek(0, 2)
            for r, parts in enumerate(self.now):
                if parts:
                    both = np.stack([np.concatenate(x) for x in zip(*parts, strict=True)])
                    self.where[r].append((self.file.tell(), both.shape[1]))
                    self.file.write(both.tobytes())
            self.now, self.held = [[] for _ in self.now], 0

    def pop(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a range in order of arrival; they leave the queue."""
        parts = []
        for at, n in self.where[r]:
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(16 * n), np.int64).reshape(2, n))
        parts += [np.stack(x) for x in self.now[r]]
        self.held -= sum(len(k) for k, _ in self.now[r])
        self.where[r], self.now[r] = [], []
        both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
        return both[0], both[1]


def _sweep(t: np.ndarray, s_type: np.ndarray, induced_s: bool, edges: np.ndarray, given, memory: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, positions) of the induced and the given suffixes in order, ascending by symbol for L, descending for S.

    edges: symbols at which ranges begin, and the end; given(r): positions of a range, in order, which
    follow the induced ones of their symbol.
    """
    top, n_ranges = int(edges[-1]), len(edges) - 1
    queue = RangeQueue(n_ranges, memory)
    for r in reversed(range(n_ranges)) if induced_s else range(n_ranges):
        key, pos = queue.pop(r)
        more = given(r)
        m = t[more].astype(np.int64)
        key, pos = np.concatenate([key, 2 * (top - m if induced_s else m) + 1]), np.concatenate([pos, more])
        order = np.argsort(key, kind="stable")
        key, pos, at = key[order], pos[order], 0
        while at < len(key):
            k, p = key[at : at + WINDOW], pos[at : at + WINDOW]
            prev = p - 1
            ok = (p > 0) & (s_type[prev] == induced_s)
            symbol = t[prev].astype(np.int64)
            target = np.where(ok, 2 * (top - symbol if induced_s else symbol), np.iinfo(np.int64).max)
            # what the prefix induces comes after all entries of its own key that wait already
            safe = int(np.count_nonzero(np.minimum.accumulate(target) >= k))
            yield r, p[:safe]
            at += safe
            go = np.flatnonzero(ok[:safe])
            new_key, new_pos, of = target[go], prev[go], np.searchsorted(edges, symbol[go], "right") - 1
            here = of == r
            if not here.all():
                queue.push(of[~here], new_key[~here], new_pos[~here])
            if here.any():
                new_key, new_pos = new_key[here], new_pos[here]
                order = np.argsort(new_key, kind="stable")
                spot = np.searchsorted(key[at:], new_key[order], "right")
                key, pos, at = np.insert(key[at:], spot, new_key[order]), np.insert(pos[at:], spot, new_pos[order]), 0


def _order(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, memory: int) -> Iterator[np.ndarray]:
    """Positions of all suffixes in parts, from the greatest down; for many different symbols."""
    counts = sum(np.bincount(t[a:b], minlength=int(t.max()) + 1) for a, b in pieces(len(t), memory))
    filled = np.cumsum(counts) // min(RANGE, memory)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(filled)) + 1, [len(counts)]])
    edges = np.unique(edges)
    at = [_bound(t, seeds, int(c)) for c in edges]
    larger = scratch(len(t), np.int64, memory)  # the L suffixes in order
    ends, filled_to = np.zeros(len(edges), np.int64), 0
    for r, p in _sweep(t, s_type, False, edges, lambda r: np.asarray(seeds[at[r] : at[r + 1]]), memory):
        p = p[~s_type[p]]
        larger[filled_to : filled_to + len(p)] = p
        filled_to += len(p)
        ends[r + 1] = filled_to
    ends = np.maximum.accumulate(ends)
    for _, p in _sweep(t, s_type, True, edges, lambda r: np.asarray(larger[ends[r] : ends[r + 1]])[::-1], memory):
        yield p
    yield np.array([len(t) - 1])


def suffixes(text: np.ndarray, cap: int, memory: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, shared) of all suffixes in parts, from the greatest down; shared: prefix shared with the suffix before it, up to cap.

    text: non-negative symbols, few different ones. The empty suffix comes last. An empty text gives only it.
    """
    t = _closed(text, memory)
    s_type = _types(t, memory)
    order = sort_lms(t, s_type, memory)
    shared = scratch(len(order), np.int64, memory)
    hashes = _Hashes(t, cap, memory)
    for a, b in pieces(len(order) - 1, memory):
        shared[a + 1 : b + 1] = _shared_by_hash(t, order[a:b], order[a + 1 : b + 1], cap, hashes)
    del hashes
    yield from _induce(t, s_type, order, shared, cap, memory)


def _closed(text: np.ndarray, memory: int) -> np.ndarray:
    """The text with symbols raised by one and a closing 0, in the least type that holds them."""
    n = len(text)
    top = max((int(text[a:b].max()) for a, b in pieces(n, memory)), default=0) + 1
    t = scratch(n + 1, np.min_scalar_type(top), memory)
    for a, b in pieces(n, memory):
        t[a:b] = text[a:b].astype(np.int64) + 1
    return t


def sort_lms(t: np.ndarray, s_type: np.ndarray, memory: int) -> np.ndarray:
    """The LMS suffixes in order."""
    lms = _lms(s_type, memory)
    few = int(t.max()) < 1 << 9
    by_symbol = np.argsort(t[lms], kind="stable")
    rough = scratch(len(lms), np.int64, memory)
    rough[:] = lms[by_symbol]
    del by_symbol
    mark = scratch(len(t), bool, memory)
    mark[lms] = True
    ranked, filled = scratch(len(lms), np.int64, memory), len(lms)  # by LMS substring
    found = (p for p, _ in _induce(t, s_type, rough, None, 0, memory)) if few else _order(t, s_type, rough, memory)
    for p in found:
        p = p[mark[p]]
        ranked[filled - len(p) : filled] = p[::-1]
        filled -= len(p)
    stop = scratch(len(t), np.int64, memory)  # the end of the LMS substring that starts here
    stop[lms[:-1]] = lms[1:] + 1
    stop[lms[-1]] = len(t)
    name = scratch(len(t), np.int64, memory)
    name[ranked[0]], last = 1, 1
    for a, b in pieces(len(ranked) - 1, memory):
        x, y = np.asarray(ranked[a:b]), np.asarray(ranked[a + 1 : b + 1])
        n = stop[x] - x
        same = n == stop[y] - y
        same[same] = _shared_prefix_of(t, x[same], y[same], n[same])
        ids = last + np.cumsum(~same)
        name[y], last = ids, int(ids[-1])
    if last == len(lms):
        return ranked
    names = scratch(len(lms), np.int64, memory)
    names[:] = name[lms]
    del ranked, rough, mark, stop, name
    if len(names) <= memory:
        return lms[doubling(names)]
    u = _closed(names, memory)
    kinds = _types(u, memory)
    out, filled = scratch(len(lms), np.int64, memory), len(lms)
    for p in _order(u, kinds, sort_lms(u, kinds, memory), memory):
        p = p[p < len(names)]
        out[filled - len(p) : filled] = lms[p[::-1]]
        filled -= len(p)
    return out


def _shared_prefix_of(t: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n symbols at x equal those at y."""
    return _shared_prefix(t, x, y, int(n.max()) if len(n) else 0) >= n
