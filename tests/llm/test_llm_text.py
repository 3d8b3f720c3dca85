"""Kernels, suffix sorting, codec, chat and HTML: pure functions against plain ones."""

import base64
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as PT
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import ann, bpe, chat, decontaminate, html_text, sharding, suffix, textvec as tv
from gridloom.llm import substring_dedup as sub

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words_of(texts):
    raw = [t.encode() for t in texts]
    return tv.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))


texts = st.lists(st.text(alphabet="aAbÉ \n\t x\x1f", max_size=30), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_and_shingles(ts):
    w = words_of(ts)
    plain = [WORD.findall(t.translate(LOW)) for t in ts]
    assert w.counts.tolist() == [len(p) for p in plain]
    flat = list(itertools.chain(*plain))
    seen = {}
    for x, h in zip(flat, w.h.tolist(), strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    for n in (2, 4):
        u, ptr = tv.row_sets(*w.shingles(n))
        want = [{tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if len(p) >= n else ({tuple(p)} if p else set()) for p in plain]
        assert np.diff(ptr).tolist() == [len(x) for x in want]


def brute_suffixes(x):
    order = sorted(range(len(x) + 1), key=lambda i: x[i:])
    shared = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while a + k < len(x) and b + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.booleans(), st.sampled_from([3, 5, 1 << 20]), st.sampled_from([3, 1000]))
def test_suffixes_and_shared_prefixes(x, twice, memory, cap):
    x = x + x if twice else x
    got = list(suffix.suffixes(np.array(x, np.int64), cap, memory))
    pos, shared = (np.concatenate([y[k] for y in got]).tolist() for k in (0, 1))
    order, least = brute_suffixes(x)
    assert (pos[::-1], shared) == (order, [min(s, cap) for s in [0, *least[1:][::-1]]])


@pytest.mark.parametrize("memory", [50, 500, 1 << 20])
def test_suffixes_through_recursion(memory):
    """Thousands of names, periods and repeats, so that names recurse and queues spill."""
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.integers(0, 26, 2500), np.tile(rnd.integers(0, 5, 40), 20), np.zeros(200, int), rnd.integers(0, 2, 500)]).astype(np.uint8)
    x = np.concatenate([x, x[300:1800]])
    got = list(suffix.suffixes(x, 400, memory))
    pos, shared = (np.concatenate([y[k] for y in got]).tolist() for k in (0, 1))
    order, least = brute_suffixes(x.tolist())
    assert (pos[::-1], shared) == (order, [min(s, 400) for s in [0, *least[1:][::-1]]])


def test_queue_spills_in_order():
    q = suffix.SymbolQueue(3)
    for k in range(10):
        q.push(k % 2, np.array([k]), np.array([k * 10]))
    assert q.runs
    assert np.concatenate([p for p, _ in q.pop(1)]).tolist() == [1, 3, 5, 7, 9]
    assert np.concatenate([v[::-1] for _, v in q.pop(0, newest_first=True)]).tolist() == [80, 60, 40, 20, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=12, max_size=40), min_size=1, max_size=6), st.sampled_from([6, 16, 1 << 20]))
def test_repeated_windows(ts, memory):
    raw, n, words = [t.encode() for t in ts], 8, 3
    spots = [[(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", b)] for b in raw]
    two = [[(w[i][0], w[i + 2][1]) for i in range(len(w) - 2) if w[i + 2][1] - w[i][0] < n] for w in spots]
    count = Counter(b[p : p + n] for b in raw for p in range(len(b) - n + 1))
    count_two = Counter(b[x:y] for b, ws in zip(raw, two, strict=True) for x, y in ws)
    shape = np.array([len(b) | (len(b) - n) << 20 | (ws[0][0] << 30 | ws[-1][0] << 40 | ws[-1][1] << 50 if ws else 1023 << 30 | 1023 << 40 | 1023 << 50) for b, ws in zip(raw, two, strict=True)])
    for b, ws, (one, more) in zip(raw, two, sub.repeated(raw, shape, np.zeros(len(raw), bool), n, words, memory), strict=True):
        covered = {q for p in range(len(b) - n + 1) if count[b[p : p + n]] > 1 for q in range(p, p + n)}
        assert {q for x, y in zip(one[::2], one[1::2], strict=True) for q in range(x, y)} == covered
        assert list(zip(more[::2], more[1::2], strict=True)) == [(x, y) for x, y in ws if count_two[b[x:y]] > 1]


def test_shards_of_a_task_are_bounded():
    """Whole anchors, in one shard each, whatever the batches; no shard is larger than asked for."""
    rnd = random.Random(4)
    rows = [(k, bytes(rnd.randrange(1, 90))) for k in range(300) for _ in range(rnd.randrange(1, 9))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 37], strict=True)], ["anchor", "bytes"]) for i in range(0, len(rows), 37)]
    seen = []
    for t in sub._by_shard(lambda t: t, 1000)([batches[0].slice(0, 0), *batches]):
        assert sum(map(len, t.column("bytes").to_pylist())) <= 1000
        seen.append(t.column("anchor").to_pylist())
    assert sum(seen, []) == [k for k, _ in rows]
    assert all(a[-1] != b[0] for a, b in zip(seen[:-1], seen[1:], strict=True))
    assert len(seen) < 2 * sum(len(b) for _, b in rows) / 1000 + 1


@pytest.fixture(scope="module")
def codec():
    return bpe.public_codec()


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PT.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = ["", " ", "\n\n  a\n", "it's we'll 's", "x" * 3000, "aé😀　 　c 12² <|endoftext|>", "\x85a \xa0 b\x1c\x1d", "!!!???...  ,,", "a​b"]


@pytest.mark.parametrize("text", CASES)
def test_ids_equal_tiktoken(codec, reference_encoding, text):
    want = reference_encoding.encode_ordinary(text)
    assert codec.ids(text) == want
    ids, back = codec.round_trip(text)
    assert ids.decode() == " ".join(map(str, want)) and back == text.encode() == codec.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_tiktoken(codec, reference_encoding, text):
    want = reference_encoding.encode_ordinary(text)
    assert codec.round_trip(text)[0].decode() == " ".join(map(str, want))


def test_memory_of_a_worker_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    rnd = np.random.default_rng(1)
    for _ in range(30):
        codec.round_trip(".".join(f"q{x}" for x in rnd.integers(0, 10**6, 100)) + " " + " ".join(map(str, rnd.integers(0, 10**6, 30))))
        assert len(codec._pieces) <= 51 and len(codec._memo) <= 51 + 31
    codec.forget()


def test_perfect_hash(codec):
    t = codec.table
    assert all(t.get(k) == i for i, k in enumerate(codec.tokens[::97] and codec.tokens) if i % 97 == 0)
    assert t.get(b"no such entry at all") == -1 and len(t.key) == len(codec.tokens) and None not in t.key


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|>\\aé\n", max_size=20), st.text(alphabet="<|>\\user", max_size=8))
def test_rendering_reverses(text, role):
    x = chat.render(role, text)
    assert chat.read_back(x)[:2] == (role, text)
    a, b = chat.read_back(x)[2]
    assert chat.unescape(x[a:b]) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.data())
def test_min_cut_is_least(gain, data):
    n = len(gain)
    edges = [(i, j, data.draw(st.floats(0.01, 2))) for i in range(n) for j in range(i + 1, n) if data.draw(st.booleans())]
    cost = lambda s: sum(max(g, 0) if not k else max(-g, 0) for g, k in zip(gain, s, strict=True)) + sum(c for i, j, c in edges if s[i] != s[j])
    best = min(cost(s) for s in itertools.product([False, True], repeat=n))
    assert cost(html_text.min_cut(gain, edges)) == pytest.approx(best, abs=1e-6)


PAGE = """<!DOCTYPE html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body><header><h1>Site</h1><a href=/>Home</a></header>
<div class="cookie-notice"><p>We use cookies on this site to give you more of them, all the time.</p></div><nav><ul><li><a href=/a>A</a></ul></nav>
<div id=content><h1>Title &amp; more</h1><p>Para one with <a href=x>link</a>ed text&nbsp;here.<p>Second<br>line<div class="ad">Buy now</div><ul><li>one<li>two</ul>
<form>Subscribe<input name=q></form><section class="comments"><p>First! A great long comment text by a reader of this page, who knows it all.</p></section></div>
<aside class=sidebar><ul><li><a href=1>Related</a></ul></aside><footer>&copy; me</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more Para one with linked text here. Second line one two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>menu</nav>") == ""
    assert html_text.main_text("<article><p>a < b <i>c</article>") == "a < b c"
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


LONG = "A long paragraph of prose goes on for a while and tells what the page is about, with some commas, so that it is seen as text. " * 3


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Let <math><mi>x</mi></math> be…</article>", "Let x be…"),
        (f'<article><p>{LONG}<div class="side-effects"><p>{LONG}</div></article>', f"{LONG} {LONG}"),
        (f"<body><div><p>{LONG}<p>Short.</div></body>", f"{LONG} Short."),
        (f"<body><div><p>Short.<p>{LONG}<p>End.</div><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></body>", f"Short. {LONG} End."),
        (f'<body><ul class="menu"><li><a href=/>Home</a></ul><div><p>{LONG}</div><div id="site-footer"><p>Imprint and terms</div></body>', LONG),
        (f'<article><h1>Title</h1><p>{LONG}<aside>Read also <a href=/x>this</a></aside><div class="cookie-notice">We use cookies</div><p>{LONG}<section id="comments"><p>{LONG}</section></article>', f"Title {LONG} {LONG}"),
        (f'<article><header class="entry-header"><h1>Title</h1></header><p>{LONG}<div class="ad-slot-1">Buy now</div><form><label>Mail<input></label></form></article>', f"Title {LONG}"),
        (f'<div class="postBody"><p>{LONG}<p>Two words</div><div class="newsletterSignup"><p>{LONG}</div>', f"{LONG} Two words"),
    ],
)
def test_main_text_of_pages_by_hand(page, text):
    """Pages without <article>, notices and comments inside one, names that only sound like boilerplate."""
    assert html_text.main_text(page) == " ".join(text.split())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/!-abp \"'=", max_size=60))
def test_broken_markup_never_fails(html):
    html_text.main_text(html)


def test_candidates_are_checked_without_array_calls(monkeypatch):
    """A window has too few words for them: they were most of the search's time."""
    item = "one two three four five six seven eight nine ten two three"
    h = decontaminate._words(item)
    vocab, col = np.unique(h, return_inverse=True)
    v = np.bincount(col).astype(np.float32)
    index = decontaminate.Index(vocab, np.ones(len(vocab)), 1.0, np.eye(len(vocab), dtype=np.float32), (v / np.linalg.norm(v))[None], np.array([0.2], np.float32), np.array([7]), [h], [vocab[:3]])
    monkeypatch.setattr(np, "isin", None)
    found = list(decontaminate._found(*decontaminate._lower(pa.array([f"x y {item} z", "one two other words", item.replace("six", "6")])), [index]))
    assert [(r, i, round(f[1], 4), f[2] > 0.5) for r, i, f in found] == [(0, 7, 1.0, True), (2, 7, round(11 / 12, 4), True)]


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = (rng.integers(0, 4, rng.integers(0, 15)).tolist() for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_fisher_yates_is_uniform_and_repeatable():
    counts = {}
    for seed in range(6000):
        p = tuple(sharding.fisher_yates(3, seed, 0).tolist())
        counts[p] = counts.get(p, 0) + 1
    assert len(counts) == 6 and max(counts.values()) < 1200 and min(counts.values()) > 800
    assert sharding.fisher_yates(50, 1, 2).tolist() == sharding.fisher_yates(50, 1, 2).tolist()


def test_rotation_is_orthogonal():
    q = ann.rotation(16)
    assert np.allclose(q @ q.T, np.eye(16))


@pytest.mark.parametrize("d", [2, 64, 100])
def test_inner_products_from_packed_bits(d):
    """The bits that code and planes share give <x, q> up to the rounding's norm."""
    rnd = np.random.default_rng(d)
    q = rnd.standard_normal((7, d))
    q /= np.linalg.norm(q, axis=1)[:, None]
    bits = rnd.random((50, d)) < 0.5
    code = np.packbits(np.pad(bits, ((0, 0), (0, -d % 64))), axis=1).view(np.uint64)
    plane, low, step, rounding = ann.planes(q)
    exact = q @ ((bits * 2.0 - 1) / np.sqrt(d)).T
    assert (np.abs(ann.inner(code, plane, low, step, d) - exact) <= rounding[:, None] + 1e-12).all() and rounding.max() < 0.1


def test_anchors_in_pieces_cover_the_same_windows():
    rnd = np.random.default_rng(3)
    x = rnd.integers(97, 100, 1500).astype(np.uint8)
    x[rnd.random(1500) < 0.25] = 32
    x[200:300] = 97
    off = np.array([0, 1500])

    def windows(piece):
        """The anchor of every window of 40 bytes and of 8 words, by its start; each window once."""
        out = {}
        for _, s, f in sub._pieces(x, off, 40, 8, 12, True, piece):
            for a, shape, h in zip((f.lo + s).tolist(), f.shape.tolist(), f.anchor.tolist(), strict=True):
                part = [shape >> 10 * k & 1023 for k in range(6)]
                raw = np.concatenate([[32], x[a : a + part[0]], [32]]).astype(np.uint8)
                two = sub.word_windows(raw, np.array([1]), np.array([shape]), 40, 8)[0] - 1
                for kind, at in ((0, range(part[1], part[2] + 1) if part[1] != 1023 else ()), (1, two.tolist())):
                    for p in at:
                        assert (kind, a + p) not in out
                        out[kind, a + p] = h
        return out

    whole = windows(1 << 20)
    assert whole == windows(100) == windows(333) and sum(k == 0 for k, _ in whole) == 1461 and sum(k == 1 for k, _ in whole) > 50
