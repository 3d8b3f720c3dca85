"""Packing, Merkle manifest and whitening against brute force; nulls, ties, repeats, long texts, empty tables, clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import merkle, packing, whitening

DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, repeated rows, ids that tie, line ends, long texts, and columns named like inner ones."""
    long = "".join(f"w{i % 977} v{i % 31}\n" for i in range(9000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "x\ny", "a"), (4, "x\ny", "a"), (4, "other", "a"), (None, "no id\n", "a"), (None, None, None), (5, long, "é"), (6, long, "é"), (-7, "minus\n", ""), (8, "<|endoftext|> a  b <|endoftext|>", "b")]
    rows += [(100 + i, f"text {i}\n" * (i % 5), "many") for i in range(40)]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", s, len(t or ""), 1, "p", 2, "u", "n") for i, t, s in rows], DOCS + ", length int, part string, i int, path string, white string")


def test_parts_give_the_ids_of_the_whole_text(tokenizer):
    rnd, encoder = random.Random(3), packing.Encoder(PATH)
    bits = ["a", " ", "  ", "\n", "\t", "é", "don't", "I'll", "12", ".", "!?", " ", "　", "\u0085", "\x1c", "​", "<|endoftext|>", "word", "ſ", "😀", "\r\n", "x" * 70]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["", " ", "y" * 5000, " y" * 5000]
    got = encoder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_signs_after_letters_are_not_encoded_again(monkeypatch, tokenizer):
    """A word with a sign after it takes its ids from the word alone; other ends, letters beyond ASCII and what was met before go on giving the library's ids."""
    monkeypatch.setattr(packing, "MEMO", 4)
    encoder, given = packing.Encoder(PATH), []
    joined = encoder._joined
    monkeypatch.setattr(encoder, "_joined", lambda parts: joined([given.append(p) or p for p in parts]))
    texts = ["so word, word. word word,. é, don't, 12. a", "x word. other, other.\nNext, next. " + "y" * 80 + ", word", "x ., . , ,"]
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert "word" in given and not {"word,", "word.", "other,", "other.", "next."} & set(given)


def test_long_texts_go_through_in_slices(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "SLICE", 50)
    encoder, text = packing.Encoder(PATH), "one  two three\n four " * 40
    assert "".join(map(encoder.whole, (p for s in encoder.slices(text) for p in s)))[1:] == text and len(list(encoder.slices(text))) > 5
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_part_is_looked_up_once_a_block(monkeypatch, tokenizer):
    """However often a block has a part, Python meets it once; texts with white space beside white space long ones in the same block, and a full memo change no ids."""
    seen = Counter()

    class Counted(dict):
        def get(self, key, default=None):
            seen[key] += 1
            return super().get(key, default)

        def __getitem__(self, key):
            seen[key] += 1
            return super().__getitem__(key)

    encoder = packing.Encoder(PATH)
    encoder.memo = Counted()
    ids = lambda texts: [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = lambda texts: [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(pa.array(texts, pa.string()))]
    texts = ["so it is, so it is\nso it is" * 40, "it is so", "is"]
    for _ in range(2):
        seen.clear()
        assert got(texts) == ids(texts)
        assert seen["it"] and max(seen.values()) == 1
    monkeypatch.setattr(packing, "BLOCK", 300)
    texts = ["", " ", "\n", "a\n", "\na", "a \nb", "a\n b", "a\n\nb", "a\tb c\t d", "tab\t", "x tab\t", "x tab\t y", "\x00 a\x1f b\x85", "a\r\nb c\r\nd", "é\nÉa, né. 12, a%%% '%% x's,", "ab " * 200 + "ab", "y" * 500, "a " + "y" * 90, "<|endoftext|> a <|endoftext|>, b"]
    for memo, characters in ((4, 20), (100, 1 << 19)):
        monkeypatch.setattr(packing, "MEMO", memo)
        monkeypatch.setattr(packing, "SLICE", characters)
        for some in (texts, texts[::-1], texts[3:4], [], texts * 3):
            assert got(some) == ids(some)
    assert not any(len(p) > 64 or p != p.strip() and packing.Encoder.beside(p) for p in encoder.memo)


def test_signs_after_latin_letters(monkeypatch, tokenizer):
    """The same for all letters that ``LETTERS`` names: the library splits signs from each of them, and a word with a sign isn't given to it."""
    encoder, given = packing.Encoder(PATH), []
    joined = encoder._joined
    monkeypatch.setattr(encoder, "_joined", lambda parts: joined([given.append(p) or p for p in parts]))
    letters = [c for c in map(chr, range(0x300)) if re.match(f"[{packing.LETTERS}]", c)]
    texts = [f"x {c}{sign} a{c}{sign} {c}b{sign} ª{sign} {c}{sign}{sign}" for c in letters for sign in ",.!"]
    for kind in (pa.string(), pa.large_string()):
        assert encoder.encode(pa.array(texts, kind)) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(letters) == 450 and "é" in given and "aé!" in given and not {"é,", "é.", "aé,", "éb."} & set(given)


def test_blocks_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 10)
    sizes = [3, 7, 1, 0, 25, 0, 10, 4, 4, 4, 0, 11, 11, 2]
    rows = pa.table({"doc_id": range(len(sizes)), "text": ["x" * n for n in sizes]})
    for step in (1, 3, 100):
        own = list(packing.blocks(iter(rows.to_batches(step))))
        assert [k for t in own for k in t.column(0).to_pylist()] == list(range(len(sizes)))
        assert [[len(x) for x in t.column(1).to_pylist()] for t in own] == [[3, 7], [1, 0], [25], [0, 10], [4, 4], [4, 0], [11], [11], [2]]
    assert not list(packing.blocks(iter([])))


def checked(rows, texts, tokenizer, capacity):
    """Every piece where the contract wants it; returns the number of sequences."""
    want = Counter()
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= capacity
    return len(by)


def test_op11_packing(spark, odd, tokenizer):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = packing.op11(spark, DIR).collect()
    n = checked(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
    packed = packing.pack(odd.repartition(3), PATH, 64)
    rows = packed.collect()
    n = checked(rows, [(r.doc_id, r.text) for r in odd.collect()], tokenizer, 64)
    assert n == -(-sum(r.length for r in rows) // 64)
    whole = packing.sequences(packed).collect()
    assert len(whole) == n and sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_plans_are_near_their_bound():
    rnd = random.Random(5)
    for capacity in (10, 64, 300):
        for _ in range(20):
            histogram = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 2000) for _ in range(rnd.randrange(1, 40))}
            p, have = packing.plan(histogram, capacity), Counter()
            for times, found in p.configurations:
                assert sum(s * a for s, a in found.items()) <= capacity
                for s, a in found.items():
                    have[s] += times * a
            assert have == histogram and p.bound <= p.sequences
            assert p.sequences <= 1.2 * p.bound + 1
    assert packing.plan({683: 10, 682: 10}).sequences == 7 and packing.plan({1025: 5, 1: 3}).sequences == 5
    big = packing.plan({k: 10**9 for k in range(1, 2048)})
    assert big.sequences <= 1.001 * big.bound and len(big.configurations) < 60_000


def brute_merkle(rows):
    """The contract, list by list."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, text: digest("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def climb(levels, i, changed):
        sib, now = "", changed
        for nodes in levels[:-1]:
            run = nodes[i - i % 3 : i - i % 3 + 3]
            sib += "".join(run[: i % 3] + run[i % 3 + 1 :])
            now = digest("".join([*run[: i % 3], now, *run[i % 3 + 1 :]]))
            i //= 3
        return sib, now

    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s] = sorted(((leaf_of(r, r.text), r) for r in by[s]), key=lambda x: (x[1].doc_id is not None, x[1].doc_id or 0, x[0]))
    trees = {s: tree([x for x, _ in by[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for i, (own, r) in enumerate(by[s]):
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            low, now = climb(trees[s], i, leaf_of(r, r.text.replace("\n", "")) if even and r.text is not None else own)
            high, now = climb(top, k, now)
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], digest(low + high), now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("tall", [1, 2, 9])
def test_op12_merkle(spark, odd, tall):
    def run(df):
        own = {c: F.col(c) for c in merkle.FIELDS}
        text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
        bad = F.when(F.pmod(merkle.fold_id(F.col("doc_id")), F.lit(2)) == 0, merkle.leaf(**(own | {"text": text})))
        return merkle.certified(merkle.manifest(df.select("source", "doc_id", merkle.leaf(**own).alias("leaf"), bad.alias("bad")), tall), "bad")

    got = run(odd.repartition(4)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_merkle(odd.collect()))
    assert any(not r.verified for r in got) and run(odd.limit(0)).count() == 0
    one = odd.filter("doc_id = 2")
    assert list(map(tuple, run(one).collect())) == brute_merkle(one.collect())


def test_op12_query_and_sql(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    got = Counter(map(tuple, merkle.op12(spark, DIR).collect()))
    assert got == Counter(brute_merkle(docs))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    assert Counter(c.sql(merkle.OP12_SQL).fetchall()) == got


def brute_whitening(rows, k=8):
    x = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            x.setdefault(len(v), []).append((i, [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]))
    own = max(x.values(), key=len)
    m = np.array([v for _, v in own], dtype=object)
    n, s = len(m), m.sum(0)
    centred = ((m * n - s) / n).astype(float)
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    deviation = ((m * n - s) ** 2).sum(1)
    return {(i, c + 1): (n, int(d), float(w @ vectors[:, c] / np.sqrt(e[c])), e[c] / e.sum()) for (i, _), d, w in zip(own, deviation, centred) for c in range(min(k, len(e)))}


def same(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    signs = {}
    for r in got:
        n, d, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, d) and abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(w) > 1e-3:
            assert signs.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(r.whitened) - abs(w)) < 1e-7


def test_op13_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(whitening.op13(spark, DIR).collect(), brute_whitening(rows))


def test_whitening_of_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1 + k) * (1000 if i == 5 else 1) for k in range(5)], "w", 1) for i in range(60)]
    rows += [(1000, None, "w", 1), (1001, [], "w", 1), (1002, [1.0, None, 1.0, 1.0, 1.0], "w", 1), (1003, [float("nan")] * 5, "w", 1), (1004, [float("inf")] + [0.0] * 4, "w", 1), (1005, [1.0, 2.0], "w", 1), (1006, [1e20] * 5, "w", 1)]
    schema = "vec_id long, embedding array<float>, white string, id int"
    df = spark.createDataFrame(rows, schema)
    got = whitening.whiten(df).collect()
    same(got, brute_whitening([(i, v) for i, v, *_ in rows if i != 1006]))
    twice = spark.createDataFrame([(1, v, w, k) for _, v, w, k in rows[:60]], schema)
    assert whitening.whiten(twice, k=2).filter("vec_id = 1").count() == 120
    assert whitening.whiten(df.limit(0)).count() == 0
    alike = spark.createDataFrame([(i, [1.0, 2.0], "w", 1) for i in range(5)], schema)
    assert whitening.whiten(alike).count() == 0
    line = spark.createDataFrame([(i, [float(i), 3.0], "w", 1) for i in range(5)], schema)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    large = spark.createDataFrame([(i, [float(i) * 2**33, float(i % 2)], "w", 1) for i in range(5)], schema)
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(large).collect() if r.deviation} == {(k[0], w[1]) for k, w in brute_whitening([(i, [float(i) * 2**33, float(i % 2)]) for i in range(5)]).items() if w[1] < 2**63}
