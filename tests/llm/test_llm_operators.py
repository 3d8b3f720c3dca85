"""The operators over small tables, against brute force; nulls, empty tables, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F

from gridloom.llm import ann, bpe, chat, decontaminate, graph, html_text, language_model, neardup, quality, registry, sharding
from gridloom.llm import substring_dedup as sub

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall((t or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, long and repeated texts under columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 977} v{i % 31}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 9
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, long), (7, long), (8, base), (9, base + "x"), (10, "É😀 <|end|> \\ x")]
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3, "k") for i, t in rows], DOCS + ", size int, shard int, text_to_score int, rep string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 8), (5, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.v: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 2 for i in (2, 3, 4, 5)}, 8: 8, 9: 8, **{i: 100 for i in range(100, 141)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(texts, n=4):
    sets = {i: ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())) for i, w in ((i, words(t)) for i, t in texts.items())}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups(spark, odd, empty):
    rnd = random.Random(4)
    base = [f"t{rnd.randrange(500)}" for _ in range(120)]
    rows = [(100 + k, " ".join(w if rnd.random() > 0.002 * (k % 25) else "zz" for w in base)) for k in range(90)]
    rows += [(300 + k, " ".join(base[:60] + [f"u{k}_{j}" for j in range(50)])) for k in range(40)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(df, 4).collect()}
    assert got == brute_groups({r.doc_id: r.text for r in df.collect()})
    assert neardup.near_groups(empty).count() == 0
    kept = neardup.keep_one(odd.unionByName(odd))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 10]


def test_near_groups_of_rows_that_share_a_doc_id_or_have_none(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    morse = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024)) for flip in (0, 1)]
    rows = [(1, one), (1, two), (2, one), (3, two), (None, two), (None, three), (None, three), (4, None), (None, None), (5, morse[0]), (6, morse[1])]
    df = spark.createDataFrame([(*r, "r", 0) for r in rows], "doc_id long, text string, rep string, component int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in neardup.near_groups(df).collect())
    assert got == [(0, 0, 0), (0, 36, 0), (0, 36, 0), (0, 36, 1), (1, 36, 1), (1, 36, 1), (2, 36, 1), (3, 36, 1), (4, 0, 4), (5, 1, 5), (6, 1, 6)]
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept.collect()) == [(0, ""), (0, "c0"), (1, "a0"), (1, "b0"), (4, ""), (5, "ab"), (6, "ba")]


def test_op5(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op5_minhash"](spark, DIR).collect()}
    assert got == brute_groups({r.doc_id: r.text for r in docs.collect()})


def brute_cut(texts, n):
    seen, dup = set(), set()
    for b in texts.values():
        for p in range(len(b) - n + 1):
            x = b[p : p + n]
            (dup if x in seen else seen).add(x)
    out = {}
    for i, b in texts.items():
        keep = np.ones(len(b), bool)
        for p in range(len(b) - n + 1):
            if b[p : p + n] in dup:
                keep[p : p + n] = False
        edge = np.diff(np.concatenate([[1], keep.astype(int)]))
        kept = np.frombuffer(b, np.uint8)[keep].tobytes()
        out[i] = (len(b), len(b) - len(kept), int((edge == -1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_op2(spark, docs):
    got = {r.doc_id: tuple(r)[1:5] for r in registry.queries()["op2_suffix_dedup"](spark, DIR).collect()}
    assert got == brute_cut({r.doc_id: (r.text or "").encode() for r in docs.collect()}, 400)


def brute_passage_bytes(rows, length, n):
    """Bytes in repeated strings of ``length`` bytes, or of n words and fewer bytes."""
    windows = []
    for t in rows:
        w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        windows.append([(p, p + length) for p in range(len(t) - length + 1)] + [(w[i][0], w[i + n - 1][1]) for i in range(len(w) - n + 1) if w[i + n - 1][1] - w[i][0] < length])
    count = Counter((b - a, t[a:b]) for t, ws in zip(rows, windows, strict=True) for a, b in ws)
    return [len({p for a, b in ws if count[b - a, t[a:b]] > 1 for p in range(a, b)}) for t, ws in zip(rows, windows, strict=True)]


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 3000, "memory": 2000}, {"memory": 20_000}])
def test_op2_with_hot_anchors_and_shards_larger_than_memory(spark, tmp_path, how):
    """Rows that share a doc_id or have none, passages among other words, repeats within a text."""
    rnd = random.Random(12)
    some = lambda n: " ".join(f"{rnd.choice('abcdefg')}{rnd.randrange(50)}" for _ in range(n))
    hot, long, short = some(51), some(160), some(50)
    texts = [f"{some(40)} {p} {some(30)}" for p in (hot, long, short, "\n".join(long.split())) for _ in range(12)] + [None, "", long, long + long, "x" * 900, "y" * 401, "é" * 500]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, n_bytes string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode() for t in texts]
    want = list(zip(*([w[k] for w in brute_cut(dict(enumerate(raw)), 400).values()] for k in range(4)), brute_passage_bytes(raw, 400, 51), strict=True))
    got = sub.op2(spark, str(tmp_path), **how).collect()
    assert Counter(map(tuple, got)) == Counter((i, *w) for i, w in zip(ids, want, strict=True))
    assert sum(w[4] > w[1] for w in want) >= 12


def test_substring_dedup_of_periodic_and_odd_texts(spark, odd, empty):
    rnd = random.Random(1)
    bits = ["".join(rnd.choice("ab") for _ in range(30)) for _ in range(6)]
    texts = {i: "".join(rnd.choice(bits) for _ in range(rnd.randrange(6))) + "a" * rnd.randrange(60) for i in range(40)}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, cover string")
    want = brute_cut({i: t.encode() for i, t in texts.items()}, 40)
    cut = sub.dedup(df, 40, 16)
    assert cut.columns == df.columns
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()} == {i: w[3] for i, w in want.items()}
    got = {r.doc_id: r.text for r in sub.dedup(odd, 40, 16).collect()}
    assert got[1] is None and got[4] == "One" and got[6] == got[7] == "" and len(got) == 10
    assert sub.dedup(empty).count() == 0


def test_decontamination(spark, docs, odd, empty):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    bench = [(r.item_id, plain(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in bench if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in registry.queries()["op1_decontaminate"](spark, DIR).collect()}
    assert want and got == want
    rnd, clean = random.Random(2), [r.text for r in docs.filter("n_chars BETWEEN 500 AND 3000").collect()]
    vocabulary = " ".join(clean).split()
    rows = []
    for k, r in enumerate(items.collect()):
        changed = [w if rnd.random() > 0.12 else rnd.choice(vocabulary) for w in r.text.split()]
        host = rnd.choice(clean).split()
        at = rnd.randrange(len(host))
        rows.append((k, r.item_id, " ".join(host[:at] + changed + host[at:])))
    para = spark.createDataFrame(rows, "doc_id long, item long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(para, items).collect()}
    assert sum((k, i) in found for k, i, _ in rows) >= 0.9 * len(rows)
    bad = {d for d, _ in want}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - bad
    assert decontaminate.leaks(odd, items).count() == 0 and decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.leaks(empty, items).count() == 0
    none = spark.createDataFrame([(1, None), (2, " ")], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.clean(docs, none.limit(0)).count() == docs.count()


def test_every_verbatim_item_of_a_large_benchmark_is_found(spark):
    rnd = random.Random(5)
    word = lambda: f"w{int(rnd.paretovariate(0.5)) % 20_000}"
    items = [(k, " ".join(word() for _ in range(40))) for k in range(2000)]
    rows = [(k, " ".join([*(word() for _ in range(rnd.randrange(40))), t, *(word() for _ in range(rnd.randrange(40)))])) for k, t in items]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(k, k) for k, _ in items} <= {(r.doc_id, r.item_id) for r in found.collect()}


def test_one_passage_of_a_long_item_is_a_leak(spark):
    item = [f"word{k}" for k in range(192)]
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(k, f"{other} {' '.join(item[48 * k : 48 * k + 48])} {other}") for k in range(4)] + [(9, other)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(k, 7) for k in range(4)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [9]


def test_randomised_svd(spark):
    a = np.random.default_rng(0).normal(size=(40, 12)) @ np.diag(2.0 ** -np.arange(12)) @ np.random.default_rng(1).normal(size=(12, 30))
    rows = [(list(range(30)), list(map(float, r))) for r in a]
    v = decontaminate.randomised_svd(spark, rows, 30, 5)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(np.linalg.norm(a @ v, axis=0), s[:5], rtol=0.02) and np.allclose(v.T @ v, np.eye(5), atol=1e-6)


def test_op3(spark):
    conv = spark.read.parquet(f"{DIR}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:5] for r in registry.queries()["op3_chat"](spark, DIR).collect()}
    turns = {}
    for r in conv.orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    control = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", control), ("assistant", control)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {k: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"), sha("".join(b for a, b in t if a == "assistant"))) for k, t in turns.items()}


def test_folding_of_a_log(spark):
    log = [(1, 0, 1, 0, "start", "user", "h"), (1, 0, 1, 1, "delta", None, "i"), (1, 1, 1, 0, "start", "assistant", ""), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 1, "delta", None, "bad"), (1, 1, 1, 3, "delta", None, "go"), (1, 1, 1, 4, "delta", None, "od"), (1, 2, 1, 0, "start", None, None), (1, 2, 1, 1, "edit", None, "new")]
    got = sorted((r.turn, r.role, r.text) for r in chat.fold(spark.createDataFrame(log, chat.LOG)).collect())
    assert got == [(0, "user", "hi"), (1, "assistant", "good"), (2, "", "new")]
    assert chat.fold(spark.createDataFrame([], chat.LOG)).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(chat.fold(chat.as_log(twice)))).first().n_turns == 3


def test_sharding(spark, docs, odd, empty, tmp_path):
    rows = registry.queries()["op4_sharding"](spark, DIR).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in sizes.items())
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id])) for r in rows) and len(rows) == len(text)
    clash = docs.selectExpr("*", "-1 AS size", "99 AS shard", "-5 AS slot", "0 AS bucket_")
    clash.repartition(2).write.parquet(str(tmp_path / "clash/documents.parquet"))
    again = sharding.op4(spark, str(tmp_path / "clash")).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in again} == {(r.doc_id, r.size, r.text_crc32) for r in rows} and {r.shard for r in again} == set(range(24))
    sharding.write_shards(clash, str(tmp_path / "named"), 3)
    named = spark.read.parquet(str(tmp_path / "named"))
    assert {r[0] for r in named.select("shard_1").distinct().collect()} == {0, 1, 2} and named.filter("shard = 99 AND slot = -5 AND size = -1").count() == docs.count()
    many = odd.unionByName(odd).unionByName(odd)
    dealt = sharding.shuffle(many, 4, bucket_bytes=100_000)
    assert {"size_1", "shard_1", "slot"} <= set(dealt.columns) and dealt.count() == 30
    assert sorted(Counter(r.shard_1 for r in dealt.collect()).values()) == [7, 7, 8, 8]
    assert sharding.shuffle(empty, 4).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def brute_tree(train, floor, least, depth):
    """log10 P(word | history) of the suffix tree over token lists, by definition."""
    mu, rate = language_model.MU, language_model.GAIN
    grams = [Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(1, depth + 2)]
    n, v = sum(grams[0].values()), len(grams[0])
    root = lambda w: (grams[0][(w,)] + 0.1) / (n + 0.1 * (v + 1))
    probs, states = {g: root(g[0]) for g in grams[0]}, {}
    for k in range(1, depth + 1):
        stored = {}
        for g, m in grams[k].items():
            if m >= floor and grams[k - 1][g[:-1]] >= least:
                stored.setdefault(g[:-1], {})[g[-1]] = m
        for s, ms in stored.items():
            c, q = grams[k - 1][s], {w: probs[(*s[1:], w)] for w in ms}
            left = c - sum(ms.values())
            gain = sum(m * math.log(m / c / q[w]) for w, m in ms.items()) + (left * math.log(left / c / max(1 - sum(q.values()), 1e-9)) if left else 0)
            probs |= {(*s, w): (m + (left + mu) * q[w]) / (c + mu) for w, m in ms.items()}
            states[s] = c, left, ms, gain >= rate * c and gain >= 0.5 * len(ms) * math.log(max(c, 2))
    kept = {s[i:] for s, x in states.items() if x[3] for i in range(len(s))}

    def log_p(history, w):
        p = root(w)
        for k in range(1, depth + 1):
            s = tuple(history[-k:])
            if len(s) < k or s not in kept:
                break
            c, left, ms, _ = states[s]
            p = (ms.get(w, 0) + (left + mu) * p) / (c + mu)
        return math.log10(p)

    return log_p, kept


@pytest.mark.parametrize("how", [{}, {"floor": 2, "least": 4, "hot": 2.0**-9}, {"floor": 3, "least": 5, "depth": 2, "hot": 1.0}, {"floor": 2, "least": 3, "depth": 6}])
def test_op6(spark, docs, how):
    got = {r.doc_id: r for r in language_model.op6(spark, DIR, **how).collect()}
    toks = {r.doc_id: [*words(r.text), None] for r in docs.collect()}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    log_p, kept = brute_tree([toks[i] for i in sorted(train)], how.get("floor", language_model.FLOOR), how.get("least", language_model.LEAST), how.get("depth", language_model.DEPTH))
    assert len(got) == len(toks) and {len(s) for s in kept} >= {1, 2}
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score == pytest.approx(sum(log_p(ws[max(0, k - 6) : k], w) for k, w in enumerate(ws)))
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_tree_distributions_sum_to_one(spark):
    texts = ["a b a b a b c", "a b a b a b d", "b c a a b c", "a b a b"] * 6
    log_p, kept = brute_tree([[*t.split(), None] for t in texts], 1, 1, 4)
    assert any(len(s) > 2 for s in kept)
    asked = [[*h, w] for h in ([], ["a"], ["b", "a"], ["a", "b"], ["zz", "a"], ["a", "b", "a", "b"]) for w in ("a", "b", "c", "d", "unseen")]
    tree, table, n, v = language_model.learn(spark.createDataFrame([(t,) for t in texts], "text string"), 1, 1, 4)
    rows = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(asked)], "row long, doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(rows, tree, table, n, v).collect()}
    whole = [[*t, None] for t in asked]
    assert [got[i] for i in range(len(asked))] == pytest.approx([sum(log_p(t[:k], w) for k, w in enumerate(t)) for t in whole])
    for k in range(0, len(asked), 5):
        history = asked[k][:-1]
        assert sum(10 ** log_p(history, w) for w in ("a", "b", "c", "d", None, "unseen")) == pytest.approx(1.0)


def test_grams_are_counted_in_blocks():
    """Blocks of different tasks, dealt by bucket, give the n-grams of ``floor`` occurrences; a block is bounded."""
    rnd = np.random.default_rng(5)
    rows, want = [], Counter()
    for _ in range(3):
        context, rest, n = rnd.integers(0, 40, 4000).astype(np.uint64), rnd.integers(0, 400, 4000).astype(np.uint64), rnd.integers(1, 3, 4000)
        for c, r, k in zip(context.tolist(), rest.tolist(), n.tolist(), strict=True):
            want[c, r] += k
        x = language_model._compact([[language_model.gram_key(context, rest), context, rest, n]])
        rows += [row for b in language_model._blocks(x, 2) for row in b.to_pylist()]
    assert 12 <= len(rows) < 30 and max(len(r["n"]) for r in rows) <= 8 * language_model.BLOCK
    rows.sort(key=lambda r: r["bucket"])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 5]) for i in range(0, len(rows), 5)]
    got = [(r["context"], r["rest"], r["n"], r["key"]) for b in language_model._merged(4)(batches) for r in b.to_pylist()]
    assert {(c, r): n for c, r, n, _ in got} == {k: n for k, n in want.items() if n >= 4} and len(got) == len({k for *_, k in got})


def test_tree_keeps_contexts_by_count_in_any_corpus(spark):
    """A context of LEAST occurrences among nine million tokens is kept with its continuation, in the table or in the hot part."""
    often = spark.createDataFrame([("once upon time",)] * language_model.LEAST, "text string")
    many = spark.range(0, 1000, 1, 4).selectExpr("concat_ws(' ', transform(sequence(1, 9000), i -> concat('x', i % 50))) AS text").unionByName(often)
    tree, table, n, _ = language_model.learn(many)
    assert n > 8 * 2**20
    h = language_model.tokens(language_model.tv.Words(np.frombuffer(b"once upon", np.uint8), np.array([0, 9])))[0]
    key = language_model.gram_key(h[:1], h[1:2])
    assert (tree.gram.find(key)[0] >= 0) + table.filter(F.col("key") == int(key.view(np.int64)[0])).count() == 1


def test_language_model_of_odd_texts(spark, odd, empty):
    df = odd.unionByName(odd).select("doc_id", "text").withColumn("held_out", F.lit(False)).withColumn("row", F.monotonically_increasing_id())
    df = df.withColumn("text", F.coalesce("text", F.lit("")))
    tree, counts, n, v = language_model.learn(df.select("text"))
    out = language_model.score(df, tree, counts, n, v).collect()
    assert len(out) == 20 and {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    t0 = language_model.learn(empty.select("text"))
    assert t0[2:] == (0, 0) and language_model.score(df, *t0).filter("n_known > 0").count() == 0


def test_op7(spark, docs, odd, empty):
    codec = bpe.public_codec()
    for r in registry.queries()["op7_bpe"](spark, DIR).join(docs, "doc_id").collect():
        ids = codec.ids(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(odd.withColumn("ids", F.lit(1)), codec), codec, "ids_1")
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    assert bpe.encode(empty, codec).count() == 0


def test_op8(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in registry.queries()["op8_ann"](spark, DIR).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = np.lexsort((ids, d))[:10]
        mine = [got[q][k] for k in range(1, 11)]
        hit += len({v for v, _ in mine} & set(ids[want].tolist()))
        assert all(s == pytest.approx(d[ids == v][0], rel=1e-12) for v, s in mine) and [s for _, s in mine] == sorted(s for _, s in mine)
    assert hit >= 0.98 * 10 * len(got)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [3.0, 0.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 100 = 0").orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 7, 2.0)]
    twice = spark.createDataFrame([(0, [1.0, 0.0], 9), (0, [1.0, 0.5], 9), (3, [1.0, 0.0], 9)], "vec_id long, embedding array<float>, row int")
    out = sorted(tuple(r) for r in ann.search(twice, "vec_id % 100 = 0").collect())
    assert out == [(0, 1, 0, 0.5), (0, 1, 3, 0.0), (0, 2, 0, 0.5), (0, 2, 3, 0.5)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 100 = 0").count() == 0


def test_op9(spark):
    from html import unescape

    got = {r.page_id: r.text for r in registry.queries()["op9_html"](spark, DIR).collect()}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "<p>")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_text.extract(odd).collect()] == [("", 0)] * 3


@pytest.mark.parametrize(
    "piece, text",
    [('<svg viewBox="0 0 1 1"/>', ""), ("<math/>", ""), ("<svg><path d='M0 0'/><title/>", ""), ('<svg aria-hidden="true">', ""), ("<button>", ""), ("<select>", ""), ("<object>", ""), ("<canvas>", ""), ("<button/>", ""),
     ("<button>Share</button>", ""), ("<select><option>One<option>Two</select>", ""), ("<math><mi>x</mi> = <mn>2</mn></math>", "x = 2"), ("<object>Fallback</object>", "Fallback"), ("<canvas>Chart</canvas>", "Chart")],
)
def test_embedded_elements_cut_nothing_off(piece, text):
    one, two = "The first paragraph has some words of prose in it.", "The second paragraph has some other words of prose."
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><p>{one} {piece} Then more.</p><p>{two}</p></article><footer>Imprint <button>Go</button></footer></body></html>"
    assert html_text.main_text(page) == " ".join(f"{one} {text} Then more. {two}".split())


def test_op10_on_held_out_labels(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.fit(docs, labels.filter(~fold))
    both = quality.score(docs, model).join(labels.filter(fold), "doc_id").collect()
    good = [r for r in both if r.quality == 1 and r.toxic == 0]
    bad = [r for r in both if r.quality == 0]
    assert sum(r.selected for r in good) >= 0.97 * len(good) and sum(not r.selected for r in bad) >= 0.9 * len(bad)
    assert model.theta.tolist() == sorted(model.theta.tolist())
    nothing = quality.fit(docs, labels.limit(0))
    assert quality.score(odd, nothing).filter("NOT selected").count() == 0 and quality.score(empty, nothing).count() == 0
    graded = spark.createDataFrame([(i, i % 4 - 1, 0) for i in range(1, 41)], "doc_id long, quality int, toxic int")
    four = spark.createDataFrame([(i, f"level{i % 4} word{i % 7} " * (i % 3 + 3)) for i in range(1, 41)] + [(1, "level1 more")] * 50, "doc_id long, text string")
    model = quality.fit(four, graded, min_df=2)
    assert model.levels.tolist() == [0, 1, 2, 3] and len(model.theta) == 3
    expected = {r.doc_id: r.expected_grade for r in quality.score(four.filter("doc_id > 1"), model).collect()}
    assert all(0 <= x <= 3 for x in expected.values()) and max(expected[i] for i in (4, 8, 12)) < min(expected[i] for i in (3, 7, 11))
    kept = quality.select(odd, labels, fit_on=docs)
    origin = quality.fit(docs, labels).tails(np.zeros(1))[0, -1] >= 0.6  # what a text without features gets
    assert kept.columns == odd.columns and kept.filter("text IS NULL").count() == kept.filter("text = ''").count() == int(origin)


def test_pipeline_cuts_repeated_passages_by_words(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(6)
    some = lambda n, k: [f"{chr(97 + rnd.randrange(26))}{k if k else ''}" for _ in range(n)]
    short, fifty, long = some(51, 0), some(50, 0), [f"longword{rnd.randrange(10**6)}" for _ in range(50)]
    texts = [" ".join([*some(30, 10 + k), *p, *some(30, 40 + k)]) for k, p in enumerate((short, short, fifty, fifty, long, long))] + [" \n".join(short), None, "", "É x"]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)

    def brute(t, at):
        w, seen = list(re.finditer(r"[^\x20\x09-\x0D]+", t)), bytearray(len(t))
        for i in range(len(w) - 50):
            if at[tuple(x[0] for x in w[i : i + 51])] > 1:
                seen[w[i].start() : w[i + 50].end()] = b"\1" * (w[i + 50].end() - w[i].start())
        return "".join(c for c, s in zip(t, seen, strict=True) if not s)

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    at = Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    got = {r.doc_id: r.text for r in pipeline.suffix_dedup_stage(spark, df, DIR).collect()}
    assert got == {k: t and brute(t, at) for k, t in enumerate(texts)}
    assert got[0] != texts[0] and got[6] == "" and all(got[k] == texts[k] for k in (2, 3, 4, 5, 7, 8, 9))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "suffix_dedup", "decontaminate", "encode"]
    out = pipeline.run(spark, DIR)
    assert out.columns == [*docs.columns, "ids"]
    rows, codec = out.collect(), bpe.public_codec()
    assert 0 < len(rows) < docs.count() and all(list(r.ids) == codec.ids(r.text) and r.n_chars == len(r.text) for r in rows)
    groups = brute_groups({r.doc_id: r.text for r in docs.collect()}, 5)
    assert len({groups[r.doc_id][1] for r in rows}) == len(rows)
