"""Draws with replacement, ranks by slices, exact percentiles and the palette index against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import datasets as D
from gridloom.operators import evaluation as E
from gridloom.operators import palette as P


def mixed(k, seed):
    for shift, factor in ((15, 2654435761), (13, 1103515245), (16, 69069)):
        k = (k * factor + seed) % 2147483648
        k ^= k >> shift
    return k


def drawn(rows, n, seed):
    owned, hi = [], 0
    for i, w in sorted(((i, w) for i, w in rows if w and round(w * D.UNITS) > 0), key=lambda r: ((r[0] * 2654435761 + seed) % 2147483648, r[0])):
        hi += round(w * D.UNITS)
        owned.append((hi, i))
    out, edges = [], np.array([h for h, _ in owned], dtype=object)
    for k in range(n):
        at = mixed(k, seed) * (hi >> 31) + ((mixed(k, seed) * (hi & 0x7FFFFFFF)) >> 31) + ((mixed(k + 97, seed + 1) * (hi >> 31)) >> 31)
        out.append((k, owned[int(np.searchsorted(edges, at, "right"))][1]))
    return out


@pytest.mark.parametrize("heavy", [0, 1, 10**7])
def test_draws_equal_the_cumulative_weights(spark, heavy):
    rnd = random.Random(3)
    rows = [(i, round(rnd.random(), 3)) for i in range(300)] + [(900, None), (901, 0.0), (902, -1.0)] + ([(950, float(heavy))] if heavy else [])
    df = spark.createDataFrame(rows, "id long, weight double")
    got = sorted(tuple(r)[:2] for r in D.draw_with_replacement(df, 2000, 17).select("draw", "id").collect())
    assert got == drawn(rows, 2000, 17)
    assert got == sorted(tuple(r) for r in D.draw_with_replacement(df.repartition(7), 2000, 17).select("draw", "id").collect())
    assert D.draw_with_replacement(df.filter("id > 899 AND id < 950"), 10, 1).count() == 0 and D.draw_with_replacement(df.limit(0), 10, 1).count() == 0


def test_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 7.0)], "id long, weight double")
    n = Counter(r.id for r in D.draw_with_replacement(df, 20_000, 5).collect())
    assert all(abs(n[i] / 20_000 - w) < 0.015 for i, w in ((1, 0.1), (2, 0.2), (3, 0.7)))


def test_per_code_index(spark):
    rnd = random.Random(8)
    rows = [(i if i % 3 else i * 10**12, "hot" if rnd.random() < 0.6 else None if rnd.random() < 0.1 else f"c{i % 4}") for i in range(1200)]
    got = {r.id: r["index"] for r in D.per_code_index(spark.createDataFrame(rows, "id long, code string")).collect()}
    for code in {c for _, c in rows}:
        assert [got[i] for i in sorted(i for i, c in rows if c == code)] == list(range(sum(c == code for _, c in rows)))
    assert D.per_code_index(spark.createDataFrame([], "id long, code string")).count() == 0


def test_weights_equal_the_windows(spark):
    rows = [(i, f"c{i % 7}" if i % 11 else None, "real" if i % 7 < 3 and i % 2 else "synth") for i in range(500)]
    got = {r.id: r.weight for r in D.sampling_weights(spark.createDataFrame(rows, "id long, code string, kind string"), 1.0, 0.5).collect()}
    n, real = Counter(c for _, c, _ in rows), {c for _, c, k in rows if k == "real"}
    raw = {i: (1.0 if k == "real" else 0.5 if c in real else 1.5) / n[c] for i, c, k in rows}
    mean = sum(raw.values()) / len(raw)
    assert got.keys() == raw.keys() and all(abs(got[i] - w / mean) < 1e-9 for i, w in raw.items())


def test_percentiles_equal_numpy(spark):
    rnd = random.Random(9)
    sets = {"many": [rnd.random() for _ in range(3000)], "ties": [0.5] * 900 + [rnd.choice([0.1, 0.9]) for _ in range(401)], "one": [0.3], "two": [1.0, 0.0], "none": [None, None], None: [0.2, 0.8, float("nan"), None]}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "s string, v double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    for r in E.percentiles(df, "v", shares, "s").collect():
        known = [v for v in sets[r.s] if v is not None and v == v]
        want = np.percentile(known, [100 * p for p in shares]) if known else [None] * 5
        assert list(r)[1:] == (pytest.approx(list(want)) if known else want)
    whole = [v for vs in sets.values() for v in vs if v is not None and v == v]
    assert list(E.percentiles(df, "v", [0.25, 0.75]).first()) == pytest.approx(list(np.percentile(whole, [25, 75])))
    assert E.percentiles(df.limit(0), "v", [0.5], "s").count() == 0


def test_palette_index_equals_a_full_scan(spark):
    rnd = random.Random(12)
    palette = [(f"C{k:03d}", f"#{rnd.randrange(1 << 24):06X}") for k in range(150)] + [("A0", "#808080"), ("B0", "#808080"), ("Z0", "#000000")]
    pixels = [(i, rnd.randrange(256), rnd.randrange(256), rnd.randrange(256)) for i in range(800)] + [(2000 + i, 128, 128, 128) for i in range(400)] + [(3000, 0, 0, 0), (3001, 255, 255, 255), (3002, None, 1, 1)]
    df = spark.createDataFrame(pixels, "id long, r int, g int, b int")
    got = {r.id: (r.d2, r.code) for r in P.nearest(df, spark.createDataFrame(palette, "code string, hex string")).collect()}
    rgb = {c: tuple(int(h[k : k + 2], 16) for k in (1, 3, 5)) for c, h in palette}
    assert got == {i: min((sum((x - y) ** 2 for x, y in zip(p, q)), c) for c, q in rgb.items()) for i, *p in pixels if None not in p}
    assert P.nearest(df.limit(0), spark.createDataFrame(palette, "code string, hex string")).count() == 0
    with pytest.raises(ValueError, match="palette too large"):
        P.nearest(df, spark.range(P.PALETTE_MOST + 1).select(F.lit("x").alias("code"), F.lit("#000000").alias("hex")))
