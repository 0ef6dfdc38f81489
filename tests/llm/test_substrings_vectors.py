"""Repeated substrings, hard negatives and whitening against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import hard_negatives, substring_dedup, whitening

VECTORS = "vec_id long, embedding array<float>, label int, anchor string, tree long, __x int"


# ---------------------------------------------------------------- repeated substrings

def removed(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of every text, string by string."""
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if often[d[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def passages(seed, n=40):
    rng = random.Random(seed)
    words = ["alpha", "bête", "c", "delta-delta", "日本", "12", "\n", "e"]
    prose = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(k))
    common = [prose(60) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            a = rng.randint(0, len(c) // 2)
            parts += [c[a:a + rng.randint(20, len(c))], prose(rng.randint(0, 6))]
        texts.append("".join(parts))
    return texts + ["a" * 500, "ab" * 200, "a" * 130, None, "", "short", texts[0], texts[0]]


@pytest.mark.parametrize("length,unit,group", [(60, 16, 1 << 21), (60, 16, 0), (100, 40, 300)])
def test_substrings_against_brute_force(spark, length, unit, group):
    texts = passages(length + group)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {"row": F.lit(1), "__data": F.lit("x"), "n_bytes": F.lit("clash")}).repartition(5)
    got = substring_dedup.drop_repeated_substrings(docs, length=length, unit=unit, group=group).collect()
    assert len(got) == len(texts)
    want = removed(texts, length)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]


def test_substrings_of_long_texts_are_found_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 97)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    texts = [long, long[1000:3000] + "x" * 300, "y" + long[2990:3100]]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data]).tolist()
    spans = [(e - len(d), e) for e, d in zip(ends, data)]
    found = substring_dedup.phrases(b"".join(data), spans, 60, 16)
    keys, starts = {}, 0
    for t, key, at, n, again in found:
        strings = [data[t][i:i + 60] for i in range(at, at + n)]
        assert again or len(set(strings)) == n
        assert all(keys.setdefault(s, key) == key for s in strings)
        starts += n
    assert starts == sum(len(d) - 59 for d in data)


def test_substring_order_puts_equal_strings_side_by_side():
    rng = random.Random(5)
    for alphabet in ("a", "ab", "abcdefghijkl"):
        base = "".join(rng.choice(alphabet) for _ in range(400)).encode()
        texts = [base[a:a + rng.randint(60, 200)] for a in (rng.randint(0, 200) for _ in range(12))]
        starts = [len(t) - 49 for t in texts]
        often = Counter(t[i:i + 50] for t, n in zip(texts, starts) for i in range(n))
        got = substring_dedup.repeated_starts(texts, starts, 50)
        assert [f.tolist() for f in got] == [[often[t[i:i + 50]] > 1 for i in range(n)] for t, n in zip(texts, starts)]


def test_substrings_at_the_border_of_the_length(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(400))
    cases = [text[:400] + "Z" * 10, "Q" + text[:400] + "W", text[500:899], "é" + text[500:899]]
    docs = spark.createDataFrame([(None, t) for t in cases], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in
                 substring_dedup.drop_repeated_substrings(docs).collect())
    assert got == [(399, 0, 0), (401, 0, 0), (402, 400, 1), (410, 400, 1)]


def test_substrings_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.drop_repeated_substrings(docs).collect() == []


# ---------------------------------------------------------------- hard negatives

def vectors(seed, n=220, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, width))
    rows = []
    for i in range(n):
        v = centres[i % 5] * rng.uniform(0.2, 1.5) + rng.standard_normal(width) * 0.4
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4)), "x", 1, 2))
    same = rows[3][1]
    rows += [(1000 + i, same, i % 2, "x", 1, 2) for i in range(30)]           # copies of one vector
    rows += [rows[0], rows[0], rows[50], (50, rows[7][1], 3, "x", 1, 2)]      # repeated rows, one id twice
    rows += [(None, same, 1, "x", 1, 2), (2000, same, None, "x", 1, 2), (2050, None, 1, "x", 1, 2),
             (2100, [1.0, None], 1, "x", 1, 2), (2150, [float("nan")] * width, 1, "x", 1, 2),
             (2200, [float("inf")] + [0.0] * (width - 1), 1, "x", 1, 2), (2250, [0.0] * width, 1, "x", 1, 2),
             (2300, [0.5, 0.5], 1, "x", 1, 2), (2350, [], 2, "x", 1, 2)]
    return rows


def mined(rows, positives=5, negatives=3, low=50, high=95):
    usable = set()
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        usable.add((i, label, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    out = set()
    for a, label, x in usable:
        if a % 50:
            continue
        scored = sorted({(-sum(p * q for p, q in zip(x, y)), i, m == label) for i, m, y in usable})
        best = [(-s, i) for s, i, same in scored if same and i != a][:positives]
        for score, p in best:
            fit = [(-s, i) for s, i, same in scored if not same and low * score <= -100 * s <= high * score]
            out |= {(a, p, r, i, score, s) for r, (s, i) in enumerate(fit[:negatives], 1)}
    return out


@pytest.mark.parametrize("tree,leaf", [(2048, 64), (40, 4)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, tree, leaf):
    for name, value in (("TREE", tree), ("LEAF", leaf), ("PASS_BYTES", 500)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(leaf)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 50 == 0).collect()]
    want = mined(rows)
    assert len(want) > 20
    assert set(got) == want


def test_cover_tree_bounds_hold_all_rows():
    rng = np.random.default_rng(2)
    x = np.vstack([np.rint(rng.standard_normal((300, 5)) * 50), np.zeros((3, 5)), np.ones((9, 5))])
    radius = float(np.sqrt((x ** 2).sum(axis=1).max()))
    tree = hard_negatives.CoverTree(np.arange(len(x)), np.zeros(len(x)), x, radius)
    queries = np.rint(rng.standard_normal((7, 5)) * 50)
    exact = queries @ tree.x.T
    for low, high in ((2000, 4000), (-1e9, 1e9), (9e9, 9e9), (0, 0)):
        seen = [set() for _ in queries]

        def visit(who, rows, scores):
            for q, each in zip(who, scores):
                seen[q] |= {int(r) for r, s in zip(rows, each) if low <= s <= high}

        tree.search(queries, lambda: np.full(len(queries), low), np.full(len(queries), high), visit)
        assert seen == [set(np.flatnonzero((e >= low) & (e <= high)).tolist()) for e in exact]


def test_hard_negatives_of_no_rows(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(df, F.lit(True)).collect() == []
    one = spark.createDataFrame(vectors(1)[:1], VECTORS)
    assert hard_negatives.hard_negatives(one, F.lit(True)).collect() == []


# ---------------------------------------------------------------- whitening

@pytest.mark.parametrize("n", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["full", "equal", "two values", "graded", "low rank", "zero"])
def test_eigenvectors(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    spectrum = {"full": rng.uniform(1, 9, n), "equal": np.full(n, 3.0), "zero": np.zeros(n),
                "two values": np.where(np.arange(n) % 2, 1.0, 5.0), "graded": 10.0 ** -np.linspace(0, 14, n),
                "low rank": np.where(np.arange(n) < n // 3, 2.0, 0.0)}[kind]
    a = q @ np.diag(spectrum) @ q.T
    a = (a + a.T) / 2
    values, columns = whitening.eigenvectors(a)
    scale = max(1e-300, float(spectrum.max()))
    assert np.abs(values - np.sort(spectrum)[::-1]).max() <= 1e-14 * n * scale
    assert np.abs(a @ columns - columns * values).max() <= 1e-14 * n * scale
    assert np.abs(columns.T @ columns - np.eye(n)).max() <= 1e-14 * n


def test_polar_factor():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    values, columns = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - columns @ np.diag(np.sign(values)) @ columns.T).max() < 1e-13


def test_whitening_against_numpy(spark):
    rows = [r for r in vectors(9) if r[1] is None or len(r[1]) == 6 or None in r[1]]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = whitening.whiten(df, components=4).collect()
    kept = [(r[0], [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]]) for r in rows
            if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=object)
    n, total = len(x), x.sum(axis=0)
    z = ((x * n - total) / n).astype(float)
    values, columns = np.linalg.eigh(z.T @ z / n)
    values, columns = values[::-1], columns[:, ::-1]
    assert len(got) == 4 * len(kept)
    want = {}
    for i, v in kept:
        d = np.array(v, dtype=object) * n - total
        w = (d / n).astype(float) @ columns[:, :4] / np.sqrt(values[:4])
        for c in range(4):
            want.setdefault((i, c + 1), set()).add((int((d * d).sum()), round(abs(w[c]), 8)))
    for r in got:
        assert (r["deviation"], round(abs(r["whitened"]), 8)) in want[r["vec_id"], r["component"]]
        assert r["n"] == n and r["identity_error"] < 1e-12
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12


def test_whitening_sums_large_entries_exactly(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.integers(-2 ** 33, 2 ** 33, 3)], 0, "x", 1, 2) for i in range(50)]
    schema = VECTORS.replace("array<float>", "array<double>")
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    x = [[64 * int(c) + 1_000_000 for c in r[1]] for r in rows]
    total = [sum(c) for c in zip(*x)]
    far = {i: sum((50 * c - t) ** 2 for c, t in zip(v, total)) for i, v in enumerate(x)}
    assert len(got) == 150 and {r["identity_error"] < 1e-9 for r in got} == {True}
    for r in got:
        assert r["deviation"] == (far[r["vec_id"]] if far[r["vec_id"]] < 2 ** 63 else None)


def test_whitening_without_variance(spark):
    schema = VECTORS
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    same = [(i, [1.0, 2.0], 0, "x", 1, 2) for i in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, schema)).collect() == []
    line = [(i, [1.0, float(i)], 0, "x", 1, 2) for i in range(5)]  # one dimension is constant
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 5 and {r["component"] for r in got} == {1} and {r["explained"] for r in got} == {1.0}
