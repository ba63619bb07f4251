"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from veilspark.llm.periods import PeriodicRuns, RangeMinimum, common_prefixes, inverse_suffix_array, next_smaller, planted, report, runs_of

from ..conftest import SF


def brute_runs(w, least=12):
    """For each period, maximal stretches of equal words a period apart; of equal stretches the least period stays."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q):
                # a stretch with a smaller period that divides it lies in a stretch of that period
                if not any(s <= i and i + length <= s + k for s, k, p in out if p < q and q % p == 0):
                    out[(i, length, q)] = True
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def moved(doc, w):
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def brute(doc, text):
    w = moved(doc, (text or "").encode().split())
    runs = brute_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
    milli = 1000 * best[1] // best[2] if runs else None
    return doc, len(runs), *best, milli, sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def got(df):
    return sorted(map(tuple, report(PeriodicRuns().run(df, planted)).collect()), key=str)


def test_parts_against_plain_ones():
    rng = random.Random(5)
    for case in range(150):
        n, k = rng.randrange(1, 120), rng.choice([1, 2, 3, 9])
        s = [rng.randrange(k) for _ in range(n)]
        if case % 3 == 0:
            s = (s[: max(1, n // 5)] * n)[:n]
        a = np.array(s)
        rank = inverse_suffix_array(a)
        order = sorted(range(n), key=lambda i: s[i:])
        assert rank[order].tolist() == list(range(n))
        common = [0] + [next((d for d, (x, y) in enumerate(zip(s[i:], s[j:])) if x != y), min(n - i, n - j)) for i, j in zip(order, order[1:])]
        assert common_prefixes(a, rank).tolist() == common
        assert next_smaller(rank).tolist() == [next((j for j in range(i + 1, n) if rank[j] < rank[i]), n) for i in range(n)]
        left = np.array([rng.randrange(n) for _ in range(40)])
        right = np.array([rng.randrange(i, n) for i in left])
        assert RangeMinimum(a)(left, right).tolist() == [min(s[i : j + 1]) for i, j in zip(left, right)]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for least in (1, 4, 12):
        texts = []
        for _ in range(60):
            n = rng.randrange(0, 90)
            w = [rng.randrange(letters) for _ in range(n)]
            texts.append((w[: rng.randrange(1, 12)] * n)[:n] if n and rng.random() < 0.4 else w)
        word, text = np.array([x for w in texts for x in w]), np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        first = np.cumsum([0] + [len(w) for w in texts])
        want = [(int(first[t]) + s, int(first[t]) + s + k, q) for t, w in enumerate(texts) for s, k, q in brute_runs(w, least)]
        assert list(map(tuple, runs_of(word, text, least).tolist())) == want


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted((brute(*r) for r in rows), key=str)
    assert got(df) == want and sum(r[1] > 0 for r in want) > len(want) // 20


def test_edges(spark):
    many = " ".join(random.Random(1).choice("ab") for _ in range(300))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (None, "x " * 30), (None, "a b " * 12), (4, "again " * 11), (4, "again " * 12), (4, "again " * 12), (5, many), (6, "é\x1c ü " * 20 + "z " * 15),
        (7, "w" * 200_000 + " " + "a b c " * 50), (24, "p q r s t u v w x y z " * 20), (9, "a b c d e f g h i j k l " * 2),
    ]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, runs int, collapsed string")
    assert got(df) == sorted((brute(*r) for r in rows), key=str)
    assert got(df.limit(0)) == []


def test_a_very_long_text(spark):
    """All words equal, and words in the order of a Thue-Morse sequence, 200,000 of each."""
    n = 200_000
    thue = ["ab"[bin(i).count("1") % 2] for i in range(n)]
    df = spark.createDataFrame([(1, "x " * n), (2, " ".join(thue))], "doc_id long, text string")
    out = {r.doc_id: r for r in PeriodicRuns().run(df).collect()}
    assert [tuple(r) for r in out[1].runs] == [(0, n, 1)] and out[1].collapsed == "x"
    # it holds no overlap, so all its runs are squares: none is longer than twice its period
    assert out[2].runs and all(r.length == 2 * r.period for r in out[2].runs)
