"""Runs by recompression against a loop over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import periodic_runs
from test_dedup import docs


def brute_runs(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, q, k) for (s, k), q in out.items())


def joined(texts):
    n = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(n + 1) - n
    symbols = np.full(int(n.sum()) + len(n) + 1, -1)
    for b, t in zip(base, texts, strict=True):
        symbols[b : b + len(t)] = t
    alone = symbols < 0
    symbols[alone] = symbols.max() + 1 + np.arange(alone.sum())
    return symbols, base, n


def runs_of(texts, least=12):
    symbols, base, n = joined(texts)
    start, length, period = (x.tolist() for x in periodic_runs.periodic_runs(symbols, base, n, least))
    of = np.searchsorted(base, start, side="right") - 1 if start else []
    return [[(s - int(base[d]), q, k) for o, s, k, q in zip(of, start, length, period, strict=True) if o == d] for d in range(len(texts))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70), st.integers(1, 4), st.integers(1, 40), st.integers(0, 2**30)), min_size=1, max_size=5), st.sampled_from([2, 12, 20]))
def test_runs_against_brute_force(shapes, least):
    texts = []
    for n, k, p, seed in shapes:
        draw = random.Random(seed)
        t = [draw.randrange(k) for _ in range(n)]
        texts.append((t[:p] * n)[:n] if seed % 2 else t)
    assert runs_of(texts, least) == [brute_runs(t, least) for t in texts]


def test_extensions_both_ways():
    rng = np.random.default_rng(5)
    symbols, _, _ = joined([rng.integers(0, 2, 60).tolist(), [1] * 30, ([0, 1, 1] * 20)])
    levels = periodic_runs.recompressed(symbols)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(symbols)), np.arange(len(symbols))))
    i, j = i[i < j], j[i < j]
    for forward in (True, False):
        step = 1 if forward else -1
        got = periodic_runs.common_extension(levels, i, j, forward)
        for a, b, g in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
            k = 0
            while 0 <= a + step * k < b + step * k < len(symbols) and symbols[a + step * k] == symbols[b + step * k]:
                k += 1
            assert g == k


def plain(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, q, k in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    tail = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (doc_id, len(found), *tail, sha("".join(f"{s},{k},{q}\n" for s, q, k in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_rows_against_plain_version(spark):
    draw = random.Random(2)
    rows = [(None, "a b " * 10), (None, "a b " * 10), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 12), (5, "x " * 11), (6, "ä b ä b " * 9)]
    rows += [(10 + k, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(0, 120)))) for k in range(120)]
    rows += [(20, "same id " * 8), (20, "same id " * 8)]
    got = periodic_runs.digest(periodic_runs.find_runs(docs(spark, rows), plant=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain(i, t) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i)
    assert periodic_runs.find_runs(docs(spark, [])).count() == 0


@pytest.mark.parametrize("text,want", [("w " * 400_000, [(0, 400_000, 1)]), (" ".join(f"w{i % 150_000}" for i in range(400_000)), [(0, 400_000, 150_000)])])
def test_texts_beyond_a_slice(spark, text, want):
    got = periodic_runs.find_runs(docs(spark, [(1, "a b c"), (2, text + " " * 1_500_000)])).collect()
    assert [(r["start"], r["length"], r["period"]) for r in got[1]["runs"]] == want and got[0]["runs"] == []
