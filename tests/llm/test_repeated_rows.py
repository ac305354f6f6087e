"""Rows that share a doc_id, and rows without one."""

from collections import Counter

import numpy as np
import pytest

from panelspark.llm import substring_dedup
from test_dedup import docs

LEAST = 20


def removed(spark, rows):
    return Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect())


@pytest.mark.parametrize("held", [200_000, 2])
def test_substring_of_rows_with_one_doc_id(spark, monkeypatch, held):
    monkeypatch.setattr(substring_dedup, "MOST_HELD", held)
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"r{i}" for i in rng.integers(0, 50_000, n))
    same, short, long, brief, shared, nobody = words(30), words(25), words(60), words(10), words(24), words(40)
    rows = [(1, same)] * 3 + [(1, words(22)), (2, brief), (2, brief), (None, nobody), (None, nobody), (5, None), (5, None), (6, same)]
    rows += [(3, short), (3, long + " " + short)]
    rows += [(4, words(40) + " " + shared + " " + words(40)), (4, shared)]
    got = removed(spark, rows)
    assert got[1, 30, 0, same] == 1 and got[1, 30, 30, ""] == 2 and got[6, 30, 30, ""] == 1
    assert got[1, 22, 0, rows[3][1]] == 1
    assert got[2, 10, 0, brief] == 2 and got[None, 40, 0, nobody] == 2 and got[5, 0, 0, ""] == 2
    assert sum(got.values()) == len(rows)
    # of a passage that two texts of one doc_id share, exactly one copy stays
    for i, one, two, n in ((3, short, long + " " + short, 25), (4, shared, rows[-2][1], 24)):
        gone = {k: v for k, v in got.items() if k[0] == i}
        size = len(two.split())
        assert gone in ({(i, n, 0, one): 1, (i, size, n, " ".join(w for w in two.split() if w not in set(one.split()))): 1}, {(i, n, n, ""): 1, (i, size, 0, two): 1})
    assert removed(spark, rows[::-1]) == got


def plain_removal(rows, least=LEAST):
    """Of different (doc_id, text), by doc_id, which is unique here: kept words, by windows that start earlier."""
    seen, out = set(), Counter()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (t or "").split()
        gone = set()
        for k in range(len(words) - least + 1):
            window = tuple(words[k : k + least])
            if window in seen:
                gone.update(range(k, k + least))
            seen.add(window)
        out[i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)] += 1
    return out + Counter((None, len((t or "").split()), 0, " ".join((t or "").split())) for i, t in rows if i is None)


@pytest.mark.parametrize("hashed", ["constant", "three values"])
def test_substring_with_clashing_row_hashes(spark, monkeypatch, hashed):
    """Rows are told apart by doc_id and digest, whatever their hashes."""
    from pyspark.sql import functions as F

    value = F.lit(5).cast("long") if hashed == "constant" else F.coalesce(F.pmod(F.col("doc_id"), F.lit(3)), F.lit(0)).cast("long")
    monkeypatch.setattr(substring_dedup, "row_hash", lambda: value)
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"r{i}" for i in rng.integers(0, 50_000, n))
    passage = words(26)
    rows = [(i, words(30)) for i in range(12)] + [(20, words(10) + " " + passage), (21, passage + " " + words(5)), (22, None), (23, ""), (24, again := words(40)), (25, again)]
    rows += [(None, passage), (None, passage), (None, None)]
    assert removed(spark, rows) == plain_removal(rows)
    assert removed(spark, rows + [rows[0]] * 3) == plain_removal(rows) + Counter({(0, 30, 30, ""): 3})


def test_many_copies_of_a_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COPIES_AT_A_TIME", 4)
    text = " ".join(f"w{k}" for k in range(25))
    for n in (2, 5, 6, 14):
        assert removed(spark, [(1, text)] * n + [(2, "a b")] * n) == Counter({(1, 25, 0, text): 1, (1, 25, 25, ""): n - 1, (2, 2, 0, "a b"): n})


def test_substring_of_a_text_beyond_a_slice(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    got = removed(spark, [(1, long), (2, "x " + " ".join(f"w{k}" for k in range(200_000, 200_040))), (3, long)])
    assert got == Counter({(1, 300_000, 0, long): 1, (2, 41, 40, "x"): 1, (3, 300_000, 300_000, ""): 1})
