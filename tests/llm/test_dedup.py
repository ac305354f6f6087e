import hashlib

import numpy as np
import pytest

from panelspark.llm import embedding_dedup, exact_dedup, simhash, substring_dedup
from panelspark.llm.components import components
from tests_llm_helpers import brute_components, simple_fingerprint, squeezed

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, " "), (5, "a  b\tc"), (6, "a b c"), (7, "word " * 3000), (8, "word " * 3000), (9, "é ñ 𝄞 x"), (10, "a b c")]
SCHEMA = "doc_id long, text string, words string, norm string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def test_exact_groups(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, ODD)).collect()}
    by = {}
    for i, t in ODD:
        by.setdefault(squeezed(t), []).append(i)
    for t, ids in by.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_groups_survive_chunk_hash_conflicts(spark, monkeypatch):
    """Documents in doubt are told apart by their own digest as well."""
    df = docs(spark, ODD)
    every = lambda recipes: recipes.selectExpr("explode(recipe) AS id").distinct()
    plain = sorted(map(tuple, exact_dedup.exact_groups(df).collect()))
    monkeypatch.setattr(exact_dedup, "conflicts", every)
    assert sorted(map(tuple, exact_dedup.exact_groups(df).collect())) == plain


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 5), (20, 21), (7, 7), *[(100, 100 + i) for i in range(1, 50)], *[(i, i + 1) for i in range(300, 340)]]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert {got[x] for x in (3, 5, 9)} == {3} and got[21] == 20 and {got[100 + i] for i in range(50)} == {100} and {got[i] for i in range(300, 341)} == {300}
    assert 7 not in got
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_simhash_groups(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 300, 200)]
    rows = list(ODD)
    for k in range(20):
        words = list(base)
        for i in rng.integers(0, 200, k // 4):
            words[i] = f"Z{i}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, " ".join(f"q{i}" for i in rng.integers(0, 9999, 40))) for k in range(20)]
    prints = [simple_fingerprint(t) for _, t in rows]
    near = [[(a ^ b).bit_count() <= 4 for b in prints] for a in prints]
    want = dict(zip([i for i, _ in rows], zip(prints, brute_components([i for i, _ in rows], near), strict=True), strict=True))
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert got == want


def test_covering_masks():
    kept = [m % (1 << 64) for m in simhash.masks()]
    rng = np.random.default_rng(1)
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(not (flips & m) for m in kept)


def test_large_buckets_are_dealt_as_blocks(spark):
    chain = [(0x10 << 40) ^ v for v in (0, 0xF, 0xFF, 0xFFF, 0xFFFF)] + [7 << 50, 1 << 30]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(chain)], "fp long, rep long")
    group = lambda **k: sorted(map(tuple, components(simhash.links(df, **k), "a", "b").collect()))
    assert group(block=1) == group() and {c for n, c in group() if n < 5} == {0}


def brute_removed(rows, least):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - least + 1):
            key = tuple(words[k : k + least])
            if key in seen:
                gone[k : k + least] = [True] * least
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w.decode() for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("held", [200_000, 2])
def test_substring(spark, monkeypatch, held):
    monkeypatch.setattr(substring_dedup, "MOST_HELD", held)
    rng = np.random.default_rng(3)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 50_000, n)]
    shared, other = word(30), word(25)
    rows = [(i, t) for i, t in ODD]
    rows += [(50 + k, " ".join(word(15) + shared[k % 5 :] + word(10))) for k in range(8)]
    rows += [(70, " ".join(other + word(3) + other)), (71, " ".join(other[:19] + word(4))), (72, " ".join(["same"] * 50)), (73, " ".join(["same"] * 21 + word(2)))]
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == brute_removed(rows, 20)
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


@pytest.mark.parametrize("held", [200_000, 2])
def test_substring_compares_words(spark, monkeypatch, held):
    """Two words with one hash, and all windows with one hash: only equal words are removed."""
    monkeypatch.setattr(substring_dedup, "MOST_HELD", held)
    one, two = thue_morse(1024)
    h = substring_dedup.word_hashes([f"{one} {two}".encode()])[0]
    assert h[0] == h[1]
    run = [f"u{i}" for i in range(40)]
    text = lambda w: " ".join([*run[:12], w, *run[12:]])
    rows = [(1, text(one)), (2, text(two)), (3, text(one)), (4, text(two)), (5, text(one) + " " + text(two))]
    removed = lambda r: {x["doc_id"]: (x["n_words"], sum(s["end"] - s["start"] for s in x["spans"]), x["kept"]) for x in substring_dedup.remove_repeats(docs(spark, r)).collect()}
    assert removed(rows) == brute_removed(rows, 20)
    assert removed(rows[:2])[2] == brute_removed(rows[:2], 20)[2]
    start, words = np.arange(0, 60, 3), np.arange(80) % 6
    got = substring_dedup.seen_before(start, [np.zeros(20)], words, 4)
    assert got.tolist() == [tuple(words[s : s + 4]) in {tuple(words[x : x + 4]) for x in start[:i]} for i, s in enumerate(start)]


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 16))
    v = [c + rng.standard_normal(16) * 0.09 * np.linalg.norm(c) / 4 for c in centre for _ in range(12)] + list(rng.standard_normal((60, 16)))
    v = [[float(np.float32(x)) for x in row] for row in v]
    rows = [(i, x, i % 2) for i, x in enumerate(v)] + [(900 + i, v[0], 0) for i in range(3)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None] * 8, 0), (1004, v[0], None), (1005, [], 0), (1006, v[0][:4], 0), (1007, [float("inf")] * 16, 1)]
    rows += [(None, v[0], 0), (3, v[3], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, links string")
    good = [r for r in rows if r[0] is not None and r[0] < 1000]
    x = embedding_dedup.unit(np.array([r[1] for r in good]))
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good]))
    comp = brute_components([r[0] for r in good], near)
    want = {r[0]: (int(near[i].sum()) - 1, comp[i]) for i, r in enumerate(good)} | {i: (0, i) for i in range(1000, 1008)} | {None: (0, None)}
    check = lambda: {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_groups(df).collect()}
    assert check() == want
    monkeypatch.setattr(embedding_dedup, "SHARD_NODES", 15)
    assert check() == want
    monkeypatch.setattr(embedding_dedup, "SHARD_LIMIT", 8)
    assert check() == want
    monkeypatch.setattr(embedding_dedup, "MAX_CENTRES", 2)  # cells first, and blocks of their nodes
    monkeypatch.setattr(embedding_dedup, "CELL_BLOCK", 9)
    assert check() == want
    monkeypatch.setattr(embedding_dedup, "LEAST_RECALL", 1.5)  # everything compared
    assert check() == want
    assert embedding_dedup.near_groups(df.limit(0)).count() == 0


def test_unmeasured_results_are_exact_at_any_size(spark, monkeypatch):
    """No id is divisible by 50, so nothing is audited, and shards that do not overlap lose links: all are found all the same."""
    monkeypatch.setattr(embedding_dedup, "MOST_SHARDS", 1)
    n = 20_100
    x = np.random.default_rng(5).standard_normal((n, 6)).astype(np.float32)
    df = spark.createDataFrame([(50 * i + 1, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["recall"]) for r in embedding_dedup.near_groups(df).collect()}
    u = embedding_dedup.unit(x.astype(np.float64))
    want = [k for i in range(0, n, 1000) for k in ((u[i : i + 1000] @ u.T >= 0.98).sum(1) - 1).tolist()]
    assert sum(want) > n and got == {50 * i + 1: (k, None) for i, k in enumerate(want)}


@pytest.mark.parametrize("block", [16_384, 37])
def test_all_pairs_compared_in_blocks(spark, monkeypatch, block):
    """A dense group, chains, lone vectors, two labels and two lengths: links and what they connect, as by brute force."""
    monkeypatch.setattr(embedding_dedup, "EXACT_BLOCK", block)
    rng = np.random.default_rng(6)
    turn = np.arange(60) * 0.07
    dense = rng.standard_normal(4) + rng.standard_normal((300, 4)) * 0.02
    v = [*dense, *np.stack([np.cos(turn), np.sin(turn), 0 * turn, 0 * turn], 1), *rng.standard_normal((40, 4))]
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(1000 + i, x.tolist(), 1) for i, x in enumerate(rng.standard_normal((50, 3)))] + [(2000, v[0].tolist(), 0)]
    nodes = embedding_dedup.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = embedding_dedup.compared(nodes)
    links = {r[0]: r[1] for r in found.filter("rep is not null").groupBy("rep").sum("links").collect()}
    near = {}
    for kind in {(len(r[1]), r[2]) for r in rows}:
        some = [r for r in rows if (len(r[1]), r[2]) == kind]
        u = embedding_dedup.unit(np.array([r[1] for r in some]))
        near |= {r[0]: {some[j][0] for j in np.flatnonzero(row)} for r, row in zip(some, u @ u.T >= 0.98, strict=True)}
    copies = {0, 2000}
    want = {i: len(s - (copies if i in copies else {i})) for i, s in near.items() if i != 2000}
    assert links == {i: k for i, k in want.items() if k}
    ids = sorted(near)
    comp = dict(zip(ids, brute_components(ids, np.array([[j in near[i] for j in ids] for i in ids])), strict=True))
    got = {r["node"]: r["component"] for r in components(found.filter("a is not null"), "a", "b").collect()}
    assert {i: got.get(i, i) for i in ids if i != 2000} == {i: c for i, c in comp.items() if i != 2000}


def test_recall_is_null_where_nothing_was_measured(spark):
    rng = np.random.default_rng(3)
    far = rng.standard_normal((3, 16))
    rows = [(k, v.tolist(), 1) for k, v in zip((1, 2, 50), [far[0], far[0] * 2 + 1e-6, far[1]], strict=True)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert {i: (r["n_links"], r["component_id"], r["recall"]) for i, r in got.items()} == {1: (1, 1, None), 2: (1, 1, None), 50: (0, 50, None)}
