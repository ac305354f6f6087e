import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import bpe, language_id, mixing
from tests_llm_helpers import brute_components, simple_fingerprint, squeezed

POOLS = {"aa": "the and ing tion of".split(), "bb": "der ung sch ein über".split()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        text = " ".join("".join(rng.choice(POOLS[lang], 3)) for _ in range(int(rng.integers(30, 90))))
        out.append((i, text, lang, f"s{i % 3}", len(text)))
    out += [(200 + k, out[k][1].replace(" ", "  "), "aa", "s1", 1) for k in range(5)]
    out += [(300 + k, out[k][1].replace(" ", " ", 1) + " tionthe", "aa", "s2", 1) for k in range(10, 20)]
    out += [(7, out[7][1], "aa", "s0", 1)] * 2 + [(9, out[3][1] + " nichts sonst", "aa", "s1", 1)]  # rows that share a doc_id
    out += [(15, out[15][1] + " und", "bb", "s1", 1)]
    lone = " ".join("".join(rng.choice(POOLS["aa"], 3)) for _ in range(50))
    out += [(None, out[12][1], "aa", "s1", 1), (None, lone, "aa", "s2", 1), (None, lone, "aa", "s2", 1)]
    out += [(400, None, "aa", "s0", 0), (401, "123 ...", "bb", None, 0), (402, "", None, "s0", 0)]
    return out


def text_hash(t):
    return (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"kept": F.lit("?"), "text_hash": F.lit(1.5), "_g0": F.lit("x")})  # names that the stages use too


def test_run_against_brute_force(spark, rows, tmp_path):
    df = table(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256").collect()), key=str)

    model = language_id.train(df)
    kept = []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0], text_hash(r[1] or ""))):
        if r[1] and language_id.LETTER.search(r[1]):
            _, p, lead = model.decode(language_id.features(r[1])[None])
            if p[0] >= corpus_pipeline.LEAST_SCORE or lead[0] >= language_id.AMBIGUOUS:
                kept.append(r)
    first = {}
    for r in kept:
        first.setdefault(squeezed(r[1]), r)
    kept = list(first.values())
    named = [r for r in kept if r[0] is not None]
    prints = [simple_fingerprint(r[1]) for r in named]
    comp = brute_components([r[0] for r in named], [[(a ^ b).bit_count() <= 4 for b in prints] for a in prints])
    near = {}
    for r, c in zip(named, comp, strict=True):
        if r[0] == c:
            near.setdefault(c, r)
    lone = {simple_fingerprint(r[1]): r for r in kept if r[0] is None and simple_fingerprint(r[1]) not in prints}
    kept = [*near.values(), *lone.values()]
    assert {r[0] for r in kept} >= {None, 15} and len(kept) < len(named)
    names = sorted({r[3] for r in kept})
    sizes = [len(r[1].split()) for r in kept]
    totals = [sum(n for r, n in zip(kept, sizes, strict=True) if r[3] == s) for s in names]
    _, whole = mixing.targets(totals, mixing.cyclic_weights(len(names)))
    want = []
    e = bpe.encoder(bpe.default_path())
    for s, total, words in zip(names, totals, whole, strict=True):
        at = 0
        for r in sorted((r for r in kept if r[3] == s), key=lambda r: hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()):
            n = len(r[1].split())
            taken = words // total * n + max(0, min(at + n, words % total) - at)
            at += n
            ids = e.direct([r[1]])[0].tolist()
            want += [(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * ((2 * taken + n) // (2 * n))
    assert got == sorted(want, key=str) and 0 < len(got)


def test_stages(spark, rows, tmp_path):
    df = table(spark, rows)
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs = docs.checkpoint()
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run_deletes_what_its_stages_wrote(spark, rows, tmp_path):
    from panelspark.llm.common import kept_tables, release

    release(spark)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert len(kept_tables(spark)) == 1 and "mixing" in kept_tables(spark)[0]
    assert got.count() > 0


def test_training_rows_of_one_doc_id(spark, tmp_path):
    """Thousands of labelled rows that share a doc_id: the stages' model keeps both languages, and clean documents stay."""
    rng = np.random.default_rng(12)
    one, other = (" ".join("".join(rng.choice(POOLS[k], 3)) for _ in range(40)) for k in ("aa", "bb"))
    rows = [(7, one, "aa", "s", 1)] * 3000 + [(100 + k, other + f" {POOLS['bb'][k % 5]}", "bb", "s", 1) for k in range(40)]
    df = table(spark, rows)
    kept = corpus_pipeline.identify_language(spark, df, "")
    assert kept.count() == len(rows) and kept.columns == df.columns
