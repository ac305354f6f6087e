"""Texts beyond a slice, beside short ones, and columns whose names the operators use themselves."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import bpe, exact_dedup, mixing, pii, simhash
from tests_llm_helpers import simple_fingerprint, squeezed

CLASHING = ["row", "places", "repeats", "copy", "again", "rank", "kept", "norm", "recipe", "digest", "fp", "key", "slot", "block", "spans", "part", "text_hash", "_h"]


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    return " ".join(rng.choice(words, 320_000)) + "  write to a.b@example.org now\n"


@pytest.fixture(scope="module")
def table(spark, long_text):
    rows = [(1, long_text, "en", "s"), (2, "short one", "en", "s"), (3, long_text.replace("  ", "\t"), "en", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(1.5) for c in CLASHING})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_and_near_groups(table, long_text):
    assert len(long_text) > 2_100_000
    got = by_id(exact_dedup.exact_groups(table))
    sha = hashlib.sha256(squeezed(long_text).encode()).hexdigest()
    assert [got[i]["keep_id"] for i in (1, 2, 3, None)] == [1, 2, 1, None] and got[3]["text_sha256"] == got[1]["text_sha256"] == sha and got[1]["group_size"] == 2
    near = by_id(simhash.near_groups(table))
    want = simple_fingerprint(long_text)
    assert near[1]["fp"] % (1 << 64) == near[3]["fp"] % (1 << 64) == want and [near[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 1]


def test_personal_data_and_mixing(table, long_text):
    found = by_id(pii.digest(pii.find(table)))
    at = long_text.index("a.b@example.org")
    assert found[1]["n_email"] == found[3]["n_email"] == 1 and found[1]["base_sha256"] == hashlib.sha256(f"email:{at}:{at + 15}".encode()).hexdigest() and found[None]["n_email"] == 0
    sizes = by_id(mixing.mix(table))
    assert [sizes[i]["size"] for i in (1, 2, 3, None)] == [320_004, 2, 320_004, 0]


def test_bpe_of_a_long_text(table, long_text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = tokenizer.encode(long_text, add_special_tokens=False).ids
    got = by_id(bpe.digest(table))
    assert (got[1]["n_tokens"], got[1]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) and got[None]["n_tokens"] == 0
    assert got[1]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_each_stage_of_the_pipeline(spark, table):
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == table.columns, name
        kept = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        assert kept <= {1, 2, 3} and 1 in kept or name == "language id"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 1
