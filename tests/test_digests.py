"""Digests of raw files: streamed in blocks, read whole, and hashlib's agree on any bytes."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelspark.sources import bars, digests


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(4)
    raw = rng.randbytes(700_000)
    files = {
        "random.bin": raw, "ends.csv": b"a,b\n1,2\n", "open.csv": b"a,b\n1,2", "mark.csv": b"\xef\xbb\xbfa,b\r\n1,2\r\n", "mark-open.csv": b"\xef\xbb\xbfa", "feeds.txt": b"\n" * 9, "one.txt": b"\n",
        "two-marks.txt": b"\xef\xbb\xbf\xef\xbb\xbfx\n", "no-feed.bin": raw.replace(b"\n", b"x")[:300_000], "only-mark.txt": b"\xef\xbb\xbf", "mark-feed.txt": b"\xef\xbb\xbf\n", "nul.bin": b"\0" * 1000 + b"\n\0", "empty.txt": b"",
        "packed.csv.gz": gzip.compress(b"a,b\n1,2\n"), "a b[1]%20.csv": b"x\ny",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}


def named(df):
    from urllib.parse import unquote

    rows = [(r["path"].rsplit("/", 1)[-1], r["sha256"]) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return {unquote(n) if n.startswith("a%20b") else n: h for n, h in rows}


@pytest.mark.parametrize("split", [1 << 27, 40_000])
@pytest.mark.parametrize("block", [1 << 16, 1000])
def test_streamed_in_splits_and_blocks(spark, folder, monkeypatch, split, block):
    path, want = folder
    monkeypatch.setattr(digests, "BLOCK", block)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = named(digests.streamed_digests(spark, str(path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: h for n, h in want.items() if n not in ("empty.txt", "only-mark.txt", "packed.csv.gz")}


def test_states_go_on_from_stretch_to_stretch(spark, folder, monkeypatch):
    """Stretches of 100,000 bytes: each is hashed by a job of its own."""
    path, want = folder
    monkeypatch.setattr(digests, "STRETCH", 100_000)
    jobs, hashed = [], digests._hashed
    monkeypatch.setattr(digests, "_hashed", lambda last: jobs.append(last) or hashed(last))
    monkeypatch.setattr(digests, "BLOCK", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        got = named(digests.streamed_digests(spark, str(path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: h for n, h in want.items() if n not in ("empty.txt", "only-mark.txt", "packed.csv.gz")}
    assert digests.carried() and jobs == [False] * 6 + [True]


@pytest.mark.parametrize("at", [0, 1, 55, 63, 64, 65, 70_000])
def test_a_hash_is_carried_on_at_any_byte(at):
    data = random.Random(1).randbytes(70_000)
    one = digests._Digest("a", len(data))
    one.add(data[:at])
    two = digests._Digest("a", len(data), one.state())
    two.add(data[at:])
    assert two.hex() == hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("whole", [1 << 26, 100_000, 5, 0])
def test_each_file_once_whatever_is_read_whole(spark, folder, monkeypatch, whole):
    path, want = folder
    monkeypatch.setattr(digests.file_digests, "__defaults__", (whole,))
    assert named(bars.file_digests(spark, str(path))) == want


def test_a_file_that_is_not_what_was_listed(spark):
    one = digests._Digest("a", 100)
    one.add(b"x\n")
    with pytest.raises(ValueError, match="100 bytes listed"):
        one.hex()
    assert spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0] == hashlib.sha256(b"").hexdigest()
