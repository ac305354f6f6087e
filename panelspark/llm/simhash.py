"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of radius + 1 bits; table v (a nonzero vector) keeps the positions whose vector has an
odd inner product with v. Any `radius` positions have some v orthogonal to all of their vectors, so two fingerprints
that differ in at most `radius` bits agree on all kept positions of that table: each such pair collides somewhere, and
none is missed. Rows are combined to distinct fingerprints first. A bucket yields links that connect all of its pairs
within the radius, never the pairs themselves; a bucket too large for one task is dealt out as pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_texts, run_bounds, sorted_runs, written
from panelspark.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
BITS = 64
#: Fingerprints of one bucket that a task compares with each other.
BLOCK = 2048

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words joined by a space, of the whole sequence if it is shorter."""
    found = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = np.append(0, ends[:-1] + 1)
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(found) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, its fingerprint as a signed long, and text_hash, which tells rows of one doc_id apart."""

    def of(piece):
        found = np.array([fingerprint(shingle_hashes(t)) for t in piece.column("text").to_pylist()], np.uint64)
        return {"doc_id": piece.column("doc_id"), "fp": found.view(np.int64), "text_hash": piece.column("text_hash")}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")), of, "doc_id long, fp long, text_hash long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The kept positions of the 2^(radius + 1) - 1 tables, as signed longs."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    kept = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]
    return [k - (1 << 64) if k >> 63 else k for k in kept]


def _joined_up(fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows, each within the radius, that connect what all pairs within the radius connect."""
    n = len(fp)
    left = np.ones(n, bool)
    a, b = [], []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fp ^ fp[at]) <= radius))
            left[near] = False
            a += [at] * len(near)
            b += near.tolist()
            todo += near.tolist()
    return rep[a], rep[b]


def _bucket_links(rows: DataFrame, keys: list[str], radius: int, limit: int | None) -> DataFrame:
    """Links within each group of equal keys, as (a, b); for a group over the limit rows with its keys instead."""
    names = ["a", "b", *[f"over_{k}" for k in keys]]

    def run(batches):
        for block, whole in sorted_runs(batches, keys, limit):
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2 + [pa.array(block[k][:1], pa.int64()) for k in keys], names)
                continue
            out_a, out_b = [], []
            for s, e in zip(*run_bounds(block, keys), strict=True):
                if e - s > 1:
                    x, y = _joined_up(block["fp"][s:e].view(np.uint64), block["rep"][s:e], radius)
                    out_a.append(x)
                    out_b.append(y)
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())] + [pa.nulls(len(a), pa.int64())] * len(keys), names)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the representatives of fingerprints that connect all pairs within the radius.

    distinct: fp, rep; no fingerprint twice.
    """
    tables = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])
    rows = distinct.select("fp", "rep", F.posexplode(tables).alias("slot", "bucket")).select(F.col("slot").cast("long").alias("slot"), "bucket", "fp", "rep")
    found = written(_bucket_links(rows, ["slot", "bucket"], radius, 2 * block), "bucket-links")
    over = found.filter("a is null").select(F.col("over_slot").alias("slot"), F.col("over_bucket").alias("bucket")).distinct()
    large = rows.join(over, ["slot", "bucket"], "left_semi")
    parts = large.groupBy("slot", "bucket").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    dealt = large.join(parts, ["slot", "bucket"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("slot", "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "rep")
    more = _bucket_links(dealt, ["slot", "bucket", "low", "high"], radius, None)
    return found.filter("a is not null").select("a", "b").unionByName(more.select("a", "b"))


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links within the radius lead to) and
    text_hash.

    Texts without words (null, empty, white space) have fingerprint 0 and link like any other. Rows that repeat a
    doc_id each give a row. A row without doc_id gives no links: it has the component of the rows with its fingerprint,
    or null where all of those lack a doc_id. Extra columns are ignored.
    """
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "distinct-fingerprints")
    grouped = components(links(distinct, radius), "a", "b")
    # written first, so that both sides of the last join are plain exchanges and a very common fingerprint can be split
    of = written(distinct.join(grouped, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "fingerprint-components")
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id", "text_hash")
