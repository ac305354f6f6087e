"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents stand in a shuffled, fixed order (by the MD5 of their id) and form one stream of words, cut
into blocks of equally many words. Slot i of the schedule belongs to the source whose share of the unit interval holds
the golden-ratio point frac(i * phi), taken exactly in 64-bit integers; the slots of a source are ranked, and the slot
of rank r takes block r modulo the source's number of blocks. So every stretch of the schedule is close to the weights,
and a source is passed over again only after all of it was taken. The slot that reaches a source's target is cut there.
The slots are part of the result: each document has the first slot that takes of it and the number of slots that do,
and the mix is delivered in the order of its slots.
Slots are made in chunks and ranked by prefix sums over chunks, so a source that holds most slots is never in one task.
Per-source totals (one row a source) are the only thing the driver sees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, written

#: Words in a block, and slots in a chunk of the schedule.
BLOCK_WORDS = 1024
CHUNK_SLOTS = 1 << 16
#: A document is taken at most so many times.
MAX_REPEATS = 3
#: 2^64 divided by the golden ratio, made odd: multiples of it, modulo 2^64, are the golden-ratio points.
GOLDEN = 0x9E3779B97F4A7C15


def cyclic_weights(n: int) -> list[int]:
    return [1 + i % 3 for i in range(n)]


def targets(totals: list[int], weights: list[int], max_repeats: int = MAX_REPEATS) -> tuple[list[float], list[int]]:
    """Each source's target, as a number and in whole words: weighted shares of everything, none above max_repeats
    times the source; what a source can't give is shared out again by weight."""
    left, weight = sum(totals), sum(weights)
    out, whole = [0.0] * len(totals), [0] * len(totals)
    order = sorted(range(len(totals)), key=lambda i: (totals[i] / weights[i], i))
    for at, i in enumerate(order):
        cap = max_repeats * totals[i]
        if cap * weight > left * weights[i]:
            for j in order[at:]:
                out[j], whole[j] = left * weights[j] / weight, left * weights[j] // weight
            break
        out[i], whole[i] = float(cap), cap
        left, weight = left - cap, weight - weights[i]
    return out, whole


def _sized(docs: DataFrame) -> DataFrame:
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("place"))


def _source_key() -> list[Column]:
    return [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_name")]


def _streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its first word's position in its source's stream."""
    rows = sized.select("*", *_source_key()).join(sources, ["no_source", "source_name"]).withColumn("part", F.substring("place", 1, 3))
    by_part = rows.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source_no", "part").orderBy("place", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("source_no", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(by_part, ["source_no", "part"]).withColumn("first_word", F.col("ahead") + F.col("within"))


def schedule(spark, quotas: list[int]) -> DataFrame:
    """slot, source_no and rank, a source's ranks being 0 to its quota - 1. Where a source's golden-ratio points are a few
    too few, its last slots come after all others, at total + rank * sources + source_no; points beyond its quota go."""
    total = sum(quotas)
    edges = np.array([(int(c) << 64) // max(total, 1) if c < total else (1 << 64) - 1 for c in np.cumsum([int(q) for q in quotas], dtype=object)], np.uint64)

    def sources_of(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        slot = np.arange(chunk * CHUNK_SLOTS, min((chunk + 1) * CHUNK_SLOTS, total), dtype=np.uint64)
        with np.errstate(over="ignore"):
            return slot.astype(np.int64), np.minimum(np.searchsorted(edges, slot * np.uint64(GOLDEN), side="right"), len(edges) - 1)

    def count(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                no, n = np.unique(sources_of(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(no), chunk)), pa.array(no.astype(np.int64)), pa.array(n.astype(np.int64))], ["chunk", "source_no", "n"])

    def rank(batches):
        for batch in batches:
            for chunk, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slot, no = sources_of(chunk)
                ranks = np.empty(len(no), np.int64)
                for x in before:
                    at = np.flatnonzero(no == x["source_no"])
                    ranks[at] = x["before"] + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(no.astype(np.int64)), pa.array(ranks)], ["slot", "source_no", "rank"])

    chunks = spark.range(-(-total // CHUNK_SLOTS)).select(F.col("id").alias("chunk"))
    counts = chunks.mapInArrow(count, "chunk long, source_no long, n long")
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).groupBy("chunk").agg(F.collect_list(F.struct("source_no", "before")).alias("before"))
    quota = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quotas)], "source_no long, quota long")
    golden = before.mapInArrow(rank, "slot long, source_no long, rank long").join(quota, "source_no").filter("rank < quota").select("slot", "source_no", "rank")
    short = counts.groupBy("source_no").agg(F.sum("n").alias("n")).join(quota, "source_no", "right").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < quota")
    return golden.unionByName(short.select("source_no", F.explode(F.sequence(F.col("n"), F.col("quota") - 1)).alias("rank")).select((F.lit(total) + F.col("rank") * len(quotas) + F.col("source_no")).alias("slot"), "source_no", "rank"))


def _mixed(docs: DataFrame, weights=cyclic_weights, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """mix(), with text_hash and turns: the slots of the block that a document begins in, turn after turn."""
    spark = docs.sparkSession
    sized = written(_sized(docs), "sized")
    totals = sorted(((r["no_source"], r["source_name"], r["words"]) for r in sized.groupBy(*_source_key()).agg(F.sum("size").alias("words")).collect()), key=lambda r: r[:2])
    sizes = [r[2] for r in totals]
    target, whole = targets(sizes, weights(len(sizes)), max_repeats)
    blocks = [-(-s // block_words) for s in sizes]
    quotas = [(w // s) * b + -(-(w % s) // block_words) if s else 0 for s, w, b in zip(sizes, whole, blocks, strict=True)]
    sources = spark.createDataFrame(
        [(no, name, i, s, t, w, b) for i, ((no, name, s), t, w, b) in enumerate(zip(totals, target, whole, blocks, strict=True))],
        "no_source boolean, source_name string, source_no long, source_size long, target double, whole long, blocks long",
    )
    block = F.lit(block_words).cast("long")
    slots = schedule(spark, quotas).join(sources.select("source_no", "source_size", "whole", "blocks"), "source_no")
    slots = slots.select("slot", "source_no", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("turn"), "source_size", "whole")
    slots = slots.withColumn("length", F.least(block, F.col("source_size") - F.col("block") * block))
    slots = slots.withColumn("words", F.least("length", F.col("whole") - F.col("turn") * F.col("source_size") - F.col("block") * block))
    # a block has at most max_repeats slots, in the order of its turns
    takes = slots.groupBy("source_no", "block").agg(
        F.sum((F.col("words") == F.col("length")).cast("long")).alias("full"), F.sum(F.when(F.col("words") < F.col("length"), F.col("words")).otherwise(0)).alias("cut"),
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "slot"))), lambda x: x["slot"]).alias("turns"),
    )
    placed = _streams(sized, sources)
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first_word") / block), F.floor((F.col("first_word") + F.col("size") - 1) / block))))
    start = F.col("block") * block
    pieces = pieces.withColumn("lo", F.greatest("first_word", start) - start).withColumn("hi", F.least(F.col("first_word") + F.col("size"), start + block) - start)
    taken = pieces.join(takes, ["source_no", "block"], "left").withColumn("words", F.coalesce(F.col("full") * (F.col("hi") - F.col("lo")) + F.greatest(F.least("hi", "cut") - F.col("lo"), F.lit(0)), F.lit(0)))
    taken = taken.withColumn("n", F.coalesce(F.col("full") + (F.col("cut") > F.col("lo")).cast("long"), F.lit(0)))
    keys = ["doc_id", "text_hash", "size", "source_size", "target"]
    taken = taken.groupBy("source_no", "first_word", *keys).agg(
        F.sum("words").alias("taken"), F.min(F.when(F.col("n") > 0, F.get("turns", F.lit(0)))).alias("first_slot"), F.sum("n").alias("n_slots"), F.min_by("turns", "block").alias("turns"),
    )
    none = placed.filter("size = 0").select(*keys, *[F.lit(0).cast("long").alias(c) for c in ("taken", "n_slots")], F.lit(None).cast("long").alias("first_slot"), F.lit(None).cast("array<long>").alias("turns"))
    return taken.drop("source_no", "first_word").unionByName(none)


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (its source's), taken (words, repeats counted),
    first_slot (the first slot of the schedule that takes of it, null for none) and n_slots (how many do).

    weights(n) gives the weights of the n sources in code point order, a null source last. Null and empty texts have
    no words and nothing is taken of them. Rows that repeat a doc_id, and rows without one, each have their own place in
    the stream. Extra columns are ignored; an empty table gives no rows.
    """
    return _mixed(docs, **how).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix in the order of the schedule's slots, each as often as the nearest whole number of times
    its words are taken (half: up). Rows with one doc_id, or none, are told apart by their text; rows alike in both are
    each taken as often as the one of them that is taken most."""
    times = _mixed(docs, **how).filter("2 * taken >= size and size > 0").withColumn("times", F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int"))
    times = times.groupBy(F.col("doc_id").alias("_mix_id"), F.col("text_hash").alias("_mix_hash")).agg(F.max(F.struct("times", "turns")).alias("_mix"))
    match = docs["doc_id"].eqNullSafe(times["_mix_id"]) & (F.xxhash64(docs["text"]) == times["_mix_hash"])
    taken = docs.join(times, match).withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.col("_mix.times") - 1)))
    return taken.withColumn("_mix_slot", F.get("_mix.turns", F.col("_mix_copy"))).orderBy("_mix_slot", F.md5(F.coalesce(F.col("_mix_id").cast("string"), F.lit("")).cast("binary"))).select(*[docs[c] for c in docs.columns])
