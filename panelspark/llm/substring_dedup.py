"""Repeated passages by seed and extend.

Seeds: of the `seed_words`-word runs within each window of `min_words` words, the one with the smallest hash is its
anchor (winnowing), so equal windows have the same anchor at the same place, and about one word in seven is an anchor.
Anchors are joined on their hash; those that occur once end there. Extension: every occurrence left brings the words
around it and is extended both ways, through each split of the words still missing between its left and its right, to
windows of the full length; within an anchor's occurrences, in order of document and position, a window that has been
seen is a repeat (those seen within the same task are marked there, so that a very frequent passage is not sent to one
task as a whole). Hashes only bring windows together: a window counts as seen when all of its words are equal to those
of an earlier one. This finds what extending every pair would find, with work in proportion to the occurrences. Covered
words merge into maximal repeats. Texts are shuffled once, by row, and the two joins with them share that exchange.

A row is known by a 64-bit hash of its doc_id and text, as rows may share a doc_id. A table of all rows' hashes, doc_ids
and SHA-256 digests verifies it: rows that share a hash but not both of these get hashes of their own. Of rows alike in
both one is extended, the others, counted in that table, repeat it from end to end. So do texts that have the SHA-256 of
one with a smaller doc_id: the digests find them beforehand, and their passages are not compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import map_texts, slices, sorted_runs, written

MIN_WORDS = 20
#: Windows of an anchor at most: min_words - seed_words + 1 may not exceed it.
SPLITS = 62
SEED_WORDS = 8
#: Occurrences of one anchor that a task holds at a time; anchors with more are dealt out by window.
MOST_HELD = 20_000
#: Copies of a row, alike in doc_id and text, that a task returns at a time.
COPIES_AT_A_TIME = 100_000

#: Odd multipliers, a value for each byte, and the finisher's multipliers (any fixed values do).
BASE = 0xD6E8FEB86659FD93
GRAM = 0x9E6C63D0676A9A99
WINDOW = 0xC3A5C85C97CB3127
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FINISH = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse^i modulo 2^64, for i up to n."""
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * FINISH[0]
    h = (h ^ (h >> np.uint64(27))) * FINISH[1]
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.view(np.int8), [1]])))
    return edge[::2], edge[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, one text after another, and the number of words of each."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    first, last = word_spans(data)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    h = finished((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(first, begin))


def run_hashes(words: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """Hash of each run of n consecutive words."""
    size = max(0, len(words) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h *= np.uint64(multiplier)
        h += words[k : k + size]
    return finished(h)


def numbered(texts: list[bytes]) -> np.ndarray:
    """A number for every word of the texts: equal words, and no others, have the same."""
    words = b" ".join(texts).split()
    of = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(of.__getitem__, words), np.int64, len(words))


def seen_before(start: np.ndarray, keys: list[np.ndarray], words: np.ndarray, n: int) -> np.ndarray:
    """Which windows (n words from start) have the words of an earlier one with the same keys, a hash of the window among
    them. The hash brings windows together; whether they are equal is decided on their words."""
    order = np.lexsort((np.arange(len(start)), *keys))
    alike = np.zeros(len(start), bool)
    alike[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    same = np.empty(len(start), bool)
    for at in range(0, len(start), 100_000):
        pairs = np.flatnonzero(alike[at : at + 100_000]) + at
        a, b = start[order[pairs]], start[order[pairs - 1]]
        equal = np.ones(len(pairs), bool)
        for k in range(n):
            equal &= words[a + k] == words[b + k]
        same[pairs] = equal
    out = np.zeros(len(start), bool)
    out[order[alike]] = True
    if not same[alike].all():  # different words with one hash: those stretches are gone through by their words
        stretch = np.cumsum(~alike)
        for s in np.unique(stretch[alike & ~same]):
            met = set()
            for i in order[stretch == s]:
                window = words[start[i] : start[i] + n].tobytes()
                out[i] = window in met
                met.add(window)
    return out


def anchors(texts: list[bytes], min_words: int, seed_words: int):
    """Of the texts' windows that lie within one text: the text's number, the window's first word in it, its hash, its
    anchor's hash and first word in the text."""
    words, counts = word_hashes(texts)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    owner = np.repeat(np.arange(len(texts)), counts)
    n = max(0, len(words) - min_words + 1)
    start = np.flatnonzero(owner[:n] == owner[min_words - 1 :])
    seeds = run_hashes(words, seed_words, GRAM)
    best, where = seeds[start], np.zeros(len(start), np.int64)
    for k in range(1, min_words - seed_words + 1):
        other = seeds[start + k]
        less = other < best
        best[less] = other[less]
        where[less] = k
    own = owner[start]
    first = start - begin[own]
    return own, first, run_hashes(words, min_words, WINDOW)[start], best.view(np.int64), first + where


def _spread(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys that deal out rows whose fate is known already."""
    return finished(rows.astype(np.uint64) * np.uint64(GRAM) + places.astype(np.uint64)).view(np.int64)


def _seeds(docs: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """key, row, pos, known of every anchor. Of an anchor that occurs several times within a slice of texts only the
    first goes by its hash, marked known = 1; the others are repeated for sure (known = 2) and dealt out evenly. So a
    very frequent anchor makes no more rows of one key than there are slices."""

    def of(piece):
        piece = _compared(piece)
        own, _, _, anchor, pos = anchors(_bytes(piece), min_words, seed_words)
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (pos[1:] != pos[:-1])
        rows, anchor, pos = piece.column("row").to_numpy(zero_copy_only=False)[own[new]], anchor[new], pos[new]
        order = np.argsort(anchor, kind="stable")
        again = np.zeros(len(anchor), bool)
        again[1:] = anchor[order[1:]] == anchor[order[:-1]]
        more = np.append(again[1:], False)
        key, known = anchor[order].copy(), np.where(again, 2, more.astype(np.int64))
        rows, pos = rows[order], pos[order]
        key[again] = _spread(rows[again], pos[again])
        return {"key": key, "row": rows, "pos": pos, "known": known}

    return map_texts(docs, of, "key long, row long, pos long, known long")


def _compared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that are compared: those that do not repeat another one from end to end."""
    return batch.filter(pc.is_null(batch.column("again")))


def _bytes(piece) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in piece.column("text").to_pylist()]


def _repeated(seeds: DataFrame) -> DataFrame:
    """row, pos of the anchors that occur more than once; looks one row back, so a group may be of any size."""

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not batch.num_rows:
                continue
            open_before = False
            if held is not None:
                cols, open_before = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)], held[1]
            same = cols[0][1:] == cols[0][:-1]
            many = cols[3] > 0
            many[1:] |= same
            many[:-1] |= same
            many[0] |= open_before
            held = ([c[-1:] for c in cols], bool(many[-1]))
            out = np.flatnonzero(many[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(cols[1][out]), pa.array(cols[2][out])], ["row", "pos"])
        if held is not None and held[1]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0][1]), pa.array(held[0][2])], ["row", "pos"])

    return seeds.repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, pos long")


EXTENDED = "key long, doc_id long, row long, pos long, back long, mask long, done long, around binary"


def _extended(with_places: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """The windows of the anchors at the places listed with each text. A row (done = 0): key (the anchor), doc_id, row, pos,
    back (words from its first window to the anchor), mask (which of its windows) and the text around it, from the first
    window's first word to the last one's last. A window that the same slice of texts has earlier is a repeat for sure:
    such are taken out into rows with done = 1 and no text, dealt out evenly."""

    def run(batches):
        for batch in batches:
            batch = _compared(batch)
            batch = batch.filter(pc.is_valid(batch.column("places")))
            for piece in slices(batch):
                texts = _bytes(piece)
                own, first, window, anchor, pos = anchors(texts, min_words, seed_words)
                ids, keys, places = *(piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row")), piece.column("places")
                at = places.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(piece.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
                wide = np.int64(1) << np.int64(40)
                keep = np.flatnonzero(np.isin(own * wide + pos, of * wide + at))
                if not len(keep):
                    continue
                own, first, window, anchor, pos = (x[keep] for x in (own, first, window, anchor, pos))
                data = b" ".join(texts)
                begins, ends = word_spans(np.frombuffer(data, np.uint8))
                start = np.searchsorted(begins, np.cumsum([0] + [len(t) + 1 for t in texts]))[own] + first
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (pos[1:] != pos[:-1])])
                lead, row = np.flatnonzero(new), np.cumsum(new) - 1
                bit = np.int64(1) << (first - first[lead][row])
                doc, text, split = ids[own], keys[own], pos - first
                order = np.lexsort((first, text, doc))  # of document and position
                again = np.empty(len(order), bool)
                again[order] = seen_before(start[order], [split[order], anchor[order], window[order]], numbered(texts), min_words)
                for done in (0, 1):
                    chosen = np.flatnonzero(again == bool(done))
                    if not len(chosen):
                        continue
                    rows = np.unique(row[chosen])
                    mask = np.zeros(len(lead), np.int64)
                    np.bitwise_or.at(mask, row[chosen], bit[chosen])
                    here = lead[rows]
                    if done:
                        around = pa.array([b""] * len(rows), pa.binary())
                    else:
                        bits = min_words - seed_words + 1
                        last = bits - 1 - (mask[rows, None] >> np.arange(bits)[::-1] & 1).argmax(1) + min_words - 1
                        around = pa.array([data[i:j] for i, j in zip(begins[start[here]].tolist(), ends[start[here] + last].tolist(), strict=True)], pa.binary())
                    key = _spread(text[here], pos[here]) if done else anchor[here]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc[here], text[here], pos[here], (pos - first)[here], mask[rows], np.full(len(rows), done))] + [around], ["key", "doc_id", "row", "pos", "back", "mask", "done", "around"])

    return with_places.mapInArrow(run, EXTENDED)


def _seen_before(extended: DataFrame, min_words: int) -> DataFrame:
    """doc_id, row, base and mask: the window at word base + i is a repeat if bit i of mask is set. The windows of an anchor
    with more occurrences than a task holds are still open: they come one by one, with their anchor, split and words."""
    names = ["doc_id", "row", "base", "mask", "anchor", "split"]

    def run(batches):
        for block, whole in sorted_runs(batches, ["key"], MOST_HELD):
            base = block["pos"] - block["back"]
            known = np.flatnonzero(block["done"] == 1)
            if len(known):
                yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in (block["doc_id"], block["row"], base, block["mask"])] + [pa.nulls(len(known), pa.int64())] * 2 + [pa.nulls(len(known), pa.binary())], [*names, "words"])
            fresh = np.flatnonzero(block["done"] == 0)
            if not len(fresh):
                continue
            key, doc_id, text, base, back, bits = (x[fresh] for x in (block["key"], block["doc_id"], block["row"], base, block["back"], block["mask"]))
            around = block["around"][fresh].tolist()
            hashes, counts = word_hashes(around)
            row, at = np.nonzero(bits[:, None] >> np.arange(SPLITS) & 1)
            start, split = (np.cumsum(counts) - counts)[row] + at, back[row] - at
            if not whole:
                words = b" ".join(around).split()
                said = [b" ".join(words[s : s + min_words]) for s in start.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc_id[row], text[row], base[row] + at, np.ones(len(row), np.int64), key[row], split)] + [pa.array(said, pa.binary())], [*names, "words"])
                continue
            window = run_hashes(hashes, min_words, WINDOW)[start]
            again = seen_before(start, [split, key[row], window], numbered(around), min_words)  # rows come in order of document and position
            mask = np.zeros(len(bits), np.int64)
            np.bitwise_or.at(mask, row[again], np.int64(1) << at[again])
            out = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (doc_id, text, base, mask)] + [pa.nulls(len(out), pa.int64())] * 2 + [pa.nulls(len(out), pa.binary())], [*names, "words"])

    schema = ", ".join([f"{n} long" for n in names] + ["words binary"])
    return extended.repartition("key").sortWithinPartitions("key", "doc_id", "row", "pos").mapInArrow(run, schema)


def _settled(seen: DataFrame) -> DataFrame:
    """Of the open windows, all but the first with the same words are repeats too; the rest passes through."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            open_ = np.asarray(batch.column("anchor").is_valid())
            keys = [pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False) for k in ("anchor", "split")]
            keys.append(pc.fill_null(batch.column("words"), b"").to_numpy(zero_copy_only=False))
            same = ~open_
            same[1:] |= open_[:-1] & np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            same[0] |= last is not None and all(k[0] == x for k, x in zip(keys, last, strict=True))
            last = [k[-1] for k in keys] if open_[-1] else None
            yield batch.select(["row", "base", "mask"]).filter(pa.array(same))

    keys = ["anchor", "split", "words"]
    spread = F.when(F.col("anchor").isNull(), F.xxhash64("row", "base")).otherwise(F.xxhash64(*keys))
    return seen.repartition(spread).sortWithinPartitions(*keys, "doc_id", "row", "base").mapInArrow(run, "row long, base long, mask long")


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, row of all rows; their keys: doc_id, digest of the text, row, n_chars): row is equal for rows alike in doc_id and
    text, and for no others."""
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_hash())
    keys = written(texts.select("doc_id", digest, "row", F.length("text").alias("n_chars")), "keys")
    for seed in range(1, 9):
        both = F.struct("doc_id", "digest")
        clash = written(keys.groupBy("row").agg(F.min(both).alias("low"), F.max(both).alias("high")).filter(~F.col("low").eqNullSafe(F.col("high"))).select("row"), "row-conflicts")
        if clash.isEmpty():
            return texts, keys
        number = F.row_number().over(Window.partitionBy("row").orderBy("doc_id", "digest"))
        parted = keys.join(clash, "row", "left_semi").drop("n_chars").distinct().withColumn("_new", F.xxhash64(F.lit(seed), "row", number))
        parted = written(parted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("row").alias("_row"), "_new"), "parted")

        def renamed(rows, parted=parted):
            same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest"))
            return rows.join(parted, same, "left").withColumn("row", F.coalesce("_new", "row")).drop("_id", "_digest", "_row", "_new")

        texts, keys = renamed(texts.withColumn("digest", digest)).drop("digest"), written(renamed(keys), "keys")
    raise ArithmeticError("rows' hashes keep clashing")


def _copies(keys: DataFrame, min_words: int) -> DataFrame:
    """row of the texts of min_words words or more, at least by their length, that another text with a smaller doc_id (or
    of the same one, by row) equals."""
    digests = keys.filter(F.col("n_chars") >= 2 * min_words - 1)
    first = written(digests.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.row").alias("first_row")), "first-texts")
    return written(digests.join(first, "digest").filter("row <> first_row").select("row").distinct().withColumn("again", F.lit(1)), "copies")


def _cleaned(rows: DataFrame, min_words: int, *extra: str) -> DataFrame:
    """doc_id, n_words, spans, kept and extra columns of rows with their repeats, or with again where they go as a whole."""

    def of(piece):
        out = {"doc_id": piece.column("doc_id"), "n_words": [], "spans": [], "kept": []} | {c: piece.column(c) for c in extra}
        for text, repeats, again in zip(_bytes(piece), piece.column("repeats"), piece.column("again").is_valid().to_pylist(), strict=True):
            words, spans = text.split(), []
            if again:
                spans = [{"start": 0, "end": len(words)}] if len(words) >= min_words else []
            elif repeats.is_valid:
                change = np.zeros(len(words) + 1, np.int64)
                base, mask = (repeats.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                s = np.concatenate([base[(mask >> i & 1).astype(bool)] + i for i in range(int(np.bitwise_or.reduce(mask)).bit_length())])
                np.add.at(change, s, 1)
                np.add.at(change, s + min_words, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            kept, at = [], 0
            for span in spans:
                kept += words[at : span["start"]]
                at = span["end"]
            out["n_words"].append(len(words))
            out["spans"].append(spans)
            out["kept"].append(b" ".join(kept + words[at:] if spans else words).decode())
        return out

    return map_texts(rows, of, ", ".join(["doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string", *[f"{c} long" for c in extra]]))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (maximal repeats as [start, end) in words) and kept (the other
    words, joined by single spaces).

    A word goes if a window of min_words words that covers it also starts earlier, in a document of smaller doc_id or
    before it in the same one. Null and empty texts have no words; shorter texts lose none. Different texts with one
    doc_id are documents of their own, in an order that depends on nothing but them (that of the rows' hashes). Of rows
    alike in doc_id and text one loses what it would lose alone; the others lose all words, unless they are shorter than
    a window. A row without doc_id keeps all its words and is not compared. Extra columns are ignored.
    """
    texts, keys = identified(docs)
    no_repeats = F.lit(None).cast("array<struct<base:long,mask:long>>").alias("repeats")
    nobody = _cleaned(texts.filter("doc_id is null").select("doc_id", "text", no_repeats, F.lit(None).cast("int").alias("again")), min_words)
    texts, keys = texts.filter("doc_id is not null"), keys.filter("doc_id is not null")
    alike = written(keys.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1"), "alike")
    others = nobody.limit(0)
    if not alike.isEmpty():
        first = written(texts.join(alike, "row", "left_semi").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.any_value("text").alias("text")), "alike-texts")
        texts = written(texts.join(alike, "row", "left_anti").unionByName(first), "texts")
        keys = written(keys.distinct(), "keys")
        gone = _cleaned(first.join(alike, "row").select("doc_id", "text", no_repeats, F.lit(1).alias("again"), "n"), min_words, "n")
        # n - 1 of each, dealt out in parts of a bounded size
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / COPIES_AT_A_TIME))).alias("part")
        size = F.least(F.lit(COPIES_AT_A_TIME).cast("long"), F.col("n") - 1 - F.col("part") * COPIES_AT_A_TIME)
        parts = gone.select("*", part).repartition("doc_id", "part")
        others = parts.select("doc_id", "n_words", "spans", "kept", F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("_k")).drop("_k")
    # all joins keep every text, so that they are the same exchange
    texts = texts.join(_copies(keys, min_words), "row", "left")
    places = _repeated(_seeds(texts, min_words, seed_words)).groupBy("row").agg(F.array_distinct(F.collect_list("pos")).alias("places"))
    extended = _extended(texts.join(places, "row", "left"), min_words, seed_words)
    repeats = _settled(_seen_before(extended, min_words)).groupBy("row").agg(F.collect_list(F.struct("base", "mask")).alias("repeats"))
    return _cleaned(texts.join(repeats, "row", "left"), min_words).unionByName(nobody).unionByName(others)


def digest(cleaned: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
