"""Periodic runs of words by recompression.

The words of a slice of texts, with a symbol of its own between any two texts, are compressed in turns: stretches of one
symbol become one symbol (block compression), then the symbols are dealt to two sides and each neighbouring left-right
pair becomes one symbol (pair compression). Equal stretches are compressed alike, so the levels are a run-length grammar
on which two positions' longest common extension, forwards or backwards, is found by going up while symbols are equal
and down again where they differ: exactly, in a step a level, without suffix arrays. Levels end where all symbols differ.

Candidates lie on harmonic grids: a run of period q and length l has l - q neighbouring positions that equal the one q
words on, so one of every max(12, 2 q) - q positions must be among them; over all q these are n log n positions. Where a
grid position has the word that stands q on, both extensions give the whole stretch; a stretch that several periods fit
has the smallest of them as its period, as the others are its multiples.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_texts

#: Shortest run in words.
LEAST_LENGTH = 12
#: Grid positions worked on at a time.
GRID_CHUNK = 1 << 20
#: Spreads symbols over the two sides of pair compression (any odd number does).
SIDES = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """A level of the grammar: its symbols, each one's parent in the next level, each parent's first child (and an end)."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    blocks: bool


def _level(symbols: np.ndarray, opens: np.ndarray, blocks: bool) -> Level:
    parent = (np.cumsum(opens) - 1).astype(np.int32)
    return Level(symbols.astype(np.int32), parent, np.append(np.flatnonzero(opens), len(symbols)).astype(np.int32), blocks)


def recompressed(symbols: np.ndarray) -> list[Level]:
    """Levels from the given symbols (0, 1, ... in any order) up to one on which no symbol occurs twice, which comes last
    with no parents. The first and last symbol must occur once."""
    symbols, levels, turn = symbols.astype(np.int64), [], 0
    new = int(symbols.max()) + 1
    while np.bincount(symbols).max() > 1:
        opens = np.ones(len(symbols), bool)
        opens[1:] = symbols[1:] != symbols[:-1]
        if not opens.all():
            level = _level(symbols, opens, True)
            levels.append(level)
            size = np.diff(level.first)
            symbols = symbols[opens]
            many = np.flatnonzero(size > 1)
            keys, number = np.unique(symbols[many] * (int(size.max()) + 1) + size[many], return_inverse=True)
            symbols[many] = new + number
            new += len(keys)
        left = (symbols.astype(np.uint64) + np.uint64(turn)) * SIDES >> np.uint64(63) == 1
        turn += 1
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        at = np.flatnonzero(one if np.count_nonzero(one) >= np.count_nonzero(other) else other)
        if not len(at):
            continue
        opens = np.ones(len(symbols), bool)
        opens[at + 1] = False
        levels.append(_level(symbols, opens, False))
        keys, number = np.unique(symbols[at] * new + symbols[at + 1], return_inverse=True)
        symbols[at] = new + number
        symbols = symbols[opens]
        new += len(keys)
    none = np.empty(0, np.int32)
    return [*levels, Level(symbols.astype(np.int32), none, none, False)]


def common_extension(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """Of each pair of different positions: how many symbols of the lowest level are equal from them on (forward), or from
    them back, themselves included."""
    step = 1 if forward else -1
    live, a, b = np.arange(len(i)), i.astype(np.int64), j.astype(np.int64)
    stopped = []
    for level in levels:
        equal = level.symbols[a] == level.symbols[b]
        halt = ~equal
        if len(level.parent):
            up_a, up_b = level.parent[a].astype(np.int64), level.parent[b].astype(np.int64)
            rest_a, rest_b = ((level.first[u + 1] - x if forward else x - level.first[u] + 1) for u, x in ((up_a, a), (up_b, b)))
            starts = ((level.first[up_a] == a) & (level.first[up_b] == b)) if forward else ((level.first[up_a + 1] - 1 == a) & (level.first[up_b + 1] - 1 == b))
            move = equal & ~starts
            ahead = np.minimum(rest_a, rest_b) if level.blocks else np.ones(len(a), np.int64)
            a, b = np.where(move, a + step * ahead, a), np.where(move, b + step * ahead, b)
            if level.blocks:  # stretches of one symbol that end apart: what follows differs
                halt |= move & (rest_a != rest_b)
        stopped.append((live[halt], a[halt], b[halt]))
        go = ~halt
        live, a, b = live[go], a[go], b[go]
        if not len(live):
            break
        a, b = level.parent[a].astype(np.int64), level.parent[b].astype(np.int64)
    who, a, b = stopped.pop()
    for level, (more, more_a, more_b) in zip(levels[len(stopped) - 1 :: -1] if stopped else [], stopped[::-1], strict=True):
        # the parents differ: so do their children from the first on, or after one step
        a, b = (level.first[x].astype(np.int64) if forward else level.first[x + 1].astype(np.int64) - 1 for x in (a, b))
        equal = level.symbols[a] == level.symbols[b]
        if level.blocks:
            up_a, up_b = level.parent[a], level.parent[b]
            ahead = np.minimum(*((level.first[u + 1] - level.first[u]) for u in (up_a, up_b)))
        else:
            ahead = 1
        a, b = np.where(equal, a + step * ahead, a), np.where(equal, b + step * ahead, b)
        who, a, b = np.concatenate([who, more]), np.concatenate([a, more_a]), np.concatenate([b, more_b])
    out = np.empty(len(i), np.int64)
    out[who] = np.abs(a - i[who])
    return out


def _smallest_periods(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row of each start and length, with the smallest period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def periodic_runs(symbols: np.ndarray, base: np.ndarray, n: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, ...]:
    """start (in symbols), length and period of every run, by start and period. symbols: those of the texts, with a unique
    one before each text and at the end; base and n: each text's first symbol and number of symbols."""
    levels = recompressed(symbols)
    counts = np.where(n >= least, n // 2, 0)
    own = np.repeat(np.arange(len(n)), counts)
    q = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    grid = np.maximum(least - q, q)
    points = (n[own] - 1 - q) // grid + 1
    total = np.cumsum(points)
    found, at = [], 0
    while at < len(own):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + GRID_CHUNK, side="right")))
        each = points[at:end]
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        period = np.repeat(q[at:end], each)
        x = np.repeat(base[own[at:end]], each) + k * np.repeat(grid[at:end], each)
        met = np.flatnonzero(symbols[x] == symbols[x + period])
        x, period = x[met], period[met]
        ahead = common_extension(levels, x, x + period, True)
        back = common_extension(levels, x - 1, x + period - 1, False)
        length = ahead + back + period
        long = length >= np.maximum(least, 2 * period)
        found.append(_smallest_periods((x - back)[long], length[long], period[long]))
        at = end
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = _smallest_periods(*(np.concatenate(c) for c in zip(*found, strict=True)))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted(doc_id: int | None, words: list) -> list:
    """The words with the period that the document's id prescribes for one in ten (none for a row without id)."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def find_runs(docs: DataFrame, least: int = LEAST_LENGTH, plant: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed
    (the words that no run has after its first period, joined by single spaces).

    A run is a stretch of `least` words or more, and of two periods or more, whose words a period apart are equal, which no
    neighbouring word extends; its period is the smallest. Null and empty texts have no words and no runs. Every row is a
    document of its own, whether or not its doc_id repeats or is missing. plant: words are first made periodic where the
    doc_id says so. Extra columns are ignored.
    """

    def of(piece):
        ids = piece.column("doc_id").to_pylist()
        words = [(t or "").encode("utf-8", "replace").split() for t in piece.column("text").to_pylist()]
        if plant:
            words = [planted(i, w) for i, w in zip(ids, words, strict=True)]
        n = np.array([len(w) for w in words], np.int64)
        base = np.cumsum(n + 1) - n
        number: dict[bytes, int] = {}
        symbols = np.empty(int(n.sum()) + len(n) + 1, np.int64)
        for b, w in zip(base.tolist(), words, strict=True):
            symbols[b : b + len(w)] = [number.setdefault(x, len(number)) for x in w]
        symbols[np.append(base - 1, len(symbols) - 1)] = len(number) + np.arange(len(n) + 1)
        start, length, period = periodic_runs(symbols, base, n, least)
        gone = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, start + length, -1)
        gone = np.cumsum(gone) > 0
        of_text = np.searchsorted(start, np.append(base, len(symbols)))
        runs, kept = [], []
        for d, w in enumerate(words):
            a, b = of_text[d], of_text[d + 1]
            runs.append([{"start": s, "length": k, "period": p} for s, k, p in zip((start[a:b] - base[d]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)])
            out = gone[base[d] : base[d] + n[d]] if a < b else ()
            kept.append(b" ".join([x for x, g in zip(w, out.tolist(), strict=True) if not g] if a < b else w).decode())
        return {"doc_id": piece.column("doc_id"), "n_words": n, "runs": runs, "collapsed": kept}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, of, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Per document: the number of runs, the longest of them (ties: smallest start, then period), digests of all runs and of
    what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("_best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
