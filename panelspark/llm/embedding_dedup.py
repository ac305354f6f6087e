"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors are one node. A node goes to the shard of its nearest cluster centre, its home, and to the next few whose
centres are nearly as close, so near vectors share a shard that is home to one of them. Each shard builds a pruned
neighbour graph; a node's adjacency lists from all its shards are united; each shard then searches the united graph
among its nodes for the neighbours of those at home in it: greedily from the medoid to the query, then outwards through
everything within range. Found pairs are verified by cosine in double precision. A pair is counted in one shard, and a
shard gives only links that connect what its pairs connect, so no group yields all of its pairs.

Centres are as many as nodes ask for, so shards keep their size as a table grows: beyond MAX_CENTRES the nodes are first
dealt to cells, and each cell has centres of its own. A shard that is still too large for a task (many vectors that no
centre tells apart) is compared exactly, in pairs of blocks. Recall is audited by brute force: every vector whose id is
divisible by 50 against all rows, in blocks. Below the target the shards overlap more and the work is done again; if it
is still below the least recall then, or if no audited vector has a link, so that nothing was measured, all pairs of
blocks are compared exactly, whatever the size of the table. The recall is part of the result.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import delete, written, written_at
from panelspark.llm.components import components

SIMILAR = 0.98
#: Nodes to a centre, most centres that are broadcast, most nodes that one task works on, and nodes of a block of a cell.
SHARD_NODES = 500
MAX_CENTRES = 16_384
SHARD_LIMIT = 3000
CELL_BLOCK = 20_000
#: A node goes to the centres within so much cosine of its best one, at least two and at most so many.
MARGIN = 0.1
LEAST_SHARDS, MOST_SHARDS = 2, 3
#: Nearest and random candidates, edges a node and slack of the pruned graph; nodes kept in a greedy search, and the width
#: of the neighbour lists that it reads (longer lists are spread over it; range expansion reads them whole).
CANDIDATES, FAR_CANDIDATES, DEGREE, SLACK, BEAM, LIST = 56, 16, 24, 1.2, 24, 40
#: Vectors with ids divisible by AUDITED are audited; the recall asked for, how often the work is done again to reach it,
#: and the recall below which everything is compared. Queries and nodes of a block of the audit.
AUDITED, TARGET, ATTEMPTS, LEAST_RECALL = 50, 0.98, 2, 0.95
AUDIT_BLOCK = 4096
#: Entries and most nodes of a block of the exact comparison, and rows of it that are compared at once.
EXACT_ENTRIES, EXACT_BLOCK, EXACT_ROWS = 1 << 20, 16_384, 256

log = logging.getLogger(__name__)


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, over the largest entry first so that no square over- or underflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def pruned_graph(v: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, slack: float = SLACK) -> np.ndarray:
    """Neighbours of each unit vector (-1: none): of its nearest candidates and some random ones, in order, those not much
    closer to one chosen before."""
    n = len(v)
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    k, rows = min(candidates, n - 1), np.arange(n)
    w = v.astype(np.float32)
    s = w @ w.T
    near = np.empty((n, k + FAR_CANDIDATES), np.int64)
    for at in range(0, n, 512):
        part = s[at : at + 512].copy()
        part[np.arange(len(part)), rows[at : at + 512]] = -np.inf
        best = np.argpartition(-part, k - 1, axis=1)[:, :k]
        best = np.concatenate([best, np.random.default_rng(at).integers(0, n, (len(part), FAR_CANDIDATES))], axis=1)
        near[at : at + 512] = np.take_along_axis(best, np.argsort(-np.take_along_axis(part, best, 1), axis=1, kind="stable"), 1)
    far = 1 - s[rows[:, None], near]
    open_ = near != rows[:, None]
    for slot in range(degree):
        pick = open_.argmax(1)
        some = open_[rows, pick]
        if not some.any():
            break
        chosen = near[rows, pick]
        out[some, slot] = chosen[some]
        open_ &= (slack * (1 - s[chosen[:, None], near]) > far) & (near != chosen[:, None])
    return out


def both_ways(graph: np.ndarray) -> list[np.ndarray]:
    """Each node's neighbours and the nodes that have it for a neighbour."""
    a, slot = np.nonzero(graph >= 0)
    n = len(graph)
    a, b = np.divmod(np.unique(np.concatenate([a * n + graph[a, slot], graph[a, slot] * n + a])), n)
    ok = a != b
    return np.split(b[ok], np.searchsorted(a[ok], np.arange(1, n)))


def padded(begin: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    """Adjacency lists (begin, flat) as rows of at most `width` neighbours, spread over a longer list; -1 for none."""
    size = np.diff(begin)
    at = begin[:-1, None] + np.arange(width) * np.maximum(size, width)[:, None] // width
    return np.where(at < begin[1:, None], flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else -1, -1)


def range_search(v: np.ndarray, begin: np.ndarray, flat: np.ndarray, start: int, least: float, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with inner product `least` or more that a greedy search from the start reaches, or range
    expansion from what it met and from the query, itself a node."""
    n, q = len(v), len(queries)
    rows = np.arange(q)
    graph = padded(begin, flat, LIST)
    seen = np.zeros((q, n), bool)
    hit = np.zeros((q, n), bool)
    seen[:, start] = True
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf)
    done = np.zeros((q, beam), bool)
    ids[:, 0] = start
    sims[:, 0] = v[queries] @ v[start]
    hit[:, start] = sims[:, 0] >= least
    while True:
        open_ = np.where(done | (ids < 0), -np.inf, sims)
        pick = open_.argmax(1)
        live = np.flatnonzero(open_[rows, pick] > -np.inf)
        if not len(live):
            break
        done[live, pick[live]] = True
        nbr = graph[ids[live, pick[live]]]
        new = (nbr >= 0) & ~seen[live[:, None], nbr]
        r, c = np.nonzero(new)
        who, node = live[r], nbr[r, c]
        seen[who, node] = True
        s = np.full(nbr.shape, -np.inf)
        s[r, c] = np.einsum("pd,pd->p", v[queries[who]], v[node])
        hit[who, node] |= s[r, c] >= least
        all_ids, all_sims = np.concatenate([ids[live], np.where(new, nbr, -1)], 1), np.concatenate([sims[live], s], 1)
        all_done = np.concatenate([done[live], np.zeros(nbr.shape, bool)], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
    seen[rows, queries] = hit[rows, queries] = True
    who, node = np.nonzero(hit)
    while len(who):
        size = begin[node + 1] - begin[node]
        who, nbr = np.repeat(who, size), flat[np.repeat(begin[node] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        new = ~seen[who, nbr]
        who, node = np.divmod(np.unique(who[new] * n + nbr[new]), n)
        seen[who, node] = True
        near = np.concatenate([np.einsum("pd,pd->p", v[queries[who[i : i + 100_000]]], v[node[i : i + 100_000]]) for i in range(0, len(who), 100_000)] or [np.empty(0)]) >= least
        who, node = who[near], node[near]
        hit[who, node] = True
    return np.nonzero(hit)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs that connect what all pairs connect."""
    root = list(range(n))
    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


def _result(rep, m, a, b, counted) -> pa.Table:
    """Rows (rep, links) of the counted pairs, weighted by the vectors of a node, and rows (a, b) of connecting links."""
    n = len(rep)
    links = np.bincount(a[counted], m[b[counted]], n) + np.bincount(b[counted], m[a[counted]], n)
    tree = _forest(n, a, b)
    return _rows(rep, links, a[tree], b[tree])


def _rows(rep, links, a, b) -> pa.Table:
    some = np.flatnonzero(links)
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.table({
        "rep": pa.chunked_array([pa.array(rep[some], pa.int64()), none(len(a))]), "links": pa.chunked_array([pa.array(links[some].astype(np.int64)), none(len(a))]),
        "a": pa.chunked_array([none(len(some)), pa.array(rep[a], pa.int64())]), "b": pa.chunked_array([none(len(some)), pa.array(rep[b], pa.int64())]),
    })


FOUND = "rep long, links long, a long, b long"
KEY = ["label", "dim", "shard"]


def _counted(table: pa.Table, rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows: is this shard the one that counts them? It is the home of the smaller one if the other is there
    too, else the home of the other."""
    shards, mine = table.column("shards").combine_chunks(), table.column("shard")[0].as_py()
    size = shards.value_lengths().to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    flat = shards.flatten().to_numpy(zero_copy_only=False)
    home = flat[begin]
    lists = np.where(np.arange(size.max()) < size[:, None], flat[np.minimum(begin[:, None] + np.arange(size.max()), len(flat) - 1)], -1)
    low, high = np.where(rep[a] <= rep[b], a, b), np.where(rep[a] <= rep[b], b, a)
    out = home[low] == mine
    rest = np.flatnonzero(~out & (home[high] == mine))
    for i in range(0, len(rest), 100_000):
        part = rest[i : i + 100_000]
        out[part] = ~(lists[high[part]] == home[low[part], None]).any(1)
    return out


def _usable():
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & some & ~F.coalesce(bad, F.lit(True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, dim and two hashes of the rows that can link with others."""
    return vectors.filter(_usable()).select("vec_id", "label", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("other"), "embedding").alias("h2"))


def classes(vectors: DataFrame) -> DataFrame:
    """rep (smallest vec_id), m, asked (is one of its vectors audited?), label, dim, h1, h2, embedding of each distinct
    usable vector of a label."""
    asked = F.max((F.pmod("vec_id", F.lit(AUDITED)) == 0).cast("int"))
    return usable(vectors).groupBy("label", "embedding", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), asked.alias("asked")).select("rep", "m", "asked", "label", "dim", "h1", "h2", "embedding")


def _picked(nodes: DataFrame, group: list[str], per: float) -> DataFrame:
    """Nodes picked by a hash as centres, one in `per`, of the groups with more than two shards' nodes."""
    sizes = nodes.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * SHARD_NODES).drop("_n")
    parts = 1 << 30
    pick = F.pmod(F.xxhash64(F.lit("centre"), F.col("rep")), F.lit(parts))
    return nodes.filter(pick < F.lit(parts) / per).join(sizes, group, "left_semi").select(*group, "embedding")


def _nearest(v: np.ndarray, centres: np.ndarray, margin: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centre, cosine) of each vector's best centre and the next ones within the margin, best first."""
    s = v @ centres.T
    k = min(most, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    best = np.take_along_axis(s, top, 1)
    inside = (best >= best[:, :1] - margin) | (np.arange(k) < LEAST_SHARDS)
    row, at = np.nonzero(inside)
    return row, top[row, at], best[row, at]


def _assigned(nodes: DataFrame, centres: dict, margin: float, most: int) -> DataFrame:
    """rep and choices (cosine, shard) by the centres of each (label, dim), best first; shard 0 where there are none."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # at most about MAX_CENTRES vectors

    def assign(batches):
        for batch in batches:
            label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            out = [[{"cosine": 1.0, "shard": 0}] for _ in label]
            for key in set(zip(label, dim, strict=True)) & set(shared.value):
                at = np.array([i for i, k in enumerate(zip(label, dim, strict=True)) if k == key])
                row, centre, cosine = _nearest(unit(_matrix(batch.column("embedding").take(pa.array(at)))), shared.value[key], margin, most)
                for i in at.tolist():
                    out[i] = []
                for r, c, x in zip(at[row].tolist(), centre.tolist(), cosine.tolist(), strict=True):
                    out[r].append({"cosine": x, "shard": c})
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, pa.list_(pa.struct([("cosine", pa.float64()), ("shard", pa.int64())])))], ["rep", "choices"])

    return nodes.select("rep", "label", "dim", "embedding").mapInArrow(assign, "rep long, choices array<struct<cosine:double,shard:long>>")


def _in_cells(nodes: DataFrame, cells: DataFrame, margin: float, most: int) -> DataFrame:
    """rep and choices by the centres of each cell that a node is in: blocks of a cell's nodes meet all its centres."""
    key = ["label", "dim", "cell"]
    placed, path = written_at(cells.select("rep", F.explode("choices.shard").alias("cell")).join(nodes.select("rep", "label", "dim", "embedding"), "rep"), "cells")
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / CELL_BLOCK).cast("long").alias("blocks"))
    centres = _picked(placed, key, SHARD_NODES).join(sizes, key).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = placed.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    both = dealt.select(*key, "block", "rep", "embedding").unionByName(centres.select(*key, "block", F.lit(None).cast("long").alias("rep"), "embedding"))

    def assign(table: pa.Table) -> pa.Table:
        rep, cell = table.column("rep"), table.column("cell")[0].as_py() << 24
        here = np.asarray(rep.is_valid())
        v, c = (unit(_matrix(table.column("embedding").take(pa.array(np.flatnonzero(x))))) if x.any() else None for x in (here, ~here))
        n = int(here.sum())
        row, at, cosine = (np.arange(n), np.zeros(n, np.int64), np.ones(n)) if c is None or v is None else _nearest(v, c[np.lexsort(c.T)], margin, most)
        return pa.table({"rep": rep.take(pa.array(np.flatnonzero(here)[row])), "cosine": cosine, "shard": cell + at})

    chosen = both.groupBy(*key, "block").applyInArrow(assign, "rep long, cosine double, shard long")
    best = F.slice(F.sort_array(F.collect_list(F.struct("cosine", "shard")), asc=False), 1, most)
    out = written(chosen.groupBy("rep").agg(best.alias("choices")), "choices")
    delete(nodes.sparkSession, path)
    return out


def _members(nodes: DataFrame, margin: float, most: int) -> DataFrame:
    """The nodes of every shard (label, dim, shard), each with all of its shards, its home first."""
    centres: dict = {}
    n = nodes.count()
    for r in _picked(nodes, ["label", "dim"], max(SHARD_NODES, n / MAX_CENTRES)).collect():
        centres.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    choices = _assigned(nodes, {k: unit(np.array(sorted(v), np.float64)) for k, v in centres.items() if len(v) > 1}, margin, most)
    if n > MAX_CENTRES * SHARD_NODES:
        choices = _in_cells(nodes, choices, margin, most)
    return nodes.join(choices.select("rep", F.col("choices.shard").alias("shards")), "rep").withColumn("shard", F.explode("shards")).select("rep", "m", "embedding", *KEY, "shards")


def _build(table: pa.Table) -> pa.Table:
    rep = table.column("rep").to_numpy()
    v = unit(_matrix(table.column("embedding")))
    return pa.table({"rep": rep, "nbrs": pa.array([rep[g] for g in both_ways(pruned_graph(v))], pa.list_(pa.int64()))})


def _search(similar: float):
    def run(table: pa.Table) -> pa.Table:
        rep, m = table.column("rep").to_numpy(), table.column("m").to_numpy()
        v = unit(_matrix(table.column("embedding")))
        lists = table.column("nbrs").combine_chunks()
        flat, count = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        order = np.argsort(rep)
        at = np.minimum(np.searchsorted(rep[order], flat), len(rep) - 1)
        here = rep[order][at] == flat
        flat, owner = order[at[here]], np.repeat(np.arange(len(rep)), count)[here]
        begin = np.searchsorted(owner, np.arange(len(rep) + 1))
        start, mine = int((v @ v.mean(0)).argmax()), table.column("shard")[0].as_py()
        at_home = np.flatnonzero(np.fromiter((x[0] == mine for x in table.column("shards").to_pylist()), bool, len(rep)))
        pairs = [np.empty(0, np.int64)]
        for i in range(0, len(at_home), 256):
            queries = at_home[i : i + 256]
            q, node = range_search(v, begin, flat, start, similar - 1e-6, queries)
            q = queries[q]
            pairs.append(np.unique(np.minimum(q, node) * len(rep) + np.maximum(q, node)))
        pairs = np.unique(np.concatenate(pairs))
        a, b = pairs // len(rep), pairs % len(rep)
        ok = a != b
        ok[ok] = _verified(v, a[ok], b[ok], similar)
        a, b = a[ok], b[ok]
        return _result(rep, m, a, b, _counted(table, rep, a, b))

    return run


def _verified(v, a, b, similar):
    return np.concatenate([np.einsum("pd,pd->p", v[a[i : i + 100_000]], v[b[i : i + 100_000]]) >= similar for i in range(0, len(a), 100_000)] or [np.empty(0, bool)])


def _compare(similar: float):
    """All pairs between the two blocks of a pair (or within its one block), exactly."""

    def run(table: pa.Table) -> pa.Table:
        rep, m, part = (table.column(k).to_numpy() for k in ("rep", "m", "part"))
        v, low, same = unit(_matrix(table.column("embedding"))), table.column("low")[0].as_py(), table.column("low")[0] == table.column("high")[0]
        left, right = np.flatnonzero(part == low), np.flatnonzero(same | (part != low))
        found = []
        for i in range(0, len(left), 512):
            q, node = np.nonzero(v[left[i : i + 512]] @ v[right].T >= similar)
            found.append((left[i + q], right[node]))
        a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
        ok = a < b if same else a != b
        a, b = a[ok], b[ok]
        return _result(rep, m, a, b, _counted(table, rep, a, b))

    return run


def _found(members: DataFrame, similar: float) -> DataFrame:
    members, path = written_at(members, "members")
    large = members.groupBy(*KEY).agg(F.ceil(F.count("*") / (SHARD_LIMIT // 2)).cast("long").alias("parts")).filter(F.col("parts") > 2)
    fitting = members.join(large.select(*KEY), KEY, "left_anti")
    lists = fitting.select("rep", "embedding", *KEY).groupBy(*KEY).applyInArrow(_build, "rep long, nbrs array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))
    searched = fitting.join(united, "rep").groupBy(*KEY).applyInArrow(_search(similar), FOUND)
    dealt = members.join(large, KEY).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    compared = dealt.groupBy(*KEY, "low", "high").applyInArrow(_compare(similar), FOUND)
    out = written(searched.unionByName(compared), "found-links")
    delete(members.sparkSession, path)
    return out


def _compare_all(similar: float):
    """All pairs between the two blocks of a pair (or within its one block), some rows at a time: links are added up, and
    of the pairs only those are kept that connect what the ones before do not."""

    def run(table: pa.Table) -> pa.Table:
        rep, m, part = (table.column(k).to_numpy() for k in ("rep", "m", "part"))
        v, low, same = unit(_matrix(table.column("embedding"))), table.column("low")[0].as_py(), table.column("low")[0] == table.column("high")[0]
        left, right = np.flatnonzero(part == low), np.flatnonzero(same | (part != low))
        n = len(rep)
        links, group, a, b = np.zeros(n), np.arange(n), [], []
        for i in range(0, len(left), EXACT_ROWS):
            rows = left[i : i + EXACT_ROWS]
            near = v[rows] @ v[right].T >= similar
            if same:
                near[np.arange(len(rows)), i + np.arange(len(rows))] = False
            q, node = np.nonzero(near)
            node = right[node]
            links += np.bincount(rows[q], m[node], n)
            if not same:
                links += np.bincount(node, m[rows[q]], n)
            for row, met in zip(rows, np.split(node, np.searchsorted(q, np.arange(1, len(rows)))), strict=True):
                while len(met := met[group[met] != group[row]]):
                    a.append(row)
                    b.append(met[0])
                    group[group == group[met[0]]] = group[row]
        return _rows(rep, links, np.array(a, np.int64), np.array(b, np.int64))

    return run


def compared(nodes: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The links of all nodes, every pair of a label's nodes compared: the work grows with the square of the nodes, a task
    holds two blocks of them and the pairs of some rows."""
    block = F.greatest(F.lit(1), F.least(F.lit(EXACT_BLOCK), F.floor(F.lit(EXACT_ENTRIES) / F.col("dim"))))
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / block).cast("long").alias("parts"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("rep", "m", "embedding", "label", "dim", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    return written(dealt.groupBy("label", "dim", "low", "high").applyInArrow(_compare_all(similar), FOUND), "compared-links")


def audit(nodes: DataFrame, found: DataFrame, similar: float = SIMILAR) -> float | None:
    """Share of the true links of an audited node, by brute force over all rows, that were found: the mean over the nodes
    that have links, None where none has: nothing was measured then. Blocks of audited nodes meet blocks of all nodes of their label."""
    parts = lambda n: F.ceil(n / AUDIT_BLOCK).cast("long")
    sizes = nodes.groupBy("label", "dim").agg(parts(F.sum("asked")).alias("asking"), parts(F.count("*")).alias("blocks")).filter("asking > 0")
    rows, every = nodes.join(sizes, ["label", "dim"]), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    queries = rows.filter("asked = 1").withColumns({"q": dealt("asking"), "b": every("blocks"), "query": F.lit(True)})
    others = rows.withColumns({"b": dealt("blocks"), "q": every("asking"), "query": F.lit(False)})
    cols = ["label", "dim", "q", "b", "rep", "m", "embedding", "query"]

    def count(table: pa.Table) -> pa.Table:
        query, rep, m = (table.column(c).to_numpy() for c in ("query", "rep", "m"))
        v, asked, rest = unit(_matrix(table.column("embedding"))), np.flatnonzero(query), np.flatnonzero(~query)
        links = [((v[asked[i : i + 512]] @ v[rest].T >= similar) & (rep[asked[i : i + 512], None] != rep[rest])) @ m[rest] for i in range(0, len(asked), 512)]
        return pa.table({"rep": rep[asked], "links": np.concatenate([*links, np.empty(0, np.int64)]).astype(np.int64)})

    counts = queries.select(*cols).unionByName(others.select(*cols)).groupBy("label", "dim", "q", "b").applyInArrow(count, "rep long, links long")
    true = counts.groupBy("rep").agg(F.sum("links").alias("known")).filter("known > 0")
    got = found.filter("rep is not null").groupBy("rep").agg(F.sum("links").alias("got"))
    return true.join(got, "rep", "left").agg(F.avg(F.least(F.coalesce("got", F.lit(0)) / F.col("known"), F.lit(1.0)))).first()[0]


def near_groups(vectors: DataFrame, similar: float = SIMILAR, margin: float = MARGIN) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other vectors of its label with cosine >= similar), component_id
    (smallest vec_id that links lead to), kept (vec_id = component_id), and the audited recall of the whole result, null where no audited vector has a link: the
    result is then made exactly, as it is where the recall is too low.

    Vectors that are null, empty, all zero or hold null or non-finite entries, or whose label or vec_id is null, have no
    links. Vectors of different lengths are not compared. Equal vectors of a label are linked. Rows that repeat a vec_id
    each give a row and each count; where their vectors differ, they share their links. Extra columns are ignored; an
    empty table gives no rows.
    """
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    nodes = written(classes(rows), "vector-classes")
    most, recall, found = MOST_SHARDS, 0.0, None
    for _ in range(ATTEMPTS):
        found = _found(_members(nodes, margin, most), similar)
        recall = audit(nodes, found, similar)
        log.info("recall %s at margin %.3f and %d shards", recall, margin, most)
        if recall is None or recall >= TARGET:
            break
        margin, most = margin * 1.6, most + 2
    if recall is None or recall < LEAST_RECALL:
        found = compared(nodes, similar)
        recall = None if recall is None else audit(nodes, found, similar)
    links = found.filter("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("a is not null"), "a", "b").withColumnRenamed("node", "rep")
    of = nodes.join(links, "rep", "left").join(joined, "rep", "left").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of = written(of, "class-links")
    if not of.groupBy("label", "h1", "h2").count().filter("count > 1").isEmpty():
        raise RuntimeError("two vectors have the same 128 bits of hashes")
    # vectors meet their class by hashes, and both sides are plain exchanges, so that a very common vector can be split
    linked = usable(rows).select("vec_id", "label", "h1", "h2").join(of, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("recall"))
