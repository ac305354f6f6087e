"""Row numbers, as-of positions and decayed running sums over series of any length: no task sees a whole series.

Rows are dealt to ranges of (keys, order) and written once, so that the ranges stay as they are; what a range needs to
know of those before it is a number or a few sums a range.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.lineage import settled

#: Blocks are scanned in groups of 2^BITS, these again in groups, and the groups of groups of a key at last.
BITS = 8


def parted(df: DataFrame, keys: tuple[str, ...], order: str, name: str = "parted") -> DataFrame:
    """df with _part, the number of the range of (keys, order) that a row falls into; equal rows share a range."""
    return settled(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), name)


def _lookup(of: dict, key: str) -> Column:
    """A column's value in a small dictionary."""
    pairs = [x for k, v in sorted(of.items()) for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(key)) if pairs else F.lit(None)


def _before(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, _part and how many rows of the keys are in earlier parts."""
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), "_n")


def numbered(df: DataFrame, order: str, name: str = "row", keys: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's place (from 0) in its keys' order. Counts of the ranges are added up, not rows: by keys in Spark,
    or without keys, where they are one number a range, on the driver."""
    rows = parted(df, keys, order)
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1
    if keys:
        out = rows.withColumn(name, inside).join(_before(rows, keys).drop("_n"), [*keys, "_part"])
    else:
        sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
        before, total = {}, 0
        for p in sorted(sizes):
            before[p], total = total, total + sizes[p]
        out = rows.withColumn(name, inside).withColumn("_before", _lookup(before, "_part"))
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).select(*df.columns, name)


#: Rows of a key that one task sees at most, in chunked() and what builds on it.
CHUNK = 1 << 20


def chunked(df: DataFrame, keys: tuple[str, ...], order: str, halo: int, build: Callable[[DataFrame, tuple[str, ...]], DataFrame], rows: int | None = None) -> DataFrame:
    """build(df, keys), for a build whose rows depend on at most `halo` rows before them in their keys' order, with no
    more than `rows` and a halo of a key in one task.

    Where no key has more rows, windows over whole keys do. Else rows are numbered, each goes to the chunk of its number
    and, as halo, to the chunks that look back to it; build works by (keys, chunk), and what it gives for a halo is dropped.
    build keeps the columns that it is given. Missing keys and values are handled as build handles them; rows that tie in
    the order are numbered in some order, as in a window.
    """
    rows = rows or CHUNK
    df = settled(df, "chunked")
    longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= rows:
        return build(df, keys)
    named = [f"_k{i}" for i in range(len(keys))]  # as structs, so that a missing key is a key like others
    at = numbered(df.select("*", *[F.struct(k).alias(n) for k, n in zip(keys, named, strict=True)]), order, "_row", tuple(named)).drop(*named)
    own = F.floor(F.col("_row") / rows)
    spread = at.withColumn("_chunk", F.explode(F.sequence(own, F.floor((F.col("_row") + halo) / rows))))
    return build(spread, (*keys, "_chunk")).filter(own == F.col("_chunk")).drop("_row", "_chunk")


def as_of(points: DataFrame, order: str, value: str, bounds: DataFrame, at: str, name: str) -> DataFrame:
    """bounds with the value of the last point at or before `at`, NULL where there is none. Values rise with the order (row
    numbers, say). Points and bounds are merged in one order: a running maximum within a range, carried in by the range's number."""
    places = points.select(F.col(order).alias("_t"), F.col(value).alias("_v"), F.lit(None).cast(bounds.schema).alias("_b"))
    asked = bounds.select(F.col(at).alias("_t"), F.lit(None).cast(points.schema[value].dataType).alias("_v"), F.struct(*bounds.columns).alias("_b"))
    rows = parted(places.unionByName(asked), (), "_t")
    tops = {r["_part"]: r["v"] for r in rows.groupBy("_part").agg(F.max("_v").alias("v")).collect()}
    carried, most = {}, None
    for p in sorted(tops):
        if most is not None:
            carried[p] = most
        most = tops[p] if most is None else max(most, tops[p] if tops[p] is not None else most)
    inside = F.max("_v").over(Window.partitionBy("_part").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_in", inside).filter("_b is not null")
    return found.select("_b.*", (F.coalesce("_in", _lookup(carried, "_part")) if carried else F.col("_in")).alias(name))


def _joined(decay, total, carry) -> Column:
    return F.zip_with(total, F.zip_with(decay, carry, lambda a, b: a * b), lambda a, b: a + b)


def _prefix(df: DataFrame, by: list[str], order: str, steps: int) -> DataFrame:
    """_d and _s of every row joined with those of the rows before it, of 2^steps rows at most: in each step a row takes in the
    row 1, 2, 4, ... before it. All steps are windows over one partitioning and order."""
    w = Window.partitionBy(*by).orderBy(order)
    rest = [c for c in df.columns if c not in ("_d", "_s")]
    for k in range(steps):
        df = df.withColumn("_l", F.lag(F.struct("_d", "_s"), 1 << k).over(w))
        first = F.col("_l").isNull()
        d = F.when(first, F.col("_d")).otherwise(F.zip_with("_d", F.col("_l._d"), lambda a, b: a * b))
        df = df.select(*rest, d.alias("_d"), F.when(first, F.col("_s")).otherwise(_joined(F.col("_d"), F.col("_s"), F.col("_l._s"))).alias("_s"))
    return df


def carried_sums(blocks: DataFrame, keys: tuple[str, ...], number: str) -> DataFrame:
    """keys, number and _c: what all earlier blocks of the keys add up to at each block's start.

    blocks: keys, number (from 0, without gaps), _d (an array: by what the block ages each sum) and _s (its own sums). Pairs
    (d, s) are joined associatively: within groups of 2^BITS blocks, then groups of groups, then over those, in as many
    steps as the longest key's number of blocks has bits, and the results are handed down again. A task holds a group, or a
    key's groups of groups.
    """
    keys = list(keys)
    bits = (blocks.agg(F.max(number).alias("n")).first()["n"] or 0).bit_length()
    steps = [min(BITS, max(0, bits - k * BITS)) for k in (0, 1)]
    one = settled(_prefix(blocks.select(*keys, F.col(number).alias("_n0"), F.shiftright(number, BITS).alias("_n1"), "_d", "_s"), [*keys, "_n1"], "_n0", steps[0]), "block-sums")
    last = lambda df, g, n: df.groupBy(*keys, g).agg(F.max_by(F.struct("_d", "_s"), n).alias("_x")).select(*keys, g, "_x._d", "_x._s")
    two = _prefix(last(one, "_n1", "_n0").withColumn("_n2", F.shiftright("_n1", BITS)), [*keys, "_n2"], "_n1", steps[1])
    three = _prefix(last(two, "_n2", "_n1"), keys, "_n2", max(0, bits - 2 * BITS))
    zero = F.transform("_s", lambda _: F.lit(0.0))
    carry = three.select(*keys, "_n2", F.coalesce(F.lag("_s").over(Window.partitionBy(*keys).orderBy("_n2")), zero).alias("_c"))
    for level, group, n in ((two, "_n2", "_n1"), (one, "_n1", "_n0")):
        before = F.lag(F.struct("_d", "_s")).over(Window.partitionBy(*keys, group).orderBy(n))
        rows = level.withColumn("_l", before).join(carry, [*keys, group])
        carry = rows.select(*keys, n, F.when(F.col("_l").isNull(), F.col("_c")).otherwise(_joined(F.col("_l._d"), F.col("_l._s"), F.col("_c"))).alias("_c"))
    return carry.withColumnRenamed("_n0", number)


def decayed_sums(rows: DataFrame, keys: tuple[str, ...], order: str, sums: dict[str, tuple[Column, float]], block: int) -> DataFrame:
    """rows, as parted() gives them, with, for each name -> (value, q), the sum over the keys' rows so far of value q^(rows
    since), a missing value counting as 0. Within blocks of rows weights are relative; blocks are joined by carried_sums."""
    keys_, names = [*keys, "_part"], [c for c in rows.columns if c != "_part"]
    before = _before(rows, keys)
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = before.select(*keys_, F.coalesce(F.sum(F.ceil(F.col("_n") / block)).over(w), F.lit(0)).cast("long").alias("_b0"))
    local = F.row_number().over(Window.partitionBy(*keys_).orderBy(order)) - 1
    rows = rows.withColumn("_k", local).withColumn("_o", F.col("_k") % block).withColumn("_b", F.floor(F.col("_k") / block))
    inner = {n: F.coalesce(v, F.lit(0.0)) * F.pow(F.lit(q), -F.col("_o")) for n, (v, q) in sums.items()}
    ends = rows.groupBy(*keys_, "_b").agg((F.max("_o") + 1).alias("_m"), *[F.sum(v).alias(n) for n, v in inner.items()]).join(blocks, keys_)
    aged = [F.pow(F.lit(q), F.col("_m")) for _, q in sums.values()]
    totals = [F.col(n) * F.pow(F.lit(q), F.col("_m") - 1) for n, (_, q) in sums.items()]
    numbers = (F.col("_b") + F.col("_b0")).alias("_block")
    ends = settled(ends.select(*keys_, "_b", numbers, F.array(*aged).alias("_d"), F.array(*totals).alias("_s")), "blocks")
    carry = carried_sums(ends.drop("_part", "_b"), keys, "_block").join(ends.select(*keys_, "_b", "_block"), [*keys, "_block"]).drop("_block")
    inside = Window.partitionBy(*keys_, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    rows = reduce(lambda d, n: d.withColumn(n, F.sum(inner[n]).over(inside)), sums, rows).join(carry, [*keys_, "_b"])
    out = [((F.col(n) + F.get("_c", F.lit(i)) * q) * F.pow(F.lit(q), F.col("_o"))).alias(n) for i, (n, (_, q)) in enumerate(sums.items())]
    return rows.select(*names, *out)
