"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut after every word whose hash falls on a fixed residue, so equal passages are cut alike wherever they
stand. Each chunk gets its 64-bit hash as identifier, and texts are read a single time: a document becomes the ordered
list of its chunks' identifiers and of their SHA-256 digests. An identifier is verified when all chunks that have it, in
the whole table, share one digest; documents are then compared by their ordered identifier lists alone, and no text is
moved. Should two chunks ever share an identifier, the documents that hold either are told apart by their text's
SHA-256 as well. Groups are written before the documents are joined to them, so that both sides of that join are plain
exchanges and adaptive execution can split a group of very many copies over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE, written

#: A chunk ends, on average, after so many words.
WORDS_PER_CHUNK = 32


def normalised(text: Column) -> Column:
    """The compared form: null is empty, each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def once(value: Column, use) -> Column:
    """use(value), with value worked out a single time: a lambda variable is never inlined, a projected column may be."""
    return F.get(F.transform(F.array(value), use), 0)


def chunks_of(norm: Column, words_per_chunk: int = WORDS_PER_CHUNK) -> Column:
    """The chunks of a normalised text; joined by single spaces they are that text."""

    def cut(words: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (F.pmod(F.xxhash64(F.get(words, i - 1)), F.lit(words_per_chunk)) == 0) | (i == F.size(words)))
        start = lambda e, j: F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1))
        return once(ends, lambda e: F.transform(e, lambda c, j: F.concat_ws(" ", F.slice(words, start(e, j) + 1, c - start(e, j)))))

    return once(F.split(norm, " "), cut)


def recipes_of(docs: DataFrame, words_per_chunk: int = WORDS_PER_CHUNK) -> DataFrame:
    """doc_id, text_hash (of the text as it is), text_sha256, recipe (the chunks' identifiers in order) and digests (their SHA-256 in the same order)."""
    listed = lambda n: once(chunks_of(n, words_per_chunk), lambda c: F.struct(F.transform(c, lambda x: F.xxhash64(x)).alias("recipe"), F.transform(c, lambda x: F.unhex(F.sha2(x.cast("binary"), 256))).alias("digests")))
    both = once(normalised(F.col("text")), lambda n: F.struct(F.sha2(n.cast("binary"), 256).alias("text_sha256"), listed(n).alias("c")))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), both.alias("x")).select("doc_id", "text_hash", "x.text_sha256", "x.c.recipe", "x.c.digests")


def conflicts(recipes: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk: none, but for a hash collision."""
    pairs = recipes.select(F.explode(F.arrays_zip("recipe", "digests")).alias("c")).select(F.col("c.recipe").alias("id"), F.col("c.digests").alias("digest"))
    return pairs.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("id")


def exact_groups(docs: DataFrame, words_per_chunk: int = WORDS_PER_CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id (smallest doc_id of equal texts), group_size, kept, text_sha256, and
    text_hash, which tells rows of one doc_id apart.

    Null and empty texts are equal to each other; a text of white space only equals a single space. Rows that repeat
    a doc_id each count in group_size and are all kept or dropped alike; a row without doc_id counts, but is never the one
    that stays unless all of its group are, when keep_id is null and kept is true for each. Extra columns are ignored; no
    rows in, none out.
    """
    recipes = written(recipes_of(docs, words_per_chunk), "recipes")
    clash = written(conflicts(recipes), "chunk-conflicts")
    plain = recipes.select("doc_id", "text_hash", "text_sha256", "recipe")
    if clash.isEmpty():
        keyed = plain.withColumn("apart", F.lit(""))
    else:
        doubtful = written(plain.select("text_sha256", F.explode("recipe").alias("id")).join(clash, "id", "left_semi").select("text_sha256").distinct().withColumn("apart", F.col("text_sha256")), "doubtful")
        keyed = plain.join(doubtful, "text_sha256", "left").withColumn("apart", F.coalesce("apart", F.lit("")))
    groups = written(keyed.groupBy("recipe", "apart").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    return keyed.join(groups, ["recipe", "apart"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_hash")
