"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, BPE encoding.

Each stage takes all that its predecessor kept, whole; its result is written as Parquet to the shared folder and read
again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm import bpe, exact_dedup, language_id, mixing, simhash
from panelspark.llm.common import delete, kept_tables, table, written, written_at

#: A text is rejected when no language is found, or the best one's probability is below this and its lead is small.
LEAST_SCORE = 0.4


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined (left_semi or left_anti) with keys (doc_id, text_hash): rows of one doc_id, or none, are told apart by
    their text."""
    keys = keys.select(F.col("doc_id").alias("_key_id"), F.col("text_hash").alias("_key_hash"))
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_key_id"]) & (F.xxhash64(docs["text"]) == keys["_key_hash"]), how)


def one_of_each(docs: DataFrame, decided: DataFrame, *group: Column) -> DataFrame:
    """The row of docs that each group keeps. decided: doc_id, text_hash and kept of every row; where a group keeps several
    rows, as they share a doc_id, the one with the smallest text_hash stays, and of rows alike in both any one."""
    decided = written(decided.select("doc_id", "text_hash", "kept", *[g.alias(f"_g{i}") for i, g in enumerate(group)]), "decided")
    names = [f"_g{i}" for i in range(len(group))]
    ties = written(decided.filter("kept").groupBy(*names).agg(F.count("*").alias("_n"), F.min("text_hash").alias("_first")).filter("_n > 1").drop("_n"), "ties")
    if ties.isEmpty():
        return matched(docs, decided.filter("not kept").distinct(), "left_anti")
    decided = decided.join(ties, names, "left").withColumn("kept", F.col("kept") & (F.col("_first").isNull() | (F.col("text_hash") == F.col("_first"))))
    alike = decided.filter("kept and _first is not null").distinct()
    gone = decided.filter("not kept").select("doc_id", "text_hash").unionByName(alike.select("doc_id", "text_hash")).distinct()
    number = F.row_number().over(Window.partitionBy(docs["doc_id"], F.xxhash64(docs["text"])).orderBy(docs["doc_id"]))
    once = matched(docs, alike, "left_semi").withColumn("_key_number", number).filter("_key_number = 1").drop("_key_number")
    return matched(docs, gone, "left_anti").unionByName(once)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without letters, or like no learned language, go."""
    return language_id.recognised(docs, language_id.train(docs), LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that of the smallest doc_id; rows without doc_id stay only where no
    row of their group has one."""
    return one_of_each(docs, exact_dedup.exact_groups(docs), F.col("text_sha256"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays, that of the smallest doc_id; rows without doc_id stay only
    where no row with their fingerprint has one."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return one_of_each(docs, simhash.near_groups(docs).withColumn("kept", kept), F.col("component_id").isNull(), F.coalesce("component_id", "fp"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number (often not at all), in the order of the
    schedule's slots."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, n_tokens, and the digests of its ids and of the text they decode to."""
    return bpe.digest(docs)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the hashes; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What a stage has written is deleted once its result is, and so is its input; the last
    one's result reads the mix."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = kept_tables(spark)
        docs, new = written_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete(spark, *[p for p in kept_tables(spark) if p not in before and p != new], *([path] if path else []))
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
