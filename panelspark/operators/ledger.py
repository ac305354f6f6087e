"""Provenance: fingerprints of a dataset, its manifest, and the checks of a trial ledger."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = "2"


def row_digests(panel: DataFrame) -> DataFrame:
    """month and digest of each row: date, symbol and the close in millionths."""
    text = F.concat_ws("|", F.col("date").cast("string"), "symbol", F.coalesce(F.round(F.col("close") * 1e6).cast("long").cast("string"), F.lit("")))
    return panel.select(F.trunc("date", "month").alias("month"), F.sha2(text, 256).alias("h"))


def month_digests(panel: DataFrame) -> DataFrame:
    """A digest a month: its rows' digests are dealt to 65,536 buckets by their first digits, sorted and hashed in those,
    and the buckets' digests are hashed in order; no task holds more than a bucket, or the buckets of a month."""
    buckets = row_digests(panel).groupBy("month", F.substring("h", 1, 4).alias("p")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("h"))
    return buckets.groupBy("month").agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])), 256).alias("h"))


def fingerprint(panel: DataFrame, actions: DataFrame | None = None, version: str = SCHEMA_VERSION) -> DataFrame:
    """One row, dataset_hash: changed by any change to the data, the corporate actions or the version, and by nothing else."""
    whole = month_digests(panel).agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("month", "h"))), lambda x: x["h"])).alias("months"))
    if actions is not None:
        listed = F.to_json(F.sort_array(F.collect_list(F.struct(*sorted(actions.columns)))))
        whole = whole.crossJoin(actions.agg(F.sha2(listed, 256).alias("acts")))
    else:
        whole = whole.withColumn("acts", F.lit(""))
    return whole.select(F.sha2(F.concat_ws("|", F.lit(version), "acts", "months"), 256).alias("dataset_hash"))


def manifest(panel: DataFrame, report: DataFrame, digests: DataFrame, dataset_hash: DataFrame) -> DataFrame:
    """One row: counts, date range, symbols, files' digests (and rows, if digests has n_rows), quality reports, dates with
    all symbols, dataset hash."""
    n = panel.agg(F.countDistinct("symbol").alias("n"))
    full = panel.filter("close is not null").groupBy("date").agg(F.countDistinct("symbol").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).agg(F.count("*").alias("all_present_rows"))
    body = panel.agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.sort_array(F.collect_set("symbol")).alias("symbols"))
    of_files = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", c))))
    files = digests.agg(of_files("sha256").alias("files"), *[of_files(c).alias("file_rows") for c in ("n_rows",) if c in digests.columns])
    quality = report.agg(F.sort_array(F.collect_list(F.struct("symbol", "status", "n_rows", "issues"))).alias("qc"), (F.count_if(F.col("status") == "FAIL") == 0).alias("passed"))
    return body.crossJoin(full).crossJoin(files).crossJoin(quality).crossJoin(dataset_hash)


def distinct_trials(trials: DataFrame) -> DataFrame:
    """The first run of each (config, dataset_hash)."""
    w = Window.partitionBy("config", "dataset_hash").orderBy("run_ts", "trial_id")
    return trials.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def record_trials(trials: DataFrame, path: str) -> None:
    """Append trials to the table at path: one slot a (config, dataset_hash), taken by the first run and never written again.

    Rows are staged beside the table and each new slot is moved in by a rename that fails where the slot is there, so
    a job that runs twice, or two at once, or again after it broke off, leave one row; readers never see half a slot.
    (Object stores have no such rename: keep the ledger on a file system.) trials has config, dataset_hash, run_ts,
    trial_id and what else is to be kept; a study records a row, so slots are moved one by one.
    """
    spark = trials.sparkSession
    slot = F.sha2(F.concat_ws("|", F.coalesce("config", F.lit("")), F.coalesce("dataset_hash", F.lit(""))), 256)
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    distinct_trials(trials).withColumn("slot", slot).repartition("slot").write.partitionBy("slot").parquet(staging)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(hadoop.Path(staging).toUri(), conf)
    kind = getattr(hadoop, "Options$Rename")
    never_over = spark.sparkContext._gateway.new_array(kind, 1)
    never_over[0] = kind.NONE
    for found in files.util().listStatus(hadoop.Path(staging)):
        name = found.getPath().getName()
        if not name.startswith("slot="):
            continue
        target = hadoop.Path(f"{path.rstrip('/')}/{name}")
        if not files.util().exists(target):
            try:
                files.rename(found.getPath(), target, never_over)
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                    raise
    files.delete(hadoop.Path(staging), True)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """The recorded trials, a row a slot."""
    return spark.read.parquet(path).drop("slot")


def ledger_check(trials: DataFrame, current: DataFrame, budget: int = 20) -> DataFrame:
    """Active (not STALE) trials with their problem: 'hash mismatch' where the stored hash does not start the current
    one, and whether distinct active slots exceed the budget. current: one row, dataset_hash."""
    active = trials.filter("status <> 'STALE'").crossJoin(F.broadcast(current.select(F.col("dataset_hash").alias("_now"))))
    slots = active.agg(F.countDistinct("config", "dataset_hash").alias("slots"))
    problem = F.when(~F.startswith("_now", "dataset_hash"), "hash mismatch").otherwise("")
    return active.crossJoin(F.broadcast(slots)).select("trial_id", "config", problem.alias("problem"), "slots", (F.col("slots") > budget).alias("over_budget"))
