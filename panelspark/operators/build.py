"""From raw bars to a stored panel: quality checks, rejection, alignment, fingerprint and manifest in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.lineage import settled
from panelspark.operators import ledger, panel, qc
from panelspark.sources import bars as sources


def build_from_files(spark: SparkSession, path: str, symbol: Column | None = None, actions: DataFrame | None = None, version: str = ledger.SCHEMA_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, report, manifest) of vendor files: a file that cannot be read is a FAIL row of the report and the rest is built.
    The manifest has the raw files' digests and the report as well."""
    rows = sources.read_vendor_files(spark, path, symbol).withColumn("date", F.to_date("ts"))
    panel_, report, manifest = build_panel(rows, actions, version)
    errors = settled(sources.load_errors(spark, path, symbol), "load-errors")
    failed = errors.select(F.coalesce("symbol", "path").alias("symbol"), F.lit(0).cast("long").alias("n_rows"), F.concat(F.lit("load error: "), "issue").alias("issues"), F.lit("FAIL").alias("status"))
    report = report.unionByName(failed, allowMissingColumns=True)
    digests = sources.file_digests(spark, path)
    files = digests.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "sha256")))).alias("files"))
    quality = report.agg(F.sort_array(F.collect_list(F.struct("symbol", "status", "n_rows", "issues"))).alias("qc"), (F.count_if(F.col("status") == "FAIL") == 0).alias("passed"), F.sort_array(F.collect_list(F.when(F.col("status") == "FAIL", F.col("symbol")))).alias("failed"))
    return panel_, report, manifest.drop("passed", "failed").crossJoin(quality).crossJoin(files)


def build_panel(bars: DataFrame, actions: DataFrame | None = None, version: str = ledger.SCHEMA_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, report, manifest) of daily bars (symbol, date, close and what else they have).

    Series with a failed quality report are left out of the panel but stay in the report. The panel has every date of any
    series left for each of them, closes missing where there was no bar, and returns between consecutive rows. The
    manifest is one row: symbols (sorted), failed (likewise), rows, first, last, all_present_rows, passed (no series
    failed) and dataset_hash, which depends on the panel, the corporate actions and the version alone.
    """
    bars = settled(bars, "raw-bars")
    report = settled(qc.qc_report(bars), "qc-report")
    kept = settled(panel.union_panel(panel.last_per_date(qc.passing(bars, report), "date")), "panel")
    whole = kept.filter("close is not null").groupBy("date").agg(F.countDistinct("symbol").alias("k"))
    n = kept.agg(F.countDistinct("symbol").alias("n"))
    present = whole.join(F.broadcast(n), F.col("k") == F.col("n")).agg(F.count("*").alias("all_present_rows"))
    body = kept.agg(F.sort_array(F.collect_set("symbol")).alias("symbols"), F.countDistinct("date").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
    failed = report.agg(F.sort_array(F.collect_list(F.when(F.col("status") == "FAIL", F.col("symbol")))).alias("failed")).withColumn("passed", F.size("failed") == 0)
    manifest = body.crossJoin(present).crossJoin(failed).crossJoin(ledger.fingerprint(kept, actions, version))
    return panel.with_returns(kept), report, manifest
