"""Reading and writing bar files, exchange daily files, panels and manifests."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources import digests

BAR_FILE = "`<DATE>` string, `<TIME>` string, `<OPEN>` double, `<HIGH>` double, `<LOW>` double, `<CLOSE>` double, `<TICKVOL>` long, `<VOL>` long, `<SPREAD>` int"

#: Header dialects of an exchange's daily file: our name -> theirs (fixed values).
MODERN = {"date": "TradDt", "symbol": "TckrSymb", "series": "SctySrs", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "volume": "TtlTradgVol"}
LEGACY = {"date": "TIMESTAMP", "symbol": "SYMBOL", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "volume": "TOTTRDQTY"}
DAILY = "date string, symbol string, series string, open double, high double, low double, close double, volume double"
PRICES = ("open", "high", "low", "close")


def symbol_of_file(name: Column) -> Column:
    """The file name up to its first _ and then its first dot, upper-cased; a ((now)) prefix goes first."""
    bare = F.regexp_replace(name, r"^\(\(now\)\)", "")
    return F.upper(F.split(F.split(bare, "_")[0], r"\.")[0])


def read_bar_files(spark: SparkSession, path: str, symbol: Column | None = None) -> DataFrame:
    """Tab-separated bar files, one instrument each: symbol, ts, open, high, low, close, tickvol, vol, spread. The symbol is
    that of the file's name, unless an expression (over _metadata) is given, as for files in a folder a symbol."""
    raw = spark.read.option("sep", "\t").option("header", True).schema(BAR_FILE).csv(path)
    ts = F.try_to_timestamp(F.concat_ws(" ", "`<DATE>`", "`<TIME>`"), F.lit("yyyy.MM.dd HH:mm:ss"))
    cols = [F.col(f"`<{c}>`").alias(c.lower()) for c in ("OPEN", "HIGH", "LOW", "CLOSE", "TICKVOL", "VOL", "SPREAD")]
    symbol = symbol_of_file(F.col("_metadata.file_name")) if symbol is None else symbol
    return raw.select(symbol.alias("symbol"), ts.alias("ts"), *cols).filter("ts is not null")


#: Columns of a vendor file at most; a file with more is an error of its own.
MOST_COLUMNS = 64
TIME_FORMATS = ("yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy.MM.dd", "yyyy-MM-dd", "yyyyMMdd")


def _vendor_lines(spark: SparkSession, path: str, symbol: Column | None) -> tuple[DataFrame, DataFrame]:
    """Lines (value, path, symbol), and of each file: path, symbol, header, names (an array), sep and issue (NULL: none)."""
    symbol = symbol_of_file(F.col("_metadata.file_name")) if symbol is None else symbol
    lines = spark.read.text(path).select("value", symbol.alias("symbol"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    heads = lines.filter("at = 0").groupBy("path", "symbol").agg(F.min_by("value", "row").alias("header"))
    tabs, commas = (F.length("header") - F.length(F.replace("header", F.lit(c))) for c in ("\t", ","))
    sep = F.when(tabs >= commas, "\t").otherwise(",")
    names = F.transform(F.split("header", F.when(F.col("sep") == "\t", "\t").otherwise(",")), lambda c: F.upper(F.regexp_replace(F.trim(F.regexp_replace(c, r"[\r\x{FEFF}]", "")), "^<|>$", "")))
    heads = heads.withColumn("sep", sep).withColumn("names", names)
    has = lambda *c: F.arrays_overlap("names", F.array(*map(F.lit, c)))
    issue = F.when(F.size("names") > MOST_COLUMNS, f"more than {MOST_COLUMNS} columns").when(~has("CLOSE", "ADJ CLOSE"), "no CLOSE column").when(~has("DATE", "DATETIME"), "no DATE or DATETIME column")
    return lines.select("value", "path"), heads.withColumn("issue", issue)


def read_vendor_files(spark: SparkSession, path: str, symbol: Column | None = None) -> DataFrame:
    """CSV files of either delimiter with DATE+TIME, DATETIME or DATE and at least CLOSE, one instrument each: symbol, ts, the
    prices and volume. One scan whatever the number of headers: a file's header, its first line, travels to its lines as
    data, and they are parsed by position. Files that cannot be read that way are left to load_errors()."""
    lines, heads = _vendor_lines(spark, path, symbol)
    fields = ", ".join(f"c{i} string" for i in range(MOST_COLUMNS))
    rows = lines.join(heads.filter("issue is null"), "path").filter(F.col("value") != F.col("header"))
    parsed = F.when(F.col("sep") == "\t", F.from_csv("value", F.lit(fields), {"sep": "\t"})).otherwise(F.from_csv("value", F.lit(fields), {"sep": ","}))

    def fields_of(x: Column) -> Column:
        has = lambda name: F.array_contains(x["names"], name)
        at = lambda name: F.get(x["v"], F.array_position(x["names"], F.lit(name)).cast("int") - 1)
        text = F.when(has("DATE") & has("TIME"), F.concat_ws(" ", at("DATE"), at("TIME"))).when(has("DATETIME"), at("DATETIME")).otherwise(at("DATE"))
        values = {"open": at("OPEN"), "high": at("HIGH"), "low": at("LOW"), "close": F.when(has("ADJ CLOSE"), at("ADJ CLOSE")).otherwise(at("CLOSE")), "volume": F.when(has("VOL"), at("VOL")).otherwise(at("VOLUME"))}
        return F.struct(text.alias("t"), *[v.try_cast("double").alias(c) for c, v in values.items()])

    rows = rows.withColumn("_c", parsed).select("symbol", F.struct("names", F.array(*[F.col(f"_c.c{i}") for i in range(MOST_COLUMNS)]).alias("v")).alias("_l"))
    # a lambda's variable is worked out once, however often it is used
    rows = rows.select("symbol", F.get(F.transform(F.array("_l"), fields_of), 0).alias("_f"))
    ts = F.coalesce(*[F.try_to_timestamp("_f.t", F.lit(f)) for f in TIME_FORMATS], F.try_to_timestamp("_f.t"))
    return rows.select("symbol", ts.alias("ts"), *[f"_f.{c}" for c in (*PRICES, "volume")]).filter("ts is not null")


def _without_rows(spark: SparkSession, files: DataFrame, found: DataFrame) -> DataFrame:
    """path of the files that a reader lists but gives no row of (found: path, not escaped): the empty ones."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  local paths are written in two ways
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(plain(digests.decoded(F.col("path"))).alias("path"))
    return listed.join(found.select(plain("path").alias("path")), "path", "left_anti")


def load_errors(spark: SparkSession, path: str, symbol: Column | None = None) -> DataFrame:
    """path, symbol and issue of the vendor files that give no bars: those without a column they need, and empty ones."""
    heads = _vendor_lines(spark, path, symbol)[1].withColumn("path", digests.decoded(F.col("path")))
    name = symbol_of_file(F.element_at(F.split("path", "/"), -1)) if symbol is None else F.lit(None).cast("string")
    empty = _without_rows(spark, spark.read.text(path), heads).select("path", name.alias("symbol"), F.lit("empty file").alias("issue"))
    return heads.filter("issue is not null").select("path", "symbol", "issue").unionByName(empty)


def trade_date(text: Column) -> Column:
    """An ISO date, or one like 19-DEC-2019."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.initcap(text), F.lit("dd-MMM-yyyy"))).cast("date")


def one_dialect(df: DataFrame) -> DataFrame:
    """Daily rows of either header dialect under our names; fails on an unknown or incomplete header."""
    have = {c.strip(): c for c in df.columns}
    for dialect in (MODERN, LEGACY):
        if dialect["date"] in have and dialect["symbol"] in have:
            if missing := [v for v in dialect.values() if v not in have]:
                raise ValueError(f"columns missing: {missing}")
            got = {k: F.col(f"`{have[v]}`") for k, v in dialect.items()}
            return df.select(trade_date(F.trim(got["date"])).alias("date"), F.trim(got["symbol"]).alias("symbol"), F.trim(got["series"]).alias("series"), *[got[c].cast("double").alias(c) for c in (*PRICES, "volume")])
    raise ValueError(f"unknown header {df.columns}")


def _members(batches):
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            data = bytes(content)
            if path.lower().endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".csv")]
                    if len(names) != 1:
                        raise ValueError(f"{path} has {len(names)} CSV members")
                    data = z.read(names[0])
            rows = pd.read_csv(io.BytesIO(data), dtype=str)
            rows.columns = [c.strip() for c in rows.columns]
            dialect = next((d for d in (MODERN, LEGACY) if set(d.values()) <= set(rows.columns)), None)
            if dialect is None:
                raise ValueError(f"unknown or incomplete header in {path}")
            out = pd.DataFrame({k: rows[v].str.strip() for k, v in dialect.items()})
            for c in (*PRICES, "volume"):
                out[c] = pd.to_numeric(out[c])
            yield out


def read_daily_files(spark: SparkSession, path: str) -> DataFrame:
    """Exchange daily files, zipped (one CSV each) or not, of either dialect: date, symbol, series, prices, volume."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_members, DAILY).withColumn("date", trade_date(F.col("date")))


def one_series(daily: DataFrame, symbol: str, series: str = "EQ") -> DataFrame:
    """One instrument's rows; a date with more than one is an error."""
    rows = daily.filter((F.trim("symbol") == symbol) & (F.trim("series") == series))
    n = F.count("*").over(Window.partitionBy("date"))
    return rows.withColumn("n", F.when(n > 1, F.raise_error(F.concat(F.lit("more than one row on "), F.col("date").cast("string")))).otherwise(n)).drop("n")


def write_bar_files(bars: DataFrame, path: str) -> None:
    """Canonical bar files: tab-separated, bracketed headers, integer volume, zero spread; one folder a symbol."""
    whole = F.coalesce(F.col("volume"), F.lit(0)).cast("long")
    out = bars.select(
        "symbol", F.date_format("ts", "yyyy.MM.dd").alias("<DATE>"), F.date_format("ts", "HH:mm:ss").alias("<TIME>"),
        *[F.col(c).alias(f"<{c.upper()}>") for c in PRICES], whole.alias("<TICKVOL>"), F.lit(0).cast("long").alias("<VOL>"), F.lit(0).alias("<SPREAD>"),
    )
    out.repartition("symbol").sortWithinPartitions("symbol", "<DATE>", "<TIME>").write.option("sep", "\t").option("header", True).partitionBy("symbol").csv(path)


def write_panel(panel: DataFrame, path: str, wide: list[str] | None = None) -> None:
    """A long panel as Parquet by symbol, with its fingerprint beside it; with the symbols given, also close and return as
    wide CSV under wide/."""
    from panelspark.operators.ledger import fingerprint

    panel.repartition("symbol").sortWithinPartitions("symbol", "date").write.partitionBy("symbol").parquet(f"{path}/long")
    fingerprint(panel.sparkSession.read.parquet(f"{path}/long").select("symbol", "date", "close")).write.parquet(f"{path}/hash")
    if wide:
        for c in ("close", "ret"):
            panel.groupBy("date").pivot("symbol", wide).agg(F.first(c)).orderBy("date").write.option("header", True).csv(f"{path}/wide/{c}")


def read_panel(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """A stored panel without some symbols, on the dates where all others are present, with fresh returns."""
    from panelspark.operators.panel import common_history, with_returns

    kept = spark.read.parquet(f"{path}/long").select("symbol", "date", "close")
    return with_returns(common_history(kept.filter(~F.col("symbol").isin(*drop)) if drop else kept))


def stored_hash(spark: SparkSession, path: str) -> DataFrame:
    """dataset_hash of a stored panel as it was written, before any symbol is dropped."""
    return spark.read.parquet(f"{path}/hash")


def read_wide(spark: SparkSession, path: str, column: str = "close") -> DataFrame:
    """A wide CSV of write_panel in long form: symbol, date and the column."""
    wide = spark.read.option("header", True).csv(f"{path}/wide/{column}")
    long = wide.unpivot("date", [c for c in wide.columns if c != "date"], "symbol", column)
    return long.select("symbol", F.to_date("date").alias("date"), F.col(column).cast("double").alias(column))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each raw file of any size, empty ones included."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    empty = _without_rows(spark, listed, listed.filter("length > 0"))
    return digests.file_digests(spark, path).unionByName(empty.select("path", F.sha2(F.lit("").cast("binary"), 256).alias("sha256")))


def write_ranked(result: DataFrame, path: str) -> None:
    """A screen's result (a row a pair), best net first, as one CSV file."""
    result.orderBy(F.desc("net_pt")).coalesce(1).write.option("header", True).csv(path)
