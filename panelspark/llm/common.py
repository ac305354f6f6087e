"""Shared pieces: the folder for written tables, Arrow helpers and sorted-run processing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words everywhere in this subpackage, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in slices of about so many characters, which bounds a Python worker's memory.
SLICE_CHARS = 2_000_000
#: Rows that hold whole texts travel between Spark and Python in batches of about so many bytes (Spark's own limit is
#: 64 MB, of which several copies would be held on either side).
BATCH_BYTES = 4 << 20
BATCH_KEY, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


_own: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if driver and executors
    are one process (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="panelspark-")
        _own[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete written tables through Hadoop's file systems, whatever store they are in."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        tables = _tables.get(spark.sparkContext.applicationId, [])
        if path in tables:
            tables.remove(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this subpackage has written in this application and not deleted yet: to be called when
    the results have been stored elsewhere, as lazy results read these tables."""
    delete(spark, *kept_tables(spark))


def kept_tables(spark: SparkSession) -> list[str]:
    """Paths of the tables written in this application and not deleted yet."""
    return list(_tables.get(spark.sparkContext.applicationId, []))


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), and the table's path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    return written_at(df, name)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n: the fold of a labelled row."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `chars` bytes of the text column (one longer text stays whole)."""
    i = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    start = 0
    while start < len(total):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + chars, side="right")))
        yield batch.slice(start, end - start)
        start = end


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text", chars: int = SLICE_CHARS, finish: Callable[[], None] | None = None) -> DataFrame:
    """Apply function to slices of df, cut by the bytes of a column; it returns the output columns as a dict. finish is
    called at the end of a task, which gives unused memory back to the system."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    out = to_arrow_schema(spark_schema)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, column, chars):
                got = function(piece)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
        if finish is not None:
            finish()
        pa.default_memory_pool().release_unused()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int | None = None) -> Iterator[tuple[dict, bool]]:
    """From batches sorted by integer keys, (block of numpy columns, True) of whole runs: a run never spans two blocks.

    A run longer than `limit` rows comes in several blocks of its own, with False; so memory is bounded by a batch and
    the limit.
    """
    held: dict | None = None
    long: tuple | None = None

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if long is not None:
            same = np.logical_and.reduce([cols[k] == v for k, v in zip(keys, long, strict=True)])
            first = len(same) if same.all() else int(np.argmin(same))
            if first:
                yield {k: v[:first] for k, v in cols.items()}, False
            if first == len(same):
                continue
            long = None
            cols = {k: v[first:] for k, v in cols.items()}
        block = cols if held is None else {k: np.concatenate([held[k], cols[k]]) for k in cols}
        cut = int(run_bounds(block, keys)[0][-1])
        if cut:
            yield {k: v[:cut] for k, v in block.items()}, True
        held = {k: v[cut:] for k, v in block.items()}
        if limit is not None and len(held[keys[0]]) > limit:
            long = tuple(held[k][-1] for k in keys)
            yield held, False
            held = None
    if held is not None:
        yield held, True


def run_bounds(block: dict, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal keys in a block."""
    n = len(block[keys[0]])
    change = np.ones(n, bool)
    change[1:] = False
    for k in keys:
        change[1:] |= block[k][1:] != block[k][:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], n)
