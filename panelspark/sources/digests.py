"""SHA-256 of raw files of any size, read through the file systems that Spark reads.

SHA-256 takes a file's bytes in order, but not in one task: a large file is hashed in stretches, one after the other, and
the hash's state goes from the task of a stretch to that of the next.
"""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.lineage import delete, scratch, settled
from panelspark.functions.positions import numbered

#: Files up to this many bytes are read whole by Spark's binaryFile; larger ones are streamed.
WHOLE = 64 << 20
#: Bytes of a block that travels to the task which hashes its file.
BLOCK = 1 << 16
#: A task hashes the splits of a file that start within so many bytes.
STRETCH = 256 << 20
#: Bytes of a row group of written blocks, which a task holds as a whole.
GROUP = 16 << 20
#: Spark unpacks text files with these endings, so their raw bytes come from binaryFile at any size (2 GB at most).
PACKED = ("gz", "bz2", "deflate", "snappy", "lz4", "zst", "zstd")

_MARK = b"\xef\xbb\xbf"
_BLOCKS = "path string, size long, start long, seq long, bytes binary"


def decoded(uri: Column) -> Column:
    """A file's path from the escaped form in which _metadata and inputFiles() give it."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _runs(table: pa.RecordBatch) -> list[tuple[int, int]]:
    """The stretches of rows that stem from one split of one file."""
    if not table.num_rows:
        return []
    path, start = table.column("path"), table.column("start")
    new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])) if table.num_rows > 1 else []
    cuts = [0, *(np.flatnonzero(np.asarray(new, dtype=bool)) + 1).tolist(), table.num_rows]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _blocks(batches):
    """Lines of splits, in order, as blocks of their bytes; a line feed is put behind each line again."""
    seq: dict[tuple[str, int], int] = {}
    for batch in batches:
        values = batch.column("value").cast(pa.large_binary())
        for a, b in _runs(batch):
            path, size, start = (batch.column(c)[a].as_py() for c in ("path", "size", "start"))
            lines = pa.LargeListArray.from_arrays(pa.array([0, b - a], pa.int64()), values[a:b])
            data = memoryview(pc.binary_join(lines, pa.scalar(b"\n", pa.large_binary()))[0].as_buffer())
            parts = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] + [b"\n"]
            n = seq.get((path, start), 0)
            seq[path, start] = n + len(parts)
            for k in range(0, len(parts), 256):
                some = [bytes(p) for p in parts[k : k + 256]]
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * m), pa.array([size] * m, pa.int64()), pa.array([start] * m, pa.int64()), pa.array(range(n + k, n + k + m), pa.int64()), pa.array(some, pa.binary())],
                    names=["path", "size", "start", "seq", "bytes"],
                )


class _Sha256:
    """OpenSSL's SHA-256, which is hashlib's. hashlib does not give out its state, a plain structure of 112 bytes."""

    STATE = 112

    def __init__(self, data: bytes = b"", state: bytes = b""):
        import _hashlib

        self._lib = ctypes.CDLL(_hashlib.__file__)  # finds the library that hashlib is linked to
        for f, kinds in ((self._lib.SHA256_Init, [ctypes.c_void_p]), (self._lib.SHA256_Update, [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]), (self._lib.SHA256_Final, [ctypes.c_char_p, ctypes.c_void_p])):
            f.argtypes = kinds
        self._state = ctypes.create_string_buffer(state, 2 * self.STATE)
        if not state:
            self._lib.SHA256_Init(self._state)
        self.update(data)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._state, data, len(data))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, ctypes.create_string_buffer(self._state.raw, 2 * self.STATE))
        return out.raw.hex()

    def state(self) -> bytes:
        return self._state.raw[: self.STATE]


@cache
def carried() -> bool:
    """Can a hash be carried on from its state here? Not where Python has no OpenSSL, or one without these functions."""
    try:
        first = _Sha256(b"a" * 100)
        second = _Sha256(state=first.state())
    except (ImportError, OSError, AttributeError):
        return False
    second.update(b"b" * 100)
    return second.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()


class _Digest:
    """The hash of a file from its lines. The reader leaves out a byte order mark, and the line feed behind the last line may
    be one that the file does not have; the file's size tells which."""

    def __init__(self, path: str, size: int, state: bytes = b""):
        self.path, self.size, self.read, self.held = path, size, 0, b""
        new = _Sha256 if carried() else hashlib.sha256
        if state:
            at = 8 + _Sha256.STATE
            self.read, self.held = int.from_bytes(state[:8], "big"), state[at + _Sha256.STATE :]
            self.plain, self.marked = _Sha256(state=state[8:at]), _Sha256(state=state[at : at + _Sha256.STATE])
        else:
            self.plain, self.marked = new(), new(_MARK)

    def state(self) -> bytes:
        return self.read.to_bytes(8, "big") + self.plain.state() + self.marked.state() + self.held

    def add(self, data: bytes) -> None:
        for h in (self.plain, self.marked):
            h.update(self.held)
        self.read += len(self.held)
        self.held = data

    def hex(self) -> str:
        left = self.size - self.read  # of the last block, a line feed, all of it or nothing, and of a mark
        for h, mark in ((self.plain, 0), (self.marked, len(_MARK))):
            if left - mark in (0, len(self.held)):
                h.update(self.held[: left - mark])
                return h.hexdigest()
        raise ValueError(f"{self.path}: {self.size} bytes listed, {self.read + len(self.held)} read; it changed meanwhile or is packed")


def _hashed(last: bool):
    """Files' blocks in order, behind the state that the stretch before left (start -1): their digests after the last
    stretch, else their states."""

    def done(file: _Digest) -> pa.RecordBatch:
        if last:
            return pa.RecordBatch.from_pydict({"path": [file.path], "sha256": [file.hex()]})
        kinds = {"path": pa.string(), "size": pa.int64(), "start": pa.int64(), "seq": pa.int64(), "bytes": pa.binary()}
        return pa.RecordBatch.from_pydict({"path": [file.path], "size": [file.size], "start": [-1], "seq": [0], "bytes": [file.state()]}, schema=pa.schema(kinds))

    def run(batches):
        file = None
        for batch in batches:
            for path, size, start, data in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start", "bytes")), strict=True):
                if file is None or file.path != path:
                    if file is not None:
                        yield done(file)
                    file = _Digest(path, size, data if start < 0 else b"")
                    if start < 0:
                        continue
                file.add(data)
        if file is not None:
            yield done(file)

    return run


def streamed_digests(spark: SparkSession, path: str, over: int = -1) -> DataFrame:
    """path and SHA-256 of the files with more than `over` bytes; those without a line (empty, or a byte order mark alone) and
    packed ones are left out. Tasks read the splits of a file side by side as lines, whatever its bytes mean; blocks of them
    are written by stretches of the files. A job a stretch sorts its blocks, spilling to disk, and passes them through the
    hash in order, all files side by side; states go on to the next job in a table. So no task holds or reads more than
    STRETCH and a split of a file, unless hashes cannot be carried on, when a task reads a file. What must fit is a
    passage without a line feed."""
    meta = decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start")
    large = (F.col("_metadata.file_size") > over) & ~F.lower("_metadata.file_name").rlike(rf"\.({'|'.join(PACKED)})$")
    lines = spark.read.option("lineSep", "\n").text(path).filter(large).select(*meta, F.col("value").cast("binary").alias("value"))
    step = F.floor(F.col("start") / STRETCH) if carried() else F.lit(0)
    path = scratch(spark, "digest-blocks")
    lines.mapInArrow(_blocks, _BLOCKS).withColumn("step", step.cast("int")).write.option("parquet.block.size", GROUP).partitionBy("step").parquet(path)
    blocks = spark.read.schema(f"{_BLOCKS}, step int").parquet(path)
    files = settled(blocks.groupBy("path").agg(F.max("step").alias("steps")), "digest-files")
    n, steps = files.agg(F.count("*"), F.max("steps")).first()
    out, states = spark.createDataFrame([], "path string, sha256 string"), None
    if n:
        files = settled(numbered(files, "path", "file").select("path", F.col("file").cast("int").alias("file")), "digest-numbers")
    for k in range(steps + 1 if n else 0):
        rows = blocks.filter(F.col("step") == k).drop("step")
        rows = (rows if states is None else rows.unionByName(states)).join(F.broadcast(files), "path")
        dealt = rows.repartitionById(n, "file").sortWithinPartitions("path", "start", "seq")
        if k < steps:
            states = settled(dealt.mapInArrow(_hashed(False), _BLOCKS), "digest-states")
        else:
            out = settled(dealt.mapInArrow(_hashed(True), "path string, sha256 string"), "digests")
    delete(spark, path)
    return out


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """path and SHA-256 of each file with any byte: small and packed ones read whole, the others streamed."""
    whole = max(whole, len(_MARK))
    names = ",".join("".join(f"[{c}{c.upper()}]" for c in ending) for ending in PACKED)
    # filters on length alone reach the reader, which refuses a file of over 2 GB before any other filter sees it
    small = spark.read.format("binaryFile").load(path).filter((F.col("length") > 0) & (F.col("length") <= whole))
    packed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{names}}}").load(path).filter(F.col("length") > whole)
    files = small.select("path", "content").unionByName(packed.select("path", "content"))
    return files.select("path", F.sha2("content", 256).alias("sha256")).unionByName(streamed_digests(spark, path, whole))
