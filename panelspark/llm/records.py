"""Token ids as length-delimited binary records with a separate offset index.

Documents are dealt by ranges of doc_id and sorted, so that part after part holds them in ascending order. A part is
one file of frames: the payload's length (uint64), the masked CRC-32 of those 8 bytes, the payload, the masked CRC-32
of the payload; all little-endian. A payload is doc_id (int64), the ids' width in bytes (uint8) and the ids. The index
file of a part has one entry a record: doc_id, offset of its frame, number of ids (three int64), so that a reader can
take records in any order without scanning: read() deals stretches of the index out in a shuffled order and seeks to
each. The smallest int64 stands for a missing doc_id, which comes first. Files are written under a name of the attempt and then renamed, and a
rerun task replaces its file as a whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.bpe import default_path, encoder
from panelspark.llm.common import bounded_batches, fresh_path, slices, written

END_ID = 1
#: Added to a rotated checksum, so that a checksum of data that holds checksums is sound (fixed value of the format).
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<Q")
SUM = struct.Struct("<I")
PREFIX = struct.Struct("<qB")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_ids", "<i8")])
NO_ID = -(1 << 63)
#: Records, and bytes, of a stretch that is read at once.
STRETCH, STRETCH_BYTES = 2_000, 8 << 20


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = PREFIX.pack(doc_id, width) + ids.astype(f"<u{width}").tobytes()
    head = HEAD.pack(len(payload))
    return b"".join((head, SUM.pack(masked(zlib.crc32(head))), payload, SUM.pack(masked(zlib.crc32(payload)))))


def unframe(data, at: int) -> tuple[int, np.ndarray, int]:
    """doc_id and ids of the frame at an offset, and the next offset; raises ValueError where a checksum fails."""
    head = data[at : at + 8]
    if len(head) < 8 or SUM.unpack_from(data, at + 8)[0] != masked(zlib.crc32(head)):
        raise ValueError(f"damaged length at {at}")
    end = at + 12 + HEAD.unpack(head)[0]
    payload = data[at + 12 : end]
    if end + 4 > len(data) or SUM.unpack_from(data, end)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"damaged record at {at}")
    doc_id, width = PREFIX.unpack_from(payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=PREFIX.size), end + 4


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write every row's whole text (null: empty) as a record of its ids and end_id, in ascending doc_id order.

    Returns the manifest, one row a part: part (ascending with doc_id), path, index_path, n_docs, n_ids. Rows that
    repeat a doc_id become records side by side, rows without one come first. An empty table gives no part. folder is one
    that all executors share, in a store that pyarrow opens (local, HDFS, S3, GCS).
    """
    path, folder = tokenizer_path or default_path(), folder or fresh_path(docs.sparkSession, "records")
    tail = np.array([end_id], "<u4").tobytes()

    def save(batches):
        from pyspark import TaskContext

        fs, root = _filesystem(folder)
        part = TaskContext.get().partitionId()
        name, mine = f"{root}/part-{part:07d}", uuid.uuid4().hex
        out, index, at, n_ids = None, [], 0, 0
        for batch in batches:
            for piece in slices(batch):
                if out is None:
                    fs.create_dir(root)
                    out = fs.open_output_stream(f"{name}.{mine}")
                texts = [(t or "").encode("utf-8", "replace") for t in piece.column("text").to_pylist()]
                encoder(path).turn()
                for doc_id, ids in zip(piece.column("doc_id").fill_null(NO_ID).to_pylist(), encoder(path).by_words(texts), strict=True):
                    ids = np.frombuffer(ids + tail, "<u4")
                    record = frame(doc_id, ids)
                    out.write(record)
                    index.append((doc_id, at, len(ids)))
                    at, n_ids = at + len(record), n_ids + len(ids)
        encoder(path).forget()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{name}.index.{mine}") as f:
                f.write(np.array(index, INDEX).tobytes())
            fs.move(f"{name}.{mine}", f"{name}.records")
            fs.move(f"{name}.index.{mine}", f"{name}.index")
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{name}.records"], "index_path": [f"{name}.index"], "n_docs": [len(index)], "n_ids": [n_ids]})

    bounded_batches(docs.sparkSession)
    # rows of one doc_id, or of none, are ranged by how their text begins as well, so that they may fill several parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_begins", F.substring("text", 1, 16))
    ordered = rows.repartitionByRange("doc_id", "_begins").sortWithinPartitions("doc_id", "text").drop("_begins")
    manifest = ordered.mapInArrow(save, "part long, path string, index_path string, n_docs long, n_ids long")
    return written(manifest.withColumn("folder", F.lit(folder)), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens and ids_crc32 of every record, all checksums checked. Stretches of
    the index, not files, are dealt out, in the order of a hash: no task holds a file."""
    start = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def listed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = _filesystem(row["folder"])
                with fs.open_input_file(row["index_path"]) as f:
                    index = np.frombuffer(f.read(), INDEX)
                ends = np.append(index["offset"][1:], fs.get_file_info(row["path"]).size)
                before = row["start"] + np.cumsum(index["n_ids"]) - index["n_ids"]
                at, out = 0, []
                while at < len(index):
                    to = min(at + STRETCH, max(at + 1, int(np.searchsorted(ends, index["offset"][at] + STRETCH_BYTES, side="right"))))
                    out.append((row["folder"], row["path"], int(ends[to - 1]), int(before[at]), index[at:to].tobytes()))
                    at = to
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["folder", "path", "stop", "start", "entries"])

    def load(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = _filesystem(row["folder"])
                index = np.frombuffer(row["entries"], INDEX)
                first = int(index["offset"][0])
                with fs.open_input_file(row["path"]) as f:
                    f.seek(first)
                    data = f.read(row["stop"] - first)
                yield _rows(data, first, index, row["start"])

    stretches = manifest.select("folder", "path", "index_path", start.alias("start")).mapInArrow(listed, "folder string, path string, stop long, start long, entries binary")
    return stretches.repartition(F.xxhash64("path", "stop")).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(data: bytes, first: int, index: np.ndarray, start: int) -> pa.RecordBatch:
    """The records of a stretch of the index; raises ValueError where a record is not what its entry says."""
    ids_of, n, crc = [], [], []
    for entry in index:
        doc_id, ids, _ = unframe(data, int(entry["offset"]) - first)
        if doc_id != entry["doc_id"] or len(ids) != entry["n_ids"]:
            raise ValueError(f"the index does not match the record at {entry['offset']}")
        ids_of.append(None if doc_id == NO_ID else doc_id)
        n.append(len(ids))
        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
    n = np.array(n, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_one(folder: str, part: int, record: int) -> tuple[int, np.ndarray]:
    """doc_id and ids of one record, found through the index: a shuffled reader's access."""
    fs, root = _filesystem(folder)
    with fs.open_input_file(f"{root}/part-{part:07d}.index") as f:
        f.seek(record * INDEX.itemsize)
        entry = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    with fs.open_input_file(f"{root}/part-{part:07d}.records") as f:
        f.seek(int(entry["offset"]))
        head = f.read(12)
        data = head + f.read(HEAD.unpack_from(head)[0] + 4)
    return unframe(data, 0)[:2]
