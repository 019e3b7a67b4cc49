"""Token ids as length-delimited binary records with a separate offset index.

A record is: payload length (u64), masked checksum of these 8 bytes (u32), payload, masked checksum of
the payload (u32), all little-endian. The checksum is CRC-32, rotated by 15 bits and offset, so that a
checksum stored inside data does not check itself. The payload is one serialized sequence: a flag byte
(bit 0: the document has an id; bit 1: wide ids), doc_id (i64), the number of ids (u32), the ids (u16
each where all are below 65,536, else wide: u32). Beside every
`.rec` file lies an `.idx` file of (byte offset u64, payload length u32) per record: a reader can open
records in any order.

Files hold documents in ascending doc_id order, and so do the files among themselves (column `part`,
then `file_no`). Tasks write under unique names and only the manifest, which Spark commits, tells which
files count: a lost executor's half-written or repeated files are never read.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; rows with equal
doc_id follow each other by text; an empty table gives an empty manifest; other columns are not read.
The folder must be a URI that pyarrow.fs opens (file, hdfs, s3, gs), reachable from all executors.
"""

from __future__ import annotations

import posixpath
import random
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelgauge.llm.common import chunks, ship
from duelgauge.llm.tokens import BLOCK_BYTES, PieceEncoder
from duelgauge.runtime import cut_lineage, scratch_path, shuffle_width

HEAD, TAIL, SEQUENCE, ENTRY = "<QI", "<I", "<BqI", "<QI"
AROUND = struct.calcsize(HEAD) + struct.calcsize(TAIL)
MASK = 0xA282EAD8
FILE_BYTES = 64 << 20
MANIFEST = "part int, file_no int, file string, records long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return struct.pack(HEAD, len(payload), masked(length)) + payload + struct.pack(TAIL, masked(payload))


def unframe(data: bytes, at: int) -> bytes:
    """Payload of the record at a byte offset, with both checksums verified."""
    length, check = struct.unpack_from(HEAD, data, at)
    if check != masked(data[at : at + 8]):
        raise ValueError(f"length of the record at byte {at} is damaged")
    start = at + struct.calcsize(HEAD)
    payload = data[start : start + length]
    if len(payload) != length or struct.unpack_from(TAIL, data, start + length)[0] != masked(payload):
        raise ValueError(f"payload of the record at byte {at} is damaged")
    return payload


def pack(doc_id: int | None, ids: bytes) -> bytes:
    numbers = np.frombuffer(ids, "<u4")
    wide = bool(len(numbers)) and int(numbers.max()) > 0xFFFF
    body = ids if wide else numbers.astype("<u2").tobytes()
    return struct.pack(SEQUENCE, (doc_id is not None) + 2 * wide, doc_id or 0, len(numbers)) + body


def unpack(payload: bytes) -> tuple[int | None, bytes]:
    """doc_id and ids (little-endian unsigned 32-bit) of a payload."""
    flags, doc_id, count = struct.unpack_from(SEQUENCE, payload)
    numbers = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=struct.calcsize(SEQUENCE))
    if len(numbers) != count:
        raise ValueError("a sequence has another length than it states")
    return (doc_id if flags & 1 else None), numbers.astype("<u4").tobytes()


class RecordFile:
    """One data file and its index, written together."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, base = fs.FileSystem.from_uri(folder)
        self.name = uuid.uuid4().hex
        self.data = self.system.open_output_stream(posixpath.join(base, self.name + ".rec"), buffer_size=1 << 20)
        self.index = self.system.open_output_stream(posixpath.join(base, self.name + ".idx"), buffer_size=1 << 16)
        self.offset = self.records = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        record = frame(pack(doc_id, ids))
        self.data.write(record)
        self.index.write(struct.pack(ENTRY, self.offset, len(record) - AROUND))
        self.offset += len(record)
        self.records += 1
        self.ids += len(ids) // 4

    def close(self) -> None:
        self.data.close()
        self.index.close()


def read_file(folder: str, name: str, order: random.Random | None = None) -> Iterator[tuple[int | None, bytes]]:
    """Sequences of one file in file order, or in random order by its index. Every checksum is verified."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(posixpath.join(base, name + ".idx")) as stream:
        entries = list(struct.iter_unpack(ENTRY, stream.read()))
    if order:
        order.shuffle(entries)
    with system.open_input_file(posixpath.join(base, name + ".rec")) as source:
        for offset, length in entries:
            yield unpack(unframe(source.read_at(length + AROUND, offset), 0))


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, spaces: bool = False) -> DataFrame:
    """Encode all documents and write them; returns the manifest, one row per file, stored as a table."""
    ship(__name__)
    ship("duelgauge.llm.tokens")
    width = shuffle_width(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = PieceEncoder(vocabulary, spaces)
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        part, number, out = TaskContext.get().partitionId(), 0, None
        schema = pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64())])

        def closed() -> pa.RecordBatch:
            out.close()
            row = [[part], [number], [out.name], [out.records], [out.ids]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for piece in chunks(batches, "text", BLOCK_BYTES):
            raw = encoder.encode(piece.column("text"))
            for doc_id, ids in zip(piece.column("doc_id").to_pylist(), raw):
                out = out or RecordFile(folder)
                out.add(doc_id, ids + end)
                if out.offset >= FILE_BYTES:
                    yield closed()
                    out, number = None, number + 1
        if out:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(width, F.asc_nulls_first("doc_id"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return cut_lineage(ordered.mapInArrow(write, MANIFEST))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: ids of all documents before it, number of ids, checksum of the ids."""
    ship(__name__)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                docs, counts, sums = [], [], []
                for doc_id, ids in read_file(folder, row["file"]):
                    docs.append(doc_id)
                    counts.append(len(ids) // 4)
                    sums.append(zlib.crc32(ids))
                n = np.array(counts, np.int64)
                columns = [docs, row["file_start"] + np.cumsum(n) - n, n, np.array(sums, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    # One row per file of 64 MB: the only window that is not cut by a key.
    order = Window.partitionBy(F.lit(1)).orderBy("part", "file_no")
    starts = manifest.select("file", (F.sum("ids").over(order) - F.col("ids")).alias("file_start"))
    return starts.repartition(shuffle_width(manifest.sparkSession), "file").mapInArrow(read, READ)


def written_and_read(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> DataFrame:
    """The whole way: encode, write, read back."""
    folder = folder or scratch_path(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, vocabulary, end_id), folder)
