"""Token ids as files of byte or bit planes.

A file holds blocks of a fixed number of ids. The ids of a block are turned
into planes (all lowest bytes, all second bytes, ..; or bit by bit), each plane
is compressed with zstandard on its own and an all-zero plane takes no bytes.
Behind the blocks stand the chunk index (place, number of ids and plane sizes
of each block) and the documents' ids and lengths; the trailer says where they
begin. Any block can be read alone.

Files lie in the shared folder, one for each range of document ids, so that
file order and order within files are ascending document id. A task writes
under a name of its own attempt and renames, so a repeated task leaves the same
file. Paths go through pyarrow's file systems (``file``, ``hdfs``, ``s3``, ..).

The number of files follows the bytes of the texts, so no file and no task
grows with the corpus; a reader holds one block and the document table of its
file, and hands out rows in batches.

Nulls and odd rows: a null text is empty and has only the end id; null document
ids come first; rows that share a document id are ordered by a hash of the
text, and rows repeated in full stand side by side; a very long text runs over
as many blocks as it needs; extra columns are ignored; an empty table gives no
documents. The table is read twice, so it must come from files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written
from .tokens import encoder

MAGIC = b"TWPLANE1"
#: Ids in a block.
BLOCK_IDS = 1 << 16
#: Bytes of text in a file, in the mean, where the corpus is large.
FILE_BYTES = 512 << 20
#: Documents of a batch that a reader hands out.
READ_ROWS = 8192
_TRAILER = struct.Struct("<QQ8s")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of some 32-bit ids, lowest first."""
    if bits:
        cells = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return [np.packbits(cells[:, k], bitorder="little").tobytes() for k in range(32)]
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [cells[:, k].tobytes() for k in range(4)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        cells = np.zeros((n, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                cells[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        return np.packbits(cells, axis=1, bitorder="little").view("<u4").ravel()
    cells = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            cells[:, k] = np.frombuffer(plane, np.uint8)
    return cells.view("<u4").ravel()


class Writer:
    """Writes one file to an open binary stream; holds one block and the document table."""

    def __init__(self, stream, bits: bool = False, block: int = BLOCK_IDS, level: int = 3):
        self.stream, self.bits, self.block = stream, bits, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.have = len(MAGIC), [], 0
        self.index: list[list[int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        stream.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.have += len(ids) // 4
        if self.have >= self.block:
            data = b"".join(self.waiting)
            whole = self.have // self.block * self.block
            for k in range(0, whole, self.block):
                self._put(data[4 * k : 4 * (k + self.block)])
            self.waiting, self.have = [data[4 * whole :]], self.have - whole

    def _put(self, data: bytes) -> None:
        planes = [self.zip.compress(p) if p.strip(b"\0") else b"" for p in to_planes(np.frombuffer(data, "<u4"), self.bits)]
        for plane in planes:
            self.stream.write(plane)
        self.index.append([self.at, len(data) // 4, *map(len, planes)])
        self.at += sum(map(len, planes))

    def close(self) -> int:
        """Write the rest, the index and the trailer; returns the number of ids."""
        if self.have:
            self._put(b"".join(self.waiting))
        head = json.dumps({"bits": self.bits, "block": self.block, "chunks": self.index}).encode()
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.docs], dtype="<i8")
        table = known.tobytes() + ids.tobytes() + np.array(self.lengths, dtype="<u8").tobytes()
        head, table = self.zip.compress(head), self.zip.compress(table)
        self.stream.write(head + table + _TRAILER.pack(len(head), len(table), MAGIC))
        return sum(self.lengths)


class Reader:
    """Reads a file of :class:`Writer` from an open seekable stream of a known size."""

    def __init__(self, stream, size: int):
        self.stream, self.zip = stream, zstandard.ZstdDecompressor()
        stream.seek(size - _TRAILER.size)
        head, table, magic = _TRAILER.unpack(stream.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        stream.seek(size - _TRAILER.size - head - table)
        spec = json.loads(self.zip.decompress(stream.read(head)))
        raw = self.zip.decompress(stream.read(table))
        n = len(raw) // 17
        self.bits, self.chunks = spec["bits"], spec["chunks"]
        self.known = np.frombuffer(raw, np.uint8, n).astype(bool)
        self.docs, self.lengths = np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        """The ids of one block."""
        place, n, *sizes = self.chunks[k]
        self.stream.seek(place)
        planes = [self.zip.decompress(self.stream.read(s)) if s else b"" for s in sizes]
        return from_planes(planes, n, self.bits)

    def documents(self):
        """``(doc_id, start in the file, ids, crc32)`` of each document, block by block."""
        start, k, ids, at = 0, 0, np.empty(0, "<u4"), 0
        for doc, known, length in zip(self.docs.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            left, crc = length, 0
            while left:
                if at == len(ids):
                    ids, at, k = self.chunk(k), 0, k + 1
                n = min(left, len(ids) - at)
                crc = zlib.crc32(ids[at : at + n].tobytes(), crc)
                at, left = at + n, left - n
            yield doc if known else None, start, length, crc
            start += length


def file_system(path: str):
    """The pyarrow file system of a path, and the path on it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 2, bits: bool = False, files: int | None = None, path: str | None = None) -> tuple[str, list[dict]]:
    """Encode all texts into files under ``path`` in ascending ``doc_id`` order.

    Returns the path and, for each file in order, its name, number of documents
    and ids, and the ids in all files before it (the manifest, also stored).
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "planes")
    if files is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def write(batches):
        part = TaskContext.get().partitionId()
        system, base = file_system(path)
        system.create_dir(base, recursive=True)
        name = f"part-{part:06d}.planes"
        own = f"{base}/.{name}.{uuid.uuid4().hex}"
        enc, end, docs_n = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), 0
        with system.open_output_stream(own) as stream:
            out = Writer(stream, bits)
            for batch in batches:
                docs_n += batch.num_rows
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out.add(doc, enc.encode(text or "") + end)
            n = out.close()
        system.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs_n]), pa.array([n], pa.int64())], names=["part", "name", "docs", "ids"])

    # the third key lets rows repeated in full be dealt over several files
    some = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    ordered = some.repartitionByRange(files, "doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "nth").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, "part int, name string, docs long, ids long"), "manifest", texts=True)
    found, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):  # one row per file
        found.append({"name": row["name"], "docs": row["docs"], "ids": row["ids"], "start": start})
        start += row["ids"]
    return path, found


def read_ids(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone; one task per file."""

    def read(batches):
        system, base = file_system(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file = f"{base}/{manifest[k]['name']}"
                with system.open_input_file(file) as stream:
                    found = ((d, manifest[k]["start"] + s, n, c) for d, s, n, c in Reader(stream, stream.size()).documents())
                    while rows := list(islice(found, READ_ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.range(0, len(manifest), 1, max(1, len(manifest)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
