"""Token ids in length-delimited binary files, each with an index of offsets for shuffled reads.

A record is: length of the payload (8 bytes), masked checksum of those 8 bytes (4), payload, masked checksum of the
payload (4); all little-endian. A payload is the doc_id (8 bytes signed, with a presence byte before it), the bytes
an id takes (1: 2 or 4) and the ids. The index holds the offset of each record (8 bytes each), in file order.

A folder holds shards, a range of the order each, their indexes, and a table of the shards (``manifest``) with what each
holds. Records are read through the index.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.bpe import SPACES, MergeList, encoder
from sparrowgrid.llm.common import arrow_map, fresh_path, remove_at_exit

MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<BqB")
TAIL = struct.Struct("<I")
#: Bytes of text of a range of the order; bytes of a file, but for its last record; bytes read at once.
RANGE, FILE, CHUNK = 8 << 20, 256 << 20, 8 << 20
#: Characters of a text that are compared to cut the order among rows of one doc_id.
PREFIX = 32
#: Shards that are summed in one task.
SUMMED = 1024


class CorruptRecord(ValueError):
    """A checksum or a length that doesn't fit."""


def masked(data: bytes) -> int:
    """CRC-32, rotated by 15 bits and shifted by a constant, so that a checksum of data with checksums is no risk."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + TAIL.pack(masked(n)) + payload + TAIL.pack(masked(payload))


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return BODY.pack(doc_id is not None, doc_id or 0, 2 if small else 4) + ids.astype("<u2" if small else "<u4").tobytes()


def parse(data: bytes | memoryview) -> tuple[int | None, np.ndarray]:
    present, doc_id, width = BODY.unpack_from(data)
    return doc_id if present else None, np.frombuffer(data, f"<u{width}", offset=BODY.size)


def record_at(content: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record that starts at ``at``, and where the next starts."""
    if at + HEAD.size > len(content):
        raise CorruptRecord(f"a cut header at {at}")
    n, check = HEAD.unpack_from(content, at)
    if masked(bytes(content[at : at + 8])) != check:
        raise CorruptRecord(f"a wrong length at {at}")
    start, end = at + HEAD.size, at + HEAD.size + n
    if end + TAIL.size > len(content):
        raise CorruptRecord(f"a cut record at {at}")
    body = content[start:end]
    if masked(bytes(body)) != TAIL.unpack_from(content, end)[0]:
        raise CorruptRecord(f"a wrong payload at {at}")
    return body, end + TAIL.size


def read_file(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    view, at = memoryview(content), 0
    while at < len(view):
        body, at = record_at(view, at)
        yield parse(body)


def shuffled(content: bytes, index: bytes, order: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records by number, through the index."""
    offsets = np.frombuffer(index, "<u8")
    for k in order:
        yield parse(record_at(memoryview(content), int(offsets[k]))[0])


def file_system(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def shard_name(number: int, file: int) -> str:
    return f"shard-{number:08d}-{file:04d}"


class ShardWriter:
    """One file of a shard and its index; both appear under their names only once they are whole, so a task that is run
    again, or twice at once, leaves the same files."""

    def __init__(self, folder: str, number: int, file: int = 0) -> None:
        self.fs, root = file_system(folder)
        self.number, self.file, self.tag = number, file, uuid.uuid4().hex
        self.base = os.path.join(root, shard_name(number, file))
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.base}.{self.tag}.rec_tmp")
        self.offsets: list[int] = []
        self.at = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = frame(payload(doc_id, ids))
        self.out.write(data)
        self.offsets.append(self.at)
        self.at += len(data)
        self.ids += len(ids)

    def close(self) -> tuple[int, int, int, int, int]:
        self.out.close()
        with self.fs.open_output_stream(f"{self.base}.{self.tag}.idx_tmp") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())
        self.fs.move(f"{self.base}.{self.tag}.idx_tmp", f"{self.base}.idx")
        self.fs.move(f"{self.base}.{self.tag}.rec_tmp", f"{self.base}.rec")
        return self.number, self.file, len(self.offsets), self.ids, self.at


def indexed_records(folder: str, number: int, file: int, docs: int, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a file at the offsets of its index, CHUNK bytes at a time. Damage and cuts raise."""
    system, root = file_system(folder)
    base = os.path.join(root, shard_name(number, file))
    with system.open_input_stream(f"{base}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    if len(offsets) != docs:
        raise CorruptRecord(f"{base}.idx has {len(offsets)} offsets of {docs}")
    ends = np.append(offsets[1:], size)
    with system.open_input_file(f"{base}.rec") as f:
        if f.size() != size:
            raise CorruptRecord(f"{base}.rec has {f.size()} bytes of {size}")
        k = 0
        while k < docs:
            to = max(k + 1, int(np.searchsorted(ends, offsets[k] + CHUNK, "right")))
            data = memoryview(f.read_at(int(ends[to - 1] - offsets[k]), int(offsets[k])))
            for r in range(k, to):
                body, end = record_at(data, int(offsets[r] - offsets[k]))
                if end != ends[r] - offsets[k]:
                    raise CorruptRecord(f"record {r} of {base} ends beside its index")
                yield parse(body)
            k = to


class FastEncoder:
    """Texts to ids with the merge list of a tokenizers file in tiktoken's core: the same ids, at three times the
    speed. A token's rank is its id there, which needs ids in merge order; a file without it is refused."""

    #: The split of byte-level tokenizers (fixed value).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        m = MergeList(vocabulary)
        special = set(m.special.values())
        ranks = {b: i for i, b in m.token_bytes.items() if i not in special}
        made = [x & 0xFFFFF for x in m.pairs.values()]
        if made != sorted(made) or len(ranks) + len(special) != len(m.token_bytes):
            raise ValueError(f"{vocabulary} doesn't number its tokens in merge order")
        self.core = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=m.special)

        self.vocabulary = vocabulary

    #: White space runs that the core's pattern must not be given: it keeps a place for each of their characters, and
    #: gives up at about a million. Shorter texts can't have one.
    LONG, SPACE = 100_000, re.compile(rf"[{SPACES}]{{100000}}")

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= self.LONG and self.SPACE.search(text):
            return np.array(encoder(self.vocabulary).encode(text), np.uint32)
        return self.core.encode_to_numpy(text, allowed_special="all")


_ENCODERS: dict[str, FastEncoder] = {}


MANIFEST = "shard long, file long, docs long, ids long, bytes long"


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 2, size: int = RANGE, file: int = FILE) -> None:
    """Encodes each text (null: empty), appends ``end_id``, and writes shards in ascending doc_id order.

    Null doc_ids come first, rows of one doc_id in an order of their texts' first characters and hashes, so that none is
    bound to one task. A shard has about ``size`` bytes of texts, and a file for each ``file`` bytes of it.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, PREFIX).asc(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(max(1, -(-total // size)), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = FastEncoder(vocabulary)
        e, number = _ENCODERS[vocabulary], TaskContext.get().partitionId()
        open_, done = None, []
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if open_ is None or open_.at >= file:
                    if open_ is not None:
                        done.append(open_.close())
                    open_ = ShardWriter(folder, number, len(done))
                open_.add(doc_id, np.concatenate([e.encode(text), end]))
        if open_ is not None:
            done.append(open_.close())
        cols = list(zip(*done, strict=True)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in MANIFEST.split(", ")])

    arrow_map(dealt, run, MANIFEST).write.parquet(f"{folder}/manifest")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's table of files, with ``start``: the ids of all files before each."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("part", F.floor(F.col("shard") / SUMMED))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select("part", before("n", Window.orderBy("part")).alias("ahead"))
    inside = before("ids", Window.partitionBy("part").orderBy("shard", "file"))
    return files.withColumn("inside", inside).join(parts, "part").withColumn("start", F.col("ahead") + F.col("inside")).drop("part", "inside", "ahead")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record of a folder's shards, read through their indexes.

    A file that is cut or changed raises. An empty folder gives no rows.
    """
    files = shards(spark, folder)
    n = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                at, out = f["start"], []
                for doc_id, ids in indexed_records(folder, f["shard"], f["file"], f["docs"], f["bytes"]):
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                if at != f["start"] + f["ids"]:
                    raise CorruptRecord(f"{shard_name(f['shard'], f['file'])} has {at - f['start']} ids of {f['ids']}")
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(files.repartition(max(1, n)), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` and reads the files back. Without a ``folder``, they go when the application ends.

    Null texts are empty and have the end id alone; repeated rows stay; an empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    spark, own = docs.sparkSession, folder is None
    folder = folder or fresh_path(spark, "records")
    write(docs, vocabulary, folder)
    if own:
        remove_at_exit(spark, folder)
    return read(spark, folder)
