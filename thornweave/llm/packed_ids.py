"""Token ids in binary files of fixed-width fields.

A document table is sorted by doc_id and cut into ranges; each task writes the ids of its range as one shard. Every id
takes the fewest bits that hold the vocabulary's largest id, in blocks of BLOCK ids whose byte offsets stand in the
shard's header, so any run of ids is found by its block and unpacked by numpy at once.

A shard, all integers little-endian:

    magic (8 bytes), bits, ids per block, number of ids, of documents, of blocks (unsigned 64-bit each)
    byte offset of each block from the start of the block area, and its end  (blocks + 1 of unsigned 64-bit)
    id offset of each document in the shard, and the end                     (documents + 1 of unsigned 64-bit)
    doc_id of each document (signed 64-bit), then one byte each: 1 where it is null
    the blocks: id k of a block lies in bits k * bits ... of it, least significant first; each ends on a whole byte

Each attempt of a task writes its shards under names of its own, and only those of the attempt that Spark takes are listed; no file is
ever renamed or written twice, which holds for any store. What a lost attempt has left in the folder is in no list.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, in_arrow, table
from .tokenizer import encoder, in_groups

MAGIC = b"TWIDS\x00\x01\x00"
BLOCK = 1 << 15
_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_SHARD = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(n_ids: int) -> int:
    """Fewest bits that hold the ids 0 ... n_ids - 1."""
    return max(1, int(n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # whole bytes: the same layout, without the way over single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype("<u8")[:, None] >> np.arange(bits, dtype="<u8")) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype("<u8") << np.arange(bits, dtype="<u8")).sum(1).astype("<u4")


class ShardWriter:
    """Collects documents and packs each block once it is full; the packed blocks of one shard are what it holds."""

    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.blocks: list[bytes] = []
        self.open: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.ends, self.doc_ids = [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._close(False)

    def _close(self, last: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        self.blocks += [pack(ids[i : i + self.block], self.bits) for i in range(0, whole, self.block)]
        self.open, self.waiting = [ids[whole:]], len(ids) - whole

    def parts(self) -> list[bytes]:
        self._close(True)
        head = np.array([self.bits, self.block, self.n_ids, len(self.doc_ids), len(self.blocks)], "<u8")
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.blocks], dtype="u8")]).astype("<u8")
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        return [MAGIC, head.tobytes(), offsets.tobytes(), np.array(self.ends, "<u8").tobytes(), ids.tobytes(), null.tobytes(), *self.blocks]


class Shard:
    """Random access to a shard: ids(a, b) reads only the blocks that hold the ids a ... b - 1."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{path} is no shard of packed ids")
        self.bits, self.block, self.n_ids, n_docs, n_blocks = (int(x) for x in np.frombuffer(self.file.read(40), "<u8"))
        self.offsets = np.frombuffer(self.file.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.ends = np.frombuffer(self.file.read(8 * (n_docs + 1)), "<u8").astype(np.int64)
        ids, null = np.frombuffer(self.file.read(8 * n_docs), "<i8"), self.file.read(n_docs)
        self.doc_ids = [None if none else int(d) for d, none in zip(ids, null, strict=True)]
        self.body = self.file.tell()

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        at, end = int(self.offsets[first]), int(self.offsets[last + 1])
        data = self.file.read_at(end - at, self.body + at)
        out = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            out.append(unpack(data[int(self.offsets[k]) - at : int(self.offsets[k + 1]) - at], self.bits, n))
        return np.concatenate(out)[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k]), int(self.ends[k + 1]))

    def spans(self, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document's number and ids in order, read in runs of about `most` ids."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            j = max(k + 1, int(np.searchsorted(self.ends, self.ends[k] + most, "right")) - 1)
            run, base = self.ids(int(self.ends[k]), int(self.ends[j])), int(self.ends[k])
            for i in range(k, j):
                yield i, run[int(self.ends[i]) - base : int(self.ends[i + 1]) - base]
            k = j

    def close(self) -> None:
        self.file.close()


def _save(shard: ShardWriter, folder: str, part: int, number: int) -> pa.RecordBatch:
    from pyarrow import fs

    path = f"{folder}/shard-{part:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0])
    with store.open_output_stream(name) as f:
        for x in shard.parts():
            f.write(x)
    return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": path, "n_docs": len(shard.doc_ids), "n_ids": shard.n_ids}], _MANIFEST)


def _write(tokenizer_path: str, end_id: int, bits: int, folder: str, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, end = encoder(tokenizer_path), ShardWriter(bits), np.array([end_id], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in in_groups(texts):
                for doc_id, ids in zip(doc_ids[a:b], own.encode(texts[a:b]), strict=True):
                    shard.add(doc_id, np.frombuffer(ids + end, "<u4"))
                if shard.n_ids >= shard_ids:
                    yield _save(shard, folder, part, number)
                    shard, number = ShardWriter(bits), number + 1
        if shard.doc_ids:
            yield _save(shard, folder, part, number)

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard, rows = Shard(path), []
            for k, ids in shard.spans():
                rows.append((shard.doc_ids[k], start + int(shard.ends[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) == 50_000 or k + 1 == len(shard.doc_ids):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    rows = []
            shard.close()


def write_packed(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shard_ids: int = 1 << 24, by_id: bool = True) -> list[dict]:
    """Writes docs (doc_id, text) to a shared folder and returns the shards in order: path, start, n_docs, n_ids.

    Documents lie in ascending doc_id order, null first, repeated rows one after another; without by_id they stay in the
    order and the partitions that docs has, which for a table read from files is the order of Spark's splits, not that in
    which it was written. A null text is an empty one; every document ends with end_id. Only the list of shards comes
    to the driver: one entry for every shard_ids ids. An empty table gives no shards.
    """
    from .tokenizer import Encoder

    bits = bits_for(max(Encoder(tokenizer_path).vocabulary, end_id + 1))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if by_id:
        dealt = dealt.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = dealt.transform(in_arrow(_write(tokenizer_path, end_id, bits, folder, shard_ids), "part int, number int, path string, n_docs long, n_ids long"))
    found, start = [], 0
    for r in sorted(shards.collect(), key=lambda r: (r.part, r.number)):
        found.append({"path": r.path, "start": start, "n_docs": r.n_docs, "n_ids": r.n_ids})
        start += r.n_ids
    return found


def read_packed(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    if not shards:
        return spark.createDataFrame([], _SHARD)
    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    dealt = listed.repartitionByRange(len(shards), "start")  # no two shards start at the same id, so each is a partition
    return dealt.transform(in_arrow(_read, _SHARD))


def token_output(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, by_id: bool = True) -> DataFrame:
    """What read_packed() finds in the files of write_packed()."""
    return read_packed(docs.sparkSession, write_packed(docs, folder, tokenizer_path, end_id, by_id=by_id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_packed_ids."""
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), fresh_path(spark, "token-ids"), public_tokenizers.path("word_bpe_49k.json"), 2)
