"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

    blocks    entries (shared prefix of the key before, key suffix, value), varint lengths; CRC-32 at the end
    index     per block: first key, file offset, size, documents before it, ids before it
    filter    Bloom filter over the keys
    footer    96 bytes: magic, versions, counts, places and CRC-32 of index and filter

A key is one byte for null or eight bytes in an order-preserving form. A value is the document's ids,
little-endian, in the smallest of 2 or 4 bytes that the vocabulary allows. A lookup reads footer, filter
and index, finds the block by binary search and scans that block alone.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ._files import Publishing, locate
from ._spark import parallelism, prepare, save, scratch
from ._text import mix64, string_buffers

MAGIC = b"CLSSTAB1"
_FOOTER = struct.Struct("<8sHHIQQQQQQQII16s")  # magic, version, width, bloom hashes, docs, ids, index at/size, bloom at/size, blocks, crc index, crc bloom, spare
BLOCK_BYTES = 64 * 1024
BITS_PER_KEY, HASHES = 10, 7
#: UTF-8 text bytes of one shard, about.
SHARD_TEXT = 32 << 20


def key_bytes(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    h1 = mix64(keys)
    h2 = mix64(h1 ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (h1[:, None] + h2[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def _bloom_key(key: bytes) -> int:
    return 0xFFFFFFFFFFFFFFFF if len(key) == 1 else struct.unpack(">Q", key[1:])[0]


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.block, self.first, self.last = bytearray(), None, b""
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[int] = []
        self.docs = self.ids = 0
        self.at_docs = self.at_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_bytes(doc_id)
        if self.first is None:
            self.first, self.at_docs, self.at_ids = key, self.docs, self.ids
        elif key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(_bloom_key(key))
        self.docs += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.first, self.out.at, len(data), self.at_docs, self.at_ids))
            self.out.write(data)
            self.block, self.first = bytearray(), None

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QIQQ", *rest) for k, *rest in self.index)
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, bool)
        for a in range(0, len(self.keys), 65536):
            bloom[_bloom_bits(np.array(self.keys[a : a + 65536], np.uint64), bits).ravel()] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        index_at = self.out.at
        self.out.write(index)
        bloom_at = self.out.at
        self.out.write(packed)
        self.out.write(_FOOTER.pack(MAGIC, 1, self.width, HASHES, self.docs, self.ids, index_at, len(index), bloom_at, len(packed), len(self.index), zlib.crc32(index), zlib.crc32(packed), b""))


class Reader:
    """One shard file, read by ranges."""

    def __init__(self, uri: str):
        fs, path = locate(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, _, self.width, _, self.docs, self.ids, ia, il, ba, bl, blocks, ic, bc, _ = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        index, self._bloom = self.file.read_at(il, ia), self.file.read_at(bl, ba)
        if zlib.crc32(index) != ic or zlib.crc32(self._bloom) != bc:
            raise ValueError(f"{uri}: damaged index or filter")
        self.blocks, at = [], 0
        for _ in range(blocks):
            n = index[at]
            self.blocks.append((index[at + 1 : at + 1 + n], *struct.unpack_from("<QIQQ", index, at + 1 + n)))
            at += 1 + n + 28

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, size, _, _ = self.blocks[block]
        data = self.file.read_at(size, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        at, key, kind = 0, b"", "<u2" if self.width == 2 else "<u4"
        while at < size - 4:
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, np.frombuffer(data, kind, length // self.width, at)
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, ids) in key order."""
        before = 0
        for b in range(len(self.blocks)):
            for key, ids in self._entries(b):
                yield key_value(key), before, ids
                before += len(ids)

    def may_contain(self, doc_id: int | None) -> bool:
        """By the filter: the few bits of the key, looked up in its bytes."""
        at = _bloom_bits(np.array([_bloom_key(key_bytes(doc_id))], np.uint64), 8 * len(self._bloom)).ravel().tolist()
        return all(self._bloom[k >> 3] >> (k & 7) & 1 for k in at)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier."""
        key = key_bytes(doc_id)
        if not self.blocks or not self.may_contain(doc_id):
            return []
        out, b = [], max(0, bisect_left(self.blocks, key, key=lambda x: x[0]) - 1)
        while b < len(self.blocks) and self.blocks[b][0] <= key:
            out += [ids for k, ids in self._entries(b) if k == key]
            b += 1
        return out


def write_shards(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards below folder; returns their manifest: shard, path, docs, ids, first and last key, base (ids of all shards before).

    Null text is an empty document (its end id alone); null ids come first; rows that repeat an id stay,
    ordered by a hash of their text, so that an id with very many rows can go on over several shards; an empty
    table gives no shards.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(parallelism(spark), -(-total // SHARD_TEXT))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc())
    ordered = d.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        from ._bpe import encoder

        enc, out, task = encoder(tokenizer), None, TaskContext.get()
        for batch in batches:
            names = batch.column(0).to_pylist()
            raw, off = string_buffers(batch.column(1))
            for a, z, flat, rows in enc.encode(raw, off):
                bounds = rows.tolist()
                for i in range(a, z):
                    if out is None:
                        uri = f"{folder}/shard-{task.partitionId():06d}.sst"
                        out = Publishing(uri, task.taskAttemptId())
                        shard = Writer(out, enc.width)
                    shard.add(names[i], np.append(flat[bounds[i - a] : bounds[i - a + 1]], np.uint32(end_id)))
        if out is not None:
            shard.close()
            out.publish()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": uri, "docs": shard.docs, "ids": shard.ids, "first_key": shard.index[0][0], "last_key": shard.last}])

    manifest = save(ordered.mapInArrow(run, "shard long, path string, docs long, ids long, first_key binary, last_key binary"), "sst-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, starts, sizes, crcs = [], [], [], []
                for doc_id, before, own in Reader(row["path"]):
                    ids.append(doc_id)
                    starts.append(row["base"] + before)
                    sizes.append(len(own))
                    crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    places = save(manifest.select("path", "base", (F.row_number().over(W.orderBy("shard")) - 1).alias("place")), "sst-places")
    spread = places.repartitionById(max(1, places.count()), F.col("place"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup_rows(manifest: DataFrame, keys: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian, unsigned 32 bits) of every stored document whose identifier is in keys(doc_id).

    A key goes to the shards whose first and last key enclose it; a task opens a shard once, asks its filter, and
    reads the blocks that binary search finds. A null key finds the documents without identifier; repeated keys
    ask once; an empty table of keys gives no rows.
    """
    prepare(keys.sparkSession)
    # Big-endian with the sign turned, so that bytes order as numbers do; null sorts first.
    shifted = F.unhex(F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    asked = keys.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    asked = asked.withColumn("key", F.when(F.col("doc_id").isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), shifted)))
    shards = manifest.select("shard", "path", "first_key", "last_key")
    # A row per shard: thousands for a terabyte.
    pairs = asked.join(shards, (F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key"))).select("shard", "path", "doc_id")

    def run(batches):
        path, reader = None, None
        for batch in batches:
            found: list[tuple] = []
            for p, doc_id in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if p != path:
                    path, reader = p, Reader(p)
                found += [(doc_id, ids.astype("<u4").tobytes()) for ids in reader.lookup(doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.binary())], ["doc_id", "ids"])

    return pairs.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer, scratch(docs.sparkSession, "sst"), **options))
