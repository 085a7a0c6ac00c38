"""Best-fit packing of documents into sequences, in a hierarchy.

Every input partition tokenizes its documents, cuts the long ones and packs the pieces best-fit
decreasing into bins. Bins that are nearly full are finished. What lies in the others goes on as items
into fewer and fewer partitions, each of which packs again and finishes what it can fill; the last round
finishes all. Items leave their partition alone, not as half-full bins that fit nowhere.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, save
from ._text import string_buffers

#: A bin with at most this much room left is finished.
SLACK = 4
#: Items that one task of a later round packs at most, on average.
TASK_ITEMS = 250_000
FAN_IN = 8


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of `size`, and before them one for what is left over."""
    head = length % size if length > size else length
    out = [(0, head)] if head else []
    return out + [(s, size) for s in range(head, length, size)]


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset. A bit mask finds the tightest room in constant time."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = size, n
            n += 1
        bins[i], offsets[i] = b, size - room
        left = room - need
        if not rooms[left]:
            mask |= 1 << left
        rooms[left].append(b)
    return bins, offsets


def tokenized_pieces(docs: DataFrame, tokenizer: str, *, size: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces of all documents, packed within their partition: doc_id, piece, start, length, ids_crc32, bin, place (and ids)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long" + ", ids binary" * keep_ids

    def run(batches):
        from pyspark import TaskContext

        from ._bpe import encoder

        enc = encoder(tokenizer)
        columns: list[list] = [[] for _ in range(6)]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, off = string_buffers(batch.column(1))
            for a, z, flat, rows in enc.encode(raw, off):
                bounds = rows.tolist()
                for i in range(a, z):
                    own = np.append(flat[bounds[i - a] : bounds[i - a + 1]], np.uint32(end_id)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(own), size)):
                        data = own[s : s + n].tobytes()
                        for c, v in zip(columns, (ids[i], k, s, n, zlib.crc32(data), data if keep_ids else None)):
                            c.append(v)
        lengths = np.array(columns[3], np.int64)
        bins, places = best_fit(lengths, size)
        room = size - np.bincount(bins, lengths, len(bins)).astype(np.int64)
        apart = room[bins] > SLACK if len(bins) else np.zeros(0, bool)
        bins[apart], places[apart] = len(bins) + np.flatnonzero(apart), 0
        bins += TaskContext.get().partitionId() << 40
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for a in range(0, len(bins), 8192):
            part = [pa.array(c[a : a + 8192], t) for c, t in zip(columns, kinds)]
            out = part[:5] + [pa.array(bins[a : a + 8192]), pa.array(places[a : a + 8192])] + part[5:] * keep_ids
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _round(items: DataFrame, parts: int, size: int, level: int, last: bool) -> DataFrame:
    """items(bin, fill) packed within `parts` partitions: bin, fill, and parent and shift where the parent is finished."""

    def run(batches):
        from pyspark import TaskContext

        names, fills = [], []
        for batch in batches:
            names.append(batch.column(0).to_numpy(zero_copy_only=False))
            fills.append(batch.column(1).to_numpy(zero_copy_only=False))
        if names:
            name, fill = np.concatenate(names), np.concatenate(fills)
            order = np.argsort(name)  # the same packing whatever order the rows come in
            name, fill = name[order], fill[order]
            parent, shift = best_fit(fill, size)
            room = size - np.bincount(parent, fill, len(parent)).astype(np.int64)
            open_ = np.zeros(len(name), bool) if last else room[parent] > SLACK
            parent += (level << 58) + (TaskContext.get().partitionId() << 34)
            for a in range(0, len(name), 65536):
                s = slice(a, a + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(name[s]), pa.array(fill[s]), pa.array(parent[s], mask=open_[s]), pa.array(shift[s], mask=open_[s])], ["bin", "fill", "parent", "shift"])

    return items.repartition(parts, "bin").mapInArrow(run, "bin long, fill long, parent long, shift long")


def pack(docs: DataFrame, tokenizer: str, *, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids).

    Null text is an empty document, which is its end id alone; repeated rows and ids are packed row by row;
    an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    pieces = save(tokenized_pieces(docs, tokenizer, size=size, end_id=end_id, id_col=id_col, text_col=text_col, keep_ids=keep_ids), "pack-pieces")
    # An item outside a finished bin is a bin of its own.
    items = pieces.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < size - SLACK)
    items = save(items, "pack-items-0")
    left, parts, steps = items.count(), pieces.select(F.shiftright("bin", 40).alias("p")).distinct().count(), []
    for level in range(1, 16):
        if not left:
            break
        least = max(1, -(-left // TASK_ITEMS))
        parts = max(least, parts // FAN_IN)
        last = parts == least
        step = save(_round(items, parts, size, level, last), f"pack-round-{level}")
        steps.append(step.where("parent IS NOT NULL").select("bin", "parent", "shift"))
        if last:
            break
        items = step.where("parent IS NULL").select("bin", "fill")
        left = items.count()
    out = pieces
    for step in steps:
        out = out.join(step, "bin", "left").withColumns({"place": F.col("place") + F.coalesce("shift", F.lit(0)), "bin": F.coalesce("parent", "bin")}).drop("parent", "shift")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"), *["ids"] * keep_ids)
