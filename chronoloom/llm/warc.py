"""WARC archives: writing, normalising monolithic gzip, and reading back through the offset index.

Archives are first written as one gzip stream each. The normaliser inflates such a stream once, in
bounded memory, rewrites every record as its own gzip member and writes a sidecar index of offsets, so
that any record can be read alone. Records whose payload was seen before are revisits that name the
response and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ._files import Publishing, locate
from ._spark import prepare, save, scratch

DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = 0x636C2D77617263 << 66
_STREAM = 1 << 20


def record_id(page_id: int | None) -> str:
    """A URN that holds the page's number."""
    n = _NAMESPACE | ((1 << 65) if page_id is None else page_id + (1 << 63))
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_of(urn: str) -> int | None:
    n = uuid.UUID(urn[len("<urn:uuid:") : -1]).int & ((1 << 66) - 1)
    return None if n >> 65 else n - (1 << 63)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:unknown"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members; a stream cut before a member's end raises ValueError."""
    z, begun = zlib.decompressobj(31), False
    for data in pieces:
        while data:
            begun = True
            out = z.decompress(data, _STREAM)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
    while begun and not z.eof:
        out = z.decompress(b"", _STREAM)
        if not out:
            raise ValueError("the gzip stream is cut: its last member has no end")
        yield out


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, one at a time."""
    buffer = bytearray()
    need = None
    for data in stream:
        buffer += data
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(buffer[:end]))["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends within a record")


def normalise(source: str, archive: str, index: str, attempt: int = 0, level: int = 6) -> int:
    """One member per record, and a sidecar with a line of JSON for each; returns the number of records."""
    fs, path = locate(source)
    out, side, n = Publishing(archive, attempt), Publishing(index, attempt), 0
    with fs.open_input_file(path) as f:
        for one in records(inflated(iter(lambda: f.read(_STREAM), b""))):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(one) + z.flush()
            head = headers(one[: one.find(b"\r\n\r\n")])
            line = {"id": head["warc-record-id"], "type": head["warc-type"], "offset": out.at, "length": len(member)}
            side.write(json.dumps(line).encode() + b"\n")
            out.write(member)
            n += 1
    out.publish()
    side.publish()
    return n


def parsed(one: bytes) -> dict:
    """A record's page, payload size and digest (both of the full payload), type and reference."""
    split = one.find(b"\r\n\r\n")
    head = headers(one[:split])
    block = one[split + 4 : split + 4 + int(head["content-length"])]
    end = block.find(b"\r\n\r\n")
    http, payload = headers(block[:end]), block[end + 4 :]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its digest")
    return {"page_id": page_of(head["warc-record-id"]), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": head["warc-type"], "refers_to": page_of(head["warc-refers-to"]) if revisit else None}


#: A payload that so many pages share is hot: its reference is broadcast, so that no task gets all its pages.
HOT_PAGES = 100_000


def with_references(pages: DataFrame, least_bytes: int = 0, hot_pages: int = HOT_PAGES) -> DataFrame:
    """page_id, url, payload, first: the smallest page_id of the pages with equal payloads of at least least_bytes.

    Payloads are equal if their SHA-1 and size are. Only shared payloads reach the join's right side; the hot
    ones among them are at most one per hot_pages pages of the table, and are broadcast.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload")})
    shared = p.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = save(shared, "warc-shared")
    hot = shared.where(F.col("n") >= hot_pages).select("sha", "bytes", F.col("first").alias("hot"), F.lit(True).alias("is_hot"))
    rest = shared.where(F.col("n") < hot_pages).select("sha", "bytes", "first")
    # Pages of hot payloads leave the second join's key empty, so they stay spread.
    found = p.join(F.broadcast(hot), ["sha", "bytes"], "left").withColumn("key", F.when(F.col("is_hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.col("page_id"))))
    found = found.join(rest.withColumnRenamed("sha", "key"), ["key", "bytes"], "left")
    return found.select("page_id", "url", "payload", F.coalesce("hot", "first").alias("first"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Monolithic archives of pages(page_id, url, html), one per partition; returns number, path, records.

    Null html is an empty payload; a null page_id is kept (it is a response unless a numbered page shares its
    payload). Rows that repeat the response's page_id are responses too. An empty table writes no archive and
    gives no rows.
    """
    prepare(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task, out, n = TaskContext.get(), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    uri = f"{folder}/whole/part-{task.partitionId():06d}.warc.gz"
                    out, z = Publishing(uri, task.taskAttemptId()), zlib.compressobj(1, zlib.DEFLATED, 31)
                revisit = row["first"] is not None and row["first"] != row["page_id"]
                out.write(z.compress(record(row["page_id"], row["url"], row["payload"].encode(), row["first"], revisit)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.publish()
            yield pa.RecordBatch.from_pylist([{"number": task.partitionId(), "path": uri, "records": n}])

    return save(with_references(pages, least_bytes).mapInArrow(run, "number long, path string, records long"), "warc-whole")


def _spread(manifest: DataFrame) -> DataFrame:
    """An archive per task: dense numbers, dealt in turn."""
    place = F.row_number().over(W.orderBy("number")) - 1  # a row per archive
    n = max(1, manifest.count())
    return manifest.withColumn("place", place).repartitionById(n, F.col("place")).drop("place")


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every archive of the manifest normalised: number, path, index, records."""

    def run(batches):
        from pyspark import TaskContext

        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/records/part-{row['number']:06d}.warc.gz"
                n = normalise(row["path"], name, name + ".index", TaskContext.get().taskAttemptId())
                yield pa.RecordBatch.from_pylist([{"number": row["number"], "path": name, "index": name + ".index", "records": n}])

    return save(_spread(manifest).mapInArrow(run, "number long, path string, index string, records long"), "warc-records")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record, read alone through the index."""

    def run(batches):
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = locate(row["path"])
                _, side = locate(row["index"])
                with fs.open_input_file(path) as f, fs.open_input_stream(side) as lines:
                    out = []
                    for line in lines.read().splitlines():
                        at = json.loads(line)
                        out.append(parsed(zlib.decompress(f.read_at(at["length"], at["offset"]), 31)))
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out = []
                    yield pa.RecordBatch.from_pylist(out, kinds)

    return _spread(manifest).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, folder, least_bytes), folder))
