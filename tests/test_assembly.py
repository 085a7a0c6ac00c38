"""One recording written in parallel, from frames and from blocks; and the index over many."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import signal
from chronoloom.plans.api import open_recording
from chronoloom.sources import assembly, index, layout, recording

C, RATE, BLOCK = 4, 1000.0, 100


def frames_of(spark, numbers, channels=C):
    return spark.createDataFrame([(f, signal.values(np.arange(channels), f, 1)[:, 0].tolist()) for f in numbers], "frame long, values array<float>")


@pytest.mark.parametrize("in_place", [True, False])
@pytest.mark.parametrize("block,task", [(100, 2), (7, 3), (1, 64)])
def test_one_valid_recording(spark, tmp_path, monkeypatch, in_place, block, task):
    monkeypatch.setattr(assembly, "TASK_BLOCKS", task)
    numbers = [*range(40, 250), *range(300, 640), *range(1200, 1210)]
    path = str(tmp_path / "deep" / "one.sigb")
    got = assembly.write_recording(frames_of(spark, numbers).repartition(5), path, rate=RATE, frames_per_block=block, in_place=in_place)
    same = str(tmp_path / "same.sigb")
    recording.write_file(same, ((f, signal.values(np.arange(C), f, 1)[:, 0]) for f in numbers), rate=RATE, frames_per_block=block)
    assert sorted(os.listdir(tmp_path / "deep")) == ["one.sigb"]
    mine, other = open_recording(spark, path), open_recording(spark, same)
    assert (got["total_frames"], got["block_count"]) == (560, other.header["block_count"]) == (mine.header["total_frames"], mine.extent["block_count"])
    columns = ["block_index", "ok", "start_frame", "frame_count", "payload_bytes", "flags", "preceding_gap_frames", "payload_crc", "byte_offset"]
    rows = lambda r: [tuple(x) for x in r.table("blocks").select(*columns).orderBy("block_index").collect()]
    assert rows(mine) == rows(other)
    assert sorted((x["start_frame"], x["frame_count"]) for x in mine.ledger().collect()) == [(0, 40), (250, 50), (640, 560)]
    report = mine.validate().first()
    assert (report["recorded"], report["missing"], report["incorrect"], report["corrupt"], report["ledger_agrees"]) == (560 * C, 650 * C, 0, 0, True)


def test_without_gaps_it_passes_and_ids_differ(spark, tmp_path):
    ids = set()
    for k in range(2):
        path = str(tmp_path / f"{k}.sigb")
        assembly.write_recording(frames_of(spark, range(900)), path, rate=RATE, frames_per_block=BLOCK)
        r = open_recording(spark, path)
        ids.add(r.header["recording_id"])
        assert r.validate().first()["result"] == "PASS" and r.gaps().count() == 0
    assert len(ids) == 2


def test_what_is_refused_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "x.sigb")
    assert assembly.write_recording(frames_of(spark, range(10)).where("false"), path, rate=RATE, frames_per_block=BLOCK) is None
    for bad in (frames_of(spark, [1, 2, 2, 3]), frames_of(spark, range(5)).unionByName(frames_of(spark, [7], 3))):
        with pytest.raises(Exception):
            assembly.write_recording(bad, path, rate=RATE, frames_per_block=BLOCK)
    assert not os.path.exists(path)


def test_ledger_is_cut_and_says_so(spark, tmp_path):
    path = str(tmp_path / "cut.sigb")
    got = assembly.write_recording(frames_of(spark, range(0, 40, 2)), path, rate=RATE, frames_per_block=BLOCK, most_entries=5)
    r = open_recording(spark, path)
    assert got["ledger_truncated"] and r.header["ledger_truncated"] and r.header["dropped_frames_total"] == 19
    assert [(x["start_frame"], x["frame_count"]) for x in r.ledger().orderBy("start_frame").collect()] == [(k, 1) for k in (1, 3, 5, 7, 9)]


def test_blocks_become_a_recording(spark, tmp_path):
    rows = []
    for n, (start, count, gap) in enumerate([(0, 100, 0), (100, 30, 0), (150, 100, 20)]):
        rows.append((n, start, count, gap, C, bytearray(signal.values(np.arange(C), start, count).tobytes())))
    blocks = spark.createDataFrame(rows, "block_index long, start_frame long, frame_count long, preceding_gap long, channel_count int, payload binary")
    path = str(tmp_path / "b.sigb")
    assembly.assemble(blocks, path, rate=RATE, frames_per_block=BLOCK)
    report = open_recording(spark, path).validate().first()
    assert (report["recorded"], report["missing"], report["incorrect"], report["corrupt"], report["ledger_agrees"]) == (230 * C, 20 * C, 0, 0, True)


def test_a_block_of_the_wrong_length_is_corrupt(spark, tmp_path):
    path = str(tmp_path / "w.sigb")
    assembly.write_recording(frames_of(spark, range(300)), path, rate=RATE, frames_per_block=BLOCK)
    data = bytearray(open(path, "rb").read())
    at = layout.FILE_HEADER + layout.BLOCK_HEADER + BLOCK * C * 4
    head = np.frombuffer(bytes(data[at : at + layout.BLOCK_HEADER]), layout.BLOCK).copy()
    head["payload_bytes"] -= 4
    raw = head.tobytes()[:-4]
    data[at : at + layout.BLOCK_HEADER] = raw + np.uint32(layout.crc32c(raw)).tobytes()
    open(path, "wb").write(bytes(data))
    report = open_recording(spark, path).validate().first()
    assert (report["corrupt"], report["incorrect"], report["result"]) == (BLOCK * C, 0, "FAIL")


def test_index_opens_only_what_is_hit(spark, tmp_path):
    folder = tmp_path / "many"
    for k in range(30):
        recording.write_file(str(folder / f"{k:03d}.sigb"), ((f, np.full(2, f, "<f4")) for f in range(k * 100, k * 100 + 95)), rate=RATE, frames_per_block=10, first=k * 100)
    built = index.build(spark, str(folder), str(tmp_path / "index"))
    assert built.count() == 300 and built.select("path").distinct().count() == 30
    for k in range(30):
        if k not in (3, 4, 20):
            os.remove(folder / f"{k:03d}.sigb")
    ranges = spark.createDataFrame([(1, 390, 412), (2, 2000, 2001), (3, 98, 98), (4, None, 5), (5, 396, 400), (6, 395, 1)], "range_id long, low long, high long")
    got = sorted((r["range_id"], r["frame"], r["channel"], r["value"]) for r in index.samples(built, ranges, [1, 7]).collect())
    want = [(1, f, 1, float(f)) for f in [*range(390, 395), *range(400, 412)]] + [(2, 2000, 1, 2000.0)]
    assert got == sorted(want)
    for bucket in (1, 7, 1000):
        pairs = sorted((r["range_id"], r["path"], r["block_index"]) for r in index.hits(built, ranges, bucket=bucket).collect())
        assert pairs == sorted(set(pairs)) and len(pairs) == 1 + 2 + 1
    assert index.samples(built.where("false"), ranges).count() == 0


def test_seek_after_loss_reads_few_headers(tmp_path):
    path = str(tmp_path / "s.sigb")
    lost = {f for f in range(6000) if f % 700 in (13, 14, 15)}
    recording.write_file(path, ((f, np.zeros(1, "<f4")) for f in range(6000) if f not in lost), rate=RATE, frames_per_block=2)
    r = recording.Recording(path)
    found, _ = r.index()
    for frame in [*range(0, 6000, 97), 13, 713, 1415, 5999]:
        block, how, reads = r.find(frame)
        start, n = int(found["start_frame"][block]), int(found["frame_count"][block])
        if frame in lost:
            assert how == "after-gap" and start - frame in (1, 2, 3)
        else:
            assert start <= frame < start + n
        assert reads <= 15
    assert r.find(6000) is None and r.find(10**9) is None
