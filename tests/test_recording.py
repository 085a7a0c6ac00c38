"""The file format, the data source, validation of damaged files, streams and side data."""

import json
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import signal
from chronoloom.functions.crc import crc32c
from chronoloom.plans.api import Refused, open_recording
from chronoloom.sources import layout, recording, side

C, RATE, BLOCK = 4, 1000.0, 100


def rows(frames):
    for f in frames:
        yield f, signal.values(np.arange(C), f, 1)[:, 0]


@pytest.fixture(scope="module")
def whole(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rec") / "whole.sigb")
    recording.write_file(path, rows(range(1000)), rate=RATE, frames_per_block=BLOCK)
    return path


@pytest.fixture(scope="module")
def gappy(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rec") / "gappy.sigb")
    recording.write_file(path, rows([*range(0, 250), *range(300, 420), *range(500, 800)]), rate=RATE, frames_per_block=BLOCK)
    return path


def copied(path, tmp_path, change):
    data = bytearray(open(path, "rb").read())
    out = change(data)
    name = str(tmp_path / "copy.sigb")
    with open(name, "wb") as f:
        f.write(data if out is None else out)
    return name


def patched(data, **fields):
    h = np.frombuffer(bytes(data[: layout.FILE_HEADER]), layout.HEADER).copy()
    for k, v in fields.items():
        h[k] = v
    head = h.tobytes()[:-4]
    data[: layout.FILE_HEADER] = head + np.uint32(crc32c(head)).tobytes()
    return data


STRIDE = layout.BLOCK_HEADER + BLOCK * C * 4
at = lambda b: layout.FILE_HEADER + b * STRIDE


def test_headers_round_trip_and_refuse_damage(whole):
    data = open(whole, "rb").read()
    h = layout.header_of(data)
    assert (h["channel_count"], h["total_frames"], h["block_count"], h["finalised"], h["dtype_name"]) == (C, 1000, 10, True, "float32")
    for change, why in (((0, 1), "magic"), ((12, 1), "big-endian"), ((8, 9), "version"), ((100, 1), "checksum")):
        bad = bytearray(data)
        bad[change[0]] ^= change[1]
        with pytest.raises(layout.Unreadable, match=why):
            layout.header_of(bytes(bad))
    with pytest.raises(layout.Unreadable, match="shorter"):
        layout.header_of(data[:100])
    with pytest.raises(layout.Unreadable, match="layout"):
        layout.header_of(bytes(patched(bytearray(data), layout_code=2)))
    b = bytearray(data[at(2) :])
    assert layout.block_of(bytes(b))["header_ok"]
    b[20] ^= 1
    assert not layout.block_of(bytes(b))["header_ok"] and layout.block_of(b"x") is None
    t = layout.ledger_bytes([(48_000, 11_400, 2)])
    assert layout.ledger_of(t)[0].tolist()[:3] == (48_000, 11_400, 2) and layout.ledger_of(t[:-20]) is None
    assert len(layout.hexdump(data)) == len(layout.HEADER.names)


def test_ranges_and_channels(spark, gappy):
    r = open_recording(spark, gappy)
    got = {(x["frame"], x["channel"]): x["value"] for x in r.samples(200, 520, [1, 3]).collect()}
    want = {(f, c): float(signal.values(np.array([c]), f, 1)[0, 0]) for f in [*range(200, 250), *range(300, 420), *range(500, 520)] for c in (1, 3)}
    assert got == want
    assert r.extent["end_frame"] == 800 and r.extent["total_frames"] == 670
    with pytest.raises(ValueError):
        r.read("0s", "1s", "9")
    with pytest.raises(ValueError, match="empty"):
        r.read("900s", "901s")


def test_filters_reach_the_source(spark, whole):
    reader = recording.RecordingReader({"path": whole, "taskbytes": "1"}, None, "samples")
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

    assert len(list(reader.pushFilters([GreaterThanOrEqual(("frame",), 150), LessThan(("frame",), 420), In(("channel",), (1, 2))]))) == 3
    parts = reader.partitions()
    assert (parts[0].first, parts[-1].last, len(parts)) == (1, 5, 4) and parts[0].channels == [1, 2]


def _unreadable(data):
    data[at(3) + 20] ^= 1


def _doubled(data):
    data[at(2) : at(3)] = data[at(1) : at(2)]


def _spliced(data):
    return bytes(data[: at(2)] + data[at(3) :])


def _swapped(data):
    data[at(2) : at(3)], data[at(6) : at(7)] = data[at(6) : at(7)], data[at(2) : at(3)]


def _torn(data):
    patched(data, flags=0)
    return bytes(data[: at(7) + 100])


@pytest.mark.parametrize("change", [_unreadable, _doubled, _spliced, _swapped, _torn])
def test_a_pushed_filter_changes_no_rows(spark, whole, tmp_path, change):
    path = copied(whole, tmp_path, change)
    rows_of = lambda df: sorted((r["block_index"], r["frame"], r["channel"], r["bits"]) for r in df.collect())
    everything = rows_of(recording.read(spark, path))
    for taskbytes in (1, 1 << 26):
        for low, high in ((0, 10_000), (150, 420), (300, 301), (250, 700), (333, 10_000), (0, 199), (5_000, 6_000)):
            df = recording.read(spark, path, taskbytes=taskbytes).where((F.col("frame") >= low) & (F.col("frame") < high) & F.col("channel").isin(1, 3))
            assert rows_of(df) == [x for x in everything if low <= x[1] < high and x[2] in (1, 3)]
    r = recording.Recording(path)
    index, ok = r.index()
    for frame in range(0, 1100, 7):
        hit = r.find(frame)
        holding = [b for b in np.flatnonzero(ok) if index["start_frame"][b] <= frame < index["start_frame"][b] + index["frame_count"][b]]
        assert (hit is not None and hit[0] in holding) if holding else (hit is None or index["start_frame"][hit[0]] > frame)


def test_checksums_of_many_values():
    from chronoloom.functions.crc import crc32c_many

    r = np.random.default_rng(3)
    parts = [r.bytes(n) for n in (0, 1, 2, 3, 9, 64, 65, 4095, 8193, 100_000, 0, 7)] + [b"123456789"]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    assert crc32c_many(np.frombuffer(b"".join(parts), np.uint8), ends).tolist() == [crc32c(p) for p in parts]
    assert crc32c(parts[-1]) == 0xE3069283


def test_seek(spark, whole, gappy):
    r, g = open_recording(spark, whole), open_recording(spark, gappy)
    assert r.seek("#555")[0] | {} == {"frame": 555, "seconds": 0.555, "block": 5, "method": "closed-form", "probes": 1, "bytes": 64}
    found = {x["frame"]: (x["block"], x["method"]) for x in g.seek("#0,#240,#270,#410,#650,#799,#800")}
    assert found == {0: (0, "closed-form"), 240: (2, "closed-form"), 270: (3, "after-gap"), 410: (4, "closed-form"), 650: (6, "closed-form"), 799: (7, "closed-form"), 800: (None, "not found")}
    assert r.predicted_bytes(0, 1000, 2) == 10 * 64 + 2 * 1000 * 4


def test_gaps_ledger_and_validation(spark, gappy):
    r = open_recording(spark, gappy)
    want = [(250, 50), (420, 80)]
    assert [tuple(x)[:2] for x in r.gaps().orderBy("start_frame").collect()] == want
    assert [(x["start_frame"], x["frame_count"]) for x in r.ledger().orderBy("start_frame").collect()] == want
    v = r.validate().first()
    assert (v["missing"], v["ledger_agrees"], v["result"], v["recorded"]) == (130 * C, True, "FAIL", 670 * C)
    f = {x["class"]: x for x in r.first_discrepancies().collect()}
    assert set(f) == {"missing"} and (f["missing"]["frame"], f["missing"]["value_count"]) == (250, 50 * C)


def test_damage_classes(spark, whole, tmp_path):
    assert open_recording(spark, whole).validate().first()["result"] == "PASS"

    def spliced(d):
        return patched(bytearray(d[: at(2)] + d[at(3) :]), block_count=9, total_frames=900, total_values=900 * C, trailer_offset=at(9))

    def doubled(d):
        return patched(bytearray(d[: at(2)] + d[at(1) : at(2)] + d[at(2) :]), block_count=11, trailer_offset=at(11))

    def wrong(d):
        p = at(3) + layout.BLOCK_HEADER
        payload = np.frombuffer(bytes(d[p : p + BLOCK * C * 4]), "<f4").copy()
        payload[2 * BLOCK + 23] += 1
        d[at(3) : at(4)] = layout.block_bytes(payload.tobytes(), start_frame=300, frame_count=BLOCK, block_index=3)

    def rotten(d):
        d[at(2) + layout.BLOCK_HEADER + 40] ^= 255

    def headless(d):
        d[at(4) + 5] ^= 255

    for change, counts, place in (
        (spliced, {"missing": BLOCK * C}, ("missing", 200)), (doubled, {"duplicated": BLOCK * C}, ("duplicated", 100)),
        (wrong, {"incorrect": 1}, ("incorrect", 323)), (rotten, {"corrupt": BLOCK * C}, ("corrupt", 200)), (headless, {"corrupt": BLOCK * C}, None),
    ):
        r = open_recording(spark, copied(whole, tmp_path, change))
        v = r.validate().first().asDict()
        assert {k: v[k] for k in ("missing", "duplicated", "incorrect", "corrupt") if v[k]} == counts and v["exit_code"] == 1, change.__name__
        if place:
            f = {x["class"]: x["frame"] for x in r.first_discrepancies().collect()}
            assert f[place[0]] == place[1]
    v = open_recording(spark, copied(whole, tmp_path, rotten)).validate(check_crc=False).first()
    assert v["corrupt"] == 0 and v["incorrect"] > 0


def test_truncated_and_unfinished(spark, whole, tmp_path):
    r = open_recording(spark, copied(whole, tmp_path, lambda d: d[: at(7) + 500]))
    assert r.extent == {"block_count": 7, "total_frames": 700, "total_values": 700 * C, "end_frame": 700, "recovered": True, "truncated_tail_bytes": 500}
    assert r.validate().first()["result"] == "PASS (TRUNCATED)"
    open_name = str(tmp_path / "open.sigb")
    recording.write_file(open_name, rows(range(250)), rate=RATE, frames_per_block=BLOCK, finalise=False)
    live = open_recording(spark, open_name)
    assert live.extent["block_count"] == 2  # the short block is still being written
    with pytest.raises(Refused):
        live.file_download()
    assert open_recording(spark, whole).file_download() == whole


def test_ledger_found_without_header(whole, gappy, tmp_path):
    name = copied(gappy, tmp_path, lambda d: patched(d, flags=0))
    entries, source = recording.Recording(name).ledger()
    assert source == "backward-scan" and [tuple(e)[:2] for e in entries.tolist()] == [(250, 50), (420, 80)]
    assert recording.Recording(copied(whole, tmp_path, lambda d: patched(d[: at(10)], flags=0))).ledger()[1] == "absent"


def test_unknown_signal_is_refused(spark, whole, tmp_path):
    r = open_recording(spark, copied(whole, tmp_path, lambda d: patched(d, signal_id=b"other/v9")))
    with pytest.raises(layout.Unreadable, match="signal"):
        r.validate()


def test_exports(spark, gappy):
    r = open_recording(spark, gappy)
    lines = [x["value"] for x in r.csv_lines("#248", "#302", "1,0").orderBy("line").collect()]
    assert lines[0] == "frameIndex,timeSeconds,ch0,ch1" and [x.split(",")[0] for x in lines[1:]] == ["248", "249", "300", "301"]
    assert lines[1].split(",")[1] == "0.248000" and float(lines[1].split(",")[2]) == float(signal.values(np.array([0]), 248, 1)[0, 0])
    down = [x["value"] for x in r.csv_download(0.5, 1, [3, 0, 99]).orderBy("line").collect()]
    assert down[0] == "time_s,frame,channel_1,channel_4" and len(down) == 301
    for bad in ([], [99]):
        with pytest.raises(Refused):
            r.csv_download(0, 1, bad)
    with pytest.raises(Refused):
        r.csv_download(100, 1, [0])
    j = json.loads(r.json_lines("#300", "#301", "2").first()["value"])
    assert j["frameIndex"] == 300 and np.float32(j["values"][0]) == signal.values(np.array([2]), 300, 1)[0, 0]
    raw = r.raw_planar("#0", "#100", "0,1").orderBy("channel").collect()
    assert np.array_equal(np.frombuffer(raw[1]["data"], "<f4"), signal.values(np.array([1]), 0, 100)[0])
    played = {x["frame"]: np.frombuffer(x["data"], "<f4") for x in r.raw_interleaved("#248", "#252", "1,3").collect()}
    assert np.isnan(played[250]).all() and np.array_equal(played[249], signal.values(np.array([1, 3]), 249, 1)[:, 0])
    env = r.envelope(0, 800, 8).where("channel = 0").orderBy("column").collect()
    assert len(env) == 8 and env[0]["hi"] == float(signal.values(np.array([0]), 0, 100).max())


def test_writer_source_and_stream(spark, whole, tmp_path):
    recording.register(spark)
    f = signal.interleaved(spark, C, 450).coalesce(1)
    f.write.format("recording").option("rate", RATE).option("framesperblock", BLOCK).mode("append").save(str(tmp_path / "w"))
    r = open_recording(spark, str(tmp_path / "w" / "part-000000.sigb"))
    assert r.validate().first()["result"] == "PASS" and r.extent["total_frames"] == 450
    folder = tmp_path / "s"
    os.makedirs(folder)
    shutil.copy(whole, folder / "a.sigb")
    stream = spark.readStream.format("recording").option("table", "blocks").load(str(folder))
    q = stream.writeStream.format("memory").queryName("followed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("followed").count() == 10


def test_configuration(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"channel_count": 16, "sample_rate_hz": 1000, "dither": False}))
    c = side.resolve({"channel_count": 8}, {"CHRONOLOOM_FRAMES_PER_BLOCK": "500"}, str(path))
    assert (c.channel_count, c.sample_rate_hz, c.dither, c.frames_per_block) == (8, 1000, False, 500)
    assert (c.sources["channel_count"], c.sources["sample_rate_hz"], c.sources["frames_per_block"], c.sources["ring_bytes"]) == ("cli", "file:c.json", "env:CHRONOLOOM_FRAMES_PER_BLOCK", "default")
    assert [side.Config(sample_rate_hz=r).frames_per_tick for r in (4000, 1000, 32000, 250, 60)] == [20, 5, 160, 1, 1]
    assert side.Config().block_stride_bytes == 512_064
    for bad in ({"channel_count": 0}, {"sample_rate_hz": -1}, {"ring_bytes": 5}):
        with pytest.raises(ValueError):
            side.resolve(bad, {})
    assert side.config_table(spark, c).count() == len(c.sources)
