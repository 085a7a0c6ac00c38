"""What a report says: sweep, details, sidecar."""

import json

import numpy as np
import pytest

from chronoloom.functions import signal
from chronoloom.plans.api import Refused, open_recording
from chronoloom.sources import layout, recording

C, RATE, BLOCK = 4, 1000.0, 100
STRIDE = layout.BLOCK_HEADER + BLOCK * C * 4


@pytest.fixture
def damaged(tmp_path):
    """Frames from 40 on, a gap, one wrong value with its checksum repaired, one payload with a stale checksum."""
    path = str(tmp_path / "d.sigb")
    recording.write_file(path, ((f, signal.values(np.arange(C), f, 1)[:, 0]) for f in [*range(40, 440), *range(500, 700)]), rate=RATE, frames_per_block=BLOCK)
    data = bytearray(open(path, "rb").read())
    at = layout.FILE_HEADER + STRIDE
    head = np.frombuffer(bytes(data[at : at + layout.BLOCK_HEADER]), layout.BLOCK).copy()
    values = np.frombuffer(bytes(data[at + layout.BLOCK_HEADER : at + STRIDE]), "<f4").copy()
    values[2 * BLOCK + 7] += 1
    head["payload_crc"] = layout.crc32c(values.tobytes())
    raw = head.tobytes()[:-4]
    data[at : at + STRIDE] = raw + np.uint32(layout.crc32c(raw)).tobytes() + values.tobytes()
    data[layout.FILE_HEADER + 2 * STRIDE + layout.BLOCK_HEADER + 40] ^= 1
    open(path, "wb").write(bytes(data))
    return path


def test_details(spark, damaged):
    r = open_recording(spark, damaged)
    lines = [x["line"] for x in r.details().orderBy("line_number").collect()]
    wrong = float(signal.values(np.arange(C), 147, 1)[2, 0])
    got = float(np.float32(wrong) + np.float32(1))
    assert lines == [
        "First missing:    value #0  (channel 0, frame 0, t=0.000000s)", "                  160 values",
        "First incorrect:  value #590  (channel 2, frame 147, t=0.147000s)",
        f"                  expected {wrong}, got {got}, byte offset {layout.FILE_HEADER + STRIDE + layout.BLOCK_HEADER + (2 * BLOCK + 7) * 4:,}",
        f"First corrupt:    block #2 at byte {layout.FILE_HEADER + 2 * STRIDE:,}",
        "Drop ledger:      header declares 400 dropped values, validator derived 400 — AGREE",
    ]
    r.close()


def test_sweep_begins_at_the_first_block(spark, damaged):
    row = open_recording(spark, damaged).check().first()
    # The frames before the first block are in the ledger, but no gap between blocks.
    assert (row["blocks"], row["bad_headers"], row["bad_payloads"], row["gaps"], row["gap_frames"], row["ledger_frames"], row["agrees"], row["sound"]) == (6, 0, 1, 1, 60, 100, False, False)


def test_sidecar_is_written_and_read(spark, damaged):
    r = open_recording(spark, damaged)
    with pytest.raises(Refused):
        r.metadata()
    r.write_sidecar()
    told = json.loads(r.metadata())
    assert told["recordingId"] == r.header["recording_id"] and told["drops"]["totalDroppedFrames"] == 100
    assert [(e["startFrameIndex"], e["valueCount"], e["cause"]) for e in told["drops"]["entries"]] == [(0, 160, "TRANSPORT_GAP"), (440, 240, "TRANSPORT_GAP")]
