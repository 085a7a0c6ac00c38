"""Packed frames, information, transport and playback."""

import numpy as np
import pytest

from chronoloom.functions import signal
from chronoloom.plans import viewer
from chronoloom.plans.api import open_recording
from chronoloom.sources import recording


@pytest.fixture(scope="module")
def rec(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("v") / "v.sigb")
    frames = [*range(0, 150), *range(200, 400)]
    recording.write_file(path, ((f, signal.values(np.arange(3), f, 1)[:, 0]) for f in frames), rate=100.0, frames_per_block=50)
    return open_recording(spark, path)


def test_packed_frame(rec):
    data = viewer.frame_bytes(rec, 100, 200, 8, [2, 0], 25, mode="review")
    info, v = viewer.unpacked(data)
    assert (info["from"], info["frames"], info["columns"], info["mode"], info["channels"]) == (100, 200, 8, "review", [2, 0])
    assert (len(data) - v.nbytes) % 4 == 0 and np.isnan(v[:, 2:4]).all()
    x = signal.values(np.array([2]), 100, 25)[0]
    assert v[0, 0].tolist() == [x.min(), x.max()]
    assert np.isnan(viewer.unpacked(viewer.frame_bytes(rec, 9999, 10, 4, [0], 5))[1]).all()


def test_information(rec):
    i = viewer.information(rec)
    assert (i["totalFrames"], i["droppedValues"], i["ledger"], i["ledgerSource"]) == (350, 150, [(150, 50, 4)], "header")


def test_playback_has_every_frame(rec):
    got = viewer.playback(rec, 0, 400, [1, 2], frames=70).orderBy("start").collect()
    assert [x["start"] for x in got] == list(range(0, 400, 70)) and sum(x["present"] for x in got) == 350
    v = np.concatenate([np.frombuffer(x["values"], "<f4").reshape(x["frames"], 2) for x in got])
    want = signal.values(np.array([1, 2]), 0, 400).T.copy()
    want[150:200] = np.nan
    assert np.array_equal(v, want, equal_nan=True)


def test_transport():
    clock = [0.0]
    t = viewer.Transport(now=lambda: clock[0])
    t.apply("seek", 50, end=1000, rate=100)
    assert t.position(1000, 100) == 50
    t.apply("play", end=1000, rate=100)
    clock[0] = 2.0
    assert t.position(1000, 100) == 250
    t.apply("speed", 99, end=1000, rate=100)
    clock[0] = 2.25
    assert t.speed == 16.0 and t.position(1000, 100) == 650
    t.apply("pause", end=1000, rate=100)
    clock[0] = 9.0
    assert t.position(1000, 100) == 650 and t.position(600, 100) == 600
    with pytest.raises(ValueError):
        t.apply("rewind", end=1, rate=1)
