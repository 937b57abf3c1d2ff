import numpy as np
import pytest

from tracelode import errors as E
from tracelode.facade import EdfFile
from tracelode.sources import writer as w


@pytest.fixture(scope="module")
def ramp(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ramp") / "ramp.edf")
    s = w.signal("ramp", 10, "-100", "100", "-100", "100")
    return EdfFile(w.write(path, w.header([s, s | {"label": "two"}, w.signal("slow", 5, "-100", "100", "-100", "100")], 5), w.records([np.arange(50).reshape(5, 10), np.arange(50).reshape(5, 10) + 50, np.arange(25).reshape(5, 5)])))


def test_signal_reads(ramp):
    s = ramp.signal("ramp")
    assert len(s) == 50 and s[0] == 0 and s[-1] == 49 and s[17] == 17
    assert s[8:12].tolist() == [8, 9, 10, 11] and s[5:5].size == 0 and s[40:99].size == 10 and s[-3:].tolist() == [47, 48, 49]
    for k in (slice(None, None, 7), slice(None, None, -1), slice(40, 3, -4), slice(3, 40, 4), slice(10, 2)):
        assert s[k].tolist() == list(range(50))[k]
    assert s.to_numpy().dtype == np.float64 and s.to_digital().dtype == np.int16
    assert s.times()[[0, 9, 10]].tolist() == [0, 0.9, 1.0]
    assert repr(s) == 'Signal(label="ramp", samples=50, rate=10Hz)'
    for bad in (50, -51):
        with pytest.raises(IndexError):
            s[bad]
    with pytest.raises(IndexError, match="index must be int or slice"):
        s[3.14]


def test_lookup_errors(ramp):
    with pytest.raises(KeyError):
        ramp.signal("none")
    with pytest.raises(E.SignalOutOfRange):
        ramp.signal(9)
    for bad in (-1, 3.14, None):
        with pytest.raises(TypeError):
            ramp.signal(bad)


def test_proxy(ramp):
    p = ramp.array_proxy([0, 1])
    assert p.shape == (2, 50) and p.sample_rate == 10 and p[0, 3] == 3 and p[-1, -1] == 99
    assert p[0, 2:4].tolist() == [2, 3] and p[:, 7].tolist() == [7, 57] and p[[1, 0, 1], 9:11].tolist() == [[59, 60], [9, 10], [59, 60]]
    assert p[:, 5:5].shape == (2, 0) and p.read_digital((slice(None), slice(0, 2))).dtype == np.int16
    assert repr(p) == "ArrayProxy(shape=(2, 50), rate=10Hz)" and ramp.array_proxy([]).shape == (0, 0)
    for key, kind in (((0, slice(0, 9, 2)), ValueError), ((slice(0, 2, 2), 0), ValueError), (0, IndexError), ((0, 1, 2), IndexError), ((0, "x"), TypeError), ((1.5, 0), TypeError), ((2, 0), IndexError), ((0, 50), IndexError)):
        with pytest.raises(kind):
            p[key]
    with pytest.raises(E.MixedSampleRates, match="signal 0 has rate 10Hz but signal 2 has rate 5Hz"):
        ramp.array_proxy()


def test_pages(ramp):
    a, b, c = ramp.read_page(1.0, 2.0)
    assert a.tolist() == list(range(10, 20)) and b[0] == 60 and c.tolist() == [5, 6, 7, 8, 9]
    assert [x.size for x in ramp.read_page(4.5, 99)] == [5, 5, 3] and all(x.size == 0 for x in ramp.read_page(9, 10)) and ramp.read_page(-5, 0.1)[0].tolist() == [0]
    assert ramp.read_page_digital(0, 0.2, [1, 1])[1].tolist() == [50, 51]
    assert ramp.signal_indices_by_rate() == {10: [0, 1], 5: [2]}


def test_file(ramp):
    assert repr(ramp) == 'EdfFile(variant="EDF+C", signals=3, records=5, duration=5s)'
    with ramp as f:
        pass
    assert f.signal(0)[0] == 0 and f.header()["num_records"] == 5 and f.annotations == [] and f.scan_progress == (5, 5)
    assert f.warnings == [] and f.annotations_ready


def test_edges(edge):
    t = EdfFile(edge["truncated"])
    assert len(t.signal(0)) == 3 and t.signal(0)[1] is not None and t.scan_progress == (2, 2) and "data truncated at record 2" in t.warnings[0]
    with pytest.raises(E.RecordOutOfRange):
        t.signal(0)[2]
    assert len(EdfFile(edge["unknown_count"]).signal(0)) == 0 and EdfFile(edge["unknown_count"]).duration == 0
    z = EdfFile(edge["zero_duration"]).signal(0).times()
    assert np.isnan(z[0]) and np.isposinf(z[1])
    assert EdfFile(edge["inverted"]).signal(0).to_numpy().tolist() == [-10.0, 20.0]
    g = EdfFile(edge["gaps"])
    assert g.starttime_subsecond == 10 and g.signal(0).times()[[0, 4, 8]].tolist() == [0, 1, 10] and g.read_page(2, 3, [0])[0].size == 4
    p = EdfFile(edge["plain_with_lists"])
    assert [repr(a) for a in p.annotations] == ['Annotation(onset=1.5, text="late")']
    b = EdfFile(edge["bad_lists"])
    assert [(a.onset, a.duration, a.text) for a in b.annotations] == [(0.25, 1.5, "good"), (0.25, 1.5, "second"), (0.5, None, "odd"), (0.9, None, "kept")] and len(b.warnings) == 4
    assert EdfFile(edge["no_time_keeping"]).warnings == ["missing time-keeping annotation in record 0, using calculated onset", "EDF+C record 1: expected onset gap 1s, got 1.500000s"]
    assert [a.text for a in EdfFile(edge["two_channels"]).annotations] == ["early", "tie"]
    assert EdfFile(edge["uneven"]).warnings == ["EDF+C record 1: expected onset gap 1s, got 1.500000s", "EDF+C record 2: expected onset gap 1s, got 0.500000s"]
    assert EdfFile(edge["merging_rates"]).signal_indices_by_rate() == {0: [0, 1, 2]}
    assert EdfFile(edge["long_year"]).start_datetime.year == 3910 and EdfFile(edge["raw_dates"]).start_datetime == "04.04.yy 00.00.00"


def test_scan_in_the_background(edge, monkeypatch):
    from tracelode import facade

    f = EdfFile(edge["gaps"])
    done, total = f.scan_progress
    assert 0 <= done <= total == 3
    f.wait_for_annotations()
    assert f.annotations_ready and f.scan_progress == (3, 3)
    f.advise_time_range(0, 5)
    f.advise_willneed()
    monkeypatch.setattr(facade.eb, "parse_tals", lambda *a: 1 / 0)
    g = EdfFile(edge["gaps"])
    assert g.annotations == [] and g.record_onsets.tolist() == [0, 1, 2] and g.warnings[-1].startswith("annotation scan failed")
