import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode import errors as E
from tracelode.functions import edf_bytes as eb
from tracelode.sources import writer as w


def head(n=1, **kw):
    return w.header([w.signal()] * n, kw.pop("num", 10), **kw)


def test_minimal_header():
    h = eb.parse_header(head(2))
    assert (h.num_signals, h.num_records, h.variant, h.header_bytes, h.duration) == (2, 10, "EDF+C", 768, 10.0)
    assert h.record_size == 2 * 2 * 256 and h.signals[1].byte_offset == 512 and not h.warnings


@pytest.mark.parametrize("date,year", [("01.01.85", 1985), ("01.01.84", 2084), ("01.01.99", 1999), ("01.01.00", 2000), ("1.1.2010", 3910)])
def test_year_pivot(date, year):
    assert eb.start_of(date, "00.00.00").year == year


@pytest.mark.parametrize("date,time", [("04.04.yy", "00.00.00"), ("31.02.00", "00.00.00"), ("01.01.00", "25.00.00"), ("01.01", "00.00.00"), ("01. 1.00", "00.00.00")])
def test_unreadable_start_stays_raw(date, time):
    h = eb.parse_header(head(date=date, time=time))
    assert h.start_datetime is None and h.start_datetime_raw == f"{date} {time}"


def test_patient_and_recording():
    warnings = []
    p = eb.patient_of("MCH_1 F 02-MAY-1951 Haagse_Harry left_handed x", "EDF+C", warnings)
    assert p == {"code": "MCH_1", "sex": "F", "birthdate": dt.date(1951, 5, 2), "birthdate_raw": None, "name": "Haagse Harry", "additional": "left handed x"}
    r = eb.recording_of("startdate 31-FEB-2002 A_1 t_1 X", "EDF+C", warnings)
    assert r["start_date"] is None and r["start_date_raw"] == "31-FEB-2002" and r["admin_code"] == "A_1" and r["technician"] == "t 1" and r["equipment"] is None
    assert not warnings
    eb.patient_of("a b", "EDF", warnings)
    assert not warnings
    eb.patient_of("a b", "EDF+C", warnings)
    eb.patient_of("a q X X", "EDF+D", warnings)
    eb.recording_of("none", "EDF+D", warnings)
    assert warnings == ['patient_id has 2 subfields (expected at least 4): "a b"', 'unrecognized sex value: "Q"', 'recording_id does not match EDF+ format: "none"']


@pytest.mark.parametrize("make,kind", [
    (lambda: b"x" * 100, E.FileTooSmall),
    (lambda: w.header([], 1), E.NoSignals),
    (lambda: head(header_bytes=999), E.HeaderSizeMismatch),
    (lambda: head(2)[:600], E.FileTooSmall),
    (lambda: head(num="1_0"), E.InvalidHeaderField),
    (lambda: head(duration="1d"), E.InvalidHeaderField),
    (lambda: w.header([w.signal(dmin="40000")], 1), E.InvalidSignalField),
    (lambda: w.header([w.signal(dmin="1.0")], 1), E.InvalidSignalField),
    (lambda: w.header([w.signal(dmin="5", dmax="5")], 1), E.InvalidDigitalRange),
    (lambda: w.header([w.signal(pmin="5", pmax="5")], 1), E.InvalidPhysicalRange),
])
def test_typed_errors(make, kind):
    with pytest.raises(kind) as e:
        eb.parse_header(make())
    assert isinstance(e.value, ValueError) and str(e.value)


def test_error_messages():
    with pytest.raises(E.HeaderSizeMismatch, match="header declares 999 header bytes, but file is only 512 bytes"):
        eb.parse_header(head(header_bytes=999))
    with pytest.raises(E.InvalidHeaderField, match='invalid header field `num_records`: not a valid integer: "x"'):
        eb.parse_header(head(num="x"))
    with pytest.raises(OSError, match="failed to open file: /nowhere"):
        eb.read_header("/nowhere")


def test_number_grammar():
    for good in ("+5", ".5", "5.", "1e5", "inf", "-NaN"):
        eb.convert("number", good)
    for bad in ("1_0", "", "1 0", "0x1", "1d", "--1", "10\0"):
        with pytest.raises(ValueError):
            eb.convert("number", bad)


def test_gain_goldens():
    s = eb.parse_header(w.header([w.signal(pmin="-1000", pmax="1000")], 1)).signals[0]
    assert s.gain * 3276 + s.offset == pytest.approx(99.99237049, abs=1e-6)
    s = eb.parse_header(w.header([w.signal(pmin="100", pmax="-100", dmin="-100", dmax="100")], 1)).signals[0]
    assert s.gain == -1.0 and s.gain * 10 + s.offset == -10.0


def test_lists():
    items, warnings = eb.parse_tals(w.tal("+0") + w.tal("-0.5", "a", "b", duration="1.5") + b"\0" * 9, 0)
    assert items == [(0.0, None, ""), (-0.5, 1.5, "a"), (-0.5, 1.5, "b")] and not warnings


def test_list_faults_and_resync():
    items, warnings = eb.parse_tals(b"0.5\x14bad\x14\0" + w.tal("+1", "good"), 3)
    assert items == [(1.0, None, "good")]
    assert warnings == ['invalid TAL onset at record 3, byte offset 0: onset must start with + or -, got "0.5"']
    assert eb.parse_tals(b"+1.\x14x\14\0", 0)[1] == ['invalid TAL onset at record 0, byte offset 0: onset cannot start or end with a dot: "1."']
    assert eb.parse_tals(b"+1.2.3\x14x\14\0", 0)[1] == ['invalid TAL onset at record 0, byte offset 0: onset has multiple decimal points: "1.2.3"']
    # text that ends in NUL and isn't UTF-8 takes the next list with it
    items, warnings = eb.parse_tals(b"+1\x14\xff\0" + w.tal("+2", "eaten") + w.tal("+3", "seen"), 0)
    assert items == [(3.0, None, "seen")] and warnings == ["non-UTF-8 annotation text at record 0, byte offset 0"]
    assert eb.parse_tals(b"+1\x15x\x14t\x14\0", 0)[0] == [(1.0, None, "t")]  # a bad duration is none
    assert eb.parse_tals(b"+1\x14open", 0)[0] == [(1.0, None, "open")]
    assert eb.parse_tals(b"+1\x14\x14\0", 0)[0] == eb.parse_tals(b"+1\x14\0", 0)[0] == [(1.0, None, "")]


@given(st.binary(max_size=300))
@settings(max_examples=300, deadline=None)
def test_any_bytes(data):
    items, warnings = eb.parse_tals(data, 0)
    assert all(isinstance(x[2], str) for x in items) and all(isinstance(x, str) for x in warnings)


@given(st.decimals(min_value=-9999, max_value=9999, places=3), st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0\x14\x15"), min_size=1), min_size=1, max_size=3), st.binary(max_size=20))
@settings(max_examples=200, deadline=None)
def test_round_trip_before_garbage(onset, texts, garbage):
    items, _ = eb.parse_tals(w.tal(f"{onset:+f}", *texts) + b"\x01" + garbage, 0)
    assert [x[2] for x in items[: len(texts)]] == texts and items[0][0] == float(onset)


def test_plain_numbers():
    assert [eb.plain_number(x) for x in (900.0, 0.5, float("inf"), float("nan"))] == ["900", "0.5", "inf", "NaN"]
    assert eb.plain_number(900.0) == "900" and eb.quoted('a"\n') == '"a\\"\\n"'
