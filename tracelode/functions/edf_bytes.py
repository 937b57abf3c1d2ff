"""Reading EDF headers and annotation bytes. Pure functions over ``bytes``; no Spark.

The layout is declared as tables of fields and walked generically; numbers are
checked against explicit grammars before conversion, because Python's own
``float``/``int`` accept more (``1_0``, inner blanks) than the format allows.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from tracelode import errors as E

# Fixed values of the file format: (name, offset, size, kind).
MAIN_FIELDS = (
    ("version", 0, 8, "text"),
    ("patient_id", 8, 80, "text"),
    ("recording_id", 88, 80, "text"),
    ("start_date", 168, 8, "text"),
    ("start_time", 176, 8, "text"),
    ("header_bytes", 184, 8, "unsigned"),
    ("reserved", 192, 44, "text"),
    ("num_records", 236, 8, "integer"),
    ("record_duration", 244, 8, "number"),
    ("num_signals", 252, 4, "unsigned"),
)
SIGNAL_FIELDS = (
    ("label", 0, 16, "text"),
    ("transducer", 16, 80, "text"),
    ("physical_dimension", 96, 8, "text"),
    ("physical_min", 104, 8, "number"),
    ("physical_max", 112, 8, "number"),
    ("digital_min", 120, 8, "int16"),
    ("digital_max", 128, 8, "int16"),
    ("prefiltering", 136, 80, "text"),
    ("num_samples", 216, 8, "unsigned"),
    ("reserved", 224, 32, "text"),
)
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
ANNOTATION_LABEL = "EDF Annotations"
MAIN_SIZE = 256
SIGNAL_SIZE = 256
EPSILON = 2.0**-52

# What each kind accepts, and how a refusal is worded.
_KINDS = {
    "unsigned": (re.compile(r"\+?[0-9]+"), int, "unsigned integer", (0, 2**64 - 1)),
    "integer": (re.compile(r"[+-]?[0-9]+"), int, "integer", (-(2**63), 2**63 - 1)),
    "int16": (re.compile(r"[+-]?[0-9]+"), int, "i16", (-(2**15), 2**15 - 1)),
    "number": (
        re.compile(r"[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)", re.I),
        float,
        "number",
        None,
    ),
}
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}


def quoted(text: str) -> str:
    """Text in double quotes with control characters escaped, as warnings show it."""
    return '"' + "".join(_ESCAPES.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in text) + '"'


def plain_number(x: float) -> str:
    """A float without a needless fraction: 900.0 is ``900``."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1e16:
        return ("-0" if str(x).startswith("-") else "0") if x == 0 else str(int(x))
    return format(x, "f").rstrip("0") if "e" in repr(x) and abs(x) < 1 else repr(x)


_BLANKS = "\t\n\v\f\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def clean(raw: bytes) -> str:
    """A field's text: lossy UTF-8 without surrounding white space (NULs stay)."""
    return raw.decode("utf-8", "replace").strip(_BLANKS)


def convert(kind: str, text: str):
    """The value of a field, or ValueError with the reason."""
    if kind == "text":
        return text
    grammar, make, noun, bounds = _KINDS[kind]
    if grammar.fullmatch(text):
        value = make(text)
        if bounds is None or bounds[0] <= value <= bounds[1]:
            return value
    raise ValueError(f"not a valid {noun}: {quoted(text)}")


@dataclass
class SignalMeta:
    label: str
    transducer: str
    physical_dimension: str
    physical_min: float
    physical_max: float
    digital_min: int
    digital_max: int
    prefiltering: str
    samples_per_record: int
    reserved: str
    gain: float
    offset: float
    is_annotation: bool
    byte_offset: int = 0

    def rate(self, record_duration: float) -> float:
        return self.samples_per_record / record_duration if record_duration else 0.0


@dataclass
class HeaderMeta:
    version: str
    patient_id: str
    recording_id: str
    start_datetime: dt.datetime | None
    start_date_raw: str
    start_time_raw: str
    header_bytes: int
    variant: str
    num_records_raw: int
    record_duration: float
    num_signals: int
    signals: list[SignalMeta] = field(default_factory=list)
    patient: dict = field(default_factory=dict)
    recording: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @property
    def num_records(self) -> int:
        return max(self.num_records_raw, 0)

    @property
    def duration(self) -> float:
        return self.num_records * self.record_duration

    @property
    def record_size(self) -> int:
        return sum(2 * s.samples_per_record for s in self.signals)

    @property
    def start_datetime_raw(self) -> str | None:
        return None if self.start_datetime else f"{self.start_date_raw} {self.start_time_raw}"

    def complete_records(self, file_size: int) -> int:
        """Records that lie wholly inside a file of this size."""
        if not self.record_size:
            return self.num_records
        return min(self.num_records, max(0, file_size - self.header_bytes) // self.record_size)


def variant_of(reserved: str) -> str:
    return next((v for v in ("EDF+C", "EDF+D") if reserved.startswith(v)), "EDF")


def start_of(date: str, time: str) -> dt.datetime | None:
    """``dd.mm.yy`` and ``hh.mm.ss``; two-digit years from 85 on are of the last century."""
    parts = date.split(".") + time.split(".")
    if date.count(".") != 2 or time.count(".") != 2 or not all(_KINDS["unsigned"][0].fullmatch(p) for p in parts):
        return None
    day, month, year, hour, minute, second = map(int, parts)
    try:
        return dt.datetime(year + (1900 if year >= 85 else 2000), month, day, hour, minute, second)
    except (ValueError, OverflowError):
        return None


def day_of(text: str) -> dt.date | None:
    """``DD-MMM-YYYY`` with an English month in any case."""
    m = re.fullmatch(r"(\+?[0-9]+)-([^-]+)-([+]?[0-9]+)", text)
    if not m or m[2].upper() not in MONTHS:
        return None
    try:
        return dt.date(int(m[3]), MONTHS.index(m[2].upper()) + 1, int(m[1]))
    except (ValueError, OverflowError):
        return None


def _known(token: str, spaced: bool = False) -> str | None:
    """A subfield's value; ``X`` says that it isn't known."""
    return None if token in ("X", "x") else token.replace("_", " ") if spaced else token


def _day_pair(token: str) -> tuple[dt.date | None, str | None]:
    if token in ("X", "x"):
        return None, None
    day = day_of(token)
    return day, None if day else token


def _rest(tokens: list[str]) -> str | None:
    return " ".join(tokens).replace("_", " ") if tokens else None


def patient_of(raw: str, variant: str, warnings: list[str]) -> dict:
    """Subfields of patient_id: code, sex, birthdate, name and whatever follows."""
    tokens = raw.split()
    if len(tokens) < 4:
        if variant != "EDF":
            warnings.append(f"patient_id has {len(tokens)} subfields (expected at least 4): {quoted(raw)}")
        return dict.fromkeys(("code", "sex", "birthdate", "birthdate_raw", "name", "additional"))
    sex = tokens[1].upper()
    if sex not in ("M", "F", "X") and variant != "EDF":
        warnings.append(f"unrecognized sex value: {quoted(sex)}")
    day, day_raw = _day_pair(tokens[2])
    return {
        "code": _known(tokens[0]),
        "sex": sex if sex in ("M", "F") else None,
        "birthdate": day,
        "birthdate_raw": day_raw,
        "name": _known(tokens[3], True),
        "additional": _rest(tokens[4:]),
    }


def recording_of(raw: str, variant: str, warnings: list[str]) -> dict:
    """Subfields of recording_id after the word ``Startdate``."""
    tokens = raw.split()
    if len(tokens) < 5 or tokens[0].lower() != "startdate":
        if variant != "EDF":
            warnings.append(f"recording_id does not match EDF+ format: {quoted(raw)}")
        return dict.fromkeys(("start_date", "start_date_raw", "admin_code", "technician", "equipment", "additional"))
    day, day_raw = _day_pair(tokens[1])
    return {
        "start_date": day,
        "start_date_raw": day_raw,
        "admin_code": _known(tokens[2]),
        "technician": _known(tokens[3], True),
        "equipment": _known(tokens[4], True),
        "additional": _rest(tokens[5:]),
    }


def _signal(block: bytes, i: int, n: int) -> SignalMeta:
    values = {}
    for name, offset, size, kind in SIGNAL_FIELDS:
        at = offset * n + size * i
        try:
            values[name] = convert(kind, clean(block[at : at + size]))
        except ValueError as why:
            raise E.InvalidSignalField(i, name, why) from None
    lo, hi, bottom, top = (values[k] for k in ("physical_min", "physical_max", "digital_min", "digital_max"))
    if bottom >= top:
        raise E.InvalidDigitalRange(i, bottom, top)
    if abs(lo - hi) < EPSILON:
        raise E.InvalidPhysicalRange(i, plain_number(lo), plain_number(hi))
    gain = (hi - lo) / (float(top) - float(bottom))
    values["samples_per_record"] = values.pop("num_samples")
    return SignalMeta(**values, gain=gain, offset=lo - gain * float(bottom), is_annotation=values["label"].startswith(ANNOTATION_LABEL))


def parse_header(data: bytes) -> HeaderMeta:
    """The header of a recording from its first bytes (main and signal headers)."""
    if len(data) < MAIN_SIZE:
        raise E.FileTooSmall(MAIN_SIZE, len(data))
    v = {}
    for name, offset, size, kind in MAIN_FIELDS:
        try:
            v[name] = convert(kind, clean(data[offset : offset + size]))
        except ValueError as why:
            raise E.InvalidHeaderField(name, why) from None
    n = v["num_signals"]
    if n == 0:
        raise E.NoSignals()
    size = MAIN_SIZE + SIGNAL_SIZE * n
    if v["header_bytes"] != size:
        raise E.HeaderSizeMismatch(v["header_bytes"], size)
    if len(data) < size:
        raise E.FileTooSmall(size, len(data))
    block = data[MAIN_SIZE:size]
    signals = [_signal(block, i, n) for i in range(n)]
    at = 0
    for s in signals:
        s.byte_offset, at = at, at + 2 * s.samples_per_record
    variant, warnings = variant_of(v["reserved"]), []
    patient = patient_of(v["patient_id"], variant, warnings)
    recording = recording_of(v["recording_id"], variant, warnings)
    return HeaderMeta(
        v["version"], v["patient_id"], v["recording_id"], start_of(v["start_date"], v["start_time"]), v["start_date"], v["start_time"],
        v["header_bytes"], variant, v["num_records"], v["record_duration"], n, signals, patient, recording, warnings,
    )


def read_header(path: str, opener=None) -> tuple[HeaderMeta, int]:
    """Header and size of a file, from no more bytes than the header has. opener gives a binary file that can seek."""
    try:
        with opener(path) if opener else open(path, "rb") as f:
            size = f.seek(0, 2)
            f.seek(0)
            head = f.read(MAIN_SIZE)
            count = clean(head[252:256])
            if len(head) == MAIN_SIZE and _KINDS["unsigned"][0].fullmatch(count):
                head += f.read(SIGNAL_SIZE * int(count))
    except OSError:
        raise E.FileOpenError(path) from None
    try:
        return parse_header(head), size
    except E.FileTooSmall as why:
        raise E.FileTooSmall(why.details[0], size) from None


# --- time-stamped annotation lists -------------------------------------------------

_UNTIL_ONSET = re.compile(rb"[^\x14\x15]*")
_UNTIL_SEP = re.compile(rb"[^\x14]*")
_UNTIL_TEXT = re.compile(rb"[^\x14\x00]*")
_DECIMAL = re.compile(r"[0-9]+(\.[0-9]+)?")


def _number_fault(text: str, what: str) -> str | None:
    """Why a decimal isn't well formed, or None."""
    if _DECIMAL.fullmatch(text):
        return None
    if not text:
        return f"empty {what}"
    if text[0] == "." or text[-1] == ".":
        return f"{what} cannot start or end with a dot: {quoted(text)}"
    odd = re.search(r"[^0-9.]", text)
    second = [m.start() for m in re.finditer(r"\.", text)][1:2]
    if second and (not odd or second[0] < odd.start()):
        return f"{what} has multiple decimal points: {quoted(text)}"
    return f"{what} contains invalid character: {quoted(text)}"


def onset_of(text: str) -> float:
    """Seconds of a signed decimal; ValueError says what is wrong with it."""
    if not text:
        raise ValueError("empty onset")
    if text[0] not in "+-":
        raise ValueError(f"onset must start with + or -, got {quoted(text)}")
    if fault := _number_fault(text[1:], "onset"):
        raise ValueError(fault)
    return float(text)


def duration_of(text: str) -> float | None:
    """Seconds of an unsigned decimal, or None for anything else."""
    return None if _number_fault(text, "duration") else float(text)


class _Bytes:
    """A reading position in a channel's bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.stop = data, 0, None

    def take(self, pattern: re.Pattern) -> bytes:
        """What the pattern spans; the byte that ended it is passed and kept in ``stop``."""
        m = pattern.match(self.data, self.at)
        self.stop = self.data[m.end()] if m.end() < len(self.data) else None
        self.at = m.end() + (self.stop is not None)
        return m.group()

    @property
    def done(self) -> bool:
        return self.at >= len(self.data)


def parse_tals(data: bytes, record: int) -> tuple[list[tuple[float, float | None, str]], list[str]]:
    """(onset, duration, text) of a channel in one record, in order, and the warnings."""
    items, warnings, src = [], [], _Bytes(data)
    while True:
        while not src.done and data[src.at] == 0:
            src.at += 1
        if src.done:
            return items, warnings
        began = src.at
        where = f"at record {record}, byte offset {began}"
        try:
            items += _one_tal(src, where)
        except ValueError as why:
            warnings.append(str(why))
            nul = data.find(b"\0", src.at)
            src.at = len(data) if nul < 0 else nul + 1


def _one_tal(src: _Bytes, where: str) -> list[tuple[float, float | None, str]]:
    head = src.take(_UNTIL_ONSET).decode("utf-8", "replace")
    timed = src.stop == 0x15
    if not head:
        raise ValueError(f"empty onset in TAL {where}")
    try:
        onset = onset_of(head)
    except ValueError as why:
        raise ValueError(f"invalid TAL onset {where}: {why}") from None
    duration = duration_of(src.take(_UNTIL_SEP).decode("utf-8", "replace")) if timed else None
    texts = []
    while not src.done and src.data[src.at] != 0:
        raw = src.take(_UNTIL_TEXT)
        try:
            texts.append(raw.decode("utf-8"))
        except UnicodeDecodeError:
            raise ValueError(f"non-UTF-8 annotation text {where}") from None
        if src.stop == 0:
            break
    else:
        src.at += not src.done
    return [(onset, duration, t) for t in texts or [""]]
