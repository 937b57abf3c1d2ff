"""Writes EDF files: for fixtures, and to stage recordings made from tables."""

from __future__ import annotations

import shutil

import numpy as np

from tracelode.sources.files import create_file, delete, open_file


def _cell(value, size: int) -> bytes:
    raw = value if isinstance(value, bytes) else str(value).encode("utf-8")
    if len(raw) > size:
        raise ValueError(f"{value!r} is longer than {size} bytes")
    return raw.ljust(size)


def signal(label="EEG", spr=256, pmin="-3200", pmax="3200", dmin="-32768", dmax="32767", transducer="", dimension="uV", prefiltering="", reserved="") -> dict:
    """The header fields of one signal."""
    return dict(label=label, transducer=transducer, dimension=dimension, pmin=pmin, pmax=pmax, dmin=dmin, dmax=dmax, prefiltering=prefiltering, spr=spr, reserved=reserved)


def header(signals, num_records, duration="1", patient="X X X X", recording="Startdate X X X X", date="01.01.00", time="00.00.00", reserved="EDF+C", header_bytes=None, version="0") -> bytes:
    n = len(signals)
    main = [(version, 8), (patient, 80), (recording, 80), (date, 8), (time, 8), (256 + 256 * n if header_bytes is None else header_bytes, 8), (reserved, 44), (num_records, 8), (duration, 8), (n, 4)]
    fields = [("label", 16), ("transducer", 80), ("dimension", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("prefiltering", 80), ("spr", 8), ("reserved", 32)]
    return b"".join(_cell(v, k) for v, k in main) + b"".join(_cell(s[f], k) for f, k in fields for s in signals)


def tal(onset: str, *texts: str, duration: str | None = None) -> bytes:
    """One time-stamped annotation list; no text makes it a time-keeping one."""
    head = onset.encode() + (b"\x15" + duration.encode() if duration is not None else b"")
    return head + b"\x14" + b"".join(t.encode() + b"\x14" for t in texts or ("",)) + b"\0"


def records(channels) -> bytes:
    """Data records from per-signal arrays (records x samples) of int16 or lists of bytes."""
    parts = []
    for c in channels:
        if isinstance(c, np.ndarray):
            parts.append(np.ascontiguousarray(c, dtype="<i2").view(np.uint8).reshape(len(c), -1))
        else:
            width = max(len(b) for b in c)
            width += width % 2
            parts.append(np.frombuffer(b"".join(b.ljust(width, b"\0") for b in c), np.uint8).reshape(len(c), -1))
    return np.concatenate(parts, axis=1).tobytes()


def write(path: str, head: bytes, body: bytes) -> str:
    with create_file(path) as f:
        f.write(head)
        f.write(body)
    return path


def join(path: str, head: bytes, parts: list[str]) -> str:
    """A file of the head and the parts' bytes; a part is deleted when it's in."""
    with create_file(path) as f:
        f.write(head)
        for part in parts:
            with open_file(part) as g:
                shutil.copyfileobj(g, f, 2**20)
            delete(part)
    return path
