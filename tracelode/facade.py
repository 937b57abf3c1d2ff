"""Array-like access to one recording: EdfFile, Signal, ArrayProxy, Annotation.

For interactive reads of single samples, slices and pages, where a Spark job's start-up
would dominate: ranges are sliced from a memory map with NumPy on the driver. Headers and
annotation lists go through the same byte functions as the Spark source, and ``to_spark``
gives the file's views as DataFrames for everything larger.
"""

from __future__ import annotations

import mmap
import operator
import threading
from dataclasses import dataclass

import numpy as np

from tracelode import errors as E
from tracelode.functions import edf_bytes as eb


@dataclass(frozen=True)
class Annotation:
    onset: float
    duration: float | None
    text: str

    def __repr__(self):
        duration = "" if self.duration is None else f", duration={eb.plain_number(self.duration)}"
        return f"Annotation(onset={eb.plain_number(self.onset)}{duration}, text={eb.quoted(self.text)})"


class _Data:
    """The records of a file: bounds-checked ranges of a signal, and the index of its annotations."""

    def __init__(self, path: str):
        self.path = path
        self.head, self.size = eb.read_header(path)
        h = self.head
        self.complete = h.complete_records(self.size)
        try:
            self.bytes = np.memmap(path, np.uint8, "r")
        except (OSError, ValueError):
            raise E.MapFailedError(path) from None
        self.block = np.asarray(self.bytes[h.header_bytes : h.header_bytes + self.complete * h.record_size]).reshape(self.complete, h.record_size) if h.record_size else np.zeros((self.complete, 0), np.uint8)
        self.cube = self.block.view("<i2") if h.record_size else self.block.view(np.int16)  # records x samples of all signals
        self.gains, self.offsets = np.array([s.gain for s in h.signals]), np.array([s.offset for s in h.signals])
        # Of each signal its samples in all, its samples in a record, and where a record has them.
        self.lengths = [h.num_records * s.samples_per_record for s in h.signals]
        self.scales = [(s.gain, s.offset) for s in h.signals]
        self.item = self.cube.item
        self.widths, self.begins = [s.samples_per_record for s in h.signals], [s.byte_offset // 2 for s in h.signals]
        self._index, self.scanned, self._thread = None, 0, None
        self.listed = any(s.is_annotation for s in h.signals)
        if self.listed and self.complete:
            self._thread = threading.Thread(target=self._fill, daemon=True)
            self._thread.start()

    def _fill(self):
        try:
            self._index = self._scan()
        except Exception as why:  # noqa: BLE001 - whatever it was, onsets are calculated and a warning tells it
            n, d = self.head.num_records, self.head.record_duration
            self._index = [], np.arange(n) * d, 0.0, [f"annotation scan failed: {why}"]

    def length(self, k: int) -> int:
        return self.lengths[k]

    def sample(self, k: int, i: int) -> float:
        """Physical value of one sample inside the signal."""
        r, at = divmod(i, self.widths[k])
        if r >= self.complete:
            raise E.RecordOutOfRange(r, self.head.num_records)
        gain, offset = self.scales[k]
        return gain * self.item(r, self.begins[k] + at) + offset

    def digital(self, k: int, start: int, end: int) -> np.ndarray:
        """int16 samples [start, end); typed errors for what lies outside."""
        n, s = self.length(k), self.head.signals[k]
        if end > n:
            raise E.SampleOutOfRange(max(end - 1, 0), n)
        if start > end:
            raise E.SampleOutOfRange(start, n)
        if start == end:
            return np.zeros(0, np.int16)
        spr = s.samples_per_record
        first, last = start // spr, (end - 1) // spr
        if last >= self.complete:
            raise E.RecordOutOfRange(max(first, self.complete), self.head.num_records)
        at = self.begins[k]
        flat = self.cube[first : last + 1, at : at + spr].reshape(-1)
        return flat[start - first * spr : end - first * spr]

    def physical(self, k: int, start: int, end: int) -> np.ndarray:
        out = self.digital(k, start, end) * self.gains[k]
        out += self.offsets[k]
        return out

    def neighbours(self, wanted: list[int], start: int, end: int) -> np.ndarray | None:
        """Physical values [start, end) of signals that lie side by side and have as many samples, in one go; None for others."""
        k, n = wanted[0], len(wanted)
        spr = self.widths[k]
        if not 0 <= start < end <= self.lengths[k] or wanted != list(range(k, k + n)) or self.widths[k : k + n] != [spr] * n:
            return None
        first, last = start // spr, (end - 1) // spr
        if last >= self.complete:
            return None
        at = self.begins[k]
        cut = self.cube[first : last + 1, at : at + n * spr].reshape(last + 1 - first, n, spr).transpose(1, 0, 2)
        out = np.multiply(cut, self.gains[k : k + n, None, None], order="C").reshape(n, -1)
        out += self.offsets[k : k + n, None]
        return out[:, start - first * spr : end - first * spr]

    def record(self, r: int) -> bytes:
        if r >= self.complete or r < 0:
            raise E.RecordOutOfRange(r, self.head.num_records)
        return self.block[r].tobytes()

    @property
    def index(self) -> tuple[list[Annotation], np.ndarray, float, list[str]]:
        """(annotations, record onsets, offset of the start, scan warnings)."""
        if self._thread is not None:
            self._thread.join()
        if self._index is None:
            self._fill()
        return self._index

    @property
    def progress(self) -> tuple[int, int]:
        """(records scanned, records to scan), without waiting."""
        if self._index is not None or not self.listed:
            n = len(self.index[1])
            return n, n
        return self.scanned, self.complete

    def _scan(self):
        h = self.head
        channels = [s for s in h.signals if s.is_annotation]
        if not channels:
            return [], np.arange(h.num_records) * h.record_duration, 0.0, []
        found, onsets, warnings = [], [], []
        for r in range(self.complete):
            keeping = None
            for s in channels:
                items, faults = eb.parse_tals(self.block[r, s.byte_offset : s.byte_offset + 2 * s.samples_per_record].tobytes(), r)
                warnings += faults
                if keeping is None and items and not items[0][2]:
                    keeping = items[0][0]
                found += [x for x in items if x[2]]
            if keeping is None and h.variant != "EDF":
                warnings.append(f"missing time-keeping annotation in record {r}, using calculated onset")
            onsets.append(r * h.record_duration if keeping is None else keeping)
            self.scanned = r + 1
        if self.complete < h.num_records:
            warnings.append(f"data truncated at record {self.complete}: expected {h.header_bytes + (self.complete + 1) * h.record_size} bytes, file has {self.size}")
        start = onsets[0] if onsets else 0.0
        at = np.array(onsets) - start
        gap, d = np.diff(at), h.record_duration
        if d > 0 and h.variant != "EDF":
            uneven = np.abs(gap - d) > 0.001 if h.variant == "EDF+C" else gap < d - 0.001
            for i in np.flatnonzero(uneven):
                shown = f"{gap[i]:.6f}s"
                warnings.append(f"EDF+C record {i + 1}: expected onset gap {eb.plain_number(d)}s, got {shown}" if h.variant == "EDF+C" else f"EDF+D record {i + 1}: onset gap {shown} is less than record duration {eb.plain_number(d)}s")
        return [Annotation(t - start, dur, text) for t, dur, text in sorted(found, key=lambda x: x[0])], at, start, warnings

    def times(self, k: int, start: int, end: int) -> np.ndarray:
        """Seconds of the samples [start, end), gaps between records included. No bounds are checked."""
        s, h = self.head.signals[k], self.head
        i = np.arange(start, end)
        spr = max(s.samples_per_record, 1)
        r = i // spr
        onset = r * h.record_duration
        if h.variant == "EDF+D":
            scan = self.index[1]
            inside = r < len(scan)
            onset = np.where(inside, scan[np.minimum(r, max(len(scan) - 1, 0))], onset) if len(scan) else onset
        with np.errstate(divide="ignore", invalid="ignore"):
            return onset + (i % spr) / np.float64(s.rate(h.record_duration))


def _wrap(i: int, n: int, what: str) -> int:
    if not -n <= i < n:
        raise IndexError(what.format(i, n))
    return i % n


class Signal:
    """One signal; ``s[i]``, ``s[a:b]`` and ``s[a:b:k]`` give physical values."""

    def __init__(self, data: _Data, k: int):
        if not 0 <= k < data.head.num_signals:
            raise E.SignalOutOfRange(k, data.head.num_signals)
        self._d, self.index, self._m = data, k, data.head.signals[k]

    label = property(lambda self: self._m.label)
    transducer = property(lambda self: self._m.transducer)
    physical_dimension = property(lambda self: self._m.physical_dimension)
    prefiltering = property(lambda self: self._m.prefiltering)
    physical_min = property(lambda self: self._m.physical_min)
    physical_max = property(lambda self: self._m.physical_max)
    digital_min = property(lambda self: self._m.digital_min)
    digital_max = property(lambda self: self._m.digital_max)
    samples_per_record = property(lambda self: self._m.samples_per_record)
    reserved = property(lambda self: self._m.reserved)
    gain = property(lambda self: self._m.gain)
    offset = property(lambda self: self._m.offset)
    is_annotation = property(lambda self: self._m.is_annotation)
    sample_rate = property(lambda self: self._m.rate(self._d.head.record_duration))
    num_samples = property(lambda self: len(self))

    def __len__(self):
        return self._d.length(self.index)

    def __repr__(self):
        return f"Signal(label={eb.quoted(self.label)}, samples={len(self)}, rate={eb.plain_number(self.sample_rate)}Hz)"

    def __getitem__(self, key):
        n = self._d.lengths[self.index]
        if type(key) is int and 0 <= key < n:
            return self._d.sample(self.index, key)
        if isinstance(key, slice):
            start, stop, step = key.indices(n)
            picked = range(start, stop, step)
            if not len(picked):
                return np.zeros(0)
            low, high = min(picked[0], picked[-1]), max(picked[0], picked[-1])
            part = self._d.physical(self.index, low, high + 1)
            return part[::step] if step > 0 else part[::-1][::-step]
        try:
            i = operator.index(key)
        except TypeError:
            raise IndexError("index must be int or slice") from None
        if i < 0 or i >= n:
            i = _wrap(i, n, "index {} out of range for signal with {} samples")
        return self._d.sample(self.index, i)

    def to_numpy(self) -> np.ndarray:
        return self._d.physical(self.index, 0, len(self))

    def to_digital(self) -> np.ndarray:
        return self._d.digital(self.index, 0, len(self)).copy()

    def times(self) -> np.ndarray:
        return self.read_times(0, len(self))

    def read_times(self, start: int, end: int) -> np.ndarray:
        return self._d.times(self.index, start, end)

    def read_digital(self, start: int, end: int) -> np.ndarray:
        return self._d.digital(self.index, start, end)


class ArrayProxy:
    """Signals of one rate as rows, samples as columns; ``p[rows, columns]`` reads physical values."""

    def __init__(self, data: _Data, wanted: list[int]):
        h = data.head
        for k in wanted:
            if not 0 <= k < h.num_signals:
                raise E.SignalOutOfRange(k, h.num_signals)
        rates = [h.signals[k].rate(h.record_duration) for k in wanted]
        for k, rate in zip(wanted, rates):
            if abs(rate - rates[0]) > 1e-9:
                raise E.MixedSampleRates(f"signal {wanted[0]} has rate {eb.plain_number(rates[0])}Hz but signal {k} has rate {eb.plain_number(rate)}Hz. Use signal_indices_by_rate() to group signals by rate.")
        self._d, self.signal_indices = data, list(wanted)
        self.sample_rate = rates[0] if rates else 0.0
        self.shape = (len(wanted), data.length(wanted[0]) if wanted else 0)

    def __repr__(self):
        return f"ArrayProxy(shape=({self.shape[0]}, {self.shape[1]}), rate={eb.plain_number(self.sample_rate)}Hz)"

    def _rows(self, spec) -> tuple[list[int], bool]:
        n = self.shape[0]
        if isinstance(spec, slice):
            start, stop, step = spec.indices(n)
            if step != 1:
                raise ValueError("step != 1 not supported for signal axis")
            return list(range(start, stop)), False
        out_of = "index {} out of range for axis with size {}"
        if isinstance(spec, list):
            return [_wrap(operator.index(i), n, out_of) for i in spec], False
        try:
            return [_wrap(operator.index(spec), n, out_of)], True
        except TypeError:
            raise TypeError("signal index must be int, slice, or list") from None

    def _columns(self, spec) -> tuple[int, int, bool]:
        n = self.shape[1]
        if isinstance(spec, slice):
            start, stop, step = spec.indices(n)
            if step != 1:
                raise ValueError("step != 1 not supported in ArrayProxy")
            return start, max(start, stop), False
        try:
            i = _wrap(operator.index(spec), n, "index {} out of range for axis with size {}")
        except TypeError:
            raise TypeError("sample index must be int or slice") from None
        return i, i + 1, True

    def _read(self, key, how):
        if not isinstance(key, tuple) or len(key) != 2:
            raise IndexError("ArrayProxy requires exactly 2 indices: [signal, sample]")
        (rows, one_row), (start, end, one_column) = self._rows(key[0]), self._columns(key[1])
        parts = [how(self.signal_indices[r], start, end) for r in rows]
        if one_row:
            return parts[0][0].item() if one_column else parts[0]
        grid = np.stack(parts) if parts else np.zeros((0, end - start))
        return grid[:, 0] if one_column else grid

    def __getitem__(self, key):
        return self._read(key, self._d.physical)

    def read_digital(self, key):
        """The same addressing on int16 samples."""
        return self._read(key, self._d.digital)


class EdfFile:
    """An EDF, EDF+C or EDF+D file."""

    def __init__(self, path: str):
        self._d = _Data(str(path))
        self._ordinary = [k for k, s in enumerate(self._d.head.signals) if not s.is_annotation]

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        return None  # the file stays usable

    def __repr__(self):
        h = self._d.head
        return f"EdfFile(variant={eb.quoted(h.variant)}, signals={h.num_signals}, records={h.num_records}, duration={eb.plain_number(h.duration)}s)"

    num_signals = property(lambda self: self._d.head.num_signals)
    num_records = property(lambda self: self._d.head.num_records)
    record_duration = property(lambda self: self._d.head.record_duration)
    duration = property(lambda self: self._d.head.duration)
    variant = property(lambda self: self._d.head.variant)
    version = property(lambda self: self._d.head.version)
    patient_id = property(lambda self: self._d.head.patient_id)
    recording_id = property(lambda self: self._d.head.recording_id)
    start_datetime = property(lambda self: self._d.head.start_datetime or self._d.head.start_datetime_raw)
    patient_name = property(lambda self: self._d.head.patient["name"])
    patient_code = property(lambda self: self._d.head.patient["code"])
    patient_sex = property(lambda self: self._d.head.patient["sex"])
    patient_birthdate = property(lambda self: self._d.head.patient["birthdate"] or self._d.head.patient["birthdate_raw"])
    patient_additional = property(lambda self: self._d.head.patient["additional"])
    recording_start_date = property(lambda self: self._d.head.recording["start_date"] or self._d.head.recording["start_date_raw"])
    admin_code = property(lambda self: self._d.head.recording["admin_code"])
    technician = property(lambda self: self._d.head.recording["technician"])
    equipment = property(lambda self: self._d.head.recording["equipment"])
    recording_additional = property(lambda self: self._d.head.recording["additional"])
    annotations = property(lambda self: list(self._d.index[0]))
    warnings = property(lambda self: self._d.head.warnings + self._d.index[3])
    record_onsets = property(lambda self: self._d.index[1])
    starttime_subsecond = property(lambda self: self._d.index[2])
    annotations_ready = property(lambda self: self._d._index is not None or not self._d.listed)
    record_size = property(lambda self: self._d.head.record_size)
    data_offset = property(lambda self: self._d.head.header_bytes)

    @property
    def scan_progress(self) -> tuple[int, int]:
        """(done, total) of the scan in the background, without waiting for it."""
        return self._d.progress

    def wait_for_annotations(self) -> None:
        self._d.index  # noqa: B018

    def header(self) -> dict:
        names = ("version", "patient_id", "recording_id", "num_signals", "num_records", "record_duration", "duration", "variant")
        return {n: getattr(self, n) for n in names}

    def signal(self, which) -> Signal:
        """By index, or by label: the first signal with exactly that label."""
        if isinstance(which, str):
            for k, s in enumerate(self._d.head.signals):
                if s.label == which:
                    return Signal(self._d, k)
            raise E.SignalNotFound(which)
        try:
            k = operator.index(which)
        except TypeError:
            k = -1
        if k < 0:
            raise TypeError("signal() argument must be int or str")
        return Signal(self._d, k)

    def signal_labels(self) -> list[str]:
        return [s.label for s in self._d.head.signals]

    def ordinary_signal_indices(self) -> list[int]:
        return list(self._ordinary)

    def signal_indices_by_rate(self) -> dict[int, list[int]]:
        groups: dict[int, list[int]] = {}
        for k in self.ordinary_signal_indices():
            groups.setdefault(int(np.floor(self._d.head.signals[k].rate(self.record_duration) + 0.5)), []).append(k)
        return groups

    def array_proxy(self, signal_indices: list[int] | None = None) -> ArrayProxy:
        return ArrayProxy(self._d, self.ordinary_signal_indices() if signal_indices is None else list(signal_indices))

    def _page(self, t0: float, t1: float, signals, how) -> list[np.ndarray]:
        wanted = self._ordinary if signals is None else list(signals)
        d, h = self._d, self._d.head
        for k in wanted:
            if not 0 <= k < h.num_signals:
                raise E.SignalOutOfRange(k, h.num_signals)
        out, at = [], 0
        while at < len(wanted):
            k = wanted[at]
            rate = h.signals[k].rate(h.record_duration)
            a, b = self._bound(t0, rate), min(self._bound(t1, rate), d.lengths[k])
            # Signals side by side with as many samples are read in one go.
            size = 1
            while how == d.physical and at + size < len(wanted) and wanted[at + size] == k + size and d.widths[k + size] == d.widths[k]:
                size += 1
            together = d.neighbours(wanted[at : at + size], a, b) if size > 1 else None
            if together is not None:
                out += list(together)
            else:
                size = 1
                out.append(how(k, a, b) if a < b else how(k, 0, 0))
            at += size
        return out

    @staticmethod
    def _bound(t: float, rate: float) -> int:
        x = max(t, 0.0) * rate if t == t else 0.0
        return 0 if x != x else int(min(x, 2.0**62))

    def read_page(self, t0: float, t1: float, signals: list[int] | None = None) -> list[np.ndarray]:
        return self._page(t0, t1, signals, self._d.physical)

    def read_page_digital(self, t0: float, t1: float, signals: list[int] | None = None) -> list[np.ndarray]:
        return self._page(t0, t1, signals, self._d.digital)

    def record_bytes(self, r: int) -> bytes:
        return self._d.record(r)

    def data(self) -> bytes:
        return self._d.bytes.tobytes()

    def advise_time_range(self, t0: float, t1: float) -> None:
        """Tells the operating system to read the records of a time range ahead."""
        h, d = self._d.head, self._d.head.record_duration
        if d > 0 and t1 > t0:
            first, last = (min(max(int(t / d), 0), self._d.complete) for t in (t0, min(t1, 2.0**40)))
            self.advise_willneed(h.header_bytes + first * h.record_size, (last + 1 - first) * h.record_size)

    def advise_willneed(self, start: int = 0, length: int | None = None) -> None:
        """The same for a range of bytes, by default the whole file; without effect where the system has no such hint."""
        mapped = getattr(self._d.bytes, "_mmap", None)
        if mapped is None or not hasattr(mmap, "MADV_WILLNEED"):
            return
        at = max(start, 0) // mmap.PAGESIZE * mmap.PAGESIZE
        n = min(len(mapped), start + length if length is not None else len(mapped)) - at
        if n > 0:
            mapped.madvise(mmap.MADV_WILLNEED, at, n)

    def to_spark(self, spark, view: str = "chunks", **options):
        """The file as one of the views of the edf source."""
        from tracelode.sources.edf import read_edf

        return read_edf(spark, self._d.path, view, **options)
