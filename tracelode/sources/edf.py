"""The ``edf`` Spark data source.

``spark.read.format("edf").option("view", V).load(paths)`` with V one of

* ``recordings`` – one row per file, only headers are read;
* ``signals`` – one row per signal, only headers are read;
* ``chunks`` – one row per record and signal with its int16 samples as an array, and the record's onset;
* ``tals`` – annotation elements, records with their onsets, scan warnings and onset faults (column ``kind``).

A file is cut into byte-proportional slices, not opened on the driver: a task gets
(path, slice, slices) and turns them into a record range with the header that it
reads itself, so planning a million files costs a directory listing. Small files are
packed into shared tasks. Filters on ``path``, ``record_idx``, ``signal_idx`` and (of ``tals``) ``kind`` are
pushed down: whole files, record ranges and channels are skipped before decoding. Of ``chunks`` the options
``t0`` and ``t1`` leave the records of a page (flat sample times), ``from_time`` and ``to_time`` those of a true-time
window; a task turns them into records with its file's header, and with record onsets that it bisects.

All that a row needs to know of its file comes with it – the first record's onset, the record before –, so that
onsets, annotations, gaps and faults need no join. A slice reads one record more for that.

Paths (local ones, or URIs that pyarrow's file systems know) must be visible to all executors. ``mode`` is FAILFAST (default) or PERMISSIVE;
the latter skips unreadable files and reports them in the ``warnings`` operator; records whose lists can't be read have calculated onsets
(from the file's start, ``missing``, the failure as text) and a warning. With FAILFAST such a failure ends the query.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tracelode.errors import MapFailedError, TraceError
from tracelode.functions import edf_bytes as eb
from tracelode.sources.files import expand, open_file

PATIENT = "STRUCT<code STRING, sex STRING, birthdate DATE, birthdate_raw STRING, name STRING, additional STRING>"
RECORDING = "STRUCT<start_date DATE, start_date_raw STRING, admin_code STRING, technician STRING, equipment STRING, additional STRING>"
SCHEMAS = {
    "recordings": "path STRING, version STRING, patient_id STRING, recording_id STRING, start_datetime TIMESTAMP_NTZ, start_datetime_raw STRING, header_bytes BIGINT, variant STRING, "
    "num_records_raw BIGINT, num_records BIGINT, complete_records BIGINT, record_duration DOUBLE, duration DOUBLE, num_signals INT, record_size BIGINT, file_size BIGINT, "
    f"has_annotations BOOLEAN, patient {PATIENT}, recording {RECORDING}, header_warnings ARRAY<STRING>, error STRING",
    "signals": "path STRING, signal_idx INT, label STRING, transducer STRING, physical_dimension STRING, physical_min DOUBLE, physical_max DOUBLE, digital_min SMALLINT, digital_max SMALLINT, "
    "prefiltering STRING, samples_per_record BIGINT, reserved STRING, gain DOUBLE, offset DOUBLE, is_annotation BOOLEAN, sample_rate DOUBLE, num_samples BIGINT, byte_offset BIGINT",
    "chunks": "path STRING, record_idx BIGINT, signal_idx INT, digital ARRAY<SMALLINT>, gain DOUBLE, offset DOUBLE, samples_per_record BIGINT, sample_rate DOUBLE, record_duration DOUBLE, is_annotation BOOLEAN, onset DOUBLE",
    "tals": "path STRING, record_idx BIGINT, signal_idx INT, elem_idx INT, kind STRING, onset DOUBLE, duration DOUBLE, text STRING, variant STRING, record_duration DOUBLE, start DOUBLE, before DOUBLE, missing BOOLEAN",
}
ARROW = {
    "chunks": pa.schema([("path", pa.string()), ("record_idx", pa.int64()), ("signal_idx", pa.int32()), ("digital", pa.list_(pa.int16())), ("gain", pa.float64()), ("offset", pa.float64()), ("samples_per_record", pa.int64()), ("sample_rate", pa.float64()), ("record_duration", pa.float64()), ("is_annotation", pa.bool_()), ("onset", pa.float64())]),
    "tals": pa.schema([("path", pa.string()), ("record_idx", pa.int64()), ("signal_idx", pa.int32()), ("elem_idx", pa.int32()), ("kind", pa.string()), ("onset", pa.float64()), ("duration", pa.float64()), ("text", pa.string()), ("variant", pa.string()), ("record_duration", pa.float64()), ("start", pa.float64()), ("before", pa.float64()), ("missing", pa.bool_())]),
}
RECORD_KINDS = ("record", "uniform")
TALS_ROWS = 8192


class Slices(InputPartition):
    """Parts of files: (path, i, n) is the i-th of n slices of the file's records."""

    def __init__(self, parts: list):
        super().__init__(0)
        self.parts = parts


@dataclass
class Bounds:
    """What pushed filters leave of the record and signal axes."""

    first: int = 0
    last: int | None = None
    signals: set | None = None
    paths: set | None = None
    kinds: set | None = None

    def cut(self, first: int, end: int) -> tuple[int, int]:
        return max(first, self.first), end if self.last is None else min(end, self.last + 1)


def time_keeping(data, channels, r: int) -> float | None:
    """Onset that a record's lists give: of the first channel whose first element has no text. ``data`` is the record's bytes."""
    for s in channels:
        raw = bytes(data[s.byte_offset : s.byte_offset + 2 * s.samples_per_record])
        # The first list alone decides, unless it's malformed.
        items, faults = eb.parse_tals(raw[: raw.find(b"\0") + 1], r)
        if faults or not items:
            items, _ = eb.parse_tals(raw, r)
        if items and not items[0][2]:
            return items[0][0]
    return None


def fault(variant: str, r: int, gap: float, d: float) -> str | None:
    """What a record's distance from the one before contradicts: even onsets of EDF+C, or records of EDF+D that don't overlap."""
    if d <= 0:
        return None
    if variant == "EDF+C" and abs(gap - d) > 0.001:
        return f"EDF+C record {r}: expected onset gap {eb.plain_number(d)}s, got {gap:.6f}s"
    if variant == "EDF+D" and gap < d - 0.001:
        return f"EDF+D record {r}: onset gap {gap:.6f}s is less than record duration {eb.plain_number(d)}s"
    return None


class EdfSource(DataSource):
    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return SCHEMAS[self.options.get("view", "recordings")]

    def reader(self, schema):
        return EdfReader({"mode": "FAILFAST"} | dict(self.options))


class EdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.view = options.get("view", "recordings")
        # Spark's readers have a mode. One made without it doesn't open bad files either, but a scan that fails falls back, as that of EdfFile does.
        mode = options.get("mode", "").upper()
        self.permissive, self.failfast = mode == "PERMISSIVE", mode == "FAILFAST"
        self.slice_bytes = int(float(options.get("slice_mb", 16)) * 2**20)
        self.rows = int(options.get("batch_records", 4096))
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]] if options.get("path") else []
        number = lambda k, default: float(options.get(k, default))
        self.page = (number("t0", 0.0), number("t1", "inf")) if options.keys() & {"t0", "t1"} else None
        self.window = (number("from_time", "-inf"), number("to_time", "inf")) if options.keys() & {"from_time", "to_time"} else None
        self.bounds = Bounds()

    def pushFilters(self, filters):
        """Takes comparisons on path, record_idx, signal_idx and kind; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            b, taken = self.bounds, True
            if getattr(f, "value", 0) is None:
                taken = False
            elif column == "path" and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                b.paths = values if b.paths is None else b.paths & values
            elif self.view == "chunks" and column == "signal_idx" and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                b.signals = values if b.signals is None else b.signals & values
            elif self.view == "tals" and column == "kind" and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                b.kinds = values if b.kinds is None else b.kinds & values
            elif self.view in ("chunks", "tals") and column == "record_idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = {EqualTo: f.value, GreaterThanOrEqual: f.value, GreaterThan: f.value + 1}.get(type(f))
                high = {EqualTo: f.value, LessThanOrEqual: f.value, LessThan: f.value - 1}.get(type(f))
                b.first = b.first if low is None else max(b.first, low)
                b.last = b.last if high is None else high if b.last is None else min(b.last, high)
            else:
                taken = False
            if not taken:
                yield f

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of all files named; directories stand for their ``*.edf`` files."""
        found = {}
        for name in self.paths:
            found |= expand(name)
        return sorted((p, n) for p, n in found.items() if self.bounds.paths is None or p in self.bounds.paths)

    def partitions(self):
        headers_only = self.view in ("recordings", "signals")
        out, now, load = [], [], 0
        for path, size in self.files():
            n = 1 if headers_only else max(1, -(-size // self.slice_bytes))
            weight = 2**17 if headers_only else min(size, self.slice_bytes)
            for i in range(n):
                if now and load + weight > self.slice_bytes:
                    out.append(Slices(now))
                    now, load = [], 0
                now, load = now + [(path, i, n)], load + weight
        out += [Slices(now)] if now else []
        return out or [Slices([])]

    def read(self, partition):
        emit = getattr(self, f"_{self.view}")
        for path, i, n in partition.parts:
            try:
                head, size = eb.read_header(path, open_file)
            except TraceError as why:
                if not self.permissive:
                    raise
                if self.view == "recordings":
                    yield (path, *[None] * 19, f"{type(why).__name__}: {why}")
                continue
            yield from emit(path, head, size, i, n)

    def _recordings(self, path, h, size, i, n):
        yield (
            path, h.version, h.patient_id, h.recording_id, h.start_datetime, h.start_datetime_raw, h.header_bytes, h.variant, h.num_records_raw, h.num_records, h.complete_records(size),
            h.record_duration, h.duration, h.num_signals, h.record_size, size, any(s.is_annotation for s in h.signals), h.patient, h.recording, h.warnings, None,
        )

    def _signals(self, path, h, size, i, n):
        for k, s in enumerate(h.signals):
            yield (
                path, k, s.label, s.transducer, s.physical_dimension, s.physical_min, s.physical_max, s.digital_min, s.digital_max, s.prefiltering, s.samples_per_record, s.reserved,
                s.gain, s.offset, s.is_annotation, s.rate(h.record_duration), h.num_records * s.samples_per_record, s.byte_offset,
            )

    def _span(self, h, size, i, n) -> tuple[int, int]:
        """The records of slice i of n that the filters leave."""
        whole = h.complete_records(size)
        return self.bounds.cut(whole * i // n, whole * (i + 1) // n)

    def _blocks(self, path, h, first, end):
        """(first record, rows x bytes array) of a few records at a time, in file order."""
        step = max(1, min(self.rows, 2**23 // max(h.record_size, 1)))
        with open_file(path) as f:
            f.seek(h.header_bytes + first * h.record_size)
            for at in range(first, end, step):
                k = min(step, end - at)
                data = f.read(k * h.record_size)
                if len(data) < k * h.record_size:
                    raise MapFailedError(path)
                yield at, np.frombuffer(data, np.uint8).reshape(k, h.record_size)

    def _raw(self, path, h, channels, records):
        """Raw onsets of single records: (what the lists give or the calculated one, whether it's calculated)."""
        if not channels:
            return [(r * h.record_duration, False) for r in records]
        low, high = min(s.byte_offset for s in channels), max(s.byte_offset + 2 * s.samples_per_record for s in channels)
        out = []
        with open_file(path) as f:
            for r in records:
                f.seek(h.header_bytes + r * h.record_size + low)
                found = time_keeping(bytes(low) + f.read(high - low), channels, r)
                out.append((r * h.record_duration if found is None else found, found is None))
        return out

    def _page_records(self, h, wanted) -> tuple[int, int]:
        """First record, and the one after the last, that hold samples of the page."""
        lows, highs = [], []
        for k in wanted:
            s, rate = h.signals[k], h.signals[k].rate(h.record_duration)
            a, b = (int(min(max(t, 0.0) * rate, 2.0**62)) if t == t and rate > 0 else 0 for t in self.page)
            if s.samples_per_record > 0 and a < b:
                lows.append(a // s.samples_per_record)
                highs.append((b - 1) // s.samples_per_record + 1)
        return min(lows, default=0), max(highs, default=0)

    def _chunks(self, path, h, size, i, n):
        first, end = self._span(h, size, i, n)
        wanted = [k for k in range(h.num_signals) if self.bounds.signals is None or k in self.bounds.signals]
        if self.page is not None:
            a, b = self._page_records(h, wanted)
            first, end = max(first, a), min(end, b)
        if first >= end or not wanted:
            return
        channels = [s for s in h.signals if s.is_annotation] if h.variant == "EDF+D" else []
        start = self._raw(path, h, channels, [0])[0][0] if channels else 0.0
        parts = [(first, end)]
        if self.window is not None:
            low, high = self.window
            at = np.array([x for x, _ in self._raw(path, h, channels, range(first, end))]) - start
            near = np.flatnonzero((at < high) & (at + h.record_duration > low)) + first
            cuts = np.flatnonzero(np.diff(near) > 1) + 1
            parts = [(int(x[0]), int(x[-1]) + 1) for x in np.split(near, cuts) if len(x)]
        for a, b in parts:
            for at, block in self._blocks(path, h, a, b):
                yield from self._batches(path, h, at, block, wanted, channels, start)

    def _batches(self, path, h, at, block, wanted, channels, start):
        rows = len(block)
        onset = np.arange(at, at + rows) * h.record_duration
        if channels:
            read = [time_keeping(row, channels, r) for r, row in enumerate(block, at)]
            onset = np.array([x if t is None else t for t, x in zip(read, onset)]) - start
        for k in wanted:
            s = h.signals[k]
            width = s.samples_per_record
            values = np.ascontiguousarray(block[:, s.byte_offset : s.byte_offset + 2 * width]).reshape(-1).view("<i2")
            digital = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values))
            same = lambda v, t: pa.array(np.full(rows, v), t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * rows), pa.array(np.arange(at, at + rows)), same(k, pa.int32()), digital, same(s.gain, pa.float64()), same(s.offset, pa.float64()), same(width, pa.int64()), same(s.rate(h.record_duration), pa.float64()), same(h.record_duration, pa.float64()), same(s.is_annotation, pa.bool_()), pa.array(onset, pa.float64())],
                schema=ARROW["chunks"],
            )

    def _tals(self, path, h, size, i, n):
        """Arrow batches of a few thousand rows."""
        rows = []
        for row in self._tal_rows(path, h, size, i, n):
            if self.bounds.kinds is None or row[3] in self.bounds.kinds:
                rows.append(row)
            if len(rows) >= TALS_ROWS:
                yield self._tal_batch(path, h, rows)
                rows = []
        if rows:
            yield self._tal_batch(path, h, rows)

    @staticmethod
    def _tal_batch(path, h, rows):
        r, k, e, kind, onset, duration, text, start, before, missing = zip(*rows)
        schema, m = ARROW["tals"], len(rows)
        columns = [[path] * m, r, k, e, kind, onset, duration, text, [h.variant] * m, [h.record_duration] * m, start, before, missing]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def _tal_rows(self, path, h, size, i, n):
        """(record, signal, element, kind, onset, duration, text, first record's onset, onset of the record before, whether calculated)."""
        d, channels = h.record_duration, [(k, s) for k, s in enumerate(h.signals) if s.is_annotation]
        if not channels:
            # Without annotation channels nothing is scanned: onsets are uniform, also past a truncated end.
            first, end = self.bounds.cut(h.num_records * i // n, h.num_records * (i + 1) // n)
            yield from ((r, -1, -1, "uniform", r * d, None, None, 0.0, (r - 1) * d if r else None, False) for r in range(first, end))
            return
        whole = h.complete_records(size)
        if i == n - 1 and whole < h.num_records and self.bounds.cut(whole, whole + 1) == (whole, whole + 1):
            text = f"data truncated at record {whole}: expected {h.header_bytes + (whole + 1) * h.record_size} bytes, file has {size}"
            yield (whole, -1, 0, "warning", None, None, text, None, None, False)
        first, end = self._span(h, size, i, n)
        if first >= end:
            return
        only = [s for _, s in channels]
        done, start, before = first, None, None
        try:
            (start, _), (before, _) = self._raw(path, h, only, [0, max(first - 1, 0)])
            before = before if first else None
            for at, block in self._blocks(path, h, first, end):
                for r, row in enumerate(block, at):
                    keeping, found = None, []
                    for k, s in channels:
                        items, warnings = eb.parse_tals(row[s.byte_offset : s.byte_offset + 2 * s.samples_per_record].tobytes(), r)
                        if keeping is None and items and not items[0][2]:
                            keeping = items[0][0]
                        found += [(r, k, e, "element", *item, start, None, False) for e, item in enumerate(items)]
                        found += [(r, k, e, "warning", None, None, text, start, None, False) for e, text in enumerate(warnings)]
                    onset = r * d if keeping is None else keeping
                    yield (r, -1, -1, "record", onset, None, None, start, before, keeping is None)
                    if before is not None and (text := fault(h.variant, r, (onset - start) - (before - start), d)):
                        yield (r, -1, -1, "fault", None, None, text, start, None, False)
                    yield from found
                    before, done = onset, r + 1
        except (OSError, TraceError) as why:
            if self.failfast:
                raise
            # What can't be scanned has no annotations, and calculated onsets that say so and why.
            text = f"annotation scan failed: {why}"
            yield (done, -1, 1, "warning", None, None, text, start, None, False)
            yield from ((r, -1, -1, "record", r * d, None, text, 0.0, (r - 1) * d if r else None, True) for r in range(done, end))


def read_edf(spark, paths, view: str = "recordings", **options):
    """A view of EDF files as a DataFrame; registers the source when it's first used. ``paths`` is one path or a list."""
    spark.dataSource.register(EdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("edf").option("view", view).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
