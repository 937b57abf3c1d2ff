"""Recordings made from the driver's tables, so that queries cover the whole byte path.

R1 is ``events`` as one EDF+D file, R2 is ``lineitem`` as one plain EDF file for each
l_returnflag, R3 is a corpus of edge cases, R4 is ``events`` as one EDF+C file whose lists and onsets are broken by rule. Files are written once per process and table
folder, into the shared folder of the session.

R1 and R2 are made by executors: they sort the table and write its rows, then the records of a range; the driver strings the ranges together.
"""

from __future__ import annotations

import contextlib
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.hot import shared_dir
from tracelode.sources import writer as w
from tracelode.sources.files import create_file, delete, expand, local, open_file

_DONE: dict[tuple[str, str], list[str]] = {}
#: Rows that a task sorts, and records that one writes.
SORTED, RECORDS = 250_000, 2**14
EVENT = np.dtype([("us", "<i8"), ("k", "<i4"), ("value", "<i2"), ("user", "<i2"), ("kind", "<i2")])
KINDS = {"purchase": 1, "error": 2}
ITEM = np.dtype([(c, "<i2") for c in ("quantity", "discount", "tax", "linenumber")])
FLAGS = ("A", "N", "R")


def _folder(spark, sf_dir: str, kind: str) -> str:
    return f"{shared_dir(spark)}/edf/{sf_dir.strip('/').replace('/', '_')}/{kind}"


def staged(spark, sf_dir: str, kind: str) -> list[str]:
    key = (sf_dir, kind)
    if key not in _DONE or not all(expand(p).get(p) or p.endswith("absent.edf") for p in _DONE[key]):
        make = {"r1": partial(_r1, spark), "r2": partial(_r2, spark), "r3": _r3, "r4": _r4, "bad": _bad}[kind]
        _DONE[key] = make(local(_folder(spark, sf_dir, kind)), sf_dir)
    return _DONE[key]


def sorted_rows(df: DataFrame, order: list[str], pick, folder: str) -> dict[str, list[tuple[str, int]]]:
    """Writes a table's rows in order, as files of fixed-width rows. ``pick`` turns an Arrow batch into arrays by key; of each key (file, rows), in order.

    Only counts reach the driver. Nulls are refused, as a sample can't be one."""
    schema = pa.schema([("part", pa.int32()), ("key", pa.string()), ("file", pa.string()), ("rows", pa.int64())])

    def write(batches):
        part, out = TaskContext.get().partitionId(), {}
        with contextlib.ExitStack() as stack:
            for b in batches:
                if bad := [c for c, x in zip(b.schema.names, b.columns) if x.null_count]:
                    raise ValueError(f"null in {', '.join(bad)}")
                for key, x in pick(b).items():
                    if key not in out:
                        path = f"{folder}/rows-{key}-{part}-{uuid.uuid4().hex[:8]}"
                        out[key] = [stack.enter_context(create_file(path)), path, 0]
                    out[key][0].write(x.tobytes())
                    out[key][2] += len(x)
        yield pa.RecordBatch.from_pylist([{"part": part, "key": key, "file": path, "rows": n} for key, (_, path, n) in out.items()], schema)

    parts = df.count() // SORTED + 1
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found: dict[str, list[tuple[str, int]]] = {}
    for r in sorted(ordered.mapInArrow(write, "part INT, key STRING, file STRING, rows BIGINT").collect()):
        found.setdefault(r.key, []).append((r.file, r.rows))
    return found


def record_files(spark: SparkSession, jobs: list, row: np.dtype, per_record: int, folder: str) -> list[list[str]]:
    """Of each job (files of rows, function from rows to bytes) the files with its whole records, in order. The rows are deleted."""
    blocks = []
    for j, (parts, make) in enumerate(jobs):
        ends = np.cumsum([n for _, n in parts])
        whole = int(ends[-1]) // per_record * per_record if parts else 0
        for a in range(0, whole, RECORDS * per_record):
            b = min(a + RECORDS * per_record, whole)
            spans = [(file, max(a - (e - n), 0), min(b, e) - max(a, e - n)) for (file, n), e in zip(parts, ends.tolist()) if e > a and e - n < b]
            blocks.append((j, spans, make))
    schema = pa.schema([("block", pa.int64()), ("file", pa.string())])

    def write(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                _, spans, make = blocks[i]
                data = bytearray()
                for file, first, n in spans:
                    with open_file(file) as f:
                        f.seek(first * row.itemsize)
                        data += f.read(n * row.itemsize)
                path = w.write(f"{folder}/records-{i}-{uuid.uuid4().hex[:8]}", b"", make(np.frombuffer(data, row)))
                yield pa.RecordBatch.from_pylist([{"block": i, "file": path}], schema)

    out: list[list[str]] = [[] for _ in jobs]
    if blocks:
        for r in sorted(spark.range(0, len(blocks), 1, len(blocks)).mapInArrow(write, "block BIGINT, file STRING").collect()):
            out[blocks[r.block][0]].append(r.file)
    for parts, _ in jobs:
        for file, _ in parts:
            delete(file)
    return out


def _events(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = np.empty(len(b), EVENT)
    out["us"] = b["ts"].cast(pa.int64())
    out["value"] = np.round(b["value"].to_numpy() * 100).astype(np.int64) - 32768
    out["user"] = b["user_id"].to_numpy().astype(np.int16)
    out["k"] = pc.utf8_trim(pc.list_element(pc.split_pattern(b["props"], ":"), 1), " }").cast(pa.int32())
    out["kind"] = b["kind"]
    return {"events": out}


def _event_records(start: int, x: np.ndarray) -> bytes:
    raw, kind, k = ((x["us"] - start) / 1e6).tolist(), x["kind"], x["k"].tolist()
    names = {v: name for name, v in KINDS.items()}
    tals = [[w.tal(f"{t:+.6f}")] for t in raw[::10]]
    for i in np.flatnonzero(kind).tolist():
        tals[i // 10].append(w.tal(f"{raw[i]:+.6f}", names[int(kind[i])], duration=str(k[i]) if kind[i] == KINDS["purchase"] else None))
    lists = [b"".join(parts).ljust(320, b"\0") for parts in tals]
    if any(len(t) > 320 for t in lists):
        raise ValueError("the lists of a record need more than 320 bytes")
    return w.records([x["value"].reshape(-1, 10), x["user"].reshape(-1, 10), x["k"][::10].reshape(-1, 1), lists])


def _r1(spark: SparkSession, folder: str, sf_dir: str) -> list[str]:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.coalesce(*[F.when(F.col("event_type") == name, v) for name, v in KINDS.items()], F.lit(0))
    t = t.select("event_id", "ts", "user_id", "value", "props", kind.alias("kind"))
    start = t.agg(F.min("ts").alias("t")).toArrow()["t"].cast(pa.int64())[0].as_py() // 10**6 * 10**6
    rows = sorted_rows(t, ["event_id"], _events, folder).get("events", [])
    n = sum(k for _, k in rows)
    signals = [
        w.signal("value", 10, "0", "655.35", dimension="uV"),
        w.signal("user", 10, "-32768", "32767", dimension=""),
        w.signal("k", 1, "0", "99", "0", "99", dimension=""),
        w.signal("EDF Annotations", 160, "-1", "1", dimension=""),
    ]
    begin = np.datetime64(start, "us").astype("datetime64[s]").item()
    head = w.header(signals, n // 10, "10", date=begin.strftime("%d.%m.%y"), time=begin.strftime("%H.%M.%S"), reserved="EDF+D")
    bodies = record_files(spark, [(rows, partial(_event_records, start))], EVENT, 10, folder)
    return [w.join(f"{folder}/events.edf", head, bodies[0])]


def _items(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = np.empty(len(b), ITEM)
    for name, c, f in (("quantity", "l_quantity", 1), ("discount", "l_discount", 100), ("tax", "l_tax", 100), ("linenumber", "l_linenumber", 1)):
        out[name] = np.round(b[c].to_numpy() * f).astype(np.int64)
    flag = b["flag"].to_numpy()
    return {name: x for i, name in enumerate(FLAGS) if len(x := out[flag == i])}


def _item_records(x: np.ndarray) -> bytes:
    quantity, discount, tax, line = (x[c].reshape(-1, 100) for c in ("quantity", "discount", "tax", "linenumber"))
    return w.records([quantity, discount, tax[:, ::2], line])


def _r2(spark: SparkSession, folder: str, sf_dir: str) -> list[str]:
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_returnflag").isin(*FLAGS))
    t = t.select(*names, F.coalesce(*[F.when(F.col("l_returnflag") == name, i) for i, name in enumerate(FLAGS)]).alias("flag"))
    rows = sorted_rows(t, names, _items, folder)
    rows = [rows.get(name, []) for name in FLAGS]
    signals = [w.signal("quantity", 100, "-32768", "32767", dimension=""), w.signal("discount", 100, "0", "1", "0", "100", dimension=""), w.signal("tax", 50, "0", "1", "0", "100", dimension=""), w.signal("linenumber", 100, "-32768", "32767", dimension="")]
    bodies = record_files(spark, [(x, _item_records) for x in rows], ITEM, 100, folder)
    heads = [w.header(signals, sum(n for _, n in x) // 100, "1", reserved="") for x in rows]
    return [w.join(f"{folder}/{name}.edf", head, body) for name, head, body in zip(FLAGS, heads, bodies)]


def _r4(folder: str, sf_dir: str) -> list[str]:
    """Of record r: no time-keeping list if r % 11 = 5, a list without sign if r % 7 = 3, one that isn't UTF-8 if r % 13 = 4, half a second late if r % 17 = 6.

    The header promises two records more than there are."""
    t = pq.read_table(f"{sf_dir}/events.parquet", columns=["event_id", "user_id"]).sort_by("event_id")
    n = len(t) // 10
    users = t["user_id"].to_numpy()[: 10 * n].reshape(n, 10)
    lists = []
    for r in range(n):
        parts = [w.tal(f"+{10 * r + 0.25:.2f}", "event") if r % 11 == 5 else w.tal(f"+{10 * r + (0.5 if r % 17 == 6 else 0.0):.1f}")]
        if r % 7 == 3:
            parts.append(b"2\x14nosign\x14\0")
        if r % 13 == 4:
            parts.append(b"+0.7\x14\xff\x14\0" + w.tal(f"+{10 * r + 1}", "after", duration=str(r % 5)))
        lists.append(b"".join(parts).ljust(120, b"\0"))
    signals = [w.signal("user", 10, "-32768", "32767", dimension=""), w.signal("EDF Annotations", 60, "-1", "1", dimension="")]
    return [w.write(f"{folder}/broken.edf", w.header(signals, n + 2, "10", patient="P1 Q", recording="none"), w.records([users, lists]))]


def edge_files(folder: str) -> list[str]:
    """Cases that no table yields: malformed lists, odd headers, truncation, merged rates."""
    one = lambda *v: np.array(v).reshape(len(v), 1)
    ann = lambda n=30, label="EDF Annotations": w.signal(label, n, "-1", "1", dimension="")
    pad = lambda b, n=60: b.ljust(n, b"\0")
    out = []

    def put(name, signals, num, channels, **kw):
        out.append(w.write(f"{folder}/{name}.edf", w.header(signals, num, **kw), w.records(channels) if channels else b""))

    put("unknown_count", [w.signal("A", 1)], -1, [one(1, 2)])
    put("zero_duration", [w.signal("A", 2)], 2, [np.array([[1, 2], [3, 4]])], duration="0")
    put("inverted", [w.signal("A", 2, "100", "-100", "-100", "100")], 1, [np.array([[10, -20]])], reserved="")
    put("raw_dates", [w.signal("A", 1)], 1, [one(5)], date="04.04.yy", patient="X Q 31-FEB-2000 Al_Bo no_pain", recording="Startdate 12-OCT-2010 A_1 T_x E_q r_1 r_2")
    put("long_year", [w.signal("A", 1)], 1, [one(5)], date="1.1.2010", patient="short", recording="none")
    put("truncated", [w.signal("A", 1), ann()], 3, [one(1, 2), [pad(w.tal("+0") + w.tal("+0.5", "first")), pad(w.tal("+1"))]])
    bad = w.tal("+0") + b"\x14x\0" + b"+1.\x14dot\x14\0" + b"2\x14nosign\x14\0" + w.tal("+0.25", "good", "second", duration="1.5") + w.tal("+0.5", "odd", duration="-1") + b"+0.7\x14\xff\x14\0" + w.tal("+0.9", "kept")
    put("bad_lists", [w.signal("A", 1), ann(80)], 1, [one(1), [pad(bad, 160)]])
    put("swallowed", [ann()], 1, [[pad(w.tal("+0") + b"+0.1\x14\xff\0" + w.tal("+0.2", "eaten") + w.tal("+0.3", "seen"))]])
    put("no_time_keeping", [w.signal("A", 1), ann()], 2, [one(1, 2), [pad(w.tal("+0.5", "event")), pad(w.tal("+1.5"))]])
    put("plain_with_lists", [w.signal("A", 1), ann()], 2, [one(1, 2), [pad(w.tal("+567") + w.tal("+568.5", "late")), pad(w.tal("+569"))]], reserved="")
    put("two_channels", [ann(), w.signal("A", 1), ann()], 2, [[pad(w.tal("+0.1", "early")), pad(w.tal("+1"))], one(1, 2), [pad(w.tal("+0") + w.tal("+0.1", "tie")), pad(w.tal("+1.25"))]])
    put("gaps", [w.signal("A", 4), ann()], 3, [np.arange(12).reshape(3, 4), [pad(w.tal("+10")), pad(w.tal("+11")), pad(w.tal("+20"))]], reserved="EDF+D")
    put("uneven", [w.signal("A", 1), ann()], 3, [one(1, 2, 3), [pad(w.tal("+0")), pad(w.tal("+1.5")), pad(w.tal("+2"))]])
    put("merging_rates", [w.signal("A", 1), w.signal("A", 4), w.signal("B", 0)], 1, [one(1), np.array([[1, 2, 3, 4]])], duration="10")
    return out


def _r3(folder: str, sf_dir: str) -> list[str]:
    return edge_files(folder)


def bad_files(folder: str) -> list[str]:
    """A file for each header error."""
    one = w.signal("A", 1)
    heads = {
        "too_small": b"x" * 100, "cut_header": w.header([one, one], 1)[:600], "bad_field": w.header([one], "1_0"), "size_mismatch": w.header([one], 1, header_bytes=999), "no_signals": w.header([], 1),
        "bad_signal_field": w.header([one | {"dmin": "40000"}], 1), "digital_range": w.header([one | {"dmin": "5", "dmax": "5"}], 1), "physical_range": w.header([one | {"pmin": "1", "pmax": "1"}], 1),
    }
    return [w.write(f"{folder}/{name}.edf", head, b"") for name, head in heads.items()] + [f"{folder}/absent.edf"]


def _bad(folder: str, sf_dir: str) -> list[str]:
    return bad_files(folder)
