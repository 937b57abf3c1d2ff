"""Staged recordings: the bytes that one pass over the whole table gives, made without the table in the driver."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracelode.plans import staging
from tracelode.sources import writer as w


@pytest.fixture
def small_parts(monkeypatch):
    """Many sort tasks and files of records, so that records lie across both."""
    monkeypatch.setattr(staging, "SORTED", 70)
    monkeypatch.setattr(staging, "RECORDS", 7)


def shuffled(path, columns: dict) -> None:
    t = pa.table(columns)
    pq.write_table(t.take(np.random.default_rng(7).permutation(len(t))), path)


def peak_mb(call) -> float:
    """MB of objects and arrays that this process has at most during a call."""
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def events(n: int) -> dict:
    rng = np.random.default_rng(3)
    ts = np.datetime64("2024-05-06T07:08:09.25", "us") + np.cumsum(rng.integers(1, 10**7, n)).astype("timedelta64[us]")
    kinds = np.array(["purchase", "error", "view", "click"])[rng.integers(0, 4, n)]
    return {"event_id": np.arange(n) * 3, "ts": ts, "user_id": rng.integers(0, 1500, n), "event_type": kinds, "value": rng.integers(0, 56021, n) / 100, "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, n)]}


def test_events(spark, tmp_path, small_parts):
    n, e = 1237, events(1237)
    shuffled(tmp_path / "events.parquet", e)
    (path,) = staging.staged(spark, str(tmp_path), "r1")
    us = e["ts"].astype(np.int64)
    raw = (us - us.min() // 10**6 * 10**6) / 1e6
    k = [int(p[6:-1]) for p in e["props"]]
    lists = []
    for r in range(n // 10):
        mine = [i for i in range(10 * r, 10 * r + 10) if e["event_type"][i] in ("purchase", "error")]
        lists.append(b"".join([w.tal(f"{raw[10 * r]:+.6f}"), *(w.tal(f"{raw[i]:+.6f}", e["event_type"][i], duration=str(k[i]) if e["event_type"][i] == "purchase" else None) for i in mine)]).ljust(320, b"\0"))
    m = n // 10 * 10
    value = np.round(e["value"] * 100).astype(np.int64) - 32768
    body = w.records([value[:m].reshape(-1, 10), e["user_id"][:m].reshape(-1, 10), np.array(k)[:m:10].reshape(-1, 1), lists])
    made = Path(path).read_bytes()
    assert made[1280:] == body and made[236:244].strip() == b"123" and [p.name for p in Path(path).parent.iterdir()] == ["events.edf"]


def items(n: int) -> dict:
    rng = np.random.default_rng(5)
    whole = {c: rng.integers(0, m, n) for c, m in (("l_orderkey", n // 4), ("l_partkey", 50), ("l_suppkey", 9), ("l_linenumber", 3))}
    return whole | {"l_quantity": rng.integers(1, 51, n) * 1.0, "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100, "l_returnflag": np.array(list("ANNRX"))[rng.integers(0, 5, n)]}


def test_items(spark, tmp_path, small_parts):
    x = items(4321)
    shuffled(tmp_path / "lineitem.parquet", x)
    order = np.lexsort([x[c] for c in ("l_tax", "l_discount", "l_quantity", "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey")])
    for flag, path in zip("ANR", staging.staged(spark, str(tmp_path), "r2"), strict=True):
        mine = order[x["l_returnflag"][order] == flag]
        n = len(mine) // 100
        pick = lambda c, f=1: np.round(x[c][mine[: n * 100]] * f).astype(np.int64).reshape(-1, 100)
        made = Path(path).read_bytes()
        assert made[1280:] == w.records([pick("l_quantity"), pick("l_discount", 100), pick("l_tax", 100)[:, ::2], pick("l_linenumber")])
        assert int(made[236:244]) == n and Path(path).name == f"{flag}.edf"


def test_nulls_are_refused(spark, tmp_path):
    shuffled(tmp_path / "events.parquet", events(30) | {"user_id": pa.array([None, *range(29)])})
    with pytest.raises(Exception, match="null in user_id"):
        staging.staged(spark, str(tmp_path), "r1")


@pytest.mark.parametrize("name", ["annotations", "flt_ordinary", "idx_negative", "idx_slice_physical", "onset_gap_check", "page_fleet", "prj_signal_labels", "proxy_fancy", "proxy_row", "rate_groups", "sig_times", "sql_views", "src_recordings", "true_time_window", "annotations_with_duration", "flt_signal_by_label", "idx_point", "idx_strided", "page_digital", "page_physical", "proxy_col", "proxy_mixed", "proxy_scalar", "record_onsets"])
def test_the_driver_keeps_no_table(spark, tmp_path, name):
    from tracelode.plans.edf_queries import QUERIES

    shuffled(tmp_path / "events.parquet", events(50_000))
    shuffled(tmp_path / "lineitem.parquet", items(200_000))
    assert peak_mb(lambda: QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()) < 10
