import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.facade import EdfFile
from tracelode.functions import columns as fc
from tracelode.functions.edf_bytes import day_of, start_of
from tracelode.operators import events as ev
from tracelode.operators import samples as sp
from tracelode.sources.edf import read_edf


@pytest.fixture(scope="module")
def files(edge):
    return sorted(edge.values())


def test_views_agree_with_the_driver(spark, files):
    rec = {r.path: r for r in read_edf(spark, files).collect()}
    samples = sp.read_range(read_edf(spark, files, "chunks"), 0, 2**62).collect()
    notes = ev.annotations(read_edf(spark, files, "tals")).collect()
    warned = ev.warnings(read_edf(spark, files), read_edf(spark, files, "tals")).collect()
    onsets = ev.record_onsets(read_edf(spark, files, "tals")).collect()
    for path in files:
        f = EdfFile(path)
        assert (rec[path].variant, rec[path].num_records, rec[path].duration) == (f.variant, f.num_records, f.duration)
        got = [(a.onset, a.duration, a.text) for a in sorted((a for a in notes if a.path == path), key=lambda a: a.ann_idx)]
        assert got == [(a.onset, a.duration, a.text) for a in f.annotations]
        assert sorted(w.message for w in warned if w.path == path) == sorted(f.warnings)
        assert [o.scan_onset for o in sorted((o for o in onsets if o.path == path), key=lambda o: o.record_idx)] == pytest.approx(list(f.record_onsets))
        for k in range(f.num_signals):
            mine = sorted((s.sample_idx, s.digital, s.physical) for s in samples if s.path == path and s.signal_idx == k)
            n = len(mine)
            assert [m[1] for m in mine] == f.signal(k).read_digital(0, n).tolist()
            assert np.allclose([m[2] for m in mine], f.signal(k)[:n])


def test_pushdown_and_slices(spark, edge):
    c = read_edf(spark, list(edge.values()), "chunks", slice_mb=0.0001).where(F.col("path") == edge["gaps"]).where("signal_idx = 0 and record_idx >= 1 and record_idx < 3")
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert c.select(F.flatten(F.array_sort(F.collect_list("digital")))).first()[0] == list(range(4, 12)) and "Filter (record_idx" not in plan


def test_time_window_and_gaps(spark, edge):
    chunks, tals, signals = (read_edf(spark, edge["gaps"], v) for v in ("chunks", "tals", "signals"))
    rows = sp.time_window(chunks.where("signal_idx = 0"), 0.5, 10.5).collect()
    assert sorted(r.time_sec for r in sp.window(spark, edge["gaps"], 0.5, 10.5, [0], slice_mb=0.0001).collect()) == sorted(r.time_sec for r in rows)
    assert sorted(r.time_sec for r in rows) == [0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 10.0, 10.25]
    g = ev.gaps(ev.record_onsets(tals), signals).collect()
    assert [(x.record_idx, x.gap_start, x.gap_end) for x in g] == [(2, 1.75, 10.0)]


def test_strides_and_rects(spark, edge):
    c = read_edf(spark, edge["gaps"], "chunks").where("signal_idx = 0")
    for k in (slice(None, None, 5), slice(None, None, -5), slice(9, 2, -3), slice(5, 5)):
        rows = sp.read_strided(c, k, 12, 4).orderBy("out_idx").collect()
        assert [r.digital for r in rows] == list(range(12))[k]
    r = sp.read_rect(read_edf(spark, edge["gaps"], "chunks"), [0, 0], 3, 5, 4).collect()
    assert sorted((x.row, x.col, x.digital) for x in r) == [(0, 0, 3), (0, 1, 4), (1, 0, 3), (1, 1, 4)]


def test_permissive(spark, tmp_path, edge):
    (tmp_path / "bad.edf").write_bytes(b"nothing")
    paths = [str(tmp_path / "bad.edf"), edge["gaps"]]
    with pytest.raises(Exception, match="file too small"):
        read_edf(spark, paths).collect()
    rec = read_edf(spark, paths, mode="PERMISSIVE")
    w = ev.warnings(rec, read_edf(spark, paths, "tals", mode="PERMISSIVE")).collect()
    assert rec.count() == 2 and [x.stage for x in w] == ["open"]
    assert read_edf(spark, str(tmp_path / "none*.edf")).count() == 0


def test_views_in_sql(spark, edge):
    from tracelode.sources.catalog import register

    assert register(spark, edge["gaps"], "t_") == ["t_recordings", "t_signals", "t_chunks", "t_annotations", "t_record_onsets", "t_warnings"]
    got = spark.sql("SELECT record_idx, physical[0] AS p FROM t_chunks WHERE signal_idx = 0 AND record_idx >= 1 ORDER BY 1").collect()
    assert [r.record_idx for r in got] == [1, 2] and spark.sql("SELECT count(*) FROM t_warnings").first()[0] == 0


def test_every_header_error(spark, tmp_path):
    from tracelode.plans.staging import bad_files

    got = {r.path.rpartition("/")[2]: r.error.partition(":")[0] for r in read_edf(spark, bad_files(str(tmp_path)), mode="PERMISSIVE").collect()}
    want = ["FileTooSmall", "FileTooSmall", "InvalidHeaderField", "HeaderSizeMismatch", "NoSignals", "InvalidSignalField", "InvalidDigitalRange", "InvalidPhysicalRange", "FileOpenError"]
    assert [got[f"{n}.edf"] for n in ("too_small", "cut_header", "bad_field", "size_mismatch", "no_signals", "bad_signal_field", "digital_range", "physical_range", "absent")] == want


def test_columns(spark):
    texts = ["+5", ".5", "5.", "1e5", "-inf", "1_0", "1d", "", "1 0", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fc.number(F.col("t"))).collect()]
    assert got == [5.0, 0.5, 5.0, 1e5, float("-inf"), None, None, None, None, None]
    dates = [("01.01.85", "10.20.30"), ("31.02.00", "00.00.00"), ("04.04.yy", "00.00.00"), ("01.12.84", "23.59.59"), ("01.01", "1.1.1")]
    rows = spark.createDataFrame([(i, *d) for i, d in enumerate(dates)], "i int, d string, t string").orderBy("i").select(fc.start_datetime(F.col("d"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [start_of(*d) for d in dates]
    days = ["02-MAR-1951", "31-FEB-2000", "2-may-2000", "02-XXX-2000", "x"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").orderBy("i").select(fc.day(F.col("d")), fc.known(F.col("d"))).collect()
    assert [r[0] for r in rows] == [day_of(d) for d in days] and rows[4][1] is None
    one = spark.createDataFrame([(5, 0.0, -1, "EDF+D x", "EDF Annotations")], "n int, d double, r int, v string, l string")
    assert tuple(one.select(fc.sample_rate(F.col("n"), F.col("d")), fc.duration(F.col("r"), F.lit(2.0)), fc.variant(F.col("v")), fc.is_annotation(F.col("l")), fc.integer(F.lit("40000"), "smallint")).first()) == (0.0, 0.0, "EDF+D", True, None)


def test_streaming(spark, tmp_path, edge):
    import shutil

    from tracelode.streaming.arrivals import arriving_files, each_batch

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(edge["gaps"], src / "a.edf")
    seen = []
    q = arriving_files(spark, str(src)).writeStream.foreachBatch(each_batch(lambda df, i: seen.extend(r.digital for r in df.collect()), "chunks")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    shutil.copy(edge["inverted"], src / "b.edf")
    q.processAllAvailable()
    q.stop()
    assert [10, -20] in seen and len(seen) == 7


def test_listing(tmp_path, monkeypatch):
    from pyarrow.fs import LocalFileSystem

    from tracelode.sources import files

    (tmp_path / "a").mkdir()
    for n in ("x.edf", "a/y.edf", "a/z.txt"):
        (tmp_path / n).write_bytes(b"123")
    names = lambda found: sorted(p[len(str(tmp_path)) + 1 :] for p in found)
    assert names(files.expand(str(tmp_path))) == ["a/y.edf", "x.edf"] == names(files.expand(f"file://{tmp_path}"))
    assert names(files.expand(f"{tmp_path}/a/*")) == ["a/y.edf", "a/z.txt"] and files.expand(f"{tmp_path}/none.edf") == {f"{tmp_path}/none.edf": 0}
    monkeypatch.setattr(files, "_remote", lambda p: (LocalFileSystem(), p.removeprefix("mem://")) if p.startswith("mem://") else None)
    assert sorted(files.expand(f"mem://{tmp_path}").items()) == [(f"mem://{tmp_path}/a/y.edf", 3), (f"mem://{tmp_path}/x.edf", 3)]
    assert list(files.expand(f"mem://{tmp_path}/a/*.txt")) == [f"mem://{tmp_path}/a/z.txt"] and files.expand(f"mem://{tmp_path}/x.edf") == {f"mem://{tmp_path}/x.edf": 3}
    with files.open_file(f"mem://{tmp_path}/x.edf") as f:
        f.seek(1)
        assert f.read(2) == b"23"


FILTERS = {
    "recordings": ["path = '{0}'", "num_signals > 1"], "signals": ["path = '{0}'", "signal_idx = 0"],
    "chunks": ["record_idx = 0", "record_idx >= 1", "record_idx < 2 and signal_idx = 0", "signal_idx in (0, 1)", "path = '{0}'", "record_idx > 5"],
    "tals": ["record_idx = 0", "record_idx >= 1", "record_idx <= 1", "record_idx = 2", "kind = 'warning'", "kind in ('record', 'fault') and record_idx > 0", "path = '{0}'"],
}


@pytest.mark.parametrize("view", list(FILTERS))
def test_pushed_filters_change_nothing(spark, files, edge, view):
    whole = [r.asDict(recursive=True) for r in read_edf(spark, files, view).collect()]
    table = spark.createDataFrame(whole, read_edf(spark, files, view).schema)
    for f in FILTERS[view]:
        f = f.format(edge["truncated"])
        for mb in (16, 0.0001):
            assert sorted(map(repr, read_edf(spark, files, view, slice_mb=mb).where(f).collect())) == sorted(map(repr, table.where(f).collect())), (f, mb)


def test_paths_with_commas_and_uris(spark, tmp_path, edge):
    import shutil

    from tracelode.streaming.arrivals import local_path

    odd = str(tmp_path / "x,y.edf")
    shutil.copy(edge["gaps"], odd)
    assert [r.path for r in read_edf(spark, odd).collect()] == [odd] and read_edf(spark, [odd, edge["inverted"]]).count() == 2
    assert local_path("s3://bucket//k.edf") == "s3://bucket//k.edf" and local_path("file:///a/b.edf") == local_path("file:/a/b.edf") == "/a/b.edf"


def test_scan_failure_gives_calculated_onsets(spark, tmp_path, edge, monkeypatch):
    """A file that gets shorter between planning and scanning."""
    from tracelode.functions import edf_bytes as eb
    from tracelode.sources.edf import EdfReader, Slices

    path = edge["gaps"]
    reader = EdfReader({"view": "tals", "paths": f'["{path}"]'})
    short = tmp_path / "short.edf"
    head, size = eb.read_header(path)
    short.write_bytes(open(path, "rb").read()[: size - 10])
    monkeypatch.setattr(eb, "read_header", lambda p, o: (head, size))
    rows = [r for b in reader.read(Slices([(str(short), 0, 1)])) for r in b.to_pylist()]
    assert [r["text"] for r in rows if r["kind"] == "warning"][0].startswith("annotation scan failed")
    assert [(r["record_idx"], r["onset"]) for r in rows if r["kind"] == "record"] == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_scan_failure_is_no_result(spark, edge, tmp_path, monkeypatch):
    """By default it ends the query; PERMISSIVE marks the calculated onsets, which count from the file's start."""
    from tracelode.errors import MapFailedError
    from tracelode.functions import edf_bytes as eb
    from tracelode.sources.edf import SCHEMAS, EdfSource, Slices

    head, size = eb.read_header(edge["gaps"])
    short = tmp_path / "short.edf"
    short.write_bytes(open(edge["gaps"], "rb").read()[: size - 10])
    monkeypatch.setattr(eb, "read_header", lambda p, o: (head, size))
    read = lambda **kw: [tuple(r.values()) for b in EdfSource({"view": "tals", "path": str(short), **kw}).reader(None).read(Slices([(str(short), 0, 1)])) for r in b.to_pylist()]
    with pytest.raises(MapFailedError):
        read()
    tals = spark.createDataFrame(read(mode="PERMISSIVE"), SCHEMAS["tals"])
    assert [(r.onset, r.scan_onset, r.missing) for r in ev.record_onsets(tals).orderBy("record_idx").collect()] == [(0.0, 0.0, True), (1.0, 1.0, True), (2.0, 2.0, True)]
    assert [w.message.partition(":")[0] for w in ev.warnings(read_edf(spark, edge["gaps"]), tals).collect()] == ["annotation scan failed"]


def scans(df):
    """Scans of the plan as it ran; a reused exchange has none."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return execution.executedPlan().toString().split("== Initial Plan ==")[0].count("BatchScan")


def test_scans(spark, edge):
    tals, chunks, signals = (read_edf(spark, edge["gaps"], v) for v in ("tals", "chunks", "signals"))
    assert scans(ev.record_onsets(tals)) == scans(ev.onset_faults(tals)) == scans(sp.time_window(chunks, 0.5, 10.5)) == 1
    # Numbering reads its input twice; a scan in Python isn't recognised as the same one.
    assert scans(ev.annotations(read_edf(spark, edge["two_channels"], "tals"))) <= 2
    assert scans(ev.gaps(ev.record_onsets(tals), signals)) == 2 and scans(ev.warnings(read_edf(spark, edge["gaps"]), tals)) <= 4


def test_pages_read_their_records_only(spark, edge):
    from tracelode.functions.edf_bytes import read_header
    from tracelode.sources.edf import EdfReader

    h, _ = read_header(edge["gaps"])
    reader = EdfReader({"view": "chunks", "paths": "[]", "t0": "1.0", "t1": "2.0"})
    assert reader._page_records(h, [0]) == (1, 2) and EdfReader({"view": "chunks", "t0": "-5", "t1": "0"})._page_records(h, [0]) == (0, 0)
    assert sorted(r.digital for r in sp.page(spark, edge["gaps"], 1.0, 2.0, [0]).collect()) == [4, 5, 6, 7]
    assert read_edf(spark, edge["gaps"], "chunks", t0=1.0, t1=2.0).where("signal_idx = 0").count() == 1
    assert read_edf(spark, edge["gaps"], "chunks", from_time=5.0).where("signal_idx = 0").count() == 1
