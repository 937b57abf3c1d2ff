"""Queries of the recording operators over staged files, and SQL that computes the same from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.functions import columns as fc
from tracelode.functions.edf_bytes import read_header
from tracelode.operators import events as ev
from tracelode.operators import samples as sp
from tracelode.plans.staging import staged
from tracelode.sources.catalog import register
from tracelode.sources.edf import read_edf

R1 = """WITH m AS (SELECT date_trunc('second', min(ts)) t0 FROM events),
e AS (SELECT event_id, event_id // 10 r, event_id % 10 o, (epoch_us(ts) - epoch_us(t0)) / 1e6::double raw, event_type et,
        CAST(json_extract(props, '$.k') AS int) k, user_id, CAST(round(value * 100) AS int) - 32768 dg FROM events, m),
rec AS (SELECT r, min_by(raw, o) ron, min_by(k, o) k FROM e GROUP BY r), s0 AS (SELECT ron s FROM rec WHERE r = 0),
g AS (SELECT 655.35 / 65535.0::double gain, 0.0 - (655.35 / 65535.0::double) * (-32768.0::double) off)
"""
R2 = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) - 1 p, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem),
l AS (SELECT l_returnflag f, p, p // 100 r, n // 100 nrec, CAST(round(l_quantity) AS bigint) q, CAST(round(l_discount * 100) AS bigint) d, CAST(round(l_tax * 100) AS bigint) t, CAST(l_linenumber AS bigint) ln FROM o WHERE p < n // 100 * 100)
"""
QUERIES, ORACLE = {}, {}


def _file():
    """A file's name without folder and extension."""
    return F.regexp_extract("path", r"([^/]+)\.edf$", 1).alias("file")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _view(spark, sf, kind, view, **kw):
    return read_edf(spark, staged(spark, sf, kind), view, **kw)


def _meta(spark, sf, kind="r1"):
    return read_header(staged(spark, sf, kind)[0])[0]


def _value(spark, sf):
    """Chunks of signal 0 of R1; the filter reaches the reader."""
    return _view(spark, sf, "r1", "chunks").where("signal_idx = 0")


@query("src_recordings", R1 + """SELECT 'events' AS file, 'EDF+D' AS variant, CAST(4 AS int) AS num_signals, count(*) // 10 AS num_records, 10.0::double AS record_duration, count(*) // 10 * 10.0::double AS duration,
 CAST(256 * 5 AS bigint) AS header_bytes, CAST(362 AS bigint) AS record_size, 'X X X X' AS patient_id, 'Startdate X X X X' AS recording_id, strftime(min(t0), '%Y-%m-%d %H:%M:%S') AS start_datetime FROM events, m""")
def _(spark, sf):
    r = _view(spark, sf, "r1", "recordings")
    return r.select(_file(), "variant", "num_signals", "num_records", "record_duration", "duration", "header_bytes", "record_size", "patient_id", "recording_id", F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss").alias("start_datetime"))


@query("src_signals", R2 + """, n1 AS (SELECT count(*) // 10 n FROM events), n2 AS (SELECT f, max(nrec) n FROM l GROUP BY f),
v1(i, label, spr, pmin, pmax, dmin, dmax, ann, bo) AS (VALUES (0, 'value', 10, 0.0, 655.35, -32768, 32767, false, 0), (1, 'user', 10, -32768.0, 32767.0, -32768, 32767, false, 20), (2, 'k', 1, 0.0, 99.0, 0, 99, false, 40), (3, 'EDF Annotations', 160, -1.0, 1.0, -32768, 32767, true, 42)),
v2(i, label, spr, pmin, pmax, dmin, dmax, ann, bo) AS (VALUES (0, 'quantity', 100, -32768.0, 32767.0, -32768, 32767, false, 0), (1, 'discount', 100, 0.0, 1.0, 0, 100, false, 200), (2, 'tax', 50, 0.0, 1.0, 0, 100, false, 400), (3, 'linenumber', 100, -32768.0, 32767.0, -32768, 32767, false, 500)),
u AS (SELECT 'events' AS file, n, 10.0 d, v1.* FROM v1, n1 UNION ALL SELECT f, n, 1.0, v2.* FROM v2, n2)
SELECT file, CAST(i AS int) AS signal_idx, label, CAST(spr AS bigint) AS samples_per_record, (pmax::double - pmin::double) / (dmax::double - dmin::double) AS gain, pmin::double - (pmax::double - pmin::double) / (dmax::double - dmin::double) * dmin::double AS "offset",
 spr / d::double AS sample_rate, CAST(n * spr AS bigint) AS num_samples, CAST(bo AS bigint) AS byte_offset, ann AS is_annotation FROM u""")
def _(spark, sf):
    s = read_edf(spark, staged(spark, sf, "r1") + staged(spark, sf, "r2"), "signals")
    return s.select(_file(), "signal_idx", "label", "samples_per_record", "gain", "offset", "sample_rate", "num_samples", "byte_offset", "is_annotation")


@query("src_chunks_sum", R1 + """, x AS (SELECT r, 0 i, dg d FROM e UNION ALL SELECT r, 1, user_id FROM e UNION ALL SELECT r, 2, k FROM rec)
SELECT r AS record_idx, CAST(i AS int) AS signal_idx, CAST(sum(d) AS bigint) AS total, CAST(count(*) AS bigint) AS n FROM x GROUP BY r, i""")
def _(spark, sf):
    c = _view(spark, sf, "r1", "chunks").where("signal_idx in (0, 1, 2)")
    return c.select("record_idx", "signal_idx", F.aggregate("digital", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("digital").cast("long").alias("n"))


@query("src_raw_bytes", "SELECT CAST(256 * 5 + count(*) // 10 * 362 AS bigint) AS bytes FROM events")
def _(spark, sf):
    return spark.read.format("binaryFile").load(staged(spark, sf, "r1")[0]).select(F.length("content").cast("long").alias("bytes"))


@query("prj_signal_labels", "SELECT CAST(i AS int) AS signal_idx, label FROM (VALUES (0, 'value'), (1, 'user'), (2, 'k'), (3, 'EDF Annotations')) v(i, label)")
def _(spark, sf):
    return sp.labels(_view(spark, sf, "r1", "signals")).select(F.posexplode("labels").alias("signal_idx", "label"))


@query("prj_header", R1 + "SELECT k, v FROM (SELECT ['version', 'patient_id', 'recording_id', 'num_signals', 'num_records', 'record_duration', 'duration', 'variant'] ks, ['0', 'X X X X', 'Startdate X X X X', '4', CAST(count(*) // 10 AS varchar), '10.0', CAST(count(*) // 10 * 10.0::double AS varchar), 'EDF+D'] vs FROM events), LATERAL (SELECT unnest(ks) k, unnest(vs) v)")
def _(spark, sf):
    names = ["version", "patient_id", "recording_id", "num_signals", "num_records", "record_duration", "duration", "variant"]
    r = _view(spark, sf, "r1", "recordings")
    show = lambda n: F.format_string("%.1f", n) if n.endswith("duration") else F.col(n).cast("string")
    return r.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), show(n))])).alias("k", "v"))


@query("flt_ordinary", "SELECT f AS file, CAST(i AS int) AS signal_idx FROM (SELECT unnest(['A', 'N', 'R']) f), (SELECT unnest([0, 1, 2, 3]) i) UNION ALL SELECT 'events', CAST(unnest([0, 1, 2]) AS int)")
def _(spark, sf):
    return sp.ordinary(read_edf(spark, staged(spark, sf, "r1") + staged(spark, sf, "r2"), "signals")).select(_file(), "signal_idx")


@query("flt_signal_by_label", "SELECT 'events' AS file, CAST(0 AS int) AS signal_idx, CAST(count(*) // 10 * 10 AS bigint) AS num_samples FROM events")
def _(spark, sf):
    return sp.by_label(_view(spark, sf, "r1", "signals"), "value").select(_file(), "signal_idx", "num_samples")


@query("idx_point", R1 + "SELECT event_id AS sample_idx, CAST(dg AS bigint) AS digital, dg::double * gain + off AS physical FROM e, g WHERE event_id = 17")
def _(spark, sf):
    return _plain(sp.read_range(_value(spark, sf), 17, 18, 10))


@query("idx_negative", R1 + "SELECT event_id AS sample_idx, CAST(dg AS bigint) AS digital, dg::double * gain + off AS physical FROM e, g WHERE event_id = (SELECT max(event_id) FROM events)")
def _(spark, sf):
    n = _meta(spark, sf).num_records * 10
    return _plain(sp.read_range(_value(spark, sf), n - 1, n, 10))


def _plain(rows, *more):
    return rows.select("sample_idx", F.col("digital").cast("long").alias("digital"), "physical", *more)


@query("idx_slice_physical", R1 + "SELECT event_id AS sample_idx, CAST(dg AS bigint) AS digital, dg::double * gain + off AS physical FROM e, g WHERE event_id >= 95 AND event_id < 105")
def _(spark, sf):
    return _plain(sp.read_range(_value(spark, sf), 95, 105, 10))


@query("idx_slice_digital", R1 + "SELECT event_id AS sample_idx, CAST(dg AS bigint) AS digital FROM e WHERE event_id >= 95 AND event_id < 105")
def _(spark, sf):
    return _plain(sp.read_range(_value(spark, sf), 95, 105, 10)).drop("physical")


@query("idx_strided", R1 + "SELECT event_id // 4 AS out_idx, event_id AS sample_idx, dg::double * gain + off AS physical FROM e, g WHERE event_id % 4 = 0")
def _(spark, sf):
    n = _meta(spark, sf).num_records * 10
    return sp.read_strided(_value(spark, sf), slice(None, None, 4), n, 10).select("out_idx", "sample_idx", "physical")


@query("idx_strided_neg", R1 + ", n AS (SELECT max(event_id) m FROM events) SELECT (m - event_id) // 3 AS out_idx, event_id AS sample_idx, dg::double * gain + off AS physical FROM e, g, n WHERE (m - event_id) % 3 = 0")
def _(spark, sf):
    n = _meta(spark, sf).num_records * 10
    return sp.read_strided(_value(spark, sf), slice(None, None, -3), n, 10).select("out_idx", "sample_idx", "physical")


@query("sig_to_numpy", R1 + "SELECT event_id AS sample_idx, dg::double * gain + off AS physical FROM e, g")
def _(spark, sf):
    return sp.to_arrays(_value(spark, sf)).select(F.posexplode("values").alias("pos", "physical")).select(F.col("pos").cast("long").alias("sample_idx"), "physical")


@query("sig_to_digital", R1 + "SELECT event_id AS sample_idx, CAST(user_id AS bigint) AS digital FROM e")
def _(spark, sf):
    c = _view(spark, sf, "r1", "chunks").where("signal_idx = 1")
    return sp.to_arrays(c, physical=False).select(F.posexplode("values").alias("pos", "v")).select(F.col("pos").cast("long").alias("sample_idx"), F.col("v").cast("long").alias("digital"))


@query("sig_times", R1 + "SELECT event_id AS sample_idx, (ron - s) + o / 1.0 AS time_sec FROM e JOIN rec USING (r), s0")
def _(spark, sf):
    rows = sp.read_range(_value(spark, sf), 0, 2**62)
    return sp.with_times(rows).select("sample_idx", "time_sec")


PAGE = R1 + """SELECT CAST(0 AS int) AS signal_idx, event_id AS sample_idx, {0} AS value FROM e, g WHERE event_id >= 100 AND event_id < 200
UNION ALL SELECT CAST(1 AS int), event_id, {1} FROM e WHERE event_id >= 100 AND event_id < 200 UNION ALL SELECT CAST(2 AS int), r, {2} FROM rec WHERE r >= 10 AND r < 20"""


@query("page_physical", PAGE.format("dg::double * gain + off", "user_id::double", "k::double"))
def page_physical(spark, sf):
    return sp.page(spark, staged(spark, sf, "r1"), 100.0, 200.0, [0, 1, 2]).select("signal_idx", "sample_idx", F.col("physical").alias("value"))


@query("page_digital", PAGE.format("CAST(dg AS bigint)", "CAST(user_id AS bigint)", "CAST(k AS bigint)"))
def _(spark, sf):
    return sp.page(spark, staged(spark, sf, "r1"), 100.0, 200.0, [0, 1, 2]).select("signal_idx", "sample_idx", F.col("digital").cast("long").alias("value"))


@query("page_empty", "SELECT CAST(0 AS bigint) AS n")
def _(spark, sf):
    return sp.page(spark, staged(spark, sf, "r1"), 1e12, 2e12).agg(F.count("*").alias("n"))


@query("page_fleet", R2 + ", x AS (SELECT f, 0 i, p si, q v FROM l UNION ALL SELECT f, 1, p, d FROM l UNION ALL SELECT f, 2, p // 2, t FROM l WHERE p % 2 = 0 UNION ALL SELECT f, 3, p, ln FROM l) SELECT f AS file, CAST(i AS int) AS signal_idx, CAST(si AS bigint) AS sample_idx, v AS value FROM x WHERE si >= CASE WHEN i = 2 THEN 75 ELSE 150 END AND si < CASE WHEN i = 2 THEN 175 ELSE 350 END")
def _(spark, sf):
    return sp.page(spark, staged(spark, sf, "r2"), 1.5, 3.5).select(_file(), "signal_idx", "sample_idx", F.col("digital").cast("long").alias("value"))


@query("fleet_totals", R2 + ", x AS (SELECT f, 0 i, q v FROM l UNION ALL SELECT f, 1, d FROM l UNION ALL SELECT f, 2, t FROM l WHERE p % 2 = 0 UNION ALL SELECT f, 3, ln FROM l) SELECT f AS file, CAST(i AS int) AS signal_idx, CAST(sum(v) AS bigint) AS total, CAST(count(*) AS bigint) AS n FROM x GROUP BY f, i")
def _(spark, sf):
    c = _view(spark, sf, "r2", "chunks")
    part = c.select("path", "signal_idx", F.aggregate("digital", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"), F.size("digital").alias("k"))
    return part.groupBy(_file(), "signal_idx").agg(F.sum("t").alias("total"), F.sum("k").alias("n"))


@query("true_time_window", R1 + ", x AS (SELECT event_id, (ron - s) + o / 1.0 t FROM e JOIN rec USING (r), s0) SELECT event_id AS sample_idx, t AS time_sec FROM x WHERE t >= 86400 AND t < 172800")
def _(spark, sf):
    return sp.window(spark, staged(spark, sf, "r1"), 86400.0, 172800.0, [0]).select("sample_idx", "time_sec")


@query("gaps", R1 + ", x AS (SELECT r, ron - s b, lag(ron - s) OVER (ORDER BY r) a FROM rec, s0), sg(i, rate, spr) AS (VALUES (0, 1.0, 10), (1, 1.0, 10), (2, 0.1, 1)) SELECT CAST(i AS int) AS signal_idx, r AS record_idx, a + (spr - 1) / rate::double AS gap_start, b AS gap_end FROM x, sg WHERE b - (a + (spr - 1) / rate::double) > 1.5::double / rate::double")
def _(spark, sf):
    return ev.gaps(ev.record_onsets(_view(spark, sf, "r1", "tals")), _view(spark, sf, "r1", "signals")).select("signal_idx", "record_idx", "gap_start", "gap_end")


@query("rate_groups", "SELECT f AS file, CAST(h AS bigint) AS rate_hz, CAST(i AS int) AS signal_idx FROM (VALUES ('events', 1, 0), ('events', 1, 1), ('events', 0, 2), ('A', 100, 0), ('A', 100, 1), ('A', 100, 3), ('A', 50, 2), ('N', 100, 0), ('N', 100, 1), ('N', 100, 3), ('N', 50, 2), ('R', 100, 0), ('R', 100, 1), ('R', 100, 3), ('R', 50, 2)) v(f, h, i)")
def _(spark, sf):
    g = sp.rate_groups(read_edf(spark, staged(spark, sf, "r1") + staged(spark, sf, "r2"), "signals"))
    return g.select(_file(), "rate_hz", F.explode("signal_indices").alias("signal_idx"))


@query("proxy_shape", R2 + "SELECT f AS file, CAST(3 AS bigint) AS n_signals, CAST(max(nrec) * 100 AS bigint) AS n_samples, false AS mixed FROM l GROUP BY f UNION ALL SELECT 'events', CAST(2 AS bigint), CAST(count(*) // 10 * 10 AS bigint), false FROM events")
def _(spark, sf):
    a = _view(spark, sf, "r1", "signals").where("signal_idx in (0, 1)")
    b = _view(spark, sf, "r2", "signals").where("signal_idx in (0, 1, 3)")
    return sp.proxy_shape(a.unionByName(b)).select(_file(), "n_signals", "n_samples", "mixed")


@query("proxy_mixed", "SELECT unnest(['A', 'N', 'R']) AS file, true AS mixed")
def _(spark, sf):
    return sp.proxy_shape(sp.ordinary(_view(spark, sf, "r2", "signals"))).select(_file(), "mixed")


def _rect(spark, sf, wanted, a, b):
    rows = sp.read_rect(_view(spark, sf, "r1", "chunks"), wanted, a, b, 10)
    return rows.select("row", F.col("col").cast("long").alias("col"), F.col("digital").cast("long").alias("digital"), "physical")


RECT = R1 + ", b AS (SELECT event_id, 0 s, CAST(dg AS bigint) d, dg::double * gain + off p FROM e, g UNION ALL SELECT event_id, 1, CAST(user_id AS bigint), user_id::double FROM e), w(r, s) AS (VALUES {w}) SELECT CAST(w.r AS int) AS row, event_id - {a} AS col, {c} FROM b JOIN w USING (s) WHERE event_id >= {a} AND event_id < {b}"
DP = "d AS digital, p AS physical"


@query("proxy_scalar", RECT.format(w="(0, 1)", a=33, b=34, c=DP))
def _(spark, sf):
    return _rect(spark, sf, [1], 33, 34)


@query("proxy_row", RECT.format(w="(0, 0)", a=5, b=25, c=DP))
def _(spark, sf):
    return _rect(spark, sf, [0], 5, 25)


@query("proxy_col", RECT.format(w="(0, 0), (1, 1)", a=19, b=20, c=DP))
def _(spark, sf):
    return _rect(spark, sf, [0, 1], 19, 20)


@query("proxy_rect", RECT.format(w="(0, 0), (1, 1)", a=95, b=115, c=DP))
def _(spark, sf):
    return _rect(spark, sf, [0, 1], 95, 115)


@query("proxy_fancy", RECT.format(w="(0, 1), (1, 0), (2, 1)", a=95, b=105, c=DP))
def _(spark, sf):
    return _rect(spark, sf, [1, 0, 1], 95, 105)


@query("proxy_digital", RECT.format(w="(0, 1), (1, 0)", a=0, b=40, c="d AS digital"))
def _(spark, sf):
    return _rect(spark, sf, [1, 0], 0, 40).drop("physical")


@query("annotations", R1 + ", a AS (SELECT event_id, r, raw - s onset, CASE WHEN et = 'purchase' THEN k::double END duration, et FROM e, s0 WHERE et IN ('purchase', 'error')) SELECT row_number() OVER (ORDER BY onset, r, event_id) - 1 AS ann_idx, onset, duration, et AS text, r AS record_idx FROM a")
def _(spark, sf):
    return ev.annotations(_view(spark, sf, "r1", "tals")).select("ann_idx", "onset", "duration", "text", "record_idx")


@query("annotations_with_duration", R1 + "SELECT raw - s AS onset, k::double AS duration FROM e, s0 WHERE et = 'purchase'")
def _(spark, sf):
    return ev.annotations(_view(spark, sf, "r1", "tals")).where("duration is not null").select("onset", "duration")


@query("record_onsets", R1 + "SELECT r AS record_idx, ron - s AS onset FROM rec, s0")
def _(spark, sf):
    return ev.record_onsets(_view(spark, sf, "r1", "tals")).select("record_idx", "onset")


@query("starttime_subsecond", R1 + "SELECT s AS starttime_subsecond FROM s0")
def _(spark, sf):
    return ev.file_offsets(ev.raw_onsets(_view(spark, sf, "r1", "tals"))).select("starttime_subsecond")


@query("uniform_onsets", R2 + "SELECT DISTINCT f AS file, r AS record_idx, r * 1.0::double AS onset FROM l")
def _(spark, sf):
    return ev.record_onsets(_view(spark, sf, "r2", "tals")).select(_file(), "record_idx", "onset")


@query("onset_gap_check", R1 + ", x AS (SELECT r, ron - lag(ron) OVER (ORDER BY r) gap FROM rec) SELECT CAST(count(*) AS bigint) AS faults FROM x WHERE gap < 9.999")
def _(spark, sf):
    return ev.onset_faults(_view(spark, sf, "r1", "tals")).agg(F.count("*").alias("faults"))


@query("scan_progress", "SELECT CAST(count(*) // 10 AS bigint) AS done, CAST(count(*) // 10 AS bigint) AS total FROM events")
def _(spark, sf):
    return ev.scan_progress(_view(spark, sf, "r1", "tals")).select("done", "total")


@query("warnings_empty", "SELECT CAST(0 AS bigint) AS n")
def _(spark, sf):
    paths = staged(spark, sf, "r1") + staged(spark, sf, "r2")
    return ev.warnings(read_edf(spark, paths, "recordings"), read_edf(spark, paths, "tals")).agg(F.count("*").alias("n"))


# R4: the lists of record r by its rules; o is the length of its first list.
R4 = """WITH n AS (SELECT count(*) // 10 n FROM events), c AS (SELECT unnest(range(0, n)) r FROM n),
q AS (SELECT r, r % 11 = 5 AS lost, CASE WHEN r % 11 = 5 THEN NULL ELSE r * 10.0::double + CASE WHEN r % 17 = 6 THEN 0.5::double ELSE 0.0::double END END AS tk,
 CASE WHEN r % 11 = 5 THEN length(printf('+%.2f', r * 10.0::double + 0.25::double)) + 8 ELSE length(printf('+%.1f', r * 10.0::double)) + 3 END AS o FROM c),
w AS (SELECT r, coalesce(tk, r * 10.0::double) raw, lag(coalesce(tk, r * 10.0::double)) OVER (ORDER BY r) b, lost, o FROM q)
"""


@query("lists_warnings", R4 + """, m AS (
 SELECT 0 part, 0 a, 0 b, 0 c, 'header' stage, 'patient_id has 2 subfields (expected at least 4): "P1 Q"' message UNION ALL SELECT 0, 1, 0, 0, 'header', 'recording_id does not match EDF+ format: "none"'
 UNION ALL SELECT 1, n, -1, 0, 'scan', 'data truncated at record ' || n || ': expected ' || (768 + (n + 1) * 140) || ' bytes, file has ' || (768 + n * 140) FROM n
 UNION ALL SELECT 1, r, 1, 0, 'scan', 'invalid TAL onset at record ' || r || ', byte offset ' || o || ': onset must start with + or -, got "2"' FROM q WHERE r % 7 = 3
 UNION ALL SELECT 1, r, 1, CASE WHEN r % 7 = 3 THEN 1 ELSE 0 END, 'scan', 'non-UTF-8 annotation text at record ' || r || ', byte offset ' || (o + CASE WHEN r % 7 = 3 THEN 10 ELSE 0 END) FROM q WHERE r % 13 = 4
 UNION ALL SELECT 1, r, 1073741824, 0, 'scan', 'missing time-keeping annotation in record ' || r || ', using calculated onset' FROM q WHERE lost
 UNION ALL SELECT 2, r, 0, 0, 'onsets', 'EDF+C record ' || r || ': expected onset gap 10s, got ' || printf('%.6f', raw - b) || 's' FROM w WHERE abs(raw - b - 10) > 0.001)
SELECT row_number() OVER (ORDER BY part, a, b, c) - 1 AS seq, stage, message FROM m""")
def _(spark, sf):
    return ev.warnings(_view(spark, sf, "r4", "recordings"), _view(spark, sf, "r4", "tals")).select("seq", "stage", "message")


@query("lists_annotations", R4 + """, a AS (SELECT r * 10.0::double + 0.25::double onset, NULL::double duration, 'event' t, r, 0 e FROM q WHERE lost UNION ALL SELECT r * 10.0::double + 1.0::double, (r % 5)::double, 'after', r, 1 FROM q WHERE r % 13 = 4)
SELECT row_number() OVER (ORDER BY onset, r, e) - 1 AS ann_idx, onset, duration, t AS text, r AS record_idx FROM a""")
def _(spark, sf):
    return ev.annotations(_view(spark, sf, "r4", "tals")).select("ann_idx", "onset", "duration", "text", "record_idx")


@query("lists_onsets", R4 + "SELECT r AS record_idx, raw AS scan_onset, r * 10.0::double AS onset, lost AS missing FROM w")
def _(spark, sf):
    return ev.record_onsets(_view(spark, sf, "r4", "tals")).select("record_idx", "scan_onset", "onset", "missing")


@query("lists_faults", R4 + "SELECT r AS record_idx FROM w WHERE abs(raw - b - 10) > 0.001")
def _(spark, sf):
    return ev.onset_faults(_view(spark, sf, "r4", "tals")).select("record_idx")


@query("meta_dates")
def _(spark, sf):
    return _view(spark, sf, "r3", "recordings").select(_file(), F.col("start_datetime").cast("string").alias("start"), "start_datetime_raw", "variant", "num_records_raw", "num_records", "duration")


@query("meta_patient")
def _(spark, sf):
    return _view(spark, sf, "r3", "recordings").select(_file(), "patient.*", F.col("recording.start_date").alias("start_date"), F.col("recording.admin_code").alias("admin_code"), F.col("recording.technician").alias("technician"), F.col("recording.equipment").alias("equipment"), F.col("recording.additional").alias("recording_additional"))


@query("tal_edge_cases")
def _(spark, sf):
    return ev.annotations(_view(spark, sf, "r3", "tals")).select(_file(), "ann_idx", "onset", "duration", "text")


@query("truncated_file")
def _(spark, sf):
    return ev.warnings(_view(spark, sf, "r3", "recordings"), _view(spark, sf, "r3", "tals")).select(_file(), "seq", "stage", "message")


@query("edge_samples")
def _(spark, sf):
    rows = sp.read_range(_view(spark, sf, "r3", "chunks").where("not is_annotation"), 0, 2**62)
    return sp.with_times(rows).select(_file(), "signal_idx", "sample_idx", "physical", F.col("time_sec").cast("string").alias("time_sec"))


# Scalar functions as column expressions, over text made from tables or found in them.
TOKENS = "string_split_regex(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')"
KNOWN = "CASE WHEN upper({0}) <> 'X' THEN {0} END"
DAY = "CASE WHEN regexp_full_match({0}, '[0-9]+-[A-Za-z]{{3}}-[0-9]+') THEN try_strptime(upper({0}), '%d-%b-%Y')::date END"


@query("fn_patient", f"""WITH t AS (SELECT DISTINCT file_id, {TOKENS.format('patient_id')} t FROM recordings ), u AS (SELECT file_id, CASE WHEN len(t) >= 4 THEN t END t FROM t)
SELECT file_id, {KNOWN.format('t[1]')} AS code, CASE WHEN upper(t[2]) IN ('M', 'F') THEN upper(t[2]) END AS sex, strftime({DAY.format('t[3]')}, '%Y-%m-%d') AS birthdate, CASE WHEN {DAY.format('t[3]')} IS NULL THEN {KNOWN.format('t[3]')} END AS birthdate_raw,
 replace({KNOWN.format('t[4]')}, '_', ' ') AS name, CASE WHEN len(t) > 4 THEN replace(array_to_string(t[5:], ' '), '_', ' ') END AS additional FROM u""")
def _(spark, sf):
    r = spark.read.parquet(f"{sf}/recordings.parquet").select("file_id", F.col("patient_id").alias("t")).distinct()
    p = r.select("file_id", fc.patient(F.col("t")).alias("p"))
    return p.select("file_id", "p.code", "p.sex", F.col("p.birthdate").cast("string").alias("birthdate"), "p.birthdate_raw", "p.name", "p.additional")


@query("fn_recording", f"""WITH t AS (SELECT DISTINCT file_id, {TOKENS.format('recording_id')} t FROM recordings ), u AS (SELECT file_id, CASE WHEN len(t) >= 5 AND lower(t[1]) = 'startdate' THEN t END t FROM t)
SELECT file_id, strftime({DAY.format('t[2]')}, '%Y-%m-%d') AS start_date, CASE WHEN {DAY.format('t[2]')} IS NULL THEN {KNOWN.format('t[2]')} END AS start_date_raw, {KNOWN.format('t[3]')} AS admin_code, replace({KNOWN.format('t[4]')}, '_', ' ') AS technician, replace({KNOWN.format('t[5]')}, '_', ' ') AS equipment,
 CASE WHEN len(t) > 5 THEN replace(array_to_string(t[6:], ' '), '_', ' ') END AS additional FROM u""")
def _(spark, sf):
    r = spark.read.parquet(f"{sf}/recordings.parquet").select("file_id", F.col("recording_id").alias("t")).distinct()
    p = r.select("file_id", fc.recording(F.col("t")).alias("p"))
    return p.select("file_id", F.col("p.start_date").cast("string").alias("start_date"), "p.start_date_raw", "p.admin_code", "p.technician", "p.equipment", "p.additional")


@query("fn_start_datetime", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 01:02:03') AS start FROM orders")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", fc.start_datetime(F.date_format("o_orderdate", "dd.MM.yy"), F.lit("01.02.03")).cast("string").alias("start"))


@query("fn_signal_scaling", """WITH s AS (SELECT DISTINCT file_id, signal_index, physical_min a, physical_max b, digital_min c, digital_max d, samples_per_data_record n FROM signals)
SELECT file_id, signal_index, CASE WHEN c <> d THEN (b - a) / (d::double - c::double) END AS gain, CASE WHEN c <> d THEN a - (b - a) / (d::double - c::double) * c::double END AS "offset", n / 2.0::double AS rate FROM s""")
def _(spark, sf):
    s = spark.read.parquet(f"{sf}/signals.parquet")
    a, b, c, d = (F.col(x) for x in ("physical_min", "physical_max", "digital_min", "digital_max"))
    g = fc.gain(a, b, c, d)
    return s.select("file_id", "signal_index", g.alias("gain"), fc.offset(a, g, c).alias("offset"), fc.sample_rate(F.col("samples_per_data_record"), F.lit(2.0)).alias("rate"), "physical_min", "physical_max", "digital_min", "digital_max").distinct().drop("physical_min", "physical_max", "digital_min", "digital_max")


@query("errors")
def _(spark, sf):
    return _view(spark, sf, "bad", "recordings", mode="PERMISSIVE").select(_file(), "error")


@query("sql_views", R1 + "SELECT r AS record_idx, ron - s AS onset, CAST(count(*) AS bigint) AS n, CAST(sum(dg) AS bigint) AS total FROM e JOIN rec USING (r), s0 WHERE ron - s < 86400 GROUP BY r, ron, s")
def _(spark, sf):
    register(spark, staged(spark, sf, "r1"), "r1_")
    return spark.sql(
        "SELECT c.record_idx, o.onset, CAST(size(c.digital) AS bigint) AS n, aggregate(c.digital, 0L, (a, x) -> a + x) AS total "
        "FROM r1_chunks c JOIN r1_record_onsets o ON c.path = o.path AND c.record_idx = o.record_idx WHERE c.signal_idx = 0 AND o.onset < 86400"
    )
