"""Queries of the general operators over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import faults, grid, intervals, packed, units

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("p1_found")
def _(spark, sf):
    return packed.unpack(_table(spark, sf, "recordings"), "file_id", ["patient_id", "recording_id"])


def _units(spark, sf):
    return units.harmonise(
        _table(spark, sf, "signals"), _table(spark, sf, "recordings"), _table(spark, sf, "unit_ref"),
        "file_id", "signal_index", ["site", "equipment"], "physical_dimension", "physical_min", "physical_max", ["label", "transducer", "prefiltering"],
    )


@query("p2_found")
def _(spark, sf):
    return _units(spark, sf).where("source <> 'inferred' and not is_common").select("file_id", "signal_index", "unit_id")


@query("p2_common_ranges")
def _(spark, sf):
    return _units(spark, sf)


def _grid(spark, sf):
    return grid.regular_grid(_table(spark, sf, "record_onsets"), _table(spark, sf, "recordings"), "file_id", "onset", "record_duration_secs")


P4_SLOTS = """WITH d AS (SELECT file_id, max(record_duration_secs) d FROM recordings WHERE record_duration_secs > 0 AND isfinite(record_duration_secs) GROUP BY 1),
o AS (SELECT file_id, onset, min(onset) OVER (PARTITION BY file_id) t0 FROM record_onsets WHERE onset IS NOT NULL),
s AS (SELECT file_id, CAST(floor((onset - t0) / d + 0.5) AS bigint) slot, onset FROM o JOIN d USING (file_id)),
u AS (SELECT file_id, slot, min(onset) onset, count(*) n FROM s GROUP BY 1, 2),
g AS (SELECT file_id, unnest(range(0, max(slot) + 1)) slot FROM u GROUP BY 1)
"""


@query("p4_found", P4_SLOTS + "SELECT file_id, slot FROM g ANTI JOIN u USING (file_id, slot)")
def _(spark, sf):
    return _grid(spark, sf).where("status <> 'observed'").select("file_id", "slot")


# The number of the record as a reading, filled where its neighbours are at most two minutes apart.
P4_VALUES = """WITH d AS (SELECT file_id, max(record_duration_secs) d FROM recordings WHERE record_duration_secs > 0 AND isfinite(record_duration_secs) GROUP BY 1),
o AS (SELECT file_id, onset, record_idx::double v, min(onset) OVER (PARTITION BY file_id) t0 FROM record_onsets WHERE onset IS NOT NULL),
s AS (SELECT file_id, CAST(floor((onset - t0) / d + 0.5) AS bigint) slot, onset, v, t0, d FROM o JOIN d USING (file_id)),
u AS (SELECT file_id, slot, min(onset) onset, arg_min(v, (onset, v)) v, count(*) n FROM s GROUP BY 1, 2),
g AS (SELECT file_id, t0, d, unnest(range(0, max(slot) + 1)) slot FROM s GROUP BY 1, 2, 3),
x AS (SELECT g.file_id, g.slot, g.t0 + g.slot * g.d AS grid_time, coalesce(u.n, 0) n, u.v uv, p.onset pt, p.v pv, q.onset qt, q.v qv FROM g LEFT JOIN u USING (file_id, slot) ASOF JOIN u p ON g.file_id = p.file_id AND g.slot >= p.slot ASOF JOIN u q ON g.file_id = q.file_id AND g.slot <= q.slot)
SELECT file_id, slot, grid_time, n AS n_readings, CASE WHEN n > 0 THEN uv WHEN qt - pt <= 120 AND qt > pt THEN pv + (qv - pv) * ((grid_time - pt) / (qt - pt)) END AS value,
 CASE WHEN n > 0 THEN 'observed' WHEN qt - pt <= 120 AND qt > pt THEN 'filled' ELSE 'missing' END AS status, pt AS prev_time, qt AS next_time FROM x"""


@query("p4_grid", P4_VALUES)
def _(spark, sf):
    return grid.regular_grid(_table(spark, sf, "record_onsets"), _table(spark, sf, "recordings"), "file_id", "onset", "record_duration_secs", "record_idx", 120.0)


P6 = """WITH i AS (SELECT file_id, CAST(round(onset * 1000) AS bigint) s, CAST(round(onset * 1000) AS bigint) + CAST(round(duration * 1000) AS bigint) e FROM annotations WHERE duration > 0 AND onset IS NOT NULL),
a AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM i WHERE s < e),
b AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM a),
p AS (SELECT file_id, k, min(s) s, max(e) e FROM b GROUP BY 1, 2),
n AS (SELECT file_id, s, e, lead(s) OVER (PARTITION BY file_id ORDER BY s) x FROM p)
SELECT file_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM n UNION ALL SELECT file_id, 'gap', e, x FROM n WHERE x IS NOT NULL"""


@query("p6_found", P6)
def _(spark, sf):
    # Not-a-number and infinite times cover nothing; bounds keep the milliseconds within bigint.
    ms = lambda c: F.when(F.abs(c) < 9e15, F.round(c * 1000)).cast("long")
    t = _table(spark, sf, "annotations").select("file_id", "onset", "duration").where("duration > 0 and not isnan(duration) and not isnan(onset)")
    start = ms(F.col("onset"))
    return intervals.merge(t, "file_id", start, start + ms(F.col("duration")))


P7 = """WITH lim AS (SELECT file_id, signal_index, min(digital_min) lo, max(digital_max) hi FROM signals GROUP BY ALL),
s AS (SELECT DISTINCT file_id, signal_index, record_idx, physical_first_10 p, digital_first_10 d FROM sample_snippets),
i AS (SELECT *, unnest(range(1, greatest(coalesce(len(d), 0), coalesce(len(p), 0)) + 1)) i FROM s),
e AS (SELECT file_id, signal_index, record_idx, i - 1 k, d[i] dv, p[i] pv FROM i),
m AS (SELECT file_id, signal_index, median(dv) md, median(pv) FILTER (WHERE isfinite(pv)) mp FROM e GROUP BY ALL),
w AS (SELECT file_id, signal_index, md, mp, 1.4826 * median(abs(dv - md)) sd, 1.4826 * median(abs(pv - mp)) FILTER (WHERE isfinite(pv)) sp FROM e JOIN m USING (file_id, signal_index) GROUP BY ALL),
n AS (SELECT *, lag(dv) OVER r lv FROM e WINDOW r AS (PARTITION BY file_id, signal_index, record_idx ORDER BY k)),
q AS (SELECT file_id, signal_index, record_idx, avg(CASE WHEN dv = lv THEN 1.0 ELSE 0.0 END) eq FROM n WHERE dv IS NOT NULL AND lv IS NOT NULL GROUP BY ALL),
h AS (SELECT file_id, signal_index, median(eq) > 0.5 held FROM q GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN dv = lv THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, signal_index, record_idx ORDER BY k ROWS UNBOUNDED PRECEDING) run FROM n),
c AS (SELECT *, count(dv) OVER (PARTITION BY file_id, signal_index, record_idx, run) len FROM g),
j AS (SELECT c.file_id, c.signal_index, record_idx, k, CASE WHEN dv < lo OR dv > hi OR (pv IS NOT NULL AND NOT isfinite(pv)) THEN 'impossible' WHEN coalesce(held, false) THEN NULL WHEN dv IS NOT NULL AND len >= 5 THEN 'stuck'
  WHEN abs(dv - md) > 10 * sd OR (isfinite(pv) AND abs(pv - mp) > 10 * sp) THEN 'spike' END kind
 FROM c JOIN w USING (file_id, signal_index) LEFT JOIN h USING (file_id, signal_index) LEFT JOIN lim USING (file_id, signal_index))
SELECT file_id, signal_index, record_idx, CAST(k AS int) AS sample_no, kind FROM j WHERE kind IS NOT NULL"""


@query("p7_found", P7)
def _(spark, sf):
    return faults.implausible(_table(spark, sf, "sample_snippets"), _table(spark, sf, "signals"), ["file_id", "signal_index"], "record_idx", "digital_first_10", "physical_first_10", "digital_min", "digital_max")
