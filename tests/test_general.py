"""The general operators against brute force, and on nulls, ties, repeats, empty tables and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import faults, grid, hot, intervals, packed, units


# --- packed fields -----------------------------------------------------------------


def unpacked(spark, texts, field="f"):
    df = spark.createDataFrame(list(enumerate(texts)), f"k bigint, {field} string")
    rows = packed.unpack(df, "k", [field]).collect()
    return {k: [(r.pos, r.val) for r in sorted((r for r in rows if r.k == k), key=lambda r: r.pos)] for k in range(len(texts))}


def test_packed_dialects(spark):
    got = unpacked(spark, [
        "A-1;M;01-JAN-2000;Ann Lee", "A-2, F,,02-FEB-2001,\"Lee, Bo\"", "A-3 M  03-MAR-2002 Cy_Lee", "b'A-4|F|04-APR-2003|Di Lee'", "A-5\tM\t\t05-MAY-2004\t Ed Lee",
        "A-6 / F / 06-JUN-2005 / ward 4/2", "A-7 M 07-JUL-2006 \"Lee, Flo\" O'Bren_ward", "'A-8'^F^'Gus ''Gee'' Lee'^", "  ", None, "", "X", ";;X;", "A-9;M, 1999|\"a\"\"b\" ",
        "12\" x;it's 'so", "A-10 \"unclosed",
    ])
    assert got[0] == [(1, "A-1"), (2, "M"), (3, "01-JAN-2000"), (4, "Ann Lee")]
    assert got[1] == [(1, "A-2"), (2, "F"), (4, "02-FEB-2001"), (5, "Lee, Bo")]
    assert got[2] == [(1, "A-3"), (2, "M"), (3, "03-MAR-2002"), (4, "Cy_Lee")]
    assert got[3] == [(1, "A-4"), (2, "F"), (3, "04-APR-2003"), (4, "Di Lee")]
    assert got[4] == [(1, "A-5"), (2, "M"), (4, "05-MAY-2004"), (5, "Ed Lee")]
    assert got[5] == [(1, "A-6"), (2, "F"), (3, "06-JUN-2005"), (4, "ward 4/2")]
    assert got[6] == [(1, "A-7"), (2, "M"), (3, "07-JUL-2006"), (4, "Lee, Flo"), (5, "O'Bren_ward")]
    assert got[7] == [(1, "A-8"), (2, "F"), (3, "Gus 'Gee' Lee")]
    assert got[8] == got[9] == got[10] == [] and got[11] == [(1, "X")] and got[12] == [(3, "X")]
    assert got[13] == [(1, "A-9"), (2, "M"), (3, "1999"), (4, 'a"b')]
    assert got[14] == [(1, '12" x'), (2, "it's 'so")] and got[15] == [(1, "A-10"), (2, '"unclosed')]


def test_code_lengths_decide(spark):
    """With separators inside quotes the first candidate is wrong, and so is the one with the fewest bits besides its values'."""
    hard = [f"B-{i} F 0{i}-MAY-2001 Al_Bo \"mask, size M\" 7{i}kg" for i in range(9)]
    plain = [f"C-{i} M 0{i}-JUN-1999 Di_Lee" for i in range(9)]
    right = lambda i: [(1, f"B-{i}"), (2, "F"), (3, f"0{i}-MAY-2001"), (4, "Al_Bo"), (5, "mask, size M"), (6, f"7{i}kg")]
    got = unpacked(spark, hard + plain)
    assert all(got[i] == right(i) for i in range(9))
    assert all([(k, v) for k, v in enumerate(packed.candidates(s)[0][0], 1)] != right(i) for i, s in enumerate(hard))
    # Years like '98 and names like Dan' enclose nothing where the corpus has either mark alone.
    marks = [f"'{70 + i % 20};M;Kim" for i in range(300)] + [f"{i % 90 + 10};M;Dan'" for i in range(300)]
    codes = {}
    for s in marks:
        for v, _ in packed.candidates(s):
            for x in v:
                codes[packed.shape(x)] = codes.get(packed.shape(x), 0) + 1
    assert codes["'9"] >= 300 and codes["a'"] >= 300 and packed.shape("98;M;Dan") not in codes


def test_packed_edges(spark):
    df = spark.createDataFrame([(1, "a;b", "x", "y"), (1, "a;b", "x", "z"), (2, ";".join("v%d" % i for i in range(5000)), None, None), (None, "q", "", "")], "k bigint, f string, name string, text string")
    out = packed.unpack(df, "k", ["f", "name"])
    assert out.columns == ["k", "field_name", "pos", "val"]
    rows = out.collect()
    assert sum(r.k == 1 for r in rows) == 3 and sum(r.k == 2 for r in rows) == 5000 and [r.val for r in rows if r.k is None] == ["q"]
    assert packed.unpack(df.limit(0), "k", ["f"]).count() == 0


# --- units -------------------------------------------------------------------------

UNITS = [(1, "uV", "voltage", True), (2, "mV", "voltage", False), (3, "V", "voltage", False), (4, "degC", "temperature", True), (5, "degF", "temperature", False), (6, "K", "temperature", False), (9, "furlong", "length", False)]


@pytest.mark.parametrize("text,unit", [("uV", "uV"), (" µV ", "uV"), ("μV", "uV"), ("(1e-6 V)", "uV"), ("m V", "mV"), ("mV.", "mV"), ("cm.H2O", "cmH2O"), ("mm(Hg)", "mmHg"), ("0..1", "fraction"), ("℃", "degC"), ("/s", "Hz"), ("m s-2", "m/s2"), ("m/s²", "m/s2"), ("mG", "mg"), ("umho", "uS"), ("X", None), ("-", None), ("", None), (None, None), ("counts", None), ("12 mV", None)])
def test_unit_names(text, unit):
    assert units.unit_named(text) == unit


@pytest.mark.parametrize("text,unit", [("EEG C3 [uV]", "uV"), ("EEG /uV", "uV"), ("EEG (mV.)", "mV"), ("Pulse [/min]", "1/min"), ("cup; values in u V", "uV"), ("cup, output in mmHg", "mmHg"), ("none unit:0..1", "fraction"), ("LP:15Hz, scaled to K", "K"), ("cup (test load 12 mV)", None), ("cup, 5 V supply", None), ("HP:0.1Hz LP:75Hz", None), ("N:60Hz", None), ("C3/A2", None), ("Ag/AgCl cup", None), (None, None)])
def test_unit_statements(text, unit):
    assert units.unit_stated(text) == unit


def harmonise(spark, rows, devices=((1, "d"),)):
    s = spark.createDataFrame(rows, "f bigint, i int, dim string, lo double, hi double, label string, note string, device string")
    d = spark.createDataFrame(list(devices), "f bigint, device string")
    u = spark.createDataFrame(UNITS, "unit_id bigint, symbol string, quantity string, is_common boolean")
    return units.harmonise(s, d, u, "f", "i", ["device"], "dim", "lo", "hi", ["label", "note"])


def test_units(spark):
    rows = [(1, i, "uV", -400.0, 400.0, "EEG", None, "x") for i in range(8)] + [(1, 20, "mV", -0.4, 0.4, "EEG", None, None), (1, 20, "mV", -0.4, 0.4, "EEG", None, None), (1, 21, "-", -0.4, 0.4, "EEG [mV]", None, None), (1, 22, None, -0.4, 0.4, "EEG", "12 mV load", None), (2, 0, "F", 212.0, 32.0, "Temp", None, None), (2, 1, "K", None, 373.15, "Temp", None, None), (2, 2, "", None, None, None, None, None), (3, 0, "furlong", 0.0, 8.0, None, None, None), (None, 2, "uV", 0.0, 1.0, None, None, None)]
    got = {(r.f, r.i): r for r in harmonise(spark, rows).collect()}
    assert len(got) == 15 and got[1, 0].is_common and got[1, 0].common_max == 400
    for i in (20, 21):
        assert (got[1, i].symbol, got[1, i].source, got[1, i].common_max) == ("mV", "stated", pytest.approx(400.0))
    assert (got[1, 22].symbol, got[1, 22].source) == ("mV", "inferred")  # the jump by a thousand tells
    assert (got[3, 0].symbol, got[3, 0].source, got[3, 0].common_max) == ("furlong", "stated", None)  # no conversion is known
    assert got[2, 0].symbol == "degF" and got[2, 0].common_min == pytest.approx(100) and got[2, 0].common_max == pytest.approx(0)
    assert got[2, 1].symbol == "K" and got[2, 1].common_min is None and got[2, 1].common_max == pytest.approx(100)
    assert got[2, 2].source == "inferred"
    assert harmonise(spark, rows).where("f = 99").count() == 0
    s = spark.createDataFrame([], "f bigint, i int, dim string, lo double, hi double, label string, note string, device string")
    d = spark.createDataFrame([], "f bigint, device string")
    u = spark.createDataFrame(UNITS, "unit_id bigint, symbol string, quantity string, is_common boolean")
    assert units.harmonise(s, d, u, "f", "i", ["device"], "dim", "lo", "hi", ["label"]).count() == 0


def drifting(n=120):
    """One channel whose gain drifts; its unit switches for a stretch, where the unit's text is missing or a letter away from four units."""
    rows = []
    for f in range(n):
        size = 200.0 * 1.03**f
        switched = n // 3 <= f < 2 * n // 3
        dim = ("xvolt" if f % 3 else None) if switched else "uV"
        size = size / 1000 if switched else size
        rows.append((f, 0, dim, -size, size, "EEG C3", None, None))
    return rows


def test_viterbi_decides(spark):
    """Texts alone leave a mistyped or missing unit open; the jumps and the smooth level give it."""
    rows = drifting()
    got = {r.f: r for r in harmonise(spark, rows).collect()}
    assert all(got[f].symbol == ("mV" if 40 <= f < 80 else "uV") for f in range(120))
    assert {got[f].source for f in range(40, 80)} == {"mistyped", "inferred"}
    assert sum(units.unit_named(r[2]) is None for r in rows) == 40  # what a look-up alone can't tell


def test_blocks_of_any_size_agree(spark, monkeypatch):
    rows = drifting(300)
    whole = sorted(map(tuple, harmonise(spark, rows).collect()))
    monkeypatch.setattr(units, "BLOCK", 80)
    monkeypatch.setattr(units, "CONTEXT", 40)
    assert sorted(map(tuple, harmonise(spark, rows).collect())) == whole
    # Rows of a key that differ: the same one counts in any order.
    twice = rows + [(r[0], r[1], "nV", *r[3:]) for r in rows[:5]]
    assert sorted(map(tuple, harmonise(spark, twice).collect())) == sorted(map(tuple, harmonise(spark, twice[::-1]).collect()))


def test_more_texts(spark):
    s = spark.createDataFrame([(1, 0, None, -0.4, 0.4, "EEG", None, None, None, "values in mV")], "f bigint, i int, dim string, lo double, hi double, a string, b string, c string, d string, e string")
    u = spark.createDataFrame(UNITS, "unit_id bigint, symbol string, quantity string, is_common boolean")
    out = units.harmonise(s, s.select("f", F.lit("x").alias("dev")), u, "f", "i", ["dev"], "dim", "lo", "hi", ["a", "b", "c", "d", "e"])
    assert [(r.symbol, r.source) for r in out.collect()] == [("mV", "stated")]


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    score = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
    assert score(units.viterbi(e, t)) == pytest.approx(max(map(score, itertools.product(range(3), repeat=5))))
    both = units.viterbi(np.concatenate([e, e[:2], e]), t, starts=np.array([0, 5, 7]))
    assert both.tolist() == [*units.viterbi(e, t), *units.viterbi(e[:2], t), *units.viterbi(e, t)]


# --- regular grid ------------------------------------------------------------------


def brute_grid(readings, steps, limit=None):
    out = {}
    for src, d in steps.items():
        ts = sorted((t, v) for s, t, v in readings if s == src and t is not None)
        if not ts or not d or d <= 0:
            continue
        t0, slots = ts[0][0], {}
        for t, v in ts:
            slots.setdefault(int(np.floor((t - t0) / d + 0.5)), []).append((t, v))
        for k in range(max(slots) + 1):
            if k in slots:
                out[src, k] = ("observed", min(slots[k])[1])
            else:
                (p, pv), (q, qv) = min(slots[max(x for x in slots if x < k)]), min(slots[min(x for x in slots if x > k)])
                g = t0 + k * d
                out[src, k] = ("filled", pv + (qv - pv) * (g - p) / (q - p)) if limit is None or q - p <= limit else ("missing", None)
    return out


@pytest.mark.parametrize("limit", [None, 30.0])
def test_grid(spark, monkeypatch, limit):
    monkeypatch.setattr(grid, "SHARD", 4)
    rnd = random.Random(5)
    readings = [(s, round(rnd.uniform(0, 300), 3), rnd.random()) for s in range(4) for _ in range(rnd.choice([1, 5, 25]))] + [(1, None, 1.0), (None, 5.0, 1.0), (7, 3.0, 1.0), (8, 5.0, 5.0)]
    readings += readings[:3]
    steps = {0: 2.0, 1: 7.5, 2: 10.0, 3: 1.0, 7: 0.0, 8: None, 9: 5.0}
    r = spark.createDataFrame([(*x, "noise") for x in readings], "src bigint, t double, v double, slot string")
    s = spark.createDataFrame([(k, d, 1) for k, d in steps.items()] * 2, "src bigint, d double, v int")
    got = grid.regular_grid(r, s, "src", "t", "d", "v", limit)
    assert got.columns == ["src", "slot", "grid_time", "n_readings", "value", "prev_time", "next_time", "status"]
    rows = {(x.src, x.slot): x for x in got.collect()}
    want = brute_grid(readings, steps, limit)
    assert rows.keys() == want.keys() and got.count() == len(want)
    for k, (status, value) in want.items():
        assert rows[k].status == status and rows[k].value == (None if value is None else pytest.approx(value))


def test_grid_empty_and_far(spark, monkeypatch):
    monkeypatch.setattr(grid, "SHARD", 8)
    r = spark.createDataFrame([(1, 0.0), (1, 1000.0), (1, float("nan")), (1, float("inf"))], "src bigint, t double")
    s = spark.createDataFrame([(1, 1.0)], "src bigint, d double")
    assert grid.regular_grid(r, s, "src", "t", "d").where("status <> 'observed'").count() == 999
    assert grid.regular_grid(r.limit(0), s, "src", "t", "d").count() == 0 and grid.regular_grid(r, s.limit(0), "src", "t", "d").count() == 0


# --- intervals ---------------------------------------------------------------------


def brute_merge(rows):
    out = []
    for e in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((s, t) for x, s, t in rows if x == e and s is not None and t is not None and s < t)
        merged = []
        for s, t in iv:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out += [(e, "period", a, b) for a, b in merged] + [(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("shard,spread,longest", [(10, 200, 30), (10, 200, 150), (1000, 500, 20), (7, 60, 9)])
def test_intervals(spark, monkeypatch, shard, spread, longest):
    monkeypatch.setattr(intervals, "SHARD_MS", shard)
    rnd = random.Random(shard + longest)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), a := rnd.randrange(-50, spread), a + rnd.randrange(-2, longest)) for _ in range(80)] + [(4, 0, 10), (4, 10, 20), (4, 20, 30), (4, 40, 50), (5, None, 5), (5, 5, None), (None, 1, 9), (6, 3, 3)]
    rows += rows[:9]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "ent bigint, s bigint, e bigint, shard int, kind string")
    got = intervals.merge(df, "ent", F.col("s"), F.col("e"))
    assert got.columns == ["ent", "kind", "start_ms", "end_ms"] and sorted(map(tuple, got.collect())) == brute_merge(rows)


def test_intervals_empty(spark):
    assert intervals.merge(spark.createDataFrame([], "ent bigint, s bigint, e bigint"), "ent", F.col("s"), F.col("e")).count() == 0


# --- faults ------------------------------------------------------------------------


def judge(spark, rows, limits):
    s = spark.createDataFrame([(*r, 0.0, "x") for r in rows], "f bigint, i int, r bigint, d array<int>, p array<double>, held double, kind string")
    lim = spark.createDataFrame(limits, "f bigint, i int, lo int, hi int")
    return sorted(map(tuple, faults.implausible(s, lim, ["f", "i"], "r", "d", "p", "lo", "hi").collect()))


def test_faults(spark):
    rnd = random.Random(2)
    noise = lambda: [100 + rnd.randrange(-5, 6) + k % 2 * 20 for k in range(10)]
    rows = [(1, 0, r, d := noise(), [x * 0.5 for x in d]) for r in range(20)]
    d = rows[3][3]
    d[4] = 900
    rows[5][4][2] = -900.0
    rows[6][3][:6] = [7] * 6
    rows[7][3][9] = 5000
    rows[8][4][0], rows[8][4][1] = float("nan"), float("inf")
    rows += [rows[3], (1, 0, 21, [], []), (1, 0, 22, None, None), (1, 0, 23, [100, None, 121], None), (1, 0, 24, [None] * 6, [None] * 6), (None, 0, 1, [9999], [1.0])]
    rows += [(2, 0, r, [5] * 10 if r % 3 else [5] * 6 + [9] * 4, [5.0] * 10) for r in range(9)] + [(2, 0, 10, [99] * 10, [5.0] * 10)]
    rows += [(3, 0, 0, [1, 2, 3], [1.0, 2.0, 3.0])]
    got = judge(spark, rows, [(1, 0, -1000, 1000), (1, 0, None, None), (2, 0, 0, 50)])
    want = [(1, 0, 3, 4, "spike"), (1, 0, 5, 2, "spike"), (1, 0, 7, 9, "impossible"), (1, 0, 8, 0, "impossible"), (1, 0, 8, 1, "impossible")]
    want += [(1, 0, 6, k, "stuck") for k in range(6)] + [(2, 0, 10, k, "impossible") for k in range(10)]
    assert got == sorted(want)
    assert judge(spark, rows[:0], []) == []


def test_wavelet_parts_and_scales():
    rng = np.random.default_rng(3)
    x = rng.normal(5.0, 2.0, size=(4000, 10))
    parts = faults.details(x)
    assert np.allclose(sum(parts), x)
    _, scales = faults.coefficients(x)
    assert np.sqrt((np.median(scales, axis=0) ** 2).sum()) == pytest.approx(2.0, rel=0.2)
    assert faults.coefficients(np.full((1, 10), np.nan))[0].tolist() != [0.0]


def pulses(level=0):
    """A source that pulses for three to four samples of each snippet, with one true spike."""
    rnd = random.Random(9)
    rows = []
    for r in range(30):
        start, n = rnd.randrange(1, 6), rnd.choice([3, 4])
        rows.append((1, 0, r, d := [level + rnd.randrange(-2, 3) + (100 if start <= k < start + n else 0) for k in range(10)], [float(x) for x in d]))
    rows[4][3][9], rows[4][4][9] = 1500, 1500.0
    return rows


def test_wavelet_scales_decide(spark):
    """Median and median deviation of the samples take every pulse for a spike; the scales of the coefficients don't."""
    rows = pulses()
    every = np.array([x for r in rows for x in r[3]], float)
    mid = np.median(every)
    plain = np.abs(every - mid) > faults.LIMIT * 1.4826 * np.median(np.abs(every - mid))
    assert plain.sum() > 80
    assert judge(spark, rows, []) == [(1, 0, 4, 9, "spike")]


# --- helpers -----------------------------------------------------------------------


def test_positions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", None]), rnd.randrange(100), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = {r.i: r.n for r in hot.positions(df, ["k"], ["t", "i"], F.floor(F.col("t") / 7), "n").collect()}
    for k in ("a", None):
        mine = [i for _, _, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        assert [got[i] for i in mine] == list(range(1, len(mine) + 1))


def test_scratch_is_deleted(spark):
    from pathlib import Path

    with hot.scratch():
        table = hot.materialize(spark.range(3), "t")
        path = Path(table.inputFiles()[0].removeprefix("file://")).parent
        assert table.count() == 3 and path.exists()
    assert not path.exists()


def test_small_is_checked(spark):
    one = spark.range(5)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(hot.small(one, 5)) and not hinted(hot.small(one, 4))
