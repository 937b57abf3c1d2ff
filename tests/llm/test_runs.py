import random

import pytest

from tracelode.llm import runs

SCHEMA = "g bigint, id bigint, t double, d double, text string, event string"


def collapse(spark, rows):
    out = runs.collapse(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), "g", "id", "t", "d", "text")
    assert out.columns == ["g", "event", "first_id", "last_id", "n_events", "start", "seconds"]
    return sorted((r.g, r.first_id, r.last_id, r.n_events) for r in out.collect())


def test_spellings(spark):
    rows = [(1, i, float(i), 1.0, t) for i, t in enumerate(["Sleep stage N1"] * 12 + ["SLEEP-STAGE N1.", "Slepe stage N1", "[Seep_stagge n1]", "Sleep stage N2", "sleep stage n2", "Sleep stage W"])]
    rows += [(2, 50 + i, 5.0, None, t) for i, t in enumerate(["leak flow", "leak flaw", "Leak  Flow!", "leak flow"])]  # short words must agree
    assert collapse(spark, rows) == [(1, 0, 14, 15), (1, 15, 16, 2), (2, 52, 53, 2)]


def test_left_out_ties_and_repeats(spark):
    rows = [(1, 3, 1.0, None, "a b"), (1, 2, 1.0, -1.0, "A B"), (1, 2, 1.0, -1.0, "A B"), (1, 4, 2.0, 5.0, None), (1, 5, 2.5, 5.0, "  "), (1, 6, 3.0, float("nan"), "a  b"), (1, 7, None, 1.0, "a b"), (None, 8, 4.0, 1.0, "a b"), (1, 9, 9.0, 1.0, "c"), (1, None, 9.5, 1.0, "c"), (1, 10, 10.0, 1.0, "..."), (1, 11, 11.0, 1.0, "!")]
    assert collapse(spark, rows) == [(1, 2, 6, 3), (1, 10, 11, 2)]
    assert collapse(spark, rows[:0]) == []


def test_durations(spark):
    rows = [(1, 1, 0.0, 9.0, "x"), (1, 2, 1.0, 1.0, "x"), (1, 3, 4.0, None, "x")]
    r = runs.collapse(spark.createDataFrame([(*x, "") for x in rows], SCHEMA), "g", "id", "t", "d", "text").first()
    assert (r.start, r.seconds) == (0.0, 9.0)


def test_one_group_over_many_partitions(spark):
    rnd = random.Random(7)
    rows, t = [], 0.0
    for i in range(3000):
        t += rnd.choice([0.0, 0.5])
        rows.append((1 if i < 2500 else i % 3 + 2, i, t, 1.0, rnd.choice(["alpha", "beta", "beta", "beta", "beta", "beta"])))
    want = []
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        i = 0
        while i < len(mine):
            j = i
            while j + 1 < len(mine) and mine[j + 1][4] == mine[i][4]:
                j += 1
            if j > i:
                want.append((g, mine[i][1], mine[j][1], j - i + 1))
            i = j + 1
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert collapse(spark, rows) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")


@pytest.mark.parametrize("a,b,near", [("stage", "stagge", True), ("stage", "stge", True), ("stage", "stgae", True), ("stage", "stabe", True), ("stage", "stags", True), ("stage", "sta", False), ("stage", "stagees", False), ("abcde", "badce", False)])
def test_patterns(a, b, near):
    pa, pb = dict(runs._patterns(a)), dict(runs._patterns(b))
    shared = [p for p in pa.keys() & pb.keys() if not p.startswith("d") or pa[p] != pb[p]]
    assert bool(shared) == near


def test_long_words():
    """Words of over WHOLE letters are compared by hashes, across the limit too."""
    rnd = random.Random(3)
    for n in (runs.WHOLE - 1, runs.WHOLE, runs.WHOLE + 1, 300):
        w = "".join(rnd.choices("abcdefgh", k=n))
        i = n // 2
        for other in (w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :]):
            pa, pb = dict(runs._patterns(w)), dict(runs._patterns(other))
            assert other == w or any(not p.startswith("d") or pa[p] != pb[p] for p in pa.keys() & pb.keys())
        far = dict(runs._patterns("y" + w[1:-1] + "y"))
        assert not [p for p in far.keys() & dict(runs._patterns(w)).keys() if not p.startswith("d")]


def test_very_long_text(spark):
    rows = [(1, i, float(i), 1.0, t) for i, t in enumerate(["x" * 30_000 + " end", "X" * 30_000 + " END", "word " * 20_000, "other"])]
    assert collapse(spark, rows) == [(1, 0, 1, 2)]
