"""Implausible samples: impossible readings, stuck values and spikes, relative to their source.

Each snippet is decomposed by an undecimated Haar wavelet into detail coefficients of ``LEVELS``
dyadic scales and a smooth rest. They add up to the samples, and their mean squares add up to
the samples' mean square, so a source's usual level and spread come from its coefficients:

* level: median of the smooth coefficients;
* scale of each detail level: scaled median of its absolute coefficients, and of the smooth rest
  its scaled median deviation within snippets together with the quartiles between them;
* spread: root of the sum of the squared scales. A source that pulses (low for most of its time,
  high for some samples of each snippet) has large coefficients at the scale of the pulses, which
  the median deviation of its samples would not see.

A coefficient beyond ``SIGNIFICANT`` scales of its level is significant, and a sample is a
candidate for a spike if one of its coefficients is. A candidate is then held against the stated limit of
ten spreads from the level. Runs of zero detail at the finest scale reveal sticking, and sources
with mostly zero detail there hold their level by nature. Bounds show impossible readings.

All figures are medians over a source's snippets of each snippet's median, from mergeable quantile
sketches with partial aggregation, so a source may hold any share of the rows; only those sketches
and each snippet once are shuffled. The join of snippets with their source's figures is left to
adaptive execution, which splits hot sources.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS, RUN, LIMIT, SIGNIFICANT = 3, 5, 10.0, 4.0


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x longest array of doubles, which elements are there): lists side by side, NaN where there is nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(column.value_lengths().fill_null(0))
    width = max(int(n.max(initial=0)), 1)
    flat = column.flatten()
    there = np.asarray(flat.is_valid())
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out, has = np.full((len(n), width), np.nan), np.zeros((len(n), width), bool)
    where = np.arange(width) < n[:, None]
    out[where], has[where] = values, there
    return out, has


def _median(x: np.ndarray) -> np.ndarray:
    """Of each row the median of its finite values, NaN without any."""
    x = np.sort(np.where(np.isfinite(x), x, np.nan), axis=1)
    n = np.isfinite(x).sum(1)
    rows = np.arange(len(x))
    a, b = x[rows, np.maximum(n - 1, 0) // 2], x[rows, np.minimum(n // 2, x.shape[1] - 1)]
    return np.where(n > 0, (a + b) / 2, np.nan)


def details(x: np.ndarray) -> list[np.ndarray]:
    """Additive wavelet parts of each row: details of the scales, then the smooth rest."""
    parts, c = [], x
    for j in range(LEVELS):
        lag = min(2**j, x.shape[1])
        before = np.concatenate([c[:, :lag][:, ::-1], c[:, :-lag]], axis=1) if lag < x.shape[1] else c[:, ::-1]
        smooth = (c + before) / 2
        parts.append(c - smooth)
        c = smooth
    return [*parts, c]


def _filled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples with the snippet's median where there's no finite one, which are finite)."""
    ok = np.isfinite(x)
    return np.where(ok, x, np.nan_to_num(_median(x))[:, None]), ok


def _calm(x: np.ndarray) -> np.ndarray:
    """Rows with elements far from the median of five neighbouring ones put there: one or two odd samples go, pulses of three stay."""
    n = x.shape[1]
    size = min(5, n)
    begin = np.clip(np.arange(n) - size // 2, 0, n - size)  # windows at the ends stay inside
    middle = np.sort(x[:, begin[:, None] + np.arange(size)], axis=2)[:, :, size // 2]
    far = 1.4826 * _median(np.abs(x - _median(x)[:, None]))[:, None] * LIMIT
    return np.where(np.abs(x - middle) > far, middle, x)


def coefficients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (median of its smooth coefficients; scale of each detail level, then of the smooth rest within it).

    Odd samples are calmed beforehand, as each would spread over several coefficients of the coarser scales."""
    full, ok = _filled(x)
    parts = [np.where(ok, p, np.nan) for p in details(_calm(full))]
    level = _median(parts[-1])
    return level, np.stack([1.4826 * _median(np.abs(p)) for p in parts[:-1]] + [1.4826 * _median(np.abs(parts[-1] - level[:, None]))], axis=1)


def flat(x: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Where the finest detail between an element and the one before it is zero (first column: never)."""
    out = np.zeros(x.shape, bool)
    out[:, 1:] = ((x[:, 1:] - x[:, :-1]) / 2 == 0) & has[:, 1:] & has[:, :-1]
    return out


def runs(zero: np.ndarray) -> np.ndarray:
    """Length of the run of elements without finest detail that each element is part of."""
    ahead, back = np.ones(zero.shape, np.int32), np.ones(zero.shape, np.int32)
    for t in range(1, zero.shape[1]):
        back[:, t] = np.where(zero[:, t], back[:, t - 1] + 1, 1)
        u = zero.shape[1] - 1 - t
        ahead[:, u] = np.where(zero[:, u + 1], ahead[:, u + 1] + 1, 1)
    return ahead + back - 1


SIDES = ("d", "p")
FIGURES = [f"{n}{side}" for side in SIDES for n in ("m", *(f"s{j}" for j in range(LEVELS + 1)))]


def _snippet_figures(batches):
    for b in batches:
        out = []
        for side, name in zip(SIDES, ("digital", "physical")):
            x, has = matrix(b[name])
            level, scales = coefficients(x)
            out += [level, *scales.T]
            if side == "d":
                pairs = (has[:, 1:] & has[:, :-1]).sum(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    held = np.where(pairs > 0, flat(x, has).sum(1) / pairs, np.nan)
        none = lambda x: pa.array(x, pa.float64(), mask=~np.isfinite(x))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"], *map(none, out), none(held)], names=["a", "b", *FIGURES, "held"])


def _judge(batches):
    for b in batches:
        d, has = matrix(b["digital"])
        p, phas = matrix(b["physical"])
        width = max(d.shape[1], p.shape[1])
        grow = lambda x, v: np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=v)
        d, p, has, phas = grow(d, np.nan), grow(p, np.nan), grow(has, False), grow(phas, False)
        col = lambda n: b[n].to_numpy(zero_copy_only=False).astype(float)[:, None]
        steady = np.asarray(b["held"].fill_null(0.0)) > 0.5
        with np.errstate(invalid="ignore"):
            impossible = (has & ((d < col("dmin")) | (d > col("dmax")))) | (phas & ~np.isfinite(p))
            stuck = has & (runs(flat(d, has)) >= RUN) & ~steady[:, None]
            spike = np.zeros(d.shape, bool)
            for x, side in zip((d, p), SIDES):
                mid, spread = col(f"level_{side}"), col(f"spread_{side}")
                full, ok = _filled(x)
                candidate = np.zeros(x.shape, bool)
                for j, part in enumerate(details(full - mid)):
                    candidate |= np.abs(part) > SIGNIFICANT * col(f"scale{j}_{side}")
                spike |= ok & candidate & (np.abs(x - mid) > LIMIT * spread)
            spike &= ~steady[:, None]
        kind = np.where(impossible, 1, np.where(stuck, 2, np.where(spike, 3, 0)))
        r, s = np.nonzero(kind)
        rows = pa.array(r)
        yield pa.RecordBatch.from_arrays(
            [b["a"].take(rows), b["b"].take(rows), b["c"].take(rows), pa.array(s.astype(np.int32)), pa.array(np.array(["", "impossible", "stuck", "spike"], object)[kind[r, s]], pa.string())],
            names=["a", "b", "c", "sample_no", "kind"],
        )


def source_figures(rows: DataFrame) -> DataFrame:
    """a, b (the source), held, and of each side its level, spread and scales. Input: a, b, digital, physical."""
    kinds = dict(rows.dtypes)
    figures = rows.select("a", "b", "digital", "physical").mapInArrow(_snippet_figures, f"a {kinds['a']}, b {kinds['b']}, {', '.join(f + ' double' for f in FIGURES)}, held double")
    mid = lambda c: F.percentile_approx(c, 0.5, 1000)
    quart = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 1000)
    per = figures.groupBy("a", "b").agg(*[(quart if f.startswith("m") else mid)(f).alias(f) for f in FIGURES], mid("held").alias("held"))
    out = ["a", "b", "held"]
    for side, least in zip(SIDES, (0.5, 0.0)):
        square = lambda c: F.pow(F.coalesce(c, F.lit(0.0)), 2)
        between = (F.col(f"m{side}")[2] - F.col(f"m{side}")[0]) / 1.349
        scales = [F.col(f"s{j}{side}") for j in range(LEVELS)] + [F.sqrt(square(F.col(f"s{LEVELS}{side}")) + square(between))]
        spread = F.greatest(F.sqrt(sum(square(c) for c in scales)), F.lit(least))
        # A source without any spread has no usual one to hold its samples against.
        out += [F.col(f"m{side}")[1].alias(f"level_{side}"), F.when(spread > 0, spread).alias(f"spread_{side}"), *[F.coalesce(c, F.lit(0.0)).alias(f"scale{j}_{side}") for j, c in enumerate(scales)]]
    return per.select(*out)


def implausible(snippets: DataFrame, limits: DataFrame, source: list[str], record: str, digital: str, physical: str, low: str, high: str) -> DataFrame:
    """Columns: the two source columns, record, sample_no (from 0), kind: the first that applies of
    'impossible', 'stuck', 'spike'. One row for each such sample; repeated rows give it once.

    impossible: digital value outside [low, high] of ``limits`` (null limits bound nothing), or physical value not finite.
    stuck: one of at least 5 equal digital values in a row of a snippet. spike: in either array further from the
    source's level than ten times its spread. Sources that mostly hold their value (median share of equal neighbours
    over a half) have neither. Null elements are no samples and end a run; null and empty arrays have none; arrays may be
    of any length. Rows with a null source are left out. If a source has several limits, the widest count."""
    a, b = source
    rows = snippets.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(record).alias("c"), F.col(digital).alias("digital"), F.col(physical).alias("physical")).where("a is not null and b is not null")
    kinds = dict(rows.dtypes)
    bounds = limits.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi")).groupBy("a", "b").agg(F.min("lo").alias("dmin"), F.max("hi").alias("dmax"))
    known = source_figures(rows).join(bounds, ["a", "b"], "left")
    judged = rows.join(known, ["a", "b"]).mapInArrow(_judge, f"a {kinds['a']}, b {kinds['b']}, c {kinds['c']}, sample_no int, kind string")
    return judged.dropDuplicates().select(F.col("a").alias(a), F.col("b").alias(b), F.col("c").alias(record), "sample_no", "kind")
