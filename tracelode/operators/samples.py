"""Addressing and decoding samples. Inputs are the ``chunks`` and ``signals`` views of
the edf source or any DataFrame of that shape.

``chunks`` carries gain, offset and rate of its signal, so decoding needs no join: it is
one projection after the scan. Ranges become predicates on ``record_idx`` before any
array is touched; ``record_range`` gives the literal bounds that reach the reader, and ``page`` and
``window`` hand times to it. ``chunks`` carries each record's onset too, so true times need no join.
Null arrays give no samples; null bounds are refused on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.sources.edf import read_edf

BIG = float(2**62)


def physical_value(digital: Column, gain: Column, offset: Column) -> Column:
    """The affine transform, in the one order of operations that all reads share."""
    return digital.cast("double") * gain + offset


def decode(chunks: DataFrame) -> DataFrame:
    """Adds ``physical``, the array of physical values of each chunk."""
    return chunks.withColumn("physical", F.transform("digital", lambda d: physical_value(d, F.col("gain"), F.col("offset"))))


def ordinary(signals: DataFrame) -> DataFrame:
    """Signals that aren't annotation channels."""
    return signals.where(~F.col("is_annotation"))


def by_label(signals: DataFrame, label: str) -> DataFrame:
    """Of each file the first signal with exactly this label."""
    hit = signals.where(F.col("label") == label)
    return hit.groupBy("path").agg(F.min_by(F.struct(*[c for c in hit.columns if c != "path"]), "signal_idx").alias("s")).select("path", "s.*")


def record_range(start: int, end: int, samples_per_record: int) -> tuple[int, int]:
    """First and last record that hold samples of [start, end); (0, -1) for none."""
    if samples_per_record <= 0 or end <= start:
        return 0, -1
    return start // samples_per_record, (end - 1) // samples_per_record


def explode_range(chunks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Samples with flat index in [start, end) as rows: path, signal_idx, sample_idx, digital, physical.

    start and end may differ by row; whole chunks outside are dropped before the arrays are cut."""
    first = F.col("record_idx") * F.col("samples_per_record")
    lo, hi = F.greatest(start - first, F.lit(0)), F.least(end - first, F.col("samples_per_record"))
    cut = chunks.withColumns({"__first": first, "__lo": lo, "__n": hi - lo}).where("__n > 0")
    rows = cut.select("*", F.posexplode(F.slice("digital", F.col("__lo").cast("int") + 1, F.col("__n").cast("int"))).alias("__pos", "__digital"))
    value = F.col("__digital")
    return rows.select(
        *[c for c in chunks.columns if c not in ("digital", "physical")],
        (F.col("__first") + F.col("__lo") + F.col("__pos")).alias("sample_idx"),
        value.alias("digital"),
        physical_value(value, F.col("gain"), F.col("offset")).alias("physical"),
    )


def read_range(chunks: DataFrame, start: int, end: int, samples_per_record: int | None = None) -> DataFrame:
    """Rows of the flat range [start, end). With samples_per_record the record bounds are literals and are pushed to the reader."""
    if samples_per_record is not None:
        first, last = record_range(start, end, samples_per_record)
        chunks = chunks.where((F.col("record_idx") >= first) & (F.col("record_idx") <= last))
    return explode_range(chunks, F.lit(start).cast("long"), F.lit(end).cast("long"))


def read_strided(chunks: DataFrame, key: slice, length: int, samples_per_record: int) -> DataFrame:
    """Python slice semantics over a signal of ``length`` samples; ``out_idx`` is the place in the result."""
    start, stop, step = key.indices(length)
    picked = range(start, stop, step)
    if not len(picked):
        return read_range(chunks, 0, 0, samples_per_record).withColumn("out_idx", F.lit(0).cast("long"))
    low, high = min(picked[0], picked[-1]), max(picked[0], picked[-1])
    rows = read_range(chunks, low, high + 1, samples_per_record)
    return rows.where(F.pmod(F.col("sample_idx") - start, F.lit(abs(step))) == 0).withColumn("out_idx", ((F.col("sample_idx") - start) / step).cast("long"))


def page_bound(seconds: float, rate: Column) -> Column:
    """Flat index of a time: cut to whole samples, never negative, saturating instead of overflowing."""
    x = F.greatest(F.lit(float(seconds)), F.lit(0.0)) * rate
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.floor(F.least(x, F.lit(BIG)))).cast("long")


def page(spark, paths, t0: float, t1: float, signals: list[int] | None = None, **options) -> DataFrame:
    """``read_page`` of files: a task reads the records that hold samples of the page, and nothing else."""
    chunks = read_edf(spark, paths, "chunks", t0=t0, t1=t1, **options)
    return read_page(chunks if signals is None else chunks.where(F.col("signal_idx").isin(signals)), t0, t1)


def window(spark, paths, t0: float, t1: float, signals: list[int] | None = None, **options) -> DataFrame:
    """``time_window`` of files: a task reads its records' onsets, and then only those near the window."""
    chunks = read_edf(spark, paths, "chunks", from_time=t0, to_time=t1, **options)
    return time_window(chunks if signals is None else chunks.where(F.col("signal_idx").isin(signals)), t0, t1)


def read_page(chunks: DataFrame, t0: float, t1: float) -> DataFrame:
    """Samples of a time page: per signal the flat range [floor(t0*rate), floor(t1*rate)).

    Pages are flat-index windows also where records have gaps; see ``time_window`` for true time."""
    rate, spr, dur = F.col("sample_rate"), F.col("samples_per_record"), F.col("record_duration")
    # A record that can hold samples of the page, with one record of slack for rounding.
    if t0 > 0 or t1 < BIG:
        low = F.floor(F.lit(max(float(t0), 0.0)) / dur) - 1
        high = F.floor(F.lit(max(float(t1), 0.0)) / dur) + 1
        chunks = chunks.where(F.when(dur > 0, (F.col("record_idx") >= low) & (F.col("record_idx") <= high)).otherwise(F.lit(True)))
    chunks = chunks.where(spr > 0)
    return explode_range(chunks, page_bound(t0, rate), page_bound(t1, rate))


def select_signals(chunks: DataFrame, wanted: list[int]) -> DataFrame:
    """Chunks of the wanted signals with ``row`` as the place in the list; repeats are kept."""
    places = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(s).alias("sig")) for r, s in enumerate(wanted)])
    return chunks.where(F.col("signal_idx").isin(sorted(set(wanted)))).select("*", F.explode(F.filter(places, lambda p: p["sig"] == F.col("signal_idx"))).alias("__p")).select(*chunks.columns, F.col("__p.row").alias("row"))


def to_arrays(chunks: DataFrame, physical: bool = True) -> DataFrame:
    """One array per signal, records in order. For signals that fit a row; stream ``chunks`` otherwise."""
    one = decode(chunks) if physical else chunks
    item = "physical" if physical else "digital"
    packed = F.array_sort(F.collect_list(F.struct("record_idx", item)))
    return one.groupBy("path", "signal_idx").agg(F.flatten(F.transform(packed, lambda x: x[item])).alias("values"))


def with_times(samples: DataFrame) -> DataFrame:
    """Adds ``time_sec``: onset of the sample's record plus the sample's offset in it.

    A rate of zero gives NaN for a record's first sample and infinity after it."""
    return samples.withColumn("time_sec", sample_time(F.col("onset")))


def sample_time(onset: Column) -> Column:
    within = F.pmod(F.col("sample_idx"), F.greatest(F.col("samples_per_record"), F.lit(1)))
    rate = F.col("sample_rate")
    zero = F.when(within == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    # the unused branch must not divide by zero either
    return onset + F.when(rate == 0, zero).otherwise(within / F.when(rate == 0, F.lit(1.0)).otherwise(rate))


def time_window(chunks: DataFrame, t0: float, t1: float) -> DataFrame:
    """Samples with true time in [t0, t1), also across gaps. Records are pruned by onset before arrays are opened."""
    near = chunks.where((F.col("onset") < t1) & (F.col("onset") + F.col("record_duration") > t0))
    rows = with_times(explode_range(near, F.lit(0).cast("long"), F.lit(2**62).cast("long")))
    return rows.where((F.col("time_sec") >= t0) & (F.col("time_sec") < t1))


def rate_groups(signals: DataFrame) -> DataFrame:
    """Ordinary signals of each file by sample rate rounded to whole Hz."""
    return ordinary(signals).groupBy("path", F.floor(F.col("sample_rate") + 0.5).cast("long").alias("rate_hz")).agg(F.array_sort(F.collect_list("signal_idx")).alias("signal_indices"))


def labels(signals: DataFrame) -> DataFrame:
    """All labels of each file, in order."""
    return signals.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("signal_idx", "label"))), lambda x: x["label"]).alias("labels"))


def proxy_shape(signals: DataFrame) -> DataFrame:
    """Rows and columns of the 2-D view over each file's given signals; ``mixed`` where their rates differ."""
    spread = F.max("sample_rate") - F.min("sample_rate")
    return signals.groupBy("path").agg(F.count("*").alias("n_signals"), F.min_by("num_samples", "signal_idx").alias("n_samples"), (spread > 1e-9).alias("mixed"))


def read_rect(chunks: DataFrame, wanted: list[int], start: int, end: int, samples_per_record: int) -> DataFrame:
    """The rectangle (wanted signals x [start, end)) in long form: row, col, digital, physical."""
    rows = read_range(select_signals(chunks, wanted), start, end, samples_per_record)
    return rows.withColumn("col", F.col("sample_idx") - start)
