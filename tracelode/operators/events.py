"""Annotations, record onsets, gaps and warnings from the ``tals`` and ``recordings`` views.

A record's row carries its onset, that of the record before and that of the file's first record, and
onset faults are found by the reader. So onsets, gaps and faults are projections of one scan; annotations and
warnings, which are numbered, take two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators.hot import positions

RECORDS = ("record", "uniform")


def raw_onsets(tals: DataFrame) -> DataFrame:
    """One row per scanned record: path, record_idx, variant, record_duration, raw onset, start (the first record's), before (of the record before), missing (calculated, as the lists have none or couldn't be scanned), uniform."""
    rows = tals.where(F.col("kind").isin(*RECORDS))
    return rows.select("path", "record_idx", "variant", "record_duration", F.col("onset").alias("raw"), "start", "before", "missing", (F.col("kind") == "uniform").alias("uniform"))


def file_offsets(raw: DataFrame) -> DataFrame:
    """Per file the first record's onset, which all other times are relative to."""
    return raw.groupBy("path").agg(F.max("start").alias("starttime_subsecond"))


def _effective(scan, record_idx):
    """What sample times use: scan onsets count in EDF+D only."""
    return F.when(F.col("variant") == "EDF+D", scan).otherwise(record_idx * F.col("record_duration"))


def record_onsets(tals: DataFrame) -> DataFrame:
    """path, record_idx, scan_onset (normalised), onset (what sample times use), before (of the record before, in the same way), variant, record_duration, missing."""
    scan, earlier = F.col("raw") - F.col("start"), F.col("before") - F.col("start")
    was = F.when(F.col("before").isNotNull(), _effective(earlier, F.col("record_idx") - 1))
    return raw_onsets(tals).select("path", "record_idx", scan.alias("scan_onset"), _effective(scan, F.col("record_idx")).alias("onset"), was.alias("before"), "variant", "record_duration", "missing")


def annotations(tals: DataFrame) -> DataFrame:
    """path, ann_idx, onset, duration, text and origin of each annotation, numbered by (onset, record, channel, place)."""
    found = tals.where("kind = 'element'").where("text <> ''").select("path", "record_idx", "signal_idx", "elem_idx", (F.col("onset") - F.col("start")).alias("onset"), "duration", "text")
    numbered = positions(found, ["path"], ["onset", "record_idx", "signal_idx", "elem_idx"], F.floor(F.col("onset") / 600.0), "ann_idx")
    return numbered.select("path", (F.col("ann_idx") - 1).alias("ann_idx"), "onset", "duration", "text", "record_idx", "signal_idx", "elem_idx")


def onset_faults(tals: DataFrame) -> DataFrame:
    """Warnings for record onsets that contradict the variant: uneven in EDF+C, overlapping in EDF+D."""
    return tals.where("kind = 'fault'").select("path", "record_idx", F.col("text").alias("message"))


def warnings(recordings: DataFrame, tals: DataFrame) -> DataFrame:
    """All warnings of each file in order: path, seq, stage, message. Header, scan, then onsets."""
    order = lambda part, a, b, c: (F.lit(part).alias("part"), a.cast("long").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    zero = F.lit(0)
    one = F.struct(*order(0, F.lit(-1), zero, zero), F.lit("open").alias("stage"), F.col("error").alias("message"))
    many = F.transform("header_warnings", lambda m, i: F.struct(*order(0, i, zero, zero), F.lit("header").alias("stage"), m.alias("message")))
    head = recordings.select("path", F.explode(F.filter(F.concat(F.coalesce(many, F.array().cast(f"array<{_ROW}>")), F.array(one)), lambda x: x["message"].isNotNull())).alias("x")).select("path", "x.*")
    kind = F.col("kind")
    lost = F.format_string("missing time-keeping annotation in record %d, using calculated onset", "record_idx")
    # A record with a text wasn't scanned, which a warning of its own tells.
    absent = (kind == "record") & F.col("missing") & F.col("text").isNull() & (F.col("variant") != "EDF")
    rows = tals.where(F.col("kind").isin("warning", "fault", "record"))
    case = F.when(kind == "warning", F.struct(*order(1, F.col("record_idx"), F.col("signal_idx"), F.col("elem_idx")), F.lit("scan").alias("stage"), F.col("text").alias("message")))
    case = case.when(kind == "fault", F.struct(*order(2, F.col("record_idx"), zero, zero), F.lit("onsets").alias("stage"), F.col("text").alias("message")))
    case = case.when(absent, F.struct(*order(1, F.col("record_idx"), F.lit(2**30), zero), F.lit("scan").alias("stage"), lost.alias("message")))
    scan = rows.select("path", case.alias("x")).where("x is not null").select("path", "x.*")
    numbered = positions(head.unionByName(scan), ["path"], ["part", "a", "b", "c", "message"], F.col("part") * 10**9 + F.floor(F.col("a") / 4096), "seq")
    return numbered.select("path", (F.col("seq") - 1).alias("seq"), "stage", "message")


_ROW = "struct<part:int,a:bigint,b:int,c:int,stage:string,message:string>"


def gaps(onsets: DataFrame, signals: DataFrame) -> DataFrame:
    """Breaks in a signal's sample times: steps longer than 1.5 sampling intervals.

    Within a record samples are evenly spaced, so only record boundaries are compared. Input: ``record_onsets`` and the ``signals`` view."""
    per = signals.where("not is_annotation and sample_rate > 0 and samples_per_record > 0").select("path", "signal_idx", "sample_rate", "samples_per_record")
    pairs = onsets.select("path", "record_idx", "onset", "before").where("before is not null").join(per, "path")
    last = F.col("before") + (F.col("samples_per_record") - 1) / F.col("sample_rate")
    step = F.col("onset") - last
    return pairs.where(step > 1.5 / F.col("sample_rate")).select("path", "signal_idx", "record_idx", last.alias("gap_start"), F.col("onset").alias("gap_end"))


def scan_progress(tals: DataFrame) -> DataFrame:
    """(done, total) of the annotation scan; a finished scan has both equal to the number of onsets."""
    n = raw_onsets(tals).groupBy("path").agg(F.count("*").alias("done"))
    return n.select("path", "done", F.col("done").alias("total"))
