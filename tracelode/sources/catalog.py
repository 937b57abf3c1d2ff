"""Recordings as temporary views, for plain SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracelode.operators import events, samples
from tracelode.sources.edf import read_edf


def register(spark: SparkSession, paths, prefix: str = "", **options) -> list[str]:
    """Creates views of the files and gives their names: recordings, signals, chunks (with ``physical``), annotations, record_onsets, warnings.

    Nothing is read before a query runs; filters in SQL on path, record_idx and signal_idx reach the reader."""
    read = lambda view: read_edf(spark, paths, view, **options)
    tals = read("tals")
    views = {
        "recordings": read("recordings"), "signals": read("signals"), "chunks": samples.decode(read("chunks")),
        "annotations": events.annotations(tals), "record_onsets": events.record_onsets(tals), "warnings": events.warnings(read("recordings"), tals),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
