"""Irregular readings onto a regular grid: one slot for each step, filled or marked.

As-of merge per source: readings and grid slots are merged in order, each reading followed by the
slots up to the next one, which gives these slots both neighbours; the
value is interpolated linearly in time where the neighbours are at most ``gap_limit``
apart, and marked missing otherwise. Slots come into being behind the last shuffle.

A source may hold any share of the rows, so nothing is windowed over a source: slots are
whole numbers, readings are first reduced to one per slot (partial aggregation before the
shuffle), and sequences are cut into shards of ``SHARD`` slots. The reading that follows a shard
comes from a table with one row for each shard that holds readings. A long gap is written out in two
steps, so that no row holds all its slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 2048


def regular_grid(readings: DataFrame, sources: DataFrame, source: str, time: str, step: str, value: str | None = None, gap_limit: float | None = None) -> DataFrame:
    """Columns: source, slot, grid_time, n_readings, value, prev_time, next_time, status ('observed', 'filled', 'missing').

    Slot of a reading: floor((time - smallest time of its source) / step + 0.5); the grid runs from
    slot 0 to the last slot that has a reading. Sources come from ``sources`` (source, step); those with a
    null, zero, negative or non-finite step, or without any timed reading, give no rows, and repeated source
    rows count once (the largest step, if they differ). Readings with null or non-finite time lie nowhere.
    Of several readings in a slot the earliest gives the value (the smallest of equal times); repeats change
    nothing. Other columns of either input are ignored. ``value`` defaults to the time itself."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    r = readings.select(F.col(source).alias("src"), F.col(time).cast("double").alias("t"), F.col(value or time).cast("double").alias("v")).where(F.col("src").isNotNull() & finite(F.col("t")))
    s = sources.select(F.col(source).alias("src"), F.col(step).cast("double").alias("d")).where(finite(F.col("d")) & (F.col("d") > 0))
    s = s.groupBy("src").agg(F.max("d").alias("d")).join(r.groupBy("src").agg(F.min("t").alias("t0")), "src")
    slot = F.floor((F.col("t") - F.col("t0")) / F.col("d") + 0.5).cast("long")
    per = r.join(s, "src").withColumn("slot", slot).groupBy("src", "slot").agg(F.min(F.struct("t", "v")).alias("x"), F.count("*").alias("n"), F.first("t0").alias("t0"), F.first("d").alias("d"))
    per = per.select("src", "slot", F.floor(F.col("slot") / SHARD).cast("long").alias("shard"), F.col("x.t").alias("t"), F.col("x.v").alias("v"), "n", "t0", "d")

    # The next reading: within the shard, or the first one of the next shard that has any.
    point = F.struct("slot", "t", "v")
    heads = per.groupBy("src", "shard").agg(F.min(point).alias("head"), F.first("t0").alias("t0"), F.first("d").alias("d"))
    follows = heads.select("src", "shard", "t0", "d", F.lead("head").over(Window.partitionBy("src").orderBy("shard")).alias("after"))
    inner = F.lead(point).over(Window.partitionBy("src", "shard").orderBy("slot"))
    merged = per.drop("t0", "d").withColumn("p", point).withColumn("within", inner).join(follows, ["src", "shard"]).withColumn("q", F.coalesce("within", "after"))
    last = F.coalesce(F.col("q.slot") - 1, F.col("slot"))
    cuts = merged.select("src", "n", "t0", "d", "p", "q", last.alias("last"), F.explode(F.sequence(F.floor(F.col("slot") / SHARD).cast("long"), F.floor(last / SHARD).cast("long"))).alias("cut"))
    stretch = F.sequence(F.greatest(F.col("p.slot"), F.col("cut") * SHARD), F.least("last", F.col("cut") * SHARD + (SHARD - 1)))
    rows = cuts.select("src", "n", "t0", "d", "p", "q", F.explode(stretch).alias("slot"))
    own = F.col("slot") == F.col("p.slot")
    rows = rows.select("src", "slot", (F.col("t0") + F.col("slot") * F.col("d")).alias("grid_time"), F.when(own, F.col("n")).otherwise(F.lit(0)).alias("n_readings"), "p", F.when(own, F.col("p")).otherwise(F.col("q")).alias("q"))
    span = F.col("q.t") - F.col("p.t")
    within = F.lit(True) if gap_limit is None else span <= gap_limit
    share = (F.col("grid_time") - F.col("p.t")) / F.when(span > 0, span)
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * share
    hit = F.col("n_readings") > 0
    return rows.select(
        F.col("src").alias(source), "slot", "grid_time", "n_readings",
        F.when(hit, F.col("p.v")).when(within, line).alias("value"), F.col("p.t").alias("prev_time"), F.col("q.t").alias("next_time"),
        F.when(hit, F.lit("observed")).when(within & line.isNotNull(), F.lit("filled")).otherwise(F.lit("missing")).alias("status"),
    )
