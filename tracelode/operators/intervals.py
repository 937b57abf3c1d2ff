"""Intervals per entity that overlap, nest, touch or leave holes: continuous periods and gaps.

Two-level merge, so that an entity may hold any share of the rows: intervals are clipped
into time shards of ``SHARD_MS``; pieces are reduced to one per (entity, shard, start) with
the largest end before the shuffle, and merged within each shard. Shards that an interval
covers wholly aren't written out one by one: only the first of them with the farthest last
one is kept, at most one row for each shard, and what lies within them is dropped. Coverage that
touches a shard's edge, together with those spans, is then stitched per entity and coalesced; the
rest is final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_MS = 600_000


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union of [s, e) rows within keys; touching ones become one."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    marked = df.withColumn("new", new)
    return marked.withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "isle").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("isle")


def merge(df: DataFrame, entity: str, start: Column, end: Column) -> DataFrame:
    """Periods and gaps: entity, kind ('period', 'gap'), start_ms, end_ms.

    start and end are whole milliseconds (bigint). Intervals with a null end or start, or that don't end after they
    start, cover nothing; a null entity is left out. Repeated rows change nothing, other columns are ignored."""
    width = F.lit(SHARD_MS)
    iv = df.select(F.col(entity).alias("ent"), start.cast("long").alias("s"), end.cast("long").alias("e")).where("ent is not null and s < e")
    first, last = F.floor(F.col("s") / width).cast("long"), F.floor((F.col("e") - 1) / width).cast("long")
    iv = iv.select("*", first.alias("a"), last.alias("b"))
    head = F.struct(F.col("a").alias("shard"), F.col("s").alias("s"), F.least(F.col("e"), (F.col("a") + 1) * width).alias("e"))
    tail = F.struct(F.col("b").alias("shard"), (F.col("b") * width).alias("s"), F.col("e").alias("e"))
    pieces = iv.select("ent", F.explode(F.when(F.col("a") == F.col("b"), F.array(head)).otherwise(F.array(head, tail))).alias("p")).select("ent", "p.*")
    pieces = pieces.groupBy("ent", "shard", "s").agg(F.max("e").alias("e"))
    local = _islands(pieces, ["ent", "shard"])
    spans = iv.where("b > a + 1").groupBy("ent", (F.col("a") + 1).alias("shard")).agg(F.max("b").alias("b"))
    # Shards inside a span, by the farthest span begun so far: one row for each shard and span of an entity.
    marks = local.select("ent", "shard").distinct().withColumn("b", F.lit(None).cast("long")).unionByName(spans)
    reach = F.max("b").over(Window.partitionBy("ent").orderBy("shard"))
    inside = marks.withColumn("reach", reach).where("b is null and reach > shard").select("ent", "shard")
    local = local.join(inside, ["ent", "shard"], "left_anti")
    edge = (F.col("s") == F.col("shard") * width) | (F.col("e") == (F.col("shard") + 1) * width)
    # Coverage at an edge gets a common key for stitching, the rest a key of its own.
    spans = spans.select("ent", "shard", (F.col("shard") * width).alias("s"), (F.col("b") * width).alias("e"), F.lit(True).alias("edge"))
    parts = local.select("ent", "shard", "s", "e", edge.alias("edge")).unionByName(spans)
    home = F.when(F.col("edge"), F.lit(-(2**62))).otherwise(F.col("shard"))
    periods = _islands(parts.select("ent", home.alias("home"), "s", "e"), ["ent", "home"]).select("ent", "s", "e")

    # Gaps: the next period within the shard of the start, or else the first one of the next shard that has any.
    placed = periods.withColumn("shard", F.floor(F.col("s") / width).cast("long"))
    firsts = placed.groupBy("ent", "shard").agg(F.min("s").alias("first"))
    beyond = firsts.select("ent", "shard", F.lead("first").over(Window.partitionBy("ent").orderBy("shard")).alias("beyond"))
    following = placed.withColumn("next", F.lead("s").over(Window.partitionBy("ent", "shard").orderBy("s"))).join(beyond, ["ent", "shard"])
    nxt = F.coalesce("next", "beyond")
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("e").alias("start_ms"), nxt.alias("end_ms"))
    return following.select(F.col("ent").alias(entity), F.explode(F.when(nxt.isNull(), F.array(period)).otherwise(F.array(period, gap))).alias("x")).select(entity, "x.*")
