"""Helpers for keys that may hold a large share of all rows, and for results that a plan reads twice."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]
_DIRS: dict[str, str] = {}
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: below spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _DIRS.get("")
        if base is None:
            base = _DIRS[""] = tempfile.mkdtemp(prefix="tracelode-")
    path = f"{base.rstrip('/')}/tracelode-{_RUN}"
    if path not in _DIRS:
        _DIRS[path] = path
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    """Deletes intermediate tables at the end of the process, as far as the session still lives."""
    spark = SparkSession.getActiveSession()
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


@contextlib.contextmanager
def scratch():
    """Deletes the intermediate tables written inside it at its end; results have to be written or collected before. Without it they stay until the process ends."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    for written in _OPEN:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """A materialised table, marked for broadcast only if it has at most so many rows; otherwise Spark joins it by its key."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def positions(df: DataFrame, keys: list[str], order: list[str], shard: Column, name: str) -> DataFrame:
    """row_number over keys in the given order, without putting a key's rows into one task.

    shard must not decrease along the order (such as floor(time / width)). Rows are numbered within (keys, shard);
    counts of shards, one row each, are summed up over the key and joined back."""
    cut = df.withColumn("__shard", shard.cast("long"))
    numbered = cut.withColumn("__inner", F.row_number().over(Window.partitionBy(*keys, "__shard").orderBy(*order)))
    # A shard's last row holds its count. Whole rows are compared, so that both sides need the same columns and share one exchange.
    rest = [c for c in df.columns if c not in keys]
    counts = numbered.groupBy(*keys, "__shard").agg(F.max(F.struct("__inner", *rest)).alias("__x")).select(*keys, "__shard", F.col("__x.__inner").alias("count"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "__shard", before.alias("__before"))
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "__shard"]]
    both = numbered.alias("n").join(starts.alias("s"), on)
    return both.select(*[F.col(f"n.{c}") for c in df.columns if c != name], (F.col("n.__inner") + F.col("s.__before")).alias(name))
