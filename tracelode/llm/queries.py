"""Queries of the operators over texts, over the driver's whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.llm import canonical, encode, leakage, mojibake, runs

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


P3 = r"""WITH a AS (SELECT DISTINCT file_id, onset, ann_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) t FROM annotations WHERE regexp_matches(text, '\S') AND onset IS NOT NULL),
z AS (SELECT trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) t FROM annotations WHERE regexp_matches(text, '\S') AND onset IS NOT NULL), t AS (SELECT t, count(*) n FROM z GROUP BY t), w AS (SELECT w, sum(n) n FROM (SELECT unnest(string_split(t, ' ')) w, n FROM t) GROUP BY w),
o AS (SELECT x.w, arg_max(y.w, (y.n, y.w)) c FROM w x JOIN w y ON (y.n >= 3 * x.n OR x.n + y.n <= 16 AND (y.n, y.w) > (x.n, x.w)) AND length(y.w) >= 5 AND length(x.w) >= 4 AND NOT regexp_matches(x.w || y.w, '[0-9]') AND damerau_levenshtein(x.w, y.w) = 1 GROUP BY x.w), c AS (SELECT o.w, coalesce(m.c, o.c) c FROM o LEFT JOIN o m ON m.w = o.c),
u AS (SELECT t, unnest(string_split(t, ' ')) w, generate_subscripts(string_split(t, ' '), 1) i FROM t),
v AS (SELECT t, string_agg(coalesce(c, w), ' ' ORDER BY i) ev FROM u LEFT JOIN c USING (w) GROUP BY t),
b AS (SELECT file_id, onset, ann_id, ev, lag(ev) OVER (PARTITION BY file_id ORDER BY onset, ann_id) p FROM a JOIN v USING (t)),
r AS (SELECT *, sum(CASE WHEN ev = p THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY onset, ann_id ROWS UNBOUNDED PRECEDING) run FROM b)
SELECT file_id, arg_min(ann_id, (onset, ann_id)) AS first_ann_id, arg_max(ann_id, (onset, ann_id)) AS last_ann_id, CAST(count(*) AS int) AS n_anns FROM r GROUP BY file_id, run HAVING count(*) > 1"""


@query("p3_found", P3)
def _(spark, sf):
    r = runs.collapse(_table(spark, sf, "annotations"), "file_id", "ann_id", "onset", "duration", "text")
    return r.select("file_id", F.col("first_id").alias("first_ann_id"), F.col("last_id").alias("last_ann_id"), F.col("n_events").alias("n_anns"))


@query("p5_found")
def _(spark, sf):
    m = canonical.map_values(_table(spark, sf, "signals"), _table(spark, sf, "channel_ref"), ["file_id", "signal_index"], ["label", "transducer"])
    return m.select("file_id", "signal_index", "field_name", "ref_id").distinct()


@query("p8_ids")
def _(spark, sf):
    return encode.encode_table(_table(spark, sf, "documents"), "doc_id", "text", encode.tokenizer_path(spark, "byte_bpe_50k.tiktoken"))


@query("p9_found")
def _(spark, sf):
    found = leakage.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"), "doc_id", "text", "lines", "item_id", "text")
    return found.select("doc_id", "item_id")


@query("p9_cleaned")
def _(spark, sf):
    return leakage.remove_spans(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"), "doc_id", "text", "lines", "item_id", "text")


def _restored(spark, sf):
    return mojibake.repair(_table(spark, sf, "documents"), "doc_id", "text", "lang")


@query("p10_found")
def _(spark, sf):
    return _restored(spark, sf).select("doc_id").distinct()


@query("p10_restored")
def _(spark, sf):
    return _restored(spark, sf)
