"""Runs of consecutive events with the same name, collapsed into one event each.

Names are equal if they agree word by word apart from case, blanks, punctuation and one
mistyped letter (changed, dropped, added or swapped with its neighbour) in a word of five or
more letters. Words are counted over all rows; a word becomes its most frequent neighbour, if
that is ``RATIO`` times as frequent or both are rare. Neighbours are found by patterns (a word without its i-th
letter, with a pair of letters sorted), grouped by pattern: a group yields its most frequent
word only, so no pairs are formed.

Boundary-only rows: events are range-partitioned by (group, order), which splits a group of
any size, and sorted; a pass over each partition keeps the rows that differ from their
predecessor. The next boundary's position gives the count, the row before it the end. Runs at
a partition's edges, at most two for each partition, are stitched afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.hot import materialize, small

LEAST, RATIO, RARE = 5, 3, 16
BROADCAST_ROWS = 200_000
WHOLE = 64


def normal_text(text: Column) -> Column:
    """Lower case, words parted by one blank, everything but letters, digits and combining marks dropped."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


class _Parts:
    """Joins of a word's parts as strings; of long words as pairs of polynomial hashes, each had from prefix sums."""

    MODULI = (2**61 - 1, 2**89 - 1)
    BASE = 1_000_003

    def __init__(self, word: str):
        self.word, self.sums = word, []
        if len(word) > WHOLE:
            for m in self.MODULI:
                h, p, sums, powers = 0, 1, [0], [1]
                for c in word:
                    h, p = (h * self.BASE + ord(c) + 1) % m, p * self.BASE % m
                    sums.append(h)
                    powers.append(p)
                self.sums.append((m, sums, powers))

    def join(self, *parts) -> str:
        """Parts are (from, to) of the word, or strings; a join of over WHOLE letters is hashed, whatever the word's length."""
        size = sum(len(x) if isinstance(x, str) else x[1] - x[0] for x in parts)
        if size <= WHOLE:
            return "".join(x if isinstance(x, str) else self.word[x[0] : x[1]] for x in parts)
        out = []
        for m, sums, powers in self.sums:
            h = 0
            for x in parts:
                if isinstance(x, str):
                    for c in x:
                        h = (h * self.BASE + ord(c) + 1) % m
                else:
                    a, b = x
                    h = (h * powers[b - a] + sums[b] - sums[a] * powers[b - a]) % m
            out.append(f"{h:x}")
        return f"#{size}#" + "#".join(out)


def _patterns(word: str) -> list[tuple[str, bool]]:
    """(pattern, whether the word is the pattern's plain form): words sharing one differ by one mistyped letter."""
    out = []
    n = len(word)
    parts = _Parts(word)
    for i in range(n):
        out.append((f"s{i}\0{parts.join((0, i), chr(1), (i + 1, n))}", False))  # changed letter
        if not i or word[i] != word[i - 1]:
            out.append((f"d\0{parts.join((0, i), (i + 1, n))}", False))  # word with one letter more
        if i + 1 < n and word[i] != word[i + 1]:
            a, b = sorted(word[i : i + 2])
            out.append((f"t{i}\0{parts.join((0, i), a + b, (i + 2, n))}", False))  # swapped pair
    out.append((f"d\0{parts.join((0, n))}", True))  # word with one letter less
    return out


def _explode(batches):
    for pdf in batches:
        rows = [(w, c, p, plain) for w, c in zip(pdf["word"], pdf["n"]) for p, plain in _patterns(w)]
        yield pd.DataFrame(rows, columns=["word", "n", "pattern", "plain"])


def canonical_words(words: DataFrame) -> DataFrame:
    """word, canon for the words that stand for another one. Input: word, n (number of occurrences)."""
    letters = words.where(f"length(word) >= {LEAST - 1} and word rlike '^[^0-9]+$'")
    pats = materialize(letters.mapInPandas(_explode, "word string, n bigint, pattern string, plain boolean"), "patterns")
    # In a d-group the plain word and the longer ones are neighbours of each other, but the longer ones aren't among themselves.
    top = F.max(F.struct("n", "word"))
    plain = F.max(F.when(F.col("plain"), F.struct("n", "word")))
    long = F.max(F.when(~F.col("plain"), F.struct("n", "word")))
    best = pats.groupBy("pattern").agg(F.count("*").alias("k"), top.alias("top"), plain.alias("short"), long.alias("long")).where("k > 1")
    seen = pats.join(best, "pattern").select("word", "n", F.when(~F.col("pattern").startswith("d"), F.col("top")).when(F.col("plain"), F.col("long")).otherwise(F.col("short")).alias("c"))
    enough = F.length("c.word") >= LEAST
    near = seen.where(enough & (F.col("c.word") != F.col("word"))).groupBy("word", "n").agg(F.max("c").alias("c"))
    # Between rare words, where frequency can't tell, the more frequent (then the later) one stands for both.
    rare = (F.col("c.n") + F.col("n") <= RARE) & (F.struct(F.col("c.n").alias("n"), F.col("c.word").alias("word")) > F.struct("n", "word"))
    return near.where((F.col("c.n") >= RATIO * F.col("n")) | rare).select("word", F.col("c.word").alias("canon"))


def event_names(texts: DataFrame) -> DataFrame:
    """text, event for the normalised texts whose event differs from the text. Input: text, n."""
    words = texts.select(F.explode(F.split("text", " ")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    canon = materialize(canonical_words(words), "canon")
    # A canonical word may itself stand for a rarer spelling's neighbour: one more step settles chains between rare words.
    again = canon.select(F.col("word").alias("canon"), F.col("canon").alias("further"))
    canon = canon.join(again, "canon", "left").select("word", F.coalesce("further", "canon").alias("canon"))
    split = texts.select("text", F.posexplode(F.split("text", " ")).alias("i", "word")).join(small(materialize(canon, "canon"), BROADCAST_ROWS), "word", "left")
    joined = split.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("canon", "word").alias("w")))).alias("ws"), F.count("canon").alias("k")).where("k > 0")
    return joined.select("text", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("event"))


def _scan(batches):
    """Runs of each sorted partition. Only those with two or more events, or at an edge, come out."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    carry, first, seq = None, True, 0
    names = ["part", "seq", "g", "event", "first_id", "last_id", "first_time", "end_time", "n", "left", "right"]

    def frame(rows):
        return pd.DataFrame(rows, columns=names)

    prev = None  # the last row's (group, id)
    for pdf in batches:
        if not len(pdf):
            continue
        g, ids, t, e, ev = (pdf[c].to_numpy() for c in ("g", "id", "t", "e", "event"))
        fresh = np.ones(len(pdf), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])
        if prev is not None:
            fresh[0] = (g[0], ids[0]) != prev
        prev = (g[-1], ids[-1])
        if not fresh.all():
            g, ids, t, e, ev = g[fresh], ids[fresh], t[fresh], e[fresh], ev[fresh]
        if not len(g):
            continue
        starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (ev[1:] != ev[:-1])])
        ends = np.r_[starts[1:], len(g)]
        rows = []
        until = np.maximum.reduceat(e, starts)
        for k, (a, b) in enumerate(zip(starts, ends)):
            if k == 0 and carry is not None and (carry[2], carry[3]) == (g[a], ev[a]):
                carry[5], carry[7], carry[8] = ids[b - 1], max(carry[7], until[k]), carry[8] + int(b - a)
            else:
                if carry is not None and (carry[8] > 1 or carry[9]):
                    rows.append(carry)
                carry = [part, seq, g[a], ev[a], ids[a], ids[b - 1], t[a], until[k], int(b - a), first, False]
                first, seq = False, seq + 1
        if rows:
            yield frame(rows)
    if carry is not None:
        carry[10] = True
        yield frame([carry])


def collapse(events: DataFrame, group: str, event_id: str, onset: str, duration: str, text: str) -> DataFrame:
    """Runs of two or more consecutive events of a group: group, event, first_id, last_id, n_events, start, seconds.

    Order is (onset, event_id); events without a text (null or blank), onset, id or group are left out beforehand.
    ``seconds`` is from the start of the first to the latest end of any event of the run; a null, negative or
    not-a-number duration counts as 0. Repeated rows of an event count once. Texts of nothing but punctuation
    name one and the same event. Other columns are ignored."""
    length = F.coalesce(F.when(~F.isnan(duration) & (F.col(duration) > 0), F.col(duration)), F.lit(0.0))
    rows = events.select(
        F.col(group).alias("g"), F.col(event_id).alias("id"), F.col(onset).cast("double").alias("t"), (F.col(onset) + length).cast("double").alias("e"), F.col(text).alias("raw")
    ).where("g is not null and id is not null and t is not null and not isnan(t) and raw rlike '\\\\S'").withColumn("text", normal_text(F.col("raw"))).drop("raw")
    names = materialize(event_names(rows.groupBy("text").agg(F.count("*").alias("n"))), "events")
    named = rows.join(small(names, BROADCAST_ROWS), "text", "left").select("g", "id", "t", "e", F.coalesce("event", "text").alias("event"))
    kind = dict(named.dtypes)
    schema = f"part int, seq int, g {kind['g']}, event string, first_id {kind['id']}, last_id {kind['id']}, first_time double, end_time double, n int, left boolean, right boolean"
    found = materialize(named.repartitionByRange("g", "t", "id").sortWithinPartitions("g", "t", "id").mapInPandas(_scan, schema), "runs")

    # Runs at the edges of partitions: two rows for each partition at most.
    edges = found.where("left or right")
    w = Window.orderBy("part", "seq")
    follows = F.coalesce((F.lag("g").over(w) == F.col("g")) & (F.lag("event").over(w) == F.col("event")) & F.lag("right").over(w) & F.col("left") & (F.lag("part").over(w) != F.col("part")), F.lit(False))
    marked = edges.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("chain", F.sum("new").over(w))
    stitched = marked.groupBy("chain", "g", "event").agg(
        F.min_by("first_id", F.struct("part", "seq")).alias("first_id"), F.max_by("last_id", F.struct("part", "seq")).alias("last_id"), F.min("first_time").alias("first_time"), F.max("end_time").alias("end_time"), F.sum("n").cast("int").alias("n")
    )
    cols = ["g", "event", "first_id", "last_id", "first_time", "end_time", "n"]
    whole = found.where("not left and not right").select(*cols).unionByName(stitched.select(*cols)).where("n > 1")
    return whole.select(F.col("g").alias(group), "event", "first_id", "last_id", F.col("n").alias("n_events"), F.col("first_time").alias("start"), (F.col("end_time") - F.col("first_time")).alias("seconds"))
