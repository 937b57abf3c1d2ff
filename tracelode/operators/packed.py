"""Several values packed in one field, written with inconsistent separators and quotes.

A *dialect* is (separator set, quote set). The candidates of a field are each set of its quote marks with all its
separators, with those outside quotes and any of the others, with each single one, or with blanks only. The cheapest
by minimum description length is used:

* each candidate parse yields values; a value's *shape* (runs of capitals, small letters, digits and
  blanks collapsed, other characters kept, quote marks among them) is counted over all candidate parses
  of all rows, each parse weighing one over the number of the field's candidates;
* a parse costs the sum of its values' code lengths (-log2 of the shape's share among the
  shapes of that field name), its separators, the dialect's own name, ``STRAY_BITS`` for each separator left
  outside quotes, as a value with a separator has to be quoted, and ``MARK_BITS`` for each quote mark left at a word's edge;
* the shapes are then counted again over the cheapest parses alone, and those counts decide.

So whether a quote mark at the edge of a word encloses a value is up to how often the corpus has values that look like either reading.

Each field is parsed once; its candidates are written to the shared folder, and what follows only looks up
code lengths. Shapes that hold less than a share ``FLOOR`` of a field's values share one code, so
what is sent to the tasks has at most 1 / ``FLOOR`` rows for each field, whatever the input.

Blanks separate only where nothing else does. A slash separates only with blanks (or an end) on both sides.
"""

from __future__ import annotations

import ast
import hashlib
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators.hot import materialize

SEPARATORS = ",;|^\t"
QUOTES = "\"'"
FLOOR = 2.0**-16
STRAY_BITS, MARK_BITS = 24.0, 8.0
_LOOSE = re.compile(r"(?<!\w)[\"']|[\"'](?!\w)")
def unwrap(text: str | None) -> str:
    """The field's content: without surrounding blanks and without a bytes literal's wrapper."""
    s = (text or "").strip(" ")
    if len(s) >= 3 and s[0] == "b" and s[1] in QUOTES and s[-1] == s[1]:
        try:
            s = ast.literal_eval(s).decode("utf-8", "replace")
        except (ValueError, SyntaxError):
            s = s[2:-1]
    return s.strip(" \r\n")


@lru_cache(maxsize=64)
def _value(quotes: str) -> re.Pattern:
    """A value's start: blanks, then a closed quotation that a separator, blank or the end follows."""
    forms = "|".join(rf"{q}(?P<q{i}>(?:[^{q}]|{q}{q})*){q}(?=[\s{re.escape(SEPARATORS)}]|$)" for i, q in enumerate(quotes))
    return re.compile(rf"[ ]*(?:{forms})" if forms else r"(?!)")


@lru_cache(maxsize=1024)
def _separators(separators: str) -> tuple[re.Pattern, re.Pattern]:
    """(what ends a value, separators that the dialect doesn't have)."""
    slash = r"(?:(?<=\s)|^)/(?=\s|$)"
    ends = [*(re.escape(c) for c in separators if c != "/"), *([slash] if "/" in separators else [])] or ["[ ]+"]
    others = ["[" + re.escape("".join(c for c in SEPARATORS if c not in separators) or "\0") + "]", *([] if "/" in separators else [slash])]
    return re.compile("|".join(ends)), re.compile("|".join(others))


def split(s: str, separators: str, quotes: str) -> tuple[list[str], int, int]:
    """(values with their places, separators passed, separators left outside quotes that the dialect doesn't have)."""
    opening = _value(quotes)
    ends, foreign = _separators(separators)
    if not any(q in s for q in quotes):
        raw = ends.split(s)
        return [v.strip(" ") for v in raw], len(raw) - 1, len(foreign.findall(s))
    out, at, n, passed, stray = [], 0, len(s), 0, 0
    while True:
        m = opening.match(s, at)
        if m:
            q = quotes[int(m.lastgroup[1:])]
            body, after = m[m.lastgroup].replace(q + q, q), m.end()
            stop = ends.search(s, after)
            gap = s[after : stop.start() if stop else n]
            if gap.strip(" "):  # text goes on after the quotation: it was no quotation
                m = None
            else:
                stray += len(foreign.findall(gap))
        if not m:
            stop = ends.search(s, at)
            end = stop.start() if stop else n
            stray += sum(at <= x.start() < end for x in foreign.finditer(s, at, end + 1)) if foreign.search(s, at, end) else 0
            body = s[at:end].strip(" ")
        out.append(body)
        if not stop:
            return out, passed, stray
        passed += 1
        at = stop.end()
        if not separators and at >= n:
            return out, passed, stray


_MARK = {q: re.compile(rf"(?:^|[\s{re.escape(SEPARATORS)}]){q}") for q in QUOTES}
_SLASH = re.compile(r"(?:\s|^)/(?:\s|$)")


def dialects(s: str) -> list[tuple[str, str]]:
    """Candidate dialects of a field, those with most quote marks and separators first.

    A separator before the first or behind the last quote mark of a kind can't be inside quotes."""
    marks = [q for q in QUOTES if q in s and _MARK[q].search(s)]
    seps = [c for c in SEPARATORS if c in s] + (["/"] if "/" in s and _SLASH.search(s) else [])
    must, may = seps, []
    if marks:
        first, last = min(s.index(q) for q in marks), max(s.rindex(q) for q in marks)
        outer = s[:first] + "\0" + s[last + 1 :]
        must = [c for c in seps if (c in outer if c != "/" else _SLASH.search(outer))]
        may = [c for c in seps if c not in must]
    sets = [[c for c in seps if c in must or c in some] for j in range(len(may), -1, -1) for some in itertools.combinations(may, j)]
    sets += [[c] for c in seps] + ([[]] if " " in s else [])
    names = list(dict.fromkeys(map("".join, sets))) or [""]
    return [(ss, "".join(qs)) for k in range(len(marks), -1, -1) for qs in itertools.combinations(marks, k) for ss in names]


class _Classes(dict):
    """What a character becomes in a shape."""

    def __missing__(self, c):
        x = chr(c)
        found = self[c] = "9" if x.isdigit() else "A" if x.isupper() else "a" if x.isalpha() else " " if x.isspace() else x
        return found


_CLASSES = _Classes()
_TWICE = re.compile(r"([aA9 ])\1+")
_NAME = re.compile("Aa")


@lru_cache(maxsize=2**16)
def shape(value: str) -> str:
    """Capitals and small letters, digits and blanks by one mark for each run; a long shape's end is hashed."""
    x = _NAME.sub("a", _TWICE.sub(r"\1", value.translate(_CLASSES)))
    return x if len(x) <= 64 else x[:32] + hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def candidates(s: str) -> list[tuple[list[str], float]]:
    """(values, bits besides those of the values' shapes) of each dialect that passes all its separators; the same parse once."""
    found: dict[tuple, float] = {}
    for separators, quotes in dialects(s):
        values, passed, stray = split(s, separators, quotes)
        if passed >= len(separators):
            bits = passed * np.log2((len(separators) or 1) + 1) + 6.0 * len(separators) + 2.0 * len(quotes) + STRAY_BITS * stray
            bits += MARK_BITS * sum(len(_LOOSE.findall(v)) for v in values) if '"' in s or "'" in s else 0.0
            key = tuple(values)
            found[key] = min(found.get(key, np.inf), bits)
    return [(list(v), float(b)) for v, b in found.items()] or [([s], 0.0)]


def _parse(batches):
    """Each field's candidates; a value's shape stands with the field's name."""
    text = pa.list_(pa.string())
    for b in batches:
        keep, ends, values, shapes, bits = [], [0], [], [], []
        for i, (name, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            if s := unwrap(t):
                found = candidates(s)
                keep.append(i)
                ends.append(ends[-1] + len(found))
                for v, x in found:
                    values.append(v)
                    shapes.append([f"{name}\0{shape(y)}" for y in v])
                    bits.append(x)
        cands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(values, text), pa.array(shapes, text), pa.array(bits, pa.float64())], names=["values", "shapes", "bits"]))
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), cands], names=["key", "name", "cands"])


class Codes:
    """Code length in bits of each shape of a field; shapes that aren't listed have one common code."""

    def __init__(self, rows: list[tuple[str, str, float]], totals: dict[str, float]):
        self.shapes = pa.array([s for _, s, _ in rows], pa.string())
        listed: dict[str, int] = {}
        for f, *_ in rows:
            listed[f] = listed.get(f, 0) + 1
        whole = {f: t + 0.5 * (listed.get(f, 0) + 1) for f, t in totals.items()}
        self.bits = np.array([-np.log2((w + 0.5) / whole[f]) for f, _, w in rows] + [-np.log2(0.5 / max(whole.values(), default=1.0))])

    def cheapest(self, cands: pa.ListArray) -> np.ndarray:
        """Of each row the place of its cheapest candidate among all candidates of the batch; the first of equal ones."""
        flat = cands.flatten()
        shapes, extra = flat.field("shapes"), np.asarray(flat.field("bits"))
        at = pc.index_in(shapes.flatten(), value_set=self.shapes).fill_null(len(self.shapes)).to_numpy(zero_copy_only=False) if len(self.shapes) else np.zeros(len(shapes.flatten()), int)
        sums = np.r_[0.0, np.cumsum(self.bits[at])]
        size = np.asarray(shapes.value_lengths())
        ends = np.cumsum(size)
        cost = np.round(sums[ends] - sums[ends - size] + extra, 6)
        many = np.asarray(cands.value_lengths())
        row = np.repeat(np.arange(len(many)), many)
        by = np.lexsort((np.arange(len(cost)), cost, row))
        return by[np.cumsum(many) - many]


def _code_lengths(parsed: DataFrame, codes_b=None):
    """Codes from counts over all candidates, or over the cheapest ones under given codes, as a broadcast."""

    def chosen(batches):
        for b in batches:
            flat = b.column(1).flatten().take(pa.array(codes_b.value.cheapest(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), flat.field("shapes")], names=["name", "shapes"])

    if codes_b is None:
        shapes = parsed.select("name", (1.0 / F.size("cands")).alias("w"), F.explode("cands").alias("c")).select("name", "w", F.explode("c.shapes").alias("shape"))
    else:
        shapes = parsed.select("name", "cands").mapInArrow(chosen, "name string, shapes array<string>").select("name", F.lit(1.0).alias("w"), F.explode("shapes").alias("shape"))
    counts = materialize(shapes.groupBy("name", "shape").agg(F.sum("w").alias("w")), "shapes")
    totals = {r.name: r.t for r in counts.groupBy("name").agg(F.sum("w").alias("t")).collect()}
    least = F.element_at(F.create_map(*[x for f, t in totals.items() for x in (F.lit(f), F.lit(t * FLOOR))]), F.col("name")) if totals else F.lit(0.0)
    rows = sorted((r.name, r.shape, r.w) for r in counts.where(F.col("w") >= least).collect())
    return parsed.sparkSession.sparkContext.broadcast(Codes(rows, totals))


def unpack(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per value: key, field_name, pos (from 1), val.

    Null and blank fields give no rows. An empty value between two separators keeps its
    position and isn't returned. Rows with the same key and text give their values once.
    Very long fields are parsed whole. Further columns of df are ignored, whatever their names. Runs jobs: the
    candidates of all fields are written once to the shared folder, and shapes are counted twice."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("text")) for f in fields])).alias("p")
    texts = df.select(F.col(key).alias("key"), pairs).select("key", "p.name", "p.text").where(F.trim("text") != "")
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, name string, cands array<struct<values array<string>, shapes array<string>, bits double>>"
    parsed = materialize(texts.mapInArrow(_parse, schema), "candidates")
    codes_b = _code_lengths(parsed, _code_lengths(parsed))

    def choose(batches):
        for b in batches:
            flat = b.column(2).flatten().take(pa.array(codes_b.value.cheapest(b.column(2))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat.field("values")], names=["key", "name", "values"])

    best = parsed.mapInArrow(choose, f"key {kind}, name string, values array<string>")
    out = best.select("key", F.col("name").alias("field_name"), F.posexplode("values").alias("at", "val")).where("val <> ''")
    return out.select(F.col("key").alias(key), "field_name", (F.col("at") + 1).alias("pos"), "val").dropDuplicates()
