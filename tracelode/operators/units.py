"""Quantities recorded in different units: each row's unit, and its range in the common unit.

A hidden Markov model per device has the unit as hidden state. Its chains are the device's channels
of one kind (the words of their label) in the order of files. A row emits

* its texts, with doubt: the unit that its dimension field names (``NAMED``), or units whose spelling is a
  mistyped letter away (``NEAR``, each), or, where it names none, each unit that another text
  states for the values (``STATED``: ``... [uV]``, ``... /uV``, ``values in uV``);
* the words of its label, each with how often it goes with each quantity in the stated rows of all data;
* the logarithm of its range, which in the right unit lies near a smooth level: the mean of the ``WINDOW`` stated
  rows before and after it in the chain, drawn towards the mean of the quantity over all data.

Between successive rows the logarithm of the range in common units jumps little unless the unit was
taken wrongly, so a transition scores the jump besides the change of unit. Viterbi decodes the most
likely sequence, for all chains of a batch at once.

A chain may hold any share of the rows: it is cut into blocks of ``BLOCK`` rows, each decoded with
``CONTEXT`` further rows on either side whose states are dropped. The paths of a chain from whatever
start meet within a few rows, so blocks of any size give the same states. Texts are
reduced to their evidence, and repeated rows dropped, before anything is shuffled by device.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators.hot import materialize, positions

BLOCK, CONTEXT, WINDOW = 8192, 64, 16
# Log odds of a text that names the unit, has it mistyped, or states it elsewhere, against one that says otherwise.
NAMED, NEAR, STATED = 16.0, 5.0, 10.0
STAY, SAME = np.log(0.6), np.log(0.1)
WIDTH, JUMP, FARTHEST = 0.35, 0.5, 5.0
LEAST_WORDS, WORD_SHARE = 3, 2.0**-14
NO_TEXT, OTHER_TEXT, NEAR_TEXT, NAMED_TEXT = range(4)

# Spellings of units (lower case, without blanks, dots and brackets) by symbol.
# Prefixed spellings are built from PREFIXES and BASES.
PREFIXES = {"u": ("u", "micro", "1e-6"), "m": ("m", "milli", "1e-3"), "n": ("n", "nano", "1e-9"), "": ("",)}
BASES = {"V": ("v", "volt", "volts"), "S": ("s", "siemens", "mho"), "g": ("g", "-g", "gee", "g-force")}
SPELLINGS = {
    "degC": "degc °c c celsius oc degcelsius",
    "degF": "degf °f f fahrenh fahrenheit of degfahrenheit",
    "K": "k kelvin °k degk",
    "cmH2O": "cmh2o cmh20 cmwater",
    "mmHg": "mmhg torr",
    "kPa": "kpa kpascal kilopascal",
    "mbar": "mbar millibar hpa",
    "L/min": "l/min lpm lmin-1 litre/mn litre/min liter/min l/mn",
    "mL/s": "ml/s ml/sec mls-1 cc/s cc/sec",
    "L/s": "l/s l/sec lps ls-1 litre/s",
    "%": "% percent pct",
    "fraction": "fraction frac 0to1",
    "1/min": "1/min /min beats/mn beats/min bpm b/min min-1",
    "Hz": "hz 1/s /s s-1 hertz",
    "m/s2": "m/s2 ms-2 m/s/s",
}
# Common value = factor * recorded value + shift.
TO_COMMON = {
    "uV": (1.0, 0.0), "mV": (1e3, 0.0), "V": (1e6, 0.0), "nV": (1e-3, 0.0),
    "degC": (1.0, 0.0), "degF": (5 / 9, -160 / 9), "K": (1.0, -273.15),
    "cmH2O": (1.0, 0.0), "mmHg": (1.359510, 0.0), "kPa": (10.197162, 0.0), "mbar": (1.0197162, 0.0),
    "L/min": (1.0, 0.0), "mL/s": (0.06, 0.0), "L/s": (60.0, 0.0),
    "%": (1.0, 0.0), "fraction": (100.0, 0.0), "1/min": (1.0, 0.0), "Hz": (60.0, 0.0),
    "m/s2": (1.0, 0.0), "g": (9.80665, 0.0), "mg": (0.00980665, 0.0),
    "uS": (1.0, 0.0), "nS": (1e-3, 0.0), "mS": (1e3, 0.0),
}


def _key(text: str) -> str:
    t = unicodedata.normalize("NFKC", text).replace("µ", "u").replace("μ", "u").lower().strip()
    t = re.sub(r"^0\s*(?:\.\.|-|to)\s*1$", "0to1", t)
    return re.sub(r"[\s.^_()\[\]]", "", t)


@lru_cache(maxsize=1)
def spellings() -> dict[str, str]:
    table = {_key(s): symbol for symbol, forms in SPELLINGS.items() for s in forms.split()}
    for prefix, forms in PREFIXES.items():
        for base, words in BASES.items():
            if prefix + base in TO_COMMON:
                table |= {_key(p + w): prefix + base for p in forms for w in words}
    return table


@lru_cache(maxsize=2**16)
def unit_named(text: str | None) -> str | None:
    """The unit that a text consists of, or None."""
    return spellings().get(_key(text)) if text and text.strip() else None


_STATEMENTS = (
    re.compile(r"(?:values?\s+in|outputs?\s+in|scaled\s+to|\bunits?\b\s*[:=]?)\s*(\S.*)$", re.I),
    re.compile(r"[(\[]([^()\[\]]+(?:\([^()]*\))?)[)\]]\s*$"),
    re.compile(r"\s/(/?\S.*)$"),
)


@lru_cache(maxsize=2**16)
def unit_stated(text: str | None) -> str | None:
    """The unit that a longer text states for the values; one that stands for anything else doesn't count."""
    for pattern in _STATEMENTS:
        m = pattern.search(text or "")
        if m and (u := unit_named(m[1])):
            return u
    return None


@lru_cache(maxsize=2**16)
def _kind(label: str | None) -> str:
    return " ".join(sorted(re.findall(r"[a-z]{2,}", (label or "").lower())))


@lru_cache(maxsize=2**16)
def units_near(text: str | None) -> tuple[str, ...]:
    """Units with a spelling of three or more characters that the text is one mistyped character away from."""
    key = _key(text) if text and text.strip() else ""
    return tuple(sorted({u for s, u in spellings().items() if min(len(s), len(key)) >= 3 and _mistyped(key, s)}))


def _mistyped(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b or a.isdigit():
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def evidence(dimension: str | None, others, index: dict[str, int]) -> tuple[int, list[int]]:
    """(what kind of text tells, numbers of the units that it tells)."""
    u = index.get((dimension or "").strip(), index.get(unit_named(dimension), -1))
    if u >= 0:
        return NAMED_TEXT, [u]
    told = sorted({index[x] for x in map(unit_stated, others) if x in index})
    if told:
        return OTHER_TEXT, told
    near = sorted(index[x] for x in units_near(dimension) if x in index)
    return (NEAR_TEXT, near) if near else (NO_TEXT, [])


def magnitudes(lo: np.ndarray, hi: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Rows x units: log10 of the larger limit in common units, NaN without one or for a unit without conversion."""
    a, b = factors[:, 0], factors[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.log10(np.fmax(np.abs(a * lo[:, None] + b), np.abs(a * hi[:, None] + b)))
    return np.where(np.isfinite(x), x, np.nan)


def viterbi(emission: np.ndarray, transition: np.ndarray, sizes: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
    """The most likely state of each row (columns: states; log scale), for all chains at once.

    ``starts`` are the first rows of the chains, one by default; ``sizes`` the logarithms by row and state whose jumps count."""
    n, k = emission.shape
    starts = np.zeros(1, int) if starts is None else starts
    length = np.diff(np.r_[starts, n])
    by = np.argsort(-length, kind="stable")
    starts, length = starts[by], length[by]
    back = np.zeros((n, k), np.int16)
    score = emission[starts].astype(np.float32)
    path, states = np.empty(n, np.int16), transition.astype(np.float32)
    for t in range(1, int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -t))
        rows = starts[:live] + t
        total = score[:live, :, None] + states
        if sizes is not None:
            with np.errstate(invalid="ignore"):
                z = (sizes[rows][:, None, :] - sizes[rows - 1][:, :, None]) / JUMP
            total -= 0.5 * np.nan_to_num(np.minimum(z * z, FARTHEST**2), nan=0.0).astype(np.float32)
        back[rows] = total.argmax(1)
        score[:live] = total.max(1) + emission[rows]
    path[starts + length - 1] = score.argmax(1)
    for t in range(int(length.max(initial=0)) - 1, 0, -1):
        live = int(np.searchsorted(-length, -t))
        rows = starts[:live] + t
        path[rows - 1] = back[rows, path[rows]]
    return path


def smooth_level(own: np.ndarray, ends: tuple[np.ndarray, np.ndarray], mean: float, sd: float) -> tuple[np.ndarray, np.ndarray]:
    """(level, width) at each row from the values of rows near it (NaN: none), drawn towards the mean of all data.

    ends: of each row the first row of its chain and the one after its last."""
    there = np.isfinite(own)
    sums, counts = np.r_[0.0, np.cumsum(np.where(there, own, 0.0))], np.r_[0, np.cumsum(there)]
    i = np.arange(len(own))
    a, b = np.maximum(i - WINDOW, ends[0]), np.minimum(i + WINDOW + 1, ends[1])
    n = counts[b] - counts[a]
    return (sums[b] - sums[a] + 2 * mean) / (n + 2), (n * WIDTH + 2 * sd) / (n + 2)


class Model:
    """The units of a reference list as states, and the level of each quantity over all data."""

    def __init__(self, symbols: list[str], quantities: list[str], conversions: dict):
        self.symbols, self.quantities = symbols, quantities
        self.index = {s: i for i, s in enumerate(symbols)}
        self.factors = np.array([conversions.get(s, (np.nan, np.nan)) for s in symbols], float).reshape(-1, 2)
        same = np.array([[a == b for b in quantities] for a in quantities])
        self.transition = np.where(np.eye(len(symbols), dtype=bool), STAY, np.where(same, SAME, np.log(0.1 / max(len(symbols), 1)))) if symbols else np.zeros((0, 0))
        self.level: dict[str, tuple[float, float]] = {}
        self.words: dict[str, np.ndarray] = {}  # log odds of each quantity by word of a label
        self.names = list(dict.fromkeys(quantities))

    def learn(self, counts: list[tuple[str, int, int]]):
        """From (word, number of the quantity, rows); every quantity is a little likely with every word."""
        n: dict[str, np.ndarray] = {}
        for w, q, c in counts:
            n.setdefault(w, np.zeros(len(self.names)))[q] += c
        share = (sum(n.values()) + 1.0) if n else np.ones(len(self.names))
        share = share / share.sum()
        self.words = {w: np.log((c + 0.5 * share) / (c.sum() + 0.5) / share) for w, c in n.items()}

    def odds(self, label: str) -> np.ndarray:
        """Log odds of the quantities by the words of a kind of channel."""
        found = [self.words[w] for w in label.split() if w in self.words]
        return np.clip(sum(found), -8.0, 8.0) if found else np.zeros(len(self.names))

    def decode(self, kinds: np.ndarray, told: list, labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """State of each row; kinds and told are the evidence of the texts."""
        sizes = magnitudes(lo, hi, self.factors)
        n = len(lo)
        first = np.array([u[0] if len(u) == 1 and k in (OTHER_TEXT, NAMED_TEXT) else -1 for k, u in zip(kinds, told)], int)
        own = np.where(first >= 0, sizes[np.arange(n), first], np.nan)
        length = np.diff(np.r_[starts, n])
        ends = np.repeat(starts, length), np.repeat(starts + length, length)
        emission = np.zeros((n, len(self.symbols)), np.float32)
        quantity = np.array(self.quantities, object)
        codes, distinct = pd.factorize(labels)
        odds = np.stack([self.odds(x) for x in distinct])[codes]
        for q in self.names:
            mean, sd = self.level.get(q, (0.0, 3.0))
            at, width = smooth_level(np.where((first >= 0) & (quantity[first] == q), own, np.nan), ends, mean, sd)
            for j in np.flatnonzero(quantity == q):
                with np.errstate(invalid="ignore"):
                    z = (sizes[:, j] - at) / width
                emission[:, j] = np.nan_to_num(-0.5 * np.minimum(z * z, FARTHEST**2), nan=0.0) + odds[:, self.names.index(q)]
        weight = np.array([0.0, STATED, NEAR, NAMED], np.float32)[kinds]
        many = np.array([len(u) for u in told])
        rows = np.repeat(np.arange(n), many)
        emission[rows, np.concatenate([np.asarray(u, int) for u in told]) if many.any() else np.zeros(0, int)] += weight[rows]
        return viterbi(emission, self.transition, sizes, starts)


RESULT = (("unit_id", "bigint"), ("symbol", "string"), ("quantity", "string"), ("is_common", "boolean"), ("source", "string"), ("common_min", "double"), ("common_max", "double"))


def harmonise(signals: DataFrame, devices: DataFrame, units: DataFrame, file: str, place: str, device: list[str], dimension: str, low: str, high: str, texts: list[str], conversions: dict | None = None) -> DataFrame:
    """Columns: file, place, unit_id, symbol, quantity, is_common, source ('stated', 'mistyped' or 'inferred'), common_min, common_max.

    One row per (file, place). ``source`` tells what the decoded unit rests on besides the ranges: a text that names it, a text that
    is a letter away from it, or none (an estimate). ``units`` is the reference list (unit_id, symbol, quantity, is_common); its units are the
    states of the model, at most 1000. ``conversions`` (symbol: factor and shift to the common unit) adds to the built-in ones; a unit
    without one is found by its symbol in texts only and has null results. ``devices`` gives the device columns of a file; files that it lacks
    form one device. Null or non-finite limits give no evidence and null results. Rows with null file or place are left out; if rows of a
    key differ, the one with the clearest text counts, then the greatest. Runs jobs: the rows are written once to the shared folder, and levels are counted."""
    ref = units.select("unit_id", "symbol", "quantity", "is_common").where("symbol is not null").limit(1001).toPandas()
    if len(ref) > 1000:
        raise ValueError("the list has more than 1000 units")
    ref = ref.sort_values("unit_id", kind="stable").drop_duplicates("symbol").reset_index(drop=True)
    model = Model(list(ref.symbol), list(ref.quantity), TO_COMMON | (conversions or {}))
    quantity = {q: i for i, q in enumerate(model.names)}
    kinds = dict(signals.dtypes)

    def read(batches):
        for pdf in batches:
            told = [evidence(d, t, model.index) for d, t in zip(pdf["dimension"], pdf["others"])]
            sizes = magnitudes(pdf.lo.to_numpy(float), pdf.hi.to_numpy(float), model.factors) if len(model.symbols) else np.zeros((len(pdf), 1))
            own = [float(sizes[i, u[0]]) if len(u) == 1 and k != NEAR_TEXT else None for i, (k, u) in enumerate(told)]
            yield pd.DataFrame({"file": pdf.file, "place": pdf.place, "text": np.array([k for k, _ in told], np.int8), "told": [u for _, u in told], "kind": [_kind(x) for x in pdf.label],
                                "lo": pdf.lo, "hi": pdf.hi, "q": pd.array([quantity[model.quantities[u[0]]] if m is not None and m == m else None for (_, u), m in zip(told, own)], "Int32"), "own": own})

    columns = [F.col(file).alias("file"), F.col(place).alias("place"), F.col(dimension).cast("string").alias("dimension"), F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi")]
    label = F.col(texts[0]).cast("string") if texts else F.lit(None).cast("string")
    others = F.array(*[F.col(t).cast("string") for t in texts]).cast("array<string>").alias("others")
    source = signals.select(*columns, label.alias("label"), others).where("file is not null and place is not null")
    read_schema = f"file {kinds[file]}, place {kinds[place]}, text tinyint, told array<int>, kind string, lo double, hi double, q int, own double"
    best = F.max(F.struct("text", "told", "kind", "lo", "hi", "q", "own")).alias("x")
    rows = source.mapInPandas(read, read_schema).groupBy("file", "place").agg(best).select("file", "place", "x.*")
    owner = devices.select(F.col(file).alias("file"), F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in device]).alias("device")).groupBy("file").agg(F.max("device").alias("device"))
    rows = materialize(rows.join(owner, "file", "left").withColumn("device", F.coalesce("device", F.lit(""))), "units")

    # One row for each quantity of the list.
    seen = rows.where("q is not null").groupBy("q").agg(F.avg("own").alias("m"), F.stddev_pop("own").alias("sd")).collect()
    model.level = {model.names[r.q]: (r.m, max(0.3, r.sd)) for r in seen}

    # Words that stand in a share of the stated rows of at least WORD_SHARE: their number is bounded by the share alone.
    words = rows.where("q is not null").select(F.explode(F.array_distinct(F.split("kind", " "))).alias("w"), "q").where("w <> ''")
    least = max(LEAST_WORDS, int(words.count() * WORD_SHARE))
    model.learn([(r.w, r.q, r.n) for r in words.groupBy("w", "q").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy("w", "q").collect()])

    numbered = positions(rows.select("device", "kind", "file", "place", "text", "told", "lo", "hi"), ["device", "kind"], ["file", "place"], _shard(kinds[file]), "pos").withColumn("pos", F.col("pos") - 1)
    b, at = F.floor(F.col("pos") / BLOCK), F.col("pos") % BLOCK
    copies = F.array(b, F.when((at < CONTEXT) & (b > 0), b - 1), F.when(at >= BLOCK - CONTEXT, b + 1))
    blocks = numbered.withColumn("block", F.explode(F.array_compact(copies))).withColumn("mine", F.col("block") == b).repartition("device", "kind", "block").sortWithinPartitions("device", "kind", "block", "pos")

    def decode(batches):
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = _starts(rest)[-1:] if len(rest) else []
            if len(last) and last[0]:
                yield _decoded(model, ref, rest.iloc[: last[0]])
                rest = rest.iloc[last[0] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield _decoded(model, ref, rest)

    schema = f"file {kinds[file]}, place {kinds[place]}, " + ", ".join(f"{n} {t}" for n, t in RESULT)
    out = blocks.mapInPandas(decode, schema) if len(ref) else blocks.select("file", "place", *[F.lit(None).cast(t).alias(n) for n, t in RESULT]).limit(0)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("common_min", "common_max")]
    return out.select(F.col("file").alias(file), F.col("place").alias(place), *[n for n, _ in RESULT[:-2]], *clean)


def _shard(kind: str):
    """Cuts a chain for numbering its rows: by file where that's a number, else not at all."""
    return F.floor(F.col("file") / 65536) if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal") else F.lit(0)


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    """First rows of the blocks of chains in sorted rows."""
    new = np.ones(len(pdf), bool)
    for c in ("device", "kind", "block"):
        v = pdf[c].to_numpy()
        new[1:] &= v[1:] == v[:-1]
    new[1:] = ~new[1:]
    return np.flatnonzero(new)


def _decoded(model: Model, ref: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
    lo, hi, told, text = pdf.lo.to_numpy(float), pdf.hi.to_numpy(float), list(pdf.told), pdf.text.to_numpy(int)
    state = model.decode(text, told, pdf.kind.to_numpy(object), lo, hi, _starts(pdf))
    by = np.array(["inferred", "stated", "mistyped", "stated"], object)[text]
    by[[s not in u for s, u in zip(state, told)]] = "inferred"
    f = model.factors[state]
    pick = lambda c: ref[c].to_numpy()[state]
    out = pd.DataFrame({"file": pdf.file, "place": pdf.place, "unit_id": pick("unit_id"), "symbol": pick("symbol"), "quantity": pick("quantity"), "is_common": pick("is_common").astype(bool), "source": by, "common_min": f[:, 0] * lo + f[:, 1], "common_max": f[:, 0] * hi + f[:, 1]})
    return out[pdf.mine.to_numpy(bool)]
