"""Text decoded with a wrong character encoding: found, and restored where the original isn't lost.

Adjacent characters are counted over the whole corpus, by language (if a column tells it) and overall. A pair's
score is the logarithm of its share in the mutual information of adjacent characters: how often it stands in the corpus, times how
much more often than its characters would meet by chance. Pairs that stand for much of the information are the language's
own; those of a wrong decoding are rare beside them. The threshold comes from the corpus: the score below which a share ``IMPROBABLE``
of the language's pairs with a non-ASCII character lies.

In each stretch of non-ASCII characters with its neighbours, the maximum-scoring segments of (threshold - score) are the
improbable runs. Inverse mappings are tested only on the characters of those: the run is encoded with the encoding
that was wrongly used and decoded with another one. A mapping counts by how much more probable it makes the run, given its neighbours, under the
corpus' pair counts; one between single-byte encodings, where any run decodes to something, also by
how much more often the corpus has each restored character between its two neighbours, and it counts
only where the restored word is known. Replacement characters and control characters of the upper range carry no
information, so they're always in a run; they prove it wrong, though their original may be lost.

Counts are exact, by the characters themselves or by 64-bit hashes. What stands in less than a share ``FLOOR`` of a table's
occurrences counts as not seen, so a table has at most 1 / ``FLOOR`` rows at any size of corpus. Texts are only
mapped, never shuffled.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators.hot import materialize

FLOOR = 2.0**-21
IMPROBABLE = 0.5
SMOOTH = 0.2
LEAST_UTF8, LEAST_WORD, LEAST_SIGN, LEAST_WITH, LEAST_NEW = 0.5, 5.0, 6.0, 3.0, 10.0
PAIR, ONE, TRIPLE, WORD = range(4)
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"\w*[^\W\x00-\x7f]\w*")
_SURE = re.compile("[\x80-\x84\x86-\x9f�]")

# Encodings that texts are wrongly decoded with, and the single-byte ones they were written in.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-2", "cp866", "koi8-r")
SINGLE = {
    "cp1252": ("cp1250", "cp1251", "mac_roman", "cp850", "iso8859-2", "koi8-r", "cp866"),
    "latin-1": ("iso8859-2", "cp1251", "koi8-r"),
    "mac_roman": ("cp1252",),
    "cp437": ("cp1252",),
    "cp850": ("cp1252",),
    "cp1250": ("cp1252",),
    "cp1251": ("cp866", "koi8-r", "cp1252"),
    "cp866": ("cp1251",),
    "koi8-r": ("cp1251",),
}


@lru_cache(maxsize=None)
def byte_of(encoding: str) -> dict[str, int]:
    """Bytes by character; what an encoding leaves undefined stands for the control character of the same number, as browsers have it."""
    table = {}
    for b in range(256):
        try:
            c = codecs.decode(bytes([b]), encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


def mappings() -> list[tuple[str, str]]:
    """(wrong, right) pairs: UTF-8 first, then single-byte ones."""
    return [(w, "utf-8") for w in WRONG] + [(w, r) for w, rs in SINGLE.items() for r in rs]


_MULTI = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


@lru_cache(maxsize=None)
def _stretches(wrong: str) -> re.Pattern:
    """Stretches of characters that an encoding has for the upper half of the bytes."""
    return re.compile("[" + "".join(re.escape(c) for c, b in byte_of(wrong).items() if b > 127) + "]+")


def restore(run: str, wrong: str, right: str) -> str | None:
    """The run as it was before the wrong decoding, or None if it can't have come from one.

    In a run of proper and wrong characters only the part that the mapping explains is changed: for UTF-8 valid
    sequences of several bytes, otherwise stretches that the wrong encoding has, where other characters stand beside them."""
    table = byte_of(wrong)

    def back(m: re.Match) -> str:
        raw = bytes([table[c] for c in m[0]])
        if right != "utf-8":
            return raw.decode(right)
        out, at = "", 0
        for v in _MULTI.finditer(raw):
            try:
                out, at = out + m[0][at : v.start()] + v[0].decode("utf-8"), v.end()
            except UnicodeDecodeError:
                pass
        return out + m[0][at:]

    try:
        r = _stretches(wrong).sub(back, run)
    except UnicodeDecodeError:
        return None
    return None if r == run else r


def _mix(a: np.ndarray, b) -> np.ndarray:
    """Hash of each a with b; a is an array, so that products wrap without a warning."""
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(b).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(31))


def _salt(group: str | None) -> int:
    """What sets the counts of a language apart, 21 bits; 0 is for all texts."""
    return 0 if group is None else zlib.crc32(group.encode("utf-8", "surrogatepass")) % (2**21 - 1) + 1


def _ones(cp: np.ndarray, salt: int) -> np.ndarray:
    return (np.uint64(salt) << np.uint64(42)) | cp.astype(np.uint64)


def _pairs(cp: np.ndarray, salt: int) -> np.ndarray:
    c = cp.astype(np.uint64)
    return (np.uint64(salt) << np.uint64(42)) | (c[:-1] << np.uint64(21)) | c[1:]


def _triples(cp: np.ndarray, salt: int) -> np.ndarray:
    return _mix(_mix(_mix(cp[:-2], cp[1:-1]), cp[2:]), salt)


def _word(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _count(batches):
    """Per batch and language counts of pairs and triples with a non-ASCII character, of characters and of words."""
    for b in batches:
        groups: dict[str, list[str]] = {}
        for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t:
                groups.setdefault(g or "", []).append(t)
        sides, keys, counts = [], [], []
        for g, texts in groups.items():
            cp = _points("\n" + "\n".join(texts) + "\n")
            at = np.flatnonzero((cp[:-1] > 127) | (cp[1:] > 127))
            mid = np.flatnonzero(cp[1:-1] > 127) + 1
            ones = np.bincount(cp)
            single = np.flatnonzero(ones)
            chunks = Counter(c for t in texts if not t.isascii() for c in t.split() if not c.isascii())
            words: Counter = Counter()
            for c, n in chunks.items():
                for w in _WORD.findall(c):
                    words[_word(w)] += n
            two, three = np.stack([cp[at], cp[at + 1]], 1), np.stack([cp[mid - 1], cp[mid], cp[mid + 1]], 1)
            pair, many = np.unique((two[:, 0].astype(np.uint64) << np.uint64(21)) | two[:, 1], return_counts=True)
            plain = _mix(_mix(three[:, 0], three[:, 1]), three[:, 2])
            triple, often = np.unique(plain, return_counts=True)
            word = np.fromiter(words, np.uint64, len(words))
            for salt in {_salt(None), _salt(g)}:
                top = np.uint64(salt) << np.uint64(42)
                found = {PAIR: (pair | top, many), ONE: (_ones(single, salt), ones[single]), TRIPLE: (_mix(triple, salt), often), WORD: (_mix(word, salt), np.fromiter(words.values(), np.int64, len(words)))}
                for side, (h, n) in found.items():
                    sides.append(np.full(len(h), side, np.int32))
                    keys.append(h.view(np.int64))
                    counts.append(n.astype(np.int64))
        if sides:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sides)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], names=["side", "key", "n"])


class Table:
    """Counts by 64-bit key; 0 for a key that isn't there."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        keys = np.asarray(keys, np.int64).view(np.uint64)
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], np.asarray(counts, float)[by].astype(np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0).astype(float)


class Model:
    """Counts of a corpus, and what they say about a run in a text of some language."""

    def __init__(self, tables: list[Table]):
        self.tables = tables
        every = tables[ONE].keys < np.uint64(1 << 42)  # the counts of all texts
        self.total = float(max(tables[ONE].counts[every].sum(dtype=float), 1))
        self.totals = dict(zip(*self._by_salt(tables[ONE])))
        self.thresholds = self._thresholds()
        self.memo: dict = {}

    @staticmethod
    def _by_salt(t: Table) -> tuple[list, list]:
        salts, of = np.unique(t.keys >> np.uint64(42), return_inverse=True)
        return salts.tolist(), np.bincount(of, weights=t.counts, minlength=len(salts)).tolist()

    def _thresholds(self) -> dict[int, float]:
        """Of each language the score below which a share of IMPROBABLE of its pairs lies, weighed by how often they stand."""
        t, out = self.tables[PAIR], {}
        mask = np.uint64((1 << 21) - 1)
        salts, begin = np.unique(t.keys >> np.uint64(42), return_index=True)
        for salt, i, j in zip(salts.tolist(), begin, [*begin[1:], len(t.keys)]):
            k = t.keys[i:j]
            score = self._score(t.counts[i:j].astype(float), (k >> np.uint64(21)) & mask, k & mask, salt)
            by = np.argsort(score)
            share = np.cumsum(t.counts[i:j][by], dtype=float)
            out[salt] = float(score[by][np.searchsorted(share, IMPROBABLE * share[-1])])
        return out

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def _score(self, n: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        total = max(self.totals.get(salt, 1.0), 1.0)
        one = self.tables[ONE]
        expected = one.of(_ones(a, salt)) * one.of(_ones(b, salt)) / total
        information = np.log((n + SMOOTH) / (expected + SMOOTH))
        return np.log((n + SMOOTH) / total) + np.log(np.logaddexp(0.0, information))

    def scores(self, s: str, salt: int) -> np.ndarray:
        """Of each adjacent pair the logarithm of its share in the language's mutual information (in nats, kept above zero)."""
        cp = _points(s)
        return self._score(self.tables[PAIR].of(_pairs(cp, salt)), cp[:-1], cp[1:], salt)

    def runs(self, before: str, stretch: str, after: str, salt: int) -> list[tuple[int, int]]:
        """Improbable runs (from, to) of a stretch of non-ASCII characters."""
        key = (before, stretch, after, salt, None)
        found = self.memo.get(key)
        if found is None:
            weight = self.thresholds.get(salt, np.inf) - self.scores(before + stretch + after, salt)
            for m in _SURE.finditer(stretch):
                weight[m.start() : m.start() + 2] = np.inf
            touched = np.zeros(len(stretch) + 2, bool)
            for i, j in segments(np.clip(weight, -50.0, 50.0)):
                touched[i : j + 1] = True
            edges = np.diff(np.r_[0, touched[1:-1].astype(int), 0])
            found = self.memo[key] = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        return found

    def weigh(self, texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text (two things, both logs): the probability of its characters after the first, each given the one before it;
        how often each inner non-ASCII character stands between its neighbours."""
        cp = _points("".join(texts))
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        one = self.tables[ONE].of(_ones(cp, salt))
        n = self.tables[PAIR].of(_pairs(cp, salt))
        log = np.log((n + 5.0 * (one[1:] + SMOOTH) / self.total + 1e-3) / (one[:-1] + 5.0))
        inside = of[:-1] == of[1:]
        likelihood = np.bincount(of[1:][inside], log[inside], len(texts))
        middle = (cp[1:-1] > 127) & (of[:-2] == of[2:])
        triples = self.tables[TRIPLE].of(_triples(cp, salt)[middle])
        return likelihood, np.bincount(of[1:-1][middle], np.log(triples + 0.5), len(texts))

    def seen(self, characters: set[str]) -> bool:
        """Whether all of the characters stand in the corpus."""
        return bool((self.tables[ONE].of(_ones(_points("".join(characters)), 0)) > 0).all())

    def known(self, words: list[str], salt: int) -> bool:
        """Whether every one of the words that has a non-ASCII letter stands in the corpus more than once."""
        hashes = np.array([_word(w) for w in words if not w.isascii()], np.uint64)
        return bool((self.tables[WORD].of(_mix(hashes, salt)) >= 2).all())

    def judge(self, before: str, run: str, after: str, salt: int = 0) -> tuple[bool, list[tuple[int, float, str]]]:
        """(whether it's wrong in any case, [(mapping, gain, restored)]) for an improbable run."""
        key = (before, run, after, salt)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > 1 << 18:
                self.memo.clear()
            found = self.memo[key] = self._judge(before, run, after, salt)
        return found

    def _judge(self, before, run, after, salt):
        sure = bool(_SURE.search(run))
        s = before + run + after
        tried = []
        for k, (wrong, right) in enumerate(MAPPINGS):
            r = restore(run, wrong, right)
            if r is None or _SURE.search(r):
                continue  # no text has replacement or control characters of the upper range
            tried.append((k, r))
            if right == "utf-8" and (twice := restore(r, wrong, right)) is not None:
                tried.append((k, twice))  # text may have been decoded wrongly twice
        if not tried:
            return sure, []
        likelihood, familiarity = self.weigh([s, *(before + r + after for _, r in tried)], salt)
        best: dict[int, tuple[int, float, str]] = {}
        for (k, r), gain, known in zip(tried, (likelihood[1:] - likelihood[0]).tolist(), (familiarity[1:] - familiarity[0]).tolist()):
            gain += known if k >= UTF8 else 0.0
            if not self.seen(set(r) - set(run)):
                gain -= LEAST_NEW  # characters that the corpus doesn't have
            if gain > 0 and gain > best.get(k, (k, 0.0, ""))[1]:
                best[k] = (k, gain, r)
        out = list(best.values())
        return sure, sorted(out, key=lambda x: (x[0] >= UTF8 or x[1] < LEAST_UTF8, -x[1]))


MAPPINGS = mappings()
UTF8 = len(WRONG)


def segments(weights: np.ndarray) -> list[tuple[int, int]]:
    """All maximal-scoring segments [i, j) of a sequence, in one pass: no further weight on either side would raise their sums."""
    found: list[list] = []  # [i, j, sum before, sum up to the end]
    total = 0.0
    for k, w in enumerate(weights.tolist()):
        if w <= 0:
            total += w
            continue
        now = [k, k + 1, total, total + w]
        total += w
        while True:
            at = next((x for x in range(len(found) - 1, -1, -1) if found[x][2] < now[2]), None)
            if at is None or found[at][3] >= now[3]:
                found.append(now)
                break
            now = [found[at][0], now[1], found[at][2], now[3]]
            del found[at:]
    return [(i, j) for i, j, *_ in found]


def examine(text: str, model: Model, group: str | None = None) -> tuple[bool, str]:
    """(whether any character is wrongly decoded, the text with what can be restored)."""
    salt = _salt(group)
    around = lambda a, b: (text[a - 1] if a else "\n", text[b] if b < len(text) else "\n")
    runs = []
    for m in _RUN.finditer(text):
        before, after = around(*m.span())
        runs += [(m.start() + i, m.start() + j, m[0][i:j]) for i, j in model.runs(before, m[0], after, salt)]
    if not runs:
        return False, text
    verdicts = [model.judge(text[a - 1] if a else "\n", r, text[b] if b < len(text) else "\n", salt) for a, b, r in runs]
    proven = set()
    for (a, b, _), (sure, found) in zip(runs, verdicts):
        for k, gain, r in found:
            if k < UTF8 or gain < LEAST_WORD or k in proven:
                continue
            left, right = _edge(text, a, -1), _edge(text, b, 1)
            words = _WORD.findall(left + r + right)
            if model.known(words, salt) if words else gain >= LEAST_SIGN:
                proven.add(k)
    out, at, wrong = [], 0, False
    for (a, b, _), (sure, found) in zip(runs, verdicts):
        for k, gain, r in found:
            if sure or (gain >= LEAST_UTF8 if k < UTF8 else k in proven and gain >= LEAST_WITH):
                out += [text[at:a], r]
                at, wrong = b, True
                break
        wrong |= sure
    out.append(text[at:])
    return wrong, "".join(out)


def _edge(text: str, at: int, step: int) -> str:
    """The word characters right before or after a place, 64 at most."""
    if step > 0:
        return re.match(r"\w{0,64}", text[at : at + 64])[0]
    return re.search(r"\w{0,64}\Z", text[max(0, at - 64) : at])[0]


def corpus_model(docs: DataFrame, text: str, group: str | None) -> Model:
    """Counts over all texts, written once to the shared folder. At most 4 / FLOOR rows reach the driver."""
    rows = docs.select(F.col(text).cast("string").alias("t"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g")).where("t is not null")
    counts = materialize(rows.mapInArrow(_count, "side int, key bigint, n bigint").groupBy("side", "key").agg(F.sum("n").alias("n")), "characters")
    sums = {r.side: r.n for r in counts.groupBy("side").agg(F.sum("n").alias("n")).collect()}
    least = F.element_at(F.create_map(*[x for side in range(4) for x in (F.lit(side), F.lit(int(sums.get(side, 0) * FLOOR)))]), F.col("side"))
    kept = counts.where(F.col("n") >= least).toPandas()
    return Model([Table(x.key.to_numpy(), x.n.to_numpy()) for x in (kept[kept.side == side] for side in range(4))])


def repair(docs: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """key, restored text of each row that has a wrongly decoded character; where the original is lost the character stays.

    ``group`` is a column that tells the language; where it's null, counts over all texts are used. Null and blank texts
    have nothing to restore. One row per affected input row, also for repeated keys. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_model(docs, text, group))

    def run(batches):
        model = shared.value
        for b in batches:
            where, out = [], []
            for i, (t, g) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if t and not t.isascii():
                    wrong, fixed = examine(t, model, g)
                    if wrong:
                        where.append(i)
                        out.append(fixed)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), pa.array(out, pa.string())], names=["key", "restored"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"))
    return rows.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, restored string").withColumnRenamed("key", key)
