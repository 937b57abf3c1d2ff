"""Token ids of whole corpora by a byte-level BPE vocabulary.

Pre-tokenisation is vectorised over a batch of texts. Every code point has a class (letter,
number, white space, other) from a table; an automaton over classes decides where words begin.
Its transition functions compose associatively, and a change of class resets the automaton
whatever its state was; so the scan of composed functions collapses to comparing each place with
its neighbours, which a few shifted arrays do. No regular expression runs over the texts.

Words are slices of the batch. Equal slices are found by a 64-bit hash from prefix sums and
then compared code point by code point, so a collision can't change a result; each distinct slice
goes once through the cached pair merging of its worker. Ids and word offsets are gathered from
there, again as arrays.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
CACHE_WORDS = 2_000_000
BATCH_POINTS = 4_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point, as the vocabulary's pattern has them (general categories L* and N*, White_Space)."""
    table = np.full(0x110000, OTHER, np.uint8)
    cats = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    cats = np.frombuffer(cats.encode("ascii"), np.uint8)
    table[cats == ord("L")] = LETTER
    table[cats == ord("N")] = NUMBER
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


@lru_cache(maxsize=1)
def _salts() -> tuple[np.ndarray, np.uint64, np.uint64]:
    """A random 64-bit number for each code point, and an odd base with its inverse modulo 2**64."""
    rng = np.random.default_rng(20240229)
    base = 0x9E3779B97F4A7C15
    return rng.integers(0, 2**64, 0x110000, np.uint64), np.uint64(base), np.uint64(pow(base, -1, 2**64))


def word_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places in a batch of code points where words begin. text_starts: where the (non-empty) texts begin."""
    n = len(cp)
    cls = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 255, cls[:-1]
    prev[first[:-1]] = 255
    change = cls != prev
    space = cls == SPACE
    start = change.copy()
    # A blank right before anything else belongs to it; other white space before it is a word of its own.
    last_of_spaces = np.zeros(n, bool)
    last_of_spaces[:-1] = space[:-1] & (cls[1:] != SPACE) & ~first[1:-1]
    glued = last_of_spaces & (cp == 0x20)
    start[1:][glued[:-1]] = False
    start[last_of_spaces] = True
    # Contractions: an apostrophe that begins a word, with s, t, m, d, re, ve or ll after it.
    apostrophes = np.flatnonzero((cp == 0x27) & change)
    if len(apostrophes):
        a = apostrophes[(apostrophes == 0) | first[apostrophes] | ~glued[np.maximum(apostrophes - 1, 0)]]
        at = lambda k: np.where(a + k < n, cp[np.minimum(a + k, n - 1)], 0)
        in1 = (a + 1 < n) & ~first[np.minimum(a + 1, n)]
        in2 = in1 & (a + 2 < n) & ~first[np.minimum(a + 2, n)]
        c1, c2 = at(1), at(2)
        short = in1 & np.isin(c1, [ord(c) for c in "stmd"])
        long = in2 & ~short & (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l")))
        for hit, k in ((short, 2), (long, 3)):
            b = a[hit]
            start[b + 1] = False
            b = b[b + k < n]
            start[b + k] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of byte sequences and cached pair merging."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, np.ndarray] = {}
        try:
            import tiktoken

            self._core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        except Exception:
            self._core = None

    def merge(self, raw: bytes) -> list[int]:
        """Joins the neighbouring pair of lowest rank until no pair is in the vocabulary."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 2**31), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 2**31:
                break
            pair, out, i = parts[at] + parts[at + 1], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] + parts[i + 1] == pair:
                    out.append(pair)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def word(self, w: str) -> np.ndarray:
        ids = self.cache.get(w)
        if ids is None:
            raw = w.encode("utf-8", "surrogatepass")
            # A very long word is merged in compiled code, where the library is there.
            ids = np.array(self._core(raw) if self._core else self.merge(raw), np.int32)
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[w] = ids
        return ids


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _distinct(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's kind, a word of each kind). Equal hashes are verified code point by code point."""
    salt, base, inverse = _salts()
    n = len(cp)
    with np.errstate(over="ignore"):
        powers = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)], out=powers)
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(salt[cp] * powers[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    kind, _ = pd.factorize(h)
    order = np.full(int(kind.max(initial=-1)) + 1, -1, np.int64)
    order[kind[::-1]] = np.arange(len(kind))[::-1]
    length = ends - starts
    rep = order[kind]
    odd = length != length[rep]
    cmp_len = np.where(odd, 0, length)
    flat = np.arange(int(cmp_len.sum())) - np.repeat(np.cumsum(cmp_len) - cmp_len, cmp_len)
    same = cp[np.repeat(starts, cmp_len) + flat] == cp[np.repeat(starts[rep], cmp_len) + flat]
    if odd.any() or not same.all():  # a collision: name the words by their text
        bad = np.unique(np.r_[np.flatnonzero(odd), np.repeat(np.arange(len(starts)), cmp_len)[~same]])
        kind = kind.copy()
        kinds = len(order)
        extra = {}
        for w in bad:
            key = cp[starts[w] : ends[w]].tobytes()
            kind[w] = extra.setdefault(key, kinds + len(extra))
        order = np.r_[order, np.zeros(len(extra), np.int64)]
        order[kind[bad][::-1]] = bad[::-1]
    return kind, order


def encode(texts: list[str | None], vocab: Vocabulary, offsets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(ids of all texts in a row, where each text's ids end, code-point offset of each id's word in its text)."""
    present = [t for t in texts if t]
    cp = np.frombuffer("".join(present).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    ends_of_text = np.cumsum(sizes)
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int32) if offsets else None
    begins = (ends_of_text - sizes)[sizes > 0]
    starts = word_starts(cp, begins)
    ends = np.r_[starts[1:], len(cp)]
    kind, order = _distinct(cp, starts, ends)
    whole = cp.tobytes()
    ids = [vocab.word(whole[4 * starts[w] : 4 * ends[w]].decode("utf-32-le", "surrogatepass")) for w in order]
    counts = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    base = np.cumsum(counts) - counts
    per = counts[kind]
    total = np.cumsum(per)
    out = flat[np.repeat(base[kind], per) + np.arange(int(total[-1])) - np.repeat(total - per, per)]
    upto = np.searchsorted(starts, ends_of_text, "left")
    stop = np.r_[0, total][upto]
    places = None
    if offsets:
        text_of = np.searchsorted(ends_of_text, starts, "right")
        places = np.repeat((starts - (ends_of_text - sizes)[text_of]).astype(np.int32), per)
    return out, stop, places


def _batches(texts: list[str | None]):
    """Slices of a list with about BATCH_POINTS code points each; a longer text is a slice of its own."""
    at, load = 0, 0
    for i, t in enumerate(texts):
        load += len(t or "")
        if load >= BATCH_POINTS:
            yield at, i + 1
            at, load = i + 1, 0
    if at < len(texts) or not texts:
        yield at, len(texts)


def encode_table(docs: DataFrame, key: str, text: str, vocab_path: str, offsets: bool = False) -> DataFrame:
    """key, ids (array<int>) of each row by the vocabulary at vocab_path (``token rank`` lines, base64), without special tokens.

    Null and empty texts have an empty list. One row per input row, also for repeated keys. With ``offsets``, a column
    ``places`` has the code-point offset of each id's word in the text. The path must exist on all executors. Strings of
    special tokens are ordinary text. Other columns are ignored."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _batches(texts):
                ids, stop, places = encode(texts[i:j], vocab, offsets)
                ends = pa.array(np.r_[0, stop].astype(np.int32))
                arrays = [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))]
                if offsets:
                    arrays.append(pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["key", "ids", "places"] if offsets else ["key", "ids"]
    schema = f"key {dict(docs.dtypes)[key]}, ids array<int>" + (", places array<int>" if offsets else "")
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    """The text of a list of ids."""
    table = _pieces(vocab)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def _pieces(vocab: Vocabulary) -> list[bytes]:
    if not hasattr(vocab, "pieces"):
        vocab.pieces = [p for p, _ in sorted(vocab.ranks.items(), key=lambda x: x[1])]
    return vocab.pieces


def tokenizer_path(spark, name: str) -> str:
    """A vocabulary file: below spark.tracelode.tokenizers, or else where /opt/tokenizers has it."""
    return os.path.join(spark.conf.get("spark.tracelode.tokenizers", "/opt/tokenizers"), name)


assert sys.byteorder == "little"
