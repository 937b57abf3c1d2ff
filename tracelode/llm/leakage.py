"""Passages of evaluation items inside documents, whole or in part.

Words of a document are read down their columns (lines are assigned to columns by their
boxes), reduced to ASCII letters and digits, and folded so that letters that scanners take
for one another are the same. Windows of ``GRAM`` folded words are looked up in a hash set of
the items' windows, which is broadcast; items of more than ``ITEM_WORDS`` words altogether are looked up in
several such sets, one after the other. Hits are verified from each window that at most ``FEW_ITEMS`` items have, and from others
where several stand close together. Those around which too few words can follow, by comparing neighbours of many hits at
once, are left out first; from each other one the passage is followed in both directions word by word, allowing a misread word, a
word broken at a line's end, and whole lines standing in between, until another word comes.
A document leaks an item if at least ``LEAST_WORDS`` words in a row of the item are found.

Documents are only mapped, never shuffled; what is broadcast has a fixed bound.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

GRAM, LEAST_WORDS, LEAST_HITS, SKIP_LINES, AFTER_SKIP = 3, 12, 4, 8, 3
ITEM_WORDS = 5_000_000
PAGES = 500
HITS = 1 << 17
FEW_ITEMS = 2

# Letters that scanners take for one another, by the letter that stands for them.
CONFUSED = {"o": "eca0", "n": "rum", "i": "l1", "t": "f", "h": "b8", "s": "5", "v": "y", "g": "q"}
_FOLD = str.maketrans({c: k for k, cs in CONFUSED.items() for c in cs})
_WIDE = re.compile("nn+")
_NOISE = re.compile(r"[^0-9a-z]+")
_BIT = {c: 1 << i for i, c in enumerate(sorted({c.translate(_FOLD) for c in "0123456789abcdefghijklmnopqrstuvwxyz"}))}
_LETTERS = (1 << len(_BIT)) - 1


def fold(word: str) -> str:
    """A word with confusable letters made equal; two of the n kind are one, as rn is taken for m."""
    return _WIDE.sub("n", word.translate(_FOLD))


def plain(chunk: str) -> tuple[str, int, int, str, int]:
    """(ASCII letters and digits of a blank-separated chunk in lower case, hash of them folded, how many other letters dropped out, folded, sketch).

    Accented and wrongly decoded letters drop out; so do marks and specks. The sketch has, from the lowest bit, which
    letters the folded word has (32 bits), its length, the plain word's and how many letters dropped out (8 bits each, 255 at most)."""
    c = unicodedata.normalize("NFC", chunk).lower().replace("ß", "ss")
    w = _NOISE.sub("", c)
    f = fold(w)
    lost = 0 if c.isascii() else sum(not x.isascii() for x in c)
    sketch = sum(map(_BIT.__getitem__, set(f))) | min(len(f), 255) << 32 | min(len(w), 255) << 40 | min(lost, 255) << 48
    return w, zlib.crc32(f.encode()), lost, f, sketch


class _Known(dict):
    """Chunks seen before; forgotten altogether when there are too many."""

    def __missing__(self, chunk):
        if len(self) > 1 << 18:
            self.clear()
        found = self[chunk] = plain(chunk)
        return found


_SEEN = _Known()


def alike(a: str, b: str, fa: str, fb: str, lost: int) -> bool:
    """Whether words that differ after folding may still be the same, by accented or wrongly decoded letters that dropped out."""
    if not lost or abs(len(fa) - len(fb)) > 2 or a.isdigit() or b.isdigit():
        return False
    m = max(len(a), len(b))
    return m > 1 and _within(fa, fb, min(lost, 1 if m < 5 else 2))


@lru_cache(maxsize=1 << 18)
def _within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k."""
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > k:
            return False
    return row[-1] <= k


def reading_order(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """Order of lines down their columns, columns from left to right."""
    if len(x0) < 2:
        return np.arange(len(x0))
    by, widths, n = x0.argsort(kind="stable"), np.sort(x1 - x0), len(x0)
    gap = max(40.0, 0.3 * float(widths[n // 2] + widths[(n - 1) // 2]) / 2)
    column, left = np.zeros(n, int), x0[by]
    column[by[1:]] = (left[1:] - left[:-1] > gap).cumsum()
    return np.lexsort((y0, column))


def grams(keys: np.ndarray) -> np.ndarray:
    """Hash of each window of GRAM words."""
    if len(keys) < GRAM:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(keys) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = (h ^ keys[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Items:
    """Words of the evaluation items, and where each window of them stands."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.words, self.keys, self.lost, self.places, self.folded, sketches = [], [], [], [], [], []
        windows, item_of, at = [], [], []
        for k, (_, text) in enumerate(rows):
            chunks = [c for c in (text or "").split() if any(x.isalnum() for x in c)]
            kept = [(*x, i) for i, x in enumerate(map(plain, chunks)) if x[0]]
            self.words.append([x[0] for x in kept])
            self.keys.append([x[1] for x in kept])
            self.lost.append([x[2] for x in kept])
            self.folded.append([x[3] for x in kept])
            sketches.append([x[4] for x in kept])
            self.places.append([x[5] for x in kept])
            h = grams(np.array(self.keys[-1], np.uint64))
            windows.append(h)
            item_of.append(np.full(len(h), k))
            at.append(np.arange(len(h)))
        every = np.concatenate(windows) if windows else np.zeros(0, np.uint64)
        by = np.argsort(every, kind="stable")
        self.item_of, self.at = (np.concatenate(x)[by] if len(every) else np.zeros(0, int) for x in (item_of, at))
        # Of all words of all items, one after the other: where an item begins, keys, sketches, places.
        self.first = np.cumsum([0, *map(len, self.keys)])
        flat = lambda lists, kind: np.array([x for xs in lists for x in xs] + [0], kind)
        self.flat_keys, self.flat_sketches, self.flat_places = flat(self.keys, np.uint64), flat(sketches, np.int64), flat(self.places, int)
        self.hashes, self.begin = np.unique(every[by], return_index=True)
        self.size = np.diff(np.r_[self.begin, len(every)])

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in the document, item, place in the item, whether few items have it) of each window that both have."""
        if not len(self.hashes) or not len(h):
            return (np.zeros(0, int),) * 4
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        p = np.flatnonzero(self.hashes[at] == h)
        n = self.size[at[p]]
        j = np.repeat(self.begin[at[p]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(p, n), self.item_of[j], self.at[j], np.repeat(n, n) <= FEW_ITEMS


class Page:
    """A document's words in reading order; ``lay_out`` adds the line of each."""

    def __init__(self, text: str, x0, x1, y0):
        lines = text.split("\n")
        order = reading_order(x0, x1, y0).tolist() if len(x0) == len(lines) else range(len(lines))
        self.text, self.order = text, order
        known = _SEEN.__getitem__
        rows = [[t for t in map(known, lines[k].split()) if t[0]] for k in order]
        self.rows = [r for r in rows if r]
        self.words = [t for r in self.rows for t in r]

    def lay_out(self):
        sizes = [len(r) for r in self.rows]
        self.line = [k for k, n in enumerate(sizes) for _ in range(n)]
        self.starts = [0]
        for n in sizes:
            self.starts.append(self.starts[-1] + n)


    def without(self, words: set[int]) -> str:
        """The text without the given words; lines that only had such words go too."""
        lines = self.text.split("\n")
        at = 0
        for k in self.order:
            kept, cut = [], False
            for chunk in re.split(r"(\s+)", lines[k]):
                if chunk and not chunk.isspace() and _SEEN[chunk][0]:
                    cut |= at in words
                    kept.append("" if at in words else chunk)
                    at += 1
                else:
                    kept.append(chunk)
            if cut:
                lines[k] = re.sub(r"\s+", " ", "".join(kept)).strip() or None
        return "\n".join(x for x in lines if x is not None)


class _Trace:
    """Follows a passage of one item through a page."""

    def __init__(self, page: Page, items: Items, k: int):
        self.page, self.words, self.lost, self.folded, self.places = page, items.words[k], items.lost[k], items.folded[k], items.places[k]

    def same(self, p: int, q: int) -> bool:
        w, _, lost, f, _ = self.page.words[p]
        want = self.folded[q]
        return f == want or alike(w, self.words[q], f, want, lost + self.lost[q])

    def joined(self, a: int, b: int, q: int) -> bool:
        """Whether words a and b of the page, broken at a line's end, make up word q of the item."""
        one, two, want = self.page.words[a], self.page.words[b], self.words[q]
        if abs(len(one[0]) + len(two[0]) - len(want)) > 3:
            return False
        w = one[0] + two[0]
        f = fold(w)
        return f == self.folded[q] or alike(w, want, f, self.folded[q], one[2] + two[2] + self.lost[q])

    def goes_on(self, p: int, q: int, step: int) -> bool:
        """Whether after a gap the passage goes on for some words, or to its end."""
        g = self.page
        for k in range(1, AFTER_SKIP):
            i, j = p + k * step, q + k * step
            if not 0 <= j < len(self.words):
                return True
            if not 0 <= i < len(g.words):
                return False
            if not self.same(i, j):
                b = i + step  # it may be broken at the line's end
                return 0 <= b < len(g.words) and g.line[b] != g.line[i] and self.joined(*((i, b) if step > 0 else (b, i)), j)
        return True

    def follow(self, p: int, q: int, step: int) -> tuple[int, list[int]]:
        """(how many words of the item beyond q the page has beyond p, their places), forward (step 1) or backward (-1)."""
        g, began, path = self.page, q, []
        n, m, lines = len(g.words), len(self.words), len(g.starts) - 1
        head = (lambda k: g.starts[k]) if step > 0 else (lambda k: g.starts[k + 1] - 1)
        tail = (lambda k: g.starts[k + 1] - 1) if step > 0 else (lambda k: g.starts[k])
        while 0 <= q + step < m:
            want, nxt, here = q + step, p + step, g.line[p]
            if 0 <= nxt < n:
                if self.same(nxt, want):
                    p, q = nxt, want
                    path.append(p)
                    continue
                # Words of accented letters alone drop out of the item; without their accents the page has them.
                gap = abs(self.places[want] - self.places[q]) - 1
                if gap and 0 <= nxt + step < n and len(g.words[nxt][0]) < 3 and self.same(nxt + step, want):
                    p, q = nxt + step, want
                    path += [nxt, p]
                    continue
            found = None
            # A word broken at the line's end, its other part in the next line or after lines in between.
            if 0 <= nxt < n and nxt == tail(line := g.line[nxt]):
                for other in range(line + step, line + step * (SKIP_LINES + 2), step):
                    if not 0 <= other < lines:
                        break
                    b = head(other)
                    if self.joined(*((nxt, b) if step > 0 else (b, nxt)), want) and (abs(other - line) == 1 or self.goes_on(b, want, step)):
                        found = b
                        path += [nxt, b]
                        break
            # Whole lines in between: another column's, an advert's, a heading's.
            if found is None and p == tail(here):
                for other in range(here + 2 * step, here + step * (SKIP_LINES + 2), step):
                    if not 0 <= other < lines:
                        break
                    b = head(other)
                    if self.same(b, want) and self.goes_on(b, want, step):
                        found = b
                        path.append(b)
                        break
            if found is None:
                break
            p, q = found, want
        return abs(q - began), path


class _Batch:
    """Words of several pages, one after the other: keys, sketches, lines and pages of them."""

    def __init__(self, pages: list[Page]):
        words = [t for g in pages for t in g.words]
        self.keys, self.sketches = (np.array([t[i] for t in words], kind) for i, kind in ((1, np.uint64), (4, np.int64)))
        sizes = np.array([len(r) for g in pages for r in g.rows], int)
        ends = sizes.cumsum()
        # The first word of each line, and the last; the line and the page of each word.
        self.heads, self.tails, self.line = ends - sizes, ends - 1, np.repeat(np.arange(len(sizes)), sizes)
        self.page_of_line = np.repeat(np.arange(len(pages)), [len(g.rows) for g in pages])
        self.page = self.page_of_line[self.line]

    def beyond(self, line: np.ndarray, step: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(the words that lines from so many lines on begin with in that direction, whether there are such lines) for each line."""
        other = line[:, None] + step * np.arange(least, SKIP_LINES + 2)
        near = np.clip(other, 0, len(self.heads) - 1)
        return (self.heads if step > 0 else self.tails)[near], (near == other) & (self.page_of_line[near] == self.page_of_line[line][:, None])


def _near(letters: np.ndarray, length: np.ndarray, want: np.ndarray, lost: np.ndarray, slack: int) -> np.ndarray:
    """Whether a folded word of these letters may be within the edits that lost letters allow of the wanted one (a sketch)."""
    most = np.minimum(lost, 2)
    close = np.abs(length - (want >> 32 & 255)) <= most + slack
    return close & (np.bitwise_count(letters & ~want & _LETTERS) <= most) & (np.bitwise_count(want & ~letters & _LETTERS) <= most)


def _alike(words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether words that differ after folding may still be the same, by their sketches."""
    lost = (words >> 48) + (wanted >> 48)
    return (lost > 0) & _near(words, words >> 32 & 255, wanted, lost, 0)


def _goes_on(batch: _Batch, items: Items, b: np.ndarray, y: np.ndarray, last: np.ndarray, step: int) -> np.ndarray:
    """Whether ``goes_on`` may hold for words b of the pages as words y of the items, the last in that direction being ``last``."""
    on, undecided, ends = np.ones(len(b), bool), np.ones(len(b), bool), batch.tails if step > 0 else batch.heads
    for n in range(1, AFTER_SKIP):
        undecided &= (last - y) * step >= n
        i, j = np.clip(b + n * step, 0, len(batch.page) - 1), np.clip(y + n * step, 0, len(items.flat_keys) - 1)
        equal = batch.keys[i] == items.flat_keys[j]
        broken = ~equal & (i == ends[batch.line[i]])  # no word after a broken one is looked at
        on &= ~undecided | (batch.page[i] == batch.page[b]) & (equal | broken | _alike(batch.sketches[i], items.flat_sketches[j]))
        undecided &= ~broken
    return on


def _may_go_on(batch: _Batch, items: Items, x: np.ndarray, y: np.ndarray, last: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How ``follow`` may go on from words x of the pages, at words y of the items, though the next words' keys differ.

    The first: with the next words, if those have lost letters; the second: otherwise, where words dropped out of the item
    or past line ends. Sketches rule out most."""
    nxt, want = x + step, items.flat_sketches[y + step]
    word = batch.sketches[nxt]
    may = np.abs(items.flat_places[y + step] - items.flat_places[y]) > 1
    ends = batch.tails if step > 0 else batch.heads
    # The next word may be one part of a broken one, the other part in one of the next lines.
    r = np.flatnonzero(~may & (nxt == ends[batch.line[nxt]]))
    b, there = batch.beyond(batch.line[nxt[r]], step, 1)
    other, one, wanted = batch.sketches[b], word[r][:, None], want[r][:, None]
    length, lost = (one >> 40 & 255) + (other >> 40 & 255), (one >> 48) + (wanted >> 48) + (other >> 48)
    close = (np.abs(length - (wanted >> 40 & 255)) <= 3) & _near(one | other, (one >> 32 & 255) + (other >> 32 & 255), wanted, lost, 1)
    m, n = np.nonzero(there & (close | (length >= 255)))
    sure = (n == 0) | _goes_on(batch, items, b[m, n], y[r[m]] + step, last[r[m]], step)
    may[r[m[sure]]] = True
    # Or the passage goes on after lines in between.
    r = np.flatnonzero(~may & (x == ends[batch.line[x]]))
    b, there = batch.beyond(batch.line[x[r]], step, 2)
    m, n = np.nonzero(there & ((batch.keys[b] == items.flat_keys[y[r] + step][:, None]) | _alike(batch.sketches[b], want[r][:, None])))
    sure = _goes_on(batch, items, b[m, n], y[r[m]] + step, last[r[m]], step)
    may[r[m[sure]]] = True
    return _alike(word, want), may


def _hopeful(batch: _Batch, items: Items, p: np.ndarray, k: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
    """Whether a hit's passage may have so many words: what is left out is too short whatever ``follow`` finds.

    Equal words are counted in both directions; where they end for certain in both, their number decides."""
    may, first, ends = np.zeros(len(p), bool), items.first[k], []
    last = items.first[k + 1] - 1
    for step, at in ((1, GRAM - 1), (-1, 0)):
        here, there = p + at, first + q + at
        live = np.flatnonzero(~may)
        for _ in range(least - GRAM):
            x, y = here[live], there[live]
            inside = (y < last[live] if step > 0 else y > first[live]) & (batch.page[np.clip(x + step, 0, len(batch.page) - 1)] == batch.page[x])
            inside &= (x + step >= 0) & (x + step < len(batch.page))
            live, x, y = live[inside], x[inside], y[inside]
            goes = batch.keys[x + step] == items.flat_keys[y + step]
            differ = np.flatnonzero(~goes)
            goes[differ], may[live[differ]] = _may_go_on(batch, items, x[differ], y[differ], (last if step > 0 else first)[live[differ]], step)
            live = live[goes & ~may[live]]
            if not len(live):
                break
            here[live] += step
            there[live] += step
        ends.append(items.flat_places[there])
    return may | (ends[0] - ends[1] + 1 >= least)


def leaked(pages: list[Page], items: Items, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int, set[int]]]:
    """(page, item, first word, words in a row, the page's words) of each item of which a page has that many words in a row.

    The page's words are those of all such passages of the item."""
    sizes = np.array([len(g.words) for g in pages], np.int64)
    if not sizes.sum():
        return []
    begin, batch = np.cumsum(sizes) - sizes, _Batch(pages)
    of = batch.page
    p, k, q, few = items.hits(grams(batch.keys))
    one = of[p] == of[p + GRAM - 1]  # a window doesn't reach into the next page
    p, k, q, few = p[one], k[one], q[one], few[one]
    if not len(p):
        return []
    # A passage of so many words has several windows of its item close together, also with words broken at line ends, and
    # mostly one that few items have: that one is enough, of others LEAST_HITS are needed.
    wide = np.int64(1) << np.int64(30)
    pair = of[p] * len(items.ids) + k
    every = pair * wide + q
    by = np.argsort(every)
    new = np.r_[True, np.diff(every[by]) > 0]
    codes, rare = every[by][new], few[by][new].astype(int)
    dense = np.zeros(len(codes), bool)
    for size, least_rare in ((LEAST_HITS, 0), (1, 1)):
        n = len(codes) - size + 1
        if n <= 0:
            continue
        close = (codes[size - 1 :] - codes[:n] <= least - GRAM) & (sum(rare[i : n + i] for i in range(size)) >= least_rare)
        for i in range(size):
            dense[i : n + i] |= close
    if not dense.any():
        return []
    kept = np.sort(by[dense[new.cumsum() - 1]])
    if least > GRAM:
        parts = [kept[i : i + HITS] for i in range(0, len(kept), HITS)]
        kept = np.concatenate([x[_hopeful(batch, items, p[x], k[x], q[x], least)] for x in parts])
    if not len(kept):
        return []
    kept = kept[np.argsort(pair[kept], kind="stable")]
    pair, p, q = pair[kept], p[kept], q[kept]
    cuts = np.r_[np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]), len(pair)].tolist()
    out, laid = [], -1
    for i, j in zip(cuts, cuts[1:]):
        at, item = divmod(int(pair[i]), len(items.ids))
        page = pages[at]
        if at != laid:
            page.lay_out()
            laid = at
        trace, places, best, seen, covered = _Trace(page, items, item), items.places[item], (0, 0), set(), set()
        for a, b in zip((p[i:j] - begin[at]).tolist(), q[i:j].tolist()):
            if (a, b) in seen:
                continue
            after, ahead = trace.follow(a + GRAM - 1, b + GRAM - 1, 1)
            before, behind = trace.follow(a, b, -1)
            seen.update((a + x, b + x) for x in range(after + 1))
            first, last = b - before, b + GRAM - 1 + after
            length = places[last] - places[first] + 1
            best = max(best, (length, first))
            if length >= least:
                covered.update(ahead, behind, range(a, a + GRAM))
        if best[0] >= least:
            out.append((at, items.ids[item], best[1], best[0], covered))
    return out


def leaked_items(page: Page, items: Items, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(item, first word, words in a row) of the items that one page leaks."""
    return [x[1:4] for x in leaked([page], items, least)]


def _shards(items: DataFrame, item: str, item_text: str) -> list[DataFrame]:
    """The items (i, t; one row for each id) in as many parts as keep each near ITEM_WORDS words."""
    listed = items.select(F.col(item).alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").groupBy("i").agg(F.min("t").alias("t"))
    size = listed.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    n = -(-size // ITEM_WORDS) or 1
    return [listed] if n == 1 else [listed.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) for k in range(n)]


def _search(docs: DataFrame, listed: DataFrame, doc: str, text: str, lines: str | None, least: int, schema: str, rows_of) -> DataFrame:
    """Maps pages of documents to rows: rows_of(page, leaks of the page) gives the values after the document's id."""
    shared = docs.sparkSession.sparkContext.broadcast(Items(sorted((r.i, r.t) for r in listed.collect())))
    edge = lambda k: F.transform(lines, lambda b: b[k].cast("double")) if lines else F.lit(None).cast("array<double>")
    boxes = [edge(k).alias(k) for k in ("x0", "x1", "y0")]
    rows = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t"), *boxes).where("d is not null and t is not null")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        known = shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            flat, ends = [], []
            for k in (2, 3, 4):
                col = b.column(k)
                flat.append(col.flatten().fill_null(0.0).to_numpy(zero_copy_only=False))
                ends.append(np.r_[0, np.cumsum(np.asarray(col.value_lengths().fill_null(0)))])
            where, out = [], []
            for i in range(0, len(texts), PAGES):
                pages = [Page(texts[r], *(f[e[r] : e[r + 1]] for f, e in zip(flat, ends))) for r in range(i, min(i + PAGES, len(texts)))]
                by_page: dict[int, list] = {}
                for at, *leak in leaked(pages, known, least):
                    by_page.setdefault(at, []).append(leak)
                for at, leaks in by_page.items():
                    for row in rows_of(pages[at], leaks):
                        where.append(i + at)
                        out.append(row)
            cols = list(zip(*out)) or [()] * (len(arrow) - 1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int64())), *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:]))], names=arrow.names)

    return rows.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, doc: str, text: str, lines: str | None, item: str, item_text: str, least: int = LEAST_WORDS) -> DataFrame:
    """Columns: doc, item, first_word (of the item, from 0), n_words (in a row); one row per document and leaked item.

    ``lines`` is a column of boxes (structs with x0, x1, y0), the i-th for the i-th line of the text; where their number
    isn't that of the lines (or the column is None) lines are read in their order. Null and blank texts leak nothing;
    null ids are left out; repeated rows of a document give its leaks once. Items with null or short texts are never
    leaked; items of the same id count as one (the first by text). Items of more than ``ITEM_WORDS`` words are searched in parts, the documents once for each."""
    schema = f"d {dict(docs.dtypes)[doc]}, i {dict(items.dtypes)[item]}, a int, n int"
    parts = [_search(docs, part, doc, text, lines, least, schema, lambda page, leaks: [(i, a, n) for i, a, n, _ in leaks]) for part in _shards(items, item, item_text)]
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("d", "i").agg(F.max(F.struct("n", "a")).alias("x")).select(F.col("d").alias(doc), F.col("i").alias(item), F.col("x.a").alias("first_word"), F.col("x.n").alias("n_words"))


def remove_spans(docs: DataFrame, items: DataFrame, doc: str, text: str, lines: str | None, item: str, item_text: str, least: int = LEAST_WORDS) -> DataFrame:
    """doc, cleaned text (without the words of leaked passages), n_removed for each document row that leaks an item.

    Lines that had only such words are dropped. Arguments and cases are those of ``find_leaks``; repeated rows are kept."""
    shards = _shards(items, item, item_text)
    kind = dict(docs.dtypes)[doc]

    def rows_of(page, leaks):
        words = set().union(*(covered for *_, covered in leaks))
        return [(page.without(words), len(words))]

    if len(shards) == 1:
        return _search(docs, shards[0], doc, text, lines, least, f"d {kind}, cleaned string, n_removed int", rows_of).withColumnRenamed("d", doc)
    # Words to remove from each part of the items, put together by document and text; repeated rows stay rows.
    whole = lambda page, leaks: [(page.text, sorted(set().union(*(covered for *_, covered in leaks))))]
    found = reduce(DataFrame.unionByName, [_search(docs, part, doc, text, lines, least, f"d {kind}, t string, words array<int>", whole) for part in shards])
    words = found.groupBy("d", F.xxhash64("t").alias("h")).agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"))
    return _cut(docs, words, doc, text, lines).withColumnRenamed("d", doc)


def _cut(docs: DataFrame, words: DataFrame, doc: str, text: str, lines: str | None) -> DataFrame:
    """d, cleaned, n_removed of the documents named by d and h (hash of the text) in words."""
    edge = lambda k: F.transform(lines, lambda b: b[k].cast("double")) if lines else F.lit(None).cast("array<double>")
    rows = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t"), *[edge(k).alias(k) for k in ("x0", "x1", "y0")])
    rows = rows.withColumn("h", F.xxhash64("t")).join(words, ["d", "h"]).select("d", "t", "x0", "x1", "y0", "words")
    kind = dict(rows.dtypes)["d"]

    def run(batches):
        for b in batches:
            out = []
            for t, x0, x1, y0, words in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                boxes = [np.array([0.0 if v is None else v for v in x or []]) for x in (x0, x1, y0)]
                out.append(Page(t, *boxes).without(set(words)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array([len(w) for w in b.column(5).to_pylist()], pa.int32())], names=["d", "cleaned", "n_removed"])

    return rows.mapInArrow(run, f"d {kind}, cleaned string, n_removed int")


def remove_documents(docs: DataFrame, leaks: DataFrame, doc: str) -> DataFrame:
    """The documents without those that ``leaks`` names."""
    return docs.join(leaks.select(doc).distinct(), doc, "left_anti")
