import random

import numpy as np

from tracelode.llm import leakage as L

BOX = "array<struct<x0 int, y0 int, x1 int, y1 int>>"
ITEM = "The quarry near Baraholt was restored on Monday by Captain Elspet Dorwick and 2479 harbours were closed in the spring at Fenorton before the lantern burned again"


def found(spark, texts, item=ITEM, boxes=None, **kw):
    docs = spark.createDataFrame([(i, t, boxes[i] if boxes else None, "x") for i, t in enumerate(texts)], f"d bigint, t string, b {BOX}, item string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, item)], "i bigint, text string")
    out = L.find_leaks(docs, items, "d", "t", "b", "i", "text", **kw)
    assert out.columns == ["d", "i", "first_word", "n_words"]
    return {(r.d, r.i): r.n_words for r in out.collect()}


def wrap(words, n):
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_lengths(spark):
    w = ITEM.split()
    pre, post = "some other words before it".split(), "and quite different ones after".split()
    texts = [" ".join(pre + w[3 : 3 + n] + post) for n in (11, 12, 13, 20)] + [" ".join(w[:6] + ["really"] + w[6:12] + ["also"] + w[12:18]), "", None, "   ", ITEM, ITEM]
    got = found(spark, texts)
    assert got == {(1, 7): 12, (2, 7): 13, (3, 7): 20, (8, 7): len(w), (9, 7): len(w)}


def test_dirt(spark):
    w = ITEM.split()
    plain = wrap(w[2:22], 5)
    hyphen = "near Bara-\nholt was rest¬\nored on Mon\xad\nday by Captain Elspet Dor‐\nwick and 2479 harbours were closed in"
    misread = "noar 8araholt wos restorod on Monday hy Copfain Elspet Donwick and 2479 harbours wene closed in"
    advert = "near Baraholt was restored on\nSOAP! Best of all\n* * *\nMonday by Captain Elspet Dorwick\nGITTA & CO\nand 2479 harbours were closed in"
    broken_advert = "near Baraholt was restored on Mon-\nSOAP! Best of all\nday by Captain Elspet Dorwick and 2479 harbours were closed in"
    specks = "near Bara*holt | was re.stored on Mon'day by Captain · Elspet Dorwick and 2479 harbours were closed in"
    got = found(spark, [plain, hyphen, misread, advert, broken_advert, specks])
    assert {d for d, _ in got} == set(range(6)) and all(n >= 16 for n in got.values())


def test_wrong_decoding(spark):
    item = "Die städtische Mühle bei Cedilnell wurde von Corin Fenelmond am 925. Tage völlig überschwemmt und später für die große Brücke verkauft"
    garbled = item.encode().decode("cp1252")
    assert set(found(spark, [garbled, item], item)) == {(0, 7), (1, 7)}


def test_columns(spark):
    w = ITEM.split()
    left = [" ".join(w[i : i + 4]) for i in range(0, 20, 4)]
    right = ["other words in the", "column on the right", "that have no bearing", "upon it at all", "and end here now"]
    lines, boxes = [], []
    for k, (a, b) in enumerate(zip(left, right)):
        lines += [a, b]
        boxes += [(100 + k % 2 * 3, 50 + 30 * k, 400, 70 + 30 * k), (600, 52 + 30 * k, 900, 72 + 30 * k)]
    assert set(found(spark, ["\n".join(lines)], boxes=[boxes])) == {(0, 7)}
    assert L.reading_order(np.array([600, 100, 603, 98]), np.array([900, 400, 900, 400]), np.array([10, 12, 40, 41])).tolist() == [1, 3, 0, 2]


def test_empty(spark):
    docs = spark.createDataFrame([], f"d bigint, t string, b {BOX}")
    items = spark.createDataFrame([(7, ITEM)], "i bigint, text string")
    assert L.find_leaks(docs, items, "d", "t", None, "i", "text").count() == 0
    assert L.find_leaks(spark.createDataFrame([(1, ITEM, None)], f"d bigint, t string, b {BOX}"), items.limit(0), "d", "t", "b", "i", "text").count() == 0


def test_parts_of_items_agree(spark, monkeypatch):
    """Items beyond the limit are searched in parts, with the same result."""
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in "kdgpx" for b in ("ar", "ol", "im", "et") for c in ("bag", "dik", "pox")]
    rows = [(i, " ".join(rnd.choices(words, k=30))) for i in range(12)]
    texts = [(d, " ".join(rnd.choices(words, k=8) + rows[d % 12][1].split()[5:20] + rnd.choices(words, k=5) + rows[(d + 5) % 12][1].split()[2:18] + rnd.choices(words, k=8)), None) for d in range(20)]
    docs, items = spark.createDataFrame(texts + texts[:2], f"d bigint, t string, b {BOX}"), spark.createDataFrame(rows, "i bigint, text string")
    args = (docs, items, "d", "t", "b", "i", "text")
    whole, cleaned = sorted(map(tuple, L.find_leaks(*args).collect())), sorted(map(tuple, L.remove_spans(*args).collect()))
    assert len(whole) == 40 and len(cleaned) == 22
    monkeypatch.setattr(L, "ITEM_WORDS", 100)
    assert len(L._shards(items, "i", "text")) == 4
    assert sorted(map(tuple, L.find_leaks(*args).collect())) == whole and sorted(map(tuple, L.remove_spans(*args).collect())) == cleaned


def test_one_whole_window_is_enough():
    """Twelve words in a row of which line ends break four: one window that few items have leads to the passage."""
    w = ITEM.split()[:12]
    item = " ".join(w)
    text = "some words before " + " ".join(x if k not in (1, 3, 8, 10) or len(x) < 4 else x[:2] + "-\n" + x[2:] for k, x in enumerate(w)) + " and after"
    page = L.Page(text, np.zeros(0), np.zeros(0), np.zeros(0))
    assert [(i, n) for i, _, n in L.leaked_items(page, L.Items([(7, item)]))] == [(7, 12)]


def test_against_brute_force():
    """Clean texts: the longest common run of words decides."""
    rnd = random.Random(11)
    words = [f"{a}{b}{c}" for a in "kdgpx" for b in ("ar", "ol", "im", "et") for c in ("bag", "dik", "pox")]
    items = [(i, " ".join(rnd.choices(words, k=40))) for i in range(12)]
    known = L.Items(items)
    for _ in range(60):
        i, text = rnd.choice(items)
        w, a, n = text.split(), rnd.randrange(20), rnd.randrange(4, 20)
        doc = rnd.choices(words, k=15) + w[a : a + n] + rnd.choices(words, k=15)
        page = L.Page(" ".join(doc), np.zeros(0), np.zeros(0), np.zeros(0))
        got = {x[0] for x in L.leaked_items(page, known)}

        def longest(u, v):
            best, row = 0, [0] * (len(v) + 1)
            for x in u:
                row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(v)]
                best = max(best, max(row))
            return best

        sure = {j for j, t in items if longest(doc, t.split()) >= 12}
        assert sure <= got and all(longest(doc, dict(items)[j].split()) >= 9 for j in got)


def test_removal(spark):
    w = ITEM.split()
    text = "Other words stand before it\n" + wrap(w[2:22], 5) + " and more\nGITTA & CO"
    docs = spark.createDataFrame([(1, text, None), (2, "clean", None), (3, None, None)], f"d bigint, t string, b {BOX}")
    items = spark.createDataFrame([(7, ITEM)], "i bigint, text string")
    got = L.remove_spans(docs, items, "d", "t", "b", "i", "text").collect()
    assert [(r.d, r.cleaned, r.n_removed) for r in got] == [(1, "Other words stand before it\nand more\nGITTA & CO", 20)]
    kept = L.remove_documents(docs, L.find_leaks(docs, items, "d", "t", "b", "i", "text"), "d")
    assert sorted(r.d for r in kept.collect()) == [2, 3] and kept.columns == ["d", "t", "b"]
    broken = spark.createDataFrame([(1, "near Bara-\nholt was restored on Monday by Captain Elspet Dorwick and 2479 harbours x", None)], f"d bigint, t string, b {BOX}")
    assert L.remove_spans(broken, items, "d", "t", "b", "i", "text").first().cleaned == "x"


def test_hits_that_go_nowhere_are_not_followed(monkeypatch):
    """Pieces of three and six words, too short whatever stands around them, are left out before any is followed."""
    w = ITEM.split()
    items, blank = L.Items([(7, ITEM)]), np.zeros(0)
    calls, follow = [], L._Trace.follow
    monkeypatch.setattr(L._Trace, "follow", lambda *a: calls.append(a) or follow(*a))
    pieces = [w[a : a + n] for a in range(0, 18, 3) for n in (3, 6)]
    text = "\n".join(" ".join(["quite", "another", *p, "thing", "entirely"]) for p in pieces)
    assert L.leaked([L.Page(text, blank, blank, blank)], items) == [] and not calls
    assert len(L.leaked([L.Page(ITEM, blank, blank, blank)], items)) == 1 and calls


def test_no_hit_left(spark):
    """The only window of an item stands inside a line, among other words."""
    assert found(spark, ["these words are harbours were closed others than those"]) == {}


def test_leaving_hits_out_loses_nothing(monkeypatch):
    """Damaged passages: the same leaks and words as with every hit followed."""
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("mu", "ör", "fa", "tn") for b in ("rne", "ül", "ca", "s1")] + ["é", "1872"]
    pages, rows = [], [(i, " ".join(rnd.choices(words, k=30))) for i in range(6)]
    filler = lambda: "".join(" ".join(rnd.choices(words, k=3)) + "\n" for _ in range(rnd.choice((0, 1, 8))))
    for _ in range(150):
        a, out = rnd.randrange(18), []
        for x in rnd.choice(rows)[1].split()[a : a + rnd.randrange(6, 20)]:
            damaged = [x[:1] + "-\n" + filler() + x[1:], "\n" + filler() + x, x.encode().decode("cp1252"), "é" + x[1:], x + " ·", rnd.choice(words)]
            out.append(rnd.choice(damaged) if rnd.random() < 0.25 else x)
        pages.append(" ".join(rnd.choices(words, k=5) + out + rnd.choices(words, k=5)))

    def leaks():
        return L.leaked([L.Page(t, np.zeros(0), np.zeros(0), np.zeros(0)) for t in pages], L.Items(rows))

    got, left_out, hopeful = leaks(), [], L._hopeful

    def every(*args):
        left_out.append((~hopeful(*args)).sum())
        return np.ones(len(args[2]), bool)

    monkeypatch.setattr(L, "HITS", 50)
    assert leaks() == got
    monkeypatch.setattr(L, "_hopeful", every)
    monkeypatch.setattr(L, "HITS", 1 << 17)
    assert leaks() == got and len(got) > 40 and left_out[0] > 100
