import numpy as np
import pytest

from tracelode.llm import mojibake as M

DE = "Die kühle Mühle bei Froithholt wurde für die große Brücke geführt. „Wir hören“, schrieb Runa, „daß die Händler völlig müde sind.“ Später wurden 935 Gemälde in Fenaholm geprüft."
FR = "La forêt célèbre fut achetée par Elspet après l’été. Où était la fenêtre ? À Broilmere, répond M. Quinon, déjà très fâché. La pêcheuse préférait la chaîne."
PL = "W mieście sprzedano wąski młyn, o czym pisał Faro. Już 198 dni trwa spór o źródło, którą zamknięto. Łącznie przyjęto 12 sztuk, choć kościół był święty i żółty."
RU = "Говорят, что пароход был построен вчера. В уезде важный урожай отложен, сообщает наш читатель."
EN = "Mr. Runa’s café, valued at £1653, drew visitors. “Nothing,” replied Liora, “has delayed the fête.” The wheat was sold — a great price."
TEXTS = [(t, g) for t, g in ((DE, "de"), (FR, "fr"), (PL, "pl"), (RU, "ru"), (EN, "en")) for _ in range(60)]

WRONG = [
    (DE.encode().decode("cp1252"), DE, "de"), (FR.encode().decode("mac_roman"), FR, "fr"), (FR.encode("cp1252").decode("mac_roman"), FR, "fr"), (RU.encode("cp1251").decode("latin-1"), RU, "ru"),
    (RU.encode("cp866").decode("cp1251"), RU, "ru"), (PL.encode("iso8859-2").decode("latin-1"), PL, "pl"), (DE.replace("Mühle", "MÃ¼hle"), DE, "de"), (EN.encode().decode("cp437"), EN, "en"),
    (EN.replace("’", "â€™"), EN, "en"), (RU.replace("читатель", "\n" + "читатель".encode("cp1251").decode("cp1252")), RU.replace("читатель", "\nчитатель"), "ru"), (EN.replace("é", "é".encode().decode("latin-1").encode().decode("latin-1")), EN, "en"),
]


@pytest.fixture(scope="module")
def out(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate(TEXTS)] + [(1000 + i, bad, g) for i, (bad, _, g) in enumerate(WRONG)]
    rows += [(2000, "caf� of Mr", "en"), (2001, None, "en"), (2002, "", None), (2003, "  ", "en"), (2004, "plain", "en"), (2005, "a \x93quoted\x94 word", "en"), (2006, DE.replace("Händler", "Han·dler"), "de"), (2007, "ﬁne ﻿ﬂood ½ Nº 5", "en"), (2008, None, None), (None, "lost � too", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, text string, lang string, key string")
    fixed = M.repair(df.unionByName(df.where("id = 2000")), "id", "text", "lang")
    assert fixed.columns == ["id", "restored"]
    return fixed.collect()


def test_found(out):
    ids = sorted(r.id for r in out if r.id is not None)
    assert ids == [*range(1000, 1000 + len(WRONG)), 2000, 2000, 2005] and sum(r.id is None for r in out) == 1


def test_restored(out):
    got = {r.id: r.restored for r in out}
    for i, (_, right, _) in enumerate(WRONG):
        assert got[1000 + i] == right, i
    assert got[2000] == "caf� of Mr"


def test_empty(spark):
    assert M.repair(spark.createDataFrame([], "id bigint, text string"), "id", "text").count() == 0


def test_bytes_round_trip():
    for wrong in M.WRONG:
        table = M.byte_of(wrong)
        assert len(set(table.values())) == len(table) and all(0 <= b < 256 for b in table.values())
        for text in ("é", "“ß”", "żółty"):
            garbled = "".join(next(c for c, b in table.items() if b == x) for x in text.encode() if x > 127)
            if garbled:
                assert M.restore(garbled, wrong, "utf-8") == "".join(c for c in text if ord(c) > 127)
    assert M.restore("éa", "cp1252", "utf-8") is None


def test_segments_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        w = rng.integers(-4, 5, size=rng.integers(1, 12)).astype(float)
        got = M.segments(w)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
        best = max((w[i:j].sum() for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=0.0)
        assert max((w[i:j].sum() for i, j in got), default=0.0) == max(best, 0.0)
        assert all(w[i:k].sum() > 0 and w[k:j].sum() > 0 for i, j in got for k in range(i + 1, j)) and {k for k in range(len(w)) if w[k] > 0} <= {k for i, j in got for k in range(i, j)}


def test_segments_decide(spark, monkeypatch):
    """A notation that the corpus has often is proper, even if an inverse mapping would make it likelier; the runs leave it out."""
    notes = ["See Â§ 5 of the act." if i % 10 else "See § 5 of the act." for i in range(60)] + ["See § 5 and § 6 and § 7 and § 8 and § 9 of the act."] * 400
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(notes)], "id bigint, text string, lang string")
    model = M.corpus_model(df, "text", "lang")
    assert M.examine(notes[1], model, "en")[0]  # fifty of them among thousands of signs: still improbable
    often = spark.createDataFrame([(i, t, "en") for i, t in enumerate(notes[:60] * 8 + notes[60:200] + [RU] * 40)], "id bigint, text string, lang string")
    model = M.corpus_model(often, "text", "lang")
    assert not M.examine(notes[1], model, "en")[0]
    monkeypatch.setattr(M.Model, "runs", lambda self, before, stretch, after, salt: [(0, len(stretch))])
    assert M.examine(notes[1], model, "en")[0]


def test_rare_counts_are_left_out_alike(spark, monkeypatch):
    monkeypatch.setattr(M, "FLOOR", 2.0**-8)
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(TEXTS)], "id bigint, text string, lang string")
    assert all(len(t.keys) <= 2**8 for t in M.corpus_model(df, "text", "lang").tables)
