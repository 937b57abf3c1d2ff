"""Freely typed values mapped to the entry of a reference list that they mean.

Token-level repair: the distinct tokens of all values are joined to the reference vocabulary (words of the
entries and their synonyms) by edit distance – equal, or one letter changed, dropped, added or swapped. Whether an
unknown token is a mistyped word or a word of its own is left to the data: a token that's rare, or not more than ``RATIO`` times as frequent
as the word in all its forms, may be that word; one that is also near a more frequent word of no entry (a maker, a note) may be just that.

Soft TF-IDF ranks complete entries. With idf from the reference list, an entry's score for a value is the cosine of
their words, where a repaired word counts a little less, a word that the others imply counts little, and a word of
other entries counts against the entry as heavily as the rarest word. Words that no entry has (numbering, makers, notes) have no
weight: the statement of the problem says that they don't matter. An entry fits if its score is above its own threshold, which is
learnt from the list: midway between the best score of a value that lacks one of its words or has one of another
entry's, and the score of one with all its words mistyped.

Candidates come from an inverted index by join. An entry is listed under its rarest words only, up to where the
others together can't reach the threshold, so no entry that fits is lost and frequent words list nothing.
Values are reduced to distinct ones before the shuffle, so a value may be as frequent as it likes; neither list is bounded.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.runs import _patterns
from tracelode.operators.hot import materialize
from tracelode.operators.units import unit_named

REPAIR_LEAST = 4
RARE, RATIO = 3, 2
TYPO, IMPLIED_WEIGHT = 0.25, 0.04

# Synonyms by word of an entry, for labels and for transducers of signals.
SYNONYMS = {
    "label": {
        "eog": "oculogram", "ecg": "ekg", "emg": "myogram", "lead": "abl ld ableitung", "left": "l lt le links", "right": "r rt ri re rechts",
        "chin": "mentum mental submental", "leg": "tib tibialis tibial", "resp": "respiration respiratory breathing breath", "nasal": "nose", "flow": "airflow",
        "thorax": "thor thx thoracic chest", "abdomen": "abd abdo abdominal belly", "sao2": "sa02 spo2 sp02 o2sat", "finger": "fing", "pulse": "puls",
        "temp": "t temperature", "rectal": "rect rectum", "skin": "dermal", "pressure": "press pres", "snore": "snoring", "sound": "audio mic microphone",
        "conductance": "cond conduct conductivity", "accel": "acc accelero acceleration accelerometer", "position": "pos", "wrist": "", "light": "", "switch": "",
    },
    "transducer": {
        "ag": "silver", "agcl": "chloride", "gold": "au", "electrode": "el elec electr elektrode elektrod", "thermistor": "ntc thermist", "pressure": "press pres",
        "piezo": "pzt", "effort": "eff", "inductive": "rip induct", "finger": "fing", "oximeter": "oxymeter oxim spo2 probe", "rectal": "rect rectum", "skin": "dermal",
        "thermocouple": "tcouple couple thermocpl", "microphone": "mic mike", "accelerometer": "acc accel accelero", "differential": "diff", "sensor": "sens transducer",
        "flow": "airflow", "cannula": "", "photodiode": "", "electrodermal": "",
    },
}
# Phrases and joined words written apart before words are looked up.
PHRASES = {"label": {"o2 sat": "sao2", "sat o2": "sao2"}, "transducer": {"t couple": "tcouple", "piezo electric": "piezo"}}
JOINED = {"label": {}, "transducer": {"agagcl": "ag agcl"}}
IMPLIED = {"label": {"eeg", "lead"}, "transducer": set()}
_TAIL = (
    re.compile(r"[\s_.]*[(\[]([^()\[\]]+(?:\([^()]*\))?)[)\]]\s*$"),
    re.compile(r"[,;]?[\s_.]*(?:values|output|units?)[\s_.]+(?:in[\s_.]+)?(\S.*)$", re.I),
    re.compile(r"[\s_.]+/\s?(/?\S.*)$"),
)


def words(value: str, phrases: dict[str, str]) -> list[str]:
    """Lower-case words of a value, without a unit that it ends in and without accents."""
    s = value
    for pattern in _TAIL:
        m = pattern.search(s)
        if m and unit_named(m[1]):
            s = s[: m.start()]
            break
    s = unicodedata.normalize("NFKD", s.lower().replace("_", " "))
    s = re.sub(r"\b([a-z])\.([a-z])\.([a-z])\b(?!\.[a-z]\b)\.?", r"\1\2\3 ", s)
    s = " ".join(re.findall(r"[^\W_]+", "".join(c for c in s if not unicodedata.combining(c))))
    for phrase, plain in phrases.items():
        s = re.sub(rf"\b{phrase}\b", plain, s)
    return s.split()


def _with_words(phrases: dict):
    def run(batches):
        for pdf in batches:
            yield pdf.assign(tokens=[sorted(set(words(v, phrases.get(f, {})))) for f, v in zip(pdf["field_name"], pdf["value"])])

    return run


def _pattern_rows(batches):
    for pdf in batches:
        out = [(f, w, p, plain) for f, w in zip(pdf["field_name"], pdf["word"]) for p, plain in _patterns(w)]
        yield pd.DataFrame(out, columns=["field_name", "word", "pattern", "plain"])


def _near(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """field_name, token, near: pairs of a token and a word of the lexicon that are one mistyped letter apart. Inputs: field_name, word."""
    schema = "field_name string, word string, pattern string, plain boolean"
    a = tokens.select("field_name", "word").mapInPandas(_pattern_rows, schema).alias("a")
    b = lexicon.select("field_name", "word").mapInPandas(_pattern_rows, schema).alias("b")
    both = a.join(b, (F.col("a.field_name") == F.col("b.field_name")) & (F.col("a.pattern") == F.col("b.pattern")))
    # Of a word and its shortened form only one may be shortened.
    apart = ~F.col("a.pattern").startswith("d") | (F.col("a.plain") != F.col("b.plain"))
    return both.where(apart & (F.col("a.word") != F.col("b.word"))).select("a.field_name", F.col("a.word").alias("token"), F.col("b.word").alias("near")).distinct()


def _similarity(token: Column, form: Column) -> Column:
    return F.when(token == form, 1.0).otherwise(1 - TYPO / F.greatest(F.length(token), F.length(form)))


class Index:
    """The reference list as tables: entries with weights and thresholds, forms of words, postings."""

    def __init__(self, reference: DataFrame, fields: list[str], synonyms: dict, phrases: dict, implied: dict, joined: dict):
        spark = reference.sparkSession
        named = reference.where("name is not null and ref_id is not null").where(F.col("field_name").isin(fields))
        named = named.groupBy("field_name", F.col("name").cast("string").alias("value")).agg(F.min("ref_id").alias("ref_id"))
        self.spelled = named.select("field_name", "value")
        listed = materialize(named.mapInPandas(_with_words(phrases), "field_name string, value string, ref_id bigint, tokens array<string>").where(F.size("tokens") > 0), "listed")
        # Entries with the same words are one: the first.
        entries = listed.groupBy("field_name", "tokens").agg(F.min("ref_id").alias("ref_id"))
        size = entries.groupBy("field_name").agg(F.count("*").alias("n"))
        slack = [(f, w) for f, ws in implied.items() for w in sorted(ws)]
        little = spark.createDataFrame(slack or [("", "")], "field_name string, word string").withColumn("factor", F.lit(IMPLIED_WEIGHT))
        df = entries.select("field_name", F.explode("tokens").alias("word")).groupBy("field_name", "word").agg(F.count("*").alias("df"))
        idf = F.pow(F.log1p(F.col("n") / F.col("df")), 2)
        weights = df.join(size, "field_name").join(little, ["field_name", "word"], "left")
        weights = weights.select("field_name", "word", (idf * F.coalesce("factor", F.lit(1.0))).alias("weight"), F.col("factor").isNotNull().alias("implied"), F.pow(F.log1p("n"), 2).alias("most"))
        weights = materialize(weights, "weights")
        parts = entries.select("field_name", "ref_id", F.explode("tokens").alias("word")).join(weights, ["field_name", "word"])
        typed = F.col("weight") * F.when(F.length("word") > REPAIR_LEAST, 1 - TYPO / F.length("word")).otherwise(1.0)
        own = parts.groupBy("field_name", "ref_id").agg(
            F.sort_array(F.collect_list(F.struct("weight", "word")), asc=False).alias("words"), F.sum("weight").alias("whole"), F.sum(F.when(F.col("implied"), 0.0).otherwise(typed)).alias("typed"),
            F.sum(F.when(~F.col("implied"), F.col("weight"))).alias("core"), F.min(F.when(~F.col("implied"), F.col("weight"))).alias("least"), F.first("most").alias("most"),
        )
        core = F.coalesce("core", "whole")
        lacking = F.sqrt(F.greatest(1 - F.coalesce("least", "whole") / F.col("whole"), F.lit(0.0)))
        foreign = F.sqrt(F.col("whole") / (F.col("whole") + F.col("most")))
        wrong, right = F.greatest(lacking, foreign), F.coalesce("typed", "whole") / F.sqrt(F.col("whole") * core)
        threshold = F.when(wrong < right, (wrong + right) / 2).otherwise((wrong + 1) / 2)
        named = F.transform("words", lambda x: x["word"]).alias("named")
        self.entries = materialize(own.select("field_name", "ref_id", "words", named, "whole", threshold.alias("threshold")), "entries")
        # Rarest words first, until the rest can't reach the threshold: at least one of these must be in a value that fits.
        before = F.transform("words", lambda x, i: F.struct(x["word"].alias("word"), F.aggregate(F.slice("words", 1, i), F.lit(0.0), lambda t, y: t + y["weight"]).alias("gone")))
        enough = F.pow(F.col("threshold"), 2) * F.col("whole")
        self.postings = self.entries.select("field_name", "ref_id", F.explode(F.filter(before, lambda x: F.col("whole") - x["gone"] >= enough * (1 - 1e-9))).alias("x")).select("field_name", "ref_id", "x.word")
        self.weights = weights.select("field_name", "word", "most")
        # Forms: the words themselves, synonyms of words that entries have, and joined words.
        vocabulary = weights.select("field_name", "word", F.col("word").alias("form"))
        told = [(f, w, o) for f, t in synonyms.items() for w, others in t.items() for o in others.split()]
        more = spark.createDataFrame(told or [("", "", "")], "field_name string, word string, form string").join(weights.select("field_name", "word"), ["field_name", "word"])
        more = more.join(vocabulary.select("field_name", "form"), ["field_name", "form"], "left_anti").select("field_name", "word", "form")
        apart = [(f, j, w) for f, t in joined.items() for j, ws in t.items() for w in ws.split()]
        apart = spark.createDataFrame(apart or [("", "", "")], "field_name string, form string, word string").join(weights.select("field_name", "word"), ["field_name", "word"]).select("field_name", "word", "form")
        forms = vocabulary.unionByName(more).unionByName(apart)
        self.forms = materialize(forms.groupBy("field_name", "form").agg(F.sort_array(F.collect_set("word")).alias("words")), "forms")


def resolve(tokens: DataFrame, index: Index) -> DataFrame:
    """field_name, token, options (array of (words, sim)), note: what each token may be. Input: field_name, token, n (rows that have it).

    A token with several words in an option stands for all of them; ``note`` tells that it may be a word of no entry."""
    forms = index.forms
    exact = tokens.join(forms, (tokens.field_name == forms.field_name) & (tokens.token == forms.form)).select(tokens.field_name, "token", F.array(F.struct("words", F.lit(1.0).alias("sim"))).alias("options"), F.lit(False).alias("note"))
    rest = tokens.join(exact.select("field_name", "token"), ["field_name", "token"], "left_anti").where(~F.col("token").rlike("^[0-9]+$"))
    # Two words written as one, both spelled exactly.
    longest = forms.agg(F.max(F.length("form"))).first()[0] or 0
    mixed = rest.where(F.length("token").between(4, 2 * longest) & (F.col("token").rlike("[0-9]") | (F.length("token") == 4)))
    cuts = mixed.select("field_name", "token", F.explode(F.sequence(F.lit(2), F.length("token") - 2)).alias("i"))
    cuts = cuts.withColumns({"a": F.expr("left(token, i)"), "b": F.expr("substr(token, i + 1)")})
    f1, f2 = forms.select("field_name", F.col("form").alias("a"), F.col("words").alias("wa")), forms.select("field_name", F.col("form").alias("b"), F.col("words").alias("wb"))
    both = cuts.join(f1, ["field_name", "a"]).join(f2, ["field_name", "b"]).groupBy("field_name", "token").agg(F.min_by(F.concat("wa", "wb"), "i").alias("words"))
    both = both.select("field_name", "token", F.array(F.struct("words", F.lit(1.0).alias("sim"))).alias("options"), F.lit(False).alias("note"))
    rest = rest.join(both.select("field_name", "token"), ["field_name", "token"], "left_anti").where(f"length(token) >= {REPAIR_LEAST}").withColumnRenamed("token", "word")
    # The lexicon: forms, and words of the data that no entry has.
    counts = tokens.select("field_name", F.col("token").alias("word"), "n")
    own = forms.select("field_name", "words", F.col("form").alias("word")).join(counts, ["field_name", "word"], "left")
    own = own.withColumn("m", F.coalesce(F.sum("n").over(Window.partitionBy("field_name", "words")), F.lit(0))).select("field_name", "word", "m", F.lit(True).alias("form"))
    other = rest.where(F.col("n") > RARE).select("field_name", "word", F.col("n").alias("m"), F.lit(False).alias("form"))
    lexicon = materialize(own.unionByName(other).where(f"length(word) > {REPAIR_LEAST}"), "lexicon")
    near = _near(rest, lexicon).join(lexicon.withColumnRenamed("word", "near"), ["field_name", "near"]).join(rest.select("field_name", F.col("word").alias("token"), "n"), ["field_name", "token"])
    likely = F.when(F.col("form"), (F.col("n") <= RARE) | (RATIO * F.col("m") >= F.col("n"))).otherwise(F.col("m") >= RATIO * F.col("n"))
    near = near.where(likely).join(forms.select("field_name", F.col("form").alias("near"), "words"), ["field_name", "near"], "left")
    option = F.when(F.col("form"), F.struct("words", _similarity(F.col("token"), F.col("near")).alias("sim")))
    mended = near.groupBy("field_name", "token").agg(F.sort_array(F.collect_set(option)).alias("options"), F.max(~F.col("form")).alias("note")).where(F.size("options") > 0)
    return exact.unionByName(both).unionByName(mended)


def score(candidates: DataFrame) -> DataFrame:
    """Adds ``score``: soft TF-IDF of bag (array of (options, note)), whose words are ``meant`` (array of (word, sim)), and entry (words,
    ``named`` without their weights, whole); ``most`` is the weight of a foreign word."""
    # A word that several tokens may be counts once, with the closest.
    best = F.transform("words", lambda x: F.struct(x["weight"].alias("weight"), F.coalesce(F.array_max(F.transform(F.filter("meant", lambda m: m["word"] == x["word"]), lambda m: m["sim"])), F.lit(0.0)).alias("sim")))
    astray = lambda t: ~t["note"] & ~F.exists(t["options"], lambda o: F.forall(o["words"], lambda w: F.array_contains(F.col("named"), w)))
    total = lambda f: F.aggregate("best", F.lit(0.0), lambda t, x: t + f(x))
    found, had = total(lambda x: x["weight"] * x["sim"]), total(lambda x: F.when(x["sim"] > 0, x["weight"]).otherwise(0.0))
    foreign = F.size(F.filter("bag", astray)) * F.col("most")
    return candidates.withColumn("best", best).withColumn("score", found / F.sqrt(F.col("whole") * (had + foreign))).drop("best")


def _meant() -> Column:
    return F.flatten(F.transform("bag", lambda t: F.flatten(F.transform(t["options"], lambda o: F.transform(o["words"], lambda w: F.struct(w.alias("word"), o["sim"].alias("sim")))))))


def map_values(rows: DataFrame, reference: DataFrame, key: list[str], fields: list[str], synonyms=None, phrases=None, implied=None, joined=None) -> DataFrame:
    """Columns: key columns, field_name, value, ref_id (-1: no entry fits), score; one row per distinct (key, field, value).

    Values that are null, blank or spelled exactly like an entry of their field give no row. ``reference`` has ref_id,
    field_name, name (null names are ignored; of names with the same words the smallest id counts) and may have any size. Ties in
    score go to the smallest ref_id. Other columns are ignored; very long values are read whole. ``synonyms``, ``phrases``,
    ``implied`` and ``joined`` are word lists by field, of the recordings' channels by default. Runs jobs: the distinct values and
    tables of the reference list are written once to the shared folder."""
    index = Index(reference, fields, synonyms or SYNONYMS, phrases or PHRASES, implied or IMPLIED, joined or JOINED)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    every = rows.select(*key, pairs).select(*key, "p.field_name", "p.value").where(F.col("value").rlike(r"\S"))
    spelled = index.spelled.withColumn("exact", F.lit(True))
    distinct = every.groupBy("field_name", "value").agg(F.count("*").alias("n")).join(spelled, ["field_name", "value"], "left").withColumn("exact", F.col("exact").isNotNull())
    values = materialize(distinct.mapInPandas(_with_words(phrases or PHRASES), "field_name string, value string, n bigint, exact boolean, tokens array<string>"), "values")

    tokens = materialize(values.select("field_name", "n", F.explode("tokens").alias("token")).groupBy("field_name", "token").agg(F.sum("n").alias("n")), "tokens")
    known = materialize(resolve(tokens, index), "repaired")
    values = values.where("not exact")
    # Of a value's tokens only those that may be words of entries.
    held = values.select("field_name", "value", F.explode("tokens").alias("token")).join(known, ["field_name", "token"])
    bags = held.groupBy("field_name", "value").agg(F.sort_array(F.collect_list(F.struct("options", "note"))).alias("bag")).withColumn("meant", _meant())
    word = F.explode(F.array_distinct(F.flatten(F.transform("options", lambda o: o["words"])))).alias("word")
    candidates = held.select("field_name", "value", word).join(index.postings, ["field_name", "word"]).select("field_name", "value", "ref_id").distinct()
    most = index.weights.groupBy("field_name").agg(F.max("most").alias("most"))
    scored = score(candidates.join(bags, ["field_name", "value"]).join(index.entries, ["field_name", "ref_id"]).join(most, "field_name")).where("score >= threshold")
    top = F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("ref_id")).alias("r"))).alias("x")
    ranked = scored.groupBy("field_name", "value").agg(top).select("field_name", "value", (-F.col("x.r")).alias("ref_id"), F.col("x.s").alias("score"))
    free = values.select("field_name", "value").join(ranked, ["field_name", "value"], "left").select("field_name", "value", F.coalesce("ref_id", F.lit(-1)).cast("bigint").alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return every.join(free, ["field_name", "value"]).select(*key, "field_name", "value", "ref_id", "score").dropDuplicates()
