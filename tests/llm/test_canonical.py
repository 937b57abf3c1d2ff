from tracelode.llm import canonical

REF = [(1, "label", "EEG F3-A2"), (2, "label", "EEG F4-A1"), (3, "label", "EOG left"), (4, "label", "EOG right"), (5, "label", "Temp skin"), (6, "label", "Temp rectal"), (7, "label", "SaO2 ear"), (8, "label", "Accel wrist X"), (9, "label", "Accel wrist Y"), (10, "label", "ECG lead I"), (11, "label", "ECG lead II"), (20, "kind", "Ag/AgCl cup electrode"), (21, "kind", "Gold disc electrode"), (22, "kind", None)]


def mapped(spark, values, field="label"):
    rows = spark.createDataFrame([(i, v, None, "x", 1) for i, v in enumerate(values)], "k bigint, label string, kind string, value string, ref_id int")
    if field == "kind":
        rows = rows.selectExpr("k", "kind as label", "label as kind", "value", "ref_id")
    ref = spark.createDataFrame(REF, "ref_id bigint, field_name string, name string")
    t = canonical
    out = t.map_values(rows, ref, ["k"], ["label", "kind"], synonyms={"label": t.SYNONYMS["label"], "kind": t.SYNONYMS["transducer"]}, phrases={"label": t.PHRASES["label"], "kind": t.PHRASES["transducer"]}, implied={"label": {"eeg", "lead"}}, joined={"kind": t.JOINED["transducer"]})
    assert out.columns == ["k", "field_name", "value", "ref_id", "score"]
    return {r.k: r.ref_id for r in out.collect()}


def test_labels(spark):
    values = ["F3A2", "e.e.g. f4 - a1", "08 EEG F3-A1", "lt E.O.G. [uV]", "R_EOG", "EOG vertical", "skin T. (degC)", "Temp ambient", "EAR SA02", "acc wrsit y /m/s2", "Accel wrist", "EKG Abl. II", "ecg i", "EOG left", "  ", None, "", "????", "EEG F3-A2 " + "z" * 5000]
    got = mapped(spark, values)
    assert got == {0: 1, 1: 2, 2: -1, 3: 3, 4: 4, 5: -1, 6: 5, 7: -1, 8: 7, 9: 9, 10: -1, 11: 11, 12: 10, 17: -1, 18: 1}


def test_transducers(spark):
    assert mapped(spark, ["AgAgCl cup el.", "AgAeCl cup electr", "std. Au disc Elektrode #14", "silver chloride cup electrode; values in uV", "gold cup electrode", "Strain gauge"], "kind") == {0: 20, 1: 20, 2: 21, 3: 20, 4: -1, 5: -1}


def test_ties_repeats_and_empty(spark):
    assert mapped(spark, ["eog LEFT", "eog LEFT"]) == {0: 3, 1: 3}
    rows = spark.createDataFrame([], "k bigint, label string")
    ref = spark.createDataFrame(REF, "ref_id bigint, field_name string, name string")
    assert canonical.map_values(rows, ref, ["k"], ["label"]).count() == 0
    one = spark.createDataFrame([(1, "eog. LEFT"), (1, "eog. LEFT")], "k bigint, label string")
    assert canonical.map_values(one, ref.limit(0), ["k"], ["label"]).collect()[0].ref_id == -1
    twice = spark.createDataFrame([(9, "label", "EOG left"), (3, "label", "EOG left")], "ref_id bigint, field_name string, name string")
    assert [r.ref_id for r in canonical.map_values(one, twice, ["k"], ["label"]).collect()] == [3]


def test_soft_tf_idf_decides(spark):
    """By the number of words found, each of these would be mapped; by weights and thresholds none is, and a missing implied word does no harm."""
    values = {0: "EOG vertical", 1: "EEG F3", 2: "Accel X", 3: "ECG", 4: "EEG F3-A2 wrist", 5: "F3-A2 new type 4", 6: "Temp ambient", 7: "EEG EOG left"}
    got = mapped(spark, list(values.values()))
    assert got == {0: -1, 1: -1, 2: -1, 3: -1, 4: -1, 5: 1, 6: -1, 7: -1}
    listed = [set(canonical.words(n, {})) for _, f, n in REF if f == "label"]
    assert all(max(len(set(canonical.words(values[k], {})) & ws) for ws in listed) for k in got)  # each shares words with some entry


def test_words_of_the_data_are_no_typos(spark):
    """A maker's name that the data have often isn't taken for the word it resembles; the word's own typing errors are."""
    ref = spark.createDataFrame([(1, "label", "Nasal flow"), (2, "label", "Nodal flow")], "ref_id bigint, field_name string, name string")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["flow, nasal"] * 5 + ["nadal flow"] * 40 + ["flow nasall"])], "k bigint, label string")
    got = {r.k: r.ref_id for r in canonical.map_values(rows, ref, ["k"], ["label"], synonyms={}, phrases={}, implied={}, joined={}).collect()}
    assert got[0] == 1 and got[45] == 1 and got[5] == -1


def test_long_reference_list(spark):
    """Postings hold the rare words only, whatever the list's length."""
    ref = spark.createDataFrame([(i, "label", f"common word serial{chr(97 + i % 26)}{i}") for i in range(12_000)], "ref_id bigint, field_name string, name string")
    rows = spark.createDataFrame([(i, f"SERIAL{chr(97 + i % 26)}{i} word. common") for i in range(0, 12_000, 997)], "k bigint, label string")
    got = {r.k: r.ref_id for r in canonical.map_values(rows, ref, ["k"], ["label"]).collect()}
    assert got == {i: i for i in range(0, 12_000, 997)}
    index = canonical.Index(ref, ["label"], {}, {}, {}, {})
    assert index.postings.where("word in ('common', 'word')").count() == 0 and index.postings.count() == 12_000
