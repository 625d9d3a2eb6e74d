from arbolith.llm import lookalikes, sight


def test_uniform_forms():
    assert lookalikes.uniform("Ａｂ　ﬂ​ó x²") == "Ab fló x²"
    assert lookalikes.readings("Νeo") == (True, ("Neo",))
    assert lookalikes.readings("пoле") == (True, ("поле",))
    assert lookalikes.readings("μm") == (True, ())
    assert lookalikes.latin_twin("сора") == "copa" and lookalikes.latin_twin("cора") == "cора" and lookalikes.keyed("5 μm") == "5 μm"
    assert lookalikes.foreign_words("cа\u0301sa x") == {"cа\u0301sa"} and lookalikes.readings("cа\u0301sa")[1][0] == "cása"


SAME = [
    ["Seven sheets, from Aland.", "Seven sheets, from Aland.", "Sеven sheets, frοm Аland.", "Ｓeven she­ets, from Aland."],
    ["Род красный сок", "Pод кpаcный cok".replace("k", "к")],
    ["café 5.5 µm", "café 5.5 μm"],
    ["no word of this stаnds elsewhere", "no wоrd of this stands elsеwhere"],
]
OTHER = ["Seven sheets, from aland.", "Seven sheets. from Aland.", "cafe 5.5 µm", "café 5.6 µm", "Seven\nsheets, from Aland.", "", " ", "​", "Seven sheet, from Aland.", "x²", "x2"]


def test_pairs_and_traps(spark):
    rows, want = [], set()
    for group in SAME:
        ids = []
        for text in group:
            ids.append(len(rows))
            rows.append((len(rows), text, "k"))
        want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(len(rows) + k, t, "k") for k, t in enumerate(OTHER)] + [(900, None, "k")]
    copies = [(1000 + k, SAME[2][0], "k") for k in range(40)]
    want |= {(SAME_ID, c[0]) for c in copies for SAME_ID in [7]}
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, key string")
    got = [tuple(r) for r in sight.identical_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    done = {r["id"]: r["form"] for r in sight.repaired(df, "doc_id", "text", True).collect()}
    assert done[1] == done[2] == done[3] == SAME[0][0] and 900 not in done
    assert sight.identical_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_a_word_outside_the_vocabulary_stays(spark):
    df = spark.createDataFrame([(1, "odе x"), (2, "wоrd"), (3, "word")], "doc_id long, text string")
    done = {r["id"]: r["form"] for r in sight.repaired(df, "doc_id", "text", True).collect()}
    assert done == {1: "odе x", 2: "word", 3: "word"}


def test_the_vocabulary_is_that_of_uniform_forms(spark):
    rows = [(1, "rаregenus x"), (2, "Ｒare ｒａｒｅｇｅｎｕｓ"), (3, "thоu"), (4, "thou\u200bght"), (5, "twоfold"), (6, "twofоld"), (7, "cа\u0301sa"), (8, "ca\u0301sa y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = {r["id"]: r["form"] for r in sight.repaired(df, "doc_id", "text", True).collect()}
    assert done == {1: "raregenus x", 2: "Rare raregenus", 3: "thоu", 4: "thought", 5: "twofold", 6: "twofold", 7: "cása", 8: "cása y"}


def test_pairs_come_by_the_repair(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a wоrd here"), (2, "a word here"), (3, "a wоrd herе")], "doc_id long, text string")
    assert {tuple(r) for r in sight.identical_pairs(df, "doc_id", "text").collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in sight.identical_classes(df.union(df.where("doc_id = 2").selectExpr("9L", "text")), "doc_id", "text").collect()} == {(1, 1, 3), (2, 1, 2), (3, 1, 3), (9, 1, 2)}
    monkeypatch.setattr(sight, "word_repairs", lambda df, text, forms: forms.select(sight.F.lit("").alias("word"), sight.F.lit("").alias("repaired")).limit(0))
    assert sight.identical_pairs(df, "doc_id", "text").count() == 0
