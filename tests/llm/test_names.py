import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbolith.llm import names

LIST = [
    ("Biscomium", 1, "Fungi", True), ("Biscomium storthomum", 2, "Fungi", True), ("Biscomium chaverifer", 3, "Fungi", True),
    ("Rhumflaster", 4, "Animals", True), ("Rhumflaster phircaes", 5, "Animals", True), ("Twicenamed", 6, "Animals", True),
    ("Twicenamed", 7, "Bacteria", True), ("Glypholia taexensis", 2, "Fungi", False), ("Glypholia", 8, "Bacteria", True),
]
TYPED = {
    "Biscomium storthomum": 2, "biscomium STORTHOMUM": 2, " Biscomium  storthomum": 2, "Biscomiun storthomum": 2, "Bicsomium storthomum": 2,
    "Biscomium_storthomum": 2, "storthomum Biscomium": 2, "storthomum, Biscomium": 2, "B. storthomum": 2, "B storthomum": 2, "Biscomium storth.": 2,
    "Biscomium storthomum (Linde, 1848)": 2, "Biscomium storthomum Linde, 1848": 2, "Biscomium cf. storthomum": 2, "Biscomium × storthomum": 2,
    "Biscomium storthomum s.l.": 2, "Biscomium storthomum sensu lato": 2, "Biscomium storthomum [sic]": 2, '"Biscomium storthomum"': 2,
    "Bіscomium stor​thomum": 2, "Bíscomium storthomum": 2, "B1scomium st0rthomum": 2, "Biscomium sp.": 1, "Biscomium spp.": 1, "Biscomium sp. 4": 1,
    "Biscomium": 1, "Biscomium ?": 1, "Biscomium Lindeberg, 1901": 1, "Rumflaster fircaes": 5, "Rhurnflaster phircaes": 5, "Glypholia taexensis": 2, "Glyfolia taeksensis": 2,
    "Biscomium phircaes": -1, "Glypholia storthomum": -1, "Unlisteda storthomum": -1, "Biscomium unlistedum": -1, "Unlisteda sp.": -1, "storthomum": -1, "???": -1, "-": -1,
    "unknown": -1, "12345": -1, "not sure yet": -1, "": -1, "sp.": -1,
}


AT = datetime(2024, 1, 1)


def resolved(spark, entries, typed, **more):
    """The ids of (name, context) typed, by a request each."""
    requests = spark.createDataFrame([(k, [t], None, c, AT) for k, (t, c) in enumerate(typed)], "request_id long, names array<string>, query_string string, context_name string, loaded_at timestamp")
    canonical = spark.createDataFrame([(n, k, c) for n, k, c, own in entries if own], "name string, ott_id long, context_name string")
    synonyms = spark.createDataFrame([(n, k) for n, k, c, own in entries if not own], "name string, ott_id long")
    got = {r["request_id"]: r["ott_id"] for r in names.resolve_names(requests, canonical, synonyms, **more).collect()}
    return [got.get(k) for k in range(len(typed))]


@pytest.mark.parametrize("rows", [names.BROADCAST_ROWS, 0])
def test_typed_names(spark, rows):
    listed = [t for t in TYPED if t.strip()]
    got = dict(zip(listed, resolved(spark, LIST, [(t, None) for t in listed], broadcast_rows=rows)))
    assert got == {t: TYPED[t] for t in listed}


def test_long_words_fold_like_short_ones(spark):
    typed = ["Bisc" + "o" * n + "mium" for n in (1, 12, 30)] + ["B" + "x" * 5000 + " " + "y" * 5000]
    assert resolved(spark, LIST, [(t, None) for t in typed]) == [1, 1, 1, -1]


def test_homonyms_by_context(spark):
    assert resolved(spark, LIST, [("Twicenamed", "Bacteria"), ("Twicenamd", "Animals"), ("Twicenamed", None)]) == [7, 6, 6]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
def test_edits_and_deletes(a, b, most):
    def slow(x, y):
        d = {(i, j): max(i, j) for i in range(len(x) + 1) for j in range(len(y) + 1) if not i * j}
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x), len(y)]

    true = slow(a, b)
    assert names.edits(a, b, most) == min(true, most + 1)
    assert names.weight(a, b) <= true + 1e-9


def test_candidates_are_all_words_within_the_bound(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 10)))
    listed, typed = {word() for _ in range(300)}, {word() for _ in range(100)}
    rows = lambda words: spark.createDataFrame([("first", w) for w in sorted(words)] + [("ending", w[:2]) for w in sorted(words)], "kind string, word string").distinct()
    for most in (0, names.BROADCAST_ROWS):
        got = {(r["word"], r["listed"]): (r["n"], r["cost"]) for r in names.candidates(rows(typed), rows(listed), most).where("kind = 'first'").collect()}
        for t in typed:
            for w in listed:
                n, within = names.edits(t, w, 2), min(names.bound(t), names.bound(w))
                if n <= within:
                    assert got[t, w][0] <= n and got[t, w][1] <= names.weight(t, w)
                if (t, w) in got:
                    assert got[t, w] == names.near(t, w, True, len(w) > 4 and len(names.fold(t)) > 3) or got[t, w] == names.near(t, w, False, True)


def test_requests(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (1, ["Biscomium", None, "", "  ", "Rhumflaster sp."], None, "Fungi", t, 0), (1, ["Biscomium", None, "", "  ", "Rhumflaster sp."], None, "Fungi", t, 0),
        (2, None, "Biscomium storthomum,, Twicenamed ,zz", "Bacteria", t, 0), (3, ["Biscomium"], "Biscomium", None, t, 0), (4, None, None, None, t, 0), (5, [], None, None, t, 0),
    ]
    requests = spark.createDataFrame(rows, "request_id long, names array<string>, query_string string, context_name string, loaded_at timestamp, ott_id int")
    canonical = spark.createDataFrame([(n, k, c) for n, k, c, own in LIST if own], "name string, ott_id long, context_name string")
    synonyms = spark.createDataFrame([(n, k, None) for n, k, c, own in LIST if not own] * 2 + [(None, 2, None), ("Zz", None, None)], "name string, ott_id long, source string")
    got = sorted(tuple(r) for r in names.resolve_names(requests, canonical, synonyms).collect())
    assert got == [(1, 0, 1), (1, 4, 4), (2, 0, 2), (2, 2, 7), (2, 3, -1)]
    nothing = names.resolve_names(requests, canonical.limit(0), synonyms)
    assert {r["ott_id"] for r in nothing.collect()} == {-1}


def test_a_misspelling_that_is_another_listed_word(spark):
    made = [("Tiarosa albicans", 1, None, True), ("Tiarusa nigripes", 2, None, True), ("Tiarosa", 3, None, True), ("Moxella nigrides", 4, None, True)]
    typed = {"Tiarosa nigripes": 2, "Tiarusa nigrides": 2, "Tiarosa albicans": 1, "Moxella nigrides": 4, "Moxella albicans": -1}  # the genus, then the species word is misspelled
    assert resolved(spark, made, [(t, None) for t in typed]) == list(typed.values())


def test_blank_texts_and_empty_lists_fill_nothing(spark):
    at = "timestamp'2024-01-01 00:00:00'"
    rows = [(1, "array('Aa')", "''"), (2, "array()", "'Bb,Cc'"), (3, "array('Aa')", "'\u00a0 '"), (4, "array('Aa')", "'Bb'"), (5, "array('')", "'Bb'"), (6, "null", "' '"), (7, "array()", "null")]
    told = " union all ".join(f"select {k}L as request_id, cast({n} as array<string>) as names, {q} as query_string, 'x' as context_name, {at} as loaded_at" for k, n, q in rows)
    got = {(r["request_id"], r["name_pos"], r["typed"]) for r in names.request_elements(spark.sql(told)).collect()}
    assert got == {(1, 0, "Aa"), (2, 0, "Bb"), (2, 1, "Cc"), (3, 0, "Aa")}
