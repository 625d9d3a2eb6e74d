from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arbolith.llm import terms


def brute(lists, longest):
    occurrences, records = Counter(), defaultdict(set)
    for k, x in enumerate(lists):
        for n in range(1, longest + 1):
            for i in range(len(x) - n + 1):
                occurrences[tuple(x[i : i + n])] += 1
                records[tuple(x[i : i + n])].add(k)
    return {g: (c, len(records[g])) for g, c in occurrences.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=40), min_size=1, max_size=8), st.one_of(st.none(), st.integers(1, 4)))
def test_intervals_against_brute_force(lists, longest):
    tokens = np.concatenate([np.array(x) for x in lists])
    record = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    got = {}
    for n, first, occurrences, records in terms.intervals(tokens, record, longest):
        for p, o, r in zip(first, occurrences, records):
            got[tuple(tokens[p : p + n].tolist())] = (o, r)
    assert got == brute(lists, longest or max(map(len, lists)))


def test_marks_runs_and_odd_rows(spark):
    t = datetime(2024, 1, 1)
    data = [(k, "Spe-cies ", [" Edited,x", None, ""], t, 1) for k in range(8)]
    data += [(7, "Spe-cies ", [" Edited,x", None, ""], t, 1), (8, None, None, t, 1), (9, " _rare__one", ["x", "x", "edited"], t, 1)]
    data += [(k, None, [], t, 1) for k in range(10, 45)]
    df = spark.createDataFrame(data, "add_key long, rank string, flags array<string>, loaded_at timestamp, term int")
    marks = {tuple(r) for r in terms.marked_terms(df).collect()}
    assert marks == {("rank", "rare_one", "rare")}
    more = {tuple(r) for r in terms.marked_terms(df.where("add_key < 40")).collect()}
    assert more == marks | {("flags", "edited", "common"), ("flags", "x", "common")} or len(more) == 3
    counts = {(r["n"], r["term"]): (r["occurrences"], r["records"]) for r in terms.addition_terms(terms.addition_records(df), 2).where("field_name = 'flags'").collect()}
    assert counts[1, "x"] == (10, 9) and counts[1, "edited"] == (9, 9)
    assert counts[2, "edited" + terms.JOIN + "x"] == (8, 8) and counts[2, "x" + terms.JOIN + "x"] == (1, 1)
    assert terms.marked_terms(df.limit(0)).count() == 0


def test_runs_of_any_length(spark):
    rows = "values (1L, 'species', array('a,b', 'c', 'd', 'e')), (2L, null, array('b', 'c', 'd', 'e'))"
    df = spark.sql(f"select col1 as add_key, col2 as rank, col3 as flags from {rows}")
    got = {(r["n"], r["term"]): (r["occurrences"], r["records"]) for r in terms.addition_terms(df, None).where("field_name = 'flags'").collect()}
    assert got[5, terms.JOIN.join("abcde")] == (1, 1) and got[4, terms.JOIN.join("bcde")] == (2, 2) and len(got) == 15


def test_a_long_record_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_TERMS", 5)
    tokens, record = np.tile([1, 2, 1], 3000), np.zeros(9000, dtype=np.int64)
    (n, first, occurrences, records), = terms.intervals(tokens, record, 1)
    assert n == 1 and occurrences.tolist() == [6000, 3000] and records.tolist() == [1, 1]
    made = terms._count_blocks(None)([terms.pd.DataFrame({"field_name": ["f"] * 3, "terms": [np.array(x, dtype=object) for x in (list("abab"), list("ab"), list("b"))]})] * 2)
    total = terms.pd.concat(made).groupby("term")[["occurrences", "records"]].sum()
    assert total.loc["a"].tolist() == [6, 4] and total.loc["b"].tolist() == [8, 6] and total.loc[terms.JOIN.join("aba")].tolist() == [2, 2]
