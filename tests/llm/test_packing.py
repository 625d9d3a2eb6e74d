import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arbolith.llm import catalog, packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_every_piece_has_one_place_that_fits(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    place = packing.pack(sizes, 50)
    assert (place >= 0).all()
    if len(sizes):
        filled = np.bincount(place, weights=sizes)
        assert filled.max() <= 50 and filled.min() > 0


def test_two_for_one():
    # Greedy takes 60 + 30 and leaves 10; 20 + 20 in place of 30 fill the container.
    place = packing.pack(np.array([60, 30, 20, 20]), 100)
    assert place[0] == place[2] == place[3] != place[1]


def test_a_single_piece_gives_way_too():
    place = packing.pack(np.array([60, 50, 50]), 100)
    assert place[1] == place[2] != place[0]


def test_little_is_left_unused():
    sizes = np.random.default_rng(3).integers(1, 1500, 4000)
    filled = np.bincount(packing.pack(sizes, 2048), weights=sizes)
    assert sizes.sum() / (len(filled) * 2048) > 0.99


def test_containers_of_a_table(spark):
    texts = [(1, "word " * 9000, 7), (2, "", 7), (3, None, 7), (4, "one two", 7), (4, "one two", 7), (None, "ä" * 50, 7)]
    texts += [(k, "some words " * (k % 40), 7) for k in range(5, 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, shard int")
    counts = packing.token_counts(df, "doc_id", "text", catalog.tokenizer_path())
    want = {}
    for r in counts.collect():
        want[r["id"]] = want.get(r["id"], 0) + r["n_tokens"]
    got = packing.containers(counts, 2048, 20_000).toPandas()
    assert got.groupby(["shard", "container_no"])["n_tokens"].sum().max() <= 2048
    assert got["shard"].nunique() > 1
    summed = got.groupby("id", dropna=False)["n_tokens"].sum().to_dict()
    assert {k: v for k, v in want.items() if v and k is not None} == {int(k): v for k, v in summed.items() if k == k}
    long = got[got["id"] == 1].sort_values("start_token")
    assert (long["n_tokens"].iloc[:-1] == 2048).all() and long["start_token"].tolist() == [2048 * i for i in range(len(long))]
    assert (got[got["id"].isin([k for k, v in want.items() if v <= 2048])]["piece_no"] == 0).all()
    assert packing.containers(counts.limit(0)).count() == 0
    again = packing.containers(counts.repartition(7), 2048, 20_000).toPandas()
    key = list(got.columns)
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    told = {r["check_name"]: r["n"] for r in packing.checks(counts, 2048, 20_000).collect()}
    assert told.pop("texts") == sum(1 for r in counts.collect() if r["n_tokens"]) and not any(told.values()), told
    assert {r["n"] for r in packing.checks(counts.limit(0)).collect()} == {0}
