"""References, hierarchies, snapshots and nested documents against brute force on small tables."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolith.functions import text
from arbolith.operators import hierarchy, nested, references, snapshots

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_orphans_in_small_blocks_and_batches(spark):
    rng = random.Random(4)
    keys = [(k, 0, rng.choice([references.ALWAYS, rng.randrange(100), None]), rng.choice([None, rng.randrange(100)])) for k in rng.sample(range(500), 200)]
    refs = [(i, rng.choice([7, rng.randrange(500)]) if i % 10 else None, 0, rng.randrange(100)) for i in range(900)]
    refs += refs[:5]
    table = {}
    for k, _, since, gone in keys:
        table[k] = (since, gone)

    def judge(key, at):
        since, gone = table.get(key, (None, None))
        if since is not None:
            return None if since <= at else "late"
        if gone is not None:
            return "deleted" if gone <= at else None
        return "missing"

    want = sorted((i, r) for i, k, _, at in refs if k is not None and (r := judge(k, at)))
    got = references.find_orphans(
        spark.createDataFrame(refs, "row long, key long, check long, at long"),
        spark.createDataFrame(keys, "key long, check long, since long, gone long"), block_keys=16, batch=20,
    )
    assert rows(got.select("row", "reason")) == want


def test_orphans_of_an_empty_key_table(spark):
    refs = spark.createDataFrame([(1, 5, 0, 3)], "row long, key long, check long, at long")
    keys = spark.createDataFrame([], "key long, check long, since long, gone long")
    assert rows(references.find_orphans(refs, keys)) == [(1, "missing")]
    assert rows(references.find_orphans(refs.limit(0), keys)) == []


def test_hash_twins_are_told_apart_by_their_check(spark):
    keys = spark.createDataFrame([(5, c, references.ALWAYS, None) for c in range(40)], "key long, check long, since long, gone long")
    refs = spark.createDataFrame([(c, 5, c, 0) for c in range(45)], "row long, key long, check long, at long")
    got = rows(references.find_orphans(refs, keys, block_keys=100).select("row"))
    assert got == [(c,) for c in range(40, 45)]


@pytest.mark.parametrize("block_keys", [1, 2, 3, 9])
def test_keys_of_one_hash_are_not_parted_by_blocks(spark, block_keys):
    listed = [(4, 0), (5, 1), (5, 2), (5, 7), (6, 1)]
    keys = spark.createDataFrame([(*k, references.ALWAYS, None) for k in listed], "key long, check long, since long, gone long")
    refs = spark.createDataFrame([(n, *k, 0) for n, k in enumerate([*listed, (5, 3), (4, 1), (3, 0), (7, 0)])], "row long, key long, check long, at long")
    assert rows(references.find_orphans(refs, keys, block_keys=block_keys).select("row")) == [(5,), (6,), (7,), (8,)]


def brute_tree(pairs):
    up = {}
    for i, p in pairs:
        if i is not None:
            up[i] = min((x for x in (up.get(i), p) if x is not None), default=None)
    out = []
    for i in up:
        path, at = [i], i
        while (p := up[at]) in up and p is not None and p not in path:
            path.append(p)
            at = p
        if p is not None and p in path:
            k = path.index(p)
            out.append((i, min(path[k:]), k, True))
        else:
            out.append((i, at, len(path) - 1, False))
    return sorted(out)


def make_forest(seed, n=300):
    rng = random.Random(seed)
    pairs = [(i, rng.choice([None, 999_999, rng.randrange(n), rng.randrange(n), 3])) for i in range(n)]
    return pairs + [(None, 4), (5, None), (7, 7)]


@pytest.mark.parametrize(("seed", "share"), [(0, 0.0), (1, 0.2), (2, 1.0)])
def test_hierarchy_with_and_without_taking_out_chains(spark, seed, share):
    pairs = make_forest(seed) + [(1000 + k, 999 + k if k else 7) for k in range(15)] + [(2000 + k, 2000 + (k + 1) % 9) for k in range(9)] + [(3000, 2003), (3001, 3000), (3002, 2005)]
    tree = hierarchy.hierarchy(spark.createDataFrame(pairs, "id long, parent long"), slow_share=share)
    assert rows(tree.select("id", "root", "depth", "to_ring")) == brute_tree(pairs)
    known = {r["id"]: r for r in tree.collect()}
    below = Counter(a for r in known.values() for a in r["path"][:-1])
    members = Counter(r["root"] for r in known.values() if r["to_ring"])
    for i, r in known.items():
        above = [i]
        while not known[above[-1]]["on_ring"] and known[above[-1]]["parent"] in known:
            above.append(known[above[-1]]["parent"])
        assert r["path"] == above[::-1]
        assert r["n_below"] == (members[r["root"]] - 1 if r["on_ring"] else below[i])


def test_long_chains_end_in_few_rounds(spark):
    n = 60_000
    chain = spark.range(n).selectExpr("id", "case when id = 0 then null else id - 1 end as parent")
    leaves = spark.range(n, n + 3000).selectExpr("id", "id % 50 as parent")
    tree = hierarchy.hierarchy(chain.union(leaves), paths=False)
    last = tree.where(f"id = {n - 1}").first()
    assert (last["root"], last["depth"], last["path"]) == (0, n - 1, None) and tree.where("id = 0").first()["n_below"] == n + 2999
    assert tree.count() == n + 3000 and tree.where(f"id < {n} and depth = id").count() == n
    ring = spark.range(n).selectExpr("id", f"(id + 1) % {n} as parent")
    assert hierarchy.hierarchy(ring, paths=False).where(f"on_ring and root = 0 and depth = 0 and n_below = {n - 1}").count() == n


def test_paths_and_descendants(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (big, 3), (9, 8), (8, 9), (10, 9)], "id long, parent long")
    for share in (0.0, 1.0):
        tree = hierarchy.hierarchy(df, slow_share=share)
        got = {r["id"]: (list(r["path"]), r["n_below"]) for r in tree.collect()}
        assert got[big] == ([1, 2, 3, big], 0) and got[1] == ([1], 3) and got[10] == ([9, 10], 0) and got[8] == ([8], 2)
        pairs = rows(hierarchy.descendants(tree))
        assert pairs == sorted([(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, big, 3), (2, big, 2), (3, big, 1), (9, 10, 1)])
    assert hierarchy.hierarchy(df.limit(0)).count() == 0


def test_parents_by_tag_and_first_record(spark):
    schema = "add_key long, addition_id string, seq int, ott_id long, tag string, parent long, parent_tag string, submitted_at timestamp"
    data = [
        (1, "a", 0, 10, "t1", None, None, T0), (2, "a", 1, 11, None, None, "t1", T0), (2, "a", 1, 11, None, None, "t1", T0),
        (3, "b", 0, 11, None, 99, None, T0 + timedelta(days=1)), (4, "b", 1, None, "t2", 10, None, T0), (5, "b", 2, 12, None, None, "t2", T0),
        (6, "b", 3, 13, None, 5, "t2", T0),
    ]
    got = rows(hierarchy.addition_parents(spark.createDataFrame(data, schema)))
    assert got == [(10, None), (11, 10), (12, None), (13, 5)] or sorted(map(str, got)) == sorted(map(str, [(10, None), (11, 10), (12, None), (13, 5)]))


def test_snapshot_changes(spark):
    rng = random.Random(1)
    data, last = [], {}
    for snap in (1, 2, 5, 6):
        for key in range(60):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                at = T0 + timedelta(seconds=rng.randrange(10_000))
                name = rng.choice(["a b", " a  b ", "A b", None, "c"])
                parent = rng.choice([None, 1])
                data.append((snap, key * 50_000, name, parent, at, "x"))
                norm = None if name is None else " ".join(name.split())
                k = (at, (norm is not None, norm or ""), (parent is not None, parent or 0))
                if (snap, key * 50_000) not in last or k > last[snap, key * 50_000][0]:
                    last[snap, key * 50_000] = (k, (norm, parent))
    data += [(None, 1, "a", 1, T0, "x"), (2, None, "a", 1, T0, "x")]
    want, snaps = [], [1, 2, 5, 6]
    for old, new in zip(snaps, snaps[1:]):
        for key in range(0, 60 * 50_000, 50_000):
            a, b = last.get((old, key)), last.get((new, key))
            if a is None and b is not None:
                want.append((new, key, "added"))
            elif a is not None and b is None:
                want.append((new, key, "removed"))
            elif a and b and a[1] != b[1]:
                want.append((new, key, "changed"))
    df = spark.createDataFrame(data, "snap_no int, ott_id long, name string, parent long, loaded_at timestamp, ordinal string")
    values = {"name": text.squeeze(F.col("name")), "parent": F.col("parent")}
    got = snapshots.snapshot_changes(df, "ott_id", "snap_no", "loaded_at", values)
    assert rows(got.drop("fields")) == sorted(want)
    fields = {(r["snap_no"], r["key"]): r["fields"] for r in got.where("change_kind = 'changed'").collect()}
    pairs = dict(zip(snaps[1:], snaps))
    for (snap, key), named in fields.items():
        a, b = last[pairs[snap], key][1], last[snap, key][1]
        assert named == [f for f, x, y in zip(("name", "parent"), a, b) if x != y]
    # One snapshot at a time, from what was kept of the one before.
    first = snapshots.latest_rows(df.where("snap_no = 1"), "ott_id", "snap_no", "loaded_at", values)
    registry = snapshots.register_keys(first)
    blocks = snapshots.snapshot_blocks(first, registry)
    steps = []
    for snap in snaps[1:]:
        before = {r["key"]: r["ordinal"] for r in registry.collect()}
        registry, blocks, changes = snapshots.next_changes(df.where(f"snap_no = {snap}"), registry, blocks, "ott_id", "snap_no", "loaded_at", values)
        now = {r["key"]: r["ordinal"] for r in registry.collect()}
        assert before.items() <= now.items() and sorted(now.values()) == list(range(len(now)))
        steps += rows(changes.drop("fields"))
    assert sorted(steps) == sorted(want)
    assert rows(snapshots.snapshot_changes(df.limit(0), "ott_id", "snap_no", "loaded_at", values)) == []


def test_a_snapshot_that_drops_everything_but_one(spark):
    df = spark.createDataFrame([(1, k, "n", None, T0) for k in range(5)] + [(2, 9, "n", None, T0)], "snap_no int, ott_id long, name string, parent long, loaded_at timestamp")
    got = snapshots.snapshot_changes(df, "ott_id", "snap_no", "loaded_at", {"name": F.col("name")})
    assert rows(got.drop("fields")) == sorted([(2, k, "removed") for k in range(5)] + [(2, 9, "added")])


@pytest.mark.parametrize("seed", range(6))
def test_compressed_bitmaps(seed):
    rng = np.random.default_rng(seed)
    top = snapshots.CHUNK

    def some():
        kind = rng.integers(4)
        if kind == 0:
            return np.sort(rng.choice(top, rng.integers(0, 40), replace=False))
        if kind == 1:
            return np.flatnonzero(rng.random(top) < 0.5)
        ends = np.sort(rng.choice(top + 1, 6, replace=False))
        return np.concatenate([np.arange(a, b) for a, b in zip(ends[::2], ends[1::2])]) if kind == 2 else np.arange(top)

    for _ in range(40):
        a, b = some(), some()
        x, y = (snapshots.Bitmap(snapshots.Bitmap.pack(s)) for s in (a, b))
        assert np.array_equal(x.meet(y, True), np.intersect1d(a, b)) and np.array_equal(x.meet(y, False), np.setdiff1d(a, b))
        picked = a[rng.random(len(a)) < 0.3]
        assert np.array_equal(x.rank(picked), np.searchsorted(a, picked))
    assert not len(snapshots.Bitmap(None).meet(x, True)) and np.array_equal(x.meet(snapshots.Bitmap(None), False), a)


def brute_docs(docs):
    def bad(_):
        raise ValueError

    def listed(x):
        return [] if x is None else x if isinstance(x, list) else [x]

    out = []
    for key, body in docs:
        try:
            doc = json.loads(body, parse_constant=bad)
            if isinstance(doc, dict) and isinstance(doc.get("addition_document"), str):
                doc = json.loads(doc["addition_document"], parse_constant=bad)
        except (ValueError, TypeError):
            out.append((key, -1, "unreadable", -1, ""))
            continue
        for i, t in enumerate(listed(doc.get("taxa")) if isinstance(doc, dict) else []):
            if not isinstance(t, dict):
                continue
            ott = "".join(str(t.get("ott_id") if t.get("ott_id") is not None else "").split())
            out.append((key, i, "taxon", -1, ott if ott.isdigit() else ""))
            for j, s in enumerate(listed(t.get("sources"))):
                v = s.get("source") if isinstance(s, dict) else s
                if v:
                    out.append((key, i, "source", j, v))
            out += [(key, i, "flag", j, f) for j, f in enumerate(listed(t.get("flags"))) if f is not None]
    return sorted(out)


BODIES = [
    '{"id": "d", "taxa": [{"ott_id": 5, "sources": [{"source": "a [x]"}, {}, null, {"source": null}, "s"], "flags": ["f", null, " g "]}]}',
    '{"taxa": {"ott_id": " 77 ", "sources": {"source": "one"}, "flags": "[odd] flag"}}',
    '{"taxa": [null, {"ott_id": null}, {"ott_id": "ott9"}, {}], "study_id": null}',
    json.dumps({"addition_document": json.dumps({"taxa": [{"ott_id": "12", "flags": ["é\"x"]}]})}),
    '{"taxa": null}', "{}", "[]", "null", '"x"', "3",
    "", "   ", "{'taxa': 1}", '{"a": NaN}', '{"a": 01}', '{"a": 1,}', '{"a": 1} x', '{"a": 1}]', '{"a": 1},{"b": 2}', '{"a": "\t"}', '{"taxa": [{"ott_id": 1', "<p>moved</p>", "// c\n{}", '{"a": Infinity}', "{a: 1}",
    '{"a": 1, "a": 2, "taxa": [{"ott_id": 3}]}',
]


def test_nested_documents(spark):
    docs = list(enumerate(BODIES))
    df = spark.createDataFrame([(k, T0, b, 0) for k, b in docs] + [(0, T0 - timedelta(days=1), "{}", 0)], "doc_key long, loaded_at timestamp, body string, taxa int")
    got = nested.flat_rows(nested.parse_documents(df))
    assert rows(got) == brute_docs(docs)
    parsed = nested.parse_documents(df)
    assert nested.flat_taxa(parsed).count() == sum(1 for r in brute_docs(docs) if r[2] == "taxon")
    assert nested.flat_sources(parsed).count() == sum(1 for r in brute_docs(docs) if r[2] == "source")
    assert nested.flat_flags(parsed).count() == sum(1 for r in brute_docs(docs) if r[2] == "flag")


def test_null_bodies_and_empty_tables(spark):
    df = spark.createDataFrame([(1, T0, None)], "doc_key long, loaded_at timestamp, body string")
    assert rows(nested.flat_rows(nested.parse_documents(df))) == [(1, -1, "unreadable", -1, "")]
    assert rows(nested.flat_rows(nested.parse_documents(df.limit(0)))) == []
