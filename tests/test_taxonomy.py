"""Dumps, store, tree, resolution, exports, additions, streaming and services on a small taxonomy."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from arbolith import schema, services
from arbolith.functions import taxon
from arbolith.operators import additions, exports, resolve
from arbolith.operators import tree as trees
from arbolith.sources import dumps
from arbolith.store import Store, open_store
from arbolith.streaming import additions as stream

LINES = [
    "uid\t|\tparent_uid\t|\tname\t|\trank\t|\tsourceinfo\t|\tuniqname\t|\tflags\t|\t",
    "805080\t|\t\t|\tlife\t|\tno rank\t|\t\t|\t\t|\t\t|\t",
    "2\t|\t805080\t|\tFungi\t|\tkingdom\t|\tncbi:4751,http://a:b,x:,plain\t|\t\t|\t\t|\t",
    "3\t|\t805080\t|\tAnimalia\t|\tkingdom\t|\tncbi:33208\t|\t\t|\t\t|\t",
    "10\t|\t2\t|\tAster\t|\tgenus\t|\tif:1\t|\tAster (genus in Fungi)\t|\tedited,odd_flag\t|\t",
    "11\t|\t3\t|\tAster\t|\tgenus\t|\tworms:1\t|\tAster (genus in Animalia)\t|\t\t|\t",
    "20\t|\t10\t|\tAster albus\t|\tspecies\t|\t\t|\t\t|\t\t|\t",
    "21\t|\t10\t|\tAster alpinus\t|\tspecies\t|\t\t|\t\t|\thidden,forced_visible\t|\t",
    "22\t|\t10\t|\tAster niger\t|\tspecies\t|\t\t|\t\t|\tforced_visible,hidden\t|\t",
    "23\t|\t10\t|\tAster viridis\t|\tspecies\t|\t\t|\t\t|\tviral\t|\t",
    "24\t|\t23\t|\tAster viridis minor\t|\tsubspecies\t|\t\t|\t\t|\t\t|\t",
    "30\t|\t11\t|\tAster (marine group B)\t|\tform\t|\t\t|\t\t|\t\t|\t",
    "31\t|\t11\t|\tÉtoile bleue\t|\tvarietas\t|\t\t|\t\t|\tnot_otu\t|\t",
    "40\t|\t999\t|\tOrphan\t|\tspecies\t|\t\t|\t\t|\t\t|\t",
    "only one column",
    "x7\t|\t2\t|\tbad id\t|\tspecies\t|\t\t|\t\t|\t\t|\t",
]
SYNONYMS = ["name\t|\tuid\t|\ttype\t|\t", "Weisse Aster\t|\t20\t|\tsynonym\t|\t", "Weisse Aster\t||\t21", "Alpenaster\t|\t21\t|\t", "Lost\t|\t777\t|\t", "Bad\t|\tx\t|\t", "Sternpilz\t|\t10\t|\t"]
FORWARDS = ["id\treplacement", "100\t20", "101\t20", "102\tnone", "103\t888"]
DEPRECATED = ["id\tname\tsourceInfo\treason", "500\tOld name\tncbi:5\tmerged", "501\tAster vetus\t\tunknown"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump")
    for name, lines in (("taxonomy.tsv", LINES), ("synonyms.tsv", SYNONYMS), ("forwards.tsv", FORWARDS), ("deprecated.tsv", DEPRECATED), ("version.txt", ["2.9draft12"])):
        (path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    (path / "tabs.tsv").write_text("\n".join(x.replace("\t|\t", "\t") for x in LINES), encoding="utf-8")
    (path / "old.ncbi").write_text("\n".join("\t|\t".join(x.split("\t|\t")[:4]) + "\t|" for x in LINES[1:8]), encoding="utf-8")
    return path


@pytest.fixture(scope="module")
def store(spark, folder):
    made = dumps.load_dumps(spark, str(folder))
    made._metadata = spark.createDataFrame([("abc2.9draft12", "me", "http://old")], schema.METADATA)
    made._roots = spark.createDataFrame([("Fungi", 2), ("Animals", 3)], "name string, root_ott_id long")
    return made


def names(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, qname string")


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_dumps(spark, folder):
    taxa = dumps.read_taxonomy(spark, f"{folder}/taxonomy.tsv")
    assert taxa.count() == 13 and dumps.bad_taxonomy_lines(spark, f"{folder}/taxonomy.tsv").count() == 2
    assert rows(dumps.read_taxonomy(spark, f"{folder}/tabs.tsv")) == rows(taxa)
    old = dumps.read_taxonomy(spark, f"{folder}/old.ncbi")
    assert old.count() == 7 and rows(old.where("ott_id = 20"), "name", "rank", "uniqname") == [("Aster albus", "species", "")]
    assert taxa.where("ott_id = 10").first()["flags"] == ["edited", "odd_flag"]
    synonyms = dumps.read_synonyms(spark, f"{folder}/synonyms.tsv")
    assert rows(synonyms, "name", "ott_id") == sorted([("Weisse Aster", 20), ("Weisse Aster", 21), ("Alpenaster", 21), ("Lost", 777), ("Sternpilz", 10)])
    assert rows(dumps.bad_synonym_lines(spark, f"{folder}/synonyms.tsv")) == [("Bad\t|\tx\t|\t",)]
    assert rows(dumps.read_forwards(spark, f"{folder}/forwards.tsv")) == [(100, 20), (101, 20), (103, 888)]
    assert dumps.read_deprecated(spark, f"{folder}/deprecated.tsv").count() == 2
    assert dumps.store_path(spark, str(folder)) == "ott_v2.9draft12.db" and dumps.store_path(spark, str(folder), "mine") == "mine"
    with pytest.raises(FileNotFoundError):
        dumps.load_dumps(spark, f"{folder}/nowhere")


def test_derived_columns(store):
    assert rows(store.taxa.where("dubious"), "ott_id") == [(23,), (31,)]
    assert dict(rows(store.taxa, "ott_id", "rank_class"))[31] == "specific" and dict(rows(store.taxa, "ott_id", "rank_class"))[11] == "genus"
    assert rows(store.source_index) == sorted([("ncbi:4751", 2), ("ncbi:33208", 3), ("if:1", 10), ("worms:1", 11)])
    assert dict(rows(resolve.flag_counts(store)))["forced_visible"] == 2 and resolve.flag_counts(store).count() == 32
    assert rows(resolve.count_flag(store, "barren")) == [("barren", 0)]
    with pytest.raises(ValueError):
        resolve.count_flag(store, "odd_flag")


def test_trees(spark, store):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "ott_id long")
    assert rows(trees.lineage(store.tree, ids(20, 12345)), "anc_id", "dist") == [(2, 2), (10, 1), (805080, 3)]
    assert rows(trees.children(store.taxa, ids(10)), "ott_id") == [(20,), (21,), (22,), (23,)]
    assert rows(trees.tips(store.pref_tree, 10)) == [(20,), (21,), (22,)] and rows(trees.tips(store.pref_tree, 20)) == [(20,)]
    check = dict(rows(trees.verify(store.taxa, store.tree)))
    assert check == {"several_parents": 0, "own_parent": 0, "orphans": 1, "on_rings": 0, "roots": 1}
    sets = spark.createDataFrame([(1, 20), (1, 21), (1, 21), (2, 20), (3, 20), (3, 30), (4, 20), (4, 24), (5, 999)], "set_id int, ott_id long")
    assert rows(trees.mrca(store.pref_tree, sets)) == sorted([(1, 10, 2, 2), (2, 20, 1, 1), (3, 805080, 2, 2), (4, 24, 2, 1)] + [(5, None, 1, 0)], key=lambda r: r[0])
    strict = {r["set_id"]: r["mrca"] for r in trees.mrca(store.pref_tree, sets, strict=True).collect()}
    assert strict == {1: 10, 2: 20, 3: 805080, 4: None, 5: None}
    pairs = spark.createDataFrame([(20, 21), (20, 10), (20, 30), (24, 20)], "id_a long, id_b long")
    got = {(r[0], r[1]): (r[2], r[3]) for r in trees.internodal_distance(store.pref_tree, pairs).collect()}
    assert got == {(20, 21): (2, 5), (20, 10): (1, 4), (20, 30): (6, 7), (24, 20): (None, 2)}
    below = {r["ott_id"]: (list(r["mrca"]), list(r["nested_mrca"])) for r in trees.below_sets(store.tree).collect()}
    assert below[10] == ([20, 21, 22, 24], [10, 23]) and below[20] == ([20], [])
    assert rows(trees.genus_members(store.pref_tree, store.taxa)) == [(10, 20), (10, 21), (10, 22), (11, 30)]
    assert dict(rows(store.least_contexts)) == {805080: "All life", 2: "Fungi", 3: "Animals", 10: "Fungi", 11: "Animals", 20: "Fungi", 21: "Fungi", 22: "Fungi", 30: "Animals"}
    barriers = trees.resolve_barriers(store)
    assert rows(barriers, "clade", "root_ott_id") == [("Fungi", 2), ("Metazoa", 3)]
    assert dict(rows(trees.taxcodes(store.tree, barriers.select("root_ott_id", "code"))))[24] == "ICN"
    twice = trees.resolve_barriers(store, (("Fungi", "ICN"), ("Sternpilz", "ICZN"), ("Fungi 2", "ICN")), (("Fungi 2", "fungi"),))
    with pytest.raises(Exception, match="two barrier clades"):
        twice.collect()
    wide = trees.wide_nodes(store.tree, 805080, 4)
    assert rows(wide, "ott_id") == [(2,), (3,), (10,), (11,), (30,), (31,), (805080,)]
    edges = spark.createDataFrame([(1, 5, "b"), (1, 6, "a"), (1, 7, "a"), (2, 5, "c")], "child_id long, parent_id long, source string")
    assert rows(trees.preferred_edges(edges, ["b"])) == [(1, 5, "b"), (2, 5, "c")]
    assert rows(trees.first_neighbour(edges, ids(1, 3))) == [(1, 6), (3, None)] and rows(trees.first_neighbour(edges, ids(1), source="b")) == [(1, 5)]


def test_newick_and_labels(spark, store):
    assert trees.newick(store, 10).first()["newick"] == "(Aster_albus_ott20,Aster_alpinus_ott21,Aster_niger_ott22)Aster_ott10;"
    assert trees.newick(store, 11, "name").first()["newick"] == "('Aster (marine group B)')Aster;"
    assert trees.newick(store, 805080, "id").first()["newick"] == "(((20,21,22)10)2,((30)11)3)805080;"
    assert trees.newick(store, 20, "original_name").first()["newick"] == "Aster albus;"
    with pytest.raises(ValueError):
        trees.newick(store, 805080, limit=3)
    with pytest.raises(ValueError):
        trees.newick(store, 10, "nonsense")
    ids = spark.createDataFrame([(20,), (22,), (30,), (10,)], "ott_id long")
    assert trees.induced_newick(store, ids, "id").first()["newick"] == "((20,22)10,30)805080;"
    edges = trees.induced_subtree(store.pref_tree, ids.select(F.lit(1).alias("set_id"), "ott_id"))
    assert sorted(map(str, rows(edges))) == sorted(map(str, [(1, 805080, None, False), (1, 10, 805080, False), (1, 20, 10, True), (1, 22, 10, True), (1, 30, 805080, True)]))
    assert trees.induced_newick(store, ids.limit(0)).count() == 0


def test_resolution(spark, store):
    q = names(spark, "ASTER ALBUS", "Aster", "Aster sp.", "Weisse Aster", "Aster albsu", "nothing like it", None, "Old name", "aster viridis", "Aster alpinis")
    plain = resolve.match_names(store, q)
    assert rows(plain, "query_id", "ott_id", "stage") == [(0, 20, "exact"), (1, 10, "exact"), (1, 11, "exact"), (2, 10, "generic"), (2, 11, "generic"), (3, 20, "synonym"), (3, 21, "synonym")]
    assert {r["score"] for r in plain.where("stage = 'generic'").collect()} == {0.99}
    assert (8, 23, "exact") in rows(resolve.match_names(store, q, include_suppressed=True), "query_id", "ott_id", "stage")
    assert rows(resolve.match_names(store, q, "FUNGI").where("query_id < 2"), "query_id", "ott_id") == [(0, 20), (1, 10)]
    assert (7, 500, "deprecated") in rows(resolve.match_names(store, q, include_deprecated=True), "query_id", "ott_id", "stage")
    close = resolve.match_names(store, q, "All life", approximate=True).where("is_approximate")
    assert {(4, 20), (9, 21)} <= {(r[0], r[1]) for r in rows(close, "query_id", "ott_id")} and all(r["score"] < 1 for r in close.collect())
    told = {r["query_id"]: (r["matched"], r["unambiguous"]) for r in resolve.summary(q, plain).collect()}
    assert told[1] == (True, True) and told[3] == (True, False) and told[5] == (False, False) and told[6] == (False, False)
    with pytest.raises(ValueError):
        resolve.match_names(store, q, "Martians")
    guess = resolve.infer_context(store, names(spark, "Aster albus", "Aster alpinus", "Aster")).first()
    assert (guess["context_name"], guess["clade_ott_id"], guess["n_unique"], guess["n_ambiguous"]) == ("Fungi", 10, 2, 1)
    assert resolve.infer_context(store, names(spark, "zzz")).first()["context_name"] == "All life"
    weighted = resolve.match_names(store, names(spark, "Aster albus", "Aster (marine group A)"), approximate=True)
    outside = weighted.where("ott_id = 30").first()["score"]
    assert 0 < outside < 1 and resolve.match_names(store, names(spark, "zzz").limit(0), approximate=True).count() == 0
    lines = {r["query_id"]: r["description"] for r in resolve.describe(plain, store.taxa).collect()}
    assert lines[0] == "Exact match from search string 'aster albus' to unique taxon name 'Aster albus'" and "non-unique" in lines[1]
    listing = {r["query_id"]: r["lines"] for r in exports.result_lines(q, resolve.describe(plain, store.taxa)).collect()}
    assert listing[5] == "" and listing[1].count("\n") <= 1
    with pytest.raises(Exception, match="more than one"):
        resolve.single_match(plain).collect()


def test_segments_find_what_a_full_comparison_finds(spark):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    keys = {word(rng.randrange(1, 26)) for _ in range(150)}
    queries = {word(rng.randrange(1, 26)) for _ in range(60)}
    for k in list(keys)[:60]:
        i = rng.randrange(len(k) + 1)
        queries |= {k[:i] + "x" + k[i:], k[:i] + k[i + 1 :], k[1:] + "b"}
    q = spark.createDataFrame([(i, x) for i, x in enumerate(queries)], "query_id long, q string")
    k = spark.createDataFrame([(x,) for x in keys], "key_lc string")
    full = q.join(k, F.lit(True)).withColumn("d", F.levenshtein("q", "key_lc")).where(taxon.fuzzy_accepts(F.col("d"), F.col("q"), F.col("key_lc")))
    assert rows(resolve.similar(q, k), "q", "key_lc", "distance") == rows(full.distinct(), "q", "key_lc", "d")


def test_autocomplete(spark, store):
    def ask(*texts, **kw):
        got = {t: [] for t in texts}
        for r in resolve.autocomplete(store, names(spark, *texts), **kw).orderBy("query_id", "position").collect():
            got[texts[r["query_id"]]].append((r["ott_id"], r["stage"]))
        return got

    want = {
        "Aster albus": [(20, 1)], "Aster al": [(20, 2), (21, 2)], "Aster Al": [(20, 4), (21, 4)], "Aster": [(11, 1), (10, 1)], "Fun": [(2, 4)], "Fu": [], "Alpen": [(21, 5)],
        "Fungo": [(2, 6)], "Weisse Aster": [(20, 1), (21, 1)], "Aster vir": [(24, 4)], "qqqqqq": [],
    }
    assert ask(*want) == want
    assert ask("Aster vir", include_suppressed=True) == {"Aster vir": [(23, 4), (24, 4)]}
    assert ask("Aster", context="Animals") == {"Aster": [(11, 1)]}


def test_lookups(spark, store):
    ids = spark.createDataFrame([(20,), (100,), (103,), (500,), (4242,)], "ott_id long")
    assert rows(resolve.lookup_ids(store, ids)) == sorted([(20, 20, "live"), (100, 20, "alias"), (103, None, "unknown"), (500, 500, "deprecated"), (4242, None, "unknown")], key=lambda r: r[0])


def test_exports(spark, store, tmp_path):
    dot = [r["line"] for r in exports.dot_lines(store, 10).orderBy("part", "position").collect()]
    assert dot[0] == "strict digraph  {" and dot[-1] == "}" and sum("->" in x for x in dot) == 4
    lines = {r["line"] for r in exports.taxon_list_lines(store, 11).collect()}
    assert "30\t|\t11\t|\tAster__marine_group_B_\t|\t" in lines and len(lines) == 3
    for r in exports.graph_json(store, 805080).collect():
        json.loads(r["json"])
    assert json.loads(exports.name_dump(store).where("ott_id = 2").first()["json"]) == {"name": "Fungi", "treestoreId": "2", "sourceIds": ["ncbi:4751"]}
    assert rows(exports.subset_lines(store, "Aster"), "ott_id") == [(11,), (30,), (31,)]
    exports.write_lines(exports.taxon_list_lines(store, 11), ["position"], f"{tmp_path}/list")
    assert spark.read.text(f"{tmp_path}/list").count() == 3


def test_save_and_open(spark, store, tmp_path):
    store.save(f"{tmp_path}/db")
    again = open_store(spark, f"{tmp_path}/db")
    assert trees.newick(again, 10).first()["newick"] == trees.newick(store, 10).first()["newick"]
    assert rows(resolve.match_names(again, names(spark, "Aster")), "ott_id") == [(10,), (11,)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.save(f"{tmp_path}/db")


DOC = {
    "id": "additions-1", "taxa": [
        {"ott_id": 600, "name": "Aster novus", "rank": "species", "parent": 10, "tag": "t1", "sources": [{"source": "doi:1"}], "flags": ["extinct"]},
        {"ott_id": 601, "name": "Aster novus minor", "parent_tag": "t1"},
        {"ott_id": 602, "name": "Too early", "parent_tag": "t9"},
        {"ott_id": 603, "name": "Later", "parent": 10, "tag": "t9"},
        {"ott_id": 20, "name": "Known", "parent": 10, "tag": "t2"},
        {"ott_id": 604, "name": "Tag of a skipped one", "parent_tag": "t2"},
        {"ott_id": 605, "parent": 10}, {"name": "No id", "parent": 10}, {"ott_id": 606, "name": "No parent"}, {"ott_id": 607, "name": "Bad parent", "parent": 4711},
        {"ott_id": 600, "name": "Again", "parent": 10},
    ],
}
STATUS = ["new", "new", "no_parent", "new", "known", "no_parent", "no_name", "no_id", "no_parent", "bad_parent", "repeated"]


def test_additions(spark, store):
    docs = spark.createDataFrame([(1, json.dumps(DOC))], "doc_key long, body string").withColumn("loaded_at", F.current_timestamp())
    grown, checked = additions.apply(store, docs)
    assert [r["status"] for r in checked.orderBy("taxon_pos").collect()] == STATUS
    assert rows(grown.taxa.where("ott_id >= 600 and ott_id < 700"), "ott_id", "parent_ott_id", "input_sources") == [(600, 10, "additions-1:600"), (601, 600, "additions-1:601"), (603, 10, "additions-1:603")]
    assert rows(trees.tips(grown.pref_tree, 10)) == [(20,), (21,), (22,), (601,), (603,)]
    again, replay = additions.apply(grown, docs)
    assert again.taxa.count() == grown.taxa.count() and set(r["status"] for r in replay.where("taxon_pos in (0, 1, 3)").collect()) == {"known"}


def test_addition_stream_is_idempotent(spark, store, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "additions-1.json").write_text(json.dumps(DOC))
    known = additions.known_ids(store)
    for n in (1, 2):
        query = stream.apply_stream(stream.document_stream(spark, str(inbox)), known, target, str(tmp_path / "check"))
        query.awaitTermination()
        assert rows(spark.read.parquet(target), "ott_id") == [(600,), (601,), (603,)]
        (inbox / f"additions-{n + 10}.json").write_text(json.dumps(DOC))
    files = dumps.read_addition_files(spark, str(inbox))
    assert [r["file_name"] for r in files.orderBy("position").collect()] == ["additions-1.json", "additions-11.json", "additions-12.json"]


def test_name_and_count_streams(spark, store, tmp_path):
    names(spark, "Aster", "zzz").write.json(f"{tmp_path}/names")
    source = spark.readStream.schema("query_id long, qname string").json(f"{tmp_path}/names")
    query = stream.match_stream(source, store).writeStream.format("memory").queryName("matched").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("matched"), "ott_id") == [(10,), (11,)]
    spark.sql("select timestamp'2024-01-01 00:10:00' as t, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a'").write.parquet(f"{tmp_path}/req")
    counted = stream.request_counts(spark.readStream.schema("t timestamp, k string").parquet(f"{tmp_path}/req"), "t", "k")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["n"] for r in spark.table("counted").collect()] == [2]


def test_scalar_rules(spark):
    one = spark.createDataFrame([("abc2.9draft12", "http://old")], "s string, u string")
    name, version = taxon.version_parts(F.col("s"))
    assert tuple(one.select(name, version, taxon.version_weburl(F.col("u"), name, version, "http://old", "http://new/")).first()) == ("abc", "2.9", "http://new/abc2.9")
    assert one.select(taxon.version_parts(F.lit("plain"))[0]).first()[0] == "plain"
    assert one.select(taxon.comma_list(F.lit("a , b,c"))).first()[0] == ["a", "b", "c"]
    assert one.select(taxon.tax_sources(F.lit(""))).first()[0] == [""] and one.select(taxon.is_higher(F.lit("varietas"))).first()[0] is True
    assert one.select(taxon.distance_factor(F.lit(1), True)).first()[0] == float("inf") and one.select(taxon.distance_factor(F.lit(1))).first()[0] < 1
    assert [one.select(taxon.max_edits(F.lit(n))).first()[0] for n in (8, 9, 13, 14, 18, 19)] == [1, 2, 2, 3, 3, 4]
    tips = dumps.newick_tips(spark.createDataFrame([("(('a b',c_d:1)x,e[note],'it''s')r;",)], "tree string")).first()["tips"]
    assert tips == ["a b", "c_d", "e", "it's"]
    assert rows(schema.flags(spark).where("label = 'forced_visible'"), "constant", "suppresses") == [("FORCE_VISIBLE", False)]
    assert schema.contexts(spark).count() == 48


EXTENDED = {"ott_id", "name", "rank", "tax_sources", "unique_name", "is_suppressed", "flags", "synonyms"}


def test_services(spark, store):
    about = services.about(store).first().asDict()
    assert about == {"source": "abc2.9draft12", "author": "me", "weburl": "http://old", "name": "abc", "version": "2.9"}
    assert services.v3_subtree(store, 100).first()["newick"] == "Aster_albus_ott20;" and services.v2_subtree(store, 10).columns == ["subtree"]
    for call in (lambda: services.v3_subtree(store, 4242), lambda: services.v3_subtree(store, 10, "x"), lambda: services.v3_mrca(store, []), lambda: services.v3_mrca(store, [20, 4242]),
                 lambda: services.v3_taxon_info(store), lambda: services.v3_taxon_info(store, source_id="no:1"), lambda: services.v1_flagged_count(store, "odd")):
        with pytest.raises(services.BadInput):
            call()
    mrca = services.v3_mrca(store, [20, 21], include_lineage=True).first()["mrca"].asDict(recursive=True)
    assert mrca["ott_id"] == 10 and set(mrca) == EXTENDED | {"lineage"} and [x["ott_id"] for x in mrca["lineage"]] == [2, 805080]
    assert mrca["flags"] == ["EDITED"] and mrca["synonyms"] == ["Sternpilz"] and set(mrca["lineage"][0]) == EXTENDED
    info = services.v3_taxon_info(store, source_id="if:1", include_children=True, include_terminal_descendants=True).first()
    assert info["terminal_descendants"] == [20, 21, 22] and [c["ott_id"] for c in info["children"]] == [20, 21, 22, 23]
    assert services.v3_taxon_info(store, 20, include_children=True, include_lineage=True).first()["children"] == []
    retired = services.v3_taxon_info(store, 500).first().asDict()
    assert retired["reason"] == "merged" and retired["input_sources"] == "ncbi:5" and retired["flags"] == ["DEPRECATED"] and retired["is_suppressed"]
    lica = services.v2_lica(store, [20, 21, 4242]).first()
    assert lica["lica"]["ot:ottId"] == 10 and lica["ott_ids_not_found"] == [4242]
    assert services.v2_taxon(store, 4242).columns == ["error"] and services.v2_taxon(store, 20, include_lineage=True).first()["taxonomic_lineage"][0]["ot:ottId"] == 10
    assert services.v2_deprecated_taxa(store).count() == 2 and services.v1_taxonomy_version(store).first()["source"] == "abc2.9draft12"
    guess = services.v3_infer_context(store, names(spark, "Aster albus", "Aster")).first().asDict()
    assert guess == {"context_name": "Fungi", "context_ott_id": 2, "ambiguous_names": ["Aster"]}
    assert services.v1_context_for_names(store, "Aster albus , Aster").first()["context_name"] == "Fungi"
    complete = services.v3_autocomplete(store, "Aster al").collect()
    assert [set(r.asDict()) for r in complete] == [{"ott_id", "unique_name", "is_suppressed", "is_higher"}] * 2
    assert services.v2_autocomplete(store, "Aster").columns[:2] == ["node_id", "ot:ottId"] and services.v1_autocomplete_box(store, "Aster").count() == 2
    assert dict(rows(services.v3_contexts(store).select("grp", F.size("contexts"))))["PLANTS"] == 19
    assert set(services.ENDPOINTS) == {"v1", "v2", "v3"}


def test_match_names_answer(spark, store):
    q = names(spark, "Aster albus", "Aster", "Weisse Aster", "nope")
    answer = json.loads(services.v3_match_names(store, q).first()["json"])
    assert set(answer) == {"governing_code", "unambiguous_names", "unmatched_names", "matched_names", "context", "includes_deprecated_taxa", "includes_suppressed_names", "includes_approximate_matches", "taxonomy", "results"}
    assert answer["context"] == "Fungi" and answer["governing_code"] == "ICN" and answer["unmatched_names"] == ["nope"]
    assert [r["name"] for r in answer["results"]] == ["Aster albus", "Aster", "Weisse Aster"]
    match = answer["results"][0]["matches"][0]
    assert set(match) == {"is_approximate_match", "search_string", "matched_name", "score", "is_synonym", "nomenclature_code", "taxon"} and set(match["taxon"]) == EXTENDED
    assert match["nomenclature_code"] == "ICN" and set(answer["matched_names"]) | set(answer["unmatched_names"]) == {"Aster albus", "Aster", "Weisse Aster", "nope"}
    with pytest.raises(services.BadInput):
        services.v3_match_names(store, q, most=3)
    with pytest.raises(services.BadInput):
        services.v3_match_names(store, q, "Martians")
    with pytest.raises(services.BadInput):
        services.v3_match_names(store, q.unionByName(q))
    second = json.loads(services.v2_match_names(store, q).first()["json"])
    assert second["unmatched_name_ids"] == [3] and set(second["matched_name_ids"]) == {0, 1, 2} and second["includes_dubious_names"] is False and second["includes_approximate_matches"] is True
    flat = second["results"][0]["matches"][0]
    assert second["results"][0]["id"] == 0 and flat["ot:ottId"] == 20 and flat["is_dubious"] is False and flat["is_deprecated"] is False
    given = json.loads(services.v1_context_query(store, names=["Aster albus", "nope"], ids=["x", "y"]).first()["json"])
    assert [r["id"] for r in given["results"]] == ["x"] and given["unmatched_name_ids"] == ["y"] and given["includes_deprecated_ids"] is False
    assert given["results"][0]["matches"][0]["parent_name"] == "Aster"
    with pytest.raises(services.BadInput):
        services.v1_context_query(store, names=["a", "b"], ids=["x", "x"])
    grown, checked = services.v3_process_additions(store, json.dumps({"taxa": [{"ott_id": 900, "name": "New", "parent": 10}]}))
    assert grown.taxa.where("ott_id = 900").count() == 1
    with pytest.raises(services.BadInput):
        services.v3_process_additions(store, json.dumps({"taxa": [{"ott_id": 901, "name": "New"}]}))


def test_empty_store(spark):
    empty = Store(*[spark.createDataFrame([], s) for s in (schema.TAXA_RAW, schema.SYNONYMS_RAW, schema.ALIASES_RAW, schema.DEPRECATED_RAW)])
    assert empty.tree.count() == 0 and resolve.match_names(empty, names(spark, "Aster"), approximate=True).count() == 0
    assert resolve.autocomplete(empty, names(spark, "Aster")).count() == 0 and resolve.infer_context(empty, names(spark, "Aster")).first()["context_name"] == "All life"


def test_views_metadata_and_plain_lookups(spark, store):
    store.register("t_")
    assert spark.sql("select count(*) as n from t_tree where array_contains(path, 10L)").first()["n"] == 6
    assert store.with_metadata(author="you").metadata.first()["author"] == "you"
    q = names(spark, "aster viridis", "Sternpilz")
    assert rows(resolve.find_taxa(store, q), "ott_id") == [(23,)] and rows(resolve.find_taxa(store, q, include_suppressed=False, synonyms=True), "ott_id") == [(10,)]


def test_commands(spark, folder, tmp_path, capsys):
    from arbolith import cli

    run = lambda *a: (cli.main([str(x) for x in a], spark), capsys.readouterr().out.splitlines())
    assert cli.main(["nonsense"], spark) == 2
    capsys.readouterr()
    assert run("buildott", folder, tmp_path / "db") == (0, [])
    assert run("getsubtree", tmp_path / "db", 20, 21) == (0, ["(Aster_albus_ott20,Aster_alpinus_ott21)Aster_ott10;"])
    assert run("makecontexts", tmp_path / "db")[1] == ["All life\t9"]
    assert run("makegenusindexes", tmp_path / "db")[1] == ["10\t3", "11\t1"]
    assert run("tnrsbasic", tmp_path / "db", "Aster albus, zzzz")[1] == ["Aster albus\tExact match from search string 'aster albus' to unique taxon name 'Aster albus'", "zzzz\t"]
    run("adddeprecated", tmp_path / "db", folder / "deprecated.tsv", tmp_path / "db2")
    run("recalculatemrcas", tmp_path / "db2", tmp_path / "sets")
    assert spark.read.parquet(str(tmp_path / "sets")).count() == 41 and spark.read.parquet(str(tmp_path / "db2/deprecated")).count() == 2
    run("loadtaxsyn", "abc1.0", folder / "taxonomy.tsv", folder / "synonyms.tsv", folder / "forwards.tsv", tmp_path / "db3")
    assert spark.read.parquet(str(tmp_path / "db3/metadata")).first()["source"] == "abc1.0"


def test_odd_rows_and_clashing_columns(spark):
    """Nulls anywhere, repeated rows and columns named like inner ones don't disturb a store."""
    extra = "key_lc string, path string, kind string, q string, dubious string, root string"
    taxa = [(1, None, "Root", None, None, None, None), (2, 1, None, None, None, None, [None, "hidden"]), (2, 1, None, None, None, None, [None, "hidden"]), (3, 1, "x" * 5000, "species", "", "", []), (None, 1, "lost", "genus", "", "", [])]
    raw = spark.createDataFrame([(*r, *["z"] * 6) for r in taxa], f"{schema.TAXA_RAW}, {extra}")
    synonyms = spark.createDataFrame([(3, "syn", None, "z"), (3, "syn", None, "z"), (None, "q", None, "z"), (3, None, None, "z")], schema.SYNONYMS_RAW + ", key_lc string")
    odd = Store(raw.select(*[c.split()[0] for c in schema.TAXA_RAW.split(", ")]), synonyms.select("ott_id", "name", "source"), spark.createDataFrame([(None, 3), (9, None), (8, 3)], schema.ALIASES_RAW), spark.createDataFrame([(None, None, None, None)], schema.DEPRECATED_RAW))
    assert rows(odd.tree, "ott_id", "depth") == [(1, 0), (2, 1), (3, 1)] and rows(odd.pref_tree, "ott_id", "depth") == [(1, 0), (2, 0), (3, 1)]
    q = spark.createDataFrame([(0, "SYN", 1), (1, "", 1), (2, "x" * 5000, 1), (3, "x" * 4999, 1), (4, None, 1)], "query_id long, qname string, ott_id int")
    found = resolve.match_names(odd, q, approximate=True)
    assert rows(found, "query_id", "ott_id", "stage") == [(0, 3, "synonym"), (2, 3, "exact"), (3, 3, "fuzzy")]


def test_fuzzy_matches_of_retired_names(spark, monkeypatch):
    from arbolith.plans import taxonomy

    sf = "/root/testdata/sf0.001"
    retired = taxonomy.store(spark, sf).deprecated.where("length(name) > 8").orderBy("name").first()
    typed = retired["name"][:-1] + "q"
    monkeypatch.setattr(taxonomy, "names", lambda spark, sf: spark.createDataFrame([(typed, typed)], "query_id string, qname string"))
    got = {(r["qname"], r["ott_id"], r["stage"], r["is_deprecated"]) for r in taxonomy.QUERIES["match_pipeline_retired"](spark, sf).collect()}
    assert (typed, retired["ott_id"], "fuzzy", True) in got


def test_answers_have_retired_names(spark, store):
    q = names(spark, "Old name", "Aster vetuss", "Aster albus")
    for answer in (services.v3_match_names(store, q, None, True, include_deprecated=True), services.v2_match_names(store, q, include_deprecated=True)):
        told = json.loads(answer.first()["json"])
        found = {m["search_string"]: m for r in told["results"] for m in r["matches"]}
        assert told["includes_deprecated_taxa"] is True and set(found) == {"old name", "aster vetuss", "aster albus"}
        taxon_ = found["old name"].get("taxon", found["old name"])
        assert taxon_["flags"] == ["DEPRECATED"] and "rank" not in taxon_ and "synonyms" not in taxon_ and taxon_["tax_sources"] == ["ncbi:5"]
        assert found["aster vetuss"]["is_approximate_match"] is True and found["aster vetuss"]["matched_name"] == "Aster vetus"
    old = json.loads(services.v1_context_query(store, query_string="Old name, Aster albus", include_deprecated=True).first()["json"])
    match = old["results"][0]["matches"][0]
    assert match["is_deprecated"] is True and match["ot:ottId"] == 500 and "is_synonym" not in match and old["includes_deprecated_ids"] is True
    assert "taxon" not in match and len(services.match_rows(store, resolve.match_names(store, q, None, True, False, True)).collect()) == 3


def test_first_completion_box(store):
    box = services.v1_autocomplete_box(store, "Aster")
    assert box.columns == ["nodeId", "ottId", "node_id", "ott_id", "name", "higher", "dubious"] and {r["ott_id"] for r in box.collect()} == {10, 11}


def test_a_reopened_store_keeps_its_contexts(spark, store, tmp_path):
    store.save(str(tmp_path / "s"))
    again = open_store(spark, str(tmp_path / "s")).with_metadata(author="x")
    assert rows(again.context_members) == rows(store.context_members) and again.metadata.first()["author"] == "x"


def test_load_options(spark, folder, tmp_path):
    with pytest.raises(ValueError):
        dumps.LoadOptions(preferred_edges=False)
    plain = dumps.load_dumps(spark, str(folder), dumps.LoadOptions(synonyms=False, aliases=False, deprecated=False, barriers=False, preferred_edges=False, preferred_index=False, source_index=False))
    assert not plain.synonyms.count() and not plain.aliases.count() and not plain.deprecated.count() and not plain.barriers.count()
    for name in ("pref_tree", "source_index"):
        with pytest.raises(ValueError):
            getattr(plain, name)
    plain.save(str(tmp_path / "p"))
    assert open_store(spark, str(tmp_path / "p"), plain.options).tree.count() == plain.tree.count()


def test_barrier_clades(store):
    found = {r["clade"]: r["root_ott_id"] for r in store.barriers.collect()}
    assert found == {"Fungi": 2, "Metazoa": 3}


def test_newick_texts_as_nodes(spark):
    trees_ = [(1, "((a_b:1,'it''s (x)':2.5)ab,c[note])root:0.1;"), (2, "(,(,));"), (3, "((a,b);"), (4, None), (5, "alone;"), (6, "(a b);"), (7, "")]
    got = {}
    for r in dumps.newick_nodes(spark.createDataFrame(trees_, "tree_id long, tree string")).collect():
        got.setdefault(r["tree_id"], {})[r["position"]] = (r["label"], r["parent_position"], r["length"])
    assert got[1] == {0: ("a b", 2, 1.0), 1: ("it's (x)", 2, 2.5), 2: ("ab", 4, None), 3: ("c", 4, None), 4: ("root", None, 0.1)}
    assert [got[2][k][1] for k in range(5)] == [4, 3, 3, 4, None] and got[5] == {0: ("alone", None, None)}
    assert not {3, 4, 6, 7} & set(got)


def test_additions_carry_the_derived_tables_on(spark, store):
    new = [{"ott_id": 950, "name": "Novum", "parent": 10, "tag": "n", "flags": ["hidden"]}, {"ott_id": 951, "name": "Novum primum", "parent_tag": "n", "rank": "species", "sources": ["zz:1"]}, {"ott_id": 952, "name": "Top", "parent": 805080}]
    for extra in ([], [{"ott_id": 999, "name": "Found", "parent": 952}]):  # the second is the lost parent of an orphan
        docs = spark.createDataFrame([(0, json.dumps({"id": "d", "taxa": new + extra}))], "doc_key long, body string").withColumn("loaded_at", F.current_timestamp())
        _ = store.tree, store.pref_tree, store.name_index, store.source_index
        grown, _ = additions.apply(store, docs)
        assert grown._carried("tree") == (not extra) and grown._carried("name_index")
        whole = Store(grown._taxa, store._synonyms, store._aliases, store._deprecated, None, store._roots)
        for name in additions.DERIVED:
            a, b = getattr(grown, name), getattr(whole, name)
            assert rows(a.select(b.columns)) == rows(b), name
        assert rows(grown.context_members) == rows(whole.context_members)
    kept, _ = additions.apply(store, docs, derive=False)
    assert rows(kept.tree) == rows(store.tree) and kept.taxa.count() == store.taxa.count() + 4


def test_newick_in_pieces_and_its_bound(spark, store, tmp_path):
    exports.write_newick(store, 805080, str(tmp_path / "n"))
    text = "".join(p.read_text().replace("\n", "") for p in sorted((tmp_path / "n").glob("part-*")))
    assert text == trees.newick(store, 805080).first()["newick"]
    made = dumps.newick_nodes(spark.createDataFrame([(1, text)], "tree_id int, tree string"))
    assert made.count() == trees.descendants(store.pref_tree, 805080).count()
    with pytest.raises(ValueError):
        trees.newick(store, 805080, limit=3)
    with pytest.raises(ValueError):
        trees.induced_newick(store, spark.createDataFrame([(20,), (21,), (11,)], "ott_id long"), limit=2)
    with pytest.raises(Exception, match="too many"):
        trees.below_sets(store.tree, most=3).collect()


def test_beginnings_of_names(spark, store):
    index = resolve.index_of(store)
    asked = resolve.prepared(names(spark, "Ast", "aster a", "as", "Aster albus x" * 500, "aster a"))
    got = {(r["query_id"], r["name"]) for r in resolve.prefix(asked, index).collect()}
    want = {(k, r["name"]) for k, q in ((0, "ast"), (1, "aster a"), (4, "aster a")) for r in index.collect() if r["key_lc"].startswith(q)}
    assert got == want


#: Formats of labels, and taxon 7 in them.
WIDE = {"original_name": "T 7", "id": "7", "name_and_id": "T_7_ott7", "name": "T_7"}


@pytest.mark.parametrize("label_format", WIDE)
def test_newick_of_more_taxa_than_one_task_joins(spark, label_format):
    n, width = 50_001, 250  # taxon 1 has 250 children, all others stand below these
    above = F.when(F.col("ott_id") == 1, F.array().cast("array<long>")).when(F.col("ott_id") <= width + 1, F.array(F.lit(1).cast("long"))).otherwise(F.array(F.lit(1).cast("long"), F.col("ott_id") % width + 2))
    taxa = spark.range(1, n + 1).select(F.col("id").alias("ott_id"), F.concat(F.lit("T "), F.col("id").cast("string")).alias("name"))
    wide = SimpleNamespace(taxa=taxa, pref_tree=taxa.select("ott_id", F.concat(above, F.array("ott_id")).alias("path")), spark=spark)
    label = lambda i: WIDE[label_format].replace("7", str(i))
    below = {k: [] for k in range(2, width + 2)}
    for i in range(width + 2, n + 1):
        below[i % width + 2].append(label(i))
    want = "(" + ",".join(f"({','.join(leaves)}){label(k)}" for k, leaves in below.items()) + f"){label(1)};"
    assert [tuple(r) for r in trees.newick(wide, 1, label_format).collect()] == [(1, want)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_beginnings_are_not_sent_through_the_driver(spark, store):
    index, asked = resolve.index_of(store), resolve.prepared(names(spark, "Ast", "aster a"))
    assert "BroadcastExchange" not in plan(resolve.prefix(asked, index))
    sent = resolve.prefix(asked, index, few=True)
    assert plan(sent).count("BroadcastExchange") == 2 and rows(sent) == rows(resolve.prefix(asked, index))


def test_completion_sends_neither_taxa_nor_many_queries_through_the_driver(spark, store, monkeypatch):
    asked = names(spark, "Aster al", "Aster", "Ast", "Fungi", "Weisse Aster", "Aster albsu")
    want, plans, write = rows(resolve.autocomplete(store, asked)), [], resolve.materialize
    monkeypatch.setattr(resolve, "FEW_QUERIES", 0)
    monkeypatch.setattr(resolve, "materialize", lambda df: (plans.append(plan(df)), write(df))[1])
    many = resolve.autocomplete(store, asked)
    assert rows(many) == want and len(plans) == 6 and not any("BroadcastExchange" in p for p in [*plans, plan(many)])


def test_completion_by_genus_joins_on_beginnings(spark, monkeypatch):
    taxa = [(1, None, "life", "no rank"), (2, 1, "Genus", "genus"), (3, 1, "Other", "genus"), (4, 2, "Genus", "species"), (5, 2, "Genusx", "species"), (6, 3, "Other ab", "species")]
    taxa += [(10 + i, 2, f"Genus {s}", "species") for i, s in enumerate(["ab", "abc", "Abc", "b", "éa", "ab"])]
    made = Store(*[spark.createDataFrame(r, c) for r, c in (([(*t, "", "", []) for t in taxa], schema.TAXA_RAW), ([], schema.SYNONYMS_RAW), ([], schema.ALIASES_RAW), ([], schema.DEPRECATED_RAW))])
    asked = names(spark, "genus a", "Genus A", "genus ", "Genus é", "Genus abcd", "Other a", "None a")
    plans, write = [], resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df: (plans.append(plan(df)), write(df))[1])
    found = rows(resolve.autocomplete(made, asked).where("stage = 2"), "query_id", "ott_id")
    assert found == [(0, 10), (0, 11), (0, 15), (1, 12), *[(2, i) for i in (5, *range(10, 16))], (3, 14), (5, 6)]
    # A query meets its hits, not every species of its genus.
    assert not any("StartsWith" in p for p in plans)


def test_completion_seeks_similar_names_once(spark, store):
    texts = ("Aster al", "Aster albsu", "Aster", "Fungo", "Alpen", "Weisse Aster", "Aster vir", "qq qq")
    whole = resolve.autocomplete(store, names(spark, *texts))
    sought = lambda df: plan(df).split("== Physical Plan ==")[-1].lower().count("levenshtein(")
    own = {}
    for blank in (True, False):
        # Queries of one sort are answered as among others, and the other sort's work isn't planned.
        part = resolve.autocomplete(store, names(spark, *texts).where(F.col("qname").contains(" ") == blank))
        own[blank] = sought(part)
        assert rows(part) == rows(whole.where(F.col("query_id").isin([i for i, t in enumerate(texts) if (" " in t) == blank])))
    assert own[True] == own[False] > 0 and sought(whole) == 2 * own[True]
    assert sought(whole.where("stage = 2")) == 0


def test_cut_paths_are_those_of_the_edges_left(spark):
    edges = [(1, None), (2, 1), (3, 2), (4, 3), (5, 2), (6, 1), (7, 99), (8, 7), (9, 8)]
    taxa = spark.createDataFrame([(i, p, f"n{i}", "", "", "", ["hidden"] if i in (1, 3, 4, 5, 7, 8) else []) for i, p in edges], schema.TAXA_RAW)
    empty = (spark.createDataFrame([], t) for t in (schema.SYNONYMS_RAW, schema.ALIASES_RAW, schema.DEPRECATED_RAW))
    made = Store(taxa, *empty)
    whole = made._paths(made.taxa.selectExpr("ott_id as id", "if(dubious, null, parent_ott_id) as parent"))
    assert rows(made.pref_tree.select(whole.columns)) == rows(whole)
