"""The service surface: answers of three generations of the interface as nested columns or JSON.

Version 3 answers come from ``v3_*``; versions 2 and 1 rename and regroup their columns. Bad
arguments raise ``BadInput`` with the status that the interface would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith import schema
from arbolith.functions import taxon
from arbolith.operators import additions, resolve
from arbolith.operators import tree as trees
from arbolith.runtime import materialize


#: Taxa that the subtree of an answer may have; ``trees.newick`` itself has no bound.
MOST_TAXA = 50_000


class BadInput(ValueError):
    status = 400


def taxon_blobs(store) -> DataFrame:
    """(ott_id, taxon): the extended description of each taxon."""
    synonyms = resolve.synonyms_by_taxon(store)
    rows = store.taxa.join(synonyms, "ott_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "ott_id",
        F.struct(
            "ott_id", "name", F.when(F.col("rank") == "", "no rank").otherwise(F.col("rank")).alias("rank"), taxon.tax_sources(F.col("input_sources")).alias("tax_sources"),
            taxon.unique_name(F.col("uniqname"), F.col("name")).alias("unique_name"), F.col("dubious").alias("is_suppressed"),
            taxon.known_flags(F.col("flags")).alias("flags"), F.coalesce("synonyms", none).alias("synonyms"),
        ).alias("taxon"),
    )


def deprecated_blobs(store) -> DataFrame:
    """(ott_id, taxon) of retired ids, with their reason and source; suppressed, without synonyms."""
    none = F.array().cast("array<string>")
    first = store.deprecated.groupBy("ott_id").agg(F.min(F.struct("name", "reason", "source_info")).alias("d"))
    return first.select("ott_id", F.struct("ott_id", F.col("d.name").alias("name"), F.col("d.reason").alias("reason"), F.col("d.source_info").alias("input_sources"), F.array(F.lit("DEPRECATED")).alias("flags"), F.lit(True).alias("is_suppressed"), none.alias("synonyms")).alias("taxon"))


def about(store, old_weburl: str | None = None, weburl_prefix: str | None = None) -> DataFrame:
    """source, author, weburl, name, version."""
    name, version = taxon.version_parts(F.col("source"))
    url = taxon.version_weburl(F.col("weburl"), name, version, old_weburl, weburl_prefix)
    return store.metadata.select("source", "author", url.alias("weburl"), name.alias("name"), version.alias("version"))


def _ids(store, ids: list[int], need_all: bool) -> DataFrame:
    found = resolve.lookup_ids(store, store.spark.createDataFrame([(int(i),) for i in ids], "ott_id long"))
    if need_all:
        bad = [r["asked_id"] for r in found.where("status = 'unknown'").collect()]  # as many as were asked for
        if bad:
            raise BadInput(f"unknown ids: {sorted(bad)}")
    return found


def v3_subtree(store, ott_id: int, label_format: str = "name_and_id") -> DataFrame:
    if label_format not in schema.LABEL_FORMATS:
        raise BadInput(f"unknown label format: {label_format}")
    row = _ids(store, [ott_id], True).first()
    try:
        return trees.newick(store, row["ott_id"], label_format, MOST_TAXA).select("newick")
    except ValueError as error:
        raise BadInput(str(error)) from error


def v3_mrca(store, ott_ids: list[int], include_lineage: bool = False) -> DataFrame:
    if not ott_ids:
        raise BadInput("no ids")
    found = _ids(store, ott_ids, True)
    answer = trees.mrca(store.pref_tree, found.select(F.lit(0).alias("set_id"), "ott_id")).select(F.col("mrca").alias("ott_id"))
    return _described(store, answer, include_lineage, False, False).select(F.struct("taxon.*", *_extra_columns(include_lineage, False, False)).alias("mrca"))


def _extra_columns(lineage: bool, kids: bool, tips: bool) -> list[str]:
    return ["lineage"] * lineage + ["children"] * kids + ["terminal_descendants"] * tips


def _described(store, ids: DataFrame, lineage: bool, kids: bool, tips: bool) -> DataFrame:
    """(ott_id, taxon, ...) of live ids, with the lists asked for."""
    blobs = taxon_blobs(store)
    out = ids.select("ott_id").distinct().join(blobs, "ott_id")
    if lineage:
        up = trees.lineage(store.tree, ids).join(blobs.select(F.col("ott_id").alias("anc_id"), "taxon"), "anc_id")
        listed = up.groupBy("ott_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", F.struct("taxon.*").alias("taxon")))), lambda x: x["taxon"]).alias("lineage"))
        out = out.join(listed, "ott_id", "left").withColumn("lineage", F.coalesce("lineage", F.array().cast(listed.schema["lineage"].dataType)))
    if kids:
        down = trees.children(store.taxa, ids).select(F.col("ott_id").alias("child"), F.col("parent_ott_id").alias("ott_id")).join(blobs.select(F.col("ott_id").alias("child"), "taxon"), "child")
        listed = down.groupBy("ott_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("child", F.struct("taxon.*").alias("taxon")))), lambda x: x["taxon"]).alias("children"))
        out = out.join(listed, "ott_id", "left").withColumn("children", F.coalesce("children", F.array().cast(listed.schema["children"].dataType)))
    if tips:
        inside = store.pref_tree.where("n_below = 0").select(F.col("ott_id").alias("tip"), F.explode("path").alias("ott_id")).join(ids.select("ott_id").distinct(), "ott_id", "left_semi")
        listed = inside.groupBy("ott_id").agg(F.array_sort(F.collect_list("tip")).alias("terminal_descendants"))
        out = out.join(listed, "ott_id", "left")
    return out


def v3_taxon_info(store, ott_id: int | None = None, source_id: str | None = None, include_lineage: bool = False, include_children: bool = False, include_terminal_descendants: bool = False) -> DataFrame:
    if (ott_id is None) == (source_id is None):
        raise BadInput("give either an id or a source id")
    if source_id is not None:
        hits = resolve.lookup_sources(store, store.spark.createDataFrame([(source_id,)], "source_id string")).limit(2).collect()
        if len(hits) != 1:
            raise BadInput(f"{'unknown' if not hits else 'ambiguous'} source id: {source_id}")
        ott_id = hits[0]["ott_id"]
    row = _ids(store, [ott_id], True).first()
    one = store.spark.createDataFrame([(row["ott_id"],)], "ott_id long")
    if row["status"] == "deprecated":
        return deprecated_blobs(store).join(one, "ott_id", "left_semi").select("taxon.*")
    flags = (include_lineage, include_children, include_terminal_descendants)
    return _described(store, one, *flags).select("taxon.*", *_extra_columns(*flags))


def v3_flags(store) -> DataFrame:
    return resolve.flag_counts(store)


def v3_contexts(store) -> DataFrame:
    """(grp, contexts): names of the contexts of each group."""
    return store.contexts.groupBy("grp").agg(F.array_sort(F.collect_list("name")).alias("contexts"))


def v3_infer_context(store, names: DataFrame) -> DataFrame:
    guess = resolve.infer_context(store, names).select("context_name", "context_ott_id")
    open_ = resolve.ambiguous_names(store, names).agg(F.array_sort(F.collect_list("qname")).alias("ambiguous_names"))
    return guess.withColumn("k", F.lit(0)).join(open_.withColumn("k", F.lit(0)), "k").drop("k")  # a row each


def v3_autocomplete(store, name: str, context_name: str | None = None, include_suppressed: bool = False) -> DataFrame:
    names = store.spark.createDataFrame([(0, name)], "query_id long, qname string")
    try:
        hits = resolve.autocomplete(store, names, context_name, include_suppressed)
    except ValueError as error:
        raise BadInput(str(error)) from error
    return hits.orderBy("position").select("ott_id", "unique_name", "is_suppressed", "is_higher")


def _codes(store) -> DataFrame:
    """(ott_id, taxcode) by the barrier clades that are in the store."""
    return trees.taxcodes(store.tree, store.barriers.select("root_ott_id", "code"))


def _parent_names(store) -> DataFrame:
    """(ott_id, parent_name) of taxa with a parent that is there (the first by name, if several)."""
    up = store.taxa.select(F.col("ott_id").alias("parent_ott_id"), F.col("name").alias("parent_name"))
    return store.taxa.select("ott_id", "parent_ott_id").join(up, "parent_ott_id").groupBy("ott_id").agg(F.min("parent_name").alias("parent_name"))


def _retired_taxa(store, like: DataFrame) -> DataFrame:
    """(ott_id, taxon) of retired ids in the form of ``taxon_blobs``: name, sources and the flag DEPRECATED, nothing else."""
    first = store.deprecated.groupBy("ott_id").agg(F.min(F.struct("name", "source_info")).alias("d"))
    given = {"ott_id": F.col("ott_id"), "name": F.col("d.name"), "tax_sources": taxon.tax_sources(F.col("d.source_info")), "flags": F.array(F.lit("DEPRECATED"))}
    fields = like.schema["taxon"].dataType.fields
    return first.select("ott_id", F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).alias("taxon"))


def match_rows(store, matches: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """The matches (``resolve.MATCH``) with the taxon, nomenclature_code and parent_name of each, of retired ids too."""
    codes = _codes(store) if codes is None else codes
    blobs = taxon_blobs(store).select("ott_id", "taxon")
    live = matches.where("not is_deprecated").join(blobs, "ott_id").join(codes, "ott_id", "left").join(_parent_names(store), "ott_id", "left")
    gone = matches.where("is_deprecated").join(_retired_taxa(store, blobs), "ott_id")
    return live.unionByName(gone, allowMissingColumns=True).withColumn("nomenclature_code", F.coalesce("taxcode", F.lit(schema.NO_CODE))).drop("taxcode")


def _match_v3() -> Column:
    return F.struct(
        F.col("is_approximate").alias("is_approximate_match"), "search_string", "matched_name", "score", "is_synonym", "nomenclature_code", "taxon",
    )


def _match_v2() -> Column:
    t = F.col("taxon")
    return F.struct(
        F.col("is_approximate").alias("is_approximate_match"), F.col("ott_id").alias("matched_node_id"), "search_string", "matched_name", "score", "is_synonym", "nomenclature_code", "is_deprecated",
        t["name"].alias("ot:ottTaxonName"), F.col("ott_id").alias("ot:ottId"), t["tax_sources"].alias("tax_sources"), t["unique_name"].alias("unique_name"), t["rank"].alias("rank"),
        t["synonyms"].alias("synonyms"), t["is_suppressed"].alias("is_dubious"), t["flags"].alias("flags"),
    )


def _match_v1() -> Column:
    t, live = F.col("taxon"), ~F.col("is_deprecated")
    return F.struct(
        F.col("is_approximate").alias("is_approximate_match"), F.col("ott_id").alias("matched_node_id"), t["name"].alias("ot:ottTaxonName"), F.col("ott_id").alias("ot:ottId"), "search_string",
        "matched_name", "score", "is_deprecated", t["flags"].alias("flags"), t["unique_name"].alias("unique_name"), t["rank"].alias("rank"), F.when(live, F.col("nomenclature_code")).alias("nomenclature_code"),
        "parent_name", t["is_suppressed"].alias("dubious_name"), F.when(live, F.col("is_synonym")).alias("is_synonym"),
    )


_SHAPES = {3: _match_v3, 2: _match_v2, 1: _match_v1}


def match_results(store, names: DataFrame, matches: DataFrame, codes: DataFrame | None = None, version: int = 3) -> DataFrame:
    """(query_id, name, matches): one row per name with the list of its matches and their taxa, best first; retired ids have few fields."""
    rows = match_rows(store, matches, codes)
    order = F.struct((-F.col("score")).alias("s"), "ott_id", "matched_name", "is_approximate")
    listed = rows.select("query_id", F.struct(order.alias("o"), _SHAPES[version]().alias("m")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("x"))
    listed = listed.select("query_id", F.transform("x", lambda x: x["m"]).alias("matches"))
    return names.join(listed, "query_id").select("query_id", F.col("qname").alias("name"), "matches")


def _checked_names(names: DataFrame, most: int | None) -> None:
    if most is not None and names.limit(most + 1).count() > most:
        raise BadInput(f"more than {most} names")
    if names.groupBy("query_id").count().where("count > 1").limit(1).count():
        raise BadInput("an id stands for more than one name")


def _answer(store, names: DataFrame, context_name: str | None, approximate: bool, suppressed: bool, retired: bool, version: int) -> DataFrame:
    """One row (json): the whole answer to a batch of names in the form of that version."""
    try:
        context = resolve.find_context(store, context_name)
    except ValueError as error:
        raise BadInput(str(error)) from error
    matches = materialize(resolve.match_names(store, names, context, approximate, suppressed, retired))
    told = resolve.summary(names, matches)
    name, kind = ("qname", "names") if version == 3 else ("query_id", "name_ids")
    pick = lambda cond, to: F.array_sort(F.collect_list(F.when(cond, F.col(name)))).alias(f"{to}_{kind}")
    head = told.agg(pick(F.col("unambiguous"), "unambiguous"), pick(~F.col("matched"), "unmatched"), pick(F.col("matched"), "matched"))
    used = context or resolve.infer_context(store, names, suppressed).first()["context_name"]
    code = next(c[6] for c in schema.CONTEXTS if c[1] == used)
    own = "name" if version == 3 else "query_id"
    listed = match_results(store, names, matches, version=version).select("query_id", F.struct(F.col(own).alias("name" if version == 3 else "id"), "matches").alias("r"))
    results = listed.agg(F.array_sort(F.collect_list(F.struct("query_id", "r")), lambda a, b: F.when(a["query_id"] < b["query_id"], -1).when(a["query_id"] > b["query_id"], 1).otherwise(0)).alias("r"))
    results = results.select(F.transform("r", lambda r: r["r"]).alias("results"))
    source = about(store).first()
    taxonomy = F.struct(*[F.lit(source[c] if source else None).cast("string").alias(c) for c in ("source", "author", "weburl", "name", "version")])
    whole = head.withColumn("k", F.lit(0)).join(results.withColumn("k", F.lit(0)), "k")  # a row each
    return whole.select(
        F.to_json(
            F.struct(
                F.lit(code).alias("governing_code"), *[f"{x}_{kind}" for x in ("unambiguous", "unmatched", "matched")], F.lit(used).alias("context"),
                F.lit(retired).alias("includes_deprecated_ids" if version == 1 else "includes_deprecated_taxa"), F.lit(suppressed).alias("includes_suppressed_names" if version == 3 else "includes_dubious_names"),
                F.lit(approximate).alias("includes_approximate_matches"), taxonomy.alias("taxonomy"), "results",
            )
        ).alias("json")
    )


def v3_match_names(
    store, names: DataFrame, context_name: str | None = None, do_approximate_matching: bool = False, include_suppressed: bool = False, most: int | None = None, include_deprecated: bool = False,
) -> DataFrame:
    """One row of the whole answer as JSON for a batch of names (query_id, qname).

    ``most`` is the number of names above which the request is refused (the interface's own were
    10,000 without and 250 with fuzzy matching); None takes any. For large batches take the rows of
    ``match_results`` or ``match_rows``, which aren't gathered into one answer.
    """
    _checked_names(names, most)
    return _answer(store, names, context_name, do_approximate_matching, include_suppressed, include_deprecated, 3)


def v3_process_additions(store, document: str) -> tuple:
    """(store with the additions, judged rows); a taxon that can't be added is an error and adds nothing."""
    docs = store.spark.createDataFrame([(0, document)], "doc_key long, body string").withColumn("loaded_at", F.current_timestamp())
    grown, checked = additions.apply(store, docs)
    bad = checked.where("status in ('no_id', 'no_name', 'no_parent', 'bad_parent')").limit(1).collect()
    if bad:
        raise BadInput(f"{bad[0]['status']} at taxon {bad[0]['taxon_pos']}")
    return grown, checked


# --- version 2


def _v2_taxon(t: Column) -> list[Column]:
    return [
        t["unique_name"].alias("unique_name"), t["ott_id"].alias("node_id"), t["ott_id"].alias("ot:ottId"), t["name"].alias("ot:ottTaxonName"), t["rank"].alias("rank"),
        t["tax_sources"].alias("tax_sources"), t["flags"].alias("flags"), t["synonyms"].alias("synonyms"),
    ]


def v2_taxon(store, ott_id: int, include_lineage: bool = False, list_terminal_descendants: bool = False, include_children: bool = False) -> DataFrame:
    """As in version 3 under the names of version 2; an unknown id gives a row with ``error``."""
    row = _ids(store, [ott_id], False).first()
    if row["status"] == "unknown":
        return store.spark.createDataFrame([(f"unknown id: {ott_id}",)], "error string")
    one = store.spark.createDataFrame([(row["ott_id"],)], "ott_id long")
    if row["status"] == "deprecated":
        return deprecated_blobs(store).join(one, "ott_id", "left_semi").select(F.col("taxon.ott_id").alias("ot:ottId"), F.col("taxon.name").alias("ot:ottTaxonName"), "taxon.reason", "taxon.input_sources", "taxon.flags")
    out = _described(store, one, include_lineage, include_children, list_terminal_descendants)
    extra = [F.transform(c, lambda t: F.struct(*_v2_taxon(t))).alias(n) for c, n in (("lineage", "taxonomic_lineage"), ("children", "children")) if c in out.columns]
    return out.select(*_v2_taxon(F.col("taxon")), *extra, *(["terminal_descendants"] if list_terminal_descendants else []))


def v2_lica(store, ott_ids: list[int], include_lineage: bool = False) -> DataFrame:
    """(lica, ott_ids_not_found): unknown ids are told, not refused."""
    found = _ids(store, ott_ids, False)
    lost = sorted(r["asked_id"] for r in found.where("status = 'unknown'").collect())
    answer = trees.mrca(store.pref_tree, found.where("status <> 'unknown'").select(F.lit(0).alias("set_id"), "ott_id")).select(F.col("mrca").alias("ott_id"))
    out = _described(store, answer, include_lineage, False, False)
    extra = [F.transform("lineage", lambda t: F.struct(*_v2_taxon(t))).alias("taxonomic_lineage")] if include_lineage else []
    return out.select(F.struct(*_v2_taxon(F.col("taxon")), *extra).alias("lica"), F.array(*[F.lit(x) for x in lost]).cast("array<long>").alias("ott_ids_not_found"))


def v2_subtree(store, ott_id: int, label_format: str = "name_and_id") -> DataFrame:
    return v3_subtree(store, ott_id, label_format).withColumnRenamed("newick", "subtree")


def v2_deprecated_taxa(store) -> DataFrame:
    return deprecated_blobs(store).select(F.col("taxon.ott_id").alias("ot:ottId"), F.col("taxon.name").alias("ot:ottTaxonName"), "taxon.reason", F.col("taxon.input_sources").alias("source_info"))


def v2_match_names(store, names: DataFrame, context_name: str | None = None, do_approximate_matching: bool = True, include_dubious: bool = False, include_deprecated: bool = False, most: int | None = None) -> DataFrame:
    """One row of the whole answer as JSON; names go by their ids (query_id), matches carry the taxon's fields themselves; fuzzy unless told otherwise."""
    _checked_names(names, most)
    return _answer(store, names, context_name, do_approximate_matching, include_dubious, include_deprecated, 2)


def v2_autocomplete(store, name: str, context_name: str | None = None, include_dubious: bool = False) -> DataFrame:
    out = v3_autocomplete(store, name, context_name, include_dubious)
    return out.select(F.col("ott_id").alias("node_id"), F.col("ott_id").alias("ot:ottId"), "unique_name", "is_higher", F.col("is_suppressed").alias("is_dubious"))


# --- version 1


def v1_context_for_names(store, query_string: str) -> DataFrame:
    return v3_infer_context(store, _listed(store, query_string))


def _listed(store, query_string: str) -> DataFrame:
    """A comma-separated list as (query_id, qname), numbered from 0."""
    one = store.spark.createDataFrame([(query_string,)], "q string")
    return one.select(F.posexplode(taxon.comma_list(F.trim("q"))).alias("query_id", "qname")).withColumn("query_id", F.col("query_id").cast("long")).where("qname <> ''")


def v1_context_query(store, query_string: str | None = None, names: list[str] | None = None, ids: list | None = None, context_name: str | None = None, include_dubious: bool = False, include_deprecated: bool = False) -> DataFrame:
    """One row of the whole answer as JSON for names given as one string or a list, with ids of their own if given, each once; else they are numbered from 0."""
    if (query_string is None) == (names is None):
        raise BadInput("give either a query string or names")
    if names is None:
        asked = _listed(store, query_string)
    else:
        if ids is not None and (len(ids) != len(names) or len(set(map(str, ids))) != len(ids)):
            raise BadInput("ids must be as many as names and different")
        kind = "long" if ids is None else "string"
        given = range(len(names)) if ids is None else map(str, ids)
        asked = store.spark.createDataFrame(list(zip(given, names, strict=True)), f"query_id {kind}, qname string")
    return _answer(store, asked, context_name, True, include_dubious, include_deprecated, 1)


def v1_autocomplete_box(store, name: str, context_name: str | None = None) -> DataFrame:
    """nodeId and ottId stand beside node_id and ott_id for callers of old."""
    out = v3_autocomplete(store, name, context_name)
    ids = [F.col("ott_id").alias(c) for c in ("nodeId", "ottId", "node_id", "ott_id")]
    return out.select(*ids, F.col("unique_name").alias("name"), F.col("is_higher").alias("higher"), F.col("is_suppressed").alias("dubious"))


def v1_taxonomy_version(store) -> DataFrame:
    return store.metadata.select("source")


def v1_contexts(store) -> DataFrame:
    return v3_contexts(store)


def v1_taxon_info(store, ott_id: int, include_lineage: bool = False) -> DataFrame:
    return v2_taxon(store, ott_id, include_lineage)


def v1_flagged_count(store, flag: str) -> DataFrame:
    try:
        return resolve.count_flag(store, flag)
    except ValueError as error:
        raise BadInput(str(error)) from error


#: Methods of the interface by version and name.
ENDPOINTS = {
    "v3": {"about": about, "subtree": v3_subtree, "mrca": v3_mrca, "taxon_info": v3_taxon_info, "flags": v3_flags, "process_additions": v3_process_additions,
           "contexts": v3_contexts, "infer_context": v3_infer_context, "autocomplete_name": v3_autocomplete, "match_names": v3_match_names},
    "v2": {"about": about, "deprecated_taxa": v2_deprecated_taxa, "subtree": v2_subtree, "lica": v2_lica, "taxon": v2_taxon, "flags": v3_flags,
           "contexts": v3_contexts, "infer_context": v3_infer_context, "autocomplete_name": v2_autocomplete, "match_names": v2_match_names},
    "v1": {"getContextForNames": v1_context_for_names, "autocompleteBoxQuery": v1_autocomplete_box, "autocompleteQuery": v2_autocomplete, "contextQueryForNames": v1_context_query,
           "contextQuery": v1_context_query, "getTaxonomyVersion": v1_taxonomy_version, "getContextsJSON": v1_contexts, "getContexts": v1_contexts,
           "getTaxonomyInfo": about, "getDeprecatedTaxa": v2_deprecated_taxa, "getTaxonInfo": v1_taxon_info, "getFlaggedTaxonCount": v1_flagged_count},
}
