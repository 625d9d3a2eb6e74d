"""Name resolution: exact, generic, synonym, deprecated and fuzzy matches, contexts, completion.

Names come as a DataFrame (query_id, qname) of any size; every stage is a join with the name index
and passes on what it didn't match. Fuzzy candidates come from equal segments of the names, so
that no pair is compared that can't match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbolith import schema
from arbolith.functions import taxon
from arbolith.operators import tree as trees
from arbolith.runtime import materialize

#: Columns of a match. ``ott_id`` of a deprecated match is the retired id.
MATCH = ("query_id", "search_string", "matched_name", "ott_id", "rank", "stage", "is_synonym", "is_approximate", "is_deprecated", "score")


def prepared(names: DataFrame) -> DataFrame:
    """(query_id, q): names in lower case; null names are left out."""
    return names.where("qname is not null").select("query_id", F.lower("qname").alias("q")).distinct()


def index_of(store, context: str | None = None, include_suppressed: bool = False, kind: str | None = None, rank_class: str | None = None) -> DataFrame:
    """The name index as one of its predicates: kind (taxon, synonym), rank class (specific, genus,
    higher: all that isn't specific), preferred taxa only or all, members of a context or all."""
    rows = store.name_index
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if rank_class == "higher":
        rows = rows.where("rank_class <> 'specific'")
    elif rank_class:
        rows = rows.where(F.col("rank_class") == rank_class)
    if not include_suppressed:
        rows = rows.where("not dubious")
    if context is not None and context != schema.ALL_LIFE:
        rows = rows.join(store.context_members.where(F.col("context") == context).select("ott_id"), "ott_id", "left_semi")
    return rows


def find_context(store, name: str | None) -> str | None:
    """The context of that name, whatever its case; None for a blank one; an unknown one is an error."""
    if name is None or not name.strip():
        return None
    for row in schema.CONTEXTS:
        if row[1].lower() == name.strip().lower():
            return row[1]
    raise ValueError(f"unknown context: {name}")


def _matches(hits: DataFrame, stage: str, synonym: Column | bool, score: Column | float, approximate: bool = False, deprecated: bool = False) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return hits.select(
        "query_id", F.col("q").alias("search_string"), F.col("name").alias("matched_name"), "ott_id", "rank", F.lit(stage).alias("stage"),
        lit(synonym).alias("is_synonym"), F.lit(approximate).alias("is_approximate"), F.lit(deprecated).alias("is_deprecated"), lit(score).cast("double").alias("score"),
    ).distinct()


def exact(queries: DataFrame, index: DataFrame) -> DataFrame:
    """All taxa whose name is the query, homonyms included."""
    hits = queries.join(index.where("kind = 'taxon'"), queries["q"] == index["key_lc"])
    return _matches(hits, "exact", False, 1.0)


def generic(queries: DataFrame, index: DataFrame) -> DataFrame:
    """For queries that end in sp. or sp: all taxa whose name is what stands before it."""
    last = F.element_at(F.split(F.trim("q"), r"\s+"), -1)
    short = queries.where(last.isin("sp.", "sp")).withColumn("head", F.trim(F.regexp_replace("q", r"\s*sp\.?\s*$", ""))).where("head <> ''")
    hits = short.join(index.where("kind = 'taxon'"), short["head"] == index["key_lc"])
    return _matches(hits, "generic", False, 0.99)


def by_synonym(queries: DataFrame, index: DataFrame) -> DataFrame:
    """All taxa that have the query as a synonym."""
    hits = queries.join(index.where("kind = 'synonym'"), queries["q"] == index["key_lc"])
    return _matches(hits, "synonym", True, 1.0)


def deprecated(queries: DataFrame, retired: DataFrame) -> DataFrame:
    """Retired ids whose name is the query."""
    hits = queries.join(retired.select("name", "name_lc", "ott_id", F.lit("").alias("rank")), F.col("q") == F.col("name_lc"))
    return _matches(hits, "deprecated", False, 1.0, deprecated=True)


def _key_segments(keys: DataFrame) -> DataFrame:
    """(key_lc, key_signs, m, size, part, piece): for each number of edits m the m + 1 even segments of every key."""
    # As text: one expression instead of hundreds of calls.
    size = "length(key_lc)"
    piece = (
        "named_struct('m', {m}, 'size', {size}, 'part', {k}, 'piece', substring(key_lc, int(floor({size} * {k} / {n})) + 1, int(floor({size} * ({k} + 1) / {n})) - int(floor({size} * {k} / {n}))))"
    )
    pieces = ", ".join(piece.format(m=m, n=m + 1, k=k, size=size) for m in (1, 2, 3, 4) for k in range(m + 1))
    return keys.selectExpr("key_lc", "key_signs", f"inline(array({pieces}))")


def _query_segments(queries: DataFrame) -> DataFrame:
    """(q, q_signs, m, size, part, piece): where the segments of a key of each possible size can stand in the query.

    With k edits before a segment and m - k behind it at most, it stands at most k places off its
    own from the left and m - k from the right; that leaves few places for each.
    """
    sized = queries.select("q", "q_signs", F.length("q").alias("n"), taxon.max_edits(F.length("q")).alias("m"))
    sized = sized.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - F.col("m")), F.col("n") + F.col("m"))))
    parts = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m"))))
    start = F.floor(F.col("size") * F.col("part") / (F.col("m") + 1)).cast("int")
    end = F.floor(F.col("size") * (F.col("part") + 1) / (F.col("m") + 1)).cast("int")
    parts = parts.withColumn("p", start).withColumn("l", end - start).withColumn("right", F.col("p") - F.col("size") + F.col("n")).withColumn("after", F.col("m") - F.col("part"))
    lo = F.greatest(F.lit(0), F.col("p") - F.col("part"), F.col("right") - F.col("after"))
    hi = F.least(F.col("n") - F.col("l"), F.col("p") + F.col("part"), F.col("right") + F.col("after"))
    ranged = parts.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    return ranged.withColumn("at", F.explode(F.sequence("lo", "hi"))).select("q", "q_signs", "m", "size", "part", F.substring("q", F.col("at") + 1, F.col("l")).alias("piece"))


def similar(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(q, key_lc, distance) of all pairs of distinct texts that are similar enough by ``taxon.fuzzy_accepts``.

    Of the m + 1 segments of a key one stands unchanged in any text within m edits, so pairs are
    joined on segments, by size, number and text, and only those are compared. A key gives 14 rows,
    a query some dozens, whatever the other side holds. Empty texts match nothing.
    """
    q = queries.select("q").distinct().where(F.length("q") > 1)
    k = keys.select("key_lc").distinct().where("key_lc <> ''")
    # Segments outgrow the planner's estimate of either side, so neither may be broadcast by it; and the
    # shuffle spreads the pairs over tasks where few queries would sit in one. A hot piece's rows of both
    # sides are split by the sort-merge join's handling of skew.
    near = _query_segments(q.withColumn("q_signs", _signs(F.col("q")))).join(_key_segments(k.withColumn("key_signs", _signs(F.col("key_lc")))).hint("merge"), ["m", "size", "part", "piece"])
    # An edit changes two signs at most, and most pairs that share a piece differ in more.
    near = near.where(F.bit_count(F.col("q_signs").bitwiseXOR(F.col("key_signs"))) <= 2 * F.col("m"))
    # Measured where they meet: a pair that meets twice is cheaper measured twice than moved once.
    # The generator keeps the distance from being worked out once for each use.
    measured = near.select("q", "key_lc", F.explode(F.array(F.levenshtein("q", "key_lc", 4))).alias("distance")).where("distance >= 0")
    return measured.where(taxon.fuzzy_accepts(F.col("distance"), F.col("q"), F.col("key_lc"))).select("q", "key_lc", "distance").distinct()


def _signs(text: Column) -> Column:
    """The signs that stand in a text, as bits by their code modulo 63."""
    signs = F.array_distinct(F.transform(F.split(text, ""), lambda c: F.ascii(c) % 63))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))


def fuzzy(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Taxa and synonyms whose name is similar to the query, with the base score."""
    close = similar(queries, index)
    hits = queries.join(close, "q").join(index, "key_lc")
    return _matches(hits, "fuzzy", F.col("kind") == "synonym", taxon.fuzzy_score(F.col("q"), F.col("name")), approximate=True)


def fuzzy_deprecated(queries: DataFrame, retired: DataFrame) -> DataFrame:
    keyed = retired.select(F.col("name_lc").alias("key_lc"), "name", "ott_id", F.lit("").alias("rank"))
    hits = queries.join(similar(queries, keyed), "q").join(keyed, "key_lc")
    return _matches(hits, "fuzzy", False, taxon.fuzzy_score(F.col("q"), F.col("name")), approximate=True, deprecated=True)


def weighted(matches: DataFrame, store, clade_id: int | None, compat: bool = False) -> DataFrame:
    """Fuzzy scores weighted down for taxa outside the inferred clade, by the distance to it."""
    if clade_id is None:
        return matches
    pairs = matches.where("is_approximate").select(F.col("ott_id").alias("id_a"), F.lit(clade_id).cast("long").alias("id_b"))
    far = trees.internodal_distance(store.pref_tree, pairs).select(F.col("id_a").alias("ott_id"), F.col("compat_dist").alias("d"))
    outside = store.pref_tree.where(~F.array_contains("path", F.lit(clade_id).cast("long"))).select("ott_id").withColumn("out", F.lit(True))
    factor = F.when(F.col("is_approximate") & F.col("out"), taxon.distance_factor(F.coalesce("d", F.lit(1)), compat)).otherwise(1.0)
    return matches.join(far, "ott_id", "left").join(outside, "ott_id", "left").withColumn("score", F.col("score") * factor).select(*MATCH)


def unique_hits(queries: DataFrame, store, include_suppressed: bool = False) -> DataFrame:
    """(query_id, q, n_hits, ott_id): how many taxa bear each query as their name, and the one if it is one."""
    index = index_of(store, None, include_suppressed, "taxon").select("key_lc", "ott_id").distinct()
    hits = queries.join(index, queries["q"] == index["key_lc"], "left")
    return hits.groupBy("query_id", "q").agg(F.count("ott_id").alias("n_hits"), F.min("ott_id").alias("first_id")).withColumn("ott_id", F.when(F.col("n_hits") == 1, F.col("first_id"))).drop("first_id")


def infer_context(store, names: DataFrame, include_suppressed: bool = False) -> DataFrame:
    """One row (context_name, context_ott_id, clade_ott_id, n_unique, n_ambiguous).

    Names of exactly one taxon span a clade, whose least context is the answer; without such
    names, or without a context there, it is all life.
    """
    hits = unique_hits(prepared(names), store, include_suppressed)
    counts = hits.agg(F.count_if(F.col("n_hits") == 1).alias("n_unique"), F.count_if(F.col("n_hits") != 1).alias("n_ambiguous"))
    sets = hits.where("ott_id is not null").select(F.lit(0).alias("set_id"), "ott_id")
    clade = trees.mrca(store.pref_tree, sets).select(F.col("mrca").alias("ott_id"))
    found = clade.join(store.least_contexts, "ott_id", "left").select(F.col("ott_id").alias("clade_ott_id"), "least_context")
    # Both sides have one row at most.
    joined = counts.withColumn("k", F.lit(0)).join(found.withColumn("k", F.lit(0)), "k", "left").withColumn("context_name", F.coalesce("least_context", F.lit(schema.ALL_LIFE)))
    roots = F.broadcast(store.contexts.select(F.col("name").alias("context_name"), F.col("root_ott_id").alias("context_ott_id")))
    return joined.join(roots, "context_name", "left").select("context_name", "context_ott_id", F.coalesce("clade_ott_id", F.lit(schema.ROOT_ID).cast("long")).alias("clade_ott_id"), "n_unique", "n_ambiguous")


def ambiguous_names(store, names: DataFrame, include_suppressed: bool = False) -> DataFrame:
    """(query_id, qname) of names that are no taxon's or several taxa's."""
    open_ = unique_hits(prepared(names), store, include_suppressed).where("n_hits <> 1").select("query_id")
    return names.join(open_, "query_id", "left_semi").select("query_id", "qname")


def match_names(
    store, names: DataFrame, context: str | None = None, approximate: bool = False, include_suppressed: bool = False,
    include_deprecated: bool = False, compat: bool = False, apply_inferred: bool = False,
) -> DataFrame:
    """All matches (MATCH) of names (query_id, qname), by stages.

    Exact and generic matches of all homonyms; synonyms for every name in addition; fuzzy matches
    for names without any. Without a context all life is searched and the clade of the unique names
    weights the fuzzy scores; ``apply_inferred`` searches the inferred context only. ``compat``
    keeps the plain weights, infinite ones included. Null names match nothing.
    """
    queries = materialize(prepared(names))
    context = find_context(store, context)
    clade = None
    if context is None and (approximate or apply_inferred):
        guess = infer_context(store, names, include_suppressed).first()
        clade = guess["clade_ott_id"]
        if apply_inferred:
            context = guess["context_name"]
    index = index_of(store, context, include_suppressed)
    if approximate:
        index = materialize(index)
    first = exact(queries, index)
    rest = queries.join(first.select("query_id"), "query_id", "left_anti")
    second = generic(rest, index)
    found = [first, second]
    if include_deprecated:
        left = rest.join(second.select("query_id"), "query_id", "left_anti")
        found.append(deprecated(left, store.deprecated))
    found.append(by_synonym(queries, index))
    out = reduce(DataFrame.unionByName, found)
    if not approximate:
        return out.select(*MATCH)
    out = materialize(out)
    open_ = materialize(queries.join(out.select("query_id").distinct(), "query_id", "left_anti"))
    close = fuzzy(open_, index)
    if include_deprecated:
        close = close.unionByName(fuzzy_deprecated(open_, store.deprecated))
    return out.unionByName(weighted(close.where("score >= 0"), store, clade, compat)).select(*MATCH)


def summary(names: DataFrame, matches: DataFrame) -> DataFrame:
    """(query_id, qname, matched, unambiguous) of every name; unambiguous: it has an exact match, homonyms included."""
    seen = matches.groupBy("query_id").agg(F.bool_or((F.col("stage").isin("exact", "deprecated")) & ~F.col("is_approximate")).alias("direct"))
    out = names.join(seen, "query_id", "left")
    return out.select("query_id", "qname", F.col("direct").isNotNull().alias("matched"), F.coalesce("direct", F.lit(False)).alias("unambiguous"))


def single_match(matches: DataFrame) -> DataFrame:
    """The matches, or an error if a name has none or more than one when rows are read."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return matches.withColumn("ott_id", F.when(n == 1, F.col("ott_id")).otherwise(F.raise_error(F.lit("a name has more than one match"))))


def describe(matches: DataFrame, taxa: DataFrame) -> DataFrame:
    """(query_id, ott_id, description) in words."""
    known = taxa.select("ott_id", F.col("name").alias("own_name"), taxon.unique_name(F.col("uniqname"), F.col("name")).alias("unique_name"))
    kind = F.when(F.col("is_synonym"), "synonym name").when(F.col("own_name") == F.col("unique_name"), "unique taxon name").otherwise("non-unique taxon name")
    text = F.format_string("%s match from search string '%s' to %s '%s'", F.when(F.col("is_approximate"), "Approximate").otherwise("Exact"), "search_string", kind, "matched_name")
    return matches.join(known, "ott_id", "left").select("query_id", "ott_id", text.alias("description"))


def find_taxa(store, names: DataFrame, context: str | None = None, include_suppressed: bool = True, synonyms: bool = False) -> DataFrame:
    """(query_id, ott_id, name) of taxa that bear a name, as their own or, if asked for, as a synonym."""
    index = index_of(store, find_context(store, context), include_suppressed, None if synonyms else "taxon")
    queries = prepared(names)
    return queries.join(index, queries["q"] == index["key_lc"]).select("query_id", "ott_id", "name").distinct()


# --- completion


#: Queries that are sent to every task; more are shuffled.
FEW_QUERIES = 1000


def prefix(queries: DataFrame, index: DataFrame, least: int = 3, few: bool = False) -> DataFrame:
    """Index rows whose key starts with the query; queries shorter than ``least`` have none.

    Every key gives its beginnings, and those that are a query are kept: what meets is a hit. Of
    queries asked for by many ids, and of keys of many rows, one each is joined.

    The planner takes a table of beginnings to be as large as that of the keys, and a written table
    as large as its packed files; the merge hints keep it from sending either through the driver.
    ``few`` tells that the queries are ``FEW_QUERIES`` at most, which are sent instead.
    """
    way = "broadcast" if few else "merge"
    asked = queries.where(F.length("q") >= least)
    keys = index.select("key_lc").distinct().where(F.length("key_lc") >= least)
    begun = keys.withColumn("q", F.explode(F.transform(F.sequence(F.lit(least), F.length("key_lc")), lambda n: F.left("key_lc", n))))
    hits = begun.join(asked.select("q").distinct().hint(way), "q")
    return asked.hint(way).join(hits, "q").join(index.hint("merge"), "key_lc")


def _species_of_genus(store, spaced: DataFrame, index: DataFrame, include_suppressed: bool, way: str) -> DataFrame:
    """The queries with a species of the genus that is their first word, whose rest starts with theirs."""
    # Species by genus and the start of the rest of their name, case as it is stored. Every species under a genus asked for
    # gives the beginnings of its rest, as in ``prefix``: no query meets species that aren't its hits, be the genus ever so wide.
    word = spaced.select("query_id", F.split("q", r"\s+", 2)[0].alias("word"), F.trim(F.split("qname", r"\s+", 2)[1]).alias("rest"))
    genera = index.where("kind = 'taxon' and rank_class = 'genus'").select(F.col("key_lc").alias("word"), F.col("ott_id").alias("genus_ott_id"), F.col("name").alias("genus"))
    genera = genera.join(word.select("word").distinct().hint(way), "word", "left_semi")
    members = trees.genus_members(store.pref_tree, store.taxa)
    if not include_suppressed:
        members = members.join(store.taxa.where("not dubious").select("ott_id").hint("merge"), "ott_id", "left_semi")
    species = members.join(genera.hint("merge"), "genus_ott_id").join(store.taxa.select("ott_id", "name").hint("merge"), "ott_id")
    tail = F.substring(F.col("name"), F.length("genus") + 2, F.length("name"))
    species = species.where(F.length("name") > F.length("genus")).select("word", "ott_id", tail.alias("tail"))
    begun = species.select("word", "ott_id", F.explode(F.transform(F.sequence(F.lit(0), F.length("tail")), lambda n: F.left("tail", n))).alias("rest"))
    return word.hint(way).join(begun, ["word", "rest"])


def autocomplete(store, names: DataFrame, context: str | None = None, include_suppressed: bool = False, higher_first: bool = False) -> DataFrame:
    """(query_id, position, ott_id, unique_name, is_higher, is_suppressed, stage): the first stage that finds something.

    With a blank in the query: species and synonyms of that name; else, if the first word is a
    genus, its species whose rest starts with the query's; else higher taxa of that name; else
    names that start with it; else similar names. Without: higher taxa and synonyms of that name;
    higher taxa that start with it; synonyms that do; similar names of higher taxa. Each taxon
    comes once per query, in the order of unique names, then ids.
    """
    asked = materialize(names.where("qname is not null").select("query_id", "qname", F.lower("qname").alias("q"), F.col("qname").contains(" ").alias("spaced")).distinct())
    index = materialize(index_of(store, find_context(store, context), include_suppressed))
    spaced, plain = asked.where("spaced"), asked.where("not spaced")
    # Neither the taxa nor many queries may go through the driver, small as their packed files are.
    count = {r["spaced"]: r["count"] for r in asked.groupBy("spaced").count().collect()}
    few = sum(count.values()) <= FEW_QUERIES
    way = "broadcast" if few else "merge"
    same = lambda q, rows: q.hint(way).join(rows, q["q"] == rows["key_lc"])
    stage = lambda rows, n: rows.select("query_id", F.lit(n).alias("stage"), "ott_id")
    higher = index.where("rank_class <> 'specific'")
    # What only the other sort of queries needs is neither planned nor run.
    any_spaced, any_plain = True in count, True not in count or False in count
    first = lambda rows: rows.join(rows.groupBy("query_id").agg(F.min("stage").alias("stage")).hint(way), ["query_id", "stage"])
    found = [stage(same(plain, higher), 1)] if any_plain else []
    if any_spaced:
        found.append(stage(same(spaced, index.where("(kind = 'taxon' and rank_class = 'specific') or kind = 'synonym'")), 1))
        found.append(stage(_species_of_genus(store, spaced, index, include_suppressed, way), 2))
        found.append(stage(same(spaced, index.where("kind = 'taxon' and rank_class <> 'specific'")), 3))
    # Each further step is taken for the queries that are still open.
    early = materialize(reduce(DataFrame.unionByName, found).distinct())
    left = materialize(asked.join(early.select("query_id").distinct().hint(way), "query_id", "left_anti"))
    spaced, plain = left.where("spaced"), left.where("not spaced")
    begun = [stage(prefix(spaced, index, few=few), 4)] if any_spaced else []
    if any_plain:
        begun.append(stage(prefix(plain, higher.where("kind = 'taxon'"), few=few), 4))
        begun.append(stage(prefix(plain, index.where("kind = 'synonym'"), few=few), 5))
    middle = materialize(reduce(DataFrame.unionByName, begun).distinct())
    open_ = materialize(left.join(middle.select("query_id").distinct().hint(way), "query_id", "left_anti"))
    late = []
    for part, rows in ([(open_.where("spaced"), index)] if any_spaced else []) + ([(open_.where("not spaced"), higher)] if any_plain else []):
        close = similar(part, rows)
        late.append(stage(part.hint(way).join(close, "q").join(rows.hint("merge"), "key_lc"), 6))
    # A query has rows of one of the three steps only, so the first stage is sought within each; that of similar names is one.
    every = reduce(DataFrame.unionByName, [first(early), first(middle), *late])
    hits = every.distinct().join(store.taxa.hint("merge"), "ott_id")
    hits = hits.select("query_id", "stage", "ott_id", taxon.unique_name(F.col("uniqname"), F.col("name")).alias("unique_name"), taxon.is_higher(F.col("rank")).alias("is_higher"), F.col("dubious").alias("is_suppressed"))
    order = [F.desc("is_higher")] if higher_first else []
    # A query's rows are of one stage; with it in the window a question for some stages leaves the others undone.
    place = F.row_number().over(Window.partitionBy("query_id", "stage").orderBy(*order, "unique_name", "ott_id")) - 1
    return hits.withColumn("position", place)


# --- lookups by id


def lookup_ids(store, ids: DataFrame) -> DataFrame:
    """(asked_id, ott_id, status) of ids: live, alias (with the id it stands for), deprecated or unknown.

    A live id goes before an alias, an alias before a retired id; of several ids an alias stands
    for, the smallest counts.
    """
    asked = ids.select(F.col("ott_id").alias("asked_id")).distinct()
    live = store.taxa.select(F.col("ott_id").alias("asked_id"), F.col("ott_id").alias("live_id")).distinct()
    forward = store.aliases.join(store.taxa.select("ott_id").distinct(), "ott_id", "left_semi").groupBy(F.col("alias_id").alias("asked_id")).agg(F.min("ott_id").alias("alias_for"))
    retired = store.deprecated.select(F.col("ott_id").alias("asked_id")).distinct().withColumn("retired", F.lit(True))
    out = asked.join(live, "asked_id", "left").join(forward, "asked_id", "left").join(retired, "asked_id", "left")
    status = F.when(F.col("live_id").isNotNull(), "live").when(F.col("alias_for").isNotNull(), "alias").when(F.col("retired"), "deprecated").otherwise("unknown")
    found = F.coalesce("live_id", "alias_for", F.when(F.col("retired"), F.col("asked_id")))
    return out.select("asked_id", found.alias("ott_id"), status.alias("status"))


def lookup_sources(store, sources: DataFrame) -> DataFrame:
    """(source_id, ott_id) of the taxa that have a source id; none for an unknown one."""
    return sources.select("source_id").distinct().join(store.source_index, "source_id")


def synonyms_by_taxon(store) -> DataFrame:
    """(ott_id, synonyms): each taxon's distinct synonyms, sorted."""
    known = store.synonyms.join(store.taxa.select("ott_id").distinct(), "ott_id", "left_semi")
    return known.groupBy("ott_id").agg(F.array_sort(F.collect_set("name")).alias("synonyms"))


def flag_counts(store) -> DataFrame:
    """(flag, n_taxa) of every known flag, zero included."""
    counts = store.taxa.select(F.explode("flags").alias("flag"), "ott_id").distinct().groupBy("flag").agg(F.count("*").alias("n"))
    return schema.flags(store.spark).select(F.col("label").alias("flag")).join(counts, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("n_taxa"))


def count_flag(store, flag: str) -> DataFrame:
    """(flag, n_taxa) of one known flag; another one is an error."""
    if flag not in schema.FLAGS:
        raise ValueError(f"unknown flag: {flag}")
    return flag_counts(store).where(F.col("flag") == flag)
