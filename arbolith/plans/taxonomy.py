"""Queries on the taxonomy of the test tables, one or more for each operator.

The store is made of canonical_names (the upper part, put under one root), taxa, synonyms,
forwards and deprecated; the names to resolve are those of tnrs_requests, the sets of taxa those
that addition documents refer to.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith import runtime, schema
from arbolith.functions import taxon
from arbolith.operators import additions, exports, resolve
from arbolith.operators import tree as trees
from arbolith.plans.records import _P6
from arbolith.sources import dumps
from arbolith.store import Store, open_store

_stores: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def store(spark: SparkSession, sf: str) -> Store:
    """The store of a folder; its derived tables are made once per session, like an index."""
    known = _stores.setdefault(spark, {})
    if sf not in known:
        t = lambda name: _table(spark, sf, name)
        cut = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
        none = F.array().cast("array<string>")
        root = spark.createDataFrame([(schema.ROOT_ID, None, schema.ROOT_NAME, "no rank", "", "", [])], schema.TAXA_RAW)
        upper = t("canonical_names").select(
            "ott_id", F.coalesce("parent", F.lit(schema.ROOT_ID)).alias("parent_ott_id"), "name", "rank", F.lit("").alias("input_sources"), F.lit("").alias("uniqname"), none.alias("flags")
        )
        lower = t("taxa").select("ott_id", F.col("parent").alias("parent_ott_id"), "name", "rank", F.col("sourceinfo").alias("input_sources"), "uniqname", cut("flags").alias("flags"))
        roots = t("canonical_names").where("parent is null").select(F.col("context_name").alias("name"), F.col("ott_id").alias("root_ott_id"))
        known[sf] = Store(
            root.unionByName(upper).unionByName(lower),
            t("synonyms").select("ott_id", "name", "source"),
            t("forwards").select("alias_id", "ott_id"),
            t("deprecated").select("ott_id", "name", "source_info", "reason"),
            spark.createDataFrame([("abc2.9draft12", "someone", "https://example.org/taxonomy")], schema.METADATA),
            roots,
        )
    return known[sf]


def names(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, qname): every distinct name typed, as it was typed but for blanks around it."""
    r = _table(spark, sf, "tnrs_requests")
    typed = r.select(F.explode("names").alias("n")).union(r.select(F.explode(F.split("query_string", ",")).alias("n")))
    clean = F.trim("n")
    return typed.where("n is not null").select(clean.alias("query_id"), clean.alias("qname")).where("qname <> ''").distinct()


def sets(spark: SparkSession, sf: str) -> DataFrame:
    """(set_id, ott_id): the taxa that each addition document names as parents."""
    return _table(spark, sf, "additions").where("parent is not null").select(F.col("addition_id").alias("set_id"), F.col("parent").alias("ott_id")).distinct()


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(id_a, id_b): the largest and the smallest parent of each document."""
    ends = sets(spark, sf).groupBy("set_id").agg(F.max("ott_id").alias("id_a"), F.min("ott_id").alias("id_b"))
    return ends.where("id_a <> id_b").select("id_a", "id_b").distinct()


def forwarded(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "forwards").select("ott_id").distinct()


def _listed(col: str) -> F.Column:
    return F.array_join(F.col(col).cast("array<string>"), ",")


QUERIES: dict = {}
ORACLE: dict = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = _WITH + sql
        return f

    return keep


# DuckDB measures levenshtein in bytes; no listed name has a sign beyond ASCII or a question mark, so one
# question mark for each such sign of a typed name (qb) leaves every distance as it is.
_SUPPRESS = "[" + ", ".join(f"'{f}'" for f in schema.SUPPRESSING) + "]"
_SPECIFIC = ", ".join(f"'{r}'" for r in schema.SPECIFIC_RANKS)
_WITH = f"""
with recursive base as (
  select cast({schema.ROOT_ID} as bigint) as ott_id, cast(null as bigint) as parent_ott_id, '{schema.ROOT_NAME}' as name, 'no rank' as rank, '' as input_sources, '' as uniqname, '' as flags
  union all select distinct ott_id, coalesce(parent, {schema.ROOT_ID}), name, rank, '', '', '' from canonical_names
  union all select distinct ott_id, parent, name, coalesce(rank, ''), coalesce(sourceinfo, ''), coalesce(uniqname, ''), coalesce(flags, '') from taxa),
tx as (
  select *, lower(name) as name_lc, list_has_any(string_split(flags, ','), {_SUPPRESS}) and not list_contains(string_split(flags, ','), 'forced_visible') as dubious,
    case when lower(rank) in ({_SPECIFIC}) then 'specific' when lower(rank) = 'genus' then 'genus' else 'higher' end as rank_class from base),
walk(ott_id, node, dist) as (
  select ott_id, ott_id, 0 from tx union all
  select w.ott_id, p.parent_ott_id, w.dist + 1 from walk w join tx p on p.ott_id = w.node join tx q on q.ott_id = p.parent_ott_id where w.dist < 60),
pwalk(ott_id, node, dist) as (
  select ott_id, ott_id, 0 from tx union all
  select w.ott_id, p.parent_ott_id, w.dist + 1 from pwalk w join tx p on p.ott_id = w.node join tx q on q.ott_id = p.parent_ott_id where not p.dubious and w.dist < 60),
pdepth as (select ott_id, max(dist) as depth, arg_max(node, dist) as root from pwalk group by ott_id),
tdepth as (select ott_id, max(dist) as depth, arg_max(node, dist) as root from walk group by ott_id),
syn as (select distinct ott_id, name, source, lower(name) as name_lc from synonyms),
ix as (
  select name_lc as key_lc, 'taxon' as kind, name, ott_id, rank, rank_class, dubious from tx where name is not null
  union select s.name_lc, 'synonym', s.name, s.ott_id, t.rank, t.rank_class, t.dubious from syn s join tx t on t.ott_id = s.ott_id),
dep as (select distinct ott_id, name, source_info, reason, lower(name) as name_lc from deprecated),
ali as (select distinct alias_id, ott_id from forwards),
fw as (select distinct ott_id from forwards),
typed as (select unnest(names) as n from tnrs_requests union all select unnest(string_split(query_string, ',')) from tnrs_requests),
qn as (select distinct trim(n) as qname from typed where n is not null),
qs as (select qname, lower(qname) as q, regexp_replace(lower(qname), '[^\\x20-\\x7e]', '?', 'g') as qb from qn where qname <> ''),
ctx as (
  select context_name as context, ott_id as root_id from canonical_names where parent is null union all select 'All life', {schema.ROOT_ID}),
st as (select distinct addition_id as set_id, parent as ott_id from additions where parent is not null),
prs as (select distinct max(ott_id) as id_a, min(ott_id) as id_b from st group by set_id having max(ott_id) <> min(ott_id)),
comp as (select s.set_id, d.root, count(*) as n from st s join pdepth d on d.ott_id = s.ott_id group by all),
based as (select set_id, root, n from comp qualify row_number() over (partition by set_id order by n desc, root) = 1),
shared as (
  select s.set_id, w.node, count(*) as n from st s join pdepth d on d.ott_id = s.ott_id join based b on b.set_id = s.set_id and b.root = d.root
  join pwalk w on w.ott_id = s.ott_id group by all),
lica as (select s.set_id, arg_max(s.node, d.depth) as mrca, max(b.n) as n_used from shared s join based b on b.set_id = s.set_id and b.n = s.n join pdepth d on d.ott_id = s.node group by s.set_id),
exactm as (select q.qname, i.ott_id, i.name, i.rank from qs q join ix i on i.key_lc = q.q where i.kind = 'taxon' and not i.dubious),
shorts as (
  select qname, q, trim(regexp_replace(q, '\\s*sp\\.?\\s*$', '')) as head from qs
  where regexp_matches(q, '(^|\\s)sp\\.?$') and qname not in (select qname from exactm)),
genericm as (select s.qname, i.ott_id, i.name, i.rank from shorts s join ix i on i.key_lc = s.head where s.head <> '' and i.kind = 'taxon' and not i.dubious),
depm as (
  select q.qname, d.ott_id, d.name from qs q join dep d on d.name_lc = q.q where q.qname not in (select qname from exactm) and q.qname not in (select qname from genericm)),
synm as (select distinct q.qname, i.ott_id, i.name, i.rank from qs q join ix i on i.key_lc = q.q where i.kind = 'synonym' and not i.dubious),
openq as (
  select qname, q, qb, case when length(q) < 9 then 1 when length(q) < 14 then 2 when length(q) < 19 then 3 else 4 end as m from qs
  where qname not in (select qname from exactm union select qname from genericm union select qname from synm)),
near as (
  select o.qname, o.q, i.kind, i.name, i.ott_id, i.rank, levenshtein(o.qb, i.key_lc) as d, (least(length(o.q), length(i.name)) - levenshtein(o.qb, i.name)) / cast(least(length(o.q), length(i.name)) as double) as score
  from openq o join ix i on abs(length(o.q) - length(i.key_lc)) <= o.m
  where length(o.q) > 1 and not i.dubious and levenshtein(o.qb, i.key_lc) * length(o.q) < (o.m + 1) * least(length(o.q), length(i.key_lc)))
"""


@_query("select ott_id, parent_ott_id, name, rank, rank_class, coalesce(nullif(uniqname, ''), name) as unique_name, dubious from tx")
def taxa_scan(spark, sf):
    return store(spark, sf).taxa.select("ott_id", "parent_ott_id", "name", "rank", "rank_class", taxon.unique_name(F.col("uniqname"), F.col("name")).alias("unique_name"), "dubious")


@_query("select dubious, count(*) as n from tx group by dubious")
def dubious_flag(spark, sf):
    return store(spark, sf).taxa.groupBy("dubious").agg(F.count("*").alias("n"))


@_query(
    "select l.flag, count(distinct f.ott_id) as n_taxa from (select unnest([" + ", ".join(f"'{f}'" for f in schema.FLAGS) + "]) as flag) l "
    "left join (select ott_id, unnest(string_split(flags, ',')) as flag from tx) f on f.flag = l.flag group by l.flag"
)
def flag_counts(spark, sf):
    return resolve.flag_counts(store(spark, sf))


@_query("select 'extinct' as flag, count(*) as n_taxa from tx where list_contains(string_split(flags, ','), 'extinct')")
def count_one_flag(spark, sf):
    return resolve.count_flag(store(spark, sf), "extinct")


_SOURCES = "select distinct s as source_id, ott_id from (select ott_id, unnest(string_split(input_sources, ',')) as s from tx) where contains(s, ':') and not ends_with(s, ':') and not starts_with(s, 'http')"


@_query(_SOURCES)
def source_ids(spark, sf):
    return store(spark, sf).source_index.select("source_id", "ott_id")


@_query(f"select b.source_id, b.ott_id from ({_SOURCES}) b join (select distinct unnest(sources) as source_id from additions) a on a.source_id = b.source_id")
def lookup_source_id(spark, sf):
    asked = _table(spark, sf, "additions").select(F.explode("sources").alias("source_id"))
    return resolve.lookup_sources(store(spark, sf), asked).select("source_id", "ott_id")


@_query(
    "select 'root' as kind, ott_id, parent_ott_id from tx where parent_ott_id is null union all "
    "select 'orphan', ott_id, parent_ott_id from tx where parent_ott_id is not null and parent_ott_id not in (select ott_id from tx)"
)
def root_and_orphans(spark, sf):
    s = store(spark, sf)
    roots = s.taxa.where("is_root").select(F.lit("root").alias("kind"), "ott_id", "parent_ott_id")
    return roots.unionByName(trees.orphans(s.taxa).withColumn("kind", F.lit("orphan")))


@_query(
    "select 'several_parents' as check_name, count(*) as n from (select ott_id from (select distinct ott_id, parent_ott_id from tx where parent_ott_id is not null) group by ott_id having count(*) > 1) "
    "union all select 'own_parent', count(*) from tx where ott_id = parent_ott_id "
    "union all select 'orphans', count(*) from tx where parent_ott_id is not null and parent_ott_id not in (select ott_id from tx) "
    "union all select 'on_rings', count(*) from tdepth where depth >= 60 union all select 'roots', count(*) from tx where parent_ott_id is null"
)
def verify_tree(spark, sf):
    s = store(spark, sf)
    return trees.verify(s.taxa, s.tree)


@_query("select rank, count(*) as n from tx group by rank")
def rank_counts(spark, sf):
    return store(spark, sf).taxa.groupBy("rank").agg(F.count("*").alias("n"))


@_query(
    ", asked as (select distinct parent as asked_id from additions where parent is not null union select alias_id from forwards union select ott_id from deprecated), "
    "fwd as (select alias_id, min(ott_id) as alias_for from ali where ott_id in (select ott_id from tx) group by alias_id) "
    "select a.asked_id, coalesce(t.ott_id, f.alias_for, d.ott_id) as ott_id, case when t.ott_id is not null then 'live' when f.alias_for is not null then 'alias' when d.ott_id is not null then 'deprecated' else 'unknown' end as status "
    "from asked a left join (select distinct ott_id from tx) t on t.ott_id = a.asked_id left join fwd f on f.alias_id = a.asked_id left join (select distinct ott_id from dep) d on d.ott_id = a.asked_id"
)
def lookup_id_with_alias(spark, sf):
    asked = _table(spark, sf, "additions").where("parent is not null").select(F.col("parent").alias("ott_id"))
    asked = asked.union(_table(spark, sf, "forwards").select("alias_id")).union(_table(spark, sf, "deprecated").select("ott_id"))
    return resolve.lookup_ids(store(spark, sf), asked)


@_query("select ott_id, name, source_info, reason from dep")
def deprecated_list(spark, sf):
    return store(spark, sf).deprecated.select("ott_id", "name", "source_info", "reason")


@_query("select ott_id as desc_id, node as anc_id, dist from walk")
def closure(spark, sf):
    return trees.closure(store(spark, sf).tree)


@_query("select w.ott_id, w.node as anc_id, w.dist from walk w join fw on fw.ott_id = w.ott_id where w.dist > 0")
def lineage(spark, sf):
    return trees.lineage(store(spark, sf).tree, forwarded(spark, sf)).select("ott_id", "anc_id", "dist")


@_query("select t.parent_ott_id, t.ott_id from tx t join fw on fw.ott_id = t.parent_ott_id")
def children(spark, sf):
    return trees.children(store(spark, sf).taxa, forwarded(spark, sf))


@_query("select t.ott_id, t.parent_ott_id from tx t join fw on fw.ott_id = t.ott_id")
def parents(spark, sf):
    return trees.parents(store(spark, sf).taxa, forwarded(spark, sf))


@_query("select node as ott_id, count(*) - 1 as n_below from walk group by node")
def descendant_counts(spark, sf):
    return store(spark, sf).tree.select("ott_id", "n_below")


_TIPS = "(select ott_id, ott_id not in (select node from pwalk where dist > 0) as tip from pdepth)"


@_query(f"select w.node as anc_id, count(*) filter (t.tip) as n_tips, count(*) filter (not t.tip) as n_inner from pwalk w join {_TIPS} t on t.ott_id = w.ott_id group by w.node")
def tip_counts(spark, sf):
    return trees.tip_counts(store(spark, sf).pref_tree)


@_query(f"select w.ott_id from pwalk w join {_TIPS} t on t.ott_id = w.ott_id where t.tip and w.node = {schema.ROOT_ID}")
def tips(spark, sf):
    return trees.tips(store(spark, sf).pref_tree, schema.ROOT_ID)


@_query(
    "select w.node as anc_id, w.ott_id, t.tip as is_tip from walk w join (select ott_id, ott_id not in (select node from walk where dist > 0) as tip from tdepth) t on t.ott_id = w.ott_id"
)
def below_members(spark, sf):
    return trees.below_members(store(spark, sf).tree)


@_query("select s.set_id, l.mrca, count(*) as n_ids, coalesce(max(l.n_used), 0) as n_used from st s left join lica l on l.set_id = s.set_id group by s.set_id, l.mrca")
def mrca_set(spark, sf):
    return trees.mrca(store(spark, sf).pref_tree, sets(spark, sf))


@_query("select s.set_id, case when count(*) = max(l.n_used) then l.mrca end as mrca, count(*) as n_ids, coalesce(max(l.n_used), 0) as n_used from st s left join lica l on l.set_id = s.set_id group by s.set_id, l.mrca")
def mrca_strict(spark, sf):
    return trees.mrca(store(spark, sf).pref_tree, sets(spark, sf), strict=True)


@_query(
    "select p.id_a, p.id_b, (select arg_min(a.node, a.dist) from walk a join walk b on a.node = b.node where a.ott_id = p.id_a and b.ott_id = p.id_b) as mrca from prs p"
)
def mrca_pairs(spark, sf):
    both = pairs(spark, sf).withColumn("set_id", F.struct("id_a", "id_b"))
    rows = both.select("set_id", F.explode(F.array("id_a", "id_b")).alias("ott_id"))
    return trees.mrca(store(spark, sf).tree, rows, strict=True).select("set_id.id_a", "set_id.id_b", "mrca")


@_query("select distinct ott_id from st where ott_id not in (select ott_id from tx)")
def mrca_bad_ids(spark, sf):
    return sets(spark, sf).select("ott_id").distinct().join(store(spark, sf).taxa.select("ott_id"), "ott_id", "left_anti")


@_query(f"select count(*) as n_pairs, count(*) filter (node = {schema.ROOT_ID}) as n_reached from pwalk")
def pref_closure_size(spark, sf):
    return trees.closure(store(spark, sf).pref_tree).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("anc_id") == schema.ROOT_ID).alias("n_reached"))


@_query("select p.id_a as ott_id, p.id_b as anc_id, exists (select 1 from pwalk w where w.ott_id = p.id_a and w.node = p.id_b) as is_descendant from prs p")
def is_descendant(spark, sf):
    asked = pairs(spark, sf).select(F.col("id_a").alias("ott_id"), F.col("id_b").alias("anc_id"))
    return trees.is_descendant(store(spark, sf).pref_tree, asked)


@_query(
    ", meet as (select p.id_a, p.id_b, min(a.dist) as up, min(b.dist) as down from prs p join pwalk a on a.ott_id = p.id_a join pwalk b on b.ott_id = p.id_b and b.node = a.node group by all) "
    "select p.id_a, p.id_b, m.up + m.down as dist, case when m.up is null then da.depth + 1 else m.up + db.depth + 1 end as compat_dist "
    "from prs p join pdepth da on da.ott_id = p.id_a join pdepth db on db.ott_id = p.id_b left join meet m on m.id_a = p.id_a and m.id_b = p.id_b"
)
def internodal_distance(spark, sf):
    return trees.internodal_distance(store(spark, sf).pref_tree, pairs(spark, sf))


@_query("select ott_id, depth as to_root from tdepth")
def path_lengths(spark, sf):
    return trees.path_lengths(store(spark, sf).tree)


def _newick_sql(fmt: str) -> str:
    clean = "case when regexp_matches({0}, '[()\\[\\]{{}}:;,''\"]') then concat('''', replace({0}, '''', ''''''), '''') else replace({0}, ' ', '_') end"
    joined = "concat(coalesce(t.name, ''), '_ott', cast(t.ott_id as varchar))"
    label = {"name_and_id": clean.format(joined), "name": clean.format("coalesce(t.name, '')"), "id": "cast(t.ott_id as varchar)", "original_name": "coalesce(t.name, '')"}[fmt]
    return f""", inside as (select distinct w.ott_id from pwalk w where w.node = (select min(ott_id) from canonical_names where parent is null)),
keyed as (
  select i.ott_id, list_append(list_reverse(list(w.node order by w.dist)), 9223372036854775807) as k, max(w.dist) as depth from inside i join pwalk w on w.ott_id = i.ott_id group by i.ott_id),
placed as (select k.*, {label} as label, lag(k.depth) over (order by k.k) as before, min(k.depth) over () as top from keyed k join tx t on t.ott_id = k.ott_id)
select (select min(ott_id) from canonical_names where parent is null) as ott_id, string_agg(case when before is null then repeat('(', depth - top) when depth < before then ')' else concat(',', repeat('(', depth - before)) end || label, '' order by k) || ';' as newick from placed"""


def _newick(spark, sf, fmt):
    top = _table(spark, sf, "canonical_names").where("parent is null").agg(F.min("ott_id").alias("x")).first()["x"]
    return trees.newick(store(spark, sf), top, fmt)


@_query(_newick_sql("name_and_id"))
def newick_subtree(spark, sf):
    return _newick(spark, sf, "name_and_id")


_PIECES = _newick_sql("name_and_id")
_PIECES = (
    _PIECES[: _PIECES.index("select (select min(ott_id)")].replace("w.node = (select min(ott_id) from canonical_names where parent is null)", f"w.node = {schema.ROOT_ID}")
    + "select ott_id, case when before is null then repeat('(', depth - top) when depth < before then ')' else concat(',', repeat('(', depth - before)) end || label || case when depth = top then ';' else '' end as piece from placed"
)


@_query(_PIECES)
def newick_pieces(spark, sf):
    """The whole tree, in pieces."""
    return trees.newick_pieces(trees.subtree_labels(store(spark, sf), schema.ROOT_ID)).select("ott_id", "piece")


@_query(_newick_sql("name"))
def newick_names(spark, sf):
    return _newick(spark, sf, "name")


@_query(_newick_sql("id"))
def newick_ids(spark, sf):
    return _newick(spark, sf, "id")


@_query(_newick_sql("original_name"))
def newick_original(spark, sf):
    return _newick(spark, sf, "original_name")


@_query(
    """, used as (select s.set_id, s.ott_id, l.mrca from st s join lica l on l.set_id = s.set_id where exists (select 1 from pwalk w where w.ott_id = s.ott_id and w.node = l.mrca)),
ways as (select distinct u.set_id, u.mrca, w.node from used u join pwalk w on w.ott_id = u.ott_id where exists (select 1 from pwalk v where v.ott_id = w.node and v.node = u.mrca)),
links as (select y.set_id, y.node, case when y.node <> y.mrca then t.parent_ott_id end as above from ways y join tx t on t.ott_id = y.node),
heavy as (select set_id, above as node, count(*) as n from links where above is not null group by all),
kept as (select l.set_id, l.node, h.n is null as is_tip from links l left join heavy h on h.set_id = l.set_id and h.node = l.node where h.n is null or h.n > 1)
select k.set_id, k.node as ott_id, (select arg_min(w.node, w.dist) from pwalk w join kept o on o.set_id = k.set_id and o.node = w.node where w.ott_id = k.node and w.dist > 0) as parent_ott_id, k.is_tip from kept k"""
)
def induced_subtree_edges(spark, sf):
    return trees.induced_subtree(store(spark, sf).pref_tree, sets(spark, sf))


@_query("select c.context, w.ott_id from pwalk w join ctx c on c.root_id = w.node")
def context_members(spark, sf):
    return store(spark, sf).context_members


@_query("select w.ott_id, arg_min(c.context, w.dist) as least_context from pwalk w join ctx c on c.root_id = w.node group by w.ott_id")
def least_context(spark, sf):
    return store(spark, sf).least_contexts


@_query("select a.context, arg_min(c.context, w.dist) as parent_context from ctx a join pwalk w on w.ott_id = a.root_id join ctx c on c.root_id = w.node and c.context <> a.context group by a.context")
def context_parents(spark, sf):
    return trees.context_parents(store(spark, sf))


@_query("select w.node as genus_ott_id, w.ott_id from pwalk w join tx g on g.ott_id = w.node and g.rank_class = 'genus' join tx s on s.ott_id = w.ott_id and s.rank_class = 'specific'")
def genus_members(spark, sf):
    s = store(spark, sf)
    return trees.genus_members(s.pref_tree, s.taxa)


_CODES = "(select * from (values " + ", ".join(f"('{c[1]}', '{c[6]}')" for c in schema.CONTEXTS if c[1] in ("Bacteria", "Animals", "Fungi", "Land plants")) + ") v(context, code))"


@_query(f"select w.ott_id, arg_min(v.code, w.dist) as taxcode from walk w join ctx c on c.root_id = w.node join {_CODES} v on v.context = c.context group by w.ott_id")
def taxcode_nearest(spark, sf):
    s = store(spark, sf)
    roots = s.contexts.where("name in ('Bacteria', 'Animals', 'Fungi', 'Land plants')").select("root_ott_id", "code")
    return trees.taxcodes(s.tree, roots)


@_query("select name_lc, count(distinct ott_id) as n_taxa, min(ott_id) as first_id from tx where name_lc is not null group by name_lc having count(distinct ott_id) > 1")
def homonyms(spark, sf):
    return trees.same_names(store(spark, sf).taxa)


def _stage(spark, sf, f, *names_):
    s = store(spark, sf)
    return f(resolve.prepared(names(spark, sf)), resolve.index_of(s)).select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), "rank")


@_query("select distinct qname, ott_id, name, rank from exactm")
def match_exact(spark, sf):
    return _stage(spark, sf, resolve.exact)


@_query("select distinct qname, ott_id, name, rank from genericm")
def match_sp_genus(spark, sf):
    s = store(spark, sf)
    queries, index = resolve.prepared(names(spark, sf)), resolve.index_of(s)
    rest = queries.join(resolve.exact(queries, index).select("query_id"), "query_id", "left_anti")
    return resolve.generic(rest, index).select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), "rank")


@_query("select qname, ott_id, name, rank from synm")
def match_synonym(spark, sf):
    return _stage(spark, sf, resolve.by_synonym)


@_query("select distinct d.name as qname, d.ott_id, d.name from dep d join dep e on e.name_lc = d.name_lc where d.name is not null")
def match_deprecated(spark, sf):
    s = store(spark, sf)
    asked = s.deprecated.where("name is not null").select(F.col("name").alias("query_id"), F.col("name").alias("qname")).distinct()
    found = resolve.deprecated(resolve.prepared(asked), s.deprecated)
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name")).where("qname = name")


@_query("select qname from openq")
def match_unmatched(spark, sf):
    s = store(spark, sf)
    told = resolve.summary(names(spark, sf), resolve.match_names(s, names(spark, sf)))
    return told.where("not matched").select("qname")


@_query(
    "select q.qname, q.qname not in (select qname from openq) as matched, q.qname in (select qname from exactm) as unambiguous_taxon from qs q"
)
def match_summary(spark, sf):
    s = store(spark, sf)
    told = resolve.summary(names(spark, sf), resolve.match_names(s, names(spark, sf)))
    return told.select("qname", "matched", F.col("unambiguous").alias("unambiguous_taxon"))


@_query("select distinct qname, ott_id, name, kind = 'synonym' as is_synonym from near")
def match_fuzzy(spark, sf):
    s = store(spark, sf)
    found = resolve.match_names(s, names(spark, sf), "All life", approximate=True).where("is_approximate")
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), "is_synonym")


@_query("select distinct qname, ott_id, name, score from near where score >= 0")
def match_fuzzy_scored(spark, sf):
    s = store(spark, sf)
    found = resolve.match_names(s, names(spark, sf), "All life", approximate=True).where("is_approximate")
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), "score").distinct()


@_query(
    "select distinct qname, ott_id, name, 'exact' as stage from exactm union select qname, ott_id, name, 'generic' from genericm union select qname, ott_id, name, 'deprecated' from depm "
    "union select qname, ott_id, name, 'synonym' from synm union select qname, ott_id, name, 'fuzzy' from near where qname not in (select qname from depm) and score >= 0"
)
def match_pipeline(spark, sf):
    s = store(spark, sf)
    found = resolve.match_names(s, names(spark, sf), "All life", approximate=True, include_deprecated=True).where("not (is_deprecated and is_approximate)")
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), "stage").distinct()


_RETIRED = """, lastd as (select * from openq where qname not in (select qname from depm)),
neardep as (
  select o.qname, d.ott_id, d.name, (least(length(o.q), length(d.name)) - levenshtein(o.qb, d.name)) / cast(least(length(o.q), length(d.name)) as double) as score
  from lastd o join dep d on abs(length(o.q) - length(d.name_lc)) <= o.m where length(o.q) > 1 and levenshtein(o.qb, d.name_lc) * length(o.q) < (o.m + 1) * least(length(o.q), length(d.name_lc)))
"""


@_query(
    _RETIRED + "select distinct qname, ott_id, name, 'exact' as stage, false as is_deprecated from exactm union select qname, ott_id, name, 'generic', false from genericm union select qname, ott_id, name, 'deprecated', true from depm "
    "union select qname, ott_id, name, 'synonym', false from synm union select qname, ott_id, name, 'fuzzy', false from near where qname not in (select qname from depm) and score >= 0 "
    "union select qname, ott_id, name, 'fuzzy', true from neardep where score >= 0"
)
def match_pipeline_retired(spark, sf):
    """The pipeline with the fuzzy matches of retired names."""
    s = store(spark, sf)
    found = resolve.match_names(s, names(spark, sf), "All life", approximate=True, include_deprecated=True)
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), "stage", "is_deprecated").distinct()


@_query(
    "select q.qname, i.ott_id, i.name, 'exact' as stage from qs q join ix i on i.key_lc = q.q where i.kind = 'taxon' "
    "union select s.qname, i.ott_id, i.name, 'generic' from (select qname, trim(regexp_replace(q, '\\s*sp\\.?\\s*$', '')) as head from qs where regexp_matches(q, '(^|\\s)sp\\.?$') "
    "and q not in (select key_lc from ix where kind = 'taxon')) s join ix i on i.key_lc = s.head where s.head <> '' and i.kind = 'taxon' "
    "union select q.qname, i.ott_id, i.name, 'synonym' from qs q join ix i on i.key_lc = q.q where i.kind = 'synonym'"
)
def match_suppressed(spark, sf):
    """Matches with suppressed taxa."""
    found = resolve.match_names(store(spark, sf), names(spark, sf), "All life", include_suppressed=True)
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), "stage")


@_query(
    "select q.qname, i.ott_id, i.name from qs q join ix i on i.key_lc = q.q join pwalk w on w.ott_id = i.ott_id join ctx c on c.root_id = w.node where c.context = 'Fungi' and i.kind = 'taxon' and not i.dubious"
)
def match_in_context(spark, sf):
    s = store(spark, sf)
    found = resolve.match_names(s, names(spark, sf), "fungi").where("stage = 'exact'")
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"))


_TOLD = (
    "(select distinct m.qname, m.ott_id, 'Exact match from search string ''' || lower(m.qname) || ''' to ' || case when m.syn then 'synonym name' when t.name = coalesce(nullif(t.uniqname, ''), t.name) then 'unique taxon name' "
    "else 'non-unique taxon name' end || ' ''' || m.name || '''' as description from (select qname, ott_id, name, false as syn from exactm union select qname, ott_id, name, false from genericm union select qname, ott_id, name, true from synm) m "
    "left join tx t on t.ott_id = m.ott_id)"
)


def _told(spark, sf):
    s = store(spark, sf)
    return resolve.describe(resolve.match_names(s, names(spark, sf), "All life"), s.taxa).distinct()


@_query(f"select qname, ott_id, description from {_TOLD}")
def match_descriptions(spark, sf):
    return _told(spark, sf).select(F.col("query_id").alias("qname"), "ott_id", "description")


@_query(f"select q.qname, coalesce(t.lines, '') as lines from qs q left join (select qname, string_agg(description, chr(10) order by description) as lines from {_TOLD} group by qname) t on t.qname = q.qname")
def match_listing(spark, sf):
    """The matches of every name in words, as the listing for a list of names."""
    return exports.result_lines(names(spark, sf), _told(spark, sf)).select("qname", "lines")


@_query("select distinct q.qname, i.ott_id, i.name from qs q join ix i on i.key_lc = q.q")
def taxa_by_name(spark, sf):
    return resolve.find_taxa(store(spark, sf), names(spark, sf), synonyms=True).select(F.col("query_id").alias("qname"), "ott_id", "name")


@_query("select distinct query_string as q, array_to_string(regexp_split_to_array(query_string, '\\s*,\\s*'), '|') as parts from tnrs_requests where query_string is not null")
def comma_lists(spark, sf):
    asked = _table(spark, sf, "tnrs_requests").where("query_string is not null").select(F.col("query_string").alias("q")).distinct()
    return asked.select("q", F.array_join(taxon.comma_list(F.col("q")), "|").alias("parts"))


_HITS = "(select q.qname, count(distinct t.ott_id) as n, min(t.ott_id) as ott_id from {0} q left join tx t on t.name_lc = q.q and not t.dubious group by q.qname)"
_INFER = f""", uniq as (select * from {_HITS} where n = 1),
comp2 as (select d.root, count(distinct u.ott_id) as n from uniq u join pdepth d on d.ott_id = u.ott_id group by d.root),
best2 as (select root, n from comp2 order by n desc, root limit 1),
cnt2 as (select w.node, count(distinct u.ott_id) as n from uniq u join pdepth d on d.ott_id = u.ott_id join best2 b on b.root = d.root join pwalk w on w.ott_id = u.ott_id group by w.node),
top2 as (select arg_max(c.node, d.depth) as clade from cnt2 c join best2 b on b.n = c.n join pdepth d on d.ott_id = c.node),
used2 as (select coalesce((select arg_min(c.context, w.dist) from top2 t join pwalk w on w.ott_id = t.clade join ctx c on c.root_id = w.node), 'All life') as context)
"""


@_query(_INFER.format("qs") + f"select context as context_name, (select root_id from ctx where ctx.context = used2.context) as context_ott_id, (select clade from top2) as clade_ott_id, (select count(*) from uniq) as n_unique, (select count(*) from {_HITS.format('qs')} where n <> 1) as n_ambiguous from used2")
def infer_context(spark, sf):
    return resolve.infer_context(store(spark, sf), names(spark, sf))


@_query(
    _INFER.format("qs") + """, met as (
  select a.ott_id, min(a.dist) as up from pwalk a join pwalk b on b.node = a.node join top2 t on t.clade = b.ott_id where a.ott_id in (select ott_id from near) group by a.ott_id),
far as (
  select d.ott_id, case when m.up is null then d.depth + 1 else m.up + c.depth + 1 end as d, not exists (select 1 from pwalk w join top2 t on t.clade = w.node where w.ott_id = d.ott_id) as outside
  from pdepth d join pdepth c on c.ott_id = (select clade from top2) left join met m on m.ott_id = d.ott_id where d.ott_id in (select ott_id from near))
select distinct n.qname, n.ott_id, n.name, round(n.score * case when f.outside then 1 / ln(greatest(f.d, 3)) else 1 end, 9) as score from near n join far f on f.ott_id = n.ott_id where n.score >= 0"""
)
def match_weighted(spark, sf):
    """Fuzzy matches without a context given: their scores are weighted by the clade that the unique names span."""
    found = resolve.match_names(store(spark, sf), names(spark, sf), approximate=True).where("is_approximate")
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), F.round("score", 9).alias("score")).distinct()


_LISTED = "(select distinct name as qname, lower(name) as q from canonical_names where name is not null and context_name = 'Fungi')"


@_query(
    _INFER.format(_LISTED) + f"select q.qname, i.ott_id, i.name, u.context from {_LISTED} q join ix i on i.key_lc = q.q and not i.dubious join used2 u on true join ctx c on c.context = u.context join pwalk w on w.ott_id = i.ott_id and w.node = c.root_id"
)
def match_applied(spark, sf):
    """The names listed for one context, matched within the context inferred from them."""
    s = store(spark, sf)
    asked = _table(spark, sf, "canonical_names").where("name is not null and context_name = 'Fungi'").select(F.col("name").alias("query_id"), F.col("name").alias("qname")).distinct()
    guess = resolve.infer_context(s, asked).first()["context_name"]
    found = resolve.match_names(s, asked, apply_inferred=True)
    return found.select(F.col("query_id").alias("qname"), "ott_id", F.col("matched_name").alias("name"), F.lit(guess).alias("context"))


@_query(f"select qname from {_HITS.format('qs')} where n <> 1")
def ambiguous_names(spark, sf):
    return resolve.ambiguous_names(store(spark, sf), names(spark, sf)).select("qname")


@_query("select q.qname, i.kind, i.name, i.ott_id from qs q join ix i on starts_with(i.key_lc, q.q) where length(q.q) >= 3")
def prefix_match(spark, sf):
    s = store(spark, sf)
    hits = resolve.prefix(resolve.prepared(names(spark, sf)), s.name_index)
    return hits.select(F.col("query_id").alias("qname"), "kind", "name", "ott_id")


_AUTO = """, pix as (select * from ix where not dubious),
sp as (select qname, q, qb, trim(regexp_extract(qname, '^\\S+\\s+(.*)$', 1)) as rest, regexp_extract(q, '^(\\S*)\\s', 1) as word from qs where contains(qname, ' ')),
ns as (select qname, q from qs where not contains(qname, ' ')),
gm as (select w.node as genus_ott_id, w.ott_id from pwalk w join tx g on g.ott_id = w.node and g.rank_class = 'genus' join tx s on s.ott_id = w.ott_id and s.rank_class = 'specific' where not s.dubious),
every as (
  select sp.qname, 1 as stage, i.ott_id from sp join pix i on i.key_lc = sp.q where i.kind = 'synonym' or i.rank_class = 'specific'
  union select ns.qname, 1, i.ott_id from ns join pix i on i.key_lc = ns.q where i.rank_class <> 'specific'
  union select sp.qname, 2, t.ott_id from sp join pix g on g.key_lc = sp.word and g.kind = 'taxon' and g.rank_class = 'genus' join gm on gm.genus_ott_id = g.ott_id join tx t on t.ott_id = gm.ott_id
    where length(t.name) > length(g.name) and starts_with(substring(t.name, length(g.name) + 2), sp.rest)
  union select sp.qname, 3, i.ott_id from sp join pix i on i.key_lc = sp.q where i.kind = 'taxon' and i.rank_class <> 'specific'
  union select sp.qname, 4, i.ott_id from sp join pix i on starts_with(i.key_lc, sp.q) where length(sp.q) >= 3
  union select ns.qname, 4, i.ott_id from ns join pix i on starts_with(i.key_lc, ns.q) where length(ns.q) >= 3 and i.kind = 'taxon' and i.rank_class <> 'specific'
  union select ns.qname, 5, i.ott_id from ns join pix i on starts_with(i.key_lc, ns.q) where length(ns.q) >= 3 and i.kind = 'synonym'),
lastq as (select qname, q, qb, case when length(q) < 9 then 1 when length(q) < 14 then 2 when length(q) < 19 then 3 else 4 end as m from qs where qname not in (select qname from every)),
late as (
  select o.qname, 6 as stage, i.ott_id from lastq o join pix i on abs(length(o.q) - length(i.key_lc)) <= o.m and (contains(o.qname, ' ') or i.rank_class <> 'specific')
  where length(o.q) > 1 and levenshtein(o.qb, i.key_lc) * length(o.q) < (o.m + 1) * least(length(o.q), length(i.key_lc))),
allm as (select * from every union select * from late),
bestm as (select qname, min(stage) as stage from allm group by qname),
shown as (select a.qname, a.stage, a.ott_id, coalesce(nullif(t.uniqname, ''), t.name) as unique_name, t.rank not in ('species', 'subspecies', 'variety', 'forma') as is_higher, t.dubious as is_suppressed
  from allm a join bestm b on b.qname = a.qname and b.stage = a.stage join tx t on t.ott_id = a.ott_id)
select qname, stage, ott_id, unique_name, is_higher, is_suppressed, row_number() over (partition by qname order by unique_name, ott_id) - 1 as position from shown where %s"""


def _auto(spark, sf, asked, condition="true"):
    # Queries don't bear on each other: those with a blank and those without are asked by themselves.
    hits = resolve.autocomplete(store(spark, sf), names(spark, sf).where(asked)).where(condition)
    return hits.select(F.col("query_id").alias("qname"), "stage", "ott_id", "unique_name", "is_higher", "is_suppressed", F.col("position").cast("long").alias("position"))


@_query(_AUTO % "contains(qname, ' ') and stage <> 2")
def autocomplete_space(spark, sf):
    return _auto(spark, sf, "contains(qname, ' ')", "stage <> 2")


@_query(_AUTO % "not contains(qname, ' ')")
def autocomplete_nospace(spark, sf):
    return _auto(spark, sf, "not contains(qname, ' ')")


@_query(_AUTO % "stage = 2")
def autocomplete_genus(spark, sf):
    return _auto(spark, sf, "contains(qname, ' ')", "stage = 2")


@_query("select s.ott_id, string_agg(s.name, ',' order by s.name) as synonyms from (select distinct ott_id, name from syn) s where s.ott_id in (select ott_id from tx) group by s.ott_id")
def synonyms_by_taxon(spark, sf):
    return resolve.synonyms_by_taxon(store(spark, sf)).select("ott_id", _listed("synonyms").alias("synonyms"))


@_query("select s.ott_id, s.name from (select distinct ott_id, name from syn) s where s.ott_id not in (select ott_id from tx)")
def synonyms_dropped(spark, sf):
    s = store(spark, sf)
    return s.synonyms.select("ott_id", "name").distinct().join(s.taxa.select("ott_id"), "ott_id", "left_anti")


@_query("select 'abc2.9draft12' as source, 'someone' as author, 'https://example.org/taxonomy' as weburl, regexp_extract('abc2.9draft12', '^([^0-9.]+)', 1) as name, regexp_extract('abc2.9draft12', '([0-9]+(\\.[0-9]+)?)', 1) as version")
def about_metadata(spark, sf):
    from arbolith import services

    return services.about(store(spark, sf))


@_query("select grp, string_agg(name, ',' order by name) as contexts from (values " + ", ".join(f"('{c[1]}', '{c[2]}')" for c in schema.CONTEXTS) + ") v(name, grp) group by grp")
def contexts_by_group(spark, sf):
    from arbolith import services

    return services.v3_contexts(store(spark, sf)).select("grp", _listed("contexts").alias("contexts"))


_ADDED = (
    "," + _P6.strip().removeprefix("with")
    + """, known as (select ott_id from tx union select alias_id from ali union select ott_id from dep),
ordered as (select doc_key, min(submitted_at) as doc_order from addition_docs group by doc_key),
given as (
  select t.doc_key, t.taxon_pos, try_cast(nullif(o.child_value, '') as bigint) as ott_id, json_extract_string(t.t, '$.name') as name,
    try_cast(trim(json_extract_string(t.t, '$.parent')) as bigint) as parent, json_extract_string(t.t, '$.parent_tag') as parent_tag, json_extract_string(t.t, '$.tag') as tag,
    row_number() over (order by d.doc_order, t.doc_key, t.taxon_pos) as place
  from taxon t join own o on o.doc_key = t.doc_key and o.taxon_pos = t.taxon_pos join ordered d on d.doc_key = t.doc_key),
firsts as (select ott_id, min(place) as place from given where ott_id is not null group by ott_id),
tagged as (select doc_key, tag, min(taxon_pos) as pos, arg_min(ott_id, taxon_pos) as by_tag from given where tag is not null and ott_id is not null and ott_id not in (select ott_id from known) group by doc_key, tag),
linked as (
  select g.*, coalesce(g.parent, case when t.pos < g.taxon_pos then t.by_tag end) as parent_ott_id, g.ott_id in (select ott_id from known) as there, f.place as first_place
  from given g left join tagged t on t.doc_key = g.doc_key and t.tag = g.parent_tag left join firsts f on f.ott_id = g.ott_id),
judged as (select l.doc_key, l.taxon_pos, l.ott_id, l.parent_ott_id, l.name, case
  when l.ott_id is null then 'no_id' when l.there then 'known' when l.place <> l.first_place then 'repeated' when coalesce(l.name, '') = '' then 'no_name' when l.parent_ott_id is null then 'no_parent'
  when l.parent_ott_id not in (select ott_id from known) and not coalesce(a.place < l.place, false) then 'bad_parent' else 'new' end as status
from linked l left join firsts a on a.ott_id = l.parent_ott_id and a.ott_id not in (select ott_id from known))
"""
)


@_query(_ADDED + "select * from judged")
def additions_apply(spark, sf):
    docs = _table(spark, sf, "addition_docs")
    _, checked = additions.apply(store(spark, sf), docs, "submitted_at")
    return checked.select("doc_key", "taxon_pos", "ott_id", "parent_ott_id", "name", "status")


_CONSTANTS = "[" + ", ".join(f"{{'l': '{k}', 'c': '{v}'}}" for k, v in schema.FLAG_CONSTANTS.items()) + "]"
_BLOBS = (
    f"(select t.ott_id, t.name, case when t.rank = '' then 'no rank' else t.rank end as rank, t.input_sources as tax_sources, coalesce(nullif(t.uniqname, ''), t.name) as unique_name, t.dubious as is_suppressed, "
    f"array_to_string(list_transform(list_filter({_CONSTANTS}, lambda f: list_contains(string_split(t.flags, ','), f.l)), lambda f: f.c), ',') as flags, coalesce(y.synonyms, '') as synonyms "
    "from tx t left join (select ott_id, string_agg(name, ',' order by name) as synonyms from (select distinct ott_id, name from syn) group by ott_id) y on y.ott_id = t.ott_id)"
)


def _flat_taxon() -> list[F.Column]:
    lists = ("tax_sources", "flags", "synonyms")
    return [F.col(f"taxon.{c}").alias(c) for c in ("name", "rank", "unique_name", "is_suppressed")] + [F.array_join(f"taxon.{c}", ",").alias(c) for c in lists]


@_query(
    _ADDED + ", gx as (select ott_id, parent_ott_id from tx union all select ott_id, parent_ott_id from judged where status = 'new'), "
    "gw(ott_id, node, dist) as (select ott_id, ott_id, 0 from gx union all select w.ott_id, p.parent_ott_id, w.dist + 1 from gw w join gx p on p.ott_id = w.node join gx q on q.ott_id = p.parent_ott_id where w.dist < 60), "
    "gb as (select node as ott_id, count(*) - 1 as n_below from gw group by node) "
    "select w.ott_id, arg_max(w.node, w.dist) as root, max(w.dist) as depth, max(b.n_below) as n_below from gw w join gb b on b.ott_id = w.ott_id group by w.ott_id"
)
def additions_grown(spark, sf):
    """The paths of the tree with the additions, carried on from those without."""
    s = store(spark, sf)
    _ = s.tree
    grown, _ = additions.apply(s, _table(spark, sf, "addition_docs"), "submitted_at")
    return grown.tree.select("ott_id", "root", "depth", "n_below")


@_query(f"select * from {_BLOBS}")
def taxon_info(spark, sf):
    """The answer on each taxon."""
    from arbolith import services

    return services.taxon_blobs(store(spark, sf)).select("ott_id", *_flat_taxon())


@_query(
    "select f.ott_id, coalesce((select string_agg(cast(w.node as varchar), ',' order by w.dist) from walk w where w.ott_id = f.ott_id and w.dist > 0), '') as lineage, "
    "coalesce((select string_agg(cast(t.ott_id as varchar), ',' order by t.ott_id) from tx t where t.parent_ott_id = f.ott_id), '') as children, "
    f"coalesce((select string_agg(cast(w.ott_id as varchar), ',' order by w.ott_id) from pwalk w join {_TIPS} t on t.ott_id = w.ott_id where t.tip and w.node = f.ott_id), '') as tips from fw f where f.ott_id in (select ott_id from tx)"
)
def taxon_lists(spark, sf):
    """Lineage, children and tips as in the answers on taxa."""
    from arbolith import services

    rows = services._described(store(spark, sf), forwarded(spark, sf), True, True, True)
    ids = lambda c: F.array_join(F.transform(c, lambda t: t["ott_id"].cast("string")), ",").alias(c)
    return rows.select("ott_id", ids("lineage"), ids("children"), F.array_join(F.col("terminal_descendants").cast("array<string>"), ",").alias("tips"))


@_query("select ott_id, d.name as name, d.reason as reason, d.source_info as source_info from (select ott_id, min({'name': name, 'reason': reason, 'source_info': source_info}) as d from dep group by ott_id)")
def retired_taxa(spark, sf):
    from arbolith import services

    return services.v2_deprecated_taxa(store(spark, sf)).select(F.col("`ot:ottId`").alias("ott_id"), F.col("`ot:ottTaxonName`").alias("name"), "reason", "source_info")


_ROWS = f"""(select w.ott_id, arg_min(v.code, w.dist) as code from walk w join ctx c on c.root_id = w.node join {_CODES} v on v.context = c.context group by w.ott_id)"""


@_query(
    f"""{_RETIRED}, found as (
  select qname, ott_id, name, false as is_synonym, false as is_approximate, false as is_deprecated, 1.0 as score from exactm union select qname, ott_id, name, false, false, false, 0.99 from genericm
  union select qname, ott_id, name, false, false, true, 1.0 from depm union select qname, ott_id, name, true, false, false, 1.0 from synm
  union select qname, ott_id, name, kind = 'synonym', true, false, score from near where qname not in (select qname from depm) and score >= 0 union select qname, ott_id, name, false, true, true, score from neardep where score >= 0)
select f.qname, f.ott_id, f.name as matched_name, f.is_synonym, f.is_approximate, f.is_deprecated, round(f.score, 9) as score,
  case when f.is_deprecated then 'undetermined' else coalesce(c.code, 'undetermined') end as nomenclature_code, case when not f.is_deprecated then p.name end as parent_name,
  case when f.is_deprecated then d.name else b.name end as name, case when not f.is_deprecated then b.rank end as rank, case when not f.is_deprecated then b.unique_name end as unique_name,
  case when not f.is_deprecated then b.is_suppressed end as is_suppressed, case when f.is_deprecated then 'DEPRECATED' else b.flags end as flags, case when not f.is_deprecated then b.synonyms end as synonyms,
  case when f.is_deprecated then coalesce(d.source_info, '') else b.tax_sources end as tax_sources
from found f left join {_ROWS} c on c.ott_id = f.ott_id left join {_BLOBS} b on b.ott_id = f.ott_id left join tx t on t.ott_id = f.ott_id left join tx p on p.ott_id = t.parent_ott_id
left join (select ott_id, min({{'name': name, 's': source_info}}) as m, (min({{'name': name, 's': source_info}})).name as name, (min({{'name': name, 's': source_info}})).s as source_info from dep group by ott_id) d on d.ott_id = f.ott_id"""
)
def match_answers(spark, sf):
    """Every match as it stands in the answers of the service, retired names included."""
    from arbolith import services

    s = store(spark, sf)
    matches = resolve.match_names(s, names(spark, sf), "All life", approximate=True, include_deprecated=True)
    codes = trees.taxcodes(s.tree, s.contexts.where("name in ('Bacteria', 'Animals', 'Fungi', 'Land plants')").select("root_ott_id", "code"))
    rows = services.match_rows(s, matches, codes)
    return rows.select(F.col("query_id").alias("qname"), "ott_id", "matched_name", "is_synonym", "is_approximate", "is_deprecated", F.round("score", 9).alias("score"), "nomenclature_code", "parent_name", *_flat_taxon())


@_query(
    f"""{_RETIRED}, hit as (select qname from exactm union select qname from genericm union select qname from depm union select qname from synm union select qname from near where score >= 0 union select qname from neardep where score >= 0)
select (select string_agg(qname, '|' order by qname) from qs where qname in (select qname from exactm union select qname from depm)) as unambiguous,
  (select string_agg(qname, '|' order by qname) from qs where qname not in (select qname from hit)) as unmatched, (select count(*) from qs where qname in (select qname from hit)) as n_matched,
  'All life' as context, 'undefined' as governing_code, (select count(*) from hit) as n_results"""
)
def match_names_answer(spark, sf):
    """The whole answer of version 2 to all names, its lists told from the JSON."""
    from arbolith import services

    lists = "unambiguous_name_ids array<string>, unmatched_name_ids array<string>, matched_name_ids array<string>, context string, governing_code string, results array<struct<id: string>>"
    whole = services.v2_match_names(store(spark, sf), names(spark, sf), "All life", include_deprecated=True).select(F.from_json("json", lists).alias("j"))
    joined = lambda c: F.array_join(F.array_sort(f"j.{c}"), "|")
    return whole.select(joined("unambiguous_name_ids").alias("unambiguous"), joined("unmatched_name_ids").alias("unmatched"), F.size("j.matched_name_ids").alias("n_matched"), "j.context", "j.governing_code", F.size("j.results").alias("n_results"))


_CLADES = "(select c.name as clade, v.code from canonical_names c join (values " + ", ".join(f"('{c[1]}', '{c[6]}')" for c in schema.CONTEXTS) + ") v(context, code) on v.context = c.context_name where c.parent is null)"


_BARRIERS = (
    f", hits as (select v.clade, v.code, i.ott_id, case i.kind when 'taxon' then 1 else 3 end as stage, d.depth from {_CLADES} v join ix i on i.key_lc = lower(v.clade) join tdepth d on d.ott_id = i.ott_id), "
    "barriers as (select clade, code, arg_min(ott_id, (stage, depth, ott_id)) as root_ott_id from hits group by clade, code) "
)


@_query(_BARRIERS + "select w.ott_id, arg_min(b.code, w.dist) as taxcode from walk w join barriers b on b.root_ott_id = w.node group by w.ott_id")
def taxcode_barriers(spark, sf):
    """Codes by the clades that barrier_clades finds."""
    return trees.taxcodes(store(spark, sf).tree, barrier_clades(spark, sf).select("root_ott_id", "code"))


@_query(_BARRIERS + "select * from barriers")
def barrier_clades(spark, sf):
    """Clades by their names: here the tops of the contexts."""
    tops = _table(spark, sf, "canonical_names").where("parent is null").select("name", "context_name").distinct().collect()  # one for each context
    codes = {c[1]: c[6] for c in schema.CONTEXTS}
    return trees.resolve_barriers(store(spark, sf), [(r["name"], codes[r["context_name"]]) for r in tops if r["context_name"] in codes], ())


@_query(
    ", inside as (select distinct ott_id from pwalk where node = " + str(schema.ROOT_ID) + "), e as (select t.ott_id, t.parent_ott_id from tx t where t.parent_ott_id in (select ott_id from inside)), "
    "n as (select x.ott_id, row_number() over (order by d.depth, x.ott_id) as k from (select ott_id from e union select parent_ott_id from e) x join tdepth d on d.ott_id = x.ott_id) "
    "select chr(9) || 'n' || a.k || ' -> n' || b.k || ' [color=black] ;' as line from e join n a on a.ott_id = e.ott_id join n b on b.ott_id = e.parent_ott_id "
    "union all select chr(9) || 'n' || n.k || ' [label=\"' || coalesce(t.name, '') || '\"] ;' from n join tx t on t.ott_id = n.ott_id"
)
def dot_edges(spark, sf):
    return exports.dot_lines(store(spark, sf), schema.ROOT_ID).where("part in (1, 2)").select("line")


_BAR = "chr(9) || '|' || chr(9)"


@_query(
    f"select '1' || {_BAR} || '0' || {_BAR} || 'life' || {_BAR} as line union all select '{schema.ROOT_ID}' || {_BAR} || '1' || {_BAR} || 'life' || {_BAR} "
    f"union all select t.ott_id || {_BAR} || t.parent_ott_id || {_BAR} || translate(coalesce(t.name, ''), ' ' || chr(9) || '.,():;''', '_________') || {_BAR} from tx t where t.ott_id in (select ott_id from pwalk where node = {schema.ROOT_ID}) and t.ott_id <> {schema.ROOT_ID}"
)
def taxlist(spark, sf):
    return exports.taxon_list_lines(store(spark, sf), schema.ROOT_ID).select("line")


@_query(
    f"select t.ott_id, t.ott_id || {_BAR} || coalesce(cast(t.parent_ott_id as varchar), '') || {_BAR} || coalesce(t.name, '') || {_BAR} || t.rank || {_BAR} || t.input_sources || {_BAR} || t.uniqname || {_BAR} as line "
    "from tx t where t.ott_id in (select ott_id from walk where node = (select max(ott_id) from tx where name = (select min(name) from canonical_names where parent is null)))"
)
def subset_taxonomy(spark, sf):
    name = _table(spark, sf, "canonical_names").where("parent is null").agg(F.min("name").alias("x")).first()["x"]
    return exports.subset_lines(store(spark, sf), name)


@_query(
    ", inner_ as (select w.node as ott_id, count(*) - 1 as n_below from walk w group by w.node having count(*) > 1), "
    f"num as (select i.ott_id, t.parent_ott_id, t.name, row_number() over (order by d.depth, i.ott_id) - 1 as k from inner_ i join tdepth d on d.ott_id = i.ott_id join tx t on t.ott_id = i.ott_id where i.ott_id in (select ott_id from walk where node = {schema.ROOT_ID})) "
    "select 'node' as kind, k as position, cast(case when name is null then to_json({'group': k}) else to_json({'name': name, 'group': k}) end as varchar) as json from num "
    "union all select 'link', a.k, cast(to_json({'source': a.k, 'target': b.k, 'value': 1}) as varchar) from num a join num b on b.ott_id = a.parent_ott_id"
)
def graph_json(spark, sf):
    return exports.graph_json(store(spark, sf), schema.ROOT_ID)


@_query(
    "select ott_id, cast(case when name is null then to_json({'treestoreId': i, 'sourceIds': s}) else to_json({'name': name, 'treestoreId': i, 'sourceIds': s}) end as varchar) as json from ("
    "select ott_id, name, cast(ott_id as varchar) as i, list_filter(string_split(input_sources, ','), lambda x: contains(x, ':') and not ends_with(x, ':') and not starts_with(x, 'http')) as s from tx)"
)
def name_dump(spark, sf):
    return exports.name_dump(store(spark, sf))


_EDGES = "(select ott_id as child_id, parent as parent_id, addition_id as source from additions where ott_id is not null and parent is not null)"


@_query(f"select child_id, parent_id, source from (select *, row_number() over (partition by child_id order by source, parent_id) as rn from {_EDGES}) where rn = 1")
def source_priority_edges(spark, sf):
    edges = _table(spark, sf, "additions").where("ott_id is not null and parent is not null").select(F.col("ott_id").alias("child_id"), F.col("parent").alias("parent_id"), F.col("addition_id").alias("source"))
    return trees.preferred_edges(edges, [])


@_query(f"select fw.ott_id, (select arg_min(e.child_id, (e.source, e.child_id)) from {_EDGES} e where e.parent_id = fw.ott_id) as neighbour from fw")
def first_neighbour(spark, sf):
    edges = _table(spark, sf, "additions").where("ott_id is not null and parent is not null").select(F.col("ott_id").alias("child_id"), F.col("parent").alias("parent_id"), F.col("addition_id").alias("source"))
    return trees.first_neighbour(edges, forwarded(spark, sf), outgoing=False)


@_query(
    ", inside as (select distinct ott_id from walk where node = " + str(schema.ROOT_ID) + "), wide as (select parent_ott_id as node from tx where ott_id in (select ott_id from inside) and parent_ott_id <> " + str(schema.ROOT_ID)
    + " group by 1 having count(*) >= 100) select ott_id from inside where ott_id not in (select w.ott_id from walk w join wide on wide.node = w.node where w.dist > 0)"
)
def wide_nodes_pruned(spark, sf):
    return trees.wide_nodes(store(spark, sf).tree, schema.ROOT_ID).select("ott_id")


@_query(
    f"select ott_id from tx where parent_ott_id = {schema.ROOT_ID} union select node from walk where dist > 0 and node <> {schema.ROOT_ID} and node in (select ott_id from walk where node = {schema.ROOT_ID})"
)
def inner_and_direct(spark, sf):
    return trees.inner_and_direct(store(spark, sf).tree, schema.ROOT_ID).select("ott_id")


# --- files: what was written in the dumps' forms and read again


def _written(lines: DataFrame) -> str:
    path = runtime.shared_path(lines.sparkSession)
    lines.write.text(path)
    return path


@_query("select ott_id, parent_ott_id, coalesce(name, '') as name, rank, input_sources, uniqname, flags from tx")
def dump_taxonomy(spark, sf):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [*[text(c) for c in ("ott_id", "parent_ott_id", "name", "rank", "input_sources", "uniqname")], F.array_join("flags", ","), F.lit("")]
    path = _written(store(spark, sf).taxa.select(F.concat_ws("\t|\t", *parts)))
    return dumps.read_taxonomy(spark, path).withColumn("flags", F.array_join("flags", ","))


@_query("select distinct ott_id, name from syn where ott_id is not null and name is not null")
def dump_synonyms(spark, sf):
    path = _written(store(spark, sf).synonyms.where("ott_id is not null").select(F.concat_ws("\t|\t", "name", F.col("ott_id").cast("string"), F.lit(""))))
    return dumps.read_synonyms(spark, path).select("ott_id", "name").distinct()


@_query("select alias_id, ott_id from ali where alias_id is not null and ott_id is not null")
def dump_forwards(spark, sf):
    return dumps.read_forwards(spark, _written(store(spark, sf).aliases.select(F.concat_ws("\t", F.col("alias_id").cast("string"), F.col("ott_id").cast("string")))))


@_query("select distinct ott_id, coalesce(name, '') as name, coalesce(source_info, '') as source_info, coalesce(reason, '') as reason from dep where ott_id is not null")
def dump_deprecated(spark, sf):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return dumps.read_deprecated(spark, _written(store(spark, sf).deprecated.where("ott_id is not null").select(F.concat_ws("\t", *[text(c) for c in ("ott_id", "name", "source_info", "reason")])))).distinct()


@_query("select ott_id, parent_ott_id, coalesce(name, '') as name, rank, '' as flags from tx")
def dump_of_four_columns(spark, sf):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    path = _written(store(spark, sf).taxa.select(F.concat(F.concat_ws("\t|\t", *[text(c) for c in ("ott_id", "parent_ott_id", "name", "rank")]), F.lit("\t|"))))
    return dumps.read_taxonomy(spark, path).select("ott_id", "parent_ott_id", "name", "rank", F.array_join("flags", ",").alias("flags"))


@_query("select c.context, w.ott_id from pwalk w join ctx c on c.root_id = w.node")
def store_reopened(spark, sf):
    """The contexts of the store, saved and opened again."""
    path = runtime.shared_path(spark)
    store(spark, sf).save(path)
    return open_store(spark, path).with_metadata(source="again").context_members
