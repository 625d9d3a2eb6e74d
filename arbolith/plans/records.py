"""Queries on records of additions: references, hierarchies, snapshots, nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.functions import text
from arbolith.operators import hierarchy, nested, references, snapshots


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    tables = ("additions", "forwards", "taxa", "canonical_names", "deprecated")
    return references.addition_orphans(*[_table(spark, sf, t) for t in tables])


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_report(p1_found(spark, sf))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.addition_parents(_table(spark, sf, "additions")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.walk_cases(_tree(spark, sf))


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select(
        F.col("id").alias("ott_id"), "root", F.col("depth").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "n_below", "to_ring"
    )


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, sf)).select("ancestor", "descendant", F.col("distance").cast("long").alias("distance"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    values = {"name": text.squeeze(F.col("name")), "parent": F.col("parent")}
    changes = snapshots.snapshot_changes(_table(spark, sf, "addition_snapshots"), "ott_id", "snap_no", "loaded_at", values)
    return changes.select(F.col("snap_no").cast("int").alias("snap_no"), F.col("key").alias("ott_id"), "change_kind", "fields")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).drop("fields")


def p4_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields changed of each taxon that did."""
    return _changes(spark, sf).where("change_kind = 'changed'").select("snap_no", "ott_id", F.explode("fields").alias("field_name"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flat_rows(nested.parse_documents(_table(spark, sf, "addition_docs")))


def p6_taxa(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flat_taxa(nested.parse_documents(_table(spark, sf, "addition_docs")))


def p6_sources(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flat_sources(nested.parse_documents(_table(spark, sf, "addition_docs")))


def p6_flags(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flat_flags(nested.parse_documents(_table(spark, sf, "addition_docs")))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_paths, p2_descendants, p4_found, p4_fields, p6_found, p6_taxa, p6_sources, p6_flags)}

_P1 = """
with rec as (select distinct add_key, addition_id, seq, ott_id, tag, parent, parent_tag, submitted_at from additions),
refs as (
  select 'additions' as table_name, 'parent' as ref_field, add_key as row_key, parent as target, submitted_at as t from rec where parent is not null
  union all select distinct 'forwards', 'ott_id', alias_id, ott_id, made_at from forwards where ott_id is not null),
ids as (select ott_id as id from taxa union select ott_id from canonical_names union select alias_id from forwards),
adds as (select ott_id as id, min(submitted_at) as since from rec where ott_id is not null group by ott_id),
dep as (select ott_id as id, min(coalesce(retired_at, timestamp '0001-01-01')) as gone from deprecated group by ott_id),
judged as (
  select r.*, case when i.id is not null or a.since <= r.t then null when a.id is not null then 'late'
    when d.gone <= r.t then 'deleted' when d.id is not null then null else 'missing' end as reason
  from refs r left join ids i on i.id = r.target left join adds a on a.id = r.target left join dep d on d.id = r.target),
tags as (select addition_id, tag, min(seq) as first_seq from rec where tag is not null group by addition_id, tag),
tagged as (
  select 'additions' as table_name, 'parent_tag' as ref_field, r.add_key as row_key, r.submitted_at as t,
    case when g.first_seq < r.seq then null when g.tag is not null then 'late' else 'missing' end as reason
  from rec r left join tags g on g.addition_id = r.addition_id and g.tag = r.parent_tag
  where r.parent is null and r.parent_tag is not null),
found as (
  select table_name, ref_field, row_key, strftime(t, '%Y-%m') as period_ym, reason from judged where reason is not null
  union all select table_name, ref_field, row_key, strftime(t, '%Y-%m'), reason from tagged where reason is not null)
"""

_P2 = """
with recursive firsts as (
  select ott_id, addition_id, parent, parent_tag, row_number() over (partition by ott_id order by submitted_at, add_key) as rn
  from (select distinct add_key, addition_id, ott_id, parent, parent_tag, submitted_at from additions) where ott_id is not null),
tags as (select addition_id, tag, arg_min(ott_id, seq) as by_tag from additions where tag is not null group by addition_id, tag),
given as (
  select f.ott_id as id, coalesce(f.parent, t.by_tag) as parent
  from firsts f left join tags t on f.parent is null and t.addition_id = f.addition_id and t.tag = f.parent_tag where f.rn = 1),
edges as (select g.id, p.id as parent from given g left join given p on p.id = g.parent),
walk(id, node, steps) as (
  select id, id, 0 from edges
  union all select w.id, e.parent, w.steps + 1 from walk w join edges e on e.id = w.node where e.parent is not null and w.steps < 400),
ends as (select id, max(steps) as steps, arg_max(node, steps) as top from walk group by id),
ring_ids as (select distinct w.node as id from walk w join ends e on e.id = w.id where e.steps = 400 and w.steps >= 200),
rings as (select w.id, min(w.node) as ring_min from walk w join ring_ids r on r.id = w.id where w.steps <= 200 group by w.id),
placed as (
  select e.id, e.top as root, e.steps as depth, false as to_ring from ends e where e.steps < 400
  union all select w.id, arg_min(r.ring_min, w.steps), min(w.steps), true
  from walk w join ends e on e.id = w.id join rings r on r.id = w.node where e.steps = 400 group by w.id)
"""

_P6 = r"""
with last as (select doc_key, body from addition_docs qualify row_number() over (partition by doc_key order by loaded_at desc, body desc) = 1),
outer_doc as (select doc_key, case when json_valid(body) then cast(body as json) end as j from last),
docs as (
  select doc_key, case when j is null then null when json_type(j, '$.addition_document') = 'VARCHAR' then cast(json_extract_string(j, '$.addition_document') as json) else j end as j from outer_doc),
lost as (select doc_key, cast(-1 as bigint) as taxon_pos, 'unreadable' as child_table, cast(-1 as bigint) as child_pos, '' as child_value from docs where j is null),
listed as (
  select doc_key, case json_type(j, '$.taxa') when 'ARRAY' then json_extract(j, '$.taxa[*]') when 'OBJECT' then [json_extract(j, '$.taxa')] else [] end as entries
  from docs where j is not null),
taxon as (
  select doc_key, k - 1 as taxon_pos, entries[k] as t from (select doc_key, entries, unnest(range(1, len(entries) + 1)) as k from listed) where json_type(entries[k]) = 'OBJECT'),
own as (
  select doc_key, taxon_pos, 'taxon' as child_table, cast(-1 as bigint) as child_pos, coalesce(regexp_replace(json_extract_string(t, '$.ott_id'), '\s', '', 'g'), '') as child_value from taxon),
kids as (
  select doc_key, taxon_pos, 'sources' as name, json_type(t, '$.sources') as kind, json_extract(t, '$.sources') as one, json_extract(t, '$.sources[*]') as many from taxon
  union all select doc_key, taxon_pos, 'flags', json_type(t, '$.flags'), json_extract(t, '$.flags'), json_extract(t, '$.flags[*]') from taxon),
listed_kids as (select doc_key, taxon_pos, name, case when kind = 'ARRAY' then many when coalesce(kind, 'NULL') = 'NULL' then [] else [one] end as entries from kids),
kid as (select doc_key, taxon_pos, name, k - 1 as child_pos, entries[k] as e from (select *, unnest(range(1, len(entries) + 1)) as k from listed_kids)),
src as (
  select doc_key, taxon_pos, 'source' as child_table, child_pos,
    case when json_type(e) = 'OBJECT' then json_extract_string(e, '$.source') when json_type(e) = 'VARCHAR' then json_extract_string(e, '$') end as child_value
  from kid where name = 'sources'),
flg as (select doc_key, taxon_pos, 'flag' as child_table, child_pos, case when json_type(e) <> 'NULL' then json_extract_string(e, '$') end as child_value from kid where name = 'flags')
"""

_P4 = r"""
with norm as (
  select snap_no, ott_id, trim(regexp_replace(name, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as name, parent, loaded_at
  from addition_snapshots where ott_id is not null),
last as (select snap_no, ott_id, name, parent from norm qualify row_number() over (partition by snap_no, ott_id order by loaded_at desc, name desc, parent desc) = 1),
follow as (select snap_no as old_no, lead(snap_no) over (order by snap_no) as snap_no from (select distinct snap_no from last)),
a as (select f.snap_no, l.ott_id, l.name, l.parent from last l join follow f on f.old_no = l.snap_no where f.snap_no is not null),
b as (select l.* from last l join follow f on f.snap_no = l.snap_no)
"""

ORACLE = {
    "p1_found": _P1 + "select * from found",
    "p1_report": _P1 + "select table_name, ref_field, period_ym, reason, count(*) as n_refs from found group by all",
    "p2_found": _P2 + "select id as ott_id, root as end_ott_id, cast(depth as bigint) as steps from placed where to_ring or depth > 8",
    "p2_descendants": _P2
    + "select w.node as ancestor, w.id as descendant, cast(w.steps as bigint) as distance from walk w join placed p on p.id = w.id where w.steps between 1 and p.depth",
    "p2_paths": _P2
    + """, below as (select w.node as id, count(*) as n from walk w join placed p on p.id = w.id where w.steps between 1 and p.depth group by w.node),
comps as (select root, count(*) as n from placed where to_ring group by root),
ways as (select p.id, string_agg(cast(w.node as varchar), '/' order by w.steps desc) as path from placed p join walk w on w.id = p.id and w.steps <= p.depth group by p.id)
select p.id as ott_id, p.root, cast(p.depth as bigint) as depth, y.path, case when p.to_ring and p.depth = 0 then c.n - 1 else coalesce(b.n, 0) end as n_below, p.to_ring
from placed p join ways y on y.id = p.id left join below b on b.id = p.id left join comps c on c.root = p.root and p.to_ring""",
    "p6_found": _P6
    + "select doc_key, taxon_pos, child_table, child_pos, child_value from (select * from lost union all select * from own union all select * from src where child_value <> '' union all select * from flg) where child_value is not null",
    "p6_taxa": _P6
    + "select o.doc_key, o.taxon_pos, o.child_value as ott_id, "
    + ", ".join(f"json_extract_string(t.t, '$.{f}') as {f}" for f in ("name", "rank", "parent", "parent_tag", "tag"))
    + " from own o join taxon t on t.doc_key = o.doc_key and t.taxon_pos = o.taxon_pos",
    "p4_found": _P4
    + """select coalesce(a.snap_no, b.snap_no) as snap_no, coalesce(a.ott_id, b.ott_id) as ott_id,
  case when a.ott_id is null then 'added' when b.ott_id is null then 'removed' else 'changed' end as change_kind
from a full outer join b on a.snap_no = b.snap_no and a.ott_id = b.ott_id
where a.ott_id is null or b.ott_id is null or a.name is distinct from b.name or a.parent is distinct from b.parent
""",
    "p4_fields": _P4
    + """select b.snap_no, b.ott_id, v.field_name from a join b on a.snap_no = b.snap_no and a.ott_id = b.ott_id, (values ('name'), ('parent')) v(field_name)
where case v.field_name when 'name' then a.name is distinct from b.name else a.parent is distinct from b.parent end""",
    "p6_sources": _P6
    + "select s.doc_key, s.taxon_pos, s.child_pos, s.child_value as source, case when json_type(k.e) = 'OBJECT' then json_extract_string(k.e, '$.source_type') end as source_type "
    "from src s join kid k on k.doc_key = s.doc_key and k.taxon_pos = s.taxon_pos and k.child_pos = s.child_pos and k.name = 'sources' where s.child_value <> ''",
    "p6_flags": _P6 + "select doc_key, taxon_pos, child_pos, child_value as flag from flg where child_value is not null",
}
