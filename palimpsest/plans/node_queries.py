"""Queries over trees that SQL can build itself: texts as documents of blocks, lines and words, and events' properties as JSON.

The operators are those of plans.changes; here each has SQL beside it that derives the same rows from the text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import mapping, matching, ranges, reports, trees
from palimpsest.operators.assignment import written
from palimpsest.operators.pairs import neighbours
from palimpsest.session import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# ---- texts

#: Nodes of documents' texts: n(unit_id, b, li, wi, kind, depth, size, n_children, sib_idx, path, content, pre, parent_pre).
TEXT_NODES = r"""l as (select doc_id as unit_id, string_split(coalesce(text, ''), chr(10)) as x from documents),
r as (select unit_id, unnest(generate_series(1, len(x))) as r, x from l),
w as (select unit_id, r, regexp_extract_all(x[r], '\S+') as words from r where regexp_matches(x[r], '\S')),
g as (select *, r - row_number() over (partition by unit_id order by r) as grp from w),
k as (select unit_id, dense_rank() over (partition by unit_id order by grp) - 1 as b, row_number() over (partition by unit_id, grp order by r) - 1 as li, words from g),
lines as (select unit_id, b, li, 'line' as kind, 2 as depth, 1 + len(words) as size, len(words) as n_children, array_to_string(words, ' ') as content, words from k),
blocks as (select unit_id, b, 'block' as kind, 1 as depth, 1 + sum(size) as size, count(*) as n_children, string_agg(content, chr(10) order by li) as content from lines group by 1, 2),
docs as (select unit_id, 'document' as kind, 0 as depth, 1 + coalesce(sum(size), 0) as size, count(b) as n_children, coalesce(string_agg(content, chr(10) || chr(10) order by b), '') as content from l left join blocks using (unit_id) group by 1),
every as (
  select unit_id, -1 as b, -1 as li, -1 as wi, kind, depth, size, n_children, 0 as sib_idx, 'document' as path, content from docs union all
  select unit_id, b, -1, -1, kind, depth, size, n_children, b, 'document/block[' || b || ']', content from blocks union all
  select unit_id, b, li, -1, kind, depth, size, n_children, li, 'document/block[' || b || ']/line[' || li || ']', content from lines union all
  select unit_id, b, li, i - 1, 'word', 3, 1, 0, i - 1, 'document/block[' || b || ']/line[' || li || ']/word[' || (i - 1) || ']', words[i] from (select *, unnest(generate_series(1, len(words))) as i from lines)),
placed as (select *, row_number() over (partition by unit_id order by b, li, wi) - 1 as pre from every),
n as (select *, case depth when 0 then null when 1 then 0 when 2 then max(case when kind = 'block' then pre end) over (partition by unit_id, b) else max(case when kind = 'line' then pre end) over (partition by unit_id, b, li) end as parent_pre from placed)"""
#: The mapping of documents with even ids to the next ones by paths: m(pair_id, path, depth, b_pre, a_pre, b_size, a_size, op, ...).
PATH_MAPPING = f"""{TEXT_NODES},
bn as (select *, unit_id as pair_id from n where unit_id % 2 = 0), an as (select *, unit_id - 1 as pair_id from n where unit_id % 2 = 1),
m as (select coalesce(bn.pair_id, an.pair_id) as pair_id, coalesce(bn.path, an.path) as path, coalesce(bn.depth, an.depth) as depth, coalesce(bn.b, an.b) as b, coalesce(bn.li, an.li) as li,
  bn.pre as b_pre, an.pre as a_pre, bn.size as b_size, an.size as a_size, bn.parent_pre as b_parent, an.parent_pre as a_parent,
  case when an.pre is null then 'Delete' when bn.pre is null then 'Insert' when bn.content = an.content and bn.size = an.size then 'Identical' when bn.size = 1 and an.size = 1 then 'Update' else 'MatchButNotIdentical' end as op
  from bn full join an on bn.pair_id = an.pair_id and bn.path = an.path)"""
#: Topmost nodes without a partner: c(pair_id, op, pre, size).
COARSE = f"""{PATH_MAPPING},
u as (select pair_id, 'b' as side, op, b_pre as pre, b_parent as parent, b_size as size from m where op = 'Delete' union all select pair_id, 'a', op, a_pre, a_parent, a_size from m where op = 'Insert'),
c as (select u.pair_id, u.op || case when u.size > 1 then 'WithChildren' else '' end as op, u.pre, u.size from u left join u as up on up.pair_id = u.pair_id and up.side = u.side and up.pre = u.parent where up.pre is null)"""
UNIQUE = f"""{TEXT_NODES},
x as (select *, unit_id - unit_id % 2 as pair_id, unit_id % 2 as side from n where size >= 4),
once as (select pair_id, side, kind, content, min(pre) as pre, min(size) as size, min(parent_pre) as parent, min(path) as path from x group by 1, 2, 3, 4 having count(*) = 1),
met as (select b.pair_id, b.pre as before_pre, a.pre as after_pre, b.size, b.parent as b_parent, a.parent as a_parent, b.path as before_path, a.path as after_path
  from once b join once a on a.pair_id = b.pair_id and a.kind = b.kind and a.content = b.content and b.side = 0 and a.side = 1),
top as (select * from met where not exists (select 1 from met up where up.pair_id = met.pair_id and up.before_pre = met.b_parent and up.after_pre = met.a_parent))"""


def text_nodes(spark: SparkSession, d: str, columns: list[str], where: str = "true") -> DataFrame:
    return trees.flatten(table(spark, d, "documents").where(where).withColumn("language", F.lit("Text")), "doc_id", "text", "language", columns)


def text_sides(spark: SparkSession, d: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    side = lambda k: text_nodes(spark, d, columns, f"doc_id % 2 = {k}").withColumn("pair_id", F.col("unit_id") - k)
    return side(0), side(1)


def path_mapping(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of both sides with pre, parent_pre, size and `more` columns, and their mapping by paths. Texts are parsed and joined once, however often these are used."""
    b, a = (written(n) for n in text_sides(spark, d, ["pre", "parent_pre", "size", "path", "full_hash", *more]))
    return b, a, written(mapping.by_paths(b, a))


@query(f"""with {TEXT_NODES}
select unit_id, cast(pre as integer) as pre, cast(pre - depth + size - 1 as integer) as post, cast(parent_pre as integer) as parent_pre, cast(sib_idx as integer) as sib_idx, cast(depth as integer) as depth,
  cast(size as integer) as size, cast(n_children as integer) as n_children, kind, path from n""")
def text_tree_nodes(spark, d):
    return text_nodes(spark, d, ["pre", "post", "parent_pre", "sib_idx", "depth", "size", "n_children", "kind", "path"])


@query(f"""with {TEXT_NODES} select kind, cast(length(bin(cast(size as bigint))) - 1 as integer) as size_bucket, count(*) as n from n group by 1, 2""")
def text_kind_counts(spark, d):
    return trees.kind_counts(text_nodes(spark, d, ["kind", "size"]))


@query(f"""with {TEXT_NODES} select unit_id, cast(pre as integer) as pre, kind, cast(size as integer) as size, path from n where kind in ('document', 'block') or size >= 45""")
def text_tree_anchors(spark, d):
    return trees.anchors(text_nodes(spark, d, ["pre", "kind", "size", "start", "path", "is_anchor"])).select("unit_id", "pre", "kind", "size", "path")


@query(f"""with {TEXT_NODES} select unit_id, cast(pre as integer) as pre, cast(size as bigint) as counted from n where size > 1""")
def text_subtree_sizes(spark, d):
    up = trees.with_ancestors(text_nodes(spark, d, ["pre", "ancestors"]), ["pre"])
    return up.groupBy("unit_id", F.col("a_pre").alias("pre")).agg((F.count("*") + 1).alias("counted"))


@query(f"""with {TEXT_NODES} select cast(min(size) as integer) as size, count(*) as copies, count(distinct unit_id) as units from n where size >= 4 group by kind, content having count(*) > 1""")
def text_repeated_subtrees(spark, d):
    return trees.repeated_subtrees(text_nodes(spark, d, ["size", "full_hash"])).select("size", "copies", "units")


@query(f"""with {UNIQUE} select pair_id, cast(before_pre as integer) as before_pre, cast(after_pre as integer) as after_pre, cast(size as integer) as size from top""")
def text_unique_subtrees(spark, d):
    return trees.unique_hash_matches(*text_sides(spark, d, ["pre", "size", "parent_pre", "full_hash"]), ["pair_id"])


@query(f"""with {TEXT_NODES} select unit_id, string_agg(repeat('  ', cast(depth as bigint)) || kind || case when n_children = 0 and kind <> 'word' then ' ' when kind = 'word' then ' ' || case when length(content) > 60 then substring(content, 1, 59) || '…' else content end else '' end, chr(10) order by pre) as report from n group by 1""")
def text_tree_dumps(spark, d):
    return reports.tree_dump(text_nodes(spark, d, ["pre", "depth", "kind", "text"]))


@query(f"""with {PATH_MAPPING} select pair_id, cast(b_pre as integer) as b_pre, cast(a_pre as integer) as a_pre, op from m""")
def path_mapping_rows(spark, d):
    return path_mapping(spark, d)[2].select("pair_id", "b_pre", "a_pre", "op")


@query(f"""with {PATH_MAPPING} select pair_id, cast(count_if(op in ('Delete', 'Insert', 'Update')) as bigint) as cost, count(b_pre) as nodes_before, count(a_pre) as nodes_after, cast(count_if(op = 'Identical') as bigint) as identical,
  cast(count_if(op = 'MatchButNotIdentical') as bigint) as matched, cast(count_if(op = 'Update') as bigint) as updated, cast(count_if(op = 'Insert') as bigint) as inserted, cast(count_if(op = 'Delete') as bigint) as deleted from m group by 1""")
def path_mapping_totals(spark, d):
    return matching.totals(path_mapping(spark, d)[2])


@query(f"""with {COARSE} select pair_id, op, cast(pre as integer) as pre, cast(size as integer) as size from c""")
def path_topmost_changes(spark, d):
    b, a, m = path_mapping(spark, d)
    return mapping.coarse(m, b, a)


@query(f"""with {COARSE} select pair_id, cast(sum(size) as bigint) as cost from c group by 1""")
def path_coarse_costs(spark, d):
    b, a, m = path_mapping(spark, d)
    return mapping.coarse_cost(mapping.coarse(m, b, a))


@query(f"""with {PATH_MAPPING}, y as (select * from m where b_pre is not null and a_pre is not null)
select x.pair_id, cast(x.b_pre as integer) as b_pre, cast(x.a_pre as integer) as a_pre, count(*) as shared
from y as x join y on y.pair_id = x.pair_id and y.depth > x.depth and (x.depth = 0 or y.b = x.b) and (x.depth < 2 or y.li = x.li) group by 1, 2, 3""")
def path_containment(spark, d):
    return mapping.shared_descendants(*path_mapping(spark, d, "ancestors"))


@query(f"""with {PATH_MAPPING} select q.pair_id, cast(q.b_pre as integer) as pre, cast(q.b_size as integer) as size from m q left join m up on up.pair_id = q.pair_id and up.b_pre = q.b_parent
where q.op = 'Identical' and up.op is distinct from 'Identical' and q.b_size > 3""")
def path_quiet_subtrees(spark, d):
    b, _, m = path_mapping(spark, d)
    return mapping.quiet_subtrees(b, m, 3)


@query(f"""with {PATH_MAPPING} select pair_id, cast(b_parent as integer) as parent_pre, count(*) as n from m where op = 'Delete' and b_parent is not null group by 1, 2 having count(*) >= 5""")
def path_wide_residuals(spark, d):
    b, _, m = path_mapping(spark, d)
    return mapping.wide_unmapped(b, m, "b", 5)


@query(f"""with {PATH_MAPPING} select pair_id, cast(count_if(op = 'Delete') as bigint) as left_before, cast(count_if(op = 'Insert') as bigint) as left_after, greatest(count_if(op = 'Delete'), count_if(op = 'Insert')) > 5000 as expensive from m group by 1""")
def path_residual_router(spark, d):
    return mapping.router(path_mapping(spark, d)[2])


@query(f"""with {UNIQUE} select pair_id, count(*) as entries, cast(count_if(before_path <> after_path) as bigint) as mismatches from top group by 1""")
def path_mapping_accuracy(spark, d):
    """The mapping by paths against entries taken from subtrees that stand once on each side."""
    b, a, m = path_mapping(spark, d)
    met = trees.unique_hash_matches(b, a, ["pair_id"])
    named = lambda nodes, side: nodes.select("pair_id", F.col("pre").alias(f"{side}_pre"), F.col("path").alias(f"{side}_path"))
    truth = met.join(named(b, "before"), ["pair_id", "before_pre"]).join(named(a, "after"), ["pair_id", "after_pre"])
    return matching.mismatches(m, truth.select("pair_id", F.lit("match_but_not_identical").alias("operation"), "before_path", "after_path"))


@query(f"""with {PATH_MAPPING} select 'left' as side, pair_id, path as b_path, path as a_path from m where op in ('Update', 'MatchButNotIdentical')""")
def path_differences(spark, d):
    """Rows by paths that the whole mapping has and its Identical and one-sided rows have not."""
    m = path_mapping(spark, d)[2]
    return matching.path_differences(m, m.where(F.col("op").isin("Identical", "Insert", "Delete")))


# ---- JSON

#: Events with even ids and the ones that follow: e(pair_id, before, after); their properties have one key and a number.
EVENT_PAIRS = """e as (select b.event_id as pair_id, json_keys(b.props)[1] as key, cast(b.props ->> json_keys(b.props)[1] as varchar) as x, cast(a.props ->> json_keys(a.props)[1] as varchar) as y
  from events b join events a on a.event_id = b.event_id + 1 where b.event_id % 2 = 0)"""


def event_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours(table(spark, d, "events"), "event_id", "props").where("before is not null and after is not null")
    return pairs.withColumn("language", F.lit("JSON"))


def event_side(spark: SparkSession, d: str, k: int, columns: list[str]) -> DataFrame:
    events = table(spark, d, "events").where(F.col("event_id") % 2 == k).withColumn("language", F.lit("JSON"))
    return trees.flatten(events, "event_id", "props", "language", columns).withColumn("pair_id", F.col("unit_id") - k)


@query(f"""with {EVENT_PAIRS}, p as (select unnest(['document', 'document/object[0]', 'document/object[0]/pair[0]', 'document/object[0]/pair[0]/key[0]', 'document/object[0]/pair[0]/number[0]']) as path, unnest([0, 1, 2, 3, 4]) as i)
select pair_id, path as b_path, path as a_path, case when x = y or i = 3 then 'Identical' when i = 4 then 'Update' else 'MatchButNotIdentical' end as op, cast(case when x <> y and i = 4 then 2 else 0 end as integer) as cost from e, p""")
def json_mapping(spark, d):
    return matching.mappings(event_pairs(spark, d)).select("pair_id", "b_path", "a_path", "op", "cost")


@query(f"""with {EVENT_PAIRS} select pair_id, cast(case when x = y then 0 else 2 end as bigint) as cost, cast(5 as bigint) as nodes_before, cast(5 as bigint) as nodes_after, cast(case when x = y then 5 else 1 end as bigint) as identical,
  cast(case when x = y then 0 else 3 end as bigint) as matched, cast(case when x = y then 0 else 1 end as bigint) as updated, cast(0 as bigint) as inserted, cast(0 as bigint) as deleted from e""")
def json_mapping_totals(spark, d):
    return matching.totals(matching.mappings(event_pairs(spark, d)))


@query(f"""with {EVENT_PAIRS} select pair_id, 'ok' as status, cast(5 as integer) as nodes_before, cast(5 as integer) as nodes_after, cast(5 as integer) as mapping_rows, cast(case when x = y then 0 else 2 end as bigint) as cost from e""")
def json_diff_status(spark, d):
    return matching.measured(event_pairs(spark, d)).select("pair_id", "status", "nodes_before", "nodes_after", "mapping_rows", "cost")


@query(f"""with {EVENT_PAIRS} select pair_id, false as fallback, case when x = y then 'NoChanges' end as summary, cast(case when x <> y and length(x) = length(y) then 1 else 0 end as bigint) as updated,
  cast(case when x <> y and length(x) <> length(y) then 1 else 0 end as bigint) as moved from e""")
def json_diff_classes(spark, d):
    """A line takes its last change: where the numbers differ in length, that is the closing brace, which stands in another column."""
    x = ranges.diffs(event_pairs(spark, d))
    return x.select("pair_id", "fallback", "summary", F.col("updated").cast("long").alias("updated"), F.col("moved").cast("long").alias("moved"))


@query("""select event_id as pair_id, 'pair' as kind, json_keys(props)[1] as name, [2] as pres from events where event_id % 2 = 0""")
def json_declared_names(spark, d):
    return mapping.statement_identities(event_side(spark, d, 0, ["pre", "kind", "decl_name"]))


@query(f"""with {EVENT_PAIRS} select pair_id, 'pair' as kind, key as decl_name, cast(2 as integer) as before_pre, cast(2 as integer) as after_pre from e""")
def json_name_matches(spark, d):
    columns = ["pre", "kind", "decl_name"]
    return trees.named_matches(event_side(spark, d, 0, columns), event_side(spark, d, 1, columns), ["pair_id"])


@query("""select event_id as unit_id, cast(0 as integer) as row, cast(0 as integer) as declared_row, json_keys(props)[1] as declared_name from events where event_id % 2 = 0""")
def json_enclosing(spark, d):
    nodes = event_side(spark, d, 0, ["kind", "start_row", "end_row", "depth", "decl_name"])
    return trees.enclosing(nodes.where("kind = 'number'").select("unit_id", F.col("start_row").alias("row")), nodes)


# ---- annotations

#: Entries that every pair of documents has: the whole matches; where pair_id is a multiple of 4, its first block goes with its children, else its first line is changed.
ENTRIES = """t as (select pair_id, 'match_but_not_identical' as operation, 'document' as before_path, 'document' as after_path from (select distinct unit_id - unit_id % 2 as pair_id from n) union all
  select pair_id, 'delete_with_children', 'document/block[0]', null from (select distinct unit_id as pair_id from n where unit_id % 4 = 0) union all
  select pair_id, 'update', 'document/block[0]/line[0]', 'document/block[0]/line[1]' from (select distinct unit_id - unit_id % 2 as pair_id from n where unit_id % 4 >= 2))"""


def text_entries(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 2).alias("pair_id"), F.col("doc_id").alias("id"))
    entry = lambda rows, operation, b, a: rows.select("pair_id").distinct().select("pair_id", F.lit(operation).alias("operation"), F.lit(b).cast("string").alias("before_path"), F.lit(a).cast("string").alias("after_path"))
    return (
        entry(pairs, "match_but_not_identical", "document", "document")
        .unionByName(entry(pairs.where("id % 4 = 0"), "delete_with_children", "document/block[0]", None))
        .unionByName(entry(pairs.where("id % 4 >= 2"), "update", "document/block[0]/line[0]", "document/block[0]/line[1]"))
    )


def text_status(spark: SparkSession, d: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    from palimpsest.operators import annotations

    before, _ = text_sides(spark, d, columns)
    return before, annotations.statuses(before, text_entries(spark, d), "before")


STATUS = f"""{TEXT_NODES}, {ENTRIES},
s as (select unit_id as pair_id, pre, n.path, b, li, kind, size, content, coalesce(t.operation, case when unit_id % 4 = 0 and b = 0 then 'delete_with_children' end) as operation, t.after_path as other_path,
  t.operation is null and unit_id % 4 = 0 and b = 0 as inherited from n left join t on t.pair_id = unit_id and t.before_path = n.path where unit_id % 2 = 0)"""


@query(f"""with {STATUS} select pair_id, cast(pre as integer) as pre, path, operation, other_path, inherited, coalesce(operation = 'identical', true) as identical, coalesce(path <> other_path, false) as moved from s""")
def annotation_status(spark, d):
    from palimpsest.operators import annotations

    return annotations.flags(text_status(spark, d, ["pre", "path", "ancestors"])[1])


#: Entries for the after side: every third pair gets its first block with its children, in others the first line is matched from the second, and one word is as it was.
AFTER = """t as (select pair_id, 'match_but_not_identical' as operation, 'document' as before_path, 'document' as after_path from (select distinct unit_id - unit_id % 2 as pair_id from n) union all
  select pair_id, 'insert_with_children', null, 'document/block[0]' from (select distinct unit_id - unit_id % 2 as pair_id from n) where pair_id % 3 = 0 union all
  select pair_id, 'update', 'document/block[0]/line[1]', 'document/block[0]/line[0]' from (select distinct unit_id - unit_id % 2 as pair_id from n) where pair_id % 3 <> 0 union all
  select pair_id, 'identical', 'document/block[0]/line[0]/word[0]', 'document/block[0]/line[0]/word[0]' from (select distinct unit_id - unit_id % 2 as pair_id from n) where pair_id % 3 = 1)"""
AFTER_STATUS = f"""{TEXT_NODES}, {AFTER},
s as (select n.unit_id - 1 as pair_id, pre, n.path, b, coalesce(t.operation, case when (unit_id - 1) % 3 = 0 and b = 0 then 'insert_with_children' end) as operation, t.before_path as other_path,
  t.operation is null and (unit_id - 1) % 3 = 0 and b = 0 as inherited from n left join t on t.pair_id = unit_id - 1 and t.after_path = n.path where unit_id % 2 = 1)"""


def after_entries(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 2).alias("pair_id")).distinct()
    entry = lambda rows, operation, b, a: rows.select("pair_id", F.lit(operation).alias("operation"), F.lit(b).cast("string").alias("before_path"), F.lit(a).cast("string").alias("after_path"))
    line, word = "document/block[0]/line", "document/block[0]/line[0]/word[0]"
    return (
        entry(pairs, "match_but_not_identical", "document", "document")
        .unionByName(entry(pairs.where("pair_id % 3 = 0"), "insert_with_children", None, "document/block[0]"))
        .unionByName(entry(pairs.where("pair_id % 3 <> 0"), "update", f"{line}[1]", f"{line}[0]"))
        .unionByName(entry(pairs.where("pair_id % 3 = 1"), "identical", word, word))
    )


@query(f"""with {AFTER_STATUS} select pair_id, cast(pre as integer) as pre, path, operation, other_path, inherited, coalesce(operation = 'identical', true) as identical, coalesce(path <> other_path, false) as moved from s""")
def annotation_status_after(spark, d):
    """What people recorded of after-side nodes: their own entries, and what came with all its children."""
    from palimpsest.operators import annotations

    _, after = text_sides(spark, d, ["pre", "path", "ancestors"])
    return annotations.flags(annotations.statuses(after, after_entries(spark, d), "after"))


@query(f"""with {PATH_MAPPING}, {AFTER}, s as (select m.pair_id, m.a_pre, m.path, m.op, coalesce(t.operation, case when m.pair_id % 3 = 0 and m.b = 0 then 'insert_with_children' end) as operation
  from m left join t on t.pair_id = m.pair_id and t.after_path = m.path where m.a_pre is not null)
select pair_id, cast(a_pre as integer) as pre, path, operation, op from s where operation is not null and op <> case operation when 'insert_with_children' then 'Insert' when 'update' then 'Update' when 'identical' then 'Identical' else 'MatchButNotIdentical' end""")
def annotation_disagreements_after(spark, d):
    """After-side nodes that the mapping by paths treats otherwise than people recorded."""
    from palimpsest.operators import annotations

    _, a, m = path_mapping(spark, d, "ancestors")
    return annotations.disagreements(annotations.statuses(a, after_entries(spark, d), "after"), m, "after")


@query(f"""with {TEXT_NODES}, {ENTRIES} select t.pair_id, cast(sum(case operation when 'delete_with_children' then coalesce(n.size, 1) when 'update' then 1 else 0 end) as bigint) as cost
from t left join n on n.unit_id = t.pair_id and n.path = t.before_path group by 1""")
def annotation_cost(spark, d):
    from palimpsest.operators import annotations

    b, a = text_sides(spark, d, ["path", "size"])
    return annotations.cost(text_entries(spark, d), b, a)


@query(f"""with {PATH_MAPPING}, {ENTRIES}, s as (select m.pair_id, m.b_pre, m.path, m.op, coalesce(t.operation, case when m.pair_id % 4 = 0 and m.b = 0 then 'delete_with_children' end) as operation
  from m left join t on t.pair_id = m.pair_id and t.before_path = m.path where m.b_pre is not null)
select pair_id, cast(b_pre as integer) as pre, path, operation, op from s where operation is not null and op <> case operation when 'delete_with_children' then 'Delete' when 'update' then 'Update' else 'MatchButNotIdentical' end""")
def annotation_disagreements(spark, d):
    from palimpsest.operators import annotations

    b, _, m = path_mapping(spark, d, "ancestors")
    return annotations.disagreements(annotations.statuses(b, text_entries(spark, d), "before"), m, "before")


@query(f"""with {PATH_MAPPING}, gg as (select *, op <> 'Delete' as good from m where b_pre is not null)
select x.pair_id, cast(x.b_pre as integer) as pre, bool_and(up.good) as holds from gg x join gg up on up.pair_id = x.pair_id and (x.path = up.path or starts_with(x.path, up.path || '/')) and up.depth <= x.depth and (up.b = -1 or up.b = x.b) and (up.li = -1 or up.li = x.li) group by 1, 2""")
def annotation_paths_hold(spark, d):
    from palimpsest.operators import annotations

    b, _, m = path_mapping(spark, d, "ancestors")
    return annotations.paths_hold(b, m)


@query(f"""with {PATH_MAPPING} select pair_id, rpad(op, 20, ' ') || ' ' || case when b_pre is null then '-' else path end || ' -> ' || case when a_pre is null then '-' else path end as line from m""")
def mapping_dump(spark, d):
    from palimpsest.operators import annotations

    return annotations.dump(path_mapping(spark, d)[2]).select("pair_id", "line")


@query("""select event_type, count(*) as n, round(avg(ln(value)), 6) as mu, round(stddev_pop(ln(value)), 6) as sigma from events where value > 0 group by 1""")
def lognormal_fit(spark, d):
    from palimpsest.functions import stats

    fit = stats.lognormal(table(spark, d, "events"), ["event_type"], "value")
    return fit.select("event_type", "n", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query(f"""with {TEXT_NODES} select unit_id, kind, cast(min(pre) as integer) as pre from n group by 1, 2""")
def first_of_each_kind(spark, d):
    return trees.first_of_kind(text_nodes(spark, d, ["pre", "kind"]))


@query(f"""with {TEXT_NODES} select unit_id, path, case depth when 0 then 'document' when 1 then 'block' when 2 then 'line' else 'word' end as kind, cast(case depth when 0 then 0 else sib_idx end as integer) as number from n""")
def path_segments(spark, d):
    kind, number = trees.last_segment(F.col("path"))
    return text_nodes(spark, d, ["path"]).select("unit_id", "path", kind.alias("kind"), number.alias("number"))
