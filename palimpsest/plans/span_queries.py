"""Queries of projected ranges and of line diffs in gaps, over documents and edited versions of them, with SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import patience, spans
from palimpsest.operators.assignment import written
from palimpsest.plans.claim_queries import CLAIMS, EDITED, SIDES, edited

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Words of both sides with their places: wd(pair_id, side, pre, ord, start, finish, col, content). A line's characters are listed once, and words begin where white space ends.
WORDS = r"""rr as (select unit_id, unnest(generate_series(1, len(x))) as r, x from l),
rs as (select unit_id, r, x[r] as s, coalesce(sum(len(x[r]) + 1) over (partition by unit_id order by r rows between unbounded preceding and 1 preceding), 0) as off from rr),
cc as (select *, string_split(s, '') as c from rs where regexp_matches(s, '\S')),
st as (select *, list_filter(generate_series(1, len(c)), lambda p: not regexp_matches(c[p], '\s') and (p = 1 or regexp_matches(c[p - 1], '\s'))) as p, regexp_extract_all(s, '\S+') as ws from cc),
ow as (select unit_id, r, i, cast(off + p[i] - 1 as bigint) as start, p[i] - 1 as col, ws[i] as content from (select *, unnest(generate_series(1, len(ws))) as i from st)),
oo as (select *, row_number() over (partition by unit_id order by r, i) as ord from ow),
nw as (select pair_id, side, unit_id, pre, row_number() over (partition by unit_id order by pre) as ord from x where kind = 'word'),
wd as (select nw.pair_id, nw.side, nw.pre, nw.ord, start, start + len(content) as finish, col, content from nw join oo using (unit_id, ord))"""


def _spans(mapping_sql: str) -> str:
    """SQL: sp(pair_id, side, number, start, finish, to_start, to_finish, op) from words and mp(pair_id, b_pre, a_pre)."""
    return f"""{WORDS}, {mapping_sql},
mm as (select pair_id, 0 as side, b_pre as pre, a_pre as other from mp union all select pair_id, 1, a_pre, b_pre from mp),
pl as (
  select w.*, o.ord as o_ord, o.start as xs, o.finish as ys,
    case when o.pre is null then case w.side when 0 then 'Delete' else 'Insert' end when w.content <> o.content then 'Update' when w.col = o.col then 'Identical' else 'Move' end as op
  from wd w left join mm on mm.pair_id = w.pair_id and mm.side = w.side and mm.pre = w.pre left join wd o on o.pair_id = w.pair_id and o.side = 1 - w.side and o.pre = mm.other
),
ll as (
  select *, coalesce(last_value(ys ignore nulls) over (partition by pair_id, side order by ord rows between unbounded preceding and 1 preceding), 0) as lim,
    lag(op) over (partition by pair_id, side order by ord) as op0, lag(o_ord) over (partition by pair_id, side order by ord) as ord0 from pl
),
il as (select *, sum(case when op = op0 and (o_ord is null or o_ord = ord0 + 1) then 0 else 1 end) over (partition by pair_id, side order by ord) as num from ll),
sp as (select pair_id, case side when 0 then 'before' else 'after' end as side, cast(num - 1 as bigint) as number, min(start) as start, max(finish) as finish, arg_min(coalesce(xs, lim), ord) as to_start, arg_max(coalesce(ys, lim), ord) as to_finish, op from il group by pair_id, side, num, op)"""


_BY_PATH = "mp as (select p.pair_id, p.pre as b_pre, q.pre as a_pre from x p join x q on q.pair_id = p.pair_id and q.path = p.path and p.side = 0 and q.side = 1)"
_CLAIMED = "mp as (select pair_id, b_pre + i as b_pre, a_pre + i as a_pre from (select *, unnest(generate_series(0, size - 1)) as i from c))"
_OUT = "pair_id, side, number, cast(start as integer) as start, cast(finish as integer) as finish, cast(to_start as integer) as to_start, cast(to_finish as integer) as to_finish, op"


@query(f"with {SIDES}, {_spans(_BY_PATH)} select {_OUT} from sp")
def diff_ranges(spark, d):
    """Ranges of both sides where nodes of one path are partners: words that stay, move, change, come and go."""
    return spans.in_place(edited(spark, d), "path")


@query(f"with {CLAIMS}, {_spans(_CLAIMED)} select {_OUT} from sp")
def diff_ranges_of_claims(spark, d):
    """Ranges of both sides where equal subtrees are partners wherever they stand."""
    return spans.in_place(edited(spark, d), "claims")


@query(f"""with {CLAIMS}, {_spans(_CLAIMED)},
th as (select *, cast(count_if(op <> 'Insert') over (partition by pair_id order by number) as bigint) as pos from sp where side = 'after'),
mi as (
  select pair_id, number as pos, 1 as own, number, start, finish, to_start, to_finish, op from sp where side = 'before' union all
  select th.pair_id, pos, 0, number, to_start, to_finish, start, finish, 'Delete' from th join (select pair_id, max(number) as last from sp where side = 'before' group by 1) using (pair_id) where op = 'Insert' and pos <= last
),
al as (select pair_id, 'before' as side, row_number() over (partition by pair_id order by pos, own, number) - 1 as number, * exclude (pair_id, pos, own, number) from mi union all select * from sp where side = 'after')
select {_OUT} from al""")
def mirrored_ranges(spark, d):
    """The same, with what was added shown as empty ranges on the before side."""
    return spans.in_place(edited(spark, d), "claims", mirror=True)


@query(f"""with {SIDES}, {_spans(_BY_PATH)},
ro as (select unit_id - unit_id % 2 as pair_id, case unit_id % 2 when 0 then 'before' else 'after' end as side, r - 1 as row, off as a, off + len(s) as z from rs),
tt as (select ro.pair_id, ro.side, ro.row, arg_max(sp.op, sp.number) as op from ro join sp on sp.pair_id = ro.pair_id and sp.side = ro.side and sp.op <> 'Identical' and sp.finish > sp.start and sp.start <= ro.z and sp.finish > ro.a group by all)
select ro.pair_id, ro.side, cast(ro.row as integer) as row, coalesce(tt.op, 'Identical') as op from ro left join tt on tt.pair_id = ro.pair_id and tt.side = ro.side and tt.row = ro.row""")
def range_labels(spark, d):
    """The operation of each line, from ranges."""
    return spans.line_labels(edited(spark, d), "path")


#: Lines that stand once on each side, in order, and the length of a longest run of them in the same order.
_ONCE = f"""recursive {EDITED},
ends as (select unit_id, case when len(x) > 0 and x[-1] = '' then x[:-2] else x end as x from l),
ln as (select unit_id - unit_id % 2 as pair_id, unit_id % 2 as side, unnest(generate_series(1, len(x))) as r, x from ends),
lo as (select pair_id, side, regexp_replace(x[r], '\\r$', '') as line, min(r) as r from ln group by 1, 2, 3 having count(*) = 1),
me as (select b.pair_id, b.r as b, a.r as a from lo b join lo a on a.pair_id = b.pair_id and a.line = b.line and b.side = 0 and a.side = 1),
se as (select pair_id, list(a order by b) as v from me group by 1),
lis as (
  select pair_id, v, 1 as i, cast([] as bigint[]) as tops from se
  union all
  select pair_id, v, i + 1, tops[:k] || [v[i]] || tops[k + 2:] from (select *, len(list_filter(tops, lambda t: t < v[i])) as k from lis where i <= len(v))
)"""


@query(f"with {_ONCE} select pair_id, cast(len(v) as bigint) as anchors, cast(len(tops) as bigint) as kept from lis where i > len(v)")
def patience_anchors(spark, d):
    """How many lines stand once on each side, and how many of them a heaviest chain of their runs keeps."""
    lines = written(patience.hashed_lines(edited(spark, d)))
    found = written(patience.anchors(patience.first_gaps(lines), lines))
    kept = patience.chained(found).where("n is not null").groupBy("pair_id").agg(F.sum("n").alias("kept"))
    return found.groupBy("pair_id").agg(F.count("*").alias("anchors")).join(kept, "pair_id").select("pair_id", "anchors", "kept")


@query()
def patience_counts(spark, d):
    """Lines inserted and deleted, by unique lines first and common subsequences in the gaps."""
    return patience.counts(edited(spark, d))
