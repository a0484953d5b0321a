"""Queries of names in scopes and of branches alike, over Python functions that are written from customers and their orders, with SQL from the tables alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import branches, costs, trees
from palimpsest.operators.assignment import written
from palimpsest.plans.changes import doc_pairs
from palimpsest.plans.corpus import PAIRS
from palimpsest.session import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


#: Customers' order numbers and states on both sides: o(c, evens, odds, states), and what the later version lacks and adds.
ORDERS = """o as (select c_custkey as c, coalesce(list(o_orderkey order by o_orderkey) filter (o_orderkey % 2 = 0), []) as evens, coalesce(list(o_orderkey order by o_orderkey) filter (o_orderkey % 2 = 1), []) as odds,
  coalesce(list_sort(list(distinct o_orderstatus) filter (o_orderstatus is not null)), []) as states from customer left join orders on o_custkey = c_custkey group by 1),
s as (
  select c, 'Match' as family, evens as b, list_filter(evens, lambda k: k % 5 <> 0) || case when c % 3 = 0 then [-1] else [] end as a from o union all
  select c, 'Match', odds, list_filter(odds, lambda k: k % 5 <> 0) || case when c % 3 = 0 then [-1] else [] end from o union all
  select c, 'If', list_transform(states, lambda t: ascii(t)), list_transform(list_filter(states, lambda t: t <> 'P'), lambda t: ascii(t)) from o)"""


def functions_(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, before, after): for each customer a Python function that tells the customer's orders and states apart, and a later version of it.

    The later version has its match statements the other way round, without every fifth order number, for every third customer with a case more, and without the state P.
    """
    # keys are small beside the functions that are written from them and parsed: without a number given, all would be dealt to a task or two
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("pair_id"), "o_orderkey", "o_orderstatus").repartition(parts, "pair_id")
    orders = orders.groupBy("pair_id").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"), F.sort_array(F.collect_set("o_orderstatus")).alias("states"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("pair_id")).repartition(parts, "pair_id").join(orders, "pair_id", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    keys, states = F.coalesce("keys", none("bigint")), F.coalesce("states", none("string"))

    def cases(of: Column, name: str, guard: str) -> Column:
        return F.array_join(F.transform(of, lambda k: F.concat(F.lit("        case "), k.cast("string"), F.lit(f"{guard}:\n            {name} = "), k.cast("string"), F.lit("\n"))), "")

    def chain(of: Column) -> Column:
        one = lambda t, i: F.concat(F.when(i == 0, "    if x == '").otherwise("    elif x == '"), t, F.lit("':\n        y = 1\n"))
        return F.array_join(F.transform(of, one), "")

    def version(later: bool) -> Column:
        some = F.filter(keys, lambda k: k % 5 != 0) if later else keys
        more = F.when((F.col("pair_id") % 3 == 0) & F.lit(later), F.array(F.lit(-1).cast("bigint"))).otherwise(none("bigint"))
        even = F.concat(F.lit("    match x:\n"), cases(F.concat(F.filter(some, lambda k: k % 2 == 0), more), "total", ""), F.lit("        case _:\n            pass\n"))
        odd = F.concat(F.lit("    match y:\n"), cases(F.concat(F.filter(some, lambda k: k % 2 == 1), more), "last", " if total > 0"), F.lit("        case _:\n            pass\n"))
        kept = F.filter(states, lambda t: t != "P") if later else states
        body = [odd, even] if later else [even, odd]
        inner = "    def g(x, z: int = 0):\n        total = x\n        total += z\n        return total\n"
        return F.concat(F.lit("def f"), F.col("pair_id").cast("string"), F.lit("(x, y):\n    total = last = 0\n"), *body, F.lit(inner), chain(kept), F.lit("    return total\n"))

    return rows.select("pair_id", version(False).alias("before"), version(True).alias("after"))


def _side(spark: SparkSession, d: str, side: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, units) of a side."""
    units = functions_(spark, d).select(F.col("pair_id").alias("unit_id"), F.col(side).alias("contents"), F.lit("Python").alias("language"))
    return written(trees.flatten(units, "unit_id", "contents", "language", branches.COLUMNS)), units


@query(f"""with {ORDERS},
n as (
  select c, 'f' as scope, 'parameter' as bucket, unnest(['x', 'y']) as name, 1 as places from o union all
  select c, 'g', 'parameter', unnest(['x', 'z']), 1 from o union all
  select c, 'g', 'assignment', 'total', 2 from o union all
  select c, 'f', 'assignment', 'total', 1 + len(evens) from o union all
  select c, 'f', 'assignment', 'last', 1 + len(odds) from o union all
  select c, 'f', 'assignment', 'y', len(states) from o where len(states) > 0)
select c as unit_id, scope, bucket, name, cast(places as bigint) as places from n""")
def names_in_scopes(spark, d):
    """How often a name is bound in each scope: parameters and assignments, told apart by the innermost function."""
    nodes, _ = _side(spark, d, "before")
    groups = branches.name_groups(branches.local_names(nodes))
    # the outer function is the only one below the module
    named = groups.join(nodes.where("kind = 'FunctionDef'").select("unit_id", F.col("pre").alias("scope"), F.when(F.col("depth") == 1, "f").otherwise("g").alias("function")), ["unit_id", "scope"])
    return named.select("unit_id", F.col("function").alias("scope"), "bucket", "name", F.size("pres").cast("long").alias("places"))


@query(f"""with {ORDERS}, j as (select *, len(list_intersect(a, b)) as n_both, len(list_distinct(a || b)) as n_any from s)
select c as pair_id, family, cast(len(b) as bigint) as b_arms, cast(len(a) as bigint) as a_arms, cast(n_both as bigint) as matched, round(1 - n_both / n_any, 9) as cost from j where n_both > 0 and n_both >= 0.75 * n_any""")
def branches_alike(spark, d):
    """Branches of both versions that share three quarters of their arms, with the arms of each and those that have a partner."""
    both = [branches.arms(*_side(spark, d, side), "contents").withColumnRenamed("unit_id", "pair_id") for side in ("before", "after")]
    b, a = (written(x) for x in both)
    met = written(branches.alike_branches(b, a))
    shared = branches.matching_arms(b, a, met).groupBy("pair_id", F.col("b_branch").alias("b_pre")).agg(F.count("*").alias("matched"))
    count = lambda x, s: x.where("signature is not null").groupBy("pair_id", F.col("branch").alias(f"{s}_pre")).agg(F.count("*").alias(f"{s}_arms"))
    return met.join(count(b, "b"), ["pair_id", "b_pre"]).join(count(a, "a"), ["pair_id", "a_pre"]).join(shared, ["pair_id", "b_pre"]).select("pair_id", "family", "b_arms", "a_arms", "matched", "cost")


@query(f"""with p as {PAIRS} select unnest(['parse', 'lines']) as tool, count(*) as pairs, count(*) as ok, 2 * count(*) as timings from p""")
def comparison_costs(spark, d):
    """How many pairs each way of comparing was timed on (times and memory, which differ from run to run, are in costs.summary())."""
    pairs = doc_pairs(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # small tables too are timed in many tasks
    return costs.summary(costs.costs(pairs, 2, ["parse", "lines"])).select("tool", "pairs", "ok", "timings")
