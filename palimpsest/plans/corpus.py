"""Queries over a corpus: file and change statistics, samples, comparisons, and pairs of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import languages as L
from palimpsest.functions import stats as S
from palimpsest.functions import text as T
from palimpsest.operators import pairs as P
from palimpsest.operators import sampling
from palimpsest.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAIRS = """(select coalesce(b.doc_id, a.doc_id - 1) as pair_id, b.text as before, a.text as after
  from (select * from documents where doc_id % 2 = 0) b full join (select * from documents where doc_id % 2 = 1) a on a.doc_id = b.doc_id + 1)"""
LINES = """(select pair_id, side, cast(i - 1 as integer) as "row", l[i] as line from (
  select pair_id, side, l, unnest(generate_series(1, len(l))) as i from (
  select pair_id, side, case when t = '' then [] when t like '%' || chr(10) then string_split(t, chr(10))[1:-2] else string_split(t, chr(10)) end as l from (
  select pair_id, 'before' as side, replace(coalesce(before, ''), chr(13) || chr(10), chr(10)) as t from {pairs} union all
  select pair_id, 'after', replace(coalesce(after, ''), chr(13) || chr(10), chr(10)) from {pairs}))))""".format(pairs=PAIRS)


def doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbours(table(spark, d, "documents"), "doc_id", "text")


# ---- file statistics


@query(f"""
select doc_id, cast(strlen(text) as bigint) as bytes, cast(length(text) - length(replace(text, chr(10), '')) as bigint) as lines_of_code,
  len(list_filter(string_split(text, chr(10))[1:50], lambda x: regexp_matches(x, {literal(T.GENERATED)}))) > 0 as generated,
  strlen(text) > 1048576 as too_large,
  case when strlen(text) < 1000 then 'small' when strlen(text) < 10000 then 'medium' when strlen(text) < 100000 then 'large' else 'xlarge' end as size_bucket
from documents""")
def file_metrics(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.octet_length(t).cast("long").alias("bytes"), T.line_feeds(t).alias("lines_of_code"), T.is_generated(t).alias("generated"),
        (F.octet_length(t) > T.TOO_LARGE).alias("too_large"), S.size_bucket(F.octet_length(t)).alias("size_bucket"),
    )


@query("""
select lang as language, count(*) as files, cast(sum(n_chars) as bigint) as chars, round(100.0 * count(*) / sum(count(*)) over (), 6) as percentage
from documents group by lang""")
def language_distribution(spark, d):
    counts = table(spark, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    total = counts.agg(F.sum("files").alias("_all"))
    return counts.join(F.broadcast(total)).select("language", "files", "chars", F.round(100.0 * F.col("files") / F.col("_all"), 6).alias("percentage"))


@query("""
with c as (select source, count(*) as n, row_number() over (order by count(*) desc, source) as r from documents group by source)
select case when r <= 9 then source else 'Other' end as source, cast(sum(n) as bigint) as n from c group by 1""")
def top_sources_and_other(spark, d):
    return sampling.top_and_other(table(spark, d, "documents"), "source", 9)


@query("""
select string_split(p_type, ' ')[1] as category, count(*) as files, count(distinct p_brand) as projects,
  round(count(*) / count(distinct p_brand), 6) as files_per_project from part group by 1 order by files desc, category limit 10""")
def category_counts(spark, d):
    part = table(spark, d, "part").withColumn("category", F.split("p_type", " ")[0])
    g = part.groupBy("category").agg(F.count("*").alias("files"), F.countDistinct("p_brand").alias("projects"))
    return g.withColumn("files_per_project", F.round(F.col("files") / F.col("projects"), 6)).orderBy(F.desc("files"), "category").limit(10)


QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p99_9": 0.999, "p99_99": 0.9999, "max": 1.0}


@query(
    """
with m as (select lang, unnest(['bytes', 'chars', 'lines']) as metric,
    unnest([strlen(text), length(text), length(text) - length(replace(text, chr(10), ''))]) as v from documents),
a as (select 'All' as language, metric, v from m union all select lang, metric, v from m),
r as (select *, row_number() over (partition by language, metric order by v) - 1 as k, count(*) over (partition by language, metric) as n from a)
select language, metric, """
    + ", ".join(f"cast(max(case when k = floor({q} * (n - 1) + 0.5) then v end) as double) as {name}" for name, q in QUANTILES.items())
    + " from r group by language, metric"
)
def percentiles_nearest(spark, d):
    t = F.col("text")
    wide = table(spark, d, "documents").select("lang", F.octet_length(t).cast("long").alias("bytes"), F.length(t).cast("long").alias("chars"), T.line_feeds(t).alias("lines"))
    long = wide.unpivot("lang", ["bytes", "chars", "lines"], "metric", "v")
    both = long.select(F.explode(F.array(F.lit("All"), F.col("lang"))).alias("language"), "metric", "v")
    return S.quantiles(both, ["language", "metric"], "v", QUANTILES)


@query("""
select o_orderpriority as priority, count(*) as n, round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.5), 4) as p50,
  round(quantile_cont(o_totalprice, 0.75), 4) as p75, round(quantile_cont(o_totalprice, 0.9), 4) as p90, round(quantile_cont(o_totalprice, 0.99), 4) as p99,
  round(max(o_totalprice), 4) as max from orders group by 1""")
def percentiles_linear(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("v"))
    base = o.groupBy("priority").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.max("v"), 4).alias("max"))
    q = S.quantiles(o, ["priority"], "v", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}, linear=True)
    return base.join(q, "priority").select("priority", "n", "mean", "max", *(F.round(c, 4).alias(c) for c in ("p50", "p75", "p90", "p99")))


@query("""
select o_orderkey, o_orderstatus as series, round(row_number() over w / count(*) over (partition by o_orderstatus), 9) as share
from orders window w as (partition by o_orderstatus order by o_totalprice, o_orderkey)""")
def cumulative_distribution(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("series"), "o_totalprice")
    return S.ranked(o, ["series"], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "series", F.round(F.col("rank") / F.col("n"), 9).alias("share"))


@query("""
select l_returnflag as grp, count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as correlation,
  round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from lineitem group by 1""")
def correlation_and_fit(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(
        F.count("*").alias("n"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"),
    )


@query("""
with c as (select l_orderkey, min(l_returnflag) as series, 100 * stddev_pop(l_quantity) / avg(l_quantity) as cov from lineitem group by 1 having count(*) >= 2 and avg(l_quantity) > 0)
select series, count(*) as fixtures, round(avg(cov), 4) as mean_cov, round(quantile_cont(cov, 0.5), 4) as median_cov, round(quantile_cont(cov, 0.9), 4) as p90_cov from c group by 1 having count(*) >= 3""")
def timing_variation(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("series"), F.stddev_pop("l_quantity").alias("s"), F.avg("l_quantity").alias("m"), F.count("*").alias("k"))
    c = g.where("k >= 2 and m > 0").select("series", (100 * F.col("s") / F.col("m")).alias("cov"))
    base = c.groupBy("series").agg(F.count("*").alias("fixtures"), F.round(F.avg("cov"), 4).alias("mean_cov")).where("fixtures >= 3")
    q = S.quantiles(c, ["series"], "cov", {"median_cov": 0.5, "p90_cov": 0.9}, linear=True)
    return base.join(q, "series").select("series", "fixtures", "mean_cov", F.round("median_cov", 4).alias("median_cov"), F.round("p90_cov", 4).alias("p90_cov"))


@query("""
with m as (select l_linestatus, l_extendedprice as x, avg(l_extendedprice) over (partition by l_linestatus) as mu from lineitem)
select l_linestatus as series, count(*) as n, round(avg(x), 3) as mean, round(stddev_samp(x), 3) as std,
  round(avg((x - mu) * (x - mu) * (x - mu)) / pow(avg((x - mu) * (x - mu)), 1.5), 5) as skew,
  round(quantile_cont(x, 0.5), 3) as p50, round(quantile_cont(x, 0.9), 3) as p90, round(quantile_cont(x, 0.99), 3) as p99, round(max(x), 3) as max from m group by 1""")
def description(spark, d):
    x = S.describe(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("series"), F.col("l_extendedprice").alias("x")), ["series"], "x")
    return x.select("series", "n", F.round("skew", 5).alias("skew"), *(F.round(c, 3).alias(c) for c in ("mean", "std", "p50", "p90", "p99", "max")))


@query("""
select cast(least(greatest(floor((log10(o_totalprice) - 2) / 0.1), 0), 39) as integer) as bin, count(*) as n,
  round(avg(ln(o_totalprice)), 6) as mu, round(stddev_pop(ln(o_totalprice)), 6) as sigma from orders where o_totalprice > 0 group by 1""")
def log_histogram(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 0")
    ln = F.log("o_totalprice")
    return o.groupBy(S.log_bin(F.col("o_totalprice"), 1e2, 1e6, 40).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(ln), 6).alias("mu"), F.round(F.stddev_pop(ln), 6).alias("sigma"))


@query("""
with a as (select l_orderkey, 100 - 100.0 * count(*) filter (l_returnflag = 'R') / count(*) as agreement from lineitem group by 1)
select cast(least(floor(agreement / 10), 9) as integer) as bin, count(*) as fixtures from a group by 1""")
def agreement_histogram(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("m"), F.count("*").alias("t"))
    return a.select((100 - S.safe_percent(F.col("m"), F.col("t"))).alias("x")).groupBy(F.least(F.floor(F.col("x") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("fixtures"))


@query("""
with b as (select l_orderkey, sum(l_extendedprice) / 100 as ms from lineitem group by 1),
a as (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) / 150 as ms from lineitem where l_linenumber <> 3 group by 1),
j as (select b.ms as before, a.ms as after, b.ms / greatest(a.ms, 1e-6) as speedup from b join a using (l_orderkey))
select count(*) as pairs, round(avg(speedup), 5) as mean_speedup, round(quantile_cont(speedup, 0.5), 5) as median_speedup, round(max(speedup), 5) as max_speedup,
  count(*) filter (speedup >= 2) as twice, count(*) filter (speedup >= 10) as tenfold,
  count(*) filter (before >= 1000) as slow_before, count(*) filter (after >= 1000) as slow_after, count(*) filter (before >= 5000) as very_slow_before, count(*) filter (after >= 5000) as very_slow_after from j""")
def run_comparison(spark, d):
    li = table(spark, d, "lineitem")
    before = li.groupBy("l_orderkey").agg((F.sum("l_extendedprice") / 100).alias("before"))
    after = li.where("l_linenumber <> 3").groupBy("l_orderkey").agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 150).alias("after"))
    j = before.join(after, "l_orderkey").withColumn("speedup", F.col("before") / F.greatest("after", F.lit(1e-6)))
    base = j.agg(
        F.count("*").alias("pairs"), F.round(F.avg("speedup"), 5).alias("mean_speedup"), F.round(F.max("speedup"), 5).alias("max_speedup"),
        F.count_if(F.col("speedup") >= 2).alias("twice"), F.count_if(F.col("speedup") >= 10).alias("tenfold"),
        *(F.count_if(F.col(side) >= ms).alias(f"{name}_{side}") for name, ms in (("slow", 1000), ("very_slow", 5000)) for side in ("before", "after")),
    )
    q = S.quantiles(j.select(F.lit(1).alias("_one"), "speedup"), ["_one"], "speedup", {"median_speedup": 0.5}, linear=True).select(F.round("median_speedup", 5).alias("median_speedup"))
    return base.join(F.broadcast(q))


@query("""
select event_type as status, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percentage, round(avg(value), 4) as mean, round(max(value), 4) as max,
  count(distinct user_id) as users from events group by 1""")
def status_summary(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("max"), F.countDistinct("user_id").alias("users"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("_all")))).select("status", "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("percentage"), "mean", "max", "users")


@query("""
with c as (select p_brand as language, p_type as kind, count(*) as total from part group by 1, 2),
r as (select *, round(100.0 * total / sum(total) over (partition by language), 6) as percentage, row_number() over (partition by language order by total desc, kind) as rank from c)
select language, kind, total, percentage, cast(rank as integer) as rank from r where rank <= 5""")
def top_kinds_by_language(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_brand").alias("language"), F.col("p_type").alias("kind")).agg(F.count("*").alias("total"))
    t = c.groupBy("language").agg(F.sum("total").alias("_all"))
    p = c.join(t, "language").select("language", "kind", "total", F.round(100.0 * F.col("total") / F.col("_all"), 6).alias("percentage"))
    return sampling.top_per_group(p, ["language"], [F.desc("total"), F.asc("kind")], 5)


@query("""
with s as (select doc_id, lang, case when strlen(text) < 1000 then 'small' when strlen(text) < 10000 then 'medium' when strlen(text) < 100000 then 'large' else 'xlarge' end as bucket from documents)
select doc_id, lang, bucket from s qualify row_number() over (partition by lang, bucket order by md5(cast(doc_id as varchar)), doc_id) <= 4""")
def stratified_sample(spark, d):
    s = table(spark, d, "documents").select("doc_id", "lang", S.size_bucket(F.octet_length("text")).alias("bucket"))
    return sampling.stratified(s, ["lang", "bucket"], ["doc_id"], 4)


@query("""
with e as (select doc_id, lang from documents where doc_id % 40 = 0), h as (select lang, count(*) as have from e group by 1),
f as (select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) as r from documents where doc_id not in (select doc_id from e))
select f.doc_id, f.lang from f left join h using (lang) where r <= 20 - coalesce(have, 0)""")
def sample_refill(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.refill(docs, docs.where("doc_id % 40 = 0"), "lang", ["doc_id"], 20)


@query("""
select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def upsert_latest(spark, d):
    return sampling.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""
with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'O')
select coalesce(a.k, b.k) as o_custkey, case when b.k is null then 'left' else 'right' end as side from a full join b on a.k = b.k where a.k is null or b.k is null""")
def symmetric_difference(spark, d):
    o = table(spark, d, "orders")
    return sampling.differences(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("""
select lang as kind, cast(floor(log2(n_chars)) as integer) as size_bucket, count(*) as n from documents where n_chars > 0 group by 1, 2""")
def log2_histogram(spark, d):
    docs = table(spark, d, "documents").where("n_chars > 0")
    return docs.groupBy(F.col("lang").alias("kind"), S.log2_bucket(F.col("n_chars")).alias("size_bucket")).agg(F.count("*").alias("n"))


EXTENSIONS = ["py", "rs", "h", "HPP", "tar.gz", "unknown", "json.test", "rs.test.test", "md", "toml", "svg", "parquet"]
_PATH = "source || '/' || lang || case when doc_id % 17 = 0 then '/third_party' else '' end || '/file' || doc_id || '.' || [" + ", ".join(map(literal, EXTENSIONS)) + f"][doc_id % {len(EXTENSIONS)} + 1]"
_CASE = lambda d, i=None: " ".join(f"when {literal(k)} then {literal(v if i is None else v[i])}" for k, v in d.items())


@query(f"""
with p as (select doc_id, {_PATH} as path from documents),
e as (select *, lower(regexp_extract(path, '\\.([^.]*)$', 1)) as ext, lower(regexp_extract(regexp_replace(path, '(\\.test)+$', ''), '\\.([^.]*)$', 1)) as code_ext from p)
select doc_id, path, string_split(path, '/')[-1] as file_name, ext as extension, string_split(path, '/')[1] as project,
  coalesce(case code_ext {_CASE(L.EXTENSION_LANGUAGE)} end, 'Unknown') as language,
  coalesce(case ext {" ".join(f"when {literal(k)} then 'Code'" for k in L.EXTENSION_LANGUAGE)} {_CASE(L.EXTENSION_TYPE, 0)} end, 'Unknown') as category,
  coalesce(case ext {" ".join(f"when {literal(k)} then 'Uncategorized'" for k in L.EXTENSION_LANGUAGE)} {_CASE(L.EXTENSION_TYPE, 1)} end, '') as subtype,
  path like '%third_party%' as skipped from e""")
def path_derivations(spark, d):
    path = F.concat(
        F.col("source"), F.lit("/"), F.col("lang"), F.when(F.col("doc_id") % 17 == 0, "/third_party").otherwise(""), F.lit("/file"), F.col("doc_id").cast("string"), F.lit("."),
        F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int")),
    )
    p = table(spark, d, "documents").select("doc_id", path.alias("path"))
    c = F.col("path")
    return p.select(
        "doc_id", "path", L.file_name(c).alias("file_name"), L.extension(c).alias("extension"), F.split("path", "/")[0].alias("project"), L.language(c).alias("language"),
        L.file_type(c)["category"].alias("category"), L.file_type(c)["subtype"].alias("subtype"), L.skipped(c).alias("skipped"),
    )


@query("""
with c as (select o_custkey as commit_id, count(*) as files, sum(o_totalprice) as size from orders group by 1)
select count(*) as commits, cast(sum(files) as bigint) as changed_files, round(avg(files), 6) as mean_files,
  round(quantile_cont(files, 0.5), 6) as p50_files, round(quantile_cont(files, 0.9), 6) as p90_files, max(files) as max_files from c""")
def files_per_commit(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("files"))
    base = c.agg(F.count("*").alias("commits"), F.sum("files").alias("changed_files"), F.round(F.avg("files"), 6).alias("mean_files"), F.max("files").alias("max_files"))
    q = S.quantiles(c.select(F.lit(1).alias("_one"), "files"), ["_one"], "files", {"p50_files": 0.5, "p90_files": 0.9}, linear=True)
    return base.join(F.broadcast(q.select(F.round("p50_files", 6).alias("p50_files"), F.round("p90_files", 6).alias("p90_files"))))


@query("""
with r as (select l_orderkey // 1000 as solution, l_returnflag || ':' || l_linestatus as reason from lineitem)
select case when grouping(solution) = 1 then 'TOTAL' else cast(solution as varchar) end as solution,
  count(*) filter (reason = 'A:F') as "A:F", count(*) filter (reason = 'N:F') as "N:F", count(*) filter (reason = 'N:O') as "N:O", count(*) filter (reason = 'R:F') as "R:F", count(*) as total
from r group by rollup (solution)""")
def reason_pivot(spark, d):
    r = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).cast("string").alias("solution"), F.concat_ws(":", "l_returnflag", "l_linestatus").alias("reason"))
    one = lambda k: F.count_if(F.col("reason") == k).alias(k)
    g = r.rollup("solution").agg(*map(one, ("A:F", "N:F", "N:O", "R:F")), F.count("*").alias("total"), F.grouping("solution").alias("_g"))
    return g.withColumn("solution", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("solution"))).drop("_g")


@query("""
with r as (select l_orderkey // 1000 as solution, l_returnflag as reason, count(*) as n from lineitem group by 1, 2)
select cast(solution as bigint) as solution, reason, n, round(100.0 * n / sum(n) over (partition by solution), 6) as share from r""")
def reason_shares(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 1000).cast("long").alias("solution"), F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("n"))
    t = n.groupBy("solution").agg(F.sum("n").alias("_all"))
    return n.join(t, "solution").select("solution", "reason", "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("share"))


@query("""
with s as (select l_orderkey, string_agg(cast(cast(l_quantity as integer) as varchar), ';' order by l_linenumber, cast(cast(l_quantity as integer) as varchar)) as cell from lineitem group by 1),
a as (select l_orderkey, cell, list_transform(string_split(cell, ';'), lambda x: cast(x as double)) as v from s)
select l_orderkey, cell, cast(len(v) as integer) as repeats, round(list_sum(v) / len(v), 6) as mean, round(list_median(v), 6) as median from a""")
def repeat_cells(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q")))).alias("r"))
    c = g.select("l_orderkey", F.array_join(F.transform("r", lambda x: x["q"]), ";").alias("cell")).withColumn("v", F.array_sort(T.repeats(F.col("cell"))))
    n = F.size("v")
    median = (F.element_at("v", F.ceil(n / 2).cast("int")) + F.element_at("v", (F.floor(n / 2) + 1).cast("int"))) / 2
    return c.select("l_orderkey", "cell", n.alias("repeats"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / n, 6).alias("mean"), F.round(median, 6).alias("median"))


# ---- pairs of texts


@query(f"""
with p as {PAIRS}
select pair_id, coalesce(strlen(before), 0) as bytes_before, coalesce(strlen(after), 0) as bytes_after,
  coalesce(length(before) - length(replace(before, chr(10), '')), 0) as lines_before, coalesce(length(after) - length(replace(after, chr(10), '')), 0) as lines_after,
  coalesce(length(after) - length(replace(after, chr(10), '')), 0) - coalesce(length(before) - length(replace(before, chr(10), '')), 0) as line_delta,
  case when coalesce(before, '') = coalesce(after, '') then 'NoChanges'
    when regexp_replace(coalesce(before, ''), '\\s+', '', 'g') = regexp_replace(coalesce(after, ''), '\\s+', '', 'g') then 'WhitespaceOnly'
    when coalesce(before, '') = '' then 'NewFile' when coalesce(after, '') = '' then 'DeletedFile' end as summary from p""")
def pair_statistics(spark, d):
    p = doc_pairs(spark, d)
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    count = lambda c: F.coalesce(T.line_feeds(F.col(c)), F.lit(0)).cast("long")
    return p.select(
        "pair_id", size("before").alias("bytes_before"), size("after").alias("bytes_after"), count("before").alias("lines_before"), count("after").alias("lines_after"),
        (count("after") - count("before")).alias("line_delta"), P.content_summary(F.col("before"), F.col("after")).alias("summary"),
    )


@query(f"""
with c as (select pair_id, line, count(*) filter (side = 'before') as b, count(*) filter (side = 'after') as a from {LINES} group by 1, 2)
select p.pair_id, cast(coalesce(sum(greatest(b - a, 0)), 0) as bigint) as deleted, cast(coalesce(sum(greatest(a - b, 0)), 0) as bigint) as inserted
from {PAIRS} p left join c using (pair_id) group by 1""")
def line_multiset_changes(spark, d):
    return P.multiset_changes(doc_pairs(spark, d))


@query("select min(doc_id) as first, count(*) as copies from documents group by text having count(*) > 1")
def exact_duplicate_groups(spark, d):
    return P.duplicate_groups(table(spark, d, "documents"), "doc_id", "text")


@query(f"""
with u as (select pair_id, line, side, min("row") as r from {LINES} where line <> '' group by 1, 2, 3 having count(*) = 1)
select b.pair_id, b.r as before_row, a.r as after_row from u b join u a on a.pair_id = b.pair_id and a.line = b.line and b.side = 'before' and a.side = 'after'""")
def unique_line_matches(spark, d):
    return P.unique_matches(doc_pairs(spark, d))


@query(f"""
with u as (select *, row_number() over (partition by pair_id, side, line order by "row") as k from {LINES})
select b.pair_id, b."row" as before_row, a."row" as after_row from u b join u a on a.pair_id = b.pair_id and a.line = b.line and a.k = b.k and b.side = 'before' and a.side = 'after'""")
def fifo_line_matches(spark, d):
    return P.fifo_matches(doc_pairs(spark, d))


@query(f"""
with s as (select pair_id, line, bool_or(side = 'before') as b, bool_or(side = 'after') as a from {LINES} group by 1, 2),
n as (select pair_id, count(*) filter (a and b) as shared, count(*) as either, count(*) filter (b) as nb, count(*) filter (a) as na from s group by 1)
select p.pair_id, coalesce(shared, 0) as shared, case when coalesce(nb, 0) = 0 or coalesce(na, 0) = 0 then 0.0 else shared / either end as jaccard from {PAIRS} p left join n using (pair_id)""")
def line_jaccard(spark, d):
    return P.line_similarity(doc_pairs(spark, d))


@query("""
with w as (select p_partkey, p_name as a, p_type as b from part),
g as (select *, list_distinct(list_transform(generate_series(1, length(a) - 1), lambda i: substr(a, i, 2))) as x, list_distinct(list_transform(generate_series(1, length(b) - 1), lambda i: substr(b, i, 2))) as y from w)
select p_partkey, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) as dice, a = b or 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) >= 0.6 as similar from g""")
def bigram_dice(spark, d):
    p = table(spark, d, "part")
    a, b = F.col("p_name"), F.col("p_type")
    return p.select("p_partkey", F.round(T.dice(T.bigrams(a), T.bigrams(b)), 9).alias("dice"), T.similar_leaves(a, b).alias("similar"))


@query("""
with l as (select l_orderkey // 100 as unit, l_orderkey * 8 + l_linenumber as "row", l_returnflag = 'R' and l_quantity > 45 as changed from lineitem)
select cast(unit as bigint) as unit, "row", changed, bool_or(changed) over (partition by unit order by "row" range between 3 preceding and 3 following) as keep from l""")
def context_rows(spark, d):
    l = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("unit"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("changed"))
    return P.context(l, ["unit"], "row", F.col("changed"))


@query("""
with c as (select l_orderkey // 100 as unit, l_orderkey * 8 + l_linenumber as "row" from lineitem where l_returnflag = 'R' and l_quantity > 45)
select cast(unit as bigint) as unit, "row", row_number() over w as number, count(*) over p as total, coalesce(lead("row") over w, min("row") over p) as next, coalesce(lag("row") over w, max("row") over p) as previous
from c window w as (partition by unit order by "row"), p as (partition by unit)""")
def next_and_previous_change(spark, d):
    c = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("unit"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    return P.round_trip(c, ["unit"], "row")


@query("""
with l as (select doc_id, string_split(text, chr(10)) as l from documents), r as (select doc_id, unnest(generate_series(1, len(l))) as i, l from l),
c as (select doc_id, i - 1 as row, unnest(generate_series(1, length(l[i]) - 2)) as j, l[i] as line from r where length(l[i]) >= 3)
select doc_id, cast(row as integer) as "row", cast(j - 1 as integer) as col from c where lower(substr(line, j, 3)) = 'eau'""")
def literal_search(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(T.search(F.col("text"), F.lit("EAU"))).alias("at"))
    return found.select("doc_id", "at.row", "at.col")


@query("""
with r as (select o_custkey, epoch_us(o_orderdate) // 86400000000 as start, epoch_us(o_orderdate) // 86400000000 + 200 as stop from orders group by all),
q as (select c_custkey as o_custkey, 9131 + c_custkey % 1000 as day from customer),
f as (select q.o_custkey, q.day, max(r.start) as start from q left join r on r.o_custkey = q.o_custkey and r.start <= q.day group by 1, 2)
select o_custkey, day, case when start + 200 > day then start else -1 end as start, case when start + 200 > day then start + 200 else -1 end as stop from f""")
def point_in_range(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("start")).distinct().withColumn("stop", F.col("start") + 200)
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 1000 + 9131).alias("day"))
    return P.last_at_or_before(q, o, ["o_custkey"], "day", "start", "stop").na.fill(-1, ["start", "stop"])


# ---- streams, as tables


@query("""
select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2""")
def hourly_event_counts(spark, d):
    from palimpsest.streaming.ingest import running_counts

    counted = running_counts(table(spark, d, "events"), "ts", "event_type")
    return counted.withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- reports


@query("""
with c as (select p_brand as language, p_type as kind, count(*) as total from part group by 1, 2),
r as (select *, row_number() over (partition by language order by total desc, kind) as rank from c)
select '| language | rank | kind | total |' || chr(10) || '|---|---|---|---|' || chr(10) ||
  string_agg('| ' || language || ' | ' || rank || ' | `' || kind || '` | ' || total || ' |', chr(10) order by language, rank) as report from r where rank <= 2""")
def top_kinds_report(spark, d):
    from palimpsest.operators import reports

    ranked = top_kinds_by_language(spark, d).where("rank <= 2").withColumn("kind", T.code_span(F.col("kind")))
    return reports.markdown_table(ranked, ["language", "rank", "kind", "total"], [F.col("language"), F.col("rank")])


@query("""
select '\\newcommand{\\Files}{' || count(*) || '}' || chr(10) || '\\newcommand{\\Languages}{' || count(distinct lang) || '}' as report from documents""")
def tex_variables(spark, d):
    from palimpsest.operators import reports

    row = table(spark, d, "documents").agg(F.count("*").alias("files"), F.countDistinct("lang").alias("languages"))
    return reports.tex_macros(row, {"files": "Files", "languages": "Languages"})
