"""The queries of this subpackage, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, html_main, merkle, negatives, packing, pieces, pii, quality, secrets, sharding, simhash, substrings, topk
from palimpsest.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("id % 50 = 0"))


ORACLE["op2_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), t as (
  select vec_id, unnest(e) as w, generate_subscripts(e, 1) as term from v
), m as (
  select q.vec_id as query_id, c.vec_id, sum(q.w * c.w) as score
  from t q join t c on q.term = c.term and q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0 group by 1, 2
), s as (
  select q.vec_id as query_id, c.vec_id, cast(coalesce(m.score, 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id left join m on m.query_id = q.vec_id and m.vec_id = c.vec_id
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 5
"""


@query
def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard(sized, "doc_id", ["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.main_text(pages, "html", ["page_id", "url"], html_main.learned(pages, "html"))


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text"
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE["op8_decontamination"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where text is not null),
t as (select item_id, w, least(len(w), 13) as n, unnest(generate_series(1, greatest(len(w) - 12, 1))) as i from b where len(w) > 0),
p as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as phrase from t),
l as (select distinct n from p),
x as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, l where len(w) >= n),
h as (select x.doc_id, x.i, x.n, p.item_id from x join p on p.n = x.n and p.phrase = array_to_string(x.w[x.i : x.i + x.n - 1], ' ')),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from h) group by 1),
m as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items from h group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from d left join c using (doc_id) left join m using (doc_id)
"""


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", digest=True)


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the session's key; the tables are synthetic, so without one theirs is no secret."""
    return pii.pseudonyms(table(spark, sf_dir, "documents"), "doc_id", "text", spark.conf.get("spark.palimpsest.pseudonyms.key", "for synthetic tables only"))


ORACLE["op5_repeats"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, i, substr(h, 2 * i + 1, 200) as x from (select doc_id, h, unnest(generate_series(0, len(h) // 2 - 100)) as i from d where len(h) >= 200)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) as k from s) where k > 1),
g as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i), -1000) + 100 as new from r),
n as (select doc_id, i, sum(cast(new as integer)) over (partition by doc_id order by i) as run from g),
u as (select doc_id, run, min(i) as a, max(i) + 100 as z from n group by 1, 2),
k as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from u),
o as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans, max(z) as last from k group by 1),
e as (select k.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept from k join d using (doc_id) group by 1)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when o.doc_id is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from d left join o using (doc_id) left join e using (doc_id)
"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, "doc_id", "text", labels, "doc_id", "quality")
    return quality.digests(docs, "doc_id", "text", model)


@query
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, "vec_id", "embedding", label, F.col("vec_id") % 50 == 0)


ORACLE["op11_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), t as (
  select vec_id, unnest(e) as w, generate_subscripts(e, 1) as term from v
), m as (
  select q.vec_id as a, c.vec_id as c, sum(q.w * c.w) as score from t q join t c on q.term = c.term and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by 1, 2
), s as (
  select q.vec_id as a, c.vec_id as c, q.label = c.label as same, cast(coalesce(m.score, 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id left join m on m.a = q.vec_id and m.c = c.vec_id where q.vec_id % 50 = 0
), p as (
  select a, c, score from s where same qualify row_number() over (partition by a order by score desc, c) <= 5
), n as (
  select p.a, p.c as p, p.score as ps, s.c as n, s.score as ns, row_number() over (partition by p.a, p.c order by s.score desc, s.c) as rank
  from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select a as anchor_id, p as positive_id, cast(rank as integer) as rank, n as negative_id, ps as positive_score, ns as negative_score from n where rank <= 3
"""


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"), "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], "text")


# the CRC-32 of an id's digits, bit by bit; rows of one id and digest are interchangeable
_CRC = """list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end))"""


def _leaf(text: str) -> str:
    framed = (f"coalesce(octet_length(encode(cast({x} as varchar))) || ':' || cast({x} as varchar), '-')" for x in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(framed)})"


ORACLE["op12_merkle"] = f"""
with recursive l as (
  select doc_id, source, {_leaf('text')} as leaf,
    case when doc_id is not null and xor({_CRC}, 4294967295::ubigint) % 5 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered
  from documents
), p as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from l
), nodes as (
  select 0 as level, source, pos, n, leaf as digest from p
  union all
  select level + 1, source, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by level, source, pos // 16
), subroots as (
  select source, digest as subroot, level as height, row_number() over (order by encode(source) nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1
), upper as (
  select 0 as level, pos, n, subroot as digest from subroots
  union all
  select level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by pos)) from upper where n > 1 group by level, pos // 16
), runs as (
  select level, source, pos // 16 as run, list(digest order by pos) as d from nodes where n > 1 group by all
), upruns as (
  select level, pos // 16 as run, list(digest order by pos) as d from upper where n > 1 group by all
), path as (
  select p.*, s.subroot, s.height, s.pos as gpos, 0 as step, '' as proof, coalesce(tampered, leaf) as folded, true as more from p join subroots s on s.source is not distinct from p.source
  union all
  select * exclude (i) replace (step + 1 as step, i.more as more,
      case when i.more then proof || array_to_string(i.d[:i.k] || i.d[i.k + 2:], '') else proof end as proof,
      case when i.more then sha256(array_to_string(i.d[:i.k] || [folded] || i.d[i.k + 2:], '')) else folded end as folded)
  from (
    select path.*, struct_pack(d := coalesce(r.d, u.d), k := case when step < height then (path.pos // cast(power(16, step) as bigint)) % 16 else (gpos // cast(power(16, greatest(step - height, 0)) as bigint)) % 16 end, more := coalesce(r.d, u.d) is not null) as i
    from path left join runs r on step < height and r.level = step and r.source is not distinct from path.source and r.run = path.pos // cast(power(16, step + 1) as bigint)
      left join upruns u on step >= height and u.level = step - height and u.run = gpos // cast(power(16, greatest(step - height + 1, 0)) as bigint)
    where path.more
  ) 
)
select doc_id, leaf, subroot, (select digest from upper where n = 1) as root, sha256(proof) as proof_sha256, folded as folded_root, folded = (select digest from upper where n = 1) as verified
from path where not more
"""


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces_ = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return pieces_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
