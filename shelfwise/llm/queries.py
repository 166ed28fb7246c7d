"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.decontaminate import contamination
from shelfwise.llm.embedding_dedup import near_duplicates
from shelfwise.llm.fingerprints import ANCHORS, CHAIN, DIGITS, RATIO, STRIDE, fingerprint_edits
from shelfwise.llm.jaccard_join import jaccard_components
from shelfwise.llm.language_crf import identify
from shelfwise.llm.lm_scoring import lm_scores
from shelfwise.llm.mixing import schedule
from shelfwise.llm.periodic_runs import find_runs
from shelfwise.llm.quality_knn import classify
from shelfwise.llm.secrets import find_secrets
from shelfwise.llm.suffix_dedup import dedup_substrings
from shelfwise.llm.token_files import token_index, write_token_files
from shelfwise.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress
from shelfwise.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


SQL["op10_decontamination"] = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
bw as (
  select distinct item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
bwin as (
  select item_id, least(len(w), 13) as n, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) as win
  from bw where len(w) > 0),
pos as (
  select d.doc_id, l.n, unnest(range(1, len(d.w) - l.n + 2)) as i
  from dw d, (select distinct n from bwin) l where len(d.w) >= l.n),
hits as (
  select p.doc_id, p.i, p.n, b.item_id
  from pos p join dw d using (doc_id) join bwin b on b.n = p.n and b.win = array_to_string(d.w[p.i:p.i + p.n - 1], ' ')),
covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
found as (
  select doc_id, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as h
  from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, cast(coalesce(f.n_items, 0) as bigint) as n_items,
  coalesce(f.h, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from dw d left join covered c using (doc_id) left join found f using (doc_id)
"""


@_query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


@_query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(_table(spark, sf_dir, "documents"))


@_query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path)


@_query
def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


@_query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


SQL["op4_embedding_dedup"] = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on l.a = r.b)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links,
  least(e.vec_id, coalesce((select min(b) from reach r where r.a = e.vec_id), e.vec_id)) as component_id,
  e.vec_id <= coalesce((select min(b) from reach r where r.a = e.vec_id), e.vec_id) as kept
from embeddings e where e.vec_id is not null
"""


@_query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


SQL["op3_jaccard_join"] = r"""
with recursive dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null),
sets as (
  select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 0) + 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from dw),
sh as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (
  select a.doc_id as a, b.doc_id as b from sh a join sh b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (
  select doc_id as id, doc_id as low from sets
  union
  select l.b, r.low from reach r join links l on l.a = r.id where r.low < l.b)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.low as component_id
from sets s join (select id, min(low) as low from reach group by id) r on r.id = s.doc_id
"""


@_query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


_LISTED = ", ".join(f"'{w}'" for w in ANCHORS)
_SIGNED = """(
  select *, case when len(s) > 0 then s when t = '' then [] else [left(md5(lower(t)), {digits})] end as sigs from (
  select *, list_sort(list_distinct(list_transform(c, lambda x, j: left(md5(array_to_string(string_split(concat_ws(' ', x, c[j + 1], c[j + 2]), ' ')[1:{chain}], ' ')), {digits})))) as s from (
  select *, list_filter(list_transform(string_split(array_to_string(list_transform(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: case when w in ({listed}) or (w <> '' and length(w) % {stride} = 0) then chr(1) else w end), ' '), chr(1))[2:], lambda x: trim(x)), lambda x: x <> '') as c
  from {table})))"""


def _signed(table: str) -> str:
    return _SIGNED.format(table=table, listed=_LISTED, stride=STRIDE, chain=CHAIN, digits=DIGITS)


def _class(x: str) -> str:
    return f"len(list_filter([{', '.join(str(RATIO**k) for k in range(1, 6))}], lambda x: x <= len({x})))"


def _alike(a: str, b: str) -> str:
    return f"case when {a} = {b} then 1e0 when len({a}) = 0 or len({b}) = 0 or abs({_class(a)} - {_class(b)}) > 1 then 0e0 else cast(len(list_intersect({a}, {b})) as double) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end"


SQL["op11_fingerprints"] = f"""
with own as (select doc_id, t, sigs from {_signed("(select doc_id, coalesce(text, '') as t from documents)")}),
pairs as (
  select *, coalesce(lead(t) over w, first_value(t) over w) as next_t, coalesce(lead(sigs) over w, first_value(sigs) over w) as next_sigs
  from own window w as (order by doc_id desc rows between unbounded preceding and unbounded following)),
cut as (
  select doc_id, length(t) as n, sigs as own_sigs, next_sigs, concat(left(t, length(t) - length(t) // 2), left(next_t, length(t) // 2)) as t
  from pairs)
select doc_id, n as n_chars, sha256(t) as edited_sha256, array_to_string(own_sigs, '') as fingerprint, array_to_string(sigs, '') as edited_fingerprint,
  {_alike("own_sigs", "sigs")} as near_edited, {_alike("own_sigs", "next_sigs")} as near_next, cast(len(own_sigs) as bigint) as n_signatures, cast({_class("own_sigs")} as int) as length_class
from {_signed("cut")}
"""


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"))


def _assigned(k: int) -> str:
    """Nearest entry of codebook ``k`` for each part of each vector."""
    return f"""a{k} as (select vec_id, p, v, arg_min(e, far * {ENTRIES} + e) as e, min(far) as far from (
  select s.vec_id, s.p, s.v, b.e, list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as far from part s join b{k} b using (p)) group by all)"""


SQL["op12_vector_codes"] = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(embedding) % {PARTS} = 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as (select vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as v from kept, range({PARTS}) r(p)),
b0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from part qualify e < {ENTRIES}),
{_assigned(0)},
""" + "".join(
    f"""m{k} as (select p, e, list(cast(floor(t / n) as bigint) order by i) as v from (select p, e, i, sum(x) as t, count(*) as n from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as i from a{k - 1}) group by all) group by all),
b{k} as (select b.p, b.e, coalesce(m.v, b.v) as v from b{k - 1} b left join m{k} m on m.p = b.p and m.e = b.e),
{_assigned(k)},
"""
    for k in range(1, ROUNDS + 1)
) + f"""coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(far)::bigint as error from a{ROUNDS} group by vec_id),
sums as (select label, sum(error)::bigint as label_error from coded join kept using (vec_id) group by label)
select c.vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from b{ROUNDS}) as codebooks_sha256
from coded c join kept k using (vec_id) join sums s on s.label is not distinct from k.label
"""


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(_table(spark, sf_dir, "documents"), edit=True)
