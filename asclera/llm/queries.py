"""The queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import decontaminate, infill, language, licenses, packing, pieces, quality, sharding, simhash, toxicity, turns, urls, vectors
from .common import remainder, table

#: The paths of the tokenizers' files; a session may set others.
PIECES = "spark.asclera.pieces"
BYTES = "spark.asclera.bytes"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(configure(spark), folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return build

    return register


@query("op2_simhash")
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3)


@query("op3_decontamination", """
with d as (
  select doc_id, row_number() over () as k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
win as (
  select item_id, least(10, len(w)) as size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as words
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct size from win),
runs as (
  select k, size, i, array_to_string(w[i:i + size - 1], ' ') as words
  from (select k, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hit as (select distinct runs.k, runs.size, runs.i, win.item_id from runs join win using (size, words)),
places as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + size)) as p from hit) group by k),
items as (select k, count(*) as n_items, string_agg(item, ',' order by item) as l from (select distinct k, cast(item_id as varchar) as item from hit) group by k)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (k) left join items using (k)""")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def model_path(spark: SparkSession, setting: str = PIECES, name: str = "piece_bpe_32k.model") -> str:
    if set_path := spark.conf.get(setting, None):
        return set_path
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_pieces")
def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(pieces.round_trip(table(spark, folder, "documents"), model_path(spark)))


@query("op6_licenses")
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.labels(table(spark, folder, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    return toxicity.judge(docs, model, out="t").select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "t.score", "t.predicted", F.size("t.passages").alias("n_passages")
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels, remainder("doc_id", 3) != 1)
    return quality.judge(docs, model, out="q").select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "q.score", "q.predicted"
    )


@query("op7_language")
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    return language.judge(docs, model, out="l").select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), F.col("l.lang").alias("lang_pred"), "l.score", "l.rejected"
    )


_RULES = ", ".join(f"('{rule}', '{verdict}', {len(rule)})" for rule, verdict in urls.RULES)
_BLOCKED = ", ".join(f"('{domain}')" for domain in urls.BLOCKED)


@query("op8_urls", f"""
with u as (select page_id, row_number() over () as k, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (
  select page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules(rule, verdict, size) as (values {_RULES}),
fit as (
  select k, arg_max(rule, size) as rule, arg_max(verdict, size) as verdict from p, rules
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, position('/' in rule)))
  group by k),
blocked(domain) as (values {_BLOCKED}),
bad as (select distinct k from p, blocked where host = domain or ends_with(host, '.' || domain))
select page_id, host, path, rule, coalesce(verdict, case when bad.k is null then 'allow' else 'block' end) as verdict
from p left join fit using (k) left join bad using (k)""")
def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"), 24)


@query("op10_vectors", """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
ok as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
pair as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(id, other) as (select vec_id, vec_id from ok union select reach.id, pair.b from reach join pair on reach.other = pair.a),
least as (select id, min(other) as component_id from reach group by id),
many as (select a, count(*) as n from pair group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from v left join many on many.a = vec_id left join least on least.id = vec_id""")
def op10_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query("op11_turns")
def op11_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.contract(table(spark, folder, "conversations"))


@query("op12_packing")
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), model_path(spark, BYTES, "byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", packing.ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step"
    )


@query("op13_infill", """
with d as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as x,
    regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as l from documents),
h as (
  select *, len(l) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2,
    cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(l[1:a], '') as prefix, array_to_string(l[a + 1:b], '') as middle, array_to_string(l[b + 1:n], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from p""")
def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(infill.transform(table(spark, folder, "documents")))
