"""The corpus operators as registered queries, each over its whole table, with DuckDB texts where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm import (
    centroids, chat_format, decontaminate, mixing, quality_classifier, quality_rules, sharding, simhash, spelling, style_tree,
    token_count, url_filter, warc_zip,
)
from ledgerlark.llm.common import table

SHARDS = 40
VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_quality_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents; the sites are source (host) and language in it (path)."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least 0.8 of the five-word shingles of a benchmark item."""
    pairs = decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.groupBy("doc_id", "item_id", "item_shingles").agg(F.max("matched").alias("matched"))


def op5_url_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all page urls; listed are the urls of the pages that are labelled toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.filter("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    listed = pages.join(bad, "page_id").select("url")
    return url_filter.judge_urls(pages.select("page_id", "url"), listed, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_efraimidis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; labelled quality is twice, labelled junk half as likely to come early."""
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), weights=weights)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, formatted in windows and read back."""
    says = "</s>[INST] ok [/INST]"
    kind = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], kind)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.read_back(chat_format.windows(turns)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def op9_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdicts of all documents."""
    judged = quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records into ZIP packages and read back by ranges."""
    return warc_zip.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents (with planted deletions), their near words, forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"), every=199)


def op12_heap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds."""
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op13_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return style_tree.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


OP4_SQL = r"""
with words as (
  select doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents where text is not null
), grams as (
  select distinct doc_id, text, array_to_string(w[i:i + 4], ' ') as gram
  from (select doc_id, text, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)
), item_words as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from benchmark where text is not null and item_id is not null
), item_grams as (
  select distinct item_id, array_to_string(w[i:i + 4], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - 3)) as i from item_words where len(w) >= 5)
), sizes as (
  select item_id, count(*) as item_shingles from item_grams group by 1
), pairs as (
  select doc_id, text, item_id, count(*) as matched from grams join item_grams using (gram) group by 1, 2, 3
)
select doc_id, item_id, item_shingles, max(matched) as matched
from pairs join sizes using (item_id) where matched >= ceil(item_shingles * 0.8 - 1e-9) group by 1, 2, 3"""

OP5_SQL = r"""
with parts as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: not regexp_matches(x, '^(utm_[a-z]*|ref)=|^$'))) as args
  from pages
), canonical as (
  select *, case when host <> '' then host || regexp_replace(path, '(\.html|/)+$', '')
    || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end end as c
  from parts
), listed as (
  select distinct c from canonical where page_id in (select doc_id from labels where toxic = 1) and c is not null
), ruled as (
  select page_id, host, path, c,
    case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule
  from canonical
)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
       when c in (select c from listed) then 'block' else 'allow' end as verdict
from ruled"""

OP7_SQL = r"""
with labelled as (
  select doc_id, min(quality) as q from labels where doc_id is not null group by 1
), docs as (
  select d.doc_id, d.source, d.text,
    len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size,
    -ln((('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint + 0.5) / 4503599627370496.0)
      / case when q >= 1 then 2.0 when q <= 0 then 0.5 else 1.0 end as draw
  from documents d left join labelled l on l.doc_id = d.doc_id
), sizes as (
  select source, sum(size)::bigint as source_size,
    [3.0, 1.0, 2.0][1 + ((row_number() over (order by source is null, source) - 1) % 3)::int] as w
  from docs group by 1
), ranked as (
  select *, row_number() over (order by source_size / w, source is null, source) as k from sizes
), levels as (
  select *, (sum(source_size) over () * 1.5
      - 2 * coalesce(sum(source_size) over (order by k rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by k rows between current row and unbounded following) as level
  from ranked
), final as (
  select min_by(level, k) as level from levels where level < 2 * source_size / w
), targets as (
  select source, source_size,
    round(coalesce(least(2.0 * source_size, level * w), 2.0 * source_size), 6)::double as target
  from sizes cross join final
), placed as (
  select d.doc_id, d.size, t.source_size, t.target, case when source_size > 0 then floor(target / source_size) else 0 end as epochs,
    coalesce(sum(size) over (partition by d.source order by draw, d.doc_id, md5(d.text) rows between unbounded preceding and 1 preceding), 0) as before
  from docs d join targets t on t.source is not distinct from d.source
)
select doc_id, size, source_size, target,
  (size * (epochs + (before + size / 2.0 < target - epochs * source_size)::int))::bigint as taken
from placed"""

OP8_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, 4 + len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as t,
    17 + length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
       + 3 + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) as chars
  from turns
), placed as (
  select *, row_number() over o as position,
    coalesce(sum(t) over (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as ahead
  from sized window o as (partition by conv_id order by turn nulls first, role, text)
), leads as (
  select conv_id, sum(case when role = 'system' then t else 0 end) as lead from placed where position = 1 group by 1
), laid as (
  select p.*, lead, position = 1 and role = 'system' as is_system, greatest(1, 384 - lead) as step,
    case when position = 1 and role = 'system' then 0 else ahead - lead end as spot,
    case when position = 1 and role = 'system' then 0 else t end as n
  from placed p join leads l on l.conv_id is not distinct from p.conv_id
), celled as (
  select *, floor(spot / step) as cell, spot + n > (floor(spot / step) + 1) * step as crosses from laid
), cells as (
  select conv_id, cell, any_value(step) as step, coalesce(sum(n) filter (not crosses), 0) as inside,
    coalesce(sum(n) filter (crosses), 0) as outside, count(*) filter (not crosses and not is_system) as turns
  from celled group by 1, 2
), sums as (
  select *, turns = 0 or inside + outside <= step as back from cells
), ends as (
  select conv_id, cell, case when back then 2 * cell
    when outside + lead(inside + case when back then outside else 0 end) over c <= step then 2 * lead(cell) over c
    else 2 * cell + 1 end as target
  from sums window c as (partition by conv_id order by cell)
), owned as (
  select c.*, case when crosses then target else 2 * c.cell end as own
  from celled c join ends e on e.conv_id is not distinct from c.conv_id and e.cell = c.cell
), windows as (
  select conv_id, own, min(spot) as start, sum(n) as fresh, min(position) as head, arg_min(role, position) as head_role from owned group by 1, 2
), used as (
  select conv_id, own, lead(own) over w as next, lead(start) over w as start, lead(fresh) over w as fresh,
    lead(head) over w as head, lead(head_role) over w as head_role
  from windows window w as (partition by conv_id order by own)
), shown as (
  select conv_id, chars from owned
  union all
  select o.conv_id, chars from owned o join used u on u.conv_id is not distinct from o.conv_id and u.own = o.own
  where not is_system and (spot >= start - 128 or (head_role = 'assistant' and position + 1 = head and n + fresh + o.lead <= 512))
  union all
  select o.conv_id, chars from owned o join used u on u.conv_id is not distinct from o.conv_id and u.own > o.own
  where is_system
), lengths as (
  select conv_id, sum(chars)::bigint as formatted_chars from shown group by 1
), digests as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by position)) as turns_sha256,
    coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by position), '')) as loss_sha256
  from owned group by 1
)
select d.*, formatted_chars from digests d join lengths l on l.conv_id is not distinct from d.conv_id"""

OP10_SQL = r"""
with rows as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d from pages
), firsts as (
  select html, min(page_id) as first from rows group by 1
)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((
      (instr('0123456789abcdef', d[5 * i // 4 + 1]) - 1) * 16
      + instr('0123456789abcdef', d[5 * i // 4 + 2]) - 1) >> (3 - (5 * i) % 4)) & 31))::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from rows join firsts using (html)"""

#: One round of assignments and one of new centroids; floor division by the remainder that is never negative.
_ASSIGNED = """, a{r} as materialized (
  select vec_id, v, min_by(c, (d, c)) as c, min(d) as d from (
    select vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
    from kept, c{r}) group by vec_id, v)"""
_MOVED = """, s{r} as (
  select c, i, sum(v[i])::hugeint as s, count(*) as n from a{r}, range(1, 65) t(i) group by c, i
), m{r} as (
  select c, list((s - ((s % n) + n) % n) // n order by i) as w from s{r} group by c
), c{q} as materialized (
  select c{r}.c, coalesce(m{r}.w, c{r}.w) as w from c{r} left join m{r} on m{r}.c = c{r}.c)"""
OP12_SQL = (
    """with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::hugeint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
  select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v as w from kept order by 1 limit 16)"""
    + "".join(_ASSIGNED.format(r=r) + _MOVED.format(r=r, q=r + 1) for r in range(3))
    + _ASSIGNED.format(r=3)
    + """
select vec_id, a3.c::int as cluster, d as distance, sum(d) over (partition by a3.c)::bigint as cluster_inertia,
  sum(d) over ()::bigint as inertia, sha256(array_to_string(w, ',')) as centroid_sha256
from a3 join c3 on a3.c = c3.c"""
)

#: For pages whose only article holds a heading and paragraphs, as those of the table.
OP13_SQL = r"""
with articles as (
  select page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs'),
    '<article>(.*?)(</article>|\z)', 1, 's') as a
  from pages
), texts as (
  select page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(a, '</?(h1|p)>'), lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' '),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) as text
  from articles
)
select page_id, url, text, length(text)::bigint as n_chars from texts"""

QUERIES = {
    "op1_histogram_sort": op1_histogram_sort,
    "op2_simhash_multi_index": op2_simhash_multi_index,
    "op3_quality_empirical_bayes": op3_quality_empirical_bayes,
    "op4_minhash_containment": op4_minhash_containment,
    "op5_url_bloom_filter": op5_url_bloom_filter,
    "op6_token_counts": op6_token_counts,
    "op7_efraimidis_mix": op7_efraimidis_mix,
    "op8_chat_windows": op8_chat_windows,
    "op9_risk_controlled_rules": op9_risk_controlled_rules,
    "op10_warc_zip": op10_warc_zip,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_heap_centroids": op12_heap_centroids,
    "op13_site_style_tree": op13_site_style_tree,
}
ORACLES = {
    "op4_minhash_containment": OP4_SQL,
    "op5_url_bloom_filter": OP5_SQL,
    "op7_efraimidis_mix": OP7_SQL,
    "op8_chat_windows": OP8_SQL,
    "op10_warc_zip": OP10_SQL,
    "op12_heap_centroids": OP12_SQL,
    "op13_site_style_tree": OP13_SQL,
}
