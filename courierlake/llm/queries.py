"""The queries that apply the operators of this package to the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .exact_dedup import exact_groups
from .importance import resample
from .jaccard_join import similar_documents
from .language import fit_languages, predict_languages
from .licenses import TEMPLATES, full_texts, scan_licenses
from .media import decode_media, encode_media
from .mixing import mix_documents
from .packing import pack_documents
from .pii import find_pii, pii_digests
from .pii_sql import PII_SQL
from .shared import table
from .substring_dedup import remove_repeats, span_digests
from .toxicity import fit_toxicity, held_out, score_toxicity
from .url_filter import judge_urls, rule_table

#: Rules of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.floor(F.col("first_position") * 1e6).alias("position_ppm"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    read = decode_media(encode_media(docs, "doc_id", "payload"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digests={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), templates={**TEMPLATES, **full_texts()}, windows=True)
    return found.select("doc_id", "license", "score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), folds=3, fold=1)
    model = fit_languages(docs.where(~out))
    return predict_languages(docs.drop("lang"), model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score", "languages")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, share=80, top=2000)


_ALL = (
    op1_suffix_dedup,
    op2_mix_sources,
    op3_exact_dedup,
    op4_media,
    op5_packing,
    op6_jaccard_join,
    op7_toxicity,
    op8_url_filter,
    op9_license_scan,
    op10_language,
    op11_pii,
    op12_importance_resampling,
    op13_collocations,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


MIX_SQL = r"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as ord,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, row_number() over (order by source asc nulls last) - 1 as rank from sizes),
weighed as (select *, rank % 3 + 1 as weight, source_size * 3 as cap from ranked),
levels as (
  select *, cap / weight as ratio,
    (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level
  from weighed),
chosen as (select level from levels where level <= ratio order by ratio, rank limit 1),
targets as (
  select source, source_size, rank, least(cast(cap as double), (select level from chosen) * weight) as target,
    cast(floor(least(cast(cap as double), (select level from chosen) * weight) + 0.5) as bigint) as demand
  from levels),
streams as (
  select d.*, t.source_size, t.target, t.demand, t.rank,
    cast(sum(size) over (partition by d.source order by ord, doc_id, size rows between unbounded preceding and current row) as bigint) - size as start
  from sized d join targets t on d.source is not distinct from t.source),
taken as (
  select *, case when source_size > 0 then demand // source_size else 0 end * size
    + greatest(0, least(size, demand - case when source_size > 0 then demand // source_size else 0 end * source_size - start)) as taken
  from streams),
shares as (select *, case when demand > 0 then start / demand end as y from taken)
select doc_id, size, source_size, target, cast(taken as bigint) as taken,
  cast(case when taken > 0 then floor(1e6 * case rank % 3
    when 0 then case when y < 0.25 then y / 0.25 / 4 when y < 0.5 then (1 + (y - 0.25) / 0.25) / 4 when y < 0.75 then (2 + (y - 0.5) / 0.25) / 4 else (3 + (y - 0.75) / 0.25) / 4 end
    when 1 then case when y < 0.1 then y / 0.1 / 4 when y < 0.3 then (1 + (y - 0.1) / 0.2) / 4 when y < 0.6 then (2 + (y - 0.3) / 0.3) / 4 else (3 + (y - 0.6) / 0.4) / 4 end
    else case when y < 0.4 then y / 0.4 / 4 when y < 0.7 then (1 + (y - 0.4) / 0.3) / 4 when y < 0.9 then (2 + (y - 0.7) / 0.2) / 4 else (3 + (y - 0.9) / 0.1) / 4 end
  end) end as bigint) as position_ppm
from shares
"""

EXACT_SQL = """
with keyed as (select doc_id, coalesce(text, '') as body from documents),
groups as (select body, max(doc_id) as keep_id, count(*) as group_size from keyed group by body)
select k.doc_id, g.keep_id, g.group_size, k.doc_id = g.keep_id as kept, sha256(k.body) as text_sha256
from keyed k join groups g using (body)
"""

URL_SQL = r"""
with rules(verdict, host, path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts as (
  select page_id, url, row_number() over () as rn,
    translate(coalesce(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
fits as (
  select rn, r.verdict, r.host || r.path as rule, row_number() over (partition by rn order by length(r.host || r.path) desc) as place
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join (select * from fits where place = 1) f using (rn)
"""


_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
LICENSE_SQL = f"""
with t0(name, body) as (values {_TEMPLATES}),
t1 as (select name, regexp_extract_all(lower(body), '[a-z0-9]+') as w from t0),
t as (select name, {_BIGRAMS} as tb from t1),
d as (select row_number() over () as rn, doc_id, coalesce(text, '') as text from documents),
u as (select rn, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split(text, chr(10) || chr(10)), [text]))) as unit from d),
w1 as (select rn, regexp_extract_all(lower(unit), '[a-z0-9]+') as w from u),
b as (select rn, {_BIGRAMS} as ub from w1 where len(w) > 1),
s as (select rn, name, 2.0::double * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) as score from b, t where 2.0 * least(len(ub), len(tb)) >= 0.8 * (len(ub) + len(tb)) - 1e-6),
best as (select rn, name, score, row_number() over (partition by rn order by score desc, name) as k from s where score >= 0.8)
select doc_id, name as license, coalesce(score, 0.0::double) as score from d left join (select * from best where k = 1) using (rn)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 by its table of 256 steps, for each distinct word.
IMPORTANCE_SQL = rf"""
with steps as (
  select list(c order by i) as t
  from (select i, list_reduce([i::bigint] || range(8)::bigint[], lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) as c from range(256) r(i))),
sides as (
  select 0 as own, row_number() over () as rn, doc_id, text from documents
  union all select 1, row_number() over (), null, text from benchmark),
words as (select own, rn, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from sides),
bytes as (select w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint) as b from (select distinct w from words)),
hashed as (select w, xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from bytes, steps),
features as (select own, rn, bucket from words join hashed using (w)),
counts as (select bucket, count(*) filter (where own = 0) as s, count(*) filter (where own = 1) as t from features group by bucket),
sums as (select sum(s)::double as s_all, sum(t)::double as t_all from counts),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain from counts, sums),
gained as (select rn, count(*) as n, sum(gain)::bigint as total from features join gains using (bucket) where own = 0 group by rn),
weighed as (
  select rn, doc_id, coalesce(n, 0) as n_features, case when n is null then 0 else (total - ((total % n) + n) % n) // n end as weight,
    ('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, '')), 8))::bigint as h
  from sides left join gained using (rn) where own = 0),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from weighed),
ranked as (select rn, row_number() over (order by score desc, doc_id nulls first, n_features) as rank, count(*) over () as able from scored where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when rank <= 10 * able // 100 then rank end as rank
from scored left join ranked using (rn)
"""

COLLOCATION_SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
numbered as (select *, row_number() over () as p from pieces),
worded as (select lang, p, unnest(w) as w1, unnest(range(len(w))) as i from (select lang, p, regexp_extract_all(piece, '[^\x20\x09]+') as w from numbered)),
along as (
  select lang, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3, lead(w1, 3) over o as w4
  from worded window o as (partition by p order by i)),
grams as (
  select lang, 1 as m, w1 as phrase from along
  union all select lang, 2, w1 || ' ' || w2 from along where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from along where w3 is not null
  union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from along where w4 is not null),
f as (select lang, phrase, m, count(*)::hugeint as a from grams group by all),
totals as (select lang, sum(a)::bigint as n from f where m = 1 group by lang),
cand as (select *, string_split(phrase, ' ') as w from f where m > 1 and a >= 30),
inner_of as (
  select c.lang, array_to_string(c.w[i:i + k - 1], ' ') as phrase, max(c.a) as longer
  from cand c, range(2, 4) s(k), range(1, 4) t(i) where k < c.m and i + k - 1 <= c.m group by all),
own as (select c.* from cand c left join inner_of o using (lang, phrase) where longer is null or 100 * longer < 80 * a),
cuts as (
  select c.lang, c.phrase, c.a, k, x.a as l, y.a as r, (2000000 * c.a) // (x.a + y.a) as score
  from own c, range(1, 4) s(k)
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')
  where k < c.m),
best as (select *, row_number() over (partition by lang, phrase order by score, k) as j from cuts),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best where j = 1)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": MIX_SQL,
        "op3_exact_dedup": EXACT_SQL,
        "op8_url_filter": URL_SQL,
        "op9_license_scan": LICENSE_SQL,
        "op11_pii": PII_SQL,
        "op12_importance_resampling": IMPORTANCE_SQL,
        "op13_collocations": COLLOCATION_SQL,
    }
