"""The registered queries of this subpackage: name -> function of (spark, folder), and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.llm.centroids import centroid_clusters
from lumenframe.llm.chat import format_conversations, read_back
from lumenframe.llm.collocations import collocations
from lumenframe.llm.licences import TEMPLATES, scan
from lumenframe.llm.lm_scores import lm_scores
from lumenframe.llm.main_text import main_text
from lumenframe.llm.mixing import mix
from lumenframe.llm.near_text import near_text
from lumenframe.llm.near_vectors import near_vectors
from lumenframe.llm.neighbours import nearest
from lumenframe.llm.packing import pack
from lumenframe.llm.quality import quality_scores
from lumenframe.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query
def op1_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents", "doc_id", "text"), BYTE_BPE)


@query
def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query
def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents", "doc_id", "text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["op3_licences"] = f"""
with template(license, body) as (values {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in TEMPLATES.items())}),
  t_words as (select license, list_filter(string_split_regex(lower(body), '[^a-z0-9]+'), lambda w: w <> '') as w from template),
  t_shingle as (select distinct license, array_to_string(w[i:i + 4], ' ') as s from t_words, range(1, len(w) - 3) r(i)),
  size as (select license, count(*) as t, (2 ** floor(log2(greatest(1, count(*) // 8))))::bigint as step from t_shingle group by license),
  plan as (select *, ((t + step - 1 + step - 1) // step) * step as width from size),
  d_words as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') as w from documents),
  hit as (select doc_id, i - 1 as p, license, s from (select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from d_words, range(1, len(w) - 3) r(i)) join t_shingle using (s)),
  held as (select doc_id, license, k * step as start, count(distinct s) / any_value(t)::double as containment
    from hit join plan using (license), range(greatest(0, (p - width + step) // step)::bigint, (p // step + 1)::bigint) r(k)
    where k * step <= p and p < k * step + width group by doc_id, license, k, step)
select doc_id, license, max(containment) as containment, arg_min(start, {{'c': -containment, 'a': start}})::bigint as first_word
from held where containment >= 0.8 - 1e-9 group by doc_id, license
"""


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents", "doc_id", "text"), BYTE_BPE)


DOMAIN = "case when substring(md5(coalesce(source, '')), 1, 1) < '8' then 'books' else 'web' end"
LEVELS = {"domain": DOMAIN, "lang": "lang", "source": "source"}
WEIGHTS = [{"books": 3, "web": 2}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {}]


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    return mix(docs, LEVELS, WEIGHTS, budget=0.9, epochs=2).select(
        "doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def level_sql(name: str, parent: str, above: list[str], level: str, weight: str) -> str:
    """One level of the budget's way down, in SQL."""
    keys = ", ".join([*above, level])
    siblings = f"partition by {', '.join(above)}" if above else ""
    joined = f"join {parent} p using ({', '.join(above)})" if above else f"cross join {parent} p"
    return f"""
  {name}_n as (select {', '.join(f'x.{c}' for c in [*above, level])}, x.room, p.given as total, {weight} as w
    from (select {keys}, sum(room) as room from room group by {keys}) x {joined}),
  {name}_f as (select *, coalesce(sum(room) over ({siblings} order by room / w, {level} rows between unbounded preceding and 1 preceding), 0)
      + room / w * sum(w) over ({siblings} order by room / w, {level} rows between current row and unbounded following) <= total as is_full from {name}_n),
  {name} as (select {keys}, case when is_full then room else (total - sum(case when is_full then room else 0 end) over ({siblings})) * w
      / sum(case when is_full then 0 else w end) over ({siblings}) end as given from {name}_f)"""


def weight_sql(column: str, weights: dict[str, float]) -> str:
    cases = "".join(f" when x.{column} = '{k}' then {float(v)}::double" for k, v in weights.items())
    return f"case{cases} else 1.0::double end" if cases else "1.0::double"


SQL["op5_mixing"] = f"""
with d as (select doc_id, lang, source, {DOMAIN} as domain, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))::bigint as n,
      md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as place from documents),
  room as (select domain, lang, source, sum(n)::bigint as tokens, (sum(n) * 2)::double as room from d group by all),
  top as (select least(sum(room), floor(sum(tokens) * 0.9::double)) as given from room),
  {level_sql("one", "top", [], "domain", weight_sql("domain", WEIGHTS[0])).strip()},
  {level_sql("two", "one", ["domain"], "lang", weight_sql("lang", WEIGHTS[1])).strip()},
  {level_sql("three", "two", ["domain", "lang"], "source", weight_sql("source", WEIGHTS[2])).strip()},
  leaf as (select domain, lang, source, tokens, floor(given + 1e-6)::bigint as given, (floor(given + 1e-6)::bigint // tokens)::int as whole
    from three join room using (domain, lang, source)),
  placed as (select d.*, whole, given - whole * tokens as rest, md5('11:' || whole::varchar || ':' || place) as hash
    from d join leaf using (domain, lang, source)),
  run as (select *, sum(n) over (partition by domain, lang, source order by hash range between unbounded preceding and current row) as upto from placed),
  used as (select *, whole + (rest > 0 and upto <= rest)::int as times from run)
select doc_id, domain, lang, source, n as n_tokens, e::int as epoch from used, range(1, 3) r(e) where e <= times
"""


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality"))


@query
def op8_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"))


SQL["op8_near_vectors"] = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  n as (select vec_id, e, sqrt(list_dot_product(e, e)) as size from v),
  pair as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
  reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, p.b from reach r join pair p on p.a = r.b),
  low as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from pair where a = vec_id) as n_links, component_id, vec_id = component_id as kept from low
"""


@query
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)))


@query
def op9_near_text(spark: SparkSession, folder: str) -> DataFrame:
    return near_text(table(spark, folder, "documents", "doc_id", "text")).drop("body_md5")


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents", "doc_id", "text"), BYTE_BPE)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@query
def op11_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages", "page_id", "url", "html"))


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents", "text", "lang"))


SQL["op12_collocations"] = """
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
  piece as (select lang, unnest(string_split_regex(t, '[.,;:!?\n-\r]')) as p from d),
  w as (select lang, regexp_extract_all(p, '[^ \t]+') as w from piece),
  size as (select lang, sum(len(w))::bigint as n from w group by lang),
  f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*)::bigint as a from w, range(1, 4) q(k), range(1, len(w) - k + 2) r(i) group by all),
  cand as (select *, string_split(phrase, ' ') as x from f where k > 1 and a >= 10),
  cut as (select c.lang, c.phrase, c.a, j, l.a as l, r.a as r, ((1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a))::bigint as score
    from (select *, unnest(range(1, k)) as j from cand) c
    join f l on l.lang = c.lang and l.phrase = array_to_string(x[1:j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(x[j + 1:], ' ')),
  low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
  inner_part as (select lang, array_to_string(x[1:2], ' ') as phrase, a as longer from cand where k = 3 union all
    select lang, array_to_string(x[2:3], ' '), a from cand where k = 3),
  gone as (select distinct lang, phrase from inner_part join cand using (lang, phrase) where 100 * longer >= 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score
from low join size using (lang) where (lang, phrase) not in (select (lang, phrase) from gone) qualify rank <= 2000
"""


@query
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings", "vec_id", "embedding"))


def round_sql(before: str, name: str) -> str:
    """A round: nearest centroid of every vector, then floored means."""
    return f"""
  near_{name} as (select v.vec_id, v.e, c.k, {DISTANCE} as d from v, {before} c qualify row_number() over (partition by v.vec_id order by d, c.k) = 1),
  mean_{name} as (select k, list(s order by i) as e from (select k, i, floor(sum(e[i])::double / count(*))::bigint as s from near_{name}, range(1, 65) r(i) group by k, i) group by k),
  {name} as (select c.k, coalesce(m.e, c.e) as e from {before} c left join mean_{name} m using (k)),"""


DISTANCE = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
SQL["op13_centroids"] = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  c0 as (select row_number() over (order by sha256('2:' || vec_id::varchar)) - 1 as k, e from v qualify k < 40),
  {"".join(round_sql(f"c{i}", f"c{i + 1}") for i in range(5)).strip()}
  last as (select v.vec_id, c.k, c.e, {DISTANCE} as d from v, c5 c qualify row_number() over (partition by v.vec_id order by d, c.k) = 1)
select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(e, ',')) as centroid_sha256 from last
"""
