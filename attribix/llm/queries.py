"""The operators bound to the given tables, each next to its SQL counterpart where SQL can express it."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import cotraining, fuzzy_lines, host_reputation, packing, prefix_bpe, quality_rules, secrets, simhash_trie, token_shards, voronoi_knn
from ..session import shared_folder
from .shared import prepared, table
from .tokens import crc_of

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def crc32_of(ids, width):
    """Unsigned CRC-32 of ids stored in ``width`` bytes each, as if stored in four."""

    @F.arrow_udf(LongType())
    def crc(values: pa.Array, widths: pa.Array) -> pa.Array:
        return pa.array([crc_of(v.as_py(), f"<u{w.as_py()}") for v, w in zip(values, widths, strict=True)], pa.int64())

    return crc(ids, width)


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
with rows as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t, {WORDS_SQL} as ws from documents),
windows as (
  select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as w
  from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from rows)
),
twice as (select rid, w from windows group by rid, w having count(*) > 1),
covered as (
  select rid, count(distinct i + k) as n
  from (select rid, i, unnest([0, 1, 2]) as k from windows semi join twice using (rid, w)) group by rid
),
lines as (
  select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
  from (select rid, unnest(string_split(t, chr(10))) as l from rows) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid
),
measured as (
  select rows.doc_id, rows.source, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_lines, 0) as n_lines,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
  from rows left join covered using (rid) left join lines using (rid)
),
ruled as (select *, {", ".join(f"({rule}) as {name}" for name, rule in quality_rules.RULES.items())} from measured),
hosts as (
  select source, count(*) as n, {", ".join(f"sum({r}::int) as {r}" for r in quality_rules.RULES)} from ruled group by source
),
moments as (
  select {", ".join(f"avg({r} / n) as m_{r}, var_pop({r} / n) as v_{r}" for r in quality_rules.RULES)} from hosts
),
weighed as (
  select *, {", ".join(
    f"case when v_{r} <= 0 then {quality_rules.WEIGHT_MAX} else least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, "
    f"{quality_rules.WEIGHT_MIN}), {quality_rules.WEIGHT_MAX}) end as w_{r}" for r in quality_rules.RULES)} from hosts, moments
),
shrunk as (
  select *, {", ".join(f"({r} + w_{r} * m_{r}) / (n + w_{r}) as r_{r}" for r in quality_rules.RULES)} from weighed
),
verdicts as (
  select source, case
    when greatest({", ".join(f"r_{r} - {quality_rules.Z} * sqrt(r_{r} * (1 - r_{r}) / (n + w_{r} + 1))" for r in quality_rules.RULES)})
      > {quality_rules.HOST_RATE} then 'rejected'
    when greatest({", ".join(f"r_{r} + {quality_rules.Z} * sqrt(r_{r} * (1 - r_{r}) / (n + w_{r} + 1))" for r in quality_rules.RULES)})
      < {quality_rules.TRUST_RATE} then 'trusted' else 'neutral' end as host_verdict
  from shrunk
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_base as base_failed, host_verdict,
  not fail_base and host_verdict <> 'rejected'
    and (not ({" or ".join(quality_rules.OWN)}) or host_verdict = 'trusted') as kept
from ruled join verdicts on ruled.source is not distinct from verdicts.source
"""


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_verdict", "kept")


@query("op2_prefix_bpe")
def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN
    rows = prefix_bpe.encoded(table(spark, sf_dir, "documents"), path, pattern)
    return rows.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_cotraining")
def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_token_shards")
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "tokens")
    token_shards.write(docs, folder, public_tokenizers.path(WORD_VOCABULARY))
    rows = token_shards.read(token_shards.keys_of(docs), folder)
    return rows.select("doc_id", "start", "n_tokens", crc32_of(F.col("ids"), F.col("width")).alias("ids_crc32"))


@query("op5_fuzzy_lines")
def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fuzzy_lines.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "text")


KNN_SQL = f"""
with v as (
  select vec_id, [floor({voronoi_knn.SCALE:g} * x::double) for x in embedding] as e
  from embeddings
  where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len([x for x in embedding if not isfinite(x)]) = 0
),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {voronoi_knn.EVERY} = 0
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= {voronoi_knn.K}
"""


@query("op6_voronoi_knn", KNN_SQL)
def op6_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, sf_dir, "embeddings"))


@query("op7_best_two_fit")
def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return rows.select(
        "doc_id", "piece", "start", "length", crc32_of(F.col("ids"), F.col("width")).alias("ids_crc32"), "sequence_id",
        "offset")


def _level_sql(name: str, source: str, key: str, more: str = "") -> str:
    """Posterior of one level in SQL; ``source`` has key, n, good, centre."""
    h = host_reputation
    return f"""
{name}_m as (select avg(good / nullif(n, 0)) as m, var_pop(good / nullif(n, 0)) as v from {source}),
{name}_w as (
  select {key}{more}, n, good, centre, case when v is null then {h.WEIGHT_MIN} when v <= 0 then {h.WEIGHT_MAX}
    else least(greatest(m * (1 - m) / v - 1, {h.WEIGHT_MIN}), {h.WEIGHT_MAX}) end as w
  from {source}, {name}_m
),
{name} as (
  select {key}{more}, mean, mean + {h.Z} * sqrt(greatest(mean * (1 - mean), 0) / (n + w + 1)) as upper
  from (select *, (good + w * centre) / (n + w) as mean from {name}_w)
)"""


REPUTATION_SQL = rf"""
with urls as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), '{host_reputation.UPPER}', '{host_reputation.LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) as path
  from pages
),
rules(verdict, rule) as (values {", ".join(f"('{v}', '{r}')" for v, r in host_reputation.RULES)}),
hits as (
  select host, path, max_by(verdict, length(rule) * 1000 + strpos(rule, '/')) as verdict,
    max_by(rule, length(rule) * 1000 + strpos(rule, '/')) as rule
  from (select distinct host, path from urls), rules
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
    and starts_with(path, substr(rule, strpos(rule, '/')))
  group by host, path
),
marks as (select doc_id, count(*) as n, sum(quality) as good from labels where quality is not null group by doc_id),
located as (select *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.?(:[0-9]*)?\z', '') as name from urls),
counted as (
  select name, coalesce(sum(n), 0) as n, coalesce(sum(good), 0) as good, string_split(name, '.') as parts
  from located left join marks on page_id = doc_id group by name
),
hosts as (
  select *, array_to_string(parts[-2:], '.') as two, parts[-1] as last, array_to_string(parts[-3:], '.') as three,
    regexp_matches(name, '{host_reputation.ADDRESS}') as number
  from counted
),
learned as (select two from hosts where len(parts) > 2 and not number group by two having count(distinct parts[-3]) >= {host_reputation.SUFFIX_NAMES}),
named as (
  select name, n, good, case when number then name when wide then two else last end as suffix,
    case when number then name when wide then three else two end as domain
  from (select *, two in {host_reputation.TWO_LABEL_SUFFIXES} or two in (select two from learned) as wide from hosts)
),
suffix_in as (
  select suffix, sum(n) as n, sum(good) as good, (select coalesce(sum(good) / nullif(sum(n), 0), 1.0) from named) as centre
  from named group by suffix
),
{_level_sql("suffixes", "suffix_in", "suffix")},
domain_in as (
  select domain, suffix, sum(n) as n, sum(good) as good, any_value(mean) as centre
  from named join suffixes using (suffix) group by domain, suffix
),
{_level_sql("domains", "domain_in", "domain")},
host_in as (select name, n, good, mean as centre from named join domains using (domain)),
{_level_sql("reputations", "host_in", "name")}
select page_id, host, path, rule,
  coalesce(verdict, case when upper < {host_reputation.MIN_GOOD} then 'block' else 'allow' end) as verdict,
  round(mean, 9) as host_mean
from located join reputations using (name) left join hits using (host, path)
"""


@query("op8_host_reputation", REPUTATION_SQL)
def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_reputation.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return rows.select("page_id", "host", "path", "rule", "verdict", F.round("host_mean", 9).alias("host_mean"))


@query("op9_secret_scans")
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.found(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return rows.select(
        "doc_id", of("assign"), of("access"), of("hex"), of("novel"),
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"))


@query("op10_simhash_trie")
def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
