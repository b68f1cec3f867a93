"""Fill-in-middle, HTML extraction and lexical search bound to the given tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, html_extract, lexical
from .queries import query
from .shared import table

FILL_SQL = """
with docs as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
hashed as (
  select doc_id, t, length(t) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from docs
),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from hashed
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
  case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t
    when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end) as output_sha256,
  sha256(t) as restored_sha256
from cut
"""


@query("op11_piece_table", FILL_SQL)
def op11_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


SEARCH_SQL = rf"""
with docs as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}') as ts from documents
),
held as (select rid, doc_id, ts, len(ts) as n from docs where len(ts) > 0),
totals as (select count(*) as docs, sum(n)::bigint as terms from held),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}')) as t
  from benchmark
),
postings as (
  select rid, t, count(*) as tf from (select rid, unnest(ts) as t from held) semi join wanted using (t) group by rid, t
),
weights as (
  select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
  from (select t, count(*) as df from postings group by t), totals
),
scored as (
  select item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::bigint as score
  from wanted join postings using (t) join weights using (t) join held using (rid), totals group by item_id, rid
),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score
  from scored join held using (rid) where score > 0
)
select * from ranked where rank <= {lexical.K}
"""


@query("op13_block_max_search", SEARCH_SQL)
def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("op12_block_labeller")
def op12_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extracted(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
