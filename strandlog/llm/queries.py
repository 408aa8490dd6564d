"""The queries of this subpackage and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import bpe, chat, egojoin, lines, mixing, simhash, suffixes, telephony, toxicity, warc
from strandlog.llm._common import stage, table

TOKENIZER = os.environ.get("STRANDLOG_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"))


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
m as (select *, max(page_id) over (partition by payload) as first from p)
select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest,
  case when octet_length(payload) >= 1000 and first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when octet_length(payload) >= 1000 and page_id is distinct from first then first end as refers_to
from m
"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
with t as (select conv_id, turn, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\\\1|', 'g'), '[\r\n]', ' ', 'g') as who,
    regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') as text,
    cast(floor(coalesce(turn, 0) / 512) as bigint) as part from conversations),
r as (select distinct conv_id as c, who as perspective from t),
x as (select t.*, perspective,
    case when who = perspective then '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10)
      else '<|im_start|>user name=' || who || chr(10) || text || '<|im_end|>' || chr(10) end as line
  from t join r on t.conv_id is not distinct from r.c),
y as (select *, coalesce(sum(length(line)) over (partition by conv_id, perspective order by part, turn nulls first, who, text
    rows between unbounded preceding and 1 preceding), 0) as pos from x)
select conv_id, perspective, part, count(*) as n_turns, string_agg(line, '' order by turn nulls first, who, text) as text,
  coalesce(string_agg(case when who = perspective then cast(cast(pos + 22 as bigint) as varchar) || '-' || cast(cast(pos + length(line) - 1 as bigint) as varchar) end,
    ',' order by turn nulls first, who, text), '') as mask
from y group by conv_id, perspective, part
"""


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stage(telephony.store(table(spark, sf_dir, "documents")), "telephony-media")
    return telephony.read_back(media, pcm=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, keep=("doc_id",), ids=False)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with d as (select doc_id, text, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as digest from documents),
s as (select source, sum(size)::double as n, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select source, n, case k % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight,
    case k % 3 when 0 then 0.5::double when 1 then 2.0::double else 1.0::double end as trend, 2 * n as cap from s),
l as (select *, cap / weight as reach, ((sum(n) over ()) * 1.5::double - coalesce(sum(cap) over (order by cap / weight, source nulls last
      rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following)) as level from w),
f as (select arg_min(level, reach) as level from l where level <= reach),
t as (select l.source, cast(l.n as bigint) as source_size, coalesce(least(l.cap, f.level * l.weight), l.cap) as target, l.trend from l left join f on true),
q as (select d.doc_id, d.size, t.source_size, t.target, t.trend, cast(round(t.target) as bigint) as total,
    cast(coalesce(sum(d.size) over (partition by d.source order by d.digest, md5(coalesce(d.text, ''))
      rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from d join t on d.source is not distinct from t.source),
r as (select *, case when source_size > 0 then total // source_size else 0 end as repeats,
    case when total > 0 then least(1.0::double, before::double / total::double) else 0.0::double end as share, (trend - 1) / (trend + 1) as slope from q)
select doc_id, size, source_size, target, cast(repeats * size + greatest(0, least(size, total - repeats * source_size - before)) as bigint) as taken,
  round(coalesce((sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / nullif(2 * slope, 0), share), 9) as first_position
from r
"""


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(table(spark, sf_dir, "documents"))


def op10_egojoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
g as (select * from v where label is not null and x is not null and list_sum(list_transform(x, lambda y: y * y)) > 0
    and not list_contains(list_transform(x, lambda y: y is null or isnan(y) or isinf(y)), true)),
e as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
    where list_cosine_similarity(a.x, b.x) >= 0.98),
r as (select vec_id as a, vec_id as b from v union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from e group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.a = v.vec_id left join n on n.a = v.vec_id
"""

QUERIES = {
    "op1_warc": op1_warc,
    "op2_chat": op2_chat,
    "op3_telephony": op3_telephony,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_lines": op7_lines,
    "op8_mixing": op8_mixing,
    "op9_suffixes": op9_suffixes,
    "op10_egojoin": op10_egojoin,
}
ORACLES = {"op1_warc": OP1_SQL, "op2_chat": OP2_SQL, "op8_mixing": OP8_SQL, "op10_egojoin": OP10_SQL}
