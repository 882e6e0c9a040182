"""The registered queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import REPLY_SCHEMA, format_chats, from_turns
from .common import materialise, read
from .fingerprints import fingerprints
from .html_extract import html_extract
from .line_dedup import line_dedup
from .lm_scores import lm_scores
from .near_dedup import near_groups
from .packing import packing
from .piece_bpe import encode_digests
from .quality_rules import quality_rules
from .token_counts import edited_counts


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = lambda trees: materialise(trees, "token_trees")
    return edited_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(from_turns(read(spark, sf_dir, "conversations")), {"reply": REPLY_SCHEMA})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(read(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_chat_format": op4_chat_format,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html_extract": op8_html_extract,
    "op9_fingerprints": op9_fingerprints,
    "op10_lm_scores": op10_lm_scores,
}

#: White space that a line's key loses, as DuckDB characters.
_EDGE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
numbered as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from split),
keyed as (select doc_id, pos, line, translate(trim(line, {_EDGE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from numbered),
repeated as (select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
judged as (select doc_id, pos, line, keeper is not null and keeper <> doc_id as lost from keyed left join repeated using (k))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where lost)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from judged group by doc_id""",
    "op4_chat_format": """
with m as (select conv_id, turn, role, coalesce(text, '') as text,
    case role when 'user' then 'call_' || turn when 'assistant' then 'call_' || (turn - 1) end as id from conversations),
j as (select a.*, b.turn is not null as linked, b.turn as call_turn, exists (select 1 from m r where r.conv_id = a.conv_id and a.role = 'user' and r.role = 'assistant' and r.id = a.id) as answered
  from m a left join m b on a.role = 'assistant' and b.role = 'user' and b.conv_id = a.conv_id and b.id = a.id),
s as (select *, greatest(turn, coalesce(call_turn, turn)) as place,
  case role when 'user' then '{"arguments":{"text":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(id) || ',"name":"reply","role":"user","turn":' || turn || '}'
    when 'assistant' then '{"content":' || to_json(text) || ',"id":' || to_json(id) || ',"role":"assistant","turn":' || turn || '}'
    else '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"turn":' || turn || '}' end as json from j)
select conv_id, count(*)::bigint as n_messages, count(*) filter (where linked)::bigint as n_linked,
  count(*) filter (where role = 'user' and not answered)::bigint as n_unanswered,
  count(*) filter (where role = 'assistant' and not linked)::bigint as n_orphans, 0::bigint as n_duplicates,
  count(*) filter (where role = 'user' and text = '')::bigint as n_invalid, 0::bigint as n_cyclic,
  '[' || string_agg(json, ',' order by place, turn) || ']' as chat
from s group by conv_id""",
    "op10_lm_scores": """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
tokens as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i, unnest(list_prepend(null, ws[:-2])) as v from words),
uni as (select w, count(*) as c from tokens group by w),
pairs as (select v, w, count(*) as c from tokens where i > 0 group by v, w),
total as (select count(*) as n from tokens),
scored as (select doc_id, i > 0 and p.c < 2 as backed,
  case when i = 0 then ln(u.c::double) - ln(n::double)
    when p.c >= 2 then ln(p.c::double) - ln(b.c::double) else ln(0.4::double) + (ln(u.c::double) - ln(n::double)) end as s
  from tokens t cross join total join uni u using (w) left join uni b on b.w = t.v left join pairs p on p.v = t.v and p.w = t.w),
summed as (select doc_id, count(*) as n_words, count(*) filter (where backed) as n_backoff, sum(s) as score from scored group by doc_id)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_backoff, 0)::bigint as n_backoff,
  round(coalesce(score, 0.0::double), 4) as log_score, round(score / n_words, 6) as mean_log_score
from documents left join summed using (doc_id)""",
}
