"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.packing import pack
    return pack(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048, 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.recompress import remove_repeats
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, 35, kept_col="kept").select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.token_count import count_tokens
    return count_tokens(_table(spark, sf_dir, "documents"), "piece_bpe_32k.model", 4096)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.jaccard import similarity_join
    return similarity_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.chat import render
    return render(_table(spark, sf_dir, "conversations"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.nearest import nearest
    return nearest(_table(spark, sf_dir, "embeddings"), 5, "id % 50 = 0")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.quality import quality
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.token_files import token_files
    return token_files(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 2)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.suffixes import repeated_passages
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.rank_model import encode_decode
    return encode_decode(_table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.lexical import search
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 20)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.line_runs import drop_repeated_lines
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, kept_col="kept").select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from imputeflow.llm.repair import damaged, repair_report
    return repair_report(damaged(_table(spark, sf_dir, "conversations"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_substring_dedup, op3_token_counts, op4_ngram_jaccard_join, op5_chat_formatting,
        op6_nearest_neighbours, op7_quality_rules, op8_token_files, op9_suffix_array_dedup, op10_byte_bpe,
        op11_lexical_search, op12_line_dedup, op13_conversation_repair)}


OP5_SQL = r"""
with turns as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
numbered as (
  select conv_id, role, text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as turn_no from turns),
rolled as (
  select *, list(md5(turn_no || '|' || role || '|' || text)) over (partition by conv_id order by turn_no
              rows between unbounded preceding and current row) as prefix,
         count(*) over (partition by conv_id) as n_turns from numbered),
keyed as (select *, md5(array_to_string(prefix, ',')) as h from rolled),
whole as (select n_turns, h, min(conv_id) as conv_id, count(*) as n_equal from keyed
          where turn_no = n_turns group by n_turns, h),
kept as (select * from whole w where not exists (
  select 1 from keyed k where k.turn_no < k.n_turns and k.turn_no = w.n_turns and k.h = w.h)),
text as (select k.conv_id, k.n_turns, k.n_equal, r.turn_no, r.role,
                '<|im_start|>' || r.role || chr(10) || r.text || '<|im_end|>' || chr(10) as rendered
         from kept k join numbered r on r.conv_id = k.conv_id)
select conv_id, n_turns::int as n_turns, n_equal, turn_no::int as turn_no, role, rendered,
       coalesce(sum(length(rendered)) over (partition by conv_id order by turn_no
         rows between unbounded preceding and 1 preceding), 0)::bigint as start
from text
"""


OP11_SQL = r"""
with docs as (
  select row_number() over () as row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
items as (
  select item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
asked as (select item_id, term, count(*) as qtf from items group by 1, 2),
total as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from docs where len(terms) > 0),
postings as (
  select row_no, doc_id, n, term, count(*) as tf
  from (select row_no, doc_id, len(terms) as n, unnest(terms) as term from docs)
  where term in (select term from asked) group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from postings, total group by term, n_docs),
parts as (
  select row_no, doc_id, term,
         (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms))) as part
  from postings, total),
scored as (
  select item_id, row_no, doc_id, sum(qtf * w * part)::bigint as score
  from asked join weights using (term) join parts using (term) group by all),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id, row_no) as rank
  from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""

OP12_SQL = r"""
with lines as (
  select row_no, doc_id, generate_subscripts(parts, 1) as place, unnest(parts) as line
  from (select row_number() over () as row_no, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
holders as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key),
judged as (
  select k.*, h.key is not null and k.doc_id is distinct from h.first as gone
  from keyed k left join holders h on h.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from judged group by row_no, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": OP5_SQL, "op11_lexical_search": OP11_SQL, "op12_line_dedup": OP12_SQL}
