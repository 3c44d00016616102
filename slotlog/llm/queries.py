"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlog.llm import (bpe_codec, decontaminate, exact_dedup, language_id, line_dedup, merkle, ngram_join, quality, ranked_search, token_counts,
                         token_files, toxicity, url_filter)
from slotlog.session import work_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_table(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, recall=0.9999)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, limit=1024)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_same", "n_near", F.sha2("text", 256).alias("text_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), TOKENIZER, out, end_id=0)
    return token_files.checksums(token_files.read(spark, out))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


#: The rule list that the query's pages are judged by.
URL_RULES = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"), url_filter.Rule("www.example.com", "/en/", "allow"),
             url_filter.Rule("net", "/es/", "block"), url_filter.Rule("net", "/fr/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_url_filter": op12_url_filter,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
      select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
        doc_id is not distinct from min(doc_id) over same as kept, sha256(t) as text_sha256
      from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents) d
      window same as (partition by t)""",
    # Within one edit: the same line without one character each (at the same place), or one is the other without one.
    "op8_line_dedup": r"""
      with texts as (select doc_id, coalesce(text, '') as t from documents),
      cut as (select doc_id, string_split(t, chr(10)) as parts from texts),
      placed as (select doc_id, unnest(range(len(parts))) as line_no, unnest(parts) as line from cut),
      numbered as (select *, row_number() over (order by doc_id, line_no) as f, trim(line, chr(32) || chr(9) || chr(13)) <> '' as shown from placed),
      firsts as (select line, min(f) as f, length(line) as n from numbered where shown group by line),
      variants as (select f, n, i, line[1:i - 1] || line[i + 1:] as v
                   from (select *, unnest(range(1, n + 1)) as i from firsts where n >= 20)),
      near as (select b.f from variants a join variants b on a.n = b.n and a.i = b.i and a.v = b.v and a.f < b.f
               union select b.f from variants b join firsts a on a.line = b.v and a.f < b.f and a.n >= 20
               union select b.f from variants a join firsts b on b.line = a.v and a.f < b.f and b.n >= 20),
      marked as (select p.*, coalesce(p.f <> x.f, false) as same_line, y.f is not null as near_line
                 from numbered p left join firsts x on p.shown and p.line = x.line left join near y on y.f = x.f)
      select doc_id, count(*) as n_lines, count(*) filter (same_line) as n_same, count(*) filter (near_line and not same_line) as n_near,
        sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (not same_line and not near_line), '')) as text_sha256
      from marked group by doc_id""",
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_url_filter": url_filter.oracle(URL_RULES),
    "op13_merkle_manifest": merkle.oracle(),
}
