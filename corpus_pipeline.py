"""From raw documents to token digests: language, exact and near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.

Defined results: a null or empty text has no language and goes in the first stage; where a later stage gets one, null counts as
empty: such rows are exact copies of each other, near nothing, hold no leak and have no tokens. Rows with null or
repeated ids are decided one by one. Of rows that are equal in everything, or tie in their id, exactly one of a group stays. Long texts
are read whole. An empty table gives no rows in any stage. All but the last stage return the columns they got, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlog.llm import bpe_codec, decontaminate, exact_dedup, language_id, ngram_join
from slotlog.llm.common import without
from slotlog.llm.queries import TOKENIZER, table
from slotlog.session import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or far from every language's profile go. Profiles come from the rows that are not held out.

    If no row has a language to learn from, none is accepted. Texts without a letter are null, empty or blank ones too.
    """
    return language_id.keep(docs, language_id.learn(docs))


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, stored so that it stays, and the name of that column, which no column of ``docs`` has.

    Ids may be null or repeated, and a decision is about one row.
    """
    name, taken = "row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows"), name


def all_but_first(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """Of ``groups`` (``row`` and ``group``) the rows but one of each group: that with the smallest id stays, one without an id only among such."""
    placed = groups.join(rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id")), "row")
    placed = cut_lineage(placed, "pipeline-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    first = placed.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return placed.join(first, "row", "left_anti").select("row")


def less(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose ``key`` is in column ``row`` of ``gone``, and without the key."""
    return without(rows, gone, {"row": rows[key]}).drop(key)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one with the smallest id stays."""
    rows, key = with_row_key(docs)
    copies = exact_dedup.dedup_table(rows, id_col=key).filter("group_size > 1")
    return less(rows, key, all_but_first(rows, key, copies.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that hang together by word 5-gram sets with a similarity of 0.8 or more one with the smallest id stays.

    Texts without words, null ones too, are near nothing and stay; ties of the id are broken by the place in the table.
    """
    rows, key = with_row_key(docs)
    classes = ngram_join.near_duplicates(rows, id_col=key)
    return less(rows, key, all_but_first(rows, key, classes.select(F.col("doc_id").alias("row"), F.col("class_id").alias("group"))))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a passage of the benchmark occurs go."""
    rows, key = with_row_key(docs)
    leaks = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    return less(rows, key, leaks.select(F.col("doc_id").alias("row")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of the ids and of the text decoded from them, one row for every row; a null text counts as empty."""
    return bpe_codec.round_trip(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe_encoding", encode),
]

#: The stages are models, sketches and alignments; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
