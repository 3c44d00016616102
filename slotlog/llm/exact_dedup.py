"""Exact dedup (1): static binary-fuse filters, exact buckets, and grouping of the new batch.

A snapshot is an immutable set of documents that were taken in before. Its exact buckets hold one row
per distinct text (digest, first id, number of rows), and each bucket has a binary-fuse filter over
its digests. A new batch is first grouped by digest on its own. Its digests are screened by the filters: what the
filter of its bucket does not hold is new for certain, only the rest joins the exact buckets, and the texts
behind each such match are compared byte for byte.

Digests are evenly spread, so buckets are even whatever the texts are. Copies are counted by partial
sums before any exchange, so a text that a third of all rows share is one row in the shuffle. Groups so
large that their rows would crowd one task are, for their number is bounded, joined by broadcast.

Texts are equal when they are the same after each run of blank, tab, line feed, vertical tab, form feed and
carriage return has become one blank. Defined results: a null text counts as the empty text; ids are compared as
numbers and a null id comes after all others; rows that repeat id and text share one decision; an empty table
or an empty snapshot gives no matches; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlog.llm.common import id_text
from slotlog.llm.fuse_filter import FuseFilter
from slotlog.session import cut_lineage

#: Digests of one bucket at most, on average; a filter of that size takes about 0.6 MB.
BUCKET_ROWS = 250_000
#: A side is broadcast only up to so many rows of a few dozen bytes.
BROADCAST_ROWS = 200_000
#: Groups with at least this share of the rows are joined by broadcast; there are at most 1 / share of them.
HOT_SHARE = 1e-3

FILTERS = "bucket int, seed decimal(20,0), segment int, segments int, prints binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the SHA-256 of the normalised text and a hash of the text as it is, of every row."""
    return id_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
                                                  F.xxhash64("text").alias("text_hash"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: first id and number of rows."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"))


@dataclass(frozen=True)
class Snapshot:
    """Exact buckets (digest, first_id, size, bucket) and their filters, both stored and never changed."""

    buckets: DataFrame
    filters: DataFrame
    n_buckets: int


def keys_of(digest: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    return np.frombuffer(b"".join(d[:8] for d in digest), ">u8").astype(np.uint64)


def take_snapshot(rows: DataFrame, new_rows: int = 0) -> Snapshot:
    """Snapshot of rows of ``digests``; ``new_rows`` is the size of the largest batch that will be screened."""
    groups = cut_lineage(grouped(rows), "exact-groups")
    n_buckets = max(1, -(-max(groups.count(), new_rows) // BUCKET_ROWS))
    buckets = groups.withColumn("bucket", bucket_of(F.col("digest"), n_buckets))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(keys_of(pdf["digest"]))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": [decimal(f.seed)], "segment": [f.segment],
                             "segments": [f.segments], "prints": [f.prints.tobytes()]})

    filters = buckets.select("bucket", "digest").groupBy("bucket").applyInPandas(build, FILTERS)
    return Snapshot(buckets, cut_lineage(filters, "exact-filters"), n_buckets)


def decimal(n: int):
    from decimal import Decimal

    return Decimal(n)


def bucket_of(digest: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(n_buckets)).cast("int")


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``groups`` (digest, first_id, size) with ``maybe``: whether the filter of its bucket holds the digest."""

    def probe(pdf: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["digest", "first_id", "size"]].assign(maybe=False)
        if len(filters) and len(pdf):
            r = filters.iloc[0]
            f = FuseFilter(int(r["seed"]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["prints"], np.uint16))
            out["maybe"] = f.holds(keys_of(pdf["digest"]))
        out["first_id"] = out["first_id"].astype("Int64")
        return out

    placed = groups.withColumn("bucket", bucket_of(F.col("digest"), snapshot.n_buckets))
    return placed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(
        probe, "digest binary, first_id long, size long, maybe boolean")


def same_bytes(matches: DataFrame, old_docs: DataFrame, new_docs: DataFrame) -> DataFrame:
    """The rows of ``matches`` (digest, old_id, new_id, ...) whose two texts are equal byte for byte.

    Only the texts of matched first rows are read. Their ids are broadcast up to ``BROADCAST_ROWS``
    and joined by a shuffle beyond.
    """
    n = matches.count()
    small = n <= BROADCAST_ROWS

    def texts(docs: DataFrame, id_name: str) -> DataFrame:
        wanted = matches.select(F.col(id_name).alias("wanted_id"), F.col("digest").alias("wanted"))
        found = docs.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
        found = found.select("wanted", normalised(F.col("text")).alias("t"))
        return found.filter(F.unhex(F.sha2("t", 256)) == F.col("wanted")).groupBy("wanted").agg(F.min("t").alias("t"))

    old, new = texts(old_docs, "old_id"), texts(new_docs, "new_id")
    equal = old.join(new.withColumnsRenamed({"wanted": "wanted_new", "t": "t_new"}),
                     (F.col("wanted") == F.col("wanted_new")) & (F.col("t") == F.col("t_new"))).select(F.col("wanted").alias("digest"))
    return matches.join(equal, "digest", "left_semi")


def decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Which row of each text stays, for a snapshot ``old`` and a batch ``new``, both doc_id and text.

    doc_id, keep_id (smallest id of the same text), group_size, kept, text_sha256 and text_hash (of the text as it is) for every row of both.
    """
    spark = old.sparkSession
    rows = cut_lineage(digests(old).withColumn("is_new", F.lit(False)).unionByName(digests(new).withColumn("is_new", F.lit(True))), "exact-digests")
    return _decisions(spark, rows, old, new)


def _decisions(spark: SparkSession, rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    new_groups = cut_lineage(grouped(rows.filter("is_new")), "exact-new")
    snapshot = take_snapshot(rows.filter("not is_new"), new_groups.count())
    screened = screen(new_groups, snapshot)
    matches = cut_lineage(
        screened.filter("maybe").select("digest", F.col("first_id").alias("new_id"), F.col("size").alias("new_size"))
        .join(snapshot.buckets.select("digest", F.col("first_id").alias("old_id"), F.col("size").alias("old_size")), "digest"),
        "exact-matches")
    confirmed = cut_lineage(same_bytes(matches, old, new), "exact-confirmed")
    first = F.least("old_id", "new_id")  # skips nulls
    both = confirmed.select("digest", first.alias("both_id"), (F.col("old_size") + F.col("new_size")).alias("both_size"))
    groups = (snapshot.buckets.select("digest", "first_id", "size", F.lit(False).alias("is_new"))
              .unionByName(new_groups.select("digest", "first_id", "size", F.lit(True).alias("is_new")))
              .join(both, "digest", "left")
              .select("digest", "is_new", F.when(F.col("both_size").isNotNull(), F.col("both_id")).otherwise(F.col("first_id")).alias("keep_id"),
                      F.coalesce("both_size", "size").alias("group_size")))
    groups = cut_lineage(groups, "exact-keep")
    hot = F.col("group_size") >= max(1000, int(rows.count() * HOT_SHARE))
    renamed = groups.withColumnsRenamed({"digest": "d", "is_new": "n"})
    on = (F.col("digest") == F.col("d")) & (F.col("is_new") == F.col("n"))
    large = rows.join(F.broadcast(renamed.filter(hot)), on)
    rest = (rows.join(F.broadcast(renamed.filter(hot).select("d", "n")), on, "left_anti").join(renamed.filter(~hot), on))
    return large.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "text_hash")


def dedup_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decisions`` within one table: its older half by id is the snapshot, the rest the new batch."""
    plain = id_text(docs, id_col, text_col)
    middle = plain.select("doc_id").approxQuantile("doc_id", [0.5], 0.01)
    is_old = F.coalesce(F.col("doc_id") <= (middle[0] if middle else 0), F.lit(False))
    rows = cut_lineage(digests(plain).withColumn("is_new", ~is_old), "exact-digests")
    return _decisions(docs.sparkSession, rows, plain.filter(is_old), plain.filter(~is_old))
