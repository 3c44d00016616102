"""Line dedup (8): deletion-neighbourhood join.

Two lines within one edit (a character changed, put in or left out) become equal when at most one character is deleted from
each. So a line is given as hashed keys of its deletion variants, equal keys meet in a join, and the pairs are verified by their
edit distance. A line goes if an earlier line, kept or not, is equal to it or within one edit; earlier is by document id, then
by place. Blank lines always stay, and lines of fewer than ``SHORTEST`` characters only go for equal ones.

Emitting a variant for each character of every line would be a hundred times the corpus, so blocks are deleted before single
characters are: lines that are one edit apart are equal outside one of the two halves, and outside one of sixteen blocks. Only lines that
share such a coarse variant with another line go on to the next finer step, and only in the blocks where they do. Each step is
exact: no pair within one edit is lost.

Members of a group of equal variants are never paired with each other. Lines with the same character changed are all one edit
apart, so each is held against the first of the group; a line that is one character shorter is held against the first of the longer ones
and each of those against it. What a text line is and where it stands is a few dozen bytes; the lines themselves are only
read again for candidates.

Defined results: a null text counts as empty and has one blank line; rows that repeat id and text share their decisions; a null id
comes after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlog.llm.common import BROADCAST_ROWS, id_text, join_groups, slices
from slotlog.session import cut_lineage

SHORTEST = 20
BLOCKS = 16
LAST = (1 << 63) - 1

U = np.uint64
M1, M2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def sums(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from the left and from the right of place-dependent hashes of a line's characters.

    Both sides count places from their own end, so what is left of a cut and what is right of it hash alike in lines of other length.
    """
    a = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    k = np.arange(1, len(a) + 1, dtype=U)
    left = np.concatenate([np.zeros(1, U), np.cumsum(mixed(a * M1 + k))])
    right = np.concatenate([np.zeros(1, U), np.cumsum(mixed(a[::-1] * M2 + k))])
    return left, right


def outside(left: np.ndarray, right: np.ndarray, start, stop, n: int) -> np.ndarray:
    """Hash of the ``start`` characters from the left and the ``n - stop`` ones from the right."""
    return mixed(left[start] * M1 + mixed(right[n - stop] + U(7)) + np.asarray(start).astype(U))


def bounds(short: int, blocks: int) -> np.ndarray:
    return np.arange(blocks + 1) * short // blocks


def block_keys(left: np.ndarray, right: np.ndarray, n: int, blocks: int) -> np.ndarray:
    """Keys of the line without each block, as the shorter (n) and as the longer (n - 1) of a pair, by length and block."""
    out = []
    for short in (n - 1, n):
        b = bounds(short, blocks)
        h = outside(left, right, b[:-1], n - (short - b[1:]), n)
        out.append(mixed(h + np.arange(blocks).astype(U) * M2 + np.array([short], U) * M1))
    return np.concatenate(out).view(np.int64)


def digest(line: str) -> bytes:
    return blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


PLACE = "doc_id long, doc_hash long, line_no int"


def half_keys(lines: list[str]) -> np.ndarray:
    """Keys of each line without each half, as the shorter and as the longer of a pair; one row of four per line.

    The running sums go over all lines at once; a line's own sum is the difference of two of them.
    """
    a = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    stop = np.cumsum(n)
    start = stop - n
    place = np.arange(1, len(a) + 1) - np.repeat(start, n)
    left = np.concatenate([np.zeros(1, U), np.cumsum(mixed(a * M1 + place.astype(U)))])
    right = np.concatenate([np.zeros(1, U), np.cumsum(mixed(a * M2 + (np.repeat(n, n) + 1 - place).astype(U)))])
    out = np.empty((len(lines), 4), U)
    for i, short in enumerate((np.maximum(n - 1, 0), n)):
        half = short // 2
        front = left[start + half] - left[start]
        back = right[stop] - right[stop - (short - half)]
        out[:, 2 * i] = mixed(mixed(back + U(7)) + short.astype(U) * M1)
        out[:, 2 * i + 1] = mixed(mixed(front + U(11)) + short.astype(U) * M1 + M2)
    return out.view(np.int64)


HALVES = ["h0", "h1", "h2", "h3"]


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: its digest, its place and, for a line that can have near ones, four half-line keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                lines, rows, numbers = [], [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    for i, line in enumerate(text.split("\n")):
                        if line and not line.isspace():
                            lines.append(line)
                            rows.append(row)
                            numbers.append(i)
                keys = half_keys(lines)
                short = np.fromiter((len(x) < SHORTEST - 1 for x in lines), bool, len(lines))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(digest, lines), pa.binary()), part.column(0).take(at), part.column(1).take(at), pa.array(numbers, pa.int32()),
                     *(pa.array(keys[:, k], mask=short) for k in range(4))], names=["line_key", "doc_id", "doc_hash", "line_no", *HALVES])

    return docs.mapInArrow(run, f"line_key binary, {PLACE}, " + ", ".join(f"{h} long" for h in HALVES))


def shared_keys(lines: DataFrame, keys: str) -> DataFrame:
    """``lines`` exploded by their array ``keys``, only for keys that several lines have: line_key and ``at``, the place in the array."""
    placed = lines.select("line_key", F.posexplode(keys).alias("at", "key"))
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return placed.join(several, "key", "left_semi").select("line_key", "at")


def candidate_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """line_key, first place and text of the lines in ``firsts`` (line_key, doc_id, doc_hash, line_no), read from their documents."""
    wanted = firsts.groupBy("doc_id", "doc_hash").agg(F.collect_list(F.struct("line_no", "line_key")).alias("lines"))  # lines of one text
    wanted = cut_lineage(wanted, "line-wanted")
    found = docs.join(F.broadcast(wanted) if firsts.count() <= BROADCAST_ROWS else wanted, ["doc_id", "doc_hash"]).dropDuplicates(["doc_id", "doc_hash"])
    texts = found.select("doc_id", "doc_hash", F.explode("lines").alias("x"), F.split("text", "\n", -1).alias("parts"))
    return texts.select("x.line_key", F.struct("doc_id", "doc_hash", "x.line_no").alias("first"), F.element_at("parts", F.col("x.line_no") + 1).alias("line"))


def block_variants(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [block_keys(*sums(x), len(x), BLOCKS) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["line_key", "keys"])

    return lines.select("line_key", "line").mapInArrow(run, "line_key binary, keys array<long>")


def deletion_variants(lines: DataFrame) -> DataFrame:
    """Keys of the variants of each line (line_key, line, at: places in block_keys) with one character deleted in its blocks.

    kind 0: equal lengths, the same character changed; kind 1: a whole line; kind 2: a line one character longer than it.
    """

    def variants(line: str, places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(line)
        left, right = sums(line)
        spots = set()
        for at in places:
            short, block = (n - 1, n)[at // BLOCKS], at % BLOCKS
            b = bounds(short, BLOCKS)
            spots.update(range(b[block], n - (short - b[block + 1])))
        spot = np.array(sorted(spots), np.int64)
        cut = outside(left, right, spot, spot + 1, n)  # same characters around the same gap
        # As a plain text the variant has no gap: the running sum from the left over its n - 1 characters.
        a = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        k = np.arange(1, n + 1, dtype=U)
        closed = np.concatenate([np.zeros(1, U), np.cumsum(mixed(a[1:] * M1 + k[:-1]))])  # of the line moved one place to the left
        plain = left[spot] + (closed[-1] - closed[spot])
        first = np.concatenate([cut, left[-1:], plain])
        kind = np.concatenate([np.zeros(len(spot)), [1], np.full(len(spot), 2)]).astype(np.int8)
        length = np.where(kind == 2, n - 1, n).astype(U)
        gap = np.concatenate([spot + 1, np.zeros(1 + len(spot), np.int64)]).astype(U)
        salt = np.where(kind == 0, U(1), U(2))
        return kind, mixed(first * M1 + length + salt), mixed(mixed(first + M2) + gap * M1 + length * M2 + salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 64 << 10):
                found = [variants(x, p) for x, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                times = [len(f[0]) for f in found]
                at = pa.array(np.repeat(np.arange(len(times)), times))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(np.concatenate([f[0] for f in found])),
                     *(pa.array(np.concatenate([f[i] for f in found]).view(np.int64)) for i in (1, 2))], names=["line_key", "kind", "k1", "k2"])

    return lines.select("line_key", "line", "at").mapInArrow(run, "line_key binary, kind byte, k1 long, k2 long")


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """line_key of every line that has an earlier one within one edit, for distinct lines (line_key, first place, halves)."""
    long_ones = lines.filter("halves is not null")
    rough = shared_keys(long_ones, "halves").select("line_key").distinct()
    firsts = cut_lineage(long_ones.join(rough, "line_key", "left_semi").select("line_key", "first.*"), "line-rough")
    texts = cut_lineage(candidate_lines(docs, firsts), "line-texts")
    fine = shared_keys(cut_lineage(block_variants(texts), "line-blocks"), "keys").groupBy("line_key").agg(F.collect_set("at").alias("at"))  # 32 at most
    found = cut_lineage(deletion_variants(texts.join(fine, "line_key")), "line-variants")
    found = cut_lineage(found.join(texts.select("line_key", "first"), "line_key"), "line-variants")

    def first_of(kind: int):
        return F.min(F.when(F.col("kind") == kind, F.col("first")))

    groups = found.groupBy("k1", "k2").agg(first_of(0).alias("same"), first_of(1).alias("whole"), first_of(2).alias("longer"), F.count(F.lit(1)).alias("n"))
    partner = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("longer")).otherwise(F.col("whole"))
    pairs = found.join(groups.filter("n > 1"), ["k1", "k2"]).withColumn("partner", partner).filter("partner < first")
    pairs = pairs.select("line_key", "partner").distinct()
    verified = (pairs.join(texts.select("line_key", F.col("line").alias("a")), "line_key")
                .join(texts.select(F.col("first").alias("partner"), F.col("line").alias("b")), "partner")
                .filter((F.length("a") >= SHORTEST) & (F.length("b") >= SHORTEST) & F.levenshtein("a", "b", 1).between(0, 1)))
    return verified.select("line_key").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_same and n_near (lines that go for an equal and for a near earlier line) and text, the lines that stay."""
    plain = id_text(docs, id_col, text_col).withColumn("null_id", F.col("doc_id").isNull())
    plain = plain.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))).withColumn("doc_hash", F.xxhash64("text", "null_id"))
    keyed = plain.select("doc_id", "doc_hash", "text")
    rows = cut_lineage(occurrences(keyed), "line-places")
    lines = rows.groupBy("line_key").agg(F.min(F.struct("doc_id", "doc_hash", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"),
                                         *(F.max(h).alias(h) for h in HALVES))
    lines = cut_lineage(lines.withColumn("halves", F.when(F.col("h0").isNotNull(), F.array(*HALVES))).drop(*HALVES), "line-distinct")
    near = cut_lineage(near_lines(keyed, lines).withColumn("near", F.lit(True)), "line-near")
    touched = lines.select("line_key", "first", "n").join(near, "line_key", "left").filter("n > 1 or near")
    touched = cut_lineage(touched.withColumn("near", F.coalesce("near", F.lit(False))), "line-touched")
    place = F.struct("doc_id", "doc_hash", "line_no")
    gone = join_groups(rows.select("line_key", "doc_id", "doc_hash", "line_no"), touched, "line_key", "n").filter(F.col("near") | (place > F.col("first")))
    is_first = place == F.col("first")
    gone = gone.select("doc_id", "doc_hash", "line_no", is_first.alias("is_first")).distinct()
    lists = gone.groupBy("doc_id", "doc_hash").agg(F.collect_set("line_no").alias("gone"), F.sum(F.col("is_first").cast("long")).alias("n_near"))  # lines of one text
    joined = plain.join(lists, ["doc_id", "doc_hash"], "left")
    parts = F.split("text", "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    none = F.col("gone").isNull()
    return joined.select(
        F.when(~F.col("null_id"), F.col("doc_id")).alias("doc_id"), F.size(parts).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("gone") - F.col("n_near")).cast("long").alias("n_same"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(none, F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("text"))
