"""N-gram Jaccard join (4): MinHash banding with verification on full n-gram sets.

Documents are sets of five-word shingles (lower case, marks at the ends of words dropped). Documents with equal sets are one
class of copies, counted by partial sums, and only its first document goes on. MinHash signatures are cut into bands; the
numbers of bands and rows follow from the similarity and the recall that is asked for. Documents meet in a bucket when a
whole band is equal, and every such pair is verified on the full sets.

* A bucket of up to ``SMALL`` members gives its pairs, each only once over all bands. A document thus has a bounded number of
  them for each band.
* A larger bucket never gives pairs. Its members are dealt to blocks, each two blocks meet in a group of bounded size, and
  what comes out is one row per member: the number of links found there and the smallest document it hangs together
  with. A pair that shares several large buckets is counted in the first of them.

Links make classes by label propagation with pointer jumping over stored tables. Nothing is collected to the driver but counts.

Result, one row per document: doc_id, copy_of (first document with the same shingle set), class_id (first document of all that
hang together by links of at least the threshold), n_links (number of other distinct shingle sets it is linked with).

Defined results: a text of fewer than five words has one shingle of all of them; a null text or one without words is linked
with nothing; a null id gives a row of its own with null classes; each row under a repeated id goes by its own text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlog.llm.bpe import Table
from slotlog.llm.common import id_text, join_groups, only_ids, slices, worker_tables
from slotlog.session import cut_lineage

if TYPE_CHECKING:  # a worker that reads texts only does without it
    import pandas as pd

WORDS = 5
#: Members of a bucket that gives its pairs one by one.
SMALL = 64
#: Members of a block of a larger bucket, on average.
BLOCK = 256

U = np.uint64


def bands_for(threshold: float, recall: float, most: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which ``recall`` at ``threshold`` takes at most ``most`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _word_hash(token: str) -> int:
    word = token.lower().strip(".,;:!?\"'()[]{}*#$%&|-_<>/\\=+~`^@")
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1 if word else 0


def words() -> Table:
    """Hashes of the words this worker process has seen lately."""
    return worker_tables("ngram words", None, lambda: Table(_word_hash, most=60_000))


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams of a text."""
    tokens = text.split()
    w = np.fromiter(map(words().__getitem__, tokens), U, len(tokens))
    w = w[w != 0]
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, U)
    for k in range(min(WORDS, len(w))):
        h = h * U(0x9E3779B97F4A7C15) + w[k:k + n]
    return np.unique(spread(h + U(min(WORDS, len(w)))))


class Signer:
    """Band keys of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(1, 2**63, bands * rows, U) * U(2) + U(1)
        self.plus = rng.integers(0, 2**63, bands * rows, U)

    def keys(self, h: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, 2**64 - 1, U)
        for at in range(0, len(h), 4096):  # long texts in pieces, so that memory stays bounded
            np.minimum(low, (h[at:at + 4096, None] * self.times + self.plus).min(axis=0), out=low)
        key = np.arange(self.bands, dtype=U)
        for column in low.reshape(self.bands, self.rows).T:
            key = spread(key * U(0x9E3779B97F4A7C15) + column)
        return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, set_key (digest of the shingle set, null without words), n (its size) and keys (one per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signer.keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "set_key", "n", "keys"])

    return docs.mapInArrow(run, "doc_id long, set_key binary, n long, keys array<long>")


def digest(shingle_set: np.ndarray) -> bytes:
    return blake2b(shingle_set.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """The whole shingle set of every text and its digest ``set_key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                                 names=["set_key", "shingles"])

    return docs.mapInArrow(run, "set_key binary, shingles array<long>")


def block_links(key: int, reps: np.ndarray, sets: list[np.ndarray], large: list[np.ndarray], left: np.ndarray, right: np.ndarray,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the members in ``left`` and those in ``right`` (numbers of members), as counts and smallest connected member.

    Only pairs for which ``key`` is the smallest large bucket they share count as links here.
    """
    n = len(reps)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        here = np.zeros((n, 4096), np.float32)
        here[owner[a:b], column[a:b] - at] = 1
        common += here[left] @ here[right].T
    linked = common / (sizes[left][:, None] + sizes[right][None, :] - common).astype(np.float64) >= threshold
    same = reps[left][:, None] == reps[right][None, :]
    linked &= ~same
    earlier: dict[int, list[int]] = {}
    for i, keys in enumerate(large):
        for k in keys:
            if k < key:
                earlier.setdefault(int(k), []).append(i)
    counted = linked.copy()
    for members in earlier.values():
        inside = np.zeros(n, bool)
        inside[members] = True
        counted[np.ix_(np.flatnonzero(inside[left]), np.flatnonzero(inside[right]))] = False
    links = np.zeros(n, np.int64)
    np.add.at(links, left, counted.sum(axis=1))
    if left is not right:
        np.add.at(links, right, counted.sum(axis=0))
    root = reps.copy()
    while True:  # smallest member reached over links inside the group
        top = root.copy()
        for i, row in zip(left, linked, strict=True):
            touched = right[row]
            if len(touched):
                low = min(top[i], top[touched].min())
                top[i] = low
                top[touched] = np.minimum(top[touched], low)
        if (top == root).all():
            return links, root
        root = top


def large_bucket_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """rep, links and root for the members (bucket, m, rep, n, large) of large buckets; every two blocks meet once."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "rep", "large", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        key, i, j = int(pdf["bucket"].iloc[0]), pdf["i"].iloc[0], pdf["j"].iloc[0]
        block = pdf["block"].to_numpy()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        reps = pdf["rep"].to_numpy(np.int64)
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": reps[:0], "links": reps[:0], "root": reps[:0]})
        links, root = block_links(key, reps, [np.asarray(s) for s in pdf["shingles"]], list(pdf["large"]), left, right, threshold)
        kept = (links > 0) | (root != reps)
        return pd.DataFrame({"rep": reps[kept], "links": links[kept], "root": root[kept]})

    return dealt.join(sets, "rep").groupBy("bucket", "i", "j").applyInPandas(compare, "rep long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """u and the smallest vertex c of its component, for edges (u, v). Each round is stored, so plans do not grow."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = cut_lineage(both, "near-edges")
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("c")).select("u", F.least("u", "c").alias("c")), "near-labels")
    while True:
        reached = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("near"))
        new = cut_lineage(labels.join(reached, "u").select("u", F.least("c", "near").alias("c"), F.col("c").alias("old")), "near-labels")
        jump = new.select(F.col("u").alias("c"), F.col("c").alias("far"))
        new = new.join(jump, "c", "left").select("u", F.least("c", F.coalesce("far", "c")).alias("c"), "old")
        new = cut_lineage(new, "near-labels")
        if new.filter("c <> old").limit(1).count() == 0:
            return new.select("u", "c")
        labels = new.select("u", "c")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy_of, class_id and n_links of every document; see above."""
    bands, rows = bands_for(threshold, recall)
    plain = id_text(docs, id_col, text_col)
    signed = cut_lineage(signatures(plain, bands, rows), "near-signatures")
    named = signed.filter("doc_id is not null")
    sets_of = named.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    # Ids may repeat with different texts, so each set has a number of its own.
    reps = cut_lineage(sets_of.withColumn("rep", F.monotonically_increasing_id()), "near-sets")

    places = reps.select("rep", "n", F.explode("keys").alias("bucket"))
    crowded = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = cut_lineage(places.join(crowded, "bucket"), "near-members")
    large_keys = members.filter(F.col("m") > SMALL).groupBy("rep").agg(F.sort_array(F.collect_list("bucket")).alias("large"))  # one per band at most
    members = cut_lineage(members.join(large_keys, "rep", "left"), "near-members")

    small = members.filter(F.col("m") <= SMALL)
    a = small.select("bucket", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("large").alias("large_a"))
    b = small.select("bucket", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("large").alias("large_b"))
    pairs = a.join(b, "bucket").filter(
        (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6)
        & ~F.coalesce(F.arrays_overlap("large_a", "large_b"), F.lit(False)))
    pairs = cut_lineage(pairs.select("a", "b", "n_a", "n_b").distinct(), "near-pairs")

    in_large = members.filter(F.col("m") > SMALL)
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(in_large.select("rep")).distinct()
    wanted = cut_lineage(reps.join(wanted, "rep").select("rep", "set_key", "first_id"), "near-wanted")
    read = only_ids(plain, wanted.select("first_id").distinct(), "first_id")
    sets = cut_lineage(shingle_sets(read).join(wanted.select("rep", "set_key"), "set_key").drop("set_key").dropDuplicates(["rep"]), "near-shingles")
    common = F.size(F.array_intersect("s_a", "s_b"))
    verified = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a")), "a")
                .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b")), "b")
                .filter(common / (F.col("n_a") + F.col("n_b") - common) >= threshold).select("a", "b"))
    verified = cut_lineage(verified, "near-links")
    blocked = cut_lineage(large_bucket_links(in_large, sets, threshold), "near-large")

    links = (verified.select(F.col("a").alias("rep"), F.lit(1).cast("long").alias("links"))
             .union(verified.select("b", F.lit(1).cast("long"))).union(blocked.select("rep", "links"))
             .groupBy("rep").agg(F.sum("links").alias("n_links")))
    classes = components(verified.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        blocked.select(F.col("rep").alias("u"), F.col("root").alias("v"))))
    linked = cut_lineage(reps.select("rep", "first_id").join(classes.withColumnRenamed("u", "rep"), "rep"), "near-classes")
    smallest = linked.groupBy("c").agg(F.min("first_id").alias("class_id"))
    linked = linked.join(smallest, "c").select("rep", "class_id")
    groups = reps.select("set_key", "rep", "first_id", "size").join(linked, "rep", "left").join(links, "rep", "left")
    groups = cut_lineage(groups.select(F.col("set_key"), F.col("first_id").alias("copy_of"), "size", F.coalesce("class_id", "first_id").alias("class_id"),
                                       F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "near-groups")
    joined = join_groups(named.filter("set_key is not null").select("doc_id", "set_key"), groups, "set_key", "size")
    alone = signed.filter("doc_id is null or set_key is null")
    return joined.select("doc_id", "copy_of", "class_id", "n_links").unionByName(
        alone.select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
