"""Ordered per-key columns that stay exact and parallel when one key is huge.

A plain ``Window.partitionBy(key).orderBy(time)`` puts a whole key into one
task. For the few keys that hold a large share of the table, ``split_hot_keys``
adds a chunk number that follows the order; the columns are then computed per
(key, chunk), and one small row per chunk carries the state over to the next.
Cold keys have no chunk number and take exactly the plain window.

Hot keys come from a frequent-items sketch, one mergeable aggregate without a shuffle of the keys. Each hot key has borders of its own,
every so many rows of a sample of its rows in order: a small sorted table that travels to the rows, which look up their
chunk by binary search. A border is the whole order (time, then the columns that break ties), so rows with one identical
time are cut too if the columns after it tell them apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlog.functions.hashes import HASH_BITS, row_hash
from slotlog.session import cut_lineage

HOT_MIN_ROWS = 2_000_000   # a group of this size is an ordinary task
CHUNK_ROWS = 1_000_000
#: Sampled rows between two borders; a chunk then differs by about a fifth from the rows it should have.
SAMPLES = 32
#: Counters of the sketch, for each key that can be hot; its estimates are off by a quarter of a hot key at most.
COUNTERS_EACH = 16
#: Most counters that the sketch can have. Beyond 1.25e11 rows a key counts as hot from a proportionally larger number of rows on.
MOST_COUNTERS = 1_000_000
#: A border table of more keys is left to a shuffled join.
BROADCAST_KEYS = 100_000


def chunk_column(keys: Sequence[str]) -> str:
    return "chunk__" + "__".join(keys)


def find_chunk(df: DataFrame, keys: Sequence[str]) -> str | None:
    """Chunk column usable for ``keys``: one made for them, or for fewer keys under the same order."""
    for c in df.columns:
        if c.startswith("chunk__") and set(c.split("__")[1:]) <= set(keys):
            return c
    return None


def _kind(df: DataFrame, name: str) -> str:
    """What a column is compared as: times as microseconds, text as it is, all else as a double."""
    kind = dict(df.dtypes)[name]
    return "bigint" if kind.startswith("timestamp") or kind == "date" else "string" if kind == "string" else "double"


def _comparable(c: Column, kind: str) -> Column:
    return F.unix_micros(c.cast("timestamp")) if kind == "bigint" else c.cast(kind)


def _position(df: DataFrame, by: Sequence[str], kinds: Sequence[str]) -> Column:
    """A row's place in the order as one value; nulls last, as in the windows. Columns that the table lacks come first of all."""
    parts = []
    for i, kind in enumerate(kinds):
        here = F.col(by[i]) if i < len(by) and by[i] in df.columns else None
        parts += [(here.isNull() if here is not None else F.lit(False)).alias(f"n{i}"),
                  (_comparable(here, kind) if here is not None else F.lit(None).cast(kind)).alias(f"v{i}")]
    return F.struct(*parts)


def _key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("\u001f", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])


def candidate_keys(df: DataFrame, keys: Sequence[str], rows: int, min_rows: int = HOT_MIN_ROWS) -> list[str]:
    """Texts of all keys with more than ``min_rows`` of the ``rows``, and perhaps some with a little less; one pass without a shuffle of keys."""
    most = math.ceil(rows / min_rows)
    tracked = min(MOST_COUNTERS, max(1024, COUNTERS_EACH * most))
    sketch = F.expr(f"approx_top_k(k, {min(2 * most, tracked)}, {tracked})")
    found = df.select(_key_text(keys).alias("k")).agg(sketch.alias("top")).collect()[0]["top"]
    return sorted(r["item"] for r in found if r["count"] > min_rows)


@dataclass(frozen=True)
class HotChunks:
    """Which keys are hot and where their order is cut; ``add`` numbers the chunks of any table with these keys.

    ``table`` has a row per hot key: its text ``hot`` and its sorted ``borders``.
    """

    keys: tuple[str, ...]
    kinds: tuple[str, ...]
    table: DataFrame
    hot: int
    most: int

    def add(self, df: DataFrame, by: str | Sequence[str]) -> DataFrame:
        """``df`` with the chunk column. ``by`` names its columns that the borders are made of; those it lacks sort first."""
        by = [by] if isinstance(by, str) else list(by)
        table = F.broadcast(self.table) if self.hot <= BROADCAST_KEYS else self.table
        out = df.withColumn("chunk_at", _position(df, by, self.kinds)).join(table, _key_text(self.keys) == F.col("hot"), "left")
        borders, at = F.col("borders"), F.col("chunk_at")
        # Number of borders up to the row's place, by binary search from the largest step down.
        steps = [1 << b for b in range(max(1, self.most).bit_length() - 1, -1, -1)]
        number = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda low, step: F.when(
            (low + step <= F.size(borders)) & (F.get(borders, low + step - 1) <= at), low + step).otherwise(low))
        return out.withColumn(chunk_column(self.keys), F.when(borders.isNotNull(), number)).drop("chunk_at", "hot", "borders")


def find_hot_chunks(df: DataFrame, keys: Sequence[str], by: str | Sequence[str], min_rows: int = HOT_MIN_ROWS,
                    rows_per_chunk: int = CHUNK_ROWS, at_most: int | None = None) -> HotChunks | None:
    """Hot keys of ``df`` with their borders in the order ``by``, or None when no key is large enough to matter.

    A table that is too small to hold one is only counted, or not even that with ``at_most``, a number of rows
    it is known not to exceed. ``df`` should be stored: a large one is read twice more.
    """
    if at_most is not None and at_most <= min_rows:
        return None
    rows = df.count()
    if rows <= min_rows:
        return None
    found = candidate_keys(df, keys, rows, min_rows)
    if not found:
        return None
    by = [by] if isinstance(by, str) else [c for c in by if c in df.columns]
    kinds = tuple(_kind(df, c) for c in by)
    names = df.sparkSession.createDataFrame([(k,) for k in found], "hot string")
    names = F.broadcast(names) if len(found) <= BROADCAST_KEYS else names
    picked = F.rand(7) < F.lit(min(1.0, SAMPLES / rows_per_chunk))
    sample = df.join(names, _key_text(keys) == F.col("hot")).select("hot", F.when(picked, _position(df, by, kinds)).alias("at"))
    ordered_sample = F.array_sort(F.collect_list("at"))
    borders = F.array_distinct(F.filter(F.col("places"), lambda x, i: i % SAMPLES == SAMPLES - 1))
    table = sample.groupBy("hot").agg(F.count(F.lit(1)).alias("n"), ordered_sample.alias("places")).filter(F.col("n") > min_rows)
    table = cut_lineage(table.select("hot", borders.alias("borders")), "hot-borders")
    size = table.agg(F.count(F.lit(1)).alias("hot"), F.max(F.size("borders")).alias("most")).collect()[0]
    return HotChunks(tuple(keys), kinds, table, size["hot"], size["most"]) if size["hot"] else None


def split_hot_keys(df: DataFrame, keys: Sequence[str], by: str | Sequence[str], **limits) -> DataFrame:
    """Add the chunk column for hot keys, or return ``df`` unchanged when there are none."""
    chunks = find_hot_chunks(df, keys, by, **limits)
    return chunks.add(df, by) if chunks else df


@dataclass(frozen=True)
class Ordered:
    """One derived column: how to compute it in a group, carry it over, and combine both."""

    within: Callable[[Window, Window, Window], Column]   # (ordered group, whole group, group in reverse)
    summary: Callable[[Column], Column]                  # order struct -> aggregate per chunk
    carry: Callable[[Column, Window], Column]            # summary over the ordered chunks
    combine: Callable[[Column, Column, Column, Column], Column]  # within, carry, at_first, at_last


_FULL = (Window.unboundedPreceding, Window.unboundedFollowing)


def lag(c: Column) -> Ordered:
    return Ordered(
        lambda w, g, r: F.lag(c).over(w),
        lambda o: F.max_by(c, o),
        lambda s, w: F.lag(s).over(w),
        lambda x, y, first, last: F.when(first, y).otherwise(x),
    )


def lead(c: Column) -> Ordered:
    return Ordered(
        lambda w, g, r: F.lead(c).over(w),
        lambda o: F.min_by(c, o),
        lambda s, w: F.lead(s).over(w),
        lambda x, y, first, last: F.when(last, y).otherwise(x),
    )


def sum_before(c: Column) -> Ordered:
    """Sum over the earlier rows, 0 on the first."""
    zero = F.lit(0).cast("long")
    return Ordered(
        lambda w, g, r: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero),
        lambda o: F.sum(c),
        lambda s, w: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda x, y, first, last: x + F.coalesce(y, zero),
    )


def smaller_before() -> Ordered:
    """Rows that come strictly before in the order; rows with equal order values get the same number."""
    return Ordered(
        lambda w, g, r: (F.rank().over(w) - 1).cast("long"),
        lambda o: F.count(F.lit(1)),
        lambda s, w: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda x, y, first, last: x + F.coalesce(y, F.lit(0).cast("long")),
    )


def rows_before() -> Ordered:
    return sum_before(F.lit(1).cast("long"))


def previous_value(c: Column) -> Ordered:
    """Latest non-null value up to and including the row."""
    return Ordered(
        lambda w, g, r: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda o: F.max_by(c, F.when(c.isNotNull(), o)),
        lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda x, y, first, last: F.coalesce(x, y),
    )


def first_value_so_far(c: Column) -> Ordered:
    """Earliest non-null value up to and including the row."""
    return Ordered(
        lambda w, g, r: F.first(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda o: F.min_by(c, F.when(c.isNotNull(), o)),
        lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda x, y, first, last: F.coalesce(y, x),
    )


def min_so_far(c: Column) -> Ordered:
    return Ordered(
        lambda w, g, r: F.min(c).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda o: F.min(c),
        lambda s, w: F.min(s).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda x, y, first, last: F.least(x, y),
    )


def next_value(c: Column) -> Ordered:
    """Earliest non-null value from the row on (back fill).

    Read against the order: a frame that grows is linear, one that shrinks is quadratic.
    """
    return Ordered(
        lambda w, g, r: F.last(c, ignorenulls=True).over(r.rowsBetween(Window.unboundedPreceding, 0)),
        lambda o: F.min_by(c, F.when(c.isNotNull(), o)),
        lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        lambda x, y, first, last: F.coalesce(x, y),
    )


def key_min(c: Column) -> Ordered:
    return Ordered(
        lambda w, g, r: F.min(c).over(g),
        lambda o: F.min(c),
        lambda s, w: F.min(s).over(w.rowsBetween(*_FULL)),
        lambda x, y, first, last: F.least(x, y),
    )


def key_max(c: Column) -> Ordered:
    return Ordered(
        lambda w, g, r: F.max(c).over(g),
        lambda o: F.max(c),
        lambda s, w: F.max(s).over(w.rowsBetween(*_FULL)),
        lambda x, y, first, last: F.greatest(x, y),
    )


def key_sum(c: Column) -> Ordered:
    return Ordered(
        lambda w, g, r: F.sum(c).over(g),
        lambda o: F.sum(c),
        lambda s, w: F.sum(s).over(w.rowsBetween(*_FULL)),
        lambda x, y, first, last: F.coalesce(y, x),
    )


def key_count(c: Column | None = None) -> Ordered:
    counted = F.lit(1) if c is None else c
    return Ordered(
        lambda w, g, r: F.count(counted).over(g),
        lambda o: F.count(counted),
        lambda s, w: F.sum(s).over(w.rowsBetween(*_FULL)),
        lambda x, y, first, last: F.coalesce(y, x),
    )


def key_first(c: Column) -> Ordered:
    """Earliest non-null value of the whole key."""
    return Ordered(
        lambda w, g, r: F.first(c, ignorenulls=True).over(w.rowsBetween(*_FULL)),
        lambda o: F.min_by(c, F.when(c.isNotNull(), o)),
        lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(*_FULL)),
        lambda x, y, first, last: F.coalesce(y, x),
    )


def key_last(c: Column) -> Ordered:
    """Latest non-null value of the whole key."""
    return Ordered(
        lambda w, g, r: F.last(c, ignorenulls=True).over(w.rowsBetween(*_FULL)),
        lambda o: F.max_by(c, F.when(c.isNotNull(), o)),
        lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(*_FULL)),
        lambda x, y, first, last: F.coalesce(y, x),
    )


def with_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Ordered]) -> DataFrame:
    """Add ``columns`` computed per ``keys`` in ``order`` (nulls last); one exchange for all of them."""
    keys = list(keys)
    chunk = find_chunk(df, keys)
    group = keys + [chunk] if chunk else keys
    w = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    g = Window.partitionBy(*group)
    r = Window.partitionBy(*group).orderBy(*[F.col(c).desc_nulls_first() for c in order])
    if not chunk:
        return df.withColumns({n: s.within(w, g, r) for n, s in columns.items()})

    inner = {"w__" + n: s.within(w, g, r) for n, s in columns.items()}
    inner["w__first"] = F.row_number().over(w) == 1
    inner["w__last"] = F.lead(F.lit(1)).over(w).isNull()
    detail = df.withColumns(inner)
    # Nulls order last, as in the windows: a null flag leads each order column.
    position = F.struct(*[x for c in order for x in (F.col(c).isNull().alias("n_" + c), F.col(c).alias(c))])
    cw = Window.partitionBy(*keys).orderBy(chunk)
    carried = (
        df.filter(F.col(chunk).isNotNull())
        .groupBy(*group)
        .agg(*[s.summary(position).alias("s__" + n) for n, s in columns.items()])
        .select(*[F.col(c).alias("k__" + c) for c in group],
                *[s.carry(F.col("s__" + n), cw).alias("c__" + n) for n, s in columns.items()])
    )
    on = F.col(chunk) == F.col("k__" + chunk)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col("k__" + c))
    joined = detail.join(carried, on, "left")
    first, last = F.col("w__first"), F.col("w__last")
    is_hot = F.col(chunk).isNotNull()
    made = {
        n: F.when(is_hot, s.combine(F.col("w__" + n), F.col("c__" + n), first, last)).otherwise(F.col("w__" + n))
        for n, s in columns.items()
    }
    keep = [c for c in df.columns if c not in made]
    return joined.select(*keep, *[c.alias(n) for n, c in made.items()])


def with_random_rank(df: DataFrame, keys: Sequence[str], identity: Sequence[str], seed: int, name: str = "random_rank",
                     rows: int | None = None, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """Add each row's 0-based place in a seeded random order of its key group.

    The order is that of a hash of ``keys`` and ``identity`` (whole numbers, text or dates, which read alike in every
    engine), so every group has its own order and none depends on how the table is partitioned. The top bits of the hash number the chunks: they are
    uniform, so large groups split evenly without looking at the data.
    """
    rows = df.count() if rows is None else rows
    bits = max(0, math.ceil(math.log2(max(rows, 1) / rows_per_chunk)))
    out = df.withColumn("order_hash", row_hash(seed, [*keys, *identity]))
    chunk = chunk_column(keys)
    if bits:
        out = out.withColumn(chunk, F.shiftright("order_hash", HASH_BITS - bits).cast("int"))
    out = with_ordered(out, keys, ["order_hash", *identity], {name: rows_before()})
    return out.drop("order_hash", chunk) if bits else out.drop("order_hash")
