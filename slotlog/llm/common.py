"""What the operators of this subpackage share: input columns, label split, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id) leaves this remainder by 4 are never learned from.
HELD_OUT = 2


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under fixed names; a null text is the empty text.

    Taking them first keeps extra columns, whatever their names, out of every later step.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """True for the rows a classifier must not learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def per_document(df: DataFrame, schema: str, make: Callable[[], Callable[[list[str]], list]],
                 keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``df`` plus the columns of ``schema`` computed from each text.

    ``make`` is called once per task and gives a function from a list of texts to one list
    per column. Batches stream through, so memory is bounded by one Arrow batch.
    """
    keep = list(keep)
    spark = df.sparkSession
    extra = spark.createDataFrame([], schema).schema
    out = df.select(*keep).schema
    for f in extra.fields:
        out = out.add(f)
    names, n_keep = [f.name for f in out.fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, n_keep):
                work = work or make()
                columns = work(part.column(n_keep).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(n_keep)), *(pa.array(c) for c in columns)], names=names)

    return df.select(*keep, "text").mapInArrow(run, out)


_tables: dict[tuple, Any] = {}


def worker_tables(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """The tables that operator ``name`` keeps in this worker process under ``key``; those of any other operator are dropped.

    Worker processes are used again by the jobs that follow, so without this the tables of all operators of a run would add up.
    """
    if (name, key) not in _tables:
        _tables.clear()
        give_back()
        _tables[name, key] = make()
        give_back()
    return _tables[name, key]


def give_back() -> None:
    """Return unused memory of this worker process to the machine: workers live on after their task, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, so that long texts do not pile up as Python objects."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * most / max(most, batch.column(column).nbytes)))
    for at in range(0, rows, step):
        yield batch.slice(at, min(step, rows - at))
    give_back()


def sampled(rows: DataFrame, max_rows: int) -> DataFrame:
    """All rows if they are ``max_rows`` at most, else about that many, chosen by a hash of ``doc_id``.

    The choice depends on the ids alone, not on order or partitions.
    """
    n = rows.select("doc_id").count()
    if n <= max_rows:
        return rows
    space = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(space)) < int(space * max_rows / n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """doc_id, text and label of about ``max_rows`` labelled rows at most, none of them held out.

    Texts may be of any length; what is to be learned from them is computed in tasks and then fetched by ``fetched``.
    Labels of documents that are not there are left out before the sample is drawn; for that only ids are shuffled.
    The sample is broadcast, a bounded number of ids and numbers. A document with several labels gets the largest, one with several rows its smallest text.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    from slotlog.session import cut_lineage

    there = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label")).join(there, "doc_id", "left_semi")
    marks = sampled(cut_lineage(marks, "labels"), max_rows)
    found = id_text(docs).join(F.broadcast(marks), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fetched(rows: DataFrame, name: str) -> list[tuple]:
    """The rows in order of ``doc_id``, which comes first. They are stored and then read part by part, so the driver's JVM has one part at a time."""
    from slotlog.session import cut_lineage

    return sorted((tuple(r) for r in cut_lineage(rows, name).toLocalIterator()), key=lambda r: r[0])


#: A side of ids or of groups is broadcast only up to so many rows of a few dozen bytes.
BROADCAST_ROWS = 200_000
#: A group with at least this share of all rows is hot; there are at most 1 / share of them.
HOT_SHARE = 1e-3


def only_ids(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose id is in column ``name`` of ``wanted``.

    The ids are counted: up to ``BROADCAST_ROWS`` they are broadcast and no text is shuffled, beyond that both sides are.
    """
    from slotlog.session import cut_lineage

    ids = cut_lineage(wanted.select(F.col(name).alias("doc_id")), "wanted-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``size`` is the number of rows of a group.

    Rows of a hot group would all meet in one task of a shuffle. As there is a bounded number of hot groups,
    those are joined by broadcast, and only the rest is shuffled.
    """
    hot = F.col(size) >= max(1000, int(rows.count() * HOT_SHARE))
    large = groups.filter(hot)
    return rows.join(F.broadcast(large), key).unionByName(
        rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.filter(~hot), key))


def keep_texts(docs: DataFrame, accepted: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts ``accepted`` says yes to; one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(accepted([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (a column of ``gone`` by the expression over ``docs`` that must equal it) are not in ``gone``.

    ``gone`` is stored and counted: up to ``BROADCAST_ROWS`` rows it is broadcast and no text is shuffled, beyond that both sides are.
    """
    from slotlog.session import cut_lineage

    names = {k: f"__gone_{i}" for i, k in enumerate(keys)}
    gone = cut_lineage(gone.select(*(F.col(k).alias(n) for k, n in names.items())).distinct(), "gone")
    on = [expr.eqNullSafe(gone[names[k]]) for k, expr in keys.items()]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, condition, "left_anti")
