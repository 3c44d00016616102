"""Ranked lexical search (11): dual-tree search with coordinate maxima.

A document is a vector of term contributions, an item a vector of term weights, and a score is their product. One pass over the
texts keeps, for each document, its length and its counts of terms that any item has; counts over all documents come from it by
sums inside tasks. The search then reads these rows. Items form a tree, and so do the documents of a block; a node holds for each term the maximum
below it. The product of two nodes is at least the score of any pair below them, so a pair of nodes whose product is
less than the weakest kth score of its items is left out as a whole, and nothing that belongs to a result ever is. The kth scores start
from a sample of documents (any subset gives a lower bound) and grow inside each task. A task gives at most k rows an item,
and one window puts them together.

All values are 64-bit integers; only the weight of a term is computed in doubles. Texts of any length are read in stretches,
documents are searched in blocks of bounded size. Items come to the tasks in blocks of bounded total length, and each block's result is
stored before the next one begins.

Defined results: null and empty texts have no terms and are in no result, an item without terms has no rows; every row of ``items`` is an item of its
own, also under a repeated or null id; rows of ``docs`` under one id are ranked each; equal scores go by ascending id, null last; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotlog.llm.common import id_text, slices
from slotlog.session import cut_lineage

#: Letters of items in one block, and terms in one item of it at most that are kept as numbers by every task.
BLOCK_CHARS = 4_000_000
#: Documents that give the first kth scores.
SEED_DOCS = 20_000
#: Documents and numbers in one tree.
TREE_DOCS, TREE_NUMBERS = 1024, 1_000_000
DOC_LEAF, ITEM_LEAF, BRANCH = 16, 4, 4
#: Bytes of a text that are split at once.
STRETCH = 4 << 20

# Letters, digits and all bytes of other than ASCII characters are kept, A-Z in lower case; the rest separates.
TERM_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))

FEATURES = "doc_id long, n long, terms array<int>, counts array<int>"


def stretches(data: bytes) -> Iterator[bytes]:
    """``data`` in parts that end at a separator."""
    at = 0
    while len(data) - at > STRETCH:
        end = data.find(b" ", at + STRETCH)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms and their counts."""
    counts: Counter = Counter()
    n = 0
    for part in stretches(text.translate(TERM_BYTES)):
        terms = part.split()
        n += len(terms)
        counts.update(terms)
    return n, counts


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def contributions(counts: np.ndarray, row: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What one unit of a term's weight adds, for each count; ``row`` is the place of its document in ``lengths``."""
    size = np.array([100 - 75 + 75 * n * documents // total for n in lengths.tolist()], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * size[row])


class Block:
    """Items as term numbers and how often each occurs, in the order of their rows."""

    def __init__(self, rows: Sequence[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        found = [term_counts(text.encode())[1] for _, text in rows]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        self.counts = [{self.vocabulary[t]: c for t, c in f.items()} for f in found]


def blocks(items: DataFrame, most: int = BLOCK_CHARS) -> Iterator[Block]:
    """Items in blocks of about ``most`` letters; the driver holds one at a time."""
    rows, size = [], 0
    for r in cut_lineage(id_text(items, "item_id"), "search-items").toLocalIterator():
        rows.append((r.doc_id, r.text))
        size += len(r.text)
        if size >= most:
            yield Block(rows)
            rows, size = [], 0
    if rows:
        yield Block(rows)


def features(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, number of all terms, and the items' terms with their counts, of every text that has a term."""

    def run(batches):
        known = vocabulary.keys()
        for batch in batches:
            for part in slices(batch, 1):
                ids, lengths, ends, terms, counts = [], [], [0], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    n, found = term_counts(text)
                    if not n:
                        continue
                    for t in known & found.keys() if len(found) < len(known) else found.keys() & known:
                        terms.append(vocabulary[t])
                        counts.append(found[t])
                    ids.append(doc_id)
                    lengths.append(n)
                    ends.append(len(terms))
                at = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    return id_text(docs).mapInArrow(run, FEATURES)


def statistics(rows: DataFrame, terms: int) -> tuple[int, int, list[int]]:
    """Documents, their terms, and the documents that hold each of the numbered terms; sums inside tasks come first."""

    def run(batches):
        held, documents, total = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            held += np.bincount(b.column(1).flatten().to_numpy(zero_copy_only=False), minlength=terms)
            documents += b.num_rows
            total += int(b.column(0).to_numpy().sum())
        if documents:
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[documents, total], held[at]]))],
                                             names=["term", "value"])

    sums = rows.select("n", "terms").mapInArrow(run, "term long, value long").groupBy("term").agg(F.sum("value").alias("value"))
    found = {r.term: r.value for r in sums.collect()}
    return found.get(-2, 0), found.get(-1, 0), [found.get(i, 0) for i in range(terms)]


def ranges(n: int, leaf: int) -> list[list[tuple[int, int]]]:
    """Levels of a tree over n members in order, leaves first; a node is a range of members."""
    level = [(a, min(a + leaf, n)) for a in range(0, n, leaf)]
    out = [level]
    while len(level) > 1:
        level = [(level[a][0], level[min(a + BRANCH, len(level)) - 1][1]) for a in range(0, len(level), BRANCH)]
        out.append(level)
    return out


class Vectors:
    """Sparse rows one after the other: numbers of terms, values, and where each row ends."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int):
        self.term, self.value = term, value
        self.ends = np.searchsorted(row, np.arange(rows + 1))
        self.rows = row

    def maxima(self, group: np.ndarray, groups: int, terms: int) -> Vectors:
        """The largest value of each term in the rows of a group."""
        key = group[self.rows] * terms + self.term
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return Vectors(key[first] // terms, key[first] % terms, np.maximum.reduceat(self.value[order], first) if len(first) else self.value[:0], groups)

    def span(self, i: int) -> slice:
        return slice(self.ends[i], self.ends[i + 1])

    def dot(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Products of some rows with a vector that has all terms."""
        starts, sizes = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)
        sums = np.concatenate([[0], np.cumsum(self.value[at] * dense[self.term[at]])])
        return sums[stops] - sums[stops - sizes]


class Tree:
    """Maxima of the members of each node, level by level; members are in an order that has like beside like."""

    def __init__(self, members: Vectors, n: int, leaf: int, terms: int):
        self.members, self.levels = members, ranges(n, leaf)
        self.nodes = []
        below, size = members, leaf
        for level in self.levels:
            group = np.arange(len(below.ends) - 1) // size
            below = below.maxima(group, len(level), terms)
            self.nodes.append(below)
            size = BRANCH


def bisected(rows: list[dict[int, int]], leaf: int) -> list[int]:
    """An order of sparse rows: halves are split by the term that parts them best, so that a node's rows share terms."""
    out, todo = [], [list(range(len(rows)))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.extend(part)
            continue
        holding = Counter()
        for i in part:
            holding.update(rows[i].keys())
        half = len(part) / 2
        term = min(holding, key=lambda t: (abs(holding[t] - half), t), default=None)
        part.sort(key=lambda i: -rows[i].get(term, 0))
        middle = -(-len(part) // 2)
        todo += [part[middle:], part[:middle]]
    return out


class Searcher:
    """The best documents of each item among all blocks that were searched."""

    def __init__(self, items: list[dict[int, int]], terms: int, k: int, least: list[int]):
        """``items``: weight by term; ``least``: scores below are not wanted."""
        self.k, self.terms = k, terms
        self.order = np.array(bisected(items, ITEM_LEAF), np.int64)
        placed = [sorted(items[i].items()) for i in self.order]
        row = np.repeat(np.arange(len(placed)), [len(p) for p in placed])
        flat = np.array([x for p in placed for x in p], np.int64).reshape(-1, 2)
        self.tree = Tree(Vectors(row, flat[:, 0], flat[:, 1], len(placed)), len(placed), ITEM_LEAF, terms)
        self.first = [np.array([a for a, _ in level]) for level in self.tree.levels]
        self.weakest = np.array([least[i] for i in self.order], np.int64)
        self.dense = np.zeros(terms, np.int64)
        self.best: list[tuple[np.ndarray, ...]] = []
        self.pairs = self.scored = 0

    def block(self, ids: np.ndarray, null: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, importance: np.ndarray) -> None:
        """Search documents given as sparse rows in order of ``row``."""
        n = len(ids)
        # Documents with the same weightiest term lie beside each other.
        heavy = np.lexsort((-(value * importance[term]), row))
        firsts = np.searchsorted(row, np.arange(n))
        key = np.full(n, self.terms, np.int64)
        has = firsts < np.append(firsts[1:], len(row))
        key[has] = term[heavy[firsts[has]]]
        order = np.argsort(key, kind="stable")
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        placed = np.argsort(back[row], kind="stable")
        docs = Tree(Vectors(back[row][placed], term[placed], value[placed], n), n, DOC_LEAF, self.terms)
        least = [np.minimum.reduceat(self.weakest, f) for f in self.first]
        top, item_top = len(docs.levels) - 1, len(self.tree.levels) - 1
        found: list[tuple[np.ndarray, ...]] = []
        todo = [(top, 0, item_top, np.arange(len(self.tree.levels[item_top])))]
        while todo:
            level, node, item_level, items = todo.pop()
            items = self.kept(docs.nodes[level], node, self.tree.nodes[item_level], items, least[item_level])
            if len(items) and level == 0:  # the items' own tree goes on to its leaves
                while len(items) and item_level:
                    items, item_level = self.children(item_level, items), item_level - 1
                    items = self.kept(docs.nodes[0], node, self.tree.nodes[item_level], items, least[item_level])
                if len(items):
                    self.score(docs, node, items, order, found)
            elif len(items):
                if item_level:
                    items, item_level = self.children(item_level, items), item_level - 1
                todo += [(level - 1, c, item_level, items) for c in range(node * BRANCH, min((node + 1) * BRANCH, len(docs.levels[level - 1])))]
        if found:
            place, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
            self.best.append((place, score, null[doc], ids[doc]))
            self.shrink()

    def kept(self, vectors: Vectors, node: int, item_nodes: Vectors, items: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The item nodes whose bound against a document node reaches the weakest of their kth scores."""
        span = vectors.span(node)
        self.dense[vectors.term[span]] = vectors.value[span]
        bound = item_nodes.dot(items, self.dense)
        self.dense[vectors.term[span]] = 0
        self.pairs += len(items)
        return items[bound >= least[items]]

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        out = (nodes[:, None] * BRANCH + np.arange(BRANCH)).ravel()
        return out[out < len(self.tree.levels[level - 1])]

    def score(self, docs: Tree, leaf: int, nodes: np.ndarray, order: np.ndarray, found: list) -> None:
        members = (nodes[:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
        members = members[members < len(self.order)]
        for d in range(*docs.levels[0][leaf]):
            span = docs.members.span(d)
            self.dense[docs.members.term[span]] = docs.members.value[span]
            scores = self.tree.members.dot(members, self.dense)
            self.dense[docs.members.term[span]] = 0
            self.scored += len(members)
            good = scores >= self.weakest[members]
            if good.any():
                found.append((members[good], np.full(int(good.sum()), order[d]), scores[good]))

    def shrink(self) -> None:
        """Keep the k best of each item and raise its weakest score."""
        place, score, null, ids = (np.concatenate(x) for x in zip(*self.best, strict=True))
        order = np.lexsort((ids, null, -score, place))
        place, score, null, ids = place[order], score[order], null[order], ids[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        good = nth < self.k
        last = nth == self.k - 1
        self.weakest[place[last]] = np.maximum(self.weakest[place[last]], score[last])
        self.best = [(place[good], score[good], null[good], ids[good])]

    def result(self) -> tuple[np.ndarray, ...]:
        """Number of the item, null flag and id of the document, score."""
        if not self.best:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        place, score, null, ids = self.best[0]
        return self.order[place], null, ids, score


def candidates(rows: DataFrame, items: list[dict[int, int]], documents: int, total: int, terms: int, k: int, least: list[int]) -> DataFrame:
    """item, doc_id and score of what may be among the k best of an item; at most k rows an item from each task."""

    def run(batches):
        searcher = Searcher(items, terms, k, least)
        importance = np.zeros(terms, np.int64)
        for item in items:
            for t, w in item.items():
                importance[t] = max(importance[t], w)
        held: list[tuple] = []

        def flush():
            if held:
                ids, null, n, sizes, term, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                row = np.repeat(np.arange(len(ids)), sizes)
                value = contributions(counts.astype(np.int64), row, n, documents, total)
                searcher.block(ids, null, row, term.astype(np.int64), value, importance)
                held.clear()

        docs = numbers = 0
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, at + max(1, TREE_DOCS - docs))
                to = max(at + 1, min(to, int(np.searchsorted(ends, ends[at] + TREE_NUMBERS - numbers, "right")) - 1))
                b = batch.slice(at, to - at)
                null = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((b.column(0).fill_null(0).to_numpy(), null, b.column(1).to_numpy(), sizes[at:to],
                             b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(3).flatten().to_numpy(zero_copy_only=False)))
                docs, numbers, at = docs + to - at, numbers + int(ends[to] - ends[at]), to
                if docs >= TREE_DOCS or numbers >= TREE_NUMBERS:
                    flush()
                    docs = numbers = 0
        flush()
        item, null, ids, score = searcher.result()
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    out = None
    for number, block in enumerate(blocks(items, block_chars)):
        terms = len(block.vocabulary)
        rows = cut_lineage(features(docs, block.vocabulary), "search-features")
        documents, total, holding = statistics(rows, max(terms, 1))
        weights = [weight(documents, h) for h in holding]
        vectors = [{t: c * weights[t] for t, c in item.items() if weights[t]} for item in block.counts]
        least = [1] * len(vectors)
        if documents > SEED_DOCS:
            space = 1 << 30
            some = rows.filter(F.pmod(F.xxhash64(F.lit("seed"), "doc_id"), F.lit(space)) < int(space * SEED_DOCS / documents))
            place = Window.partitionBy("item").orderBy(F.desc("score"))
            kth = candidates(some, vectors, documents, total, max(terms, 1), k, least).withColumn("nth", F.row_number().over(place))
            for r in kth.filter(F.col("nth") == k).collect():
                least[r.item] = r.score
        found = candidates(rows, vectors, documents, total, max(terms, 1), k, least)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        names = spark.createDataFrame([(i, d) for i, d in enumerate(block.ids)], "item long, item_id long")
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(names, "item")
        best = cut_lineage(best.select("item_id", "rank", "doc_id", "score"), f"search-block-{number}")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
  with terms as (select r, doc_id, unnest({_TERMS}) as term from (select *, row_number() over () as r from documents) d),
  tf as (select r, doc_id, term, count(*) as tf from terms group by all),
  lengths as (select r, sum(tf) as n from tf group by r),
  total as (select count(*) as docs, sum(n) as terms from lengths),
  df as (select term, count(*) as df from tf group by term),
  wanted as (select r, item_id, term, count(*) as times from (select r, item_id, unnest({_TERMS}) as term
             from (select *, row_number() over () as r from benchmark) b) x group by all),
  scores as (select w.r, w.item_id, tf.doc_id, tf.r as doc, cast(sum(w.times * cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1))) as bigint)
               * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total.terms)))) as bigint) as score
             from wanted w join tf using (term) join df using (term) join lengths l on l.r = tf.r cross join total group by all)
  select item_id, cast(row_number() over (partition by r order by score desc, doc_id) as integer) as rank, doc_id, score
  from scores where score > 0 qualify rank <= 10"""
