"""Benchmark decontamination (3): q-gram lemma filtering and banded alignment.

An item of the benchmark is cut into overlapping segments of two lengths (``GRIDS``); an item of no more characters than one length is one segment
of it. A document is contaminated if some segment occurs in it with at most ``rate`` edits per character. As the short segments start
every ten characters, a stretch of 69 characters out of any place of an item that is quoted within four edits holds one. By the q-gram lemma such
an occurrence shares at least m - q + 1 - q e of the segment's q-grams, and all of them lie on at most e + 1 neighbouring
diagonals (place in the text minus place in the segment). So shared q-grams are counted in diagonal bands of twice that
width which overlap by half, only bands that meet the bound are kept, and the regions they point to are
verified by an alignment restricted to the band. Nothing that meets the edit budget is lost.

Characters are compared after lower-casing, with every run of other characters than letters and digits as one blank.

Documents are read once for each block of the benchmark, and a block has a bounded number of characters, so
nothing that is sent to the executors grows with either table. There is no shuffle of texts. A long text is searched in stretches that
overlap by more than a segment, and where a text repeats a phrase of an item, its q-grams are looked up in windows of bounded work. Equal
segments of a benchmark are one segment with several owners.

Defined results: a null or empty text matches nothing, nor does an item that has fewer than ``SHORTEST`` characters left
(no q-gram; such an item is found in too many texts to tell a leak); equal
items match each; repeated rows give repeated matches; an empty table on either side gives no matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlog.llm.common import id_text, slices, worker_tables
from slotlog.session import cut_lineage

Q = 10
#: Length and step of the segments. A quote that holds no whole segment is not found; memory and time grow with the sum of length / step.
GRIDS = ((100, 50), (60, 10))
SHORTEST = Q
#: Characters of a text that are searched at once, and shared q-grams that are counted at once, about.
STRETCH = 1 << 20
POSTINGS = 400_000
#: Characters of the benchmark that are held against the documents in one pass, about; each is in some eight segments.
BLOCK_CHARS = 250_000
#: Alignments that are done at once.
TOGETHER = 256

U = np.uint64
BITS = 22
MATCHES = "doc_id long, item_id long, edits int, segment_start int, text_start int, text_end int"

_classes: list[np.ndarray] = []


def plain(text: str) -> np.ndarray:
    """Code points in lower case, each run of anything but letters and digits as one blank, none at the ends."""
    if not _classes:
        _classes.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    parts, inside = [], False
    for at in range(0, len(text), STRETCH):
        a = np.frombuffer(text[at:at + STRETCH].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        shown = _classes[0][a]
        kept = shown.copy()
        kept[1:] |= shown[:-1]  # one other character after each run of shown ones
        kept[0] |= inside
        inside = bool(shown[-1])
        parts.append(np.where(shown, a, np.uint32(32))[kept])
    out = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return out[:-1] if len(out) and out[-1] == 32 else out


def qgrams(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each q-gram (q = 10), by doubling: eight characters, then two more."""
    if len(a) < Q:
        return np.empty(0, U)
    h = a.astype(U)
    two = h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]
    h = two[:-2] * U(0xC2B2AE3D27D4EB4F) + two[2:]
    h = h[:-4] * U(0x165667B19E3779F9) + h[4:]
    h = h[:-2] * U(0x27D4EB2F165667C5) + two[8:]
    return h ^ (h >> U(29))


def segments_of(a: np.ndarray, grids: tuple[tuple[int, int], ...] = GRIDS) -> list[tuple[int, np.ndarray]]:
    """(start, code points) of overlapping segments; the last one of each length ends with the item."""
    places = {}
    for size, step in grids:
        last = max(0, len(a) - size)
        places |= dict.fromkeys((s, min(len(a), s + size)) for s in [*range(0, last, step), last])
    return [(s, a[s:e]) for s, e in places]


class Index:
    """The q-grams of a block of items: a bit table for a first look, then postings (segment, place) in order of hash.

    ``segments`` has each different one once, ``owners`` the items that hold it, each with its first place there.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float, grids: tuple[tuple[int, int], ...] = GRIDS):
        found: dict[bytes, tuple[np.ndarray, dict[int, int]]] = {}
        for item, text in items:
            for start, s in segments_of(plain(text or ""), grids):
                if len(s) >= SHORTEST:
                    owners = found.setdefault(s.tobytes(), (s, {}))[1]
                    owners[item] = min(start, owners.get(item, start))
        self.segments = [s for s, _ in found.values()]
        self.owners = [o for _, o in found.values()]
        sizes = np.array([len(s) for s in self.segments], np.int64)
        self.longest = int(sizes.max(initial=0))
        #: In a very short item more edits could leave no q-gram whole.
        self.budget = np.minimum((sizes * rate).astype(np.int64), (sizes - Q) // Q)
        self.needed = np.maximum(1, sizes - Q + 1 - Q * self.budget)
        #: The bound can be met by chance where it is small; the alignment decides in any case.
        grams = [qgrams(s) for s in self.segments]
        if grams:
            codes = np.concatenate(grams)
            owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(codes, kind="stable")
            self.codes, self.owner, self.place = codes[order], owner[order], place[order]
            self.bits = np.zeros(1 << BITS, bool)
            self.bits[(codes >> U(64 - BITS)).astype(np.int64)] = True
            self.window = int((sizes + self.budget).max())
            self.least = int(self.needed.min())
            self.half = int(self.budget.max()) + 1

    def regions(self, a: np.ndarray) -> Iterator[tuple[int, int]]:
        """(segment, first diagonal of the band) of every band whose count meets its segment's bound; some come twice."""
        if not self.segments:
            return
        for at in range(0, len(a), STRETCH):
            for number, diagonal in self._regions(a[at:at + STRETCH + self.window + Q]):
                yield number, diagonal + at

    def _regions(self, a: np.ndarray) -> Iterator[tuple[int, int]]:
        h = qgrams(a)
        if not len(h):
            return
        at = np.flatnonzero(self.bits[(h >> U(64 - BITS)).astype(np.int64)])
        if len(at) < self.least:
            return
        low = np.searchsorted(self.codes, h[at])
        high = np.searchsorted(self.codes, h[at], "right")
        known = high > low
        at, low, high = at[known], low[known], high[known]
        # Fewer known q-grams than the bound within the length of a segment: no band can meet it.
        upto = np.searchsorted(at, at + self.window)
        dense = upto - np.arange(len(at)) >= self.least
        if not dense.any():
            return
        change = np.zeros(len(at) + 1, np.int64)
        np.add.at(change, np.flatnonzero(dense), 1)
        np.add.at(change, upto[dense], -1)
        inside = np.cumsum(change[:-1]) > 0
        at, low, times = at[inside], low[inside], (high - low)[inside]
        before, first = np.concatenate([[0], np.cumsum(times)]), 0
        while first < len(at):
            # Two windows share the length of an occurrence, so each occurrence is in one of them as a whole.
            last = max(np.searchsorted(before, before[first] + POSTINGS), np.searchsorted(at, at[first] + 2 * self.window))
            yield from self._bands(at[first:last], low[first:last], times[first:last])
            if last >= len(at):
                return
            first = int(np.searchsorted(at, at[last] - self.window))

    def _bands(self, at: np.ndarray, low: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int]]:
        """Bands among the places ``at`` of a text, whose postings are ``times`` from ``low`` on."""
        starts = np.cumsum(times) - times
        post = np.repeat(low - starts, times) + np.arange(times.sum())
        where, owner, place = np.repeat(at, times), self.owner[post], self.place[post]
        key = owner * (1 << 40) + (where - place + self.longest) // self.half
        order = np.argsort(key, kind="stable")
        key, where, place = key[order], where[order], place[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        value, ends = key[heads], np.append(heads[1:], len(key))
        needed = self.needed[value >> 40]
        # A band is two neighbouring halves; the last half of a run stands alone, as does the first with none before it.
        paired = np.append(value[1:] == value[:-1] + 1, False)
        stop = np.where(paired, np.append(ends[1:], 0), ends)
        for i in np.flatnonzero(stop - heads >= needed):
            a_, b_ = heads[i], stop[i]
            # A shared q-gram has a place of its own on either side, so repetition on one of them does not count.
            if min(distinct(where[a_:b_]), distinct(place[a_:b_])) >= needed[i]:
                yield int(value[i] >> 40), int(value[i] & ((1 << 40) - 1)) * self.half - self.longest

    def matches(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """For each item that occurs: edits, start of the segment, start and end in the normalised text, of its best segment."""
        a = plain(text)
        data = a.tobytes()
        out: dict[int, tuple[int, int, int, int]] = {}
        rest: dict[int, dict[tuple[int, int], None]] = {}

        def add(number: int, edits: int, first: int, last: int) -> None:
            for item, start in self.owners[number].items():
                row = (edits, start, first, last)
                out[item] = min(out.get(item, row), row)

        for number, diagonal in self.regions(a):
            pattern = self.segments[number]
            # The very segment needs no alignment.
            low = max(0, diagonal)
            at = data.find(pattern.tobytes(), 4 * low, 4 * max(low, diagonal + 2 * self.half + len(pattern)))
            if at >= 0 and at % 4 == 0:
                add(number, 0, at // 4, at // 4 + len(pattern))
            else:
                rest.setdefault(len(pattern), {})[number, diagonal] = None
        for listed in rest.values():
            regions = [(n, d) for n, d in listed if any(item not in out or out[item][0] > 0 for item in self.owners[n])]
            for k in range(0, len(regions), TOGETHER):
                part = regions[k:k + TOGETHER]
                e = int(self.budget[part[0][0]])  # the same for one length
                found = banded(np.stack([self.segments[n] for n, _ in part]), a, np.array([d - e for _, d in part]), 2 * self.half + 2 * e + 1)
                for (n, _), (edits, first, last) in zip(part, found, strict=True):
                    if edits <= e:
                        add(n, edits, first, last)
        return out


def banded(patterns: np.ndarray, text: np.ndarray, lowest: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Fewest edits between each whole pattern (all of one length) and a stretch of the text, over its diagonals lowest .. lowest + width - 1.

    Row i, column k is the cell of i pattern characters and i + lowest + k text characters. A cell's cost and the start of its
    stretch travel together in one number, cost first, so that the smaller number is the better cell.
    """
    m, n = patterns.shape[1], len(text)
    k = np.arange(width, dtype=np.int64)
    one = 1 << 40
    far = (m + n + 1) * one
    end = lowest[:, None] + k
    cell = np.where((end >= 0) & (end <= n), end, far)
    at = lowest[:, None] + np.arange(width + m)  # the text characters before the cells of the first row on
    padded = np.where((at >= 0) & (at < n), text[np.clip(at, 0, n - 1)], np.uint32(0xFFFFFFFF))
    edges = bool((lowest < 0).any() or (lowest + m + width > n).any())
    slope = k * one
    drop = np.full(cell.shape, far, np.int64)
    for i in range(m):
        drop[:, :-1] = cell[:, 1:] + one
        cell = np.minimum(cell + (padded[:, i:i + width] != patterns[:, i:i + 1]) * one, drop) - slope
        # Insertions run along the row: the smallest cost less column number up to here.
        cell = np.minimum.accumulate(cell, axis=1) + slope
        if edges:
            end = lowest[:, None] + (i + 1) + k
            cell[(end < 0) | (end > n)] = far
    at = np.argmin(cell >> 40, axis=1)
    best = cell[np.arange(len(cell)), at]
    return [(int(c >> 40), int(c & (one - 1)), int(x)) for c, x in zip(best, lowest + m + at, strict=True)]


def distinct(values: np.ndarray) -> int:
    return len(set(values.tolist()))


def index_of(items: tuple[tuple[int, str], ...], rate: float, grids: tuple[tuple[int, int], ...]) -> Index:
    """The index of this worker process for a block of items."""
    return worker_tables("benchmark index", (hash(items), rate, grids), lambda: Index(list(items), rate, grids))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", grids: tuple[tuple[int, int], ...] = GRIDS) -> DataFrame:
    """doc_id, item_id, edits and the places of the best match, for each document and each item that occurs in it.

    ``grids`` has (length, step) of the segments: with (30, 5) as a third one, quotes of 34 characters are found too, at about twice the cost.
    """
    plain_docs = id_text(docs, id_col, text_col)
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].alias("text"))
    items = cut_lineage(items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()), "benchmark-items")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        found = _against(plain_docs, tuple((r.item_id, r.text) for r in block), rate, grids)
        out = found if out is None else out.unionByName(found)
    return out


def _against(docs: DataFrame, items: tuple[tuple[int, str], ...], rate: float, grids: tuple[tuple[int, int], ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(items, rate, grids)
        names = [c.split(" ")[0] for c in MATCHES.split(", ")]
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(d, item, *found) for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                        for item, found in sorted(index.matches(text).items())]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(columns)], names=names)

    return docs.mapInArrow(run, MATCHES)
