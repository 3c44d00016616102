"""Token counts (6): heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a linked list. A heap holds its adjacent pairs by merge rank;
the lowest one is popped again and again, and each merge takes one symbol away. The count is the
number of initial symbols minus the number of merges, and no identifier is ever made. The work is
O(n log n) in the length of a pre-token, so one very long run of letters does no harm.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each;
special strings inside a text count as one token; other columns are ignored.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from slotlog.llm.bpe import Parts, Vocabulary
from slotlog.llm.common import id_text, per_document, worker_tables

PLACE = (1 << 40) - 1

def merged_length(data: bytes, vocab: Vocabulary) -> int:
    """Number of symbols that are left when no adjacent pair of ``data`` can be merged any more."""
    count = len(data)
    if count < 2:
        return count
    rank_of, merged = vocab.merges.get, vocab.merged
    symbol = [vocab.byte_ids[b] for b in data]
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    end = count
    heap = []  # rank and place in one number, so that ties of rank are taken from the left
    for at in range(count - 1):
        rank = rank_of(symbol[at] << 20 | symbol[at + 1])
        if rank is not None:
            heap.append(rank << 40 | at)
    heapify(heap)
    while heap:
        top = heappop(heap)
        rank, at = top >> 40, top & PLACE
        right = after[at]
        if symbol[at] < 0 or right == end or rank_of(symbol[at] << 20 | symbol[right]) != rank:
            continue  # the pair at this place has changed since it was pushed
        symbol[at], symbol[right] = merged[rank], -1
        count -= 1
        right = after[at] = after[right]
        if right != end:
            before[right] = at
            rank = rank_of(symbol[at] << 20 | symbol[right])
            if rank is not None:
                heappush(heap, rank << 40 | at)
        left = before[at]
        if left >= 0:
            rank = rank_of(symbol[left] << 20 | symbol[at])
            if rank is not None:
                heappush(heap, rank << 40 | left)
    return count


class Counter:
    """Number of tokens of whole texts."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.parts = Parts(lambda word: merged_length(word.encode(), self.vocab), sum)

    def count(self, text: str) -> int:
        return sum(1 if special is not None else self.parts.of(section) for section, special in self.vocab.sections(text))


def counter(path: str) -> Counter:
    """The counter of this worker process for a vocabulary file."""
    return worker_tables("counter", path, lambda: Counter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text; one narrow pass without a shuffle."""

    def make():
        c = counter(path)

        def work(texts: list[str]):
            counts = [c.count(t) for t in texts]
            return [len(t.encode()) for t in texts], counts, [n > limit for n in counts]

        return work

    return per_document(id_text(docs, id_col, text_col), "n_bytes long, n_tokens long, over_limit boolean", make)
