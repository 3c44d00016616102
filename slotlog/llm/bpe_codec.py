"""BPE encoding and decoding (7): forced-boundary splitting.

A token that spans two neighbouring bytes contains them as a neighbouring pair. A pair of bytes
that occurs inside no vocabulary token can therefore never be spanned: it is a certain cut. Pre-tokens
are cut at all such pairs, each fragment is encoded on its own and the results are put together,
which gives the very ids of merging the whole pre-token. Fragments are short and recur, so they
are kept in a bounded table.

Defined results: a null or empty text has no ids and decodes to the empty text; special strings
inside a text become their single id; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame

from slotlog.llm.bpe import Parts, Table, Vocabulary
from slotlog.llm.common import id_text, per_document, worker_tables


def inner_pairs(vocab: Vocabulary) -> set[tuple[int, int]]:
    """Every pair of neighbouring bytes inside any ordinary token."""
    return {pair for token in vocab.ids for pair in zip(token, token[1:], strict=False)}


def fragments(data: bytes, inner: set[tuple[int, int]]) -> list[bytes]:
    """``data`` cut between every two bytes that no token holds side by side."""
    if inner.issuperset(zip(data, data[1:], strict=False)):
        return [data]
    cuts = [i for i in range(1, len(data)) if (data[i - 1], data[i]) not in inner]
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]


#: From so many bytes on a fragment is merged through buckets of places instead of a list of ranks.
LONG = 256
NEVER = 1 << 40


def encode_fragment(data: bytes, vocab: Vocabulary) -> list[int]:
    """Merge the leftmost neighbouring pair of the lowest rank until no pair can be merged.

    For short fragments: the cost grows with the square of the length.
    """
    rank_of, merged = vocab.merges.get, vocab.merged
    symbols = [vocab.byte_ids[b] for b in data]
    ranks = [rank_of(a << 20 | b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
    while ranks:
        rank = min(ranks)
        if rank == NEVER:
            break
        at = ranks.index(rank)
        symbols[at:at + 2] = [merged[rank]]
        del ranks[at]
        if at:
            ranks[at - 1] = rank_of(symbols[at - 1] << 20 | symbols[at], NEVER)
        if at < len(ranks):
            ranks[at] = rank_of(symbols[at] << 20 | symbols[at + 1], NEVER)
    return symbols


def encode_long(data: bytes, vocab: Vocabulary) -> list[int]:
    """The ids of encode_fragment for fragments of any length: the places of each rank stand in a bucket of their own.

    A merge changes the two pairs beside it only; each of its places is visited once, from the left.
    """
    n = len(data)
    rank_of, merged = vocab.merges.get, vocab.merged
    symbol = [vocab.byte_ids[b] for b in data]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[int, list[int]] = {}
    for at in range(n - 1):
        rank = rank_of(symbol[at] << 20 | symbol[at + 1])
        if rank is not None:
            places.setdefault(rank, []).append(at)
    order = list(places)
    heapify(order)
    while order:
        rank = heappop(order)
        for at in sorted(places.pop(rank)):
            other = right[at]
            if symbol[at] < 0 or other >= n or rank_of(symbol[at] << 20 | symbol[other]) != rank:
                continue
            symbol[at], symbol[other] = merged[rank], -1
            right[at] = right[other]
            if right[at] < n:
                left[right[at]] = at
            for where in (at, left[at]):
                if where >= 0 and right[where] < n:
                    found = rank_of(symbol[where] << 20 | symbol[right[where]])
                    if found is not None:
                        if found not in places:
                            places[found] = []
                            heappush(order, found)
                        places[found].append(where)
    return [s for s in symbol if s >= 0]


class Codec:
    """Ids of whole texts and texts of whole id lists."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.inner = inner_pairs(self.vocab)
        self.fragments = Table(self._fragment)
        self.parts = Parts(self._word, lambda values: tuple(chain.from_iterable(values)))
        self.digits = [str(i) for i in range(len(self.vocab.tokens))]

    def _fragment(self, data: bytes) -> list[int]:
        return (encode_fragment if len(data) < LONG else encode_long)(data, self.vocab)

    def _word(self, word: str) -> tuple[int, ...]:
        cut = fragments(word.encode(), self.inner)
        if len(cut) == 1:
            return tuple(self._fragment(cut[0]))
        return tuple(chain.from_iterable(map(self.fragments.__getitem__, cut)))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for section, special in self.vocab.sections(text):
            out.extend(self.parts.of(section) if special is None else [special])
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.tokens.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The codec of this worker process for a vocabulary file."""
    return worker_tables("codec", path, lambda: Codec(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    return per_document(id_text(docs, id_col, text_col), "ids array<int>", lambda: lambda texts: _ids(texts, path))


def _ids(texts: list[str], path: str):
    import pyarrow as pa

    return (pa.array([codec(path).encode(t) for t in texts], pa.list_(pa.int32())),)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of every id list; null counts as no ids. Bytes that are no UTF-8 become U+FFFD."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = [codec(path).decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, in one pass without a shuffle."""

    def make():
        c = codec(path)

        def work(texts: list[str]):
            counts, ids_sums, text_sums = [], [], []
            for t in texts:
                ids = c.encode(t)
                counts.append(len(ids))
                ids_sums.append(sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                text_sums.append(sha256(c.decode(ids).encode()).hexdigest())
            return counts, ids_sums, text_sums

        return work

    return per_document(id_text(docs, id_col, text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
