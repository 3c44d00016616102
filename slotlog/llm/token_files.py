"""Token-ID / binary output (9): ORC files of token ids.

Documents are range-partitioned and sorted by id, encoded where they lie and written as ORC: integer
columns use ORC's run-length encoding, each stripe has a row index (minimum and maximum for every few
thousand rows) and a Bloom filter on ``doc_id``, so a reader can take stripes in parallel and a look-up of some
ids skips files, stripes and row groups by their metadata. One range is one file and one shard. A
document's place is the number of ids of all shards before its own, plus those before it in the
shard; only the first is joined at reading, from one row per shard.

Defined results: a null or empty text has just the end id; repeated ids lie beside each other, ordered by a hash of the text;
a null id sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotlog.llm.common import id_text, slices, worker_tables

SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"


# A Latin letter and ASCII marks after it are always in two pre-tokens; the apostrophe may begin one that goes on with letters.
MARKED = r"(?s)^(?P<stem>.*[A-Za-zÀ-ÖØ-öø-ɏ])(?P<end>[!-&(-/:-@\[-`{-~]+)$"
# What a blank may stand before without a change to the pre-tokens behind it: no white space at either end.
PLAIN = r"(?s)^[^\s\x00\x0b\x1c-\x1f\x{85}\p{Z}](.*[^\s\x0b\x1c-\x1f\x{85}\p{Z}])?$"
AFTER_FEED = r"(?s)^\n[^\s\x00\x0b\x1c-\x1f\x{85}\p{Z}](.*[^\s\x0b\x1c-\x1f\x{85}\p{Z}])?$"


class Ids:
    """Id lists one after the other: list i is ``flat[start[i]:start[i] + size[i]]``; size -1 marks a part that must not be cut there."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.flat, self.start, self.size = flat, start, size

    @classmethod
    def of(cls, lists: list[list[int]]) -> Ids:
        size = np.array([len(x) for x in lists], np.int64)
        return cls(np.array([i for x in lists for i in x], np.int32), np.cumsum(size) - size, size)

    @classmethod
    def unsafe(cls, n: int) -> Ids:
        return cls(np.zeros(0, np.int32), np.zeros(n, np.int64), np.full(n, -1, np.int64))

    def take(self, at: np.ndarray) -> Ids:
        """Some of the lists; those without a place (-1) are unsafe ones."""
        size = np.where(at >= 0, self.size[at], -1) if len(self.size) else np.full(len(at), -1, np.int64)
        return Ids(self.flat, self.start[at] if len(self.size) else np.zeros(len(at), np.int64), size)

    def packed(self) -> Ids:
        size = np.maximum(self.size, 0)
        stop = np.cumsum(size)
        flat = self.flat[np.repeat(self.start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        return Ids(flat, stop - size, self.size)

    @staticmethod
    def joined(parts: list[Ids]) -> Ids:
        """The lists of all under each other."""
        shift = np.cumsum([0, *(len(p.flat) for p in parts)])
        return Ids(np.concatenate([p.flat for p in parts]), np.concatenate([p.start + s for p, s in zip(parts, shift, strict=False)]),
                   np.concatenate([p.size for p in parts]))


class LibraryEncoder:
    """Ids as the tokenizers library gives them; parts of texts recur, so the library is asked once for each new part.

    Texts are cut only at single blanks and line feeds between other characters, where the library's
    own splitting ends a pre-token in any case. Any other text goes to the library as a whole. Arrow cuts the texts and looks up
    the different parts, numpy puts their ids together; Python sees neither texts nor parts one by one but those the library has to be asked for.
    Parts are kept in two generations, so memory stays bounded whatever the texts hold.
    """

    MOST = 300_000
    #: Parts that the library is asked for at once; its answers are large objects.
    ASK = 10_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.blank = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.blank[i] = token.startswith("Ġ")
        nothing = pa.array([], pa.large_string()), Ids.unsafe(0)
        self.young, self.old = nothing, nothing

    def whole(self, text: str) -> bytes:
        return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def apart(self, texts: list[str]) -> Ids:
        """The ids of short texts, each on its own."""
        lists = []
        for at in range(0, len(texts), self.ASK):
            lists += [e.ids for e in self.library.encode_batch_fast(texts[at:at + self.ASK], add_special_tokens=False)]
        return Ids.of(lists)

    def behind_blanks(self, words: list[str]) -> Ids:
        """The ids of words with a blank before each; neither end of a word is white space."""
        flats, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), self.ASK):
            # All words in one text: each begins with a blank and has no other, so an id that begins with a blank begins a word.
            answer = self.library.encode_batch_fast([" " + " ".join(words[at:at + self.ASK])], add_special_tokens=False)[0].ids
            ids = np.fromiter(answer, np.int32, len(answer))
            flats.append(ids)
            sizes.append(np.diff(np.append(np.flatnonzero(self.blank[ids]), len(ids))))
        size = np.concatenate(sizes)
        return Ids(np.concatenate(flats), np.cumsum(size) - size, size)

    def asked(self, parts: pa.Array) -> Ids:
        """The ids of different parts that no generation has, each as it stands behind a blank."""
        out_start, out_size, flats = np.zeros(len(parts), np.int64), np.full(len(parts), -1, np.int64), []

        def put(at: np.ndarray, ids: Ids) -> None:
            out_start[at], out_size[at] = ids.start + sum(map(len, flats)), ids.size
            flats.append(ids.flat)

        first = pc.starts_with(parts, "\0")
        plain = pc.match_substring_regex(parts, PLAIN)
        cut = pc.extract_regex(pc.if_else(plain, parts, None), MARKED)
        marked = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
        simple = np.flatnonzero(pc.and_not(plain, cut.is_valid()).to_numpy(zero_copy_only=False))
        stems, ends = cut.field("stem").take(pa.array(marked)), cut.field("end").take(pa.array(marked))
        words = pc.unique(pa.chunked_array([parts.take(pa.array(simple)), stems]))
        ids, tails = self.behind_blanks(words.to_pylist()), pc.unique(ends)
        put(simple, ids.take(pc.index_in(parts.take(pa.array(simple)), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)).packed())
        head = ids.take(pc.index_in(stems, value_set=words).to_numpy(zero_copy_only=False).astype(np.int64))
        tail = self.apart(tails.to_pylist()).take(pc.index_in(ends, value_set=tails).to_numpy(zero_copy_only=False).astype(np.int64))
        both = Ids.joined([head, tail])
        pairs = both.take(np.arange(2 * len(marked)).reshape(2, -1).T.ravel()).packed()
        put(marked, Ids(pairs.flat, pairs.start[::2], head.size + tail.size))
        lone = np.flatnonzero(pc.or_(first, pc.match_substring_regex(parts, AFTER_FEED)).to_numpy(zero_copy_only=False))
        put(lone, self.apart([t.removeprefix("\0") for t in parts.take(pa.array(lone)).to_pylist()]))
        return Ids(np.concatenate(flats), out_start, out_size)

    def values(self, parts: pa.Array) -> Ids:
        """The ids of different parts, each as it stands behind a blank."""
        n = len(parts)
        found, left, place = [], np.arange(n), np.zeros(n, np.int64)
        for names, ids in (self.young, self.old):
            at = pc.index_in(parts.take(pa.array(left)), value_set=names).fill_null(-1).to_numpy().astype(np.int64)
            place[left[at >= 0]] = np.arange((at >= 0).sum()) + sum(len(f.size) for f, _ in found)
            found.append((ids.take(at[at >= 0]), left[at >= 0]))
            left = left[at < 0]
        new = parts.take(pa.array(left))
        place[left] = np.arange(len(left)) + sum(len(f.size) for f, _ in found)
        found.append((self.asked(new), left))
        # What came from the old generation or the library is kept on in the young one, but for very long parts.
        names, ids = [self.young[0]], [self.young[1]]
        for f, where in found[1:]:
            short = pc.less_equal(pc.utf8_length(parts.take(pa.array(where))), 64).to_numpy(zero_copy_only=False)
            names.append(parts.take(pa.array(where[short])))
            ids.append(f.take(np.flatnonzero(short)).packed())
        out = Ids.joined([f for f, _ in found]).take(place)
        young = pa.concat_arrays(names), Ids.joined(ids)
        if len(young[0]) > self.MOST:
            self.old, young = young, (young[0][:0], Ids.unsafe(0))
        self.young = young
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers, one after the other."""
        safe = [i for i, t in enumerate(texts) if "\0" not in t and not any(s in t for s in self.special)]
        out: list[bytes | None] = [None] * len(texts)
        if safe:
            cut = pc.replace_substring(pa.array(["\0" + texts[i] for i in safe], pa.large_string()), "\n", " \n")
            cut = pc.split_pattern(cut, " ")
            parts = cut.flatten().dictionary_encode()
            lists = self.values(parts.dictionary).take(parts.indices.to_numpy().astype(np.int64))
            flat = lists.packed().flat.tobytes()
            first = cut.offsets.to_numpy()
            ends = np.concatenate([[0], np.cumsum(np.maximum(lists.size, 0))])[first]
            bad = np.add.reduceat(lists.size < 0, first[:-1]) > 0  # every text has a part
            for i, a, b, again in zip(safe, ends[:-1].tolist(), ends[1:].tolist(), bad.tolist(), strict=True):
                if not again:
                    out[i] = flat[4 * a:4 * b]
        return [self.whole(t) if o is None else o for t, o in zip(texts, out, strict=True)]


def encoder(path: str) -> LibraryEncoder:
    """The encoder of this worker process for a vocabulary file."""
    return worker_tables("library encoder", path, lambda: LibraryEncoder(path))


def write(docs: DataFrame, tokenizer: str, out: str, end_id: int = 0, shards: int | None = None, stripe_mb: int = 64,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text with ``end_id`` after each to ORC files under ``out`` in ascending id order."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        shard, start, end = TaskContext.get().partitionId(), 0, array("i", [end_id]).tobytes()
        for batch in batches:
            for part in slices(batch, 1):
                ids = encoder(tokenizer).encode(part.column(1).to_pylist())
                sizes = np.fromiter((len(x) // 4 + 1 for x in ids), np.int64, len(ids))
                ends = np.cumsum(sizes)
                flat = np.frombuffer(end.join([*ids, b""]), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard, np.int32)), part.column(0), pa.array(start + ends - sizes), pa.array(sizes), lists],
                    names=["shard", "doc_id", "shard_start", "n_tokens", "ids"])
                start += int(ends[-1])

    # The ranges are found from a sample of ids and hashes; texts only break ties inside a task.
    (id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "text_hash")
     .sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text").mapInArrow(run, SCHEMA)
     .write.option("orc.create.index", "true").option("orc.row.index.stride", "5000").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01").option("orc.stripe.size", str(stripe_mb << 20)).option("compression", "zstd").orc(out))


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, read from the files."""
    files = spark.read.schema(SCHEMA).orc(out)
    # One row per shard: as many as the files have ranges.
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = sizes.select("shard", (F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens")).alias("before"))
    return files.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The columns of ``tokens`` but the ids, and their unsigned crc32 as little-endian 32-bit integers."""
    kept = [c for c in tokens.columns if c != ids_col]
    schema = tokens.select(*kept).schema.add("ids_crc32", "long")
    names = schema.fieldNames()

    def run(batches):
        for b in batches:
            lists = b.column(len(kept))
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(sums, pa.int64())], names=names)

    return tokens.select(*kept, ids_col).mapInArrow(run, schema)
