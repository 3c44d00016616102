"""Token counts, codec and token files against the tokenizers library."""

import os
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from slotlog.llm import bpe_codec, queries, token_counts, token_files
from slotlog.llm.bpe import Table, Vocabulary
from slotlog.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=400):
    rng = random.Random(5)
    letters = [*"ab  \n\n\t\r'sé1!ñ 　世界😀", "<|endoftext|>", "'ll", " \n", "aaaa", "the ", ". "]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, None, "", " ", "\n", "".join(rng.choice("abcdethiso") for _ in range(30_000)), "x" * 5000, "a b " * 20_000]


def frame(spark, texts):
    rows = [(i, t, "src", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids long, n_tokens string")


def test_odd_texts(spark, library):
    texts = odd_texts()
    docs = frame(spark, texts).repartition(3)
    want = [ids_of(library, t) for t in texts]
    for r in token_counts.count_tokens(docs, TOKENIZER).collect():
        assert (r.n_tokens, r.n_bytes) == (len(want[r.doc_id]), len((texts[r.doc_id] or "").encode()))
        assert r.over_limit == (r.n_tokens > 1024)
    for r in bpe_codec.round_trip(docs, TOKENIZER).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(want[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    ids = bpe_codec.encode(docs, TOKENIZER)
    for r in bpe_codec.decode(ids, TOKENIZER).collect():
        assert r.text == (texts[r.doc_id] or "")


def test_broken_utf8_decodes_like_the_library(spark, library):
    ids = [[0xC3, 1000], [128], [], None, [50256, 5]]
    got = bpe_codec.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>"), TOKENIZER).collect()
    for r in got:
        assert r.text == library.decode(ids[r.doc_id] or [], skip_special_tokens=False)


def test_long_fragments_and_cuts_equal_plain_merging():
    v = Vocabulary(TOKENIZER)
    rng = random.Random(3)
    inner = bpe_codec.inner_pairs(v)
    for n in [1, 2, 5, 80, 400]:
        data = bytes(rng.choice(b"etaoin shrdlu\xc3\xa9\x00\xff") for _ in range(n))
        plain = bpe_codec.encode_fragment(data, v)
        assert bpe_codec.encode_long(data, v) == plain
        assert [i for f in bpe_codec.fragments(data, inner) for i in bpe_codec.encode_fragment(f, v)] == plain
        assert token_counts.merged_length(data, v) == len(plain)
    assert len(bpe_codec.fragments(b"\xff\xff\xff", inner)) > 1


def test_table_keeps_bounded_and_frequent():
    calls = []
    t = Table(lambda k: calls.append(k) or len(k), most=3)
    for k in ["a", "b", "c", "a", "d", "a", "e", "f", "a"]:
        assert t[k] == 1
    assert len(t) + len(t.old) <= 6 and calls.count("a") == 1


def test_token_files(spark, library, tmp_path):
    texts = odd_texts(60)
    docs = frame(spark, texts)
    docs = docs.union(docs.filter("doc_id in (3, 4)")).orderBy("text")
    out = str(tmp_path / "ids")
    token_files.write(docs, TOKENIZER, out, end_id=0, shards=4)
    at = 0
    rows = token_files.read(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([*range(len(texts)), 3, 4])
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.checksums(token_files.read(spark, out)).collect()}
    for r in rows:
        want = [*ids_of(library, texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(want), want)
        assert sums[r.doc_id, r.start] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, []).limit(0)
    assert token_counts.count_tokens(docs, TOKENIZER).count() == 0
    assert bpe_codec.round_trip(docs, TOKENIZER).count() == 0
    token_files.write(docs, TOKENIZER, str(tmp_path / "none"))
    assert token_files.checksums(token_files.read(spark, str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("name", ["op6_token_counts", "op7_bpe_codec", "op9_token_files"])
def test_queries_over_whole_table(spark, library, name):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(texts)
    extra = name.startswith("op9")
    assert all(r.n_tokens == len(ids_of(library, texts[r.doc_id])) + extra for r in rows)


def test_files_have_row_indexes_and_bloom_filters_and_a_look_up_skips_rows(spark, tmp_path):
    """Integer run lengths, a row index and a Bloom filter on the ids in every stripe; a look-up by id reads one row group of many."""
    out = str(tmp_path / "tokens")
    docs = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "concat('text ', id) as text")
    token_files.write(docs, TOKENIZER, out, shards=1)
    jvm = spark.sparkContext._jvm
    conf, footers = spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in sorted(p for p in os.listdir(out) if p.endswith(".orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"{out}/{f}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        ids = next(i for i, c in enumerate(reader.getSchema().getFieldNames(), 1) if c == "doc_id")
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            footers.append({footer.getStreams(k).getKind().toString() for k in range(footer.getStreamsCount()) if footer.getStreams(k).getColumn() == ids})
            assert footer.getColumns(ids).getKind().toString() == "DIRECT_V2"  # integer run-length encoding, second version
    assert footers and all("ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds) for kinds in footers)

    def rows_read(condition):
        df = spark.read.schema(token_files.SCHEMA).orc(out).filter(condition)
        found = df.collect()
        return len(found), df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()

    found, read = rows_read("doc_id = 20000")
    assert found == 1 and read <= 5000 < 20_000
    # An id within the range of a row group that no row has: minimum and maximum would not tell, the Bloom filter does.
    found, read = rows_read("doc_id = 20001")
    assert found == 0 and read <= 5000
