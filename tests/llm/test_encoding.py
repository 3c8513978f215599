"""Operators 1, 4 and 9 against the libraries, on every kind of row."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from cuewright.llm import byte_bpe, token_counts, token_store
from cuewright.llm.common import scratch_path
from cuewright.llm.words import WordMemo, library, units_of, words_of

BYTES, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aab  \n\n\tZz'sé日本!!0 1\xa0ñeing the\x1c."


def texts(n, seed=3, longest=60):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.worker_encoder(BYTES, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(BYTES), special_tokens={})


@pytest.fixture(scope="module")
def rows(spark):
    found = [(1, ""), (2, None), (3, "one two\nthree"), (3, "one two\nthree"), (None, "no id"), (4, "ab" * 30000), (5, "word " * 20000), (6, "<|endoftext|> token: x")]
    found += [(10 + i, t) for i, t in enumerate(texts(100))]
    return found, spark.createDataFrame([(i, t, 0, "x") for i, t in found], "doc_id long, text string, n_tokens int, ids string")


def together(encoder, found):
    ids, offsets, chosen, counts = byte_bpe.encoded(pa.array(found, pa.string()), encoder)
    own = iter(chosen.tolist())
    return [[x for i in itertools.islice(own, n) for x in ids[offsets[i] : offsets[i + 1]].tolist()] for n in counts.tolist()]


def test_encoder_equals_library(bpe, reference):
    found = texts(1500) + texts(1500, seed=9, longest=25)
    for text, ids in zip(found, together(bpe[0], found), strict=True):
        assert ids == reference.encode_ordinary(text) == bpe[0].encode(text)


def test_classes_of_bytes(bpe, reference):
    """Signs among letters, letters beyond the table, white space of many kinds and runs of marks."""
    draw = random.Random(11)
    alphabet = "aZ19 '\n×÷Àÿƀȿɀʰ¿ª½٣́　\x1f\x1c\t\x00😀_-"
    found = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    assert together(bpe[0], found) == [reference.encode_ordinary(x) for x in found]


def test_tables_stay_small(reference):
    """Long words without a space, all of them different, leave nothing behind; full tables are emptied without changing ids."""
    encoder = byte_bpe.PrefixBPE(byte_bpe.ranks_of(BYTES), public_tokenizers.PATTERN)
    encoder.pairs, encoder.steps = byte_bpe.Table(500), byte_bpe.Table(300)
    draw = random.Random(2)
    for _ in range(5):
        found = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=2000)) for _ in range(20)] + texts(100, seed=draw.random())
        assert together(encoder, found) == [reference.encode_ordinary(x) for x in found]
    assert encoder.pairs.held <= 500 and encoder.steps.held <= 300 and len(encoder._pairs) <= byte_bpe.PAIRS // 4
    assert max(map(len, encoder.names)) <= max(map(len, encoder.ranks))


def test_edits_and_appends(bpe, reference):
    draw = random.Random(5)
    for text in texts(400, seed=4):
        held = byte_bpe.EditableEncoding(bpe[0], text)
        for _ in range(3):
            a = draw.randint(0, len(held.text))
            held.replace(a, draw.randint(a, min(len(held.text), a + 6)), "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 5))))
            held.append(draw.choice(["", "s", " x", "\n", "é"]))
            assert held.ids() == reference.encode_ordinary(held.text)


def test_documents(spark, rows, reference):
    found, df = rows
    got = byte_bpe.encode_documents(df, BYTES, public_tokenizers.PATTERN)
    expected = sorted(((i is None, i or 0), reference.encode_ordinary(t or "")) for i, t in found)
    seen = sorted(((r.doc_id is None, r.doc_id or 0), r.ids) for r in got.collect())
    assert seen == expected
    for r in got.collect():
        assert r.round_trip and r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode_bytes(r.ids)).hexdigest()
    decoded = byte_bpe.decode_documents(got, BYTES)
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((t or "").encode() for _, t in found)
    assert byte_bpe.encode_documents(df.limit(0), BYTES, public_tokenizers.PATTERN).collect() == []


def test_counts(spark, rows):
    found, df = rows
    expected = sorted((str(i), len((t or "").encode()), len(ids)) for (i, t), ids in zip(found, library(WORDS)([t or "" for _, t in found])))
    got = token_counts.count_tokens(df, WORDS, limit=10).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)
    assert token_counts.count_tokens(df.limit(0), WORDS).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_vocabularies(spark, rows, name):
    found, df = rows
    path = public_tokenizers.path(name)
    expected = sorted((str(i), len(ids)) for (i, t), ids in zip(found, library(path)([t or "" for _, t in found])))
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(df, path).collect()) == expected


@pytest.mark.parametrize("in_batches", [True, False])
def test_memo_does_not_change_ids(in_batches):
    memo = WordMemo(WORDS, list, in_batches, most_bytes=8000)
    words = [w for t in texts(200) for w in words_of(pa.array([t]))[0]] + ["Word.", "it's", "NO!!", "<|endoftext|>", "don't.", "...", "a" * 300, ".word", "É.", "x.y.", "ÀÖØßÿ!!", "×a", "e\u0301", "É\u0301", "ÿé***", "İx.", "ſs", "abc<|endoftext|>", "don't's", "rock'", "a\u0338=", "=\u0338", "ǅ", "ŀa"]
    for i in range(0, len(words), 20):
        some = list(dict.fromkeys(words[i : i + 20]))
        assert memo.of(some) == library(WORDS)(some)
        assert memo.held <= 8000 + 20 * 400 and all(len(w) <= 64 for w in memo)


def test_memo_is_bounded_in_bytes():
    draw = random.Random(8)
    memo = WordMemo(WORDS, len, most_bytes=50_000)
    for _ in range(10):
        memo.of(["".join(draw.choices("abcdefgh", k=2000)) for _ in range(20)] + ["".join(draw.choices("abcdefgh", k=9)) for _ in range(200)])
    assert len(memo) <= 500 and max(map(len, memo)) <= 64


def test_store_round_trip(spark, rows):
    found, df = rows
    path = scratch_path(spark, "test-store")
    token_store.write_store(df, path, WORDS, end_id=1)
    whole = token_store.read_documents(spark, path).orderBy("ordinal").collect()
    assert [r.ordinal for r in whole] == list(range(len(found)))
    ids = [r.doc_id for r in whole]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    expected = sorted((str(i), e + [1]) for (i, t), e in zip(found, library(WORDS)([t or "" for _, t in found])))
    assert sorted((str(r.doc_id), list(r.ids)) for r in whole) == expected
    before = 0
    for r in whole:
        assert r.start == before and r.n_tokens == len(r.ids)
        before += r.n_tokens
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.read_checksums(spark, path).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in whole}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


@pytest.mark.parametrize("change", ["lost", "repeated", "another count"])
def test_manifest_verifies_recipes(spark, rows, change):
    path = scratch_path(spark, "test-store")
    token_store.write_store(rows[1], path, WORDS, end_id=1)
    recipes = spark.read.parquet(f"{path}/recipes")
    one = recipes.filter("doc_id = 12")
    changed = {"lost": recipes.filter("doc_id IS NULL OR doc_id <> 12"), "repeated": recipes.unionByName(one), "another count": recipes.withColumn("n_tokens", F.expr("n_tokens + if(doc_id <=> 12, 1, 0)"))}[change]
    other = scratch_path(spark, "test-store")
    changed.write.parquet(f"{other}/recipes")
    for part in ("chunks", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{other}/{part}")
    with pytest.raises(Exception, match="does not match its manifest"):
        token_store.read_checksums(spark, other).collect()


def test_store_of_nothing(spark, rows):
    path = scratch_path(spark, "test-store")
    token_store.write_store(rows[1].limit(0), path, WORDS, end_id=1)
    assert token_store.read_checksums(spark, path).collect() == [] and token_store.read_documents(spark, path).collect() == []


def test_chunks_follow_content():
    draw = np.random.default_rng(0)
    a, b = draw.integers(0, 49000, 5000).astype("<u2"), draw.integers(0, 49000, 777).astype("<u2")
    pieces = lambda ids: {ids[x:y].tobytes() for x, y in zip([0, *token_store.cuts(ids)], token_store.cuts(ids))}
    shared = pieces(a) & pieces(np.concatenate([b, a]))
    assert len(shared) > 0.7 * len(pieces(a))
    assert token_store.crc_joined([(zlib.crc32(b"abc"), 3), (zlib.crc32(b""), 0), (zlib.crc32(b"defgh"), 5)]) == zlib.crc32(b"abcdefgh")


def test_units_of_words():
    """What is found for all words together equals the library, and the same letters are one unit however they are written."""
    found = texts(300) + ["Word. it's NO!! <|endoftext|> <|ENDOFTEXT|> don't. ... .word É. x.y. ÀÖØßÿ!! ×a a÷ ÷ × é É́ ÿé*** İx. ſs abc<|endoftext|> don't's rock' a̸= ≠ Ça! 9. a9. ,A, A,b, Ĉ", "", " \n", "Ã\u0083 ã Ã!"]
    end = token_store.packed([1], 2)
    for part in (found, found[:1], [""], []):
        data, bounds = token_store.streams_of(pa.array(part, pa.string()), WORDS, 1, 2)
        got = [data[a:b].tobytes() for a, b in itertools.pairwise(bounds.tolist())]
        assert got == [token_store.packed(ids, 2) + end for ids in library(WORDS)(part)]
    units, halves = units_of(pa.array(["The", "THE!!", "the", "É.", "é", "don't", "!!"], pa.large_string()), True)
    assert units == ["the", "", "!!", "é", ".", "don't"]
    assert [[units[i] for i in two] for two in halves] == [["the", ""], ["the", "!!"], ["the", ""], ["é", "."], ["é", ""], ["don't", ""], ["!!", ""]]


def test_words_are_met_once_by_a_worker():
    """What one task has encoded is not encoded again by the next in the same worker, and is given back before the chunks are dealt."""
    token_store.memo_of.cache_clear()
    one = token_store.streams_of(pa.array(["many words, Many WORDS!"]), WORDS, 1, 2)[0].tobytes()
    memo = token_store.memo_of(WORDS, 2)
    assert {"many", "words"} < set(memo) and "Many" not in memo
    memo.plain = memo.encode = pytest.fail  # not needed any more
    assert token_store.streams_of(pa.array(["many words, Many WORDS!"]), WORDS, 1, 2)[0].tobytes() == one
    token_store.memo_of.cache_clear()


def test_cuts_of_streams_together():
    """Streams that stand one after another are cut as each alone, also very short and empty ones and those of one id only."""
    draw = np.random.default_rng(4)
    streams = [draw.integers(0, 49000, n).astype("<u2") for n in (0, 1, 3, 64, 65, 5000, 0, 700, 2, 9000)] + [np.full(5000, 7, "<u2"), np.empty(0, "<u2")]
    bounds = np.cumsum([0, *map(len, streams)])
    got = token_store.cuts_of(np.concatenate(streams), bounds)
    assert got == [token_store.cuts(x) for x in streams]
    for ids, ends in zip(streams, got):
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(ids) and all(64 <= n <= 2048 for n in sizes[:-1]) and all(0 < n <= 2048 for n in sizes)
    assert len(got[9]) > 9000 / 2048 + 1 and token_store.cuts_of(np.empty(0, "<u2"), np.array([0])) == []
