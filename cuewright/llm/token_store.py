"""Operator 4, token-id output: a content-addressed store of id streams.

Files of a store, all below one folder:
  chunks/    digest, n, crc, payload: every distinct run of ids once, wherever and however often it occurs
  recipes/   one row per document in ascending id order: shard, place in it, digests of its chunks, Merkle leaf
  manifest/  one row per shard of recipes: first ordinal, documents, ids, ids before it, Merkle root

Ids are cut where a rolling hash over the last WINDOW ids hits a mask, so equal passages give equal
chunks wherever they stand in a document. A payload holds little-endian unsigned ids of `width` bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import arrow_schema, binaries, delete, joined, packets, partitions, picked, prepare, released, scratch_path
from cuewright.llm.words import WordMemo, coded_words, drops_white_space, library, units_of

#: Documents of a shard of recipes, about: what a Merkle root is made of in one task.
SHARD_DOCUMENTS = 100_000
#: Ids that the rolling hash sees, and lengths of chunks in ids. About one id in MASK + 1 ends a chunk.
WINDOW, MASK, SHORTEST, LONGEST = 4, 255, 64, 2048
DIGEST_BYTES = 16
PACKET_BYTES = 16 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaf digests; an odd node moves up as it is; the root of no leaves is the digest of nothing."""
    level = leaves or [digest_of(b"")]
    while len(level) > 1:
        pairs = [digest_of(a + b) for a, b in itertools.batched(level[: len(level) // 2 * 2], 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: content-defined, none shorter than SHORTEST (but the last) or longer than LONGEST."""
    return cuts_of(ids, np.array([0, len(ids)]))[0]


def cuts_of(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """cuts of each of the id streams between bounds that stand one after another.

    The hash of the first ids of a stream sees the end of the one before, but no chunk ends there: WINDOW is below SHORTEST.
    """
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    rolling = mixed.copy()
    for back in range(1, WINDOW):
        rolling[back:] += mixed[:-back] << np.uint64(back)
    found = np.flatnonzero((rolling >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    firsts = np.searchsorted(found, bounds, side="right")
    places, out = found.tolist(), []
    for (start, stop), (a, b) in zip(itertools.pairwise(bounds.tolist()), itertools.pairwise(firsts.tolist()), strict=True):
        n, last = stop - start, 0
        ends: list[int] = []
        for place in [*places[a:b], stop] if n else ():
            end = place - start
            while end - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if end - last >= SHORTEST or (end == n and end > last):
                ends.append(end)
                last = end
        out.append(ends)
    return out


STAGED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("leaf", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("digests", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def packed(ids: list[int], width: int) -> bytes:
    """Ids as little-endian unsigned integers of width bytes."""
    return struct.pack(f"<{len(ids)}{'H' if width == 2 else 'I'}", *ids)


@cache
def memo_of(vocabulary: str, width: int) -> WordMemo | None:
    """The packed ids of words that this worker has met lately, in any task; None if the tokenizer does not go word by word."""
    return WordMemo(vocabulary, lambda ids: packed(ids, width), in_batches=False) if drops_white_space(vocabulary) else None


def streams_of(texts: pa.Array, vocabulary: str, end_id: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed ids of texts (none of them null), one after another, each with the end id, and where each text's end, after a 0; in bytes."""
    memo, end = memo_of(vocabulary, width), packed([end_id], width)
    if memo is None:
        streams = [packed(ids, width) + end for ids in library(vocabulary)(texts.to_pylist())]
        return np.frombuffer(b"".join(streams), np.uint8), np.cumsum([0, *map(len, streams)])
    words, chosen, counts = coded_words(texts)
    units, halves = units_of(words, memo.plain is not None)
    data, ends = joined(pa.array(memo.of_units(units), pa.large_binary()), halves.ravel())
    # One more word, the end id, stands behind those of each text.
    values = binaries(np.concatenate((data, np.frombuffer(end, np.uint8))), np.append(ends[::2], ends[-1] + width))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    data, ends = joined(values, np.insert(chosen, bounds[1:], len(words)))
    return data, ends[bounds + np.arange(len(bounds))]


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per document: its ids as bytes, cut into chunks with their digests, and its Merkle leaf."""
    prepare(docs.sparkSession)
    source = picked(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([source.schema["doc_id"], *STAGED])
    out_schema = arrow_schema(schema)
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                data, bounds = streams_of(pc.fill_null(part.column("text"), ""), vocabulary, end_id, width)
                held, rows = memoryview(data), []
                for start, ends in zip(bounds.tolist(), cuts_of(data.view(kind), bounds // width), strict=False):
                    digests = [digest_of(held[start + a * width : start + b * width]) for a, b in itertools.pairwise([0, *ends])]
                    rows.append((merkle(digests), packed([b - a for a, b in itertools.pairwise([0, *ends])], 4), b"".join(digests)))
                columns = [np.diff(bounds) // width, *zip(*rows, strict=True), binaries(data, bounds).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(out_schema)[1:], strict=True))], schema=out_schema)

    return source.mapInArrow(run, schema)


CHUNKS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("payload", T.BinaryType())])


def roots_of(recipes: DataFrame) -> DataFrame:
    """shard, documents, ids, root (Merkle root over the leaves in their order) of the recipes of each shard."""
    shards = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("documents", T.LongType()), T.StructField("ids", T.LongType()), T.StructField("root", T.BinaryType())])
    shard_schema = arrow_schema(shards)

    def rooted(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by("ordinal")
        leaves = held.column("leaf").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([len(leaves)], pa.int64()), pa.array([pc.sum(held.column("n_tokens")).as_py()], pa.int64()), pa.array([merkle(leaves)], pa.binary())], schema=shard_schema)

    return recipes.select("shard", "ordinal", "leaf", "n_tokens").groupBy("shard").applyInArrow(rooted, shards)


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> None:
    """Encode every text and write the store below path (a folder that all executors see).

    end_id ends each document. width is the number of bytes of an id; it must hold the vocabulary.
    Documents stand in ascending order of their id, null ids first; rows that share an id stand in the
    order of their Merkle leaves. Null text: the end id alone. An empty table gives empty tables.

    The texts are encoded once, into a staged table that is removed when the store is complete. The only
    shuffle of id bytes is the one that leaves each chunk once, combined on the map side first, so a
    passage that a third of the documents hold is one row per task. Recipes are dealt by ranges of the id.
    """
    spark = docs.sparkSession
    staging = scratch_path(spark, "ids")
    encoded(docs, vocabulary, end_id, id_col, text_col, width).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.parquet(staging)
    out_schema = arrow_schema(CHUNKS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of.cache_clear()  # all is encoded by now
        released()
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            for lengths, digests, payload in zip(*(batch.column(c).to_pylist() for c in ("lengths", "digests", "payload")), strict=True):
                at = 0
                for i, n in enumerate(np.frombuffer(lengths, "<u4").tolist()):
                    seen[digests[i * DIGEST_BYTES : (i + 1) * DIGEST_BYTES]] = payload[at : at + n * width]
                    at += n * width
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.binary())], schema=out_schema)

    occurrences = staged.select("lengths", "digests", "payload").mapInArrow(split, CHUNKS)
    occurrences.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = staged.select("doc_id", "n_tokens", "leaf", "lengths", "digests").repartitionByRange(max(partitions(spark), -(-staged.count() // SHARD_DOCUMENTS)), F.col("doc_id").asc_nulls_first(), "leaf").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "leaf")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField("before", T.LongType()), *recipes.schema])
    recipe_schema = arrow_schema(schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ordinal, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            tokens = batch.column("n_tokens").to_numpy()
            ends = before + np.cumsum(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.array(ends - tokens, pa.int64()), *batch.columns], schema=recipe_schema
            )
            ordinal, before = ordinal + n, int(ends[-1]) if n else before

    recipes.mapInArrow(placed, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")

    summary = roots_of(spark.read.schema(schema).parquet(f"{path}/recipes"))
    rows = sorted(summary.collect())  # one row per shard, that is per SHARD_DOCUMENTS documents or shuffle partition
    first, tokens, manifest = 0, 0, []
    for shard, documents, ids, root in rows:
        manifest.append((shard, first, documents, ids, tokens, bytes(root)))
        first, tokens = first + documents, tokens + ids
    spark.createDataFrame(manifest, "shard int, first_ordinal long, documents long, ids long, ids_before long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    delete(spark, staging)


def recipes_of(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store in order: ordinal, doc_id, start (ids of all documents before it), n_tokens, chunk lengths and digests.

    The manifest verifies them: a shard whose recipes are lost, added or changed, so that they do not give its counts and Merkle
    root, raises.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    found = roots_of(recipes).select("shard", F.struct("documents", "ids", "root").alias("found"))
    sound = F.when(F.col("found").eqNullSafe(F.struct("documents", "ids", "root")), F.col("ids_before")).otherwise(F.raise_error(F.lit("a shard does not match its manifest")).cast("bigint"))
    manifest = spark.read.parquet(f"{path}/manifest").join(found, "shard", "full").select("shard", "first_ordinal", sound.alias("ids_before"))
    return (
        recipes.join(F.broadcast(manifest), "shard")  # one row per shard
        .select((F.col("first_ordinal") + F.col("ordinal")).alias("ordinal"), "doc_id", (F.col("ids_before") + F.col("before")).alias("start"), "n_tokens", "leaf", "lengths", "digests")
    )


def wanted_chunks(recipes: DataFrame, *carried: str) -> DataFrame:
    """One row per chunk that a document refers to: its ordinal, place and digest. Narrow rows."""
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordinals, places, sizes, digests = [], [], [], []
            for o, lengths, d in zip(*(batch.column(c).to_pylist() for c in ("ordinal", "lengths", "digests")), strict=True):
                for i, n in enumerate(np.frombuffer(lengths, "<u4").tolist()):
                    ordinals.append(o)
                    places.append(i)
                    sizes.append(n)
                    digests.append(d[i * DIGEST_BYTES : (i + 1) * DIGEST_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(ordinals, pa.int64()), pa.array(places, pa.int32()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], schema=out_schema)

    return recipes.select("ordinal", "lengths", "digests").mapInArrow(run, schema)


def checked(digest: bytes, payload: bytes) -> bytes:
    if digest_of(payload) != digest:
        raise ValueError(f"chunk {digest.hex()} does not hold what its name says")
    return payload


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Every document read back in full: ordinal, doc_id, start, n_tokens, ids (array of long).

    Each chunk is compared with its digest, each document with its Merkle leaf; a mismatch raises.
    """
    recipes = recipes_of(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("found", T.BinaryType())])
    out_schema = arrow_schema(schema)

    def build(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((p, d, x) for b in batches for p, d, x in zip(*(b.column(c).to_pylist() for c in ("place", "digest", "payload")), strict=True))
        ids = np.frombuffer(b"".join(checked(d, x) for _, d, x in rows), f"<u{width}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([merkle([d for _, d, _ in rows])], pa.binary())], schema=out_schema)

    whole = wanted_chunks(recipes).join(chunks, "digest", "left").groupBy("ordinal").applyInArrow(build, schema)
    sound = F.when(F.col("found") == F.col("leaf"), F.col("ids")).otherwise(F.raise_error(F.lit("a document does not match its Merkle leaf")).cast("array<bigint>"))
    return recipes.join(whole, "ordinal").select("ordinal", "doc_id", "start", "n_tokens", sound.alias("ids"))


CRC_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
            if not a & (bit - 1):
                break
        bit >>= 1
        b = (b >> 1) ^ CRC_POLYNOMIAL if b & 1 else b >> 1
    return out


@cache
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    out, base, n = 1 << 31, 1 << 23, n_bytes
    while n:
        if n & 1:
            out = _times(base, out)
        base, n = _times(base, base), n >> 1
    return out


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of joined runs of bytes, from the (crc32, length) of each."""
    total = 0
    for crc, n in parts:
        total = _times(_shift(n), total) ^ crc
    return total


def read_checksums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Per document of the files: ordinal, doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers).

    Every payload is read from the files, compared with its digest and summed where it lies; only
    (digest, checksum, length) moves, and a document's checksum is put together from those of its chunks
    in the order of its recipe. A chunk that is missing, and a document whose digests or lengths do not
    give its Merkle leaf and token count, raise.
    """
    recipes = recipes_of(spark, path)
    sums = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("crc", T.LongType())])
    sum_schema = arrow_schema(sums)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            crcs = [zlib.crc32(np.frombuffer(checked(d, x), f"<u{width}").astype("<u4").tobytes()) for d, x in zip(digests, batch.column("payload").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(crcs, pa.int64())], schema=sum_schema)

    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(summed, sums)
    parts = wanted_chunks(recipes).join(chunks, "digest", "left")
    per_document = parts.groupBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("place", "crc", "n", "digest"))).alias("parts"))
    schema = T.StructType([recipes.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    out_schema = arrow_schema(schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, lists = [], batch.column("parts")
            digests, sums, sizes = (lists.values.field(c).to_pylist() for c in ("digest", "crc", "n"))
            for n, leaf, (a, b) in zip(batch.column("n_tokens").to_pylist(), batch.column("leaf").to_pylist(), itertools.pairwise(lists.offsets.to_pylist()), strict=True):
                if merkle(digests[a:b]) != leaf or sum(sizes[a:b]) != n:
                    raise ValueError("a document does not match its Merkle leaf")
                crcs.append(crc_joined([(c, 4 * k) for c, k in zip(sums[a:b], sizes[a:b], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], schema=out_schema)

    return recipes.select("ordinal", "doc_id", "start", "n_tokens", "leaf").join(per_document, "ordinal").mapInArrow(joined, schema)


__all__ = ["crc_joined", "cuts", "encoded", "merkle", "read_checksums", "read_documents", "recipes_of", "write_store"]
