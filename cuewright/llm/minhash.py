"""Operator 5, near-duplicate documents: HyperMinHash registers, banded, estimated, then verified on full sets.

A document is its set of word shingles. Documents with equal sets are one class, and everything below
works on classes. The hash of a shingle chooses one of REGISTERS buckets by its top bits; a bucket keeps the
leading zeros and the next MANTISSA bits of the smallest hash in it, 16 bits instead of 64. Rows of registers
form bands; classes that share a band are candidates. A candidate pair is estimated from its registers, with
the chance agreement of compressed registers taken off, and is a link only if its full sets say so.

Finding components takes three passes, none of which makes all pairs of a bucket:
1. Each class is compared with HUBS of the hubs of its buckets, those that it meets most often. A bucket's hub is the class
   with the most company over all its buckets. Where copies were made of one text, that text is in more of their
   buckets than any copy, so its copies meet it, even if they are too far from each other.
2. Components of the links so far. A bucket that lies in one component has nothing left to say.
3. In the other buckets, classes of different components are compared in memory. The largest component of a bucket is
   dealt out in blocks apart from all other classes, so blocks of its own never meet each other. A pair belongs to the
   first bucket that it shares. Where registers leave a link possible, full sets decide, the likeliest pairs first, until a
   component is joined; only links that join components leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import arrow_schema, dropped, packets, partitions, picked, prepare, written
from cuewright.llm.components import components

#: 32 bands of 4 registers miss a pair of similarity 0.8 with probability (1 - 0.8 ** 4) ** 32 < 1e-7.
REGISTERS, ROWS = 128, 4
BUCKET_BITS, MANTISSA = 7, 10
#: A pair is let go if its estimate falls short of the threshold by more than this: 5.6 standard deviations at 0.8, so a
#: link is lost with probability below 1e-7, as with the bands.
SLACK = 0.2
#: Hubs that a class is compared with in the first pass; what they leave apart is for the third.
HUBS = 2
#: Classes of a bucket, and shingles of all their sets, that make a block; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
PACKET_BYTES = 8 << 20
#: A to Z as small letters, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: of `size` words, or of all its words if it has fewer; none for a null."""
    import xxhash

    # These six characters separate words: space, and tab to carriage return.
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = pc.list_flatten(lists).dictionary_encode()
    places = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w.translate(LOWER)) for w in words), np.uint64, len(words))
    blank = next((i for i, w in enumerate(words) if not w), -1)  # white space at the ends of a text
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    if blank >= 0:
        real = places != blank
        before = np.concatenate(([0], np.cumsum(real)))
        places, ends = places[real], before[ends]
        counts = np.diff(ends, prepend=0)
    hashes = of_word[places] if len(places) else np.empty(0, np.uint64)

    def summed(run: np.ndarray, width: int) -> np.ndarray:
        total = np.full(len(run) - width + 1, np.uint64(width))
        for i in range(width):
            total = total * ODD + run[i : len(run) - width + 1 + i]
            total ^= total >> np.uint64(32)
        return mixed(total)

    whole = summed(hashes, size) if len(hashes) >= size else np.empty(0, np.uint64)  # also those that cross from one text to the next, left out below
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(whole[end - n : end - size + 1]))
        else:
            out.append(summed(hashes[end - n : end], n) if n else np.empty(0, np.uint64))
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), size)[0]


def registers(hashes: np.ndarray) -> np.ndarray:
    """16-bit HyperMinHash registers of a sorted set of hashes; 0 where no hash falls in a bucket."""
    out = np.zeros(REGISTERS, dtype="<u2")
    if len(hashes):
        buckets = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))  # sorted: the first is the smallest
        rest = hashes[first] << np.uint64(BUCKET_BITS)
        exponent = np.frexp(np.maximum(rest >> np.uint64(11), np.uint64(1)).astype(np.float64))[1]  # exact: 53 bits
        zeros = np.minimum(53 - exponent, 62).astype(np.uint64)
        tail = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out[buckets[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | tail).astype("<u2")
    return out


def keys_of_bands(table: np.ndarray) -> np.ndarray:
    """The key of every band of register rows; 0 for a band without any hash."""
    bands = table.reshape(len(table), REGISTERS // ROWS, ROWS).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64)
    for i in range(ROWS):
        key = key * np.uint64(65536) + bands[:, :, i]
    used = key != 0
    key = mixed(key * ODD + np.arange(1, key.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.where(used, key, np.uint64(0)).astype(np.int64)


def band_keys(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the bands of register rows; a band without any hash makes none."""
    keys = keys_of_bands(table)
    rows, _ = np.nonzero(keys)
    return rows, keys[keys != 0]


#: Chance that two registers of different minima agree: over the geometric leading zeros, times the mantissa.
CHANCE = sum(0.25**i for i in range(1, 62)) / 2**MANTISSA


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of register rows: agreeing registers among those that either fills, less chance agreement."""
    filled = (one != 0) | (many != 0)
    n = np.maximum(filled.sum(axis=-1), 1)
    agree = ((one == many) & filled).sum(axis=-1) / n
    return np.clip((agree - CHANCE) / (1 - CHANCE), 0, 1)


CLASS = ("hi", "lo")


def described(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_key (hash of the text), n_shingles, hi and lo (128-bit digest of the set), registers."""
    import hashlib

    prepare(docs.sparkSession)
    source = picked(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    schema = T.StructType(
        [source.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("registers", T.BinaryType())]
    )
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                sizes, digests, signatures = [], [], []
                for hashes in shingle_sets(part.column("text"), shingle):
                    sizes.append(len(hashes))
                    digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    signatures.append(registers(hashes).tobytes())
                parts = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(parts[:, 0]), pa.array(parts[:, 1]), pa.array(signatures, pa.binary())], schema=out_schema)

    return source.mapInArrow(run, schema)


def node(*names: str):
    return F.struct(*(F.col(old).alias(new) for old, new in zip(names, CLASS, strict=True)))


def similar(left: np.ndarray, right: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two full sets are as similar as similarity[0] / similarity[1]."""
    bound, base = similarity
    if base * min(len(left), len(right)) < bound * max(len(left), len(right)):
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return base * both >= bound * (len(left) + len(right) - both)


def texts_of_classes(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """c, text: the text of one row of each wanted class."""
    texts = docs.select(F.col(id_col).alias("rep_id"), F.xxhash64(text_col).alias("rep_key"), F.col(text_col).alias("text"))
    named = wanted.join(classes.select(node(*CLASS).alias("c"), "rep_id", "rep_key"), "c")
    # Rows that repeat both id and text give the same text twice; one of them is as good as the other.
    return named.join(texts, (named.rep_key == texts.rep_key) & named.rep_id.eqNullSafe(texts.rep_id)).groupBy("c").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar. The texts of one row of each class are read again."""
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    held = written(texts_of_classes(wanted, classes, docs, id_col, text_col), "texts")
    joined = pairs.join(held.select(F.col("c").alias("a"), F.col("text").alias("left")), "a").join(held.select(F.col("c").alias("b"), F.col("text").alias("right")), "b")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in packets(batch, "right", PACKET_BYTES):
                sides = [part.column(c).dictionary_encode() for c in ("left", "right")]  # a hub stands in many pairs
                sets = [shingle_sets(side.dictionary, shingle) for side in sides]
                keep = [similar(sets[0][i], sets[1][j], similarity) for i, j in zip(*(side.indices.to_pylist() for side in sides), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], schema=out_schema)

    links = written(joined.select("a", "b", "left", "right").mapInArrow(run, schema), "links", release=True)
    dropped(held)
    return links


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose registers leave a similarity of `least` possible."""
    signatures = classes.select(node(*CLASS).alias("c"), "registers")
    joined = pairs.join(signatures.select(F.col("c").alias("a"), F.col("registers").alias("left")), "a").join(signatures.select(F.col("c").alias("b"), F.col("registers").alias("right")), "b")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("left", "right"))
                keep = pa.array(estimates(one, other) >= least - SLACK)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], schema=out_schema)

    return joined.mapInArrow(run, schema)


DEALT = "key long, i int, j int, main boolean, first boolean, c struct<hi: long, lo: long>, component struct<hi: long, lo: long>, registers binary"


def dealt(members: DataFrame) -> DataFrame:
    """The classes of split buckets in pairs of blocks that are to be compared.

    members: key, c, component, registers, n_shingles. The largest component of a bucket is its main one. Its blocks meet the blocks of
    all other classes, and those meet each other; blocks within the main component are never paired. `first` marks
    the side i, `main` whether side j is of the main component.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    blocks = lambda n, weight: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES)).cast("int")
    most = sizes.groupBy("key").agg(F.max_by(F.struct("component", "n", "weight"), F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    plan = most.select("key", F.col("m.component").alias("largest"), blocks(F.col("m.n"), F.col("m.weight")).alias("main_blocks"), blocks(F.col("n") - F.col("m.n"), F.col("weight") - F.col("m.weight")).alias("blocks"))
    placed = members.join(plan, "key").withColumn("main", F.col("component") == F.col("largest"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("c"), F.when(F.col("main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    role = lambda i, j, main, first: F.struct(i.alias("i"), j.alias("j"), F.lit(main).alias("main"), F.lit(first).alias("first"))
    block = F.col("block")
    of_main = F.transform(numbers(F.col("blocks")), lambda i: role(i, block, True, False))
    of_others = F.concat(
        F.transform(numbers(F.col("main_blocks")), lambda j: role(block, j, True, True)),
        F.transform(F.filter(numbers(F.col("blocks")), lambda j: j >= block), lambda j: role(block, j, False, True)),
        F.transform(F.filter(numbers(F.col("blocks")), lambda i: i < block), lambda i: role(i, block, False, False)),
    )
    roles = placed.withColumn("role", F.explode(F.when(F.col("main"), of_main).otherwise(of_others)))
    return roles.select("key", "role.i", "role.j", "role.main", "role.first", "c", "component", "registers")


#: Rows and bytes of groups that are looked at together, and groups up to this size whose pairs are laid out in one go.
CHUNK_ROWS, CHUNK_BYTES, SMALL_GROUP = 16_384, 32 << 20, 48
#: Pairs whose registers are compared at a time.
PAIRS_AT_ONCE = 1 << 16
GROUP = ("key", "i", "j", "main")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in chunks that end with a group, and the group number of each row. A group is two blocks at most, so a chunk is bounded."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            pending.append(batch)
            if sum(b.num_rows for b in pending) >= CHUNK_ROWS or sum(b.nbytes for b in pending) >= CHUNK_BYTES:
                held = pa.Table.from_batches(pending)
                groups = numbered(held)
                last = int(np.searchsorted(groups, groups[-1]))
                if last:
                    yield held.slice(0, last), groups[:last]
                    pending = held.slice(last).combine_chunks().to_batches()
    if pending:
        held = pa.Table.from_batches(pending)
        yield held, numbered(held)


def numbered(held: pa.Table) -> np.ndarray:
    changes = np.zeros(held.num_rows, bool)
    for name in GROUP:
        column = held.column(name).to_numpy()
        changes[1:] |= column[1:] != column[:-1]
    return np.cumsum(changes)


def labels_of(held: pa.Table) -> np.ndarray:
    """A number for every component of a chunk."""
    parts = np.stack([pc.struct_field(held.column("component"), name).to_numpy() for name in CLASS])
    return np.unique(parts, axis=1, return_inverse=True)[1].reshape(-1)


def possible(held: pa.Table, groups: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the pairs of a group that are of different components, share this bucket first and whose registers leave a link possible, and their estimates."""
    table = np.frombuffer(b"".join(held.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
    keys, labels = keys_of_bands(table), labels_of(held)
    first, same = held.column("first").to_numpy(), ~held.column("main").to_numpy() & (held.column("i").to_numpy() == held.column("j").to_numpy())
    bucket = held.column("key").to_numpy()
    ends = np.searchsorted(groups, groups, side="right")
    small = ends - np.searchsorted(groups, groups) <= SMALL_GROUP
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(left: np.ndarray, right: np.ndarray) -> None:
        wanted = (labels[left] != labels[right]) & (same[left] | (first[left] != first[right]))
        left, right = left[wanted], right[wanted]
        for at in range(0, len(left), PAIRS_AT_ONCE):
            x, y = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
            sims = estimates(table[x], table[y])
            near = sims >= least - SLACK
            x, y, sims = x[near], y[near], sims[near]
            shared = (keys[x] == keys[y]) & (keys[x] != 0)
            here = keys[x, shared.argmax(axis=1)] == bucket[x]
            found.append((x[here], y[here], sims[here]))

    rows = np.flatnonzero(small)
    for by in range(1, SMALL_GROUP):
        rows = rows[rows + by < ends[rows]]
        if not len(rows):
            break
        keep(rows, rows + by)
    for x in np.flatnonzero(~small & first).tolist():
        there = np.arange(x + 1 if same[x] else int(np.searchsorted(groups, groups[x])), ends[x])
        keep(np.full(len(there), x), there)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def across(members: DataFrame, classes: DataFrame, docs: DataFrame, least: float, shingle: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join different components of a bucket; of links between the same two components one is enough.

    Two steps over the same blocks: registers tell which classes have a pair whose estimate leaves a link possible; the
    texts of those alone are fetched, and full sets decide. No pairs are emitted but links.
    """
    blocks = written(dealt(members), "blocks")
    schema = T.StructType.fromDDL(DEALT)
    out_schema = arrow_schema(schema)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(rows.sparkSession), *GROUP).sortWithinPartitions(*GROUP)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, groups in whole_groups(batches):
            lefts, rights, _ = possible(held, groups, least)
            kept = held.take(pa.array(np.unique(np.concatenate([lefts, rights])), pa.int64())).combine_chunks()
            yield from (pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in out_schema], schema=out_schema) for b in kept.to_batches())

    open_ = written(grouped(blocks).mapInArrow(wanted, schema), "open", release=True)
    texts = written(texts_of_classes(open_.select("c").distinct(), classes, docs, id_col, text_col), "texts")
    pair = T.StructType([T.StructField("a", schema["c"].dataType), T.StructField("b", schema["c"].dataType)])
    pair_schema = arrow_schema(pair)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, groups in whole_groups(batches):
            lefts, rights, sims = possible(held, groups, least)
            sets = shingle_sets(held.column("text").combine_chunks(), shingle)
            labels = labels_of(held).tolist()
            root: dict[int, int] = {}  # components that links of this chunk have joined

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:  # noqa: B023
                    x = up
                return x

            kept: list[tuple[int, int]] = []
            for at in np.argsort(-sims, kind="stable").tolist():
                x, y = int(lefts[at]), int(rights[at])
                a, b = find(labels[x]), find(labels[y])
                if a != b and similar(sets[x], sets[y], similarity):
                    root[a] = b
                    kept.append((x, y))
            classes_ = held.column("c")
            yield pa.RecordBatch.from_arrays([pa.array([classes_[p[k]].as_py() for p in kept], pair_schema.field(k).type) for k in (0, 1)], schema=pair_schema)

    links = written(grouped(open_.join(texts, "c")).mapInArrow(decided, pair), "links", release=True)
    dropped(blocks, open_, texts)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least similarity[0] / similarity[1].

    Returns per input row: id_col, n_shingles, component_id (smallest id reachable by links, its own included), kept
    (id = component_id). A to Z are lower-cased; words are what stands between space and the control characters tab to
    carriage return. A text with fewer words than a shingle is one shingle.

    Null, empty and blank texts: no shingles, linked with nothing, their own component, kept. Null ids: take part
    in links; the component of a group is its smallest non-null id, and rows of a group without any id have a null
    component; kept is false for them unless they have no links at all. Repeated rows: each is returned; rows that
    share the smallest id are all kept. Empty table: empty result. Other columns are not read.
    """
    least = similarity[0] / similarity[1]
    rows = written(described(docs, shingle, id_col, text_col), "sets")
    classes = (
        rows.filter("n_shingles > 0")
        .groupBy(*CLASS)
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles"))
        .select(*CLASS, F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "registers", "n_shingles")
    )
    classes = written(classes, "classes")
    out_schema = arrow_schema(T.StructType([T.StructField("key", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())]))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, keys = band_keys(np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(batch.column(c).to_numpy()[at]) for c in CLASS)], schema=out_schema)

    bands = classes.select(*CLASS, "registers").mapInArrow(banded, "key long, hi long, lo long").select("key", node(*CLASS).alias("c"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(bands.join(buckets, "key"), "members", release=True)
    company = members.groupBy("c").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "c").groupBy("key").agg(F.max(F.struct("company", "c")).alias("hub")).select("key", F.col("hub.c").alias("pivot"), F.col("hub.company").alias("company"))
    # Of the hubs that a class meets, those that it shares the most buckets with are the likeliest to be like it.
    met = members.select("key", "c").join(hubs, "key").filter("c != pivot").groupBy("c", "pivot", "company").agg(F.count("*").alias("shared"))
    nearest = Window.partitionBy("c").orderBy(F.col("shared").desc(), F.col("company").desc(), "pivot")  # at most one row per band
    stars = met.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= HUBS).select(F.col("pivot").alias("a"), F.col("c").alias("b"))
    candidates = written(estimated(stars, classes, least), "candidates", release=True)
    links = verified(candidates, classes, docs, shingle, similarity, id_col, text_col)
    dropped(candidates)
    reached = written(components(links), "components")

    labelled = written(members.join(reached.select(F.col("node").alias("c"), "component"), "c", "left").select("key", "c", F.coalesce("component", "c").alias("component")), "labelled")
    split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    # All pairs of different components in each bucket that is still split are compared now.
    rest = labelled.join(split, "key").join(classes.select(node(*CLASS).alias("c"), "registers", "n_shingles"), "c")
    more = across(rest, classes, docs, least, shingle, similarity, id_col, text_col)
    dropped(labelled, members)
    # These links join whole components, so only their labels are joined, not the classes.
    ends = more.join(reached.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a", "left").join(reached.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
    joined = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    every = reached.unionByName(joined.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("label"))
    reached = written(every.join(joined.select(F.col("node").alias("label"), "component"), "label", "left").select("node", F.coalesce("component", "label").alias("component")), "components")

    smallest = classes.select(node(*CLASS).alias("node"), "rep_id").join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "rep_id")
    names = smallest.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    named = smallest.join(names, "component").select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), "component_id")
    linked = rows.filter("n_shingles > 0").select("doc_id", "n_shingles", *CLASS).join(named, list(CLASS)).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & (F.col("n_shingles") == 0)).alias("kept"))
