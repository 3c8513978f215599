"""Operator 6, near-duplicate embeddings: NN-descent.

Equal vectors are one class. A first neighbour graph comes from blocks of vectors that random hyperplanes put
together; then neighbours of neighbours are compared, round after round, and every list keeps its best. Links are
edges at or above the threshold. Lists are bounded, so they only give components to start from: at last every
vector is compared with every other, block by block, which counts all links and joins components that the lists
left apart. A bounded audit compares some vectors with all others before that; while it finds that links were
missed, more rounds follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import arrow_schema, partitions, picked, prepare, written
from cuewright.llm.components import components

#: Neighbours that a list keeps, sets of hyperplanes of the first graph, and vectors of a block.
NEIGHBOURS, TABLES, BLOCK = 8, 8, 512
#: Rounds of descent at least and at most; vectors that are audited, and the share of their links, per vector, that must be found.
LEAST_ROUNDS, MOST_ROUNDS, AUDITED, RECALL = 1, 6, 256, 0.999
#: Bytes of vectors that pass at a time in the exact comparison, and vectors that a batch meets at a time.
PIECE_BYTES, COLUMNS = 16 << 20, 4096

LISTED = "u long, v long, sim double"


def number_type(vectors: DataFrame, column: str) -> str:
    return "<f4" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "<f8"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Per row: id, digest of its vector and the vector as bytes; both null where the vector is null, zero or not finite throughout."""
    kind = number_type(vectors, vector_col)
    source = picked(vectors, id=id_col, v=vector_col)
    schema = T.StructType([source.schema["id"], T.StructField("digest", T.BinaryType()), T.StructField("vector", T.BinaryType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, data = [], []
            for v in batch.column("v").to_pylist():
                row = None if v is None or any(x is None for x in v) else np.array(v, kind)
                if row is None or not np.isfinite(row).all() or not row.any():
                    digests.append(None)
                    data.append(None)
                else:
                    row = row + np.zeros(1, kind)  # -0.0 and 0.0 are the same number
                    data.append(row.tobytes())
                    digests.append(hashlib.blake2b(data[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array(data, pa.binary())], schema=out_schema)

    return source.mapInArrow(run, schema)


def unit(data: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision, one per row; shorter vectors end in zeros."""
    width = max(map(len, data), default=0)
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), kind).reshape(len(data), -1).astype(np.float64)
    table = table / np.abs(table).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return table / np.sqrt((table * table).sum(axis=1, keepdims=True))


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar neighbours of every node, each once."""
    first = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    return edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).drop("place")


def in_groups(rows: DataFrame, keys: list[str], compare, kind: str, schema: str) -> DataFrame:
    """Apply compare(key values, column arrays) to every group of rows; groups are runs of sorted partitions, so small ones cost little."""
    spread = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    struct = T.StructType.fromDDL(schema)
    out_schema = arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            held = pa.Table.from_batches(pending)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(compare(held, kind), out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for i in range(1, len(values) + 1):
                if i == len(values) or values[i] != values[start]:
                    if last is not None and values[start] != last:
                        yield done()
                        pending.clear()
                    last = values[start]
                    pending.append(batch.slice(start, i - start))
                    start = i
        if pending:
            yield done()

    return spread.mapInArrow(run, struct)


def nearest_in_block(held: pa.Table, kind: str) -> tuple:
    nodes = held.column("node").to_numpy()
    table = unit(held.column("vector").to_pylist(), kind)
    sims = table @ table.T
    np.fill_diagonal(sims, -2)
    k = min(NEIGHBOURS, len(nodes) - 1)
    if k < 1:
        return [], [], []
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(nodes, k), nodes[near.ravel()], np.take_along_axis(sims, near, axis=1).ravel()


def first_graph(classes: DataFrame, n: int, kind: str, seed: int) -> DataFrame:
    """Neighbours within blocks that the signs of random projections share; a block that is too large is dealt out by hash."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / (BLOCK / 4))))))
    schema = "part int, code long, node long, vector binary"
    out_schema = arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = unit(batch.column("vector").to_pylist(), kind)
            for t in range(TABLES):
                planes = np.random.default_rng([seed, t]).standard_normal((table.shape[1], bits))  # row by row: a longer vector only adds rows
                codes = (table @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(table), pa.int32()), pa.array(codes, pa.int64()), batch.column("node"), batch.column("vector")], schema=out_schema)

    coded = classes.select("node", "vector").mapInArrow(run, schema)
    sizes = coded.groupBy("part", "code").agg(F.count("*").alias("n"))
    dealt = coded.join(sizes, ["part", "code"]).withColumn("block", F.pmod(F.xxhash64("node", "part"), F.ceil(F.col("n") / BLOCK)))
    return best_of(in_groups(dealt.select("part", "code", "block", "node", "vector"), ["part", "code", "block"], nearest_in_block, kind, LISTED), NEIGHBOURS)


def improved_around(held: pa.Table, kind: str) -> tuple:
    """Similarities of the neighbours of one node to each other, where they beat the worst that a list holds."""
    nodes, worst = held.column("node").to_numpy(), held.column("worst").to_numpy()
    if len(nodes) < 2:
        return [], [], []
    table = unit(held.column("vector").to_pylist(), kind)
    sims = table @ table.T
    better = (sims > worst[:, None]) & (nodes[:, None] != nodes[None, :])
    a, b = np.nonzero(better)
    return nodes[a], nodes[b], sims[a, b]


def descended(graph: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """One round: around every node, its neighbours and as many of those whose neighbour it is are compared with each other."""
    worst = graph.groupBy("u").agg(F.when(F.count("*") < NEIGHBOURS, F.lit(-2.0)).otherwise(F.min("sim")).alias("worst"))
    backward = best_of(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"), NEIGHBOURS)
    around = graph.select("u", "v").unionByName(backward.select("u", "v")).distinct()
    carried = classes.select(F.col("node"), "vector").join(worst.select(F.col("u").alias("node"), "worst"), "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    rows = around.select(F.col("u").alias("around"), F.col("v").alias("node")).join(carried, "node").select("around", "node", "vector", "worst")
    return best_of(graph.unionByName(in_groups(rows, ["around"], improved_around, kind, LISTED)), NEIGHBOURS)


def joined(own: np.ndarray, labels: np.ndarray, linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of components that links join, without those that follow from pairs already given; labels is changed."""
    for row in np.flatnonzero((linked & (own[:, None] != labels[None, :])).any(axis=1)):
        for other in np.unique(labels[linked[row]]).tolist():
            if other != own[row]:
                yield int(own[row]), other
                labels[labels == other] = own[row]


def linked_everywhere(classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Every class of equal vectors against every other, exactly: (node, links) and, with null links, (node, other): components that a link joins.

    `classes` has node, times, vector and component. One side passes in pieces of PIECE_BYTES, so nothing is shuffled;
    links are counted where they are found, and at most one pair a row and one a column leaves a block.
    """
    spark = classes.sparkSession
    schema = "node long, links long, other long"
    out_schema = arrow_schema(T.StructType.fromDDL(schema))
    pieces = max(1, -(-(classes.agg(F.sum(F.length("vector"))).first()[0] or 0) // PIECE_BYTES))
    results = []
    for number in range(pieces):
        piece = classes.filter(F.pmod(F.xxhash64("node", F.lit("piece")), F.lit(pieces)) == number).select("node", "times", "component", "vector").toArrow()  # about PIECE_BYTES
        sent = spark.sparkContext.broadcast(tuple(piece.column(c).to_numpy() for c in ("node", "times", "component")) + (piece.column("vector").to_pylist(),))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            there, times, components_there, data = sent.value
            blocks = [slice(at, at + COLUMNS) for at in range(0, len(there), COLUMNS)]
            tables = [unit(data[block], kind) for block in blocks]
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                nodes, own = batch.column("node").to_numpy(), batch.column("component").to_numpy()
                table = unit(batch.column("vector").to_pylist(), kind)
                links, pairs = np.zeros(len(nodes), np.int64), []
                for block, others in zip(blocks, tables, strict=True):
                    width = min(table.shape[1], others.shape[1])  # what is beyond one's end meets zeros
                    linked = table[:, :width] @ others[:, :width].T >= threshold
                    linked &= nodes[:, None] != there[block][None, :]
                    links += linked @ times[block]
                    pairs += joined(own, components_there[block].copy(), linked)
                pairs = list(dict.fromkeys(pairs))
                ids = np.concatenate([nodes, np.array([a for a, _ in pairs], np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([*links.tolist(), *[None] * len(pairs)], pa.int64()), pa.array([*[None] * len(nodes), *[b for _, b in pairs]], pa.int64())], schema=out_schema)

        results.append(written(classes.select("node", "component", "vector").mapInArrow(run, schema), "links"))
        sent.unpersist()
    together = results[0]
    for more in results[1:]:
        together = together.unionByName(more)
    return together


def audit(classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """All links of AUDITED vectors (those of the lowest hashes), by comparison with every vector."""
    sample = classes.select("node", "vector").orderBy(F.xxhash64("node", F.lit("audit"))).limit(AUDITED).collect()  # bounded
    nodes, data = np.array([r[0] for r in sample], np.int64), [bytes(r[1]) for r in sample]
    out_schema = arrow_schema(T.StructType.fromDDL("a long, b long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(nodes):
                table = unit([*data, *batch.column("vector").to_pylist()], kind)
                there = batch.column("node").to_numpy()
                a, b = np.nonzero(table[: len(nodes)] @ table[len(nodes) :].T >= threshold)
                other = nodes[a] != there[b]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a][other]), pa.array(there[b][other])], schema=out_schema)

    return classes.select("node", "vector").mapInArrow(run, "a long, b long")


def recall_of(truth: DataFrame, reached: DataFrame) -> float:
    """The share of its links that an audited vector has inside its component: the mean over vectors with about as many links, the least of these means.

    Links are not pooled, since one large group would outweigh all others; vectors with 2 ** i to 2 ** (i + 1) - 1 links are one stratum.
    """
    label = lambda side: reached.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    found = truth.join(label("a"), "a", "left").join(label("b"), "b", "left").withColumn("found", F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)))
    each = found.groupBy("a").agg(F.count("*").alias("asked"), F.avg(F.col("found").cast("double")).alias("share"))
    strata = each.groupBy(F.floor(F.log2("asked")).alias("stratum")).agg(F.avg("share").alias("share"))
    return strata.agg(F.min("share")).first()[0]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """Links and components of vectors whose cosine, in double precision, is at least the threshold.

    Returns per input row: id_col, n_links (other rows linked directly), component_id (smallest id reachable), kept
    (id = component_id). Null and zero vectors, and those with a null or non-finite component, are linked with
    nothing and are their own component. Equal vectors are linked. A shorter vector counts as ending in zeros.
    Null ids take part in links; a group without any id has a null component and is not kept. Repeated rows: each
    counts as a vector. Empty table: empty result. `report`, if given, gets the audited recall and the rounds.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = number_type(vectors, vector_col)
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    grouped = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("times"), F.min("id").alias("rep"), F.first("vector").alias("vector"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()

    truth = written(audit(classes, kind, threshold), "audit")
    asked = truth.count()
    graph, recall = None, 1.0
    for turn in range(MOST_ROUNDS):
        if turn == 0 or turn >= LEAST_ROUNDS:  # more hyperplanes each time that the audit is not content
            more = first_graph(classes, n, kind, seed=turn)
            graph = written(more if graph is None else best_of(graph.unionByName(more), NEIGHBOURS), "graph")
        graph = written(descended(graph, classes, kind), "graph")
        if turn + 1 < LEAST_ROUNDS:
            continue
        links = graph.filter(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        reached = components(links)
        recall = recall_of(truth, reached) if asked else 1.0
        if report is not None:
            report |= {"recall": recall, "audited": asked, "rounds": turn + 1}
        if recall >= RECALL:
            break
    # What the audit saw are links, whether or not the lists had them.
    if recall < 1.0:
        reached = components(links.unionByName(truth))
    reached = written(reached, "components")

    # Lists and blocks only find components early: every pair is compared, so no full list or missed block hides a link.
    labelled = classes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    exact = linked_everywhere(written(labelled, "labelled"), kind, threshold)
    counted = exact.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    across = components(exact.filter("links IS NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    reached = written(labelled.select("node", "component").join(across, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "whole")

    named = classes.select("node", "digest", "times", "rep").join(reached, "node")
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    described = named.join(names, "component").join(counted, "node", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), "component_id")
    linked = rows.select("id", "digest").filter("digest IS NOT NULL").join(described, "digest").select("id", "n_links", "component_id")
    alone = rows.filter("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("n_links") == 0).alias("kept"))
