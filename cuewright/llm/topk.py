"""Operator 3, exact top-k search: columnar branch-and-bound over blocks of vectors.

Vectors are packed into blocks in vertical layout, one row per dimension. A block of queries meets a block of
candidates in one task. Inner products grow by BLOCK_DIMENSIONS dimensions at a time; what is still missing of a
product is at most the product of the lengths of the two remaining parts, so candidates whose bound is below the
k-th best score known so far are dropped and the others compacted before the next dimensions are added: first those
that no query of the block wants, then, once few products are left, every single pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cuewright.llm.common import arrow_schema, partitions, picked, prepare, written

#: Vectors of a block of candidates and of queries, and dimensions that are added at a time.
CANDIDATES, QUERIES, BLOCK_DIMENSIONS = 4096, 512, 16
#: Products and bounds are sums of whole numbers; below this they are exact in double precision.
EXACT = float(1 << 52)
#: And below this in single precision.
EXACT_SINGLE = float(1 << 24)
#: Once no more than this share of the products of a block is wanted, they go on as single pairs.
SPARSE = 0.02

PACKED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("dimensions", T.IntegerType()), T.StructField("columns", T.BinaryType())])


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of every usable vector: not null, and no component null or not finite."""
    x = F.transform(F.col("v"), lambda c: c.cast("double"))
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return picked(vectors, id=id_col, v=vector_col).filter(usable & F.col("id").isNotNull()).select("id", F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def different(rows: DataFrame) -> DataFrame:
    """Each id and vector once, combined before the shuffle; zeros at the end of a vector count for nothing."""
    last = F.size("v") + 1 - F.array_position(F.transform(F.reverse("v"), lambda x: x != 0), True)
    return rows.withColumn("v", F.slice("v", 1, F.when(F.exists("v", lambda x: x != 0), last).otherwise(0).cast("int"))).distinct()


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of about `size` vectors in vertical layout, dimension by dimension, in the fewest bytes that hold each number. Shorter vectors end in zeros."""
    out_schema = arrow_schema(PACKED)

    def block(ids: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
        width = max(map(len, vectors))
        table = np.zeros((len(ids), width), dtype="<i8")
        for i, v in enumerate(vectors):
            table[i, : len(v)] = v
        narrow = next((t for t in ("<i1", "<i2", "<i4") if table.size and np.iinfo(t).min <= table.min() and table.max() <= np.iinfo(t).max), "<i8")
        table = table.astype(narrow)
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([np.ascontiguousarray(table.T).tobytes()], pa.binary())], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            vectors += batch.column("v").to_pylist()
            while len(ids) >= size:
                yield block(ids[:size], vectors[:size])
                ids, vectors = ids[size:], vectors[size:]
        if ids:
            yield block(ids, vectors)

    return rows.mapInArrow(run, PACKED)


def vertical(columns: bytes, n: int, width: int, dimensions: int | None = None) -> np.ndarray:
    """The table of a block: one row a dimension, as many as asked for; numbers as narrow as they were packed."""
    size = 8 if not dimensions else len(columns) // (n * dimensions)
    table = np.frombuffer(columns, f"<i{size}").reshape(-1, n)
    return np.vstack([table, np.zeros((width - len(table), n), dtype=table.dtype)]) if len(table) < width else table


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list[int], list[int], list[int]]:
    """(query, vector, score) of the k best of each query in a block, ties to smaller ids; a query's own id is left out.

    floor: a score that k other vectors reach for each query, if known; what is below it need not be returned.
    """
    largest = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(candidates.astype(np.float64)).max(initial=0)) * len(queries)
    exact = largest < EXACT  # beyond, sums in double precision are off by a little: bounds allow for that, and whole numbers decide at the end
    kind = np.float32 if largest < EXACT_SINGLE else np.float64
    # The margins cover rounding of square roots and bounds; where `exact`, all other numbers here are exact.
    relative, absolute = (1 + 1e-5, 4.0) if kind is np.float32 else (1 + 1e-9, 1e-6)
    c64 = candidates.astype(np.float64)
    mass = np.einsum("dn,dn->n", c64, c64)
    # Dimensions that carry the most come first: the remaining parts get short early.
    by_weight = np.argsort(-np.einsum("dn,dn->d", c64, c64), kind="stable")
    q64, c64 = queries[by_weight].astype(np.float64), c64[by_weight]
    q, c = q64.astype(kind), c64.astype(kind)
    probe = np.unique(np.concatenate([np.argsort(-mass, kind="stable")[: 4 * k], np.argsort(-(q64.sum(axis=1) @ c64), kind="stable")[: 4 * k]]))
    off_q, off_c = (np.zeros(x.shape[1]) if exact else np.sqrt(np.einsum("dn,dn->n", x, x)) for x in (q64, c64))
    off_q *= 1e-15 * (len(q) + 8)  # of a product of a query and a candidate: a few units in the last place for each dimension
    seeds = q64.T @ c64[:, probe] - np.outer(off_q, off_c[probe])
    seeds[query_ids[:, None] == ids[probe][None, :]] = -np.inf
    limit = np.partition(seeds, len(probe) - k, axis=1)[:, len(probe) - k] if len(probe) > k else np.full(len(query_ids), -np.inf)
    if floor is not None:
        limit = np.maximum(limit, floor - 1e-15 * np.abs(floor))
    left_q, left_c = (np.vstack([np.cumsum((x**2)[::-1], axis=0)[::-1], np.zeros((1, x.shape[1]))]) for x in (q64, c64))  # what remains of a length from each dimension on
    if not exact:  # sums of squares are rounded
        left_q, left_c = left_q * (1 + 1e-13 * len(q)), left_c * (1 + 1e-13 * len(q))
    left_q, left_c = np.sqrt(left_q) * relative, np.sqrt(left_c)

    own = np.flatnonzero(np.isin(ids, query_ids))
    place = np.arange(len(ids))  # of the candidates that are still looked at
    score, at = np.zeros((len(query_ids), len(ids)), kind), 0
    while True:  # dense: all queries meet all candidates that any of them may still want
        dims = slice(at, at + BLOCK_DIMENSIONS)
        score += q[dims].T @ c[dims]
        if not at and len(own):
            score[:, own] = np.where(query_ids[:, None] == ids[own][None, :], -np.inf, score[:, own])
        at = min(at + BLOCK_DIMENSIONS, len(q))
        bound = left_q[at].astype(kind)[:, None] * left_c[at, place].astype(kind)[None, :]
        if not exact:
            bound += np.outer(off_q, off_c[place])
        bound += score
        if at == len(q) and len(place) > k:  # what k candidates reach at least is a better limit
            sure = score if exact else score - np.outer(off_q, off_c[place])
            limit = np.maximum(limit, np.partition(sure, len(place) - k, axis=1)[:, len(place) - k])
        open_ = bound >= (limit - absolute).astype(kind)[:, None]
        wanted = int(np.count_nonzero(open_))
        if at == len(q) or wanted <= SPARSE * open_.size:
            break
        alive = open_.any(axis=0)
        if np.count_nonzero(alive) < 0.75 * len(place):
            place, c, score = place[alive], np.ascontiguousarray(c[:, alive]), np.ascontiguousarray(score[:, alive])
    i, j = np.nonzero(open_)
    score, j = score[i, j].astype(np.float64), place[j]
    kept = score > -np.inf
    i, j, score = i[kept], j[kept], score[kept]
    while at < len(q):  # compacted: pairs of a query and a candidate, dropped as soon as they can't reach the limit
        dims = slice(at, at + BLOCK_DIMENSIONS)
        score = score + np.einsum("dn,dn->n", q64[dims][:, i], c64[dims][:, j])
        at = min(at + BLOCK_DIMENSIONS, len(q))
        alive = score + left_q[at, i] * left_c[at, j] + off_q[i] * off_c[j] >= limit[i] - absolute
        i, j, score = i[alive], j[alive], score[alive]
    if exact:
        order = np.lexsort((ids[j], -score, i))
        whole_scores = score.astype(np.int64)
    else:
        whole_scores = (queries[:, i].astype(object) * candidates[:, j].astype(object)).sum(axis=0) if len(i) else score
        order = np.array(sorted(range(len(i)), key=lambda x: (i[x], -whole_scores[x], ids[j[x]])), dtype=np.int64)
    i, j, whole_scores = i[order], j[order], whole_scores[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return query_ids[i[first]].tolist(), ids[j[first]].tolist(), [int(x) for x in whole_scores[first].tolist()]


class Floors:
    """The k best scores of the queries of a block so far: each block of candidates that a task meets makes the next one shorter."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.ids, self.order = query_ids, np.argsort(query_ids, kind="stable")
        self.scores = np.full((len(query_ids), k), -np.inf)

    def of(self) -> np.ndarray:
        return self.scores.min(axis=1)

    def add(self, found: tuple[list[int], list[int], list[int]]) -> None:
        at = self.order[np.searchsorted(self.ids, np.array(found[0], np.int64), sorter=self.order)]
        k, rank = self.scores.shape[1], np.arange(len(at)) - np.searchsorted(at, at)
        new = np.full_like(self.scores, -np.inf)
        new[at, rank] = found[2]
        self.scores = np.sort(np.concatenate([self.scores, new], axis=1), axis=1)[:, -k:]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest inner products of each query with all vectors but those of its own id.

    Components are taken as floor(scale * x) of the double x. Returns query_id, rank (from 1), vec_id, score; ties
    go to the smaller id; all of them, if there are fewer than k. Vectors (and queries) that are null or hold a null
    or non-finite component take no part, nor do rows without an id. A shorter vector counts as ending in
    zeros. Repeated rows: a repeated vector of the same id counts once, repeated queries give one answer. An
    empty table gives no rows. Other columns are not read.

    Query blocks are dealt to all candidate blocks, a stated query set against all rows: both sides are packed,
    and a task holds one block of each. Repeated vectors go before that, so the k places of a block hold k different ones. Only k rows per query and candidate block leave it.
    """
    prepare(vectors.sparkSession)
    candidates = written(packed(different(whole(vectors, id_col, vector_col, scale)), CANDIDATES).withColumn("block", F.monotonically_increasing_id()), "candidates")
    asked = packed(whole(queries, id_col, vector_col, scale).dropDuplicates(["id"]), QUERIES)
    asked = written(asked.select(F.col("ids").alias("query_ids"), F.col("dimensions").alias("query_dimensions"), F.col("columns").alias("query_columns")), "queries")
    # A grid of cells: each block of candidates lies in one, each block of queries goes to all.
    # The copies of the queries are shuffled and never broadcast, however small the planner takes them to be: it does not count copies.
    cells = max(1, min(candidates.count(), 2 * partitions(vectors.sparkSession)))
    asked, candidates = asked.hint("merge"), candidates.hint("merge")
    pairs = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).join(candidates.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")), "cell")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = None  # of the block of queries at hand: the join brings all candidates of a cell for one of them after another
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                query_ids, ids = np.frombuffer(value("query_ids"), "<i8"), np.frombuffer(value("ids"), "<i8")
                width = max(value("query_dimensions"), value("dimensions"))
                if floors is None or not np.array_equal(floors.ids, query_ids):
                    floors = Floors(query_ids, k)
                queries = vertical(value("query_columns"), len(query_ids), width, value("query_dimensions"))
                found = best(query_ids, queries, ids, vertical(value("columns"), len(ids), width, value("dimensions")), k, floors.of())
                floors.add(found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=out_schema)

    scored = pairs.select("query_ids", "query_dimensions", "query_columns", "ids", "dimensions", "columns").mapInArrow(run, schema)
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
