"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of a bounded sample.  Every row is represented by its ``PREFIX``
nearest pivots in order of nearness, and is posted, with the pivot's place in that
order, in the inverted file of each of them.  A query reads the files of its own
nearest pivots and adds up, for every row found there, by how much the shared pivots
shorten the footrule distance of the two orders (a pivot that an order lacks counts as
place ``PREFIX``).  The rows with the nearest orders are ranked again by the inner
product of the original vectors in double precision.

The index is a table of blocks of at most ``BLOCK_ROWS`` rows, each with its vectors
and its own inverted files, so a pivot that is nearest to a third of all rows has a
bounded file in every block and no task gets all of its rows.  Queries are blocks too.
Every query block meets every index block once; a meeting returns the block's best
``k`` rows of each query, and these are merged.  Within a block the nearest
``RERANKED`` share is ranked again, and with it the ``LONGEST`` longest vectors, which
the inner product favours whatever their order of pivots.

Bounds of the fit: the pivots come from ``4 * PIVOTS`` rows, those with the smallest
hash of the vec_id.  Every row is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without a vec_id or vectors whose number of components is not
the most common one (of equally common ones the smallest).  Ties go to the smaller
vec_id.  A query with fewer than k candidates gets all of them.  Repeated vec_ids are
rows like others, but a query is asked once (with its smallest vector) and never finds
its own vec_id.  Without usable vectors the result is empty.  Columns other than vec_id
and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import arrow_rows, materialise, table

K, QUERY_EVERY = 20, 20
# Pivots, and how many of a row's nearest make its order.
PIVOTS, PREFIX = 256, 48
# Rows of an index block and of a query block.
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
# Share of a block that is ranked again for each query, and at least so many rows.
RERANKED, LEAST = 0.35, 5 * K
LONGEST = 32

BLOCK = "n int, dim int, ids binary, vectors binary, files array<struct<pivot:int,rows:binary,places:binary>>, long binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    e = F.col("embedding")
    fine = (F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(e, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e).filter(F.col("vec_id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.col("n").desc(), "dim").limit(1)
    return rows.join(F.broadcast(common.select("dim")), F.size("embedding") == F.col("dim")).drop("dim")


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Directions of distinct vectors among those with the smallest hash of the vec_id."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "embedding").limit(4 * pivots).collect()
    seen: dict[bytes, np.ndarray] = {}
    for r in sample:
        v = np.array(r.embedding, dtype=np.float64)
        seen.setdefault((v / np.linalg.norm(v)).astype(np.float32).tobytes(), v)
    return unit(np.array(list(seen.values())[:pivots]))


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first; ties to the smaller number."""
    near = np.round(unit(vectors) @ pivots.T, 9)
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def build_block(ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray) -> dict:
    """A block: its rows by vec_id, its longest rows, and the inverted file of every pivot."""
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    order = orders(vectors, pivots)
    pivot, row = order.ravel(), np.repeat(np.arange(len(ids)), order.shape[1])
    place = np.tile(np.arange(order.shape[1]), len(ids))
    grouped = np.argsort(pivot, kind="stable")
    present, starts = np.unique(pivot[grouped], return_index=True)
    files = [{"pivot": int(p), "rows": row[part].astype("<u2").tobytes(), "places": place[part].astype("<u2").tobytes()}
             for p, part in zip(present, np.split(grouped, starts[1:]))]
    longest = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")[:LONGEST]
    return {"n": len(ids), "dim": vectors.shape[1], "ids": ids.astype("<i8").tobytes(), "files": files,
            "vectors": vectors.astype("<f8").tobytes(), "long": longest.astype("<u2").tobytes()}


def build_index(rows: DataFrame, pivots: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block; rows are dealt evenly, about a block to a task."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    dealt = rows.repartition(max(1, -(-rows.count() // block_rows)), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = np.zeros(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            own = _matrix(b.column("embedding"))
            ids = np.concatenate([ids, b.column("vec_id").to_numpy()])
            vectors = own if vectors is None else np.concatenate([vectors, own])
            while len(ids) >= block_rows:
                yield _one_row(build_block(ids[:block_rows], vectors[:block_rows], sent.value))
                ids, vectors = ids[block_rows:], vectors[block_rows:]
        if len(ids):
            yield _one_row(build_block(ids, vectors, sent.value))

    return materialise(dealt.mapInArrow(run, BLOCK), "permutation_index")


_FILE = pa.struct([("pivot", pa.int32()), ("rows", pa.binary()), ("places", pa.binary())])
_ROW = pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()),
                  ("files", pa.list_(_FILE)), ("long", pa.binary())])


def _one_row(block: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([block], schema=_ROW)


def query_blocks(queries: DataFrame, rows: int = QUERY_ROWS) -> DataFrame:
    """(q_ids, q_vectors): full blocks of queries; every index block is copied once for each of them."""
    def block(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                                           pa.array([vectors.astype("<f8").tobytes()], pa.binary())], ["q_ids", "q_vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = np.zeros(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            own = _matrix(b.column("embedding"))
            ids = np.concatenate([ids, b.column("vec_id").to_numpy()])
            vectors = own if vectors is None else np.concatenate([vectors, own])
            while len(ids) >= rows:
                yield block(ids[:rows], vectors[:rows])
                ids, vectors = ids[rows:], vectors[rows:]
        if len(ids):
            yield block(ids, vectors)

    dealt = queries.repartition(max(1, -(-queries.count() // rows)), "vec_id")
    return materialise(dealt.mapInArrow(run, "q_ids binary, q_vectors binary"), "query_blocks")


def nearest_orders(order: np.ndarray, files: dict[int, tuple[np.ndarray, np.ndarray]], n: int, keep: int,
                   prefix: int, lengths: np.ndarray | None = None, pivots: int = PIVOTS) -> np.ndarray:
    """Rows of a block by footrule distance from a query's order; ties to the smaller vec_id.

    Two orders without a common pivot are ``prefix * (prefix + 1)`` apart; a pivot at
    places a and b shortens that by twice ``prefix - max(a, b)``.  Orders tell directions only:
    with ``lengths``, how much nearer than by chance a row lies counts by its length, as an
    inner product does."""
    if keep >= n:
        return np.arange(n)
    nearer = np.zeros(n, dtype=np.int64)
    for a, pivot in enumerate(order):
        if pivot in files:
            rows, places = files[pivot]
            nearer[rows] += prefix - np.maximum(places, a)
    if lengths is not None:
        # what orders drawn at random have in common counts as no nearness; copies of a vector count once
        key = (prefix ** 3 / (3 * pivots) - nearer) * lengths
        distinct = np.unique(key)
        return np.nonzero(key <= distinct[min(keep, len(distinct)) - 1])[0]
    key = -nearer
    last = np.partition(key, keep - 1)[keep - 1]
    sure = np.nonzero(key < last)[0]
    return np.concatenate([sure, np.nonzero(key == last)[0][:keep - len(sure)]])


def search_block(q_ids: np.ndarray, q_vectors: np.ndarray, block: dict, pivots: np.ndarray,
                 k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): the block's best rows of each query."""
    n = block["n"]
    ids = np.frombuffer(block["ids"], "<i8")
    vectors = np.frombuffer(block["vectors"], "<f8").reshape(n, block["dim"])
    files = {f["pivot"]: (np.frombuffer(f["rows"], "<u2"), np.frombuffer(f["places"], "<u2").astype(np.int64))
             for f in block["files"]}
    longest = np.frombuffer(block["long"], "<u2")
    lengths = np.linalg.norm(vectors, axis=1)
    keep = min(n, max(LEAST, int(np.ceil(n * RERANKED))))
    found = []
    for q, v, order in zip(q_ids, q_vectors, orders(q_vectors, pivots)):
        chosen = np.zeros(n, dtype=bool)
        chosen[nearest_orders(order, files, n, keep, len(order), lengths, len(pivots))] = True
        chosen[longest] = True
        near = np.nonzero(chosen & (ids != q))[0]
        scores = vectors[near] @ v
        best = np.lexsort((ids[near], -scores))[:k]
        found.append((np.full(len(best), q), ids[near][best], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def search(index: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query (vec_id, embedding).

    Blocks meet on a pair of hash values, one for each side's number of blocks: every
    pair of blocks meets once, and pairs are dealt over all tasks."""
    asked = query_blocks(queries)
    across, down = max(1, index.count()), max(1, asked.count())

    def group(key: Column, of: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(of)).cast("int")

    left = (index.withColumn("g", group(F.col("ids"), across))
            .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))))
    right = (asked.withColumn("h", group(F.col("q_ids"), down))
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))))
    meetings = left.join(right.hint("merge"), ["g", "h"])
    sent = index.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_ids = np.frombuffer(r["q_ids"], "<i8")
                q_vectors = np.frombuffer(r["q_vectors"], "<f8").reshape(len(q_ids), r["dim"])
                out = search_block(q_ids, q_vectors, r, sent.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    with arrow_rows(index.sparkSession, 1):  # one meeting at a time
        found = materialise(meetings.select("n", "dim", "ids", "vectors", "files", "long", "q_ids", "q_vectors").mapInArrow(
            run, "query_id long, vec_id long, score double"), "block_bests")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def permutation_search(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """The k nearest rows found for every row whose vec_id is divisible by ``every``."""
    rows = materialise(usable(vectors), "vectors")
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = choose_pivots(rows)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search(build_index(rows, pivots), asked, pivots, k)


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_permutation_index": op6_permutation_index}
