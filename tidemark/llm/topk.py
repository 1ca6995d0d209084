"""Exact top-k search by tiled matrix products.

Candidates are packed into tiles (ids and one matrix, bounded by rows and bytes),
queries into blocks. Each block meets each tile once: a matrix product, then the
best k of each query in that tile; a task keeps one running list for each query
over its tiles, and the lists of all tasks are merged in a tree, FAN of them at
a time. A block's tiles are dealt over SALTS tasks or more.

Vectors that are null, or hold null or non-finite components, take no part.
Vectors are compared with those of their own length only, whatever that is. Ties
go to the smaller id; ids that occur more than once (repeated rows) are
candidates each. Null ids take no part. An empty table gives an empty result.
Columns other than the two are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Most rows of a block and of a tile, and most bytes of either.
BLOCK = 4096
TILE = 4096
TILE_BYTES = 8 << 20
#: Tasks over which a block's tiles are dealt at least; lists that are merged at a time.
SALTS, FAN = 8, 16


def usable(vectors: DataFrame, row_id: str, column: str, scale: float) -> DataFrame:
    """_id, _v (floor(scale * x) as double) of vectors with finite components only."""
    v = F.col(column)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(F.col(row_id).isNotNull() & v.isNotNull() & whole)
    return kept.select(F.col(row_id).cast("long").alias("_id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")).alias("_v"))


def tiles(vectors: DataFrame, rows: int) -> DataFrame:
    """Tiles of up to so many vectors of one length, by ascending id: dim, ids and matrix as bytes. No shuffle: a tile holds rows of one task."""

    def most(dim):
        return max(1, min(rows, TILE_BYTES // (8 * max(1, dim))))

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            ids = np.concatenate([x[0] for x in held[dim]])
            flat = np.concatenate([x[1] for x in held[dim]])
            del held[dim]
            by = np.argsort(ids, kind="stable")
            ids, flat = ids[by], flat.reshape(len(ids), dim)[by].ravel()
            size = most(dim)
            for k in range(0, len(ids), size):
                n = len(ids[k : k + size])
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[k : k + size].tobytes()], pa.binary()), pa.array([flat[k * dim : (k + n) * dim].tobytes()], pa.binary())], ["dim", "ids", "matrix"])

        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            ids, values = batch.column(0).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                block = values if len(at) == len(sizes) else np.concatenate([values[begins[i] : begins[i] + dim] for i in at])
                held.setdefault(int(dim), []).append((ids[at], block))
                if sum(len(x[0]) for x in held[int(dim)]) >= most(int(dim)):
                    yield from out(int(dim))
        for dim in list(held):
            yield from out(dim)

    return vectors.mapInArrow(run, "dim int, ids binary, matrix binary")


_NONE = np.iinfo(np.int64).min


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: higher score first, then smaller id."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    keep = place < k
    return row[keep], score[keep], ids[keep]


def _tile(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, rows: int = 256):
    """(query's row, score, id) of the k best of each query in a tile, whose ids ascend; of those that tie with the last, the smallest ids."""
    exact = q.shape[1] * (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) < 2**53
    out = []
    for a in range(0, len(q), rows):
        part = q[a : a + rows]
        s = (part @ c.T).astype(np.int64) if exact else part.astype(np.int64) @ c.astype(np.int64).T
        s[q_ids[a : a + rows, None] == ids[None, :]] = _NONE
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), _NONE)
        best = (s >= least[:, None]) & (s > _NONE)
        many = np.flatnonzero(best.sum(axis=1) > k)
        if len(many):  # ties beyond the k-th place
            ties = s[many] == least[many, None]
            room = k - (best[many] & ~ties).sum(axis=1)
            best[many] &= ~ties | (np.cumsum(ties, axis=1) <= room[:, None])
        r, col = np.nonzero(best)
        out.append((r + a, s[r, col], ids[col]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Both have _id and _v; returns query_id, rank, vec_id, score. A query's own id is no candidate.

    Query blocks are numbered, and each candidate tile is sent to each block's
    number: the product's two inputs meet by an equi-join on (block, dim), in
    which a row is a whole tile.
    """
    blocks = tiles(queries, BLOCK).withColumn("block", F.monotonically_increasing_id())
    # a table of its own: a block keeps its number in both uses, whatever is lost between them
    blocks = cut(blocks, "query-blocks").select("block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    # one row of block numbers for each length: a number is 8 bytes for 4,096 queries
    numbers = blocks.groupBy("q_dim").agg(F.collect_list("block").alias("blocks"))
    spread = tiles(candidates, TILE).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    spread = spread.join(numbers, F.col("dim") == F.col("q_dim")).select("dim", "ids", "matrix", "salt", F.explode("blocks").alias("block"))
    salted = blocks.withColumn("salt", F.explode(F.array(*(F.lit(n).cast("long") for n in range(SALTS)))))
    pairs = spread.join(salted, ["block", "salt"]).select("block", "q_ids", "q_matrix", "ids", "matrix", "dim")

    def run(batches):
        held: dict[int, tuple] = {}  # the best of each query so far, by block
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = (np.frombuffer(r[x], np.float64).reshape(len(y), r["dim"]) for x, y in (("q_matrix", q_ids), ("matrix", ids)))
                found = _tile(q, q_ids, c, ids, k)
                if r["block"] in held:
                    found = [np.concatenate(x) for x in zip(held[r["block"]][1], found, strict=True)]
                held[r["block"]] = (q_ids, _best(*found, k))
        for q_ids, (row, score, ids) in held.values():
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    partial = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    # Merge in a tree: lists of neighbouring tasks, then lists of neighbouring groups, until one is left.
    lists, tasks = partial.withColumn("task", F.spark_partition_id()), max(partitions(partial.sparkSession), SALTS)
    while tasks > FAN:
        lists = lists.withColumn("task", F.floor(F.col("task") / FAN))
        leaf = Window.partitionBy("query_id", "task").orderBy(F.desc("score"), "vec_id")
        lists, tasks = lists.withColumn("n", F.row_number().over(leaf)).where(F.col("n") <= k).drop("n"), -(-tasks // FAN)
    root = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(root)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
