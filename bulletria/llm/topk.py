"""Exact top-k search by columnar branch-and-bound.

Vectors are kept in blocks in vertical layout, one array a dimension. For a
query the squared Euclidean distances to a block are accumulated a few
dimensions at a time. What the dimensions that are left can still add lies
between the squares of the difference and of the sum of the two remaining
lengths; candidates whose least possible distance exceeds the k-th best so far
are dropped, and the survivors compacted, before the next dimensions are read
(de Vries et al., BOND, SIGMOD 2002). Survivors of all dimensions get their
distance again in double precision, so rounding decides nothing.

Queries are a table of their own (without one, the vectors themselves). They are
packed into blocks too, and each block of queries meets each block of vectors of
its length: work grows with the product of both, as an exact answer takes.

Defined results: rows with a null vec_id, a null or empty embedding, or one with
a null, NaN or infinite element are left out, of queries as of vectors. Of
several rows with one vec_id the one with the least embedding counts. Vectors
are compared with those of their own length only, however long. A vector isn't
its own neighbour, told by its vec_id; equal distances go to the smaller vec_id;
with fewer than k others there are fewer neighbours. No vectors or no queries
give no rows. Columns other than vec_id and embedding aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 10
BLOCK_ROWS = 8_192
QUERY_ROWS = 1_024
STEP = 8
SEEDS = 512  # rows of a block that give a query its first bound
SPARSE = 0.25  # share of survivors under which they are compacted
_BATCH = 64
_SLACK = 1e-4  # more than single precision can be off, relative to the lengths
_BLOCK_DDL = "dim int, block int, ids binary, columns binary"


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the valid rows, each vec_id once."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = own.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    return valid.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Block:
    """Vectors in vertical layout, with the length that is left after each step."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.columns = np.ascontiguousarray(x.T, np.float32)
        dim = x.shape[1]
        self.edges = [*range(0, dim, STEP), dim]
        power = np.cumsum(np.r_[np.zeros((1, len(ids))), (x.T**2)[::-1]], axis=0)[::-1]
        self.rest = np.sqrt(power[self.edges]).astype(np.float32)
        self.power = -np.diff(power[self.edges], axis=0).astype(np.float32)


def search(queries: Block, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, block row, squared distance) of up to k neighbours a query."""
    out_q, out_x, out_d = [], [], []
    n, edges = len(block.ids), block.edges
    slack = _SLACK * float((queries.rest[0] ** 2).max(initial=0) + (block.rest[0] ** 2).max(initial=0))
    rows = np.arange(n)
    for a in range(0, len(queries.ids), _BATCH):
        part = slice(a, min(a + _BATCH, len(queries.ids)))
        limit = np.full(part.stop - part.start, np.inf)
        if n > k + 1:
            some = slice(0, max(SEEDS, k + 1))
            near = queries.rest[0, part][:, None] ** 2 + block.rest[0, some][None, :] ** 2 - 2 * queries.columns[:, part].T @ block.columns[:, some]
            seed = np.partition(near, k, axis=1)[:, k] + slack if near.shape[1] > k else limit  # the query itself may be among them
            limit = np.minimum(limit, seed)
        fence = (limit + slack).astype(np.float32)[:, None]
        sums = np.zeros((part.stop - part.start, n), np.float32)
        for dense in range(1, len(edges)):  # the first dimensions leave most candidates: all of a batch's are accumulated at once
            cols = slice(edges[dense - 1], edges[dense])
            sums += queries.power[dense - 1, part][:, None] + block.power[dense - 1][None, :] - 2 * queries.columns[cols, part].T @ block.columns[cols]
            gap = queries.rest[dense, part][:, None] - block.rest[dense][None, :]
            alive = sums + gap * gap <= fence
            if np.count_nonzero(alive) < SPARSE * alive.size:
                break
        for i in range(part.stop - part.start):
            q, bound = a + i, float(limit[i])
            live = rows[alive[i]]
            total = np.maximum(sums[i][live], 0)
            for j in range(dense, len(edges) - 1):
                if not len(live):
                    break
                cols = slice(edges[j], edges[j + 1])
                diff = block.columns[cols, live] - queries.columns[cols, q][:, None]
                total = total + np.einsum("ij,ij->j", diff, diff)
                left = block.rest[j + 1, live]
                if len(live) > k + 1:
                    most = total + (queries.rest[j + 1, q] + left) ** 2
                    bound = min(bound, float(np.partition(most, k)[k]))
                low = total + (queries.rest[j + 1, q] - left) ** 2
                stay = low <= bound + slack
                live, total = live[stay], total[stay]
            live = live[block.ids[live] != queries.ids[q]]
            diff = block.x[live] - queries.x[q]
            exact = (diff * diff).sum(1)
            order = np.lexsort((block.ids[live], exact))[:k]
            out_q.append(np.full(len(order), q))
            out_x.append(live[order])
            out_d.append(exact[order])
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)


def _pack(group: pa.Table) -> pa.Table:
    """Vectors of one length and block as one row."""
    dim, number = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
    ids, x = group.column("vec_id").to_numpy(), matrix(group.column("embedding"), dim)
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "block": pa.array([number], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "columns": pa.array([x.tobytes()], pa.binary()),
        }
    )


def _packed(own: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Blocks of about so many vectors, and their number for each length."""
    blocks = max(1, -(-own.count() // rows))
    placed = own.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    return materialize(placed.groupBy("dim", "block").applyInArrow(_pack, _BLOCK_DDL)), blocks


def _block(row: dict, side: str) -> Block:
    return Block(np.frombuffer(row[f"{side}ids"], "<i8"), np.frombuffer(row[f"{side}columns"], "<f8").reshape(-1, row["dim"]))


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                queries, block = _block(row, "q_"), _block(row, "x_")
                q, x, d = search(queries, block, k)
                yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(block.ids[x]), pa.array(d)], names=["query_id", "vec_id", "distance"])

    return run


def best_k(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k nearest of each query."""
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def exact_top_k(embeddings: DataFrame, k: int = K, queries: DataFrame | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest others of each query, by squared Euclidean distance.

    queries: (vec_id, embedding), every vector without it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    right, blocks = _packed(vectors(embeddings), block_rows)
    left, _ = _packed(vectors(embeddings if queries is None else queries), query_rows)
    left = left.select("dim", F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"))
    right = right.repartition(blocks, "block").select(F.col("dim").alias("x_dim"), F.col("ids").alias("x_ids"), F.col("columns").alias("x_columns"))
    same = F.least("dim", "x_dim") == F.greatest("dim", "x_dim")  # no equi-join: blocks of one length must not meet in one task
    pairs = left.hint("shuffle_replicate_nl").join(right, same).drop("x_dim")
    return best_k(pairs.mapInArrow(_pairs(k), "query_id long, vec_id long, distance double"), k)
