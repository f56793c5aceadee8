"""Exact top-k search by tiled matrix products.

Vectors are packed into tiles of a fixed number of rows where they are read, queries
into blocks. A round broadcasts as many blocks as its bound of bytes allows, and
every tile meets each of them once, as one matrix product, so vectors are neither
shuffled nor sorted: a round reads them once. From each product only k scores a query
are selected, and a task folds the lists of the tiles it reads before it passes any
on. The lists then merge as a tree: by groups of tasks, then by query. What moves is
bounded by queries x tasks x k, never by queries x rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a tile and of a block of queries (with 64 dimensions 1 MB and 0.5 MB).
TILE_ROWS = 2048
BLOCK_QUERIES = 1024

#: Bytes of the blocks that one round broadcasts at most (a single block may exceed them: its rows are fixed).
ROUND_BYTES = 64 << 20

PACKED = "dim int, ids binary, data binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of x as double; vectors null or with null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(vector_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _pack(rows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def tile(dim: int, got: list) -> pd.DataFrame:
            return pd.DataFrame({"dim": [dim], "ids": [np.array([i for i, _ in got], "<i8").tobytes()], "data": [np.concatenate([v for _, v in got]).astype("<i8").tobytes()]})

        for b in batches:
            for i, v in zip(b["vec_id"], b["v"], strict=True):
                got = held.setdefault(len(v), [])
                got.append((i, np.asarray(v, np.int64)))
                if len(got) == rows:
                    yield tile(len(v), held.pop(len(v)))
        for dim, got in held.items():
            yield tile(dim, got)

    return pack


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by floating point where every partial sum stays under 2^53."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def select(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of `scores`, ties to the smaller id; short rows keep all. -2^63 marks what is no candidate."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k] if scores.shape[1] <= 4 * k else None
    if order is None:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        width = int((scores >= cut[:, None]).sum(1).max())  # over k only where scores tie at the cut
        near = np.argsort(~(scores >= cut[:, None]), axis=1, kind="stable")[:, :width]
        sub, sub_ids = np.take_along_axis(scores, near, 1), np.broadcast_to(ids, scores.shape)[np.arange(len(scores))[:, None], near]
        best = np.lexsort((sub_ids, -sub), axis=1)[:, :k]
        return np.take_along_axis(sub_ids, best, 1), np.take_along_axis(sub, best, 1)
    return np.take_along_axis(np.broadcast_to(ids, scores.shape), order, 1), np.take_along_axis(scores, order, 1)


NONE = np.iinfo(np.int64).min + 1


def _multiply(k: int):
    """(tile, block) pairs to the k best of each query over all tiles that this task reads, block by block."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for b in batches:
            for block, dim, qi, qd, ti, td in b[["block", "dim", "q_ids", "q_data", "ids", "data"]].itertuples(index=False):
                if block not in held:
                    q_ids = np.frombuffer(qi, "<i8")
                    none = np.zeros((len(q_ids), 0), np.int64)
                    held[block] = q_ids, np.frombuffer(qd, "<i8").reshape(len(q_ids), dim), none, none
                q_ids, q, top_ids, top = held[block]
                ids = np.frombuffer(ti, "<i8")
                scores = _product(q, np.frombuffer(td, "<i8").reshape(len(ids), dim))
                scores[q_ids[:, None] == ids[None, :]] = NONE
                got_ids, got = select(ids, scores, min(k, len(ids)))
                both_ids, both = np.concatenate([top_ids, got_ids], 1), np.concatenate([top, got], 1)
                best = np.lexsort((both_ids, -both), axis=1)[:, :k]
                held[block] = q_ids, q, np.take_along_axis(both_ids, best, 1), np.take_along_axis(both, best, 1)
        for q_ids, _, top_ids, top in held.values():
            ok = top.ravel() != NONE
            yield pd.DataFrame({"query_id": np.repeat(q_ids, top.shape[1])[ok], "vec_id": top_ids.ravel()[ok], "score": top.ravel()[ok]})

    return multiply


def rounds(blocks: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Numbers of `blocks` (number, bytes) in runs of at most `most` bytes; a larger block is a run by itself."""
    out: list[list[int]] = []
    room = 0
    for number, size in blocks:
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(number)
        room -= size
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tile_rows: int = TILE_ROWS, block_queries: int = BLOCK_QUERIES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query over all `vectors` but its own id.

    Both tables hold (vec_id, v array<long>), see `quantised`; other columns are not
    read. Only vectors of the query's dimension are compared. Ties go to the smaller
    vec_id. A query with fewer candidates has fewer rows. Repeated rows of an id count
    as candidates each; a repeated query id is answered once, by its smallest vector.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    packed = queries.mapInPandas(_pack(block_queries), PACKED)
    blocks = materialise(packed.select(F.monotonically_increasing_id().alias("block"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "blocks")
    # The plan of the rounds: two numbers for each block of queries.
    sizes = [tuple(r) for r in blocks.select("block", F.length("q_ids") + F.length("q_data")).orderBy("block").collect()]
    runs = rounds(sizes, round_bytes) or [[]]
    done = [_merged(_lists(vectors, blocks.where(F.col("block").between(run[0], run[-1]) if run else F.lit(False)), k, tile_rows), k) for run in runs]
    # Rounds answer different queries; each is written before the next broadcasts.
    return done[0] if len(runs) == 1 else functools.reduce(DataFrame.unionByName, (materialise(d, "round") for d in done))


def _lists(vectors: DataFrame, blocks: DataFrame, k: int, tile_rows: int) -> DataFrame:
    """The lists that tasks found for the queries of `blocks`, which are broadcast."""
    tiles = vectors.select("vec_id", "v").mapInPandas(_pack(tile_rows), PACKED)
    pairs = tiles.join(F.broadcast(blocks), "dim").select("block", "dim", "q_ids", "q_data", "ids", "data")
    return pairs.mapInPandas(_multiply(k), "query_id long, vec_id long, score long")


def _merged(lists: DataFrame, k: int) -> DataFrame:
    by = [F.desc("score"), F.asc("vec_id")]
    branch = max(2, int(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    part = lists.withColumn("b", F.pmod(F.spark_partition_id(), F.lit(branch)))
    for keys in (["query_id", "b"], ["query_id"]):
        part = part.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)
    return part.select("query_id", "rank", "vec_id", "score")
