"""Similarity search over embedding columns: exact and quantized top-k, masks, allow-lists, deletes, metrics.

A search is one pass over the data for a block of queries: each task scores its batches against the block by matrix
products and keeps its own k best, so only queries x k x tasks rows are shuffled to the final ranking. A block holds
queries of ``BLOCK_BYTES`` at most, with what a task keeps for each of them; more queries make more passes. Scores are
made for tiles of ``TILE`` rows x queries, so a task's memory doesn't grow with the number of rows or queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions import quantizer as Q
from verdigris.session import ship

BLOCK_BYTES = 32 << 20
TILE = 1 << 19
PARTIAL = "query_id long, vec_id long, score double"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows; lists of unequal lengths, null lists and null elements are errors."""
    if not len(column):
        return np.zeros((0, 0))
    size = pc.list_value_length(column)
    if size.null_count or len(pc.unique(size)) > 1:
        raise ValueError("vectors of different dimensions, or none")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a null element")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(queries: DataFrame, k: int, kept: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, in blocks of bounded size. ``kept``: bytes that a task keeps for each coordinate of a query, besides its k best."""
    n, width = queries.select(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, min(n, -(-n * (width * (8 + kept) + 16 * k) // BLOCK_BYTES)))
    for b in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = own.select("query_id", "embedding").orderBy("query_id").toArrow()
        if rows.num_rows:
            yield rows.column(0).to_numpy(), matrix(rows.column(1).combine_chunks()).astype(np.float64)


def _shape(n_queries: int, k: int) -> tuple[int, int]:
    """Rows and queries of a tile: 256 to 4,096 rows, as many as k within that, so that merging into the k best stays cheap."""
    rows = min(4096, max(256, k, TILE // max(1, n_queries)))
    return rows, max(1, min(n_queries, TILE // max(rows, k)))


class _Best:
    """A task's k best rows for each query so far; of equal scores the smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.ids, self.scores = k, np.zeros((0, n_queries), np.int64), np.zeros((0, n_queries))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: rows x queries. Only scores that reach the k-th best so far, before they are rounded, are merged."""
        if (few := self.k - len(self.scores)) > 0:
            every = np.broadcast_to(ids[:few, None], scores[:few].shape)
            self.ids, self.scores = self._merged(self.ids, self.scores, every, _rounded(scores[:few]))
            ids, scores = ids[few:], scores[few:]
        if not len(ids):
            return
        last = self.scores[-1]
        row, query = np.nonzero(~(scores < last - 1e-6 - 1e-12 * np.abs(last)))
        if not len(row):
            return
        order = np.argsort(query, kind="stable")
        row, query = row[order], query[order]
        some, begin, count = np.unique(query, return_index=True, return_counts=True)
        # the queries' new rows one below the other, filled up with what can't be among the best
        new_ids = np.full((count.max(), len(some)), np.iinfo(np.int64).max)
        new = np.full(new_ids.shape, -np.inf)
        at = np.arange(len(row)) - np.repeat(begin, count), np.repeat(np.arange(len(some)), count)
        new_ids[at], new[at] = ids[row], _rounded(scores[row, query])
        self.ids[:, some], self.scores[:, some] = self._merged(self.ids[:, some], self.scores[:, some], new_ids, new)

    def _merged(self, ids: np.ndarray, scores: np.ndarray, more_ids: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more])
        top = np.lexsort((ids, -scores, ~np.isnan(scores)), axis=0)[: self.k]
        return np.take_along_axis(ids, top, 0), np.take_along_axis(scores, top, 0)

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        columns = (np.repeat(query_ids, len(self.ids)), self.ids.T.reshape(-1), self.scores.T.reshape(-1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, 6) + 0.0


def _ranked(partials: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partials.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _check_k(k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")


def _search(data: DataFrame, queries: DataFrame, k: int, read: Callable, prepare: Callable, kept: int = 0) -> DataFrame:
    """``read(batch)`` gives what is scored of some rows; ``prepare(query vectors)``, once for each tile of queries, a function of it with scores, rows x queries."""
    _check_k(k)
    spark = data.sparkSession
    ship(spark)
    out = spark.createDataFrame([], PARTIAL)
    if k == 0:
        return _ranked(out, 0)
    for ids, vectors in _blocks(queries, k, kept):

        def work(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
            height, width = _shape(len(ids), k)
            tiles = []
            for b in batches:
                for at in range(0, b.num_rows, height):
                    part = b.slice(at, height)
                    own, found = part.column("vec_id").to_numpy(), read(part)
                    if not tiles:
                        tiles = [(ids[q : q + width], prepare(vectors[q : q + width]), _Best(len(ids[q : q + width]), k)) for q in range(0, len(ids), width)]
                    for _, score, best in tiles:
                        best.add(own, score(found))
            for own, _, best in tiles:
                yield best.rows(own)

        out = out.union(data.mapInArrow(work, PARTIAL))
    return _ranked(out, k)


def top_k(data: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact inner-product top-k: ``query_id, rank, vec_id, score`` (rounded to 6; ties by vec_id)."""
    return _search(data.select("vec_id", "embedding").filter("embedding is not null"), queries, k, lambda b: matrix(b.column("embedding")).astype(np.float64), lambda q: lambda v: v @ q.T)


def encode(data: DataFrame, bits: int = 4) -> DataFrame:
    """Append ``codes`` (one small integer a coordinate) and ``scale`` in one pass; no shuffle."""
    ship(data.sparkSession)
    if bits not in (2, 3, 4):
        raise ValueError("bits must be 2, 3 or 4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("embedding"))
            if v.size and v.shape[1] % 8:
                raise ValueError("the dimension must be divisible by 8")
            codes, scale = Q.encode(v, bits) if v.size else (np.zeros((0, 8), np.int8), np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, max(1, codes.shape[1]), dtype=np.int32)), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists, pa.array(scale)], ["vec_id", "codes", "scale"])

    return data.select("vec_id", "embedding").filter("embedding is not null").mapInArrow(work, "vec_id long, codes array<tinyint>, scale double")


def top_k_quantized(codes: DataFrame, queries: DataFrame, bits: int = 4, k: int = 10, lut: bool = False) -> DataFrame:
    """Top-k over codes: the original vectors aren't read. ``lut``: with 8-bit look-up tables."""

    def coded(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return matrix(b.column("codes")), b.column("scale").to_numpy()[:, None]

    def near(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        c, scale = coded(b)
        return Q.codebook(bits, c.shape[1])[1].astype(np.float64)[c], scale

    def product(q: np.ndarray) -> Callable:
        rotated = q @ Q.rotation(q.shape[1]).astype(np.float64).T
        return lambda found: found[0] @ rotated.T * found[1]

    def looked_up(q: np.ndarray) -> Callable:
        some = max(1, TILE // (q.shape[1] << bits))
        t, step, bias = (np.concatenate(x) for x in zip(*(Q.tables(q[a : a + some], bits) for a in range(0, len(q), some)), strict=True))
        # sums of 257 entries fit 16 bits
        t = np.ascontiguousarray(t.transpose(1, 2, 0), dtype=np.uint16 if q.shape[1] <= 257 else np.uint32)

        def score(found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
            c, scale = found
            total = np.zeros((len(c), len(q)), t.dtype)
            for levels, column in zip(t, c.T, strict=True):
                total += levels[column]
            return (total * step + bias) * scale

        return score

    if lut:
        return _search(codes, queries, k, coded, looked_up, kept=4 << bits)
    return _search(codes, queries, k, near, product, kept=8)


def allowed(data: DataFrame, allow: DataFrame) -> DataFrame:
    """Rows with an id in the allow-list (a left-semi join)."""
    return data.join(allow.select("vec_id").distinct(), "vec_id", "left_semi")


def check_allow_list(data: DataFrame, allow: DataFrame) -> None:
    """An empty list, or one with unknown ids, is an error."""
    if allow.isEmpty():
        raise ValueError("the allow-list is empty")
    if not allow.join(data.select("vec_id"), "vec_id", "left_anti").isEmpty():
        raise ValueError("the allow-list has unknown ids")


def add_with_ids(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's rows by id with the reason they can't be added, or null: repeated in the batch, or there already."""
    counted = batch.groupBy("vec_id").agg(F.count(F.lit(1)).alias("copies"))
    there = index.select("vec_id", F.lit(True).alias("there")).dropDuplicates(["vec_id"])
    reason = F.when(F.col("copies") > 1, "duplicate in batch").when(F.col("there"), "already present")
    return counted.join(there, "vec_id", "left").select("vec_id", "copies", reason.alias("rejected"))


def remove(data: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without the given ids."""
    return data.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")


def swap_remove(slots: DataFrame, slot: int) -> DataFrame:
    """``slot, vec_id`` after the last slot's row has moved into the removed one."""
    last = slots.agg(F.max("slot")).first()[0]
    return slots.filter(F.col("slot") != slot).select(F.when(F.col("slot") == last, F.lit(slot)).otherwise(F.col("slot")).cast("long").alias("slot"), "vec_id")


def block_skip(data: DataFrame, mask, block: int = 32) -> DataFrame:
    """Allowed rows by block of ``block`` slots; blocks with none are skipped by a scan."""
    return data.groupBy(F.floor(F.col("vec_id") / block).alias("block")).agg(F.count_if(mask).alias("n_allowed"), F.count(F.lit(1)).alias("n_rows")).withColumn("skipped", F.col("n_allowed") == 0)


def norms(data: DataFrame) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return data.select("vec_id", F.round(F.sqrt(squares), 6).alias("norm"))


def recall(exact: DataFrame, approximate: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, hits, recall`` of the exact neighbours that were found."""
    hit = approximate.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.round(F.count("hit") / F.lit(float(k)), 6).alias("recall"))


def distortion(data: DataFrame, bits: int) -> DataFrame:
    """Mean squared error times the dimension of rotated unit vectors under the codebook, and the mean self score."""
    ship(data.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("embedding")).astype(np.float64)
            if not v.size:
                continue
            norm = np.sqrt((v * v).sum(1))
            unit = v / np.maximum(norm, 1e-10)[:, None]
            rotated = unit @ Q.rotation(v.shape[1]).astype(np.float64).T
            codes, scale = Q.encode(v, bits)
            near = Q.codebook(bits, v.shape[1])[1].astype(np.float64)[codes]
            yield pa.RecordBatch.from_arrays([pa.array([float(((rotated - near) ** 2).sum())]), pa.array([float((scale * (rotated * near).sum(1) * norm / np.maximum(norm**2, 1e-20)).sum())]), pa.array([len(v)])], ["se", "own", "n"])

    sums = data.select("embedding").filter("embedding is not null").mapInArrow(work, "se double, own double, n long")
    return sums.agg(F.round(F.sum("se") / F.sum("n"), 6).alias("mse_x_dim"), F.round(F.sum("own") / F.sum("n"), 6).alias("self_score"), F.sum("n").alias("n"))
