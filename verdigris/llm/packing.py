"""Operator 8: hierarchical best-fit packing of token sequences.

Every document becomes its ids and a final id; only one longer than the capacity is cut, into pieces of the capacity.
Partitions pack their pieces best-fit (longest first, into the fullest bin with room). Bins filled to at least ``full``
of the capacity are done. The rest become items of their own: groups of ``fan_in`` partitions' underfull bins are
packed best-fit again, and so on up a tree until one group is left. A group holds about ``most`` bins and ``most_pieces``
pieces at most, so no task gets an unbounded share however much is left over; where that leaves several groups at the
top, rounds with other neighbours follow until one saves less than a bin in a thousand.

Null and empty texts are one piece holding the final id alone. Repeated rows are packed each by itself; ties in
length go by document and piece. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import text as T
from verdigris.llm.tokenizer import PieceCache, cache, default_path
from verdigris.session import load, local_arrow_rows, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ROWS = PIECES + ", bin long, offset long, fill long"


def text_ids(batch: pa.RecordBatch, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and each text's n + 1 offsets among them."""
    text = pc.fill_null(batch.column("text").cast(pa.string()), "")
    data, offsets = T.buffers(text)
    w = T.words(data, offsets, T.SPACED, fold=False)
    pieces: PieceCache = cache(path, True)
    raw = data.tobytes()
    start, count = pieces.find(w.hash, lambda i: raw[w.start[i] : w.end[i]].decode()) if len(w.hash) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    ends = np.cumsum(count, dtype=np.int64)
    ids = pieces.pool[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
    return ids, np.concatenate([[0], ends])[w.at]


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document with the checksum of their ids; no shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = text_ids(batch, path)
        doc, piece, start, length, crc = [], [], [], [], []
        for d, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            own = np.append(ids[a:b], end_id).astype("<u4")
            for k, s in enumerate(range(0, len(own), capacity)):
                part = own[s : s + capacity]
                doc.append(d)
                piece.append(k)
                start.append(s)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(T.scan(work), PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, items taken in the order given: the fullest bin with room, else a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        if room > s:
            if not by_room[room - s]:
                mask |= 1 << (room - s)
            by_room[room - s].append(b)
    return out


def pack(items: pd.DataFrame, capacity: int, first: int) -> pd.DataFrame:
    """Best-fit of the bins in ``items`` (rows of pieces with bin, offset and fill) into bins numbered from ``first``."""
    old = items.drop_duplicates("bin")[["bin", "fill"]].sort_values(["fill", "bin"], ascending=[False, True])
    new = best_fit(old["fill"].to_numpy(), capacity)
    base = old["fill"].groupby(new).cumsum().to_numpy() - old["fill"].to_numpy()
    fill = np.bincount(new, old["fill"].to_numpy()).astype(np.int64) if len(new) else np.zeros(0, np.int64)
    at = pd.Series(np.arange(len(old)), index=old["bin"].to_numpy())[items["bin"]].to_numpy()
    return items.assign(bin=first + new[at], offset=items["offset"].to_numpy() + base[at], fill=fill[new[at]])


def _repack(capacity: int, tag: int):
    def again(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        return pack(items, capacity, tag + (int(key[0]) << 20))[["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]]

    return again


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, full: float = 0.995, fan_in: int = 8, most: int = 200_000, most_pieces: int = 1_000_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    local_arrow_rows(spark)
    pieces = materialize(pieces_of(docs, path or default_path("word_bpe_49k.json"), capacity, end_id), "pieces")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, part, run = [], TaskContext.get().partitionId(), 0
        held = 0

        def packed() -> pd.DataFrame:
            rows = pd.concat(items, ignore_index=True).sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
            rows = rows.assign(bin=np.arange(len(rows)), offset=0, fill=rows["length"])
            return pack(rows, capacity, (part << 32) + (run << 20))

        for b in batches:
            items.append(b)
            held += len(b)
            if held >= most:
                yield packed()
                items, held, run = [], 0, run + 1
        if held:
            yield packed()

    need = int(full * capacity)
    rows = materialize(pieces.mapInPandas(local, ROWS), "packed")
    done = [rows.filter(F.col("fill") >= need)]
    rest = rows.filter(F.col("fill") < need)
    groups, level = max(1, rows.rdd.getNumPartitions()), 0
    bins, n = rest.select(F.count_distinct("bin"), F.count(F.lit(1))).first()
    while bins > 1:
        level += 1
        least = max(-(-bins // most), -(-n // most_pieces))
        top = groups <= least * fan_in
        groups = max(-(-groups // fan_in), least)
        keyed = rest.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        rows = materialize(keyed.groupBy("g").applyInPandas(_repack(capacity, level << 56), ROWS), "packed")
        after = rows.select(F.count_distinct("bin")).first()[0]
        done.append(rows.filter(F.col("fill") >= need))
        rest = rows.filter(F.col("fill") < need)
        if groups == 1 or top and after > 0.999 * bins:
            break
        bins, n = rest.select(F.count_distinct("bin"), F.count(F.lit(1))).first()
    out = rest
    for d in done:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"))
