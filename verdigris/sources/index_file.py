"""Interchange files of a quantized index: a header, bit planes of the codes, scales, and ids where there are any."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigris.functions.quantizer import pack_planes, unpack_planes
from verdigris.session import ship

PLAIN, KEYED, VERSION = b"TVPI", b"TVIM", 2


def dumps(codes: np.ndarray, scales: np.ndarray, bits: int, ids: np.ndarray | None = None) -> bytes:
    n, dim = codes.shape
    if dim % 8:
        raise ValueError("the dimension must be divisible by 8")
    if ids is not None and (len(ids) != n or len(np.unique(ids)) != n):
        raise ValueError("one distinct id is needed for each row")
    head = (PLAIN if ids is None else KEYED) + struct.pack("<BBII", VERSION, bits, dim, n)
    return head + pack_planes(codes.astype(np.uint8), bits).tobytes() + scales.astype("<f4").tobytes() + (b"" if ids is None else ids.astype("<u8").tobytes())


def loads(raw: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray | None]:
    """Codes, scales, bits and ids (None for a plain index)."""
    if len(raw) and 2 <= raw[0] <= 4:
        raise ValueError("an index of the first version: build it again")
    if raw[:4] not in (PLAIN, KEYED):
        raise ValueError("not an index file")
    if raw[4] != VERSION:
        raise ValueError(f"index version {raw[4]} is not supported")
    bits, dim, n = struct.unpack_from("<BII", raw, 5)
    if dim % 8:
        raise ValueError("the dimension must be divisible by 8")
    at, size = 14, n * dim // 8 * bits
    if len(raw) < at + size + 4 * n + (8 * n if raw[:4] == KEYED else 0):
        raise ValueError("the index file is cut short")
    codes = unpack_planes(np.frombuffer(raw, np.uint8, size, at).reshape(n, -1), bits, dim)
    scales = np.frombuffer(raw, "<f4", n, at + size)
    ids = np.frombuffer(raw, "<u8", n, at + size + 4 * n) if raw[:4] == KEYED else None
    if ids is not None and len(np.unique(ids)) != n:
        raise ValueError("the index file repeats an id")
    return codes, scales, bits, ids


def index_files(codes: DataFrame, bits: int, per_file: int = 100_000) -> DataFrame:
    """``n, content``: encoded rows (vec_id, codes, scale) as keyed index files of up to ``per_file`` rows; no shuffle."""
    ship(codes.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def file() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            flat = rows.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            raw = dumps(flat.reshape(rows.num_rows, -1), rows.column("scale").to_numpy(), bits, rows.column("vec_id").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64()), pa.array([raw], pa.binary())], ["n", "content"])

        for b in batches:
            for at in range(0, b.num_rows, per_file):
                part = b.slice(at, per_file)
                if sum(x.num_rows for x in held) + part.num_rows > per_file and held:
                    yield file()
                    held.clear()
                held.append(part)
        if held:
            yield file()

    return codes.select("vec_id", "codes", "scale").mapInArrow(work, "n long, content binary")


def read_index_files(files: DataFrame, content: str = "content") -> DataFrame:
    """``vec_id, codes, scale, bits`` of index files in a binary column; rows of a plain index are named by their place."""
    ship(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                codes, scales, bits, ids = loads(raw)
                ids = np.arange(len(codes)) if ids is None else ids
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, max(1, codes.shape[1]), dtype=np.int32)), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), lists, pa.array(scales.astype(np.float64)), pa.array(np.full(len(codes), bits, np.int32))], ["vec_id", "codes", "scale", "bits"])

    return files.select(content).mapInArrow(work, "vec_id long, codes array<tinyint>, scale double, bits int")
