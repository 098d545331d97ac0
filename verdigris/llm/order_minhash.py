"""Operator 6: Order MinHash fingerprints, sensitive to edits and their order.

A text's k-mers (of code points) are numbered by occurrence, so that repeats are different elements. Each of ``hashes``
functions selects the ``tuple_size`` elements with the smallest values, keeps them in text order and hashes the tuple;
the share of equal tuples estimates how alike two texts are under edits. A text shorter than k is one k-mer, and
tuples are shorter where there are fewer elements; the empty text has a fingerprint of its own.

For the query each document also needs the beginning of the next one by doc_id. Documents are cut into ranges of doc_id
(from a pass over the ids alone), each range's first document is sent to the range before it as well, and ranges are
read in order with one document held back, so each text is shuffled once and no range has to fit in memory.
Null texts count as empty. Rows that repeat a doc_id follow each other in order of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.text import RUN, mix, runs
from verdigris.session import load, local_arrow_rows, ship

U = np.uint64
_POINT = np.uint64(0x9E3779B97F4A7C15)


def elements(text: str, k: int) -> np.ndarray:
    """32-bit hashes of the occurrence-numbered k-mers in text order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint32)
    k = min(k, len(points))
    with np.errstate(over="ignore"):
        h = np.zeros(len(points) - k + 1, np.uint64)
        for i in range(k):
            h *= _POINT
            h += points[i : len(points) - k + 1 + i]
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(29)
        h *= U(0x94D049BB133111EB)
    # equal k-mers in runs, by position within a run
    packed = (h >> U(32) << U(32)) | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    top = packed >> U(32)
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(top[1:], top[:-1], out=new[1:])
    if new.all():
        return (h >> U(32)).astype(np.uint32)
    place = np.arange(len(h))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    out = (h >> U(32)).astype(np.uint32)
    again = nth > 0
    at = (packed[again] & U(0xFFFFFFFF)).astype(np.int64)
    with np.errstate(over="ignore"):
        out[at] = (mix(top[again] + nth[again].astype(np.uint64) * _POINT) >> U(32)).astype(np.uint32)
    return out


class OrderMinHash:
    def __init__(self, k: int = 8, hashes: int = 48, tuple_size: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.hashes, self.size = k, hashes, tuple_size
        self.add = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def fingerprint(self, text: str) -> np.ndarray:
        """One 64-bit tuple hash for each function."""
        e = elements(text, self.k)
        n = len(e)
        out = np.zeros(self.hashes, np.uint64)
        size = min(self.size, n)
        if not n:
            return out
        step = 1 << 16
        best_v = np.full((self.hashes, 0), 0, np.uint32)
        best_i = np.zeros((self.hashes, 0), np.int64)
        with np.errstate(over="ignore"):
            for a in range(0, n, step):
                part = e[a : a + step]
                v = part[None, :] ^ self.add[:, None]
                v *= self.times[:, None]
                v ^= v >> np.uint32(15)
                v *= np.uint32(0x2C1B3C6D)
                some = []
                rows = np.arange(self.hashes)
                for _ in range(min(size, len(part))):  # the smallest, then the next smallest
                    i = v.argmin(axis=1)
                    some.append((v[rows, i].copy(), i + a))
                    v[rows, i] = 0xFFFFFFFF
                best_v = np.concatenate([best_v, np.stack([x for x, _ in some], 1)], 1)
                best_i = np.concatenate([best_i, np.stack([x for _, x in some], 1)], 1)
                if best_v.shape[1] > 64:
                    best_v, best_i = self._least(best_v, best_i, size)
            _, at = self._least(best_v, best_i, size)
            at.sort(axis=1)  # text order
            for j in range(size):
                out = mix(out * U(0xA24BAED4963EE407) + e[at[:, j]].astype(np.uint64) + U(1))
        return out

    @staticmethod
    def _least(v: np.ndarray, i: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(v, axis=1, kind="stable")[:, :size]
        return np.take_along_axis(v, order, 1), np.take_along_axis(i, order, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(f: np.ndarray) -> str:
    """The fingerprint's lowest 32 bits a function, as hex."""
    return (f & U(0xFFFFFFFF)).astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, model: OrderMinHash | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (array of longs) of every document; no shuffle."""
    model = model or OrderMinHash()
    local_arrow_rows(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            f = [model.fingerprint(t or "").view(np.int64).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f, pa.list_(pa.int64()))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fingerprint array<long>")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the following text's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _range_of(cuts: np.ndarray):
    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int32))

    return of


def _targets(firsts: np.ndarray):
    """The range of a document, and for a range's first document the range before it (else -1)."""

    @F.pandas_udf("own int, before int")
    def of(ids: pd.Series) -> pd.DataFrame:
        own = np.searchsorted(firsts, ids.to_numpy(), "right") - 1
        return pd.DataFrame({"own": own.astype(np.int32), "before": np.where(firsts[own] == ids.to_numpy(), (own - 1) % len(firsts), -1).astype(np.int32)})

    return of


def edit_likeness(docs: DataFrame, model: OrderMinHash | None = None, per_range: int = 4000, most_ranges: int = 100_000) -> DataFrame:
    """Fingerprints of every text, its edited text, and their likeness and that to the next document.

    Ranges have about ``per_range`` documents each, more where that would make over ``most_ranges``.
    """
    spark = docs.sparkSession
    ship(spark)
    local_arrow_rows(spark, 500)
    model = model or OrderMinHash()
    docs = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "doc_id", "text")
    ids = docs.select("id")
    ranges = max(1, min(ids.count() // per_range, most_ranges))
    cuts = np.unique(np.array(ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else [], np.int64))
    # each range that has documents, and its first
    rows = ids.select("id", _range_of(cuts)("id").alias("r")).groupBy("r").agg(F.min("id").alias("first")).orderBy("r").collect()
    firsts = np.array([r["first"] for r in rows], np.int64)
    targets = _targets(firsts)("id")
    sent = docs.withColumn("t", targets).select("id", "doc_id", "text", F.posexplode(F.filter(F.array("t.own", "t.before"), lambda x: x >= 0)).alias("lent", "bucket"))
    # lent rows come after all of their range; the first document of all is lent to the last range
    sent = sent.repartitionById(max(1, len(firsts)), F.col("bucket")).sortWithinPartitions("bucket", "lent", "id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, fingerprint)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], schema=SCHEMA)

        def settle(following: str, f_next: np.ndarray) -> tuple:
            _, doc, text, f = held
            other = edited(text, following)
            g = model.fingerprint(other)
            return doc, len(text), hashlib.sha256(other.encode()).hexdigest(), shown(f), shown(g), likeness(f, g), likeness(f, f_next)

        for b in runs(batches, size=RUN):
            for doc, text, bucket, is_lent in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "lent"))):
                text = text or ""
                if held is not None and held[0] != bucket:
                    held = None
                if is_lent and held is None:
                    continue
                f = model.fingerprint(text)
                if held is not None:
                    rows.append(settle(text, f))
                held = None if is_lent else (bucket, doc, text, f)
            if rows:
                yield flush()
                rows.clear()

    return sent.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(load(spark, sf_dir, "documents"))
