"""Operator 4: shards as the leaves of a k-d tree over document metadata.

Each node is cut across its widest dimension (spread within the node over spread in the corpus) where the bytes on the
left come to the share of leaves that go left. The weighted median is found from histograms that the executors add up:
a node's key range is split into ``bins``, the keys of the bin holding the median again, and so on until that bin weighs
less than ``tolerance`` of a shard or is one group. All nodes of a level are handled in the same jobs over a table of
metadata, and no text is ever shuffled. A tree of more than ``most_nodes`` leaves is grown in steps: the rows of each of
its first ``most_nodes`` subtrees go to a folder of their own and are split on from there, so only most_nodes x bins sums
are held by a task or reach the driver, whatever the corpus holds.

A key is a dimension's rank (20 bits of its range) followed by 42 bits of the group, so equal texts are neighbours. A cut
goes around a group that weighs up to ten times the tolerance for each leaf on the side with fewer; where a heavier group
holds the median, the next widest dimensions are tried, and only one that holds it in all of them is split, by document.
Null texts and metadata count as empty. Repeated rows are items each by itself; a table with fewer rows than shards
leaves some empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.session import load, materialize, scratch, ship

DIM_BITS, GROUP_BITS, ROW_BITS = 20, 42, 40


@dataclass
class Node:
    """A node of the tree: shards first .. first + leaves - 1; once cut, rows at or above the cut go right."""

    id: int
    first: int
    leaves: int
    dim: int = -1
    cut: int = 0
    row_cut: int = 0  # of the group at the cut, rows at or above this go right
    spans: list[tuple[int, int, int]] = field(default_factory=list)  # dimensions yet to try, with their least and greatest keys


@dataclass
class Search:
    """Where a node's median may lie: keys (or, within one group, row hashes) from lo on, before hi."""

    lo: int
    hi: int
    left: int
    want: float
    by_row: bool = False
    whole: tuple[int, int, int] | None = None  # the first dimension's cut at a heavy group, with what is left of it


class Cuts:
    """The cut nodes of a tree as arrays."""

    def __init__(self, nodes: list[Node]):
        nodes = sorted((n for n in nodes if n.dim >= 0), key=lambda n: n.id)
        self.id, self.dim, self.cut, self.row_cut = (np.array([getattr(n, a) for n in nodes], np.int64) for a in ("id", "dim", "cut", "row_cut"))

    def route(self, keys: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The node of each row."""
        node, here = np.ones(len(row), np.int64), np.arange(len(row))
        while len(self.id) and len(here):
            at = np.searchsorted(self.id, node[here])
            at[at == len(self.id)] = 0
            known = self.id[at] == node[here]
            at, here = at[known], here[known]
            k = keys[self.dim[at], here]
            node[here] = 2 * node[here] + ((k > self.cut[at]) | (k == self.cut[at]) & (row[here] >= self.row_cut[at]))
        return node


def _arrays(batch: pa.RecordBatch, n_dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.stack([batch.column(f"k{i}").to_numpy() for i in range(n_dims)])
    return keys, batch.column("row").to_numpy(), batch.column("size").to_numpy()


def _among(ids: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose node is one of the sorted ids, and its place among them."""
    at = np.searchsorted(ids, node)
    at[at == len(ids)] = 0
    some = np.flatnonzero(ids[at] == node)
    return some, at[some]


def _histogram(cuts: Cuts, open_nodes: dict[int, tuple[Node, Search]], n_dims: int, bins: int):
    """Sums of size, and least and greatest key, by node and bin of the search's range, within a task."""
    order = sorted(open_nodes)
    ids = np.array(order, np.int64)
    nodes, searches = zip(*(open_nodes[i] for i in order))
    dim, cut = (np.array([getattr(n, a) for n in nodes], np.int64) for a in ("dim", "cut"))
    low, high, by_row = (np.array([getattr(s, a) for s in searches], np.int64) for a in ("lo", "hi", "by_row"))
    width = np.array([_width(s, bins) for s in searches], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ids) * bins
        sums, least, most = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        for b in batches:
            keys, row, size = _arrays(b, n_dims)
            here, at = _among(ids, cuts.route(keys, row))
            v, rows = keys[dim[at], here], by_row[at] > 0
            inside = ~rows | (v == cut[at])
            v = np.where(rows, row[here], v)
            inside &= (v >= low[at]) & (v < high[at])
            here, at, v = here[inside], at[inside], v[inside]
            cell = at * bins + (v - low[at]) // width[at]
            np.add.at(sums, cell, size[here])
            np.minimum.at(least, cell, v)
            np.maximum.at(most, cell, v)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some // bins]), pa.array(some % bins), *(pa.array(a[some]) for a in (sums, least, most))], ["node", "bin", "w", "lo", "hi"])

    return work


def _spreads(cuts: Cuts, ids: list[int], n_dims: int):
    known = np.array(sorted(ids), np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(known)
        w, lo, hi = np.zeros(n, np.int64), np.full((n_dims, n), np.iinfo(np.int64).max), np.full((n_dims, n), -1)
        for b in batches:
            keys, row, size = _arrays(b, n_dims)
            here, at = _among(known, cuts.route(keys, row))
            np.add.at(w, at, size[here])
            for i in range(n_dims):
                np.minimum.at(lo[i], at, keys[i][here])
                np.maximum.at(hi[i], at, keys[i][here])
        some = np.flatnonzero(hi[0] >= 0)
        for i in range(n_dims):
            yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(w[some]), pa.array(np.full(len(some), i)), pa.array(lo[i][some]), pa.array(hi[i][some])], ["node", "w", "dim", "lo", "hi"])

    return work


def _width(s: Search, bins: int) -> int:
    return max(1, -(-(s.hi - s.lo) // bins))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: dict[str, Column] | None = None, bins: int = 1024, tolerance: float = 0.002, most_nodes: int = 256) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every document, for a number of shards or their target bytes.

    ``dims``: numeric columns by name; by default the size's logarithm, source, language and document number.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    if dims is None:
        dims = {
            "size": F.log2(F.octet_length(text) + 1.0),
            "source": F.pmod(F.xxhash64("source"), F.lit(1 << 20)).cast("double"),
            "lang": F.pmod(F.xxhash64("lang"), F.lit(1 << 20)).cast("double"),
            "doc": F.coalesce(F.col("doc_id"), F.lit(0)).cast("double"),
        }
    crc = F.crc32(F.encode(text, "utf-8"))
    group = F.pmod(F.xxhash64(text), F.lit(1 << GROUP_BITS))
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), crc.alias("text_crc32"), group.alias("g"), *[c.alias(f"d{i}") for i, c in enumerate(dims.values())])
    base = materialize(base, "metadata")
    n_dims = len(dims)
    span = base.agg(F.sum("size").alias("total"), *[f(f"d{i}") for i in range(n_dims) for f in (F.min, F.max)]).first()
    total = span[0] or 0
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 256 << 20)))
    low = [float(span[1 + 2 * i] or 0) for i in range(n_dims)]
    wide = [max(float(span[2 + 2 * i] or 0) - low[i], 1e-12) for i in range(n_dims)]
    top = (1 << DIM_BITS) - 1
    # equal texts take the metadata of one of them, so that they are neighbours in every dimension
    ranks = [F.floor((F.coalesce(f"d{i}", F.lit(low[i])) - low[i]) / wide[i] * top).cast("long") for i in range(n_dims)]
    ranked = base.select("doc_id", "size", "text_crc32", "g", *[r.alias(f"r{i}") for i, r in enumerate(ranks)])
    copies = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.min(f"r{i}").alias(f"m{i}") for i in range(n_dims)]).filter("n > 1").drop("n")
    joined = ranked.join(copies, "g", "left")
    row = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << ROW_BITS))
    keys = [F.shiftleft(F.coalesce(f"m{i}", f"r{i}"), GROUP_BITS).bitwiseOR(F.col("g")).alias(f"k{i}") for i in range(n_dims)]
    items = materialize(joined.select("doc_id", "size", "text_crc32", row.alias("row"), *keys), "keys")
    slack = max(1.0, tolerance * total / shards)
    path, held = f"{scratch(spark).rstrip('/')}/shards-{uuid.uuid4().hex}", [(items, 0, shards)]
    schema = "doc_id long, size long, text_crc32 long, shard int"
    while held:
        own, first, leaves = held.pop()
        cut, ends = grow(own, n_dims, first, leaves, bins, slack, most_nodes)
        cuts = Cuts(cut)
        placed = own.mapInArrow(_placed(cuts, {n.id: n.first for n in ends}, n_dims), schema + ", row long, " + ", ".join(f"k{i} long" for i in range(n_dims)) + ", node long")
        more = [n for n in ends if n.leaves > 1]
        if more:  # rows of the subtrees yet to split, by subtree
            parts = f"{scratch(spark).rstrip('/')}/subtrees-{uuid.uuid4().hex}"
            placed.write.partitionBy("node").parquet(parts)
            split = spark.read.schema(placed.schema).parquet(parts)
            held += [(split.filter(F.col("node") == n.id).drop("node", "shard"), n.first, n.leaves) for n in more]
            placed = split.filter(~F.col("node").isin([n.id for n in more]))
        placed.select("doc_id", "size", "text_crc32", "shard").write.mode("append").parquet(path)
    return with_slots(spark.read.schema(schema).parquet(path))


def grow(items: DataFrame, n_dims: int, first: int, leaves: int, bins: int, slack: float, most_nodes: int) -> tuple[list[Node], list[Node]]:
    """A tree's cut nodes, and its ends: ``leaves`` leaves, or most_nodes subtrees at most, of shards from ``first`` on."""
    slim = items.select("size", "row", *[f"k{i}" for i in range(n_dims)])
    cut: list[Node] = []
    level, ends = [Node(1, first, leaves)], []
    while level:
        ends += [n for n in level if n.leaves == 1]
        level = [n for n in level if n.leaves > 1]
        if not level or 2 * len(level) + len(ends) > most_nodes:
            return cut, ends + level
        by_id = {n.id: n for n in level}
        cuts = Cuts(cut)
        spread = slim.mapInArrow(_spreads(cuts, list(by_id), n_dims), "node long, w long, dim long, lo long, hi long")
        found: dict[int, list] = {}
        for r in spread.groupBy("node", "dim").agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            found.setdefault(r["node"], []).append(r)
        open_nodes: dict[int, tuple[Node, Search]] = {}
        for n in level:
            n.dim = 0
            if n.id in found:
                order = sorted(found[n.id], key=lambda r: ((r["lo"] >> GROUP_BITS) - (r["hi"] >> GROUP_BITS), r["dim"]))
                n.spans = [(r["dim"], r["lo"], r["hi"]) for r in order]
                n.dim, lo, hi = n.spans.pop(0)
                open_nodes[n.id] = n, Search(lo, hi + 1, 0, order[0]["w"] * (n.leaves // 2) / n.leaves)
        while open_nodes:
            sums: dict[int, list[tuple]] = {}
            found_bins = slim.mapInArrow(_histogram(cuts, open_nodes, n_dims, bins), "node long, bin long, w long, lo long, hi long").groupBy("node", "bin")
            for r in found_bins.agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
                sums.setdefault(r["node"], []).append(tuple(r)[1:])
            open_nodes = {i: (n, s) for i, (n, s) in open_nodes.items() if _narrow(n, s, sorted(sums.get(i, [])), slack)}
        cut += level
        level = [c for n in level for c in (Node(2 * n.id, n.first, n.leaves // 2), Node(2 * n.id + 1, n.first + n.leaves // 2, n.leaves - n.leaves // 2))]
    return cut, ends


def _placed(cuts: Cuts, first: dict[int, int], n_dims: int):
    """Rows with their end node and its first shard."""
    ids = np.array(sorted(first), np.int64)
    shards = np.array([first[i] for i in ids.tolist()], np.int32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, row, _ = _arrays(b, n_dims)
            node = cuts.route(keys, row)
            kept = ["row", *(f"k{i}" for i in range(n_dims))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(shards[np.searchsorted(ids, node)]), *(b.column(c) for c in kept), pa.array(node)], ["doc_id", "size", "text_crc32", "shard", *kept, "node"])

    return work


def _narrow(n: Node, s: Search, sums: list[tuple[int, int, int, int]], slack: float) -> bool:
    """Move the search to the keys of the bin with the median, or settle the node's cut; whether the search goes on."""
    for _, w, lo, hi in sums:
        if s.left + w < s.want:
            s.left += w
            continue
        if w <= slack or lo == hi and (s.by_row or w <= 10 * slack * (n.leaves // 2)):
            edge = lo if s.want - s.left < s.left + w - s.want else hi + 1
            if s.by_row:
                n.row_cut = edge
            else:
                n.cut = edge
            return False
        if lo == hi:  # one heavy group
            s.whole = s.whole or (n.dim, lo, s.left)
            if n.spans:  # it may lie elsewhere in another dimension
                n.dim, low, high = n.spans.pop(0)
                s.lo, s.hi, s.left = low, high + 1, 0
            else:  # its rows are split
                n.dim, n.cut, s.left = s.whole
                s.lo, s.hi, s.by_row = 0, 1 << ROW_BITS, True
        else:
            s.lo, s.hi = lo, hi + 1
        return True
    if s.by_row:
        n.row_cut = s.hi
    else:
        n.cut = s.hi
    return False


def with_slots(rows: DataFrame, per_block: int = 50_000) -> DataFrame:
    """Gapless positions in each shard. Rows are numbered in blocks of documents, then blocks are stacked."""
    n = rows.count()
    blocks = max(1, n // per_block)
    b = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    counts = b.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    above = counts.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("base"))
    local = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id")) - 1
    return b.withColumn("local", local).join(above, ["shard", "block"]).select(*[c for c in rows.columns], (F.col("base") + F.col("local")).cast("long").alias("slot"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(load(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
