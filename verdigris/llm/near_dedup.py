"""Operator 3: near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

A document is its set of distinct 2-word shingles (with fewer words the whole sequence; without words empty, linked with
nothing). Documents with equal sets are one class from the start, however many copies there are; everything after works
on classes, which have numbers of their own, so rows without doc_id and rows that repeat one with other texts are linked
like all others.

*Signatures.* Each element draws a random permutation of the slots, one slot a level, with value level + uniform; a slot
keeps its smallest value. As values of a level are below those of the next, a document is finished once all its slots
hold values below the level (early stopping), which is soon for long texts. Levels run over all documents of a run at
once.

*Candidates.* Slots are hashed in ``bands`` of ``rows``: at the threshold 0.8 all bands miss a pair with a chance of
(1 - 0.8^rows)^bands, 3e-6 for 32 x 5. Inside a bucket, members are ranked; each round compares the next centers, in
growing numbers, with later members that aren't in their component yet, until no bucket has unexamined pairs across
components. So a bucket of thousands of near copies costs one star, not all pairs, and none is capped. A few bands go
first; what they link needs no more pairs in the others. Members of large buckets are ranked in many tasks.

*Verification* counts intersections of the full sets (64-bit shingle hashes). *Grouping* is union-find over components
so far: the links of a round, between components, are joined on the driver if they are few (``few_links``) and by
alternating large and small stars else, until nothing changes.

Null texts have no words. Repeated rows stay rows; they share class and component. A component is named by its smallest
doc_id; one of rows without any has none (null), and in it the rows of one class are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verdigris.llm import text as T
from verdigris.session import forget, load, local_arrow_rows, materialize

U = np.uint64
UNIT = 40  # bits of a value below its level
EMPTY = U((1 << 63) - 1)
CHUNK = 1 << 17


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and n + 1 offsets."""
    w = T.words(data, offsets, T.SPACED)
    n = np.diff(w.at)
    with np.errstate(over="ignore"):
        pair = T.mix(w.hash[:-1] * U(0xA24BAED4963EE407) + w.hash[1:]) if len(w.hash) > 1 else np.zeros(0, np.uint64)
        single = T.mix(w.hash * U(0x9FB21C651E98DF25) + U(1))
    size = np.where(n > 1, n - 1, n)
    at = np.concatenate([[0], np.cumsum(size)])
    keep = np.ones(len(w.hash), bool)
    keep[w.at[1:][n > 1] - 1] = False  # a document's last word begins no shingle
    flat = np.zeros(len(w.hash), np.uint64)
    flat[:-1] = pair
    ones = w.at[:-1][n == 1]
    flat[ones] = single[ones]
    flat = flat[keep]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[at[:-1][size > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return flat[new], total[at]


def superminhash(sets: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots) of the sets ``sets[at[i]:at[i + 1]]``; EMPTY throughout for an empty set."""
    out = np.full((len(at) - 1, slots), EMPTY, np.uint64)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        for a in range(int(at[lo]), max(int(at[hi]), int(at[lo]) + 1), 4 * CHUNK):  # a huge set in parts: minima combine
            b = min(int(at[hi]), a + 4 * CHUNK)
            _levels(out[lo:hi], sets[a:b], np.clip(at[lo : hi + 1], a, b) - a, slots)
        lo = hi
    return out


def _levels(out: np.ndarray, sets: np.ndarray, at: np.ndarray, slots: int) -> None:
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    seed, perm = sets, None
    flat = out.reshape(-1)
    with np.errstate(over="ignore"):
        for level in range(slots):
            if not len(doc):
                return
            r = T.mix(seed + U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            k = level + ((r >> U(UNIT)) * U(slots - level) >> U(64 - UNIT)).astype(np.int64)
            if level:
                row = np.arange(len(doc))
                slot = perm[row, k]
                perm[row, k] = perm[:, level]
            else:
                slot = k
            np.minimum.at(flat, doc * slots + slot, U(level << UNIT) | (r & U((1 << UNIT) - 1)))
            busy = out.max(axis=1) >= U((level + 1) << UNIT)
            stay = busy[doc]
            if level == 0:
                doc, seed, k = doc[stay], seed[stay], k[stay]
                perm = np.broadcast_to(np.arange(slots, dtype=np.uint16 if slots > 256 else np.uint8), (len(doc), slots)).copy()
                perm[np.arange(len(doc)), k] = 0
            elif not stay.all():
                doc, seed, perm = doc[stay], seed[stay], perm[stay]


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signatures), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(signatures), (b + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1, np.uint64)
            for c in range(b * rows, b * rows + rows):
                h = T.mix(h * U(0xA24BAED4963EE407) + signatures[:, c])
            out[:, b] = h
    return out


def class_keys(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets have equal ones."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[U(0)], np.cumsum(T.mix(sets ^ U(x)), dtype=np.uint64)]) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        return tuple(T.signed(s[at[1:]] - s[at[:-1]]) for s in sums)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, c1, c2, keys``: set size, class and band keys (null without words) of every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, at = shingle_sets(*T.buffers(batch.column("text")))
        n = np.diff(at)
        c1, c2 = class_keys(sets, at)
        keys = T.signed(band_keys(superminhash(sets, at, bands * rows), bands, rows).reshape(-1))
        offsets = pa.array(np.arange(0, len(keys) + 1, bands, dtype=np.int32), mask=np.concatenate([n == 0, [False]]))
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(c1), pa.array(c2), lists], ["doc_id", "n", "c1", "c2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(T.scan(work), "doc_id long, n long, c1 long, c2 long, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (smallest node reachable) of every node of the edges (a, b)."""
    current = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), "edges")
    before = None
    while True:
        both = current.union(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("x")).agg(F.least(F.min("u"), F.col("x")).alias("m"))
        large = both.filter("u > v").join(least, F.col("v") == F.col("x")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        small = large.join(low, F.col("v") == F.col("x"))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("u < v").distinct()
        last, current = current, materialize(small, "edges")
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(last)
        if now == before:
            break
        before = now
    return current.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"))


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        for side in (up[x], up[y], x, y):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == up).all():
            return nodes, nodes[up]
        up = new


def joined(links: DataFrame, few_links: int) -> tuple[DataFrame, int]:
    """``node, label`` of the components that links (a, b) join, and the number of links."""
    spark = links.sparkSession
    n = links.count()
    if n > few_links:
        return materialize(components(links), "labels"), n
    rows = links.toPandas()
    node, label = union_find(rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)) if n else (np.zeros(0, np.int64),) * 2
    return F.broadcast(spark.createDataFrame(pa.table({"node": pa.array(node), "label": pa.array(label)}))), n  # 2 few_links rows at most


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, at most 32 MB however many there are: no id is missed, some others may pass."""
    words = 1 << min(22, max(12, (ids.count() * 16 // 64).bit_length()))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(words * 64))
    rows = ids.select(h.alias("h")).groupBy((F.shiftright("h", 6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(words, np.uint64)
    bitmap[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def wanted_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, set`` of the classes (node, c1, c2, n, rep); a bitmap of their documents thins the scan before the join."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap := bitmap_of(classes.filter("rep is not null").select(F.col("rep").alias("doc_id"))))
    # a row without doc_id passes only where a class has no other rows
    h = F.when(F.col("doc_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(len(bitmap) * 64)))
    if classes.filter("rep is null").isEmpty():
        docs = docs.filter("doc_id is not null")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at = batch.column("h").to_numpy()
        hit = ((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) == U(1)) | (at < 0)
        if not hit.any():
            return None
        sets, at = shingle_sets(*T.buffers(batch.filter(pa.array(hit)).column("text")))
        c1, c2 = class_keys(sets, at)
        raw = pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array(np.diff(at)), raw], ["c1", "c2", "n", "set"])

    found = docs.select("text", h.alias("h")).mapInArrow(T.scan(work), "c1 long, c2 long, n long, set binary")
    once = found.groupBy("c1", "c2", "n").agg(F.first("set").alias("set"))
    return materialize(once.join(classes.select("node", "c1", "c2", "n"), ["c1", "c2", "n"]).select("node", "set"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, ..) with 100 * intersection >= percent * union; columns other than a and b."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = np.zeros(len(p), bool)
            for i, (x, y) in enumerate(zip(p["sa"], p["sb"])):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                common = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                ok[i] = 100 * common >= percent * (len(u) + len(v) - common)
            yield p.loc[ok, rest]

    return both.select(*rest, "sa", "sb").mapInPandas(check, ", ".join(f"{c} long" for c in rest))


def bucket_members(classes: DataFrame, most: int = 1 << 16) -> DataFrame:
    """``band, key, node, n, rank``: members of the buckets of two or more. Ranks are any order within a bucket; one of
    more than ``most`` members is ranked in parts."""
    keyed = classes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / most)).cast("long")
    members = keyed.join(shared, "key").withColumn("part", part)
    members = members.withColumn("rank", F.row_number().over(W.partitionBy("key", "part").orderBy("node")) - 1)
    if not shared.filter(F.col("members") > most).isEmpty():
        counts = members.filter(F.col("members") > most).groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
        before = counts.select("key", "part", (F.sum("size").over(W.partitionBy("key").orderBy("part")) - F.col("size")).alias("before"))
        members = members.join(before, ["key", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    return members.select("band", "key", "node", "n", F.col("rank").cast("long").alias("rank"))


def link_classes(docs: DataFrame, classes: DataFrame, percent: int, bands: int, few_links: int) -> DataFrame | None:
    """``node, label`` of the classes that are linked with others."""
    members = materialize(bucket_members(classes), "buckets")
    if members.isEmpty():
        return None
    sets = wanted_sets(docs, classes.join(members.select("node").distinct(), "node", "left_semi"))
    labels: DataFrame | None = None
    edges = [0, max(1, bands // 8), bands]
    for low, high in zip(edges[:-1], edges[1:]):
        group = members.filter((F.col("band") >= low) & (F.col("band") < high))
        at, centers = 0, 1
        while True:
            if labels is None:
                now = group.withColumn("label", F.col("node"))
            else:
                now = group.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
                split = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("rank").alias("last")).filter(f"x < y AND last > {at}").select("key")
                now = materialize(now.join(split, "key"), "open")
            last, left_over = now.agg(F.max("rank"), F.sum(F.greatest(F.col("rank") - at, F.lit(0)))).first()
            if last is None or last <= at:
                break
            if at and left_over <= few_links:
                centers = last + 1
            left = now.filter(f"rank >= {at} AND rank < {at + centers}").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("label").alias("la"))
            right = now.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.col("label").alias("lb"))
            near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("rb") > F.col("ra")) & (F.col("la") != F.col("lb"))
            pairs = left.join(right, "key").filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "la", "lb").distinct()
            pairs = materialize(pairs, "pairs")
            wanted = sets
            if pairs.count() <= few_links:  # then only their sets are shuffled; 2 few_links numbers at most are broadcast
                ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                wanted = sets.join(F.broadcast(ends), "node", "left_semi")
            links = materialize(verified(pairs, wanted, percent).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
            forget(pairs)
            if labels is not None:
                forget(now)
            moved, n = joined(links, few_links)
            if n:
                if labels is None:
                    fresh = moved
                else:
                    other = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
                    known = labels.join(other, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                    fresh = known.unionByName(moved.join(labels.select("node"), "node", "left_anti").select("node", "label"))
                fresh = materialize(fresh, "labels")
                if labels is not None:
                    forget(labels)
                labels = fresh
            forget(links)
            at, centers = at + centers, centers * 4
    forget(sets)
    forget(members)
    return labels


def near_duplicate_rows(docs: DataFrame, percent: int = 80, bands: int = 32, rows: int = 5, few_links: int = 200_000) -> DataFrame:
    """``doc_id, c1, c2, n, component_id, kept`` of every document; c1, c2 and n name its class."""
    local_arrow_rows(docs.sparkSession)
    sig = materialize(signatures(docs, bands, rows), "signatures")
    classes = sig.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = link_classes(docs, classes, percent, bands, few_links)
    named = classes.select("c1", "c2", "n", "node", "rep")
    if labels is None:
        named = named.select("c1", "c2", "n", F.col("rep").alias("name"), F.lit(True).alias("first"))
    else:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = named.groupBy("label").agg(F.min("rep").alias("name"))
        named = named.join(least, "label").select("c1", "c2", "n", "name", (F.col("node") == F.col("label")).alias("first"))
    out = sig.select("doc_id", "c1", "c2", "n").join(named, ["c1", "c2", "n"], "left")
    component = F.coalesce("name", "doc_id")
    kept = F.when(component.isNull(), F.coalesce("first", F.lit(True))).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", "c1", "c2", "n", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = 32, rows: int = 5, few_links: int = 200_000) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    out = near_duplicate_rows(docs, percent, bands, rows, few_links)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def deduplicate(docs: DataFrame, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row of each group, with all columns; rows without words stay, those of one doc_id once.

    Rows that may go or repeat a doc_id, told by a bitmap of their ids, are shuffled; the rest pass as they are read.
    Rows whose doc_id is repeated or null are told apart by their texts.
    """
    spark = docs.sparkSession
    found = materialize(near_duplicate_rows(docs, percent, bands, rows), "found")
    by_id = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("NOT kept OR n > 1")
    suspects = materialize(by_id, "suspects")
    shared = spark.sparkContext.broadcast(bitmap := bitmap_of(suspects))
    bits = len(bitmap) * 64

    @F.pandas_udf("boolean")
    def hit(h: pd.Series) -> pd.Series:
        at = h.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) == U(1))

    maybe = hit(F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    some = docs.filter(maybe & F.col("doc_id").isNotNull())
    again = suspects.filter("n > 1").select("doc_id")
    out = docs.filter(~maybe & F.col("doc_id").isNotNull()).unionByName(some.join(suspects.select("doc_id"), "doc_id", "left_anti").select(*docs.columns))
    repeated = not again.isEmpty()
    if not repeated and found.filter("doc_id is null").isEmpty():
        return out
    odd = docs.filter("doc_id is null")
    stay = found.filter("kept AND doc_id is null AND n > 0")
    if repeated:
        odd = odd.unionByName(some.join(again, "doc_id", "left_semi").select(*docs.columns))
        stay = stay.unionByName(found.filter("kept AND doc_id is not null").join(again, "doc_id", "left_semi").select(*stay.columns))
    taken = {c.lower() for c in docs.columns}
    c1, c2, n, i = ("_" * (max(map(len, docs.columns)) + 1) + c for c in ("c1", "c2", "n", "id"))
    assert not {c1, c2, n, i} & taken
    schema = StructType([*odd.schema.fields, *(StructField(c, LongType()) for c in (c1, c2, n))])

    def classed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, at = shingle_sets(*T.buffers(batch.column("text")))
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, class_keys(sets, at)), pa.array(np.diff(at))], [*batch.schema.names, c1, c2, n])

    odd = odd.mapInArrow(T.scan(classed), schema)
    names = stay.select(F.col("doc_id").alias(i), *[F.col(x).alias("_of" + y) for x, y in (("c1", c1), ("c2", c2), ("n", n))]).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(i))
    for c in (c1, c2, n):
        same &= F.col(c) == F.col("_of" + c)
    once = odd.filter(F.col("doc_id").isNotNull() | (F.col(n) > 0)).join(names, same, "left_semi").dropDuplicates(["doc_id", c1, c2, n])
    wordless = odd.filter(F.col("doc_id").isNull() & (F.col(n) == 0))
    return out.unionByName(once.select(*docs.columns)).unionByName(wordless.select(*docs.columns))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON r = a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.r AS component_id, d.doc_id = r.r AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1) r USING (doc_id)
"""
