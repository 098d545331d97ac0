"""Operator 5: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features (``toxic_features``): densities of lexicon words and of weighted cues, proximity of second-person words,
capitals, punctuation, obfuscation, repetition, length. Labels, language, source and doc_id are never features.

*Fitting* uses a bounded sample of labelled documents: the ``most_labels`` (20,000) with the smallest hashes. Cues are
beginnings of words that stand in at least ``support`` toxic ones (and one in 400 of them); a cue's weight is the lower
bound, two standard errors down, of the logarithm of how much likelier toxic documents hold it, 1 at least. Texts are
dealt into folds. A document's cues come from the other folds alone; the calibration is fitted on scores of each fold by
trees and cues that have seen nothing of it. Trees grow on histograms of quantile bins, in numpy on the driver.
*Scoring* reads every whole text, in Arrow batches, without a shuffle.

Null and empty texts have all features zero and the score of such rows. Repeated label rows of a document count once, as
toxic if any says so; repeated rows of a labelled document once, with their least text. Without usable labels of both
kinds the score is the share of lexicon words, doubled, at most 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import text as T
from verdigris.llm.toxic_features import BASE, CUES, NO_CUES, Cues, Scanned, features
from verdigris.session import load, local_arrow_rows, materialize

FOLDS = 5


class Trees:
    """Boosted trees on logistic loss, grown by level on histograms."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.start)
        n, m = x.shape
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            tree = []
            for level in range(self.depth):
                width = 1 << level
                split = np.full(width, -1), np.zeros(width, np.int64)
                best = np.full(width, 1e-6)
                for j in range(m):
                    cell = node * self.bins + binned[:, j]
                    gs, hs, ns = (np.bincount(cell, v, width * self.bins).reshape(width, self.bins).cumsum(1) for v in (g, h, np.ones(n)))
                    gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(nl < self.least) | (nt - nl < self.least)] = -1
                    at = gain.argmax(1)
                    v = gain[np.arange(width), at]
                    better = v > best
                    split[0][better], split[1][better], best[better] = j, at[better], v[better]
                feature, cut = split
                go = (feature[node] >= 0) & (binned[np.arange(n), np.maximum(feature[node], 0)] > cut[node])
                node = node * 2 + go
                tree.append((feature.copy(), cut.copy()))
            width = 1 << self.depth
            value = self.rate * np.bincount(node, g, width) / (np.bincount(node, h, width) + self.penalty)
            self.trees.append((tree, value))
            f += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        f = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = node * 2 + ((feature[node] >= 0) & (binned[rows, np.maximum(feature[node], 0)] > cut[node]))
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and means, to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([v, t, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2] or blocks[-2][0] / blocks[-2][2] == v):
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
    return np.array([a / n for a, _, n in blocks]), np.array([t / n for _, t, n in blocks])


class Model:
    def __init__(self, cues: Cues, trees: Trees | None, curve: tuple[np.ndarray, np.ndarray] | None):
        self.cues, self.trees, self.curve = cues, trees, curve

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = features(data, offsets, self.cues)
        if self.trees is None:
            return np.minimum(1.0, 2 * x[:, BASE.index("lexicon")])
        f = self.trees.raw(x)
        # the calibrated chance; a thousandth of the raw one keeps the order within its steps
        return np.clip(0.999 * np.interp(f, *self.curve) + 0.001 / (1 + np.exp(-f)), 0, 1)


def weigh(hash: np.ndarray, yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int, support: int) -> Cues:
    """The cues among beginnings of words, from how many toxic and other documents hold each."""
    weight = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1)) - 2 * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    some = (yes >= max(support, n_yes / 400)) & (weight >= 1)
    return Cues(hash[some], weight[some])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, most_labels: int = 20_000, support: int = 3) -> Model:
    """The model from those labelled documents that ``usable`` admits, ``most_labels`` at most."""
    local_arrow_rows(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").filter(usable).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels))  # most_labels rows of two numbers
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "y").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    rows = materialize(rows.select("doc_id", "y", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    return _fit(rows, support)


def _held(rows: DataFrame, candidates: np.ndarray | None, toxic: int) -> tuple[DataFrame, list[str]]:
    """``w, n0 ..``: beginnings of words of the rows with this label, how many rows of each fold hold them, and these columns."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        s = Scanned(*T.buffers(batch.column("text")))
        words, h = (np.concatenate(x) for x in zip(*s.starts))
        if candidates is not None:
            at = np.searchsorted(candidates, h)
            at[at == len(candidates)] = 0
            hit = candidates[at] == h
            words, h = words[hit], h[hit]
        doc = np.searchsorted(s.w.at, words, "right") - 1
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        u, back = np.unique(h, return_inverse=True)
        n = np.bincount(back * FOLDS + batch.column("fold").to_numpy()[doc], minlength=len(u) * FOLDS).reshape(-1, FOLDS)
        return pa.RecordBatch.from_arrays([pa.array(T.signed(u)), *(pa.array(c) for c in n.T)], ["w", *names])

    names = [f"n{k}" for k in range(FOLDS)]
    found = rows.filter(F.col("y") == toxic).select("text", "fold").mapInArrow(T.scan(work), "w long, " + ", ".join(f"{n} long" for n in names))
    found = found.groupBy("w").agg(*[F.sum(n).alias(n) for n in names])
    return found, names


def _fit(rows: DataFrame, support: int) -> Model:
    """Passes over the labelled rows: beginnings of toxic words, the same in other rows, features by fold."""
    size = np.zeros((2, FOLDS), np.int64)
    for r in rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["y"], r["fold"]] = r["n"]
    if not size.sum(1).all():
        return Model(NO_CUES, None, None)
    found, names = _held(rows, None, 1)
    total = sum(F.col(n) for n in names)
    table = found.filter(total >= max(support, int(size[1].sum()) // 500)).toPandas().sort_values("w")
    hash = table["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hash)
    hash, yes, no = hash[order], table[names].to_numpy(np.int64)[order], np.zeros((len(table), FOLDS), np.int64)
    if len(hash):
        others = _held(rows, hash, 0)[0].toPandas()
        no[np.searchsorted(hash, others["w"].to_numpy(np.int64).view(np.uint64))] = others[names].to_numpy(np.int64)

    def without(*folds: int) -> Cues:
        keep = [k for k in range(FOLDS) if k not in folds]
        return weigh(hash, yes[:, keep].sum(1), no[:, keep].sum(1), int(size[1, keep].sum()), int(size[0, keep].sum()), support)

    cues = {(j, k): without(j, k) for j in range(FOLDS) for k in range(j, FOLDS)}

    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Features, and those of cues: for each fold k, from the folds that are neither k nor the row's own."""
        s = Scanned(*T.buffers(batch.column("text")))
        fold = batch.column("fold").to_numpy()
        by = {jk: s.cues(c) for jk, c in cues.items()}
        row = np.arange(len(fold))
        wide = [np.stack([by[min(j, k), max(j, k)][i] for i, j in zip(row, fold)]) for k in range(FOLDS)] + [np.stack([by[j, j][i] for i, j in zip(row, fold)])]
        x = np.concatenate([s.base(), *wide], 1)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y", "fold")), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "fold", "x"])

    table = rows.mapInArrow(T.scan(described, size=1 << 20), "doc_id long, y int, fold int, x array<double>").toPandas().sort_values("doc_id", ignore_index=True)
    x, y, fold = np.array(table["x"].tolist()), table["y"].to_numpy(), table["fold"].to_numpy()
    base, m, out = len(BASE), len(CUES), np.zeros(len(y))

    def columns(k: int) -> np.ndarray:
        return np.concatenate([x[:, :base], x[:, base + k * m : base + (k + 1) * m]], 1)

    for k in range(FOLDS):
        if not (fold == k).any():
            continue
        if len(set(y[fold != k].tolist())) < 2:
            return Model(without(), None, None)
        out[fold == k] = Trees().fit(columns(k)[fold != k], y[fold != k]).raw(columns(k)[fold == k])
    return Model(without(), Trees().fit(columns(FOLDS), y), isotonic(out, y.astype(float)))


def toxicity_scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` of every document with its score, as ``name``; no shuffle."""
    local_arrow_rows(docs.sparkSession)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(*T.buffers(batch.column("text"))))], [*keep, name])

    return source.mapInArrow(T.scan(work, size=1 << 20), schema)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where a column has it already."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def reject_toxic(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The documents that score below ``least``, with all their columns."""
    name = free_name(docs, "score")
    return toxicity_scores(docs, model, tuple(docs.columns), name).filter(F.col(name) < least).select(*docs.columns)


def remainder(column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3; rows with 1 are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels"), remainder() != 1)
    out = toxicity_scores(docs, model)
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
