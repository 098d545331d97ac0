"""Operator 2: language-model scores from a hierarchical Pitman-Yor model over words.

Restaurants: one for every preceding word of the training texts (and a text's beginning), all with the same parent, the
word restaurant, whose own parent is uniform over the V known words and one unknown. In a restaurant with discount d and
strength s, a word's customers sit at tables, and every table is a customer of the parent:

    P(w | u) = (c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u)

*Gathering.* Tasks turn blocks of documents into postings (word, context, document, count), laid out as compressed arrays
by a hash of the word; one shuffle brings each hash range together. Words that make up a large share of all tokens are
spread by context, so no range outgrows the others. Nothing of the vocabulary or the pairs is ever collected or broadcast
but the totals of the ``contexts`` most frequent contexts, which have numbers, and the words spread, both of bounded
number. Other contexts are named by their hash; ranges of hashes add their totals up and answer the word ranges. Ranges
hold about ``range_tokens`` training tokens each, whatever the session's settings.

*Seating* is sampled by Gibbs in each range. In a sweep every dish (a word in a restaurant) leaves, and its customers are
seated anew: the sizes of its tables are summed out, and their number is drawn from its conditional distribution,

    p(t) ~ S_d(c, t) prod_{j < t} (s + d (t_u' + j)) P_j(w),

t_u' being the tables of the restaurant's other dishes and P_j(w) the parent's chance for one more customer after j
(``draw_tables``: exact by generalised Stirling numbers for up to ``EXACT`` customers, by their asymptotic ratio beyond).
A quarter of the dishes moves at a time, so that most see what their neighbours have just done. Tables that a restaurant
has in other ranges are its dishes there, known exactly for contexts with numbers, times the tables a dish of this range;
of other contexts the mean. The word restaurant's tables are drawn likewise, those of spread words from their own range's
customers. After ``burn`` sweeps, ``samples`` seatings are kept, ``gap`` sweeps apart; their exact totals over all ranges
are added up for scoring, where a range draws the same seatings again instead of storing them. Discounts are estimated
from the numbers of dishes with one and two customers.

*Scores.* Predictive probabilities are averaged over the seatings; each range adds up its share of every document's score
and of the base score, and a last shuffle sums the shares. Perplexity is 10 ** (-score / n_tokens).

Null texts are empty: one token, the end. Rows without doc_id are training rows. Repeated rows count each by itself.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import text as T
from verdigris.session import load, local_arrow_rows, materialize, scratch

U = np.uint64
#: An entry's key is its word's number above its context's.
LOW = (1 << 32) - 1
END, BEGIN = U(0x1234567_89ABCDEF), U(0xFEDCBA98_7654321)
#: A block's bytes of text and its documents, at most (one document at least).
BLOCK_BYTES, BLOCK_DOCS = 3 << 20, 60_000
#: Shares of scores are rounded to this part of one; a task adds up those of its ranges until they take so many bytes.
FIXED, HELD_BYTES = 1 << 22, 32 << 20
#: Customers of a dish up to which the numbers of tables have exact weights; columns held when drawing beyond.
EXACT, WINDOW = 128, 129
#: Postings that a task holds back, to send those of several blocks in one row.
SEND_BYTES = 32 << 20


def _small(a: np.ndarray) -> np.ndarray:
    if not len(a):
        return a.astype(np.uint8)
    lo, hi = int(a.min()), int(a.max())
    for kind in (np.uint8, np.uint16, np.uint32) if lo >= 0 else (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= lo and hi <= np.iinfo(kind).max:
            return a.astype(kind)
    return a.astype(np.int64)


def _pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(blob) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Block:
    """Words, contexts and documents of a run of rows, with an end after each document's words."""

    def __init__(self, batches: list[pa.RecordBatch]):
        words, sizes, self.ids = [], [], []
        for b in batches:
            w = T.words(*T.buffers(b.column("text")), T.SPACED)
            n = np.diff(w.at)
            out = np.full(len(w.hash) + len(n), END, np.uint64)
            ends = np.cumsum(n + 1) - 1
            keep = np.ones(len(out), bool)
            keep[ends] = False
            out[keep] = w.hash
            words.append(out)
            sizes.append(n + 1)
            self.ids += b.column("doc_id").to_pylist()
        self.word, self.size = np.concatenate(words), np.concatenate(sizes)
        self.train = np.array([not held_out(i) for i in self.ids])
        self.doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, size, rows = [], 0, 0
    for run in T.runs(batches, size=min(T.RUN, BLOCK_BYTES)):
        own = run.column("text").nbytes
        if held and (size + own > BLOCK_BYTES or rows + run.num_rows > BLOCK_DOCS):
            yield Block(held)
            held, size, rows = [], 0, 0
        held.append(run)
        size, rows = size + own, rows + run.num_rows
    if held:
        yield Block(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """``w, n``: training tokens of each word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            u, n = np.unique(b.word[b.train[b.doc]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(u)), pa.array(n)], ["w", "n"])

    return docs.select("doc_id", "text").mapInArrow(work, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _number(sorted_hashes: np.ndarray, numbers: np.ndarray, h: np.ndarray, default: int) -> np.ndarray:
    if not len(sorted_hashes):
        return np.full(len(h), default, np.int64)
    at = np.searchsorted(sorted_hashes, h)
    at[at == len(sorted_hashes)] = 0
    return np.where(sorted_hashes[at] == h, numbers[at], default)


def _postings(context: tuple[np.ndarray, np.ndarray], hot: np.ndarray, ranges: int):
    """Rows (g, block, blob): range g's postings of a block; below zero a block's documents."""
    other = len(context[0])

    def sent(held: dict[int, list[tuple[int, tuple]]]) -> Iterator[pa.RecordBatch]:
        """A row for each range with the postings of all blocks held, each array of theirs after the other."""
        keys = sorted(held)
        for at in range(0, len(keys), 16):
            some = keys[at : at + 16]
            blobs = [_pack(*held[g][0][1]) if g < 0 else _joined(held[g]) for g in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([held[g][0][0] for g in some], pa.int64()), pa.array(blobs, pa.binary())], ["g", "block", "blob"])
        held.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), {}, 0
        for k, b in enumerate(blocks(batches)):
            name = (part << 20) + k
            # look each distinct word up once
            distinct, back = np.unique(b.word, return_inverse=True)
            of_word, own = _number(*context, distinct, other), distinct
            of_word = np.where(of_word == other, other + np.arange(len(own)), of_word)  # the others by their place in the block
            u = np.empty(len(b.word), np.int64)
            u[1:] = of_word[back[:-1]]
            u[np.cumsum(b.size) - b.size] = int(_number(*context, np.array([BEGIN]), other)[0])
            spread = _among(distinct, hot)
            entity = distinct
            if spread.any():
                with np.errstate(over="ignore"):
                    e = b.word.copy()
                    s = spread[back]
                    at = u[s]
                    name_of = np.where(at < other, at.astype(np.uint64), own[np.maximum(at - other, 0)])
                    e[s] = T.mix(b.word[s] + (name_of + U(1)) * U(0x9E3779B97F4A7C15))
                entity, first, back = np.unique(e, return_index=True, return_inverse=True)
                distinct = b.word[first]
            key = (back << 32) | u
            ids, sizes, train_doc, of_doc = b.ids, b.size, b.train, b.doc
            del b, back, u  # a worker's memory is what a block has at its largest
            order = np.argsort(key, kind="stable")
            key, doc = key[order], of_doc[order]
            del order, of_doc
            new_p = np.ones(len(key), bool)
            new_p[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            p_at = np.flatnonzero(new_p)
            count = np.diff(np.append(p_at, len(key)))
            p_key, p_doc = key[p_at], doc[p_at]
            del key, doc, new_p
            new_e = np.ones(len(p_key), bool)
            new_e[1:] = p_key[1:] != p_key[:-1]
            e_at = np.flatnonzero(new_e)
            e_key = p_key[e_at]
            e_n = np.diff(np.append(e_at, len(p_key)))
            train = np.add.reduceat(count * train_doc[p_doc], e_at)
            of = (entity >> U(32)) * U(ranges) >> U(32)
            e_range = of[e_key >> 32].astype(np.int64)
            edge = np.searchsorted(e_range, np.arange(ranges + 1))
            p_edge = np.append(e_at, len(p_key))
            out = [(-1 - name, name, (ids, sizes))]
            for g in range(ranges):
                a, z = edge[g], edge[g + 1]
                if a == z:
                    continue
                ent, e_u = e_key[a:z] >> 32, e_key[a:z] & LOW
                w, w_at = np.unique(ent, return_index=True)
                q = slice(p_edge[a], p_edge[z])
                fields = (
                    distinct[w], _small(np.diff(np.append(w_at, z - a))), np.minimum(e_u, other).astype(np.uint16), _small(e_n[a:z]), _small(train[a:z]), _small(p_doc[q]), _small(count[q]), np.array([len(sizes)]), own[e_u[e_u >= other] - other],
                )
                out.append((g, name, fields))
                size += sum(x.nbytes for x in fields)
            for g, n, blob in out:
                held.setdefault(g, []).append((n, blob))
            del out, p_key, p_doc, e_key, count, train
            if size > SEND_BYTES:
                yield from sent(held)
                size = 0
        yield from sent(held)

    return work


def _joined(blocks: list[tuple[int, tuple]]) -> bytes:
    """Postings of several blocks: names, lengths of their arrays, and the arrays."""
    names, parts = zip(*blocks)
    return _pack(np.array(names), np.array([[len(x) for x in p] for p in parts]), *(_small(np.concatenate(x)) if 0 < k < 8 else np.concatenate(x) for k, x in enumerate(zip(*parts))))


def _parted(blob: bytes) -> list[tuple[int, tuple]]:
    names, lengths, *arrays = _unpack(blob)
    ends = np.cumsum(lengths, axis=0)
    return [(n, tuple(x[e - k : e] for x, e, k in zip(arrays, end, size))) for n, end, size in zip(names.tolist(), ends.tolist(), lengths.tolist())]


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return _number(known, np.ones(len(known), np.int64), h, 0) > 0


@lru_cache(maxsize=8)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t), c and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            out[c + 1] = np.logaddexp(np.concatenate([[-np.inf], out[c, :-1]]), np.log(np.maximum(c - d * t, 0)) + out[c])
    return out


@lru_cache(maxsize=8)
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(c / t) and the logarithm of d t S_d(c, t + 1) / S_d(c, t) there, for many customers."""
    u = np.concatenate([np.exp(np.linspace(-60, np.log(0.5), 2000)), 1 - np.exp(np.linspace(np.log(0.5), -14, 2000))[1:]])
    rest = -np.expm1(d * np.log(u))
    return np.log(d * (1 - u) * u ** (d - 1) / rest)[::-1], np.log(rest)[::-1]


def draw_tables(c: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers each, drawn from p(t) ~ S_d(c, t) prod_{j < t} weight(dish, j)."""
    t = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    edge = np.searchsorted(c[order], np.arange(EXACT + 2))
    table = stirling(d)
    with np.errstate(divide="ignore"):
        for size in range(2, EXACT + 1):
            for lo in range(edge[size], edge[size + 1], max(1, (1 << 20) // size)):
                own = order[lo : min(edge[size + 1], lo + max(1, (1 << 20) // size))]
                log_p = np.zeros((len(own), size))
                np.cumsum(np.log(weight(own[:, None], np.arange(1, size)[None, :])), axis=1, out=log_p[:, 1:])
                log_p += table[size, 1 : size + 1]
                t[own] += _pick(log_p, rng)
        own = order[edge[EXACT + 1] :]
        if len(own):
            t[own] = _draw_many(own, c[own].astype(float), weight, d, rng)
    return t


def _pick(log_p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column for each row, by its weight."""
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
    np.cumsum(p, axis=1, out=p)
    return (p < rng.random(len(p))[:, None] * p[:, -1:]).sum(axis=1)


def _draw_many(own: np.ndarray, c: np.ndarray, weight, d: float, rng: np.random.Generator) -> np.ndarray:
    """Dishes of many customers: all numbers of tables around the mode, or its normal curve where that is wider."""
    x, y = _saddle(d)

    def ratio(own: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The logarithm of p(t + 1) / p(t)."""
        return np.log(weight(own, t)) + np.interp(np.log(c / t), x, y, left=-np.inf) - np.log(d * t)

    low, high = np.ones(len(c)), c.copy()
    for _ in range(40):
        mid = (low + high) / 2
        up = ratio(own, c, mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    h = np.minimum(np.maximum(1.0, 0.02 * low), np.maximum((c - low) / 2, 1e-3))
    lower = np.maximum(low - h, 1.0)
    slope = (ratio(own, c, low + h) - ratio(own, c, lower)) / (low + h - lower)
    sd = 1 / np.sqrt(np.maximum(-slope, 1e-12))
    out = np.clip(np.rint(low + 0.5 + sd * rng.standard_normal(len(c))), 1, c)
    near = np.flatnonzero(sd <= WINDOW / 10)
    for at in range(0, len(near), 4096):
        i = near[at : at + 4096]
        first = np.maximum(1.0, np.rint(low[i]) - WINDOW // 2)
        grid = first[:, None] + np.arange(WINDOW - 1)[None, :]
        steps = ratio(own[i][:, None], c[i][:, None], np.minimum(grid, c[i][:, None]))
        steps[grid >= c[i][:, None]] = -np.inf
        log_p = np.concatenate([np.zeros((len(i), 1)), np.cumsum(steps, axis=1)], axis=1)
        out[i] = first + _pick(log_p, rng)
    return out.astype(np.int64)


class Range:
    """A range's dishes: words, contexts and customers, and what other ranges have of both."""

    def __init__(self, w_of: np.ndarray, u_of: np.ndarray, c: np.ndarray, n_words: int, n_contexts: int, spread: np.ndarray, settings: dict):
        self.settings, self.spread = settings, spread
        some = np.flatnonzero(c > 0)
        self.some, self.w, self.u, self.c = some, w_of[some], u_of[some], c[some]
        self.n_words, self.n_contexts = n_words, n_contexts
        # of contexts with numbers: dishes in other ranges
        types = np.bincount(self.u, minlength=n_contexts).astype(float)
        self.types, other = types, settings["other"]
        self.others = np.zeros(n_contexts)
        self.others[:other] = np.maximum(settings["types"] - types[:other], 0)
        # of the rest: the mean, less the dish's own customers
        rare = self.u >= other
        share = rare.sum() / max(1, self.c[rare].sum())
        self.unseen = np.where(rare & (settings["ranges"] > 1), share * np.maximum(settings["rare_mean"] - self.c, 0), 0.0)
        self.hot = np.flatnonzero(spread >= 0)
        m = np.bincount(self.w, minlength=n_words)
        self.m_others, self.root_others = np.zeros(n_words), np.zeros(n_words)
        self.m_others[self.hot] = np.maximum(settings["hot_types"][spread[self.hot]] - m[self.hot], 0)
        self.all_others = max(0.0, settings["M"] - m.sum())
        self.words_others = max(0.0, settings["V"] - (m > 0).sum())

    def seatings(self, g: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each kept seating: tables of the dishes, of words as the parent's customers, and the parent's own."""
        x = self.settings
        d, s, d0, s0 = x["d"], x["s"], x["d0"], x["s0"]
        rng = np.random.default_rng([x["seed"], g])
        many = np.flatnonzero(self.c > 1)
        t = np.ones(len(self.c), np.int64)
        root = np.minimum(np.bincount(self.w, minlength=self.n_words), 1)
        turn = rng.integers(0, 4, len(many))
        last = x["burn"] + x["gap"] * (x["samples"] - 1)
        for i in range(last + 1):
            for part in range(4):
                m = np.bincount(self.w, t, self.n_words)
                t_u = np.bincount(self.u, t, self.n_contexts)
                growth = float(m.sum()) / max(1, len(self.c))
                more = self.others * (t_u + 10 * growth) / (self.types + 10)
                m_all = m + self.m_others * growth
                total = s0 + m.sum() + self.all_others * growth
                k_all = root.sum() + self.words_others * (root.sum() / max(1, (root > 0).sum()))
                new = (s0 + d0 * k_all) / (x["V"] + 1)
                own = many[turn == part]
                w, u = self.w[own], self.u[own]
                start = s + d * (t_u[u] - t[own] + more[u] + self.unseen[own] * growth)
                rest, k = m_all[w] - t[own], root[w] * (1 + self.m_others[w] / np.maximum(self.types_of(w), 1))

                def weight(i: np.ndarray, j: np.ndarray, start=start, rest=rest, k=k, new=new, total=total) -> np.ndarray:
                    there = rest[i] + j
                    return (start[i] + d * j) * np.maximum(there - d0 * np.minimum(k[i], there) + new, 1e-300) / total

                t[own] = draw_tables(self.c[own], weight, d, rng)
            m = np.bincount(self.w, t, self.n_words).astype(np.int64)
            root = self.word_tables(m, root, rng)
            if i >= x["burn"] and (i - x["burn"]) % x["gap"] == 0:
                yield t.copy(), m, root.copy()

    def types_of(self, w: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_word_types"):
            self._word_types = np.bincount(self.w, minlength=self.n_words)
        return self._word_types[w]

    def word_tables(self, m: np.ndarray, root: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of each word in the word restaurant, given its customers."""
        x = self.settings
        d0, s0 = x["d0"], x["s0"]
        out = np.minimum(m, 1)
        dishes = np.flatnonzero(m > 1)
        others = root.sum() + self.words_others * (root.sum() / max(1, (root > 0).sum()))
        rest = np.maximum(others - root[dishes], 0)
        out[dishes] = draw_tables(m[dishes], lambda i, j: (s0 + d0 * (rest[i] + j)) / (x["V"] + 1), d0, rng)
        return out


def _merge(key: tuple, table: pa.Table, settings: dict) -> pa.Table:
    """Merge a range's postings: one row with the range's dishes, its postings and its numbers of dishes."""
    g = key[0].as_py()
    if g < 0:
        return _row(g, table.column("blob")[0].as_py(), b"", b"")
    other = settings["other"]
    names, parts = zip(*sorted((pair for b in table.column("blob") for pair in _parted(b.as_py())), key=lambda pair: pair[0]))
    words, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    rare = np.unique(np.concatenate([p[8] for p in parts]))  # contexts without a number
    entry, at = [], 0
    for w, runs_, u, *_, own in parts:
        u = u.astype(np.int64)
        u[u == other] += np.searchsorted(rare, own)
        entry.append((np.repeat(back[at : at + len(w)], runs_) << 32) | u)
        at += len(w)
    entries, number = np.unique(np.concatenate(entry), return_inverse=True)
    number = number.astype(np.int32)
    del entry, back
    c = np.bincount(number, np.concatenate([p[4] for p in parts])).astype(np.int64)
    w_of, u_of = entries >> 32, entries & LOW
    n_words = len(words)
    c_word = np.bincount(w_of, c, n_words).astype(np.int64)
    spread = _number(settings["hot"], np.arange(len(settings["hot"])), words, -1)
    postings = []
    at = 0
    for name, (_, _, u, n, _, doc, count, (n_docs,), _) in zip(names, parts):
        own_entries = number[at : at + len(u)]
        at += len(u)
        postings.append((name, _small(np.diff(own_entries, prepend=0)), _small(n), _small(doc), _small(count), int(n_docs)))
    data = _pack(_small(np.diff(w_of, prepend=0)), np.minimum(u_of, other).astype(np.uint16), _small(u_of[u_of >= other] - other), _small(c), _small(c_word), spread, rare)
    one = c > 0
    m = np.bincount(w_of[one], minlength=n_words).astype(np.int64)
    cold = m[spread < 0]
    about = np.array([m.sum(), (c == 1).sum(), (c == 2).sum(), (cold == 1).sum(), (cold == 2).sum()])
    sums = {0: (np.bincount(np.minimum(u_of[one], other), minlength=other + 1)[:other].astype(np.int64), about, np.bincount(spread[spread >= 0], m[spread >= 0], len(settings["hot"])).astype(np.int64))}
    return _row(g, data, _pack(postings), _pack(sums))


def _opened(data: bytes, settings: dict) -> tuple[Range, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A range, and its entries' words, contexts and customers, its words' tokens, spread words and hashed contexts."""
    w_of, code, of_rare, c, c_word, spread, rare = _unpack(data)
    u_of = code.astype(np.int64)
    u_of[u_of == settings["other"]] += of_rare
    w_of, c = np.cumsum(w_of, dtype=np.int64), c.astype(np.int64)
    return Range(w_of, u_of, c, len(c_word), settings["other"] + len(rare), spread, settings), w_of, u_of, c, c_word.astype(np.int64), spread, rare


def _sampled(settings: dict):
    """Rows (g, sums, rare): totals of a range's kept seatings."""
    other, hot = settings["other"], len(settings["hot"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, data in zip(b.column("g").to_pylist(), b.column("data").to_pylist()):
                r, _, u_of, c, _, spread, rare = _opened(data, settings)
                sums, of_rare = {}, [np.bincount(u_of, c, r.n_contexts)[other:]]
                for i, (t, m, root) in enumerate(r.seatings(g)):
                    t_u = np.bincount(r.u, t, r.n_contexts).astype(np.int64)
                    of_rare.append(t_u[other:])
                    sums[i] = t_u[:other], np.array([m.sum(), root.sum()]), *(np.bincount(spread[spread >= 0], x[spread >= 0], hot).astype(np.int64) for x in (m, root))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([_pack(sums)], pa.binary()), pa.array([_pack(rare, *(_small(x.astype(np.int64)) for x in of_rare))], pa.binary())], ["g", "sums", "rare"])

    return work


def _row(g: int, data: bytes, postings: bytes, sums: bytes) -> pa.Table:
    return pa.table([pa.array([g], pa.int64()), *(pa.array([x], pa.binary()) for x in (data, postings, sums))], names=["g", "data", "postings", "sums"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sample, kind, number, n) of a task's ranges, added up."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for blob in b.column("sums").to_pylist():
            for i, kinds in _unpack(blob)[0].items():
                for kind, x in enumerate(kinds):
                    found[i, kind] = found[i, kind] + x if (i, kind) in found else x
    for (i, kind), x in found.items():
        some = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i)), pa.array(np.full(len(some), kind)), pa.array(some), pa.array(x[some])], ["sample", "kind", "number", "n"])


def _sent(buckets: int):
    """Rows (bucket, g, blob): customers and tables, by sample, that a range has of the contexts without a number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, blob in zip(b.column("g").to_pylist(), b.column("rare").to_pylist()):
                rare, *sums = _unpack(blob)
                edge = np.searchsorted((rare >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(edge)).tolist()
                blobs = [_pack(*(_small(x[edge[i] : edge[i + 1]]) if k else x[edge[i] : edge[i + 1]] for k, x in enumerate((rare, *sums)))) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([g] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "g", "blob"])

    return work


def _answered(key: tuple, table: pa.Table) -> pa.Table:
    """Rows (bucket, g, blob): the exact totals over all ranges, in the order in which the range has sent its own."""
    parts = [_unpack(x) for x in table.column("blob").to_pylist()]
    rare, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    totals = [np.bincount(back, np.concatenate([p[k] for p in parts]), len(rare)).astype(np.int64) for k in range(1, len(parts[0]))]
    edge = np.cumsum([0, *(len(p[0]) for p in parts)])
    blobs = [_pack(*(_small(x[back[a:z]]) for x in totals)) for a, z in zip(edge[:-1], edge[1:])]
    return pa.table([table.column("bucket"), table.column("g"), pa.array(blobs, pa.binary())], names=["bucket", "g", "blob"])


def _chances(g: int, data: bytes, answers: list | None, settings: dict, totals: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Words and contexts of a range's entries, their chances averaged over the seatings, and their words' training tokens."""
    d, s, d0, s0, v = (settings[k] for k in ("d", "s", "d0", "s0", "V"))
    r, w_of, u_of, c, c_word, spread, _ = _opened(data, settings)
    answers = [_unpack(a["blob"]) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    # the contexts with a number, then the range's others
    rare_c, *rare_t = [np.concatenate(x).astype(float) for x in zip(*answers)] or [np.zeros(0)] * (1 + len(totals))
    c_all = np.concatenate([settings["c_u"], rare_c])[u_of]
    hot = spread >= 0
    c_word[hot] = settings["hot_n"][spread[hot]]
    p = np.zeros(len(w_of))
    for i, (own_t, m, root) in enumerate(r.seatings(g)):
        t_u, (m_all, t_all), hot_m, hot_root = totals[i]
        m, root, t = m.astype(float), root.astype(float), np.zeros(len(c))
        m[hot], root[hot] = hot_m[spread[hot]], hot_root[spread[hot]]
        parent = ((m - d0 * root + (s0 + d0 * t_all) / (v + 1)) / (s0 + m_all))[w_of]
        t[r.some] = own_t
        p += (c - d * t + (s + d * np.concatenate([t_u, rare_t[i]])[u_of]) * parent) / (s + c_all)
    return w_of, u_of, p / len(totals), c_word[w_of]


def _shares(settings: dict, totals: dict[int, list[np.ndarray]]):
    """Rows (block, g, blob): shares of the scores of a block's documents, from the ranges up to g."""
    n, v = settings["N"], settings["V"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = g = 0
        for b in batches:
            for g, data, posted, answers in zip(*(b.column(x).to_pylist() for x in ("g", "data", "postings", "answers"))):
                _, _, p, c_word = _chances(g, data, answers, settings, totals)
                log_p, log_base, known = np.log10(p), np.log10((c_word + 1.0) / (n + v + 1.0)), c_word > 0
                for name, step, times, doc, count, n_docs in _unpack(posted)[0]:
                    e = np.repeat(np.cumsum(step, dtype=np.int64), times)
                    count = count.astype(float)
                    sums = [np.bincount(doc, count * x[e], n_docs) for x in (log_p, log_base, known)]
                    if name in held:
                        for x, y in zip(held[name], sums):
                            x += y
                    else:
                        held[name] = sums
                        size += 24 * n_docs
                if size > HELD_BYTES:
                    yield from _shown(held, g)
                    held, size = {}, 0
        yield from _shown(held, g)

    return work


def _shown(held: dict[int, list[np.ndarray]], g: int) -> Iterator[pa.RecordBatch]:
    """A task's shares of each block: documents touched, and sums in fixed point, which takes half a double's bytes."""
    names = sorted(held)
    for at in range(0, len(names), 64):
        some, blobs = names[at : at + 64], []
        for name in some:
            score, base, known = held[name]
            touched = np.flatnonzero((score != 0) | (base != 0) | (known > 0))
            blobs.append(_pack(_small(np.diff(touched, prepend=0)), *(_small(np.rint(x[touched] * FIXED).astype(np.int64)) for x in (score, base)), _small(known[touched].astype(np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([g] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["block", "g", "blob"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(n: int):
    def work(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("g").to_numpy(), kind="stable")
        blobs = table.column("blob")
        ids, size = _unpack(blobs[int(order[0])].as_py())
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for i in order[1:]:
            step, a, b, k = _unpack(blobs[int(i)].as_py())
            at = np.cumsum(step, dtype=np.int64)
            score[at] += a.astype(float) / FIXED
            base[at] += b.astype(float) / FIXED
            known[at] += k
        return pa.table([pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(size.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), n)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return work


def _frequent(counts: DataFrame, most: int) -> list:
    """The most frequent words, down to a level of frequency that at most ``most`` of them reach. (A sorted limit would
    send as many rows from every task.)"""
    level = F.floor(F.log2("n") * 64)
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return [] if least is None else counts.filter(F.col("n") >= least).orderBy("w").collect()


def _collected(rows: DataFrame, sizes: tuple[int, ...], samples: int) -> dict[int, list[np.ndarray]]:
    """The totals of all ranges: for each sample, arrays of these sizes."""
    totals = {i: [np.zeros(n) for n in sizes] for i in range(samples)}
    for r in rows.select("sums").mapInArrow(_totals, "sample long, kind long, number long, n long").groupBy("sample", "kind", "number").agg(F.sum("n").alias("n")).collect():
        totals[r["sample"]][r["kind"]][r["number"]] = r["n"]
    return totals


def _discount(n1: float, n2: float, default: float) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 and n2 else default


def _bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """Written to the shared folder in buckets of ``by``, so that a later join with rows spread alike leaves it in place."""
    spark = df.sparkSession
    name = f"postings_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{scratch(spark).rstrip('/')}/{name}").bucketBy(buckets, by).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def pitman_yor_scores(docs: DataFrame, contexts: int = 60_000, discount: float | None = None, strength: float = 1.0, burn: int = 3, samples: int = 3, gap: int = 1, seed: int = 11, range_tokens: int = 700_000) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``contexts``: how many contexts have numbers, at most 65,533, so that one takes two bytes: those above a level of
    frequency that no more than so many words reach. The results don't depend on it but for chance. ``discount``: of the
    restaurants of preceding words, instead of the estimate.
    """
    spark = docs.sparkSession
    local_arrow_rows(spark)
    counts = materialize(word_counts(docs), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(1, min(1 << 20, math.ceil(n / range_tokens)))
    end = int(T.signed(np.array([END]))[0])
    top = _frequent(counts.filter(F.col("w") != end), min(contexts, 65_533))
    least = min((r["n"] for r in top), default=None)
    below = counts.filter(F.col("w") != end) if least is None else counts.filter((F.col("n") < least) & (F.col("w") != end))
    square, total = below.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum("n")).first()
    hashes = np.array([r["w"] for r in top], np.int64).view(np.uint64)
    context = np.append(hashes, BEGIN)
    order = np.argsort(context)
    trained = docs.select(F.count_if(~(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)))).first()[0]
    c_u = np.array([r["n"] for r in top] + [trained], float)
    spread = counts.filter(F.col("n") * 4 * ranges > n).collect()  # fewer than four for each range
    hot = np.array([r["w"] for r in spread], np.int64).view(np.uint64)
    hot_order = np.argsort(hot)
    light = {"other": len(context), "hot": hot[hot_order]}
    rows = docs.select("doc_id", "text").mapInArrow(_postings((context[order], order), light["hot"], ranges), "g long, block long, blob binary")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return _merge(key, table, light)

    spans = min(ranges, 4096)
    merged = _bucketed(rows.repartition(spans, "g").groupBy("g").applyInArrow(merge, "g long, data binary, postings binary, sums binary"), "g", spans)
    parts = merged.filter("g >= 0")
    types, (dishes, once, twice, words_once, words_twice), hot_types = _collected(parts, (len(context), 5, len(hot)), 1)[0]
    settings = light | {
        "ranges": ranges, "d": _discount(once, twice, 0.8) if discount is None else discount, "s": strength, "d0": _discount(words_once, words_twice, 0.5), "s0": strength, "N": n, "V": v, "M": dishes, "types": types,
        "hot_types": hot_types, "rare_mean": square / total if total else 0.0, "seed": seed, "burn": burn, "samples": samples, "gap": gap,
    }
    sampled = materialize(parts.select("g", "data").mapInArrow(_sampled(settings), "g long, sums binary, rare binary"), "seatings")
    totals = _collected(sampled, (len(context), 2, len(hot), len(hot)), samples)
    buckets = max(1, ranges // 16)
    answers = sampled.select("g", "rare").mapInArrow(_sent(buckets), "bucket long, g long, blob binary").groupBy("bucket").applyInArrow(_answered, "bucket long, g long, blob binary")
    answers = answers.repartition(spans, "g").groupBy("g").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
    scoring = settings | {"c_u": c_u, "hot_n": np.array([r["n"] for r in spread], np.int64)[hot_order]}
    shares = parts.select("g", "data", "postings").join(answers, "g", "left").mapInArrow(_shares(scoring, totals), "block long, g long, blob binary")
    lists = merged.filter("g < 0").select((-1 - F.col("g")).alias("block"), "g", F.col("data").alias("blob"))
    return lists.unionByName(shares).groupBy("block").applyInArrow(_finish(n), SCORES)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor_scores(load(spark, sf_dir, "documents"))
