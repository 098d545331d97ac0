"""Operator 10: license scan with a positional rare-token index.

Templates are word sequences with a label and mandatory key phrases. The words of all templates are the license words;
their document frequencies are counted over the whole corpus. In each file every template has its own rare words: its
``rarest`` words with the highest IDF that the file holds, and as many more as it takes that no beginning with enough
words in place is missed. They are looked up in the index (word -> template, position), and each occurrence votes for the
template's beginning at its place minus the position; votes that agree are the intersection of postings by relative
position. Beginnings with enough of the template's rare words are verified: every key phrase must stand at its place,
give or take ``slack`` words. A verified template gives its label and a score, the IDF share of its words in place.

Base places (fixed phrases, each word next to the other) are found apart from that, in every whole text; their labels
always stay. Null texts have no words; repeated rows are scanned each by itself; no templates or rows give no labels.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import text as T
from verdigris.session import load, local_arrow_rows

#: phrase -> label of the base places.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, wording, mandatory phrases within it).
TEMPLATES = [
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0-1.0", "released under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]


def _words(phrase: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", phrase.translate({c: c + 32 for c in range(65, 91)}))


class Templates:
    """The index: license words by hash, postings, key phrases as (position, word number) lists."""

    def __init__(self, templates, phrases: dict[str, str]):
        names = sorted({w for _, t, _ in templates for w in _words(t)} | {w for p in phrases for w in _words(p)})
        hashes = np.array([T.word_hash(w) for w in names], np.uint64)
        order = np.argsort(hashes)
        self.hash, number = hashes[order], {names[o]: i for i, o in enumerate(order.tolist())}
        self.labels = [t[0] for t in templates]
        self.body = [[number[w] for w in _words(t)] for _, t, _ in templates]
        self.keys = []
        for body, (_, _, keys) in zip(self.body, templates):
            own = []
            for k in keys:
                want = [number[w] for w in _words(k)]
                at = next(i for i in range(len(body)) if body[i : i + len(want)] == want)
                own.append((at, want))
            self.keys.append(own)
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, body in enumerate(self.body):
            for p, w in enumerate(body):
                self.postings.setdefault(w, []).append((t, p))
        self.phrases = [([number[w] for w in _words(p)], label) for p, label in phrases.items()]

    def numbers(self, hash: np.ndarray) -> np.ndarray:
        """The license word at each place, or -1."""
        if not len(self.hash):
            return np.full(len(hash), -1)
        at = np.searchsorted(self.hash, hash)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == hash, at, -1)

    def base(self, ids: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """For each phrase the places where it begins."""
        out = []
        inside = np.repeat(at[1:], np.diff(at))  # end of each word's document
        for want, label in self.phrases:
            places = np.flatnonzero(ids == want[0])
            for k, w in enumerate(want[1:], 1):
                places = places[places + k < inside[places]]
                places = places[ids[places + k] == w]
            out.append((places, label))
        return out

    def rare(self, t: int, present: set[int], idf: np.ndarray, rarest: int, least: float) -> set[int]:
        """The words of template t that vote. Those left out and any single voter weigh less than ``least`` together."""
        body = self.body[t]
        weight = {w: idf[w] * body.count(w) for w in present.intersection(body)}
        order = sorted(weight, key=lambda w: (-idf[w], w))
        n = min(rarest, len(order))
        enough = least * math.fsum(idf[w] for w in body) * (1 - 1e-9)
        while n < len(order) and max((weight[w] for w in order[:n]), default=0.0) + math.fsum(weight[w] for w in order[n:]) >= enough:
            n += 1
        return set(order[:n])

    def find(self, places: np.ndarray, ids: np.ndarray, idf: np.ndarray, rarest: int, slack: int, least: float) -> tuple[set[str], float]:
        """Labels and best score of a file, from its license words' places and numbers."""
        present = set(ids.tolist())
        rare = [self.rare(t, present, idf, rarest, least) for t in range(len(self.body))]
        votes: dict[tuple[int, int], set[int]] = {}
        for p, w in zip(places.tolist(), ids.tolist()):
            for t, q in self.postings.get(w, ()):
                if w in rare[t]:
                    votes.setdefault((t, p - q), set()).add(w)
        there = dict(zip(places.tolist(), ids.tolist()))
        labels, best = set(), 0.0
        for (t, begin), found in sorted(votes.items()):
            body = self.body[t]
            if len(found) < min(2, len(rare[t])):
                continue
            if not all(any(all(there.get(begin + at + d + i) == w for i, w in enumerate(want)) for d in range(-slack, slack + 1)) for at, want in self.keys[t]):
                continue
            total = math.fsum(idf[w] for w in body)
            share = math.fsum(idf[w] for i, w in enumerate(body) if there.get(begin + i) == w) / total if total > 0 else 0.0
            if share >= least:
                labels.add(self.labels[t])
                best = max(best, share)
        return labels, min(1.0, best)


def word_frequencies(docs: DataFrame, index: Templates) -> tuple[np.ndarray, int]:
    """Documents with each license word, and all documents, over the whole table."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = T.words(*T.buffers(batch.column("text")), T.ALNUM)
        ids = index.numbers(w.hash)
        at = np.flatnonzero(ids >= 0)
        pairs = np.unique(w.doc()[at] * len(index.hash) + ids[at])
        seen, n = np.unique(pairs % max(1, len(index.hash)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(n, batch.num_rows))], ["word", "n"])

    rows = docs.select("text").mapInArrow(T.scan(work), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(len(index.hash), np.int64), 0
    for r in rows:
        if r["word"] < 0:
            n = r["n"]
        else:
            df[r["word"]] = r["n"]
    return df, n


_indexes: dict[str, Templates] = {}


def license_scan(docs: DataFrame, templates=None, phrases: dict[str, str] | None = None, rarest: int = 12, slack: int = 1, least: float = 0.6) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; labels are arrays."""
    local_arrow_rows(docs.sparkSession)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    df, n = word_frequencies(docs, Templates(templates, phrases))
    idf = np.log1p((n + 1) / (df + 0.5))  # positive, however common a word is
    key = uuid.uuid4().hex

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = Templates(templates, phrases)
        index = _indexes[key]
        w = T.words(*T.buffers(batch.column("text")), T.ALNUM)
        ids = index.numbers(w.hash)
        docs_n = batch.num_rows
        n_base = np.zeros(docs_n, np.int64)
        first, last = np.full(docs_n, np.iinfo(np.int64).max), np.full(docs_n, -1)
        base: list[set[str]] = [set() for _ in range(docs_n)]
        for places, label in index.base(ids, w.at):
            doc = np.searchsorted(w.at, places, "right") - 1
            n_base += np.bincount(doc, minlength=docs_n)
            np.minimum.at(first, doc, places - w.at[doc])
            np.maximum.at(last, doc, places - w.at[doc])
            for d in np.unique(doc).tolist():
                base[d].add(label)
        labels, score = [sorted(b) for b in base], np.zeros(docs_n)
        at = np.flatnonzero(ids >= 0)
        doc = np.searchsorted(w.at, at, "right") - 1
        edges = np.searchsorted(doc, np.arange(docs_n + 1))
        # a file that lacks a word of every template's key phrases can't be verified
        have = np.zeros((docs_n, len(index.hash)), bool)
        have[doc, ids[at]] = True
        some = np.zeros(docs_n, bool)
        for own in index.keys:
            some |= have[:, sorted({x for _, want in own for x in want})].all(axis=1)
        for d in np.flatnonzero(some).tolist():
            own = slice(edges[d], edges[d + 1])
            found, score[d] = index.find(at[own] - w.at[d], ids[at[own]], idf, rarest, slack, least)
            labels[d] = sorted(base[d] | found)
        none = n_base == 0
        strings = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(w.at)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(b) for b in base], strings), pa.array(labels, strings), pa.array(score)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )

    return docs.select("doc_id", "text").mapInArrow(T.scan(work), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(load(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
