"""Operator 9: benchmark decontamination with a generalised suffix automaton over words.

The items' words (a-z lower-cased runs of letters, digits and non-ASCII) build one automaton; a document's words stream
through it and the length of the longest match ending at each word is tracked. Where it reaches ``window`` words (8), a
window of every item that contains those words occurs; an item of fewer words, but not none, must occur as a whole.

Streaming is needed only where a match can be long enough: words are looked up by hash, and only runs of neighbours that
are neighbours in some item, of the shortest length that any item's window asks for, enter the automaton. This leaves
out no match, as all neighbours in an occurring window are neighbours in the item.

The automaton is broadcast for items of ``most_bytes`` at most; a larger benchmark is split by item into groups, each
scanned in a pass of its own, and the passes' spans are united. ``decontaminate`` removes the spans from the texts and
drops documents with too many items or too much covered. Null texts have no words; items without id are left out;
repeated rows are treated each by itself; an empty benchmark finds nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import text as T
from verdigris.session import load, local_arrow_rows, materialize


class SuffixAutomaton:
    """Generalised suffix automaton over integer words, with the items behind each window."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, set[int]]]] = {}
        for item, words in items:
            v = 0
            for p, w in enumerate(words):
                v = self.next[v][w]
                if p + 1 >= window:
                    self.full.setdefault(self._up(v, window), set()).add(item)
            if 0 < len(words) < window:
                own = self.short.setdefault(self._up(v, len(words)), [])
                for n, some in own:
                    if n == len(words):
                        some.add(item)
                        break
                else:
                    own.append((len(words), {item}))

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _up(self, v: int, n: int) -> int:
        """The state of the suffix of n words."""
        while self.len[self.link[v]] >= n:
            v = self.link[v]
        return v

    def matches(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Word spans of occurring windows, the items they are of, and the longest match."""
        spans, items, longest, v, n = [], set(), 0, 0, 0
        for p, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if w in self.next[v]:
                v = self.next[v][w]
                n += 1
            longest = max(longest, n)
            if n >= self.window:
                items |= self.full[self._up(v, self.window)]
                spans.append((p + 1 - self.window, p + 1))
            if self.short:
                u = v
                while u > 0:
                    for size, some in self.short.get(u, ()):
                        if size <= n:
                            items |= some
                            spans.append((p + 1 - size, p + 1))
                    u = self.link[u]
        return spans, items, longest


class Index:
    """The automaton behind its filters: known words, known neighbours, the shortest run worth streaming."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int):
        self.known = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        ids = [(i, np.searchsorted(self.known, h)) for i, h in items if len(h)]
        self.automaton = SuffixAutomaton([(i, x.tolist()) for i, x in ids], window)
        pairs = [x[:-1] * len(self.known) + x[1:] for _, x in ids if len(x) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.least = min((min(len(x), window) for _, x in ids), default=window)
        self.singles = np.array(sorted({int(x[0]) for _, x in ids if len(x) == 1}), np.int64)
        if self.least == 1:  # items of one word are looked up by themselves
            self.least = min((min(len(x), window) for _, x in ids if len(x) > 1), default=window)
        self.single_items: dict[int, set[int]] = {}
        for i, x in ids:
            if len(x) == 1:
                self.single_items.setdefault(int(x[0]), set()).add(i)

    def scan(self, hash: np.ndarray, at: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int], int]]:
        """By document: merged word spans (within all words), items and longest match, where there are any."""
        found: dict[int, tuple[list, set, int]] = {}
        if not len(self.known) or not len(hash):
            return found
        ids = np.searchsorted(self.known, hash)
        ids[ids == len(self.known)] = 0
        ids[self.known[ids] != hash] = -1

        def add(doc: int, spans, items, longest) -> None:
            old = found.get(doc, ([], set(), 0))
            found[doc] = old[0] + spans, old[1] | items, max(old[2], longest)

        if len(self.singles):
            for p in np.flatnonzero(np.isin(ids, self.singles)).tolist():
                add(int(np.searchsorted(at, p, "right")) - 1, [(p, p + 1)], self.single_items[int(ids[p])], 1)
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if len(both) and len(self.pairs):
            code = ids[both] * len(self.known) + ids[both + 1]
            spot = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            both = both[self.pairs[spot] == code]
            ok = np.zeros(len(hash) + 1, bool)
            ok[both] = True
            ok[at[1:][at[1:] > 0] - 1] = False  # not across documents
            edge = np.diff(np.concatenate([[0], ok.view(np.int8)]))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = stop - start >= max(1, self.least - 1)
            for a, b in zip(start[long].tolist(), stop[long].tolist()):
                spans, items, longest = self.automaton.matches(ids[a : b + 1].tolist())
                if items:
                    add(int(np.searchsorted(at, a, "right")) - 1, [(a + s, a + e) for s, e in spans], items, longest)
        return {d: (_merged(s), i, n) for d, (s, i, n) in found.items()}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, items array<string>, longest long, spans array<struct<word: long, end_word: long, start: long, stop: long>>"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, most_bytes: int = 16 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and doc_id of every document with ``n_words, items, longest, spans`` (word and UTF-8 byte ranges)."""
    spark = docs.sparkSession
    local_arrow_rows(spark)
    usable = benchmark.filter("item_id is not null").select("item_id", "text")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // most_bytes) or 1
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    source = docs.select(*names, *([] if "text" in names else ["text"]))
    if groups > 1:
        source = materialize(source.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        names = [*names, "_row"]
    schema = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in names) + ", " + FOUND
    parts = []
    for g in range(groups):
        rows = usable.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id").collect()
        texts = T.words(*T.buffers(pa.array([r["text"] for r in rows], pa.string())), T.ALNUM)
        items = [(r["item_id"], texts.hash[texts.at[i] : texts.at[i + 1]]) for i, r in enumerate(rows)]
        parts.append(source.mapInArrow(T.scan(_matcher(spark.sparkContext.broadcast(items), window, names)), schema))
    if groups == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = every.groupBy("_row").agg(*[F.first(n).alias(n) for n in names if n != "_row"], F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<word: bigint, end_word: bigint, start: bigint, stop: bigint>>), (done, s) ->
        if(size(done) > 0 AND s.word <= element_at(done, -1).end_word,
           concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).word as word, greatest(element_at(done, -1).end_word, s.end_word) as end_word, element_at(done, -1).start as start, greatest(element_at(done, -1).stop, s.stop) as stop))),
           concat(done, array(s))))""")
    return merged.withColumn("spans", joined).drop("_row")


_built: dict[str, Index] = {}


def _matcher(shared, window: int, names: list[str]):
    key = uuid.uuid4().hex  # a worker builds the automaton once and keeps it

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _built:
            _built.clear()
            _built[key] = Index(shared.value, window)
        w = T.words(*T.buffers(batch.column("text")), T.ALNUM)
        found = _built[key].scan(w.hash, w.at)
        base = T.buffers(batch.column("text"))[1]
        items, longest, spans = [], [], []
        for d in range(batch.num_rows):
            s, i, n = found.get(d, ((), (), 0))
            items.append([str(x) for x in i])
            longest.append(n)
            spans.append([{"word": a - int(w.at[d]), "end_word": b - int(w.at[d]), "start": int(w.start[a] - base[d]), "stop": int(w.end[b - 1] - base[d])} for a, b in s])
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("word", "end_word", "start", "stop")]))
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(w.at)), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()), pa.array(spans, kind)], [*names, "n_words", "items", "longest", "spans"])

    return work


def hit_words():
    return F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.end_word - s.word)"), F.lit(0).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, most_items: int = 1, most_coverage: float = 0.5) -> DataFrame:
    """Documents without benchmark passages: those with more than ``most_items`` items, or more than ``most_coverage`` of
    their words in occurring windows, are dropped; from the others the spans are cut out. Columns as before; n_chars, where
    there is one, follows the text."""
    columns = docs.columns
    # other columns may have the names of the matches: they travel under numbers
    number = {c: f"_c{i}" for i, c in enumerate(columns) if c not in ("doc_id", "text", "n_chars")}
    found = benchmark_matches(docs.withColumnsRenamed(number), benchmark, window, keep=tuple(number.get(c, c) for c in columns))
    kept = found.filter((F.size("items") <= most_items) & (hit_words() <= most_coverage * F.col("n_words")))
    raw = F.expr("""concat_ws('', transform(sequence(0, size(spans)), i -> decode(
        substring(encode(text, 'utf-8'), cast(if(i = 0, 0, spans[i - 1].stop) + 1 as int),
                  cast(if(i = size(spans), octet_length(text), spans[i].start) - if(i = 0, 0, spans[i - 1].stop) as int)), 'utf-8')))""")
    out = kept.withColumn("text", F.when(F.size("spans") > 0, raw).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(number.get(c, c)).alias(c) for c in columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP9_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 8) AS k, unnest(list_transform(range(1, greatest(len(w) - 6, 2)), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM b WHERE len(w) > 0),
size AS (SELECT DISTINCT k FROM win),
gram AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, size WHERE len(w) >= k),
occ AS MATERIALIZED (SELECT DISTINCT doc_id, p, k, item_id FROM gram JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS i FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
