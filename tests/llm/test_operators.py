"""Each operator on odd rows, empty tables and rows without doc_id, against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tests.llm import brute
from tests.llm.conftest import ODD, words
from verdigris.llm import decontam, kd_shards, licenses, near_dedup, order_minhash, packing, pitman_yor, queries, token_counts, toxic_features, toxicity, url_trie
from verdigris.llm import text as T
from verdigris.llm.tokenizer import PieceCache, default_path, tokenizer


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def once(df):
    """Rows by id; a repeated row's results must be equal."""
    got = by_id(df)
    assert all(len(set(map(str, v))) == 1 for v in got.values())
    return {k: v[0] for k, v in got.items()}


# 1


def test_token_counts(docs, empty, nameless, rows):
    t = tokenizer(default_path("byte_bpe_50k.json"))
    for chunk in (50_000, 64):
        df = token_counts.token_counts(docs, chunk=chunk, overlap=16)
        got = once(df)
        assert df.count() == len(rows)
        for i, text, *_ in rows:
            n = len(t.encode(text or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024), text
    assert token_counts.token_counts(empty).isEmpty()
    assert token_counts.token_counts(nameless).count() == 3


def test_splicing():
    t = tokenizer(default_path("byte_bpe_50k.json"))
    encode = lambda s: t.encode(s, add_special_tokens=False)
    rng = random.Random(5)
    bits = ["a", "Bc ", " ", "  ", "\n", "'re", "12", "é", "!", "<|endoftext|>", "\u00a0", "ß" * 9, "x'l"]
    widened = 0
    for _ in range(150):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 300)))
        for chunk, overlap in ((24, 4), (90, 20)):
            n, w = token_counts.splice(encode, s, chunk, overlap)
            assert n == len(encode(s).ids)
            widened += w
    assert widened  # overlaps too short for a common boundary were widened
    assert token_counts.splice(encode, "z" * 3000, 100, 20)[0] == len(encode("z" * 3000).ids)


# 2


def test_pitman_yor(docs, empty, nameless, rows):
    rows = [*rows]
    df = pitman_yor.pitman_yor_scores(docs)
    got = once(df)
    assert df.count() == len(rows)
    c = brute.train_counts(rows)
    n, v = sum(c.values()), len(c)
    for i, text, *_ in rows:
        w = [*brute.words(text, brute.SPACED), "<end>"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.held_out(i, 7, 2), len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * max(1, abs(r.base_score))
        assert r.score < 0
    held = [r for r in got.values() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.pitman_yor_scores(empty).isEmpty()
    assert pitman_yor.pitman_yor_scores(nameless).count() == 3


class Stage:
    """The operator's steps without a session: postings, ranges, samples, chances of all entries."""

    def __init__(self, rows, monkeypatch, ranges=1, contexts=(), **more):
        monkeypatch.setattr(pitman_yor, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
        c = brute.train_counts(rows)
        names = np.array([T.word_hash(w) for w in contexts] + [pitman_yor.BEGIN], np.uint64)
        order = np.argsort(names)
        light = {"other": len(names), "hot": np.zeros(0, np.uint64)}
        sent = list(pitman_yor._postings((names[order], order), light["hot"], ranges)(iter([batch])))
        by = {}
        for b in sent:
            for r in b.to_pylist():
                by.setdefault(r["g"], []).append(r["blob"])
        merged = {g: pitman_yor._merge((pa.scalar(g),), pa.table({"blob": blobs}), light).to_pylist()[0] for g, blobs in by.items() if g >= 0}
        types, about = np.zeros(len(names)), np.zeros(5)
        for r in merged.values():
            x, y, _ = pitman_yor._unpack(r["sums"])[0][0]
            types, about = types + x, about + y
        trained = sum(not brute.held_out(i, 7, 2) for i, _ in rows)
        self.settings = light | {"ranges": ranges, "d": 0.6, "s": 1.0, "d0": 0.4, "s0": 1.0, "N": sum(c.values()), "V": len(c), "M": about[0], "types": types, "hot_types": np.zeros(0), "rare_mean": 0.0, "seed": 1, "burn": 3, "samples": 3, "gap": 1,
                                 "c_u": np.array([c[w] for w in contexts] + [trained], float), "hot_n": np.zeros(0)} | more
        self.merged = merged

    def chances(self):
        """P(word | numbered context) of all entries."""
        x, totals = self.settings, {}
        for g, r in self.merged.items():
            batch = pa.RecordBatch.from_arrays([pa.array([g]), pa.array([r["data"]])], ["g", "data"])
            for b in pitman_yor._sampled(x)(iter([batch])):
                for i, kinds in pitman_yor._unpack(b.column("sums")[0].as_py())[0].items():
                    totals[i] = [p + q for p, q in zip(totals[i], kinds)] if i in totals else list(kinds)
        out = {}
        for g, r in self.merged.items():
            w, u, p, _ = pitman_yor._chances(g, r["data"], None, x, totals)
            out |= {(g, a, b): y for a, b, y in zip(w.tolist(), u.tolist(), p)}
        return out


@pytest.mark.parametrize("ranges", [1, 5])
def test_pitman_yor_adds_up(monkeypatch, ranges):
    """Over all known words, an unknown one and the end, a context's probabilities sum to one."""
    rng = random.Random(4)
    train = [(i, words(rng, 30, 12)) for i in range(400) if not brute.held_out(i, 7, 2)]
    known = sorted({w for _, t in train for w in t.split()})
    held = [i for i in range(1000, 90_000) if brute.held_out(i, 7, 2)]
    probes = [f"{u} {w}" for u in known for w in [*known, "never"]] + known + ["never", ""]
    stage = Stage([*train, *zip(held, probes)], monkeypatch, ranges, [*known, "never"])
    sums = {}
    for (_, _, u), p in stage.chances().items():
        sums[u] = sums.get(u, 0) + p
        assert 0 < p < 1
    del sums[len(known)]  # after the unknown word only the end was asked for
    assert len(sums) == len(known) + 1 and all(abs(x - 1) < 1e-9 for x in sums.values())
    # the same however rows are cut into blocks, and blocks sent together
    whole = stage.chances()
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 2000)
    for send in (1, 20_000):
        monkeypatch.setattr(pitman_yor, "SEND_BYTES", send)
        assert Stage([*train, *zip(held, probes)], monkeypatch, ranges, [*known, "never"]).chances() == whole


def exact_tables(c, words_of, contexts_of, d, s, d0, s0, v):
    """Mean tables of each dish and of each word at the parent, by summing over all numbers of tables."""
    import itertools

    S, S0 = np.exp(pitman_yor.stirling(d, 16)), np.exp(pitman_yor.stirling(d0, 32))
    rise = lambda a, step, n: math.prod(a + step * j for j in range(n))
    mean, root, total = np.zeros(len(c)), np.zeros(max(words_of) + 1), 0.0
    for t in itertools.product(*(range(1, x + 1) for x in c)):
        m = np.bincount(words_of, t).astype(int)
        p = math.prod(S[x, y] for x, y in zip(c, t)) * math.prod(rise(s, d, int(n)) for n in np.bincount(contexts_of, t)) / rise(s0, 1, int(m.sum()))
        for k in itertools.product(*(range(1, int(x) + 1) for x in m)):
            q = p * math.prod(S0[x, y] for x, y in zip(m, k)) * rise(s0, d0, sum(k)) / v ** sum(k)
            mean, root, total = mean + q * np.array(t), root + q * np.array(k), total + q
    return mean / total, root / total


def test_sweeps_reach_the_exact_distribution():
    """Mean tables of long chains against sums over all seatings of a small model."""
    c, w, u = np.array([6, 4, 2, 5, 1, 3]), np.array([0, 1, 2, 0, 1, 2]), np.array([0, 0, 0, 1, 1, 1])
    x = {"other": 2, "ranges": 1, "d": 0.6, "s": 1.0, "d0": 0.4, "s0": 1.0, "V": 3, "M": 6, "types": np.array([3.0, 3.0]), "hot_types": np.zeros(0), "rare_mean": 0.0, "seed": 5, "burn": 20, "samples": 4000, "gap": 1}
    r = pitman_yor.Range(w, u, c, 3, 2, np.full(3, -1), x)
    t, k = np.zeros(6), np.zeros(3)
    for own, _, root in r.seatings(0):
        t, k = t + own / 4000, k + root / 4000
    exact_t, exact_k = exact_tables(c.tolist(), w.tolist(), u.tolist(), 0.6, 1.0, 0.4, 1.0, 4)
    assert np.abs(t / exact_t - 1).max() < 0.06 and np.abs(k / exact_k - 1).max() < 0.08, (t, exact_t, k, exact_k)


def test_tables_of_many_customers():
    """Draws for dishes beyond the exact table against exact weights, from few tables to most customers alone."""
    rng = np.random.default_rng(2)
    d, c = 0.8, 400
    table = pitman_yor.stirling(d, c)
    for level in (0.5, 5.0, 80.0, 900.0):
        log_p = table[c, 1:] + np.cumsum(np.log(level + 0.1 * np.arange(c)))
        p = np.exp(log_p - log_p.max())
        p /= p.sum()
        t = np.arange(1, c + 1)
        mean = float((p * t).sum())
        sd = math.sqrt(float((p * (t - mean) ** 2).sum()))
        got = pitman_yor.draw_tables(np.full(3000, c), lambda i, j, level=level: level + 0.1 * j + 0 * i, d, rng)
        assert abs(got.mean() - mean) < 0.04 * mean + 0.1 * sd + 0.05 and abs(got.std() - sd) < 0.1 * sd + 0.1, (level, got.mean(), mean, got.std(), sd)
    few = pitman_yor.draw_tables(np.array([1, 2, 5, 128]), lambda i, j: 1e-9 + 0.0 * i + 0.0 * j, d, rng)
    assert few.tolist() == [1, 1, 1, 1]


def test_pitman_yor_has_every_context(spark):
    """A word's own continuation is likelier after it than others, whether its context has a number or is named by its hash."""
    train = [i for i in range(2000) if not brute.held_out(i, 7, 2)][:400]
    held = [i for i in range(5000) if brute.held_out(i, 7, 2)]
    texts = [(i, f"a{k % 50} b{k % 50}") for k, i in enumerate(train)]
    probes = [(held[2 * k], f"a{k} b{k}") for k in range(50)] + [(held[2 * k + 1], f"a{k} b{(k + 1) % 50}") for k in range(50)]
    df = spark.createDataFrame(texts + probes, "doc_id long, text string")
    every = {}
    for contexts in (0, 10, 60_000):
        got = {r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(df, contexts=contexts).collect()}
        assert all(got[held[2 * k]] > got[held[2 * k + 1]] + 1 for k in range(50))
        every[contexts] = got
    # only sampling differs
    assert all(abs(every[0][i] - every[60_000][i]) < 0.3 for i in every[0] if i in set(train))


# 3


def test_near_duplicates(docs, empty, nameless, rows):
    sets, label = brute.near_groups(rows)
    df = near_dedup.near_duplicates(docs)
    got = once(df)
    assert df.count() == len(rows)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), label[i], label[i] == i)
    assert near_dedup.near_duplicates(empty).isEmpty()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(nameless).collect()) == [(0, 0, True), (0, 1, False), (1, 1, True)]


def test_near_copies_in_a_large_bucket(spark):
    """A chain in which only neighbours are alike, and a group of many near copies."""
    rng = random.Random(2)
    base = words(rng, 100, 10**6).split()
    rows = []
    for i in range(40):
        base[rng.randrange(100)] = f"new{i}"
        rows.append((i, " ".join(base)))
    other = words(rng, 60, 10**6).split()
    rows += [(100 + i, " ".join([*other[:30], f"x{i}", *other[31:]])) for i in range(60)]
    sets, label = brute.near_groups(rows)
    got = once(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == label
    assert len(set(label.values())) < 20
    # links joined by stars, as where there are too many for the driver
    got = once(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), few_links=0))
    assert {i: r.component_id for i, r in got.items()} == label


def test_ranks_of_large_buckets(spark):
    """Ranks are gapless in every bucket, however it is split."""
    rows = [(i, 5, [1, 100 + i % 3, 1000 + i]) for i in range(500)]
    df = spark.createDataFrame(rows, "node long, n long, keys array<long>")
    for most in (1 << 16, 20):
        by = {}
        for r in near_dedup.bucket_members(df, most).collect():
            by.setdefault(r.key, []).append(r.rank)
        assert {k: sorted(v) for k, v in by.items()} == {k: list(range(len(v))) for k, v in by.items()} and len(by) == 4


def test_near_copies_without_doc_id(spark):
    """Rows without doc_id link, name no component that has one, and are told apart by their texts; so are rows that share a doc_id."""
    rng = random.Random(9)
    a, b, c = (words(rng, 60, 10**6).split() for _ in range(3))
    near = lambda w, i: " ".join([*w[:30], f"x{i}", *w[31:]])
    rows = [(None, near(a, 1)), (None, near(a, 2)), (None, near(a, 2)), (7, near(b, 1)), (None, near(b, 2)), (9, near(b, 3)), (9, " ".join(c)), (9, " ".join(c)), (None, ""), (None, None), (11, near(c, 1)), (12, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"c1": F.lit(1), "n": F.lit("n"), "node": F.lit(2)})
    got = near_dedup.near_duplicates(df)
    assert got.count() == len(rows)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in got.collect() if r.n_shingles > 2) == sorted([(0, 0, 59)] * 3 + [(7, 7, 59), (0, 7, 59), (9, 7, 59), (9, 9, 59), (9, 9, 59), (11, 9, 59)])
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns
    kept = sorted(((r.doc_id or 0, r.text or "") for r in out.collect()))
    assert [k for k in kept if k[0]] == [(7, near(b, 1)), (9, " ".join(c)), (12, "alone here")]
    assert sum(not t for i, t in kept) == 2 and sum(bool(t) and not i for i, t in kept) == 1


def test_deduplicate(docs, empty, nameless, rows):
    _, label = brute.near_groups(rows)
    out = near_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({i for i in label if label[i] == i})
    assert near_dedup.deduplicate(empty).isEmpty()
    assert sorted((r.doc_id or 0, r.text is None) for r in near_dedup.deduplicate(nameless).collect()) == [(0, True), (1, False)]


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(0)
    for n in (3, 50, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n - n // 2, dtype=np.uint64)]))
        s = near_dedup.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 240)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.12
    assert (near_dedup.superminhash(np.zeros(0, np.uint64), np.array([0, 0]), 8) == near_dedup.EMPTY).all()


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute.components(pairs, {x for p in pairs for x in p})
    assert all(want[n] == x for n, x in got.items()) and {n for n in want if want[n] != n} <= set(got)


# 4


@pytest.mark.parametrize("shards", [1, 7])
def test_shards(docs, empty, nameless, rows, shards):
    got = kd_shards.kd_shards(docs, shards).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    size = [0] * shards
    slots = {}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(t.encode()) + 16 for t in text.values())
    assert max(size) - sum(size) / shards <= largest
    assert kd_shards.kd_shards(empty, shards).isEmpty()
    assert kd_shards.kd_shards(nameless, shards).count() == 3
    assert kd_shards.kd_shards(nameless, target_bytes=40).select("shard").distinct().count() >= 2


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(5, 60)) for _ in range(3000)]
    texts += texts[:20] * 3
    df = spark.createDataFrame([(i, t, rng.choice(("en", "de")), "hot" if i % 3 else f"s{i % 9}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = kd_shards.kd_shards(df, 10).collect()
    size = np.bincount([r.shard for r in got], [r["size"] for r in got], 10)
    assert size.max() < 1.03 * size.mean() and size.min() > 0.97 * size.mean()
    where = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 0
    # grown in steps of a few subtrees: the same laws
    stepwise = kd_shards.kd_shards(df, 10, most_nodes=3).collect()
    size = np.bincount([r.shard for r in stepwise], [r["size"] for r in stepwise], 10)
    assert len(stepwise) == len(texts) and size.max() < 1.03 * size.mean() and size.min() > 0.97 * size.mean()
    assert sorted((r.shard, r.slot) for r in stepwise) == [(k, i) for k in range(10) for i in range(sum(r.shard == k for r in stepwise))]
    hot = spark.createDataFrame([(i, "copy of one text") for i in range(900)], "doc_id long, text string").select("*", F.lit("a").alias("lang"), F.lit("b").alias("source"))
    counts = [r["count"] for r in kd_shards.kd_shards(hot, 9).groupBy("shard").count().collect()]
    assert len(counts) == 9 and max(counts) < 1.05 * min(counts)  # a group that outweighs a shard is split


# 5


def labelled(spark, n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(5, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(("idiot", "STUPID", "you moron", "zorgle")))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_toxicity(spark, docs, empty, nameless, rows):
    own, labels, truth = labelled(spark)
    model = toxicity.fit(own, labels, toxicity.remainder() != 1)
    got = once(toxicity.toxicity_scores(own, model))
    held = [(r.score, truth[i]) for i, r in got.items() if brute.held_out(i, 3, 1)]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert auc > 0.97 and all(0 <= s <= 1 for s, _ in held)
    assert T.word_hash("zorgle") in model.cues.hash.tolist()  # a word that only the labels tell
    assert toxicity.toxicity_scores(docs, model).count() == len(rows)
    assert toxicity.toxicity_scores(empty, model).isEmpty()
    assert toxicity.toxicity_scores(nameless, model).count() == 3
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.select("score").first()[0] == 0.5
    none = toxicity.fit(own, labels.limit(0), F.lit(True))
    assert none.trees is None and toxicity.toxicity_scores(own, none).count() == 600


def brute_features(text, weights, near=5):
    """``toxic_features`` in plain Python, without disguises."""
    text = text or ""
    raw = text.encode()
    names, size = toxic_features.NAMES, max(len(raw), 1)
    out = dict.fromkeys(names, 0.0)
    if not raw:
        return out
    w = brute.words(text, brute.ALNUM)
    cased = brute.re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    n, some = len(w), max(len(w), 1)
    second = [i for i, x in enumerate(w) if x in toxic_features.SECOND]
    close = lambda hit: sum(any(abs(i - j) <= near for j in second) for i in hit) / max(len(hit), 1)
    lex = [i for i, x in enumerate(w) if x in toxic_features.LEXICON]

    def weight(word):
        b = word.encode()
        starts = [b[:k] for k in range(3, 11) if k <= len(b) and (k == len(b) or b[k] & 0xC0 != 0x80)] + [b]
        return max([0, *(weights.get(x.decode(), 0) for x in starts if len(x) > 2)])

    cue = [weight(x) for x in w]
    hit = [i for i, x in enumerate(cue) if x > 0]
    upper, punct, digits = (sum(c in group for c in raw) for group in (range(65, 91), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], range(48, 58)))
    out |= {"words": math.log1p(n), "lexicon": len(lex) / some, "lexicon_n": math.log1p(len(lex)), "second": close(lex), "capitals": upper / size, "shouting": sum(len(x) > 1 and all("A" <= c <= "Z" for c in x) for x in cased) / some}
    out |= {"punctuation": punct / size, "exclaimed": raw.count(b"!") / size, "digits": digits / size, "distinct": len(set(w)) / some, "lengthy": size / some}
    return out | {"cue_sum": math.log1p(sum(cue)), "cue_rate": sum(cue) / some, "cue_most": max(cue, default=0), "cue_n": math.log1p(len(hit)), "cue_second": close(hit)}


def test_toxicity_features(rows):
    """Features of odd texts, of a run and one by one, as plain Python has them; stems cover their endings."""
    weights = {"zor": 1.5, "zorgle": 4.0, "été": 2.0, "w17": 1.0, "日": 3.0}
    cues = toxic_features.Cues(np.array([T.word_hash(x) for x in weights], np.uint64), np.array(list(weights.values())))
    texts = [t for _, t, *_ in rows] + ["YOU zorgles, zorg and zörgle", "you! idiot idiot " + "x " * 9 + "moron", "étés Été ét", "日本 日 x", "!", "A! B! idiot"]
    got = toxic_features.features(*T.buffers(pa.array(texts, pa.string())), cues)
    for row, text in zip(got, texts):
        want = brute_features(text, weights)
        alone = toxic_features.features(*T.buffers(pa.array([text], pa.string())), cues)[0]
        assert np.allclose(row, alone), text
        for name, x in zip(toxic_features.NAMES, row):
            assert name.startswith("obfuscated") or abs(x - want[name]) < 1e-9, (name, text)


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("idiot", 0), ("1d10t", 1), ("an id1ot!", 1), ("i d i o t", 1), ("so i.d.i.o.t, yes", 1), ("i-d-i-o-t", 1), ("a i d i o t", 1), ("idiooooot", 1), ("idi*t and s**m", 2), ("íďiöt", 1), ("ｉｄｉｏｔ", 1),
        ("id-iot", 1), ("i\u200bdi\u00adot", 1), ("808 text! $5 @home", 0), ("idiot### you$$", 0), ("A. B. C. I am", 0), ("", 0), ("see mail9.example.com", 0), ("good *** day", 0), ("l0ser scum cl0wn", 2),
    ],
)
def test_disguises(text, count):
    """Disguised lexicon words are counted once, plain ones and other signs aren't, alone and among other texts."""
    for texts in ([text], ["an idiot", text, "x i", "d i o t"]):
        row = toxic_features.features(*T.buffers(pa.array(texts, pa.string())))[texts.index(text)]
        assert abs(row[toxic_features.NAMES.index("obfuscated_n")] - math.log1p(count)) < 1e-9


def test_toxicity_of_held_out_rows(spark):
    """Words learned by their stems: held-out rows of documents of another language than the lexicon's."""
    d = "/root/testdata/sf0.1"
    p = toxicity.op5_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    pos, neg = p[p.toxic == 1].score.to_numpy(), p[p.toxic == 0].score.to_numpy()
    order = np.argsort(np.argsort(np.concatenate([pos, neg]))) + 1
    auc = (order[: len(pos)].sum() - len(pos) * (len(pos) + 1) / 2) / len(pos) / len(neg)
    assert len(pos) > 100 and auc > 0.98 and (pos >= 0.7).mean() > 0.85 and (neg >= 0.7).mean() < 0.01


def test_trees_and_cues():
    """Trees fit an interaction; a cue weighs what its share among toxic rows surely tells."""
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    f = toxicity.Trees().fit(x[:1500], y[:1500]).raw(x[1500:])
    assert ((f > 0) == y[1500:]).mean() > 0.95
    cues = toxicity.weigh(np.array([1, 2, 3, 4], np.uint64), np.array([50, 2, 50, 3]), np.array([0, 0, 400, 0]), 100, 1000, 3)
    assert cues.hash.tolist() == [1, 4] and cues.weight[0] > 2 > cues.weight[1]


def test_isotonic():
    x, y = toxicity.isotonic(np.array([3.0, 1, 2, 2]), np.array([1.0, 0, 1, 0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


# 6


def test_order_minhash(spark, docs, empty, rows):
    df = order_minhash.edit_likeness(docs, per_range=20)
    got = df.collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    model = order_minhash.OrderMinHash()
    by = by_id(df)
    for k, (i, text, *_) in enumerate(order):
        if len(by[i]) > 1:
            continue
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        other = text[: len(text) - n] + following[:n]
        r, f = by[i][0], model.fingerprint(text)
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(other.encode()).hexdigest(), order_minhash.shown(f))
        assert r.near_edited == order_minhash.likeness(f, model.fingerprint(other)) and r.near_next == order_minhash.likeness(f, model.fingerprint(following))
    assert order_minhash.edit_likeness(empty).isEmpty()
    one = order_minhash.edit_likeness(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1


def test_order_minhash_without_or_with_repeated_ids(spark):
    """Rows without doc_id come first, rows that share one follow each other by text, also where a range ends between ids."""
    rng = random.Random(7)
    rows = [(i, words(rng, 12)) for i in (None, None, 5, 5, 5, 6, 7, 7, 9)] + [(5, ""), (None, None), (7, None)]
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, r[1] or ""))
    model, want = order_minhash.OrderMinHash(), []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        other = order_minhash.edited(text, following)
        want.append((str(i), len(text), hashlib.sha256(other.encode()).hexdigest(), order_minhash.likeness(model.fingerprint(text), model.fingerprint(following))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for per_range in (1, 2, 100):
        got = order_minhash.edit_likeness(df, per_range=per_range).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_next) for r in got) == sorted(want), per_range


def test_order_minhash_minima():
    """The selected tuple by sorting all elements, for short texts and ones of several steps."""
    m = order_minhash.OrderMinHash(k=4, hashes=6, tuple_size=3)
    rng = random.Random(1)
    for n in (1, 5, 40, 150_000):
        text = "".join(rng.choice("abc ") for _ in range(n))
        e = order_minhash.elements(text, 4)
        if n < 1000:
            assert len(set(e.tolist())) == len(e)  # occurrences differ
        with np.errstate(over="ignore"):
            v = (e[None, :] ^ m.add[:, None]) * m.times[:, None]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
        out = np.zeros(6, np.uint64)
        size = min(3, len(e))
        at = np.sort(np.argsort(v, axis=1, kind="stable")[:, :size], axis=1)
        with np.errstate(over="ignore"):
            for j in range(size):
                out = order_minhash.mix(out * np.uint64(0xA24BAED4963EE407) + e[at[:, j]].astype(np.uint64) + np.uint64(1))
        assert (m.fingerprint(text) == out).all()


def test_order_minhash_follows_edits():
    rng = random.Random(6)
    text = words(rng, 300, 5000)
    m = order_minhash.OrderMinHash()
    f = m.fingerprint(text)
    ws = text.split()
    swapped = " ".join([*ws[150:], *ws[:150]])
    few = text.replace(ws[10], "zzz", 1)
    assert order_minhash.likeness(f, m.fingerprint(few)) > order_minhash.likeness(f, m.fingerprint(swapped)) > order_minhash.likeness(f, m.fingerprint(words(rng, 300, 5000)))


# 7

URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://xexample.org/en/12", "https://com/fr/", "https://a.b.com/de/1", "https://a.com/fr", "ftp://org", "ftp://org/", "http://x.org:80/", "http://h.net#a/b", "x://a.org/?://b.com/fr/", "http://example.org/en/1"]


def test_url_trie(spark, duck):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string")
    duck.register("few", pages.toPandas()[["page_id", "url"]])
    df = url_trie.url_verdicts(pages, url_trie.RULES)
    same(df, duck, url_trie.OP7_SQL.replace("FROM pages", "FROM few"))
    nameless = url_trie.url_verdicts(spark.createDataFrame([(None, "http://a.net/x"), (None, None), (1, "http://example.org/es/")], "page_id long, url string"), url_trie.RULES)
    assert sorted((str(r.page_id), r.host, str(r.rule)) for r in nameless.collect()) == [("1", "example.org", "example.org/es/"), ("None", "", "None"), ("None", "a.net", "None")]
    table = spark.createDataFrame([*url_trie.RULES, ("allow", "example.org/es/"), (None, None)], "verdict string, rule string")
    for most in (10, 0):  # by trie, by join
        assert sorted(map(str, url_trie.url_verdicts(pages, table, most_rules=most).collect())) == sorted(map(str, df.collect()))
    assert url_trie.url_verdicts(pages.limit(0), url_trie.RULES).isEmpty()
    assert {r.verdict for r in url_trie.url_verdicts(pages, [], default="block").collect()} == {"block"}


# 8


def check_packing(got, rows, path, capacity):
    t = tokenizer(path)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity
    want, total = [], 0
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    return len(by), -(-total // capacity)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, empty, nameless, rows, capacity):
    path = default_path("word_bpe_49k.json")
    used, least = check_packing(packing.best_fit_packing(docs, capacity=capacity).collect(), rows, path, capacity)
    assert used <= 1.02 * least + 1
    assert packing.best_fit_packing(empty).isEmpty()
    assert packing.best_fit_packing(nameless).count() == 3


def test_packing_in_a_tree(docs, rows):
    path = default_path("word_bpe_49k.json")
    used, least = check_packing(packing.best_fit_packing(docs, capacity=128, fan_in=2, most=15).collect(), rows, path, 128)
    assert used <= 1.1 * least + 2


def test_packing_of_tiny_pieces(spark):
    """Groups bounded in pieces: thousands of short documents still share sequences."""
    df = spark.createDataFrame([(i, "a") for i in range(3000)], "doc_id long, text string").repartition(6)
    got = packing.best_fit_packing(df, capacity=40, fan_in=2, most_pieces=500).collect()
    used, least = check_packing(got, [(i, "a") for i in range(3000)], default_path("word_bpe_49k.json"), 40)
    assert used <= 1.1 * least + 2


def test_best_fit():
    rng = random.Random(2)
    sizes = np.array([rng.randint(1, 10) for _ in range(200)])
    room, want = [], []
    for s in sizes.tolist():
        fits = [b for b, r in enumerate(room) if r >= s]
        b = min(fits, key=lambda b: room[b]) if fits else len(room)
        if not fits:
            room.append(10)
        room[b] -= s
        want.append(room[b])
    out = packing.best_fit(sizes, 10)
    left, got = {}, []
    for b, s in zip(out.tolist(), sizes.tolist()):
        left[b] = left.get(b, 10) - s
        got.append(left[b])
    assert got == want


# 9


def test_decontamination(spark, docs, empty, nameless, rows):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:20])), (2, " ".join(texts[1].split()[:8])), (3, "two words"), (4, "emoji"), (5, None), (6, "..."), (7, " ".join(texts[0].split()[10:25]) + " other end of it"), (8, "unseen " * 9), (1, "two words")]
    bench = spark.createDataFrame([*items, (None, "two words")], "item_id long, text string")
    want = {i: brute.matches(t, [x for x in items if x[1]]) for i, t, *_ in rows}
    for bound in (1 << 20, 60):  # one automaton, several
        df = decontam.benchmark_matches(docs, bench, most_bytes=bound)
        got = once(df.select("doc_id", "n_words", decontam.hit_words().alias("hit"), F.array_sort("items").alias("items")))
        assert df.count() == len(rows)
        assert {i: (r.n_words, r.hit, r["items"]) for i, r in got.items()} == want
    assert any(h for _, h, _ in want.values())
    assert decontam.benchmark_matches(empty, bench).isEmpty()
    assert decontam.benchmark_matches(nameless, bench).count() == 3
    none = decontam.benchmark_matches(docs, bench.limit(0))
    assert none.filter("size(items) > 0").isEmpty() and none.count() == len(rows)


def test_decontaminated_texts(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    rows = [(1, f"É before, {item.upper()}; after " + "more words " * 20, 1), (2, item, 1), (3, "clean text", 10), (4, None, None), (5, f"{item} and kappa " + "x y " * 30 + " one two three four five six seven eight", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"items": F.lit("own"), "longest": F.lit(1)})
    bench = spark.createDataFrame([(1, item), (2, "one two three four five six seven eight nine")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(df, bench).collect()}
    assert sorted(got) == [1, 3, 4]  # 2 is all passage, 5 holds two
    assert got[1].text == "É before, ; after " + "more words " * 20 and got[1].n_chars == len(got[1].text)
    assert (got[3].text, got[3].n_chars, got[3]["items"], got[3].longest) == ("clean text", 10, "own", 1) and got[4].text is None
    assert decontam.decontaminate(docs, bench).columns == docs.columns


# 10


def test_license_scan(docs, empty, nameless, rows):
    df = licenses.license_scan(docs)
    got = once(df)
    assert df.count() == len(rows)
    for i, text, *_ in rows:
        w = brute.words(text, brute.ALNUM)
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels))
        assert labels <= set(r.labels) and 0 <= r.score <= 1
    apache = next(i for i, t, *_ in rows if t == ODD[16])
    assert got[apache].labels == ["apache", "apache-2.0"] and got[apache].score == 1
    assert licenses.license_scan(empty).isEmpty()
    assert licenses.license_scan(nameless).count() == 3


def test_license_scan_of_many_notices(spark):
    """However many notices a file holds, each gets its label."""
    wording = {label: t for label, t, _ in licenses.TEMPLATES}
    texts = [
        " ; ".join(wording.values()), f"{wording['isc']} {wording['cc-by-4.0']}", f"{wording['mit-text']} {wording['gpl-2.0']}", f"{wording['isc']} {wording['mit-notice']}",
        *[f"plain words number {i}" for i in range(200)],
    ]
    got = once(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, want in enumerate((set(wording), {"isc", "cc-by-4.0"}, {"mit-text", "gpl-2.0"}, {"isc", "mit-notice"})):
        assert set(got[i].labels) - set(licenses.PHRASES.values()) == want
    # a template whose rarest words don't stand in place, but enough of the others do
    body = [f"r{i}" for i in range(12)] + ["key", "phrase"] + [f"c{i}" for i in range(40)]
    index = licenses.Templates([("long", " ".join(body), ["key phrase"])], {})
    idf = np.zeros(len(index.hash))
    for i, w in enumerate(index.body[0]):
        idf[w] = 2.0 if i < 12 else 1.0
    ids = np.array(index.body[0][12:] + index.body[0][:12][::-1])
    assert index.find(np.arange(len(ids)), ids, idf, 12, 1, 0.6)[0] == {"long"}


def test_license_scan_of_common_notices(spark):
    """A notice is found in a table of any size, however many files hold it."""
    for n, more in ((1, 0), (3, 0), (4, 0), (40, 60)):
        texts = ["Licensed under the Apache License, Version 2.0."] * n + [f"plain words number {i}" for i in range(more)]
        got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert all(r.labels == (["apache", "apache-2.0"] if r.doc_id < n else []) and (r.doc_id >= n or r.score > 0.99) for r in got)


def brute_labels(text, templates, idf, slack=1, least=0.6):
    """Labels and score of the method, at every beginning of every template."""
    w = brute.words(text, brute.ALNUM)
    there = dict(enumerate(w))
    labels, best = set(), 0.0
    for label, body, keys in templates:
        body = body.split()
        total = math.fsum(idf[x] for x in body)
        places = []
        for key in keys:
            k = key.split()
            places.append((next(i for i in range(len(body)) if body[i : i + len(k)] == k), k))
        for begin in range(-len(body), len(w)):
            if all(any(all(there.get(begin + at + d + i) == x for i, x in enumerate(k)) for d in range(-slack, slack + 1)) for at, k in places):
                share = math.fsum(idf[x] for i, x in enumerate(body) if there.get(begin + i) == x) / total
                if share >= least:
                    labels.add(label)
                    best = max(best, share)
    return labels, min(1.0, best)


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_license_labels_by_brute_force(spark, share):
    """Whole, cut, changed and mixed notices, in corpora where none, some or all files have one."""
    rng = random.Random(int(share * 10))
    texts = []
    for i in range(120):
        t = words(rng, 20)
        if rng.random() < share:
            for _ in range(rng.choice((1, 1, 2, 4))):
                body = rng.choice(licenses.TEMPLATES)[1].split()
                for _ in range(rng.choice((0, 0, 1, 3))):
                    kind, at = rng.randrange(3), rng.randrange(len(body))
                    body = body[:at] + ([] if kind == 0 else ["other"] if kind == 1 else [body[at], "more"]) + body[at + 1 :]
                t += " " + " ".join(body) + rng.choice(("", ". ", " " + words(rng, 3)))
        texts.append(t)
    names = {x for _, body, _ in licenses.TEMPLATES for x in body.split()} | {x for p in licenses.PHRASES for x in p.split()}
    df = {x: sum(x in brute.words(t, brute.ALNUM) for t in texts) for x in names}
    idf = {x: math.log1p((len(texts) + 1) / (n + 0.5)) for x, n in df.items()}
    got = once(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    found = 0
    for i, t in enumerate(texts):
        labels, score = brute_labels(t, licenses.TEMPLATES, idf)
        assert set(got[i].labels) - set(got[i].base_labels) == labels - set(got[i].base_labels) and abs(got[i].score - score) < 1e-9, t
        found += bool(labels)
    assert (found > 0) == (share > 0)


# registered queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLE_SQL:
        same(df, duck, queries.ORACLE_SQL[name])
    else:
        n = duck.execute("SELECT count(*) FROM documents").fetchone()[0]
        assert df.count() == n or name.startswith("op8_")


def test_pieces_cache_forgets():
    c = PieceCache(default_path("word_bpe_49k.json"), True, most=2)
    texts = ["one", "two", "three", "four", "one"]
    for t in texts:
        start, count = c.find(np.array([hash(t) & 0xFFFFFFFF], np.uint64), lambda i, t=t: t)
        assert c.pool[start[0] : start[0] + count[0]].tolist() == tokenizer(c.path).encode(t, add_special_tokens=False).ids
        assert len(c.key) <= 3
