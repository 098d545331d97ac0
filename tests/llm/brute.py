"""Plain Python versions of the operators' contracts."""

import re
import zlib
from collections import Counter

LOW = {c: c + 32 for c in range(65, 91)}
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOW))


def shingles(text):
    w = words(text, SPACED)
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, components(pairs, ids)


def windows(item, n=8):
    w = words(item, ALNUM)
    return [tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def matches(text, items):
    """Word count, hit words, ids of the items found."""
    w = words(text, ALNUM)
    hit, found = set(), set()
    for i, t in items:
        for g in set(windows(t)):
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def held_out(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def train_counts(rows):
    c = Counter()
    for i, t, *_ in rows:
        if not held_out(i, 7, 2):
            c.update([*words(t, SPACED), "<end>"])
    return c
