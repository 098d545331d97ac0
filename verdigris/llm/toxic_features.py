"""Dense features of a text for operator 5: lexicon and cue densities, second-person proximity, disguises, form.

*Cues* are beginnings of words (3 to 10 bytes that end between characters, or the whole word) that labelled rows have
weighted; a word counts with the largest weight among its beginnings, so that one stem covers all its endings.

*Disguises* are lexicon words that only appear once a text is undone of: digits and signs for letters (not signs at a
word's end), accents, full-width letters, invisible and combining characters, letters repeated three times or more,
letters set apart one by one, words cut by a hyphen, dot or underscore, and letters masked by ``*`` or ``#``.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from verdigris.llm import text as T

U = np.uint64
LEXICON = (
    "idiot idiots stupid moron morons loser losers pathetic worthless scum trash garbage disgusting clown fool fools dumb dumbass imbecile cretin jerk creep "
    "pig pigs vermin filth filthy bastard bastards coward cowards liar ugly freak freaks lunatic psycho retard retarded brainless useless despicable "
    "hate hated hateful shut kill crap damn shit bullshit fuck fucking fucker asshole bitch bitches slut whore piss prick cunt wanker twat "
    "salope connard idiote imbécile dummkopf trottel arschloch idioten pendejo estúpido estúpida estupido estupida basura imbécil imbecil"
).split()
SECOND = "you your yours yourself yourselves ya ur u tu toi vous votre vos ton ta tes du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros".split()
PREFIXES = range(3, 11)

LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"0134578@$!", b"oieastbasi"):
    LEET[_a] = _b
_SIGNS = T._class(b"@$!")
_LETTER = T._class([*range(65, 91), *range(97, 123)])
_APART = T._class(b" .-_*,/|")
_JOINT = T._class(b"-._")
_MASK = T._class(b"*#")
PUNCTUATION = T._class([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
#: The plain letter of a character of two bytes, 0 where it has none; 1 for one to leave out.
_PLAIN = np.zeros(1 << 11, np.uint8)
for _c in range(0xC0, 0x250):
    _d = unicodedata.normalize("NFD", chr(_c))
    if len(_d) > 1 and _d[0].isascii():
        _PLAIN[_c] = ord(_d[0])
_PLAIN[0x300:0x370] = 1
_PLAIN[0xAD] = 1  # soft hyphen


def hashes(words) -> np.ndarray:
    return np.unique(np.array([T.word_hash(w) for w in words], np.uint64)) if len(words) else np.zeros(0, np.uint64)


def _undone(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _collapsed(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if not i or c != word[i - 1])


def _masked(word: str) -> list[str]:
    """The word with one run of letters masked, of which the first and another stay."""
    n = len(word)
    return [word[:a] + "*" * (b - a) + word[b:] for a in range(1, n) for b in range(a + 1, n + 1) if n - (b - a) >= 2]


_BARE = sorted({_undone(w) for w in LEXICON})
_LEXICON, _SECOND = hashes(LEXICON), hashes(SECOND)
_UNDONE, _COLLAPSED = hashes(_BARE), hashes({_collapsed(w) for w in _BARE})
_MASKED = hashes({m for w in _BARE if len(w) > 3 for m in _masked(w)})
#: Words of a length, for letters set apart.
_LENGTHS = {n: hashes([w for w in _BARE if len(w) == n]) for n in sorted({len(w) for w in _BARE}) if n > 2}


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64 if flags.dtype == bool else float)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def beginnings(data: np.ndarray, w: T.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of the words' beginnings of each length in ``PREFIXES``, equal to the hash of such a word."""
    out, h = [], np.zeros(len(w.start), np.uint64)
    size = w.end - w.start
    some = np.arange(len(w.start))
    for j in range(PREFIXES[-1]):
        some = some[size[some] > j]
        with np.errstate(over="ignore"):
            h[some] += T._FOLDED[data[w.start[some] + j]] * T.powers(PREFIXES[-1])[0][j]
        if j + 1 in PREFIXES:
            after = data[np.minimum(w.start[some] + j + 1, len(data) - 1)]
            whole = some[(size[some] == j + 1) | (after & 0xC0 != 0x80)]
            with np.errstate(over="ignore"):
                out.append((whole, T.mix(h[whole] + U(j + 1) * U(0xD6E8FEB86659FD93))))
    long = np.flatnonzero(size > PREFIXES[-1])
    out.append((long, w.hash[long]))
    return out


def plain_letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with accents, full-width letters, invisible characters, digits and signs read as the letters they stand for."""
    out = LEET[data]
    following = np.zeros(len(data), bool)
    following[:-1] = T.ALNUM[data[1:]] | _SIGNS[data[1:]]
    end = np.zeros(len(data) + 1, bool)
    end[offsets] = True
    # a sign stands for a letter only inside a word
    bare = _SIGNS[data] & (~following | end[1:])
    for _ in range(3):  # and so do signs before such ones
        again = _SIGNS[data] & np.append(bare[1:], False) & ~bare
        if not again.any():
            break
        bare |= again
    out[bare] = data[bare]
    keep = None
    wide = np.flatnonzero(data >= 0xC2)
    wide = wide[wide + 1 < len(data)]
    if len(wide):
        lead, second = data[wide], data[wide + 1]
        two = lead < 0xE0
        at = wide[two]
        plain = _PLAIN[((lead[two].astype(np.int64) & 0x1F) << 6) | (second[two] & 0x3F)]
        keep = np.ones(len(data), bool)
        some = plain > 1
        out[at[some]] = plain[some]
        keep[at[some] + 1] = False
        gone = at[plain == 1]
        keep[gone], keep[gone + 1] = False, False
        three = wide[(lead >= 0xE0) & (lead < 0xF0)]
        three = three[three + 2 < len(data)]
        a, b, c = data[three], data[three + 1], data[three + 2]
        upper, lower = (a == 0xEF) & (b == 0xBC) & (c >= 0xA1) & (c <= 0xBA), (a == 0xEF) & (b == 0xBD) & (c >= 0x81) & (c <= 0x9A)
        out[three[upper]], out[three[lower]] = c[upper] - 0xA1 + 65, c[lower] - 0x81 + 97
        unseen = (a == 0xE2) & (b == 0x80) & (c >= 0x8B) & (c <= 0x8D) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
        for skip, some in ((0, unseen), (1, upper | lower | unseen), (2, upper | lower | unseen)):
            keep[three[some] + skip] = False
    if keep is None or keep.all():
        return out, offsets
    return out[keep], _sums(keep)[offsets]


def disguised(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Disguised lexicon words of each document; ``lexicon``: its plain ones."""
    p, at = plain_letters(data, offsets)
    w = T.words(p, at, T.ALNUM)
    hit = among(w.hash, _UNDONE)
    found = np.maximum(per_doc(hit, w.at) - lexicon, 0)
    folded = T.LOWER[p]
    letter = _LETTER[p]
    edge = np.zeros(len(p) + 1, bool)
    edge[at] = True
    # repeated letters
    same = np.zeros(len(p), bool)
    same[1:] = (folded[1:] == folded[:-1]) & letter[1:] & ~edge[1 : len(p)]
    thrice = np.zeros(len(p), bool)
    thrice[2:] = same[2:] & same[1:-1]
    if thrice.any():
        keep = ~same
        c = T.words(p[keep], _sums(keep)[at], T.ALNUM)
        runs = _sums(thrice)
        found += per_doc(among(c.hash, _COLLAPSED) & (runs[w.end] > runs[w.start]) & ~hit, w.at)
    # letters set apart by one or two signs
    size = w.end - w.start
    single = (size == 1) & letter[w.start] if len(w.start) else np.zeros(0, bool)
    linked = np.zeros(len(w.start), bool)
    if len(w.start) > 1:
        gap = w.start[1:] - w.end[:-1]
        linked[:-1] = single[:-1] & single[1:] & (gap <= 2) & _APART[p[np.minimum(w.end[:-1], len(p) - 1)]]
        linked[w.at[1:-1][(w.at[1:-1] > 0) & (w.at[1:-1] < len(linked))] - 1] = False
    if linked.any():
        chained = np.zeros(len(linked) + 1, np.int64)  # letters linked after each one
        last = np.flatnonzero(~linked)
        chained = last[np.searchsorted(last, np.arange(len(linked)))] - np.arange(len(linked))
        for n, known in _LENGTHS.items():
            some = np.flatnonzero(chained >= n - 1)
            h = np.zeros(len(some), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(n):
                    h += T._FOLDED[p[w.start[some + j]]] * T.powers(n)[0][j]
                h = T.mix(h + U(n) * U(0xD6E8FEB86659FD93))
            flag = np.zeros(len(linked), bool)
            flag[some] = among(h, known)
            found += per_doc(flag, w.at)
    # words cut by a sign between letters
    joint = np.zeros(len(p), bool)
    joint[1:-1] = _JOINT[p[1:-1]] & letter[:-2] & letter[2:] & ~edge[1 : len(p) - 1] & ~edge[2 : len(p)]
    if joint.any():
        keep = ~joint
        c = T.words(p[keep], _sums(keep)[at], T.ALNUM)
        cut = np.flatnonzero(joint)
        where = _sums(keep)[cut]  # in the joined text, the place after each cut
        inside = np.searchsorted(where, c.end, "left") - np.searchsorted(where, c.start, "right")
        long = c.end - c.start - inside > 1  # letters set apart are counted above
        found += per_doc(among(c.hash, _UNDONE) & (inside > 0) & long, c.at)
    # masked letters
    if _MASK[p].any():
        stars = np.where(_MASK[p], np.uint8(42), p)
        c = T.words(stars, at, _STARRED)
        found += per_doc(among(c.hash, _MASKED), c.at)
    return found


_STARRED = T.ALNUM.copy()
_STARRED[42] = True

BASE = ["words", "lexicon", "lexicon_n", "second", "capitals", "shouting", "punctuation", "exclaimed", "digits", "obfuscated", "obfuscated_n", "distinct", "lengthy"]
CUES = ["cue_sum", "cue_rate", "cue_most", "cue_n", "cue_second"]
NAMES = BASE + CUES


class Cues:
    """Weights of beginnings of words, by hash."""

    def __init__(self, hash: np.ndarray, weight: np.ndarray):
        order = np.argsort(hash)
        self.hash, self.weight = hash[order], weight[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash) or not len(h):
            return np.zeros(len(h))
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == h, self.weight[at], 0.0)


NO_CUES = Cues(np.zeros(0, np.uint64), np.zeros(0))


class Scanned:
    """A run of documents, scanned once; features with any cues follow."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, near: int = 5):
        self.data, self.offsets, self.near = data, offsets, near
        self.w = w = T.words(data, offsets, T.ALNUM)
        self.n = np.diff(w.at).astype(float)
        self.some = np.maximum(self.n, 1)
        self.second = _sums(among(w.hash, _SECOND))
        self.begin, self.end = np.repeat(w.at[:-1], np.diff(w.at)), np.repeat(w.at[1:], np.diff(w.at))
        self._starts: list[tuple[np.ndarray, np.ndarray]] | None = None

    @property
    def starts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if self._starts is None:
            self._starts = beginnings(self.data, self.w)
        return self._starts

    def close(self, hit: np.ndarray) -> np.ndarray:
        """The share of the hits with a second-person word within ``near`` words of the same document."""
        at = np.flatnonzero(hit)
        close = np.zeros(len(hit), bool)
        close[at] = self.second[np.minimum(at + self.near + 1, self.end[at])] > self.second[np.maximum(at - self.near, self.begin[at])]
        return per_doc(close, self.w.at) / np.maximum(per_doc(hit, self.w.at), 1)

    def distinct(self) -> np.ndarray:
        """Distinct words over words."""
        w = self.w
        key = np.sort((w.doc().astype(np.uint64) << U(40)) | (w.hash >> U(24)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return per_doc(new, w.at) / self.some

    def base(self) -> np.ndarray:
        data, offsets, w = self.data, self.offsets, self.w
        chars = np.maximum(np.diff(offsets), 1).astype(float)
        lex = among(w.hash, _LEXICON)
        upper = (data >= 65) & (data <= 90)
        ups = _sums(upper)
        size = w.end - w.start
        shouting = (size > 1) & (ups[w.end] - ups[w.start] == size)
        digits = (data >= 48) & (data <= 57)
        count = lambda flags: per_doc(flags, offsets)
        lex_n = per_doc(lex, w.at)
        hidden = disguised(data, offsets, per_doc(among(w.hash, _UNDONE), w.at)) if len(data) else np.zeros(len(self.n))
        columns = [
            np.log1p(self.n), lex_n / self.some, np.log1p(lex_n), self.close(lex), count(upper) / chars, per_doc(shouting, w.at) / self.some,
            count(PUNCTUATION[data]) / chars, count(data == 33) / chars, count(digits) / chars, hidden / self.some, np.log1p(hidden), self.distinct(), chars / self.some,
        ]
        out = np.stack(columns, 1)
        out[np.diff(offsets) == 0] = 0
        return out

    def cues(self, cues: Cues) -> np.ndarray:
        weight = np.zeros(len(self.w.hash))
        if len(cues.hash):
            for words, h in self.starts:
                weight[words] = np.maximum(weight[words], cues.of(h))
        total, hit = per_doc(weight, self.w.at), weight > 0
        most = np.zeros(len(self.n))
        at = np.flatnonzero(hit)
        np.maximum.at(most, np.searchsorted(self.w.at, at, "right") - 1, weight[at])
        return np.stack([np.log1p(total), total / self.some, most, np.log1p(per_doc(hit, self.w.at)), self.close(hit)], 1)


def features(data: np.ndarray, offsets: np.ndarray, cues: Cues = NO_CUES, near: int = 5) -> np.ndarray:
    """One row of ``NAMES`` for each document."""
    s = Scanned(data, offsets, near)
    return np.concatenate([s.base(), s.cues(cues)], 1)
