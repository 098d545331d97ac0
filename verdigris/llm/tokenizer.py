"""Exact token ids through a cache of encoded pieces, shared by the operators that count or pack tokens.

Where a tokenizer's pre-tokenization can't look across a certain cut, the ids of a text are those of its pieces one
after another. Pieces are found by their 64-bit hashes in sorted arrays; only unseen ones go through the library.
"""

from __future__ import annotations

import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: A cache that holds more pieces is begun anew, so a worker's memory is bounded.
MOST_PIECES = 1_500_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once in a worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


class PieceCache:
    """Ids of pieces by hash: those of entry i are ``pool[start[i]:start[i] + count[i]]``."""

    def __init__(self, path: str, ids: bool, most: int = MOST_PIECES):
        self.path, self.ids, self.most = path, ids, most
        self.clear()

    def clear(self) -> None:
        self.key, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool and count of each hash; ``piece(i)`` gives the string behind ``hashes[i]``."""
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.key) > self.most:
            self.clear()
        at = np.searchsorted(self.key, unique)
        known = np.zeros(len(unique), bool)
        if len(self.key):
            known = self.key[np.minimum(at, len(self.key) - 1)] == unique
        new = np.flatnonzero(~known)
        if len(new):
            found = tokenizer(self.path).encode_batch_fast([piece(i) for i in first[new].tolist()], add_special_tokens=False)
            lists = [e.ids for e in found]
            count = np.fromiter(map(len, lists), np.int32, len(lists))
            start = len(self.pool) + np.cumsum(count, dtype=np.int64) - count
            if self.ids:
                self.pool = np.concatenate([self.pool, np.fromiter((i for x in lists for i in x), np.int32, int(count.sum()))])
            spot = at[new]
            self.key = np.insert(self.key, spot, unique[new])
            self.start = np.insert(self.start, spot, start)
            self.count = np.insert(self.count, spot, count)
            at = np.searchsorted(self.key, unique)
        return self.start[at][back], self.count[at][back]


_caches: dict[tuple[str, bool], PieceCache] = {}


def cache(path: str, ids: bool) -> PieceCache:
    """The worker's cache for a tokenizer; it outlives a task."""
    return _caches.setdefault((path, ids), PieceCache(path, ids))
