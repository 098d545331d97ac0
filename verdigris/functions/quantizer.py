"""Tables of the data-oblivious quantizer: a seeded rotation and the Lloyd-Max codebook of a rotated unit vector.

Both depend on the dimension and bit width alone, so they are small constants made on the driver.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEED = 42


def chacha8_words(seed: int, blocks: int) -> np.ndarray:
    """``blocks`` x 16 words of the ChaCha stream cipher with four double rounds; all blocks at once."""
    state = np.zeros((16, blocks), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4], state[5] = seed & 0xFFFFFFFF, seed >> 32
    state[12] = np.arange(blocks, dtype=np.uint64).astype(np.uint32)
    x = state.copy()

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for p, q, r, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[p] += x[q]
            x[r] ^= x[p]
            x[r] = x[r] << np.uint32(turn) | x[r] >> np.uint32(32 - turn)

    for _ in range(4):
        for i in range(4):
            quarter(i, i + 4, i + 8, i + 12)
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
    return (x + state).T.reshape(-1)


def normals(n: int, seed: int = SEED) -> np.ndarray:
    """The first n standard normals by the polar method, both of each accepted pair in turn."""
    pairs = n
    while True:
        w = chacha8_words(seed, -(-4 * pairs // 16)).astype(np.uint64)
        unit = ((w[0::2] << np.uint64(21)) | (w[1::2] >> np.uint64(11))).astype(np.float64) / 2.0**53
        u, v = 2 * unit[0::2] - 1, 2 * unit[1::2] - 1
        s = u * u + v * v
        ok = (s < 1) & (s > 0)
        if 2 * ok.sum() >= n:
            u, v, s = u[ok], v[ok], s[ok]
            f = np.sqrt(-2 * np.log(s) / s)
            return np.stack([u * f, v * f], 1).reshape(-1)[:n]
        pairs *= 2


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """Orthogonal dim x dim matrix (float32 values) from normals filled by column; R's diagonal is positive."""
    q, r = np.linalg.qr(normals(dim * dim).reshape(dim, dim, order="F"))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@lru_cache(maxsize=32)
def codebook(bits: int, dim: int, rounds: int = 200, grid: int = 200_001) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (2**bits - 1) and centroids (2**bits) for a coordinate of a random unit vector."""
    x = np.linspace(-1, 1, grid)
    with np.errstate(divide="ignore"):
        log_f = (dim - 3) / 2 * np.log1p(-np.minimum(x * x, 1))
    f = np.exp(log_f)
    mass = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2)])
    moment = np.concatenate([[0], np.cumsum((x[1:] * f[1:] + x[:-1] * f[:-1]) / 2)])
    c = np.linspace(-3, 3, 1 << bits) / np.sqrt(2 * dim)
    for _ in range(rounds):
        edges = np.concatenate([[-1], (c[1:] + c[:-1]) / 2, [1]])
        m, s = np.diff(np.interp(edges, x, mass)), np.diff(np.interp(edges, x, moment))
        new = np.where(m > 1e-15 * mass[-1], s / np.maximum(m, 1e-300), c)
        done = np.abs(new - c).max() < 1e-12
        c = new
        if done:
            break
    c = (c - c[::-1]) / 2  # exactly symmetric
    return ((c[1:] + c[:-1]) / 2).astype(np.float32), c.astype(np.float32)


def encode(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x dim) and scales (n) of row vectors; a zero vector has scale 0."""
    v = v.astype(np.float64)
    dim = v.shape[1]
    bounds, centroids = (a.astype(np.float64) for a in codebook(bits, dim))
    norm = np.sqrt((v * v).sum(1))
    unit = v * np.where(norm > 1e-10, 1 / np.maximum(norm, 1e-300), 0)[:, None]
    rotated = unit @ rotation(dim).astype(np.float64).T
    codes = np.searchsorted(bounds, rotated, "left").astype(np.int8)
    dot = (rotated * centroids[codes]).sum(1)
    scale = np.where(norm > 1e-10, norm / np.maximum(dot, 1e-10), 0)
    return codes, scale


def tables(q: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit look-up tables (queries x dim x levels) of rotated queries, their steps and biases."""
    dim = q.shape[1]
    rotated = q.astype(np.float64) @ rotation(dim).astype(np.float64).T
    products = rotated[:, :, None] * codebook(bits, dim)[1].astype(np.float64)
    low, high = products.min((1, 2)), products.max((1, 2))
    step = np.where(high - low > 1e-12, (high - low) / 255, 1.0)
    return np.clip(np.rint((products - low[:, None, None]) / step[:, None, None]), 0, 255).astype(np.uint8), step, low * dim


def pack_planes(codes: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes, low bit first, most significant bit first within a byte."""
    return np.concatenate([np.packbits((codes >> p) & 1, axis=1) for p in range(bits)], 1)


def unpack_planes(packed: np.ndarray, bits: int, dim: int) -> np.ndarray:
    planes = packed.reshape(len(packed), bits, dim // 8)
    return sum((np.unpackbits(planes[:, p], axis=1) << p for p in range(bits))).astype(np.int8)
