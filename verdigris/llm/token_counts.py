"""Operator 1: exact token counts, with overlap resynchronisation for huge documents.

A document longer than ``chunk`` characters is cut into overlapping chunks, each encoded by itself with offsets. Two
neighbours are spliced at a boundary between pre-tokens that both found inside their overlap and that can't change with
what follows: pre-tokenization scans from left to right without looking back, so from a common boundary on both scans
agree, and a boundary that lies ``margin`` characters before the end of the left chunk can't be moved by text beyond
it. Where no such boundary is found (one word may fill the overlap) the overlap is doubled, and the right chunk is
encoded anew from farther left, at last from the left chunk's own beginning, joined with it.

Shorter documents without special strings or rare white space are counted piece by piece (see ``tokenizer``): ASCII
white space cuts are exact for this family of pre-tokenizers (GPT-2's pattern).

Null and empty texts have no tokens. Repeated rows are counted each by itself; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import text as T
from verdigris.llm.tokenizer import PieceCache, cache, default_path, tokenizer
from verdigris.session import load, local_arrow_rows

#: White space outside ASCII, and the special strings' first characters: such texts are encoded whole.
RARE = r"<\||[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def splice(encode, text: str, chunk: int, overlap: int, margin: int = 16) -> tuple[int, int]:
    """Number of tokens of ``text`` and how often an overlap was widened. ``encode`` gives offsets and word ids."""
    n, total, widened = len(text), 0, 0
    # left: its begin (a true boundary), its end, the token starts and pre-token numbers
    begin = 0
    end = min(n, chunk)
    starts, firsts = _encoded(encode, text, begin, end)
    while end < n:
        back = overlap
        while True:
            right = max(begin, end - back)
            right_end = min(n, right + chunk + back) if right > begin else min(n, end + chunk)
            r_starts, r_firsts = _encoded(encode, text, right, right_end)
            if right == begin:  # the two joined: nothing to align
                begin, end, starts, firsts = begin, right_end, r_starts, r_firsts
                break
            common = np.intersect1d(starts[firsts], r_starts[r_firsts])
            common = common[(common > right) & (common <= end - margin)]
            if len(common):
                cut = int(common[-1])
                total += int(np.searchsorted(starts, cut))
                keep = r_starts >= cut
                begin, end, starts, firsts = cut, right_end, r_starts[keep], r_firsts[keep]
                break
            widened += 1
            back *= 2
    return total + len(starts), widened


def _encoded(encode, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of text[begin:end] start, and which of them begin a pre-token."""
    e = encode(text[begin:end])
    starts = np.array([o[0] for o in e.offsets], np.int64) + begin
    ids = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) & (starts[1:] > starts[:-1])
    return starts, first


def piece_counts(data: np.ndarray, offsets: np.ndarray, pieces: PieceCache, spaces: dict[bytes, int]) -> np.ndarray:
    """Tokens of each text, none of which has special strings or white space outside ASCII."""
    w = T.words(data, offsets, T.SPACED, fold=False)
    n_docs = len(offsets) - 1
    if not len(w.hash):
        counts = np.zeros(n_docs, np.int64)
    else:
        doc = w.doc()
        gap_from = np.concatenate([[0], w.end[:-1]])
        gap_from = np.maximum(gap_from, offsets[doc])
        gap = w.start - gap_from
        spaced = (gap > 0) & (data[np.maximum(w.start - 1, 0)] == 32)
        with np.errstate(over="ignore"):
            key = T.mix(w.hash + spaced.astype(np.uint64) * T.U(0x632BE59BD9B4E019))
        lead = w.start - spaced
        raw = data.tobytes()
        _, c = pieces.find(key, lambda i: raw[lead[i] : w.end[i]].decode())
        total = np.concatenate([[0], np.cumsum(c, dtype=np.int64)])
        counts = total[w.at[1:]] - total[w.at[:-1]]
        odd = np.flatnonzero(gap - spaced > 0)
        if len(odd):
            extra = np.fromiter((_space(raw[a:b], s, pieces, spaces) for a, b, s in zip(gap_from[odd].tolist(), w.start[odd].tolist(), spaced[odd].tolist())), np.int64, len(odd))
            counts += np.bincount(doc[odd], extra, n_docs).astype(np.int64)
    # white space at a text's end is one piece
    some = w.at[1:] > w.at[:-1]
    last = offsets[:-1].copy()
    last[some] = w.end[w.at[1:][some] - 1]
    for i in np.flatnonzero(last < offsets[1:]).tolist():
        counts[i] += _run(data[last[i] : offsets[i + 1]].tobytes(), pieces, spaces)
    return counts


def _run(run: bytes, pieces: PieceCache, spaces: dict[bytes, int]) -> int:
    if run not in spaces:
        if len(spaces) > 100_000:
            spaces.clear()
        n = len(tokenizer(pieces.path).encode(run.decode(), add_special_tokens=False).ids)
        if len(run) > 64:
            return n
        spaces[run] = n
    return spaces[run]


def _space(run: bytes, spaced: bool, pieces: PieceCache, spaces: dict[bytes, int]) -> int:
    """Tokens of white space before a word: all but the last character are one piece; a last blank goes with the word."""
    head = _run(run[:-1], pieces, spaces) if len(run) > 1 else 0
    return head if spaced else head + _run(run[-1:], pieces, spaces)


_spaces: dict[str, dict[bytes, int]] = {}


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = 50_000, overlap: int = 512, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_widened`` of every document; no shuffle."""
    path = path or default_path("byte_bpe_50k.json")
    local_arrow_rows(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(batch.column("text").cast(pa.string()), "")
        t = tokenizer(path)
        counts, widened = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        long = pc.greater(pc.utf8_length(text), chunk).to_numpy(zero_copy_only=False)
        rare = pc.match_substring_regex(text, RARE).to_numpy(zero_copy_only=False) & ~long
        for i in np.flatnonzero(long).tolist():
            counts[i], widened[i] = splice(lambda s: t.encode(s, add_special_tokens=False), text[i].as_py(), chunk, overlap)
        if rare.any():
            counts[rare] = [len(e.ids) for e in t.encode_batch_fast(text.filter(pa.array(rare)).to_pylist(), add_special_tokens=False)]
        plain = ~(long | rare)
        if plain.any():
            counts[plain] = piece_counts(*T.buffers(text.filter(pa.array(plain))), cache(path, False), _spaces.setdefault(path, {}))
        size = pc.binary_length(text).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(counts), pa.array(counts > limit), pa.array(widened)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_widened"])

    return docs.select("doc_id", "text").mapInArrow(T.scan(work), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_widened long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))
