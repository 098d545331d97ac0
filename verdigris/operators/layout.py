"""Text and tables from word boxes of PDF pages: ``doc, page, text, left, right, top, bottom`` (y grows upwards).

Words are put into lines greedily from the top, each with the last line whose first word is near enough, which depends on
what came before; so a page is handled as a whole, in a grouped Arrow function. A page is a bounded group.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

from verdigris.functions.markdown import table
from verdigris.session import ship

Box = tuple[str, float, float, float, float]


def _grouped(words: list[Box], y, near: float) -> list[list[Box]]:
    lines: list[list[Box]] = []
    for w in sorted(words, key=y, reverse=True):
        for line in reversed(lines):
            if abs(y(line[0]) - y(w)) <= near:
                line.append(w)
                break
        else:
            lines.append([w])
    return [sorted(line, key=lambda w: w[1]) for line in lines]


def page_lines(words: list[Box]) -> list[str]:
    """Lines from top to bottom, an empty one at a gap of more than one and a half lines; ``.12`` joins the next line."""
    if not words:
        return []
    height = sum(w[3] - w[4] for w in words) / len(words)
    lines = _grouped(words, lambda w: (w[3] + w[4]) / 2, 0.5 * height)
    spans = [(max(w[3] for w in line), min(w[4] for w in line)) for line in lines]
    mean = sum(t - b for t, b in spans) / len(spans)
    out: list[str] = []
    for i, line in enumerate(lines):
        if i and spans[i - 1][1] - spans[i][0] > 1.5 * mean:
            out.append("")
        out.append(" ".join(w[0] for w in line))
    merged: list[str] = []
    for text in out:
        if merged and re.fullmatch(r"\.\d+", merged[-1]):
            merged[-1] += text
        else:
            merged.append(text)
    return merged


def page_table(words: list[Box], gap: float = 10.0, near: float = 3.0, widest: int = 8) -> list[list[str]] | None:
    """Rows of cells, if at least two rows and three tenths of them have several; short rows keep all their cells."""
    if len(words) < 4:
        return None
    rows = []
    for line in _grouped(words, lambda w: w[4], near):
        cells = [[line[0]]]
        for a, b in zip(line, line[1:]):
            if b[1] - a[2] > gap:
                cells.append([])
            cells[-1].append(b)
        rows.append([" ".join(w[0] for w in c) for c in cells])
    several = [len(r) for r in rows if len(r) > 1]
    if len(several) < 2 or len(several) < 0.3 * len(rows):
        return None
    counts = Counter(several)
    width = min(widest, max(counts, key=lambda n: (counts[n], n)))
    return [r if len(r) <= width else [*r[: width - 1], " ".join(r[width - 1 :])] for r in rows]


def page_markdown(words: list[Box]) -> str:
    cells = page_table(words)
    return table(cells) if cells else "\n".join(page_lines(words))


def pages_markdown(boxes: DataFrame) -> DataFrame:
    """``doc, page, markdown`` with a heading for each page."""
    ship(boxes.sparkSession)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words = list(pdf[["text", "left", "right", "top", "bottom"]].itertuples(index=False, name=None))
        return pd.DataFrame({"doc": [key[0]], "page": [key[1]], "markdown": [f"## Page {key[1]}\n\n{page_markdown(words)}"]})

    return boxes.groupBy("doc", "page").applyInPandas(one, f"doc {boxes.schema['doc'].dataType.simpleString()}, page int, markdown string")
