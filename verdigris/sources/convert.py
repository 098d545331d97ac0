"""Files to Markdown: a registry of converters over binary content, applied by ``mapInPandas`` with errors as a column.

A converter takes (bytes, info) and gives (markdown, title). The registry is tried by priority, then by registration; one
that finds it can't read an input raises ``Unsupported`` and the next is tried; other errors end up in ``error``.
"""

from __future__ import annotations

import base64
import csv
import io
import json
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from email.utils import format_datetime, parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.markdown import html_to_markdown, table
from verdigris.functions.text import EXTENSION_MIME, ISBN, ISBN_HEADS
from verdigris.operators.layout import page_markdown
from verdigris.session import ship
from verdigris.sources import web_pages
from verdigris.sources.chm import Chm
from verdigris.sources.pdf import Pdf

Result = tuple[str, str | None]


class Unsupported(Exception):
    """The converter can't take this input after all."""


@dataclass(frozen=True)
class Info:
    file_name: str | None = None
    extension: str | None = None
    mime_type: str | None = None
    charset: str | None = None
    url: str | None = None

    def merged(self, other: Info) -> Info:
        """The other's values where it has them."""
        return replace(self, **{k: v for k, v in vars(other).items() if v is not None})

    def normal(self) -> Info:
        name = self.file_name or (posixpath.basename(re.sub(r"[?#].*", "", self.url)) if self.url else None) or None
        ext = self.extension or (posixpath.splitext(name)[1].lower() if name else None) or None
        mime = self.mime_type or EXTENSION_MIME.get((ext or "").lstrip("."))
        return replace(self, file_name=name, extension=ext, mime_type=mime, charset=self.charset or ("utf-8" if (mime or "").startswith("text/") else None))


def decode(raw: bytes, declared: str | None = None) -> str:
    """Declared charset if it fits, byte-order mark, UTF-8, then the candidate that encodes back with fewest differences."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    for name in (declared, "utf-8"):
        try:
            if name:
                return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    best, least = raw.decode("latin-1"), None
    for name in ("cp932", "gbk", "big5", "cp949", "euc_jp", "latin-1"):
        text = raw.decode(name, "replace")
        back = text.encode(name, "replace")
        wrong = sum(a != b for a, b in zip(back, raw)) + abs(len(back) - len(raw))
        if least is None or wrong < least:
            best, least = text, wrong
    return best


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _one(e: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return None if e is None else next((x for x in e if _local(x) == name), None)


def _attr(e: ElementTree.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in z.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(posixpath.dirname(part), r.get("Target", ""))).lstrip("/") for r in _xml(z, name)}


def _zip(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ValueError("not a zip container") from e


def plain(raw: bytes, info: Info) -> Result:
    return decode(raw, info.charset), None


def html(raw: bytes, info: Info) -> Result:
    return html_to_markdown(decode(raw, info.charset))


def wikipedia(raw: bytes, info: Info) -> Result:
    return web_pages.article(decode(raw, info.charset))


def video(raw: bytes, info: Info) -> Result:
    return web_pages.video(decode(raw, info.charset), info.url)


def search(raw: bytes, info: Info) -> Result:
    return web_pages.search_results(decode(raw, info.charset), info.url or "")


def csv_table(raw: bytes, info: Info) -> Result:
    return table([r for r in csv.reader(io.StringIO(decode(raw, info.charset), newline="")) if r]), None


def notebook(raw: bytes, info: Info) -> Result:
    nb = json.loads(decode(raw, info.charset))
    out, title = [], None
    for c in nb.get("cells", []):
        text = "".join(c.get("source", []))
        if not text.strip():
            continue
        kind = c.get("cell_type")
        out.append(text if kind == "markdown" else f"```{'python' if kind == 'code' else ''}\n{text}\n```")
        if title is None and kind == "markdown" and (m := re.search(r"^# (.*)$", text, re.M)):
            title = m[1].strip()
    return "\n\n".join(out), title or nb.get("metadata", {}).get("title")


def feed(raw: bytes, info: Info) -> Result:
    root = ElementTree.fromstring(raw)
    atom = _local(root) == "feed"
    channel = root if atom else _one(root, "channel")
    if channel is None:
        raise Unsupported("no channel")
    text = lambda e, *names: next((x.text.strip() for n in names if (x := _one(e, n)) is not None and x.text and x.text.strip()), None)

    def link(e: ElementTree.Element) -> str | None:
        every = [x for x in e if _local(x) == "link"]
        first = next((x for x in every if x.get("rel", "alternate") == "alternate"), every[0] if every else None)
        return None if first is None else first.get("href") or (first.text or "").strip() or None

    def when(x: str | None) -> str | None:
        if not x:
            return None
        try:
            at = parsedate_to_datetime(x)
        except ValueError:
            from datetime import datetime

            at = datetime.fromisoformat(x.replace("Z", "+00:00"))
        return format_datetime(at, usegmt=at.utcoffset() is not None and not at.utcoffset())

    title = text(channel, "title")
    lines = [f"# {title or info.url or 'Feed'}", text(channel, "description", "subtitle"), (f"[{title}]({u})" if title else u) if (u := link(channel)) else None]
    for item in (x for x in (channel if atom or any(_local(c) == "item" for c in channel) else root) if _local(x) in ("item", "entry")):
        name = text(item, "title") or "Untitled"
        lines += [f"## {name}", f"[{name}]({u})" if (u := link(item)) else None]
        lines.append(f"Updated on: {d}" if (d := when(text(item, "updated"))) else f"Published on: {d}" if (d := when(text(item, "pubDate", "published"))) else None)
        if body := text(item, "description", "summary", "content"):
            lines.append(html_to_markdown(body)[0])
    return "\n\n".join(x for x in lines if x), title


def docx(raw: bytes, info: Info) -> Result:
    with _zip(raw) as z:
        styles: dict[str, tuple[str, str | None, int | None]] = {}
        if "word/styles.xml" in z.namelist():
            for s in _all(_xml(z, "word/styles.xml"), "style"):
                level = next((_attr(x, "val") for x in _all(s, "outlineLvl")), None)
                styles[_attr(s, "styleId") or ""] = (_attr(_one(s, "name"), "val") or "", _attr(_one(s, "basedOn"), "val"), int(level) if level else None)
        rels = _rels(z, "word/document.xml")

        def heading(p: ElementTree.Element) -> int | None:
            props = _one(p, "pPr")
            if (own := _attr(_one(props, "outlineLvl"), "val")) is not None:
                return min(6, max(1, int(own) + 1)) if int(own) < 9 else None
            style, seen = _attr(_one(props, "pStyle"), "val"), set()
            while style and style not in seen:
                seen.add(style)
                name, base, level = styles.get(style, (style, None, None))
                if m := re.fullmatch(r"(?i)heading\s*(\d+)", name) or re.fullmatch(r"(?i)heading\s*(\d+)", style):
                    return min(6, max(1, int(m[1])))
                if level is not None:
                    return min(6, level + 1)
                style = base
            return None

        def run(r: ElementTree.Element) -> str:
            props = _one(r, "rPr")
            on = lambda n: (e := _one(props, n)) is not None and _attr(e, "val") not in ("0", "false")
            text = "".join("\n" if _local(t) == "br" else "\t" if _local(t) == "tab" else t.text or "" for t in r if _local(t) in ("t", "br", "tab"))
            if text.strip():
                mark = "***" if on("b") and on("i") else "**" if on("b") else "*" if on("i") else ""
                text = mark + text + mark
            for d in _all(r, "drawing"):
                alt = next((_attr(x, "descr") or _attr(x, "name") for x in _all(d, "docPr")), "") or ""
                for blip in _all(d, "blip"):
                    part = rels.get(_attr(blip, "embed") or "")
                    if part in z.namelist():
                        mime = EXTENSION_MIME.get(part.rpartition(".")[2].lower(), "application/octet-stream")
                        text += f"![{alt}](data:{mime};base64,{base64.b64encode(z.read(part)).decode()})"
            return text

        def paragraph(p: ElementTree.Element) -> str:
            text = "".join(run(r) for r in _all(p, "r")).strip()
            if not text:
                return ""
            if level := heading(p):
                return "#" * level + " " + re.sub(r"^\*+|\*+$", "", text)
            return ("- " if _one(_one(p, "pPr"), "numPr") is not None else "") + text

        out, title = [], None
        for e in _one(_xml(z, "word/document.xml"), "body"):
            if _local(e) == "p" and (text := paragraph(e)):
                title = title or (text.lstrip("# ") if text.startswith("#") else None)
                out.append(text)
            elif _local(e) == "tbl":
                out.append(table([[" ".join(filter(None, (paragraph(p) for p in _all(c, "p")))) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]))
        return "\n\n".join(out), title


def xlsx(raw: bytes, info: Info) -> Result:
    with _zip(raw) as z:
        shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        rels, out = _rels(z, "xl/workbook.xml"), []

        def value(c: ElementTree.Element) -> str:
            v, kind = _one(c, "v"), c.get("t")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in _all(c, "t"))
            text = (v.text or "") if v is not None else ""
            return shared[int(text)] if kind == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text

        for s in _all(_xml(z, "xl/workbook.xml"), "sheet"):
            rows: list[list[str]] = []
            for r in _all(_xml(z, rels[_attr(s, "id")]), "row"):
                row: list[str] = []
                for c in (x for x in r if _local(x) == "c"):
                    at = len(row)
                    if m := re.match("[A-Z]+", c.get("r", "")):
                        at = 0
                        for ch in m[0]:
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    row += [""] * (at + 1 - len(row))
                    row[at] = value(c)
                rows.append(row)
            if any(any(r) for r in rows):
                out.append(f"## {s.get('name')}\n\n{table(rows)}")
        return "\n\n".join(out), None


def pptx(raw: bytes, info: Info) -> Result:
    with _zip(raw) as z:
        rels, out, title, headed = _rels(z, "ppt/presentation.xml"), [], None, False

        def texts(e: ElementTree.Element) -> str:
            return "\n".join(t for p in _all(e, "p") if (t := "".join(x.text or "" for x in _all(p, "t")).strip()))

        def place(e: ElementTree.Element) -> tuple[int, int]:
            off = next(_all(e, "off"), None)
            return (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)

        def chart(part: str) -> str:
            root = _xml(z, part)
            name = "".join(t.text or "" for x in _all(root, "title") for t in _all(x, "t"))
            series = []
            for s in _all(root, "ser"):
                points = lambda kind, s=s: [(_one(p, "v").text or "") for k in _all(s, kind) for p in _all(k, "pt")]
                series.append(((points("tx") or [""])[0], points("cat"), points("val")))
            cats = series[0][1] if series else []
            return f"### Chart: {name}\n\n" + table([["Category", *[s[0] for s in series]], *[[c, *[s[2][i] if i < len(s[2]) else "" for s in series]] for i, c in enumerate(cats)]])

        def shapes(tree: ElementTree.Element, own: dict[str, str]) -> Iterator[str]:
            nonlocal title, headed
            for e in sorted((x for x in tree if _local(x) in ("sp", "pic", "graphicFrame", "grpSp")), key=place):
                kind = _local(e)
                if kind == "grpSp":
                    yield from shapes(e, own)
                elif kind == "pic":
                    about = next(_all(e, "cNvPr"), None)
                    yield f"![{_attr(about, 'descr') or ''}]({_attr(about, 'name') or 'image'})"
                elif kind == "graphicFrame":
                    for t in (x for x in e.iter() if _local(x) in ("tbl", "table")):
                        yield table([[texts(c) for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"])
                    for c in _all(e, "chart"):
                        if (part := own.get(_attr(c, "id") or "")) in z.namelist():
                            yield chart(part)
                elif text := texts(e):
                    if _attr(next(_all(e, "ph"), None), "type") in ("title", "ctrTitle") and not headed:
                        headed, title = True, title or text
                        text = "# " + text
                    yield text

        for n, s in enumerate(_all(_xml(z, "ppt/presentation.xml"), "sldId"), 1):
            part, headed = rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))], False
            own = _rels(z, part)
            out.append("\n\n".join([f"<!-- Slide number: {n} -->", *shapes(next(_all(_xml(z, part), "spTree")), own)]))
            notes = next((p for p in own.values() if "notesSlide" in p), None)
            if notes in z.namelist() and (text := texts(_xml(z, notes))):
                out.append("### Notes:\n" + text)
        return "\n\n".join(out), title


def epub(raw: bytes, info: Info) -> Result:
    with _zip(raw) as z:
        opf = next(_all(_xml(z, "META-INF/container.xml"), "rootfile")).get("full-path")
        root, base = _xml(z, opf), posixpath.dirname(opf)
        values = lambda n: [x.text.strip() for x in _all(root, n) if x.text and x.text.strip()]
        title = next(iter(values("title")), None)
        lines = [f"**{k}:** {v}" for k, v in (("Title", title), ("Authors", ", ".join(values("creator"))), ("Language", next(iter(values("language")), "")), ("Description", next(iter(values("description")), "")), ("Identifier", next(iter(values("identifier")), ""))) if v]
        files = {i.get("id"): posixpath.normpath(posixpath.join(base, i.get("href", ""))) for i in _all(root, "item")}
        names: dict[str, str] = {}
        for n in z.namelist():
            if n.endswith(".ncx"):
                for p in _all(_xml(z, n), "navPoint"):
                    target = posixpath.normpath(posixpath.join(posixpath.dirname(n), (next(_all(p, "content")).get("src") or "").partition("#")[0]))
                    names.setdefault(target, "".join(t.text or "" for t in _all(p, "text")).strip())
        out = ["\n".join(lines)] if lines else []
        for r in _all(root, "itemref"):
            path = files.get(r.get("idref"))
            if path in z.namelist() and (body := z.read(path)).strip():
                text = html_to_markdown(decode(body))[0]
                if names.get(path) or text:
                    out.append(f"## {names[path]}\n\n{text}" if names.get(path) else text)
        return "\n\n".join(out), title


def unpack_palm(data: bytes) -> bytes:
    """PalmDoc's LZ77."""
    out, i = bytearray(), 0
    while i < len(data):
        b = data[i]
        i += 1
        if 1 <= b <= 8:
            out += data[i : i + b]
            i += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((32, b & 0x7F))
        elif i < len(data):
            back, n = (b & 0x3F) << 3 | data[i] >> 5, (data[i] & 7) + 3
            i += 1
            for _ in range(n if back else 0):
                out.append(out[-back] if back <= len(out) else 32)
    return bytes(out)


def mobi_parts(raw: bytes) -> tuple[dict, list[bytes]]:
    """Metadata by EXTH code and the records of a Palm database."""
    n = struct.unpack_from(">H", raw, 76)[0]
    starts = [struct.unpack_from(">I", raw, 78 + 8 * i)[0] for i in range(n)] + [len(raw)]
    records = [raw[a:b] for a, b in zip(starts, starts[1:])]
    head, found = records[0], {"name": raw[:32].split(b"\0")[0].decode("latin-1").strip()}
    at = head.find(b"MOBI", 0, 68)
    if at >= 0 and at + 76 <= len(head):
        start, size = struct.unpack_from(">II", head, at + 68)
        if 0 < start and 0 < size and start + size <= len(head):
            found["full"] = decode(head[start : start + size])
        exth = at + struct.unpack_from(">I", head, at + 4)[0]
        if head[exth : exth + 4] == b"EXTH" and exth + 12 <= len(head):
            pos = exth + 12
            for _ in range(struct.unpack_from(">I", head, exth + 8)[0]):
                if pos + 8 > len(head):
                    break
                code, size = struct.unpack_from(">II", head, pos)
                if size < 8 or pos + size > len(head):
                    break
                found.setdefault(code, []).append(decode(head[pos + 8 : pos + size]).strip())
                pos += size
    return found, records


def mobi(raw: bytes, info: Info) -> Result:
    meta, records = mobi_parts(raw)
    kind, _, _, n = struct.unpack_from(">HHIH", records[0])
    if kind not in (1, 2):
        raise Unsupported(f"compression {kind}")
    body = b"".join(unpack_palm(r) if kind == 2 else r for r in records[1 : 1 + n])
    text, title = html_to_markdown(decode(body))
    return text, meta.get("full") or meta["name"] or title


def chm(raw: bytes, info: Info) -> Result:
    archive, out = Chm(raw), []
    for path in archive.pages():
        text = html_to_markdown(decode(archive.read(path) or b""))[0]
        if text:
            out.append(f"## {posixpath.splitext(posixpath.basename(path))[0]}\n\n{text}")
    return "\n\n".join(out), archive.metadata().get("title")


def pdf(raw: bytes, info: Info) -> Result:
    """Pages by their word boxes: tables, or lines; captions of photographs where a captioner is set."""
    if not raw.startswith(b"%PDF"):
        raise Unsupported("not a PDF")
    file = Pdf(raw)
    out = []
    for n, page in enumerate(file.pages, 1):
        parts = [f"## Page {n}", page_markdown(file.words(page))]
        for photo in file.jpegs(page) if captioner else []:
            try:
                parts.append((captioner(photo, "image/jpeg") or "").strip())
            except Exception:  # captions are an extra
                continue
        out.append("\n\n".join(p for p in parts if p))
    return "\n\n".join(out), file.info.get("Title")


#: Called with an image's bytes and type, if set; its caption is added, and its failures are ignored.
captioner: Callable[[bytes, str], str | None] | None = None


def image(raw: bytes, info: Info) -> Result:
    tags: list[tuple[str, object]] = []
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        kind, (w, h, depth) = "PNG-IHDR", struct.unpack_from(">IIB", raw, 16)
        tags = [("Image Width", w), ("Image Height", h), ("Bits Per Sample", depth)]
    elif raw[:2] == b"BM":
        kind, (w, h, _, depth) = "BMP Header", struct.unpack_from("<iiHH", raw, 18)
        tags = [("Image Width", w), ("Image Height", h), ("Bits Per Pixel", depth)]
    elif raw[:3] == b"GIF":
        kind, (w, h) = "GIF Header", struct.unpack_from("<HH", raw, 6)
        tags = [("Image Width", w), ("Image Height", h)]
    elif raw[:2] == b"\xff\xd8":
        kind, at = "JPEG", 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            code, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
            if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", raw, at + 5)
                tags = [("Image Height", f"{h} pixels"), ("Image Width", f"{w} pixels")]
                break
            at += 2 + size
    else:
        raise Unsupported("unknown image format")
    out = "\n".join([f"## {kind}", *[f"- {k}: {v}" for k, v in tags]])
    try:
        caption = captioner(raw, info.mime_type or "image/*") if captioner else None
    except Exception:
        caption = None
    return out + (f"\n\n# Description\n\n{caption.strip()}" if caption and caption.strip() else ""), None


def audio(raw: bytes, info: Info) -> Result:
    lines = []
    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE" and (at := raw.find(b"fmt ")) > 0:
        _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
        lines = [f"Channels: {channels}", f"Sample Rate: {rate}", f"Bits Per Sample: {bits}"]
    elif raw[:3] == b"ID3":
        at, names = 10, {b"TIT2": "Title", b"TPE1": "Artist", b"TALB": "Album", b"TDRC": "Year"}
        while at + 10 < len(raw) and raw[at : at + 4].isalnum():
            size = struct.unpack_from(">I", raw, at + 4)[0]
            if raw[at : at + 4] in names:
                body = raw[at + 10 : at + 10 + size]
                lines.append(f"{names[raw[at : at + 4]]}: {body[1:].decode({1: 'utf-16', 2: 'utf-16-be', 3: 'utf-8'}.get(body[0], 'latin-1')).strip(chr(0))}")
            at += 10 + size
    return "\n".join(lines) or "_No metadata found._", None


def ole_streams(raw: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name."""
    shift, mini_shift = struct.unpack_from("<HH", raw, 30)
    size, cutoff = 1 << shift, struct.unpack_from("<I", raw, 56)[0]
    sector = lambda i: raw[(i + 1) * size : (i + 2) * size]
    fat: list[int] = []
    for s in struct.unpack_from("<109I", raw, 76):
        if s < 0xFFFFFFFA:
            fat += struct.unpack(f"<{size // 4}I", sector(s))

    def chain(at: int, table_: list[int], get) -> bytes:
        out, seen = [], set()
        while at < 0xFFFFFFFA and at not in seen and at < len(table_):
            seen.add(at)
            out.append(get(at))
            at = table_[at]
        return b"".join(out)

    directory = chain(struct.unpack_from("<I", raw, 48)[0], fat, sector)
    entries = []
    for at in range(0, len(directory), 128):
        n = struct.unpack_from("<H", directory, at + 64)[0]
        entries.append((directory[at : at + max(0, n - 2)].decode("utf-16-le", "replace"), directory[at + 66], *struct.unpack_from("<IQ", directory, at + 116)))
    root = next(e for e in entries if e[1] == 5)
    mini = chain(root[2], fat, sector)
    first = struct.unpack_from("<I", raw, 60)[0]
    mini_raw = chain(first, fat, sector) if first < 0xFFFFFFFA else b""
    mini_fat = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw))
    step = 1 << mini_shift
    return {name: (chain(at, fat, sector) if n >= cutoff else chain(at, mini_fat, lambda i: mini[i * step : (i + 1) * step]))[:n] for name, kind, at, n in entries if kind == 2}


def outlook(raw: bytes, info: Info) -> Result:
    streams = ole_streams(raw)
    text = lambda code: (streams.get(f"__substg1.0_{code}001F") or b"").decode("utf-16-le", "replace").strip("\0") or None
    subject, body = text("0037"), text("1000")
    head = [f"**{k}:** {v}" for k, v in (("From", text("0C1F")), ("To", text("0E04")), ("Subject", subject)) if v and v.strip()]
    out = "# Email Message\n\n" + "\n".join(head)
    if body and body.strip():
        out += f"\n\n## Content\n\n{body.rstrip()}"
    return out.rstrip(), subject


def members(raw: bytes, info: Info) -> Result:
    """Each readable entry of an archive, under its name."""
    out = []
    with _zip(raw) as z:
        for e in z.infolist():
            if e.is_dir():
                continue
            name = e.filename.replace("\\", "/").replace("..", "_")
            text, _, error = convert(z.read(e), Info(file_name=posixpath.basename(name)))
            if error is None:
                out.append(f"## File: {name}\n\n{text}")
    return "\n\n".join(out), None


Accepts = Callable[[bytes, Info], bool]
_registry: list[tuple[float, int, str, Accepts, Callable[[bytes, Info], Result]]] = []


def register(name: str, accepts: Accepts, converter: Callable[[bytes, Info], Result], priority: float = 0.0) -> None:
    """Add a converter; lower priorities are tried first, equal ones in order."""
    _registry.append((priority, len(_registry), name, accepts, converter))
    _registry.sort(key=lambda r: r[:2])


def _kind(*extensions: str, mime: str = "") -> Accepts:
    known = {EXTENSION_MIME.get(e) for e in extensions} - {None}
    return lambda raw, i: (i.extension or "").lower().lstrip(".") in extensions or (i.mime_type or "") in known or bool(mime and (i.mime_type or "").startswith(mime))


def _is_feed(raw: bytes, i: Info) -> bool:
    return _kind("rss", "atom")(raw, i) or (raw.lstrip()[:1] == b"<" and re.match(rb"\s*(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*)*<(?:\w+:)?(?:rss|feed|RDF)\b", raw[:4096], re.S) is not None)


for _name, _test, _fn, _priority in (
    ("wikipedia", lambda raw, i: web_pages.is_article(i.url), wikipedia, 0.0),
    ("video", lambda raw, i: web_pages.is_video(i.url), video, 0.0),
    ("search", lambda raw, i: web_pages.is_search(i.url) and (_kind("html", "htm", mime="text/html")(raw, i) or (i.mime_type or "").startswith("application/xhtml")), search, 0.0),
    ("docx", _kind("docx"), docx, 0.0),
    ("xlsx", _kind("xlsx"), xlsx, 0.0),
    ("pptx", _kind("pptx"), pptx, 0.0),
    ("pdf", _kind("pdf"), pdf, 0.0),
    ("image", _kind("jpg", "jpeg", "png", "gif", "bmp", mime="image/"), image, 0.0),
    ("epub", _kind("epub"), epub, 0.0),
    ("mobi", _kind("mobi", "azw", "azw3", "prc"), mobi, 0.0),
    ("chm", lambda raw, i: _kind("chm")(raw, i) or raw[:4] == b"ITSF", chm, 0.0),
    ("msg", lambda raw, i: _kind("msg")(raw, i) or raw[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", outlook, 0.0),
    ("audio", _kind("mp3", "wav", "m4a", "flac", mime="audio/"), audio, 0.0),
    ("notebook", lambda raw, i: _kind("ipynb")(raw, i) or b'"nbformat"' in raw[:4096] and b'"nbformat_minor"' in raw[:4096], notebook, 0.0),
    ("zip", _kind("zip"), members, 10.0),
    ("feed", _is_feed, feed, 10.0),
    ("csv", _kind("csv"), csv_table, 10.0),
    ("html", _kind("html", "htm", mime="text/html"), html, 10.0),
    ("text", lambda raw, i: _kind("txt", "text", "md", "markdown", "json", "jsonl", "xml", mime="text/")(raw, i) or (i.charset is not None and i.mime_type is None), plain, 10.0),
):
    register(_name, _test, _fn, _priority)


def convert(raw: bytes, info: Info) -> tuple[str | None, str | None, str | None]:
    """Markdown, title and error of one input."""
    info = info.normal()
    for _, _, name, accepts, fn in _registry:
        if accepts(raw, info):
            try:
                return (*fn(raw, info), None)
            except Unsupported:
                continue
            except Exception as e:  # a bad file must not end the job
                return None, None, f"{name}: {type(e).__name__}: {e}"
    return None, None, "unsupported format"


def convert_files(files: DataFrame, path: str = "path", content: str = "content", url: str | None = None, mime: str | None = None) -> DataFrame:
    """``path, markdown, title, error`` of a ``binaryFile`` table, or of pages with columns ``url`` and ``mime``; no shuffle."""
    ship(files.sparkSession)

    def one(p: str | None, c: bytes | None, u: str | None, m: str | None) -> tuple[str | None, str | None, str | None]:
        if c is None:
            return None, None, "no content"
        name = posixpath.basename(p) if p and url is None else None
        return convert(bytes(c), Info(file_name=name, url=u if isinstance(u, str) else None, mime_type=m if isinstance(m, str) else None))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [one(*r) for r in zip(b["path"], b["content"], b["url"], b["mime"])]
            yield pd.DataFrame({"path": b["path"], "markdown": [r[0] for r in rows], "title": [r[1] for r in rows], "error": [r[2] for r in rows]})

    extra = [(F.lit(None).cast("string") if c is None else F.col(c)).alias(n) for c, n in ((url, "url"), (mime, "mime"))]
    source = files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content"), *extra)
    return source.mapInPandas(work, "path string, markdown string, title string, error string")


def read_files(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """Files of a folder as ``path, modificationTime, length, content``."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(folder)


def pdf_date(text: str | None) -> datetime | None:
    """``D:YYYYMMDDHHmmSS+HH'mm'`` with parts left out from the right, in UTC."""
    m = re.match(r"(?:D:)?(\d{4})(\d\d)(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:([+-])(\d\d)(?:'(\d\d))?)?)?)?)?", (text or "").strip())
    if not m:
        return None
    try:
        local = datetime(*(int(x or 0) for x in m.groups()[:6]))
    except ValueError:
        return None
    shift = timedelta(hours=int(m[8] or 0), minutes=int(m[9] or 0))
    return local + shift if m[7] == "-" else local - shift


def loose_date(text: str | None) -> datetime | None:
    """A date as books write it, in UTC: a year, a year and month, or an ISO date with or without a time and zone."""
    text = (text or "").strip()
    if m := re.fullmatch(r"(\d{4})(?:-(\d\d))?", text):
        text = f"{m[1]}-{m[2] or '01'}-01"
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        try:
            at = parsedate_to_datetime(text)
        except (TypeError, ValueError):
            return None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def book_metadata(raw: bytes, name: str) -> dict:
    """Catalog fields of one book; what can't be read is left out."""
    ext = posixpath.splitext(name)[1].lower().lstrip(".")
    out: dict = {"file_name": name, "file_size_bytes": len(raw)}
    split = lambda x: [p.strip() for p in re.split("[,;]", x) if p.strip()]
    if ext == "pdf":
        file = Pdf(raw)
        pages, info = file.pages, file.info
        out |= {"format": "PDF", "title": info.get("Title"), "authors": split(info.get("Author", "")), "publisher": info.get("Creator"), "description": info.get("Subject"), "tags": split(info.get("Keywords", "")), "page_count": len(pages) or None}
        out |= {"published_date": pdf_date(info.get("CreationDate")), "modified_date": pdf_date(info.get("ModDate"))}
    elif ext == "epub":
        with _zip(raw) as z:
            root = _xml(z, next(_all(_xml(z, "META-INF/container.xml"), "rootfile")).get("full-path"))
            values = lambda n: [x.text.strip() for x in _all(root, n) if x.text and x.text.strip()]
            isbn = next((x.text.strip() for x in _all(root, "identifier") if x.text and "isbn" in (_attr(x, "scheme") or x.text).lower()), None)
            out |= {"format": "EPUB", "title": next(iter(values("title")), None), "authors": values("creator"), "publisher": next(iter(values("publisher")), None), "description": next(iter(values("description")), None), "language": next(iter(values("language")), None), "isbn": isbn, "tags": values("subject")}
            dates = [(x.text, (_attr(x, "event") or "").lower() or None) for x in _all(root, "date")]
            chosen = [d for d, e in dates if e is None or "publication" in e or "issued" in e] or [d for d, _ in dates]
            out["published_date"] = loose_date(chosen[0]) if chosen else None
    elif ext in ("mobi", "azw", "azw3", "prc"):
        m, _ = mobi_parts(raw)
        first = lambda c: next((v for v in m.get(c, []) if v), None)
        out |= {"format": "MOBI", "title": first(503) or m.get("full") or m["name"] or None, "authors": m.get(100, []), "publisher": first(101), "description": first(103), "isbn": first(104), "tags": m.get(105, []), "language": first(524), "published_date": next((d for d in map(loose_date, m.get(106, [])) if d), None)}
    elif ext == "chm":
        archive = Chm(raw)
        m = archive.metadata()
        text = "\n".join(decode(archive.read(p) or b"") for p in archive.pages()[:12])
        meta = {}
        for t in re.findall(r"(?is)<meta\b[^>]*>", text):
            a = {k.lower(): v for k, _, v in re.findall(r"""([\w:-]+)\s*=\s*(["'])(.*?)\2""", t, re.S)}
            meta.setdefault((a.get("name") or a.get("property") or a.get("http-equiv") or "").lower(), a.get("content"))
        people = [p.strip() for p in re.split(r"; ?| and ", meta.get("author") or meta.get("dc.creator") or "") if p.strip()]
        runs = (y for x in re.findall(ISBN, re.sub("<[^>]+>", " ", text)) for y in (x, *(h[0] for p in ISBN_HEADS for h in re.finditer(p, x))))
        found = next((d for x in runs if valid_isbn(d := re.sub("[^0-9X]", "", x.upper()))), None)
        words = [p.strip() for p in re.split("[,;|]", meta.get("keywords") or "") if p.strip()]
        tags = list({t.lower(): t for t in reversed([*archive.tags(), *words])}.values())[::-1]
        out |= {"format": "CHM", "title": m.get("title") or html_to_markdown(text)[1], "authors": people, "publisher": meta.get("publisher"), "description": meta.get("description"), "language": m.get("language"), "isbn": found, "tags": tags}
        out["published_date"] = next((d for k in ("dc.date", "date", "pubdate", "article:published_time") if (d := loose_date(meta.get(k)))), None)
    return {k: v for k, v in out.items() if v not in (None, [], "")}


def valid_isbn(s: str) -> bool:
    """Check digits of ISBN-10 and ISBN-13."""
    if re.fullmatch("[0-9]{9}[0-9X]", s):
        return sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(s)) % 11 == 0
    return bool(re.fullmatch("[0-9]{13}", s)) and sum((3 if i % 2 else 1) * int(c) for i, c in enumerate(s)) % 10 == 0


BOOK = "path string, file_name string, format string, file_size_bytes long, title string, authors array<string>, publisher string, description string, language string, isbn string, published_date timestamp, modified_date timestamp, page_count int, tags array<string>, error string"


def scan_books(files: DataFrame) -> DataFrame:
    """Catalog rows of a ``binaryFile`` table; a file that fails has its ``error``, others go on."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in BOOK.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    rows.append({"path": p, **book_metadata(bytes(c), posixpath.basename(p))})
                except Exception as e:  # the scan goes on
                    rows.append({"path": p, "file_name": posixpath.basename(p), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="Int32" if n == "page_count" else "datetime64[us]" if n.endswith("_date") else object) for n in names})

    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("pdf", "epub", "mobi", "azw", "azw3", "prc", "chm")
    return files.select("path", "content").filter(wanted).mapInPandas(work, BOOK)
