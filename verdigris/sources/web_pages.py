"""Pages of sites that have converters of their own: encyclopedia articles, video pages, search results.

Each takes (bytes, info) like the converters in ``convert`` and is chosen by the page's address alone.
"""

from __future__ import annotations

import base64
import binascii
import html as entities
import re
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

from verdigris.functions.markdown import html_to_markdown

#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Spans(HTMLParser):
    """Where the elements of a page that ``want(tag, attributes)`` picks begin and end."""

    def __init__(self, page: str, want) -> None:
        super().__init__(convert_charrefs=True)
        self.want, self.open, self.found = want, [], []
        self.lines = [0]
        for m in re.finditer("\n", page):
            self.lines.append(m.end())
        self.feed(page)
        self.close()
        for tag, span in self.open:  # never closed: to the end of the page
            if span:
                span[1] = span[2] = len(page)

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        span = None
        if self.want(tag, {k: v or "" for k, v in attrs}):
            at = self.here()
            span = [at, at + len(self.get_starttag_text() or ""), at + len(self.get_starttag_text() or "")]
            self.found.append(span)
        if tag not in VOID:
            self.open.append((tag, span))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        for _, span in self.open[at:]:
            if span:
                span[1] = self.here()
        own = self.open[at][1]
        if own:
            own[2] = self.here() + len(tag) + 3
        for _, span in self.open[at + 1 :]:
            if span:
                span[2] = span[1]
        del self.open[at:]


def outer(page: str, want) -> list[str]:
    """The wanted elements with their tags, in order of their beginnings."""
    spans = [(a, max(b, c)) for a, b, c in _Spans(page, want).found]
    return [page[a:b] for a, b in spans]


def _has_class(name: str):
    return lambda tag, a: name in a.get("class", "")


def _plain(element: str) -> str:
    return entities.unescape(re.sub(r"<[^>]*>", "", element)).strip()


def _title(page: str) -> str | None:
    m = re.search(r"(?is)<title\b[^>]*>(.*?)</title>", page)
    return (_plain(m[1]) or None) if m else None


def is_article(url: str | None) -> bool:
    return bool(url and re.match(r"(?i)https?://[a-z]{2,3}\.wikipedia\.org/", url))


def article(page: str) -> tuple[str, str | None]:
    """The article's body alone, under its title; pages without one are converted whole."""
    body = next(iter(outer(page, lambda tag, a: tag == "div" and a.get("id") == "mw-content-text")), None)
    if body is None:
        return html_to_markdown(page)
    named = next(iter(outer(page, lambda tag, a: tag == "span" and "mw-page-title-main" in a.get("class", ""))), None)
    title = (_plain(named) or None) if named is not None else _title(page)
    text = html_to_markdown(body)[0]
    return (f"# {title}\n\n{text}" if title else text), title


def is_video(url: str | None) -> bool:
    host = (urlsplit(url).hostname or "").lower() if url and re.match(r"[A-Za-z][\w+.-]*://", url) else ""
    return "youtube.com" in host or "youtu.be" in host


def unescaped(text: str) -> str:
    """A JSON string's escapes; unknown ones stay as they are."""
    known = {"n": "\n", "r": "\r", "t": "\t"}
    return re.sub(r'\\(?:u([0-9a-fA-F]{4})|([nrt"\\/]))', lambda m: chr(int(m[1], 16)) if m[1] else known.get(m[2], m[2]), text)


def caption_track(page: str) -> str | None:
    """The address of the first caption track that a video page names."""
    at = page.find('"captionTracks":')
    m = re.compile(r'"baseUrl":"([^"]*)"').search(page, at) if at >= 0 else None
    return unescaped(m[1]) if m else None


def transcript(timed_text: str) -> str | None:
    """Lines of a caption track."""
    lines = [entities.unescape(_plain(t)).strip() for t in re.findall(r"(?s)<text\b[^>]*>(.*?)</text>", timed_text)]
    return "\n".join(x for x in lines if x) or None


#: Gives the text of a caption track by its address, if set; its failures are ignored.
fetch_captions = None


def video(page: str, url: str | None) -> tuple[str, str | None]:
    """Title, address, figures, description and, where captions can be fetched, the transcript of a video page."""
    metas: dict[tuple[str, str], str] = {}
    for tag in re.findall(r"(?is)<meta\b[^>]*>", page):
        a = {k.lower(): entities.unescape(v) for k, _, v in re.findall(r"""([\w:-]+)\s*=\s*(["'])(.*?)\2""", tag, re.S)}
        for key in ("property", "name", "itemprop"):
            if key in a and a.get("content", "").strip():
                metas.setdefault((key, a[key]), a["content"])
    pick = lambda *keys: next((metas[k] for k in keys if k in metas), None)
    title = pick(("property", "og:title"), ("name", "title")) or _title(page)
    long = re.search(r'"shortDescription":"((?:[^"\\]|\\.)*)"', page)
    description = unescaped(long[1]) if long else pick(("property", "og:description"), ("name", "description"))
    about = [("Views", ("itemprop", "interactionCount")), ("Duration", ("itemprop", "duration")), ("Keywords", ("name", "keywords"))]
    facts = [f"- **{name}:** {metas[key]}" for name, key in about if key in metas]
    parts = [f"# {title}" if title else "", url or "", "## Video Metadata\n\n" + "\n".join(facts) if facts else ""]
    parts.append(f"## Description\n\n{description}" if (description or "").strip() else "")
    if fetch_captions is not None and (track := caption_track(page)):
        try:
            said = transcript(fetch_captions(track))
        except Exception:  # captions are an extra
            said = None
        parts.append(f"## Transcript\n\n{said}" if said else "")
    return "\n\n".join(p for p in parts if p.strip()), title


def is_search(url: str | None) -> bool:
    return bool(url and url.startswith("https://www.bing.com/search?q="))


def query_value(url: str, name: str) -> str | None:
    """A parameter of an address's query, percent-decoded; its name in any case."""
    for part in url.partition("?")[2].split("&"):
        key, eq, value = part.partition("=")
        if eq and unquote(key).lower() == name.lower():
            return unquote(value)
    return None


def direct_link(href: str) -> str:
    """The target that a search page's redirect carries in base64 after two letters; other links stay."""
    code = query_value(entities.unescape(href), "u")
    if code is None:
        return href
    code = code[2:].replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(code + "=" * (-len(code) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return href


def search_results(page: str, url: str) -> tuple[str, str | None]:
    """The results of a search page under its query, with direct links."""
    for icon in outer(page, _has_class("algoSlug_icon")):
        page = page.replace(icon, "")
    for name in outer(page, _has_class("tptt")):  # names run into what follows them
        cut = name.rfind("</")
        page = page.replace(name, f"{name[:cut]} {name[cut:]}" if cut >= 0 else name)
    results = []
    for result in outer(page, _has_class("b_algo")):
        linked = re.sub(r"""(?i)(\bhref\s*=\s*)(["'])(.*?)\2""", lambda m: f"{m[1]}{m[2]}{entities.escape(direct_link(m[3]))}{m[2]}", result)
        lines = (line.strip() for line in html_to_markdown(linked)[0].split("\n"))
        results.append("\n".join(line for line in lines if line))
    return f"## A Bing search for '{query_value(url, 'q')}' found the following results:\n\n" + "\n\n".join(results), _title(page)
