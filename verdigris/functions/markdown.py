"""HTML to Markdown: headings, paragraphs, emphasis, links, images, lists, code, quotes, tables and rules; other tags pass
their content on. Scripts and styles are left out."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_VOID = {"br", "hr", "img", "meta", "link", "input"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "nav", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "body"}


def cell(x: str) -> str:
    return x.replace("\r", " ").replace("\n", "<br/>").replace("|", "\\|").strip()


def table(rows: list[list[str]]) -> str:
    """A pipe table; ragged rows are padded and the first is the header."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(cell(c) for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: str | None = None
        self.skip, self.pre, self.in_title = 0, 0, False
        self.lists: list[list] = []
        self.links: list[str] = []
        self.rows: list[list[list[str]]] = []
        self.saved: list[list[str]] = []

    def block(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            own = self.lists[-1] if self.lists else ["ul", 0]
            own[1] += 1
            self.out.append("\n" + "    " * (len(self.lists) - 1) + (f"{own[1]}. " if own[0] == "ol" else "- "))
        elif tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in ("td", "th") and self.rows and self.rows[-1]:
            self.saved.append(self.out)
            self.out = []
        elif tag == "blockquote":
            self.saved.append(self.out)
            self.out = []
        elif tag in _BLOCK:
            self.block()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n" if not self.lists else "")
        elif tag in ("td", "th") and self.saved and self.rows and self.rows[-1]:
            text = "".join(self.out).strip()
            self.out = self.saved.pop()
            self.rows[-1][-1].append(text)
        elif tag == "table" and self.rows:
            self.out.append("\n\n" + table([r for r in self.rows.pop() if r]) + "\n\n")
        elif tag == "blockquote" and self.saved:
            inner = tidy("".join(self.out))
            self.out = self.saved.pop()
            self.out.append("\n\n" + "\n".join("> " + line for line in inner.split("\n")) + "\n\n")
        elif tag in _BLOCK:
            self.block()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title = (self.title or "") + data
        elif not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def tidy(x: str) -> str:
    x = re.sub(r"[ \t]+\n", lambda m: "  \n" if m[0].startswith("  ") else "\n", x)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+\n", "\n\n", x)).strip()


def html_to_markdown(html: str) -> tuple[str, str | None]:
    """Markdown and the trimmed title."""
    w = _Writer()
    w.feed(html)
    w.close()
    while w.saved:  # unclosed cells and quotes
        inner = w.out
        w.out = w.saved.pop() + inner
    return tidy("".join(w.out)), (w.title or "").strip() or None
