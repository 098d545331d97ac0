"""Documents to Markdown, routes, titles and metadata, as columns over tables of pages and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions import text as X

#: Converters by priority, then in this order; the first that accepts an input takes it.
ROUTES: list[tuple[float, str]] = [(0.0, n) for n in ("wikipedia", "youtube", "docx", "xlsx", "pptx", "pdf", "image", "epub", "mobi", "chm", "msg", "audio", "notebook", "serp")] + [(10.0, n) for n in ("zip", "feed", "csv", "html", "text")]


def stream_info(rows: DataFrame, url: str = "url") -> DataFrame:
    """``file_name, extension, mime_type, charset`` from a URL, where the row doesn't have them."""
    have = set(rows.columns)
    path = X.url_path(F.col(url))
    for name, value in (("file_name", X.file_name(path)), ("extension", X.extension(F.col("file_name"))), ("mime_type", X.mime_of(F.col("extension"))), ("charset", X.charset_of(F.col("mime_type")))):
        rows = rows.withColumn(name, F.coalesce(name, value) if name in have else value)
    return rows


def accepts(url: Column, ext: Column, mime: Column, content: Column) -> dict[str, Column]:
    """Whether each converter takes an input."""
    ext, mime, url = (F.coalesce(c, F.lit("")) for c in (F.lower(ext), F.lower(mime), F.lower(url)))
    host = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    html = ext.isin(".html", ".htm") | mime.startswith("text/html") | mime.startswith("application/xhtml")
    head = F.substring(content, 1, 4096)
    office = lambda e: (ext == f".{e}") | (mime == X.EXTENSION_MIME[e])
    first = F.ltrim(head)
    return {
        "wikipedia": html & host.rlike(r"(^|\.)wikipedia\.org$"),
        "youtube": html & (host.contains("youtube.com") | host.contains("youtu.be")),
        "docx": office("docx"),
        "xlsx": office("xlsx"),
        "pptx": office("pptx"),
        "pdf": office("pdf"),
        "image": ext.isin(*[f".{e}" for e in "jpg jpeg png gif bmp tif tiff webp".split()]) | mime.startswith("image/"),
        "epub": office("epub"),
        "mobi": ext.isin(".mobi", ".azw", ".azw3", ".prc"),
        "chm": office("chm"),
        "msg": ext == ".msg",
        "audio": ext.isin(".mp3", ".wav", ".m4a", ".flac", ".ogg") | mime.startswith("audio/"),
        "notebook": (ext == ".ipynb") | (head.contains('"nbformat"') & head.contains('"nbformat_minor"')),
        "serp": html & url.rlike(r"^https://www\.bing\.com/search\?q="),
        "zip": office("zip"),
        "feed": ext.isin(".rss", ".atom") | mime.isin("application/rss+xml", "application/atom+xml") | (first.startswith("<?xml") & (head.contains("<rss") | head.contains("<feed"))),
        "csv": office("csv"),
        "html": html,
        "text": ext.isin(".txt", ".text", ".md", ".markdown", ".json", ".jsonl", ".xml") | mime.startswith("text/") | mime.isin("application/json", "application/xml"),
    }


def route(url: Column, ext: Column, mime: Column, content: Column) -> Column:
    """The first converter by priority that accepts, or ``unsupported``."""
    test = accepts(url, ext, mime, content)
    out = F.lit("unsupported")
    for _, name in reversed(sorted(ROUTES, key=lambda r: r[0])):
        out = F.when(test[name], name).otherwise(out)
    return out


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, authors, publisher, description, tags, date and ISBN of HTML pages."""
    m = pages.select("page_id", "html", X.meta_map(F.col("html")).alias("m"))
    v = lambda *keys: X.meta_value(F.col("m"), *keys)
    return m.select(
        "page_id",
        X.tag_text(F.col("html"), "title").alias("title"),
        F.array_join(X.authors(v("author", "dc.creator", "dcterms.creator", "creator")), "; ").alias("authors"),
        v("publisher", "dc.publisher", "dcterms.publisher").alias("publisher"),
        v("description", "dc.description", "dcterms.description").alias("description"),
        F.array_join(X.distinct_ignoring_case(X.split_list(v("keywords", "dc.subject", "dcterms.subject", "subject"), "[,;|]")), ", ").alias("tags"),
        X.find_isbn(X.strip_tags(F.col("html"))).alias("isbn"),
    )


def video_metadata(pages: DataFrame) -> DataFrame:
    """Title and description of video pages: og: properties before meta names before the title element."""
    m = pages.select("page_id", "html", X.meta_map(F.col("html")).alias("m"))
    title = F.coalesce(X.meta_value(F.col("m"), "og:title", "title"), X.tag_text(F.col("html"), "title"))
    short = X.blank_to_null(F.regexp_extract("html", r'"shortDescription":"((?:[^"\\]|\\.)*)"', 1))
    return m.select("page_id", title.alias("title"), F.coalesce(short, X.meta_value(F.col("m"), "og:description", "description")).alias("description"), X.meta_value(F.col("m"), "keywords").alias("keywords"))


def notebook_markdown(raw: Column) -> Column:
    """A notebook's cells as Markdown: text as it is, code fenced, empty cells left out."""
    nb = F.from_json(raw, "cells array<struct<cell_type: string, source: array<string>>>")
    cells = F.transform(nb["cells"], lambda c: F.struct(c["cell_type"].alias("kind"), F.array_join(c["source"], "").alias("text")))
    shown = F.transform(F.filter(cells, lambda c: F.trim(c["text"]) != ""), lambda c: F.when(c["kind"] == "markdown", c["text"]).when(c["kind"] == "code", F.concat(F.lit("```python\n"), c["text"], F.lit("\n```"))).otherwise(F.concat(F.lit("```\n"), c["text"], F.lit("\n```"))))
    return F.array_join(shown, "\n\n")


def notebook_title(raw: Column) -> Column:
    """The first heading of a text cell, else the title in the metadata."""
    nb = F.from_json(raw, "cells array<struct<cell_type: string, source: array<string>>>, metadata struct<title: string>")
    text = F.array_join(F.transform(F.filter(nb["cells"], lambda c: c["cell_type"] == "markdown"), lambda c: F.array_join(c["source"], "")), "\n")
    return F.coalesce(X.blank_to_null(F.regexp_extract(text, r"(?m)^# (.*)$", 1)), nb["metadata"]["title"])


def csv_markdown(content: Column, width: int = 64) -> Column:
    """CSV text (no line breaks inside quotes) as a Markdown table; the first record is the header."""
    field = lambda f: F.when(f.startswith('"'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)
    fields = lambda s: F.transform(F.regexp_extract_all(F.concat(F.lit(","), s), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), field)
    return X.once(F.filter(F.split(content, "\r?\n"), lambda s: s != ""), lambda lines: F.when(F.size(lines) > 0, X.pipe_table(F.transform(lines, fields))))


def merge_partial_numbers(lines: DataFrame, doc: str, order: str) -> DataFrame:
    """A line that is only ``.12`` is joined with the next one, without a blank."""
    w = W.partitionBy(doc).orderBy(order)
    partial = F.col("line").rlike(r"^\.[0-9]+$")
    before = F.lag("line").over(w)
    r = lines.withColumns({"_p": partial, "_b": before, "_last": F.lead("line").over(w).isNull()})
    joined = F.when(F.coalesce(F.col("_b").rlike(r"^\.[0-9]+$"), F.lit(False)), F.concat("_b", "line")).otherwise(F.col("line"))
    return r.withColumn("merged", joined).filter(~F.col("_p") | F.col("_last")).drop("_p", "_b", "_last")
