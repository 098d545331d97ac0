"""Column expressions over text, URLs, HTML, dates and numbers, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MIME type -> extensions.
MIME = {
    "text/plain": "txt text",
    "text/markdown": "md markdown",
    "application/json": "json jsonl",
    "text/csv": "csv",
    "text/html": "html htm",
    "application/xml": "xml",
    "application/pdf": "pdf",
    "application/zip": "zip",
    "application/epub+zip": "epub",
    "application/vnd.ms-htmlhelp": "chm",
    "image/jpeg": "jpg jpeg",
    "image/png": "png",
    "image/gif": "gif",
    "image/bmp": "bmp",
    "image/tiff": "tif tiff",
    "image/webp": "webp",
} | {f"application/vnd.openxmlformats-officedocument.{kind}": ext for ext, kind in (("docx", "wordprocessingml.document"), ("xlsx", "spreadsheetml.sheet"), ("pptx", "presentationml.presentation"))}
EXTENSION_MIME = {e: m for m, es in MIME.items() for e in es.split()}
#: The word with the run of digits, blanks and hyphens after it, and a run's beginnings that may be an ISBN-13 or ISBN-10.
ISBN = r"(?i)ISBN(?:-1[03])?\s*[:#]?\s*([0-9X][0-9X\-\s]{8,20})"
ISBN_HEADS = [r"^9[-\s]*7[-\s]*[89](?:[-\s]*[0-9]){10}(?![0-9Xx])", r"^[0-9](?:[-\s]*[0-9]){8}[-\s]*[0-9Xx](?![0-9Xx])"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
LANGUAGES = {1025: "ar-SA", 1028: "zh-TW", 1029: "cs-CZ", 1030: "da-DK", 1031: "de-DE", 1032: "el-GR", 1033: "en-US", 1034: "es-ES", 1035: "fi-FI", 1036: "fr-FR", 1040: "it-IT", 1041: "ja-JP", 1042: "ko-KR", 1043: "nl-NL", 1044: "nb-NO", 1045: "pl-PL", 1046: "pt-BR", 1049: "ru-RU", 1053: "sv-SE", 1055: "tr-TR", 2052: "zh-CN", 2057: "en-GB", 2070: "pt-PT", 3082: "es-ES"}


def mapping(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with ``x`` computed once a row, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(x), then), 1)


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def decode_entities(x: Column) -> Column:
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def strip_tags(x: Column) -> Column:
    """Tags become blanks, white space runs one blank; entities are decoded."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(x, "<[^>]+>", " ")), r"\s+", " "))


def tag_text(html: Column, tag: str) -> Column:
    """Inner text of the first such element, or null."""
    return blank_to_null(strip_tags(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)))


def without(html: Column, *tags: str) -> Column:
    for t in tags:
        html = F.regexp_replace(html, f"(?is)<{t}[^>]*>.*?</{t}>", "")
    return html


def strip_comments(x: Column) -> Column:
    return F.regexp_replace(x, "(?s)<!--.*?-->", "")


def html_text(html: Column) -> Column:
    return strip_tags(strip_comments(without(html, "script", "style")))


def html_links(html: Column) -> Column:
    """Targets of anchors in order."""
    return F.regexp_extract_all(html, F.lit('(?i)<a [^>]*href="([^"]*)"'), F.lit(1))


def meta_map(html: Column) -> Column:
    """Entries (key, value) of meta tags: name, then property, then http-equiv; quoted attributes."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def attribute(t: Column, name: str) -> Column:
        return blank_to_null(F.regexp_extract(t, f"(?i){name}\\s*=\\s*[\"']([^\"']*)[\"']", 1))

    entries = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"), attribute(t, "http-equiv"))).alias("key"), decode_entities(F.coalesce(attribute(t, "content"), F.lit(""))).alias("value")))
    return F.filter(entries, lambda e: e["key"].isNotNull())


def meta_value(entries: Column, *keys: str) -> Column:
    """The first non-blank value under the keys in turn; of a key's entries the last holds."""

    def under(key: str) -> Column:
        own = F.filter(entries, lambda e: e["key"] == key)
        return blank_to_null(F.try_element_at(F.transform(own, lambda e: e["value"]), F.lit(-1)))

    return F.coalesce(*map(under, keys))


def url_scheme(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def source_kind(x: Column) -> Column:
    """Where a source is read from: http, file, data, or a local path."""
    s = url_scheme(x)
    return F.when(s.isin("http", "https"), "http").when(s.isin("file", "data"), s).otherwise("local")


def url_path(x: Column) -> Column:
    return F.regexp_extract(x, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def file_name(path: Column) -> Column:
    return blank_to_null(F.regexp_extract(path, r"([^/\\]*)$", 1))


def extension(name: Column) -> Column:
    """With its dot, or null."""
    return blank_to_null(F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1)))


def mime_of(ext: Column) -> Column:
    return mapping(EXTENSION_MIME, F.ltrim(F.lower(ext), F.lit(".")))


def charset_of(mime: Column) -> Column:
    return F.when(mime.startswith("text/"), "utf-8")


def query_parameter(url: Column, name: str) -> Column:
    """A query parameter by name, whatever its case; percent-decoded."""
    raw = blank_to_null(F.regexp_extract(url, f"(?i)[?&]{name}=([^&#]*)", 1))
    return F.try_url_decode(raw)


def redirect_target(u: Column) -> Column:
    """A base64url redirect parameter after two characters of prefix."""
    body = F.translate(F.substring(u, 3, 1 << 20), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    return F.decode(F.unbase64(padded), "utf-8")


def data_uri(x: Column) -> Column:
    """``mime, text`` of a data: URI, base64 or percent-encoded."""
    head = F.regexp_extract(x, "^data:([^,]*),", 1)
    body = F.regexp_extract(x, "^data:[^,]*,(.*)$", 1)
    mime = F.coalesce(blank_to_null(F.regexp_extract(head, "^([^;]*)", 1)), F.lit("text/plain"))
    is64 = head.endswith(";base64")
    return F.struct(mime.alias("mime"), F.when(is64, F.decode(F.unbase64(F.when(is64, body)), "utf-8")).otherwise(F.try_url_decode(body)).alias("text"))


def escape_cell(x: Column) -> Column:
    """A value inside a Markdown table."""
    for a, b in (("\r", " "), ("\n", "<br/>"), ("|", "\\|")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(x)


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: escape_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))


def pipe_table(rows: Column) -> Column:
    """A Markdown table of an array of rows of cells: ragged rows are padded, the first is the header."""

    def table(rows: Column, width: Column) -> Column:
        padded = F.transform(rows, lambda r: pipe_row(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))
        return once(padded, lambda p: F.array_join(F.concat(F.slice(p, 1, 1), F.array(rule), F.slice(p, 2, F.size(p))), "\n"))

    return once(rows, lambda r: once(F.array_max(F.transform(r, lambda x: F.size(x))), lambda width: table(r, width)))


def truncated(x: Column, n: int) -> Column:
    flat = F.replace(F.replace(x, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(F.coalesce(flat, F.lit("")))


def human_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB")):
        out = F.when(n >= 1 << power, F.concat(F.format_string("%.1f", n / float(1 << power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def split_list(x: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(x, pattern), lambda p: F.trim(p)), lambda p: p != "")


def authors(x: Column) -> Column:
    return split_list(x, "; ?| and ")


def distinct_ignoring_case(tags: Column) -> Column:
    """First spelling of each tag, in order."""
    return F.aggregate(tags, F.array().cast("array<string>"), lambda done, t: F.when(F.exists(done, lambda d: F.lower(d) == F.lower(t)), done).otherwise(F.concat(done, F.array(t))))


def _digit(s: Column, i: int) -> Column:
    return F.substring(s, i, 1)


def valid_isbn10(s: Column) -> Column:
    total = sum(((11 - i) * F.when(_digit(s, i) == "X", 10).otherwise(_digit(s, i).try_cast("int")) for i in range(1, 11)), F.lit(0))
    return F.coalesce(s.rlike("^[0-9]{9}[0-9X]$") & (total % 11 == 0), F.lit(False))


def valid_isbn13(s: Column) -> Column:
    total = sum(((3 if i % 2 == 0 else 1) * _digit(s, i).try_cast("int") for i in range(1, 14)), F.lit(0))
    return F.coalesce(s.rlike("^[0-9]{13}$") & (total % 10 == 0), F.lit(False))


def find_isbn(text: Column) -> Column:
    """The first valid ISBN after the word, digits only; other numbers may follow it after a blank or hyphen."""
    found = F.regexp_extract_all(text, F.lit(ISBN), F.lit(1))
    runs = F.flatten(F.transform(found, lambda f: F.array(f, *[F.regexp_extract(f, p, 0) for p in ISBN_HEADS])))
    plain = F.transform(runs, lambda f: F.regexp_replace(F.upper(f), "[^0-9X]", ""))
    ok = F.filter(plain, lambda s: valid_isbn10(s) | valid_isbn13(s))
    return F.try_element_at(ok, F.lit(1))


def pdf_date(x: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+HH'mm'`` with parts left out from the right; UTC; anything else is null."""
    d = F.regexp_replace(x, "^D:", "")
    part = lambda at, n, default: F.coalesce(F.when(F.length(d) >= at + n - 1, F.substring(d, at, n)).try_cast("int"), F.lit(default))
    local = F.when(d.rlike("^[0-9]{8}"), F.try_make_timestamp(part(1, 4, 1), part(5, 2, 1), part(7, 2, 1), part(9, 2, 0), part(11, 2, 0), part(13, 2, 0).cast("decimal(8,6)")))
    sign = F.regexp_extract(d, "^[0-9]{14}([+-])", 1)
    hours = F.regexp_extract(d, "^[0-9]{14}[+-]([0-9]{2})", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(d, "^[0-9]{14}[+-][0-9]{2}'([0-9]{2})", 1).try_cast("int"), F.lit(0))
    shift = F.when(sign == "-", 1).otherwise(-1) * (F.coalesce(hours, F.lit(0)) * 60 + minutes)
    return F.timestamp_micros(F.unix_micros(local) + shift.cast("long") * 60_000_000)


def filetime(x: Column) -> Column:
    """100-nanosecond steps since 1601; none for zero or less."""
    return F.when(x > 0, F.timestamp_micros(F.floor(x / 10).cast("long") - 11_644_473_600_000_000))


def unix_time(x: Column) -> Column:
    """Seconds since 1970, if from 1980 to 2100."""
    return F.when((x >= 315_532_800) & (x < 4_133_980_800), F.timestamp_seconds(x))


def candidate_score(path: Column) -> Column:
    """Likely title pages first: shallow paths, then telling names."""
    low = F.lower(path)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    some = low.contains("title") | low.contains("about") | low.contains("copyright")
    return F.when(slashes <= 1, -10).otherwise(0) + F.when(low.contains("index"), -5).otherwise(0) + F.when(low.contains("default"), -5).otherwise(0) + F.when(some, -3).otherwise(0)


def bom_charset(content: Column) -> Column:
    """The charset that a byte-order mark or valid UTF-8 tells, else null."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").when(F.is_valid_utf8(content.cast("string")), "utf-8")
