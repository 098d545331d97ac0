"""Queries over pages, documents, conversations and synthesised identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import catalog as C
from verdigris.operators import documents as D
from verdigris.session import load
from verdigris.sources.convert import convert_files


def doc_route(spark, d):
    p = D.stream_info(load(spark, d, "pages"))
    mime = F.coalesce("mime_type", F.when(F.col("html").startswith("<!DOCTYPE html"), "text/html"))
    return p.select("page_id", D.route(F.col("url"), F.col("extension"), mime, F.col("html")).alias("route"))


def doc_mime(spark, d):
    p = D.stream_info(load(spark, d, "pages"))
    return p.select("page_id", "file_name", "extension", "mime_type", "charset")


def src_dispatch(spark, d):
    s = load(spark, d, "pages").select("page_id", F.element_at(F.array("url", F.concat(F.lit("file:///tmp/"), "page_id"), F.concat(F.lit("data:,"), "page_id"), F.concat(F.lit("/srv/"), "page_id")), (F.col("page_id") % 4 + 1).cast("int")).alias("source"))
    return s.select("page_id", X.source_kind(F.col("source")).alias("kind"))


def html_title(spark, d):
    return load(spark, d, "pages").select("page_id", X.tag_text(F.col("html"), "title").alias("title"))


def html_text(spark, d):
    return load(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


def html_links(spark, d):
    p = load(spark, d, "pages").select("page_id", X.html_links(F.col("html")).alias("links"))
    return p.select("page_id", F.size("links").cast("long").alias("n_links"), F.array_join("links", " ").alias("links"))


def page_markdown(spark, d):
    """Every page by the converter of its address."""
    pages = load(spark, d, "pages").withColumn("mime", F.lit("text/html"))
    out = convert_files(pages, "page_id", "html", url="url", mime="mime")
    return out.select(F.col("path").cast("long").alias("page_id"), "title", "markdown", "error")


def html_metadata(spark, d):
    p = load(spark, d, "pages")
    head = F.concat(F.lit('<meta name="Author" content="Ann Lee; Bo Ray and Cy"><meta property="dc.date" content="2024-03-24"><meta name="keywords" content="One, two|ONE;'), F.col("page_id"), F.lit('"><meta name=\'description\' content=\'A &amp; B\'><p>ISBN: 978-0-306-40615-7</p>'))
    return D.page_metadata(p.select("page_id", F.concat(head, "html").alias("html")))


def video_metadata(spark, d):
    p = load(spark, d, "pages")
    head = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta property="og:title" content="Video '), F.col("page_id"), F.lit('"><script>"shortDescription":"say \\"hi\\""</script>'))).otherwise('<meta name="description" content="plain">')
    return D.video_metadata(p.select("page_id", F.concat(head, "html").alias("html")))


def url_parts(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").select("page_id", X.url_scheme(u).alias("scheme"), X.url_path(u).alias("path"), X.query_parameter(u, "page").alias("page"), X.query_parameter(u, "UTM_SOURCE").alias("utm_source"))


def url_redirect(spark, d):
    u = F.concat(F.lit("a1"), F.translate(F.regexp_replace(F.base64(F.encode("url", "utf-8")), "[=\r\n]+", ""), "+/", "-_"))
    return load(spark, d, "pages").select("page_id", X.redirect_target(u).alias("target"))


def data_uri_decode(spark, d):
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data:text/markdown;base64,"), F.regexp_replace(F.base64(F.encode("text", "utf-8")), "[\r\n]+", ""))).otherwise(F.concat(F.lit("data:,"), F.replace(F.col("role"), F.lit("s"), F.lit("%73"))))
    c = load(spark, d, "conversations").select("conv_id", "turn", X.data_uri(body).alias("u"))
    return c.select("conv_id", "turn", "u.mime", "u.text")


def md_escape(spark, d):
    return load(spark, d, "documents").select("doc_id", X.escape_cell(F.coalesce("text", F.lit(""))).alias("cell"))


def md_table(spark, d):
    rows = F.array(F.array(F.lit("Name"), F.lit("Value")), F.array("p_name", "p_brand"), F.array(F.concat(F.lit("a|b"), "p_partkey")))
    return load(spark, d, "part").select("p_partkey", X.pipe_table(rows).alias("markdown"))


def csv_table(spark, d):
    text = F.concat(F.lit("key,name,note\n"), F.col("p_partkey"), F.lit(","), F.col("p_name"), F.lit(',"x, ""'), F.col("p_size"), F.lit('"" | y"\n'), F.col("p_type"))
    return load(spark, d, "part").select("p_partkey", D.csv_markdown(text).alias("markdown"))


def _notebooks(spark, d):
    kind = F.when(F.col("role") == "user", "markdown").when(F.col("role") == "assistant", "code").otherwise("raw")
    source = F.array(F.when(F.col("role") == "user", F.concat(F.lit("# "), F.col("turn"), F.lit("\n"))).otherwise(""), F.col("text"))
    cell = F.struct(kind.alias("cell_type"), source.alias("source"))
    c = load(spark, d, "conversations")
    return c.select("conv_id", "turn", F.to_json(F.struct(F.array(cell).alias("cells"), F.struct(F.lit("none").alias("title")).alias("metadata"), F.lit(4).alias("nbformat"), F.lit(2).alias("nbformat_minor"))).alias("raw"))


def nb_from_json(spark, d):
    return _notebooks(spark, d).select("conv_id", "turn", D.notebook_markdown(F.col("raw")).alias("markdown"), D.notebook_title(F.col("raw")).alias("title"))


def comment_strip(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(X.strip_comments(F.col("html"))).alias("md5"), F.length(X.strip_comments(F.col("html"))).cast("long").alias("n"))


def partial_numbers(spark, d):
    c = load(spark, d, "conversations")
    line = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("."), F.col("turn"))).otherwise(F.concat("role", F.col("turn")))
    return D.merge_partial_numbers(c.select("conv_id", "turn", line.alias("line")), "conv_id", "turn").select("conv_id", "turn", "merged")


def isbn_check(spark, d):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    ten, thirteen = F.lpad((k * 11 % 10_000_000_000).cast("string"), 10, "0"), F.concat(F.lit("978"), F.lpad((k % 10_000_000_000).cast("string"), 10, "0"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.valid_isbn10(ten).alias("ok10"), X.valid_isbn13(thirteen).alias("ok13"))


def isbn_find(spark, d):
    n = F.lpad((F.col("o_orderkey") % 10_000_000_000).cast("string"), 10, "0")
    text = F.concat(F.lit("see ISBN: 123 or isbn-13 978-"), F.substring(n, 1, 4), F.lit("-"), F.substring(n, 5, 6), F.lit(" or ISBN 0-306-40615-2."))
    return load(spark, d, "orders").select("o_orderkey", X.find_isbn(text).alias("isbn"))


def pdf_date_parse(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("D:"), day, F.lit("101530+02'30'"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("D:"), day)).otherwise(F.concat(F.lit("D:"), F.substring(day, 1, 6)))
    return load(spark, d, "orders").select("o_orderkey", F.date_format(X.pdf_date(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def tags_distinct_ci(spark, d):
    tags = X.split_list(F.concat_ws("; ", "p_type", F.lower("p_type"), "p_name", F.upper("p_name"), F.concat(F.lit(" "), "p_brand", F.lit(" ,, "))), "[,;|]")
    return load(spark, d, "part").select("p_partkey", F.array_join(X.distinct_ignoring_case(tags), ",").alias("tags"))


def author_split(spark, d):
    a = F.concat("s_name", F.lit(" and Co; Ann;; "), F.col("s_suppkey"))
    return load(spark, d, "supplier").select("s_suppkey", F.array_join(X.authors(a), "/").alias("authors"))


def numeric_times(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", F.date_format(X.filetime(F.col("o_custkey") * 1_000_000_000_000 + 116_444_736_000_000_000), "yyyy-MM-dd HH:mm:ss").alias("filetime"), F.date_format(X.unix_time(F.col("o_orderkey") * 1_000_000), "yyyy-MM-dd HH:mm:ss").alias("unix"), X.mapping(X.LANGUAGES, (F.col("o_custkey") % 64 + 1025).cast("int")).alias("language"))


def _books(spark, d):
    s = load(spark, d, "documents")
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "EPUB", "azw3", "chm", "prc"))), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("Doc"), F.col("doc_id"), F.lit("."), ext)
    text = F.coalesce("text", F.lit(""))
    return s.select(
        F.concat(F.lit("/lib/"), "source", F.lit("/"), name).alias("file_path"), name.alias("file_name"), C.format_of(F.concat(F.lit("."), ext)).alias("format"), (F.octet_length(text).cast("long") * 97).alias("file_size_bytes"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("T|"), F.col("doc_id"))).alias("title"), F.array("source", "lang").alias("authors"), F.lit(None).cast("string").alias("publisher"), text.alias("description"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("isbn"),
        F.lit(None).cast("timestamp").alias("published_date"), F.lit(None).cast("timestamp").alias("modified_date"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 900).cast("int")).alias("page_count"), F.array("lang").alias("tags"),
    )


def catalog_rows(spark, d):
    return C.table_rows(_books(spark, d), ["name", "format", "authors", "language", "pages", "size", "description"])


def catalog_sections(spark, d):
    return C.field_table(_books(spark, d))


def catalog_counts(spark, d):
    return C.summary_line(_books(spark, d))


def catalog_json(spark, d):
    return C.json_rows(_books(spark, d).select("file_path", "file_name", "format", "file_size_bytes", "title", "language", "page_count"))


def scan_progress(spark, d):
    return C.scan_order(load(spark, d, "pages").select("page_id", F.col("url").alias("path")), ties=("page_id",)).select("page_id", "current", "total")


def candidate_top12(spark, d):
    p = load(spark, d, "pages").select("page_id", X.url_path(F.col("url")).alias("path"))
    return p.select("page_id", "path", X.candidate_score(F.col("path")).alias("score")).orderBy("score", F.lower("path"), "page_id").limit(12)


def charset_sniff(spark, d):
    k = F.col("doc_id") % 4
    text = F.substring(F.coalesce("text", F.lit("")), 1, 1 << 30)
    raw = F.when(k == 0, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode(text, "utf-8"))).when(k == 1, F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode(text, "utf-16le"))).when(k == 2, F.encode(text, "utf-8")).otherwise(F.concat(F.lit(bytearray(b"\xe9 ")), F.encode(text, "utf-8")))
    return load(spark, d, "documents").select("doc_id", X.bom_charset(raw).alias("charset"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_route, doc_mime, src_dispatch, html_title, html_text, html_links, html_metadata, page_markdown, video_metadata, url_parts, url_redirect, data_uri_decode, md_escape, md_table, csv_table, nb_from_json, comment_strip, partial_numbers,
        isbn_check, isbn_find, pdf_date_parse, tags_distinct_ci, author_split, numeric_times, catalog_rows, catalog_sections, catalog_counts, catalog_json, scan_progress, candidate_top12, charset_sniff,
    )
}


def _entities(x):
    for a, b in X.ENTITIES.items():
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _strip(x):
    inner = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return rf"trim(regexp_replace({_entities(inner)}, '\s+', ' ', 'g'))"


def _no(x, *tags):
    for t in tags:
        x = f"regexp_replace({x}, '(?is)<{t}[^>]*>.*?</{t}>', '', 'g')"
    return x


def _title(x):
    inner = _strip(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)")
    return f"nullif({inner}, '')"


_COMMENTS = "regexp_replace({}, '(?s)<!--.*?-->', '', 'g')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_INFO = rf"""WITH a AS (SELECT *, nullif(regexp_extract({_PATH}, '([^/\\]*)$', 1), '') AS file_name FROM pages), b AS (SELECT *, nullif(lower(regexp_extract(file_name, '(\.[^./\\]+)$', 1)), '') AS extension FROM a),
c AS (SELECT *, CASE {" ".join(f"WHEN extension = '.{e}' THEN '{m}'" for e, m in X.EXTENSION_MIME.items())} END AS mime_type FROM b)"""
_ESC = r"trim(replace(replace(replace({}, chr(13), ' '), chr(10), '<br/>'), '|', '\|'))"
_BOOKS = """WITH s AS (SELECT *, (['pdf', 'EPUB', 'azw3', 'chm', 'prc'])[doc_id % 5 + 1] AS ext FROM documents), n AS (SELECT *, 'Doc' || doc_id || '.' || ext AS file_name FROM s),
b AS (SELECT '/lib/' || source || '/' || file_name AS file_path, file_name, (['PDF', 'EPUB', 'MOBI', 'CHM', 'MOBI'])[doc_id % 5 + 1] AS format, strlen(coalesce(text, '')) * 97 AS size, CASE WHEN doc_id % 3 = 0 THEN 'T|' || doc_id END AS title, source, lang,
  replace(replace(coalesce(text, ''), chr(13), ''), chr(10), ' ') AS flat, CASE WHEN doc_id % 2 = 0 THEN doc_id % 900 END AS pages FROM n),
c AS (SELECT *, coalesce(title, regexp_replace(file_name, '\\.[^.]*$', '')) AS name, CASE WHEN size >= 1073741824 THEN printf('%.1f GB', round(size / 1073741824.0, 1)) WHEN size >= 1048576 THEN printf('%.1f MB', round(size / 1048576.0, 1)) WHEN size >= 1024 THEN printf('%.1f KB', round(size / 1024.0, 1)) ELSE size || ' B' END AS human FROM b)"""
ORACLE_SQL = {
    "doc_route": _INFO + """ SELECT page_id, CASE WHEN regexp_matches(lower(url), '^https?://([^/?#]*\\.)?wikipedia\\.org([/?#]|$)') THEN 'wikipedia' WHEN coalesce(extension, '') = '.pdf' THEN 'pdf' WHEN coalesce(extension, '') IN ('.html', '.htm') OR (mime_type IS NULL AND starts_with(html, '<!DOCTYPE html')) THEN 'html' ELSE 'unsupported' END AS route FROM c""",
    "doc_mime": _INFO + " SELECT page_id, file_name, extension, mime_type, CASE WHEN starts_with(mime_type, 'text/') THEN 'utf-8' END AS charset FROM c",
    "src_dispatch": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'file' WHEN 2 THEN 'data' ELSE 'local' END AS kind FROM pages",
    "html_title": f"SELECT page_id, {_title('html')} AS title FROM pages",
    "html_text": f"SELECT page_id, {_strip(_COMMENTS.format(_no('html', 'script', 'style')))} AS text FROM pages",
    "html_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1) AS l FROM pages) SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM l""",
    "html_metadata": f"SELECT page_id, {_title('html')} AS title, 'Ann Lee; Bo Ray; Cy' AS authors, NULL::VARCHAR AS publisher, 'A & B' AS description, 'One, two, ' || page_id AS tags, '9780306406157' AS isbn FROM pages",
    "video_metadata": f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Video ' || page_id ELSE {_title('html')} END AS title, CASE WHEN page_id % 2 = 0 THEN 'say \\"hi\\"' ELSE 'plain' END AS description, NULL::VARCHAR AS keywords FROM pages""",
    "url_parts": f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {_PATH} AS path, nullif(url_decode(regexp_extract(url, '[?&]page=([^&#]*)', 1)), '') AS page, nullif(url_decode(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1)), '') AS utm_source FROM pages",
    "url_redirect": "SELECT page_id, url AS target FROM pages",
    "data_uri_decode": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'text/markdown' ELSE 'text/plain' END AS mime, CASE WHEN turn % 2 = 0 THEN text ELSE role END AS text FROM conversations",
    "md_escape": f"SELECT doc_id, {_ESC.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS cell FROM documents",
    "md_table": r"SELECT p_partkey, '| Name | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || '| a\|b' || p_partkey || ' |  |' AS markdown FROM part",
    "csv_table": r"""SELECT p_partkey, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || p_partkey || ' | ' || p_name || ' | x, "' || p_size || '" \| y |' || chr(10) || '| ' || p_type || ' |  |  |' AS markdown FROM part""",
    "nb_from_json": """SELECT conv_id, turn, CASE role WHEN 'user' THEN '# ' || turn || chr(10) || text WHEN 'assistant' THEN '```python' || chr(10) || text || chr(10) || '```' ELSE '```' || chr(10) || text || chr(10) || '```' END AS markdown, CASE role WHEN 'user' THEN turn::VARCHAR ELSE 'none' END AS title FROM conversations""",
    "comment_strip": f"WITH s AS (SELECT page_id, {_COMMENTS.format('html')} AS x FROM pages) SELECT page_id, md5(x) AS md5, length(x) AS n FROM s",
    "partial_numbers": """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '.' || turn ELSE role || turn END AS line FROM conversations), w AS (SELECT *, lag(line) OVER o AS b, lead(line) OVER o AS a FROM l WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN regexp_matches(b, '^\\.[0-9]+$') THEN b || line ELSE line END AS merged FROM w WHERE NOT regexp_matches(line, '^\\.[0-9]+$') OR a IS NULL""",
    "isbn_check": """WITH k AS (SELECT l_orderkey, l_linenumber, lpad((((l_orderkey * 8 + l_linenumber) * 11) % 10000000000)::VARCHAR, 10, '0') AS t, '978' || lpad(((l_orderkey * 8 + l_linenumber) % 10000000000)::VARCHAR, 10, '0') AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, list_sum(list_transform(range(1, 11), lambda i: (11 - i) * t[i]::INT)) % 11 = 0 AS ok10, list_sum(list_transform(range(1, 14), lambda i: (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) * u[i]::INT)) % 10 = 0 AS ok13 FROM k""",
    "isbn_find": """WITH k AS (SELECT o_orderkey, '978' || lpad((o_orderkey % 10000000000)::VARCHAR, 10, '0') AS u FROM orders)
SELECT o_orderkey, CASE WHEN list_sum(list_transform(range(1, 14), lambda i: (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) * u[i]::INT)) % 10 = 0 THEN u ELSE '0306406152' END AS isbn FROM k""",
    "pdf_date_parse": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(date_trunc('day', o_orderdate) + INTERVAL 7 HOUR + INTERVAL 45 MINUTE + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders",
    "tags_distinct_ci": "SELECT p_partkey, p_type || ',' || p_name || ',' || p_brand AS tags FROM part",
    "author_split": "SELECT s_suppkey, s_name || '/Co/Ann/' || s_suppkey AS authors FROM supplier",
    "numeric_times": f"""SELECT o_orderkey, strftime(make_timestamp((o_custkey * 1000000000000) // 10), '%Y-%m-%d %H:%M:%S') AS filetime, CASE WHEN o_orderkey * 1000000 >= 315532800 AND o_orderkey * 1000000 < 4133980800 THEN strftime(make_timestamp(o_orderkey * 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') END AS unix,
CASE o_custkey % 64 + 1025 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in X.LANGUAGES.items())} END AS language FROM orders""",
    "catalog_rows": _BOOKS + r""" SELECT lower(file_path) AS sort_key, '| ' || concat_ws(' | ', replace(name, '|', '\|'), format, source || ', ' || lang, lang, coalesce(pages::VARCHAR, ''), human, replace(CASE WHEN length(flat) > 100 THEN flat[1:100] || '…' ELSE flat END, '|', '\|')) || ' |' AS line FROM c""",
    "catalog_sections": _BOOKS + r""", d AS (SELECT *, replace(flat, '|', '\|') AS e FROM c) SELECT lower(file_path) AS sort_key, concat_ws(chr(10), '## ' || name, '', '| Field | Value |', '|-------|-------|', '| Format | ' || format || ' |', '| Authors | ' || source || ', ' || lang || ' |', '| Language | ' || lang || ' |',
'| Pages | ' || pages || ' |', CASE WHEN trim(e) <> '' THEN '| Description | ' || CASE WHEN length(e) > 200 THEN e[1:200] || '…' ELSE e END || ' |' END, '| Tags | ' || lang || ' |', '| File | ' || file_name || ' |', '| Size | ' || human || ' |') AS section FROM d""",
    "catalog_counts": _BOOKS + " SELECT concat_ws(' · ', '**Total:** ' || count(*) || CASE WHEN count(*) = 1 THEN ' book' ELSE ' books' END, 'PDF: ' || nullif(count(*) FILTER (format = 'PDF'), 0), 'EPUB: ' || nullif(count(*) FILTER (format = 'EPUB'), 0), 'MOBI: ' || nullif(count(*) FILTER (format = 'MOBI'), 0), 'CHM: ' || nullif(count(*) FILTER (format = 'CHM'), 0)) AS line FROM c",
    "catalog_json": _BOOKS + """ SELECT lower(file_path) AS sort_key, '{"filePath":"' || file_path || '","fileName":"' || file_name || '","format":"' || format || '","fileSizeBytes":' || size || CASE WHEN title IS NULL THEN '' ELSE ',"title":"' || title || '"' END || ',"language":"' || lang || '"' || CASE WHEN pages IS NULL THEN '' ELSE ',"pageCount":' || pages END || '}' AS json FROM c""",
    "scan_progress": "SELECT page_id, row_number() OVER (ORDER BY lower(url), url) AS current, count(*) OVER () AS total FROM pages",
    "candidate_top12": f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), s AS (SELECT *, CASE WHEN length(path) - length(replace(path, '/', '')) <= 1 THEN -10 ELSE 0 END + CASE WHEN contains(lower(path), 'index') THEN -5 ELSE 0 END + CASE WHEN contains(lower(path), 'default') THEN -5 ELSE 0 END + CASE WHEN contains(lower(path), 'title') OR contains(lower(path), 'about') OR contains(lower(path), 'copyright') THEN -3 ELSE 0 END AS score FROM p) SELECT * FROM s ORDER BY score, lower(path), page_id LIMIT 12",
    "charset_sniff": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-8' END AS charset FROM documents",
}
