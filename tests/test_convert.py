import io
import json
import struct
import zipfile

import pytest

from verdigris.functions.markdown import html_to_markdown, table
from verdigris.sources import convert as C

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'


def pack(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return b.getvalue()


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def docx():
    body = '<w:p><w:pPr><w:pStyle w:val="My"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    styles = '<w:style w:styleId="My"><w:name w:val="my"/><w:basedOn w:val="H2"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style>'
    return pack(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>"})


def xlsx():
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Score</t></is></c></row><row><c r="A2"><v>5</v></c><c r="B2" t="b"><v>1</v></c></row>'
    return pack(**{
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="Sheet1" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(r1="worksheets/s1.xml", r2="worksheets/s2.xml"),
        "xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>", "xl/worksheets/s1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>", "xl/worksheets/s2.xml": "<worksheet><sheetData/></worksheet>",
    })


def pptx():
    sp = lambda text, y, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    chart = '<p:graphicFrame><p:xfrm><a:off x="0" y="900"/></p:xfrm><a:graphic><c:chart r:id="c1"/></a:graphic></p:graphicFrame>'
    slide = f'<p:sld {W}><p:cSld><p:spTree>{sp("low", 500)}{sp("Title", 10, chr(60) + "p:ph type=" + chr(34) + "title" + chr(34) + "/>")}{chart}</p:spTree></p:cSld></p:sld>'
    data = f'<c:chartSpace {W}><c:title><a:t>Sales</a:t></c:title><c:ser><c:tx><c:pt><c:v>Q</c:v></c:pt></c:tx><c:cat><c:pt><c:v>Q1</c:v></c:pt></c:cat><c:val><c:pt><c:v>4</c:v></c:pt></c:val></c:ser></c:chartSpace>'
    return pack(**{
        "ppt/presentation.xml": f'<p:presentation {W}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(r1="slides/s1.xml"), "ppt/slides/s1.xml": slide,
        "ppt/slides/_rels/s1.xml.rels": rels(c1="../charts/c.xml", n1="../notesSlides/n.xml"), "ppt/charts/c.xml": data, "ppt/notesSlides/n.xml": f"<p:notes {W}><a:p><a:r><a:t>say it</a:t></a:r></a:p></p:notes>",
    })


def epub():
    opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>Ann</dc:creator><dc:language>en</dc:language><dc:identifier>isbn:1</dc:identifier><dc:subject>x</dc:subject></metadata><manifest><item id="c1" href="c1.xhtml"/></manifest><spine><itemref idref="c1"/></spine></package>'
    ncx = '<ncx><navMap><navPoint><navLabel><text>First</text></navLabel><content src="c1.xhtml#a"/></navPoint></navMap></ncx>'
    return pack(**{"META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>', "O/c.opf": opf, "O/toc.ncx": ncx, "O/c1.xhtml": "<html><body><p>Once</p></body></html>"})


def mobi(kind=1, exth=True):
    title, body = b"Full Name", b"<html><body><h1>Hello</h1></body></html>"
    ex = b""
    if exth:
        recs = b"".join(struct.pack(">II", c, 8 + len(v)) + v for c, v in ((100, b"Ann"), (100, b"Bo"), (101, b"Press"), (104, b"978"), (105, b"tag"), (524, b"en")))
        ex = b"EXTH" + struct.pack(">II", 12 + len(recs), 6) + recs
    head = bytearray(16 + 232)
    struct.pack_into(">HHIH", head, 0, kind, 0, len(body), 1)
    head[16:20] = b"MOBI"
    struct.pack_into(">I", head, 20, 232)
    struct.pack_into(">II", head, 16 + 68, len(head) + len(ex), len(title))
    r0 = bytes(head) + ex + title
    start = 78 + 16 + 2
    top = bytearray(start)
    top[:4] = b"Palm"
    struct.pack_into(">H", top, 76, 2)
    struct.pack_into(">I", top, 78, start)
    struct.pack_into(">I", top, 86, start + len(r0))
    return bytes(top) + r0 + body


def pdf():
    s = b"BT (Hello) Tj 0 -14 Td (.1) Tj 0 -14 Td (World) Tj ET"
    return b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Length " + str(len(s)).encode() + b">> stream\n" + s + b"\nendstream endobj\n3 0 obj <</Title (T) /Author (Ann; Bo) /Creator (Pub)>> endobj\ntrailer <</Info 3 0 R>>"


RSS = b'<?xml version="1.0"?><rss><channel><title>Feed</title><link>http://x/</link><description>About</description><item><title>One</title><link>http://x/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>&lt;b&gt;hi&lt;/b&gt;</description></item></channel></rss>'
ATOM = b'<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><entry><title>One</title><link href="http://x/1"/><updated>2024-01-01T10:00:00Z</updated><summary>sum</summary></entry></feed>'
NOTEBOOK = json.dumps({"nbformat": 4, "nbformat_minor": 2, "cells": [{"cell_type": "markdown", "source": ["# Test Title\n", "x"]}, {"cell_type": "code", "source": "1+1"}, {"cell_type": "raw", "source": " "}]}).encode()


@pytest.mark.parametrize(
    "name, raw, parts, title",
    [
        ("a.html", b"<title>Test</title><h1>Hello</h1><p>World <b>x</b></p><script>no</script>", ["# Hello", "World **x**"], "Test"),
        ("a.csv", b'Name,Value\n"A|B",1\n', ["| Name | Value |", "| A\\|B | 1 |"], None),
        ("a.csv", "名前,年齢\n太郎,5".encode("cp932"), ["| 名前 | 年齢 |"], None),
        ("a.json", b'{"key":"value"}', ['{"key":"value"}'], None),
        ("a.xml", RSS, ["# Feed", "## One", "Published on: Mon, 01 Jan 2024 10:00:00 GMT", "**hi**"], "Feed"),
        ("a.xml", ATOM, ["# Feed", "[One](http://x/1)", "Updated on: Mon, 01 Jan 2024"], "Feed"),
        ("a.ipynb", NOTEBOOK, ["# Test Title", "```python\n1+1\n```"], "Test Title"),
        ("a.docx", docx(), ["## Head", "**bold**", "- item", "| A |  |"], "Head"),
        ("a.xlsx", xlsx(), ["## Sheet1", "| Name |  | Score |", "| 5 | TRUE |  |"], None),
        ("a.pptx", pptx(), ["<!-- Slide number: 1 -->\n\n# Title\n\nlow", "### Chart: Sales", "| Q1 | 4 |", "### Notes:\nsay it"], "Title"),
        ("a.epub", epub(), ["**Title:** Book", "## First\n\nOnce"], "Book"),
        ("a.mobi", mobi(), ["# Hello"], "Full Name"),
        ("a.pdf", pdf(), ["## Page 1", "Hello\n.1World"], "T"),
        ("a.zip", pack(**{"x.txt": "inside", "y.bin": b"\0"}), ["inside"], None),
        ("a.bmp", b"BM" + bytes(16) + struct.pack("<iiHH", 2, 3, 1, 24) + bytes(20), ["- Image Width: 2"], None),
        ("a.wav", b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 0, 4, 16), ["Sample Rate: 44100"], None),
    ],
)
def test_converters(name, raw, parts, title):
    text, got, error = C.convert(raw, C.Info(file_name=name))
    assert error is None and got == title
    for p in parts:
        assert p in text


def test_unreadable():
    assert C.convert(b"\0\1\2", C.Info(file_name="a.xyz"))[2] == "unsupported format"
    assert C.convert(b"no zip", C.Info(file_name="a.docx"))[2].startswith("docx: ValueError")


def test_palm_codec():
    assert C.unpack_palm(b"\x03abcd\xc1\0") == b"abcd A\0"
    assert C.unpack_palm(b"abc" + bytes([0x80, 3 << 5 | 0])) == b"abcabc"


def test_markdown_pieces():
    assert table([["a"], ["b", "c|d"]]) == "| a |  |\n| --- | --- |\n| b | c\\|d |"
    assert html_to_markdown("<ul><li>a<li>b</ul><ol><li>c</li></ol>")[0].split() == ["-", "a", "-", "b", "1.", "c"]
    assert html_to_markdown("<table><tr><th>x<td>y</table><blockquote>q</blockquote><a href='u'>t</a>")[0].endswith("> q\n\n[t](u)")


def test_registry_fallback(monkeypatch):
    monkeypatch.setattr(C, "_registry", list(C._registry))

    def refuse(raw, info):
        raise C.Unsupported

    C.register("first", lambda raw, i: i.extension == ".txt", refuse, -1.0)
    assert C.convert(b"x", C.Info(file_name="a.txt")) == ("x", None, None)


def test_info():
    i = C.Info(url="http://h/p/a.html?x#y").merged(C.Info(charset="cp932")).normal()
    assert (i.file_name, i.extension, i.mime_type, i.charset) == ("a.html", ".html", "text/html", "cp932")


def test_scan(spark, tmp_path):
    for name, raw in (("a.mobi", mobi()), ("b.pdf", pdf()), ("d/c.epub", epub()), ("bad.epub", b"x"), ("n.txt", b"t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    files = C.read_files(spark, str(tmp_path))
    rows = {r.file_name: r for r in C.scan_books(files).collect()}
    assert sorted(rows) == ["a.mobi", "b.pdf", "bad.epub", "c.epub"]
    assert rows["a.mobi"].authors == ["Ann", "Bo"] and rows["a.mobi"].publisher == "Press" and rows["a.mobi"].language == "en"
    assert rows["b.pdf"].publisher == "Pub" and rows["b.pdf"].authors == ["Ann", "Bo"] and rows["b.pdf"].page_count == 1
    assert rows["c.epub"].title == "Book" and rows["bad.epub"].error
    out = {r.path.rpartition("/")[2]: r for r in C.convert_files(files).collect()}
    assert out["n.txt"].markdown == "t" and out["bad.epub"].error


ARTICLE = (
    '<html><head><title>Newt - Enc</title></head><body><nav>menu</nav><h1><span class="x mw-page-title-main">Newt &amp; eft</span></h1>'
    '<div id="mw-content-text" class="c"><div>A <b>newt</b>.<br><img src="n.png" alt="n"></div><script>no()</script><style>no{}</style><p>More</p></div><footer>foot</footer></body></html>'
)


def test_articles():
    page = C.Info(url="https://en.wikipedia.org/wiki/Newt", mime_type="text/html")
    text, title, error = C.convert(ARTICLE.encode(), page)
    assert error is None and title == "Newt & eft" and text.startswith("# Newt & eft\n\nA **newt**.") and text.endswith("More")
    assert all(x not in text for x in ("menu", "foot", "no"))
    assert C.convert(b"<title>T</title><h1>Plain</h1>", page)[:2] == ("# Plain", "T")
    assert "menu" in C.convert(ARTICLE.encode(), C.Info(url="https://example.org/wiki/Newt", mime_type="text/html"))[0]
    untitled = C.convert(b'<title>Only &lt;this&gt;</title><div id="mw-content-text">x', page)
    assert untitled[:2] == ("# Only <this>\n\nx", "Only <this>")


def test_videos(monkeypatch):
    page = (
        '<meta property="og:title" content="A &quot;talk&quot;"><meta content="PT2M" itemprop="duration"><meta itemprop="interactionCount" content="12"><meta name="keywords" content="a, b"><meta name="description" content="short">'
        r'<script>{"shortDescription":"first\nsecond \u00e9 \"q\"","captionTracks":[{"baseUrl":"https://cap.example/t?a=1\u0026b=2"}]}</script>'
    )
    info = C.Info(url="https://www.youtube.com/watch?v=x", mime_type="text/html")
    want = '# A "talk"\n\nhttps://www.youtube.com/watch?v=x\n\n## Video Metadata\n\n- **Views:** 12\n- **Duration:** PT2M\n- **Keywords:** a, b\n\n## Description\n\nfirst\nsecond é "q"'
    assert C.convert(page.encode(), info) == (want, 'A "talk"', None)
    asked = []
    monkeypatch.setattr(C.web_pages, "fetch_captions", lambda url: asked.append(url) or "<transcript><text start='1'>one &amp;amp; two</text><text> </text><text>three</text></transcript>")
    assert C.convert(page.encode(), info)[0] == want + "\n\n## Transcript\n\none & two\nthree"
    assert asked == ["https://cap.example/t?a=1&b=2"]
    monkeypatch.setattr(C.web_pages, "fetch_captions", lambda url: 1 / 0)
    assert C.convert(page.encode(), info)[0] == want
    assert C.convert(b"<title>t</title>", C.Info(url="https://youtu.be/x"))[0] == "# t\n\nhttps://youtu.be/x"


def test_search_pages():
    import base64

    code = "a1" + base64.urlsafe_b64encode(b"https://example.org/x?y=1&z=2").decode().rstrip("=")
    page = f'<title>q &amp; s</title><ol><li class="b_algo"><a class="tptt" href="https://www.bing.com/ck/a?p=1&amp;u={code}">Name</a><i class="algoSlug_icon">ICON</i><p>About it</p></li><li class="b_algo"><a href="https://plain.example/?u=zz%21">B</a></li></ol><div>other</div>'
    text, title, error = C.convert(page.encode(), C.Info(url="https://www.bing.com/search?q=two%20words&x=1", mime_type="text/html"))
    assert error is None and title == "q & s"
    assert text.startswith("## A Bing search for 'two words' found the following results:\n\n") and "[Name ](https://example.org/x?y=1&z=2)" in text
    assert "ICON" not in text and "other" not in text and "https://plain.example/?u=zz%21" in text


def test_pages_by_url(spark):
    rows = [("1", ARTICLE, "https://de.wikipedia.org/wiki/M", "text/html"), ("2", "<h1>x</h1>", "https://example.org/a.html", None), ("3", None, None, None)]
    df = spark.createDataFrame(rows, "id string, html string, url string, mime string")
    out = {r.path: r for r in C.convert_files(df, "id", "html", url="url", mime="mime").collect()}
    assert out["1"].title == "Newt & eft" and out["2"].markdown == "# x" and out["3"].error == "no content"


def test_dates():
    from datetime import datetime

    for text, want in (("D:20240315120000+02'30'", datetime(2024, 3, 15, 9, 30)), ("20240315", datetime(2024, 3, 15)), ("D:20240315235959-01'00", datetime(2024, 3, 16, 0, 59, 59)), ("D:20241399", None), ("2024", None), (None, None)):
        assert C.pdf_date(text) == want, text
    for text, want in (("2021", datetime(2021, 1, 1)), ("2021-05", datetime(2021, 5, 1)), ("2024-03-24T10:00:00+02:00", datetime(2024, 3, 24, 8)), ("Mon, 01 Jan 2024 10:00:00 GMT", datetime(2024, 1, 1, 10)), ("soon", None), ("", None)):
        assert C.loose_date(text) == want, text


def test_book_dates():
    from datetime import datetime

    opf = '<package><metadata><date event="modification">2020-01-01</date><date event="Publication">2018-02-03</date><title>B</title></metadata><manifest/><spine/></package>'
    raw = pack(**{"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o.opf"/></rootfiles></container>', "o.opf": opf})
    assert C.book_metadata(raw, "a.epub")["published_date"] == datetime(2018, 2, 3)
    raw = pdf().replace(b"/Title (T)", b"/Title (T) /CreationDate (D:20200102030405Z) /ModDate (D:20210102)")
    m = C.book_metadata(raw, "a.pdf")
    assert m["published_date"] == datetime(2020, 1, 2, 3, 4, 5) and m["modified_date"] == datetime(2021, 1, 2)


def compound(streams):
    """A compound file of 512-byte sectors: the mini stream holds all streams."""
    mini, entries, at = b"", [], 0
    fat = []
    for name, body in streams.items():
        size = -(-len(body) // 64) * 64
        entries.append((name, 2, at // 64, len(body)))
        mini += body.ljust(size, b"\0")
        fat += [*range(at // 64 + 1, (at + size) // 64), 0xFFFFFFFE]
        at += size
    n_mini = max(1, -(-len(mini) // 512))
    directory = [("Root Entry", 5, 3, len(mini)), *entries]
    n_dir = -(-len(directory) * 128 // 512)
    # sectors: 0 fat, 1 mini fat, 2 unused, 3 .. mini stream, then the directory
    first = 3 + n_mini
    chain = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *range(4, 3 + n_mini), 0xFFFFFFFE, *range(first + 1, first + n_dir), 0xFFFFFFFE]
    out = bytearray(512)
    out[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HH", out, 30, 9, 6)
    struct.pack_into("<I", out, 48, first)
    struct.pack_into("<III", out, 56, 4096, 1, 1)
    struct.pack_into("<109I", out, 76, 0, *[0xFFFFFFFF] * 108)
    words = lambda x: struct.pack("<128I", *x, *[0xFFFFFFFF] * (128 - len(x)))
    body = b""
    for name, kind, start, size in directory:
        raw = name.encode("utf-16-le") + b"\0\0"
        e = bytearray(128)
        e[: len(raw)] = raw
        struct.pack_into("<HB", e, 64, len(raw), kind)
        struct.pack_into("<IQ", e, 116, start, size)
        body += bytes(e)
    return bytes(out) + words(chain) + words(fat) + bytes(512) + mini.ljust(n_mini * 512, b"\0") + body.ljust(n_dir * 512, b"\0")


def test_outlook_message():
    text = lambda s: s.encode("utf-16-le")
    raw = compound({"__substg1.0_0037001F": text("Plans"), "__substg1.0_0C1F001F": text("ann@x.example"), "__substg1.0_1000001F": text("Hello\n" * 40), "__substg1.0_0E04001F": text("bo@x.example")})
    got = C.convert(raw, C.Info(file_name="a.msg"))
    assert got == ("# Email Message\n\n**From:** ann@x.example\n**To:** bo@x.example\n**Subject:** Plans\n\n## Content\n\n" + ("Hello\n" * 40).rstrip(), "Plans", None)
    assert C.convert(compound({"other": b"x"}), C.Info(file_name="a.msg"))[0] == "# Email Message"


def test_mp3_tags():
    frame = lambda k, body: k + struct.pack(">IH", len(body), 0) + body
    raw = b"ID3\3\0\0" + bytes(4) + frame(b"TIT2", b"\x01" + "Söng".encode("utf-16")) + frame(b"TXXX", b"\0x") + frame(b"TPE1", b"\x03Ann\0") + bytes(20)
    assert C.convert(raw, C.Info(file_name="a.mp3"))[0] == "Title: Söng\nArtist: Ann"
    assert C.convert(b"\xff\xfb" + bytes(50), C.Info(file_name="a.mp3"))[0] == "_No metadata found._"


def test_choose_columns():
    from verdigris.operators.catalog import DEFAULT, choose_columns

    assert choose_columns(None) == (DEFAULT, []) and choose_columns("Name, size,odd") == (["name", "size"], ["odd"]) and choose_columns("odd") == (DEFAULT, ["odd"])


def pdf_file(objects, trailer, streams=()):
    """A file of objects by number; ``streams``: (number, dictionary, content)."""
    out = b"%PDF-1.7\n"
    for n, body in objects.items():
        out += b"%d 0 obj %s endobj\n" % (n, body)
    for n, about, body in streams:
        out += b"%d 0 obj <<%s /Length %d>> stream\n%s\nendstream endobj\n" % (n, about, len(body), body)
    return out + (b"trailer << %s >>" % trailer if trailer else b"")


def test_pdf_tables_and_lines():
    """Word boxes give tables and lines; pages follow the tree, resources are inherited."""
    table_page = b"BT /F 10 Tf 1 0 0 1 50 700 Tm (Name) Tj 1 0 0 1 150 700 Tm (Score) Tj 1 0 0 1 50 680 Tm (Ann B) Tj 1 0 0 1 150 680 Tm (5) Tj ET"
    lines = b"BT /F 10 Tf 14 TL 50 700 Td [(Hel) -20 (lo) -600 (there)] TJ T* (second) Tj 0 -40 Td <74686972 64> Tj (\\(x\\051) ' ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [5 0 R 4 0 R] /Resources << /Font << /F 3 0 R >> >> >>", 3: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>", 5: b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>", 8: b"<< /Title <FEFF00C4> /Author (Ann) >>",
    }
    import zlib

    raw = pdf_file(objects, b"/Root 1 0 R /Info 8 0 R", [(6, b"", lines), (7, b"/Filter /FlateDecode", zlib.compress(table_page))])
    text, title, error = C.convert(raw, C.Info(file_name="a.pdf"))
    assert error is None and title == "Ä"
    assert text == "## Page 1\n\nHello there\nsecond\n\nthird\n(x)\n\n## Page 2\n\n| Name | Score |\n| --- | --- |\n| Ann B | 5 |"


def test_pdf_object_streams_and_character_maps():
    """Objects in a compressed stream, a cross-reference stream for a trailer, two-byte codes read by their map, a form."""
    import zlib

    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R] >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R /DescendantFonts [5 0 R] >>",
             4: b"<< /Type /Page /Contents 7 0 R /Resources << /Font << /F 3 0 R >> /XObject << /X 8 0 R >> >> >>", 5: b"<< /DW 600 /W [1 [500 500] 3 9 700] >>"}
    heads, body = b"", b""
    for n, x in inner.items():
        heads += b"%d %d " % (n, len(body))
        body += x + b" "
    packed = zlib.compress(heads + body)
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar 2 beginbfrange <0003> <0005> <0061> <0006> <0007> [<4E2D> <6587>] endbfrange"
    streams = [
        (6, b"/Type /ObjStm /N 5 /First %d /Filter /FlateDecode" % len(heads), packed), (7, b"", b"q 2 0 0 2 0 0 cm BT /F 12 Tf 10 300 Td <0001000200030005> Tj ET Q /X Do"),
        (8, b"/Subtype /Form", b"BT /F 12 Tf 10 300 Td <00060007> Tj ET"), (9, b"", cmap), (10, b"/Type /XRef /Root 1 0 R", b""),
    ]
    text, _, error = C.convert(pdf_file({}, b"", streams), C.Info(file_name="a.pdf"))
    assert error is None and text == "## Page 1\n\nHfiac\n\n中文"


def test_pdf_edges():
    assert C.convert(pdf_file({1: b"<< /Type /Page >>"}, b"/X 1"), C.Info(file_name="a.pdf"))[0] == "## Page 1"
    assert "encrypted" in C.convert(pdf_file({1: b"<< >>"}, b"/Encrypt 1 0 R"), C.Info(file_name="a.pdf"))[2]
    assert C.convert(b"%PDF-1.4 (cut", C.Info(file_name="a.pdf")) == ("", None, None)
    from verdigris.sources.pdf import _predicted

    rows = bytes([0, 1, 2, 3]) + bytes([1, 5, 1, 1]) + bytes([2, 1, 1, 1]) + bytes([4, 1, 0, 0])
    assert list(_predicted(rows, {"Predictor": 12, "Columns": 3})) == [1, 2, 3, 5, 6, 7, 6, 7, 8, 7, 7, 8]


def test_page_markdown(spark, sf_dir):
    """The query's rows are what the converters make of each page."""
    from verdigris.plans.documents import QUERIES

    rows = {r.page_id: r for r in QUERIES["page_markdown"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        want = C.convert((p.html or "").encode(), C.Info(url=p.url, mime_type="text/html"))
        assert p.html is None or (rows[p.page_id].markdown, rows[p.page_id].title, rows[p.page_id].error) == want
