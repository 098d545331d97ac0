"""Catalogs of books: scans in order, rows, counts, tables and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.functions.ranking import bucketed_rank, range_bucket

FORMATS = {"pdf": "PDF", "epub": "EPUB", "chm": "CHM"} | dict.fromkeys(("mobi", "azw", "azw3", "prc"), "MOBI")
COLUMNS = ["name", "location", "format", "authors", "publisher", "language", "isbn", "published", "modified", "pages", "tags", "size", "description"]
DEFAULT = ["name", "format", "authors", "language", "pages", "size"]


def format_of(ext: Column) -> Column:
    return X.mapping(FORMATS, F.ltrim(F.lower(ext), F.lit(".")))


def choose_columns(wanted: str | None) -> tuple[list[str], list[str]]:
    """Known columns of a comma list (or the default ones), and the unknown, which are left out."""
    names = [w.strip().lower() for w in (wanted or "").split(",") if w.strip()]
    return [n for n in names if n in COLUMNS] or list(DEFAULT), [n for n in names if n not in COLUMNS]


def scan_order(files: DataFrame, path: str = "path", ties: tuple[str, ...] = ()) -> DataFrame:
    """1-based place and total of each file, by path whatever its case; placed within ranges of paths, not in one task.

    Equal paths are placed by the columns ``ties``; without them their order is open and may change from run to run.
    """
    total = files.count()
    files = files.withColumn("_low", F.lower(path))
    ranked = bucketed_rank(files, [], range_bucket(files, "_low"), ["_low", path, *ties], "_i")
    return ranked.withColumns({"current": F.col("_i") + 1, "total": F.lit(total).cast("long")}).drop("_i", "_low")


def cells(wanted: list[str]) -> dict[str, Column]:
    """Table cells of book metadata by column name."""
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    date = lambda c: F.coalesce(F.date_format(F.col(c), "yyyy-MM-dd"), F.lit(""))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    every = {
        "name": F.coalesce("title", stem), "location": F.col("file_path"), "format": F.col("format"), "authors": join(F.col("authors")), "publisher": text("publisher"), "language": text("language"), "isbn": text("isbn"),
        "published": date("published_date"), "modified": date("modified_date"), "pages": text("page_count"), "tags": join(F.col("tags")), "size": X.human_size(F.col("file_size_bytes")), "description": X.truncated(F.col("description"), 100),
    }
    return {w: every[w] for w in wanted}


def table_rows(books: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """One Markdown table row a book, with its sort key (lower-cased path)."""
    c = cells(wanted or DEFAULT)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(v, F.lit("|"), F.lit("\\|")) for v in c.values()]), F.lit(" |"))
    return books.select(F.lower("file_path").alias("sort_key"), line.alias("line"))


def field_table(books: DataFrame) -> DataFrame:
    """One Markdown section a book: a heading and a table of the fields it has."""
    show = lambda name, v: F.when(F.trim(v) != "", F.concat(F.lit(f"| {name} | "), v, F.lit(" |")))
    c = cells(COLUMNS)
    about = F.replace(X.truncated(F.replace(F.col("description"), F.lit("|"), F.lit("\\|")), 200), F.lit("\x00"), F.lit(""))
    lines = [F.concat(F.lit("## "), c["name"]), F.lit(""), F.lit("| Field | Value |"), F.lit("|-------|-------|")]
    lines += [show(n, c[k]) for n, k in (("Format", "format"), ("Authors", "authors"), ("Publisher", "publisher"), ("Language", "language"), ("ISBN", "isbn"), ("Pages", "pages"), ("Published", "published"), ("Modified", "modified"))]
    lines += [show("Description", about), show("Tags", c["tags"]), show("File", F.col("file_name")), show("Size", c["size"])]
    return books.select(F.lower("file_path").alias("sort_key"), F.concat_ws("\n", *lines).alias("section"))


def summary_line(books: DataFrame) -> DataFrame:
    """``**Total:** n books · PDF: a · ...`` over all books; every format is counted."""
    n = books.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("format") == f).alias(f) for f in ("PDF", "EPUB", "MOBI", "CHM")])
    parts = [F.when(F.col(f) > 0, F.concat(F.lit(f"{f}: "), F.col(f))) for f in ("PDF", "EPUB", "MOBI", "CHM")]
    total = F.concat(F.lit("**Total:** "), F.col("n"), F.when(F.col("n") == 1, " book").otherwise(" books"))
    return n.select(F.concat_ws(" · ", total, *parts).alias("line"))


def json_rows(books: DataFrame) -> DataFrame:
    """One JSON object a book, camelCase, without null fields."""
    camel = lambda c: (p := c.split("_"))[0] + "".join(x.title() for x in p[1:])
    return books.select(F.lower("file_path").alias("sort_key"), F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in books.columns])).alias("json"))
