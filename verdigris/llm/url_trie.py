"""Operator 7: URL allow and block lists in a trie over reversed host labels, then path characters.

A rule is a host and a path: it fits that host and its subdomains where the URL's path starts with the rule's. The
longest fitting rule wins (by its characters; of equally long ones the one with the longer host, then a block), and
without one the default verdict holds. The trie is broadcast only if the rules are within ``most_rules`` and
``most_bytes``; larger lists are joined by hashed keys instead, one row for each pair of host suffix and length of path
that occurs among the rules, so that a URL meets at most as many keys as it has suffixes and characters.

Null URLs, and those without ``://``, have an empty host and path and only the default verdict. Repeated rows are judged
each by itself. Of equal rules with both verdicts the block stands. No rules or no rows: defaults, or an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.session import load, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule) as the query applies them.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def split_url(url):
    """Host and path columns of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class Trie:
    """Nodes are dicts: host labels from the last to the first, then under "/" a dict of path characters."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in sorted(rules):
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault((label,), {})
            node = node.setdefault("paths", {})
            for char in slash + path:
                node = node.setdefault(char, {})
            node["rule"] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, size = (None, None), -1
        if not host:
            return best
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get((label,))
            if node is None:
                break
            at = node.get("paths")
            if at is None:
                continue
            depth = 0
            while at is not None:
                if (found := at.get("rule")) and len(found[0]) >= size:
                    best, size = found, len(found[0])
                at = at.get(path[depth]) if depth < len(path) else None
                depth += 1
        return best


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow", most_rules: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page. ``rules``: pairs, or a table (verdict, rule)."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        n, size = rules.select(F.count("rule"), F.coalesce(F.sum(F.length("rule")), F.lit(0))).first()
        if n > most_rules or size > most_bytes:
            return by_join(split, rules, default)
        rules = [(r.verdict, r.rule) for r in rules.select("verdict", "rule").na.drop().collect()]
    elif len(rules) > most_rules or sum(len(r) for _, r in rules) > most_bytes:
        return by_join(split, spark.createDataFrame(rules, "verdict string, rule string"), default)
    shared = spark.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = shared.value.find
        for b in batches:
            found = [find(h, p) for h, p in zip(b["host"].tolist(), b["path"].tolist())]
            yield b.assign(rule=[f[0] for f in found], verdict=[f[1] or default for f in found])

    return split.mapInPandas(judge, "page_id long, host string, path string, rule string, verdict string")


def by_join(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a shuffled join: URLs by host suffix and path prefix, of the lengths that the rules have."""
    r = rules.na.drop().select("verdict", "rule", F.regexp_extract("rule", r"^[^/]*", 0).alias("rhost"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("rpath"))
    r = r.groupBy("rule", "rhost", "rpath").agg(F.max("verdict").alias("verdict"))
    lengths = r.groupBy("rhost").agg(F.collect_set(F.length("rpath")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    urls = materialize(split.withColumn("row", F.monotonically_increasing_id()), "urls")
    keys = urls.filter("host <> ''").select("row", "path", F.explode(suffixes).alias("rhost")).join(lengths, "rhost")
    keys = keys.select("row", "rhost", "path", F.explode("lengths").alias("n")).filter("n <= length(path)").select("row", "rhost", F.expr("substring(path, 1, n)").alias("rpath"))
    best = keys.join(r, ["rhost", "rpath"]).groupBy("row").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rhost"))).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(load(spark, sf_dir, "pages"), RULES)


OP7_SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT n, verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
        FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN (SELECT * FROM fit WHERE k = 1) f USING (n)
"""
