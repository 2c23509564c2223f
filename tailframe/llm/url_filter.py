"""URL verdicts from allow and block entries, by a broadcast trie with longest match."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path); what the query judges by.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A trie is broadcast up to so many rules (some 50 MB); more rules are joined on the host's suffixes.
TRIE_RULES = 200_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlTrie:
    """Edges are reversed host labels, then path segments; a rule hangs at the node it ends in.

    A rule's last path segment matches as a prefix of the url's, so that ``/en`` fits ``/english`` and ``/en/``
    only what has the slash. Nodes are [children, path root, path rules: segment prefix to rule number].
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {}
        for number, (_, host, path) in enumerate(rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {})
            ends.setdefault(last, number)
            node["sizes"] = sorted({*node.get("sizes", ()), len(last)}, reverse=True)

    def find(self, host: str, path: str) -> int:
        """Number of the rule with the longest host, then the longest path, among those that fit; -1 if none."""
        best, node = -1, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            at: dict | None = node
            for segment in segments:
                ends = at.get("ends")
                if ends:  # one look for each length of its rules, longest first
                    best = next((ends[segment[:n]] for n in at["sizes"] if len(segment) >= n and segment[:n] in ends), best)
                at = at.get(("p", segment))
                if at is None:
                    break
        return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def parts(pages: DataFrame, key: str, url: str) -> DataFrame:
    d = pages.select(pages[key].alias("k"), pages[url].alias("u"))
    return d.select("k", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", key: str = "page_id", url: str = "url", most: int = TRIE_RULES) -> DataFrame:
    """Gives every row the verdict of the longest rule that fits its url, else ``default``.

    A rule fits its host and all subdomains if the url's path starts with the rule's. The more specific
    host wins, then the longer path; of rules that repeat a host and path, the first. A null url, or one without
    ``://``, has an empty host and path, fits no rule and gets the default, as does a url without a path. Rows are judged one by
    one, so repeated rows get equal verdicts, nothing is shuffled and an empty table gives no rows. Other
    columns are ignored. Columns: key, host, path, rule, verdict.
    """
    d = parts(pages, key, url)
    if len(rules) > most:
        return by_join(d, rules, default).withColumnRenamed("k", key)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    names, verdicts = [f"{h}{p}" for _, h, p in rules], [v for v, _, _ in rules]

    @F.pandas_udf("rule string, verdict string")
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for host, path in batches:
            hit = [find(h, p) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame({"rule": [names[x] if x >= 0 else None for x in hit], "verdict": [verdicts[x] if x >= 0 else default for x in hit]})

    return d.withColumn("r", look("host", "path")).select(F.col("k").alias(key), "host", "path", "r.rule", "r.verdict")


def by_join(d: DataFrame, rules: Sequence[tuple[str, str, str]], default: str) -> DataFrame:
    """The same for rule sets too large to broadcast: hosts' suffixes (one for each label) meet the rules' hosts.

    Pages of one host suffix (``com``) are dealt to SALTS tasks, each with a copy of its rules.
    """
    spark = d.sparkSession
    table = spark.createDataFrame([(v, h, p, h.count(".") + 1, n) for n, (v, h, p) in enumerate(rules)], "v string, rh string, rp string, depth int, n int")
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = materialize(d.withColumn("_id", F.monotonically_increasing_id()), "urls")  # stored, so the numbers stay
    labels = F.split("host", r"\.")
    tails = d.withColumn("rh", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    tails = tails.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    met = tails.join(table, ["rh", "salt"]).where(F.col("path").startswith(F.col("rp")))
    best = met.groupBy("_id").agg(F.max(F.struct("depth", F.length("rp").alias("len"), (-F.col("n")).alias("n"), F.concat("rh", "rp").alias("rule"), "v")).alias("b"))
    return d.join(best, "_id", "left").select("k", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT p.page_id, host, path, rh || rp AS rule, verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh) DESC NULLS LAST, length(rp) DESC) AS n
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
