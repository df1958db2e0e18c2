"""URL filters as a sort-merge range join.

A host's labels are written in reverse, each closed by a dot: `www.example.org` becomes `org.example.www.`. A rule's host then
covers the interval of keys that begin with its own key, and intervals are nested or apart. Pages are sorted by key inside
their partitions; one sweep walks pages and rules together and keeps the stack of rule hosts whose interval is open. The
deepest host with a path that begins the page's path wins, and among its paths the longest.
No page is shuffled. Rules reach the tasks in blocks of at most BLOCK_ROWS hosts, counted before; more rules mean more sweeps
over the same sorted rows, each keeping the better of the old and the new rule.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, table

BLOCK_ROWS = 100_000
DEFAULT = "allow"  # where no rule fits
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(batches: Iterator[pd.DataFrame], nodes: list[tuple[str, dict[str, tuple[str, str]]]]) -> Iterator[pd.DataFrame]:
    """batches: pages sorted by key. nodes: rule hosts sorted by key, each with its paths' (rule, verdict)."""
    sized = [(key, sorted({len(p) for p in paths}, reverse=True), paths) for key, paths in nodes]
    stack: list[tuple] = []
    following = 0
    for pages in batches:
        rule, verdict, depth = pages["rule"].tolist(), pages["verdict"].tolist(), pages["depth"].tolist()
        for i, (key, path) in enumerate(zip(pages["key"], pages["path"])):
            while following < len(sized) and sized[following][0] <= key:
                while stack and not sized[following][0].startswith(stack[-1][0]):
                    stack.pop()
                stack.append(sized[following])
                following += 1
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            for node, lengths, paths in reversed(stack):
                if hit := next((paths[path[:n]] for n in lengths if path[:n] in paths), None):
                    size = (len(node) << 32) + len(hit[0])
                    if size > depth[i]:
                        (rule[i], verdict[i]), depth[i] = hit, size
                    break
        yield pages.assign(rule=rule, verdict=verdict, depth=depth)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url); rules(host, path, verdict).

    Null urls and urls without `://`: empty host and path, no rule, the default. Rules with a null are left out; of equal rules
    the smallest verdict holds. Empty tables work; further columns of both are not read. Repeated pages are judged each.
    """
    part = lambda k: F.coalesce(F.regexp_extract("url", PARTS, k), F.lit(""))
    rows = pages.select("page_id", ascii_lower(part(1)).alias("host"), part(2).alias("path")).withColumn("key", host_key(F.col("host")))
    rows = rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).cast("long").alias("depth"))
    rows = rows.sortWithinPartitions("key")
    own = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = own.withColumn("key", host_key(F.col("host")))
    blocks = max(1, -(-own.count() // block_rows))
    for b in range(blocks):
        nodes = defaultdict(dict)
        for r in own.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == b).collect():
            nodes[r.key][r.path] = (r.host + r.path, r.verdict)
        ordered = sorted(nodes.items())
        rows = rows.mapInPandas(lambda batches, ordered=ordered: sweep(batches, ordered), rows.schema)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
