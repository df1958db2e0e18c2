"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of WINDOW consecutive words (an item of fewer words is one window). A document holds a window
only if it holds all of its shingles, so with full containment the prefix of a window shrinks to one shingle: its rarest.
1. Count, over the whole corpus, the documents' occurrences of the benchmark's shingles.
2. Order each window's shingles by (count, hash) and keep the first as the window's anchor, with its offset.
3. Join the documents' shingles with the anchors. The anchor's offset fixes where the window would start (positional bound)
   and the start with the window's length must lie inside the document (length bound).
4. Compare the words at that place with the window's words, exactly.
Documents are never shuffled: the anchors go out as broadcasts in blocks of at most BLOCK_ROWS rows, counted before, one
pass over the documents for each block. Built-in functions only.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, staged, table

WINDOW = 10
SHINGLE = 4
BLOCK_ROWS = 200_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between lower-cased words


def words_of(text: Column) -> Column:
    """Words of the A-Z lower-cased text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of all runs of `size` words, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    run = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(F.size(words) >= size, run).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows: wid (their words joined by a space), n words, list of items holding them. Items without words have none."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("n", F.least(F.lit(window), F.size("words")))
    at = w.select("item_id", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    return at.select("item_id", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("wid")).distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(wid, n, size, off, h): the shingles of each distinct window; a window shorter than a shingle is one of its own size."""
    w = windows.select("wid", "n").distinct().withColumn("words", F.split("wid", " "))
    parts = []
    for size in range(1, shingle + 1):
        own = w.where(F.least("n", F.lit(shingle)) == size)
        parts.append(own.select("wid", "n", F.lit(size).alias("size"), F.posexplode(shingle_hashes("words", size)).alias("off", "h")))
    return reduce(DataFrame.union, parts)


def in_blocks(df: DataFrame, key: str, rows: int):
    """Pieces of df with about `rows` rows each, cut by the hash of key, to be broadcast one at a time."""
    n = df.count()
    blocks = -(-n // rows)
    for b in range(blocks):
        yield df if blocks == 1 else df.where(F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)) == b)


def positions(docs: DataFrame, size: int) -> DataFrame:
    """One row per shingle place of a document; `words` stays a reference to the document's array.

    The outer form keeps Spark from inferring a filter that would repeat the word splitting; its null rows join nothing.
    """
    w = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("hs", shingle_hashes("words", size))
    return w.select("doc_id", "words", F.posexplode_outer("hs").alias("pos", "h"))


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, item_id, start, end) of every occurrence of an item's window in a document; word places, end excluded."""
    spark = docs.sparkSession
    windows = staged(item_windows(items, window), "windows")
    shingles = staged(window_shingles(windows, shingle), "shingles")
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # at most `shingle` values
    counts = [spark.createDataFrame([], "size int, h long, freq long")]
    for size in sizes:
        own = shingles.where(F.col("size") == size).select("h").distinct()
        for block in in_blocks(own, "h", block_rows):
            hits = positions(docs, size).select("h").join(F.broadcast(block), "h")
            counts.append(hits.groupBy("h").agg(F.count("*").alias("freq")).select(F.lit(size).alias("size"), "h", "freq"))
    freq = reduce(DataFrame.union, counts)
    # a shingle that no document holds rules its windows out
    ranked = shingles.join(freq, ["size", "h"], "left").groupBy("wid", "n", "size").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "h", "off")).alias("a"))
    anchors = staged(ranked.where(F.col("a.freq") > 0).select("wid", "n", "size", F.col("a.h").alias("h"), F.col("a.off").alias("off")), "anchors")
    found = [spark.createDataFrame([], "doc_id long, start int, wid string, n int")]
    for size in sizes:
        for block in in_blocks(anchors.where(F.col("size") == size).drop("size"), "wid", block_rows):
            at = positions(docs, size).join(F.broadcast(block), "h").withColumn("start", F.col("pos") - F.col("off"))
            at = at.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("words")))
            same = at.where(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ") == F.col("wid"))
            found.append(same.select("doc_id", "start", "wid", "n"))
    hits = reduce(DataFrame.union, found)
    return hits.join(windows.select("wid", "item_id"), "wid").select("doc_id", "item_id", "start", (F.col("start") + F.col("n")).alias("end"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per doc_id: n_words, n_hit, items (sorted ids as strings), n_items, contaminated.

    Null or empty texts have no words and no hits; items without words have no windows. Rows sharing a doc_id (null included)
    give one row: the longest text's words, hits of all of them. Only doc_id and text of docs, item_id and text of items are read.
    """
    size = F.size(words_of(F.col("text")))
    hits = find_windows(docs, items, window, shingle, block_rows)
    rows = docs.select("doc_id", size.cast("long").alias("n_words"), F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.lit(None).cast("string").alias("item"))
    rows = rows.union(hits.select("doc_id", F.lit(0).cast("long"), F.struct(F.col("start").cast("int"), F.col("end").cast("int")), F.col("item_id").cast("string")))
    per = rows.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")))
    return per.select("doc_id", "n_words", covered["n"].cast("long").alias("n_hit"), "items", F.size("items").cast("long").alias("n_items"),
                      (F.size("items") > 0).alias("contaminated"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bn, generate_series(1, len(w) - n + 1) AS g(i)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM dw, sizes, generate_series(1, len(w)) AS g(i) WHERE i + n - 1 <= len(w)),
hit AS (SELECT o.doc_id, o.i, o.n, x.item_id FROM occ o JOIN win x ON o.win = x.win AND o.n = x.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos p USING (doc_id) LEFT JOIN its i USING (doc_id)
"""
