"""Repeated passages by sparse suffix arrays.

Words stand between blanks, A-Z lower-cased. Of all suffixes only those at minimisers are kept: positions whose GRAM-word hash is
the smallest of some WINDOW neighbouring ones (the first of equals). Each window of `length` words belongs to the minimiser of its
first WINDOW grams, at most WINDOW - 1 words in, so all copies of a window belong to suffixes that agree on length - WINDOW + 1
words: the run key. The windows of one suffix start at neighbouring words; the text from the first one's start to the last one's
end is its block.
1. Suffixes are brought together by run key; runs within one document go. If all blocks of a run are equal, each of its documents
   holds all windows of the block, and the run's documents are their holders.
2. The windows of the other runs are hashed one by one and brought together by that hash.
3. The windows found in two documents, overlapping and touching ones joined, are the repeated passages; inside them, neighbouring
   windows with the same smallest holder are a stretch.
Every window meets all its copies, whatever else its documents share. A run is never gathered: its rows only meet one row with its
first and last document.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import join_counted, staged, table
from tidemark.llm.superminhash import _WORDS, STEP, mix

LENGTH = 50
GRAM = 5
WINDOW = 16
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BACK = pow(BASE, -1, 2**64)


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), dtype="uint64", count=len(words))


def span_hashes(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the words from starts up to stops, excluded."""
    up, down = (np.concatenate([np.ones(1, dtype="uint64"), np.cumprod(np.full(len(h), np.uint64(b)))]) for b in (BASE, BACK))
    sums = np.concatenate([np.zeros(1, dtype="uint64"), np.cumsum(mix(h * STEP) * up[:-1])])
    return mix((sums[stops] - sums[starts]) * down[starts])


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words."""
    starts = np.arange(max(0, len(h) - size + 1))
    return span_hashes(h, starts, starts + size)


def owners(h: np.ndarray, length: int, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, lo, hi): the windows of `length` words starting at lo..hi belong to the minimiser, the first smallest of their
    first `window` gram hashes. Each window start of the text is in one row."""
    n = len(h) - length + 1
    if n < 1:
        return (np.empty(0, dtype="int64"),) * 3
    view = np.lib.stride_tricks.sliding_window_view(run_hashes(h, gram), window)[:n]
    at = np.arange(n) + view.argmin(axis=1)
    lo = np.flatnonzero(np.diff(at, prepend=-1))
    return at[lo], lo, np.append(lo[1:], n) - 1


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, lo, hi, key, block): the retained suffixes by the windows that belong to them, with the hashes of their run key and block."""
    run = length - WINDOW + 1

    @F.pandas_udf("lo array<int>, hi array<int>, key array<long>, block array<long>")
    def retained(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = word_hashes(t)
            at, lo, hi = owners(h, length)
            key, block = span_hashes(h, at, at + run), span_hashes(h, lo, hi + length)
            out.append((lo.astype("int32"), hi.astype("int32"), key.view("int64"), block.view("int64")))
        return pd.DataFrame(out, columns=["lo", "hi", "key", "block"])

    got = docs.select("doc_id", retained("text").alias("s"))
    rows = got.select("doc_id", F.explode_outer(F.arrays_zip("s.lo", "s.hi", "s.key", "s.block")).alias("s"))
    return rows.select("doc_id", "s.lo", "s.hi", "s.key", "s.block").where("lo is not null and doc_id is not null")


def windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc_id, lo, wide): the windows starting in the ranges of wanted(doc_id, lo, hi), with their hashes."""

    @F.pandas_udf("lo array<int>, wide array<long>")
    def hashed(texts: pd.Series, los: pd.Series, his: pd.Series) -> pd.DataFrame:
        out = []
        for t, lo, hi in zip(texts, los, his):
            h = word_hashes(t)
            n = max(0, len(h) - length + 1)
            edges = np.zeros(n + 1, dtype="int64")
            np.add.at(edges, np.minimum(lo, n), 1)
            np.add.at(edges, np.minimum(np.asarray(hi) + 1, n), -1)
            at = np.flatnonzero(np.cumsum(edges[:n]) > 0)
            out.append((at.astype("int32"), span_hashes(h, at, at + length).view("int64")))
        return pd.DataFrame(out, columns=["lo", "wide"])

    lists = wanted.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct("lo", "hi")).alias("at"))
    rows = docs.join(lists, F.col("doc_id") == F.col("_d")).select("doc_id", hashed("text", F.col("at.lo"), F.col("at.hi")).alias("s"))
    return rows.select("doc_id", F.explode(F.arrays_zip("s.lo", "s.wide")).alias("s")).select("doc_id", "s.lo", "s.wide")


def held(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, lo, hi, low, high): the windows starting at lo..hi, of which low and high are the first and the last holder, two documents."""
    def holders(rows: DataFrame, key: str, *more) -> DataFrame:
        ends = rows.groupBy(key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), *more)
        return staged(ends.where(F.col("low") < F.col("high")), "runs")

    found = staged(suffixes(docs, length), "suffixes")
    runs = holders(found, "key", (F.min("block") == F.max("block")).alias("same"))
    met = staged(join_counted(found, runs, ["key"], "n").select("doc_id", "lo", "hi", "low", "high", "same"), "met")
    single = staged(windows(docs, met.where("not same").select("doc_id", "lo", "hi"), length), "windows")
    ones = join_counted(single, holders(single, "wide"), ["wide"], "n")
    return met.where("same").select("doc_id", "lo", "hi", "low", "high").union(ones.select("doc_id", "lo", F.col("lo").alias("hi"), "low", "high"))


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, stop, n_words, other_id, first, stretches): one row per repeated passage and document, in word places, stop excluded.

    A passage is a stretch of words of which each lies in a window of `length` words that also stands in another document;
    overlapping and touching ones of a document are one row. Every such window is found. A passage can be made of parts with
    different holders, so `stretches`, (start, stop, other_id, first) in order, cuts it without gap or overlap where the smallest
    holder changes. `first` says that no smaller document holds the stretch, so that the others may drop theirs; words in
    windows of both kinds are in the first stretch, so one whole copy of every window is left. other_id is the stretch's smallest
    holder, or for that document itself the last holder of a window (the smallest of them). The row is `first` if a stretch is,
    with other_id the smallest of those stretches, else of all. Windows are told apart by 64-bit hashes. Null, empty and short
    texts give no row, nor do repeats inside one document alone. Rows that share a doc_id count as one document, rows without
    one are left out. Empty tables give an empty one; further columns are not read.
    """
    if length < WINDOW + GRAM:
        raise ValueError(f"length must be at least {WINDOW + GRAM} words")
    rows = held(docs.select("doc_id", "text"), length).select("doc_id", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"), "low", "high")
    by = Window.partitionBy("doc_id").orderBy("start", "stop", "low", "high")
    past, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("start") > F.max("stop").over(past), F.lit(True))
    rows = rows.withColumn("apart", apart.cast("int")).withColumn("cut", (apart | (F.col("low") != F.lag("low").over(by))).cast("int"))
    rows = rows.withColumn("span", F.sum("apart").over(upto)).withColumn("part", F.sum("cut").over(upto))
    parts = rows.groupBy("doc_id", "span", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("low").alias("low"), F.min("high").alias("high"))
    parts = parts.withColumn("first", F.col("low") == F.col("doc_id")).withColumn("other_id", F.when(F.col("first"), F.col("high")).otherwise(F.col("low")))
    along = Window.partitionBy("doc_id", "span").orderBy("part")
    kept = F.max(F.when(F.col("first"), F.col("stop"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    start, stop = F.greatest("start", kept), F.when(F.col("first"), F.col("stop")).otherwise(F.least("stop", F.lead("start").over(along)))
    parts = parts.select("doc_id", "span", "start", "stop", "other_id", "first", F.struct(start.alias("start"), stop.alias("stop"), "other_id", "first").alias("s"))
    own = F.min(F.when(F.col("first"), F.col("other_id")))
    out = parts.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.coalesce(own, F.min("other_id")).alias("other_id"),
                                              F.max("first").alias("first"), F.array_sort(F.collect_list(F.when(F.col("s.start") < F.col("s.stop"), F.col("s")))).alias("stretches"))
    return out.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "other_id", "first", "stretches")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
