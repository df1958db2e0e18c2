"""Runs of repeating words, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period q and at least TIMES * q words that no neighbouring word extends.
1. Periods up to SMALL are read off directly: stretches where words q apart agree.
2. For a scale t (a power of two) position i gets the hash of its t words, positions inside a highly periodic region (period t/3 at
   most, known from step 1 or a smaller scale) none. i is selected if the least hash of i..i+t stands at i or i+t. Whether i is
   selected hangs on its 2t words only, so equal contexts are selected alike; any t positions in a row hold a selected one unless
   their words are highly periodic.
3. In a run of period q >= 3t/2 at least t positions have their 2t words again q words later, inside the run. One of them is
   selected (were they all highly periodic, so would be 2q words of the run, and q wasn't its smallest period), and so is its
   partner. Scale t thus proposes all q in 3t/2 .. 3t-1 from pairs of selected positions with equal contexts. Equal contexts
   lie more than t/3 apart, so a position has fewer than nine partners within 3t.
4. A proposed pair is extended to both sides by comparing the words themselves, so hashes never decide.
A stretch found under several periods has the smallest; by length, every smaller period of it is found, too.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

TIMES = 3
MIN_WORDS = 24
SMALL = 8
AT_ONCE = 200_000  # words of short texts handled together
WORD = r"[^\x20\x09-\x0D]+"
NONE = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def joined(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of 2t words from those of t words."""
    return mixed(h[:-t] * np.uint64(0xD6E8FEB86659FD93) + h[t:])


def stretches(s: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every stretch of period q with at least TIMES * q words."""
    same = np.flatnonzero(s[q:] == s[:-q])
    if not len(same):
        return same, same
    cut = np.flatnonzero(np.diff(same) > 1)
    begin, end = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]] + 1 + q
    long = end - begin >= TIMES * q
    return begin[long], end[long]


def extent(s: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest stretch around i in which words q apart agree; (i, i + q) if those at i don't."""
    high, step, limit = i, 64, len(s) - q
    while high < limit:
        stop = min(limit, high + step)
        differ = s[high:stop] != s[high + q:stop + q]
        k = int(differ.argmax())
        if differ[k]:
            high += k
            break
        high, step = stop, step * 2
    if high == i:
        return i, i + q
    low, step = i, 64
    while low > 0:
        stop = max(0, low - step)
        differ = (s[stop:low] != s[stop + q:low + q])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            low -= k
            break
        low, step = stop, step * 2
    return low, high + q


def selected(h: np.ndarray, t: int, regions: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The synchronising set of scale t over hashes of t words; regions are stretches of period t/3 at most."""
    ids, n = h >> np.uint64(1), len(h)
    begin = np.concatenate([b for b, _ in regions] or [np.zeros(0, np.int64)])
    stop = np.concatenate([e for _, e in regions] or [np.zeros(0, np.int64)]) - t + 1
    fits = (stop > begin) & (begin < n)
    if fits.any():
        edges = np.zeros(n + 1, np.int32)
        np.add.at(edges, begin[fits], 1)
        np.add.at(edges, np.minimum(stop[fits], n), -1)
        ids[np.cumsum(edges[:-1]) > 0] = NONE
    least, width = ids, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    return np.flatnonzero((least != NONE) & ((least == ids[:len(least)]) | (least == ids[t:])))


def periodic_stretches(s: np.ndarray, lengths: list[int]) -> dict[tuple[int, int], int]:
    """(begin, end) -> smallest period of all runs with TIMES * period words in s: texts from the longest to the shortest, each
    followed by an id that stands nowhere else."""
    found: dict[tuple[int, int], int] = {}
    known: list[tuple[int, np.ndarray, np.ndarray]] = []
    for q in range(1, SMALL + 1):
        if len(s) > q:
            begin, end = stretches(s, q)
            if len(begin):
                known.append((q, begin, end))
                for pair in zip(begin.tolist(), end.tolist()):
                    found.setdefault(pair, q)
    h, t, active = mixed(s.astype(np.uint64) + np.uint64(1)), 1, len(lengths)
    ends = np.cumsum([n + 1 for n in lengths])
    while active:
        low, high = max(3 * t // 2, SMALL + 1), 3 * t
        while active and lengths[active - 1] < TIMES * low:
            active -= 1
        if not active or ends[active - 1] <= 2 * t:
            break
        h = h[:max(0, ends[active - 1] - t + 1)]
        contexts = joined(h, t)
        if high > low:
            at = selected(h, t, [(b, e) for q, b, e in known if 3 * q <= t])
            context = contexts[at]
            order = np.argsort(context, kind="stable")
            context, at = context[order], at[order]
            pairs = []
            for k in count(1):
                apart = at[k:] - at[:-k]
                near = (context[k:] == context[:-k]) & (apart < high)
                if not near.any():
                    break
                near &= apart >= low
                pairs.append((apart[near], at[:-k][near]))
            if pairs:
                period, begin = (np.concatenate(x) for x in zip(*pairs))
                order, new, last, upto = np.lexsort((begin, period)), [], 0, 0
                for q, i in zip(period[order].tolist(), begin[order].tolist()):
                    if q == last and i < upto:
                        continue
                    a, b = extent(s, i, q)
                    last, upto = q, b - q
                    if b - a >= TIMES * q and found.setdefault((a, b), q) == q:
                        new.append((q, a, b))
                known.extend((q, np.array([a]), np.array([b])) for q, a, b in new)
        h, t = contexts, 2 * t
    return found


def split_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def word_ids(words: list[list[bytes]]) -> np.ndarray:
    """The texts' words as numbers, equal for equal words; each text is followed by a number of its own."""
    seen: dict[bytes, int] = {}
    out, number = np.empty(sum(map(len, words)) + len(words), np.int64), count()
    at = 0
    for k, own in enumerate(words):
        out[at:at + len(own)] = np.fromiter(map(seen.setdefault, own, number), np.int64, len(own))
        at += len(own) + 1
        out[at - 1] = -2 - k
    return out


def runs_of(words: list[list[bytes]], min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period) with min_words words or more, by start and period."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    lengths = [len(words[k]) for k in order]
    ends = np.cumsum([n + 1 for n in lengths])
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for (a, b), q in periodic_stretches(word_ids([words[k] for k in order]), lengths).items():
        if b - a >= min_words:
            k = int(np.searchsorted(ends, a, "right"))
            out[order[k]].append((a - int(ends[k]) + lengths[k] + 1, b - a, q))
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words but those that a run holds after its first period, joined by a space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words).decode()


def gathered(texts: list, at_once: int) -> Iterator[list[list[bytes]]]:
    """Split texts in order, as many at a time as hold at_once words, a longer one alone."""
    group, size = [], 0
    for text in texts:
        words = split_words(text)
        if group and size + len(words) > at_once:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, at_once: int = AT_ONCE) -> DataFrame:
    """docs with runs array<struct<start, length, period>> by start and period, and collapsed, the text without repetitions.

    Null, empty and blank texts have no runs and collapse to ''. Repeated rows are read each; columns of docs named runs or
    collapsed are replaced, others pass through; an empty table gives an empty one. No shuffle: a task holds one Arrow batch, the
    split words of at_once words or of one longer text, and about 60 bytes a word of hashes.
    """
    @F.pandas_udf("starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for words in gathered(texts.tolist(), at_once):
                for own, runs in zip(words, runs_of(words, min_words)):
                    rows.append((*([r[k] for r in runs] for k in range(3)), collapsed(own, runs)))
            yield pd.DataFrame(rows, columns=["starts", "lengths", "periods", "collapsed"])

    rest = docs.drop("runs", "collapsed")
    out = rest.withColumn("_found", found("text"))
    runs = F.arrays_zip(F.col("_found.starts").alias("start"), F.col("_found.lengths").alias("length"), F.col("_found.periods").alias("period"))
    return out.select(*[F.col(f"`{c}`") for c in rest.columns], runs.cast("array<struct<start:long,length:long,period:long>>").alias("runs"), F.col("_found.collapsed").alias("collapsed"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text of each document whose id's checksum is divisible by ten repeats its words from a place on."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    div = lambda x, y: F.call_function("div", x, y)
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n, g = F.nullif(F.size("words").cast("long"), F.lit(0).cast("long")), div(F.col("h"), F.lit(10).cast("long"))
    placed = chosen.withColumn("n", F.when(F.col("words").isNotNull(), n)).withColumn("a", g % F.col("n"))
    placed = placed.withColumn("p", 1 + div(F.col("n") - F.col("a"), 3 + g % 8))
    rest = (F.col("n") - F.col("a")).cast("int")
    block = F.slice("words", (F.col("a") + 1).cast("int"), F.least(F.col("p").cast("int"), rest))
    times = div(F.col("n") - F.col("a") + F.col("p") - 1, F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """The query's columns from runs and collapsed."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs come by start and period, so the first of equals stays
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | better(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = rows.select("doc_id", "runs", "collapsed", best.alias("best"), F.array_join(lines, "").alias("lines"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        sha(F.col("lines")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def sha(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(periodic_runs(with_repeats(docs)))
