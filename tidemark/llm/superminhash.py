"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

1. One pass hashes each text's word shingles and signs the set. Each element deals its ranks over the signature by a random
   permutation of its own (one slot per step, rank step + fraction), so the ranks of a set are spread evenly; steps stop as
   soon as no later rank can win. BANDS x ROWS values: a pair at similarity 0.8 misses every band with probability 5e-8.
2. Equal sets fold into the class of their smallest doc_id; only class representatives go on.
3. Star round: a bucket's members are paired with its smallest member, the two leaders that share most bands are kept, pairs whose
   signatures agree too rarely drop out, the rest are verified on full sets and grouped.
4. Rest round: buckets that still hold several groups are compared whole, in blocks of about BLOCK rows against BLOCK rows, between
   members of different groups only and each pair in the first band it shares. Rows with a partner whose signature agrees often
   enough meet again in their blocks with their full sets; a task verifies the pairs, most alike first, joins groups by union-find
   and gives out the links that joined some. Pairs inside a group can't change it, so no link is lost, and no pair is written out.
Full sets are worked out again from the texts of the documents in some pair; they are never stored for all.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import staged, table
from tidemark.llm.components import components

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 4
SIGNATURE = BANDS * ROWS
LEADERS = 2
BLOCK = 2_048
BLOCK_ELEMENTS = 4_000_000  # set elements in a block, about
BROADCAST_IDS = 1_000_000
SLACK = 5.8  # standard errors below the threshold at which signatures still go to verification
WORDS_KEPT = 500_000  # word hashes kept by a task
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = WordHashes()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; fewer words are one run; no words, no element.

    Words are what stands between blanks (space, tab to carriage return), A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="uint64")
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype="uint64", count=len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for j in range(size):
        out = mix(out * STEP + h[j:len(h) - size + 1 + j])
    return np.unique(out)


def signature(elements: np.ndarray, m: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash ranks of a set: m doubles; equal slots of two sets are equal with probability their Jaccard similarity."""
    ranks = np.full(m, np.inf)
    n = len(elements)
    order = np.broadcast_to(np.arange(m, dtype="uint8" if m <= 256 else "int32"), (n, m)).copy()
    row = np.arange(n)
    for j in range(m):
        r = mix(elements + np.uint64((j + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r & np.uint64(0xFFFFFF)) % np.uint64(m - j)).astype("int64")
        slot = order[row, k]
        order[row, k] = order[:, j]
        np.minimum.at(ranks, slot, j + (r >> np.uint64(24)).astype("float64") / 2.0**40)
        if ranks.max() <= j + 1:
            break
    return ranks


def sign(texts: Iterator[pd.Series], size: int) -> Iterator[pd.DataFrame]:
    import xxhash

    salt = mix((np.arange(BANDS, dtype="uint64") + np.uint64(1)) * STEP)
    for batch in texts:
        out = []
        for text in batch:
            s = shingle_set(text, size)
            if not len(s):
                out.append((0, 0, 0, None, None))
                continue
            bits = mix(signature(s).view("uint64"))
            band = salt.copy()
            for j in range(ROWS):
                band = mix(band * STEP + bits.reshape(BANDS, ROWS)[:, j])
            d = xxhash.xxh3_128_digest(s.tobytes())
            h1, h2 = np.frombuffer(d, dtype="int64")
            out.append((len(s), int(h1), int(h2), band.view("int64"), (bits >> np.uint64(32)).astype("uint32").tobytes()))
        yield pd.DataFrame(out, columns=["n", "s1", "s2", "bands", "sig"])


def agreement(percent: int) -> int:
    """Equal signature slots below which a pair isn't verified."""
    p = percent / 100
    return max(1, int(SIGNATURE * (p - SLACK * (p * (1 - p) / SIGNATURE) ** 0.5)))


def in_reach(a: Column, b: Column, percent: int) -> Column:
    """Length bound: sets whose sizes differ more can't be that similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def by_block(batches: Iterator[pd.DataFrame], work) -> Iterator[pd.DataFrame]:
    """batches: rows sorted by (key, i, j). work gets the whole rows of some blocks and the places where blocks begin and end."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        ident = rows[["key", "i", "j"]].to_numpy()
        edge = np.flatnonzero((ident[1:] != ident[:-1]).any(axis=1)) + 1
        held = rows.iloc[edge[-1] if len(edge) else 0:]
        if len(edge):
            yield work(rows.iloc[: edge[-1]], [0, *edge])
    if held is not None and len(held):
        yield work(held, [0, len(held)])


def candidates(rows: pd.DataFrame, edges, least: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, ys, equal slots): row places within a block, of different groups and fit lengths, whose signatures agree often enough and
    that share no earlier band: each pair turns up in one bucket only."""
    sig = np.frombuffer(b"".join(rows["sig"]), dtype="uint32").reshape(len(rows), SIGNATURE)
    bands = np.stack(rows["bands"].to_numpy())
    group, n, band = rows["component"].to_numpy(), rows["n"].to_numpy(), rows["band"].to_numpy()
    left, right = rows["part"].to_numpy() == rows["i"].to_numpy(), rows["part"].to_numpy() == rows["j"].to_numpy()
    twice = rows["i"].to_numpy() == rows["j"].to_numpy()
    for a, b in zip(edges[:-1], edges[1:]):
        right_side = a + np.flatnonzero(right[a:b])
        for x in a + np.flatnonzero(left[a:b]):
            y = right_side[right_side > x] if twice[a] else right_side  # left and right are the same rows there
            y = y[(group[y] != group[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
            y = y[~(bands[y, : band[a]] == bands[x, : band[a]]).any(axis=1)] if band[a] else y
            same = (sig[y] == sig[x]).sum(axis=1)
            if (ok := same >= least).any():
                yield x, y[ok], same[ok]


def with_partners(rows: pd.DataFrame, edges, least: int, percent: int) -> pd.DataFrame:
    """The rows that some candidate pair of their block needs."""
    need = np.zeros(len(rows), dtype=bool)
    for x, y, _ in candidates(rows, edges, least, percent):
        need[x] = True
        need[y] = True
    return rows.loc[need, ["key", "i", "j", "rep"]]


def links_within(rows: pd.DataFrame, edges, least: int, percent: int) -> pd.DataFrame:
    """Verified links that join the groups of each block; pairs that earlier ones have joined already are passed over."""
    group, rep = rows["component"].to_numpy(), rows["rep"].to_numpy()
    sets = [np.frombuffer(s, dtype="uint64") for s in rows["set"]]
    pairs = [(-int(k), int(x), int(y)) for x, ys, same in candidates(rows, edges, least, percent) for y, k in zip(ys, same)]
    parent: dict[int, int] = {}

    def find(g: int) -> int:
        while (up := parent.get(g, g)) != g:
            parent[g] = parent.get(up, up)
            g = up
        return g

    out = []
    for _, x, y in sorted(pairs):
        p, q = find(int(group[x])), find(int(group[y]))
        if p == q:
            continue
        small, large = sorted((sets[x], sets[y]), key=len)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        inter = int((large[at] == small).sum())
        if inter * 100 >= (len(small) + len(large) - inter) * percent:
            parent[max(p, q)] = min(p, q)
            out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


class NearDuplicates:
    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK):
        self.docs, self.shingle, self.percent, self.block, self.spark = docs.select("doc_id", "text"), shingle, percent, block, docs.sparkSession
        shape = "n long, s1 long, s2 long, bands array<long>, sig binary"
        signed = _iterator_udf(shingle, shape)
        got = self.docs.select("doc_id", signed("text").alias("s")).select("doc_id", "s.*")
        self.signed = staged(got, "signed")
        real = self.signed.where("n > 0 and doc_id is not null")
        folded = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        self.classes = staged(folded, "classes")
        rows = self.classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
        full = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("lead"), F.min(F.struct("rep", "n"))["n"].alias("lead_n"))
        self.buckets = staged(rows.join(full.where("size > 1 and lead is not null"), "key"), "buckets")

    def sets(self, pairs: DataFrame, as_bytes: bool = False) -> DataFrame:
        """(rep, set) for every document in some pair, from its text. Few ids go out as a broadcast; many are shuffled."""
        ids = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
        small = ids.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
        size = self.shingle
        shown = (lambda x: x.tobytes()) if as_bytes else (lambda x: x.view("int64"))
        full = F.pandas_udf(lambda s: pd.Series([shown(shingle_set(t, size)) for t in s]), "binary" if as_bytes else "array<long>")
        return staged(texts.select(F.col("doc_id").alias("rep"), full("text").alias("set")), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        pairs = staged(pairs.distinct(), "pairs")
        sets = self.sets(pairs)
        both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
        inter = F.size(F.array_intersect("x", "y"))
        good = both.withColumn("inter", inter).where(F.col("inter") * 100 >= (F.size("x") + F.size("y") - F.col("inter")) * self.percent)
        return staged(good.select("a", "b"), "links")

    def star_pairs(self) -> DataFrame:
        near = self.buckets.where((F.col("rep") != F.col("lead")) & in_reach(F.col("n"), F.col("lead_n"), self.percent))
        shared = near.groupBy("rep", "lead").agg(F.count("*").alias("shared"))
        first = Window.partitionBy("rep").orderBy(F.desc("shared"), "lead")  # at most one row per band
        best = shared.withColumn("k", F.row_number().over(first)).where(F.col("k") <= LEADERS)
        sigs = self.classes.select("rep", F.col("sig").alias("sig"))
        both = best.join(sigs.withColumnRenamed("sig", "x"), "rep").join(sigs.select(F.col("rep").alias("lead"), F.col("sig").alias("y")), "lead")
        slots = F.aggregate(F.sequence(F.lit(0), F.lit(SIGNATURE - 1)), F.lit(0), lambda s, i: s + F.when(
            F.substring("x", i * 4 + 1, F.lit(4)) == F.substring("y", i * 4 + 1, F.lit(4)), 1).otherwise(0))
        return both.where(slots >= agreement(self.percent)).select(F.col("lead").alias("a"), F.col("rep").alias("b"))

    def rest_links(self, group: DataFrame) -> DataFrame:
        """Verified links between groups, from the buckets that still hold several."""
        rows = self.buckets.select("key", "band", "rep", "n").join(group, F.col("rep") == F.col("node"), "left")
        rows = rows.select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("component"))
        mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.min("band").alias("band"), F.sum("n").alias("elements"),
                                        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit(2), "rep")).alias("mixed")).where("low < high")
        # of buckets with the same members the one of the first band is compared
        once = mixed.groupBy("size", "total", "mixed").agg(F.min(F.struct("band", "key"))["key"].alias("key"), F.max("elements").alias("elements"))
        parts = F.greatest(F.ceil(F.col("size") / self.block), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
        once = once.select("key", parts.alias("parts"))
        dealt = rows.join(once, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        # block pair (i, j), i <= j, gets the rows of parts i and j
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")
        dealt = staged(dealt, "blocks")
        least, percent, order = agreement(self.percent), self.percent, ["key", "i", "j"]
        signs = self.classes.select("rep", "sig", "bands")
        full = dealt.join(signs, "rep").repartition(*order).sortWithinPartitions(*order)
        need = full.mapInPandas(lambda b: by_block(b, lambda r, e: with_partners(r, e, least, percent)), "key long, i int, j int, rep long")
        need = staged(need, "needed")
        sets = self.sets(need.select(F.col("rep").alias("a"), F.col("rep").alias("b")), as_bytes=True)
        full = dealt.join(need, [*order, "rep"]).join(signs, "rep").join(sets, "rep").repartition(*order).sortWithinPartitions(*order)
        return staged(full.mapInPandas(lambda b: by_block(b, lambda r, e: links_within(r, e, least, percent)), "a long, b long"), "links")

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept: one row per row of docs."""
        links = self.verified(self.star_pairs())
        group = staged(components(links), "group")
        group = staged(components(links.union(self.rest_links(group))), "group")
        known = self.classes.select("s1", "s2", "rep").join(group, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
        real = self.signed.where("n > 0 and doc_id is not null").join(known, ["s1", "s2"]).select("doc_id", "n", "component_id")
        # rows that share a doc_id are one node
        out = real.union(self.signed.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _iterator_udf(shingle: int, shape: str):
    @F.pandas_udf(shape)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from sign(batches, shingle)

    return signed


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text); further columns are not read.

    Documents link when percent of the union of their shingle sets is shared; component_id is the smallest doc_id reachable,
    and that document is kept. Null, empty and blank texts have no shingles and stay alone, as do rows without a doc_id
    (component_id null, kept). Rows that share a doc_id are one node. Shingles are told apart by 64-bit hashes. Empty tables
    give an empty one.
    """
    return NearDuplicates(docs, shingle, percent, block).groups()


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM w, generate_series(1, greatest(1, len(w) - 3)) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id)
      JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
