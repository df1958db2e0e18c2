"""Prefix trie of rebuilt conversations by composable fingerprints.

A sequence of turns has the fingerprint (n, sum of e(i) * M^i mod P), e(i) the i-th turn's hash. Fingerprints form a monoid: the second
part's sum is shifted by M^n of the first. So the fingerprint of any prefix of a rebuilt conversation (a head of its base, then a
suffix of its own turns) follows from running sums over the stored turns: base head + (own up to j - own up to h) * M^(k - h). No
rebuilt text is ever made. Two prime moduli give 61 bits. Then
1. prefixes with equal depth and fingerprint are one node;
2. equality is verified on the stored turns: all own turns of a node must have the same role and text and hang on the same
   parent, which proves the sequences equal from the root down (a base's head is the base's own path). Else another
   M is taken;
3. every node is represented by its smallest conversation; what a node adds to its ancestors (a leaf, saved bytes) is put on that
   conversation's path, summed from the deep end up, and added up over the members of each node.
Conversations are cut into chunks of turns throughout, so a very long one is no task's own.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import staged, table
from tidemark.operators.ordered import CHUNK, running

HEAD = 9  # a conversation takes crc32(id) % HEAD turns of its base
FAMILY = 5  # conversations c - c % FAMILY .. share a base
WIDTH = 256  # turn numbers and depths in a chunk
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 69_069_069)
SEEDS = 4
MEMBERS = 65_536  # ids of a chunk of members
EARLIEST = -(2**60)  # chunk of turns without a number
KEY = ["depth", "f1", "f2"]


def power(base: int, n: Column, p: int, bits: int = 31) -> Column:
    """base ** n mod p."""
    out = F.lit(1).cast("long")
    for b in range(bits):
        out = out * F.when(F.shiftright(n, b).bitwiseAND(1) == 1, F.lit(pow(base, 2**b, p)).cast("long")).otherwise(F.lit(1).cast("long")) % p
    return out


def ordered_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """conv_id, idx (from 1), role, text, f1, f2: running fingerprint sums of each conversation's own turns, not yet reduced."""
    t = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn(CHUNK, F.coalesce(F.floor(F.col("turn") / WIDTH), F.lit(EARLIEST)))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]  # rows equal in all of these are interchangeable
    here = t.withColumn("_pos", F.row_number().over(Window.partitionBy("conv_id", CHUNK).orderBy(*order)))
    counts = here.groupBy("conv_id", CHUNK).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("conv_id", CHUNK, F.coalesce(before, F.lit(0)).alias("_before"))
    t = here.join(counts, ["conv_id", CHUNK]).withColumn("idx", F.col("_pos") + F.col("_before"))
    for k, (p, m) in enumerate(zip(PRIMES, BASES), 1):
        e = F.pmod(F.xxhash64(F.lit(seed * 2 + k), "role", "text"), F.lit(p - 1)) + 1
        t = t.withColumn(f"t{k}", e * power(pow(m, 2 * seed + 1, p), F.col("idx"), p) % p)
    out = running(t, ["conv_id"], ["idx"], {"f1": F.col("t1"), "f2": F.col("t2")})
    return out.select("conv_id", "idx", "role", "text", F.col("t1"), F.col("t2"), "f1", "f2", F.octet_length("text").cast("long").alias("bytes"))


def heads_of(turns: DataFrame) -> DataFrame:
    """Per conversation: n, and its first HEAD - 1 turns' sums and bytes (at most that many)."""
    first = F.when(F.col("idx") < HEAD, F.struct("idx", *[(F.col(f"f{k}") % p).alias(f"f{k}") for k, p in enumerate(PRIMES, 1)], "bytes"))
    return turns.groupBy("conv_id").agg(F.max("idx").alias("n"), F.array_sort(F.collect_list(first)).alias("head"))


def rebuilt(turns: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(paths, own): paths has a row per prefix of every rebuilt conversation: conv_id, depth, f1, f2, parent's p1, p2, bytes of the
    last turn, last (whether the conversation ends there). own are those of them that end in one of the conversation's own turns, with role and text."""
    heads = staged(heads_of(turns.select("conv_id", "idx", "f1", "f2", "bytes")), "heads")
    # a base is rebuilt as it is; all its turns count as own ones, so each turn is own to some path
    h = F.when(F.col("conv_id") % FAMILY == 0, 0).otherwise(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEAD)
    c = heads.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    c = c.join(heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head")), "base", "left")
    c = c.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)).cast("long")))
    at = lambda head, i, k: F.coalesce(F.get(head, (i - 1).cast("int"))[f"f{k}"], F.lit(0).cast("long"))
    c = c.select("conv_id", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("depths"), F.slice("base_head", F.lit(1), F.col("k").cast("int")).alias("base_head"),
                 *[at(F.col("base_head"), F.col("k"), k).alias(f"b{k}") for k in (1, 2)],
                 *[F.when(F.col("n") > F.col("h"), at(F.col("head"), F.col("h"), k)).alias(f"o{k}") for k in (1, 2)])
    c = staged(c, "rebuilt")
    root = c.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(x) for x in ("f1", "f2")],
                    *[F.lit(None).cast("long").alias(x) for x in ("p1", "p2")], F.lit(0).cast("long").alias("bytes"), (F.col("depths") == 0).alias("last"))
    # the base's own turns stand in the base's own path, so they are read and verified there
    lead = c.where(F.col("k") > 0).select("conv_id", "depths", F.posexplode("base_head").alias("i", "x"), "base_head")
    lead = lead.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("x.f1").alias("f1"), F.col("x.f2").alias("f2"),
                       *[at(F.col("base_head"), F.col("i"), k).alias(f"p{k}") for k in (1, 2)], F.col("x.bytes").alias("bytes"), (F.col("i") + 1 == F.col("depths")).alias("last"))
    own = turns.join(c.drop("base_head"), "conv_id").where(F.col("idx") > F.col("h"))
    depth = F.col("k") + F.col("idx") - F.col("h")
    shifted = {}
    for k, (p, m) in enumerate(zip(PRIMES, BASES), 1):
        back = pow(pow(m, 2 * seed + 1, p), -1, p)
        factor = F.element_at(F.array(*[F.lit(pow(back, d, p)).cast("long") for d in range(HEAD)]), (F.col("h") - F.col("k") + 1).cast("int"))
        upto, prior = F.col(f"f{k}") % p, (F.col(f"f{k}") - F.col(f"t{k}")) % p
        shifted[f"g{k}"] = (F.col(f"b{k}") + F.pmod(upto - F.col(f"o{k}"), F.lit(p).cast("long")) * factor) % p
        shifted[f"p{k}"] = (F.col(f"b{k}") + F.pmod(prior - F.col(f"o{k}"), F.lit(p).cast("long")) * factor) % p
    own = own.select("conv_id", depth.alias("depth"), shifted["g1"].alias("f1"), shifted["g2"].alias("f2"), shifted["p1"].alias("p1"), shifted["p2"].alias("p2"),
                     "bytes", (depth == F.col("depths")).alias("last"), "role", "text")
    return root.union(lead).union(own.drop("role", "text")), own


def unequal(own: DataFrame) -> bool:
    """Whether some node holds two different turns or hangs on two parents."""
    turn, parent = F.struct("role", "text"), F.struct("p1", "p2")
    nodes = own.groupBy(*KEY).agg(F.min(turn).alias("a"), F.max(turn).alias("b"), F.min(parent).alias("c"), F.max(parent).alias("d"))
    return not nodes.where((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).isEmpty()


def joined_ids(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's member ids; a node's chunks come one after the other, and only the running hash is kept."""
    names = [*KEY, "ends_sha256"]
    key, state = None, None
    for batch in chunks:
        done = []
        columns = batch.to_pydict()
        for *now, ids in zip(*(columns[c] for c in [*KEY, "ids"])):
            if now != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=names)


def ends(paths: DataFrame) -> DataFrame:
    """KEY, ends_sha256 for every node where some conversation ends; ids are joined in chunks of MEMBERS ids before they meet."""
    part = F.floor(F.col("conv_id") / MEMBERS)
    chunks = paths.where("last").groupBy(*KEY, part.alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    text = chunks.select(*KEY, "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return text.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(joined_ids, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Only conv_id, turn, role and text are read. Turns stand by turn (null first), then role and text; a null role or text is empty;
    rows without conv_id belong to no conversation. Repeated rows are turns of their own. Conversations without turns end at the
    root. An empty table has no node. Takes another multiplier if two different turns met under one fingerprint.
    """
    for seed in range(SEEDS):
        turns = staged(ordered_turns(conversations, seed), "turns")
        paths, own = rebuilt(turns, seed)
        if not unequal(own):
            break
    else:
        raise RuntimeError("fingerprints collide under every multiplier")
    paths = staged(paths, "paths")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes"))
    nodes = staged(nodes, "nodes")
    children = nodes.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # what a node adds, on the path of its smallest conversation, summed from the deep end
    adds = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = paths.select("conv_id", *KEY).join(adds, ["conv_id", "depth"], "left").withColumn("_up", -F.col("depth")).withColumn(CHUNK, F.floor(F.col("_up") / WIDTH))
    below = running(path, ["conv_id"], ["_up"], {"saved_tokens": F.coalesce("saved", F.lit(0).cast("long")), "n_leaves": F.coalesce("leaf", F.lit(0).cast("long"))})
    sums = below.groupBy(*KEY).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, KEY).join(ends(paths), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# crc32 by its byte table, which the query builds bit by bit; paths are lists of (role, text)
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS k FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
conv AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
         FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, (xor(list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9)::BIGINT AS h FROM conv, tab),
reb AS (SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS path FROM h c LEFT JOIN h b ON b.conv_id = c.conv_id - c.conv_id % 5),
pre AS (SELECT conv_id, d::BIGINT AS depth, path[1:d] AS p, len(path) = d AS ends FROM reb, generate_series(0, len(path)) g(d)),
node AS (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM pre GROUP BY depth, p),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.p[depth].t) END AS saved FROM node n LEFT JOIN kids k ON k.p = n.p),
up AS (SELECT p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM full_node, generate_series(0, depth) g(d) GROUP BY 1)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM full_node n JOIN up u ON u.p = n.p LEFT JOIN node a ON n.depth > 0 AND a.p = n.p[1:n.depth - 1]
"""
