"""Mixing sources to target weights by hierarchical budgeting.

Weights run down the tree domain > language > source. A node's capacity is max_epochs times its tokens; a node's budget is
shared among its children in proportion to their weights, children that run short take their capacity and leave the rest to their
siblings. A parent never gets more than its capacity, so a shortage moves up only when all siblings are exhausted.
A leaf's budget is its whole epochs plus a token prefix of one more epoch, in an order seeded by (seed, epoch, doc_id).
All sums are integers. The prefix is cut without sorting a leaf: the order hash is dealt into BUCKETS ranges, their sums give
the range that holds the cut, and only that range is sorted. Built-in functions only; texts are not shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import staged, table

LEVELS = ["domain", "lang", "source"]
DOMAIN_WEIGHTS = {"web": 50, "news": 20, "books": 20, "forum": 10}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}
DEFAULT_WEIGHT = 1  # of names without a weight; all sources weigh the same
MAX_EPOCHS = 4
BUDGET_PERCENT = 60  # of all tokens
SEED = "mix-1"
BUCKETS = 4_096
HASH_BITS = 60


def token_count(text: Column) -> Column:
    """Tokens of budgeting: runs of non-blank characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The tables have no domain; sources are dealt to four by the number in their name (none: web)."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.element_at(F.array(*[F.lit(d) for d in DOMAIN_WEIGHTS]), F.when(n == "", 0).otherwise(n.cast("int")) % 4 + 1)


def order_hash(seed: str, epoch: Column, doc_id: Column) -> Column:
    """60 bits of md5(seed|epoch|doc_id)."""
    key = F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    own = [F.lit(x) for pair in weights.get(level, {}).items() for x in pair]
    given = F.element_at(F.create_map(*own), F.col(level)) if own else F.lit(None)
    return F.coalesce(given.cast("long"), F.lit(DEFAULT_WEIGHT).cast("long"))


def share(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """nodes: (*parents, child, weight, cap, pot): pot is the parent's budget, never above the sum of caps. Adds `budget`."""
    by = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), child)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    big = "decimal(38,0)"
    n = nodes.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn(
        "rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    n = n.withColumn("short", F.col("cap").cast(big) * F.col("rest") <= (F.col("pot") - F.col("spent")).cast(big) * F.col("weight"))
    left = F.col("pot") - F.sum(F.when(F.col("short"), F.col("cap")).otherwise(0)).over(whole)
    open_weight = F.sum(F.when(F.col("short"), 0).otherwise(F.col("weight"))).over(whole)
    n = n.withColumn("left", left).withColumn("open", open_weight)
    exact = F.expr("cast((cast(left as decimal(28,0)) * cast(weight as decimal(9,0))) div open as long)")
    return n.withColumn("budget", F.when(F.col("short"), F.col("cap")).otherwise(exact)).drop("spent", "rest", "short", "left", "open")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """leaves: (domain, lang, source, tokens). Adds each leaf's `budget` in tokens."""
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = tree.agg(F.least(F.floor(budget), F.sum("cap")).cast("long").alias("pot"))
    pots = total
    for depth, level in enumerate(LEVELS):
        parents = LEVELS[:depth]
        nodes = tree.groupBy(*parents, level).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).where("cap > 0")
        nodes = nodes.withColumn("weight", weight_of(level, weights))
        nodes = nodes.join(pots, parents) if parents else nodes.crossJoin(F.broadcast(pots))  # one row
        given = share(nodes, parents, level)
        pots = given.select(*parents, level, F.col("budget").alias("pot"))
    return given.select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Rows of docs chosen for the mixture, once per epoch: all columns of docs, then domain, n_tokens and epoch (from 0).

    Null sources and languages form leaves of their own (named ''). Null, empty and blank texts hold no tokens and are in no
    mixture. A document of the last epoch is taken while the tokens before it stay below the leaf's rest, so a leaf overshoots
    by less than one document. Rows that share a doc_id follow each other in the order. Columns of docs named domain,
    n_tokens or epoch are replaced. Empty tables give empty ones.
    """
    rest = docs.drop("domain", "n_tokens", "epoch")
    names = {"_domain": domain_of(F.col("source")), "_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))}
    rows = rest.withColumns({**names, "_n": token_count(F.col("text"))})
    tokens = staged(rows.select("doc_id", *[F.col(f"_{c}").alias(c) for c in LEVELS], F.col("_n").alias("n")).where("n > 0"), "tokens")
    leaves = staged(tokens.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), "leaves")
    every = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = staged(budgets(leaves, weights, F.lit(every * budget_percent // 100), max_epochs), "budgets")
    plan = plan.select(*LEVELS, F.expr("cast(budget div tokens as int)").alias("full"), (F.col("budget") % F.col("tokens")).alias("cut"))

    width = (1 << HASH_BITS) // buckets
    bucket = F.expr(f"cast(_h div {width} as int)")
    dealt = tokens.join(plan, LEVELS).withColumn("_h", order_hash(seed, F.col("full"), F.col("doc_id"))).withColumn("bucket", bucket)
    sums = dealt.where("cut > 0").groupBy(*LEVELS, "cut", "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("n")
    edge = sums.withColumn("before", upto).where("before < cut").groupBy(*LEVELS).agg(F.max("bucket").alias("edge"), F.max("before").alias("before"))
    plan = staged(plan.join(edge, LEVELS, "left"), "cuts").select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "full", "cut", "edge", "before")

    got = rows.where("_n > 0").join(plan, [f"_{c}" for c in LEVELS])
    got = got.withColumn("_h", order_hash(seed, F.col("full"), F.col("doc_id"))).withColumn("_b", bucket)
    at_edge = got.where(F.col("_b") == F.col("edge"))
    order = Window.partitionBy(*[f"_{c}" for c in LEVELS]).orderBy("_h", "doc_id", "_n", F.xxhash64("text"))
    inside = at_edge.withColumn("_upto", F.col("before") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).where("_upto < cut")
    keep = [*[F.col(f"`{c}`") for c in rest.columns], F.col("_domain").alias("domain"), F.col("_n").alias("n_tokens")]
    whole = got.where("full > 0 or _b < edge").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.col("full") - F.when(F.col("_b") < F.col("edge"), 0).otherwise(1))))
    return whole.select(*keep, "epoch").union(inside.select(*keep, F.col("full").alias("epoch")))


WEIGHTS = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), WEIGHTS)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _level_sql(name: str, parents: list[str], child: str, weight: str, pots: str) -> str:
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    join = f"JOIN {pots} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {pots}"
    keys = ", ".join([*parents, child])
    return f"""
n_{name} AS (SELECT {keys}, cap, {weight} AS w, pot FROM (SELECT {keys}, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS cap FROM leaves GROUP BY {keys}) {join}),
r_{name} AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS spent, sum(w) OVER a - coalesce(sum(w) OVER b, 0) AS rest FROM n_{name}
  WINDOW a AS ({by}), b AS ({by} ORDER BY cap::DOUBLE / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s_{name} AS (SELECT *, cap * rest <= (pot - spent) * w AS short FROM r_{name}),
o_{name} AS (SELECT *, pot - coalesce(sum(cap) FILTER (short) OVER ({by}), 0) AS rem, sum(w) FILTER (NOT short) OVER ({by}) AS open FROM s_{name}),
p_{name} AS (SELECT {keys}, CASE WHEN short THEN cap ELSE (rem * w) // open END AS pot FROM o_{name})"""


def _weights_sql(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {DEFAULT_WEIGHT} END"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    list_extract({list(DOMAIN_WEIGHTS)}, coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 4 + 1) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, text FROM documents),
t AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS MATERIALIZED (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM t GROUP BY ALL),
top AS (SELECT least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(tokens) * {MAX_EPOCHS}) AS pot FROM leaves),
{_level_sql("domain", [], "domain", _weights_sql("domain", DOMAIN_WEIGHTS), "top")},
{_level_sql("lang", ["domain"], "lang", _weights_sql("lang", LANG_WEIGHTS), "p_domain")},
{_level_sql("source", ["domain", "lang"], "source", str(DEFAULT_WEIGHT), "p_lang")},
f AS (SELECT domain, lang, source, (pot // tokens)::INT AS full_epochs, pot % tokens AS cut FROM p_source JOIN leaves USING (domain, lang, source)),
h AS (SELECT t.*, full_epochs, cut, ('0x' || substr(md5('{SEED}|' || full_epochs || '|' || doc_id), 1, 15))::BIGINT AS h FROM t JOIN f USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM h)
SELECT doc_id, domain, lang, source, n_tokens, e::INT AS epoch FROM c, generate_series(0, full_epochs) AS g(e) WHERE e < full_epochs OR before < cut
"""
