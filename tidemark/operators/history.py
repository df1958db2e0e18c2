"""Bounded-history loads for a batch of prediction moments.

Every origin needs the rows of the last hours or days before it, published by then.  For a batch the wanted periods are
united into few disjoint ranges, which bound the stored time column and so reach the files; the rows read are then
held exactly against the nearest origin after their publication.  No row is paired with the origins that see it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordered import neighbour
from .timejoin import asof


@dataclass(frozen=True)
class Source:
    """Metrics that one rule loads: rows sampled after ``origin - age`` (from it on if ``closed``) and published by the origin."""

    metrics: Sequence[str]
    age: int
    delay: int = 0
    closed: bool = False
    lowest: float | None = None


def runtime_sources(analysers: Sequence[str], controls: Sequence[str], lab: str) -> dict[str, Source]:
    return {"analysers": Source(analysers, 46 * C.DAY), "controls": Source(controls, 48 * C.HOUR),
            "labs": Source([lab], 60 * C.DAY, C.LAB_DELAY_MINUTES * C.MINUTE, True, 0.0)}


def read_ranges(origins: DataFrame, on: str, age: int, delay: int = 0, pieces: int = 64, width: int = C.DAY) -> list[tuple[int, int]]:
    """At most ``pieces`` disjoint closed ranges that cover ``[origin - age, origin - delay]`` of every origin.

    With more holes between the periods only the widest stay holes: the ranges may cover too much, never too little.
    At most ``pieces`` rows reach the driver.
    """
    o = origins.filter(F.col(on).isNotNull()).select(F.lit(0).alias("_k"), F.col(on).alias("o")).distinct()
    ends = o.agg(F.min("o"), F.max("o")).first()
    if ends[0] is None:
        return []
    hole = F.col("o") - age - (F.col("prev.o") - delay)
    holes = neighbour(o, ["_k"], "o", [], [], width, "prev").select((F.col("prev.o") - delay).alias("a"), (F.col("o") - age).alias("b"), hole.alias("size"))
    widest = sorted((r["a"], r["b"]) for r in holes.filter("size > 1").orderBy(F.desc("size"), "a").limit(pieces - 1).collect())
    return list(zip([ends[0] - age, *[b for _, b in widest]], [*[a for a, _ in widest], ends[1] - delay]))


def in_ranges(column: str, ranges: Sequence[tuple[int, int]], slack: int = 0) -> Column:
    """The stored time column lies in one of the ranges, or up to ``slack`` after one, as constants that reach the files; false without ranges."""
    parts = [(F.col(column) >= C.ntz_literal(a)) & (F.col(column) <= C.ntz_literal(b + slack)) for a, b in ranges]
    return reduce(lambda p, q: p | q, parts) if parts else F.lit(False)


def visible_from(rows: DataFrame, origins: DataFrame, on: str, source: Source, width: int = C.HOUR) -> DataFrame:
    """Rows (with a clock ``t``) that some origin loads, with ``first_origin``, the first of them.

    The first origin at or after publication decides: if the row is too old for it, it is for all later ones.
    """
    o = origins.filter(F.col(on).isNotNull()).select(F.lit(0).alias("_k"), (-F.col(on)).alias("_o")).distinct()
    left = rows.withColumn("_k", F.lit(0)).withColumn("_back", -(F.col("t") + source.delay))
    j = asof(left, o, ["_k"], "_back", "_o", [], [], source.age - source.delay - (0 if source.closed else 1), width, "_hit")
    return j.filter("_hit IS NOT NULL").withColumn("first_origin", -F.col("_hit._o")).drop("_k", "_back", "_hit")


def bounded_history(read, origins: DataFrame, sources: Mapping[str, Source], on: str = "origin", pieces: int = 64) -> DataFrame:
    """Rows of every source that some origin of the batch sees: (source, metric_id, t, value, first_origin), the last valid one per (metric, t).

    ``read(ranges)`` returns the observations (metric_id, t, value, flags, source_row) of the given ranges; it should bound the stored
    column with :func:`in_ranges`.  Without origins nothing is read and the result is empty.
    """
    parts = []
    for name, s in sources.items():
        rows = read(read_ranges(origins, on, s.age, s.delay, pieces)).filter(F.col("metric_id").isin(*s.metrics) & C.is_valid())
        if s.lowest is not None:
            rows = rows.filter(F.col("value") >= s.lowest)
        last = rows.groupBy("metric_id", "t").agg(F.max_by("value", "source_row").alias("value"))
        parts.append(visible_from(last, origins, on, s).select(F.lit(name).alias("source"), "metric_id", "t", "value", "first_origin"))
    return reduce(DataFrame.unionByName, parts)
