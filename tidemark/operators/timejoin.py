"""Time joins: as-of, publication-aware as-of, rolling sums at arbitrary moments, range frames.

None of them pairs rows.  Both sides meet in one tagged, time-chunked stream and
the wanted right row is carried forward, so the work is linear in the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY, bucket
from .ordered import CHUNK, local


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, cols: Sequence[str],
         order: Sequence[str] = (), tolerance: int | None = None, width: int = DAY, out: str = "hit",
         strict: bool = False) -> DataFrame:
    """Left rows with ``out`` = struct(right_on, cols) of the latest right row at or before ``left_on``.

    ``strict`` excludes equal times.  ``order`` breaks ties among right rows (largest wins).  Beyond
    ``tolerance`` microseconds the struct is NULL.  Times are long microseconds.
    """
    names = list(dict.fromkeys([right_on, *cols]))
    order = [x for x in order if x != right_on]
    sort_names = [f"_o{i}" for i in range(len(order))]
    hit = F.struct(*[F.col(x) for x in names])
    r = right.select(
        *keys, F.col(right_on).alias("_t"), *[F.col(o).alias(s) for o, s in zip(order, sort_names)], hit.alias("_r"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"),
        F.lit(1 if strict else 0).alias("_side"), bucket(right_on, width).alias(CHUNK))
    l = left.select(
        *keys, F.col(left_on).alias("_t"), *[F.lit(None).cast(right.schema[o].dataType).alias(s) for o, s in zip(order, sort_names)],
        F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"),
        F.lit(0 if strict else 1).alias("_side"), bucket(left_on, width).alias(CHUNK))
    # Last right row of each chunk; the rank limit runs before the shuffle.
    top = Window.partitionBy(*keys, CHUNK).orderBy(F.col("_t").desc(), *[F.col(s).desc() for s in sort_names])
    tail = r.withColumn("_rn", F.row_number().over(top)).filter("_rn = 1").drop("_rn")
    if tolerance is not None and tolerance <= width:
        seed = tail.withColumn(CHUNK, F.col(CHUNK) + 1)
    else:
        wanted = l.select(*keys, CHUNK).distinct().withColumn("_want", F.lit(True))
        known = tail.withColumn("_want", F.lit(False))
        both = known.unionByName(wanted, allowMissingColumns=True)
        before = Window.partitionBy(*keys).orderBy(CHUNK).rangeBetween(Window.unboundedPreceding, -1)
        seed = (
            both.withColumn("_r", F.last("_r", ignorenulls=True).over(before))
            .filter(F.col("_want") & F.col("_r").isNotNull())
            .withColumn("_t", F.col(f"_r.{right_on}"))
            .withColumn("_side", F.lit(1 if strict else 0)).drop("_want"))
    w = local(keys, "_t", "_side", *sort_names).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        l.unionByName(r).unionByName(seed)
        .withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
        .filter(F.col("_l").isNotNull())
    )
    keep = F.col("_hit") if tolerance is None else F.when(F.col("_t") - F.col(f"_hit.{right_on}") <= tolerance, F.col("_hit"))
    return found.select("_l.*", keep.alias(out))


def published_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, sample: str, cols: Sequence[str],
                   delay: int, max_age: int, order: Sequence[str] = (), width: int = DAY, out: str = "lab") -> DataFrame:
    """Latest right row *published* (sample + delay) by ``left_on``; NULL when its sample is older than ``max_age``.

    Age is measured from sampling and there is no fallback to an older sample.
    """
    r = right.withColumn("_available", F.col(sample) + F.lit(delay))
    j = asof(left, r, keys, left_on, "_available", [sample, *cols], order, None, width, "_p")
    inner = F.struct(F.col(f"_p.{sample}").alias(sample), F.col("_p._available").alias("available_at"),
                     *[F.col(f"_p.{x}").alias(x) for x in cols])
    return j.withColumn(out, F.when(F.col(left_on) - F.col(f"_p.{sample}") <= max_age, inner)).drop("_p")


def window_sums(origins: DataFrame, series: DataFrame, keys: Sequence[str], on: str, t: str, value: str,
                spans: Mapping[str, tuple[int, int]], width: int = DAY) -> DataFrame:
    """Per distinct (keys, on): ``n_<name>`` and ``sum_<name>`` of ``value`` over ``(on + lo, on + hi]``.

    Each window is the difference of two running sums read at its edges.  Running sums restart per chunk, and a
    chunk is never shorter than the longest window, so a window touches at most two chunks and no precision is
    lost to a long history.
    """
    width = max([width, *[hi - lo for lo, hi in spans.values()]])
    edges = sorted({e for lo, hi in spans.values() for e in (lo, hi)})
    probe = (
        origins.select(*keys, on).distinct()
        .withColumn("_e", F.explode(F.array(*[F.lit(e).cast("long") for e in edges])))
        .withColumn("_t", F.col(on) + F.col("_e"))
        .withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast("double"))
    )
    rows = series.filter(F.col(value).isNotNull()).select(
        *keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.col(value).cast("double").alias("_v"),
        F.lit(None).cast("long").alias(on), F.lit(None).cast("long").alias("_e"))
    u = probe.unionByName(rows).withColumn(CHUNK, bucket("_t", width))
    w = local(keys, "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, CHUNK)
    u = (
        u.withColumn("_s", F.coalesce(F.sum("_v").over(w), F.lit(0.0))).withColumn("_n", F.count("_v").over(w))
        .withColumn("_ts", F.coalesce(F.sum("_v").over(whole), F.lit(0.0))).withColumn("_tn", F.count("_v").over(whole))
        .filter(F.col("_side") == 1)
    )

    def at(e, x):
        return F.max(F.when(F.col("_e") == e, F.col(x)))

    aggs = [at(e, x).alias(f"{x}{i}") for i, e in enumerate(edges) for x in ("_s", "_n", "_ts", "_tn")]
    g = u.groupBy(*keys, on).agg(*aggs)
    out = [*keys, on]
    for name, (lo, hi) in spans.items():
        a, b = edges.index(lo), edges.index(hi)
        same = bucket(F.col(on) + lo, width) == bucket(F.col(on) + hi, width)
        for label, part, total in (("n", "_n", "_tn"), ("sum", "_s", "_ts")):
            inner = F.col(f"{part}{b}") - F.col(f"{part}{a}")
            across = F.col(f"{part}{b}") + F.col(f"{total}{a}") - F.col(f"{part}{a}")
            out.append(F.when(same, inner).otherwise(across).alias(f"{label}_{name}"))
    return g.select(*out)


def window_means(origins: DataFrame, series: DataFrame, keys: Sequence[str], on: str, t: str, value: str,
                 spans: Mapping[str, tuple[int, int, int]], width: int = DAY) -> DataFrame:
    """Mean over ``(on + lo, on + hi]`` where at least ``min_count`` readings exist: ``spans[name] = (lo, hi, min_count)``."""
    s = window_sums(origins, series, keys, on, t, value, {k: v[:2] for k, v in spans.items()}, width)
    return s.select(*keys, on, *[
        F.when(F.col(f"n_{k}") >= max(1, m), F.col(f"sum_{k}") / F.col(f"n_{k}")).alias(k) for k, (_, _, m) in spans.items()])


def range_frame(origins: DataFrame, series: DataFrame, keys: Sequence[str], on: str, t: str, cols: Sequence[str],
                lo: int, hi: int, aggs: Mapping[str, Column], width: int = DAY) -> DataFrame:
    """Arbitrary aggregates over series rows in ``(on + lo, on + hi]`` for each distinct (keys, on).

    Series rows near a chunk edge are copied to the chunks whose origins can see them (at most two copies more),
    then a RANGE frame runs per chunk.  For sums and counts prefer :func:`window_sums`.
    """
    width = max(width, hi - lo, abs(lo), abs(hi))
    o = origins.select(*keys, on).distinct().withColumn(CHUNK, bucket(on, width)).withColumn("_t", F.col(on))
    s = series.select(*keys, F.col(t).alias("_t"), *[x for x in cols if x != t])
    seen = F.sequence(bucket(F.col("_t") - hi, width), bucket(F.col("_t") - lo - 1, width))
    s = s.withColumn(CHUNK, F.explode(seen))
    u = o.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*keys, CHUNK).orderBy("_t").rangeBetween(lo + 1, hi)
    for name, e in aggs.items():
        u = u.withColumn(name, e.over(w))
    return u.filter(F.col(on).isNotNull()).select(*keys, on, *aggs)


MERGE = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, None), "count": (F.count, None)}


def window_merge(origins: DataFrame, series: DataFrame, keys: Sequence[str], on: str, t: str, lo: int, hi: int,
                 aggs: Mapping[str, tuple[str, Column | str]], width: int = DAY) -> DataFrame:
    """``aggs[name] = (max | min | sum | count, column)`` over series rows in ``(on + lo, on + hi]`` per distinct (keys, on).

    Chunks are no longer than the window, so a window is the rest of one chunk after its lower edge, whole chunks, and
    the start of another up to its upper edge.  Each part is a running aggregate read at an edge, or comes from one
    summary row per chunk; no row is copied or aggregated per origin.  Empty windows give NULL, counts 0.
    """
    if hi <= lo:
        raise ValueError("an empty window")
    pieces = -(-(hi - lo) // width)
    width = (hi - lo) // pieces
    names = list(aggs)
    rows = series.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), *[(F.col(x) if isinstance(x, str) else x).alias(n) for n, (_, x) in aggs.items()])
    edges = origins.select(*keys, on).distinct().withColumn("_low", F.explode(F.array(F.lit(True), F.lit(False))))
    edges = edges.withColumn("_t", F.col(on) + F.when(F.col("_low"), lo).otherwise(hi)).withColumn("_side", F.lit(1))
    u = edges.unionByName(rows, allowMissingColumns=True).withColumn(CHUNK, bucket("_t", width))
    upto = local(keys, "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    # Descending, because a frame that ends with the partition is aggregated anew for every row.
    after = local(keys, F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    run = {n: MERGE[kind][0] for n, (kind, _) in aggs.items()}
    u = u.select("*", *[run[n](n).over(upto).alias(f"_u_{n}") for n in names])
    u = u.select("*", *[run[n](n).over(after).alias(f"_a_{n}") for n in names]).filter("_side = 1")
    g = u.groupBy(*keys, on).agg(
        *[F.max(F.when(F.col("_low"), F.col(f"_a_{n}"))).alias(f"_a_{n}") for n in names],
        *[F.max(F.when(~F.col("_low"), F.col(f"_u_{n}"))).alias(f"_u_{n}") for n in names])
    a, b = bucket(F.col(on) + lo, width), bucket(F.col(on) + hi, width)
    parts = ["_a_", "_u_"]
    if pieces > 1:
        # Between the edges' chunks lie pieces - 1 or pieces whole chunks.
        again = {n: (F.sum if kind == "count" else MERGE[kind][0]) for n, (kind, _) in aggs.items()}
        whole = rows.withColumn(CHUNK, bucket("_t", width)).groupBy(*keys, CHUNK).agg(*[run[n](n).alias(n) for n in names])
        seen = g.select(*keys, a.alias(CHUNK)).distinct()
        along = Window.partitionBy(*keys).orderBy(CHUNK)
        m = whole.unionByName(seen.withColumn("_want", F.lit(True)), allowMissingColumns=True)
        spans = {f"_m{p}_": along.rangeBetween(1, p) for p in (pieces - 1, pieces) if p}
        m = m.select(*keys, CHUNK, "_want", *[again[n](n).over(w).alias(f"{p}{n}") for p, w in spans.items() for n in names]).filter("_want").drop("_want")
        g = g.withColumn(CHUNK, a).join(m, [*keys, CHUNK], "left")
        for n in names:
            g = g.withColumn(f"_m_{n}", F.when(b - a > pieces, F.col(f"_m{pieces}_{n}")).otherwise(F.col(f"_m{pieces - 1}_{n}")))
        parts.append("_m_")
    out = []
    for n, (kind, _) in aggs.items():
        cells = [F.col(f"{p}{n}") for p in parts]
        if MERGE[kind][1] is not None:
            value = MERGE[kind][1](*cells)
        else:
            total = sum((F.coalesce(c, F.lit(0)) for c in cells[1:]), F.coalesce(cells[0], F.lit(0)))
            value = total if kind == "count" else F.when(F.coalesce(*cells).isNotNull(), total)
        out.append(value.alias(n))
    return g.select(*keys, on, *out)
