"""Order-dependent operators that never put one whole key into one task.

A window over ``(key ORDER BY time)`` sends a hot key to a single task.  Here
every key is cut into time chunks, the window runs per ``(key, chunk)``, and
the little that has to cross a chunk edge (the last rows, a run start, a
running total) travels through a one-row-per-chunk summary.  Results equal the
plain window; a key with a third of all rows is spread over all its chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY, MINUTE, bucket

CHUNK = "_chunk"
GHOST = "_ghost"


def suggest_width(df: DataFrame, keys: Sequence[str], t: str, rows_per_chunk: int = 1_000_000,
                  widest: int = DAY, narrowest: int = MINUTE) -> int:
    """Chunk width so that the densest (key, widest) bucket splits into chunks of about ``rows_per_chunk``.

    One partial-aggregated pass over the key and time columns only.
    """
    per = df.groupBy(*keys, bucket(t, widest).alias(CHUNK)).count()
    peak = per.agg(F.max("count")).first()[0] or 1
    return int(max(narrowest, min(widest, widest * rows_per_chunk // peak)))


def local(keys: Sequence[str], *order: str | Column) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def add_chunk(df: DataFrame, t: str, width: int) -> DataFrame:
    return df.withColumn(CHUNK, bucket(t, width))


def with_ghosts(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], cols: Sequence[str],
                width: int = DAY, n: int = 1, ahead: bool = False) -> DataFrame:
    """Rows plus, per chunk, copies of the ``n`` nearest rows before it (after it if ``ahead``).

    Ghost copies carry only ``keys, t, order, cols`` and are marked in ``_ghost``.
    The rank limit is applied by Spark before the shuffle (window group limit),
    so at most ``n`` rows per chunk and task travel.
    """
    base = add_chunk(df, t, width)
    need = list(dict.fromkeys([t, *order, *cols]))
    by = [F.col(x).asc() if ahead else F.col(x).desc() for x in dict.fromkeys([t, *order])]
    edge = (
        base.select(*keys, CHUNK, *[x for x in need if x not in keys])
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*by)))
        .filter(F.col("_rn") <= n)
    )
    step = F.col(CHUNK).asc() if not ahead else F.col(CHUNK).desc()
    packed = edge.groupBy(*keys, CHUNK).agg(F.collect_list(F.struct(*need)).alias("_rows"))
    # Every chunk in the summary holds a row, so the n preceding chunks hold the n preceding rows.
    over = Window.partitionBy(*keys).orderBy(step).rowsBetween(-n, -1)
    near = F.flatten(F.collect_list("_rows").over(over))
    near = F.array_sort(near) if ahead else F.reverse(F.array_sort(near))
    ghosts = (
        packed.withColumn("_near", F.slice(near, 1, n))
        .select(*keys, CHUNK, F.explode("_near").alias("_r"))
        .select(*keys, CHUNK, *[F.col(f"_r.{x}").alias(x) for x in need if x not in keys], F.lit(True).alias(GHOST))
    )
    return base.withColumn(GHOST, F.lit(False)).unionByName(ghosts, allowMissingColumns=True)


def drop_ghosts(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(GHOST)).drop(GHOST)


def neighbour(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], cols: Sequence[str],
              width: int = DAY, out: str = "prev", ahead: bool = False) -> DataFrame:
    """Adds ``out`` = struct(t, cols) of the preceding (or following) row of the key; keeps ``_chunk``."""
    g = with_ghosts(df, keys, t, order, cols, width, 1, ahead)
    move = F.lead if ahead else F.lag
    want = F.struct(*dict.fromkeys([t, *cols]))
    return drop_ghosts(g.withColumn(out, move(want).over(local(keys, t, *order))))


def trailing(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], cols: Sequence[str], n: int,
             width: int = DAY, out: str = "recent") -> DataFrame:
    """Adds ``out`` = array of struct(t, cols) of the last ``n`` rows including this one, oldest first."""
    g = with_ghosts(df, keys, t, order, cols, width, max(1, n - 1))
    w = local(keys, t, *order).rowsBetween(-(n - 1), 0)
    want = F.struct(*dict.fromkeys([t, *cols]))
    return drop_ghosts(g.withColumn(out, F.collect_list(want).over(w)))


def _carry(df: DataFrame, keys: Sequence[str], summary: dict[str, Column], fold: dict[str, Column]) -> DataFrame:
    """Per (key, chunk): ``fold`` over the summaries of all earlier chunks of the key."""
    s = df.groupBy(*keys, CHUNK).agg(*[e.alias(k) for k, e in summary.items()])
    w = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return s.select(*keys, CHUNK, *[e.over(w).alias(k) for k, e in fold.items()])


def last_where(df: DataFrame, keys: Sequence[str], order: Sequence[str], when: Column, value: Column, out: str) -> DataFrame:
    """Adds ``out`` = ``value`` at the latest row (this one included) where ``when`` holds.

    ``value`` must grow with the order (a time or a row number), so the chunk summary is a plain maximum.
    """
    d = df.withColumn("_v", F.when(when, value))
    carry = _carry(d, keys, {"_m": F.max("_v")}, {"_in": F.max("_m")})
    w = local(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.withColumn("_here", F.last("_v", ignorenulls=True).over(w))
        .join(carry, [*keys, CHUNK], "left")
        .withColumn(out, F.coalesce("_here", "_in"))
        .drop("_v", "_here", "_in")
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Adds running totals (this row included) of the given expressions along ``order``."""
    d = df
    for k, e in totals.items():
        d = d.withColumn(f"_x_{k}", e)
    carry = _carry(d, keys, {f"_s_{k}": F.sum(f"_x_{k}") for k in totals}, {f"_in_{k}": F.sum(f"_s_{k}") for k in totals})
    w = local(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    for k in totals:
        d = d.withColumn(f"_here_{k}", F.sum(f"_x_{k}").over(w))
    d = d.join(carry, [*keys, CHUNK], "left")
    zero = {k: F.lit(0) for k in totals}
    for k in totals:
        d = d.withColumn(k, F.coalesce(f"_in_{k}", zero[k]) + F.coalesce(f"_here_{k}", zero[k]))
    return d.drop(*[f"{p}{k}" for k in totals for p in ("_x_", "_in_", "_here_")])


def islands(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], breaks, cols: Sequence[str],
            width: int = DAY, start: str = "run_start") -> DataFrame:
    """Adds ``start`` = time at which the current unbroken run began.

    ``breaks`` maps the column ``prev`` (struct of the preceding row, NULL for the first) to a condition that
    is true where a new run begins.
    """
    d = neighbour(df, keys, t, order, cols, width, "prev")
    d = d.withColumn("_break", F.col("prev").isNull() | F.coalesce(breaks, F.lit(True)))
    return last_where(d, keys, [t, *order], F.col("_break"), F.col(t), start)


def value_chunks(df: DataFrame, keys: Sequence[str], value: str, pieces: int = 64) -> DataFrame:
    """Adds ``_chunk`` so that each key is cut into about ``pieces`` equal shares along ``value``.

    The cut points come from a mergeable sketch, so they follow the data; the chunk is a monotone function of the
    value, which is all the running operators need.
    """
    probs = [i / pieces for i in range(1, pieces)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("_cuts"))
    return df.join(cuts, list(keys)).withColumn(CHUNK, F.size(F.filter("_cuts", lambda x: x < F.col(value))).cast("long")).drop("_cuts")
