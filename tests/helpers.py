from datetime import datetime, timezone

import numpy as np
import pandas as pd

MIN = 60_000_000


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


def observations(spark, rows):
    """rows: (metric, minute offset or text, value, source, flags[, source_row])"""
    base = us("2026-01-01 00:00:00")
    out = []
    for i, r in enumerate(rows):
        t = us(r[1]) if isinstance(r[1], str) else base + int(r[1] * MIN)
        out.append((r[0], t, None if r[2] is None else float(r[2]), r[3], r[4] if len(r) > 4 else "", r[5] if len(r) > 5 else i))
    from tidemark.functions.columns import from_micros
    d = spark.createDataFrame(out, "metric_id string, t long, value double, source string, flags string, source_row long")
    return d.withColumn("timestamp", from_micros("t"))


def skewed(seed, n=600, keys=3, span_minutes=3000, distinct_times=False):
    """Random series where one key holds most rows."""
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.7, 0, rng.integers(1, keys, n))
    t = rng.permutation(span_minutes)[:n] if distinct_times else rng.integers(0, span_minutes, n)
    return pd.DataFrame({"k": k, "t": t.astype("int64") * MIN, "row": np.arange(n), "value": np.floor(rng.exponential(2, n))})
