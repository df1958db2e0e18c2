"""The flat-line stream against its batch rule, for several cuts into micro-batches and late rows."""
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import from_micros
from tidemark.streaming import jobs as J

MIN = 60_000_000
BASE = 1_767_225_600_000_000  # 2026-01-01


def batch_rule(rows, hold, gap, until):
    out = []
    for metric in {r[0] for r in rows}:
        start = last_t = last_v = None
        for _, t, row, v in sorted((r for r in rows if r[0] == metric and r[3] is not None), key=lambda r: (r[1], r[2])):
            if start is None or v != last_v or t - last_t > gap:
                start = t
            elif t - start >= hold and t <= until:
                out.append((metric, t, row, start))
            last_t, last_v = t, v
    return sorted(out)


def series(seed):
    r, rows, n = random.Random(seed), [], 0
    for metric in ("a", "b", "c"):
        t, v = BASE, 1.0
        for _ in range(150):
            t += r.choice([5, 10, 10, 10, 45]) * MIN
            if r.random() < 0.06:
                v = float(r.randrange(3))
            rows.append((metric, t, n, None if r.random() < 0.03 else v))
            n += 1
    return rows


@pytest.mark.parametrize("seed,parts,late", [(1, 1, 0), (1, 3, 0), (1, 9, 0), (2, 4, 1), (2, 12, 1)])
def test_alarms_do_not_depend_on_micro_batches(spark, tmp_path, seed, parts, late):
    rows = series(seed)
    first, last = min(r[1] for r in rows), max(r[1] for r in rows)
    width = (last - first) // parts + 1
    r = random.Random(parts)
    place = lambda x: min(parts - 1, (x[1] - first) // width + (late if r.random() < 0.2 else 0))
    dealt = [(place(x), x) for x in rows]
    for k in range(parts):
        own = [x for p, x in dealt if p == k]
        d = spark.createDataFrame(own, "metric_id string, t long, source_row long, value double").withColumn("timestamp", from_micros("t"))
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    # a delay of two parts: a row one batch late is still ahead of the watermark
    delay = 2 * width // 1000 + 1
    stream = J.open_events(spark, f"{tmp_path}/in", schema, 1)
    hold, gap = 60 * MIN, 20 * MIN
    out = spark.read.parquet(J.drain(J.flatline_alarm(stream, hold, gap, f"{delay} milliseconds"), store=J.ROCKSDB))
    got = sorted(tuple(x) for x in out.select("metric_id", "t", "source_row", "run_start").collect())
    assert got == batch_rule(rows, hold, gap, last - delay * 1000)
    if parts > 3:
        assert len(got) > 10 and out.select(F.countDistinct("batch")).first()[0] > 1
