"""Hand-computed period statistics, durations, snapshots and down-sampling."""
import pytest
from helpers import MIN, observations, us
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import process as P
from tidemark.operators import series as S

LAB, AN = "lims.x", "pak.x"


def fresh(spark):
    return spark.createDataFrame(list(C.FRESHNESS_MINUTES.items()), "source string, fresh_minutes int")


def test_publication_edge(spark):
    o = observations(spark, [(LAB, "2026-01-01 10:00:00", 5, "lims")])
    assert S.snapshot(o, us("2026-01-01 13:59:00"), fresh(spark)).count() == 0
    r = S.snapshot(o, us("2026-01-01 14:00:00"), fresh(spark)).first()
    assert r.value == 5 and r.available_at.hour == 14 and r.freshness == "fresh"


def test_snapshot_never_reads_ahead(spark):
    o = observations(spark, [("ht.T", "2026-01-01 11:50:00", 98, "kip"), ("ht.T", "2026-01-01 12:00:00", 100, "kip"), ("ht.T", "2026-01-01 12:10:00", 900, "kip")])
    r = S.snapshot(o, us("2026-01-01 12:03:00"), fresh(spark)).first()
    assert (r.value, r.age_minutes, r.delta, r.freshness) == (100, 3, 2, "fresh")
    assert S.snapshot(o, us("2026-01-01 12:09:59"), fresh(spark)).first().freshness == "fresh"
    assert S.snapshot(o, us("2026-01-02 12:00:00"), fresh(spark)).first().freshness == "stale"


def test_flagged_newest_is_not_replaced(spark):
    o = observations(spark, [(LAB, "2026-01-01 10:00:00", 5, "lims"), (LAB, "2026-01-01 11:00:00", 6, "lims", "invalid")])
    r = S.snapshot(o, us("2026-01-01 16:00:00"), fresh(spark)).first()
    assert r.value is None and r.flags == "invalid" and r.delta is None


def test_durations_and_agreement(spark):
    o = observations(spark, [(AN, 0, 10, "pak"), (AN, 10, 12, "pak"), (AN, 20, 12, "pak", "flatline"), (AN, 50, 8, "pak")])
    a = us("2026-01-01 00:00:00")
    for width in (7 * MIN, 10_000 * MIN):
        r = S.durations(o, a, a + 60 * MIN, 10.0, width=width).first()
        assert (r.observed_minutes, r.exceed_minutes, r.suspect_minutes, r.coverage) == (30, 10, 10, 0.5)
    parts = {r.part: r.minutes for r in S.composition(S.durations(o, a, a + 60 * MIN, 10.0), 60.0).collect()}
    assert parts == {"below": 20, "above": 10, "suspect": 10, "missing": 20}
    ok = o.filter(C.is_valid("value", "flags", True)).select("t", "value", "source_row")
    lab = observations(spark, [(LAB, 12, 11, "lims"), (LAB, 45, 9, "lims")]).select("t", "value", "source_row")
    r = S.agreement(lab, ok).first()
    assert (r.n, r.bias, r.mae) == (1, 1, 1)


def test_reading_before_the_period_covers_its_start(spark):
    o = observations(spark, [(AN, -4, 12, "pak"), (AN, 100, 1, "pak")])
    a = us("2026-01-01 00:00:00")
    assert S.durations(o, a, a + 30 * MIN, 10.0).first().exceed_minutes == 6


@pytest.mark.parametrize("per_range", [1, 10**9])
def test_period_statistics(spark, per_range):
    o = observations(spark, [("m", 0, 1, "kip"), ("m", 10, 3, "kip"), ("m", 20, 100, "kip", "suspect"), ("m", 30, 1000, "kip", "conflict"), ("m", 40, None, "kip", "invalid"), ("m", -30, 4, "kip")])
    a = us("2026-01-01 00:00:00")
    r = S.period_statistics(o, a, a + 60 * MIN, per_range=per_range).first()
    assert (r["count"], r.median, r.invalid_count, r.suspect_count, r.previous_median, r.median_change) == (3, 3, 2, 1, 4, -1)
    assert abs(r.p05 - 1.2) < 1e-9 and abs(r.p95 - 90.3) < 1e-9 and abs(r.iqr - 49.5) < 1e-9 and r.change == 99
    r = S.period_statistics(o, a, a + 60 * MIN, True, per_range=per_range).first()
    assert (r["count"], r["mean"]) == (2, 2)


def test_histogram_and_constant(spark):
    o = observations(spark, [("m", 0, 1, "kip"), ("m", 10, 3, "kip"), ("c", 0, 5, "kip"), ("c", 1, 5, "kip")])
    h = S.histogram(o).collect()
    assert sum(r["count"] for r in h if r.metric_id == "m") == 2 and len([r for r in h if r.metric_id == "m"]) == 20
    assert [(r["count"], r["from"]) for r in h if r.metric_id == "c"] == [(2, 5.0)]


def test_downsampling_keeps_the_peak(spark):
    o = observations(spark, [("m", 10 * i, 879 if i == 77 else i % 5, "kip") for i in range(144)])
    a = us("2026-01-01 00:00:00")
    for hot in (1, 10**9):
        d = S.downsample(o, a, a + 1440 * MIN, 50, per_range=hot).collect()
        assert len(d) <= 50 and max(r["max"] for r in d) == 879 and all(r.aggregated for r in d)
    assert S.downsample(o, a, a + 1440 * MIN, 500).filter("aggregated").count() == 0


def test_fraction_curve_never_mixes_times(spark):
    dim = spark.createDataFrame([("a", 0), ("b", 50), ("c", 90)], "metric_id string, fraction int")
    o = observations(spark, [("a", "2026-01-01 00:00:00", 180, "lims"), ("b", "2026-01-01 00:00:00", 260, "lims"), ("c", "2026-01-02 00:00:00", 330, "lims")])
    r = S.fraction_curve(o, dim, us("2026-01-02 01:00:00")).collect()
    assert {x.metric_id for x in r} == {"a", "b"} and r[0].age_minutes == 1500 and r[0].monotonic


def test_median_of_last_three(spark):
    rows = [(LAB, "2026-01-01 01:00:00", 355, "lims"), (LAB, "2026-01-02 01:00:00", 345, "lims"), (LAB, "2026-01-03 06:00:00", 350, "lims"),
            (LAB, "2026-01-03 06:00:00", 350, "lims"), (LAB, "2026-01-03 09:00:00", 999, "lims")]
    o = observations(spark, rows).withColumn("unit", F.lit("C"))
    at = us("2026-01-03 10:00:00")
    assert P.median_of_latest(P.latest_samples(o, at), at).first().estimate == 350
    before = us("2026-01-03 09:59:59")
    assert P.latest_samples(o, before).filter("rn = 1").first().value == 345
    bad = observations(spark, rows + [(LAB, "2026-01-03 06:00:00", 351, "lims")]).withColumn("unit", F.lit("C"))
    s = P.latest_samples(bad, at).filter("rn = 1").first()
    assert s.flags == "conflict" and s.value is None and P.median_of_latest(P.latest_samples(bad, at), at).first().estimate is None


def test_filters_and_columns_reach_the_file(spark, tmp_path):
    from tidemark.sources import sinks as W
    o = observations(spark, [("m", i, i, "kip") for i in range(50)]).withColumn("unit", F.lit(None).cast("string")).withColumn("source_file", F.lit("f"))
    W.write_long(o, str(tmp_path / "t"))
    d = W.read_long(spark, str(tmp_path / "t")).filter("source = 'kip' AND metric_id = 'm'").select("t", "value")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(metric_id,m)" in plan and "PartitionFilters: [isnotnull(source" in plan and "source_file" not in plan
    assert d.count() == 50
