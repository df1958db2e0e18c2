"""Period statistics, durations, histograms, down-sampling, snapshots."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import series as S
from .adapter import AFTER_AT, AT, BEFORE_MIDDLE, END, LAB, LIMIT, ANALYSER, MIDDLE, OBS, START, SUSPECT, VALID, obs, ts_text
from .registry import query, rounded


def us(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * C.SECOND


def round_all(df, digits=6, skip=()):
    return df.select(*[rounded(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in skip else F.col(f"`{n}`") for n, t in df.dtypes])


def freshness(spark):
    return spark.createDataFrame(list(C.FRESHNESS_MINUTES.items()), "source string, fresh_minutes int")


def summary_sql(exclude: bool) -> str:
    ok = VALID + (f" AND NOT {SUSPECT}" if exclude else "")
    return OBS + f""", base AS (
  SELECT *, CASE WHEN {ok} THEN value END AS v, timestamp >= TIMESTAMP '{MIDDLE}' AS cur FROM obs
  WHERE timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}'),
st AS (SELECT metric_id, cur, count(v) AS count, count(*) FILTER (WHERE NOT {VALID}) AS invalid_count,
  count(*) FILTER (WHERE {SUSPECT}) AS suspect_count, avg(v) AS mean, min(v) AS min, max(v) AS max, stddev_pop(v) AS std,
  quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, min(timestamp) FILTER (WHERE v IS NOT NULL) AS first_at,
  max(timestamp) FILTER (WHERE v IS NOT NULL) AS last_at FROM base GROUP BY 1, 2),
f AS (SELECT metric_id, cur, v AS first FROM base WHERE v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY metric_id, cur ORDER BY timestamp, source_row) = 1),
l AS (SELECT metric_id, cur, v AS last FROM base WHERE v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY metric_id, cur ORDER BY timestamp DESC, source_row DESC) = 1),
lo AS (SELECT metric_id, cur, timestamp AS min_at FROM base WHERE v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY metric_id, cur ORDER BY v, timestamp) = 1),
hi AS (SELECT metric_id, cur, timestamp AS max_at FROM base WHERE v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY metric_id, cur ORDER BY v DESC, timestamp) = 1)
SELECT s.metric_id, s.count, s.invalid_count, s.suspect_count, round(s.mean, 6) AS mean, round(s.min, 6) AS min, round(s.max, 6) AS max,
  round(s.std, 6) AS std, round(s.max - s.min, 6) AS "range", {ts_text('min_at')} AS min_at, {ts_text('max_at')} AS max_at,
  round(s.p05, 6) AS p05, round(s.median, 6) AS median, round(s.p95, 6) AS p95, round(s.p75 - s.p25, 6) AS iqr,
  round(f.first, 6) AS first, round(l.last, 6) AS last, {ts_text('s.first_at')} AS first_at, {ts_text('s.last_at')} AS last_at,
  round(l.last - f.first, 6) AS change, round(p.median, 6) AS previous_median, round(s.median - p.median, 6) AS median_change
FROM st s LEFT JOIN st p ON p.metric_id = s.metric_id AND NOT p.cur
LEFT JOIN f ON f.metric_id = s.metric_id AND f.cur LEFT JOIN l ON l.metric_id = s.metric_id AND l.cur
LEFT JOIN lo ON lo.metric_id = s.metric_id AND lo.cur LEFT JOIN hi ON hi.metric_id = s.metric_id AND hi.cur
WHERE s.cur"""


@query("period_summary", "A1 A2 J4 W9 P3 Q11", summary_sql(False))
def _(spark, sf):
    return round_all(S.period_statistics(obs(spark, sf, START, END), us(MIDDLE), us(END)))


@query("period_summary_without_suspects", "A1 Q11", summary_sql(True))
def _(spark, sf):
    return round_all(S.period_statistics(obs(spark, sf, START, END), us(MIDDLE), us(END), True))


@query("period_summary_hot_groups", "A2", summary_sql(False))
def _(spark, sf):
    # Every group is cut into as many ranges as possible.
    return round_all(S.period_statistics(obs(spark, sf, START, END), us(MIDDLE), us(END), per_range=10))


@query("exceedance_share", "A3", OBS + f"""SELECT metric_id, count(*) AS count, count(*) FILTER (WHERE value > {LIMIT}) AS exceed_count,
  round(avg(CASE WHEN value > {LIMIT} THEN 1.0 ELSE 0.0 END), 6) AS exceed_fraction FROM obs WHERE {VALID} AND NOT {SUSPECT} GROUP BY 1""")
def _(spark, sf):
    return round_all(S.exceedance(obs(spark, sf), LIMIT, True))


DURATION = OBS + f""", seq AS (SELECT *, lead(timestamp) OVER (PARTITION BY metric_id ORDER BY timestamp, source_row) AS nx FROM obs
  WHERE timestamp >= TIMESTAMP '{MIDDLE}' - INTERVAL 10 MINUTE AND timestamp < TIMESTAMP '{END}'),
d AS (SELECT *, greatest(0, (epoch_us(least(coalesce(nx, timestamp + INTERVAL 10 MINUTE), timestamp + INTERVAL 10 MINUTE, TIMESTAMP '{END}'))
  - epoch_us(greatest(timestamp, TIMESTAMP '{MIDDLE}'))) / 60000000.0) AS m FROM seq),
u AS (SELECT metric_id, coalesce(sum(m) FILTER (WHERE {VALID} AND NOT {SUSPECT}), 0) AS o,
  coalesce(sum(m) FILTER (WHERE {VALID} AND NOT {SUSPECT} AND value > {LIMIT}), 0) AS e,
  coalesce(sum(m) FILTER (WHERE {SUSPECT}), 0) AS s FROM d GROUP BY 1)
"""


@query("exceedance_minutes", "A4 W10", DURATION + """SELECT metric_id, round(o, 6) AS observed_minutes, round(e, 6) AS exceed_minutes,
  round(s, 6) AS suspect_minutes, round(o / (15 * 1440), 6) AS coverage FROM u""")
def _(spark, sf):
    return round_all(S.durations(obs(spark, sf, BEFORE_MIDDLE, END), us(MIDDLE), us(END), LIMIT))


@query("time_composition", "A5", DURATION + """, p AS (SELECT metric_id, least(greatest(e, 0), 21600.0) AS a, o, s FROM u),
  p2 AS (SELECT *, least(greatest(o - a, 0), 21600.0 - a) AS b FROM p),
  p3 AS (SELECT *, least(greatest(s, 0), 21600.0 - a - b) AS q FROM p2)
  SELECT metric_id, part, round(minutes, 6) AS minutes, round(minutes / 21600.0 * 100, 6) AS percent FROM (
    SELECT metric_id, 'below' AS part, b AS minutes FROM p3 UNION ALL SELECT metric_id, 'above', a FROM p3
    UNION ALL SELECT metric_id, 'suspect', q FROM p3 UNION ALL SELECT metric_id, 'missing', greatest(0, 21600.0 - a - b - q) FROM p3)""")
def _(spark, sf):
    d = S.durations(obs(spark, sf, BEFORE_MIDDLE, END), us(MIDDLE), us(END), LIMIT)
    return round_all(S.composition(d, 21600.0))


@query("source_agreement", "A6 J1", OBS + f""", l AS (SELECT timestamp, value FROM obs WHERE metric_id = '{LAB}' AND {VALID} AND NOT {SUSPECT}),
  p0 AS (SELECT timestamp, value FROM obs WHERE metric_id = '{ANALYSER}' AND {VALID} AND NOT {SUSPECT}
     QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY source_row DESC) = 1)
  SELECT count(*) AS n, round(avg(p0.value - l.value), 6) AS bias, round(avg(abs(p0.value - l.value)), 6) AS mae
  FROM l ASOF JOIN p0 ON l.timestamp >= p0.timestamp WHERE l.timestamp - p0.timestamp <= INTERVAL 10 MINUTE""")
def _(spark, sf):
    ok = obs(spark, sf).filter(C.is_valid("value", "flags", True)).select("metric_id", "t", "value", "source_row")
    return round_all(S.agreement(ok.filter(F.col("metric_id") == LAB).drop("metric_id"), ok.filter(F.col("metric_id") == ANALYSER).drop("metric_id")))


@query("value_histogram", "A7", OBS + f""", v AS (SELECT metric_id, value FROM obs WHERE {VALID}),
  m AS (SELECT metric_id, min(value) AS lo, max(value) AS hi, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) / 20 ELSE 1.0 END AS w FROM v GROUP BY 1),
  n AS (SELECT v.metric_id, least(19, CAST(floor((value - lo) / w) AS INTEGER)) AS bin, count(*) AS c FROM v JOIN m USING (metric_id) GROUP BY 1, 2)
  SELECT m.metric_id, CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 6) AS "from", round(lo + (g.bin + 1) * w, 6) AS "to", coalesce(c, 0) AS count
  FROM m CROSS JOIN range(20) g(bin) LEFT JOIN n ON n.metric_id = m.metric_id AND n.bin = g.bin WHERE hi > lo OR g.bin = 0""")
def _(spark, sf):
    return round_all(S.histogram(obs(spark, sf)))


@query("quartiles", "A8", OBS + f"""SELECT metric_id, round(quantile_cont(value, 0.0), 6) AS q0, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 1.0), 6) AS q4
  FROM obs WHERE {VALID} GROUP BY 1""")
def _(spark, sf):
    from ..operators.quantiles import quantiles
    return round_all(quantiles(obs(spark, sf).filter(C.is_valid()), ["metric_id"], "value", [0, .25, .5, .75, 1], ["q0", "q1", "q2", "q3", "q4"]))


POINTS = 300
WIDTH = 15 * 86400 / POINTS
DOWN = OBS + f""", r AS (SELECT *, CASE WHEN {VALID} THEN value END AS v, count(*) OVER (PARTITION BY metric_id) AS n FROM obs
    WHERE timestamp >= TIMESTAMP '{MIDDLE}' AND timestamp < TIMESTAMP '{END}'),
  b AS (SELECT *, floor((epoch_us(timestamp) - epoch_us(TIMESTAMP '{MIDDLE}')) / 1000000.0 / {WIDTH}) AS k FROM r WHERE n > {POINTS}),
  p AS (SELECT metric_id, timestamp, v AS value, v AS min, v AS max, flags, CAST(1 AS BIGINT) AS count, FALSE AS aggregated FROM r WHERE n <= {POINTS}
    UNION ALL SELECT metric_id, min(timestamp), quantile_cont(v, 0.5), min(v), max(v),
      coalesce(string_agg(DISTINCT flags, '|' ORDER BY flags) FILTER (WHERE flags <> ''), ''), count(v), TRUE FROM b GROUP BY metric_id, k)
"""


@query("downsampled_series", "A9", DOWN + f"""SELECT metric_id, {ts_text('timestamp')} AS timestamp, round(value, 6) AS value, round(min, 6) AS min,
  round(max, 6) AS max, flags, count, aggregated FROM p""")
def _(spark, sf):
    d = S.downsample(obs(spark, sf, MIDDLE, END), us(MIDDLE), us(END), POINTS)
    return round_all(d.withColumn("timestamp", C.from_micros("t")).drop("t"))


@query("downsampled_series_with_gaps", "W8", DOWN + f""", g AS (SELECT *, lag(timestamp) OVER (PARTITION BY metric_id ORDER BY timestamp, value) AS pv FROM p),
  z AS (SELECT metric_id, timestamp, value, min, max, flags, count, aggregated FROM g UNION ALL
   SELECT metric_id, pv + to_microseconds(CAST({max(600.0, WIDTH)} * 1000000 AS BIGINT)), NULL, NULL, NULL, 'gap', 0, aggregated FROM g
   WHERE epoch_us(timestamp) - epoch_us(pv) > {max(1200.0, 2 * WIDTH)} * 1000000)
  SELECT metric_id, {ts_text('timestamp')} AS timestamp, round(value, 6) AS value, round(min, 6) AS min, round(max, 6) AS max, flags, count, aggregated FROM z""")
def _(spark, sf):
    d = S.gap_markers(S.downsample(obs(spark, sf, MIDDLE, END), us(MIDDLE), us(END), POINTS), us(MIDDLE), us(END), POINTS)
    return round_all(d.withColumn("timestamp", C.from_micros("t")).drop("t"))


SNAP = OBS + f""", two AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY timestamp DESC, source_row DESC) AS rn FROM obs
    WHERE timestamp <= TIMESTAMP '{AT}' AND (source <> 'lims' OR timestamp <= TIMESTAMP '{AT}' - INTERVAL 240 MINUTE)),
  a AS (SELECT * FROM two WHERE rn = 1), b AS (SELECT * FROM two WHERE rn = 2),
  snap AS (SELECT a.metric_id, a.source, CASE WHEN contains(a.flags, 'invalid') OR contains(a.flags, 'conflict') THEN NULL ELSE a.value END AS value,
    a.timestamp, (epoch_us(TIMESTAMP '{AT}') - epoch_us(a.timestamp)) / 60000000.0 AS age_minutes, a.flags,
    CASE WHEN (epoch_us(TIMESTAMP '{AT}') - epoch_us(a.timestamp)) / 60000000.0 <= CASE a.source WHEN 'kip' THEN 10 WHEN 'pak' THEN 30 ELSE 2880 END THEN 'fresh' ELSE 'stale' END AS freshness,
    CASE WHEN contains(a.flags, 'invalid') OR contains(b.flags, 'invalid') OR contains(a.flags, 'conflict') OR contains(b.flags, 'conflict') THEN NULL ELSE a.value - b.value END AS delta,
    CASE WHEN a.source = 'lims' THEN a.timestamp + INTERVAL 240 MINUTE ELSE a.timestamp END AS available_at
    FROM a LEFT JOIN b USING (metric_id))
"""
# A catalog entry that never reports: it must show up as missing.
CATALOG = {"ev.click": "kip", "ev.error": "kip", "ev.signup": "kip", "ev.view": "pak", "ev.purchase": "lims", "ev.refund": "lims"}
CATALOG_SNAP = SNAP + ", cat(metric_id, source) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CATALOG.items()) + """), full_snap AS (
  SELECT cat.metric_id, cat.source, value, timestamp, age_minutes, coalesce(flags, '') AS flags, coalesce(freshness, 'missing') AS freshness, delta, available_at,
    CASE WHEN timestamp IS NULL THEN 'no_reading' WHEN value IS NULL THEN 'not_usable' WHEN freshness = 'stale' THEN 'older_than_limit' ELSE '' END AS reason FROM cat LEFT JOIN snap USING (metric_id))
"""


def snap_at(spark, sf):
    known = spark.createDataFrame(list(CATALOG.items()), "metric_id string, source string")
    return S.snapshot(obs(spark, sf, None, AFTER_AT), us(AT), freshness(spark), catalog=known)


@query("snapshot_at_moment", "W1 S13", CATALOG_SNAP + f"""SELECT metric_id, source, round(value, 6) AS value, {ts_text('timestamp')} AS timestamp,
  round(age_minutes, 6) AS age_minutes, flags, freshness, round(delta, 6) AS delta, {ts_text('available_at')} AS available_at, reason FROM full_snap""")
def _(spark, sf):
    return round_all(snap_at(spark, sf))


@query("snapshot_alerts", "Q18", CATALOG_SNAP + """SELECT metric_id, 'danger' AS severity, 'above_limit' AS code FROM full_snap WHERE value > 30
  UNION ALL SELECT metric_id, 'warning', CASE freshness WHEN 'stale' THEN 'not_fresh' ELSE 'missing' END FROM full_snap WHERE freshness <> 'fresh'
  UNION ALL SELECT metric_id, 'warning', 'flagged' FROM full_snap WHERE flags <> ''""")
def _(spark, sf):
    return S.snapshot_alerts(snap_at(spark, sf), list(CATALOG), 30.0)


VIRTUAL = OBS + f""", va AS (SELECT metric_id, timestamp, value, flags, source_row FROM obs
  UNION ALL SELECT 'derived.margin.' || metric_id, timestamp, CASE WHEN {VALID} THEN {LIMIT} - value END, flags, source_row FROM obs WHERE metric_id IN ('{LAB}', '{ANALYSER}')
  UNION ALL SELECT 'derived.excess.' || metric_id, timestamp, CASE WHEN {VALID} THEN greatest(value - {LIMIT}, 0) END, flags, source_row FROM obs WHERE metric_id IN ('{LAB}', '{ANALYSER}')
  UNION ALL SELECT 'derived.click_minus_signup', a.timestamp, a.value - b.value, concat_ws('|', nullif(a.flags, ''), nullif(b.flags, '')), a.source_row
    FROM obs a JOIN obs b ON a.timestamp = b.timestamp AND a.metric_id = 'ev.click' AND b.metric_id = 'ev.signup')
"""


def with_virtual(o):
    cols = ["metric_id", "t", "timestamp", "value", "flags", "source_row"]
    o = o.select(*cols)
    return (o.unionByName(S.virtual_limit_metrics(o, [LAB, ANALYSER], LIMIT))
            .unionByName(S.virtual_difference(o, "ev.click", "ev.signup", "derived.click_minus_signup")))


@query("virtual_metrics", "P1 P2 U1 J3", VIRTUAL + """SELECT metric_id, count(*) AS n, count(value) AS n_value, round(sum(value), 4) AS total, round(min(value), 6) AS min, round(max(value), 6) AS max,
  count(*) FILTER (WHERE contains(flags, 'suspect')) AS n_suspect FROM va GROUP BY 1""")
def _(spark, sf):
    return with_virtual(obs(spark, sf)).groupBy("metric_id").agg(
        F.count("*").alias("n"), F.count("value").alias("n_value"), rounded(F.sum("value"), 4).alias("total"), rounded(F.min("value")).alias("min"),
        rounded(F.max("value")).alias("max"), F.count_if(C.has_flag("flags", "suspect")).alias("n_suspect"))


@query("fraction_curve", "A10 A11 T2", OBS + f""", d(metric_id, fraction) AS (VALUES ('ev.click', 0), ('ev.view', 50), ('ev.error', 90), ('ev.signup', 95)),
  k AS (SELECT o.metric_id, o.timestamp, o.value, o.source_row, d.fraction FROM obs o JOIN d USING (metric_id) WHERE {VALID} AND NOT {SUSPECT} AND timestamp <= TIMESTAMP '{AT}'),
  n AS (SELECT timestamp FROM k GROUP BY 1 HAVING count(DISTINCT metric_id) >= 2 ORDER BY 1 DESC LIMIT 1),
  p AS (SELECT timestamp, metric_id, fraction, arg_max(value, source_row) AS value FROM k JOIN n USING (timestamp) GROUP BY 1, 2, 3),
  u AS (SELECT *, coalesce(value >= lag(value) OVER (ORDER BY fraction), TRUE) AS up FROM p)
  SELECT {ts_text('timestamp')} AS timestamp, metric_id, CAST(fraction AS INTEGER) AS fraction, round(value, 6) AS value, bool_and(up) OVER () AS monotonic,
    round((epoch_us(TIMESTAMP '{AT}') - epoch_us(timestamp)) / 60000000.0, 6) AS age_minutes FROM u""")
def _(spark, sf):
    dim = spark.createDataFrame([("ev.click", 0), ("ev.view", 50), ("ev.error", 90), ("ev.signup", 95)], "metric_id string, fraction int")
    return round_all(S.fraction_curve(obs(spark, sf), dim, us(AT)))
