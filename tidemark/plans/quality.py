"""Quality reports, profiling, status findings, operating state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features as X
from ..operators import quality as Q
from ..operators import series as S
from .adapter import ANALYSER, LAB, OBS, SECOND_ANALYSER, SUSPECT, VALID, obs, table, ts_text
from .features import CONTROL_MAP, DYN, ORIGINS, asof_sql, clean, lab_origins
from .registry import query, rounded
from .series import SNAP, freshness, round_all, us
from .adapter import AFTER_AT, AT

M, H = C.MINUTE, C.HOUR


@query("metric_quality", "Q12 S7", OBS + f"""SELECT metric_id, count(*) AS count, count(*) FILTER (WHERE NOT {VALID}) AS invalid_count, count(*) FILTER (WHERE {SUSPECT}) AS suspect_count,
   count(*) FILTER (WHERE contains(flags, 'flatline')) AS flatline_count, {ts_text('min(timestamp)')} AS start, {ts_text('max(timestamp)')} AS "end" FROM obs GROUP BY 1""")
def _(spark, sf):
    return Q.metric_quality(obs(spark, sf))


@query("suspect_ranking", "Q13 T3", OBS + f"""SELECT metric_id, count(*) FILTER (WHERE {SUSPECT}) AS suspect_count, round(100.0 * count(*) FILTER (WHERE {SUSPECT}) / count(*), 6) AS percentage FROM obs GROUP BY 1
   HAVING count(*) FILTER (WHERE {SUSPECT}) > 0 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 3""")
def _(spark, sf):
    return round_all(Q.suspect_ranking(Q.metric_quality(obs(spark, sf)), 3).select("metric_id", "suspect_count", "percentage"))


@query("signal_overview", "Q10", OBS + f""", q AS (SELECT metric_id, count(*) AS n, count(*) FILTER (WHERE NOT {VALID}) AS i, count(*) FILTER (WHERE {SUSPECT}) AS s FROM obs GROUP BY 1)
   SELECT count(*) AS metrics, count(*) FILTER (WHERE n > 0) AS covered, CAST(sum(i) AS BIGINT) AS invalid, CAST(sum(s) AS BIGINT) AS suspect, count(*) FILTER (WHERE i > 0 OR s > 0) AS to_check FROM q""")
def _(spark, sf):
    return Q.metric_quality(obs(spark, sf)).agg(
        F.count("*").alias("metrics"), F.count_if(F.col("count") > 0).alias("covered"), F.sum("invalid_count").alias("invalid"), F.sum("suspect_count").alias("suspect"),
        F.count_if((F.col("invalid_count") > 0) | (F.col("suspect_count") > 0)).alias("to_check"))


@query("duplicate_time_audit", "Q17", OBS + """, p AS (SELECT metric_id, timestamp, count(*) AS n FROM obs GROUP BY 1, 2)
   SELECT metric_id, CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_times, count(*) FILTER (WHERE n > 1) AS repeated_times, CAST(sum(n) - count(*) AS BIGINT) AS surplus_rows FROM p GROUP BY 1""")
def _(spark, sf):
    return Q.duplicate_times(obs(spark, sf), ["metric_id"])


@query("operator_findings", "Q19", SNAP + f""", v AS (SELECT *, value IS NOT NULL AS present, value IS NOT NULL AND freshness = 'fresh' AND flags = '' AS reliable FROM snap WHERE metric_id IN ('{LAB}', '{ANALYSER}')),
   ag AS (SELECT count(*) FILTER (WHERE present) AS p, count(*) FILTER (WHERE reliable) AS r, count(*) FILTER (WHERE reliable AND value > 5) AS x FROM v),
   k AS (SELECT metric_id FROM snap WHERE source = 'kip' AND flags <> '')
   SELECT code, level, priority FROM (SELECT 'exceeded' AS code, 'danger' AS level, 0 AS priority FROM ag WHERE x > 0 UNION ALL SELECT 'unreliable', 'warning', 1 FROM ag WHERE p > r
    UNION ALL SELECT 'missing', 'unknown', 2 FROM ag WHERE p = 0 UNION ALL SELECT 'signal:' || metric_id, 'warning', 1 FROM k)""")
def _(spark, sf):
    snap = S.snapshot(obs(spark, sf, None, AFTER_AT), us(AT), freshness(spark))
    watched = F.col("metric_id").isin(LAB, ANALYSER)
    present = watched & F.col("value").isNotNull()
    reliable = present & (F.col("freshness") == "fresh") & (F.col("flags") == "")
    a = snap.agg(F.count_if(present).alias("p"), F.count_if(reliable).alias("r"), F.count_if(reliable & (F.col("value") > 5)).alias("x"))
    rule = lambda cond, code, level, rank: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(rank).alias("priority")))
    main = a.select(F.inline(F.array_compact(F.array(
        rule(F.col("x") > 0, "exceeded", "danger", 0), rule(F.col("p") > F.col("r"), "unreliable", "warning", 1), rule(F.col("p") == 0, "missing", "unknown", 2),
        rule((F.col("p") > 0) & (F.col("r") == 0) & (F.col("p") == F.col("r")), "insufficient", "unknown", 2)))))
    signals = snap.filter("source = 'kip' AND flags <> ''").select(F.concat(F.lit("signal:"), "metric_id").alias("code"), F.lit("warning").alias("level"), F.lit(1).alias("priority"))
    return main.unionByName(signals).orderBy("priority", "code")


SEQ = """WITH s AS (SELECT event_id, ts, floor(value / 50) AS value, user_id FROM events)"""


@query("constant_runs", "A28 T3", SEQ + """, a AS (SELECT *, CASE WHEN value = lag(value) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS b FROM s), g AS (SELECT *, sum(b) OVER (ORDER BY event_id) AS run FROM a)
   SELECT min(event_id) AS run_start, max(event_id) AS run_end, min(value) AS value, count(*) AS rows FROM g GROUP BY run ORDER BY rows DESC, run_start LIMIT 10""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.lit(0).alias("k"), "event_id", F.floor(F.col("value") / 50).cast("double").alias("value"))
    r = Q.constant_runs(e, ["k"], "event_id", "value", 5000)
    return r.orderBy(F.col("rows").desc(), "run_start").limit(10).select("run_start", "run_end", "value", "rows")


def profile_sql(col):
    return f"""SELECT '{col}' AS name, count(x) AS count, count(*) - count(x) AS missing, count(DISTINCT x) AS nunique, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max,
  count(*) FILTER (WHERE x = 0) AS zero_count, count(*) FILTER (WHERE x < 0) AS negative_count, round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS median,
  round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, (SELECT max(n) FROM (SELECT run, count(*) AS n FROM g_{col} GROUP BY run)) AS longest_constant_rows,
  round((SELECT avg(1 - b) FROM g_{col}), 6) AS unchanged_adjacent_fraction FROM g_{col}"""


def island_cte(col, expr):
    return f"""a_{col} AS (SELECT event_id, x, CASE WHEN x = lag(x) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS b FROM (SELECT event_id, {expr} AS x FROM events)),
  g_{col} AS (SELECT *, sum(b) OVER (ORDER BY event_id) AS run FROM a_{col})"""


@query("column_profile", "A26", f"WITH {island_cte('value', 'floor(value)')}, {island_cte('user_id', 'CAST(user_id AS DOUBLE) - 3')} {profile_sql('value')} UNION ALL {profile_sql('user_id')}")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor("value").cast("double").alias("value"), (F.col("user_id").cast("double") - 3).alias("user_id"))
    long = e.unpivot(["event_id"], ["value", "user_id"], "name", "x")
    return round_all(Q.column_profile(long, ["name"], "event_id", "x", 5000))


@query("non_numeric_values", "A26 T3", """WITH v AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE CAST(l_quantity AS VARCHAR) END AS x FROM lineitem) SELECT x AS text, count(*) AS n FROM v WHERE TRY_CAST(x AS DOUBLE) IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def _(spark, sf):
    x = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_quantity").cast("string"))
    v = table(spark, sf, "lineitem").select(x.alias("text")).filter(C.parse_number("text").isNull() & F.col("text").isNotNull())
    return v.groupBy("text").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "text").limit(8)


@query("time_axis_profile", "A27", OBS + f""", d AS (SELECT metric_id, timestamp, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY metric_id ORDER BY timestamp, source_row)) / 1000000.0 AS step FROM obs)
   SELECT metric_id, {ts_text('min(timestamp)')} AS start, {ts_text('max(timestamp)')} AS "end", count(*) FILTER (WHERE step = 0) AS duplicate_timestamps, round(max(step) / 3600, 6) AS max_gap_hours,
   round(quantile_cont(step, 0.5), 6) AS median_step_seconds FROM d GROUP BY 1""")
def _(spark, sf):
    return round_all(Q.time_profile(obs(spark, sf), ["metric_id"], width=6 * H))


@query("step_sizes", "A27 T3", OBS + """, d AS (SELECT metric_id, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY metric_id ORDER BY timestamp, source_row)) / 1000000.0 AS step FROM obs),
   n AS (SELECT metric_id, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY 1, 2) SELECT metric_id, step AS step_seconds, n FROM n QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY n DESC, step) <= 8""")
def _(spark, sf):
    return Q.step_counts(obs(spark, sf), ["metric_id"], 8, width=6 * H)


@query("largest_gaps", "A31", OBS + f""", u AS (SELECT DISTINCT metric_id, timestamp FROM obs), d AS (SELECT metric_id, lag(timestamp) OVER (PARTITION BY metric_id ORDER BY timestamp) AS pv, timestamp FROM u)
   SELECT metric_id, {ts_text('pv')} AS previous_time, {ts_text('timestamp')} AS time, round((epoch_us(timestamp) - epoch_us(pv)) / {H}.0, 6) AS gap_hours FROM d WHERE pv IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY epoch_us(timestamp) - epoch_us(pv) DESC, timestamp) <= 5""")
def _(spark, sf):
    return round_all(Q.largest_gaps(obs(spark, sf), ["metric_id"], 5, width=6 * H))


@query("monthly_profile", "A25 A31", """SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS month, count(*) AS rows, count(*) FILTER (WHERE l_discount > 0) AS valid, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
   round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(avg(CASE WHEN l_discount > 0 THEN 0.0 ELSE 1.0 END), 6) AS missing_share, count(*) FILTER (WHERE l_extendedprice > 100000) AS above FROM lineitem GROUP BY 1""")
def _(spark, sf):
    from ..operators.quantiles import quantiles
    l = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice", "l_discount")
    base = l.groupBy("month").agg(F.count("*").alias("rows"), F.count_if(F.col("l_discount") > 0).alias("valid"), F.avg(F.when(F.col("l_discount") > 0, 0.0).otherwise(1.0)).alias("missing_share"),
                                  F.count_if(F.col("l_extendedprice") > 100000).alias("above"))
    return round_all(base.join(quantiles(l, ["month"], "l_extendedprice", [0.5, 0.95], ["median", "p95"]), "month"))


@query("yearly_profile", "A31 A36", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 6) AS median, count(*) FILTER (WHERE o_totalprice > 400000) AS above,
   round(avg(CASE WHEN o_totalprice > 400000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders GROUP BY 1""")
def _(spark, sf):
    from ..operators.quantiles import quantiles
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    base = o.groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("above"), F.avg(F.when(F.col("o_totalprice") > 400000, 1.0).otherwise(0.0)).alias("share"))
    return round_all(base.join(quantiles(o, ["year"], "o_totalprice", [0.5], ["median"]), "year"))


@query("largest_values", "A31 T3", "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(8)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_ranking", "A29", "SELECT name, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS name, corr(l_extendedprice, {m}) AS r FROM lineitem" for m in ("l_quantity", "l_discount", "l_tax")) + ")")
def _(spark, sf):
    return round_all(Q.correlations(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query("near_duplicate_signals", "A29", """SELECT 'b|a' AS pair, round(corr(value, 2 * value + user_id / 1000.0), 6) AS r FROM events WHERE (SELECT abs(corr(value, 2 * value + user_id / 1000.0)) FROM events) > 0.995 LIMIT 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("value").alias("a"), (2 * F.col("value") + F.col("user_id") / 1000.0).alias("b"), F.col("user_id").cast("double").alias("c"))
    return round_all(Q.correlated_pairs(e, ["a", "b", "c"]))


@query("analyser_correlation", "J11 A29", OBS + """, w AS (SELECT t, max(value) FILTER (WHERE metric_id = 'ev.view') AS y, max(value) FILTER (WHERE metric_id = 'ev.click') AS click, max(value) FILTER (WHERE metric_id = 'ev.error') AS error,
   max(value) FILTER (WHERE metric_id = 'ev.signup') AS signup FROM clean GROUP BY 1) SELECT name, r FROM (SELECT 'click' AS name, round(corr(y, click), 6) AS r FROM w UNION ALL SELECT 'error', round(corr(y, error), 6) FROM w UNION ALL SELECT 'signup', round(corr(y, signup), 6) FROM w) WHERE r IS NOT NULL AND NOT isnan(r)""")
def _(spark, sf):
    names = {"y": "ev.view", "click": "ev.click", "error": "ev.error", "signup": "ev.signup"}
    w = clean(spark, sf).groupBy("t").agg(*[F.max(F.when(F.col("metric_id") == m, F.col("value"))).alias(n) for n, m in names.items()])
    return round_all(Q.correlations(w, "y", ["click", "error", "signup"]))


PAIRS = ORIGINS + f""", pr AS (SELECT lab.t, lab.value AS lab, {asof_sql(ANALYSER, 'lab.t', 30 * M)} AS an FROM lab)"""


def agreement_pairs(spark, sf):
    from .features import labs
    l = labs(spark, sf).withColumnRenamed("t", "origin")
    hit = X.lookup(l.select("origin"), clean(spark, sf), {"an": (ANALYSER, 0)})
    return l.join(hit, "origin").select("origin", F.col("value").alias("lab"), "an")


@query("agreement_under_caps", "A30", PAIRS + """, c(cap) AS (VALUES (CAST(NULL AS DOUBLE)), (100.0), (20.0))
   SELECT cap, count(*) AS n, round(avg(abs(an - lab)), 6) AS mae, round(quantile_cont(abs(an - lab), 0.5), 6) AS median_absolute_error, round(avg(an - lab), 6) AS bias, round(corr(lab, an), 6) AS correlation,
   count(*) FILTER (WHERE (lab > 10) <> (an > 10)) AS disagree FROM pr JOIN c ON cap IS NULL OR lab <= cap WHERE an IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    from ..operators.quantiles import quantiles
    caps = F.array_compact(F.array(F.lit(-1.0), F.when(F.col("lab") <= 100, F.lit(100.0)), F.when(F.col("lab") <= 20, F.lit(20.0))))
    p = agreement_pairs(spark, sf).filter("an IS NOT NULL").withColumn("cap", F.explode(caps)).withColumn("e", F.col("an") - F.col("lab")).withColumn("ae", F.abs("e"))
    g = p.groupBy("cap").agg(F.count("*").alias("n"), F.avg("ae").alias("mae"), F.avg("e").alias("bias"), F.corr("lab", "an").alias("correlation"),
                             F.count_if((F.col("lab") > 10) != (F.col("an") > 10)).alias("disagree"))
    g = g.join(quantiles(p, ["cap"], "ae", [0.5], ["median_absolute_error"]), "cap")
    return round_all(g.withColumn("cap", F.when(F.col("cap") > 0, F.col("cap"))))


@query("row_count_reconciliation", "A37", """SELECT o_orderpriority AS series, count(DISTINCT o_orderkey) AS declared, count(l_orderkey) AS actual, count(*) FILTER (WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31') AS within_span
   FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    inside = F.col("l_shipdate").between(F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ'2000-12-31 00:00:00'"))
    per = l.groupBy("l_orderkey").agg(F.count("*").alias("a"), F.count_if(inside).alias("w"))
    return o.join(per, o.o_orderkey == per.l_orderkey, "left").groupBy(F.col("o_orderpriority").alias("series")).agg(
        F.count("*").alias("declared"), F.coalesce(F.sum("a"), F.lit(0)).alias("actual"), F.coalesce(F.sum("w"), F.lit(0)).alias("within_span"))


@query("same_time_axis", "U5", OBS + """, a AS (SELECT DISTINCT timestamp FROM obs WHERE metric_id = 'ev.view'), b AS (SELECT DISTINCT timestamp FROM obs WHERE metric_id = 'ev.click')
   SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_second""")
def _(spark, sf):
    side = F.max(F.col("metric_id") == ANALYSER).alias("a"), F.max(F.col("metric_id") == SECOND_ANALYSER).alias("b")
    t = obs(spark, sf).filter(F.col("metric_id").isin(ANALYSER, SECOND_ANALYSER)).groupBy("t").agg(*side)
    return t.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("b") & ~F.col("a")).alias("only_second"))


@query("operating_state", "Q21 Q22", DYN + """, ref AS (SELECT avg(T) AS mt, stddev_pop(T) AS st, avg(F) AS mf, stddev_pop(F) AS sf, avg(P) AS mp, stddev_pop(P) AS sp FROM dyn),
   s AS (SELECT origin, F / mf AS share, CASE WHEN T IS NOT NULL AND P IS NOT NULL AND F IS NOT NULL THEN greatest(greatest(0, (T - mt) / st), greatest(0, (P - mp) / sp), greatest(0, (F - mf) / sf)) / 12 END AS sev FROM dyn, ref)
   SELECT strftime(make_timestamp(origin), '%Y-%m-%d %H:%M:%S') AS origin, CASE WHEN share IS NULL THEN 'unknown' WHEN share < 0.1 THEN 'shutdown' WHEN share < 0.6 THEN 'transition' ELSE 'normal' END AS state, round(sev, 6) AS severity,
   CASE WHEN sev > 2.0 / 3 THEN 'high' WHEN sev > 1.0 / 3 THEN 'elevated' WHEN sev IS NOT NULL THEN 'normal' END AS class FROM s""")
def _(spark, sf):
    s = clean(spark, sf)
    f = X.lookup(X.origin_grid(s), s, {k: (m, 0) for k, m in CONTROL_MAP.items()})
    ref = f.agg(*[e for k in "TFP" for e in (F.avg(k).alias(f"m{k}"), F.stddev_pop(k).alias(f"s{k}"))])
    d = f.join(F.broadcast(ref))
    d = d.withColumn("severity", Q.load_severity({k: (k, f"m{k}", f"s{k}") for k in "TFP"}))
    return round_all(d.select(C.from_micros("origin").alias("origin"), Q.operating_state("F", "mF").alias("state"), "severity", Q.severity_class("severity").alias("class")))


@query("formula_inputs_pivot", "J12", OBS + f"""SELECT {ts_text('timestamp')} AS timestamp, max(value) FILTER (WHERE metric_id = 'ev.click') AS "T1", max(value) FILTER (WHERE metric_id = 'ev.error') AS "F1", max(value) FILTER (WHERE metric_id = 'ev.signup') AS "F2"
   FROM clean WHERE metric_id IN ('ev.click', 'ev.error', 'ev.signup') GROUP BY timestamp""")
def _(spark, sf):
    w = clean(spark, sf).filter(F.col("metric_id").isin("ev.click", "ev.error", "ev.signup")).groupBy("t").pivot("metric_id", ["ev.click", "ev.error", "ev.signup"]).agg(F.max("value"))
    return w.select(C.from_micros("t").alias("timestamp"), F.col("`ev.click`").alias("T1"), F.col("`ev.error`").alias("F1"), F.col("`ev.signup`").alias("F2"))
