"""Decision queries over moments taken from the purchase events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import decide as K
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import quality as Q
from ..operators.stage import staged
from .adapter import LAB, table, ts_text
from .evaluate import reg
from .features import GRID, asof_sql, clean
from .registry import query, rounded
from .series import round_all

LEVELS = [k / 100 for k in range(5, 100, 5)]

QF = ", ".join(f"quantile_cont(r, {p}) AS q{i}" for i, p in enumerate(LEVELS))
PROB = "1 - (0.05 + " + " + ".join(f"0.05 * greatest(0, least(1, (g - q{i}) / (q{i + 1} - q{i})))" for i in range(18)) + ")"
MOM = f"""WITH mo AS (SELECT event_id AS moment, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 6 END AS lab, value / 6 AS base0, 330.0 + user_id % 50 AS T, 150.0 + event_id % 100 AS F, 4 + (user_id % 7) / 10.0 AS P, event_id % 4 AS q, user_id % 10 AS u FROM events WHERE event_type = 'purchase'),
  ref AS (SELECT avg(T) AS mt, stddev_pop(T) AS st, avg(F) AS mf, stddev_pop(F) AS sf, avg(P) AS mp, stddev_pop(P) AS sp FROM mo),
  qf AS (SELECT {QF} FROM (SELECT (ln(l_quantity * (1 + l_discount) + l_tax * 10) - ln(l_extendedprice / 1000)) / 4 AS r FROM lineitem WHERE NOT (l_linenumber = 7 AND l_returnflag = 'N') AND l_extendedprice > 0 AND l_quantity > 0)),
  m AS (SELECT mo.*, base0 AS base, ref.*, qf.* FROM mo, ref, qf)
"""


def moments(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'purchase'")
    i, u = F.col("event_id"), F.col("user_id")
    m = e.select(i.alias("moment"), (F.col("value") / 6).alias("base"), (330.0 + u % 50).alias("T"), (150.0 + i % 100).alias("F"), (4 + (u % 7) / 10.0).alias("P"),
                 (i % 4).alias("q"), (u % 10).alias("u"))
    ref = m.agg(*[x for k in "TFP" for x in (F.avg(k).alias(f"mean_{k}"), F.stddev_pop(k).alias(f"std_{k}"))])
    return m.join(F.broadcast(ref))  # one row: reference means and deviations


def policy(spark, sf):
    """The residual quantile function, a model artefact of 19 numbers, read back for the policy."""
    r = reg(spark, sf).filter("p IS NOT NULL AND y > 0 AND p > 0").select(F.lit(0).alias("g"), ((F.ln("p") - F.ln("y")) / 4).alias("r"))
    rows = sorted(E.residual_quantiles(r, ["g"], "r", LEVELS).collect(), key=lambda x: x["probability"])
    return K.Policy([x["probability"] for x in rows], [x["quantile"] for x in rows])


def move_sql(src, dt="dT", df="dF", dp="dP"):
    return f"""SELECT *, 1 + dF / 100 AS throughput, 1 + 0.10 * dT / 10 + 0.05 * dP / 2 + 0.10 * dF / 10 AS energy, {PROB} AS probability FROM (SELECT *, ln(10.0) - ln(greatest(product, 0.001)) AS g,
      greatest(0, (T + dT - mt) / st, (P + dP - mp) / sp, (F * (1 + dF / 100) - mf) / sf) / 12 AS severity, round(abs(dT) / 10 + abs(dF) / 10 + abs(dP) / 2, 4) AS effort FROM (SELECT *, greatest(0, base + greatest(-0.08 * dT, -0.02 * dT * base) + greatest(0.05 * dF, 0.01 * dF * base) + greatest(-0.15 * dP, -0.05 * dP * base)) AS product FROM {src}))"""


LOSS = "0.5 * (1 - throughput) / 0.10 + (energy - 1) + 0.25 * severity + 0.05 * effort + 0.25 * probability / 0.2"
DENSE = """SELECT a.range / 2::DOUBLE AS dT, b.range::DOUBLE AS dF, c.range * 0.05::DOUBLE AS dP FROM range(-12, 13) a, range(-10, 11) b, range(-4, 5) c"""
COARSE = """SELECT a.range::DOUBLE AS dT, b.range::DOUBLE AS dF, c.p AS dP FROM range(-6, 7) a, range(-10, 11) b, (VALUES (-0.2::DOUBLE), (-0.1), (0.0), (0.1), (0.2)) c(p)"""


def grid_sql(moves, skip="dT = 0 AND dF = 0 AND dP = 0"):
    return f""", gr AS (SELECT row_number() OVER (ORDER BY dT, dF, dP) - 1 AS i, dT, dF, dP FROM ({moves}) WHERE NOT ({skip})),
  mg AS (SELECT m.*, gr.* FROM m, gr), sc AS ({move_sql('mg')}), l AS (SELECT *, {LOSS} AS loss, dT >= 0 AND dF <= 0 AND dP >= 0 AS fix FROM sc),
  ok AS (SELECT *, CAST(floor((loss + 500) * 1e12 + 0.5) AS BIGINT) AS lk FROM l WHERE probability <= 0.2 + 1e-9 AND product <= 10 AND severity <= 1 AND (fix OR probability <= 0.1 + 1e-9)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY moment, fix ORDER BY lk, effort, i) AS rn FROM ok), ad AS (SELECT moment, count(*) AS admissible FROM ok GROUP BY 1)
"""


GRID_SQL = MOM + grid_sql(COARSE)


@query("grid_search", "K6 K17", GRID_SQL + """SELECT m.moment, coalesce(admissible, 0) AS admissible, c.dT AS "corrective_dT", c.dF AS "corrective_dF", c.dP AS "corrective_dP", round(c.loss, 9) AS corrective_loss, e.dT AS "economic_dT", e.dF AS "economic_dF", e.dP AS "economic_dP", round(e.loss, 9) AS economic_loss
   FROM mo m LEFT JOIN ad USING (moment) LEFT JOIN rk c ON c.moment = m.moment AND c.fix AND c.rn = 1 LEFT JOIN rk e ON e.moment = m.moment AND NOT e.fix AND e.rn = 1""")
def _(spark, sf):
    return round_all(K.grid_optima(moments(spark, sf), policy(spark, sf)), 9)


CANDS = MOM + """, a1 AS (SELECT *, least(6.0, greatest(base - 10 * exp(-q17), 0) / 0.08) AS xt FROM m), a2 AS (SELECT *, greatest(0, greatest(base - 10 * exp(-q17), 0) - 0.08 * xt) AS r1 FROM a1), a3 AS (SELECT *, least(0.2, r1 / 0.15) AS xp FROM a2), a4 AS (SELECT *, -least(10.0, greatest(0, r1 - 0.15 * xp) / 0.05) AS xf FROM a3),
  cd AS (SELECT *, 'hold' AS id, 0.0::DOUBLE AS dT, 0.0::DOUBLE AS dF, 0.0::DOUBLE AS dP FROM a4 UNION ALL SELECT *, 'conservative', xt * 0.5, xf * 0.5, xp * 0.5 FROM a4 UNION ALL SELECT *, 'automatic', xt, xf, xp FROM a4 UNION ALL SELECT *, 'lower_heat', -2, 0, 0 FROM a4 UNION ALL SELECT *, 'more_feed', 0, 2, 0 FROM a4 UNION ALL SELECT *, 'lower_pressure', 0, 0, -0.1 FROM a4),
  sc AS (""" + move_sql("cd") + f"""), l AS (SELECT *, {LOSS} AS loss, probability <= 0.2 + 1e-9 AS risk_passed, probability <= 0.1 + 1e-9 AS within_design, CASE WHEN u = 3 THEN 'stale' ELSE '' END AS dr, u = 5 AS ac FROM sc),
  gt AS (SELECT *, concat_ws('|', nullif(dr, ''), CASE WHEN product > 10 THEN 'sulfur_hard_limit' END, CASE WHEN product > 10 THEN 'sulfur_target' END, CASE WHEN NOT risk_passed THEN 'sulfur_risk_margin' END, CASE WHEN id IN ('lower_heat', 'more_feed', 'lower_pressure') AND NOT within_design THEN 'economic_risk_budget' END,
    CASE WHEN q = 1 THEN 't95' END, CASE WHEN NOT severity <= 1 THEN 'load_severity' END) AS reasons, CASE WHEN q = 2 THEN 't95' ELSE '' END AS unassessed FROM l), fe AS (SELECT *, reasons = '' AS feasible FROM gt)
"""


def gated(spark, sf):
    # Spread by moment once; whatever regroups or joins the candidates by moment then needs no shuffle.
    m = moments(spark, sf).repartition("moment")
    rule = policy(spark, sf)
    d = K.scored(K.candidates(m, rule, F.lit(rule.level(rule.p_max / 2))), rule)
    d = d.withColumn("data_reasons", F.when(F.col("u") == 3, F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>"))).withColumn("analyser_conflict", F.col("u") == 5)
    return K.gate(d, rule, [(F.col("q") != 1, F.col("q") != 2, "t95")])


@query("candidate_gate", "K12 K5 K8 K20", CANDS + "SELECT moment, id, round(product, 6) AS product, round(probability, 6) AS probability, round(severity, 6) AS severity, round(loss, 6) AS loss, reasons, unassessed, feasible FROM fe")
def _(spark, sf):
    d = gated(spark, sf)
    return round_all(d.select("moment", "id", "product", "probability", "severity", "loss", F.array_join("reasons", "|").alias("reasons"), F.array_join("unassessed", "|").alias("unassessed"), "feasible"))


@query("candidate_order", "T4 K10", CANDS + "SELECT moment, id, CAST(row_number() OVER (PARTITION BY moment ORDER BY feasible DESC, CASE WHEN feasible THEN loss ELSE product END, effort, product, id) AS INTEGER) AS rank FROM fe")
def _(spark, sf):
    return K.ordered_candidates(gated(spark, sf), "moment").select("moment", "id", "rank")


PARETO = CANDS + """, ob AS (SELECT moment, id, -throughput AS o1, energy AS o2, severity AS o3, effort AS o4 FROM fe WHERE feasible),
  dm AS (SELECT a.moment, a.id, string_agg(b.id, '|' ORDER BY b.id) AS by_ FROM ob a JOIN ob b ON a.moment = b.moment AND a.id <> b.id AND b.o1 <= a.o1 AND b.o2 <= a.o2 AND b.o3 <= a.o3 AND b.o4 <= a.o4 AND (b.o1 < a.o1 OR b.o2 < a.o2 OR b.o3 < a.o3 OR b.o4 < a.o4) GROUP BY 1, 2)"""


@query("pareto_front", "K9", PARETO + " SELECT fe.moment, fe.id, CASE WHEN feasible THEN by_ IS NULL END AS pareto, CASE WHEN feasible THEN coalesce(by_, '') END AS dominated_by FROM fe LEFT JOIN dm ON dm.moment = fe.moment AND dm.id = fe.id")
def _(spark, sf):
    d = gated(spark, sf).withColumn("neg", -F.col("throughput"))
    return K.pareto(d, "moment", "id", ["neg", "energy", "severity", "effort"], F.col("feasible")).select("moment", "id", "pareto", F.array_join("dominated_by", "|").alias("dominated_by"))


SELECT = CANDS + """, b AS (SELECT moment, id, loss FROM fe WHERE feasible QUALIFY row_number() OVER (PARTITION BY moment ORDER BY loss, effort, product, id) = 1), h AS (SELECT moment, loss AS hold_loss FROM fe WHERE feasible AND id = 'hold'),
  se AS (SELECT x.moment, CASE WHEN coalesce(hold_loss - b.loss < 0.03, FALSE) THEN 'hold' ELSE b.id END AS selected, b.loss AS best_loss, hold_loss FROM (SELECT DISTINCT moment FROM fe) x LEFT JOIN b USING (moment) LEFT JOIN h USING (moment))"""


@query("candidate_selection", "K10", SELECT + " SELECT moment, selected, round(best_loss, 6) AS best_loss, round(hold_loss, 6) AS hold_loss FROM se")
def _(spark, sf):
    return round_all(K.select_candidate(gated(spark, sf), "moment").select("moment", "selected", "best_loss", "hold_loss"))


CONFLICT = SELECT + """, hq AS (SELECT *, regexp_matches(reasons, 'sulfur_hard_limit|sulfur_target|sulfur_risk_margin|economic_risk_budget') AS ql FROM fe), cg AS (SELECT moment, bool_or(reasons = 'load_severity' AND id <> 'hold' AND product <= 10) AS load, bool_or(feasible AND product <= 10) AS reach,
    bool_or(id IN ('lower_heat', 'more_feed', 'lower_pressure') AND NOT feasible AND ql) AS eco, bool_or(id = 'hold' AND NOT feasible AND ql AND dr = '') AS unstable, bool_or(ac) AS src FROM hq GROUP BY 1), cs AS (SELECT * FROM cg JOIN se USING (moment)),
  cf AS (SELECT moment, 'analyser_disagreement' AS code, 'abstain' AS resolution FROM cs WHERE src UNION ALL SELECT moment, 'quality_vs_load', CASE WHEN reach THEN 'resolved_by_alternative' ELSE 'abstain' END FROM cs WHERE load UNION ALL SELECT moment, 'economy_vs_quality', 'quality_priority' FROM cs WHERE eco
    UNION ALL SELECT moment, 'stability_vs_quality', CASE WHEN selected IS NOT NULL AND selected <> 'hold' THEN 'corrective_action' ELSE 'abstain' END FROM cs WHERE unstable UNION ALL SELECT moment, 'stability_vs_economy', 'hold' FROM cs WHERE selected = 'hold' AND best_loss < hold_loss)"""


@query("goal_conflicts", "K13", CONFLICT + " SELECT moment, code, resolution FROM cf")
def _(spark, sf):
    d = gated(spark, sf)
    return K.conflicts(d, K.select_candidate(d, "moment"), "moment")


@query("decision_status", "K18 K17", CONFLICT + """, bl AS (SELECT moment, min(code) AS blocked FROM cf WHERE resolution = 'abstain' GROUP BY 1), f AS (SELECT mo.moment, selected, CASE WHEN u = 3 THEN 'data:stale' WHEN selected IS NULL THEN 'no_admissible_option' WHEN blocked IS NOT NULL THEN 'conflict:' || blocked END AS cause FROM mo LEFT JOIN se USING (moment) LEFT JOIN bl USING (moment))
   SELECT moment, CASE WHEN cause IS NULL THEN 'recommendation' ELSE 'abstain' END AS status, cause, CASE WHEN cause IS NULL THEN selected END AS selected FROM f""")
def _(spark, sf):
    d = gated(spark, sf)
    s = K.select_candidate(d, "moment")
    data = d.filter("id = 'hold'").select("moment", "data_reasons")
    return K.final_status(s, K.conflicts(d, s, "moment"), data, "moment")


@query("consistency_checks", "K13", SELECT + " SELECT count(*) AS moments, count(selected) AS selected, count(*) FILTER (WHERE NOT fe.feasible) AS selected_not_feasible, count(*) FILTER (WHERE fe.product > 10) AS selected_above_limit FROM se LEFT JOIN fe ON fe.moment = se.moment AND fe.id = se.selected")
def _(spark, sf):
    d = gated(spark, sf)
    j = K.select_candidate(d, "moment").drop("feasible").join(d.select("moment", F.col("id").alias("selected"), "feasible", "product"), ["moment", "selected"], "left")
    return j.agg(F.count("*").alias("moments"), F.count("selected").alias("selected"), F.count_if(F.col("selected").isNotNull() & ~F.col("feasible")).alias("selected_not_feasible"), F.count_if(F.col("product") > K.HARD_LIMIT).alias("selected_above_limit"))


@query("risk_policy", "K7 K2", MOM + f""", x AS (SELECT moment, base, q <> 3 AS usable, 1 + (u % 3) / 2.0 AS margin, q15, q17, ln(10.0) - ln(greatest(base, 0.001)) AS g, {', '.join(f'q{i}' for i in range(19) if i not in (15, 17))} FROM m),
   y AS (SELECT *, CASE WHEN usable THEN 10 * exp(-q15) ELSE 10 - margin END AS safe, CASE WHEN usable THEN 10 * exp(-q17) ELSE 10 - 1.5 * margin END AS design, CASE WHEN usable THEN {PROB} END AS p FROM x)
   SELECT moment, CASE WHEN usable THEN 'residual_quantiles' ELSE 'point_margin' END AS basis, round(safe, 6) AS safe_level, round(design, 6) AS design_level, round(p, 6) AS probability,
     CASE WHEN usable THEN p <= 0.2 + 1e-9 ELSE base <= safe + 1e-9 END AS risk_passed, CASE WHEN usable THEN p <= 0.1 + 1e-9 ELSE base <= design + 1e-9 END AS within_design FROM y""")
def _(spark, sf):
    m = moments(spark, sf).withColumn("product", F.col("base"))
    d = K.risk_policy(m, policy(spark, sf), F.col("q") != 3, 1 + (F.col("u") % 3) / 2.0)
    return round_all(d.select("moment", "basis", "safe_level", "design_level", "probability", "risk_passed", "within_design"))


# Decisions replayed on the regular grid of origins and held against the dense audit grid; levels are the latest published laboratory value.
REPLAY = GRID + f""", mo AS (SELECT origin AS moment, (SELECT arg_max(lab.value, lab.t) FROM lab WHERE lab.t + {240 * C.MINUTE} <= origin AND lab.t >= origin - {48 * C.HOUR}) / 6 AS base, 330 + {asof_sql('ev.click', 'o.origin', 30 * C.MINUTE)} / 5 AS T,
     150 + {asof_sql('ev.error', 'o.origin', 30 * C.MINUTE)} / 2 AS F, 4 + {asof_sql('ev.signup', 'o.origin', 30 * C.MINUTE)} / 400 AS P FROM o),
  ref AS (SELECT avg(T) AS mt, stddev_pop(T) AS st, avg(F) AS mf, stddev_pop(F) AS sf, avg(P) AS mp, stddev_pop(P) AS sp FROM mo),
  qf AS """ + MOM.split("qf AS ", 1)[1].split("\n")[0] + """
  m AS (SELECT mo.*, 0 AS q, CASE WHEN base IS NULL OR T IS NULL OR F IS NULL OR P IS NULL THEN 3 ELSE 0 END AS u, ref.*, qf.* FROM mo, ref, qf)"""


def replay_moments(spark, sf):
    s = staged(clean(spark, sf))
    o = X.origin_grid(s)
    t = X.lookup(o, s, {"click": ("ev.click", 0), "error": ("ev.error", 0), "signup": ("ev.signup", 0)})
    b = X.previous_lab(o, s.filter(F.col("metric_id") == LAB).select("t", "value")).select("origin", (F.col("previous_lab") / 6).alias("base"))
    m = staged(t.join(b, "origin").select(F.col("origin").alias("moment"), "base", (330 + F.col("click") / 5).alias("T"), (150 + F.col("error") / 2).alias("F"), (4 + F.col("signup") / 400).alias("P")))
    ref = m.agg(*[x for k in "TFP" for x in (F.avg(k).alias(f"mean_{k}"), F.stddev_pop(k).alias(f"std_{k}"))])
    return m.join(F.broadcast(ref))  # one row


@query("audit_replay", "K6 K17", REPLAY + grid_sql(DENSE, "FALSE") + SELECT[len(MOM):].replace("sc AS (", "sk AS (").replace("FROM sc)", "FROM sk)").replace(", l AS (", ", lk AS (").replace("FROM l)", "FROM lk)") + f"""
   SELECT {ts_text('make_timestamp(se.moment)')} AS moment, selected, round(CASE WHEN selected = 'hold' THEN hold_loss ELSE best_loss END, 6) AS selected_loss, round(hold_loss, 6) AS hold_loss, CASE WHEN u = 0 THEN coalesce(ad.admissible, 0) END AS admissible,
     round(r.loss, 6) AS oracle_loss, CASE WHEN r.fix THEN 'corrective' WHEN NOT r.fix THEN 'economic' END AS oracle_kind, round(CASE WHEN selected = 'hold' THEN hold_loss ELSE best_loss END - r.loss, 6) AS given_away
   FROM se JOIN m ON m.moment = se.moment LEFT JOIN ad ON ad.moment = se.moment AND u = 0 LEFT JOIN (SELECT moment, fix, loss FROM rk WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY moment ORDER BY lk, fix DESC) = 1) r ON r.moment = se.moment AND u = 0""")
def _(spark, sf):
    m, rule = replay_moments(spark, sf), policy(spark, sf)
    known = F.col("base").isNotNull() & F.col("T").isNotNull() & F.col("F").isNotNull() & F.col("P").isNotNull()
    d = K.scored(K.candidates(m, rule, F.lit(rule.level(rule.p_max / 2))), rule)
    d = d.withColumn("data_reasons", F.when(~known, F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>")))
    data = m.select("moment", F.when(~known, F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>")).alias("data_reasons"))
    decided = K.select_candidate(K.gate(d, rule), "moment").drop("feasible", "best_loss").join(data, "moment")
    out = K.audit(decided, K.grid_optima(m, rule, K.AUDIT_GRID, hold=True), "moment").drop("data_reasons")
    return round_all(out.withColumn("moment", C.from_micros("moment")))


EVID = """WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v, CASE WHEN user_id % 4 = 0 THEN 'stale' ELSE 'fresh' END AS fr, CASE WHEN value > 250 THEN 'suspect' WHEN value < 1 THEN 'invalid' ELSE '' END AS fl, event_id + (user_id % 3) - 1 AS av, event_type, value, user_id FROM events)"""


@query("evidence_gate", "K1", EVID + """, r AS (SELECT concat_ws('|', CASE WHEN v IS NULL THEN 'no_finite_value' END, CASE WHEN fr <> 'fresh' THEN 'not_fresh' END, CASE WHEN fl <> '' THEN 'unreliable' END, CASE WHEN av > event_id THEN 'not_yet_available' END) AS reasons FROM e) SELECT reasons, count(*) AS n FROM r GROUP BY 1""")
def _(spark, sf):
    e, i, u = table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    d = e.select(i, F.when(i % 9 != 0, F.col("value")).alias("v"), F.when(u % 4 == 0, "stale").otherwise("fresh").alias("fr"), F.when(F.col("value") > 250, "suspect").when(F.col("value") < 1, "invalid").otherwise("").alias("fl"), (i + u % 3 - 1).alias("av"))
    return d.groupBy(F.array_join(K.evidence_failures("v", "fr", "fl", "av", "event_id"), "|").alias("reasons")).agg(F.count("*").alias("n"))


@query("baseline_source", "K2 K19", """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS lab, CASE WHEN event_id % 5 <> 0 THEN value + 1 END AS a, CASE WHEN event_id % 7 <> 0 THEN value - 1 END AS b, user_id % 2 = 0 AS aok, user_id % 3 = 0 AS bok, user_id % 5 <> 0 AS af, user_id % 4 <> 0 AS bf, user_id AS ta, user_id % 11 AS tb, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS soft FROM events),
   r AS (SELECT *, CASE WHEN lab IS NOT NULL THEN 'lab' WHEN a IS NOT NULL AND (b IS NULL OR (aok, af, ta) >= (bok, bf, tb)) THEN 'a' WHEN b IS NOT NULL THEN 'b' WHEN soft IS NOT NULL THEN 'soft' END AS source FROM e)
   SELECT source, count(*) AS n, round(sum(CASE source WHEN 'lab' THEN lab WHEN 'a' THEN a WHEN 'b' THEN b ELSE soft END), 4) AS total FROM r GROUP BY 1""")
def _(spark, sf):
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    row = K.choose_baseline(F.when(i % 3 == 0, v), [("a", F.when(i % 5 != 0, v + 1), u % 2 == 0, u % 5 != 0, u), ("b", F.when(i % 7 != 0, v - 1), u % 3 == 0, u % 4 != 0, u % 11)], F.when(i % 2 == 0, v * 2))
    d = table(spark, sf, "events").select(row.alias("r"))
    return d.groupBy(F.col("r.source").alias("source")).agg(F.count("*").alias("n"), rounded(F.sum("r.value"), 4).alias("total"))


@query("analyser_disagreement", "K3", """WITH e AS (SELECT value / 10 AS a, value / 10 + user_id % 6 AS b, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1.0 END AS oa, -1.5 AS ob, event_id % 4 <> 0 AS cmp FROM events), d AS (SELECT CASE WHEN cmp THEN coalesce(abs((a + oa) - (b + ob)), abs(a - b)) END AS diff FROM e)
   SELECT coalesce(diff > 2, FALSE) AS conflict, count(*) AS n, round(avg(diff), 6) AS mean_difference FROM d GROUP BY 1""")
def _(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select((F.col("value") / 10).alias("a"), (F.col("value") / 10 + F.col("user_id") % 6).alias("b"), F.when(i % 3 != 0, 1.0).alias("oa"), F.lit(-1.5).alias("ob"), (i % 4 != 0).alias("cmp"))
    diff, bad = K.analyser_conflict("a", "b", "oa", "ob", F.col("cmp"))
    return e.groupBy(bad.alias("conflict")).agg(F.count("*").alias("n"), rounded(F.avg(diff)).alias("mean_difference"))


@query("reliability_verdict", "K4 K19", MOM + """, s AS (SELECT moment, CASE WHEN F / mf < 0.8 THEN 'transition' ELSE 'normal' END AS st, concat_ws('|', CASE WHEN u = 3 THEN 'not_fresh' END, CASE WHEN u IN (3, 4) THEN 'unreliable' END) AS ev, CASE WHEN u = 5 THEN 'analyser_conflict' ELSE '' END AS ac FROM m)
   SELECT concat_ws('|', CASE WHEN st = 'transition' THEN 'state:transition' END, nullif(ev, ''), nullif(ac, '')) AS reasons, count(*) AS moments FROM s GROUP BY 1""")
def _(spark, sf):
    m = moments(spark, sf)
    state = Q.operating_state("F", "mean_F", 0.1, 0.8)
    why = K.reliability(state, C.reasons((F.col("u") == 3, "not_fresh"), (F.col("u").isin(3, 4), "unreliable")), C.reasons((F.col("u") == 5, "analyser_conflict")))
    return m.groupBy(F.array_join(why, "|").alias("reasons")).agg(F.count("*").alias("moments"))


@query("additive_dose", "K11", """SELECT l_linenumber, count(*) AS n, round(avg(CASE WHEN 51 - b <= 0 THEN 0 ELSE round(ceil((51 - b) / 4 / 0.05 - 1e-9) * 0.05, 4) END), 6) AS mean_dose, count(*) FILTER (WHERE CASE WHEN 51 - b <= 0 THEN 0 ELSE round(ceil((51 - b) / 4 / 0.05 - 1e-9) * 0.05, 4) END <= 3) AS feasible FROM (SELECT l_linenumber, 35 + l_quantity / 2 AS b FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    dose = K.required_additive(35 + F.col("l_quantity") / 2)
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), rounded(F.avg(dose)).alias("mean_dose"), F.count_if(dose <= K.MAX_ADDITIVE).alias("feasible"))


@query("recipe_balance", "K14", """WITH c AS (SELECT l_orderkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS tot, l_discount * 100 AS sulfur, 300 + l_quantity AS t95, 45 + l_tax * 100 AS cetane, 1 + l_discount AS cost, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 1000 END AS stock, l_linenumber FROM lineitem),
   k AS (SELECT *, CASE WHEN l_orderkey % 10 = 0 THEN l_quantity ELSE l_quantity / tot * 100 END AS share, l_quantity * 0.9 AS req FROM c), g AS (SELECT l_orderkey, abs(sum(share) - 100) <= 1e-6 AS ok, sum(share * sulfur) / sum(share) AS s, sum(share * cetane) / sum(share) AS c, sum(share * cost) / sum(share) AS k, sum(share * t95) / sum(share) AS t,
     bool_or(stock IS NOT NULL AND stock < req - 1e-8) AS short, bool_or(stock IS NULL) AS unk FROM k GROUP BY 1)
   SELECT l_orderkey AS recipe, ok AS valid_recipe, round(CASE WHEN ok THEN s * 0.99 + 12 * 0.01 END, 12) AS sulfur, round(CASE WHEN ok THEN t END, 9) AS t95, round(CASE WHEN ok THEN c + 4 END, 9) AS cetane, round(CASE WHEN ok THEN k * 0.99 + 1 END, 12) AS cost_index, CASE WHEN short THEN FALSE WHEN unk THEN NULL ELSE TRUE END AS stock_met FROM g""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    tot = l.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("tot"))
    d = l.join(tot, "l_orderkey").select(
        F.col("l_orderkey").alias("recipe"), F.when(F.col("l_orderkey") % 10 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") / F.col("tot") * 100).alias("share"), (F.col("l_discount") * 100).alias("sulfur"),
        (300 + F.col("l_quantity")).alias("t95"), (45 + F.col("l_tax") * 100).alias("cetane"), (1 + F.col("l_discount")).alias("cost"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 1000).alias("stock"), (F.col("l_quantity") * 0.9).alias("required"))
    r = K.blend(d, "recipe", 1.0, 4.0, 12.0)
    return r.select("recipe", "valid_recipe", "stock_met", *[rounded(F.col(x), n).alias(x) for x, n in (("sulfur", 12), ("t95", 9), ("cetane", 9), ("cost_index", 12))])


@query("recipe_neighbours", "K16", """WITH r AS (SELECT p_partkey AS recipe, [p_size::DOUBLE, 60.0 - p_size, 40.0]::DOUBLE[] AS s FROM part), x AS (SELECT recipe, s, d.range AS donor, v.range AS receiver FROM r, range(3) d, range(3) v WHERE d.range <> v.range AND s[d.range + 1] >= 5)
   SELECT recipe, CAST(donor AS INTEGER) AS donor, CAST(receiver AS INTEGER) AS receiver, s[1] + CASE WHEN receiver = 0 THEN 5 WHEN donor = 0 THEN -5 ELSE 0 END AS a, s[2] + CASE WHEN receiver = 1 THEN 5 WHEN donor = 1 THEN -5 ELSE 0 END AS b, s[3] + CASE WHEN receiver = 2 THEN 5 WHEN donor = 2 THEN -5 ELSE 0 END AS c FROM x""")
def _(spark, sf):
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("recipe"), F.array(F.col("p_size").cast("double"), 60.0 - F.col("p_size"), F.lit(40.0)).alias("shares"))
    n = K.recipe_neighbours(r)
    return n.select("recipe", "donor", "receiver", *[F.col("shares")[i].alias(x) for i, x in enumerate("abc")])


@query("batch_integral", "K15", """WITH c AS (SELECT o_orderkey AS batch, unnest([0, 60, 120, 180]) AS t, unnest([o_totalprice / 50000 - 3, (o_custkey % 20) - 6, 4 - o_orderkey % 9, o_totalprice / 90000 - 1]) AS v FROM orders), s AS (SELECT batch, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM c WINDOW w AS (PARTITION BY batch ORDER BY t))
   SELECT batch, round(sum(CASE WHEN v >= 0 AND v1 >= 0 THEN (t1 - t) * (v + v1) / 2 WHEN greatest(v, v1) > 0 THEN (t1 - t) * greatest(v, v1) * greatest(v, v1) / (2 * abs(v1 - v)) ELSE 0 END) / sum(t1 - t), 6) AS mean FROM s WHERE t1 IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    vs = [F.col("o_totalprice") / 50000 - 3, (F.col("o_custkey") % 20 - 6).cast("double"), (4 - k % 9).cast("double"), F.col("o_totalprice") / 90000 - 1]
    c = o.select(k.alias("batch"), F.inline(F.array(*[F.struct(F.lit(t).alias("t"), v.alias("v")) for t, v in zip((0, 60, 120, 180), vs)])))
    return round_all(K.batch_mean(c, "batch", "t", "v"))


@query("response_ramp", "K20", "SELECT l_linenumber, round(avg(CASE WHEN m <= 15 THEN 0 ELSE least(1.0, (m - 15) / 90.0) END), 6) AS fraction FROM (SELECT l_linenumber, l_quantity * 3 AS m FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(rounded(F.avg(K.response_fraction(F.col("l_quantity") * 3, 90.0, 15.0))).alias("fraction"))
