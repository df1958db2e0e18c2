"""Batch decisions over a table of moments: evidence gates, candidate scoring, grid search, Pareto marks, selection.

One row is one moment (or one moment x candidate).  The grid search unfolds a constant list of moves inside each
row and reduces it again before anything is shuffled; the argmin key is one long integer, so both halves of the
aggregation run on hashed primitive buffers.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# Fixed values of the decision model.
HARD_LIMIT = 10.0
STEP_LIMITS = {"T": 6.0, "F": 10.0, "P": 0.2}
EDITABLE = {"T": -0.08, "F": 0.05, "P": -0.15}
MINIMUM_GAIN = 0.03
MAX_ADDITIVE = 3.0
ECONOMIC = ("lower_heat", "more_feed", "lower_pressure", "economic_optimum")
QUALITY_REASONS = ("sulfur_hard_limit", "sulfur_target", "sulfur_risk_margin", "economic_risk_budget")
# (first index, step, count) per control: 13 x 21 x 5 moves for the search, 25 x 21 x 9 for the audit.
SEARCH_GRID = {"T": (-6, 1.0, 13), "F": (-10, 1.0, 21), "P": (-2, 0.1, 5)}
AUDIT_GRID = {"T": (-12, 0.5, 25), "F": (-10, 1.0, 21), "P": (-4, 0.05, 9)}


@dataclass(frozen=True)
class Policy:
    """Risk policy, response model and residual quantile function (a model artefact of at most 99 numbers)."""

    probs: Sequence[float]
    quants: Sequence[float]
    p_max: float = 0.2
    target: float = HARD_LIMIT
    observed: Mapping[str, float] = field(default_factory=lambda: {"T": -0.02, "F": 0.01, "P": -0.05})
    editable: Mapping[str, float] = field(default_factory=lambda: dict(EDITABLE))
    severity_cap: float = 12.0


    def level(self, p: float) -> float:
        """The product level at which the exceedance probability is ``p``."""
        at, q = list(self.probs), list(self.quants)
        i = max(1, min(len(at) - 1, bisect.bisect_left(at, 1 - p - 1e-12)))
        share = max(0.0, min(1.0, (1 - p - at[i - 1]) / (at[i] - at[i - 1])))
        return HARD_LIMIT * math.exp(-(q[i - 1] + share * (q[i] - q[i - 1])))


# --- evidence -------------------------------------------------------------------------


def evidence_failures(value, freshness, flags, available, at, require_fresh: bool = True) -> Column:
    """Ordered reasons why a reading cannot support a decision."""
    bad = F.exists(F.split(F.coalesce(C.c(flags), F.lit("")), r"\|"), lambda x: x.isin(*C.UNUSABLE_FLAGS))
    checks = [(C.finite(value).isNull(), "no_finite_value")]
    if require_fresh:
        checks.append((F.coalesce(C.c(freshness) != "fresh", F.lit(True)), "not_fresh"))
    checks += [(bad, "unreliable"), (C.c(available).isNull(), "unknown_time"), (C.c(available) > C.c(at), "not_yet_available")]
    return C.reasons(*checks)


def choose_baseline(lab: Column, analysers: Sequence[tuple[str, Column, Column, Column, Column]], soft: Column) -> Column:
    """struct(source, value): the lab, else the best analyser by (clean, fresh, newest), else the soft sensor.

    ``analysers`` are (name, value, clean, fresh, time).
    """
    ranked = F.array_max(F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(ok.alias("ok"), fresh.alias("fresh"), t.alias("t"), F.lit(-i).alias("i"), v.alias("value"), F.lit(n).alias("source")))
        for i, (n, v, ok, fresh, t) in enumerate(analysers)])))
    row = lambda s, v: F.struct(s.cast("string").alias("source"), v.cast("double").alias("value"))
    return (F.when(lab.isNotNull(), row(F.lit("lab"), lab)).when(ranked.isNotNull(), row(ranked["source"], ranked["value"]))
            .when(soft.isNotNull(), row(F.lit("soft"), soft)).otherwise(row(F.lit(None), F.lit(None))))


def analyser_conflict(a, b, offset_a, offset_b, comparable: Column, limit: float = 2.0) -> tuple[Column, Column]:
    """(difference, conflict?) after anchoring both analysers to the lab, raw where an anchor is missing."""
    raw = F.abs(C.c(a) - C.c(b))
    anchored = F.abs((C.c(a) + C.c(offset_a)) - (C.c(b) + C.c(offset_b)))
    d = F.when(comparable, F.coalesce(anchored, raw))
    return d, F.coalesce(d > limit, F.lit(False))


def reliability(state: Column, *groups: Column) -> Column:
    """All reasons in order, the operating state first when the unit is not running normally."""
    first = F.when(state.isin("shutdown", "transition"), F.array(F.concat(F.lit("state:"), state))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, *groups))


# --- scenario ----------------------------------------------------------------------------


def response_fraction(minute, lag: float = 90.0, dead: float = 0.0) -> Column:
    m = C.c(minute)
    return F.when(m <= dead, 0.0).otherwise(1.0 if lag == 0 else F.least(F.lit(1.0), (m - dead) / lag))


def control_effect(name: str, change: Column, level: Column, policy: Policy) -> Column:
    """The worse for quality of the editable and the observed effect."""
    return F.greatest(policy.editable[name] * change, policy.observed[name] * change * F.greatest(level, F.lit(0.0)))


def effort(dt: Column, df: Column, dp: Column, rounded: bool = True) -> Column:
    e = F.abs(dt) / 10 + F.abs(df) / 10 + F.abs(dp) / 2
    return F.round(e, 4) if rounded else e


def automatic_changes(reduction: Column, editable: Mapping[str, float] = EDITABLE, limits: Mapping[str, float] = STEP_LIMITS) -> tuple[Column, Column, Column]:
    """Capped greedy allocation of a wanted reduction: heat first, then pressure, then feed."""
    need = F.greatest(reduction, F.lit(0.0))
    dt = F.least(F.lit(limits["T"]), need / abs(editable["T"]))
    left = F.greatest(F.lit(0.0), need + editable["T"] * dt)
    dp = F.least(F.lit(limits["P"]), left / abs(editable["P"]))
    left2 = F.greatest(F.lit(0.0), left + editable["P"] * dp)
    return dt, -F.least(F.lit(limits["F"]), left2 / editable["F"]), dp


def probability_above(gap: str, policy: Policy) -> Column:
    """Exceedance probability as one comparison chain over constants; it compiles to a few hundred bytes."""
    p, q, g = list(policy.probs), list(policy.quants), F.col(gap)
    out = F.when(g <= q[0], 1 - p[0])
    for i in range(len(q) - 1):
        if q[i + 1] > q[i]:
            out = out.when(g < q[i + 1], (1 - p[i]) - (g - q[i]) * ((p[i + 1] - p[i]) / (q[i + 1] - q[i])))
    return out.when(g.isNotNull(), 1 - p[-1])


def risk_policy(df: DataFrame, policy: Policy, usable: Column, margin: Column | float) -> DataFrame:
    """Adds basis, safe_level, design_level and, for rows with ``product``, probability, risk_passed and within_design.

    Where the residual quantiles are ``usable`` the admissible level is the one whose exceedance probability is p_max and the design
    level that of half of it; elsewhere the levels lie one and one and a half ``margin`` below the limit and no probability is known.
    """
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    yes = F.coalesce(usable, F.lit(False))
    d = df.withColumn("basis", F.when(yes, "residual_quantiles").otherwise("point_margin"))
    d = d.withColumn("safe_level", F.when(yes, policy.level(policy.p_max)).otherwise(HARD_LIMIT - margin))
    d = d.withColumn("design_level", F.when(yes, policy.level(policy.p_max / 2)).otherwise(HARD_LIMIT - 1.5 * margin))
    if "product" not in df.columns:
        return d
    d = d.withColumn("_gap", F.lit(math.log(HARD_LIMIT)) - F.ln(F.greatest(F.col("product"), F.lit(1e-3))))
    d = d.withColumn("probability", F.when(yes, probability_above("_gap", policy)))
    rule = lambda p, level: F.when(yes, F.col("probability") <= p + 1e-9).otherwise(F.col("product") <= F.col(level) + 1e-9)
    return d.withColumn("risk_passed", rule(policy.p_max, "safe_level")).withColumn("within_design", rule(policy.p_max / 2, "design_level")).drop("_gap")


def scored(df: DataFrame, policy: Policy, round_effort: bool = True) -> DataFrame:
    """Adds product, probability, severity, throughput, energy, effort and ranking loss to rows with dT, dF, dP.

    Needs base, T, F, P and their reference mean_x / std_x.  Shared intermediate values are columns of their own,
    so each is computed once per row.
    """
    dt, df_, dp = F.col("dT"), F.col("dF"), F.col("dP")
    total = control_effect("T", dt, F.col("base"), policy) + control_effect("F", df_, F.col("base"), policy) + control_effect("P", dp, F.col("base"), policy)
    d = df.withColumn("product", F.greatest(F.lit(0.0), F.col("base") + total)).withColumn("effort", effort(dt, df_, dp, round_effort))
    d = d.withColumn("_gap", F.lit(math.log(HARD_LIMIT)) - F.ln(F.greatest(F.col("product"), F.lit(1e-3))))
    d = d.withColumn("probability", probability_above("_gap", policy))
    z = lambda x, v: (v - F.col(f"mean_{x}")) / F.col(f"std_{x}")
    sev = F.greatest(F.lit(0.0), z("T", F.col("T") + dt), z("P", F.col("P") + dp), z("F", F.col("F") * (1 + df_ / 100))) / policy.severity_cap
    known = F.col("T").isNotNull() & F.col("F").isNotNull() & F.col("P").isNotNull()
    d = d.withColumn("severity", F.when(known, sev)).withColumn("throughput", 1 + df_ / 100).withColumn("energy", 1 + 0.10 * dt / 10 + 0.05 * dp / 2 + 0.10 * df_ / 10)
    loss = 0.5 * (1 - F.col("throughput")) / 0.10 + (F.col("energy") - 1) + 0.25 * F.col("severity") + 0.05 * F.col("effort") + 0.25 * F.col("probability") / policy.p_max
    if "cost" in d.columns:
        loss = loss + 0.25 * (F.col("cost") - 1)
    return d.withColumn("loss", loss).withColumn("risk_passed", F.col("probability") <= policy.p_max + 1e-9).withColumn(
        "within_design", F.col("probability") <= policy.p_max / 2 + 1e-9).drop("_gap")


def is_corrective(dt: Column, df: Column, dp: Column) -> Column:
    return (dt >= 0) & (df <= 0) & (dp >= 0)


def move_at(i: Column, grid: Mapping[str, tuple[int, float, int]]) -> dict[str, Column]:
    """The move with number ``i`` (T slowest, P fastest); the grid is arithmetic, so no move table travels."""
    nf, np_ = grid["F"][2], grid["P"][2]
    at = {"T": F.floor(i / (nf * np_)), "F": F.pmod(F.floor(i / np_), F.lit(nf)), "P": F.pmod(i, F.lit(np_))}
    return {f"d{k}": (at[k] + grid[k][0]) * F.lit(grid[k][1]) for k in "TFP"}


def _plain_effort(i: int, grid: Mapping[str, tuple[int, float, int]]) -> float:
    nf, np_ = grid["F"][2], grid["P"][2]
    at = {"T": i // (nf * np_), "F": i // np_ % nf, "P": i % np_}
    move = {k: abs((at[k] + grid[k][0]) * grid[k][1]) for k in "TFP"}
    return move["T"] / 10 + move["F"] / 10 + move["P"] / 2


def grid_optima(moments: DataFrame, policy: Policy, grid: Mapping[str, tuple[int, float, int]] = SEARCH_GRID, key: str = "moment",
                partitions: int | None = None, hold: bool = False) -> DataFrame:
    """Cheapest admissible corrective and economic move per moment (loss, then effort, then grid order).

    ``hold`` counts staying put among the corrective moves.

    Moments are spread by key before the grid unfolds, so the reduction needs no further shuffle.  Moves are numbered
    by (effort, grid order) beforehand, so the argmin is a single long: the loss in units of 1e-12, then that number.
    A move inside the grid that passes the checks has a loss far inside +-500, so nothing overflows.
    """
    count = grid["T"][2] * grid["F"][2] * grid["P"][2]
    size = 8192
    if count > size:
        raise ValueError(f"a grid holds at most {size} moves")
    order = sorted(range(count), key=lambda i: (round(_plain_effort(i, grid), 9), i))
    partitions = partitions or int(moments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = [key, "base", "T", "F", "P", *[f"{s}_{x}" for x in "TFP" for s in ("mean", "std")]]
    d = moments.select(*need).repartition(partitions, key).select("*", F.posexplode(F.array(*[F.lit(i) for i in order])).alias("_rank", "i"))
    move = move_at(F.col("i"), grid)
    d = d.select("*", *[move[k].alias(k) for k in ("dT", "dF", "dP")])
    if not hold:
        d = d.filter("dT != 0 OR dF != 0 OR dP != 0")
    d = scored(d, policy, round_effort=False)
    ok = F.col("loss").isNotNull() & F.col("risk_passed") & (F.col("product") <= min(policy.target, HARD_LIMIT)) & (F.col("severity") <= 1)
    fix = is_corrective(F.col("dT"), F.col("dF"), F.col("dP"))
    ok = ok & (fix | F.col("within_design"))
    packed = F.when(ok, F.floor((F.col("loss") + 500) * 1e12 + 0.5) * size + F.col("_rank"))
    d = d.select(key, ok.alias("_ok"), fix.alias("_fix"), packed.alias("_k"))
    g = d.groupBy(key).agg(F.count_if("_ok").alias("admissible"), F.min(F.when(F.col("_ok") & F.col("_fix"), F.col("_k"))).alias("_c"),
                           F.min(F.when(F.col("_ok") & ~F.col("_fix"), F.col("_k"))).alias("_e"))
    out = [key, "admissible"]
    for name, col in (("corrective", "_c"), ("economic", "_e")):
        best = move_at(F.get(F.array(*[F.lit(i) for i in order]), F.pmod(F.col(col), F.lit(size)).cast("int")), grid)
        out += [best[x].alias(f"{name}_{x}") for x in ("dT", "dF", "dP")]
        out.append((F.expr(f"{col} div {size}L").cast("double") / 1e12 - 500).alias(f"{name}_loss"))
    return g.select(*out)


def candidates(moments: DataFrame, policy: Policy, design_level: Column) -> DataFrame:
    """The fixed candidate moves of each moment (hold, half and full correction, three economic ones)."""
    dt, df, dp = automatic_changes(F.col("base") - design_level, policy.editable)
    row = lambda n, t, f, p: F.struct(F.lit(n).alias("id"), t.cast("double").alias("dT"), f.cast("double").alias("dF"), p.cast("double").alias("dP"))
    zero = F.lit(0.0)
    cells = F.array(row("hold", zero, zero, zero), row("conservative", dt * 0.5, df * 0.5, dp * 0.5), row("automatic", dt, df, dp),
                    row("lower_heat", F.lit(-2.0), zero, zero), row("more_feed", zero, F.lit(2.0), zero), row("lower_pressure", zero, zero, F.lit(-0.1)))
    return moments.select("*", F.inline(cells))


def gate(df: DataFrame, policy: Policy, extra: Sequence[tuple[Column, Column, str]] = ()) -> DataFrame:
    """Named checks -> reasons, unassessed names and feasibility.

    ``extra`` holds (passed, assessed, name): a check that is not assessed is listed, not failed.
    """
    eco = F.col("id").isin(*ECONOMIC)
    over = (F.abs("dT") > STEP_LIMITS["T"] + 1e-9) | (F.abs("dF") > STEP_LIMITS["F"] + 1e-9) | (F.abs("dP") > STEP_LIMITS["P"] + 1e-9)
    checks = [(over, "step_limit"), (F.col("product") > HARD_LIMIT, "sulfur_hard_limit"), (F.col("product") > policy.target, "sulfur_target"),
              (~F.col("risk_passed"), "sulfur_risk_margin"), (eco & ~F.col("within_design"), "economic_risk_budget")]
    for passed, assessed, name in extra:
        checks.append((assessed & ~F.coalesce(passed, F.lit(False)), name))
    checks.append((~F.coalesce(F.col("severity") <= 1, F.lit(False)), "load_severity"))
    d = df.withColumn("reasons", F.concat(F.col("data_reasons"), C.reasons(*checks)))
    d = d.withColumn("unassessed", C.reasons(*[(~assessed, name) for _, assessed, name in extra]) if extra else F.array().cast("array<string>"))
    return d.withColumn("feasible", F.size("reasons") == 0)


def pareto(df: DataFrame, key: str, ident: str, objectives: Sequence[str], eligible: Column) -> DataFrame:
    """Adds ``pareto`` and ``dominated_by``: only eligible rows with complete objectives (all minimised) compete.

    A moment has only its handful of candidate kinds, so they meet in one small array.
    """
    full = eligible
    for o in objectives:
        full = full & C.finite(o).isNotNull()
    d = df.withColumn("_in", F.coalesce(full, F.lit(False)))
    me = F.struct(F.col(ident).alias("id"), F.array(*[F.col(o).cast("double") for o in objectives]).alias("v"))
    rivals = d.filter("_in").groupBy(key).agg(F.array_sort(F.collect_list(me)).alias("_all"))
    d = d.join(rivals, key, "left").withColumn("_v", F.array(*[F.col(o).cast("double") for o in objectives]))
    beats = lambda r: (F.forall(F.arrays_zip(r["v"].alias("a"), F.col("_v").alias("b")), lambda z: z["a"] <= z["b"])
                       & F.exists(F.arrays_zip(r["v"].alias("a"), F.col("_v").alias("b")), lambda z: z["a"] < z["b"]))
    by = F.transform(F.filter("_all", lambda r: (r["id"] != F.col(ident)) & beats(r)), lambda r: r["id"])
    d = d.withColumn("dominated_by", F.when(F.col("_in"), by))
    return d.withColumn("pareto", F.when(F.col("_in"), F.size("dominated_by") == 0)).drop("_in", "_all", "_v")


def select_candidate(df: DataFrame, key: str, gain: float = MINIMUM_GAIN) -> DataFrame:
    """Per moment: least (loss, effort, product) feasible candidate; holding is kept unless the gain is large enough."""
    best = F.min(F.when(F.col("feasible"), F.struct("loss", "effort", "product", "id")))
    g = df.groupBy(key).agg(best.alias("b"), F.max(F.when(F.col("feasible") & (F.col("id") == "hold"), F.col("loss"))).alias("hold_loss"), F.count_if("feasible").alias("feasible"))
    keep = F.coalesce(F.col("hold_loss") - F.col("b.loss") < gain, F.lit(False))
    return g.select(key, F.when(keep, "hold").otherwise(F.col("b.id")).alias("selected"), F.when(keep, F.col("hold_loss")).otherwise(F.col("b.loss")).alias("selected_loss"),
                    "hold_loss", F.col("b.loss").alias("best_loss"), "feasible")


def ordered_candidates(df: DataFrame, key: str) -> DataFrame:
    """Rank inside the moment: feasible by (loss, effort, product), then the others by (product, effort)."""
    inf = F.lit(float("inf"))
    ok = F.col("feasible")
    w = Window.partitionBy(key).orderBy(ok.desc(), F.when(ok, F.col("loss")).otherwise(F.coalesce("product", inf)), "effort", F.coalesce("product", inf), "id")
    return df.withColumn("rank", F.row_number().over(w))


def conflicts(df: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Goal conflicts between quality, load and economy per moment with their resolution."""
    quality = F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in QUALITY_REASONS]))
    eco, hold = F.col("id").isin(*ECONOMIC), F.col("id") == "hold"
    load_only = (F.size("reasons") > 0) & F.forall("reasons", lambda r: r == "load_severity") & ~hold & (F.col("product") <= HARD_LIMIT)
    g = df.groupBy(key).agg(
        F.bool_or(load_only).alias("load"), F.bool_or(F.col("feasible") & (F.col("product") <= HARD_LIMIT)).alias("reachable"),
        F.bool_or(eco & ~F.col("feasible") & quality).alias("eco"), F.bool_or(hold & ~F.col("feasible") & quality & (F.size("data_reasons") == 0)).alias("unstable"),
        F.max("analyser_conflict").alias("sources")).join(selection, key)
    row = lambda cond, code, how: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), (how if isinstance(how, Column) else F.lit(how)).alias("resolution")))
    cells = F.array_compact(F.array(
        row(F.col("sources"), "analyser_disagreement", "abstain"),
        row(F.col("load"), "quality_vs_load", F.when(F.col("reachable"), "resolved_by_alternative").otherwise("abstain")),
        row(F.col("eco"), "economy_vs_quality", "quality_priority"),
        row(F.col("unstable"), "stability_vs_quality", F.when(F.col("selected").isNotNull() & (F.col("selected") != "hold"), "corrective_action").otherwise("abstain")),
        row((F.col("selected") == "hold") & (F.col("best_loss") < F.col("hold_loss")), "stability_vs_economy", "hold")))
    return g.select(key, F.inline(cells))


def final_status(selection: DataFrame, found: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """recommendation or abstain with the first applicable cause: data, no candidate, conflict."""
    blocked = found.filter("resolution = 'abstain'").groupBy(key).agg(F.min("code").alias("blocked"))
    d = data.join(selection, key, "left").join(blocked, key, "left")
    cause = (F.when(F.size("data_reasons") > 0, F.concat(F.lit("data:"), F.col("data_reasons")[0])).when(F.col("selected").isNull(), "no_admissible_option")
             .when(F.col("blocked").isNotNull(), F.concat(F.lit("conflict:"), F.col("blocked"))))
    return d.select(key, F.when(cause.isNull(), "recommendation").otherwise("abstain").alias("status"), cause.alias("cause"), F.when(cause.isNull(), F.col("selected")).alias("selected"))


def audit(decisions: DataFrame, optima: DataFrame, key: str) -> DataFrame:
    """Decisions beside the best admissible move of a dense grid: its loss and what the decision gives away.

    Moments whose data already forbid a decision are not audited.
    """
    best = F.least("corrective_loss", "economic_loss")
    found = optima.select(key, "admissible", best.alias("oracle_loss"), F.when(best == F.col("corrective_loss"), "corrective").when(best.isNotNull(), "economic").alias("oracle_kind"))
    d = decisions.join(found, key, "left")
    asked = F.size("data_reasons") == 0
    return d.select(*decisions.columns, *[F.when(asked, F.col(x)).alias(x) for x in ("admissible", "oracle_loss", "oracle_kind")],
                    F.when(asked, F.col("selected_loss") - F.col("oracle_loss")).alias("given_away"))


# --- additive, recipes, batches --------------------------------------------------------------


def required_additive(bound, minimum: float = 51.0, gain: float = 4.0, step: float = 0.05) -> Column:
    """Smallest dose in whole steps lifting the bound to the minimum."""
    gap = F.lit(minimum) - C.c(bound)
    return F.when(C.c(bound).isNotNull(), F.when(gap <= 0, 0.0).otherwise(F.round(F.ceil(gap / gain / step - 1e-9) * step, 4)))


def blend(components: DataFrame, key: str, additive_pct: float = 0.0, gain: float = 4.0, additive_sulfur: float | None = None) -> DataFrame:
    """Share-weighted recipe properties with additive dilution, limits and three-valued stock sufficiency.

    Rows: key, share, sulfur, t95, cetane, cost, required, stock (NULL = unknown).
    """
    share = F.col("share")
    enough = F.when(share == 0, True).when(F.col("stock").isNull() | F.col("required").isNull(), None).otherwise(F.col("stock") >= F.col("required") - 1e-8)
    mean = lambda x: F.sum(share * F.col(x)) / F.sum("share")
    f = additive_pct / 100
    g = components.groupBy(key).agg(
        F.sum("share").alias("_total"), mean("sulfur").alias("_s"), mean("t95").alias("_t"), mean("cetane").alias("_c"), mean("cost").alias("_k"),
        F.bool_or(F.coalesce(~enough, F.lit(False))).alias("_short"), F.bool_or(enough.isNull()).alias("_unknown"))
    sulfur = F.col("_s") * (1 - f) + (additive_sulfur or 0.0) * f if additive_sulfur is not None else F.col("_s")
    ok = F.abs(F.col("_total") - 100) <= 1e-6
    return g.select(key, ok.alias("valid_recipe"), *[F.when(ok, e).alias(n) for n, e in (
        ("sulfur", sulfur), ("t95", F.col("_t")), ("cetane", F.col("_c") + gain * additive_pct), ("cost_index", F.col("_k") * (1 - f) + 100 * f))],
        F.when(F.col("_short"), False).when(F.col("_unknown"), None).otherwise(True).alias("stock_met"))


def recipe_neighbours(recipes: DataFrame, shift: float = 5.0) -> DataFrame:
    """Every ±shift transfer between two components; ``shares`` is an array of at most a few components."""
    n = F.size("shares") - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(F.sequence(F.lit(0), n), lambda j: F.struct(i.alias("donor"), j.alias("receiver")))))
    d = recipes.select("*", F.inline(F.filter(pairs, lambda p: p["donor"] != p["receiver"]))).filter(F.get("shares", F.col("donor")) >= shift)
    moved = F.transform("shares", lambda x, i: x + F.when(i == F.col("receiver"), shift).when(i == F.col("donor"), -shift).otherwise(0.0))
    return d.withColumn("shares", moved)


def batch_mean(curve: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """Time-weighted mean of a piecewise-linear curve clipped at zero (exact where a segment crosses zero).

    ``curve`` holds the knots of each key; a knot's successor is found inside the key's own few knots.
    """
    w = Window.partitionBy(key).orderBy(t)
    d = curve.withColumn("_t1", F.lead(t).over(w)).withColumn("_v1", F.lead(v).over(w)).filter("_t1 IS NOT NULL")
    a, b, dt = F.col(v), F.col("_v1"), F.col("_t1") - F.col(t)
    top = F.greatest(a, b)
    area = F.when((a >= 0) & (b >= 0), dt * (a + b) / 2).when(top > 0, dt * top * top / (2 * F.abs(b - a))).otherwise(0.0)
    return d.groupBy(key).agg((F.sum(area) / F.sum(dt)).alias("mean"))
