"""Metric catalog, selections, formula versions: small dimensions joined to large rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_catalog(base: DataFrame, override: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Override values win where given, but a described metric keeps its own label and description."""
    o = override.select("metric_id", F.lit(True).alias("_known"), *[F.col(f).alias(f"_{f}") for f in fields])
    d = base.join(o, "metric_id", "left")
    described = F.col("description").isNotNull()
    for f in fields:
        win = F.col(f"_{f}").isNotNull()
        if f in ("label", "description"):
            win = win & ~described
        d = d.withColumn(f"_n_{f}", F.when(win, F.col(f"_{f}")).otherwise(F.col(f)))
    warning = F.when(F.coalesce("_known", F.lit(False)) | described, F.lit(None)).otherwise(F.lit("unknown_mapping"))
    keep = [x for x in base.columns if x not in fields]
    return d.select(*keep, *[F.col(f"_n_{f}").alias(f) for f in fields], warning.alias("mapping_warning"))


def derived_metrics(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``rules(metric_id, inputs array, ...)`` whose inputs all exist in the catalog.

    ``rules`` is the small side; only its ids are looked up.
    """
    need = rules.select("metric_id", F.size("inputs").alias("_n"), F.explode("inputs").alias("input"))
    have = need.join(catalog.select(F.col("metric_id").alias("input")).distinct(), "input", "left_semi").groupBy("metric_id", "_n").agg(F.count("*").alias("_k"))
    return rules.join(have.filter("_k = _n").select("metric_id"), "metric_id", "left_semi")


def select_metrics(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested ids in order without repeats and whether each exists. ``wanted(request, position, metric_id)``."""
    first = wanted.filter(F.trim("metric_id") != "").groupBy("request", F.trim("metric_id").alias("metric_id")).agg(F.min("position").alias("position"))
    known = catalog.select("metric_id", F.lit(True).alias("known")).distinct()
    return first.join(known, "metric_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def selection_verdict(catalog: DataFrame, wanted: DataFrame, limit: int = 20) -> DataFrame:
    """One row per request: different ids asked for, unknown ones, and why it is refused (NULL: accepted).

    A selection holds 1 to ``limit`` different ids, all of them known; blank and NULL ids do not count.
    """
    found = select_metrics(catalog, wanted).groupBy("request").agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("unknown"))
    d = wanted.select("request").distinct().join(found, "request", "left").select("request", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n", "unknown")])
    return d.withColumn("refused", F.when(F.col("n") == 0, "empty").when(F.col("n") > limit, "too_many").when(F.col("unknown") > 0, "unknown_metric"))


def search(catalog: DataFrame, text: str, selected: Sequence[str] = (), columns: Sequence[str] = ("metric_id", "label")) -> DataFrame:
    """Case-insensitive contains over the joined columns; selected rows first."""
    hay = F.lower(F.concat_ws(" ", *columns))
    hits = catalog.filter(F.contains(hay, F.lit(text.lower())))
    return hits.withColumn("selected", F.col("metric_id").isin(*selected) if selected else F.lit(False)).orderBy(F.col("selected").desc(), "metric_id")


def formula_versions(registry: DataFrame, uploaded: DataFrame) -> DataFrame:
    """An uploaded text that differs from the registry replaces it, unresolved, with a version from its hash.

    Expert versions keep their expression and only note the uploaded text.
    """
    d = registry.join(uploaded.select("formula_id", F.col("expression").alias("_up")), "formula_id", "left")
    differs = F.col("_up").isNotNull() & (F.col("_up") != F.col("expression"))
    expert = F.coalesce(F.col("version").startswith("expert-"), F.lit(False))
    swap = differs & ~expert
    return d.select(
        "formula_id",
        F.when(swap, F.col("_up")).otherwise(F.col("expression")).alias("expression"),
        F.when(swap, F.concat(F.lit("source-"), F.substring(F.sha2("_up", 256), 1, 12))).otherwise(F.col("version")).alias("version"),
        F.when(swap, "unresolved").otherwise(F.col("status")).alias("status"),
        F.when(differs & expert, F.col("_up")).alias("source_expression"))
