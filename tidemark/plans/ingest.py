"""Import: reshaping, lenient parsing, quality flags, manifest, catalog, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import quality as Q
from ..sources import catalog as K
from ..sources import readers as R
from ..sources import sinks as W
from .adapter import ANALYSER, CONTROLS, END, LAB, MIDDLE, OBS, VALID, SUSPECT, obs, table, ts_text
from .registry import query, rounded
from .series import round_all, us

H, M = C.HOUR, C.MINUTE


def raw_rows(spark, sf):
    """Observation rows before flagging; values below 1 count as unreadable."""
    o = obs(spark, sf)
    bad = F.col("value") < 1
    return o.select("metric_id", "t", F.when(~bad, F.floor(F.col("value") / 100).cast("double")).alias("value"), bad.alias("invalid"),
                    "source", "unit", "source_file", "source_row")


def flagged(spark, sf):
    return Q.flag_observations(raw_rows(spark, sf), 2 * H, 2 * H, width=6 * H, suspect=F.coalesce(F.col("value") >= 3, F.lit(False)))


FLAGGED = OBS + f""", r AS (SELECT metric_id, epoch_us(timestamp) AS t, CASE WHEN value >= 1 THEN floor(value / 100) END AS value, value < 1 AS invalid, source, source_row FROM obs),
  c AS (SELECT metric_id, t, value, invalid, min(source) AS source, min(source_row) AS source_row, count(*) AS copies FROM r GROUP BY 1, 2, 3, 4),
  k AS (SELECT *, count(*) OVER (PARTITION BY metric_id, t) > 1 AS conflict FROM c),
  a AS (SELECT *, lag(value) OVER w AS pv, lag(invalid) OVER w AS pi, lag(t) OVER w AS pt FROM k WINDOW w AS (PARTITION BY metric_id ORDER BY t, source_row)),
  b AS (SELECT *, NOT coalesce(value = pv AND NOT pi AND NOT invalid AND t - pt <= {2 * H}, FALSE) AS brk FROM a),
  d AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY metric_id ORDER BY t, source_row) AS run FROM b),
  e AS (SELECT *, min(t) OVER (PARTITION BY metric_id, run) AS st FROM d),
  f AS (SELECT *, source IN ('kip', 'pak') AND NOT brk AND t - st >= {2 * H} AS flatline, coalesce(value >= 3, FALSE) AS suspect FROM e),
  fl AS (SELECT *, concat_ws('|', CASE WHEN conflict THEN 'conflict' END, CASE WHEN flatline THEN 'flatline' END, CASE WHEN invalid THEN 'invalid' END, CASE WHEN suspect THEN 'suspect' END) AS flags FROM f)
"""


@query("flagged_observations", "Q4 Q5 Q6 Q8", FLAGGED + f"SELECT metric_id, {ts_text('make_timestamp(t)')} AS timestamp, value, source, flags, source_row, copies FROM fl")
def _(spark, sf):
    return flagged(spark, sf).select("metric_id", C.from_micros("t").alias("timestamp"), "value", "source", "flags", "source_row", "copies")


@query("issue_tally", "Q9 Q10", FLAGGED + """, u AS (SELECT 'duplicate' AS code, metric_id, sum(copies - 1) AS n FROM fl GROUP BY 2 UNION ALL
   SELECT 'conflict', metric_id, sum(copies) FROM fl WHERE conflict GROUP BY 2 UNION ALL SELECT 'suspect', metric_id, count(*) FROM fl WHERE suspect GROUP BY 2
   UNION ALL SELECT 'flatline', metric_id, count(*) FROM fl WHERE flatline GROUP BY 2)
  SELECT code, metric_id, CAST(n AS BIGINT) AS count, CAST(sum(n) OVER (PARTITION BY code) AS BIGINT) AS code_count FROM u WHERE n > 0""")
def _(spark, sf):
    t = Q.issue_tally(flagged(spark, sf))
    total = t.groupBy("code").agg(F.sum("count").alias("code_count"))
    return t.join(total, "code")


@query("import_manifest", "S9 S10", FLAGGED + f"""SELECT source, 'events' AS source_file, count(*) AS rows, count(DISTINCT t) AS frame_count, {ts_text('make_timestamp(min(t))')} AS start,
   {ts_text('make_timestamp(max(t))')} AS "end", count(*) FILTER (WHERE invalid) AS invalid_count, count(*) FILTER (WHERE flatline OR suspect) AS suspect_count,
   CAST(sum(copies - 1) AS BIGINT) AS duplicate_count, 'ready' AS status FROM fl GROUP BY source""")
def _(spark, sf):
    s = Q.source_stats(flagged(spark, sf))
    return s.withColumn("status", F.when(F.col("rows") > 0, "ready").otherwise("error"))


@query("first_ready_dataset", "S10", """SELECT o_orderpriority AS dataset, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS created, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 0
   ORDER BY max(o_orderdate) DESC, o_orderpriority LIMIT 1""")
def _(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.max("o_orderdate").alias("created"), F.count("*").alias("rows"))
    return d.filter("rows > 0").orderBy(F.col("created").desc(), "dataset").limit(1)


WIDE_TAGS = {"l_quantity": "Q", "l_extendedprice": "E", "l_discount": "D", "l_tax": "X"}


@query("wide_to_long", "S1 Q1 Q2", """WITH w AS (SELECT l_orderkey AS source_row, l_shipdate, CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE replace(CAST(l_quantity AS VARCHAR), '.', ',') END AS Q,
     CAST(l_extendedprice AS VARCHAR) AS E, CAST(l_discount AS VARCHAR) AS D, CAST(l_tax AS VARCHAR) AS X FROM lineitem),
   l AS (UNPIVOT w ON Q, E, D, X INTO NAME code VALUE raw)
   SELECT 'line.' || code AS metric_id, count(*) AS rows, count(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE)) AS numeric_rows,
     count(*) FILTER (WHERE TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) IS NULL) AS invalid_rows, round(sum(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE)), 2) AS total,
     strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS start, CAST(sum(source_row) AS BIGINT) AS row_sum FROM l GROUP BY 1""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    wide = l.select(F.col("l_orderkey").alias("source_row"), F.col("l_shipdate").cast("string").alias("date"),
                    F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.translate(F.col("l_quantity").cast("string"), ".", ",")).alias("Q"),
                    F.col("l_extendedprice").cast("string").alias("E"), F.col("l_discount").cast("string").alias("D"), F.col("l_tax").cast("string").alias("X"),
                    F.lit("").alias("Unnamed: 5"))
    long = R.accepted(R.wide_to_long(wide, "line", "lineitem"))
    return long.groupBy("metric_id").agg(
        F.count("*").alias("rows"), F.count("value").alias("numeric_rows"), F.count_if("invalid").alias("invalid_rows"), rounded(F.sum("value"), 2).alias("total"),
        F.min("timestamp").alias("start"), F.sum("source_row").alias("row_sum"))


PAIRED = """WITH s AS (SELECT l_orderkey AS source_row, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS t1,
     CASE WHEN l_linenumber % 5 = 0 THEN 'trace' WHEN l_linenumber % 7 = 6 THEN NULL ELSE CAST(l_quantity AS VARCHAR) END AS v1,
     CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN strftime(l_shipdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') || 'Z' ELSE strftime(l_shipdate + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS t2,
     CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_extendedprice AS VARCHAR) END AS v2 FROM lineitem),
   l AS (SELECT 'lims.ht.2.Quantity' AS metric_id, 'pcs' AS unit, t1 AS t, v1 AS v, source_row FROM s WHERE t1 IS NOT NULL OR v1 IS NOT NULL
     UNION ALL SELECT 'lims.ht.2.Price', 'usd', t2, v2, source_row FROM s WHERE t2 IS NOT NULL OR v2 IS NOT NULL)
"""


def paired_long(spark, sf):
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    sheet = l.select(
        F.col("l_orderkey").alias("source_row"), text("l_shipdate").alias("t1"),
        F.when(n % 5 == 0, "trace").when(n % 7 == 6, None).otherwise(F.col("l_quantity").cast("string")).alias("v1"),
        F.when(n % 3 == 0, None).when(n % 3 == 1, F.concat(text(F.col("l_shipdate") + F.expr("INTERVAL 1 HOUR")), F.lit("Z"))).otherwise(
            text(F.col("l_shipdate") + F.expr("INTERVAL 2 HOURS"))).alias("t2"),
        F.when(n % 3 == 0, None).otherwise(F.col("l_extendedprice").cast("string")).alias("v2"))
    pairs = R.lab_pairs(["Hydro unit, point '2'", None, None, None], ["Quantity", None, "Price", None], ["pcs", None, "usd", None], ["t1", "v1", "t2", "v2"],
                        lambda g: "ht" if "hydro" in g.lower() else "avt", lambda g: g.split("'")[1])
    return R.paired_to_long(sheet, pairs, "lims", "lineitem")


@query("paired_to_long", "S2 Q3", PAIRED + """SELECT metric_id, unit, count(*) AS rows, count(TRY_CAST(v AS DOUBLE)) AS numeric_rows, round(sum(TRY_CAST(v AS DOUBLE)), 2) AS total,
    strftime(min(TRY_CAST(t AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS start FROM l WHERE t IS NOT NULL AND t NOT LIKE '%Z' GROUP BY 1, 2""")
def _(spark, sf):
    return R.accepted(paired_long(spark, sf)).groupBy("metric_id", "unit").agg(
        F.count("*").alias("rows"), F.count("value").alias("numeric_rows"), rounded(F.sum("value"), 2).alias("total"), F.min("timestamp").alias("start"))


@query("rejected_times", "Q2 S4", PAIRED + "SELECT 'timezone_timestamp' AS code, metric_id, count(*) AS count FROM l WHERE t LIKE '%Z' GROUP BY 2")
def _(spark, sf):
    return R.rejected(paired_long(spark, sf))


@query("analyser_pairs_to_long", "S3", """SELECT 'pak.ht.Mg.Sulfur' AS metric_id, 'mg/kg' AS unit, count(*) AS rows, round(sum(value), 2) AS total, strftime(min(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS start FROM events WHERE event_type = 'view'
   UNION ALL SELECT 'pak.ht.D15', 'kg/m3', count(*), round(sum(user_id), 2), strftime(min(date_trunc('second', ts) + INTERVAL 1 MINUTE), '%Y-%m-%d %H:%M:%S') FROM events WHERE event_type = 'view'""")
def _(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'view'")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    sheet = e.select(F.col("event_id").alias("source_row"), text("ts").alias("a"), F.col("value").cast("string").alias("b"),
                     text(F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("d"), F.col("user_id").cast("string").alias("e"))
    pairs = R.analyser_pairs(["24-2000:Mg.Sulfur", "value", None, "24-2000:D15", "value"], ["mg/kg", None, None, "kg/m3", None], ["a", "b", "_", "d", "e"], "ht")
    long = R.accepted(R.paired_to_long(sheet, pairs, "pak", "events"))
    return long.groupBy("metric_id", "unit").agg(F.count("*").alias("rows"), rounded(F.sum("value"), 2).alias("total"), F.min("timestamp").alias("start"))


@query("unparseable_rows", "Q16", PAIRED + """SELECT metric_id, t AS raw_time, v AS raw_value, count(*) AS rows FROM l WHERE (t IS NOT NULL OR v IS NOT NULL) AND
   (t IS NULL OR t LIKE '%Z' OR v IS NULL OR TRY_CAST(v AS DOUBLE) IS NULL) GROUP BY 1, 2, 3""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    cells = F.array(
        F.struct(F.lit("lims.ht.2.Quantity").alias("metric_id"), text("l_shipdate").alias("raw_time"),
                 F.when(n % 5 == 0, "trace").when(n % 7 == 6, None).otherwise(F.col("l_quantity").cast("string")).alias("raw_value")),
        F.struct(F.lit("lims.ht.2.Price").alias("metric_id"),
                 F.when(n % 3 == 0, None).when(n % 3 == 1, F.concat(text(F.col("l_shipdate") + F.expr("INTERVAL 1 HOUR")), F.lit("Z"))).otherwise(
                     text(F.col("l_shipdate") + F.expr("INTERVAL 2 HOURS"))).alias("raw_time"),
                 F.when(n % 3 == 0, None).otherwise(F.col("l_extendedprice").cast("string")).alias("raw_value")))
    return Q.unparseable(l.select(F.inline(cells)), "raw_time", "raw_value").groupBy("metric_id", "raw_time", "raw_value").agg(F.count("*").alias("rows"))


@query("tag_dimension", "S5", """WITH c AS (SELECT 'avt' AS plant, trim(p_brand) AS tag, p_name AS d, p_partkey AS r FROM part UNION ALL SELECT 'ht', 'P' || p_size, p_type, p_partkey FROM part)
   SELECT plant, tag, arg_max(d, r) AS description FROM c GROUP BY 1, 2""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("source_row"), "p_name", "p_brand", "p_type", F.concat(F.lit("P"), F.col("p_size").cast("string")).alias("size"))
    return R.tag_dimension(p, [("avt", "p_name", "p_brand"), ("ht", "p_type", "size")])


@query("plant_and_point", "Q3", """SELECT CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'widget') THEN 'ht' ELSE 'avt' END AS plant, regexp_extract(p_brand, 'Brand#([0-9]+)', 1) AS point, count(*) AS n FROM part GROUP BY 1, 2""")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy(C.plant_of("p_name", {"ht": ("ring", "widget")}, "avt").alias("plant"), F.regexp_extract("p_brand", "Brand#([0-9]+)", 1).alias("point")).agg(F.count("*").alias("n"))


@query("physical_range_flags", "Q7", """WITH v AS (SELECT ['lims.a.I250', 'pak.ht.D15', 'lims.ht.2.95%.T', 'ht.Sulfur'][1 + l_linenumber % 4] AS metric_id, CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 3 WHEN 1 THEN l_extendedprice / 40
     WHEN 2 THEN l_extendedprice / 50 ELSE l_quantity - 10 END AS value FROM lineitem)
   SELECT metric_id, count(*) AS n, count(*) FILTER (WHERE CASE WHEN metric_id LIKE '%.I250' THEN NOT value BETWEEN 0 AND 100 WHEN metric_id LIKE '%.D15' THEN NOT value BETWEEN 500 AND 1200
     WHEN metric_id LIKE '%.T' THEN value > 1000 ELSE value < 0 END) AS suspect FROM v GROUP BY 1""")
def _(spark, sf):
    l, k = table(spark, sf, "lineitem"), F.col("l_linenumber") % 4
    mid = F.element_at(F.array(*[F.lit(x) for x in ("lims.a.I250", "pak.ht.D15", "lims.ht.2.95%.T", "ht.Sulfur")]), k + 1)
    v = F.when(k == 0, F.col("l_quantity") * 3).when(k == 1, F.col("l_extendedprice") / 40).when(k == 2, F.col("l_extendedprice") / 50).otherwise(F.col("l_quantity") - 10)
    return l.select(mid.alias("metric_id"), v.alias("value")).groupBy("metric_id").agg(F.count("*").alias("n"), F.count_if(C.suspect_range("metric_id", "value")).alias("suspect"))


@query("export_rows", "S8 T1 S12", OBS + f"""SELECT metric_id, {ts_text('timestamp')} AS timestamp, value, source, flags, source_row FROM obs WHERE metric_id IN ('{LAB}', '{ANALYSER}')
   AND timestamp >= TIMESTAMP '{MIDDLE}' AND timestamp < TIMESTAMP '{END}'""")
def _(spark, sf):
    return W.export_rows(obs(spark, sf, MIDDLE, END).drop("unit", "source_file"), [LAB, ANALYSER], us(MIDDLE), us(END)).drop("t")


@query("formula_text_guard", "S8", """SELECT CASE WHEN regexp_matches(x, '^[=+@-]') THEN '''' || x ELSE x END AS text, count(*) AS n FROM (SELECT substr('=+-@ab', 1 + CAST(p_partkey % 6 AS INTEGER), 1) || p_type AS x FROM part) GROUP BY 1""")
def _(spark, sf):
    x = F.concat(F.expr("substring('=+-@ab', 1 + cast(p_partkey % 6 as int), 1)"), F.col("p_type"))
    return table(spark, sf, "part").select(C.csv_safe(x).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


MERGE = """WITH a AS (SELECT l_shipdate AS timestamp, l_quantity AS x FROM lineitem),
  b AS (SELECT o_orderdate AS timestamp, round(o_totalprice / 100000) AS y FROM orders),
  ga AS (SELECT timestamp, CASE WHEN min(x) = max(x) AND count(x) = count(*) THEN max(x) END AS x FROM a GROUP BY 1),
  gb AS (SELECT timestamp, CASE WHEN min(y) = max(y) AND count(y) = count(*) THEN max(y) END AS y FROM b GROUP BY 1)
"""


@query("merged_telemetry", "S14", MERGE + "SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, x AS avt__x, y AS ht__y FROM ga FULL JOIN gb USING (timestamp)")
def _(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("x"))
    b = table(spark, sf, "orders").select(F.col("o_orderdate").alias("timestamp"), F.round(F.col("o_totalprice") / 100000).alias("y"))
    return R.merge_wide({"avt": a, "ht": b})


@query("lab_target", "S15", OBS + f"""SELECT {ts_text('timestamp')} AS target_time, arg_max(value, source_row) AS target FROM obs WHERE metric_id = '{LAB}' GROUP BY timestamp""")
def _(spark, sf):
    o = obs(spark, sf).filter(F.col("metric_id") == LAB)
    sheet = o.select("source_row", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("value").cast("string").alias("cell"))
    long = R.accepted(R.paired_to_long(sheet, [R.Pair("time", "cell", LAB)], "lims", "events")).filter("value IS NOT NULL")
    return long.groupBy("timestamp").agg(F.max_by("value", "source_row").alias("target")).withColumnRenamed("timestamp", "target_time")


CATALOG = """WITH base AS (SELECT 'm.' || p_partkey AS metric_id, p_type AS label, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS description, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS unit FROM part),
  reg AS (SELECT 'm.' || p_partkey AS metric_id, 'R-' || p_name AS label, 'text ' || p_partkey AS description, 'u' || p_size AS unit FROM part WHERE p_partkey % 5 = 0),
  cat AS (SELECT b.metric_id, CASE WHEN r.metric_id IS NOT NULL AND b.description IS NULL THEN r.label ELSE b.label END AS label,
    CASE WHEN r.metric_id IS NOT NULL AND b.description IS NULL THEN r.description ELSE b.description END AS description, coalesce(r.unit, b.unit) AS unit,
    CASE WHEN r.metric_id IS NULL AND b.description IS NULL THEN 'unknown_mapping' END AS mapping_warning FROM base b LEFT JOIN reg r USING (metric_id))
"""


def catalog_rows(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    mid = F.concat(F.lit("m."), k.cast("string")).alias("metric_id")
    base = p.select(mid, F.col("p_type").alias("label"), F.when(k % 3 == 0, F.col("p_name")).alias("description"), F.when(k % 2 == 0, F.col("p_brand")).alias("unit"))
    reg = p.filter(k % 5 == 0).select(mid, F.concat(F.lit("R-"), "p_name").alias("label"), F.concat(F.lit("text "), k.cast("string")).alias("description"),
                                      F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("unit"))
    return K.build_catalog(base, reg, ["label", "description", "unit"])


@query("metric_catalog", "S11", CATALOG + "SELECT * FROM cat")
def _(spark, sf):
    return catalog_rows(spark, sf)


@query("derived_catalog_entries", "S11 U1", """WITH have AS (SELECT DISTINCT 'ev.' || event_type AS m FROM events), rules(metric_id, i) AS (VALUES ('derived.a', ['ev.click', 'ev.view']), ('derived.b', ['ev.click', 'ev.absent']), ('derived.c', ['ev.purchase']))
   SELECT metric_id, count(*) AS inputs FROM (SELECT metric_id, unnest(i) AS x FROM rules) GROUP BY 1 HAVING bool_and(x IN (SELECT m FROM have))""")
def _(spark, sf):
    rules = spark.createDataFrame([("derived.a", ["ev.click", "ev.view"]), ("derived.b", ["ev.click", "ev.absent"]), ("derived.c", ["ev.purchase"])], "metric_id string, inputs array<string>")
    return K.derived_metrics(obs(spark, sf).select("metric_id").distinct(), rules).select("metric_id", F.size("inputs").cast("long").alias("inputs"))


@query("metric_selection", "S12 U4 J8", """WITH w AS (SELECT c_custkey AS request, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS position, unnest(l) AS m FROM (SELECT c_custkey, string_split(c_mktsegment || ',ev.click, ev.view,ev.click,' || CAST(c_nationkey AS VARCHAR), ',') AS l FROM customer)),
   f AS (SELECT request, trim(m) AS metric_id, min(position) AS position FROM w WHERE trim(m) <> '' GROUP BY 1, 2)
   SELECT request, metric_id, position, metric_id IN (SELECT 'ev.' || event_type FROM events) AS known FROM f""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    parts = F.split(F.concat(F.col("c_mktsegment"), F.lit(",ev.click, ev.view,ev.click,"), F.col("c_nationkey").cast("string")), ",")
    w = c.select(F.col("c_custkey").alias("request"), F.posexplode(parts).alias("position", "metric_id"))
    return K.select_metrics(obs(spark, sf).select("metric_id").distinct(), w).select("request", "metric_id", "position", "known")


@query("selection_rule", "S12", """WITH w AS (SELECT o_custkey % 400 AS request, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE 'm' || (o_orderkey % 40) END AS m FROM orders), c AS (SELECT DISTINCT 'm' || p_partkey % 39 AS id FROM part),
   f AS (SELECT request, m, m IN (SELECT id FROM c) AS known FROM (SELECT DISTINCT request, trim(m) AS m FROM w WHERE trim(m) <> '')), a AS (SELECT r.request, count(m) AS n, count(*) FILTER (WHERE m IS NOT NULL AND NOT known) AS unknown FROM (SELECT DISTINCT request FROM w) r LEFT JOIN f USING (request) GROUP BY 1)
   SELECT request, n, unknown, CASE WHEN n = 0 THEN 'empty' WHEN n > 20 THEN 'too_many' WHEN unknown > 0 THEN 'unknown_metric' END AS refused FROM a""")
def _(spark, sf):
    k = F.col("o_orderkey")
    w = table(spark, sf, "orders").select((F.col("o_custkey") % 400).alias("request"), k.alias("position"), F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit("m"), (k % 40).cast("string"))).alias("metric_id"))
    known = table(spark, sf, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 39).cast("string")).alias("metric_id")).distinct()
    return K.selection_verdict(known, w)


@query("catalog_search", "T5", CATALOG + """SELECT metric_id, label, metric_id IN ('m.5', 'm.10') AS selected FROM cat WHERE contains(lower(metric_id || ' ' || label), 'r-red')""")
def _(spark, sf):
    return K.search(catalog_rows(spark, sf), "R-RED", ["m.5", "m.10"]).select("metric_id", "label", "selected")


@query("catalog_facets", "T5", OBS + "SELECT source, split_part(metric_id, '.', 1) AS plant, CAST(count(DISTINCT metric_id) AS BIGINT) AS metrics FROM obs GROUP BY 1, 2")
def _(spark, sf):
    m = obs(spark, sf).select("source", "metric_id").distinct()
    return m.groupBy("source", F.split_part("metric_id", F.lit("."), F.lit(1)).alias("plant")).agg(F.count("*").alias("metrics"))


@query("catalog_complete_statistics", "J9 U4", CATALOG + """SELECT c.metric_id, count(l.l_partkey) AS count, round(avg(l_quantity), 6) AS mean FROM cat c LEFT JOIN lineitem l ON c.metric_id = 'm.' || l.l_partkey GROUP BY 1""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))
    l = l.withColumn("metric_id", F.concat(F.lit("m."), F.col("l_partkey").cast("string")))
    return catalog_rows(spark, sf).join(l, "metric_id", "left").select("metric_id", F.coalesce("n", F.lit(0)).alias("count"), rounded(F.col("mean")).alias("mean"))


@query("metrics_without_data", "U4", """SELECT 'c.' || c_custkey AS metric_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(spark, sf):
    name = lambda key: F.concat(F.lit("c."), F.col(key).cast("string")).alias("metric_id")
    return table(spark, sf, "customer").select(name("c_custkey")).join(table(spark, sf, "orders").select(name("o_custkey")), "metric_id", "left_anti")


@query("formula_versions", "P6", """WITH r AS (SELECT p_partkey AS formula_id, p_type AS expression, CASE WHEN p_partkey % 4 = 0 THEN 'expert-1' ELSE 'v1' END AS version, 'verified' AS status FROM part),
   u AS (SELECT p_partkey AS formula_id, CASE WHEN p_size > 25 THEN p_type ELSE p_name END AS x FROM part WHERE p_partkey % 2 = 0)
   SELECT formula_id, CASE WHEN x <> expression AND version NOT LIKE 'expert-%' THEN x ELSE expression END AS expression,
     CASE WHEN x <> expression AND version NOT LIKE 'expert-%' THEN 'source-' || substr(sha256(x), 1, 12) ELSE version END AS version,
     CASE WHEN x <> expression AND version NOT LIKE 'expert-%' THEN 'unresolved' ELSE status END AS status,
     CASE WHEN x <> expression AND version LIKE 'expert-%' THEN x END AS source_expression FROM r LEFT JOIN u USING (formula_id)""")
def _(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    reg = p.select(k.alias("formula_id"), F.col("p_type").alias("expression"), F.when(k % 4 == 0, "expert-1").otherwise("v1").alias("version"), F.lit("verified").alias("status"))
    up = p.filter(k % 2 == 0).select(k.alias("formula_id"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name")).alias("expression"))
    return K.formula_versions(reg, up)


@query("newest_records", "S18 T6", """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"))
    return o.orderBy(F.col("at").desc(), F.col("id").desc()).limit(50)


@query("record_content_ids", "S18", """SELECT count(*) AS records, count(DISTINCT sha256('{"at":' || o_orderkey || ',"status":"' || o_orderstatus || '"}')) AS ids FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return W.with_content_id(o).agg(F.count("*").alias("records"), F.count_distinct("record_id").alias("ids"))


@query("file_inventory", "S19")
def _(spark, sf):
    return W.file_inventory(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")
