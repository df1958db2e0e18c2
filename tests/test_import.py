"""Import rules on files and hand-made rows."""
from datetime import datetime, timedelta

import pytest
from helpers import MIN
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import quality as Q
from tidemark.sources import catalog as K
from tidemark.sources import readers as R
from tidemark.sources import sinks as W

T0 = datetime(2026, 1, 1)


def wide_file(path):
    rows = [f"{T0 + timedelta(minutes=10 * i)},5,{i}," for i in range(39)]
    last = T0 + timedelta(minutes=380)
    rows += [f"{last},5,38,", f"{last},5,n/a,"]
    path.write_text("date,T1,F26,Unnamed: 3\n" + "\n".join(rows) + "\n")


def test_wide_csv_rules(spark, tmp_path):
    f = tmp_path / "242000_tags.csv"
    wide_file(f)
    raw = R.with_file_row(R.read_text_csv(spark, str(f)))
    long = R.accepted(R.wide_to_long(raw, "ht", f.name)).cache()
    assert long.count() == 82 and {r[0] for r in long.select("metric_id").distinct().collect()} == {"ht.T1", "ht.F26"}
    assert sorted(r[0] for r in long.filter("metric_id = 'ht.T1'").select("source_row").collect()) == list(range(2, 43))
    d = Q.flag_observations(long).cache()
    # exact copies collapse: three equal T1 rows become one, one F26 copy goes
    assert d.count() == 79
    f26 = {(r.value, r.flags) for r in d.filter("metric_id = 'ht.F26' AND conflict").collect()}
    assert f26 == {(38.0, "conflict"), (None, "conflict|invalid")}
    flat = d.filter("metric_id = 'ht.T1' AND flatline").agg(F.min("source_row"), F.count("*")).first()
    assert flat[0] == 2 + 36 and flat[1] == 3  # the 37th equal reading closes six hours
    tally = {(r.code, r.metric_id): r["count"] for r in Q.issue_tally(d).collect()}
    assert tally[("conflict", "ht.F26")] == 3 and tally[("duplicate", "ht.T1")] == 2 and tally[("flatline", "ht.T1")] == 3


def test_flatline_resets_after_gap_and_never_for_labs(spark):
    rows = []
    for metric, source in (("ht.T1", "kip"), ("lims.ht.2.X", "lims")):
        for start in (0, 3000):
            rows += [(metric, (start + 10 * i) * MIN, 5.0, False, source, i) for i in range(37)]
    d = spark.createDataFrame(rows, "metric_id string, t long, value double, invalid boolean, source string, source_row long")
    flat = Q.flag_observations(d, width=120 * MIN).filter("flatline").collect()
    assert sorted(r.t // MIN for r in flat) == [360, 3360] and {r.metric_id for r in flat} == {"ht.T1"}


def test_paired_sheets(spark):
    cols = ["a", "b", "c", "d", "e", "f"]
    pairs = R.lab_pairs(["Hydro, point '2'", None, None, None, "Column, point '1.5'", None], ["S", None, "D15", None, "T", None], ["mg", None, None, None, "C", None], cols,
                        lambda g: "ht" if "hydro" in g.lower() else "avt", lambda g: g.split("'")[1])
    assert [p.metric_id for p in pairs] == ["lims.ht.2.S", "lims.ht.2.D15", "lims.avt.1.5.T"] and pairs[0].unit == "mg"
    d = spark.createDataFrame([(5, "2026-01-01 10:00:00", "8,5", None, None, "2026-01-02", "x"), (6, "2026-01-01T10:00:00Z", "1", "junk", "2", None, "3")],
                              "source_row int, a string, b string, c string, d string, e string, f string")
    long = R.paired_to_long(d, pairs, "lims", "sheet")
    got = {(r.metric_id, r.source_row): (r.value, r.invalid) for r in R.accepted(long).collect()}
    assert got == {("lims.ht.2.S", 5): (8.5, False), ("lims.avt.1.5.T", 5): (None, True)}
    bad = {(r.code, r.metric_id): r["count"] for r in R.rejected(long).collect()}
    assert bad == {("timezone_timestamp", "lims.ht.2.S"): 1, ("invalid_timestamp", "lims.ht.2.D15"): 1, ("invalid_timestamp", "lims.avt.1.5.T"): 1}
    heads = R.analyser_pairs(["24-2000:Mg.Sulfur", "v", None, "24-2000:D15", "v"], ["mg/kg", None, None, "kg", None], list("abcde"), "ht")
    assert [(p.metric_id, p.time, p.value) for p in heads] == [("pak.ht.Mg.Sulfur", "a", "b"), ("pak.ht.D15", "d", "e")]


def test_bad_file_does_not_stop_the_others(spark, tmp_path):
    good, bad = tmp_path / "avt_tags.csv", tmp_path / "broken.csv"
    wide_file(good)
    bad.write_text("x,y\n1,2\n")

    def kip(s, path):
        df = R.with_file_row(R.read_text_csv(s, path))
        return f"kip:{path}", R.wide_to_long(df, "avt", path)

    assert R.route(str(good)) == "tags" and R.route("kip.csv") == "kip" and R.route("~$x.csv") is None
    long, issues = R.import_files(spark, [str(good), str(bad), str(good)], {"kip": kip, "tags": kip})
    assert long.count() == 82 and [i["code"] for i in issues] == ["source_error", "source_error"]


def test_lenient_parsing(spark):
    d = spark.createDataFrame([(" 1,5 ",), ("inf",), ("NaN",), ("abc",), (None,), ("-2e3",)], "x string")
    assert [r[0] for r in d.select(C.parse_number("x")).collect()] == [1.5, None, None, None, None, -2000.0]
    t = spark.createDataFrame([("2026-01-01 10:00:00",), ("2026-01-01T10:00:00+03:00",), ("nope",), ("2026-01-01",)], "x string")
    assert [r[0] is not None for r in t.select(C.parse_time("x")).collect()] == [True, False, False, True]


def test_file_rows_survive_splits(spark, tmp_path):
    f = tmp_path / "big.csv"
    f.write_text("a,b\n" + "\n".join(f"{i},{'x' * 50}" for i in range(4000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = R.with_file_row(R.read_text_csv(spark, str(f)))
        assert d.rdd.getNumPartitions() >= 1 and d.filter("cast(a as int) + 2 != source_row").count() == 0 and d.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sinks(spark, tmp_path):
    rec = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    for _ in range(2):
        W.append_log(spark, rec, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    d = spark.createDataFrame([("=SUM(A1)",), ("plain",), ("-1",)], "x string")
    assert [r[0] for r in d.select(C.csv_safe("x")).collect()] == ["'=SUM(A1)", "plain", "'-1"]
    W.write_csv(d, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfx")
    assert W.file_inventory(spark, str(tmp_path / "log")).filter("bytes > 0").count() > 0


def test_catalog_override(spark):
    base = spark.createDataFrame([("a", "A", None, None), ("b", "B", "described", "u"), ("c", "C", None, None)], "metric_id string, label string, description string, unit string")
    over = spark.createDataFrame([("a", "RA", "ra", "x"), ("b", "RB", "rb", None)], "metric_id string, label string, description string, unit string")
    got = {r.metric_id: (r.label, r.description, r.unit, r.mapping_warning) for r in K.build_catalog(base, over, ["label", "description", "unit"]).collect()}
    assert got == {"a": ("RA", "ra", "x", None), "b": ("B", "described", "u", None), "c": ("C", None, None, "unknown_mapping")}
