"""What grows with a table's rows: results that don't depend on their order, passes over inputs, files that stay."""

import datetime as dt

from pyspark.sql import functions as F

from shelfspan.functions import periods, text
from shelfspan.operators import panel, reports
from shelfspan.plans import derived
from shelfspan.sources import shared


def files(spark) -> int:
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(f.getName().startswith("shuffle_") for f in (blocks.apply(k) for k in range(blocks.size())))


def test_panel_file_is_the_same_in_any_order(spark, tmp_path):
    day = dt.datetime(1999, 3, 5)
    lines = [(k, 5, p, 1.0, day) for k, p in enumerate([0.1, 0.2, 0.3, 1e5, 0.7, 0.01])]
    tables = {
        "part": ([(5, "large ring", "Brand#7", "LARGE", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": ([(k, 1) for k in range(6)], "o_orderkey long, o_custkey long"),
        "customer": ([(1, 1)], "c_custkey long, c_nationkey int"),
        "nation": ([(1, 1)], "n_nationkey int, n_regionkey int"),
        "region": ([(1, "EUROPE")], "r_regionkey int, r_name string"),
    }
    got = []
    for name, order in (("a", lines), ("b", lines[::-1]), ("c", lines[3:] + lines[:3])):
        for t, (rows, schema) in {**tables, "lineitem": (order, "l_orderkey long, l_partkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp")}.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        got.append({(r["Markets"], r["$"], r["Units"]) for r in derived.panel_file(spark, f"{tmp_path}/{name}").collect()})
    assert got[0] == got[1] == got[2] == {("Acme EUROPE TA", 200002.62, 6.0), ("Acme Total US", 200002.62, 6.0)}


def test_labels_are_parsed_without_a_second_pass(spark, tmp_path):
    spark.createDataFrame([("Jan 2000",), ("hello",), (None,), ("Jan 2000",)], "label string").write.parquet(f"{tmp_path}/t")
    df = periods.with_parsed(spark.read.parquet(f"{tmp_path}/t"), F.col("label"), "t")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert sorted((r.label or "", r.t and str(r.t.period_end)) for r in df.collect()) == [("", None), ("Jan 2000", "2000-01-31"), ("Jan 2000", "2000-01-31"), ("hello", None)]


def test_stored_tables_leave_no_shuffle(spark):
    before, setting = files(spark), spark.conf.get(shared._TIDY, None)
    df = spark.range(1000).repartition(4).groupBy((F.col("id") % 10).alias("k")).count()
    assert shared.stored(df).count() == 10 and len(shared.collected(df)) == 10
    assert files(spark) <= before + 8  # the count's own
    assert spark.conf.get(shared._TIDY, None) == setting


def test_blanks_and_numbers_of_panels(spark):
    seen = spark.createDataFrame([(" a  b ",), ("\ta\x0bb\n",), ("a b",), ("   ",), ("",), (None,), ("a b",)], "x string")
    assert [r[0] for r in seen.select(text.clean_label(F.col("x"))).collect()] == ["a b", "a b", "a b", None, None, None, "a b"]
    header = "Periods string, Markets string, UPC string, Brand string, Category string, `$` double, Units string"
    export = spark.createDataFrame([("Jan 2000", m, u, "b", "c", s, "(3)") for m, u, s in (("Acme", "012345678905", 1.5), ("Acme", "1", float("nan")), (" \t", "1", 1.0), ("Acme", None, 1.0), ("Acme", "2", None), ("Acme", "3", float("inf")))], header)
    assert [(r.market, r.dollar_sales, r.unit_sales, r.upc_key) for r in panel.validate(export).panel.collect()] == [("Acme", 1.5, -3.0, "1234567890")]


def test_totals_keep_cents(spark):
    sales = [302448726472.08, 0.01, -302448726472.08, 0.02] * 3
    for rows in (sales, sales[::-1], sorted(sales)):
        assert spark.createDataFrame([(x,) for x in rows], "sales double").agg(reports.total("sales")).first()[0] == 0.09
