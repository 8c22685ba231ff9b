"""CSV files of unknown layout, and the measure of wide files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from shelfspan.operators import normalize, schema
from shelfspan.sources import tabular
from shelfspan.sources.records import read_records


def write(tmp_path, text):
    (tmp_path / "file.csv").write_text(text)
    return str(tmp_path / "file.csv")


def rows(loaded):
    return [tuple(r) for r in loaded.df.orderBy("source_row_id").drop("source_row_id").collect()]


def test_title_lines_and_ragged_rows(spark, tmp_path):
    path = write(tmp_path, 'Sales Report\n\nUPC,Market,Note,Sales\n071800000211,"Buffalo, NY",,"$1,200.50"\n000000000017,Albany\n,,,\n3,Troy,,(7)\n')
    got = tabular.load(spark, path)
    assert got.df.columns == ["UPC", "Market", "Sales", "source_row_id"] and got.header_row == 2 and got.file_name == "file.csv"
    assert rows(got) == [("071800000211", "Buffalo, NY", 1200.5), ("000000000017", "Albany", None), ("3", "Troy", -7.0)]
    assert got.notes


def test_repeated_and_missing_headers(spark, tmp_path):
    got = tabular.load(spark, write(tmp_path, "Sales of,Sales of,Market,City,\n1,,a,,x\n,4,,b,y\n"))
    assert got.df.columns == ["Sales of", "Sales of.1", "Market", "City", "Unnamed_4", "source_row_id"]
    assert rows(got) == [(1.0, None, "a", None, "x"), (None, 4.0, None, "b", "y")]


def test_empty_and_unknown_files(spark, tmp_path):
    assert rows(tabular.load(spark, write(tmp_path, ""))) == []
    assert rows(tabular.load(spark, write(tmp_path, "Market,Sales\n"))) == []
    with pytest.raises(ValueError, match="unsupported"):
        tabular.load(spark, "file.txt")


def test_sink_and_crosswalk(spark, tmp_path):
    tabular.write_csv(spark.createDataFrame([("a,b", 1)], "x string, y int"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("a,b", "1")]
    user = tabular.load(spark, write(tmp_path, "Client UPC,Panel UPC\n071800000211,71800000228\nX-1,\n"))
    got = tabular.crosswalk_file(user.df)
    assert got.columns == ["client_key", "panel_key", "position"] and got.where("panel_key is not null").count() == 1
    assert tabular.crosswalk_file(user.df.select(F.lit(1).alias("other"))) is None


def test_wide_file_takes_the_best_ranked_measure(spark, tmp_path):
    path = write(tmp_path, "UPC,Retailer,Jan 2025 Gross Sales,Jan 2025 Net Sales,Feb 2025 Gross Sales,Feb 2025 Net Sales\n071800000211,Acme,10,9,20,18\n071800000228,Acme,30,27,40,36\n")
    df = tabular.load(spark, path).df
    found = schema.detect(df)
    out = normalize.normalize(df, found.concepts, found.metrics, found.grain, found.mode, 0.9, found.wide)
    assert found.structure == "wide" and sorted(r[0] for r in out.select("sales_value").collect()) == [9.0, 18.0, 27.0, 36.0]


def test_structure_and_grain(spark):
    def found(header, *rows):
        d = schema.detect(spark.createDataFrame([*rows], ", ".join(f"`{h}` string" for h in header)))
        return d.structure, d.grain

    assert found(("UPC", "Month", "Sales"), *[("071800000211", m, "5") for m in ("Jan-25", "Feb-25")]) == ("long", "monthly")
    assert found(("UPC", "Fiscal Year", "Month", "Sales"), *[("071800000211", "2025", m, "5") for m in ("Jan-25", "Feb-25")])[0] == "mixed"
    # The week column tells no period, so the month does.
    assert found(("UPC", "Week Ending", "Month", "Sales"), *[("071800000211", w, m, "5") for w, m in (("x", "Jan-25"), ("y", "Feb-25"))])[1] == "monthly"


def test_spacing(spark):
    grain = lambda *days: schema.spacing_grain(spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d")), "d")
    assert [grain("2025-01-04", "2025-01-11"), grain("2025-01-31", "2025-02-28", "2025-03-31"), grain("2025-01-01", "2025-01-02"), grain("2025-01-01")] == ["weekly", "monthly", "unknown", "unknown"]
    assert grain("2025-01-01", "2025-01-02", "2025-01-09") == "weekly"


def spreads(rng, n):
    """Random records whose cells hold quotes, commas and line breaks, some wider than all before."""
    pieces = ["a", "b ", '"', '""', ",", "\n", "\n\n", "x,y", "é", '",', ',"', "5\" pipe"]
    return [["".join(rng.choice(pieces) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 5) if k != n - 10 else 9)] for k in range(n)]


@pytest.mark.parametrize("split", [64, 301, 100_000])
def test_records_against_the_csv_module(spark, tmp_path, split):
    rng, out = random.Random(split), io.StringIO()
    rows = spreads(rng, 400)
    csv.writer(out, lineterminator="\n").writerows(rows)
    # Quotes within open cells are text.
    out.write('5" pipe,"a""b",c"d"\nx,"y"z"w,v\n')
    (tmp_path / "odd.csv").write_bytes(out.getvalue().encode())
    want = list(csv.reader(io.StringIO(out.getvalue(), newline="")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = read_records(spark, str(tmp_path / "odd.csv"))
        got = [r.value for r in found.rows.orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [next(csv.reader(io.StringIO(v, newline="")), []) for v in got] == want
    assert found.width == max(map(len, want)) == 9


def test_breaks_in_cells_and_a_late_wide_line(spark, tmp_path):
    text = 'UPC,"Long\nheader",Sales\n' + "".join(f'{k},"line {k}\n""quoted"", and more",{k}\n' for k in range(300)) + '9,x,1,"far\nout",2\n'
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        got = tabular.load(spark, write(tmp_path, text))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.df.columns == ["UPC", "Long\nheader", "Sales", "Unnamed_3", "Unnamed_4", "source_row_id"]
    assert rows(got)[7] == ("7", 'line 7\n"quoted", and more', 7.0, None, None) and rows(got)[-1] == ("9", "x", 1.0, "far\nout", 2.0) and len(rows(got)) == 301


def test_folder_of_parts_and_open_ends(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    for k, text in enumerate(("﻿UPC,Market,Sales\n1,\"a\nb\",5\n", "", "2,c,6\n3,d,7")):
        (tmp_path / "parts" / f"part-{k}.csv").write_text(text)
    got = tabular.read_csv(spark, str(tmp_path / "parts"))
    assert got.df.columns[:3] == ["UPC", "Market", "Sales"] and rows(got) == [("1", "a\nb", 5.0), ("2", "c", 6.0), ("3", "d", 7.0)]
    with pytest.raises(ValueError, match="inside a quoted cell"):
        tabular.read_csv(spark, write(tmp_path, 'UPC,Sales\n1,"2\n3,4\n'))


def test_alternates_are_no_metrics(spark):
    rows = [(f"07180000021{k}", f"b{k}", "5", "7", "Jan-25") for k in range(8)]
    found = schema.detect(spark.createDataFrame(rows, "UPC string, Brand string, Units string, `Brand Sales` string, Month string"))
    assert found.metrics == {"unit": "Units"} and found.concepts["brand"] == "Brand"
    assert [m["concept"] for m in found.mappings if m["column"] == "Brand Sales" and m["role"] == "alternate"] == ["brand"]


@pytest.mark.parametrize(
    ("label", "want"),
    [("POS Sales $", ("sales", "pos", None, 1.0)), ("Net Rev", ("sales", "shipment", "net", 1.2)), ("Gross POS Sales", ("sales", "pos", "gross", 0.8)), ("Cases", ("volume", "shipment", None, 1.0)), ("EQ Vol", ("volume", None, "equivalized", 1.0)), ("Scan Units", ("unit", "pos", None, 1.0)), ("Promo Sales", ("other", None, "promotional / allowance metric", 0.0)), ("Foo", ("other", None, "unrecognized metric", 0.0))],
)
def test_metric_labels(label, want):
    m = schema.classify_metric(label)
    assert (m.kind, m.hint, m.modifier, m.rank) == want


def test_profile_reads_no_cell_twice(spark):
    df = spark.range(2000).select(F.col("id").alias("source_row_id"), F.when(F.col("id") % 4 == 0, "Jan-25").when(F.col("id") % 4 == 1, "x").alias("a b"), (F.col("id") % 7).cast("string").alias("n"), F.lit(None).cast("string").alias("none"), F.lit("  ").alias("blank"))
    got = {r["column"]: r for r in schema.profile(df.repartition(5)).collect()}
    assert got["a b"].non_null_rate == 0.5 and 0.35 < got["a b"].date_rate < 0.65 and got["a b"].distinct_values == 2
    assert (got["n"].numeric_rate, got["n"].date_rate, got["n"].distinct_values) == (1.0, 0.0, 7)
    assert got["none"].non_null_rate == got["blank"].non_null_rate == 0.0 and got["none"].rows == 2000
    assert schema.profile(df.limit(0)).count() == 4
    sample = schema.sampled(df, ["n"], lambda c: F.col(c), 50)
    assert sample.count() == 50 and sorted(map(str, sample.collect())) == sorted(map(str, schema.sampled(df.repartition(3), ["n"], lambda c: F.col(c), 50).collect()))
