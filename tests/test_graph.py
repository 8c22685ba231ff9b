"""Mapping graph: rule tables, merging of nodes, layout, and graphs of a run, a profile and a recommendation."""

import math

from pyspark.sql import functions as F
from test_reports import MINE, THEIRS, client, panel

from shelfspan.operators import coverage, graph
from shelfspan.operators.recommend import recommend
from shelfspan.operators.schema import Detection

MAPPED = [
    (0, "Brand", "brand", "dimension", 0.95),
    (1, "Brand Sales", "brand", "alternate", 0.5),
    (2, "Memo", None, "unmapped", 0.0),
    (3, "Units", "unit", "metric", 0.85),
    (4, "Jan-25 Sales", "wide sales", "wide_period", 0.9),
    (5, "Feb-25 Sales", "wide sales", "wide_period", 0.9),
]


def columns(spark, rows=MAPPED):
    return graph.of_columns(spark.createDataFrame(rows, "position long, column string, concept string, role string, confidence double"))


def test_labels(spark):
    said = ["low confidence upc", "UPC market", "market of week", "fiscal year", "dollars", "memo", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, x string").select("k", graph.area(F.col("x")).alias("area")).orderBy("k").collect()
    assert [r.area for r in rows] == ["exceptions", "product", "geography", "time", "metrics", "product", "product"]
    fields = [("item_description", "dimension", "Panel Product ID"), ("category", "alternate", "Panel Category"), ("volume", "metric", "Panel Volume"), (None, "metric", "Panel Measure"), ("other", "dimension", "Panel other"), (None, "ignored", "Panel Target Field")]
    got = spark.createDataFrame(fields, "c string, r string, want string").select(graph.target_field(F.col("c"), F.col("r")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    bands = spark.createDataFrame([(0.9,), (0.7,), (0.5,), (0.49,), (None,), (math.nan,)], "x double").select(graph.confidence_band(F.col("x")).alias("b")).collect()
    assert [r.b for r in bands] == ["high", "medium", "low", "needs_review", "none", "none"]


def test_columns_merge_and_flag(spark):
    g = graph.assemble(*columns(spark))
    nodes = {r.id: r for r in g.nodes.collect()}
    # Both columns mean a brand: the first one's figures count, of the details the later ones.
    brand = nodes["panel-field-panel-brand"]
    assert (brand.confidence, brand.band, brand.details) == (0.95, "high", {"derived_from": "Brand Sales", "detected_concept": "brand"})
    assert nodes["client-field-wide-period-columns"].label == "2 wide period columns"
    assert nodes["client-field-wide-period-columns"].details == {"examples": "Jan-25 Sales; Feb-25 Sales"}
    flags = {r.id: (r.severity, r.node_id, r.title) for r in g.exceptions.collect()}
    assert flags == {
        "exception-brand-sales-alternate-low": ("warning", "client-field-brand-sales", "Low confidence field mapping"),
        "exception-memo-unmapped-needs-review": ("critical", "client-field-memo", "Unmapped client field"),
    }
    edges = {(r.source, r.target): r.label for r in g.edges.collect()}
    assert edges[("client-field-memo", "exception-memo-unmapped-needs-review")] == "unmapped"
    assert edges[("client-field-brand", "meaning-product-brand")] == "95% confidence"
    assert {r.id for r in graph.adjacent(g.edges, "client-field-memo").collect()} == {"client-field-memo", "meaning-exceptions-unmapped-field", "exception-memo-unmapped-needs-review"}
    assert [r.id for r in graph.exceptions_of(g.exceptions, "client-field-memo").collect()] == ["exception-memo-unmapped-needs-review"]
    s = graph.stats(g.nodes).first()
    assert (s.client_fields, s.exceptions) == (5, 2)


def test_layout(spark):
    g = graph.assemble(*columns(spark, MAPPED[:1]))
    at = {r.id: (r.x, r.y) for r in g.nodes.collect()}
    assert at["client-field-brand"] == (-520 + 300, -280)  # the first of four
    assert at["meaning-product-brand"] == (-520, -280 + 190)
    assert at["rule-product-header-and-sample-pattern-match"] == (-520, -280 - 190 - 42)


def test_empty_and_null_columns(spark):
    assert graph.assemble(*columns(spark, [])).nodes.isEmpty()
    g = graph.assemble(*columns(spark, [(0, None, None, "unmapped", None), (1, "", "brand", "dimension", 0.8), (1, "", "brand", "dimension", 0.8)]))
    assert {r.id for r in g.nodes.where("type = 'client_field'").collect()} == {"client-field-item"}


def test_run_with_profile_and_recommendation(spark):
    run = coverage.run_coverage(client(spark, MINE), panel(spark, THEIRS))
    facts = spark.createDataFrame([(10, 2, 3, 0, 0.9, None, None, 1, ["One note."])], "total_rows long, distinct_periods long, distinct_markets long, distinct_products long, period_parse_rate double, period_start date, period_end date, rows_needing_review long, warnings array<string>")
    profile = {"customer": "Acme", "markets": [{"value": "Total", "total_like": True}, {"value": "Boston"}], "categories": [], "manufacturers": [], "brands": [{"value": "Zeta"}], "period_start": None, "period_end": None, "time_grain": "monthly"}
    rec = recommend(profile, Detection("long", "monthly", "directional", [], {}, {}, [], [], "shipment"))
    assert len(rec["caveats"]) == 3 and len(rec["market_scope"]) == 2 and rec["brand_scope"] == ["Zeta"]
    g = graph.assemble(*columns(spark), *graph.of_profile(facts, "Acme", None), *graph.of_recommendation(spark, rec), *graph.of_coverage(run))
    nodes = {r.id: r for r in g.nodes.collect()}
    assert nodes["client-profile-product-0-products"].band == "none"
    assert nodes["client-profile-time-2-periods"].details == {"value": "? to ?"}
    assert nodes["exception-quality-review"].severity == "critical"
    assert nodes["meaning-matched-coverage"].details["row_coverage"] == "30%"
    assert nodes["exception-unmapped-market-atlantis"].label == "Unmapped market: Atlantis"
    assert nodes["exception-brand-match-zeta"].severity == "critical" and "exception-brand-match-kappa" not in nodes
    assert nodes["exception-metric-mismatch-1"].band == "needs_review" and nodes["exception-matched-with-caveat-1"].severity == "info"
    known = set(nodes)
    assert all({r.source, r.target} <= known for r in g.edges.collect())
    flags = {r.id: r for r in g.exceptions.collect()}
    assert "exception-matched-with-caveat-1" not in flags
    assert (flags["exception-brand-match-zeta"].rows, flags["exception-brand-match-zeta"].note) == (1, "0% match rate for zeta.")
    assert flags["exception-quality-review"].note == "One note."


def test_blocked_run_has_no_nodes(spark):
    assert graph.of_coverage(coverage.run_coverage(client(spark, MINE), panel(spark, THEIRS), mode="not_comparable")) == []
