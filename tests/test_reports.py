"""Coverage runs and their reports on a micro-fixture of two sides."""

import pytest

from shelfspan.operators import coverage, reports

CLIENT = "source_row_id long, customer string, market string, market_level string, period_key string, upc_key string, upc string, description string, brand string, brand_norm string, category string, sales double, units double, volume double, confidence double, record_status string, exception_reason string"
PANEL = "customer string, market string, period_key string, upc_key string, upc string, description string, brand_low_norm string, brand_norm string, category string, sales double, units double, volume double, position long"
CODES = {c: f"71800{ord(c):05}" for c in "ABCDEFGHIJ"}


def client(spark, rows, customer="Acme"):
    full = []
    for k, (market, upc, description, brand, period, sales, units, volume) in enumerate(rows):
        level = None if market is None else "total" if market == "Total" else "detail"
        bad = period is None
        full.append((k, customer, market, level, period, CODES.get(upc), CODES.get(upc), description, brand, brand and brand.lower(), "c", sales, units, volume, 0.9, "needs_review" if bad else "normalized", "period_unparsed" if bad else None))
    return spark.createDataFrame(full, CLIENT)


def panel(spark, rows, customer="Acme"):
    return spark.createDataFrame([(customer, m, p, CODES.get(u), CODES.get(u), d, None, b and b.lower(), "c", s, 1.0, None, k) for k, (m, u, d, b, p, s) in enumerate(rows)], PANEL)


MINE = [
    ("Total", "A", "Plain Water", None, "2025-01", 100.0, 10.0, None),
    ("Boston Region", "A", "Plain Water", None, "2025-01", 40.0, 4.0, None),
    ("Total", "A", "Plain Water", None, "2025-02", 50.0, 5.0, None),
    ("Atlantis", "A", "Plain Water", None, "2025-01", 30.0, 3.0, None),
    ("Total", "B", "Rye Bread", None, "2025-01", 20.0, 2.0, None),
    ("Total", None, "Lime Fizz Twelve", None, "2025-01", 15.0, 1.0, None),
    ("Total", "C", "Quark Jelly", "Zeta", "2025-01", 12.0, 1.0, None),
    ("Total", "F", "Alpha Soda", "Kappa", "2025-01", 11.0, 1.0, None),
    ("Total", "A", "Plain Water", None, None, 10.0, 1.0, None),
    ("Total", "H", "Grain Bulk", None, "2025-01", None, None, 5.0),
]
THEIRS = [
    ("Acme Total US", "A", "Plain Water", None, "2025-01", 90.0),
    ("Acme Boston TA", "A", "Plain Water", None, "2025-01", 38.0),
    ("Acme Denver TA", "B", "Rye Bread", None, "2025-01", 19.0),
    ("Acme Total US", "E", "Lime Fizz Twelve", None, "2025-01", 14.0),
    ("Acme Total US", "G", "Zzx Qwv", "Kappa", "2025-01", 9.0),
    ("Acme Total US", "H", "Grain Bulk", None, "2025-01", 8.0),
    ("Acme Total US", "J", "Mmn Ppq", "Omega", "2025-01", 7.0),
]


def test_all_statuses(spark):
    run = coverage.run_coverage(client(spark, MINE), panel(spark, THEIRS))
    got = [r.status for r in run.rows.orderBy("source_row_id").collect()]
    assert got == ["matched", "matched", "period_mismatch", "market_mismatch", "market_mismatch", "low_confidence_product_match", "missing_from_discover", "matched_with_caveat", "needs_review", "metric_mismatch"]
    assert {r.pkey for r in run.groups.where("status = 'missing_from_client'").collect()} == {"BRAND::omega"}
    k = reports.kpis(run).first()
    assert (k.total_client_rows, k.matched_rows, k.row_coverage_pct, k.kpi_slice_rows, k.kpi_slice_row_coverage_pct) == (10, 3, 0.3, 8, 0.25)
    # The KPI slice has no detail rows.
    brands = {r.brand: (r.client_rows, r.matched_rows) for r in reports.brand_diagnostic(run).collect()}
    assert brands == {"zeta": (1, 0), "kappa": (1, 1)}
    january = next(r for r in reports.period_diagnostic(run).collect() if r.period == "2025-01")
    assert (january.client_rows, january.matched_rows, january.client_sales, january.matched_client_sales) == (6, 2, 158.0, 111.0)
    assert reports.brand_overlap(run).first().asDict() == {"client_brand_count": 2, "panel_brand_count": 2, "overlap_count": 1, "client_unmatched_brands": "zeta"}
    s = reports.summary(run)
    assert s["unmapped_client_markets"] == ["Atlantis"] and s["market_hierarchy_detected"] and s["customer_alignment"] == {"Acme": "Acme"} and not s["market_rollup_mode"]


def test_blocked_and_forced_customers(spark):
    two = client(spark, MINE[:1]).unionByName(client(spark, MINE[1:2], "Other"))
    blocked = coverage.run_coverage(two, panel(spark, THEIRS, "Nobody"))
    assert blocked.blocked and blocked.rows is None and len(blocked.reasons) == 1 and reports.summary(blocked)["blocked"]
    assert coverage.run_coverage(two, panel(spark, THEIRS), mode="not_comparable").blocked
    forced = coverage.run_coverage(client(spark, MINE[:2], "Foo"), panel(spark, THEIRS, "Bar"))
    assert forced.customers == {"Foo": "Bar"} and len(forced.warnings) == 1 and forced.rows.where("status = 'matched'").count() == 2
    mixed = coverage.run_coverage(two, panel(spark, THEIRS))
    assert mixed.customers == {"Acme": "Acme"} and not mixed.blocked


def test_rolled_up_markets_and_brands_of_descriptions(spark):
    rows = [("Nowhere", "A", "Plain Water", None, "2025-01", 1.0, 1.0, None), ("Elsewhere", "C", "Omega Tea", None, "2025-01", 2.0, 1.0, None)]
    run = coverage.run_coverage(client(spark, rows), panel(spark, THEIRS))
    got = {r.source_row_id: (r.status, r.pkey, r.panel_market) for r in run.rows.collect()}
    assert run.rollup and got[0] == ("matched_with_caveat", CODES["A"], coverage.ALL_MARKETS) and got[1][:2] == ("matched_with_caveat", "BRAND::omega")
    no_market = coverage.run_coverage(client(spark, [(None, *r[1:]) for r in rows]), panel(spark, THEIRS[:1]))
    assert [r.panel_market for r in no_market.rows.collect()] == ["Acme Total US"] * 2
    none = coverage.run_coverage(client(spark, []), panel(spark, THEIRS))
    assert none.rows.count() == 0 and reports.kpis(none).first().total_client_rows == 0


def test_user_crosswalk_overrides_exact_matches(spark):
    user = spark.createDataFrame([(CODES["A"], CODES["H"], 1)], "client_key string, panel_key string, position long")
    run = coverage.run_coverage(client(spark, MINE[:1]), panel(spark, THEIRS), user_crosswalk=user)
    assert [(r.pkey, r.pmatch, r.status) for r in run.rows.collect()] == [(CODES["H"], "upc_crosswalk", "matched_with_caveat")]


def test_panel_files(spark):
    from shelfspan.operators import panel as panels

    schema = "source_row_id long, Markets string, Periods string, UPC string, Brand string, Category string, `$` string, Units string"
    one = spark.createDataFrame([(0, "Acme Boston TA", "2025-01", "071800000211", "b", "c", "1.5", "1"), (1, "Acme Boston TA", "2025-02", "071800000211", "b", "c", "2", "1"), (2, "Copyright", None, None, None, None, None, None)], schema)
    two = spark.createDataFrame([(0, "Acme Boston TA", "2025-02", "071800000211", "b", "c", "2", "1"), (1, "Acme Boston TA", "2025-03", "071800000228", None, "c", "3", "1")], schema)
    got = panels.check_files({"a.csv": one, "b.csv": two})
    assert got.valid and got.row_count == 3 and (got.period_start, got.period_end) == ("2025-01-01", "2025-03-31")
    assert [(f["name"], f["rows"], f["junk"]) for f in got.files] == [("a.csv", 2, 1), ("b.csv", 2, 0)] and got.files[0]["period_end"] == "2025-02-28"
    assert len(got.preview) == 3 and any("kept once" in w for w in got.warnings)
    # Without a description column the brand stands in, and the market's first word for the customer.
    assert {(r.item_description, r.customer) for r in got.panel.collect()} == {("b", "Acme"), (None, "Acme")}
    bad = panels.check_files({"a.csv": one.drop("UPC")})
    assert not bad.valid and bad.panel is None and "upc" in bad.missing_required_fields


def test_catalogue_of_runs(spark, tmp_path):
    from shelfspan.sources import shared
    from shelfspan.sources.catalogue import Catalogue

    runs = Catalogue(spark, coverage.Coverage, str(tmp_path / "runs"))
    before = set(shared.children(spark, shared.shared_folder(spark)))
    run = runs.keep("first-1", lambda: coverage.run_coverage(client(spark, MINE), panel(spark, THEIRS)))
    assert set(shared.children(spark, shared.shared_folder(spark))) == before
    assert runs.ids() == ["first-1"] and run.customers == {"Acme": "Acme"} and reports.kpis(run).first().matched_rows == 3
    again = runs.get("first-1")
    assert again.rows.count() == 10 and again.markets.mapped()["Total"] == "Acme Total US" and reports.summary(again)["unmapped_client_markets"] == ["Atlantis"]
    blocked = runs.keep("first-1", lambda: coverage.run_coverage(client(spark, MINE), panel(spark, THEIRS), mode="not_comparable"))
    assert blocked.blocked and blocked.rows is None and runs.get("first-1").blocked
    runs.expire("first-1")
    assert runs.ids() == [] and runs.get("first-1") is None and not (tmp_path / "runs" / "first-1").exists()
    with pytest.raises(ValueError, match="not a run id"):
        runs.get("../x")
