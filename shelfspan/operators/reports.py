"""Reports over a coverage run: each is one aggregation (two where both sides count) over rows or groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.operators.coverage import MATCHED, REVIEW, STATUSES, Coverage

DRILLDOWN_ROWS = 5000


def _matched() -> Column:
    return F.col("status").isin(*MATCHED)


def total(x: Column | str) -> Column:
    """The sum of an amount to six places: of decimals, as a sum of doubles depends on the order of rows and loses cents of large totals."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(20,6)")).cast("double")


def _total(x: Column) -> Column:
    return F.coalesce(total(x), F.lit(0.0))


def _share(a: Column, b: Column, places: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(a, b), places), F.lit(0.0))


def kpis(run: Coverage, mode: str = "comparable") -> DataFrame:
    """One row of 20 figures; ratios have four places, money two, and a share of nothing is 0 (units: null)."""
    k, m = F.col("kpi_slice"), _matched()
    rows = run.rows.agg(
        F.count(F.lit(1)).alias("total_client_rows"),
        F.count_if(m).alias("matched_rows"),
        F.count_if(k).alias("kpi_slice_rows"),
        F.count_if(k & m).alias("kpi_matched_rows"),
        _total(F.when(k, F.col("sales"))).alias("client_sales"),
        _total(F.when(k & m, F.col("sales"))).alias("matched_sales"),
        F.sum(F.when(k, F.col("units"))).alias("client_units"),
        F.sum(F.when(k & m, F.col("units"))).alias("matched_units"),
        F.count_if(F.col("status").isin(*REVIEW)).alias("rows_needing_review"),
        F.bool_and(k).alias("whole"),
    )
    groups = run.groups.where(m & k).agg(_total(F.col("panel_sales")).alias("panel_sales"), F.sum("panel_units").alias("panel_units"))
    r = rows.join(groups, F.lit(True))  # one row each
    c = F.col
    has_units = c("client_units").isNotNull()
    units = lambda x: F.when(has_units, x)
    matched_units, panel_units = F.coalesce("matched_units", F.lit(0.0)), F.coalesce("panel_units", F.lit(0.0))
    return r.select(
        F.lit(mode).alias("comparison_mode"),
        F.lit("directional" if mode == "directional" else "comparable").alias("delta_label"),
        "total_client_rows",
        "matched_rows",
        _share(c("matched_rows"), c("total_client_rows")).alias("row_coverage_pct"),
        "kpi_slice_rows",
        _share(c("kpi_matched_rows"), c("kpi_slice_rows")).alias("kpi_slice_row_coverage_pct"),
        F.round("client_sales", 2).alias("client_sales_uploaded"),
        F.round("matched_sales", 2).alias("matched_client_sales"),
        _share(c("matched_sales"), c("client_sales")).alias("sales_coverage_pct"),
        F.round("panel_sales", 2).alias("panel_comparable_sales"),
        F.round(c("matched_sales") - c("panel_sales"), 2).alias("sales_delta"),
        F.round("client_units", 2).alias("client_units_uploaded"),
        units(F.round(matched_units, 2)).alias("matched_client_units"),
        units(F.round(F.try_divide(matched_units, c("client_units")), 4)).alias("unit_coverage_pct"),
        units(F.round(panel_units, 2)).alias("panel_comparable_units"),
        units(F.round(matched_units - panel_units, 2)).alias("unit_delta"),
        "rows_needing_review",
        F.round(c("client_sales") - c("matched_sales"), 2).alias("uncovered_sales"),
        F.when(~F.coalesce(c("whole"), F.lit(True)), "Detail markets are left out of totals, so nothing counts twice.").alias("kpi_slice_note"),
    )


def trend(run: Coverage) -> DataFrame:
    """By period over the KPI slice: sales and units of both sides, delta of what matched, coverage."""
    m = _matched()
    mine = run.rows.where("kpi_slice and period_key is not null").groupBy("period_key").agg(_total(F.col("sales")).alias("client_sales"), _total(F.when(m, F.col("sales"))).alias("matched"), F.sum("units").alias("client_units"))
    theirs = run.groups.where(m & F.col("kpi_slice")).groupBy("period_key").agg(_total(F.col("panel_sales")).alias("panel_sales"), F.sum("panel_units").alias("panel_units"))
    j = mine.join(theirs, "period_key", "left")
    panel = F.coalesce("panel_sales", F.lit(0.0))
    return j.select(
        F.col("period_key").alias("period"),
        F.round("client_sales", 2).alias("client_sales"),
        F.round(panel, 2).alias("panel_sales"),
        F.round(F.col("matched") - panel, 2).alias("sales_delta"),
        _share(F.col("matched"), F.col("client_sales")).alias("coverage_rate"),
        F.round("client_units", 2).alias("client_units"),
        F.round("panel_units", 2).alias("panel_units"),
    ).orderBy("period")


def exceptions(run: Coverage) -> DataFrame:
    """By status other than matched: client rows, or panel groups that the client lacks, with the sales of that side and a note, the reason of the first row that has one; `rank` is the order of statuses."""
    first = F.min_by("exception_reason", F.when(F.col("exception_reason").isNotNull(), F.col("source_row_id")))
    rows = run.rows.where("status != 'matched' and status != 'missing_from_client'").groupBy("status").agg(F.count(F.lit(1)).alias("rows"), _total(F.col("sales")).alias("client_sales"), F.lit(None).cast("double").alias("panel_sales"), first.alias("note"))
    groups = run.groups.where("status = 'missing_from_client'").groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("client_sales"), _total(F.col("panel_sales")).alias("panel_sales"), F.min("exception_reason").alias("note"))
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return rows.unionByName(groups).select(rank.cast("long").alias("rank"), "status", "rows", F.round("client_sales", 2).alias("client_sales"), F.round("panel_sales", 2).alias("panel_sales"), "note").orderBy("rank")


def exception_shares(run: Coverage) -> DataFrame:
    """The exceptions with total_rows and each status's share of them, to three places."""
    e = exceptions(run)
    total = e.agg(F.sum("rows").alias("total_rows"))
    return e.join(F.broadcast(total), F.lit(True)).withColumn("share", _share(F.col("rows"), F.col("total_rows"), 3))  # one row


def matched_split(diagnostic: DataFrame) -> DataFrame:
    """A brand or period diagnostic with `side`: whether any of its rows matches."""
    return diagnostic.withColumn("side", F.when(F.col("matched_rows") > 0, "matched").otherwise("unmatched"))


def exception_rows(run: Coverage) -> DataFrame:
    """Client rows that aren't matched: the export of exceptions."""
    named = {"source_row_id": "source_row_id", "customer": "customer", "market": "market", "period_key": "period", "upc": "upc", "description": "item_description", "brand": "brand", "category": "category", "sales": "sales_value", "units": "unit_value", "status": "status", "exception_reason": "exception_reason"}
    return run.rows.where(~_matched()).select(*(F.col(a).alias(b) for a, b in named.items()))


def drilldown(run: Coverage, customer: str | None = None, limit: int | None = DRILLDOWN_ROWS) -> DataFrame:
    """Groups with both sides' figures, the first `limit` by product, period and market (the report's cap; None for the export)."""
    g = run.groups.orderBy("pkey", "period_key", "panel_market").limit(limit) if limit else run.groups
    money = ("client_sales", "panel_sales", "sales_delta", "client_units", "panel_units", "unit_delta")
    return g.select(
        "status",
        "exception_reason",
        F.col("period_key").alias("period"),
        F.lit(customer or run.customer).cast("string").alias("customer"),
        F.col("panel_market").alias("market"),
        "client_upc",
        F.col("client_description").alias("client_item_description"),
        "panel_upc",
        F.col("panel_description").alias("panel_item_description"),
        "brand",
        "category",
        *(F.round(x, 2).alias(x) for x in money),
        F.round("confidence", 2).alias("match_confidence"),
        F.coalesce("client_row_count", F.lit(0)).cast("long").alias("client_row_count"),
    ).orderBy(F.coalesce("period", F.lit("")), "status", F.desc("client_sales"))


def brand_diagnostic(run: Coverage) -> DataFrame:
    """By brand over the KPI slice: sales, rows, matched rows and their share."""
    g = run.rows.where("kpi_slice and brand_norm is not null").groupBy(F.col("brand_norm").alias("brand")).agg(F.count(F.lit(1)).alias("client_rows"), F.count_if(_matched()).alias("matched_rows"), F.round(_total(F.col("sales")), 2).alias("client_sales"))
    return g.withColumn("match_rate", F.round(F.col("matched_rows") / F.col("client_rows"), 3)).orderBy(F.desc("client_sales"), "brand")


def period_diagnostic(run: Coverage) -> DataFrame:
    """By period over the KPI slice: rows, sales and the share of sales that matched."""
    m = _matched()
    g = run.rows.where("kpi_slice and period_key is not null").groupBy(F.col("period_key").alias("period")).agg(F.count(F.lit(1)).alias("client_rows"), F.count_if(m).alias("matched_rows"), _total(F.col("sales")).alias("s"), _total(F.when(m, F.col("sales"))).alias("t"))
    return g.select("period", "client_rows", "matched_rows", F.round("s", 2).alias("client_sales"), F.round("t", 2).alias("matched_client_sales"), _share(F.col("t"), F.col("s"), 3).alias("match_rate")).orderBy("period")


def brand_overlap(run: Coverage) -> DataFrame:
    """One row: brands of each side and of both, after the alias map, and up to 20 client brands without a matched row in the KPI slice, sorted and comma-joined."""
    mine = run.rows.where("brand_norm is not null").groupBy(F.col("brand_norm").alias("brand")).agg(F.lit(1).alias("c"), F.count_if(F.col("kpi_slice") & _matched()).alias("hits"))
    theirs = run.panel.select(F.col("brand_norm").alias("brand")).where("brand is not null").distinct().withColumn("p", F.lit(1))
    j = mine.join(theirs, "brand", "full")
    counts = j.agg(F.count("c").alias("client_brand_count"), F.count("p").alias("panel_brand_count"), F.count_if(F.col("c").isNotNull() & F.col("p").isNotNull()).alias("overlap_count"))
    lacking = j.where("hits = 0").orderBy("brand").limit(20).agg(F.array_join(F.array_sort(F.collect_list("brand")), ", ").alias("client_unmatched_brands"))
    return counts.join(F.broadcast(lacking), F.lit(True))  # one row each


def summary(run: Coverage) -> dict:
    """What the run found besides its figures; of lists that grow with the file as many entries as reports show. A blocked run has its reasons only."""
    if run.blocked:
        return {"blocked": True, "reasons": run.reasons, "comparison_mode": run.mode, "time_grain": run.grain, "customer_alignment": run.customers, "warnings": run.warnings}
    overlap = brand_overlap(run).first()
    warnings = list(run.warnings)
    if overlap.client_brand_count and overlap.panel_brand_count and not overlap.overlap_count and run.rows.where(_matched()).isEmpty():
        warnings.append(f"No row matches: none of the client's {overlap.client_brand_count} brands is one of the panel's {overlap.panel_brand_count}. The panel is probably of other products.")
    shown = lambda df: [r.asDict() for r in df.limit(DRILLDOWN_ROWS).collect()]
    mapped = run.markets.mapped()
    return {
        "blocked": False,
        "comparison_mode": run.mode,
        "time_grain": run.grain,
        "customer_alignment": run.customers,
        "market_alignment": mapped,
        "market_rollup_mode": run.rollup,
        "market_hierarchy_detected": run.hierarchy,
        "unmapped_client_markets": [] if run.rollup else [m[0] for m in run.markets.matches if m[1] is None],
        "warnings": warnings,
        "match_grain": "code or item, period, customer and market",
        "brand_overlap_diagnostic": overlap.asDict(),
        "brand_diagnostic": shown(brand_diagnostic(run)),
        "period_diagnostic": shown(period_diagnostic(run)),
        "brand_alias_map": {r.client_brand: r.panel_brand for r in run.brands.orderBy("client_brand").limit(DRILLDOWN_ROWS).collect()},
        "crosswalk_entries": shown(run.crosswalk.orderBy("client_key")),
        "geo_rollup_map": {m[1]: list(m[5]) for m in run.markets.matches if m[5]},
    }


def filtered(groups: DataFrame, search: str | None = None, **equal: str | None) -> DataFrame:
    """Drilldown rows with the given values, and with the search text in a description (any case) or a code."""
    for c, v in equal.items():
        if v is not None:
            groups = groups.where(F.col(c) == v)
    if search:
        low = F.lit(search.lower())
        groups = groups.where(F.greatest(*(F.coalesce(F.contains(F.lower(x), low), F.lit(False)) for x in ("client_item_description", "panel_item_description")), *(F.coalesce(F.contains(F.col(x), F.lit(search)), F.lit(False)) for x in ("client_upc", "panel_upc"))))
    return groups


def facet(groups: DataFrame, column: str) -> DataFrame:
    return groups.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def top_values(df: DataFrame, column: str, k: int, order: str | None = None) -> DataFrame:
    """(value, rows): the most frequent values; on ties the first to appear by `order`, or by value."""
    first = F.min(order) if order else F.min(column)
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"), first.alias("at")).orderBy(F.desc("rows"), "at").limit(k).select("value", "rows")
