"""All registered queries and their oracle SQL."""

from __future__ import annotations

import calendar
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.functions import fuzzy, geography, identifiers, periods, text
from shelfspan.operators import align, coverage, graph, markets, normalize, panel, profile, reports, schema
from shelfspan.plans.derived import CUSTOMER, KEYS_SQL, RUN_SQL, SIDES_SQL, client_file, indel, panel_file, read, token_set_sql
from shelfspan.sources import shared, tabular

Query = Callable[[SparkSession, str], DataFrame]
CONCEPTS = {"customer": "Retailer", "client_market": "Market", "month": "Month", "upc": "UPC", "item_description": "Item Description", "brand": "Brand", "category": "Category"}
METRICS = {"sales": "POS Sales $", "unit": "Units"}
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = f, sql
        return f

    return add


def model(spark: SparkSession, sf: str) -> DataFrame:
    """The client file in the fixed model."""
    return normalize.normalize(client_file(spark, sf), CONCEPTS, METRICS, "monthly", "comparable", 0.95)


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    export = panel.validate(panel_file(spark, sf))
    return normalize.for_coverage(model(spark, sf)), panel.for_coverage(export.panel, "monthly")


def run(spark: SparkSession, sf: str) -> coverage.Coverage:
    """The run that all coverage reports read: every tier, customers and markets aligned."""
    return coverage.run_coverage(*sides(spark, sf))


def on_run(sql: str) -> str:
    return f"{RUN_SQL} {sql}"


def on_keys(sql: str) -> str:
    return f"{KEYS_SQL} {sql}"


def on_sides(sql: str) -> str:
    return f"WITH {SIDES_SQL} {sql}"


# -- coverage and its reports

M = "status IN ('matched', 'matched_with_caveat')"


@query(
    on_run(f"""
, t AS (SELECT period_key, sum(panel_sales) AS ps, sum(panel_units) AS pu FROM g WHERE {M} AND kpi_slice GROUP BY 1)
SELECT r.period_key AS period, round(coalesce(sum(sales), 0), 2) AS client_sales, round(coalesce(any_value(ps), 0), 2) AS panel_sales,
       round(coalesce(sum(sales) FILTER (WHERE {M}), 0) - coalesce(any_value(ps), 0), 2) AS sales_delta,
       coalesce(round(coalesce(sum(sales) FILTER (WHERE {M}), 0) / sum(sales), 4), 0) AS coverage_rate,
       round(sum(units), 2) AS client_units, round(any_value(pu), 2) AS panel_units
FROM r LEFT JOIN t USING (period_key) WHERE kpi_slice AND r.period_key IS NOT NULL GROUP BY 1""")
)
def coverage_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return reports.trend(run(spark, sf))


@query(
    on_run(f"""
, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE m) AS k, count(*) FILTER (WHERE kpi_slice) AS kn, count(*) FILTER (WHERE kpi_slice AND m) AS kk, count(*) FILTER (WHERE status IN ('needs_review', 'low_confidence_product_match')) AS review,
               coalesce(sum(sales) FILTER (WHERE kpi_slice), 0) AS s, coalesce(sum(sales) FILTER (WHERE kpi_slice AND m), 0) AS t, sum(units) FILTER (WHERE kpi_slice) AS u, coalesce(sum(units) FILTER (WHERE kpi_slice AND m), 0) AS v
        FROM (SELECT *, {M} AS m FROM r)),
b AS (SELECT coalesce(sum(panel_sales), 0) AS ps, coalesce(sum(panel_units), 0) AS pu FROM g WHERE {M} AND kpi_slice)
SELECT n AS total_client_rows, k AS matched_rows, round(k / n, 4) AS row_coverage_pct, round(s, 2) AS client_sales_uploaded, round(t, 2) AS matched_client_sales,
       round(t / s, 4) AS sales_coverage_pct, round(ps, 2) AS panel_comparable_sales, round(t - ps, 2) AS sales_delta, round(u, 2) AS client_units_uploaded,
       round(v, 2) AS matched_client_units, round(v / u, 4) AS unit_coverage_pct, round(pu, 2) AS panel_comparable_units, round(v - pu, 2) AS unit_delta, round(s - t, 2) AS uncovered_sales,
       'comparable' AS comparison_mode, 'comparable' AS delta_label, kn AS kpi_slice_rows, round(kk / kn, 4) AS kpi_slice_row_coverage_pct, review AS rows_needing_review,
       CASE WHEN kn < n THEN 'Detail markets are left out of totals, so nothing counts twice.' END AS kpi_slice_note
FROM a, b""")
)
def kpis(spark: SparkSession, sf: str) -> DataFrame:
    return reports.kpis(run(spark, sf))


@query(
    on_run("""
SELECT list_position(['matched', 'matched_with_caveat', 'low_confidence_product_match', 'missing_from_discover', 'missing_from_client', 'market_mismatch', 'period_mismatch', 'metric_mismatch', 'needs_review'], status)::BIGINT AS rank,
       status, n AS rows, round(s, 2) AS client_sales, round(p, 2) AS panel_sales, note
FROM (SELECT status, count(*) AS n, coalesce(sum(sales), 0) AS s, NULL::DOUBLE AS p, arg_min(reason, source_row_id) AS note FROM r WHERE status NOT IN ('matched', 'missing_from_client') GROUP BY 1
      UNION ALL SELECT status, count(*), NULL, coalesce(sum(panel_sales), 0), min(exception_reason) FROM g WHERE status = 'missing_from_client' GROUP BY 1)""")
)
def exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.exceptions(run(spark, sf))


@query(
    on_run("""
SELECT status, exception_reason, period_key AS period, 'Acme Stores' AS customer, panel_market AS market, client_upc, client_description AS client_item_description, panel_upc, panel_description AS panel_item_description, brand, category,
       round(client_sales, 2) AS client_sales, round(panel_sales, 2) AS panel_sales, round(client_sales - panel_sales, 2) AS sales_delta,
       round(client_units, 2) AS client_units, round(panel_units, 2) AS panel_units, round(client_units - panel_units, 2) AS unit_delta, round(confidence, 2) AS match_confidence, coalesce(client_row_count, 0) AS client_row_count
FROM (SELECT * FROM g ORDER BY pkey, period_key, panel_market LIMIT 5000)""")
)
def drilldown(spark: SparkSession, sf: str) -> DataFrame:
    return reports.drilldown(run(spark, sf))


@query(on_run("SELECT status, count(*) AS groups, coalesce(sum(client_row_count), 0)::BIGINT AS rows FROM g GROUP BY 1"))
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).groups.groupBy("status").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("client_row_count"), F.lit(0)).alias("rows"))


@query(on_run("SELECT status, reason, count(*) AS rows, round(sum(sales), 2) AS sales FROM r GROUP BY 1, 2"))
def row_status(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).rows.groupBy("status", F.col("exception_reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows"), F.round(reports.total("sales"), 2).alias("sales"))


@query(on_run("SELECT pkey, period_key, panel_market, round(client_sales, 2) AS client_sales, client_units, client_row_count, pmatch, client_description, client_upc, brand, category, round(confidence, 2) AS confidence FROM cg"))
def client_group_agg(spark: SparkSession, sf: str) -> DataFrame:
    g = run(spark, sf).groups.where("client_row_count is not null")
    return g.select("pkey", "period_key", "panel_market", F.round("client_sales", 2).alias("client_sales"), "client_units", "client_row_count", "pmatch", "client_description", "client_upc", "brand", "category", F.round("confidence", 2).alias("confidence"))


@query(on_run("SELECT pkey, period_key, panel_market, round(panel_sales, 2) AS panel_sales, panel_units, panel_description, panel_upc FROM inside"))
def panel_group_agg(spark: SparkSession, sf: str) -> DataFrame:
    g = run(spark, sf).groups.where("panel_sales is not null")
    return g.select("pkey", "period_key", "panel_market", F.round("panel_sales", 2).alias("panel_sales"), "panel_units", "panel_description", "panel_upc")


@query(on_run("SELECT pkey, period_key, panel_market, client_row_count IS NOT NULL AS from_client, panel_sales IS NOT NULL AS from_panel, status, exception_reason FROM g"))
def coverage_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).groups.select("pkey", "period_key", "panel_market", F.col("client_row_count").isNotNull().alias("from_client"), F.col("panel_sales").isNotNull().alias("from_panel"), "status", "exception_reason")


@query(on_run(f"SELECT source_row_id, customer, market, period_key AS period, upc, description AS item_description, brand, category, sales AS sales_value, units AS unit_value, status, reason AS exception_reason FROM r WHERE NOT {M}"))
def exception_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reports.exception_rows(run(spark, sf))


@query(
    on_run(f"""
SELECT brand_norm AS brand, count(*) AS client_rows, count(*) FILTER (WHERE {M}) AS matched_rows, round(coalesce(sum(sales), 0), 2) AS client_sales,
       round(count(*) FILTER (WHERE {M}) / count(*), 3) AS match_rate FROM r WHERE kpi_slice AND brand_norm IS NOT NULL GROUP BY 1""")
)
def brand_diag(spark: SparkSession, sf: str) -> DataFrame:
    return reports.brand_diagnostic(run(spark, sf))


@query(
    on_run(f"""
SELECT period_key AS period, count(*) AS client_rows, count(*) FILTER (WHERE m) AS matched_rows, round(coalesce(sum(sales), 0), 2) AS client_sales, round(coalesce(sum(sales) FILTER (WHERE m), 0), 2) AS matched_client_sales,
       coalesce(round(coalesce(sum(sales) FILTER (WHERE m), 0) / sum(sales), 3), 0) AS match_rate FROM (SELECT *, {M} AS m FROM r) WHERE kpi_slice AND period_key IS NOT NULL GROUP BY 1""")
)
def period_diag(spark: SparkSession, sf: str) -> DataFrame:
    return reports.period_diagnostic(run(spark, sf))


@query(
    on_run(f"""
, b AS (SELECT brand_norm AS c, count(*) FILTER (WHERE kpi_slice AND {M}) AS hits FROM r WHERE brand_norm IS NOT NULL GROUP BY 1)
SELECT count(c) AS client_brand_count, count(p) AS panel_brand_count, count(*) FILTER (WHERE c IS NOT NULL AND p IS NOT NULL) AS overlap_count,
       coalesce(array_to_string(list_sort(list(c) FILTER (WHERE hits = 0))[:20], ', '), '') AS client_unmatched_brands
FROM b FULL JOIN (SELECT DISTINCT brand_norm AS p FROM panel) ON c = p""")
)
def brand_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return reports.brand_overlap(run(spark, sf))


@query(on_run("SELECT DISTINCT period_key AS period FROM g WHERE status = 'matched' AND panel_market = 'Acme EUROPE TA'"))
def drilldown_facet(spark: SparkSession, sf: str) -> DataFrame:
    whole = reports.drilldown(run(spark, sf), limit=None)
    return reports.facet(reports.filtered(whole, status="matched", market="Acme EUROPE TA"), "period")


@query(on_run("SELECT status, period_key AS period, panel_market AS market, client_upc, panel_upc, client_description AS client_item_description FROM g WHERE status = 'matched_with_caveat' AND (contains(lower(client_description), 'red r') OR contains(lower(panel_description), 'red r') OR contains(client_upc, 'Red R') OR contains(panel_upc, 'Red R'))"))
def drilldown_search(spark: SparkSession, sf: str) -> DataFrame:
    """Drilldown rows that hold a text."""
    whole = reports.drilldown(run(spark, sf), limit=None)
    return reports.filtered(whole, search="Red R", status="matched_with_caveat").select("status", "period", "market", "client_upc", "panel_upc", "client_item_description")


@query(on_run(f"""
, o AS (SELECT count(c) AS n, count(p) AS k, count(*) FILTER (WHERE c IS NOT NULL AND p IS NOT NULL) AS shared FROM (SELECT DISTINCT brand_norm AS c FROM r WHERE brand_norm IS NOT NULL) FULL JOIN (SELECT DISTINCT brand_norm AS p FROM panel) ON c = p)
SELECT 'monthly' AS time_grain, 'comparable' AS comparison_mode, 'Acme Stores=Acme' AS customers, false AS market_rollup_mode, count(DISTINCT market_level) = 2 AS market_hierarchy_detected,
       (SELECT string_agg(market || '=' || panel_market, '; ' ORDER BY market) FROM (SELECT DISTINCT market, panel_market FROM r WHERE panel_market IS NOT NULL)) AS markets,
       (SELECT coalesce(string_agg(market, '; ' ORDER BY market), '') FROM (SELECT DISTINCT market FROM r WHERE panel_market IS NULL)) AS unmapped,
       (SELECT count(*) FROM alias) AS brand_aliases, (SELECT count(*) FROM auto) AS crosswalk_entries, any_value(n) AS client_brands, any_value(k) AS panel_brands, any_value(shared) AS overlap FROM r, o"""))
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What the run found besides its figures."""
    found = run(spark, sf)
    s = reports.summary(found)
    pairs = lambda d: "; ".join(f"{a}={b}" for a, b in sorted(d.items()))
    b = s["brand_overlap_diagnostic"]
    row = (s["time_grain"], s["comparison_mode"], pairs(s["customer_alignment"]), s["market_rollup_mode"], s["market_hierarchy_detected"], pairs(s["market_alignment"]), "; ".join(sorted(s["unmapped_client_markets"])), b["client_brand_count"], b["panel_brand_count"], b["overlap_count"])
    one = spark.createDataFrame([row], "time_grain string, comparison_mode string, customers string, market_rollup_mode boolean, market_hierarchy_detected boolean, markets string, unmapped string, client_brands long, panel_brands long, overlap long")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one.join(count(found.brands, "brand_aliases"), F.lit(True)).join(count(found.crosswalk, "crosswalk_entries"), F.lit(True))


@query(
    on_run("""
, e AS (SELECT status, count(*) AS n FROM r WHERE status NOT IN ('matched', 'missing_from_client') GROUP BY 1 UNION ALL SELECT status, count(*) FROM g WHERE status = 'missing_from_client' GROUP BY 1)
SELECT status, n AS rows, sum(n) OVER ()::BIGINT AS total_rows, round(n / sum(n) OVER (), 3) AS share FROM e""")
)
def exception_shares(spark: SparkSession, sf: str) -> DataFrame:
    return reports.exception_shares(run(spark, sf)).select("status", "rows", "total_rows", "share")


@query(on_run(f"SELECT period_key AS period, count(*) AS client_rows, CASE WHEN count(*) FILTER (WHERE {M}) > 0 THEN 'matched' ELSE 'unmatched' END AS side FROM r WHERE kpi_slice AND period_key IS NOT NULL GROUP BY 1"))
def diagnostics_split(spark: SparkSession, sf: str) -> DataFrame:
    return reports.matched_split(reports.period_diagnostic(run(spark, sf))).select("period", "client_rows", "side")


# -- client file to the fixed model


@query(on_sides("SELECT source_row_id, market AS client_market_standardized, period_key, upc_key, upc AS upc_normalized, description AS item_description_raw, brand AS brand_standardized, sales AS sales_value, units AS unit_value, record_status, confidence::DOUBLE AS mapping_confidence, row_reason AS exception_reason, market_level, category AS category_standardized FROM client"))
def norm_long(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf).select("source_row_id", "client_market_standardized", "period_key", "upc_key", "upc_normalized", "item_description_raw", "brand_standardized", "sales_value", "unit_value", "record_status", "mapping_confidence", "exception_reason", "market_level", "category_standardized")


@query("""
SELECT k.o_custkey AS source_row_id, printf('2025-%02d', m) AS period_key, (SELECT round(sum(o_totalprice), 2) FROM orders o WHERE o.o_custkey = k.o_custkey AND month(o_orderdate) = m) AS sales_value,
       (SELECT count(*) FROM orders o WHERE o.o_custkey = k.o_custkey AND month(o_orderdate) = m)::DOUBLE AS unit_value FROM (SELECT DISTINCT o_custkey FROM orders) k, range(1, 13) t(m)""")
def unpivot_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A wide file of twelve months, its columns detected by their headers."""
    m = F.month("o_orderdate")
    wide = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source_row_id")).agg(*(x for k, name in enumerate(calendar.month_abbr) if k for x in (F.round(F.sum(F.when(m == k, F.col("o_totalprice"))), 2).alias(f"{name}-25 Net Rev"), F.count_if(m == k).alias(f"{name}-25 Units"))))
    named = schema.wide_header(wide.columns[1:])
    columns = [(c, a, b, grain, schema.classify_metric(rest).kind) for c, (a, b, grain, rest) in named.items()]
    return normalize.normalize(wide, {}, {}, "monthly", "directional", 0.4, columns).select("source_row_id", "period_key", "sales_value", "unit_value")


@query(on_sides("SELECT count(*) AS total_rows, round(count(period_key) / count(*), 3) AS period_parse_rate, round(count(upc_key) / count(upc), 3) AS upc_valid_rate, round(count(sales) / count(*), 3) AS sales_present_rate, count(*) FILTER (WHERE record_status = 'needs_review') AS rows_needing_review, count(DISTINCT period_key) AS distinct_periods, count(DISTINCT market) AS distinct_markets, count(DISTINCT upc_key) AS distinct_products FROM client"))
def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.quality(model(spark, sf))


@query(on_sides("SELECT brand AS value, count(*) AS rows FROM client WHERE brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"))
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_values(model(spark, sf), "brand_standardized", 12)


@query(
    on_sides("""
, v AS (SELECT unnest(['customer_standardized', 'client_market_standardized', 'brand_standardized', 'category_standardized']) AS "column", unnest([customer, market, brand, category]) AS value, source_row_id FROM client),
n AS (SELECT "column", value, count(*) AS rows, min(source_row_id) AS first FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rows DESC, first)::INTEGER AS place FROM n)
SELECT "column", value, rows, CASE WHEN "column" = 'client_market_standardized' THEN value = 'Total' END AS total_like, place FROM k WHERE place <= CASE "column" WHEN 'customer_standardized' THEN 5 WHEN 'client_market_standardized' THEN 25 ELSE 12 END""")
)
def profile_values(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, markets, brands and categories of the profile."""
    return profile.value_counts(model(spark, sf))


@query(
    on_sides("""
, f AS (SELECT description, min(source_row_id) AS first FROM client GROUP BY 1 ORDER BY 2 LIMIT 200),
s AS (SELECT DISTINCT regexp_extract(description, ' ([0-9]+)OZCAN$', 1) || 'OZ' AS size FROM f WHERE description LIKE '%OZCAN')
SELECT 'Acme Stores' AS customer, min(CASE WHEN period_key IS NOT NULL THEN period_key || '-01' END) AS period_start, strftime(max(last_day((period_key || '-01')::DATE)), '%Y-%m-%d') AS period_end, 'monthly' AS time_grain,
       count(DISTINCT upc_key) AS distinct_products, (SELECT string_agg(size, ',' ORDER BY size) FROM s) AS sizes, 'UPC' AS identifiers, 'Item Description' AS descriptions, count(DISTINCT market) AS markets FROM client""")
)
def client_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The whole profile, of the detected columns."""
    p = profile.build(model(spark, sf), schema.detect(client_file(spark, sf)))
    row = (p["customer"], p["period_start"], p["period_end"], p["time_grain"], p["distinct_products"], ",".join(p["description_hints"]["sizes"]), ",".join(p["product_identifier_fields"]), ",".join(p["description_fields"]), len(p["markets"]))
    return spark.createDataFrame([row], "customer string, period_start string, period_end string, time_grain string, distinct_products long, sizes string, identifiers string, descriptions string, markets long")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "Order Key", 'line 1 of ' || o_orderkey || chr(10) || '"quoted", and ' || o_custkey AS "Note", o_totalprice AS "Total", CASE WHEN o_orderkey % 1000 = 507 THEN 'far' || chr(10) || 'out' END AS "Unnamed_3", CASE WHEN o_orderkey % 1000 = 507 THEN o_custkey::DOUBLE END AS "Unnamed_4" FROM orders""")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as a CSV folder whose cells hold quotes and line breaks and of which few rows are wider, and read again."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    note = F.concat(F.lit("line 1 of "), key, F.lit("\n"), F.lit('"quoted", and '), cust)
    wide = F.when(F.col("o_orderkey") % 1000 == 507, F.concat(F.lit(","), quoted(F.lit("far\nout")), F.lit(","), cust)).otherwise("")
    lines = read(spark, sf, "orders").select("o_orderkey", F.concat(key, F.lit(","), quoted(note), F.lit(",$"), F.format_string("%.2f", "o_totalprice"), wide).alias("value"))
    head = spark.createDataFrame([(-1, "Order Key,Note,Total")], "o_orderkey long, value string")
    return tabular.read_csv(spark, shared.stored_text(lines.unionByName(head).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("value"))).df.drop("source_row_id")


@query(
    """
WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '$' || printf('%.2f', o_totalprice) WHEN 1 THEN '(' || printf('%.2f', o_totalprice) || ')' WHEN 2 THEN '1,' || printf('%.1f', 100 + o_orderkey % 800) WHEN 3 THEN 'n/a' WHEN 4 THEN ' ' || CAST(o_orderkey AS VARCHAR) ELSE NULL END AS x, o_totalprice FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN 1 THEN -CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN 2 THEN 1100 + o_orderkey % 800 WHEN 4 THEN o_orderkey END::DOUBLE AS value FROM raw"""
)
def numeric_restore(spark: SparkSession, sf: str) -> DataFrame:
    k, price = F.col("o_orderkey") % 6, F.format_string("%.2f", "o_totalprice")
    raw = F.when(k == 0, F.concat(F.lit("$"), price)).when(k == 1, F.concat(F.lit("("), price, F.lit(")"))).when(k == 2, F.format_string("1,%d.0", (100 + F.col("o_orderkey") % 800).cast("int"))).when(k == 3, F.lit("n/a")).when(k == 4, F.concat(F.lit(" "), F.col("o_orderkey").cast("string")))
    return read(spark, sf, "orders").select("o_orderkey", normalize.number(raw).alias("value"))


@query(
    on_sides("""
SELECT 'UPC' AS "column", count(*) AS rows, count(upc) / count(*) AS non_null_rate, 1.0::DOUBLE AS numeric_rate, count(upc_key) / count(upc) AS upc_rate FROM client
UNION ALL SELECT 'Brand', count(*), count(brand) / count(*), 0.0, 0.0 FROM client UNION ALL SELECT 'Item Description', count(*), 1.0, 0.0, 0.0 FROM client
UNION ALL SELECT 'POS Sales $', count(*), count(sales) / count(*), 1.0, 0.0 FROM client UNION ALL SELECT 'Units', count(*), count(units) / count(*), 1.0, 0.0 FROM client""")
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    file = client_file(spark, sf).select("source_row_id", "UPC", "Brand", "Item Description", "POS Sales $", "Units")
    return schema.profile(file).select("column", "rows", "non_null_rate", "numeric_rate", "upc_rate")


@query("SELECT 'wide' AS structure, 'monthly' AS grain, 'comparable' AS mode WHERE false UNION ALL SELECT 'long', 'monthly', 'comparable'")
def schema_detection(spark: SparkSession, sf: str) -> DataFrame:
    found = schema.detect(client_file(spark, sf))
    return spark.createDataFrame([(found.structure, found.grain, found.mode)], "structure string, grain string, mode string")


@query("SELECT CASE WHEN median(d) BETWEEN 6 AND 8 THEN 'weekly' WHEN median(d) BETWEEN 27 AND 32 THEN 'monthly' ELSE 'unknown' END AS grain FROM (SELECT date_diff('day', lag(w) OVER (ORDER BY w), w) AS d FROM (SELECT DISTINCT date_trunc('week', l_shipdate)::DATE AS w FROM lineitem))")
def grain_inference(spark: SparkSession, sf: str) -> DataFrame:
    weeks = read(spark, sf, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("d"))
    return spark.createDataFrame([(schema.spacing_grain(weeks, "d"),)], "grain string")


# -- scalar functions over whole tables


def _labels(key: Column, day: Column) -> Column:
    """A period label in one of eight spellings."""
    forms = (F.date_format(day, "MM/dd/yyyy"), F.concat(F.lit("WE "), F.date_format(day, "MM/dd/yyyy")), F.concat(F.lit("FY"), F.date_format(day, "yyyy"), F.lit(" P"), F.date_format(day, "MM")), F.date_format(day, "MMM-yyyy"), F.date_format(day, "yyyy MMM"), F.date_format(day, "yyyy-MM"), F.concat(F.lit("5 w/e "), F.date_format(day, "MM/dd/yy")), F.lit("hello"))
    return F.coalesce(*(F.when(key % 8 == k, f) for k, f in enumerate(forms)))


@query(
    """
SELECT l_orderkey, l_linenumber, strftime(CASE k WHEN 0 THEN d WHEN 1 THEN d - 6 WHEN 6 THEN d - 34 WHEN 7 THEN NULL ELSE date_trunc('month', d)::DATE END, '%Y-%m-%d') AS period_start,
       strftime(CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 6 THEN d WHEN 7 THEN NULL ELSE last_day(d) END, '%Y-%m-%d') AS period_end,
       CASE k WHEN 0 THEN 'daily_date' WHEN 1 THEN 'weekly' WHEN 6 THEN 'multi_week' WHEN 7 THEN NULL ELSE 'monthly' END AS grain
FROM (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS d, (l_orderkey + l_linenumber) % 8 AS k FROM lineitem)"""
)
def period_parse(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_orderkey") + F.col("l_linenumber")
    t = periods.with_parsed(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), _labels(key, F.col("l_shipdate")), "t")
    return t.select("l_orderkey", "l_linenumber", F.date_format("t.period_start", "yyyy-MM-dd").alias("period_start"), F.date_format("t.period_end", "yyyy-MM-dd").alias("period_end"), "t.grain")


@query(
    """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(7180000000 + p_partkey AS VARCHAR) WHEN 1 THEN CAST(7180000000 + p_partkey AS VARCHAR) WHEN 2 THEN CAST(7180000000 + p_partkey AS VARCHAR) WHEN 3 THEN NULL WHEN 4 THEN CAST(7180000000 + p_partkey AS VARCHAR) ELSE NULL END AS upc_key,
       p_partkey % 6 = 5 AS pseudo FROM part"""
)
def upc_key(spark: SparkSession, sf: str) -> DataFrame:
    k, digits = F.col("p_partkey") % 6, (F.lit(7180000000) + F.col("p_partkey")).cast("string")
    code = F.when(k == 0, F.concat(F.lit("0"), digits, F.lit("7"))).when(k == 1, F.concat(digits, F.lit("3.0"))).when(k == 2, F.concat(F.lit("000"), digits, F.lit("4"))).when(k == 3, F.col("p_partkey").cast("string")).when(k == 4, F.concat(F.lit("0-"), digits, F.lit("-1X"))).otherwise(F.concat(F.lit("ABI-"), digits))
    return read(spark, sf, "part").select("p_partkey", identifiers.upc_key(code).alias("upc_key"), (identifiers.is_pseudo_code(code) & (k != 4)).alias("pseudo"))


@query("SELECT p_partkey, (2 + p_partkey % 23)::BIGINT AS pack_count, (p_size + 0.5)::DOUBLE AS size, CASE WHEN p_partkey % 2 = 0 THEN 'OZ' ELSE 'ML' END AS size_unit, CASE WHEN p_partkey % 2 = 0 THEN 'CAN' ELSE 'BTL' END AS package_type, (2 + p_partkey % 23) || 'pk-' || p_size || '.5' || CASE WHEN p_partkey % 2 = 0 THEN 'oz-can' ELSE 'ml-btl' END AS size_key FROM part")
def desc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    d = F.concat(F.upper("p_name"), F.lit(" "), (2 + F.col("p_partkey") % 23).cast("string"), F.lit("PK"), F.col("p_size").cast("string"), F.lit(".5"), F.when(even, "OZCAN").otherwise("mlbtls"))
    return read(spark, sf, "part").select("p_partkey", text.description_tokens(d).alias("t"), text.size_key(d).alias("size_key")).select("p_partkey", "t.*", "size_key")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'coca-cola' ELSE lower(p_brand) END AS brand_norm, CASE WHEN string_split(p_name, ' ')[1] IN ('old', 'new') THEN string_split(p_name, ' ')[2] ELSE string_split(p_name, ' ')[1] END AS first_word, lower(replace(p_brand, '#', ' ')) AS value_form, lower(p_brand) || ' $' AS header_form FROM part")
def brand_norm(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit("  COKE (The Company)")).otherwise(F.concat(F.upper("p_brand"), F.lit("  (maker)")))
    return read(spark, sf, "part").select("p_partkey", text.norm_brand(raw).alias("brand_norm"), text.brand_from_description(F.concat(F.lit("The 12 "), "p_name")).alias("first_word"), text.norm_value(F.col("p_brand")).alias("value_form"), text.norm_header(F.concat("p_brand", F.lit(" ($)"))).alias("header_form"))


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS total_like, CASE WHEN n_nationkey % 2 = 0 THEN 'Acme' ELSE string_split(l, ' ')[1] END AS customer, CASE WHEN upper(l) = l AND length(l) > 4 THEN array_to_string(list_transform(string_split(l, ' '), lambda w: w[1] || lower(w[2:])), ' ') ELSE l END AS standard FROM (SELECT *, replace(n_name, '_', ' ') AS l FROM nation)")
def market_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation").withColumn("l", F.replace("n_name", F.lit("_"), F.lit(" ")))
    label = F.when(F.col("n_nationkey") % 3 == 0, F.concat("l", F.lit(" National Account"))).otherwise(F.col("l"))
    market = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Total Acme (x) "), "l")).otherwise(F.concat("l", F.lit(" TA")))
    return n.select("n_nationkey", text.is_total_like(label).alias("total_like"), text.customer_from_market(market).alias("customer"), text.standardize(F.col("l")).alias("standard"))


# -- panel


@query(on_sides("SELECT market, count(*) AS rows, round(sum(sales), 2) AS dollar_sales, sum(units) AS unit_sales, min(period_key) AS first_period, max(period_key) AS last_period, 'Acme' AS customer FROM panel GROUP BY 1"))
def junk_filter(spark: SparkSession, sf: str) -> DataFrame:
    export = panel_file(spark, sf)
    junk = spark.createDataFrame([("Copyright", None, None, None, None, None, None, None, 1), ("Acme ASIA TA", "2000-01", None, "x", "b", "c", 1.0, 1.0, 2), ("Acme ASIA TA", "2000-01", "041000000010", "x", "b", "c", None, 1.0, 3)], export.schema)
    rows = panel.validate(export.unionByName(junk)).panel
    key = periods.period_key(F.col("period_end"), "monthly")
    return rows.groupBy("market").agg(F.count(F.lit(1)).alias("rows"), F.round(reports.total("dollar_sales"), 2).alias("dollar_sales"), F.sum("unit_sales").alias("unit_sales"), F.min(key).alias("first_period"), F.max(key).alias("last_period"), F.min("customer").alias("customer"))


@query(on_sides("SELECT market, count(*) AS rows, round(sum(sales), 2) AS dollar_sales FROM panel GROUP BY 1"))
def stitch_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    export = panel_file(spark, sf)
    early, late = (panel.validate(export.where(c)).panel for c in ("Periods <= '1999-06'", "Periods >= '1999-01'"))
    return panel.stitch([early, late]).groupBy("market").agg(F.count(F.lit(1)).alias("rows"), F.round(reports.total("dollar_sales"), 2).alias("dollar_sales"))


@query(on_sides("SELECT count(*)::BIGINT AS overlapping_rows FROM panel WHERE period_key BETWEEN '1999-01' AND '1999-06'"))
def overlap_count(spark: SparkSession, sf: str) -> DataFrame:
    export = panel_file(spark, sf)
    early, late = (panel.validate(export.where(c)).panel for c in ("Periods <= '1999-06'", "Periods >= '1999-01'"))
    return panel.overlap_count(early.unionByName(late.withColumn("dollar_sales", F.col("dollar_sales") + 1)))


@query(on_sides("""
SELECT 'early' AS name, count(*) AS rows, 1::BIGINT AS junk, min(period_key) || '-01' AS period_start, strftime(max(last_day((period_key || '-01')::DATE)), '%Y-%m-%d') AS period_end, (SELECT count(*) FROM panel) AS stitched FROM panel WHERE period_key <= '1999-06'
UNION ALL SELECT 'late', count(*), 0, min(period_key) || '-01', strftime(max(last_day((period_key || '-01')::DATE)), '%Y-%m-%d'), (SELECT count(*) FROM panel) FROM panel WHERE period_key >= '1999-01'"""))
def panel_files(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of two files of one export that overlap by half a year."""
    export = panel_file(spark, sf)
    foot = spark.createDataFrame([("Copyright", None, None, None, None, None, None, None, 1)], export.schema)
    found = panel.check_files({"early": export.where("Periods <= '1999-06'").unionByName(foot), "late": export.where("Periods >= '1999-01'")})
    return spark.createDataFrame([(f["name"], f["rows"], f["junk"], f["period_start"], f["period_end"], found.row_count) for f in found.files], "name string, rows long, junk long, period_start string, period_end string, stitched long")


# -- alignment


@query("SELECT array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS client_market, CASE WHEN r_name <> 'ASIA' THEN 'Acme ' || r_name || ' TA' END AS panel_market FROM region WHERE length(r_name) > 4 UNION ALL SELECT r_name, NULL FROM region WHERE length(r_name) <= 4")
def market_alignment(spark: SparkSession, sf: str) -> DataFrame:
    names = read(spark, sf, "region").select("r_name", F.col("r_regionkey").alias("position"))
    there = names.where("r_name != 'ASIA'").select(F.concat(F.lit("Acme "), "r_name", F.lit(" TA")).alias("market"), "position")
    return markets.align_markets(names.select(text.standardize(F.col("r_name")).alias("market"), "position"), there, CUSTOMER).select("client_market", "panel_market")


GEO = (("Western NY Operating Area", "NY"), ("Mid-Atlantic", ""), ("Buffalo TA", "NY"), ("Washington", "DC WA"), ("Orlando", "FL"), ("New England", "CT MA ME NH RI VT"), ("walmart", ""))


@query("SELECT n_nationkey, states FROM nation JOIN (VALUES " + ", ".join(f"({k}, '{b}')" for k, (_, b) in enumerate(GEO)) + ") AS v(k, states) ON n_nationkey % 7 = k")
def geo_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """States of market labels, one of seven for each nation."""
    label = F.get(F.array(*(F.lit(a) for a, _ in GEO)), (F.col("n_nationkey") % 7).cast("int"))
    nations = read(spark, sf, "nation").select("n_nationkey", label.alias("market"))
    return nations.join(geography.expand(nations, "market"), F.col("market") == F.col("label")).select("n_nationkey", F.array_join("states", " ").alias("states"))


#: Equal without blanks, then contained, then alike. Client brands are one word, so brands that share a word are contained.
BRAND_SQL = f"""
WITH b AS (SELECT DISTINCT lower(p_brand) AS c, CAST(string_split(p_brand, '#')[2] AS INTEGER) % 3 AS k FROM part),
panel AS (SELECT DISTINCT CASE k WHEN 0 THEN replace(c, '#', ' #') WHEN 1 THEN 'maker ' || c ELSE 'zzz' END AS d FROM b),
equal AS (SELECT c, min(d) AS d FROM b JOIN panel ON replace(c, ' ', '') = replace(d, ' ', '') GROUP BY 1),
contained AS (SELECT c, arg_min(d, (length(d), d)) AS d FROM b JOIN panel ON length(c) >= 3 AND (contains(d, c) OR contains(c, d)) WHERE c NOT IN (SELECT c FROM equal) GROUP BY 1),
rest AS (SELECT c, d, CASE WHEN length(c) <= length(d) THEN c ELSE d END AS x, CASE WHEN length(c) <= length(d) THEN d ELSE c END AS y,
                array_to_string(list_sort(list_distinct(string_split(d, ' '))), ' ') AS w
         FROM b, panel WHERE c NOT IN (SELECT c FROM equal UNION ALL SELECT c FROM contained)),
stretches AS (SELECT DISTINCT x, y, substring(y, greatest(k, 0) + 1, least(length(y), k + length(x)) - greatest(k, 0)) AS z
              FROM (SELECT DISTINCT x, y FROM rest), LATERAL (SELECT unnest(range(1 - length(x), length(y))) AS k)
              UNION SELECT y, x, substring(x, greatest(k, 0) + 1, least(length(x), k + length(y)) - greatest(k, 0))
              FROM (SELECT DISTINCT x, y FROM rest WHERE length(x) = length(y)), LATERAL (SELECT unnest(range(1 - length(y), length(x))) AS k)),
part_of AS (SELECT least(x, y) AS x, greatest(x, y) AS y, max({indel("x", "z")}) AS p FROM stretches GROUP BY 1, 2),
scored AS (SELECT c, d, p, {indel("c", "w")} AS s FROM rest JOIN part_of ON part_of.x = least(c, d) AND part_of.y = greatest(c, d)),
alike AS (SELECT c, arg_max(d, (p, s, d)) AS d, max((p, s, d)) AS best FROM scored GROUP BY 1)
SELECT c AS client_brand, d AS panel_brand FROM equal UNION ALL SELECT c, d FROM contained
UNION ALL SELECT c, d FROM alike WHERE best[1] >= 82 AND best[2] >= 60"""


@query(BRAND_SQL)
def brand_alias(spark: SparkSession, sf: str) -> DataFrame:
    b = read(spark, sf, "part").select(F.lower("p_brand").alias("brand")).distinct()
    k = F.get(F.split("brand", "#"), 1).cast("int") % 3
    there = b.select(F.when(k == 0, F.replace("brand", F.lit("#"), F.lit(" #"))).when(k == 1, F.concat(F.lit("maker "), "brand")).otherwise(F.lit("zzz")).alias("brand"))
    return align.align_brands(b, there).select("client_brand", "panel_brand")


def keyed(spark: SparkSession, sf: str) -> coverage.Keyed:
    """Product keys of both sides, all tiers."""
    mine, theirs = sides(spark, sf)
    return coverage.resolve_keys(mine, theirs.drop("brand_low_norm"))


def automatic(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(spark, sf).crosswalk


@query(on_keys("SELECT client_key, panel_key, 'auto' AS basis FROM auto"))
def crosswalk_auto(spark: SparkSession, sf: str) -> DataFrame:
    """Client codes without a twin in the panel, matched by brand and description."""
    return automatic(spark, sf)


@query(on_keys("""
, said AS (SELECT DISTINCT upc_key AS client_key, 'user' || upc_key AS user_key FROM c WHERE upc_key LIKE '%0')
SELECT client_key, coalesce(user_key, panel_key) AS panel_key, CASE WHEN user_key IS NOT NULL THEN 'user' ELSE 'auto' END AS basis FROM auto FULL JOIN said USING (client_key)"""))
def crosswalk_user_override(spark: SparkSession, sf: str) -> DataFrame:
    """The automatic crosswalk of all codes, with a user's two entries for some, of which the later counts."""
    found = keyed(spark, sf)
    own = found.products.where("upc_key like '%0'").select(F.col("upc_key").alias("client_key")).distinct()
    said = own.select("client_key", F.explode(F.array(F.struct(F.lit(1).alias("position"), F.lit("old").alias("panel_key")), F.struct(F.lit(2).alias("position"), F.concat(F.lit("user"), "client_key").alias("panel_key")))).alias("e")).select("client_key", "e.*")
    return align.merge_crosswalk(found.crosswalk, said)


@query(on_keys("SELECT pmatch, count(*) AS rows, count(DISTINCT pkey) AS keys FROM c GROUP BY 1"))
def description_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Product keys with all tiers: code, description, crosswalk, brand."""
    return keyed(spark, sf).products.groupBy("pmatch").agg(F.sum("rows").alias("rows"), F.count_distinct("pkey").alias("keys"))


@query("WITH d AS (SELECT DISTINCT p_name AS a FROM part), e AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS b FROM part) SELECT a, b, round(s, 6) AS token_set FROM (" + token_set_sql("SELECT a, b FROM d, e") + ") WHERE s >= 75")
def fuzzy_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of product names with names and types, from 75 on."""
    part = read(spark, sf, "part")
    return align.alike_pairs(part.select(F.col("p_name").alias("a")), "a", part.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("b")), "b", 75).select("a", "b", F.round("score", 6).alias("token_set"))


# -- mapping graph

#: What a part's number makes of it where parts stand for the columns of a file.
GRAPH_CONCEPTS = (None, "upc", "item_description", "brand", "manufacturer", "category", "client_market", "customer", "week_end_date", "unit", "sales", "volume", "other")
GRAPH_ROLES = ("dimension", "metric", "alternate", "unmapped", "ignored")


def safe_sql(x: str) -> str:
    return f"coalesce(nullif(left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 90), ''), 'item')"


def band_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'none' WHEN {x} >= 0.9 THEN 'high' WHEN {x} >= 0.7 THEN 'medium' WHEN {x} >= 0.5 THEN 'low' ELSE 'needs_review' END"


def severity_sql(x: str) -> str:
    return f"CASE {x} WHEN 'needs_review' THEN 'critical' WHEN 'low' THEN 'warning' ELSE 'info' END"


#: n: all statements of nodes, e: of edges, by place; node and edge: one by id. Names of parts have none of the words that tell areas.
GRAPH_SQL = f"""
WITH m AS (SELECT *, 'client-field-' || {safe_sql("name")} AS source_id, 'meaning-' || {safe_sql("area || '-' || means")} AS means_id, 'panel-field-' || {safe_sql("target")} AS target_id, 'rule-' || {safe_sql("area || '-' || told_by")} AS rule_id,
                  'exception-' || {safe_sql("name || '-' || role || '-' || band")} AS flag_id, role = 'unmapped' OR band IN ('needs_review', 'low') AS flagged, floor(sure * 100 + 0.5)::BIGINT || '% confidence' AS said, {severity_sql("band")} AS severity,
                  CASE WHEN role = 'unmapped' OR band = 'needs_review' THEN 'critical' ELSE 'warning' END AS flag_severity
  FROM (SELECT *, {band_sql("sure")} AS band, coalesce(concept, CASE role WHEN 'ignored' THEN 'Ignored field' WHEN 'unmapped' THEN 'Unmapped field' ELSE 'Needs interpretation' END) AS means,
          CASE WHEN role = 'unmapped' THEN 'exceptions' WHEN concept IN ('client_market', 'customer') THEN 'geography' WHEN concept = 'week_end_date' THEN 'time' WHEN concept IN ('unit', 'sales', 'volume') THEN 'metrics'
               WHEN role = 'metric' AND (concept IS NULL OR concept = 'other') THEN 'metrics' ELSE 'product' END AS area,
          CASE WHEN concept IN ('upc', 'item_description') THEN 'Panel Product ID' WHEN concept = 'brand' THEN 'Panel Brand' WHEN concept = 'manufacturer' THEN 'Panel Manufacturer' WHEN concept = 'category' THEN 'Panel Category'
               WHEN concept = 'client_market' THEN 'Panel Market' WHEN concept = 'customer' THEN 'Panel Customer' WHEN concept = 'week_end_date' THEN 'Panel Period' WHEN concept = 'unit' THEN 'Panel Units' WHEN concept = 'sales' THEN 'Panel Sales'
               WHEN concept = 'volume' THEN 'Panel Volume' WHEN role = 'metric' THEN 'Panel Measure' WHEN concept = 'other' THEN 'Panel other' ELSE 'Panel Target Field' END AS target,
          CASE role WHEN 'dimension' THEN 'Header and sample pattern match' WHEN 'metric' THEN 'Metric classifier' WHEN 'alternate' THEN 'Alternate field candidate' WHEN 'unmapped' THEN 'Manual review required' ELSE 'Excluded from mapping' END AS told_by
        FROM (SELECT pos, name, role, sure, CASE WHEN role NOT IN ('unmapped', 'ignored') THEN concept END AS concept
              FROM (SELECT p_partkey AS pos, p_name AS name, ({list(GRAPH_ROLES)})[p_partkey % 5 + 1] AS role, ({["" if c is None else c for c in GRAPH_CONCEPTS]})[p_partkey % 13 + 1] AS c, nullif(c, '') AS concept, (p_partkey * 37 % 101)::DOUBLE / 100 AS sure FROM part)))),
n AS (SELECT pos, 0 AS k, source_id AS id, name AS label, 'client_field' AS type, area, sure AS confidence, band, severity, [{{'n': 'role', 'v': role}}, {{'n': 'concept', 'v': coalesce(concept, 'Not detected')}}, {{'n': 'evidence', 'v': told_by}}] AS d FROM m
      UNION ALL SELECT pos, 1, means_id, means, 'interpreted_meaning', area, sure, band, severity, [{{'n': 'source_column', 'v': name}}, {{'n': 'evidence', 'v': told_by}}] FROM m
      UNION ALL SELECT pos, 2, target_id, target, 'panel_field', area, sure, band, severity, [{{'n': 'derived_from', 'v': name}}, {{'n': 'detected_concept', 'v': coalesce(concept, 'Needs review')}}] FROM m
      UNION ALL SELECT pos, 3, rule_id, told_by, 'rule', area, sure, band, severity, [{{'n': 'source_column', 'v': name}}] FROM m
      UNION ALL SELECT pos, 4, flag_id, CASE WHEN role = 'unmapped' THEN 'Unmapped client field' ELSE 'Low confidence field mapping' END, 'exception', 'exceptions', sure, band, flag_severity,
                       [{{'n': 'source_column', 'v': name}}, {{'n': 'role', 'v': role}}, {{'n': 'confidence', 'v': sure::VARCHAR}}] FROM m WHERE flagged),
e AS (SELECT pos, 0 AS k, source_id AS source, means_id AS target, said AS label, 'interpreted as' AS relationship, sure AS confidence, band FROM m
      UNION ALL SELECT pos, 1, means_id, target_id, said, 'maps to', sure, band FROM m UNION ALL SELECT pos, 2, rule_id, means_id, 'rule used', 'supports', sure, band FROM m
      UNION ALL SELECT pos, 3, source_id, flag_id, CASE WHEN role = 'unmapped' THEN 'unmapped' ELSE said END, 'flagged by', sure, band FROM m WHERE flagged),
told AS (SELECT id, string_agg(n || '=' || v, '|' ORDER BY n) AS details FROM (SELECT id, d.n AS n, arg_max(d.v, (pos, k)) AS v FROM (SELECT id, pos, k, unnest(d) AS d FROM n) GROUP BY ALL) GROUP BY 1),
node AS (SELECT id, x.label AS label, x.type AS type, x.area AS area, x.confidence AS confidence, x.band AS band, x.severity AS severity, details
         FROM (SELECT id, arg_min({{'label': label, 'type': type, 'area': area, 'confidence': confidence, 'band': band, 'severity': severity}}, (pos, k)) AS x FROM n GROUP BY 1) JOIN told USING (id)),
edge AS (SELECT source, target, x.label AS label, x.relationship AS relationship, x.confidence AS confidence, x.band AS band
         FROM (SELECT source, target, arg_min({{'label': label, 'relationship': relationship, 'confidence': confidence, 'band': band}}, (pos, k)) AS x FROM e GROUP BY 1, 2))
"""
NODE_COLUMNS = ("id", "label", "type", "area", "confidence", "band", "severity")


def parts_graph(spark: SparkSession, sf: str) -> graph.Graph:
    """A graph whose columns are all parts: many state the same nodes."""
    k = F.col("p_partkey")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    role = pick(GRAPH_ROLES, len(GRAPH_ROLES))
    concept = F.when(~role.isin("unmapped", "ignored"), pick(GRAPH_CONCEPTS, len(GRAPH_CONCEPTS)))
    columns = read(spark, sf, "part").select(k.cast("long").alias("position"), F.col("p_name").alias("column"), concept.alias("concept"), role.alias("role"), ((k * 37 % 101).cast("double") / 100).alias("confidence"))
    return graph.assemble(*graph.of_columns(columns))


@query(f"{GRAPH_SQL} SELECT * FROM node")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with the details of all their statements."""
    told = F.array_join(F.array_sort(F.transform(F.map_entries("details"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "|")
    return parts_graph(spark, sf).nodes.select(*NODE_COLUMNS, told.alias("details"))


@query(f"{GRAPH_SQL}, shown AS (SELECT id FROM node WHERE area <> 'exceptions' AND band IN ('high', 'medium')) SELECT * FROM edge WHERE band IN ('high', 'medium') AND source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of at least medium confidence between nodes of such, exceptions left out."""
    g = parts_graph(spark, sf)
    _, edges = graph.visible(g.nodes, g.edges, areas=["product", "geography", "time", "metrics"], bands=["high", "medium"])
    return edges.drop("id")


@query(f"""{GRAPH_SQL} SELECT {", ".join(f"count(*) FILTER (WHERE type = '{t}') AS {n}" for n, t in (("client_fields", "client_field"), ("panel_fields", "panel_field"), ("rules", "rule"), ("exceptions", "exception")))},
{", ".join(f"count(*) FILTER (WHERE band = '{t}') AS {n}" for n, t in (("high_confidence", "high"), ("medium_confidence", "medium"), ("low_confidence", "low"), ("needs_review", "needs_review")))} FROM node""")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stats(parts_graph(spark, sf).nodes)


@query(on_sides(f"""
, q AS (SELECT count(DISTINCT market) AS markets, count(DISTINCT period_key) AS periods, count(DISTINCT upc_key) AS products, round(avg((period_key IS NOT NULL)::INT), 3) AS parsed, count(*) FILTER (WHERE record_status = 'needs_review') AS review FROM client),
f AS (SELECT * FROM (SELECT 'Acme Stores' AS label, 'geography' AS area, 'Customer scope' AS means, 'Panel Customer' AS target, 0.85::DOUBLE AS sure UNION ALL SELECT markets || ' market values', 'geography', 'Market scope', 'Panel Market', CASE WHEN markets > 0 THEN 0.8 END FROM q
      UNION ALL SELECT periods || ' periods', 'time', 'monthly', 'Panel Period', nullif(parsed, 0) FROM q UNION ALL SELECT products || ' products', 'product', 'Product scope', 'Panel Product Universe', CASE WHEN products > 0 THEN 0.75 END FROM q)),
n AS (SELECT 'client-profile-' || {safe_sql("area || '-' || label")} AS id, label, 'client_field' AS type, area, sure FROM f UNION ALL SELECT 'meaning-' || {safe_sql("area || '-' || means")}, means, 'interpreted_meaning', area, sure FROM f
      UNION ALL SELECT 'panel-field-' || {safe_sql("target")}, target, 'panel_field', area, sure FROM f)
SELECT id, label, type, area, sure AS confidence, {band_sql("sure")} AS band, {severity_sql(band_sql("sure"))} AS severity FROM n
UNION ALL SELECT 'exception-quality-review', 'Rows needing review', 'exception', 'exceptions', NULL, 'needs_review', 'critical' FROM q WHERE review > 0"""))
def graph_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the file as a whole."""
    rows = model(spark, sf)
    customer = profile.mode(rows, "customer_standardized").first()
    return graph.assemble(*graph.of_profile(normalize.warned(rows), customer and customer["value"], "monthly")).nodes.select(*NODE_COLUMNS)


#: Nodes and exceptions of a coverage run: statuses st, brands with gaps gap.
COVERED_SQL = f"""
, k AS (SELECT round(count(*) FILTER (WHERE {M}) / count(*), 4) AS rate, CASE WHEN count(*) FILTER (WHERE status IN ('needs_review', 'low_confidence_product_match')) > 0 THEN 'warning' ELSE 'info' END AS severity FROM r),
places AS (SELECT DISTINCT market, panel_market FROM c WHERE market IS NOT NULL),
spelled AS (SELECT * FROM alias ORDER BY client_brand LIMIT 10),
st AS (SELECT *, CASE WHEN status IN ('metric_mismatch', 'needs_review') THEN 'critical' WHEN contains(status, 'matched') THEN 'info' ELSE 'warning' END AS severity
       FROM (SELECT status, count(*) AS n, arg_min(reason, source_row_id) AS note FROM r WHERE status NOT IN ('matched', 'missing_from_client') GROUP BY 1 UNION ALL SELECT status, count(*), min(exception_reason) FROM g WHERE status = 'missing_from_client' GROUP BY 1)),
gap AS (SELECT brand_norm AS brand, count(*) AS n, count(*) FILTER (WHERE {M}) AS hits, round(hits / n, 3) AS rate FROM r WHERE kpi_slice AND brand_norm IS NOT NULL GROUP BY 1 HAVING rate < 0.95 ORDER BY rate, n DESC, brand LIMIT 10)"""


@query(on_run(f"""{COVERED_SQL}
, n AS (SELECT 'rule-coverage-match-engine' AS id, 'Coverage match engine' AS label, 'rule' AS type, 'metrics' AS area, rate::DOUBLE AS confidence, {band_sql("rate")} AS band, severity FROM k
  UNION ALL SELECT 'meaning-matched-coverage', 'Matched coverage result', 'interpreted_meaning', 'metrics', rate, {band_sql("rate")}, severity FROM k
  UNION ALL SELECT 'rule-market-alignment', 'Market alignment rule', 'rule', 'geography', 0.6, 'low', 'warning'
  UNION ALL FROM (VALUES ('rule-customer-alignment', 'Customer alignment rule', 'rule', 'geography', 0.85, 'medium', 'info'), ('client-customer-acme-stores', 'Acme Stores', 'client_field', 'geography', 0.85, 'medium', 'info'), ('panel-customer-acme', 'Acme', 'panel_field', 'geography', 0.85, 'medium', 'info'))
  UNION ALL SELECT 'client-market-' || {safe_sql("market")}, market, 'client_field', 'geography', 0.9, 'high', 'info' FROM places WHERE panel_market IS NOT NULL
  UNION ALL SELECT 'panel-market-' || {safe_sql("panel_market")}, panel_market, 'panel_field', 'geography', 0.9, 'high', 'info' FROM places WHERE panel_market IS NOT NULL
  UNION ALL SELECT 'exception-unmapped-market-' || {safe_sql("market")}, 'Unmapped market: ' || market, 'exception', 'exceptions', NULL, 'needs_review', 'critical' FROM places WHERE panel_market IS NULL
  UNION ALL SELECT DISTINCT 'rule-brand-fuzzy-aliases', 'Brand fuzzy alias rule', 'rule', 'product', 0.75, 'medium', 'info' FROM alias
  UNION ALL SELECT 'client-brand-' || {safe_sql("client_brand")}, client_brand, 'client_field', 'product', 0.75, 'medium', 'info' FROM spelled
  UNION ALL SELECT 'panel-brand-' || {safe_sql("panel_brand")}, panel_brand, 'panel_field', 'product', 0.75, 'medium', 'info' FROM spelled
  UNION ALL SELECT 'exception-' || {safe_sql("status || '-' || n")}, status, 'exception', 'exceptions', NULL, CASE severity WHEN 'info' THEN 'medium' WHEN 'warning' THEN 'low' ELSE 'needs_review' END, severity FROM st
  UNION ALL SELECT 'exception-' || {safe_sql("'brand-match-' || brand")}, 'Brand match: ' || brand, 'exception', 'exceptions', rate, {band_sql("rate")}, CASE WHEN rate = 0 THEN 'critical' ELSE 'warning' END FROM gap)
SELECT * FROM n"""))
def graph_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a coverage run."""
    return graph.assemble(*graph.of_coverage(run(spark, sf))).nodes.select(*NODE_COLUMNS)


@query(on_run(f"""{COVERED_SQL}
SELECT 'exception-unmapped-market-' || {safe_sql("market")} AS id, 'Unmapped client market: ' || market AS title, 'geography' AS area, 'critical' AS severity, NULL::BIGINT AS rows, 'This client market has no panel market.' AS note FROM places WHERE panel_market IS NULL
UNION ALL SELECT 'exception-' || {safe_sql("status || '-' || n")}, status, CASE WHEN status LIKE 'missing%' OR status LIKE '%mismatch' OR status LIKE '%review' THEN 'exceptions' ELSE 'product' END, severity, n, note FROM st WHERE severity <> 'info'
UNION ALL SELECT 'exception-' || {safe_sql("'brand-match-' || brand")}, 'Brand coverage gap: ' || brand, 'product', CASE WHEN rate = 0 THEN 'critical' ELSE 'warning' END, n - hits, floor(rate * 100 + 0.5)::BIGINT || '% match rate for ' || brand || '.' FROM gap"""))
def graph_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    """Exceptions of a coverage run: markets, statuses and the brands with the largest gaps."""
    return graph.assemble(*graph.of_coverage(run(spark, sf))).exceptions.select("id", "title", "area", "severity", "rows", "note")


@query(on_sides("""SELECT source_row_id::VARCHAR AS source_row_id, upper(market) AS "Market", upc AS "UPC", description AS "Item Description", brand AS "Brand" FROM client ORDER BY client.source_row_id LIMIT 25"""))
def preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the client file as text."""
    file = client_file(spark, sf).withColumn("Market", F.upper("Market")).orderBy("source_row_id")
    return tabular.preview(file, 25, ["source_row_id", "Market", "UPC", "Item Description", "Brand"])


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, (_, sql) in _FOUND.items() if sql is not None}
