"""Coverage of a client's rows by the panel: product keys, groups of both sides, their full join and every row's status.

`client` has columns source_row_id, customer, market, market_level, period_key, upc_key, upc, description,
brand, brand_norm, category, sales, units, volume, confidence, record_status, exception_reason; `panel` has
customer, market, period_key, upc_key, upc, description, brand_low_norm, brand_norm, sales, units, volume, position. Both sides are
aggregated before they are joined, so the join's input is groups, and each row meets its group again by the
three keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.functions import text
from shelfspan.operators import align, markets
from shelfspan.sources.shared import collected, stored

#: Statuses in the order of reports.
STATUSES = (
    "matched",
    "matched_with_caveat",
    "low_confidence_product_match",
    "missing_from_discover",
    "missing_from_client",
    "market_mismatch",
    "period_mismatch",
    "metric_mismatch",
    "needs_review",
    "not_comparable",
)
MATCHED = ("matched", "matched_with_caveat")
REVIEW = ("needs_review", "low_confidence_product_match")
ALL_MARKETS = "(all markets rolled up)"
KEYS = ["pkey", "period_key", "panel_market"]
#: What the panel holds of a row's product (see `_keyed_rows`).
HELD = ("anywhere", "known", "known_period")


@dataclass
class Coverage:
    """rows: client rows with status; groups: both sides' groups with status; what the run found on the way. A blocked run has neither."""

    rows: DataFrame | None = None
    groups: DataFrame | None = None
    mode: str = "comparable"
    grain: str = "monthly"
    blocked: bool = False
    reasons: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    customer: str | None = None
    customers: dict[str, str] = field(default_factory=dict)
    markets: markets.Alignment = field(default_factory=lambda: markets.Alignment([]))
    rollup: bool = False
    hierarchy: bool = False
    panel: DataFrame | None = None
    brands: DataFrame | None = None
    crosswalk: DataFrame | None = None


@dataclass
class Facts:
    """What a run needs to know of a side before it plans: labels in order of appearance, market levels, which brand columns hold anything."""

    customers: list[str]
    markets: list[str]
    levels: set[str]
    brands: dict[str, bool]


def facts(df: DataFrame, position: str, brands: list[str]) -> Facts:
    """One aggregation: a row for each customer, market and level."""
    level = F.col("market_level") if "market_level" in df.columns else F.lit(None).cast("string")
    got = collected(df.groupBy("customer", "market", level.alias("level")).agg(F.min(position).alias("at"), *(F.count(b).alias(b) for b in brands)).limit(markets.LABELS * 4))
    got.sort(key=lambda r: r["at"])
    labels = lambda c: list(dict.fromkeys(r[c] for r in got if r[c] is not None))
    return Facts(labels("customer"), labels("market"), set(labels("level")), {b: any(r[b] for r in got) for b in brands})


def place_markets(client: DataFrame, panel: DataFrame, aligned: markets.Alignment, mine: list[str], theirs: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """Adds panel_market, market_ok, market_caveat to client and panel_market to panel, and whether markets are rolled up.

    If no client market is aligned, all markets of both sides are rolled up; if the client has none at all, a
    panel with one market is taken for it. Panel markets that are summed for a client market get its label.
    Boolean in_scope of the panel says whether a client market is mapped to its market, or none is to any.
    """
    spark = client.sparkSession
    found = [m for m in aligned.matches if m[1] is not None]
    if not found and mine and theirs:
        whole = {"panel_market": F.lit(ALL_MARKETS), "market_ok": F.lit(True), "market_caveat": F.lit(True)}
        return client.withColumns(whole), panel.withColumns({"panel_market": F.lit(ALL_MARKETS), "in_scope": F.lit(True)}), True
    if not found:
        only = theirs[0] if len(theirs) == 1 and not mine else None
        one = {"panel_market": F.lit(only).cast("string"), "market_ok": F.lit(only is not None), "market_caveat": F.lit(False)}
        return client.withColumns(one), panel.withColumns({"panel_market": F.col("market"), "in_scope": F.lit(True)}), False
    to = F.broadcast(spark.createDataFrame([(m[0], m[1], m[4]) for m in found], "market string, panel_market string, market_caveat boolean"))
    placed = client.join(to, "market", "left").withColumns({"market_ok": F.col("panel_market").isNotNull(), "market_caveat": F.coalesce("market_caveat", F.lit(False))})
    parts = {d: m[1] for m in found for d in m[5] or ()}
    named = {d: parts.get(d, d) for d in theirs}
    there = F.broadcast(spark.createDataFrame([(d, x, x in {m[1] for m in found}) for d, x in named.items()], "market string, panel_market string, in_scope boolean"))
    return placed, panel.join(there, "market", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False))), False


def _met(df: DataFrame, key: str, row: str, right: DataFrame) -> DataFrame:
    """df left-joined to right (first column: the key). Rows without a key meet nothing, and are spread over the tasks.

    Tables of codes are many times smaller as files than in memory, where Spark would judge by the file whether to send them to all tasks; so both sides are sorted.
    """
    k = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.pmod(F.xxhash64(row), F.lit(1024)).cast("string")))
    other = right.columns[0]
    return df.withColumn("_k", k).join(right.withColumnRenamed(other, "_k").hint("merge"), "_k", "left").drop("_k")


@dataclass
class Keyed:
    """Both sides with product keys; products: a row for each upc_key, description and brand_norm of the client's rows, with their count `rows`."""

    client: DataFrame
    panel: DataFrame
    brands: DataFrame
    crosswalk: DataFrame
    products: DataFrame


def _keyed_rows(client: DataFrame, products: DataFrame) -> DataFrame:
    """Client rows with pkey, pmatch, the panel's spelling of brand_norm, and known and known_period: whether the panel has the product in the client's markets at all, and in the row's period; anywhere tells of all markets."""
    # Rows without code, description and brand meet no product; they are spread, as so many of them would meet in one task.
    alone = F.coalesce("upc_key", "description", "brand_norm").isNull()
    to = products.select(F.col("upc_key").alias("_u"), F.col("description").alias("_d"), F.col("brand_norm").alias("_b"), F.lit(-1).alias("_s"), "pkey", "pmatch", F.col("brand").alias("_brand"), "periods").hint("merge")
    rows = client.withColumn("_salt", F.when(alone, F.pmod(F.xxhash64("source_row_id"), F.lit(1024)).cast("int")).otherwise(-1))
    met = rows.join(to, F.col("upc_key").eqNullSafe(F.col("_u")) & F.col("description").eqNullSafe(F.col("_d")) & F.col("brand_norm").eqNullSafe(F.col("_b")) & (F.col("_salt") == F.col("_s")), "left")
    seen = {"anywhere": F.col("periods").isNotNull(), "known": F.coalesce(F.size("periods") > 0, F.lit(False)), "known_period": F.coalesce(F.array_contains("periods", F.col("period_key")), F.lit(False))}
    return met.withColumns(seen | {"brand_norm": F.col("_brand")}).drop("_u", "_d", "_b", "_s", "_salt", "_brand", "periods")


def resolve_keys(client: DataFrame, panel: DataFrame, user: DataFrame | None = None, cutoff: float = 85) -> Keyed:
    """Adds pkey and pmatch to client, pkey to panel.

    In order: the code's key; for codes the panel lacks, and rows without one, the most alike panel description from the cutoff on, the first on ties;
    the crosswalk's key, built from codes and given by the user; the brand, for what is still unmatched on either side. Client brands take the panel's spelling.
    All of this is found for each different product of a side, of which there are fewer than rows; each side is read once for its products, and rows get their product's keys in one join.
    """
    listed = stored(panel.groupBy("upc_key", "brand_norm").agg(F.min_by("description", "position").alias("description"), F.min("position").alias("position")))
    c = stored(client.groupBy("upc_key", "description", "brand_norm").agg(F.min("source_row_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    codes = stored(listed.where("upc_key is not null").groupBy("upc_key").agg(F.min_by("description", "position").alias("description"), F.min_by("brand_norm", "position").alias("brand"), F.min("position").alias("position")))
    in_panel = codes.select(F.col("upc_key").alias("code"), F.lit(True).alias("known"))
    c = _met(c, "upc_key", "first", in_panel)
    # Brands first: the crosswalk takes the panel's spelling too.
    brand_sides = [df.select(F.col("brand_norm").alias("brand")).where("brand is not null").distinct() for df in (c, listed)]
    brands = stored(align.align_brands(brand_sides[0].join(brand_sides[1], "brand", "left_anti"), brand_sides[1]))
    c = stored(_met(c, "brand_norm", "first", brands.select(F.col("client_brand"), "panel_brand")).withColumn("brand", F.coalesce("panel_brand", "brand_norm")).drop("panel_brand"))

    mine = c.where("known is null and description is not null").select("description").distinct()
    theirs = stored(codes.where("description is not null").groupBy(F.col("description").alias("panel_description")).agg(F.min("position").alias("at"), F.max_by("upc_key", "position").alias("fuzzy_key")))
    alike = align.alike_pairs(mine, "description", theirs, "panel_description", cutoff).join(theirs, "panel_description")
    best = alike.groupBy("description").agg(F.max_by("fuzzy_key", F.struct("score", -F.col("at"))).alias("fuzzy_key"))
    first = c.where("upc_key is not null and known is null").groupBy("upc_key").agg(F.min_by("description", "first").alias("description"), F.min_by("brand", "first").alias("brand"), F.min("first").alias("position"))
    auto = align.build_crosswalk(stored(first), codes)
    crosswalk = stored(align.merge_crosswalk(auto, user if user is not None else client.sparkSession.createDataFrame([], "client_key string, panel_key string, position long")))

    c = _met(c, "description", "first", best)
    hit = F.col("known").isNull() & F.col("fuzzy_key").isNotNull()
    c = c.withColumns({"pkey": F.when(hit, F.col("fuzzy_key")).otherwise(F.col("upc_key")), "pmatch": F.when(hit, "description_fuzzy").when(F.col("upc_key").isNotNull(), "upc")})
    c = _met(c, "pkey", "first", crosswalk.select("client_key", F.col("panel_key").alias("cross_key")))
    c = c.withColumns({"pmatch": F.when(F.col("cross_key").isNotNull(), "upc_crosswalk").otherwise(F.col("pmatch")), "pkey": F.coalesce("cross_key", "pkey")}).drop("cross_key", "fuzzy_key", "known")
    c = _met(c, "pkey", "first", in_panel)
    rolled = F.col("known").isNull() & F.col("brand").isNotNull()
    c = c.withColumns({"pmatch": F.when(rolled, "brand_rollup").otherwise(F.col("pmatch")), "pkey": F.when(rolled, F.concat(F.lit("BRAND::"), "brand")).otherwise(F.col("pkey"))}).drop("known")
    products = stored(c)
    taken = products.where("pkey is not null").select(F.col("pkey").alias("code"), F.lit(True).alias("taken")).distinct()
    p = _met(panel, "upc_key", "position", taken)
    p = p.withColumn("pkey", F.when(F.col("taken").isNull() & F.col("brand_norm").isNotNull(), F.concat(F.lit("BRAND::"), "brand_norm")).otherwise(F.col("upc_key"))).drop("taken")
    return Keyed(client, p, brands, crosswalk, products)


def with_keys(keyed: Keyed) -> Keyed:
    """The client's rows with their product's keys, and with what the panel holds of it: its periods inside the mapped markets, of which a product has few."""
    rows = keyed.panel.where("period_key is not null and pkey is not null")
    held = rows.groupBy("pkey").agg(F.sort_array(F.collect_set(F.when(F.col("in_scope"), F.col("period_key")))).alias("periods"))
    products = stored(_met(keyed.products, "pkey", "first", held))
    return replace(keyed, client=_keyed_rows(keyed.client, products), products=products)


def _first(x: str, order: str) -> Column:
    """The first value that isn't null."""
    return F.min_by(x, F.when(F.col(x).isNotNull(), F.col(order)))


def client_groups(client: DataFrame) -> DataFrame:
    """Sums (null if all are null), first values, mean confidence and row count by product, period and panel market, of rows that have all three."""
    rows = client.where("market_ok and period_key is not null and pkey is not null")
    return rows.groupBy(*KEYS).agg(
        F.sum("sales").alias("client_sales"),
        F.sum("units").alias("client_units"),
        F.sum("volume").alias("client_volume"),
        _first("description", "source_row_id").alias("client_description"),
        _first("upc", "source_row_id").alias("client_upc"),
        _first("brand", "source_row_id").alias("brand"),
        _first("category", "source_row_id").alias("category"),
        _first("pmatch", "source_row_id").alias("pmatch"),
        # Decimals, as a mean of doubles depends on the order of rows.
        (F.sum(F.col("confidence").cast("decimal(18,6)")) / F.count("confidence")).cast("double").alias("confidence"),
        F.bool_or("kpi_slice").alias("kpi_slice"),
        F.bool_or("market_caveat").alias("market_caveat"),
        *(F.bool_or(x).alias(x) for x in HELD),
        F.count("source_row_id").alias("client_row_count"),
    )


def panel_groups(panel: DataFrame) -> DataFrame:
    rows = panel.where("period_key is not null and pkey is not null")
    return rows.groupBy(*KEYS).agg(
        F.sum("sales").alias("panel_sales"),
        F.sum("units").alias("panel_units"),
        F.sum("volume").alias("panel_volume"),
        _first("description", "position").alias("panel_description"),
        _first("upc", "position").alias("panel_upc"),
        F.bool_or("in_scope").alias("in_scope"),
    )


def join_groups(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """The full join of both sides' groups with status, exception_reason and deltas; a panel market that no client market is mapped to only tells what it holds."""
    inside = theirs.where("in_scope").drop("in_scope")
    j = mine.withColumn("mine", F.lit(True)).join(inside.withColumn("theirs", F.lit(True)), KEYS, "full")
    both = F.col("mine").isNotNull() & F.col("theirs").isNotNull()
    empty = F.col("client_sales").isNull() & F.col("client_units").isNull()
    rolled_up = F.col("panel_market") == ALL_MARKETS
    cases = [
        (both & empty, "metric_mismatch", "client rows have no comparable sales/unit values"),
        (both & (F.col("pmatch") == "description_fuzzy"), "low_confidence_product_match", "matched by description similarity, not UPC"),
        (both & (F.col("pmatch") == "upc_crosswalk"), "matched_with_caveat", "matched via UPC crosswalk (brand + pack/size + description)"),
        (both & (F.col("pmatch") == "brand_rollup"), "matched_with_caveat", "matched at brand level (UPC not in the panel)"),
        (both & rolled_up, "matched_with_caveat", "matched with client markets rolled up"),
        (both & F.col("market_caveat"), "matched_with_caveat", "client market matched to a panel market with a caveat"),
        (both, "matched", None),
        (F.col("mine").isNull(), "missing_from_client", "panel row without a client counterpart"),
        (F.col("known") & ~F.col("known_period"), "period_mismatch", "product is in the panel, but not in this period"),
        (~F.col("known") & F.col("anywhere"), "market_mismatch", "product is in the panel, but only in unmapped markets"),
        (F.lit(True), "missing_from_discover", "product and period aren't in the panel"),
    ]
    chain = lambda k: F.coalesce(*(F.when(c[0], F.lit(c[1])) for c in cases)) if k == 1 else F.coalesce(*(F.when(c[0], F.lit(c[2] or "")) for c in cases))
    return j.withColumns(
        {
            "status": chain(1),
            "exception_reason": F.nullif(chain(2), F.lit("")),
            "sales_delta": F.round(F.col("client_sales") - F.col("panel_sales"), 2),
            "unit_delta": F.round(F.col("client_units") - F.col("panel_units"), 2),
        }
    ).drop("mine", "theirs", *HELD)


def row_statuses(client: DataFrame, groups: DataFrame) -> DataFrame:
    """Client rows with status and exception_reason: what the row lacks, else its group's."""
    of = groups.where("client_row_count is not null").select(*KEYS, F.col("status").alias("group_status"), F.col("exception_reason").alias("group_reason"))
    rows = client.withColumnRenamed("exception_reason", "row_reason")
    # Rows without a key meet no group; they stay where they are, as so many of them would meet in one task.
    whole = F.lit(True)
    for k in KEYS:
        whole = whole & F.col(k).isNotNull()
    rows = rows.where(whole).join(of, KEYS, "left").unionByName(rows.where(~whole), allowMissingColumns=True)
    cases = [
        (F.col("record_status") == "needs_review", F.lit("needs_review"), F.col("row_reason")),
        (~F.col("market_ok"), F.lit("market_mismatch"), F.lit("client market has no panel market")),
        (F.col("period_key").isNull(), F.lit("needs_review"), F.lit("period_unparsed")),
        (F.col("pkey").isNull(), F.lit("missing_from_discover"), F.lit("no product key")),
        (F.lit(True), F.coalesce("group_status", F.lit("needs_review")), F.col("group_reason")),
    ]
    pick = F.coalesce(*(F.when(c, F.struct(s.alias("status"), r.alias("exception_reason"))) for c, s, r in cases))
    return rows.withColumn("s", pick).select(*(c for c in rows.columns if c not in ("group_status", "group_reason", "row_reason")), "s.status", "s.exception_reason")


def run_coverage(client: DataFrame, panel: DataFrame, mode: str = "comparable", grain: str = "monthly", user_crosswalk: DataFrame | None = None) -> Coverage:
    """Statuses of client rows and of both sides' groups, or the reason why they can't be compared.

    Blocked are files that lack what a comparison needs, and files of which no customer is one of the panel's. Each side, its groups and
    their join are written once and read where they are needed (see `stored`).
    """
    run = Coverage(mode=mode, grain=grain if grain in ("weekly", "monthly") else "weekly")
    if mode == "not_comparable":
        return _blocked(run, "The client file lacks dimensions or measures that a comparison needs.")
    client, panel = stored(client), stored(panel)
    mine, theirs = facts(client, "source_row_id", ["brand_norm"]), facts(panel, "position", ["brand_low_norm", "brand_norm"])
    spark = client.sparkSession
    found, notes = markets.customer_map(spark, mine.customers, theirs.customers)
    run.customers, run.warnings = {c: d for c, (d, _) in found.items()}, notes
    if mine.customers and theirs.customers and not found:
        return _blocked(run, "No customer of the client file is one of the panel's; check the panel's scope.")
    run.customer = next(iter(mine.customers or theirs.customers), None)
    run.markets = markets.align_labels(spark, mine.markets, theirs.markets, run.customer)
    run.warnings = run.warnings + run.markets.warnings
    run.hierarchy = mine.levels == {"total", "detail"}
    # Brands of descriptions stand in only where a file has none at all.
    of_description = text.brand_from_description(F.col("description"))
    if not mine.brands["brand_norm"]:
        client = client.withColumn("brand_norm", of_description)
    own = F.coalesce("brand_low_norm", "brand_norm") if theirs.brands["brand_low_norm"] else F.col("brand_norm") if theirs.brands["brand_norm"] else of_description
    panel = panel.withColumn("brand_norm", own).drop("brand_low_norm")
    placed, there, run.rollup = place_markets(client, panel, run.markets, mine.markets, theirs.markets)
    if run.rollup:
        run.warnings = [*run.warnings, "No client market is one of the panel's; all are rolled up and compared with the panel's total, with a caveat."]
    keyed = with_keys(resolve_keys(placed.withColumn("kpi_slice", ~F.col("market_level").eqNullSafe("detail") if run.hierarchy else F.lit(True)), there, user_crosswalk))
    run.panel, run.brands, run.crosswalk = panel, keyed.brands, keyed.crosswalk
    run.groups = stored(join_groups(client_groups(keyed.client), panel_groups(keyed.panel)))
    run.rows = row_statuses(keyed.client.drop(*HELD), run.groups)
    return run


def _blocked(run: Coverage, reason: str) -> Coverage:
    run.blocked, run.reasons = True, [reason]
    return run
