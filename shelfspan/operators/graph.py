"""Mapping graph: how columns, profile, recommendation and coverage of a client file connect, as frames of nodes, edges and exceptions.

Each source of the graph is a frame whose rows state the nodes, edges and exceptions they stand for as arrays, so a row is
read once. `assemble` unites sources and merges what has the same id: the first statement of a node counts, its details
are those of all statements (of a repeated detail the latest), and so is the first description that isn't empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspan.functions import text
from shelfspan.operators import reports
from shelfspan.operators.coverage import Coverage
from shelfspan.operators.schema import Detection

#: Words that put a label in an area of the graph; the first area with one of them counts, product where none has.
AREA_WORDS = (
    ("exceptions", ("exception", "warning", "mismatch", "missing", "unmapped", "review", "blocked", "low confidence")),
    ("product", ("upc", "ean", "sku", "item", "product", "brand", "manufacturer", "category", "description", "pack", "size", "crosswalk")),
    ("geography", ("market", "region", "geo", "geography", "city", "state", "province", "customer", "retailer", "banner", "store")),
    ("time", ("period", "week", "month", "quarter", "year", "date", "time", "calendar")),
    ("metrics", ("sales", "dollar", "revenue", "unit", "volume", "measure", "metric", "value", "qty", "quantity")),
)
#: Words of a concept and role, and the panel's field that they stand for; the first field with one of them counts.
TARGET_WORDS = (
    ("Panel Product ID", ("upc", "ean", "sku", "item", "product identifier")),
    ("Panel Item Description", ("description", "item description", "product description")),
    ("Panel Brand", ("brand",)),
    ("Panel Manufacturer", ("manufacturer",)),
    ("Panel Category", ("category",)),
    ("Panel Market", ("market", "region", "geo", "city", "province", "state")),
    ("Panel Customer", ("customer", "retailer", "banner")),
    ("Panel Period", ("period", "week", "month", "date", "time")),
    ("Panel Units", ("unit",)),
    ("Panel Sales", ("sales", "dollar", "revenue", "value")),
    ("Panel Volume", ("volume",)),
    ("Panel Measure", ("metric", "measure")),
)
#: What a column without a concept means by its role, and the rule that gave a role.
MEANINGS = {"wide_period": "Period and metric", "ignored": "Ignored field", "unmapped": "Unmapped field"}
RULES = {
    "wide_period": "Wide period parser",
    "metric": "Metric classifier",
    "auxiliary_metric": "Metric classifier",
    "dimension": "Header and sample pattern match",
    "alternate": "Alternate field candidate",
    "ignored": "Excluded from mapping",
    "unmapped": "Manual review required",
}
#: The middle of each area's ellipse, its radii, and how much farther out two types stand.
PLACES = {
    "product": (-520, -280, 300, 190),
    "geography": (220, -260, 300, 190),
    "time": (-520, 260, 260, 160),
    "metrics": (220, 260, 270, 170),
    "exceptions": (820, 0, 230, 220),
}
FARTHER = {"rule": 42, "exception": 72}
#: How many entries of growing lists are drawn (fixed values).
MARKETS, CUSTOMERS, ALIASES, NAMED_ALIASES, UNMAPPED, GAPS, EXAMPLES = 12, 8, 10, 12, 12, 10, 8
#: Brands that match less than this are gaps.
GAP = 0.95

NODE = "struct<k:int,id:string,label:string,type:string,area:string,confidence:double,band:string,description:string,details:map<string,string>,severity:string>"
EDGE = "struct<k:int,id:string,source:string,target:string,label:string,relationship:string,confidence:double,band:string>"
FLAG = "struct<k:int,id:string,title:string,area:string,severity:string,rows:bigint,note:string,node_id:string>"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    exceptions: DataFrame


def _col(x: Column | str | float | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def confidence_band(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "none").when(x >= 0.9, "high").when(x >= 0.7, "medium").when(x >= 0.5, "low").otherwise("needs_review")


def severity(band: Column) -> Column:
    return F.when(band == "needs_review", "critical").when(band == "low", "warning").otherwise("info")


def _first_with_words(label: Column, table: tuple) -> Column:
    return F.coalesce(*(F.when(F.lower(label).rlike("|".join(words)), F.lit(name)) for name, words in table))


def area(label: Column) -> Column:
    return F.coalesce(_first_with_words(label, AREA_WORDS), F.lit("product"))


def target_field(concept: Column, role: Column) -> Column:
    said = F.concat_ws(" ", F.coalesce(concept, F.lit("")), role)
    return F.coalesce(_first_with_words(said, TARGET_WORDS), F.concat(F.lit("Panel "), concept), F.lit("Panel Target Field"))


def _looked_up(role: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(role == k, F.lit(v)) for k, v in table.items()))


def meaning(concept: Column, role: Column) -> Column:
    return F.coalesce(concept, _looked_up(role, MEANINGS), F.lit("Needs interpretation"))


def rule(role: Column) -> Column:
    return F.coalesce(_looked_up(role, RULES), F.concat(role, F.lit(" rule")))


def identifier(prefix: str, *parts: Column | str) -> Column:
    label = F.concat_ws("-", *map(_col, parts))
    return F.concat(F.lit(f"{prefix}-"), F.coalesce(F.nullif(text.safe_id(label), F.lit("")), F.lit("item")))


def percent(x: Column) -> Column:
    """A share in whole per cent, halves up."""
    return F.floor(x * 100 + 0.5).cast("string")


def confidence_label(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "Needs review").otherwise(F.concat(percent(x), F.lit("% confidence")))


def node(k: int, id: Column | str, label, type: str, area, confidence=None, band=None, description: Column | str = "", details: dict | None = None, level=None) -> Column:
    """One node; `k` is its place among those of its row. Band and severity follow from the confidence where they aren't given."""
    c = _col(confidence).cast("double")
    b = _col(band) if band is not None else confidence_band(c)
    pairs = [x for name, v in (details or {}).items() for x in (F.lit(name), _col(v).cast("string"))]
    said = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map()
    return F.struct(F.lit(k), _col(id), _col(label), F.lit(type), _col(area), c, b, _col(description), said, _col(level) if level is not None else severity(b)).cast(NODE)


def edge(k: int, source: Column | str, target: Column | str, label, relationship: str, confidence=None, band=None) -> Column:
    c = _col(confidence).cast("double")
    a, b = _col(source), _col(target)
    return F.struct(F.lit(k), F.concat(a, F.lit("->"), b), a, b, _col(label), F.lit(relationship), c, _col(band) if band is not None else confidence_band(c)).cast(EDGE)


def flag(id, title, area, level, note, node_id, rows=None) -> Column:
    return F.struct(F.lit(0), _col(id), _col(title), _col(area), _col(level), _col(rows).cast("long"), _col(note), _col(node_id)).cast(FLAG)


def _stated(df: DataFrame, position: Column, nodes: Sequence[Column], edges: Sequence[Column] = (), exceptions: Sequence[Column] = ()) -> DataFrame:
    """(position, nodes, edges, exceptions): what each row states; null members are left out."""
    kept = lambda xs, kind: F.filter(F.array(*xs).cast(f"array<{kind}>"), lambda x: x.isNotNull())
    return df.select(position.cast("long").alias("position"), kept(nodes, NODE).alias("nodes"), kept(edges, EDGE).alias("edges"), kept(exceptions, FLAG).alias("exceptions"))


def mappings_frame(spark: SparkSession, found: Detection) -> DataFrame:
    """(position, column, concept, role, confidence) of a detection; columns that are ignored or unmapped have no concept."""
    rows = [(k, m["column"], None if m["role"] in ("ignored", "unmapped") else m["concept"], m["role"], float(m["confidence"])) for k, m in enumerate(found.mappings)]
    return spark.createDataFrame(rows, "position long, column string, concept string, role string, confidence double")


def of_columns(mappings: DataFrame) -> list[DataFrame]:
    """Columns of a file, their meanings, the panel's fields and the rules between them; columns of periods in headers are one node."""
    c = F.col
    column, concept, role, sure = c("column"), c("concept"), c("role"), c("confidence")
    where = area(F.concat_ws(" ", column, F.coalesce(concept, F.lit("")), role))
    means, target, by = meaning(concept, role), target_field(concept, role), rule(role)
    ids = {"source": identifier("client-field", column), "means": identifier("meaning", c("area"), c("means")), "target": identifier("panel-field", c("target")), "rule": identifier("rule", c("area"), c("by"))}
    rows = mappings.where("role != 'wide_period'").select("*", where.alias("area"), means.alias("means"), target.alias("target"), by.alias("by"), confidence_band(sure).alias("band"))
    rows = rows.select("*", *(x.alias(f"{n}_id") for n, x in ids.items()), identifier("exception", column, role, c("band")).alias("flag_id"))
    unmapped = role == "unmapped"
    flagged = unmapped | c("band").isin("needs_review", "low")
    title = F.when(unmapped, "Unmapped client field").otherwise("Low confidence field mapping")
    level = F.when(unmapped | (c("band") == "needs_review"), "critical").otherwise("warning")
    at, said = c("area"), confidence_label(sure)
    normal = _stated(
        rows,
        c("position"),
        [
            node(0, c("source_id"), column, "client_field", at, sure, None, "A column of the client file.", {"role": role, "concept": F.coalesce(concept, F.lit("Not detected")), "evidence": c("by")}),
            node(1, c("means_id"), c("means"), "interpreted_meaning", at, sure, None, "What the column means.", {"source_column": column, "evidence": c("by")}),
            node(2, c("target_id"), c("target"), "panel_field", at, sure, None, "The field of the panel that it compares with.", {"derived_from": column, "detected_concept": F.coalesce(concept, F.lit("Needs review"))}),
            node(3, c("rule_id"), c("by"), "rule", at, sure, None, "The rule that mapped the column.", {"source_column": column}),
            F.when(flagged, node(4, c("flag_id"), title, "exception", "exceptions", sure, None, "A person should look at this column.", {"source_column": column, "role": role, "confidence": sure}, level)),
        ],
        [
            edge(0, c("source_id"), c("means_id"), said, "interpreted as", sure),
            edge(1, c("means_id"), c("target_id"), said, "maps to", sure),
            edge(2, c("rule_id"), c("means_id"), "rule used", "supports", sure),
            F.when(flagged, edge(3, c("source_id"), c("flag_id"), F.when(unmapped, "unmapped").otherwise(said), "flagged by", sure)),
        ],
        [F.when(flagged, flag(c("flag_id"), title, at, level, F.concat(column, F.lit(": "), c("by")), c("source_id")))],
    )
    in_order = F.array_sort(F.collect_list(F.struct("position", "column")))  # headers of one file
    wide = mappings.where("role = 'wide_period'").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.slice(in_order, 1, EXAMPLES), lambda x: x["column"]), "; ").alias("examples")).where("n > 0")
    source, means_id, target_id, rule_id = "client-field-wide-period-columns", "meaning-wide-periods", "panel-field-panel-period", "rule-wide-period-parser"
    header = _stated(
        wide,
        F.lit(0),
        [
            node(0, source, F.concat(c("n").cast("string"), F.lit(" wide period columns")), "client_field", "time", 0.9, None, "Columns whose headers name a period and a measure.", {"examples": c("examples")}),
            node(1, means_id, "Period and metric in header", "interpreted_meaning", "time", 0.9, None, "Headers are read as periods and measures, one row for each."),
            node(2, target_id, "Panel Period", "panel_field", "time", 0.9, None, "The panel's periods."),
            node(3, rule_id, "Wide period parser", "rule", "time", 0.9, None, "Turns columns of months or weeks into rows."),
        ],
        [edge(0, source, means_id, "90% confidence", "interpreted as", 0.9), edge(1, means_id, target_id, "unpivoted", "normalizes to", 0.9), edge(2, rule_id, means_id, "rule used", "supports", 0.9)],
    )
    return [normal, header]


def of_profile(facts: DataFrame, customer: str | None, grain: str | None) -> list[DataFrame]:
    """What the file as a whole says; `facts` is the one row of `normalize.quality` with `normalize.warned`."""
    c = F.col
    some = lambda n, x: F.when(c(n) > 0, F.lit(x))
    counted = lambda n, what: F.concat(c(n).cast("string"), F.lit(f" {what}"))
    span = F.concat(F.coalesce(c("period_start").cast("string"), F.lit("?")), F.lit(" to "), F.coalesce(c("period_end").cast("string"), F.lit("?")))
    told = (
        (_col(customer or "Customer scope"), "geography", "Customer scope", "Panel Customer", _col(customer), _col(0.85 if customer else None)),
        (counted("distinct_markets", "market values"), "geography", "Market scope", "Panel Market", c("distinct_markets"), some("distinct_markets", 0.8)),
        (counted("distinct_periods", "periods"), "time", grain or "Period scope", "Panel Period", span, F.nullif(c("period_parse_rate"), F.lit(0.0))),
        (counted("distinct_products", "products"), "product", "Product scope", "Panel Product Universe", c("distinct_products"), some("distinct_products", 0.75)),
    )
    nodes, edges = [], []
    for k, (label, at, means, target, value, sure) in enumerate(told):
        sure = sure.cast("double")
        source_id, means_id, target_id = identifier("client-profile", at, label), identifier("meaning", at, means), identifier("panel-field", target)
        nodes += [
            node(3 * k, source_id, label, "client_field", at, sure, None, "Read from the client file as a whole.", {"value": value}),
            node(3 * k + 1, means_id, means, "interpreted_meaning", at, sure, None, "A scope of the client's file."),
            node(3 * k + 2, target_id, target, "panel_field", at, sure, None, "What the scope is compared with."),
        ]
        edges += [edge(2 * k, source_id, means_id, confidence_label(sure), "summarized as", sure), edge(2 * k + 1, means_id, target_id, "target scope", "aligns to", sure)]
    review, notes = c("rows_needing_review"), F.array_join("warnings", " ")
    bad = (review > 0) | (F.size("warnings") > 0)
    level = F.when(review > 0, "critical").otherwise("warning")
    id = "exception-quality-review"
    nodes.append(F.when(bad, node(20, id, "Rows needing review", "exception", "exceptions", None, "needs_review", "Rows or warnings of the file need a look.", {"rows_needing_review": review, "warnings": notes}, level)))
    flags = [F.when(bad, flag(id, "Client file quality review", "exceptions", level, F.coalesce(F.nullif(notes, F.lit("")), F.lit("Rows need a look.")), id, review))]
    return [_stated(facts, F.lit(0), nodes, edges, flags)]


def of_recommendation(spark: SparkSession, rec: dict) -> list[DataFrame]:
    """The export to pull and its caveats."""
    c = F.col
    caveats = spark.createDataFrame(list(enumerate(rec["caveats"])), "position long, caveat string")
    rule_id, dataset_id, level = "rule-panel-pull-recommendation", identifier("panel-field", rec["recommended_dataset"]), "warning" if rec["caveats"] else "info"
    listed = lambda *keys: {k: "; ".join(rec[k]) if isinstance(rec[k], list) else rec[k] for k in keys}
    pull = _stated(
        spark.range(1),
        F.lit(-1),
        [
            node(0, rule_id, "Panel pull recommendation", "rule", "metrics", 0.8, None, "The export that a comparison needs.", listed("country", "comparison_mode", "required_fields", "optional_fields", "caveats"), level),
            node(1, dataset_id, rec["recommended_dataset"], "panel_field", "metrics", 0.8, None, "The data set to pull from.", listed("required_measures", "product_grain", "time_grain"), level),
        ],
        [edge(0, rule_id, dataset_id, "recommended pull", "selects", 0.8)],
    )
    id = identifier("exception", "recommendation", c("caveat"))
    each = _stated(
        caveats,
        c("position"),
        [node(0, id, "Recommendation caveat", "exception", "exceptions", None, "needs_review", c("caveat"), {"caveat": c("caveat")}, "warning")],
        [edge(0, dataset_id, id, "caveat", "flagged by", None, "needs_review")],
        [flag(id, "Panel recommendation caveat", "exceptions", "warning", c("caveat"), id)],
    )
    return [pull, each]


def _pairs(spark: SparkSession, pairs: dict[str, str], most: int) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(list(pairs.items())[:most])], "position long, mine string, theirs string")


def _aligned(pairs: DataFrame, kind: str, at: str, sure: float, rule_node: Column | None, rule_id: str, lookup: str, aligned: str) -> DataFrame:
    """Client values, the rule that aligns them and panel values."""
    c = F.col
    a, b = identifier(f"client-{kind}", c("mine")), identifier(f"panel-{kind}", c("theirs"))
    nodes = [node(1, a, c("mine"), "client_field", at, sure, None, f"A {kind} of the client."), node(2, b, c("theirs"), "panel_field", at, sure, None, f"A {kind} of the panel.")]
    return _stated(pairs, c("position"), ([rule_node] if rule_node is not None else []) + nodes, [edge(0, a, rule_id, lookup, "uses", sure), edge(1, rule_id, b, aligned, "maps to", sure)])


def of_coverage(run: Coverage) -> list[DataFrame]:
    """What a run matched and what not. Lists that grow with the file are as long as the graph draws them; blocked runs have no nodes."""
    if run.blocked:
        return []
    spark, c = run.rows.sparkSession, F.col
    figures = reports.kpis(run, run.mode)
    engine, matched, sure = "rule-coverage-match-engine", "meaning-matched-coverage", c("row_coverage_pct")
    level = F.when(c("rows_needing_review") > 0, "warning").otherwise("info")
    result = _stated(
        figures,
        F.lit(0),
        [
            node(0, engine, "Coverage match engine", "rule", "metrics", sure, None, "Compares client rows with the panel.", {"match_grain": "code or item, period, customer and market", "comparison_mode": run.mode, **{k: c(k) for k in ("matched_rows", "total_client_rows", "row_coverage_pct", "sales_coverage_pct")}}, level),
            node(1, matched, "Matched coverage result", "interpreted_meaning", "metrics", sure, None, "What of the file the panel covers.", {"row_coverage": F.concat(percent(sure), F.lit("%")), "sales_coverage": F.concat(percent(c("sales_coverage_pct")), F.lit("%")), "delta_label": c("delta_label")}, level),
        ],
        [edge(0, engine, matched, confidence_label(sure), "produces", sure)],
    )
    lacking = [] if run.rollup else [m[0] for m in run.markets.matches if m[1] is None]
    by_market = "rule-market-alignment"
    placed = _stated(
        spark.range(1),
        F.lit(1),
        [node(0, by_market, "Market rollup rule" if run.rollup else "Market alignment rule", "rule", "geography", 0.6 if lacking else 0.9, "low" if lacking else "high", "Maps client markets to the panel's.", {"market_rollup_mode": str(run.rollup).lower(), "market_hierarchy_detected": str(run.hierarchy).lower(), "unmapped_client_markets": "; ".join(lacking)}, "warning" if lacking else "info")],
    )
    by_customer, by_brand = "rule-customer-alignment", "rule-brand-fuzzy-aliases"
    customer_rule = node(0, by_customer, "Customer alignment rule", "rule", "geography", 0.85, None, "Maps the client's customers to the panel's.")
    w = Window.orderBy("client_brand")
    drawn = run.brands.orderBy("client_brand").limit(max(ALIASES, NAMED_ALIASES))  # bounded, so one window holds it
    aliases = drawn.select((F.row_number().over(w) - 1).alias("position"), c("client_brand").alias("mine"), c("panel_brand").alias("theirs"))
    named = aliases.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "mine", "theirs"))), lambda x: F.concat(x["mine"], F.lit(" to "), x["theirs"])), "; ").alias("aliases")).where("n > 0")
    alias_rule = _stated(named, F.lit(0), [node(0, by_brand, "Brand fuzzy alias rule", "rule", "product", 0.75, None, "Matches brands that both sides spell differently.", {"aliases": c("aliases")})])
    unmapped = spark.createDataFrame(list(enumerate(lacking[:UNMAPPED])), "position long, market string")
    id, title = identifier("exception", "unmapped-market", c("market")), F.concat(F.lit("Unmapped market: "), c("market"))
    missing = _stated(
        unmapped,
        c("position"),
        [node(0, id, title, "exception", "exceptions", None, "needs_review", "No panel market is mapped to this one.", {"client_market": c("market")}, "critical")],
        [edge(0, by_market, id, "unmapped", "flags", None, "needs_review")],
        [flag(id, F.concat(F.lit("Unmapped client market: "), c("market")), "geography", "critical", "This client market has no panel market.", id)],
    )
    return [
        result,
        placed,
        _aligned(_pairs(spark, run.markets.mapped(), MARKETS), "market", "geography", 0.9, None, by_market, "market lookup", "aligned"),
        _aligned(_pairs(spark, run.customers, CUSTOMERS), "customer", "geography", 0.85, customer_rule, by_customer, "customer lookup", "aligned"),
        alias_rule,
        _aligned(aliases.where(c("position") < ALIASES), "brand", "product", 0.75, None, by_brand, "fuzzy alias", "matched"),
        missing,
        _statuses(reports.exceptions(run), matched),
        _gaps(reports.brand_diagnostic(run)),
    ]


def _statuses(statuses: DataFrame, matched: str) -> DataFrame:
    c = F.col
    status, rows = c("status"), c("rows")
    level = F.when(status.rlike("not_comparable|metric_mismatch|needs_review"), "critical").when(F.contains(status, F.lit("matched")), "info").otherwise("warning")
    band = F.when(level == "info", "medium").when(level == "warning", "low").otherwise("needs_review")
    id = identifier("exception", status, rows.cast("string"))
    return _stated(
        statuses,
        c("rank"),
        [node(0, id, status, "exception", "exceptions", None, band, F.coalesce(c("note"), F.lit("A status of the coverage run.")), {"rows": rows, "client_sales": c("client_sales"), "panel_sales": c("panel_sales"), "note": c("note")}, level)],
        [edge(0, matched, id, F.concat(F.format_number(rows, 0), F.lit(" rows")), "breaks out into", None, band)],
        [F.when(level != "info", flag(id, status, area(status), level, c("note"), id, rows))],
    )


def _gaps(diagnostic: DataFrame) -> DataFrame:
    """Brands with incomplete matches: the least matched first, then those of most rows, then by name."""
    c = F.col
    order = (c("match_rate"), F.desc("client_rows"), c("brand"))
    few = diagnostic.where(c("match_rate") < GAP).orderBy(*order).limit(GAPS)
    placed = few.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # GAPS rows
    id, rate = identifier("exception", "brand-match", c("brand")), c("match_rate")
    level = F.when(rate == 0, "critical").otherwise("warning")
    return _stated(
        placed,
        c("place"),
        [node(0, id, F.concat(F.lit("Brand match: "), c("brand")), "exception", "exceptions", rate, None, "Not all rows of the brand match.", {k: c(k) for k in ("brand", "client_rows", "matched_rows", "match_rate", "client_sales")}, level)],
        (),
        [flag(id, F.concat(F.lit("Brand coverage gap: "), c("brand")), "product", level, F.concat(percent(rate), F.lit("% match rate for "), c("brand"), F.lit(".")), id, c("client_rows") - c("matched_rows"))],
    )


def assemble(*sources: DataFrame) -> Graph:
    """One graph of all sources, earlier ones first. Merging is by id with partial aggregates, so its state is that of one node's details."""
    stated = None
    for k, source in enumerate(sources):
        part = source.withColumn("source_no", F.lit(k))
        stated = part if stated is None else stated.unionByName(part)
    if stated is None:
        raise ValueError("a graph needs a source")
    seq = F.struct("source_no", "position", "k").alias("seq")
    listed = lambda name: stated.select("source_no", "position", F.inline(name)).select(seq, "*").drop("source_no", "position", "k")
    drafts = listed("nodes")
    fixed = ("label", "type", "area", "confidence", "band", "severity")
    each = drafts.select("seq", "id", F.struct(*fixed).alias("said"), F.nullif("description", F.lit("")).alias("description"), F.explode_outer("details").alias("name", "value"))
    described = F.struct("seq", "description")
    by_detail = each.groupBy("id", "name").agg(F.max_by("value", "seq").alias("value"), F.min(F.struct("seq", "said")).alias("first"), F.min(F.when(F.col("description").isNotNull(), described)).alias("described"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value"))))
    merged = by_detail.groupBy("id").agg(F.min("first").alias("first"), F.min("described").alias("described"), F.map_from_entries(pairs).alias("details"))
    nodes = merged.select(F.col("first.seq").alias("seq"), "id", "first.said.*", F.coalesce("described.description", F.lit("")).alias("description"), "details")
    once = lambda df: df.groupBy("id").agg(F.min_by(F.struct(*(c for c in df.columns if c != "id")), "seq").alias("x")).select("id", "x.*").drop("seq")
    known = nodes.select("id")
    edges = once(listed("edges"))
    edges = edges.join(known, edges["source"] == known["id"], "left_semi").join(known, edges["target"] == known["id"], "left_semi")
    return Graph(layout(nodes).drop("seq"), edges, once(listed("exceptions")))


def layout(nodes: DataFrame) -> DataFrame:
    """Adds x and y: nodes of an area stand on an ellipse around its middle, in the order of `seq`; rules and exceptions farther out."""
    w = Window.partitionBy("area")
    k, n = F.row_number().over(w.orderBy("seq", "id")) - 1, F.count(F.lit(1)).over(w)
    of = lambda i: F.coalesce(*(F.when(F.col("area") == name, F.lit(float(p[i]))) for name, p in PLACES.items()))
    out = F.coalesce(*(F.when(F.col("type") == t, F.lit(float(x))) for t, x in FARTHER.items()), F.lit(0.0))
    turn = 2 * F.pi() * k / n
    return nodes.withColumns({"x": F.round(of(0) + F.cos(turn) * (of(2) + out), 6), "y": F.round(of(1) + F.sin(turn) * (of(3) + out), 6)})


def stats(nodes: DataFrame) -> DataFrame:
    """One row of eight counts: four types, four bands."""
    types = {"client_fields": "client_field", "panel_fields": "panel_field", "rules": "rule", "exceptions": "exception"}
    bands = {"high_confidence": "high", "medium_confidence": "medium", "low_confidence": "low", "needs_review": "needs_review"}
    return nodes.agg(*(F.count_if(F.col("type") == t).alias(n) for n, t in types.items()), *(F.count_if(F.col("band") == b).alias(n) for n, b in bands.items()))


def visible(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, areas: list[str] | None = None, bands: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given kinds, and edges of the given bands between them."""
    for column, values in (("type", types), ("area", areas), ("band", bands)):
        if values is not None:
            nodes = nodes.where(F.col(column).isin(*values))
    ids = nodes.select("id")
    e = edges.where(F.col("band").isin(*bands)) if bands is not None else edges
    return nodes, e.join(ids, e["source"] == ids["id"], "left_semi").join(ids, e["target"] == ids["id"], "left_semi")


def adjacent(edges: DataFrame, node_id: str) -> DataFrame:
    """(id,): the node and its neighbours."""
    touching = edges.where((F.col("source") == node_id) | (F.col("target") == node_id))
    return touching.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def exceptions_of(exceptions: DataFrame, node_id: str) -> DataFrame:
    """Exceptions that are linked to the node or are it."""
    return exceptions.where((F.col("node_id") == node_id) | (F.col("id") == node_id))
