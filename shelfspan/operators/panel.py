"""Panel exports: header synonyms, checks, clean-up, stitching of several files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfspan.functions import identifiers, periods, text
from shelfspan.operators.normalize import number
from shelfspan.sources.shared import stored
from shelfspan.sources.tabular import header_form

#: Accepted headers of each field, the more specific first.
SYNONYMS = {
    "period": ["periods", "period", "time period", "week ending date", "week ending", "week end", "week", "period description", "time", "date", "month"],
    "customer": ["customer", "retailer", "banner", "account", "channel", "chain"],
    "market": ["markets", "market", "market name", "market description", "geography", "geo"],
    "upc": ["upc", "upc code", "item upc", "gtin", "barcode", "product key", "item code", "upc ean", "consumer upc"],
    "item_description": ["item description", "item desc", "product description", "product text", "item name", "product name", "item long desc", "item", "product"],
    "manufacturer": ["manufacturer", "mfr", "mfr name", "mfg", "supplier", "vendor", "parent company", "company"],
    "brand_low": ["brand low", "brandlow", "sub brand", "subbrand", "low brand", "brand lowest", "lowest brand", "brand detail", "brand level 2", "brand hierarchy low"],
    "brand": ["brand family", "brand text", "brand name", "brand"],
    "category": ["sub category", "subcategory", "category name", "category", "product category", "module", "segment", "super category"],
    "dollar_sales": ["dollar sales", "dollar volume", "value sales", "sales value", "$ sales", "sales $", "$", "dollars", "sales"],
    "unit_sales": ["unit sales", "unit volume", "units", "qty", "quantity"],
    "volume_sales": ["volume sales", "equivalized volume", "eq volume", "volume eq", "volume", "eq", "ce", "equiv units"],
}
#: Fields without which an export can't be used.
REQUIRED = ("period", "market", "category", "dollar_sales", "unit_sales")
COLUMNS = (*SYNONYMS, "period_start", "period_end", "upc_key", "upc_normalized")


@dataclass
class Validation:
    valid: bool
    matched_fields: dict[str, str]
    missing_required_fields: list[str]
    warnings: list[str] = field(default_factory=list)
    panel: DataFrame | None = None


def match_fields(headers: list[str]) -> dict[str, str]:
    """Fields to headers: for each field the first of its synonyms that is a header."""
    by_form = {header_form(h): h for h in reversed(headers)}
    return {f: by_form[s] for f, names in SYNONYMS.items() if (s := next((n for n in names if n in by_form), None)) is not None}


def missing_fields(matched: dict[str, str]) -> list[str]:
    lacking = [f for f in REQUIRED if f not in matched]
    for either in (("upc",), ("manufacturer", "brand", "brand_low"), ("item_description", "brand", "brand_low")):
        if not any(f in matched for f in either):
            lacking.append(" or ".join(either[:2]))
    return lacking


def cleaned(df: DataFrame, matched: dict[str, str], seen: tuple[Observation, Observation] | None = None) -> DataFrame:
    """Canonical columns (all of COLUMNS, null where absent), without junk rows: those without numeric dollars, market or code.

    Where the export has no such column, the description is the brand and the customer leads the market's label. `position` is the row's
    place in the file if df has source_row_id, else a hash of its content. What `seen` observes is counted while the rows are written: rows and
    junk of the file, then rows that stay and their span.
    """
    place = F.col("source_row_id") if "source_row_id" in df.columns else F.xxhash64(*(F.col(f"`{h}`") for h in matched.values()))
    cell = lambda f: text.clean_label(F.col(f"`{matched[f]}`")) if f in matched else F.lit(None).cast("string")
    # What is a number already needn't be read, and whether a cell has any text is seen without cleaning it.
    kinds = dict(df.dtypes)
    finite = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    amount = lambda f: finite(F.col(f"`{matched[f]}`").cast("double")) if f in matched and kinds.get(matched[f]) in ("int", "bigint", "double") else number(cell(f))
    some = lambda f: F.coalesce(F.col(f"`{matched[f]}`").cast("string").rlike(r"\S"), F.lit(False)) if f in matched else F.lit(False)
    good = amount("dollar_sales").isNotNull() & some("market") & some("upc")
    if seen:
        df = df.observe(seen[0], F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("junk"))
    rows = df.where(good).select(*(amount(f).alias(f) if f.endswith("_sales") else cell(f).alias(f) for f in SYNONYMS), place.alias("position"))
    absent = {"item_description": F.col("brand"), "customer": text.customer_from_market(F.col("market"))}
    rows = rows.withColumns({f: x for f, x in absent.items() if f not in matched})
    rows = periods.with_parsed(rows, F.col("period"), "parsed")
    if seen:
        rows = rows.observe(seen[1], F.count(F.lit(1)).alias("rows"), F.min("parsed.period_start").alias("start"), F.max("parsed.period_end").alias("end"))
    return rows.select(*SYNONYMS, "parsed.period_start", "parsed.period_end", identifiers.upc_key(F.col("upc")).alias("upc_key"), identifiers.normalize_upc(F.col("upc")).alias("upc_normalized"), "position")


def validate(df: DataFrame) -> Validation:
    """Checks one export's headers and cleans its rows; nothing is read unless a result is."""
    matched = match_fields(df.columns)
    lacking = missing_fields(matched)
    notes = [] if "volume_sales" in matched else ["The export has no volume sales."]
    return Validation(not lacking, matched, lacking, notes, None if lacking else cleaned(df, matched))


@dataclass
class PanelReport:
    """valid, what was found of each file (name, valid, rows, junk, period_start, period_end, missing, warnings), of all, and the stitched panel with its first rows."""

    valid: bool
    files: list[dict]
    warnings: list[str]
    row_count: int = 0
    period_start: str | None = None
    period_end: str | None = None
    missing_required_fields: list[str] = field(default_factory=list)
    matched_fields: dict[str, str] = field(default_factory=dict)
    preview: list[dict] = field(default_factory=list)
    panel: DataFrame | None = None


#: Rows of a report's preview.
PREVIEW = 8


def check_files(files: dict[str, DataFrame]) -> PanelReport:
    """Checks, cleans and stitches the files of one export. Their figures are observed while the panel is written, so each file is read once."""
    checks = {name: match_fields(df.columns) for name, df in files.items()}
    lacking = {name: missing_fields(m) for name, m in checks.items()}
    seen = {name: (Observation(), Observation()) for name in files}
    told = {name: [] if "volume_sales" in m else ["The export has no volume sales."] for name, m in checks.items()}
    missing = sorted({f for fields in lacking.values() for f in fields})
    first = next(iter(checks.values()), {})
    if missing or not files:
        rows = [{"name": n, "valid": not lacking[n], "rows": None, "junk": None, "period_start": None, "period_end": None, "missing": lacking[n], "warnings": told[n]} for n in files]
        return PanelReport(False, rows, [w for t in told.values() for w in t] + ["All files of an export must have the required fields."], missing_required_fields=missing, matched_fields=first)
    parts = {name: stored(cleaned(df, checks[name], seen[name])) for name, df in files.items()}
    rows = []
    for name, (before, after) in seen.items():
        b, a = before.get, after.get
        if b["junk"]:
            told[name].append(f"{b['junk']} rows without sales, market or code were left out.")
        rows.append({"name": name, "valid": True, "rows": a["rows"], "junk": b["junk"], "period_start": a["start"] and str(a["start"]), "period_end": a["end"] and str(a["end"]), "missing": [], "warnings": told[name]})
    whole = stored(stitch(list(parts.values()))) if len(parts) > 1 else next(iter(parts.values()))
    count = whole.count() if len(parts) > 1 else rows[0]["rows"]
    warnings = [w for t in told.values() for w in t]
    if len(parts) > 1:
        repeated = sum(r["rows"] for r in rows) - count
        if repeated:
            warnings.append(f"{repeated} rows stood in several files and were kept once.")
        if over := overlap_count(whole).first()[0]:
            warnings.append(f"{over} combinations of item, period and market have several rows with different values; they are summed.")
        warnings.append(f"{len(parts)} files were stitched to {count} rows.")
    shown = [{c: None if v is None else str(v) for c, v in r.asDict().items() if c != "position"} for r in whole.orderBy("position").limit(PREVIEW).collect()]
    starts, ends = ([r[k] for r in rows if r[k]] for k in ("period_start", "period_end"))
    return PanelReport(True, rows, warnings, count, min(starts, default=None), max(ends, default=None), [], first, shown, whole)


def stitch(panels: list[DataFrame]) -> DataFrame:
    """One panel of several files: united by name, without exact repeats, of which the first stays. A single file stays as it is."""
    if len(panels) == 1:
        return panels[0]
    placed = [p.withColumn("position", (F.lit(k).cast("decimal(38,0)") * F.lit(1 << 62) * 4 + F.col("position")).cast("decimal(38,0)")) if "position" in p.columns else p for k, p in enumerate(panels)]
    first = placed[0]
    for p in placed[1:]:
        first = first.unionByName(p, allowMissingColumns=True)
    values = [c for c in first.columns if c != "position"]
    return first.groupBy(*values).agg(F.min("position").alias("position")) if "position" in first.columns else first.dropDuplicates()


def overlap_count(panel: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each code, period, market and customer. These are written first, so that what makes the panel isn't on disk while they meet."""
    keys = ("upc_key", "period_start", "period_end", "market", "customer")
    return stored(panel.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("overlapping_rows"))


def for_coverage(panel: DataFrame, grain: str) -> DataFrame:
    """The columns that coverage takes."""
    key = periods.period_key(F.col("period_end"), "monthly" if grain == "monthly" else "weekly")
    return panel.select("customer", "market", key.alias("period_key"), "upc_key", F.col("upc_normalized").alias("upc"), F.col("item_description").alias("description"), text.norm_brand(F.col("brand_low")).alias("brand_low_norm"), text.norm_brand(F.col("brand")).alias("brand_norm"), "category", F.col("dollar_sales").alias("sales"), F.col("unit_sales").alias("units"), F.col("volume_sales").alias("volume"), "position")
