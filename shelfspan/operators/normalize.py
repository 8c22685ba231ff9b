"""Client files to the fixed model: one row for each source row and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.functions import identifiers, periods, text
from shelfspan.functions.let import let

#: Columns of the fixed model and their types, in order.
MODEL = (
    ("source_row_id", "long"), *((c, "string") for c in "source_file_name source_sheet_name customer_raw customer_standardized client_market_raw client_market_standardized market_level period_raw period_start period_end period_key time_grain product_key_raw upc_raw upc_normalized upc_key item_id_raw item_description_raw brand_raw brand_standardized manufacturer_raw manufacturer_standardized category_raw category_standardized metric_type_raw metric_name_raw".split()),
    *((c, "double") for c in ("metric_value", "sales_value", "unit_value", "volume_value")), ("comparison_mode", "string"), ("mapping_confidence", "double"), ("record_status", "string"), ("exception_reason", "string"),
)


def number(x: Column) -> Column:
    """A number, also with currency signs, thousands separators or in parentheses (negative); null for anything else."""
    return let(F.translate(F.trim(x.cast("string")), "$£€¥,", ""), _number)


def _number(s: Column) -> Column:
    plain = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))
    return plain.when(s.rlike(r"^\([\d.]+\)$"), -F.translate(s, "()", "").try_cast("double"))


def row_period(concepts: dict[str, str]) -> Column:
    """The first that can be read of week end, period, month, fiscal year with month, fiscal month."""
    got = [periods.parse_period(F.col(f"`{concepts[c]}`")) for c in ("week_end_date", "period", "month") if c in concepts]
    if "fiscal_year" in concepts and "fiscal_month" in concepts:
        got.append(periods.fiscal_pair(F.col(f"`{concepts['fiscal_year']}`"), F.col(f"`{concepts['fiscal_month']}`")))
    if "fiscal_month" in concepts:
        got.append(periods.parse_period(F.col(f"`{concepts['fiscal_month']}`")))
    return F.coalesce(*got) if got else F.lit(None).cast("struct<period_start:date,period_end:date,grain:string>")


def unpivot(df: DataFrame, wide: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """A row for each source row and period of a wide file: wide lists (column, start, end, grain, kind), one column for each period and kind.

    The other columns stay; added are _parsed, _label, _sales, _units, _volume and _metric_names. One array of
    periods is exploded, so there is no union and no shuffle.
    """
    by_period: dict[tuple[str, str, str], dict[str, str]] = {}
    for column, start, end, grain, kind in wide:
        by_period.setdefault((start, end, grain), {}).setdefault(kind, column)
    value = lambda kinds, k: number(F.col(f"`{kinds[k]}`")) if k in kinds else F.lit(None).cast("double")
    entries = []
    for (start, end, grain), kinds in sorted(by_period.items()):
        parsed = F.struct(F.lit(start).cast("date").alias("period_start"), F.lit(end).cast("date").alias("period_end"), F.lit(grain).alias("grain"))
        entries.append(F.struct(parsed.alias("_parsed"), F.lit(start).alias("_label"), *(value(kinds, k).alias(n) for k, n in (("sales", "_sales"), ("unit", "_units"), ("volume", "_volume"))), F.lit("; ".join(kinds[k] for k in ("sales", "unit", "volume") if k in kinds)).alias("_metric_names")))
    columns = {w[0] for w in wide}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), F.explode(F.array(*entries)).alias("e")).select("*", "e.*").drop("e")


def _trust(base: Column, flaws: Sequence[tuple[Column, float]]) -> Column:
    """The confidence less what each flaw costs, 0.05 at least, to two places: constants among which a row's flaws choose."""
    if not flaws:
        return F.round(F.greatest(F.lit(0.05), base), 2)
    (flaw, cost), *rest = flaws
    return F.when(flaw, _trust(base - F.lit(cost), rest)).otherwise(_trust(base - F.lit(0.0), rest))


def normalize(df: DataFrame, concepts: dict[str, str], metrics: dict[str, str], grain: str, mode: str, confidence: float, wide: Sequence[tuple[str, str, str, str, str]] = (), file_name: str | None = None, sheet_name: str | None = None) -> DataFrame:
    """The fixed model (see MODEL) of a client file.

    `concepts` maps concepts to columns, `metrics` maps sales, unit and volume to columns; df has source_row_id.
    Blank cells are null. Column functions only, period labels apart, which Arrow batches parse.
    """
    cell = lambda c: text.clean_label(F.col(f"`{concepts[c]}`")) if c in concepts else F.lit(None).cast("string")
    if wide:
        rows = unpivot(df, wide)
        raw = F.col("_label")
    else:
        have = [c for c in ("sales", "unit", "volume") if c in metrics]
        pick = lambda k: number(F.col(f"`{metrics[k]}`")) if k in metrics else F.lit(None).cast("double")
        rows = df.withColumn("_parsed", row_period(concepts)).select("*", pick("sales").alias("_sales"), pick("unit").alias("_units"), pick("volume").alias("_volume"), F.lit("; ".join(metrics[k] for k in have)).alias("_metric_names"))
        raws = [text.clean_label(F.col(f"`{concepts[c]}`")) for c in ("week_end_date", "period", "month", "fiscal_month") if c in concepts]
        raw = F.coalesce(*raws) if raws else F.lit(None).cast("string")
    # Cells are cleaned once, in a step of their own.
    dims = ("customer", "client_market", "upc", "item_id", "item_description", "brand", "manufacturer", "category")
    rows = rows.select("source_row_id", "_parsed", "_sales", "_units", "_volume", "_metric_names", raw.alias("_raw"), *(cell(c).alias(f"_{c}") for c in dims))
    rows = rows.withColumns({"_upc_key": identifiers.upc_key(F.col("_upc")), "_start": F.col("_parsed.period_start"), "_end": F.col("_parsed.period_end")})
    cell, raw = lambda c: F.col(f"_{c}"), F.col("_raw")
    start, end = F.col("_start"), F.col("_end")
    start = periods.week_start(start, end) if grain == "weekly" else start
    market, upc = cell("client_market"), cell("upc")
    no_metric = F.coalesce("_sales", "_units", "_volume").isNull()
    no_period = F.col("_parsed").isNull()
    unkeyed = upc.isNotNull() & F.col("_upc_key").isNull()
    trust = _trust(F.lit(confidence), ((no_period, 0.3), (no_metric, 0.2), (unkeyed, 0.1)))
    reason = F.concat_ws("; ", F.when(no_period, "period_unparsed"), F.when(no_metric, "no_metric_values"))
    values = {
        "source_row_id": F.col("source_row_id"),
        "source_file_name": F.lit(file_name),
        "source_sheet_name": F.lit(sheet_name),
        "customer_raw": cell("customer"),
        "customer_standardized": text.titled(cell("customer")),
        "client_market_raw": market,
        "client_market_standardized": text.titled(market),
        "market_level": F.when(text.is_total_like(market), "total").when(market.isNotNull(), "detail"),
        "period_raw": raw,
        "period_start": F.date_format(start, "yyyy-MM-dd"),
        "period_end": F.date_format(end, "yyyy-MM-dd"),
        "period_key": periods.period_key(end, grain),
        "time_grain": F.lit(grain),
        "product_key_raw": F.coalesce(upc, cell("item_id")),
        "upc_raw": upc,
        "upc_normalized": identifiers.normalize_upc(upc),
        "upc_key": F.col("_upc_key"),
        "item_id_raw": cell("item_id"),
        "item_description_raw": cell("item_description"),
        "brand_raw": cell("brand"),
        "brand_standardized": text.titled(cell("brand")),
        "manufacturer_raw": cell("manufacturer"),
        "manufacturer_standardized": text.titled(cell("manufacturer")),
        "category_raw": cell("category"),
        "category_standardized": text.titled(cell("category")),
        "metric_type_raw": F.when(F.col("_sales").isNotNull(), "sales").when(F.col("_units").isNotNull(), "unit").when(F.col("_volume").isNotNull(), "volume"),
        "metric_name_raw": F.col("_metric_names"),
        "metric_value": F.coalesce("_sales", "_units", "_volume"),
        "sales_value": F.col("_sales"),
        "unit_value": F.col("_units"),
        "volume_value": F.col("_volume"),
        "comparison_mode": F.lit(mode),
        "mapping_confidence": trust,
        "record_status": F.when(no_period | no_metric, "needs_review").otherwise("normalized"),
        "exception_reason": F.nullif(reason, F.lit("")),
    }
    return rows.select(*(values[c].cast(t).alias(c) for c, t in MODEL))


def for_coverage(model: DataFrame) -> DataFrame:
    """The columns that coverage takes, from the fixed model."""
    return model.select("source_row_id", F.col("customer_standardized").alias("customer"), F.col("client_market_standardized").alias("market"), "market_level", "period_key", "upc_key", F.col("upc_normalized").alias("upc"), F.col("item_description_raw").alias("description"), F.col("brand_standardized").alias("brand"), text.norm_brand(F.col("brand_standardized")).alias("brand_norm"), F.col("category_standardized").alias("category"), F.col("sales_value").alias("sales"), F.col("unit_value").alias("units"), F.col("volume_value").alias("volume"), F.col("mapping_confidence").alias("confidence"), "record_status", "exception_reason")


def _figures() -> list[Column]:
    rate = lambda c: F.round(F.avg(c.cast("int")), 3)
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(rate(F.col("period_key").isNotNull()), F.lit(0.0)).alias("period_parse_rate"),
        F.round(F.avg(F.when(F.col("upc_raw").isNotNull(), F.col("upc_key").isNotNull().cast("int"))), 3).alias("upc_valid_rate"),
        F.coalesce(rate(F.col("sales_value").isNotNull()), F.lit(0.0)).alias("sales_present_rate"),
        F.count_if(F.col("record_status") == "needs_review").alias("rows_needing_review"),
        F.count_distinct("period_key").alias("distinct_periods"),
        F.count_distinct("client_market_standardized").alias("distinct_markets"),
        F.when(F.count_distinct("upc_key") > 0, F.count_distinct("upc_key")).otherwise(F.count_distinct("item_id_raw")).alias("distinct_products"),
    ]


def quality(model: DataFrame) -> DataFrame:
    """One row: how much of a client file could be read."""
    return model.agg(*_figures())


def warned(model: DataFrame) -> DataFrame:
    """The row of `quality` with the file's span and `warnings` of what a reader should know, in the same pass over the file."""
    lost = lambda c, of: F.count_if(of & F.col(c).isNull())
    has = lambda level: F.count_if(F.col("market_level") == level) > 0
    row = model.agg(
        *_figures(),
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
        (has("total") & has("detail")).alias("both_levels"),
        lost("upc_key", F.col("upc_raw").isNotNull()).alias("no_code"),
        lost("period_key", F.lit(True)).alias("no_period"),
    )
    told = (
        F.when(F.col("both_levels"), "The file has total and detail markets; figures use the total, so nothing counts twice."),
        F.when(F.col("no_code") > 0, F.concat(F.col("no_code").cast("string"), F.lit(" rows have identifiers that aren't product codes."))),
        F.when(F.col("no_period") > 0, F.concat(F.col("no_period").cast("string"), F.lit(" rows have periods that can't be read."))),
    )
    return row.withColumn("warnings", F.array_compact(F.array(*told))).drop("both_levels", "no_code", "no_period")
