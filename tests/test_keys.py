"""Products that many rows share: forms that the crosswalk compares, and means of groups."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspan.functions import fuzzy
from shelfspan.operators import align, coverage


def test_crosswalk_compares_forms_not_codes(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.DoubleType())
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series([fuzzy.token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    monkeypatch.setattr(align.fuzzy, "token_set", counted)
    rows = lambda p, n: spark.createDataFrame([(f"{p}{k}", f"{('lime cola', 'orange soda')[k % 2]} 12OZCAN", "pepsi", k) for k in range(n)], "upc_key string, description string, brand string, position long")
    got = {r.client_key: r.panel_key for r in align.build_crosswalk(rows("c", 40), rows("d", 50)).collect()}
    assert got == {f"c{k}": f"d{k % 2}" for k in range(40)}
    assert 4 <= scored.value <= 8


def test_sizes_that_fit_and_brands_within(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "upc_key string, description string, brand string, position long")
    client = frame(("1", "lime cola 12OZCAN", "pepsi", 0), ("2", "lime cola 16OZCAN", "pepsi", 1), ("3", "lime cola", "pep", 2), ("4", "lime cola", None, 3))
    there = frame(("7", "lime cola", "pepsi", 0), ("8", "lime colas 12 OZ CAN", "pepsi", 1), ("9", None, "pepsi", 2))
    assert {(r.client_key, r.panel_key) for r in align.build_crosswalk(client, there).collect()} == {("1", "8"), ("2", "7"), ("3", "7")}


def test_mean_confidence_is_exact(spark):
    sure = [0.75] * 3 + [0.95] * 5
    for k in range(8):
        rows = [(i, "p", "2000-01", "m", True, 1.0, c) for i, c in enumerate(sure[k:] + sure[:k])]
        df = spark.createDataFrame(rows, "source_row_id long, pkey string, period_key string, panel_market string, market_ok boolean, sales double, confidence double")
        df = df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in {"units": "double", "volume": "double", "description": "string", "upc": "string", "brand": "string", "category": "string", "pmatch": "string"}.items()), *(F.lit(True).alias(c) for c in ("kpi_slice", "market_caveat", "anywhere", "known", "known_period")))
        assert coverage.client_groups(df.coalesce(1)).first()["confidence"] == 0.875


def test_growing_tables_are_not_sent_to_all_tasks(spark):
    rows = spark.createDataFrame([("1", "a", "b", 0)], "upc_key string, description string, brand_norm string, source_row_id long")
    products = rows.select("*", F.lit("1").alias("pkey"), F.lit("upc").alias("pmatch"), F.lit("b").alias("brand"), F.array(F.lit("2000-01")).alias("periods"))
    plans = [coverage._keyed_rows(rows.withColumn("period_key", F.lit("2000-01")), products), coverage._met(rows, "upc_key", "source_row_id", rows.select("upc_key", F.lit(True).alias("known")))]
    assert all(df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1 for df in plans)
    assert plans[0].first()["known_period"] and plans[1].first()["known"]
