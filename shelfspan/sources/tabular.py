"""Tabular files of unknown layout: CSV by Spark's reader, Excel where a reader is installed."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspan.sources.records import read_records
from shelfspan.sources.workbooks import read_workbooks

#: Rows that may hold the header.
HEAD_ROWS = 10
#: Headers of identifiers, which stay text; their leading zeros matter.
IDENTIFIER = re.compile(r"\b(upc|gtin|barcode|ean|plu|item|product|sku|material|article)|\b(code|id|number|num|no|key|#)\b", re.IGNORECASE)


@dataclass
class Loaded:
    df: DataFrame
    file_name: str
    sheet_name: str | None = None
    sheet_names: list[str] = field(default_factory=list)
    header_row: int = 0
    notes: list[str] = field(default_factory=list)


def header_form(name: str) -> str:
    """A header for comparison: lower-case letters, digits, $ and # with single blanks."""
    return re.sub(r"[^a-z0-9$#]+", " ", str(name).lower()).strip()


def find_header(rows: list[list]) -> int:
    """The row that most looks like a header: many cells, many of them text, all different, early."""
    best, found = -1.0, 0
    for k, row in enumerate(rows[:HEAD_ROWS]):
        cells = [c for c in row if c is not None and str(c) != ""]
        if len(cells) < 2:
            continue
        texts = sum(isinstance(c, str) and bool(c.strip()) for c in cells)
        score = len(cells) + 2 * texts + 2 * (len(set(map(str, cells))) == len(cells)) - 0.5 * k
        if score > best:
            best, found = score, k
    return found


def _numeric(c: str):
    s = F.translate(F.trim(F.col(f"`{c}`")), "$£€¥,", "")
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double")).when(s.rlike(r"^\([\d.]+\)$"), -F.translate(s, "()", "").try_cast("double"))


def restore_numbers(df: DataFrame) -> DataFrame:
    """Text columns of which 95 % of the cells are numbers become doubles; identifiers stay. One aggregation over all columns."""
    columns = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and not IDENTIFIER.search(f.name)]
    if not columns:
        return df
    counts = df.agg(*(F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.count(_numeric(c)).alias("k")).alias(str(i)) for i, c in enumerate(columns))).first()
    numeric = {c for i, c in enumerate(columns) if counts[i].k >= max(1, int(counts[i].n * 0.95))}
    return df.select(*(_numeric(c).alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns))


def cells_of(text: str) -> list[str | None]:
    """Cells of one record; empty ones are null."""
    return [c.strip() or None for c in next(csv.reader(io.StringIO(text, newline="")), [])]


def unique_names(cells: list[str | None], width: int) -> list[str]:
    """Column names from a header's cells: `Unnamed_k` where there is none, and a number after repeated ones."""
    seen: dict[str, int] = {}
    names = []
    for k in range(width):
        name = (cells[k] if k < len(cells) else None) or f"Unnamed_{k}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    return names


def read_csv(spark: SparkSession, path: str, header_row: int | None = None) -> Loaded:
    """A CSV file, or a folder of parts with one header, as text columns under its own header, wherever in the first rows it is, with numbers restored and source_row_id.

    Quoted cells may hold line breaks. The table is as wide as its widest row; shorter rows end in nulls. All-null rows
    and columns are dropped. source_row_id ascends in file order, with gaps (see `records`).
    """
    found = read_records(spark, path)
    name = PurePosixPath(path).name
    first = [cells_of(r.value) for r in found.rows.orderBy("id").limit(max(HEAD_ROWS, (header_row or 0) + 1)).collect()]
    if not any(c for cells in first for c in cells):
        return Loaded(spark.createDataFrame([], "source_row_id long"), name)
    at = header_row if header_row is not None else find_header(first)
    header_id = found.rows.select("id").orderBy("id").limit(at + 1).agg(F.max("id")).first()[0]
    header = unique_names(first[at], found.width)
    plain = [f"_c{k}" for k in range(found.width)]
    options = {"quote": '"', "escape": '"', "maxColumns": str(found.width + 1), "maxCharsPerColumn": "-1"}
    cells = found.rows.where(F.col("id") > header_id).select("id", F.from_csv("value", ", ".join(f"{c} string" for c in plain), options).alias("c")).select("id", "c.*")
    trimmed = cells.select("id", *(F.nullif(F.trim(c), F.lit("")).alias(c) for c in plain))
    body = trimmed.where(F.coalesce(*plain).isNotNull())
    return Loaded(typed(body, plain, header), name, header_row=at, notes=[f"The header is in row {at + 1}."] if at else [])


def typed(body: DataFrame, plain: list[str], header: list[str]) -> DataFrame:
    """The columns `plain` under their headers, without empty ones, columns of numbers as doubles, and `id` as source_row_id. One aggregation over all columns tells which."""
    count = lambda c, h: F.struct(F.count(c).alias("n"), (F.lit(0) if IDENTIFIER.search(h) else F.count(_numeric(c))).alias("k")).alias(c)
    counts = body.agg(*(count(c, h) for c, h in zip(plain, header, strict=True))).first()
    kept = [(c, h) for c, h in zip(plain, header, strict=True) if counts[c].n]
    return body.select(*((_numeric(c) if counts[c].k >= max(1, int(counts[c].n * 0.95)) else F.col(c)).alias(h) for c, h in kept), F.col("id").alias("source_row_id"))


def read_xlsx(spark: SparkSession, path: str) -> Loaded:
    """The sheet of a workbook that has most cells of data, times its columns (40 count at most); the first of equal ones.

    source_row_id is the row of the sheet, from 0. Raises ValueError for a workbook without data.
    """
    found = read_workbooks(spark, path)
    head: dict[int, list[list]] = {}
    names: dict[int, str] = {}
    for r in found.where(F.col("row") < HEAD_ROWS).orderBy("sheet_no", "row").collect():  # HEAD_ROWS of each sheet
        names[r.sheet_no] = r.sheet
        if r.row >= 0:
            rows = head.setdefault(r.sheet_no, [])
            rows += [[]] * (r.row - len(rows))
            rows.append([c if c is None or t else float("nan") for c, t in zip(r.cells, r.is_text, strict=True)])
    header = {k: find_header(rows) for k, rows in head.items()}
    below = F.create_map(*(F.lit(x) for pair in header.items() for x in pair))[F.col("sheet_no")] if header else F.lit(0)
    filled = found.where(F.col("row") > F.coalesce(below, F.lit(-1))).select("sheet_no", F.posexplode("cells").alias("k", "x")).where("trim(x) != ''")
    sizes = {r.sheet_no: r for r in filled.groupBy("sheet_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("wide"), (F.max("k") + 1).alias("width")).collect()}
    if not sizes:
        raise ValueError(f"no sheet of {PurePosixPath(path).name} has data")
    best = max(sorted(sizes), key=lambda k: sizes[k].n * min(sizes[k].wide, 40))
    at = header.get(best, 0)
    sheet = found.where((F.col("sheet_no") == best) & (F.col("row") >= at))
    titles = sheet.where(F.col("row") == at).select("cells").first()
    plain = [f"_c{k}" for k in range(sizes[best].width)]
    cells = [(c or "").strip() or None for c in (titles.cells if titles else [])]
    body = sheet.where(F.col("row") > at).select(F.col("row").alias("id"), *(F.nullif(F.trim(F.get("cells", F.lit(k))), F.lit("")).alias(c) for k, c in enumerate(plain))).where(F.coalesce(*plain).isNotNull())
    sheets = [names[k] for k in sorted(names)]
    notes = [f"{len(sheets)} sheets; {names[best]} was read."] if len(sheets) > 1 else []
    width = max(len(plain), len(cells))
    return Loaded(typed(body, plain, unique_names(cells + [None] * (width - len(cells)), width)[: len(plain)]), PurePosixPath(path).name, names[best], sheets, at, notes + [f"The header is in row {at + 1}."] * bool(at))


def read_xls(spark: SparkSession, path: str) -> Loaded:
    """The fullest sheet of a workbook in the older binary format (.xls). It is read on the driver, and has 65,536 rows at most; needs xlrd."""
    import pandas as pd

    try:
        sheets = pd.read_excel(path, sheet_name=None, header=None, dtype=object)
    except ImportError as e:
        raise RuntimeError("reading .xls needs xlrd") from e
    name = max(sheets, key=lambda s: int(sheets[s].notna().sum().sum()) * min(sheets[s].shape[1], 40))
    raw = sheets[name]
    rows = [[None if pd.isna(v) else v for v in r] for r in raw.itertuples(index=False)]
    at = find_header(rows)
    header = [str(v).strip() if v is not None else f"Unnamed_{k}" for k, v in enumerate(rows[at])]
    body = [[None if v is None else str(v) for v in r] + [k] for k, r in enumerate(rows[at + 1 :]) if any(v is not None for v in r)]
    df = spark.createDataFrame(body, ", ".join(f"`{h}` string" for h in header) + ", source_row_id long")
    notes = [f"{len(sheets)} sheets; {name} was read."] if len(sheets) > 1 else []
    return Loaded(restore_numbers(df), PurePosixPath(path).name, name, list(sheets), at, notes + [f"The header is in row {at + 1}."] * bool(at))


def load(spark: SparkSession, path: str) -> Loaded:
    """A client or panel file by its extension: .csv, .xlsx, .xls, or .parquet (columns as they are, with source_row_id)."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".csv":
        return read_csv(spark, path)
    if kind == ".xlsx":
        return read_xlsx(spark, path)
    if kind == ".xls":
        return read_xls(spark, path)
    if kind == ".parquet":
        return Loaded(spark.read.parquet(path).withColumn("source_row_id", F.monotonically_increasing_id()), PurePosixPath(path).name)
    raise ValueError(f"unsupported file type: {kind or 'none'}")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, written by all tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, rows: int, columns: list[str] | None = None) -> DataFrame:
    """The first rows as text."""
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns or df.columns)).limit(rows)


def crosswalk_file(df: DataFrame) -> DataFrame | None:
    """(client_key, panel_key, position) of a user's crosswalk file; None if a side's header isn't there."""
    from shelfspan.functions.identifiers import upc_key

    #: Headers of either side; the fields' names in crosswalk files.
    left = ("client upc", "client sku", "client", "sku", "internal upc", "internal sku", "client item")
    right = ("discover upc", "niq upc", "upc", "gtin", "discover", "niq", "panel upc")
    by_form = {header_form(c): c for c in df.columns}
    a, b = (next((c for f, c in by_form.items() if f in names), None) for names in (left, right))
    if a is None or b is None:
        return None
    at = F.col("source_row_id") if "source_row_id" in df.columns else F.monotonically_increasing_id()
    key = lambda c: F.coalesce(upc_key(F.col(f"`{c}`")), F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")))
    return df.select(key(a).alias("client_key"), key(b).alias("panel_key"), at.alias("position"))


def consecutive_dates(df: DataFrame, column: str) -> DataFrame:
    """(days,): spacing of distinct dates; dates are few, so one window holds them."""
    d = df.select(F.col(column).alias("d")).where("d is not null").distinct()
    return d.select(F.date_diff("d", F.lag("d").over(Window.orderBy("d"))).alias("days")).where("days is not null")
