"""Workbooks written part by part, read back."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from shelfspan.sources import tabular
from shelfspan.sources.workbooks import read_workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = f'<styleSheet {MAIN}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'


def write(path, sheets, shared=(), date1904=False):
    """`sheets`: name to rows; a row is its number and XML of its cells."""
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{k}" Type="{REL}/worksheet" Target="{"/xl/" if k == 2 else ""}worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(shared) + "</sst>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {MAIN}><sheetData>" + "".join(f'<row r="{r}">{c}</row>' for r, c in rows) + "</sheetData></worksheet>")
    return str(path)


def text(x):
    return f'<c t="inlineStr"><is><t>{escape(x)}</t></is></c>'


def number(x, style=0):
    return f'<c s="{style}"><v>{x}</v></c>'


def rows(loaded):
    return [tuple(r) for r in loaded.df.orderBy("source_row_id").collect()]


def test_best_sheet_header_and_types(spark, tmp_path):
    body = [(4 + k, text("Buffalo & Co") + number(f"7180000021{k}") + number(45292 + k, 1) + f'<c t="str"><f>A1</f><v>$1,{k}00.50</v></c><c t="e"><v>#N/A</v></c>') for k in range(3)]
    sheets = {"Notes": [(1, text("read me"))], "Data": [(1, text("Report")), (3, "".join(map(text, ("Market", "UPC", "Date", "Sales", "Gone")))), *body, (9, text("  "))], "Empty": []}
    got = tabular.load(spark, write(tmp_path / "a.xlsx", sheets))
    assert (got.sheet_name, got.sheet_names, got.header_row, got.file_name) == ("Data", ["Notes", "Data", "Empty"], 2, "a.xlsx")
    assert got.df.columns == ["Market", "UPC", "Date", "Sales", "source_row_id"]
    assert rows(got) == [("Buffalo & Co", f"7180000021{k}", f"2024-01-0{k + 1}", 1000.5 + 100 * k, 3 + k) for k in range(3)]
    assert len(got.notes) == 2


def test_cells(spark, tmp_path):
    shared = ["<si><t>Brand</t></si>", "<si><r><t>Ze</t></r><r><t>ta</t></r><rPh><t>no</t></rPh></si>", "<si><t>Brand</t></si>"]
    cells = '<c r="A2" t="s"><v>1</v></c><c r="AB2"><v>7.5E1</v></c><c r="AC2" t="b"><v>1</v></c><c r="AD2" s="2"><v>0.5</v></c><c r="AE2" s="1"><v>1E300</v></c>'
    path = write(tmp_path / "b.xlsx", {"S": [(1, '<c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>2</v></c>'), (2, cells)]}, shared, date1904=True)
    got = read_workbooks(spark, path).where("row = 1").first()
    assert len(got.cells) == 31 and got.cells[0] == "Zeta" and got.cells[27:31] == ["75", "True", "1904-01-01 12:00:00", None]
    assert got.is_text[0] and not any(got.is_text[1:])
    columns = tabular.load(spark, path).df.columns
    assert columns[0] == "Brand" and len(set(columns)) == len(columns)


def test_many_rows_and_several_files(spark, tmp_path):
    for name in ("x", "y"):
        write(tmp_path / f"{name}.xlsx", {"S": [(1, text("Item") + text("Units"))] + [(k, text(f"i{k}") + number(k)) for k in range(2, 5003)]})
    assert read_workbooks(spark, str(tmp_path / "*.xlsx")).where("row > 0").groupBy("path").count().select("count").distinct().first()[0] == 5001
    got = tabular.load(spark, str(tmp_path / "x.xlsx"))
    assert got.df.agg({"Units": "sum"}).first()[0] == sum(range(2, 5003))


def test_no_data(spark, tmp_path):
    with pytest.raises(ValueError, match="has data"):
        tabular.load(spark, write(tmp_path / "c.xlsx", {"A": [], "B": [(1, text("Only") + text("Header"))]}))
