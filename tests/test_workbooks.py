"""Workbooks: round trips, odd cells, and writes that fail."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from scholia.operators import lookups
from scholia.sources import workbooks as W


def test_round_trip_over_several_sheets(spark, tmp_path):
    rows = spark.range(200_000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 7).cast("string").alias("amount"))
    sheets = lookups.exported(rows, "id", 65_536, "name", ["amount"], "at")
    W.write_workbooks(sheets, str(tmp_path / "out"), "sheet", ["at"], 2)
    assert sorted(os.listdir(tmp_path / "out")) == ["book-00000.xlsx", "book-00001.xlsx"]
    read = W.read_workbooks(spark, str(tmp_path / "out"), ["amount", "name", "none"]).cache()
    counts = {r.sheet_: (r.n, r.first, r.last) for r in read.groupBy("sheet_").agg(F.count("*").alias("n"), F.min_by("name", "row_").alias("first"), F.max_by("name", "row_").alias("last")).collect()}
    assert counts == {"Sheet0": (65_536, "n0", "n65535"), "Sheet1": (65_536, "n65536", "n131071"), "Sheet2": (65_536, "n131072", "n196607"), "Sheet3": (3393, "n196608", "total")}
    fields = {"label": ("name", "string", None), "amount": ("amount", "double", None)}
    typed = lookups.imported(read, fields)
    assert typed.where("label <> 'total'").agg(F.sum("amount")).first()[0] == typed.where("label = 'total'").first().amount == sum(i % 7 for i in range(200_000))
    assert read.where("none is not null").count() == 0


def test_odd_cells(spark, tmp_path):
    rows = [(0, 1, "a\x0b<&>\r\n_x0041_ ", 1.5, True), (0, 2, None, None, None), (0, 0, "", -0.0, False), (3, 9, "眼 \U0001f600", float("nan"), None)]
    df = spark.createDataFrame(rows, "s int, o int, text string, `a b` double, yes boolean")
    W.write_workbooks(df, str(tmp_path / "out"), "s", ["o"])
    found = sorted((r.sheet_, r.row_, r.text, r["a b"], r.yes) for r in W.read_workbooks(spark, str(tmp_path / "out"), ["text", "a b", "yes"]).collect())
    assert found == [("Sheet0", 1, "", "-0.0", "false"), ("Sheet0", 2, "a\x0b<&>\r\n_x0041_ ", "1.5", "true"), ("Sheet3", 1, "眼 \U0001f600", "nan", None)]
    W.write_workbooks(df.limit(0), str(tmp_path / "out"), "s", ["o"])
    assert W.read_workbooks(spark, str(tmp_path / "out"), []).count() == 0


def test_books_of_other_writers():
    """Shared strings with runs, references that skip cells, a sheet whose rows are numbered."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{W.MAIN}" xmlns:r="{W.LINKS}"><sheets><sheet name="one" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="x" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{W.MAIN}"><si><t>ab</t></si><si><r><t>c</t></r><rPh><t>no</t></rPh><r><t> d</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{W.MAIN}"><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c><c r="AA3" t="s"><v>1</v></c></row><row><c><f>1+1</f><v>2</v></c><c t="str"><v>x</v></c><c t="e"/></row></sheetData></worksheet>')
    rows = list(W.sheet_rows(out.getvalue()))
    assert rows[0] == ("one", 2, [None, "ab", *[None] * 24, "c d"]) and rows[1] == ("one", 3, ["2", "x", None])


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    good = spark.createDataFrame([(0, 0, "old")], "s int, o int, v string")
    W.write_workbooks(good, str(tmp_path / "out"), "s", ["o"])
    bad = spark.createDataFrame([(i, 0, str(i)) for i in range(40)], "s int, o int, v string").withColumn("v", F.when(F.col("s") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception):
        W.write_workbooks(bad, str(tmp_path / "out"), "s", ["o"], 4)
    assert os.listdir(tmp_path / "out") == ["book-00000.xlsx"]
    assert [r.v for r in W.read_workbooks(spark, str(tmp_path / "out"), ["v"]).collect()] == ["old"]
