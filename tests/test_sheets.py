"""Spreadsheet runs against a plain expansion."""

import random

from wardline.plans import formats
from wardline.sources import sheets, sinks


def test_runs_expand_to_their_cells(spark, tmp_path):
    rng = random.Random(1)
    tables = {n: [[rng.choice(["", "", "x", "1,234", "7", "a & b"]) for _ in range(rng.randrange(1, 9))] for _ in range(12)] for n in ("one", "two")}
    files = spark.createDataFrame([("a.ods", formats.workbook(tables)), ("b.ods", formats.workbook({"none": [[""]]}))], "name string, content binary")
    assert sinks.write_files(files, str(tmp_path)) == ["a.ods", "b.ods"]
    found = sheets.expand(sheets.read_runs(spark, str(tmp_path))).collect()
    want = {(n, r, c, v) for n, rows in tables.items() for r, row in enumerate(rows) for c, v in enumerate(row) if v}
    assert {(f.sheet, f.row, f.col, f.value) for f in found} == want and len(found) == len(want)


def test_repeated_rows_covered_cells_and_long_tails():
    t = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        cells = '<table:table-cell/><table:covered-table-cell table:number-columns-repeated="2"/><table:table-cell><text:p>a<text:s/>b</text:p><text:p>c</text:p></table:table-cell><table:table-cell table:number-columns-repeated="9999999"/>'
        z.writestr("content.xml", f'<x {t}><table:table table:name="s"><table:table-row table:number-rows-repeated="3">{cells}</table:table-row><table:table-row><table:table-cell><text:p>z</text:p></table:table-cell></table:table-row></table:table></x>')
    assert list(sheets.runs(buffer.getvalue())) == [("s", 0, 3, 3, 1, "ab\nc"), ("s", 3, 1, 0, 1, "z")]


def test_sheets_with_another_header_are_left_out(spark):
    row = lambda sheet, r, values: [("f", sheet, r, c, v) for c, v in enumerate(values) if v]
    cells = [*row("A", 0, sheets.HEADER), *row("A", 2, ["A", "", "1"]), *row("A", 3, ["A", "2.0", "1,000", " 5 ", "", "x", "7", 'say "hi", all']), *row("B", 0, ["State"]), *row("B", 3, ["B", "1", "9"])]
    votes, seats = sheets.election(spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string"))
    assert [tuple(r)[2:] for r in votes.collect()] == [("A", 2, 1000, 5, 0, 0, 7, 'say "hi", all')] and seats.count() == 1
    lines = {r.part: r.value for r in sheets.all_lines(votes).collect()}
    assert lines[1] == 'A,2,1000,5,0,0,7,"say ""hi"", all"' and lines[4] == "smallest winner,A,2,1000" and lines[9] == "votes for others,12"
