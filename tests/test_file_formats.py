"""Workbooks read cell by cell, and NetCDF files read back by a parser of the test's own."""

import datetime
import glob
import io
import os
import struct
import zipfile
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywing.plans.source_plans import workbook_of
from tallywing.sources import netcdf, workbooks

T = datetime.datetime
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(sheets: dict[str, str], strings=(), formats=(), styles=(), late=False) -> bytes:
    """A workbook of sheets whose rows are given as XML."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        entries = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(late)}"/><sheets>{entries}</sheets></workbook>')
        # listed in another order than the sheets, and by absolute paths
        links = "".join(f'<Relationship Id="r{i}" Type="t" Target="/xl/worksheets/s{i}.xml"/>' for i in reversed(range(len(sheets))))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")
        numbers = "".join(f'<numFmt numFmtId="{i}" formatCode={quoteattr(c)}/>' for i, c in formats)
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts>{numbers}</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs>{"".join(f"<xf numFmtId=\"{s}\"/>" for s in styles)}</cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


STRINGS = ["<t>species</t>", "<t>when</t>", "<t>n</t>", "<r><t>Red </t></r><r><rPr/><t>Kite</t></r><rPh><t>x</t></rPh>", '<t xml:space="preserve"> Hen &amp; Harrier </t>', "<t>note</t>", "<t>only here</t>"]
HEADER = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'


def three_sheets() -> bytes:
    first = HEADER + '<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2" s="1"><v>44392.3958333333</v></c><c r="C2"><v>12</v></c></row><row r="3"/><row r="9"><c r="C9"><v>0.5</v></c><c r="A9" t="s"><v>4</v></c></row>'
    # another order of columns, one more of them, a gap, a formula's text, an error, a truth, cells without a place
    second = '<row><c t="s"><v>2</v></c><c t="inlineStr"><is><t>species</t></is></c><c/><c t="s"><v>5</v></c><c t="s"><v>1</v></c></row><row><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>Osprey</v></c><c><v>99</v></c><c t="b"><v>1</v></c><c s="2"><v>60</v></c></row>'
    return book({"old": first, "new & more": second, "empty": "", "head alone": HEADER}, STRINGS, [(164, "yyyy\\-mm"), (165, '[Red]0.0" days"'), (166, "[h]:mm")], (0, 164, 14, 165, 166))


def given(spark, *books):
    return spark.createDataFrame([(f"/x/b{i}.xlsx", b) for i, b in enumerate(books)], "path string, content binary")


def test_sheets_of_odd_cells(spark):
    got = workbooks.parse(given(spark, three_sheets()), source=True)
    assert dict(got.dtypes) == {"path": "string", "sheet": "string", "species": "string", "when": "timestamp", "n": "double", "note": "boolean"}
    rows = {r.species: r for r in got.collect()}
    assert len(rows) == 3 and rows["Red Kite"].when == T(2021, 7, 15, 9, 30) and rows["Red Kite"].n == 12 and rows["Red Kite"].note is None
    assert rows[" Hen & Harrier "].n == 0.5 and rows[" Hen & Harrier "].when is None
    assert rows["Osprey"].note is True and rows["Osprey"].n is None and rows["Osprey"].when == T(1900, 2, 28) and rows["Osprey"].sheet == "new & more"


def test_named_sheets_and_schema(spark):
    got = workbooks.parse(given(spark, three_sheets()), "old", "n long, species string, lacking date").collect()
    assert [(r.n, r.species, r.lacking) for r in got] == [(12, "Red Kite", None), (None, " Hen & Harrier ", None)]  # 0.5 is no whole number
    with pytest.raises(Exception, match="has no sheets"):
        workbooks.parse(given(spark, three_sheets()), "other", "n long").collect()
    assert workbooks.parse(given(spark, three_sheets()), ["empty", "head alone"]).count() == 0


def test_days_and_times():
    assert workbooks._moment(0.5, False) == ("time", "12:00:00") and workbooks._moment(1, False) == ("date", "1900-01-01 00:00:00")
    assert workbooks._moment(61, False)[1] == "1900-03-01 00:00:00" and workbooks._moment(44392.25, True)[1] == "2025-07-16 06:00:00"
    assert [workbooks._is_date(c) for c in ("0.00", "General", "dd/mm/yy", '"day" 0', "[Red]0", "[h]:mm", "\\d0", "mm:ss.0", "#,##0_);(#,##0)")] == [False, False, True, False, False, True, False, True, False]
    for hours in range(24):
        for minutes in range(60):
            assert workbooks._moment(44392 + (hours + minutes / 60) / 24, False)[1] == str(T(2021, 7, 15, hours, minutes))


def test_repeated_names_and_types_that_differ(spark):
    rows = '<row><c t="inlineStr"><is><t>a</t></is></c><c t="inlineStr"><is><t>a</t></is></c></row>'
    one, two = book({"s": rows + "<row><c><v>1</v></c><c><v>2</v></c></row>"}), book({"s": rows + '<row><c t="inlineStr"><is><t>x</t></is></c><c><v>2.5</v></c></row>'})
    got = workbooks.parse(given(spark, one, two))
    assert dict(got.dtypes) == {"a": "string", "a.1": "double"} and sorted(tuple(r) for r in got.collect()) == [("1", 2.0), ("x", 2.5)]


def test_yearly_pairs_from_files(spark, tmp_path):
    """Four years of birds with the surveys of the same year; ids come again in every year."""
    for year in range(2022, 2026):
        day = pd.Timestamp(year, 8, 1)
        body = pd.DataFrame({"countid": [1.0, 1.0, 2.0, 9.0], "speciesid": [5.0, 6.0, 5.0, 5.0], "timestamp": [570.0, None, 615.0, 0.0], "direction1": [1.0, 2.0, 3.0, 4.0], "date": [day] * 4})
        header = pd.DataFrame({"id": [1.0, 2.0, 3.0], "date": [day] * 3, "start": ["09:00"] * 3, "stop": ["12:00"] * 3, "year_": [float(year)] * 3})
        (tmp_path / f"data_2422_{year}.xlsx").write_bytes(workbook_of(body, "a", ("date",), ("timestamp",)))
        (tmp_path / f"headerdata_2422_{year}.xlsx").write_bytes(workbook_of(header, "a", ("date",)))
    got = workbooks.yearly(workbooks.files(spark, f"{tmp_path}/data_2422_*.xlsx"), workbooks.files(spark, f"{tmp_path}/headerdata_2422_*.xlsx"))
    rows = got.collect()
    assert len(rows) == 12 and {"date_x", "date_y", "countid", "id", "timestamp"} <= set(got.columns)
    assert all(r.year == r.year_ and r.countid == r.id and r.date_x == r.date_y == T(r.year, 8, 1) for r in rows)
    assert sorted((r.year, r.direction1) for r in rows) == [(y, n) for y in range(2022, 2026) for n in (1, 2, 3)]
    assert {r.timestamp for r in rows} == {"09:30:00", None, "10:15:00"}


def test_each_sheet_is_a_task(spark):
    assert workbooks._sheets(given(spark, three_sheets(), three_sheets()), None).select(F.spark_partition_id()).count() == 8


def unpacked(raw: bytes):
    """Dimensions, attributes and variables (attributes, array) of a classic NetCDF file, as its definition says."""
    at = 0

    def take(fmt):
        nonlocal at
        v = struct.unpack_from(">" + fmt, raw, at)
        at += struct.calcsize(">" + fmt)
        return v if len(v) > 1 else v[0]

    def text(n):
        nonlocal at
        v = raw[at : at + n]
        at += n + (-n) % 4
        return v

    def listed(tag, one):
        found, n = take("ii")
        assert (found, n) == (0, 0) or found == tag
        return [one() for _ in range(n)]

    def attribute():
        name, kind, n = text(take("i")).decode(), take("i"), take("i")
        return (name, text(n).decode()) if kind == 2 else (name, np.frombuffer(text(8 * n), ">f8").tolist())

    assert raw[:4] == b"CDF\x02"
    at = 4
    assert take("i") == 0
    dims = listed(10, lambda: (text(take("i")).decode(), take("i")))
    about = dict(listed(12, attribute))

    def variable():
        name, n = text(take("i")).decode(), take("i")
        ids = [take("i") for _ in range(n)]
        more, kind, size, begin = dict(listed(12, attribute)), take("i"), take("i"), take("q")
        shape, layout = [dims[i][1] for i in ids], {2: "S1", 4: ">i4", 5: ">f4", 6: ">f8"}[kind]
        count = int(np.prod(shape))
        assert begin % 4 == 0 and size == (count * np.dtype(layout).itemsize + 3) // 4 * 4
        return name, ([dims[i][0] for i in ids], more, np.frombuffer(raw, layout, count, begin).reshape(shape))

    return dict(dims), about, dict(listed(11, variable))


def predictions(spark, species=("Red Kite", "Osprey"), days=3):
    rows = [(s, datetime.date(2026, 7, 14), datetime.date(2026, 7, 15) + datetime.timedelta(d), f"{h:02d}:00", float(len(s) * 100 + d * 24 + h), None if h == 5 else float(h)) for s in species for d in range(days) for h in range(24)]
    df = spark.createDataFrame(rows, "species string, run_date date, date date, time string, pred_log_hourly_count double, temperature_2m double")
    return df.repartition(7)


def test_predictions_read_back(spark, tmp_path):
    to = str(tmp_path / "out")
    netcdf.write(predictions(spark).where("NOT (species = 'Osprey' AND date = '2026-07-16' AND time = '03:00')"), to)
    assert sorted(os.listdir(to)) == ["20260714_Osprey.nc", "20260714_Red_Kite.nc"]
    dims, about, found = unpacked((tmp_path / "out" / "20260714_Osprey.nc").read_bytes())
    assert dims == {"date": 3, "time": 24, "time_length": 5} and about == {"run_date": "2026-07-14", "species": "Osprey"}
    assert found["date"][1]["units"] == "days since 1970-01-01" and found["date"][2].tolist() == [20649.0, 20650.0, 20651.0]
    assert b"".join(found["time"][2][7]) == b"07:00"
    of, more, values = found["pred_log_hourly_count"]
    assert of == ["date", "time"] and np.isnan(more["_FillValue"][0]) and values[2, 7] == 600 + 48 + 7 and np.isnan(values[1, 3]) and np.isnan(values).sum() == 1
    assert np.isnan(found["temperature_2m"][2][:, 5]).all() and found["temperature_2m"][2][0, 6] == 6


def test_times_and_numbers_as_dimensions(spark, tmp_path):
    df = spark.createDataFrame([("a", T(2026, 1, 1, 6), 2.0, 1.0), ("a", T(2026, 1, 1), 4.0, 3.0)], "station string, at timestamp_ntz, level double, v double")
    netcdf.write(df, str(tmp_path), ["station"], ["at", "level"])
    dims, _, found = unpacked((tmp_path / "a.nc").read_bytes())
    assert dims == {"at": 2, "level": 2} and found["at"][2].tolist() == [1767225600.0, 1767247200.0]
    assert np.array_equal(found["v"][2], [[np.nan, 3], [1, np.nan]], equal_nan=True)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    to = str(tmp_path / "out")
    netcdf.write(predictions(spark, ["Merlin"]), to)
    before = (tmp_path / "out" / "20260714_Merlin.nc").read_bytes()
    twice = predictions(spark, ["Merlin", "Osprey", "Hobby"], 2).unionByName(predictions(spark, ["Hobby"], 1))
    with pytest.raises(Exception, match="two rows have"):
        netcdf.write(twice, to)
    assert os.listdir(to) == ["20260714_Merlin.nc"] and (tmp_path / "out" / "20260714_Merlin.nc").read_bytes() == before
    with pytest.raises(Exception, match="are there already"):
        netcdf.write(predictions(spark, ["Merlin", "Osprey"]), to, overwrite=False)
    assert glob.glob(f"{to}/*") == [f"{to}/20260714_Merlin.nc"]
    netcdf.write(predictions(spark, ["Merlin"], 1), to)
    assert unpacked((tmp_path / "out" / "20260714_Merlin.nc").read_bytes())[0]["date"] == 1


def test_no_rows_no_files(spark, tmp_path):
    netcdf.write(predictions(spark).where("false"), str(tmp_path))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="time"):
        netcdf.write(predictions(spark).drop("time").withColumn("x", F.lit(1.0)), str(tmp_path))
