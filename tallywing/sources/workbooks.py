"""Workbooks (.xlsx) as DataFrames: each sheet of each file is parsed by a task of its own, cell by cell.

Files come through Spark's own reader of whole files, so that any store it knows will do. A sheet is
streamed: what a task holds is the file's bytes, its list of shared strings and a batch of rows.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import suffixed_join

# Fixed values of the format: namespaces, and the numbers of its built-in formats for dates and times.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
ROWS_A_BATCH = 4096
#: Kinds of cells from the narrowest on, and the type of a column that holds several.
KINDS = {"bool": "boolean", "whole": "bigint", "number": "double", "time": "string", "date": "timestamp", "text": "string"}


def _parts(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """Name and path of each sheet, in order, and whether its days count from 1904."""
    targets, found, late = {}, [], False
    for _, e in iterparse(book.open("xl/_rels/workbook.xml.rels")):
        if e.tag.endswith("}Relationship"):
            to = e.get("Target", "")
            targets[e.get("Id")] = to[1:] if to.startswith("/") else f"xl/{to}"
    for _, e in iterparse(book.open("xl/workbook.xml")):
        if e.tag.endswith("}sheet"):
            found.append((e.get("name"), targets[e.get(RELATION)]))
        elif e.tag.endswith("}workbookPr"):
            late = e.get("date1904") in ("1", "true")
    return found, late


def _strings(book: zipfile.ZipFile) -> list[str]:
    found: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, e in iterparse(book.open("xl/sharedStrings.xml")):
            if e.tag == f"{MAIN}si":
                found.append(_text(e))
                e.clear()
    return found


def _text(e) -> str:
    """The text of a string or of its runs, phonetic hints left out."""
    return "".join(t.text or "" for part in e if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t")))


def _is_date(code: str) -> bool:
    """Whether a format shows a day or a time: one of its letters stands outside quotes, brackets and escapes."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.|_.|\*.', "", code.lower()))) and code.lower() != "general"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of the cell styles that show days or times."""
    custom, styles, inside = {}, set(), False
    if "xl/styles.xml" not in book.namelist():
        return styles
    at = 0
    for event, e in iterparse(book.open("xl/styles.xml"), ("start", "end")):
        if e.tag == f"{MAIN}cellXfs":
            inside = event == "start"
        elif event == "start" and e.tag == f"{MAIN}numFmt":
            custom[int(e.get("numFmtId"))] = e.get("formatCode", "")
        elif event == "start" and inside and e.tag == f"{MAIN}xf":
            number = int(e.get("numFmtId", 0))
            if _is_date(custom[number]) if number in custom else number in DATE_FORMATS:
                styles.add(at)
            at += 1
    return styles


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


@lru_cache(1 << 16)  # days and times of day come again in most rows
def _moment(serial: float, late: bool) -> tuple[str, str]:
    """Kind and text of a day number; one below 1 is a time of day alone."""
    micros = round(serial * 86_400_000_000)
    micros = round(micros, -3)  # what a double of days can tell
    if 0 <= micros < 86_400_000_000:
        return "time", str((datetime.datetime.min + datetime.timedelta(microseconds=micros)).time())
    first = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30) if serial >= 60 else datetime.datetime(1899, 12, 31)
    return "date", str(first + datetime.timedelta(microseconds=micros))


def _value(cell, strings: list[str], dates: set[int], late: bool) -> tuple[str, str] | None:
    """Kind and text of a cell, null for an empty one or an error."""
    kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return ("text", _text(inline)) if inline is not None else None
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return "text", strings[int(v.text)]
    if kind == "str":
        return "text", v.text
    if kind == "b":
        return "bool", "true" if v.text.strip() == "1" else "false"
    if kind == "d":
        return "date", v.text.replace("T", " ").removesuffix("Z")
    number = float(v.text)
    if int(cell.get("s", 0)) in dates:
        return _moment(number, late)
    return ("whole", str(int(number))) if number.is_integer() and abs(number) < 2**53 else ("number", repr(number))


def _rows(book: zipfile.ZipFile, part: str, strings: list[str], dates: set[int], late: bool) -> Iterator[dict[int, tuple[str, str]]]:
    """For each row that has a value, its values by column."""
    with book.open(part) as f:
        for _, e in iterparse(f):
            if e.tag != f"{MAIN}row":
                continue
            found, at = {}, -1
            for cell in e:
                if cell.tag == f"{MAIN}c":
                    at = _column(cell.get("r")) if cell.get("r") else at + 1
                    value = _value(cell, strings, dates, late)
                    if value is not None and value[1] != "":
                        found[at] = value
            e.clear()
            if found:
                yield found


def _names(header: dict[int, tuple[str, str]]) -> dict[int, str]:
    """Column names of a header row; one that comes again gets a number."""
    found, seen = {}, {}
    for at, (_, name) in sorted(header.items()):
        n = seen[name] = seen.get(name, -1) + 1
        found[at] = f"{name}.{n}" if n else name
    return found


def files(spark: SparkSession, path: str | Iterable[str]) -> DataFrame:
    """path and content of the workbooks at path, which may hold wildcards."""
    return spark.read.format("binaryFile").load([path] if isinstance(path, str) else list(path)).select("path", "content")


def _sheets(contents: DataFrame, names: list[str] | None) -> DataFrame:
    """path, sheet, place and content for every sheet asked for, dealt out over tasks."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [name for name, _ in _parts(zipfile.ZipFile(io.BytesIO(content)))[0]]
                if names is not None and (missing := [n for n in names if n not in found]):
                    raise ValueError(f"{path} has no sheets {missing}; there are {found}")
                some = found if names is None else names
                places = pa.array([[{"place": i, "name": n} for i, n in enumerate(some)]], pa.list_(pa.struct([("place", pa.int32()), ("name", pa.string())])))
                yield pa.record_batch([pa.array([path]), pa.array([content], pa.binary()), places], names=["path", "content", "sheets"])

    found = contents.mapInArrow(listed, "path string, content binary, sheets array<struct<place int, name string>>")
    return found.select("path", "content", F.explode("sheets").alias("sheet")).repartition("path", "sheet.place")


def cells(contents: DataFrame, sheets: str | Iterable[str] | None = None, kinds: bool = True) -> DataFrame:
    """path, sheet, place (of the sheet), row, and values and kinds by column name, for each row below a sheet's header.

    Without `kinds` that column holds empty maps: who knows the schema needs none.
    """
    names = [sheets] if isinstance(sheets, str) else list(sheets) if sheets is not None else None
    schema = "path string, sheet string, place int, row long, values map<string,string>, kinds map<string,string>, header array<string>"

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            text = pa.map_(pa.string(), pa.string())
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), text, text, pa.list_(pa.string()))
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "sheet", "place", "row", "values", "kinds", "header"])

        for batch in batches:
            for given in batch.to_pylist():
                book = zipfile.ZipFile(io.BytesIO(given["content"]))
                parts, late = _parts(book)
                strings, dates, sheet = _strings(book), _date_styles(book), given["sheet"]
                columns, out = None, []
                for n, found in enumerate(_rows(book, dict(parts)[sheet["name"]], strings, dates, late)):
                    if columns is None:
                        columns = _names(found)
                    known = [(columns[at], v) for at, v in found.items() if at in columns]
                    values = [] if not n else [(c, v[1]) for c, v in known]
                    out.append((given["path"], sheet["name"], sheet["place"], n, values, [(c, v[0]) for c, v in known] if n and kinds else [], [columns[at] for at in sorted(columns)] if not n else None))
                    if len(out) == ROWS_A_BATCH:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    return _sheets(contents, names).mapInArrow(parsed, schema)


def _schema(found: DataFrame) -> T.StructType:
    """All columns in order of file, sheet and place, each of the narrowest type that holds its cells."""
    headers = found.where("row = 0").select("path", "place", "header").orderBy("path", "place").collect()  # a row a sheet
    kinds = {r["c"]: set(r["kinds"]) for r in found.select(F.explode("kinds").alias("c", "kind")).groupBy("c").agg(F.collect_set("kind").alias("kinds")).collect()}
    fields = []
    for name in dict.fromkeys(c for r in headers for c in r["header"]):
        seen = kinds.get(name, set())
        kind = next(iter(seen)) if len(seen) == 1 else "number" if seen and seen <= {"whole", "number"} else "text"
        fields.append(f"`{name.replace('`', '``')}` {KINDS[kind]}")
    return T.StructType.fromDDL(", ".join(fields)) if fields else T.StructType()


def parse(contents: DataFrame, sheets: str | Iterable[str] | None = None, schema: str | T.StructType | None = None, source: bool = False) -> DataFrame:
    """The rows of the sheets under each other, columns matched by name; a column that a sheet lacks is null there.

    contents has path and content of each workbook. Without a schema the cells are read once more to
    find one: whole numbers, numbers, days, truths, and text for what is mixed. A cell that isn't of
    its column's type is null, as are empty cells and errors; empty rows are left out, and a sheet
    without rows gives none. Times of day are text, as 09:30:00. `source` adds path and sheet.
    """
    found = cells(contents, sheets, kinds=schema is None)
    if schema is None:
        schema = _schema(found)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def typed(f: T.StructField):
        text = F.col("values")[F.lit(f.name)]
        return (text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)).alias(f.name)

    more = [F.col("path"), F.col("sheet")] if source else []
    return found.where("row > 0").select(*more, *[typed(f) for f in schema.fields])


def read(spark: SparkSession, path: str | Iterable[str], sheets: str | Iterable[str] | None = None, schema: str | T.StructType | None = None, source: bool = False) -> DataFrame:
    """The sheets of the workbooks at path, as `parse` gives them."""
    return parse(files(spark, path), sheets, schema, source)


def yearly(bodies: DataFrame, headers: DataFrame, schema: tuple | None = None, year: str = r"(\d{4})\.xlsx$") -> DataFrame:
    """Counted birds of several yearly exports with the surveys of the same year, `countid` meeting `id`.

    Both have path and content of workbooks whose path tells the year. Columns that both sides have
    get _x and _y. A year that one side lacks gives no rows.
    """
    sides = []
    for contents, types in zip((bodies, headers), schema or (None, None), strict=True):
        rows = parse(contents, schema=types, source=True)
        sides.append(rows.withColumn("year", F.regexp_extract("path", year, 1).try_cast("int")).drop("path", "sheet"))
    return suffixed_join(*sides, ["year"], [("countid", "id")])
