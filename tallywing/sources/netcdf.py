"""A sink for gridded predictions: files of the classic NetCDF format, one for each group of rows.

`df.write.format("netcdf")` goes through `write`: rows are dealt out by group, each task lays out its
groups' grids under names of its own, and only the commit of the whole job gives files their names.
"""

from __future__ import annotations

import datetime
import os
import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Fixed values of the format: tags of its lists, type numbers with their big-endian layouts, the filler of each, its version for large files.
DIMENSIONS, VARIABLES_TAG, ATTRIBUTES, ABSENT = 10, 11, 12, b"\0" * 8
TYPES = {np.dtype("S1"): (2, "S1", b"\0"), np.dtype("i4"): (4, ">i4", -2147483647), np.dtype("f4"): (5, ">f4", np.nan), np.dtype("f8"): (6, ">f8", np.nan)}
MAGIC = b"CDF\x02"
EPOCH = datetime.date(1970, 1, 1)


def _padded(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def _name(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + _padded(raw)


def _attributes(given: Mapping[str, str | float]) -> bytes:
    if not given:
        return ABSENT
    out = struct.pack(">ii", ATTRIBUTES, len(given))
    for name, value in given.items():
        if isinstance(value, str):
            raw = value.encode()
            out += _name(name) + struct.pack(">ii", 2, len(raw)) + _padded(raw)
        else:
            out += _name(name) + struct.pack(">iid", 6, 1, value)
    return out


@dataclass
class Grid:
    """A variable: its dimensions by name, its values in their order, and its attributes."""

    dims: Sequence[str]
    values: np.ndarray
    attributes: Mapping[str, str | float]


def layout(dims: Mapping[str, int], variables: Mapping[str, Grid], attributes: Mapping[str, str | float]) -> Iterator[bytes]:
    """The bytes of a file: its header, then each variable's values."""
    order, head = list(dims), [MAGIC, struct.pack(">i", 0)]
    head.append(struct.pack(">ii", DIMENSIONS, len(dims)) + b"".join(_name(d) + struct.pack(">i", n) for d, n in dims.items()) if dims else ABSENT)
    head.append(_attributes(attributes))
    entries, sizes = [], []
    for name, v in variables.items():
        number, dtype, _ = TYPES[v.values.dtype]
        if v.values.shape != tuple(dims[d] for d in v.dims):
            raise ValueError(f"{name} has the shape {v.values.shape}, not that of its dimensions")
        size = v.values.size * np.dtype(dtype).itemsize
        size += -size % 4
        sizes.append(size)
        entry = _name(name) + struct.pack(">i", len(v.dims)) + b"".join(struct.pack(">i", order.index(d)) for d in v.dims) + _attributes(v.attributes)
        entries.append(entry + struct.pack(">ii", number, min(size, 2**31 - 4)))
    head.append(struct.pack(">ii", VARIABLES_TAG, len(variables)) if variables else ABSENT)
    at = sum(map(len, head)) + sum(len(e) + 8 for e in entries)
    for entry, size in zip(entries, sizes, strict=True):
        head.append(entry + struct.pack(">q", at))
        at += size
    yield b"".join(head)
    for v in variables.values():
        yield _padded(v.values.astype(TYPES[v.values.dtype][1]).tobytes())


def _axis(name: str, values: list) -> tuple[np.ndarray, list[str], dict]:
    """Values of a dimension, more dimensions that they need, and their attributes."""
    first = values[0]
    if isinstance(first, datetime.datetime):
        return np.array([(v.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)).total_seconds() for v in values]), [], {"units": "seconds since 1970-01-01 00:00:00", "calendar": "standard"}
    if isinstance(first, datetime.date):
        return np.array([float((v - EPOCH).days) for v in values]), [], {"units": "days since 1970-01-01", "calendar": "standard"}
    if isinstance(first, str):
        raw = [v.encode() for v in values]
        width = max(1, *map(len, raw))
        return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), "S1").reshape(len(raw), width), [f"{name}_length"], {"_Encoding": "utf-8"}
    return np.array(values, float), [], {}


def gridded(rows: Sequence, dims: Sequence[str], names: Sequence[str], attributes: Mapping[str, str | float]) -> Iterator[bytes]:
    """The file of a group's rows: their values on the grid of all values that each dimension takes, NaN where no row is."""
    axes = [sorted({r[d] for r in rows}) for d in dims]
    places = [{v: i for i, v in enumerate(a)} for a in axes]
    sizes, variables = {d: len(a) for d, a in zip(dims, axes, strict=True)}, {}
    for d, a in zip(dims, axes, strict=True):
        values, more, about = _axis(d, a)
        sizes |= dict(zip(more, values.shape[1:], strict=True))
        variables[d] = Grid([d, *more], values, about)
    arrays = {n: np.full([len(a) for a in axes], np.nan) for n in names}
    filled = np.zeros([len(a) for a in axes], bool)
    for r in rows:
        at = tuple(p[r[d]] for p, d in zip(places, dims, strict=True))
        if filled[at]:
            raise ValueError(f"two rows have {dict(zip(dims, (r[d] for d in dims), strict=True))}")
        filled[at] = True
        for n in names:
            if r[n] is not None:
                arrays[n][at] = r[n]
    variables |= {n: Grid(list(dims), v, {"_FillValue": float("nan")}) for n, v in arrays.items()}
    return layout(sizes, variables, attributes)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # made as, to be named


class _Writer(DataSourceWriter):
    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.to, self.by, self.dims, self.overwrite = options["path"], options["by"].split(","), options["dims"].split(","), overwrite
        self.names = options["variables"].split(",")
        self.run = f"_temporary-{uuid.uuid4().hex}"

    def _made(self) -> str:
        return os.path.join(self.to, self.run)

    def write(self, iterator):
        folder, found = os.path.join(self._made(), uuid.uuid4().hex), []
        os.makedirs(folder)
        for key, rows in groupby(iterator, key=lambda r: tuple(r[c] for c in self.by)):
            name = "_".join(k.strftime("%Y%m%d") if isinstance(k, datetime.date) else str(k).replace(" ", "_").replace("/", "_") for k in key) + ".nc"
            made = os.path.join(folder, name)
            with open(made, "xb") as f:  # a group that comes twice is an error
                for part in gridded(list(rows), self.dims, self.names, dict(zip(self.by, map(str, key), strict=True))):
                    f.write(part)
            found.append((made, os.path.join(self.to, name)))
        return _Written(found)

    def commit(self, messages):
        every = [x for m in messages if m is not None for x in m.files]
        names = [to for _, to in every]
        if len(set(names)) < len(names):
            self._clear()
            raise ValueError("a group was written by two tasks")
        if not self.overwrite and (there := [n for n in names if os.path.exists(n)]):
            self._clear()
            raise FileExistsError(f"{there} are there already")
        for made, to in every:
            os.replace(made, to)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        import shutil

        shutil.rmtree(self._made(), ignore_errors=True)


class NetCDF(DataSource):
    """Writes only: options path, by, dims and variables (lists of columns, comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def writer(self, schema, overwrite):
        if lacking := [c for c in ",".join(self.options[o] for o in ("by", "dims", "variables")).split(",") if c not in schema.names]:
            raise ValueError(f"the rows lack {lacking}")
        return _Writer(dict(self.options), overwrite)


def write(df: DataFrame, path: str, by: Sequence[str] = ("run_date", "species"), dims: Sequence[str] = ("date", "time"), variables: Sequence[str] | None = None, overwrite: bool = True) -> None:
    """One file a group, <run date>_<species>.nc by default, in a folder that the driver and all executors share.

    Every other column (or `variables`) is a variable on the grid of `dims`; dates become days and
    time stamps seconds since 1970, text an array of letters. A null is NaN, as is a place of the grid
    without a row; two rows for one place are an error. A group's grid is held by one task. Files of
    the same name are replaced under `overwrite` and an error else; others stay. If any task fails,
    no file appears.
    """
    names = list(variables) if variables else [c for c in df.columns if c not in (*by, *dims)]
    df.sparkSession.dataSource.register(NetCDF)
    rows = df.select(*by, *dims, *[F.col(c).cast("double") for c in names]).where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, *dims)))
    rows = rows.repartition(*by).sortWithinPartitions(*by)
    rows.write.format("netcdf").option("by", ",".join(by)).option("dims", ",".join(dims)).option("variables", ",".join(names)).mode("overwrite" if overwrite else "append").save(path)
