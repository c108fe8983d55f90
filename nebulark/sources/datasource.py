"""FITS as a data source of Spark: spark.read.format("fits").load(path), in SQL too, after register(spark).

A file is split by its size alone, so planning opens no file; a task walks the headers by range and reads the rows of samples
that start in its share of the bytes. Conditions on file, hdu, z and y are pushed into what is listed and read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from nebulark.sources.fits import SAMPLES, SUPPORTED, header_at, ranges

#: Bytes of a file that a task reads, and samples of a batch of rows.
SPLIT, ROWS = 32 << 20, 1 << 18
BLOCK = 2880


@dataclass
class Part(InputPartition):
    """The share [start, stop) of a file's bytes."""

    file: str
    size: int
    start: int
    stop: int


@dataclass
class Bounds:
    """What pushed conditions leave of a column: whole numbers in [low, high], or some values."""

    low: int = -(1 << 62)
    high: int = 1 << 62
    values: set | None = None

    def narrow(self, condition: Filter) -> None:
        if isinstance(condition, EqualTo | In):
            found = set(condition.value) if isinstance(condition, In) else {condition.value}
            self.values = found if self.values is None else self.values & found
        elif isinstance(condition, GreaterThan):
            self.low = max(self.low, condition.value + 1)
        elif isinstance(condition, GreaterThanOrEqual):
            self.low = max(self.low, condition.value)
        elif isinstance(condition, LessThan):
            self.high = min(self.high, condition.value - 1)
        else:
            self.high = min(self.high, condition.value)

    def __contains__(self, x) -> bool:
        return (self.values is None or x in self.values) and (isinstance(x, str) or self.low <= x <= self.high)

    def chosen(self, n: int) -> np.ndarray:
        """Of 0 to n - 1 those that are left."""
        if self.values is not None:
            return np.array(sorted(k for k in self.values if 0 <= k < n and k in self), np.int64)
        return np.arange(max(self.low, 0), min(self.high, n - 1) + 1)


@dataclass
class Reader(DataSourceReader):
    path: str
    split: int = SPLIT
    bounds: dict[str, Bounds] = field(default_factory=lambda: {c: Bounds() for c in ("file", "hdu", "z", "y")})

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            known = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.bounds
            equal = isinstance(f, EqualTo | In)
            ordered = isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and known and f.attribute[0] != "file"
            if known and (equal or ordered):
                self.bounds[f.attribute[0]].narrow(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, base = fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", self.path))
        info = store.get_file_info(base)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
        scheme = "file:" if isinstance(store, fs.LocalFileSystem) else re.match(r"^[^:]*://[^/]*", self.path)[0]
        files = sorted((scheme + f.path, f.size) for f in found if f.is_file and f.path.lower().rpartition(".")[2] in SUPPORTED)
        return [Part(name, size, s, min(s + self.split, size)) for name, size in files if name in self.bounds["file"] for s in range(0, size, self.split)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        read, at, hdu = ranges(part.file), 0, 0
        while at < part.stop and (unit := header_at(read, part.size, at)):
            at = unit.start + -(-unit.size // BLOCK) * BLOCK
            kind, shape = SAMPLES.get(int(unit.number("BITPIX", 0))), unit.shape
            if kind and unit.size and hdu in self.bounds["hdu"]:
                depth, height, width = ([1, 1, 1] + shape)[-3:]
                yield from self.rows(part, read, unit, hdu, np.dtype(kind), depth, height, width)
            hdu += 1

    def rows(self, part: Part, read, unit, hdu: int, kind: np.dtype, depth: int, height: int, width: int) -> Iterator[pa.RecordBatch]:
        """Rows of samples of a unit that start in the share and that conditions leave, in runs that are read at once."""
        if unit.start + unit.size > part.size:
            raise ValueError(f"{part.file} ends before its image does")
        line = width * kind.itemsize
        first, last = max(-(-(part.start - unit.start) // line), 0), min(-(-(part.stop - unit.start) // line), depth * height)
        number = (self.bounds["z"].chosen(depth)[:, None] * height + self.bounds["y"].chosen(height)[None, :]).reshape(-1)
        number = number[(number >= first) & (number < last)]
        most = max(1, ROWS // width)
        cuts = np.flatnonzero(np.diff(number) != 1) + 1
        for run in np.split(number, cuts):
            for s in range(0, len(run), most):
                lines = run[s : s + most]
                v = np.frombuffer(read(unit.start + int(lines[0]) * line, len(lines) * line), kind).astype(np.float64) * unit.number("BSCALE", 1.0) + unit.number("BZERO", 0.0)
                k = np.repeat(lines, width)
                numbers = [pa.array(c.astype(np.int32)) for c in (np.full(len(k), hdu), k // height, k % height, np.tile(np.arange(width), len(lines)))]
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(k)), *numbers, pa.array(v)], names=["file", "hdu", "z", "y", "x", "v"])


class Fits(DataSource):
    """Samples of all units with data of the files at `path`; `split` is the size of a task's share in bytes."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "file string, hdu int, z int, y int, x int, v double"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with its conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Fits)
