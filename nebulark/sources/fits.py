"""FITS files: header tables and pixels from any store that Spark reads, and frames back to file contents.

Files are listed by Spark's binary source; tasks read headers and blocks of rows by range. The content of a file, a row
each, is only taken for what comes out of a bundle.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
#: Samples of each BITPIX, big-endian.
SAMPLES = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
#: Pixels in a batch of rows.
ROWS = 1 << 18
#: Cards that an extension's header doesn't take from the primary one.
STRUCTURAL = {"SIMPLE", "XTENSION", "EXTEND", "PCOUNT", "GCOUNT"}
SUPPORTED = ("fits", "fit", "fts")


@dataclass
class Hdu:
    index: int
    start: int
    cards: list[tuple[str, str]] = field(default_factory=list)

    def get(self, key: str, default: str = "") -> str:
        return next((v for k, v in reversed(self.cards) if k == key), default)

    def number(self, key: str, default: float) -> float:
        try:
            return float(self.get(key).strip())
        except ValueError:
            return default

    @property
    def shape(self) -> list[int]:
        """Sizes of the axes, slowest first."""
        return [int(self.number(f"NAXIS{k}", 0)) for k in range(int(self.number("NAXIS", 0)), 0, -1)]

    @property
    def size(self) -> int:
        """Bytes of data, without padding."""
        return int(np.prod(self.shape)) * abs(int(self.number("BITPIX", 0))) // 8 if self.shape else 0

    def pixels(self, data: bytes) -> np.ndarray:
        kind = SAMPLES.get(int(self.number("BITPIX", 0)))
        if kind is None:
            raise ValueError(f"BITPIX {self.get('BITPIX')} is not supported")
        raw = np.frombuffer(data, kind, int(np.prod(self.shape)), self.start).astype(np.float64).reshape(self.shape)
        scale, zero = self.number("BSCALE", 1.0), self.number("BZERO", 0.0)
        return raw if abs(scale - 1) < 1e-15 and abs(zero) < 1e-15 else raw * scale + zero


def value_of(raw: str) -> str:
    raw = raw.strip()
    return raw[1:].split("'", 1)[0].rstrip() if raw.startswith("'") else raw.split("/", 1)[0].strip()


def hdus(data: bytes) -> list[Hdu]:
    """The file's units; what can't be read as a header ends them."""
    out, at = [], 0
    while at + BLOCK <= len(data):
        unit, done, position = Hdu(len(out), 0), False, at
        while not done and position + BLOCK <= len(data):
            block = data[position : position + BLOCK].decode("ascii", "replace")
            position += BLOCK
            for k in range(0, BLOCK, CARD):
                card = block[k : k + CARD]
                if card[:8].rstrip() == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    unit.cards.append((card[:8].rstrip(), value_of(card[10:])))
        if not done or not unit.cards or unit.cards[0][0] not in ("SIMPLE", "XTENSION"):
            break
        unit.start = position
        out.append(unit)
        at = position + -(-unit.size // BLOCK) * BLOCK
    return out


def best(units: list[Hdu]) -> Hdu | None:
    """The image: a single unit, else the first SCI one, else the first extension, with data; else the primary one."""
    full = [u for u in units if u.size]
    science = [u for u in full if u.get("EXTNAME").upper() == "SCI"]
    return next(iter(science or [u for u in full if u.index] or full or units), None)


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUPPORTED))


def expanded(files: DataFrame, depth: int = 4) -> DataFrame:
    """Files (name, content) with ZIP bundles replaced by the supported files in them, bundles in bundles down to a depth; a
    nested bundle that can't be read is left out. Names are the bundle's and the member's."""

    def members(name: str, data: bytes, left: int):
        if not name.lower().endswith(".zip"):
            if name.lower().rpartition(".")[2] in SUPPORTED:
                yield name, data
            return
        try:
            bundle = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            if left == depth:
                raise
            return
        if left:
            for one in sorted(bundle.namelist()):
                yield from members(f"{name}/{one}", bundle.read(one), left - 1) if not one.endswith("/") else ()

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for one, content in members(name, data, depth):
                    yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([content], pa.binary())], names=["name", "content"])

    return files.mapInArrow(scan, "name string, content binary")


def first_of_bundle(files: DataFrame) -> DataFrame:
    """Of each bundle's files (name, content) the first by name."""
    top = F.regexp_extract("name", r"(?i)^(.*?\.zip)(?:/|$)", 1)
    key = F.when(top != "", top).otherwise(F.col("name"))
    return files.groupBy(key.alias("bundle")).agg(F.min(F.struct("name", "content")).alias("s")).select("s.*")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Supported files under a path, without their content: path and length."""
    return binary(spark, path).select("path", "length")


UNIT = "file string, hdu int, start long, size long, bitpix int, shape array<int>, scale double, zero double, whole boolean, cards array<struct<key:string,value:string>>"


def units_of(name: str, size: int) -> Iterator[tuple]:
    """The units of a file, as rows of UNIT; only headers are read, block by block."""
    read, at, index = ranges(name), 0, 0
    while unit := header_at(read, size, at):
        end = unit.start + unit.size
        yield name, index, unit.start, unit.size, int(unit.number("BITPIX", 0)), unit.shape, unit.number("BSCALE", 1.0), unit.number("BZERO", 0.0), end <= size, [{"key": k, "value": v} for k, v in unit.cards]
        at, index = unit.start + -(-unit.size // BLOCK) * BLOCK, index + 1


def open_units(files: DataFrame) -> DataFrame:
    """One row a unit of files (path, length): file, hdu, start and size of its data in bytes, bitpix, shape (slowest axis
    first), scale, zero, whether the file is long enough, and its cards. A task reads headers by range, never data."""
    names = UNIT.replace("struct<key:string,value:string>", "").split(", ")
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))]

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(units_of(name, size))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[n.split()[0] for n in names])

    return files.select("path", "length").mapInArrow(scan, UNIT)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Cards of all units of the files under a path: file, hdu, pos, key and value; read by range."""
    return open_units(listed(spark, path)).select("file", "hdu", F.posexplode("cards").alias("pos", "card")).select("file", "hdu", "pos", "card.key", "card.value")


def card(key: str) -> Column:
    """The value of a unit's last card of a key; null without one."""
    found = F.filter("cards", lambda c: c["key"] == key)
    return F.try_element_at(found, F.lit(-1))["value"]


def images(units: DataFrame, hdu: int | None = None) -> DataFrame:
    """Geometry of each file's image (of units from open_units): file, hdu, start, bitpix, planes, height, width, scale, zero.

    The unit asked for; else a single unit, the first SCI one, or the first extension that has data, else the primary one.
    A file without the unit or without an image, or that ends before it does, is an error.
    """
    full = F.col("size") > 0
    science = F.upper(F.coalesce(card("EXTNAME"), F.lit(""))) == "SCI"
    rank = F.when(full & science, 0).when(full & (F.col("hdu") > 0), 1).when(full, 2).otherwise(3) if hdu is None else F.when(F.col("hdu") == hdu, 0).otherwise(1)
    one = units.groupBy("file").agg(F.min_by(F.struct("hdu", "start", "size", "bitpix", "shape", "scale", "zero", "whole", rank.alias("rank")), F.struct(rank, "hdu")).alias("u")).select("file", "u.*")
    fault = F.when(F.col("size") <= 0, " has no image").when(~F.col("whole"), " ends before its image does").when(~F.col("bitpix").isin(*SAMPLES), " has samples of an unknown kind")
    if hdu is not None:
        fault = F.when(F.col("rank") > 0, f" has no unit {hdu}").otherwise(fault)
    side = lambda k: F.coalesce(F.try_element_at("shape", F.lit(-k)), F.lit(1))
    start = F.when(fault.isNull(), F.col("start")).otherwise(F.raise_error(F.concat("file", fault)).cast("long"))
    return one.select("file", "hdu", start.alias("start"), "bitpix", side(3).alias("planes"), side(2).alias("height"), side(1).alias("width"), "scale", "zero")


def headers_of(files: DataFrame) -> DataFrame:
    """Cards of all units of files (name, content): file, hdu, pos, key and value."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [(f, u.index, k, *card) for f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for u in hdus(data) for k, card in enumerate(u.cards)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["file", "hdu", "pos", "key", "value"]).astype({"hdu": "int32", "pos": "int32"}), preserve_index=False)

    return files.mapInArrow(scan, "file string, hdu int, pos int, key string, value string")


def merged_header(headers: DataFrame, hdu: int) -> DataFrame:
    """Per file one map: an extension's cards over the primary unit's, without structural ones."""
    own = headers.where(F.col("hdu").isin(0, hdu) & ~F.col("key").isin(*STRUCTURAL))
    last = own.groupBy("file", "key").agg(F.max_by("value", F.struct("hdu", "pos")).alias("value"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("header"))  # a header's cards


def read_pixels(spark: SparkSession, path: str, hdu: int | None = None) -> DataFrame:
    """Pixels of each file's image or cube: file, z, y, x (from 0) and v; the best unit, or the one asked for. Tasks read
    blocks of rows by range, so files may be larger than a task's memory."""
    return read_frames(images(open_units(listed(spark, path)), hdu))


def pixels_of(files: DataFrame, hdu: int | None = None) -> DataFrame:
    """Of files (name, content)."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = hdus(data)
                if hdu is not None and hdu >= len(units):
                    raise ValueError(f"{name} has no unit {hdu}")
                unit = best(units) if hdu is None else units[hdu]
                if unit is None or not unit.size:
                    raise ValueError(f"{name} has no image")
                values = unit.pixels(data)
                z, y, x = (1, *values.shape)[-3:] if values.ndim < 3 else values.shape[-3:]
                flat = values.reshape(-1)[: z * y * x]
                for s in range(0, len(flat), ROWS):
                    at = np.arange(s, min(s + ROWS, len(flat)))
                    cols = [pa.array([name] * len(at)), *(pa.array(c.astype(np.int32)) for c in (at // (y * x), at // x % y, at % x)), pa.array(flat[at])]
                    yield pa.RecordBatch.from_arrays(cols, names=["file", "z", "y", "x", "v"])

    return files.mapInArrow(scan, "file string, z int, y int, x int, v double")


def rgb_of(pixels: DataFrame) -> DataFrame:
    """file, y, x, r, g and b of files with three or four planes; others have no rows."""
    planes = pixels.groupBy("file").agg((F.max("z") + 1).alias("planes")).where("planes BETWEEN 3 AND 4")
    return pixels.join(planes, "file").groupBy("file", "y", "x").agg(*(F.max(F.when(F.col("z") == k, F.col("v"))).alias(c) for k, c in enumerate("rgb")))


def ranges(name: str):
    """A function that reads bytes [start, start + n) of a file, wherever Spark's path points to."""
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
    stream = store.open_input_file(path)

    def read(start: int, n: int) -> bytes:
        data = stream.read_at(n, start)
        if len(data) < n:
            raise ValueError(f"{name} is cut short")
        return data

    return read


def header_at(read, size: int, at: int) -> Hdu | None:
    """The unit whose header starts at a byte, read block by block; None if there is none."""
    data = b""
    while at + len(data) + BLOCK <= size:
        data += read(at + len(data), BLOCK)
        if any(data[k : k + 8].rstrip() == b"END" for k in range(len(data) - BLOCK, len(data), CARD)):
            found = hdus(data)
            return Hdu(0, at + len(data), found[0].cards) if found else None
    return None


def open_cubes(spark: SparkSession, path: str) -> DataFrame:
    """Geometry of each file's first cube of several planes: file, start (of its data), bitpix, planes, height, width, scale
    and zero. Only headers are read, by ranges; a file that ends before its cube does is an error."""
    cubes = open_units(listed(spark, path)).where((F.size("shape") == 3) & (F.col("shape")[0] > 1))
    first = cubes.groupBy("file").agg(F.min_by(F.struct("start", "bitpix", "shape", "scale", "zero", "whole"), "hdu").alias("u")).select("file", "u.*")
    start = F.when(F.col("whole"), F.col("start")).otherwise(F.raise_error(F.concat("file", F.lit(" ends before its cube does"))).cast("long"))
    return first.select("file", start.alias("start"), "bitpix", *(F.col("shape")[k].alias(n) for k, n in enumerate(("planes", "height", "width"))), "scale", "zero")


def dealt(jobs: DataFrame, *keys: str) -> DataFrame:
    """A list of what is to be read, over as many tasks as Spark shuffles to. The list is small, whatever it stands for, so
    without a number Spark would join its partitions to one task."""
    return jobs.repartition(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_frames(cubes: DataFrame, z: Column | None = None, rows: int = 256) -> DataFrame:
    """Voxels (file, z, y, x, v) of opened cubes, or of the planes that a condition on z picks; a task reads blocks of rows
    of a plane by range, never a whole file."""
    planes = cubes.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("planes") - 1)))
    planes = planes if z is None else planes.where(z)
    blocks = dealt(planes.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(rows)))), "file", "z", "y0")

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                kind, n = np.dtype(SAMPLES[r["bitpix"]]), min(rows, r["height"] - r["y0"]) * r["width"]
                first = (r["z"] * r["height"] + r["y0"]) * r["width"]
                v = np.frombuffer(ranges(r["file"])(r["start"] + first * kind.itemsize, n * kind.itemsize), kind).astype(np.float64)
                at = np.arange(n)
                cols = [pa.array([r["file"]] * n), pa.array(np.full(n, r["z"], np.int32)), pa.array((r["y0"] + at // r["width"]).astype(np.int32)), pa.array((at % r["width"]).astype(np.int32)), pa.array(v * r["scale"] + r["zero"])]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "z", "y", "x", "v"])

    return blocks.mapInArrow(scan, "file string, z int, y int, x int, v double")


def collapse(cubes: DataFrame, how: str = "mean", samples: int = 1 << 22) -> DataFrame:
    """Mean or upper median along z (file, y, x, v) of the samples of opened cubes that are finite and not 0; 0 without any.

    A task reads a block of the image through all planes by range and reduces it where it is read, so voxels never become
    rows and nothing is shuffled but the list of blocks. It holds `samples` at most: a mean adds plane to plane, a median
    takes as many pixels as fit with all their planes.
    """
    width = F.lit(samples) if how == "mean" else F.greatest(F.lit(1), F.floor(F.lit(samples) / F.col("planes")))
    blocks = cubes.withColumn("cols", F.least(F.col("width"), width).cast("int")).withColumn("rows", F.greatest(F.lit(1), F.least(F.col("height"), F.floor(width / F.col("cols")))).cast("int"))
    for axis, side, step in (("y", "height", "rows"), ("x", "width", "cols")):
        blocks = blocks.withColumn(f"{axis}0", F.explode(F.sequence(F.lit(0), F.col(side) - 1, F.col(step))))

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                kind, read = np.dtype(SAMPLES[r["bitpix"]]), ranges(r["file"])
                rows, cols = min(r["rows"], r["height"] - r["y0"]), min(r["cols"], r["width"] - r["x0"])

                def plane(z: int, r=r, kind=kind, read=read, rows=rows, cols=cols) -> np.ndarray:
                    at = lambda y: r["start"] + ((z * r["height"] + r["y0"] + y) * r["width"] + r["x0"]) * kind.itemsize
                    runs = [(at(0), rows * cols)] if cols == r["width"] else [(at(y), cols) for y in range(rows)]
                    v = np.concatenate([np.frombuffer(read(p, n * kind.itemsize), kind) for p, n in runs]).astype(np.float64)
                    return v * r["scale"] + r["zero"]

                counts = lambda v: np.isfinite(v) & (v != 0)
                if how == "mean":
                    total, n = np.zeros(rows * cols), np.zeros(rows * cols, np.int64)
                    for z in range(r["planes"]):
                        v = plane(z)
                        ok = counts(v)
                        total += np.where(ok, v, 0)
                        n += ok
                    out = total / np.maximum(n, 1)
                else:
                    v = np.stack([plane(z) for z in range(r["planes"])])
                    ok = counts(v)
                    n = ok.sum(axis=0)
                    ordered = np.sort(np.where(ok, v, np.inf), axis=0)
                    out = np.where(n > 0, np.take_along_axis(ordered, np.minimum(n // 2, len(v) - 1)[None], axis=0)[0], 0.0)
                k = np.arange(rows * cols)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(k)), pa.array((r["y0"] + k // cols).astype(np.int32)), pa.array((r["x0"] + k % cols).astype(np.int32)), pa.array(out)], names=["file", "y", "x", "v"])

    return dealt(blocks, "file", "y0", "x0").mapInArrow(scan, "file string, y int, x int, v double")


def read_spectra(cubes: DataFrame, y: int, x: int) -> DataFrame:
    """file, z and v of one pixel of opened cubes: one sample a plane is read, and nothing else. Unknown formats give 0."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                if not (0 <= y < r["height"] and 0 <= x < r["width"]):
                    raise ValueError(f"{r['file']} has no pixel ({y}, {x})")
                kind, read = SAMPLES.get(r["bitpix"]), ranges(r["file"])
                size = np.dtype(kind or "u1").itemsize
                at = [r["start"] + ((k * r["height"] + y) * r["width"] + x) * size for k in range(r["planes"])]
                v = [float(np.frombuffer(read(p, size), kind)[0]) * r["scale"] + r["zero"] if kind else 0.0 for p in at]
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(v)), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["file", "z", "v"])

    return dealt(cubes, "file").mapInArrow(scan, "file string, z int, v double")


def encode(planes: np.ndarray, cards: list[tuple[str, str]] = (), bitpix: int = -32) -> bytes:
    """A file's content from planes (z, y, x), or one plane (y, x); with 16 bits, samples are scaled to their range."""
    fixed = [("SIMPLE", "T"), ("BITPIX", str(bitpix)), ("NAXIS", str(planes.ndim)), *((f"NAXIS{k + 1}", str(n)) for k, n in enumerate(reversed(planes.shape)))]
    data = planes
    if bitpix == 16:
        some = planes[np.isfinite(planes)]
        low, high = (float(some.min()), float(some.max())) if len(some) else (0.0, 0.0)
        scale, zero = ((high - low) / 65535, low + (high - low) / 65535 * 32768) if high - low >= 1e-30 else (1.0, 32768.0)
        fixed += [("BSCALE", repr(scale)), ("BZERO", repr(zero))]
        scaled = np.clip((np.nan_to_num(planes, nan=zero) - zero) / scale, -32768, 32767)
        data = np.trunc(scaled + np.copysign(0.5, scaled))
    names = {k for k, _ in fixed} | {"BSCALE", "BZERO", "END"}
    lines = [f"{k:<8}= {v:>20}" for k, v in fixed]
    for key, value in cards:
        if key not in names:
            try:
                float(value)
                lines.append(f"{key[:8]:<8}= {value:>20}"[:CARD])
            except ValueError:
                text = value.replace("'", "")[: CARD - 12]
                lines.append(f"{key[:8]:<8}= '{text:<8}'")
    head = "".join(f"{x:<{CARD}}" for x in [*lines, "END"]).encode("ascii", "replace")
    body = data.astype(SAMPLES[bitpix]).tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK, b" ") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def to_files(pixels: DataFrame, frame: str, bitpix: int = -32) -> DataFrame:
    """Each frame (y, x, v, or z, y, x, v) as (frame, content): a frame is one file, so one task's work."""
    has_z = "z" in pixels.columns

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf["z"].to_numpy() if has_z else np.zeros(len(pdf), int)
        planes = np.full((int(z.max()) + 1, int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.nan)
        planes[z, pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({"frame": [str(pdf[frame].iloc[0])], "content": [encode(planes if has_z else planes[0], bitpix=bitpix)]})

    return pixels.groupBy(frame).applyInPandas(build, "frame string, content binary")


def save(files: DataFrame, folder: str, extension: str = "fits", name: str = "frame") -> None:
    """Writes contents to a folder that all executors share, one file a row."""

    def write(rows) -> None:
        store, base = fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", folder))
        store.create_dir(base)
        for r in rows:
            with store.open_output_stream(f"{base}/{r[0]}.{extension}") as out:
                out.write(bytes(r[1]))

    files.select(name, "content").foreachPartition(write)


def folder_info(spark: SparkSession, folder: str) -> DataFrame:
    """One row: bytes and files under a folder, hidden ones left out; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("length")
    return found.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
