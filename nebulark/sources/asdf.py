"""ASDF files: a tree in YAML, then binary blocks. Arrays are found in the tree, blocks by their headers; samples are read by
range where a block is plain, and by streaming where it is compressed, so no task holds a file.

Numbers are little-endian unless the datatype (`>f4`) or the byteorder key says big.
"""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.functions.channels import holds_reference
from nebulark.sources import fits
from nebulark.sources.fits import dealt, ranges

MAGIC, BLOCK_MAGIC = b"#ASDF", b"\xd3BLK"
#: Names of arrays at the top of a tree and below `roman`, and how deep others are looked for.
TOP, ROMAN, DEPTH = ("data", "sci", "SCI", "science", "image"), ("data", "science", "sci"), 4
#: Kinds of samples by their names.
KINDS = {"f4": "f4", "float32": "f4", "f8": "f8", "float64": "f8", "i2": "i2", "int16": "i2", "i4": "i4", "int32": "i4", "u2": "u2", "uint16": "u2", "u1": "u1", "uint8": "u1", "c8": "c8", "complex64": "c8"}
#: Decoders of compressed blocks that a standard Python has.
DECODERS = {"zlib": zlib.decompressobj, "bzp2": bz2.BZ2Decompressor}
#: Bytes that are read at once, and samples of a batch of rows.
CHUNK, ROWS = 1 << 20, 1 << 18
#: Characters of a header's key.
KEY_SIZE = 68


def tree_of(read, size: int) -> tuple[dict, int]:
    """The tree of a file, every scalar as text, and the byte after it."""
    import yaml

    data, end = b"", -1
    while end < 0 and len(data) < size:
        data += read(len(data), min(CHUNK, size - len(data)))
        end = max(data.find(b"\n...\n"), data.find(b"\n...\r\n"))
    if not data.startswith(MAGIC):
        raise ValueError("not an ASDF file")
    stop = len(data) if end < 0 else data.index(b"\n", end + 1) + 1
    lines = data[:stop].decode("utf-8", "replace").splitlines()
    begin = next((k for k, line in enumerate(lines) if line.startswith("---")), len(lines))
    text = "\n".join(line for line in lines[begin + 1 :] if line.rstrip() != "...")
    if not text.strip():
        raise ValueError("no tree")
    tree = yaml.load(text, yaml.BaseLoader)  # tags and types of scalars don't matter here
    return tree if isinstance(tree, dict) else {}, stop


def blocks_of(read, size: int, at: int) -> Iterator[tuple[int, int, str, int]]:
    """Start, bytes used, compression ('' for none) and bytes of data of each block; only block headers are read."""
    first = True
    while at + 4 <= size:
        window = read(at, min(4096, size - at))
        skip = window.find(BLOCK_MAGIC) if first else len(window) - len(window.lstrip(b"\0"))
        if skip < 0 or skip == len(window):  # padding
            at += max(len(window) - 3, 1)
            continue
        at += skip
        if at + 54 > size or (head := read(at, 54))[:4] != BLOCK_MAGIC:
            return
        number = lambda s, n, head=head: int.from_bytes(head[s : s + n], "big")
        header, flags, allocated, used, data = number(4, 2), number(6, 4), number(14, 8), number(22, 8), number(30, 8)
        if header < 48:
            raise ValueError("a block header is cut short")
        start = at + 6 + header
        if flags & 1:  # a streamed block goes to the end of the file
            allocated = used = data = size - start
        if start + allocated > size:
            raise ValueError("a block is cut short")
        yield start, used, head[10:14].rstrip(b"\0").decode("ascii", "replace"), data
        at, first = start + allocated, False


def array_of(tree: dict) -> tuple[str, dict] | None:
    """The name and description of a tree's image: by the usual names, then below `roman`, then the first array in depth."""
    is_array = lambda node: isinstance(node, dict) and "source" in node and "shape" in node
    for name in TOP:
        node = tree.get(name)
        if is_array(node):
            return name, node
        if isinstance(node, dict) and isinstance(node.get("data"), dict) and "source" in node["data"]:
            return name, node["data"]
    roman = tree.get("roman")
    for name in ROMAN if isinstance(roman, dict) else ():
        if is_array(roman.get(name)):
            return f"roman.{name}", roman[name]

    def search(node, depth: int):
        if is_array(node):
            return node
        return next(filter(None, (search(v, depth + 1) for v in node.values())), None) if isinstance(node, dict) and depth < DEPTH else None

    return next(((name, found) for name, node in tree.items() if (found := search(node, 0))), None)


def layout(shape: list[int]) -> tuple[int, int, int, bool]:
    """Height, width, planes, and whether planes come last: three axes have up to four planes at either end, or many at first."""
    if len(shape) == 2:
        return shape[0], shape[1], 1, False
    if len(shape) == 3:
        last = shape[0] > 4 and shape[2] <= 4
        return (shape[0], shape[1], shape[2], True) if last else (shape[1], shape[2], shape[0], False)
    side = int(np.sqrt(np.prod(shape, dtype=np.float64)))
    return side, side, 1, False


def flattened(node, prefix: str) -> Iterator[tuple[str, str]]:
    """Scalars below a node by dotted keys; lists and nulls are left out."""
    if isinstance(node, dict):
        for key, value in node.items():
            yield from flattened(value, f"{prefix}.{key}")
    elif isinstance(node, str) and node not in ("", "~", "null"):
        yield prefix, node


def numbers(node, key: str) -> list[float] | None:
    """The first two numbers of a list below a key."""
    try:
        return [float(x) for x in node[key][:2]] if len(node[key]) >= 2 else None
    except (KeyError, TypeError, ValueError):
        return None


def matrix(node, key: str) -> list[list[float]] | None:
    try:
        return [[float(x) for x in row[:2]] for row in node[key][:2]] if len(node[key]) >= 2 else None
    except (KeyError, TypeError, ValueError):
        return None


def world_cards(tree: dict) -> dict[str, str]:
    """Cards of a tree's world coordinates: given plainly, or by the steps of a pipeline of transforms; none without them."""
    meta = tree.get("meta") if isinstance(tree.get("meta"), dict) else {}
    plain = tree.get("wcs") or meta.get("wcs")
    point, value = numbers(plain, "crpix"), numbers(plain, "crval")
    kinds, units = ["RA---TAN", "DEC--TAN"], ["deg", "deg"]
    if point and value:
        delta, turn = numbers(plain, "cdelt") or [1.0, 1.0], matrix(plain, "pc") or [[1.0, 0.0], [0.0, 1.0]]
        pair = lambda key, other: plain[key][:2] if isinstance(plain.get(key), list) and len(plain[key]) >= 2 else other
        kinds, units = pair("ctype", kinds), pair("cunit", units)
    else:
        piped = tree.get("gwcs") or (meta.get("wcs") if isinstance(meta.get("wcs"), dict) else None)
        if not isinstance(piped, dict) or not isinstance(piped.get("steps"), list):
            return {}
        shifts, scales, value, turn = [], [], [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]
        for step in piped["steps"]:
            node = step.get("transform") if isinstance(step, dict) else None
            if not isinstance(node, dict):
                continue
            kind = node.get("transform_type") or node.get("type") or ""
            if "Shift" in kind and "offset" in node:
                shifts.append(-float(node["offset"]))
            elif "Scale" in kind and "factor" in node:
                scales.append(float(node["factor"]))
            elif "AffineTransformation" in kind or "Rotation" in kind:
                turn = matrix(node, "matrix") or turn
            elif "Pix2Sky" in kind or "TAN" in kind:
                value = [float(node.get(key, old)) for key, old in zip(("lon_0", "lat_0"), value)]
        point, delta = (shifts + [0.0, 0.0])[:2], (scales + [1.0, 1.0])[:2]
    own = lambda x: str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))
    pairs = {"CRPIX": map(own, point), "CRVAL": map(own, value), "CDELT": map(own, delta), "CTYPE": kinds, "CUNIT": units}
    cards = {f"{name}{k + 1}": v for name, both in pairs.items() for k, v in enumerate(both)}
    return cards | {f"PC{i + 1}_{j + 1}": own(turn[i][j]) for i in range(2) for j in range(2)}


def header_of(tree: dict, name: str, height: int, width: int) -> dict[str, str]:
    """Cards as a plain image has them: its size, world coordinates, and the tree's metadata by upper-case keys."""
    cards = {"NAXIS": "2", "NAXIS1": str(width), "NAXIS2": str(height), "BITPIX": "-32"} | world_cards(tree)
    roman = tree.get("roman") if isinstance(tree.get("roman"), dict) else {}
    found = [*flattened(tree.get("meta"), "meta"), *flattened(tree.get("header"), "header"), *flattened(roman.get("meta"), "roman.meta"), ("ASDF_DATA_KEY", name)]
    for key, value in found:
        cards.setdefault(key.replace(".", "_")[:KEY_SIZE].upper(), value)
    return cards | {"ASDF_SRC": "true"}


OPENED = "file string, name string, kind string, planes int, height int, width int, last boolean, start long, used long, size long, compression string, header map<string,string>"


def described(name: str, size: int) -> tuple | None:
    """A row of OPENED; None for a file without an array."""
    read = ranges(name)
    try:
        tree, at = tree_of(read, size)
        if (found := array_of(tree)) is None:
            return None
        key, node = found
        if "strides" in node:
            raise ValueError("arrays with strides can't be read")
        sign, kind = (node["datatype"][0], node["datatype"][1:]) if node["datatype"][0] in "<>=|" else ("", node["datatype"])
        if kind not in KINDS:
            raise ValueError(f"samples of kind {kind} can't be read")
        order = ">" if sign == ">" or not sign and node.get("byteorder") == "big" else "<"
        height, width, planes, last = layout([int(n) for n in node["shape"]])
        source = int(node["source"])
        block = next((b for k, b in enumerate(blocks_of(read, size, at)) if k == source), None)
        if block is None:
            raise ValueError(f"block {source} is missing")
        start, used, compression, data = block
        if compression and compression not in DECODERS:
            raise ValueError(f"{compression} blocks can't be read")
        skip, need = int(node.get("offset", 0)), height * width * planes * np.dtype(KINDS[kind]).itemsize
        if data < skip + need:
            raise ValueError("the block ends before its array does")
        where = (start + skip, need) if not compression else (start, used)
        return name, key, order + KINDS[kind], planes, height, width, last, *where, skip, compression, header_of(tree, key, height, width)
    except ValueError as fault:
        raise ValueError(f"{name}: {fault}") from fault


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path that are ASDF by their extension or first bytes: path and length. Calibration references are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def sniffed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = [p.lower().endswith(".asdf") or n >= len(MAGIC) and ranges(p)(0, len(MAGIC)) == MAGIC for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = files.mapInArrow(sniffed, "path string, length long")
    own = F.element_at(F.split("path", "/"), -1)
    checked = F.when(holds_reference(own), F.raise_error(F.concat(F.lit("a calibration reference has no image: "), own)).cast("string")).otherwise(F.col("path"))
    return found.select(checked.alias("path"), "length")


def open_arrays(files: DataFrame) -> DataFrame:
    """One row a file (path, length) that has an array: its name, kind of samples, planes, height, width, whether planes come
    last, where its block lies and how it is compressed, and a header of cards. Trees and block headers are read by range."""
    names = [c.split()[0] for c in OPENED.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int32()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.string(), pa.map_(pa.string(), pa.string())]

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [r for r in map(described, batch.column(0).to_pylist(), batch.column(1).to_pylist()) if r]
            rows = [(*r[:-1], list(r[-1].items())) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return files.select("path", "length").mapInArrow(scan, OPENED)


def samples(raw: bytes, kind: str) -> np.ndarray:
    values = np.frombuffer(raw, kind)
    return np.abs(values).astype(np.float64) if values.dtype.kind == "c" else values.astype(np.float64)


def decoded(read, start: int, used: int, compression: str) -> Iterator[bytes]:
    """The data of a compressed block, piece by piece."""
    decoder, at = DECODERS[compression](), start
    while at < start + used:
        piece = read(at, min(CHUNK, start + used - at))
        at += len(piece)
        while piece:
            if compression == "zlib":
                yield decoder.decompress(piece, CHUNK)
                piece = decoder.unconsumed_tail
            else:
                yield decoder.decompress(piece, CHUNK)
                while not decoder.eof and not decoder.needs_input:
                    yield decoder.decompress(b"", CHUNK)
                piece = b""
    if compression == "zlib":
        yield decoder.flush()


def pieces(read, r: dict) -> Iterator[tuple[int, np.ndarray]]:
    """Samples of a block, or of a part of it, as (number of the first sample, values)."""
    width = np.dtype(r["kind"]).itemsize
    if not r["compression"]:
        yield r["first"], samples(read(r["start"] + r["first"] * width, r["n"] * width), r["kind"])
        return
    rest, skip, at, left = b"", r["size"], 0, r["n"]
    for piece in decoded(read, r["start"], r["used"], r["compression"]):
        cut = min(skip, len(piece))
        rest, skip = rest + piece[cut:], skip - cut
        n = min(len(rest) // width, left)
        if n:
            yield at, samples(rest[: n * width], r["kind"])
            rest, at, left = rest[n * width :], at + n, left - n
    if left:
        raise ValueError(f"{r['file']}: the block ends before its array does")


def read_arrays(arrays: DataFrame, first_plane: bool = False) -> DataFrame:
    """Samples (file, z, y, x, v) of opened arrays, all planes or the first one; complex samples by their modulus.

    A plain block is read by ranges of ROWS samples, each a row that Spark deals to tasks; a compressed one, which can only
    be read from its start, is streamed by one task.
    """
    total = F.col("height").cast("long") * F.col("width") * F.col("planes")
    parts = F.when(F.col("compression") == "", F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0).cast("long")), F.lit(ROWS).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    jobs = arrays.drop("header", "name").withColumn("total", total).where("total > 0").withColumn("first", F.explode(parts))
    jobs = jobs.withColumn("n", F.when(F.col("compression") == "", F.least(F.lit(ROWS).cast("long"), F.col("total") - F.col("first"))).otherwise(F.col("total")))

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                for at, v in pieces(ranges(r["file"]), r):
                    k = np.arange(at, at + len(v))
                    z = k % r["planes"] if r["last"] else k // (r["height"] * r["width"])
                    k = k // r["planes"] if r["last"] else k % (r["height"] * r["width"])
                    keep = z == 0 if first_plane else slice(None)
                    cols = [z[keep], (k // r["width"])[keep], (k % r["width"])[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(cols[0])), *(pa.array(c.astype(np.int32)) for c in cols), pa.array(v[keep])], names=["file", "z", "y", "x", "v"])

    return dealt(jobs, "file", "first").mapInArrow(scan, "file string, z int, y int, x int, v double")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images (file, z, y, x, v) of the ASDF files under a path: the first plane of each, and for a file without an array that
    of the .fits file beside it; an error where there is none, either."""
    files = listed(spark, path)
    arrays = open_arrays(files)
    bare = files.join(arrays.select(F.col("file").alias("path")), "path", "left_anti").withColumn("beside", F.regexp_replace("path", r"(?i)\.asdf$", ".fits"))
    there = fits.listed(spark, path).select(F.col("path").alias("beside"), F.col("length").alias("size"))
    asked = bare.join(there, "beside", "left")
    length = F.when(F.col("size").isNull(), F.raise_error(F.concat("path", F.lit(" has no image and no .fits file beside it"))).cast("long")).otherwise(F.col("size"))
    other = fits.images(fits.open_units(asked.select(F.col("beside").alias("path"), length.alias("length"))))
    return read_arrays(arrays, True).unionByName(fits.read_frames(other, F.col("z") == 0))


def encode(planes: np.ndarray, tree: dict | None = None, compression: str = "", name: str = "data", last: bool = False) -> bytes:
    """A file's content from an array; its dtype is kept, planes are moved to the end if asked. tree holds more nodes."""
    import yaml

    data = np.moveaxis(planes, 0, -1) if last and planes.ndim == 3 else planes
    code = next(k for k, v in KINDS.items() if np.dtype(v) == data.dtype.newbyteorder("=") and len(k) > 2)
    node = {"source": 0, "datatype": code, "byteorder": "big" if data.dtype.str[0] == ">" else "little", "shape": list(data.shape)}
    top = yaml.safe_dump((tree or {}) | {name: node}, sort_keys=False, default_flow_style=None)
    raw = data.tobytes()
    body = {"": lambda b: b, "zlib": zlib.compress, "bzp2": bz2.compress}.get(compression, lambda b: b)(raw)
    head = BLOCK_MAGIC + (48).to_bytes(2, "big") + bytes(4) + compression.encode().ljust(4, b"\0") + b"".join(n.to_bytes(8, "big") for n in (len(body), len(body), len(raw))) + bytes(16)
    return b"#ASDF 1.0.0\n#ASDF_STANDARD 1.5.0\n%YAML 1.1\n%TAG ! tag:stsci.edu:asdf/\n--- !core/asdf-1.1.0\n" + top.encode() + b"...\n" + head + body


def to_files(pixels: DataFrame, frame: str) -> DataFrame:
    """Each frame (y, x, v, kind, compression) as (frame, content); a frame is one file, so one task's work."""
    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.full((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.nan)
        plane[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["v"].to_numpy()
        own = {"meta": {"frame": str(pdf[frame].iloc[0])}}
        return pd.DataFrame({"frame": [str(pdf[frame].iloc[0])], "content": [encode(plane.astype(pdf["kind"].iloc[0]), own, pdf["compression"].iloc[0])]})

    return pixels.groupBy(frame).applyInPandas(build, "frame string, content binary")
