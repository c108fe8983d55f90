"""ZIP bundles: members packed by tasks, written as parts and joined to one file; bundles listed and read member by member.

A bundle is one file, so its last step copies the parts' bytes one after another, in pieces of a bounded size; members are
compressed, checked and written by all tasks before that, and never gathered.
"""

from __future__ import annotations

import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nebulark.operators.lineage import checkpointed
from nebulark.sources.fits import dealt

#: Bytes that are copied at once.
PIECE = 4 << 20
#: The largest number of a plain record; what is beyond stands in an extra field.
LIMIT = 0xFFFFFFFF
#: The date of all members, the first that the format has.
DATE = 0x21


def store_of(path: str):
    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))


def packed(files: DataFrame) -> DataFrame:
    """Members (name, content) with crc, size, method (8 where packing makes them smaller, else 0) and body."""

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
                body = squeeze.compress(content) + squeeze.flush()
                method = 8 if len(body) < len(content) else 0
                row = [name, zlib.crc32(content), len(content), method, body if method else content]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["name", "crc", "size", "method", "body"])

    return files.select("name", "content").mapInArrow(pack, "name string, crc long, size long, method int, body binary")


def local_record(name: str, crc: int, size: int, method: int, packed: int) -> bytes:
    big = max(size, packed) > LIMIT
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if big else b""
    own = name.encode()
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, method, 0, DATE, crc, LIMIT if big else packed, LIMIT if big else size, len(own), len(extra)) + own + extra


def central_record(name: str, crc: int, size: int, method: int, packed: int, offset: int) -> bytes:
    big = max(size, packed, offset) > LIMIT
    extra = struct.pack("<HHQQQ", 1, 24, size, packed, offset) if big else b""
    own, cap = name.encode(), lambda n: LIMIT if big else n
    return struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45 if big else 20, 45 if big else 20, 0x800, method, 0, DATE, crc, cap(packed), cap(size), len(own), len(extra), 0, 0, 0, 0, cap(offset)) + own + extra


def end_record(count: int, size: int, offset: int) -> bytes:
    big = count > 0xFFFF or max(size, offset) > LIMIT
    wide = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, offset) + struct.pack("<IIQI", 0x07064B50, 0, offset + size, 1) if big else b""
    return wide + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, LIMIT), min(offset, LIMIT), 0)


def export(files: DataFrame, path: str) -> DataFrame:
    """Writes files (name, content) as one bundle, in the order of their names; one row with path, members and bytes.

    Tasks pack members and write each partition's records as a part beside the bundle; offsets are sums of the records'
    sizes, a small row a member; the last task joins the parts and adds the directory. Names must differ.
    """
    spark, parts = files.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    store, base = store_of(path)
    store.create_dir(base.rpartition("/")[0])
    rows = packed(files).repartitionByRange("name").sortWithinPartitions("name").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]):
        out, at = None, 0
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if out is None:
                        there, folder = store_of(parts)
                        there.create_dir(folder)
                        out = there.open_output_stream(f"{folder}/{r['part']}")
                    head = local_record(r["name"], r["crc"], r["size"], r["method"], len(r["body"]))
                    out.write(head)
                    out.write(r["body"])
                    row = [r["name"], r["crc"], r["size"], r["method"], len(r["body"]), r["part"], at]
                    at += len(head) + len(r["body"])
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*row, at], (*kinds, pa.int64()))], names=["name", "crc", "size", "method", "packed", "part", "at", "stop"])
        finally:
            if out is not None:
                out.close()

    entries = checkpointed(rows.mapInArrow(write, "name string, crc long, size long, method int, packed long, part int, at long, stop long"))
    if entries.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("two members have one name")
    sizes = entries.groupBy("part").agg(F.max("stop").alias("bytes"))  # a row a part
    sizes = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    listed = checkpointed(entries.join(F.broadcast(sizes), "part").select("name", "crc", "size", "method", "packed", "part", (F.col("at") + F.col("before")).alias("offset")))

    def join(batches: Iterator[pa.RecordBatch]):
        there, target = store_of(path)
        _, folder = store_of(parts)
        total = count = directory = 0
        with there.open_output_stream(target) as out:
            copied: set[int] = set()
            central = []
            for batch in batches:  # in the order of parts and offsets
                for r in batch.to_pylist():
                    if r["part"] not in copied:
                        copied.add(r["part"])
                        with there.open_input_stream(f"{folder}/{r['part']}") as source:
                            while piece := source.read(PIECE):
                                out.write(piece)
                                total += len(piece)
                    central.append(central_record(r["name"], r["crc"], r["size"], r["method"], r["packed"], r["offset"]))
                    count += 1
            for record in central:
                out.write(record)
                directory += len(record)
            tail = end_record(count, directory, total)
            out.write(tail)
        if count:
            there.delete_dir(folder)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([total + directory + len(tail)], pa.int64())], names=["path", "members", "bytes"])

    return checkpointed(listed.coalesce(1).sortWithinPartitions("offset").mapInArrow(join, "path string, members long, bytes long"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Members of the bundles under a path: bundle, name and size; only directories are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".zip")).select("path")

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = store_of(name)
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(infos)), pa.array([i.filename for i in infos]), pa.array([i.file_size for i in infos], pa.int64())], names=["bundle", "name", "size"])

    return found.mapInArrow(scan, "bundle string, name string, size long")


def contents(members: DataFrame) -> DataFrame:
    """name and content of members (bundle, name), dealt to tasks; each is read from its bundle by range."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for bundle, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = store_of(bundle)
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["name", "content"])

    return dealt(members.select("bundle", "name"), "bundle", "name").mapInArrow(scan, "name string, content binary")
