"""The FITS data source: the same samples however files are split, and conditions that narrow what is read."""

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from nebulark.sources import datasource, fits
from nebulark.sources.datasource import Reader


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("fits")
    cube = np.arange(4 * 30 * 20, dtype=float).reshape(4, 30, 20)
    (path / "a.fits").write_bytes(fits.encode(cube) + fits.encode(np.full((6, 5), 7.0), bitpix=16).replace(b"SIMPLE  = ", b"XTENSION= ", 1))
    (path / "b.fit").write_bytes(fits.encode(np.zeros((3, 300)) + np.arange(300), bitpix=-64))
    (path / "c.txt").write_text("no image")
    return str(path)


@pytest.mark.parametrize("split", [1000, 2881, 1 << 20])
def test_all_samples(spark, folder, split):
    datasource.register(spark)
    got = spark.read.format("fits").option("split", split).load(folder)
    rows = {(r.file[-5:], r.hdu, r.z, r.y, r.x): r.v for r in got.collect()}
    want = {("a.fits"[-5:], 0, z, y, x): float(z * 600 + y * 20 + x) for z in range(4) for y in range(30) for x in range(20)}
    want |= {(".fits", 1, 0, y, x): 7.0 for y in range(6) for x in range(5)} | {("b.fit", 0, 0, y, x): float(x) for y in range(3) for x in range(300)}
    assert rows == pytest.approx(want)
    part = got.where("z = 2 AND y >= 5 AND y < 8 AND hdu = 0 AND file LIKE '%a.fits'")
    assert {(r.z, r.y, r.x) for r in part.collect()} == {(2, y, x) for y in range(5, 8) for x in range(20)}
    spark.sql(f"CREATE TEMPORARY VIEW fits_files_{split} USING fits OPTIONS (path '{folder}')")
    assert spark.sql(f"SELECT count(*) FROM fits_files_{split} WHERE hdu = 1").first()[0] == 30


def test_conditions_narrow_reading(folder, monkeypatch):
    reader = Reader(folder, 4000)
    name = next(p.file for p in reader.partitions() if p.file.endswith("a.fits"))
    left = list(reader.pushFilters([EqualTo(("file",), name), In(("z",), (1, 3)), GreaterThanOrEqual(("y",), 28), LessThan(("x",), 4), EqualTo(("hdu",), 0)]))
    assert left == [LessThan(("x",), 4)]
    assert {p.file for p in reader.partitions()} == {name} and len(reader.partitions()) < len(Reader(folder, 4000).partitions())
    read = []
    whole = fits.ranges(name)
    monkeypatch.setattr(datasource, "ranges", lambda n: lambda start, size: read.append(size) or whole(start, size))
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in rows) == 2 * 2 * 20
    assert sum(n for n in read if n != fits.BLOCK) == 2 * 2 * 20 * 4  # four rows of samples, and headers


def test_short_file(spark, tmp_path):
    (tmp_path / "s.fits").write_bytes(fits.encode(np.ones((50, 60)))[:-5000])
    datasource.register(spark)
    with pytest.raises(Exception, match="ends before its image"):
        spark.read.format("fits").load(str(tmp_path)).count()
