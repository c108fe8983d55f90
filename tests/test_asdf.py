"""ASDF files: kinds of samples, blocks, layouts, trees, and what must be an error."""

import numpy as np
import pytest

from nebulark.sources import asdf, fits


def values(spark, folder, **kw):
    opened = asdf.open_arrays(asdf.listed(spark, str(folder)))
    return {(r.z, r.y, r.x): r.v for r in asdf.read_arrays(opened, **kw).collect()}


@pytest.mark.parametrize("compression", ["", "zlib", "bzp2"])
@pytest.mark.parametrize("kind", ["<f4", ">f4", "<f8", ">f8", "<i2", ">i2", "<i4", "<u2", ">u2", "u1", "<c8", ">c8"])
def test_kinds(spark, tmp_path, kind, compression):
    plane = (np.arange(35).reshape(5, 7) * (1 + 1j if "c" in kind else 1)).astype(kind)
    (tmp_path / "a.asdf").write_bytes(asdf.encode(plane, compression=compression))
    got = values(spark, tmp_path)
    assert got == pytest.approx({(0, y, x): float(abs(complex(plane[y, x]))) for y in range(5) for x in range(7)})


@pytest.mark.parametrize("compression", ["", "zlib"])
@pytest.mark.parametrize("shape, last", [((3, 5, 6), False), ((3, 5, 6), True), ((9, 5, 6), False)])
def test_planes(spark, tmp_path, monkeypatch, shape, last, compression):
    monkeypatch.setattr(asdf, "CHUNK", 64)
    cube = np.arange(np.prod(shape), dtype="<f4").reshape(shape)
    (tmp_path / "a.asdf").write_bytes(asdf.encode(cube, compression=compression, last=last))
    assert values(spark, tmp_path) == {(z, y, x): float(cube[z, y, x]) for z in range(shape[0]) for y in range(5) for x in range(6)}
    assert values(spark, tmp_path, first_plane=True) == {(0, y, x): float(cube[0, y, x]) for y in range(5) for x in range(6)}


def test_blocks_larger_than_a_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(asdf, "CHUNK", 1 << 12)
    monkeypatch.setattr(asdf, "ROWS", 1000)
    rng = np.random.default_rng(1)
    plane = rng.normal(size=(120, 130))
    for c in ("", "zlib", "bzp2"):
        (tmp_path / f"x{c}").mkdir()
        (tmp_path / f"x{c}" / "a.asdf").write_bytes(asdf.encode(plane, compression=c))
        got = values(spark, tmp_path / f"x{c}")
        assert len(got) == plane.size and all(got[0, y, x] == plane[y, x] for y, x in ((0, 0), (119, 129), (60, 3)))


def array(**more):
    return {"source": 0, "datatype": "float64", "shape": [2, 2]} | more


def test_arrays_of_trees():
    assert asdf.array_of({"sci": {"data": array()}})[0] == "sci"
    assert asdf.array_of({"roman": {"meta": {}, "data": array()}})[0] == "roman.data"
    assert asdf.array_of({"a": {"b": {"c": {"d": array()}}}})[0] == "a" and asdf.array_of({"a": {"b": {"c": {"d": {"e": {"f": array()}}}}}}) is None
    assert asdf.array_of({"meta": {"x": "1"}}) is None


def test_header(spark, tmp_path):
    tree = {"meta": {"instrument": {"name": "WFI", "gain": 1.5, "on": True}, "tags": ["a"], "none": None}, "wcs": {"crpix": [3, 4.5], "crval": [10.0, -20.0], "cdelt": [0.001, 0.002], "ctype": ["RA---SIN", "DEC--SIN"]}, "roman": {"meta": {"x": 1}}}
    (tmp_path / "a.asdf").write_bytes(asdf.encode(np.ones((2, 3), "<f4"), tree))
    (tmp_path / "unnamed").write_bytes(asdf.encode(np.ones((2, 3), "<f4"), {"gwcs": {"steps": [{"transform": {"type": "Shift", "offset": -5.0}}, {"transform": {"type": "Shift", "offset": -6}}, {"transform": {"type": "Scale", "factor": 0.1}}, {"transform": {"transform_type": "Pix2Sky_TAN"}}, {"transform": {"type": "RotateCelestial2D_TAN", "lon_0": 7}}, {"transform": {"type": "Affine", "matrix": [[0, 1], [1, 0]]}}, {"transform": {"type": "AffineTransformation2D", "matrix": [[0, -1], [1, 0]]}}, {"frame": "sky"}]}}))
    (tmp_path / "other.fits").write_bytes(b"no image")
    found = {r.file.rpartition("/")[2]: r.header for r in asdf.open_arrays(asdf.listed(spark, str(tmp_path))).collect()}
    assert set(found) == {"a.asdf", "unnamed"}
    a = found["a.asdf"]
    assert (a["NAXIS1"], a["NAXIS2"], a["CRPIX2"], a["CRVAL2"], a["CDELT1"], a["CTYPE1"], a["PC1_1"]) == ("3", "2", "4.5", "-20", "0.001", "RA---SIN", "1")
    assert (a["META_INSTRUMENT_NAME"], a["META_INSTRUMENT_GAIN"], a["META_INSTRUMENT_ON"], a["ROMAN_META_X"], a["ASDF_DATA_KEY"], a["ASDF_SRC"]) == ("WFI", "1.5", "true", "1", "data", "true")
    assert "META_TAGS" not in a and "META_NONE" not in a
    u = found["unnamed"]
    assert (u["CRPIX1"], u["CRPIX2"], u["CDELT1"], u["CDELT2"], u["CRVAL1"], u["PC1_2"]) == ("5", "6", "0.1", "1", "7", "-1")


def test_companions_and_faults(spark, tmp_path):
    empty = asdf.encode(np.ones((1, 1), "<f4")).replace(b"source: 0", b"sauces: 0")
    (tmp_path / "c.asdf").write_bytes(empty)
    (tmp_path / "c.fits").write_bytes(fits.encode(np.full((2, 2), 7.0)))
    (tmp_path / "d.asdf").write_bytes(asdf.encode(np.full((1, 2), 9.0)))
    got = sorted((r.file.rpartition("/")[2], r.y, r.x, r.v) for r in asdf.read_images(spark, str(tmp_path)).collect())
    assert got == [("c.fits", y, x, 7.0) for y in range(2) for x in range(2)] + [("d.asdf", 0, 0, 9.0), ("d.asdf", 0, 1, 9.0)]
    (tmp_path / "c.fits").unlink()
    with pytest.raises(Exception, match="no .fits file beside"):
        asdf.read_images(spark, str(tmp_path)).count()
    whole = asdf.encode(np.ones((4, 4)))
    faults = {"lz4": (asdf.encode(np.ones((2, 2)), compression="lz4"), "lz4 blocks can't be read"), "short": (whole[:-8], "cut short"), "magic": (b"#FDSA" + whole[5:], "not an ASDF file"), "kind": (whole.replace(b"float64", b"bool888"), "bool888 can't be read"), "source": (whole.replace(b"source: 0", b"source: 3"), "block 3 is missing")}
    for name, (data, match) in faults.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.asdf").write_bytes(data)
        with pytest.raises(Exception, match=match):
            values(spark, tmp_path / name)
    (tmp_path / "ref").mkdir()
    (tmp_path / "ref" / "jwst_nircam_flat_1.asdf").write_bytes(whole)
    with pytest.raises(Exception, match="calibration reference"):
        values(spark, tmp_path / "ref")
