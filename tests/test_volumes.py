import gzip
import struct

import numpy as np
import pytest

from phasorlake.operators import signal
from phasorlake.sources import volumes


def _file(path, values, order="<", code=16, slope=0.0, intercept=0.0, second=False):
    """``values``: (x, y, z, t), written as they are; two members where compressed."""
    dim = [values.ndim, *values.shape] + [1] * (7 - values.ndim)
    head = bytearray(544 if second else 352)
    if second:
        struct.pack_into(order + "i4sxxxxh", head, 0, 540, b"n+2\0", code)
        struct.pack_into(order + "8q", head, 16, *dim)
        struct.pack_into(order + "q2d", head, 168, len(head), slope, intercept)
    else:
        struct.pack_into(order + "i", head, 0, 348)
        struct.pack_into(order + "8h", head, 40, *dim)
        struct.pack_into(order + "h", head, 70, code)
        struct.pack_into(order + "3f", head, 108, len(head), slope, intercept)
        head[344:348] = b"n+1\0"
    raw = bytes(head) + values.astype(order + volumes.TYPES[code]).tobytes(order="F")
    path.write_bytes(gzip.compress(raw[:400]) + gzip.compress(raw[400:]) if path.suffix == ".gz" else raw)


def _read(df, shape):
    got = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(got[:, :, r["z"], r["t"]]).all()  # once each
        got[:, :, r["z"], r["t"]] = np.reshape(r["values"], shape[:2], order="F")
    return got


@pytest.mark.parametrize(("name", "order", "code", "slope", "second"), [("a.nii", "<", 16, 0.0, False), ("b.nii", ">", 4, 0.5, False), ("c.nii.gz", "<", 512, 2.0, False), ("d.nii", ">", 64, 0.0, True), ("e.nii.gz", ">", 8, 0.0, True)])
def test_round_trip(spark, tmp_path, name, order, code, slope, second):
    values = np.random.default_rng(1).integers(0, 1000, (4, 3, 5, 11)).astype(float)
    _file(tmp_path / name, values, order, code, slope, 3.0 if slope else 0.0, second)
    expected = values * slope + 3 if slope else values
    df = volumes.read_volumes(spark, str(tmp_path / name), size=4 * 3 * 5 * 8 * 2)
    np.testing.assert_allclose(_read(df, values.shape), expected)
    assert df.rdd.getNumPartitions() == (1 if name.endswith("gz") else {16: 3, 4: 2, 64: 6}[code])
    some = _read(volumes.read_volumes(spark, str(tmp_path / name), "3:7"), values.shape)
    np.testing.assert_allclose(some[..., 3:7], expected[..., 3:7])
    assert np.isnan(some[..., :3]).all() and np.isnan(some[..., 7:]).all()


def test_folder_goes_to_parcels(spark, tmp_path):
    rng = np.random.default_rng(2)
    held = {n: rng.normal(size=(2, 3, 2, t)) for n, t in (("s1.nii", 4), ("s2.nii", 6), ("none.nii", 0))}
    for n, v in held.items():
        _file(tmp_path / n, v, code=64)
    (tmp_path / "notes.txt").write_text("no volume")
    _file(tmp_path / "still.nii", rng.normal(size=(2, 3, 2)), code=64)
    atlas = spark.createDataFrame([(c, c % 3) for c in range(12)], "channel long, roi int")
    rows = volumes.channels(volumes.read_volumes(spark, str(tmp_path / "s*.nii")))
    got = {(r["path"].rsplit("/", 1)[1], r["t"], r["roi"]): r["value"] for r in signal.parcellate(rows, atlas, ("path", "t")).collect()}
    assert len(got) == (4 + 6 + 1) * 3
    for (name, t, roi), value in got.items():
        if name != "still.nii":
            assert value == pytest.approx(held[name][..., t].reshape(-1, order="F")[roi::3].mean())
    assert volumes.read_volumes(spark, str(tmp_path)).count() == (4 + 6 + 1) * 2
    assert volumes.read_volumes(spark, str(tmp_path / "none.nii")).count() == 0


def test_what_is_no_volume(tmp_path):
    (tmp_path / "x.nii").write_bytes(b"\0" * 600)
    with pytest.raises(ValueError):
        volumes.Reader({"path": str(tmp_path / "x.nii")}).partitions()
    _file(tmp_path / "y.nii", np.zeros((2, 2, 2, 2)), code=64)
    (tmp_path / "y.nii").write_bytes((tmp_path / "y.nii").read_bytes()[:-1])
    reader = volumes.Reader({"path": str(tmp_path / "y.nii")})
    with pytest.raises(ValueError):
        [list(reader.read(p)) for p in reader.partitions()]
    with pytest.raises(FileNotFoundError):
        volumes.Reader({"path": str(tmp_path / "z.nii")}).partitions()
