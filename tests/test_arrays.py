"""Array files."""

from __future__ import annotations

import numpy as np
import pytest
from tessera.sources import arrays


def test_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    own = {"a/x.npy": np.arange(6, dtype="<i2").reshape(2, 3), "y.npy": np.array(2.5), "z.npy": np.zeros((0, 4), "<f4")}
    rows = spark.createDataFrame([(k, v.dtype.str, list(v.shape), bytearray(v.tobytes())) for k, v in own.items()], arrays.ARRAYS)
    arrays.write(rows, root)
    assert (np.load(tmp_path / "out" / "a" / "x.npy") == own["a/x.npy"]).all()
    np.save(tmp_path / "out" / "w.npy", np.asfortranarray(np.arange(6.0).reshape(2, 3)))
    back = {r.path[len(root) + 1 :]: r for r in arrays.arrays(spark, root).collect()}
    assert {k: (back[k].dtype, back[k].shape, bytes(back[k].data)) for k in own} == {k: (v.dtype.str, list(v.shape), v.tobytes()) for k, v in own.items()}
    assert np.frombuffer(back["w.npy"].data).tolist() == [0, 1, 2, 3, 4, 5]
    heads = arrays.arrays(spark, root, "shape array<int>, path string").collect()
    assert sorted(r.shape for r in heads) == [[], [0, 4], [2, 3], [2, 3]]
    with pytest.raises(Exception, match="exist"):
        arrays.write(rows, root)
    arrays.write(rows.limit(1), root, overwrite=True)
    numbers = arrays.unpacked(arrays.arrays(spark, root).where("path like '%x.npy'"), ["path"]).collect()
    assert [r["values"] for r in numbers] == [[0, 1, 2, 3, 4, 5]]
