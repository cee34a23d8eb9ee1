"""Tensors written by tasks and read by blocks of trajectories."""

import numpy as np
import pytest

from lagweave.sources import tensors


def test_round_trip_and_blocks(spark, tmp_path):
    x = np.arange(7 * 5 * 3, dtype=np.float32).reshape(7, 5, 3)
    np.save(tmp_path / "x.npy", x)
    for block, nodes in ((1, None), (3, 2), (100, 9)):
        df = tensors.read_tensor(spark, f"file://{tmp_path}/x.npy", nodes, block)
        assert df.rdd.getNumPartitions() == -(-7 // block)
        got = {(r.traj_id, r.t, r.node): r.value for r in df.collect()}
        assert got == {(i, t, n): float(x[i, t, n]) for i in range(7) for t in range(5) for n in range(min(nodes or 3, 3))}
    rows = [(i, 10 * t, "abc"[n], float(x[i, t, n])) for i in range(7) for t in range(5) for n in range(3)]
    obs = spark.createDataFrame(rows, "traj_id long, t long, variable string, value double")
    folder = f"file://{tmp_path}/parts"
    assert {(r.traj_id, r.steps) for r in tensors.write_tensor(obs, folder, ["c", "a"]).collect()} == {(i, 5) for i in range(7)}
    assert [p[1] for p in tensors.parts(folder)] == [(1, 5, 2)] * 7
    again = {(r.traj_id, r.t, r.node): r.value for r in tensors.read_tensor(spark, folder).collect()}
    assert again == {(i, t, k): float(x[i, t, n]) for i in range(7) for t in range(5) for k, n in ((0, 2), (1, 0))}


def test_what_is_no_tensor(spark, tmp_path):
    np.save(tmp_path / "flat.npy", np.zeros((3, 4)))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.zeros((2, 3, 4))))
    np.save(tmp_path / "objects.npy", np.array([{}], object))
    for name in ("flat", "columns", "objects"):
        with pytest.raises(Exception, match="tensor"):
            tensors.read_tensor(spark, f"{tmp_path}/{name}.npy").collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no array"):
        tensors.read_tensor(spark, f"{tmp_path}/none").collect()
    ragged = spark.createDataFrame([(0, 0, "a", 1.0), (0, 0, "b", 1.0), (0, 1, "a", 1.0)], "traj_id long, t long, variable string, value double")
    with pytest.raises(Exception, match="lacks cells"):
        tensors.write_tensor(ragged, f"{tmp_path}/ragged", ["a", "b"]).collect()
