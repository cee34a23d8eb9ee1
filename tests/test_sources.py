import numpy as np
import pytest

from lagweave.sources import checkpoints, datasets


def test_csv_takes_numeric_columns_by_date(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("date,temperature,humidity,label\n2020-01-02,2,0.5,b\n2020-01-01,1,0.4,a\n")
    d = datasets.load(spark, str(f), date_column="date")
    assert d.columns == ["temperature", "humidity"] and d.source_format == "csv"
    assert [r.temperature for r in d.trajectory(0).collect()] == [1.0, 2.0]
    with pytest.raises(IndexError):
        d.trajectory(1)
    with pytest.raises(ValueError):
        datasets.load(spark, str(f), selected_columns=["nope"])
    with pytest.raises(FileNotFoundError):
        datasets.load(spark, str(tmp_path / "none.csv"))


def test_tensor_keeps_the_graphs_nodes(spark, tmp_path):
    x = np.arange(48, dtype=np.float32).reshape(2, 4, 6)
    graph = np.array([[1, 1, 0], [0, 1, 1], [0, 0, 1]])
    np.save(tmp_path / "gen_data.npy", x)
    np.save(tmp_path / "graph.npy", graph)
    d = datasets.load(spark, str(tmp_path / "gen_data.npy"), selected_columns=["variable_00", "variable_01"], trajectory_index=1)
    assert d.available == ["variable_00", "variable_01", "variable_02"] and d.trajectory_count() == 2
    assert [(r.source, r.target, r.lag) for r in d.ground_truth.collect()] == [("variable_00", "variable_01", None)]
    assert [r.variable_01 for r in d.trajectory(1).collect()] == x[1, :, 1].tolist()
    assert d.metadata["ground_truth_is_symmetric"] is False
    with pytest.raises(IndexError):
        datasets.load(spark, str(tmp_path / "gen_data.npy"), trajectory_index=2)


def test_checkpoints_resume(spark, tmp_path):
    path, config = str(tmp_path / "results"), {"alpha": 5}
    every = spark.createDataFrame([(i,) for i in range(4)], "trajectory_index int")
    assert checkpoints.pending(every, spark, path).count() == 4
    checkpoints.append(spark.createDataFrame([(0, False), (1, True)], "trajectory_index int, failed boolean"), path, config)
    assert sorted(r[0] for r in checkpoints.pending(every, spark, path).collect()) == [2, 3]
    assert sorted(r[0] for r in checkpoints.pending(every, spark, path, True).collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError):
        checkpoints.append(every, path, {"alpha": 6})
    made = []
    for _ in range(2):
        checkpoints.cached_edges(spark, str(tmp_path / "cache"), config, lambda: made.append(1) or every)
    assert made == [1]
