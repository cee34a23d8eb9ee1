"""Arrays of (trajectory, time, node) as a Spark data source: .npy files, or folders of them, on any file system that Arrow opens.

A partition reads the bytes of its own block of trajectories and hands on the nodes that are asked for. Options: path,
block (trajectories a partition, 1 by default) and nodes (the first so many, all by default).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "panel_tensor"
SCHEMA = "traj_id bigint, t bigint, node int, value double"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Block(InputPartition):
    """Trajectories from first on, count of them, of one file, whose first trajectory has the number base."""

    path: str
    base: int
    first: int
    count: int

    def __init__(self, path: str, base: int, first: int, count: int):
        for name, value in (("path", path), ("base", base), ("first", first), ("count", count)):
            object.__setattr__(self, name, value)


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, kind of number, where the numbers begin) of a .npy file in row order."""
    files, name = _opened(path)
    with files.open_input_file(name) as f:
        version = np.lib.format.read_magic(f)
        shape, columns_first, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if columns_first and len(shape) > 1:
            raise ValueError("the tensor must be stored row by row")
        if kind.hasobject:
            raise ValueError("the tensor must hold numbers")
        return shape, kind, f.tell()


def parts(path: str) -> list[tuple[str, tuple[int, ...]]]:
    """The files of a tensor and their shapes: one, or those of a folder by name."""
    files, name = _opened(path)
    if files.get_file_info(name).type != fs.FileType.Directory:
        return [(path, header(path)[0])]
    found = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(name)) if i.base_name.endswith(".npy") and i.base_name != "graph.npy")
    if not found:
        raise FileNotFoundError(f"no array in {path}")
    return [(f"{path.rstrip('/')}/{n}", header(f"{path.rstrip('/')}/{n}")[0]) for n in found]


def read_array(path: str) -> np.ndarray:
    """A small array, whole."""
    files, name = _opened(path)
    with files.open_input_file(name) as f:
        return np.lib.format.read_array(f, allow_pickle=False)


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block, self.nodes = options["path"], int(options.get("block", 1)), options.get("nodes")

    def partitions(self) -> list[Block]:
        found, base = [], 0
        for path, shape in parts(self.path):
            if len(shape) != 3:
                raise ValueError("a tensor of three dimensions is needed")
            found += [Block(path, base, i, min(self.block, shape[0] - i)) for i in range(0, shape[0], self.block)]
            base += shape[0]
        return found

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        shape, kind, begin = header(partition.path)
        size = shape[1] * shape[2] * kind.itemsize
        nodes = min(int(self.nodes), shape[2]) if self.nodes else shape[2]
        files, name = _opened(partition.path)
        with files.open_input_file(name) as f:
            for i in range(partition.first, partition.first + partition.count):
                cells = np.frombuffer(f.read_at(size, begin + i * size), kind).reshape(shape[1:])[:, :nodes].astype(float)
                steps, n = cells.shape[0], cells.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, partition.base + i, np.int64)), pa.array(np.repeat(np.arange(steps, dtype=np.int64), nodes)), pa.array(np.tile(np.arange(nodes, dtype=np.int32), steps)), pa.array(cells.ravel())],
                    ["traj_id", "t", "node", "value"],
                )


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(dict(self.options))


def read_tensor(spark: SparkSession, path: str, nodes: int | None = None, block: int = 1) -> DataFrame:
    """(traj_id, t, node, value) of a tensor."""
    spark.dataSource.register(TensorSource)
    reader = spark.read.format(FORMAT).option("block", block)
    return (reader.option("nodes", nodes) if nodes else reader).load(path)


def _write(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    files, name = _opened(folder)

    def saved() -> pa.RecordBatch:
        cells = np.concatenate(held)
        if len(cells) % width:
            raise ValueError(f"trajectory {at} lacks cells")
        with files.open_output_stream(f"{name}/part-{at:010d}.npy") as out:
            np.lib.format.write_array(out, cells.reshape(1, -1, width), allow_pickle=False)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(cells) // width], pa.int64())], ["traj_id", "steps"])

    at, held = None, []
    for batch in batches:
        ids, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))) if len(ids) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if at is not None and ids[a] != at:
                yield saved()
                held = []
            at = int(ids[a])
            held.append(values[a:b])
    if held:
        yield saved()


def write_tensor(obs: DataFrame, folder: str, names: list[str]) -> DataFrame:
    """Writes each trajectory of obs(traj_id, t, variable, value) as a file of folder, its nodes in the order of names; returns (traj_id, steps).

    Trajectories are numbered by whole numbers; a later read numbers them by their order. A task holds one trajectory.
    """
    files, name = _opened(folder)
    files.create_dir(name, recursive=True)
    node = F.array_position(F.array(*map(F.lit, names)), F.col("variable"))
    rows = obs.where(F.col("variable").isin(*names)).select(F.col("traj_id").cast("long").alias("traj_id"), "t", node.alias("node"), F.col("value").cast("double").alias("value"))
    rows = rows.repartition("traj_id").sortWithinPartitions("traj_id", "t", "node").select("traj_id", "value")
    return rows.mapInArrow(lambda it: _write(it, folder, len(names)), "traj_id long, steps long")
