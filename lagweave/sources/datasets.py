"""Loading panels from CSV, Parquet and tensor bundles, and storing results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .checkpoints import stored
from .tensors import parts, read_array, read_tensor

FORMATS = ("auto", "csv", "parquet", "causaltime", "npy")


@dataclass(frozen=True)
class Dataset:
    """Observations (traj_id, t, ts, variable, value), known edges and what was loaded."""

    observations: DataFrame
    available: list[str]
    columns: list[str]
    source_format: str
    ground_truth: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    def trajectory_count(self) -> int:
        return self.observations.select("traj_id").distinct().count()

    def trajectory(self, index: int) -> DataFrame:
        """One trajectory of the selected columns, a column per variable."""
        if index < 0 or index >= self.metadata.get("trajectories", 1):
            raise IndexError(f"no trajectory {index}")
        mine = self.observations.where((F.col("traj_id") == index) & F.col("variable").isin(*self.columns))
        return mine.groupBy("t").pivot("variable", self.columns).agg(F.first("value")).orderBy("t")

    def selected(self) -> DataFrame:
        return self.observations.where(F.col("variable").isin(*self.columns))


def chosen(requested: Sequence[str] | None, available: Sequence[str]) -> list[str]:
    """Requested columns without repeats, in order; unknown or no columns are errors."""
    names = list(dict.fromkeys(requested if requested is not None else available))
    if not names:
        raise ValueError("no column is selected")
    if unknown := [n for n in names if n not in available]:
        raise ValueError(f"unknown columns: {unknown}")
    return names


def long(df: DataFrame, names: Sequence[str], traj_id: int = 0) -> DataFrame:
    """Rows (t, ts, one column per variable) as observations."""
    ts = F.col("ts") if "ts" in df.columns else F.lit(None).cast("timestamp")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])).alias("v")
    return df.select(F.lit(traj_id).cast("long").alias("traj_id"), F.col("t").cast("long").alias("t"), ts.alias("ts"), each).select("traj_id", "t", "ts", "v.variable", "v.value")


def positions(df: DataFrame, *order: str) -> DataFrame:
    """Adds t, the position by order, counted per range of rows and shifted by the ranges before."""
    parted = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("n"))
    shift = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_rank", rank).join(F.broadcast(shift), "_part").withColumn("t", F.col("_rank") + F.col("_shift") - 1).drop("_part", "_rank", "_shift")


def load_table(spark: SparkSession, path: str, fmt: str, selected: Sequence[str] | None, date_column: str | None) -> Dataset:
    """A wide CSV or Parquet table: numeric columns become variables, sorted by the date column or in file order."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.csv(path, header=True, inferSchema=True)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != date_column]
    names = chosen(selected, numeric)
    if date_column:
        df = positions(df.withColumn("ts", F.to_timestamp(F.col(date_column))), "ts")
    else:
        df = positions(df.withColumn("_row", F.monotonically_increasing_id()), "_row")
    return Dataset(long(df, names), numeric, names, fmt, metadata={"path": path, "trajectories": 1})


def matrix_edges(spark: SparkSession, graph: np.ndarray, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Non-zero entries as edges row to column without the diagonal, lag unknown, both ends kept."""
    rows = [(names[i], names[j], None) for i, j in zip(*np.nonzero(graph), strict=True) if i != j and names[i] in keep and names[j] in keep]
    return spark.createDataFrame(rows, "source string, target string, lag int")


def load_daily_climate(spark: SparkSession, path: str) -> Dataset:
    """A CSV of daily climate whose column date is the index, in its order."""
    return load(spark, path, data_format="csv", date_column="date")


def load_tensor(spark: SparkSession, path: str, selected: Sequence[str] | None, graph_path: str | None, column_names: Sequence[str] | None, prefix: str, trajectory: int) -> Dataset:
    """A (trajectory, time, node) array and its square graph; only the graph's nodes are kept. tensors.py reads it."""
    beside = f"{path.rstrip('/')}/graph.npy" if not path.endswith(".npy") else f"{path.rpartition('/')[0]}/graph.npy" if "/" in path else "graph.npy"
    graph, shapes = read_array(graph_path or beside), [shape for _, shape in parts(path)]
    if any(len(s) != 3 or s[1:] != shapes[0][1:] for s in shapes) or graph.ndim != 2 or graph.shape[0] != graph.shape[1]:
        raise ValueError("a tensor of three dimensions and a square graph are needed")
    count, nodes = sum(s[0] for s in shapes), graph.shape[0]
    if shapes[0][2] < nodes:
        raise ValueError("the tensor has fewer channels than the graph has nodes")
    if not 0 <= trajectory < count:
        raise IndexError(f"no trajectory {trajectory}")
    digits = max(2, len(str(nodes - 1)))
    available = list(column_names) if column_names is not None else [f"{prefix}_{i:0{digits}d}" for i in range(nodes)]
    if len(available) != nodes:
        raise ValueError("one name per node is needed")
    names = chosen(selected, available)
    steps = read_tensor(spark, path, nodes)
    obs = steps.select("traj_id", "t", F.lit(None).cast("timestamp").alias("ts"), F.element_at(F.array(*map(F.lit, available)), F.col("node") + 1).alias("variable"), "value")
    meta = {"path": path, "trajectories": count, "ground_truth_is_symmetric": bool((graph == graph.T).all()), "trajectory": trajectory}
    return Dataset(obs, available, names, "causaltime", matrix_edges(spark, graph, available, names), meta)


def load(
    spark: SparkSession, path: str, *, data_format: str = "auto", selected_columns: Sequence[str] | None = None, date_column: str | None = None, graph_path: str | None = None,
    trajectory_index: int = 0, column_names: Sequence[str] | None = None, column_prefix: str = "variable",
) -> Dataset:
    """Loads a dataset; auto takes .csv as CSV, .parquet as Parquet and anything else as a tensor bundle."""
    if data_format not in FORMATS:
        raise ValueError(f"unknown format {data_format}")
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    suffix = Path(path).suffix.lower()
    fmt = {".csv": "csv", ".parquet": "parquet"}.get(suffix, "causaltime") if data_format == "auto" else data_format
    if fmt in ("csv", "parquet"):
        if trajectory_index:
            raise IndexError("a table has one trajectory")
        return load_table(spark, path, fmt, selected_columns, date_column)
    return load_tensor(spark, path, selected_columns, graph_path, column_names, column_prefix, trajectory_index)
