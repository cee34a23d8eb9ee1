"""Helpers that the operators share: intermediate tables, code-point ranges, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.checkpoints import shared_folder

#: Word separators of the contracts: space and the five ASCII controls from tab to carriage return.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task turns few texts into Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the order that are counted at once; a round has at most 2 ** bits counts a stratum.
DIGITS = (15, 16, 16, 16)


def _last_values(rows: DataFrame, sizes: dict) -> dict:
    """By stratum k of rows(k, u), the value of u up to which there are sizes[k] rows, and at most as many too many.

    Counts per leading digits are refined in the one group that holds the last row wanted, until that is small or a
    single value. Only counts reach the driver, whatever the number of rows or of equal ones.
    """
    found, open_, shift = {}, {k: (0, n) for k, n in sizes.items()}, sum(DIGITS)
    for bits in DIGITS:
        some = rows
        if shift < sum(DIGITS):
            groups = rows.sparkSession.createDataFrame([(k, p) for k, (p, _) in open_.items()], StructType([rows.schema["k"], StructField("p", LongType())])).withColumnRenamed("k", "k2")
            some = rows.join(F.broadcast(groups), F.col("k").eqNullSafe(F.col("k2")) & (F.shiftright("u", shift) == F.col("p")))
        shift -= bits
        counts: dict = {k: [] for k in open_}
        for r in some.groupBy("k", F.shiftright("u", shift).alias("b")).count().collect():
            counts[r["k"]].append((r["b"], r["count"]))
        todo = {}
        for k, (_, left) in open_.items():
            for b, n in sorted(counts[k]):
                if n >= left:
                    if n <= sizes[k] or not shift:
                        found[k] = ((b + 1) << shift) - 1
                    else:
                        todo[k] = (b, left)
                    break
                left -= n
            else:
                found[k] = (1 << sum(DIGITS)) - 1
        open_ = todo
        if not open_:
            break
    return found


def hashed_sample(df: DataFrame, order: str, size: int | dict, by: str | None = None) -> DataFrame:
    """The first size rows by a 64-bit hash column, read as unsigned; with by, the first size[value] of each value.

    Equal rows are counted, not moved: up to twice the size distinct rows leave the tasks, however often each occurs.
    """
    sizes = size if by else {0: size}
    half, stratum = F.shiftrightunsigned(order, 1), F.col(by) if by else F.lit(0)
    rows = df.select(stratum.alias("k"), half.alias("u"))
    last = [(k, u, sizes[k]) for k, u in _last_values(rows, sizes).items()]
    cuts = df.sparkSession.createDataFrame(last, StructType([StructField("_k", rows.schema["k"].dataType), StructField("_last", LongType()), StructField("_size", LongType())]))
    near = df.join(F.broadcast(cuts), stratum.eqNullSafe(F.col("_k"))).where(half <= F.col("_last"))
    counted = near.groupBy(*df.columns, "_size").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(half, *df.columns).rowsBetween(Window.unboundedPreceding, 0)
    take = F.least(F.col("_n"), F.col("_size") - F.sum("_n").over(over) + F.col("_n"))
    taken = counted.withColumn("_take", take).where("_take > 0").withColumn("_take", F.explode(F.sequence(F.lit(1), F.col("_take").cast("int"))))
    return taken.select(*df.columns)


#: Keys that are looked up before a join for the number of tasks that their rows go to, at most; rows a task from which a key is split, at least.
HOT_KEYS, HOT_ROWS = 100_000, 1024


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], salt: Column, count: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with keys, which has one row per value of on and, in count, how many of rows have it.

    The most frequent keys go to as many tasks as they hold HOT_ROWS, or twice as many rows, and so on, until at most HOT_KEYS
    keys are split; only those are broadcast. salt is a hash of a row that differs among the rows of one key. The join itself
    is by sorting at every size, since keys grows with the rows.
    """
    power = F.floor(F.log2(F.col(count))).cast("int")
    most, least = 0, HOT_ROWS.bit_length() - 1
    for p, n in sorted(((r["p"], r["count"]) for r in keys.groupBy(power.alias("p")).count().collect()), reverse=True):
        if most + n > HOT_KEYS:
            least = max(least, p + 1)
            break
        most += n
    parts = F.ceil(F.col(count) / F.lit(float(1 << least))).cast("int")
    hot = keys.where(F.col(count) > (1 << least)).select(*on, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(salt, F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    spread = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > (1 << least), parts - 1).otherwise(0))))
    return dealt.join(spread.drop(count).hint("merge"), [*on, "_salt"], how).drop("_salt")


def keyed(rows: DataFrame, columns: str) -> StructType:
    """The schema of rows' column key, whatever its type, followed by columns."""
    return StructType([StructField("key", rows.schema["key"].dataType), *StructType.fromDDL(columns).fields])


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of links(a, b); component is the smallest id reachable.

    Each round hooks every component to its smallest neighbour, jumps twice along those pointers and contracts the
    links. A hub's links meet in partial aggregates and, where adaptive execution splits it, in several tasks of the joins
    on them. Rounds end when no link joins two components. Only the
    last round's tables are kept.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = stored(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("component", F.col("id")))
    while links.head(1):
        both = links.union(links.select("b", "a")).toDF("node", "peer")
        near = stored(both.groupBy("node").agg(F.least(F.min("peer"), F.first("node")).alias("up")))
        hook = near
        for _ in range(2):
            over = hook.select(F.col("node").alias("up"), F.col("up").alias("next"))
            hook = hook.join(over, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
        hook = stored(hook)
        placed = stored(
            labels.join(hook.select(F.col("node").alias("component"), "up"), "component", "left")
            .select("id", F.coalesce("up", "component").alias("component"))
        )
        one, two = (hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        left = stored(
            links.join(one, "a").join(two, "b")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
            .where("a <> b").distinct()
        )
        discard(near, hook, labels, links)
        labels, links = placed, left
    discard(links)
    return labels


def ranges(df: DataFrame, key: str, parts: int) -> list:
    """Up to parts - 1 cut points that split df evenly by key (approximate quantiles; only these reach the driver)."""
    df = df.where(F.col(key).isNotNull()).select(key)
    if parts < 2 or not df.head(1):
        return []
    cuts = df.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts)
    return sorted(set(cuts))


def bucket_of(key: Column, cuts: list) -> Column:
    """The number of cut points at or below key, counted in blocks first; nulls come after all others."""
    if not cuts:
        return F.when(key.isNull(), F.lit(1)).otherwise(F.lit(0))
    step = max(1, round(len(cuts) ** 0.5))
    below = lambda points: F.size(F.filter(points, lambda c: c <= key))
    whole = below(F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]))
    rest = below(F.slice(F.array(*[F.lit(c) for c in cuts]), whole * step + 1, F.lit(step)))
    return F.when(key.isNull(), F.lit(len(cuts) + 1)).otherwise(whole * step + rest)
