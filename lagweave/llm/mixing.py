"""Mixing sources to target weights: words per source, repetition rates, then whole copies and one seeded draw.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by weight. No target exceeds 3
times its source's words; the excess goes to the others by weight until none is above. A document is taken floor(rate)
times, rate being target / words of its source, and once more if a hash of its id falls below the fraction.

Edge cases: a null text has no words; a source without words has target 0 and its documents are taken once. Rows that
repeat an id draw alike; a null id draws by its text. An empty table gives an empty result. Extra columns of any name
stay, but for those of ADDED, and of _copy in emitted(), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

CYCLE = 3
MOST = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row per source.

    Ranks are counted per range of sources and shifted by the ranges before; only sums reach the driver.
    """
    parted = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    shift = parted.groupBy("part").agg(F.count("*").alias("n"))
    shift = shift.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = parted.withColumn("rank", rank).join(F.broadcast(shift), "part")
    weighed = stored(weighed.select("source", "source_size", ((F.col("rank") + F.col("shift")) % CYCLE + 1).alias("weight")))
    total, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    unit, full = total / weights if weights else 0.0, -1
    while True:
        above = F.col("weight") * F.lit(float(unit)) > F.col("source_size") * MOST
        size, rest, count = weighed.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if count == full or not rest:
            break
        unit, full = (total - MOST * (size or 0)) / rest, count
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(float(unit)), (F.col("source_size") * MOST).cast("double")).alias("target"))


def _draw(key: Column, text: Column) -> Column:
    """A number from 0 to 1 that depends on the id and the seed only."""
    seeded = F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(seeded), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


ADDED = ("_size", "_source_size", "_target", "_copies")


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, ...) with ADDED: _size, _source_size, _target and _copies of each row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = docs.select(row, size, F.col("source").cast("string").alias("own"))
    sizes = sized.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    joined = sized.join(targets, F.col("own").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(1.0)
    copies = F.floor(rate) + F.when(_draw(F.col("row.doc_id"), F.col("row.text")) < rate - F.floor(rate), 1).otherwise(0)
    added = dict(zip(ADDED, (F.col("size"), F.col("source_size"), F.col("target"), copies.cast("int")), strict=True))
    return joined.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *[x.alias(c) for c, x in added.items()])


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of mix(), each as often as it is taken, numbered by _copy from 1."""
    copy = F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")
    return mixed.where("_copies > 0").select(*[F.col(f"`{c}`") for c in mixed.columns if c != "_copy"], copy)
