"""Removal of repeated runs of lines by winnowing over line hashes, in DataFrame functions only.

A run of consecutive lines with at least min_words words counts as repeated when the same lines stand earlier, by
(doc_id, line). The later run goes; the first stays. Steps:

1. from each line, the shortest windows of at least min_words words to its right and to its left; the line with the
   smallest hash in a window is its fingerprint, the first of equal ones. Only these positions are kept, each with the
   windows that chose it. Equal windows have equal fingerprints, so none is missed;
2. positions are joined by fingerprint: those whose fingerprint stands at one position only are done with;
3. the others are extended both ways, by the hashes of the lines to the left and to the right of the position, to the
   ends of their windows; positions that agree on all three match, and the first of them is their origin;
4. later windows that overlap or touch are one run, and its lines are deleted.

No pair of positions is ever listed: each match is reduced to its first position, whatever its count, and the joins
deal frequent fingerprints and matches to several tasks.

Edge cases: null text stays null. Blank lines count no words, split no run and go only within one. Rows that repeat an
id and text are one document. Null ids come after all others, ties between texts are broken by their hash. Within one
document the first of overlapping equal windows stays whole. An empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, salted_join, stored

_KEY = ["_doc", "_hash"]


def _place(*columns: str) -> Column:
    return F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_hash", *columns)


def _lines(docs: DataFrame) -> DataFrame:
    """A row per document: where its lines with words stand, their hashes and words."""
    lines = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    rows = docs.select(*_KEY, F.filter(lines, lambda x: x["words"] > 0).alias("lines")).where(F.size("lines") > 0)
    return rows.dropDuplicates(_KEY)


def _fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """A row per position that some window chose: its line's number, hash and the windows, as numbers of lines."""
    each = lines.repartition(*_KEY).select(*_KEY, F.posexplode("lines").alias("i", "line")).select(*_KEY, "i", "line.h", "line.words")
    before = Window.partitionBy(*_KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum("words").over(before)).withColumn("begin", F.col("end") - F.col("words"))
    found = []
    for by, frame in (("begin", (0, min_words - 1)), ("end", (1 - min_words, 0))):
        over = Window.partitionBy(*_KEY).orderBy(by).rangeBetween(*frame)
        ends = F.min("i").over(over), F.max("i").over(over)
        found.append(F.struct(F.struct(ends[0].alias("first"), ends[1].alias("last")).alias("span"), F.sum("words").over(over).alias("words"), F.min(F.struct("h", "i")).over(over).alias("least")))
    each = each.select(*_KEY, F.array(*found).alias("both")).select(*_KEY, F.explode("both").alias("w")).where(F.col("w.words") >= min_words)
    return each.groupBy(*_KEY, F.col("w.least.i").alias("at"), F.col("w.least.h").alias("mark")).agg(F.collect_set("w.span").alias("windows"))


def _extended(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """A row per window of anchors(doc, at, mark, windows): its lines' places and the hashes to both sides of the position."""
    per_doc = anchors.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "mark", "windows")).alias("anchors"))
    both = per_doc.toDF("_doc2", "_hash2", "anchors").join(lines, F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_hash") == F.col("_hash2")))
    each = both.select(*_KEY, F.col("lines.pos").alias("pos"), F.col("lines.h").alias("h"), F.explode("anchors").alias("a"))
    each = each.select(*_KEY, "pos", "h", "a.at", "a.mark", F.explode("a.windows").alias("w"))
    return each.select(
        *_KEY, "mark", F.get("pos", F.col("w.first")).alias("first"), F.get("pos", F.col("w.last")).alias("last"),
        F.xxhash64(F.slice("h", F.col("w.first") + 1, F.col("at") - F.col("w.first"))).alias("left"),
        F.xxhash64(F.lit(1), F.slice("h", F.col("at") + 2, F.col("w.last") - F.col("at"))).alias("right"),
    )


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(_doc, _hash, _runs) for docs(_doc, _hash, _text) that lose lines; _runs are first and last lines, in order."""
    lines = stored(_lines(docs))
    prints = stored(_fingerprints(lines, min_words))
    marks = stored(prints.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"))
    anchors = salted_join(prints, marks, ["mark"], F.xxhash64(*_KEY, "at"))
    windows = stored(_extended(anchors, lines))
    match = ["mark", "left", "right"]
    origin = windows.groupBy(*match).agg(F.min(_place("first", "last")).alias("from"), F.max(_place("first", "last")).alias("to"), F.count("*").alias("n"))
    origin = stored(origin.where("from <> to").drop("to"))
    later = salted_join(windows, origin, match, F.xxhash64(*_KEY, "first")).where(_place("first", "last") > F.col("from"))
    same = F.col("_doc").eqNullSafe(F.col("from._doc")) & (F.col("_hash") == F.col("from._hash"))
    start = F.when(same, F.greatest("first", F.col("from.last") + 1)).otherwise(F.col("first"))
    later = later.select(*_KEY, start.alias("first"), "last").distinct()
    order = Window.partitionBy(*_KEY).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(reach + 1 >= F.col("first"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = later.groupBy(*_KEY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = stored(runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_runs")))
    discard(lines, prints, marks, windows, origin)
    return found


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs(doc_id, text, ...) with the later repeated runs cut from text, and _n_lines, _n_removed beside it.

    Input columns of these two names are replaced; all others go through whole.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    runs = repeated_runs(keyed.select(*_KEY, "_text"), min_words).select(F.col("_doc").alias("_doc2"), F.col("_hash").alias("_hash2"), "_runs")
    joined = keyed.join(runs.hint("merge"), keyed["_doc"].eqNullSafe(F.col("_doc2")) & (keyed["_hash"] == F.col("_hash2")), "left")
    lines = F.split("_text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.exists("_runs", lambda r: i.between(r["first"], r["last"])))
    cut = F.col("_runs").isNotNull()
    removed = F.aggregate("_runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    text = F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("_text")).alias("text")
    return joined.select(
        *[text if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("_n_lines", "_n_removed")],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("_n_lines"), F.when(cut, removed).otherwise(0).cast("long").alias("_n_removed"),
    )
