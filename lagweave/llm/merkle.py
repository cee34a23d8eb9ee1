"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in DataFrame functions only.

A text splits into paragraphs at line feeds and each paragraph into clauses after punctuation; nothing is lost, so
equal roots mean equal texts. Leaves are SHA-256 values of clauses, a paragraph hashes its leaves, a section hashes a
run of paragraphs that ends where a paragraph's hash is 0 modulo SECTION, which keeps sections aligned after an edit,
and the root hashes the sections. The fingerprint is the root, whole, and every branch below it by its first DIGITS
digits: "root|section=paragraph:leaf.leaf,paragraph:leaf;section=paragraph:leaf".

Two trees are compared from the root down: equal roots end it, then sections that the other tree has are left out,
then paragraphs. differing() numbers the paragraphs that are left; likeness() is the Dice coefficient of the distinct
leaves, counted from the leaves that are left.

Edge cases: null text is empty, one empty leaf. Neighbours are by ascending id, rows of an equal id by text hash, null
ids last, and the last row's neighbour is the first. Rows that repeat are each returned. An empty table gives none.
Extra columns of any name are ignored. An id that is no number is ordered as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import bucket_of, discard, ranges, stored

SECTION = 8
#: Hexadecimal digits that the fingerprint keeps of the hash of a leaf, paragraph or section; the root hashes whole ones.
DIGITS = 16
#: Rows of a range within which neighbours are found in one task, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 500, 8192
#: The end of a clause; what follows belongs to the next one.
CLAUSE = r"(?<=[.,;:!?|])"


def paragraphs(text: Column) -> Column:
    """The lower levels of the tree: per paragraph its leaves' hashes, its own, and whether a section ends after it."""
    leaves = F.transform(F.split(text, "\n"), lambda p: F.transform(F.split(p, CLAUSE), lambda c: F.sha2(c, 256)))
    hashed = F.transform(leaves, lambda p: F.struct(p.alias("leaves"), F.sha2(F.array_join(p, "."), 256).alias("hash")))
    ends = lambda p: F.pmod(F.conv(F.substring(p["hash"], 1, 8), 16, 10).cast("long"), F.lit(SECTION)) == 0
    return F.transform(hashed, lambda p: F.struct(p["leaves"].alias("leaves"), p["hash"].alias("hash"), F.when(ends(p), ";").otherwise(",").alias("mark")))


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is named in it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sections(parts: Column, written) -> Column:
    """What written(paragraph) gives, joined by commas, one string per section."""
    line = F.array_join(F.transform(parts, lambda p, i: F.concat(written(p), F.when(i < F.size(parts) - 1, p["mark"]).otherwise(""))), "")
    return F.split(line, ";")


def _written(parts: Column) -> Column:
    """The fingerprint of paragraphs()."""
    short = lambda x: F.substring(x, 1, DIGITS)
    branches = _sections(parts, lambda p: F.concat(short(p["hash"]), F.lit(":"), F.array_join(F.transform(p["leaves"], short), ".")))

    def with_root(hashes: Column) -> Column:
        below = F.array_join(F.zip_with(hashes, branches, lambda h, b: F.concat(short(h), F.lit("="), b)), ";")
        return F.concat(F.sha2(F.array_join(hashes, ","), 256), F.lit("|"), below)

    return _let(F.transform(_sections(parts, lambda p: p["hash"]), lambda s: F.sha2(s, 256)), with_root)


def fingerprint(text: Column) -> Column:
    return _let(paragraphs(text), _written)


def _root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def _branches(print_: Column) -> Column:
    """The sections of a fingerprint, each with its paragraphs and their leaves as text."""
    return F.split(F.substring_index(print_, "|", -1), ";")


def leaves(print_: Column) -> Column:
    """The leaves of a fingerprint, in order."""
    return F.transform(F.split(F.translate(F.substring_index(print_, "|", -1), ",;", ".."), "\\."), lambda x: F.substring_index(x, ":", -1))


def _paragraphs_of(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, "=", -1), ",")))


def _left(one: Column, two: Column) -> Column:
    """The paragraphs of the first tree's sections that the second tree lacks, looked for below the sections that it lacks."""
    return F.array_except(_paragraphs_of(F.array_except(one, two)), _paragraphs_of(two))


def _left_leaves(one: Column, two: Column, other: Column) -> Column:
    """The leaves below those paragraphs that are none of the other tree's leaves."""
    return F.array_except(F.flatten(F.transform(_left(one, two), lambda p: F.split(F.substring_index(p, ":", -1), "\\."))), other)


def likeness(one: Column, two: Column) -> Column:
    """From 0 to 1: the Dice coefficient of the distinct leaves; 1 for equal roots, found without a look below them."""
    trees = F.struct(_branches(one).alias("a"), _branches(two).alias("b"), F.array_distinct(leaves(one)).alias("x"), F.array_distinct(leaves(two)).alias("y"))
    apart = lambda t: F.size(_left_leaves(t["a"], t["b"], t["y"])) + F.size(_left_leaves(t["b"], t["a"], t["x"]))
    return F.when(_root(one) == _root(two), 1.0).otherwise(_let(trees, lambda t: 1 - apart(t) / (F.size(t["x"]) + F.size(t["y"]))))


def differing(one: Column, two: Column) -> Column:
    """The numbers, from 0, of the paragraphs of the first tree that the second lacks; none for equal roots."""
    none = F.expr("CAST(array() AS array<int>)")

    def numbers(t: Column) -> Column:
        marked = F.flatten(F.transform(t["a"], lambda s: _let(F.array_contains(t["inside"], s), lambda gone: F.transform(F.split(F.substring_index(s, "=", -1), ","), lambda p: F.struct(gone.alias("inside"), p.alias("paragraph"))))))
        numbered = F.transform(marked, lambda x, i: F.struct(i.alias("i"), x["inside"].alias("inside"), x["paragraph"].alias("paragraph")))
        return F.transform(F.filter(numbered, lambda x: x["inside"] & F.array_contains(t["gone"], x["paragraph"])), lambda x: x["i"])

    def descend(t: Column) -> Column:
        return _let(F.struct(t["a"].alias("a"), F.array_except(t["a"], t["b"]).alias("inside"), _left(t["a"], t["b"]).alias("gone")), numbers)

    return F.when(_root(one) == _root(two), none).otherwise(_let(F.struct(_branches(one).alias("a"), _branches(two).alias("b")), descend))


def changed(one: Column, two: Column) -> Column:
    """The number of the first paragraph, from 0, that the second tree lacks; null if there is none."""
    return F.get(differing(one, two), F.lit(0))


def next_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with print, the text's fingerprint, and next_text and next_print of the following row.

    Rows meet in a window per range of ids. Only texts are shuffled: fingerprints are made where rows meet. Only each range's
    first row crosses ranges; there are MOST_RANGES + 1 at most.
    """
    docs = docs.select("doc_id", "text")
    count = docs.count()
    number = isinstance(docs.schema["doc_id"].dataType, NumericType)
    cuts = ranges(docs, "doc_id", min(MOST_RANGES, count // RANGE_ROWS + 1)) if count and number else []
    bucket = bucket_of(F.col("doc_id"), cuts)
    parted = docs.withColumns({"_range": bucket, "_tie": F.xxhash64("text")})
    first = parted.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tie")).alias("f"))
    first = stored(first.select(F.col("_range").alias("range"), F.col("f.doc_id").alias("id"), F.col("f._tie").alias("tie")))
    every = Window.orderBy("range")
    order = first.select("range", F.coalesce(F.lead("range").over(every), F.min("range").over(every)).alias("after"))
    heads = parted.join(F.broadcast(first), (F.col("_range") == F.col("range")) & F.col("doc_id").eqNullSafe(F.col("id")) & F.col("_tie").eqNullSafe(F.col("tie")))
    heads = heads.select(F.col("range").alias("after"), "text").dropDuplicates(["after"]).select("after", F.struct("text", fingerprint(F.col("text")).alias("print")).alias("_after"))
    heads = stored(heads.join(F.broadcast(order), "after").select(F.col("range").alias("_range"), "_after"))
    discard(first)
    within = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_last(), F.col("_tie"))
    printed = parted.repartition("_range").withColumn("print", fingerprint(F.col("text")))
    joined = printed.withColumn("_next", F.lead(F.struct("text", "print")).over(within)).join(heads, "_range")
    nearest = F.coalesce("_next", "_after")
    return joined.select("doc_id", "text", "print", nearest["text"].alias("next_text"), nearest["print"].alias("next_print"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half, rounded down, replaced by as many first code points of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, with likenesses and the paragraphs that differ."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = next_rows(plain).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print")
    one, two, three = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_print")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(one, two).alias("near_edited"), likeness(one, three).alias("near_next"),
        differing(one, two).alias("lost_paragraphs"), differing(two, one).alias("new_paragraphs"),
    )
