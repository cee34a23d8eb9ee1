"""N-gram Jaccard join by prefix filters under several global orders, and the components of its links.

A document is the set of its distinct k-word shingles (64-bit hashes). Two documents link when 100 * intersection >=
percent * union. Every linked pair shares a token in its prefixes, whatever the global order:

* order A puts tokens that recur in many documents last and sorts the rest by hash, so that the prefixes of documents
  that merely hold the same passage or template rarely meet. Candidates come from equal tokens here, kept only if
  lengths and positions leave room for the overlap. Tokens that no chunk shows to recur but that stand in more than
  HEAVY prefixes, counted over all documents, are put last as well, and the prefixes that hold them are made again;
* orders B and C are two unrelated hash orders. A linked pair shares at least l tokens of its first p + l - 1 there
  (p: prefix length). Candidates must pass under both before their whole sets are compared.

Copies: equal sets are one class and enter once. Each token's documents are first compared with one centre only; the
components of those links then stand for their members, and a second round compares a token's documents outside the
centre's component with its other documents. So a group of mutual near copies costs as many pairs as it has members.

Edge cases: null text and text without words have no shingles and link with nothing. A null id takes part in nothing
and has a null component. Ids are whole numbers; other types are refused. Rows that repeat an id and text are one
document (each row is returned); classes of different texts with the same smallest id count as one node. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import connected_components, discard, pieces, salted_join, stored
from .hashing import U, mix, shingles

#: Documents and tokens of the chunks in which recurring tokens are counted; a common token recurs so often in some chunk.
CHUNK_DOCS, CHUNK_TOKENS, CHUNK_LEAST = 8192, 4_000_000, 3
#: Most common tokens that are told apart (12 MB); the rest keep their hash order, which is as right an order.
MOST_COMMON = 1 << 20
#: Documents with a token in their prefix from which it counts as common after all, and turns of looking for such tokens.
HEAVY, TURNS = 256, 3
#: Ids of documents to verify that are broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_ORDERS = (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(1).cast(pa.binary()).to_pylist()


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row per document with its set's size and digest; rows without digest hold tokens that recur in a chunk."""

    def recurring() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(kept), return_counts=True)
        token, count = token[count >= CHUNK_LEAST], count[count >= CHUNK_LEAST]
        return pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([-1], pa.int32()), *[pa.array([None], pa.int64())] * 2, _lists([_signed(token)], pa.int64()), _lists([count], pa.int32())], names
        )

    names = ["doc_id", "n", "d1", "d2", "tokens", "counts"]
    kept: list[np.ndarray] = []
    size = 0
    for batch in pieces(batches, 1024):
        n, d1, d2 = [], [], []
        for text in _texts(batch):
            found = shingles(text, k)
            n.append(len(found))
            digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
            d1.append(digest and int.from_bytes(digest[:8], "little", signed=True))
            d2.append(digest and int.from_bytes(digest[8:], "little", signed=True))
            kept.append(found)
            size += len(found)
            if len(kept) >= CHUNK_DOCS or size >= CHUNK_TOKENS:
                yield recurring()
                kept, size = [], 0
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(len(n), pa.list_(pa.int64())), pa.nulls(len(n), pa.list_(pa.int32()))], names
        )
    if kept:
        yield recurring()


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signatures(batches: Iterator[pa.RecordBatch], k: int, percent: int, common) -> Iterator[pa.RecordBatch]:
    """Per document: set digest, prefix under order A, and the longer prefixes under B and C as distinct 32-bit values.

    need: tokens that a linked pair shares under B or C at least, less what equal 32-bit values may hide.
    """
    token, rank = common.value
    for batch in pieces(batches, 1024):
        ids, n, d1, d2, first, more, need = [], [], [], [], [], ([], []), ([], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
            found = shingles(text, k)
            if not len(found) or doc_id is None:
                continue
            digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            p = _prefix(len(found), percent)
            at = np.minimum(np.searchsorted(token, found), max(len(token) - 1, 0))
            often = token[at] == found if len(token) else np.zeros(len(found), bool)
            last = found[often][np.argsort(rank[at[often]], kind="stable")] if often.any() else found[:0]
            ids.append(doc_id)
            n.append(len(found))
            d1.append(int.from_bytes(digest[:8], "little", signed=True))
            d2.append(int.from_bytes(digest[8:], "little", signed=True))
            first.append(_signed(np.concatenate((found[~often], last))[:p]))
            shared = min((p + 1) // 2, len(found) - p + 1)
            for i, seed in enumerate(_ORDERS):
                key = mix(found ^ seed)
                length = min(p + shared - 1, len(key))
                head = np.partition(key, length - 1)[:length] if length < len(key) else key
                short = np.unique((head >> U(32)).astype(np.uint32)).view(np.int32)
                more[i].append(short)
                need[i].append(shared - (length - len(short)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(first, pa.int64()), _lists(more[0], pa.int32()), _lists(more[1], pa.int32()), pa.array(need[0], pa.int32()), pa.array(need[1], pa.int32())],
            ["doc_id", "n", "d1", "d2", "prefix", "b", "c", "need_b", "need_c"],
        )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1024):
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([_signed(shingles(t, k)) for t in _texts(batch)], pa.int64())], ["doc_id", "tokens"])


def _common_tokens(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(Tokens in ascending order, their rank by document count), at most MOST_COMMON of them."""
    pairs = profile.where("n < 0").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t")).select("t.tokens", "t.counts")
    often = pairs.groupBy(F.col("tokens").alias("token")).agg(F.sum("counts").alias("df"))
    often = stored(often.withColumn("step", F.floor(F.log2("df") * 8).cast("int")))
    kept, least = 0, 0
    for step, count in sorted(((r["step"], r["count"]) for r in often.groupBy("step").count().collect()), reverse=True):
        kept, least = kept + count, step
        if kept > MOST_COMMON:
            least = step + 1
            break
    rows = often.where(F.col("step") >= least).select("token", "df").toPandas().sort_values(["df", "token"], ascending=[False, True])
    token = rows["token"].to_numpy(np.int64).view(U)
    order = np.argsort(token)
    discard(often)
    return token[order], -np.arange(len(token), dtype=np.int64)[order]


def _signed_documents(docs: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(common)
    return docs.mapInArrow(
        lambda it: _signatures(it, k, percent, shared),
        "doc_id long, n int, d1 long, d2 long, prefix array<long>, b array<int>, c array<int>, need_b int, need_c int",
    )


def _heavy_tokens(centres: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tokens that stand in more than HEAVY prefixes and aren't common yet, the most frequent first; common ones stay below 2 * MOST_COMMON."""
    room = max(2 * MOST_COMMON - len(common[0]), 0)
    rows = centres.where(F.col("size") > HEAVY).orderBy(F.desc("size"), "token").limit(room).select("token").toPandas()
    found = rows["token"].to_numpy(np.int64).view(U)
    at = np.minimum(np.searchsorted(common[0], found), max(len(common[0]) - 1, 0))
    return found[common[0][at] != found] if len(common[0]) else found


def _room(one: str, two: str, percent: int) -> Column:
    """Whether sizes and positions of an equal token leave room for enough overlap; true for a linked pair's first one."""
    n, m = F.col(f"{one}.n").cast("long"), F.col(f"{two}.n").cast("long")
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    left = F.least(n - F.col(f"{one}.pos"), m - F.col(f"{two}.pos"))
    return fits & (left * (100 + percent) >= (n + m) * percent)


def _verified(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that pass under orders B and C and then link by their whole sets."""
    side = [signatures.select(F.col("doc_id").alias(x), F.struct("b", "c", "need_b", "need_c").alias(f"s{x}")) for x in "ab"]
    both = pairs.join(side[0], "a").join(side[1], "b")
    for order in "bc":
        both = both.where(F.size(F.array_intersect(f"sa.{order}", f"sb.{order}")) >= F.least(f"sa.need_{order}", f"sb.need_{order}"))
    passed = stored(both.select("a", "b").distinct())
    ids = passed.select(F.col("a").alias("doc_id")).union(passed.select("b")).distinct()
    if passed.count() <= BROADCAST_IDS // 2:
        ids = F.broadcast(ids)
    sets = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lambda it: _sets(it, k), "doc_id long, tokens array<long>")
    sets = stored(sets.dropDuplicates())
    side = [sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab"]
    met = passed.join(side[0], "a").join(side[1], "b").withColumn("met", F.size(F.array_intersect("ta", "tb")))
    found = stored(met.where(F.col("met") * (100 + percent) >= (F.size("ta") + F.size("tb")) * percent).select("a", "b").distinct())
    discard(passed, sets)
    return found


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = stored(docs.mapInArrow(lambda it: _profile(it, k), "doc_id long, n int, d1 long, d2 long, tokens array<long>, counts array<int>"))
    rows = profile.where("n >= 0")
    classes = stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    kept = classes.select("d1", "d2", F.col("rep").alias("doc_id"))
    common = _common_tokens(profile)
    signatures = _signed_documents(docs, k, percent, common).join(kept, ["d1", "d2", "doc_id"], "left_semi")
    signatures = stored(signatures.dropDuplicates(["d1", "d2", "doc_id"]))
    for turn in range(TURNS + 1):
        tokens = signatures.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
        centres = stored(tokens.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("pos", "n", "doc_id")).alias("centre")).where("size > 1"))
        heavy = _heavy_tokens(centres, common) if turn < TURNS else []
        if not len(heavy):
            break
        old, discarded = signatures, centres
        common = np.concatenate((common[0], heavy)), np.concatenate((common[1], -len(common[0]) - np.arange(len(heavy), dtype=np.int64)))
        order = np.argsort(common[0])
        common = common[0][order], common[1][order]
        again = spark.createDataFrame(pd.DataFrame({"token": _signed(heavy)}), "token long")
        ids = stored(tokens.join(F.broadcast(again), "token").select("doc_id").distinct())
        renewed = _signed_documents(docs.join(ids, "doc_id", "left_semi"), k, percent, common).join(kept, ["d1", "d2", "doc_id"], "left_semi").dropDuplicates(["d1", "d2", "doc_id"])
        signatures = stored(old.join(ids, "doc_id", "left_anti").unionByName(renewed))
        discard(old, discarded, ids)

    shared = stored(salted_join(tokens, centres.select("token", "centre", "size"), ["token"], F.xxhash64("doc_id"), "size").select("token", F.struct("doc_id", "n", "pos").alias("x"), "centre"))
    discard(centres)

    first = shared.where("x.doc_id <> centre.doc_id").where(_room("x", "centre", percent))
    first = stored(first.select(F.least("x.doc_id", "centre.doc_id").alias("a"), F.greatest("x.doc_id", "centre.doc_id").alias("b")).distinct())
    links = _verified(first, signatures, docs, k, percent)

    parts = connected_components(links)
    own, core = parts.select(F.col("id").alias("own_id"), F.col("component").alias("own")), parts.select(F.col("id").alias("core_id"), F.col("component").alias("core"))
    placed = shared.join(own, F.col("x.doc_id") == F.col("own_id"), "left").join(core, F.col("centre.doc_id") == F.col("core_id"), "left")
    placed = stored(placed.select("token", "x", F.coalesce("own", "x.doc_id").alias("own"), F.coalesce("core", "centre.doc_id").alias("core")))
    outside = placed.where("own <> core").select("token", F.col("x").alias("y"), F.col("own").alias("other"))
    meet = (F.col("other") != F.col("own")) & ((F.col("own") == F.col("core")) | (F.col("y.doc_id") < F.col("x.doc_id"))) & _room("x", "y", percent)
    second = placed.join(outside, (placed["token"] == outside["token"]) & meet)
    second = second.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    second = stored(second.join(first, ["a", "b"], "left_anti"))
    discard(shared, first)
    if second.head(1):
        more = _verified(second, signatures, docs, k, percent)
        if more.head(1):
            parts = connected_components(links.union(more))
        discard(more)
    discard(placed, second, signatures, links)

    # a class has its component before its copies, which may be many, meet it; rows without a class meet nothing
    found = classes.join(parts.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    found = stored(found.select("d1", "d2", F.coalesce("component", "rep").alias("component_id"), "copies"))
    inside = F.col("d1").isNotNull() & F.col("doc_id").isNotNull()
    size = F.col("n").cast("long").alias("n_shingles")
    named = salted_join(rows.where(inside), found, ["d1", "d2"], F.xxhash64("doc_id"), "copies").select("doc_id", size, "component_id")
    return named.union(rows.where(~inside).select("doc_id", size, F.col("doc_id").alias("component_id")))
