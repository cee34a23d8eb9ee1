"""Removal of repeated word sequences by fixed-block anchors.

A window is `window` consecutive words of one document; words are kept apart by space and tab to carriage return and not
changed. Every word covered by a window whose words also start earlier, by (doc_id, start), goes. Steps:

1. index and probe: each document is cut into non-overlapping reference blocks of `window // 2` words; any window holds a
   whole block of its own document. Every rolling sequence of as many words probes the index. Both travel as packed hashes
   (four bytes for a sequence and four for its document), dealt by ranges of the hash; a hash that occurs at a block and
   anywhere else comes back as a hit of its documents;
2. extend: within a document, each hit is extended to both sides to all windows around it, which are compared by 96 bits
   of hash. Only the first place of equal windows stays an origin, the others are repeats;
3. repeats that overlap or touch are one maximal span, and its words are deleted.

Hashes of step 1 are short: a false hit only brings windows into step 2 that have no equal there. Copies of whole texts
are told by a digest: all but the first are one span, and enter step 2 not at all. Tasks reduce what they hold before it
is dealt: of equal hashes in a batch of documents one travels, so a passage that all documents share costs one entry a
batch, and no group of equal windows ever lies in one task whole.

Edge cases: null text has no words and stays null; texts shorter than a window lose nothing. Rows that repeat an id and
text are one document, each returned. Null ids come after all others; different texts of one id are told apart by their
hash, in its order. Ids are whole numbers; other types are refused. An empty table gives an empty result. All other
columns stay; input columns named _n_words, _n_removed or _spans are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from .common import discard, pieces, salted_join, stored
from .hashing import SPACE, U, mix, word_hashes

#: Words or windows of the documents that a task reduces at once (about 150 MB), and of a range of hashes.
BATCH, RANGE = 1 << 20, 1 << 22
#: Different marks of documents with hits, broadcast to leave out most others before texts are shuffled (16 MB at most).
MARKS = 1 << 20
_KEY = ["_none", "_id", "_hash"]
_SEEDS = U(0x100000001B3), U(0xC6A4A7935BD1E995)


def _rolling(words: np.ndarray, k: int, seed: np.uint64) -> np.ndarray:
    """One hash per k consecutive words."""
    n = max(len(words) - k + 1, 0)
    found = np.full(n, k, U)
    for i in range(k if n else 0):
        found = found * seed + words[i : i + n]
    return mix(found)


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U(40)) * U(ranges) >> U(24)).astype(np.int32)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """One of so many numbers for each key of a document."""
    return ((keys.astype(np.int64) & 0x7FFFFFFF) % buckets).astype(np.int32)


def _short(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The number of the range and 30 bits within it, as one number."""
    return (_range(hashes, ranges).astype(np.int64) << 30) | (hashes & U((1 << 30) - 1)).astype(np.int64)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array and where it lies."""
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.empty(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(keys[a]), slice(a, b)


def _groups(order_by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Order by the last key first, as lexsort has it; where a new combination of keys begins in that order)."""
    order = np.lexsort(order_by)
    new = np.zeros(len(order), bool)
    for key in order_by:
        sorted_ = key[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    new[:1] = True
    return order, np.flatnonzero(new)


def _packed(batch_keys: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """For each key, in order, the bytes of each column's values."""
    order = np.argsort(batch_keys, kind="stable")
    keys, rows = [], [[] for _ in columns]
    for k, part in _slices(batch_keys[order]):
        keys.append(k)
        for row, column in zip(rows, columns, strict=True):
            row.append(column[order[part]].tobytes())
    return keys, rows


_PROBES = "range int, hashes binary, docs binary"


def _probes(batches: Iterator[pa.RecordBatch], block: int, ranges: int, most: int) -> Iterator[pa.RecordBatch]:
    """For docs(mark, key, text), mark being part of the hash key: packed probes by range, and hits that recur within the batch already.

    Each distinct hash of the batch travels once, with its first document; its lowest bit says that it stands at a block,
    the next that it occurs more than once, so that the batch's documents have their hits already. Those follow as rows of
    the ranges from ranges on, one range for so many documents.
    """

    def reduced() -> Iterator[pa.RecordBatch]:
        found = [_rolling(w, block, _SEEDS[0]) for w in held]
        h = np.concatenate(found)
        doc = np.repeat(np.array(marks, np.int32), [len(f) for f in found])
        aligned = np.concatenate([np.arange(len(f)) % block == 0 for f in found])
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        size = np.diff(np.append(starts, len(h)))
        flags = np.logical_or.reduceat(aligned[order], starts).astype(np.uint32) | ((size > 1).astype(np.uint32) << np.uint32(1))
        often = order[np.repeat(size > 1, size)]
        keys, rows = _packed(ranges + _bucket(doc[often], ranges), _short(h[often], ranges), doc[often])
        yield _batch(keys, rows)
        first = order[starts]
        back = np.argsort(first)  # as the documents come: equal document marks stand together
        first, flags = first[back], flags[back]
        short = ((h[first] & U((1 << 30) - 1)).astype(np.uint32) << np.uint32(2)) | flags
        yield _batch(*_packed(_range(h[first], ranges), short, doc[first]))

    def _batch(keys: list[int], rows: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(r, pa.binary()) for r in rows]], names)

    names = ["range", "hashes", "docs"]
    held, marks, size, seen = [], [], 0, set()
    for batch in pieces(batches):
        for mark, key, text in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            words = word_hashes(text, SPACE) if text and key not in seen else ()
            if len(words) >= block:
                seen.add(key)
                held.append(words)
                marks.append(mark)
                size += len(words)
                if size >= most:
                    yield from reduced()
                    held, marks, size, seen = [], [], 0, set()
    if held:
        yield from reduced()


def _by_range(batches: Iterator[pa.RecordBatch], whole) -> Iterator[pa.RecordBatch]:
    """whole(number, rows) for each range of rows sorted by range; rows are lists of the packed columns' bytes."""
    at, held = None, []
    for batch in pieces(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != at and held:
                yield from whole(at, held)
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield from whole(at, held)


def _hits(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """The hashes that stand at a block and elsewhere, packed by documents' buckets; a range lies in one task."""

    def whole(at: int, rows: list) -> Iterator[pa.RecordBatch]:
        if at >= ranges:
            hits, doc = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.int64, np.int32)))
        else:
            h, doc = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.uint32, np.int32)))
            order = np.argsort(h >> np.uint32(2), kind="stable")
            h, doc = h[order], doc[order]
            starts = np.flatnonzero(np.concatenate(([True], (h[1:] ^ h[:-1]) > 3)))
            size = np.diff(np.append(starts, len(h)))
            flags = np.bitwise_or.reduceat(h & np.uint32(3), starts)
            recurs = np.repeat((flags & np.uint32(1) > 0) & ((size > 1) | (flags > 1)), size) & (h & np.uint32(2) == 0)
            hits, doc = (np.int64(at) << 30) | (h[recurs] >> np.uint32(2)).astype(np.int64), doc[recurs]
        keys, (a, b) = _packed(_bucket(doc, ranges), hits, doc)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["bucket", "hits", "docs"])

    return _by_range(batches, whole)


def _hits_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document: its mark and distinct hits."""

    def whole(_: int, rows: list) -> Iterator[pa.RecordBatch]:
        hits, doc = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.int64, np.int32)))
        order, starts = _groups([hits, doc])
        hits, doc = hits[order[starts]], doc[order[starts]]
        cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(doc)), pa.int32()), pa.array(hits, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), lists], ["doc", "hits"])

    return _by_range(batches, whole)


#: Packed places of windows: 96 bits of hash, the document's key, the window's start.
_PLACE = (("h", np.uint64), ("more", np.uint32), ("none", np.bool_), ("id", np.int64), ("hash", np.int64), ("start", np.int32))
_PLACES = f"range int, {', '.join(f'{n} binary' for n, _ in _PLACE)}"
_OWN = _PLACE[2:]


def _origins(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Order of the places, by window and then by document and start; whether each differs from its window's first place)."""
    order = np.lexsort([p[n] for n in ("start", "hash", "id", "none", "more", "h")])
    h, more = p["h"][order], p["more"][order]
    starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (more[1:] != more[:-1]))))
    first = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    return order, np.logical_or.reduce([p[n][order] != p[n][first] for n in ("none", "id", "hash", "start")])


def _windows(batches: Iterator[pa.RecordBatch], window: int, block: int, ranges: int, spread: int, most: int) -> Iterator[pa.RecordBatch]:
    """For docs(_none, _id, _hash, text, hits): the windows around hits, packed by range; of equal ones of a batch only the first travels, the others are repeats."""

    def reduced() -> Iterator[pa.RecordBatch]:
        p = {n: np.concatenate([x[i] for x in held]) for i, (n, _) in enumerate(_PLACE)}
        order, later = _origins(p)
        gone, keep = order[later], order[~later]
        own = [p[n] for n, _ in _OWN]
        keys, rows = _packed(spread + _bucket(p["hash"][gone], spread), *[x[gone] for x in own])
        none = [[None] * len(keys)] * (len(_PLACE) - len(_OWN))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(r, pa.binary()) for r in (*none, *rows)]], names)
        keys, rows = _packed(_range(p["h"][keep], spread), *[p[n][keep].astype(kind) for n, kind in _PLACE])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(r, pa.binary()) for r in rows]], names)

    names = ["range", *[n for n, _ in _PLACE]]
    held, size, seen = [], 0, set()
    for batch in pieces(batches, 64):
        for none, id_, digest, text, hits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (none, id_, digest) in seen:
                continue
            seen.add((none, id_, digest))
            words = word_hashes(text.encode(), SPACE)
            if len(words) < window:
                continue
            anchors = np.flatnonzero(np.isin(_short(_rolling(words, block, _SEEDS[0]), ranges), np.unique(np.array(hits, np.int64))))
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(anchors - (window - block), 0), 1)
            np.add.at(near, anchors + 1, -1)
            start = np.flatnonzero(np.cumsum(near)[: len(words) - window + 1] > 0)
            if len(start):
                one, two = (_rolling(words, window, s)[start] for s in _SEEDS)
                n = len(start)
                held.append((one, (two >> U(32)).astype(np.uint32), np.full(n, none), np.full(n, id_, np.int64), np.full(n, digest, np.int64), start.astype(np.int32)))
                size += n
                if size >= most:
                    yield from reduced()
                    held, size, seen = [], 0, set()
    if held:
        yield from reduced()


def _later(batches: Iterator[pa.RecordBatch], spread: int) -> Iterator[pa.RecordBatch]:
    """The places of windows that have an equal one before them, packed by documents' buckets."""

    def whole(at: int, rows: list) -> Iterator[pa.RecordBatch]:
        own = len(_PLACE) - len(_OWN)
        if at >= spread:
            p = {n: np.concatenate([np.frombuffer(r[own + i], kind) for r in rows]) for i, (n, kind) in enumerate(_OWN)}
        else:
            p = {n: np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, (n, kind) in enumerate(_PLACE)}
            order, later = _origins(p)
            p = {n: p[n][order[later]] for n, _ in _OWN}
        keys, packed = _packed(_bucket(p["hash"], spread), *[p[n] for n, _ in _OWN])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(r, pa.binary()) for r in packed]], ["bucket", *[n for n, _ in _OWN]])

    return _by_range(batches, whole)


def _repeats_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document: its key and the starts of its windows that repeat."""

    def whole(_: int, rows: list) -> Iterator[pa.RecordBatch]:
        p = {n: np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, (n, kind) in enumerate(_OWN)}
        order, cut = _groups([p["start"], p["hash"], p["id"], p["none"]])
        p = {n: x[order[cut]] for n, x in p.items()}  # repeated rows repeat their places
        new = np.zeros(len(cut), bool)
        for n in ("none", "id", "hash"):
            new[1:] |= p[n][1:] != p[n][:-1]
        new[:1] = True
        cut = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(new)), pa.int32()), pa.array(p["start"], pa.int32()))
        yield pa.RecordBatch.from_arrays([*[pa.array(p[n][cut]) for n in ("none", "id", "hash")], lists], [*_KEY, "starts"])

    return _by_range(batches, whole)


def _ranges(size: int | None, spark) -> int:
    """Ranges of about RANGE entries, and as many as there are shuffle partitions at least."""
    return min(max((size or 0) // RANGE + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1 << 20)


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(_none, _id, _hash, starts, whole, n) for docs(_none, _id, _hash, _text) with repeats: starts of their repeated windows, or whole for copies; n is the number of rows of the document."""
    spark, block = docs.sparkSession, window // 2
    whole_mark = F.xxhash64(*_KEY)
    mark = F.shiftright(whole_mark, 32).cast("int").alias("mark")
    profile = stored(
        docs.select(*_KEY, F.md5("_text").alias("digest"), F.octet_length("_text").alias("bytes"))
        .groupBy(*_KEY, "digest", "bytes").agg(F.count("*").alias("n"))
    )
    texts = profile.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(*_KEY)).alias("first"), F.count("*").alias("m")).where("m > 1")
    copies = salted_join(profile, texts, ["digest"], F.xxhash64(*_KEY), "m").where(F.struct(*_KEY) != F.col("first"))
    copies = stored(copies.select(*_KEY, "n"))
    ranges = _ranges((profile.agg(F.sum("bytes")).head()[0] or 0) // 6, spark)
    probes = docs.select(mark, whole_mark.alias("key"), "_text").mapInArrow(lambda it: _probes(it, block, ranges, BATCH), _PROBES)
    hits = probes.repartition("range").sortWithinPartitions("range").mapInArrow(lambda it: _hits(it, ranges), "bucket int, hits binary, docs binary")
    hits = stored(hits.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_hits_by_document, "doc int, hits array<long>"))
    counts = profile.join(copies, _KEY, "left_anti").groupBy(mark).agg(F.sum("n").alias("m"))
    known = stored(hits.join(counts.hint("merge"), hits["doc"] == F.col("mark")).select("mark", "hits", "m"))
    near = known.select(F.pmod("mark", F.lit(MARKS)).alias("near")).distinct()
    some = docs.select(*_KEY, "_text", mark).join(F.broadcast(near), F.pmod("mark", F.lit(MARKS)) == F.col("near"), "left_semi")
    some = salted_join(some, known, ["mark"], F.monotonically_increasing_id(), "m")
    spread = _ranges(hits.agg(F.sum(F.size("hits"))).head()[0], spark)
    windows = some.select(*_KEY, "_text", "hits").mapInArrow(lambda it: _windows(it, window, block, ranges, spread, BATCH), _PLACES)
    later = windows.repartition("range").sortWithinPartitions("range").mapInArrow(lambda it: _later(it, spread), f"bucket int, {', '.join(f'{n} binary' for n, _ in _OWN)}")
    later = later.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeats_by_document, "_none boolean, _id long, _hash long, starts array<int>")
    later = later.withColumn("whole", F.lit(False))
    both = later.unionByName(copies.select(*_KEY, F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole")))
    both = both.groupBy(*_KEY).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.max("whole").alias("whole"))
    found = stored(both.join(profile.select(*_KEY, "n").hint("merge"), _KEY))
    discard(profile, copies, hits, known)
    return found


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(row, text, starts, whole) to (row, kept text, words, removed words, spans of words)."""
    for batch in pieces(batches):
        kept, n_words, n_removed, spans = [], [], [], []
        for text, starts, whole in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
            words = (text or "").encode().split()
            first = np.arange(max(len(words) - window + 1, 0)) if whole else np.unique(np.array(starts or [], np.int64))
            gap = np.flatnonzero(first[1:] > first[:-1] + window) + 1
            found = [(int(a[0]), int(a[-1]) + window) for a in np.split(first, gap)] if len(first) else []
            left, at = [], 0
            for a, b in found:
                left += words[at:a]
                at = b
            kept.append(None if text is None else b" ".join(left + words[at:]).decode())
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in found))
            spans.append([{"start": a, "end": b} for a, b in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["row", "text", "words", "removed", "spans"],
        )


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs(doc_id, text, ...) with text reduced to its kept words, joined by one space, and _n_words, _n_removed, _spans (of deleted words, end exclusive) beside it."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    others = [c for c in docs.columns if c not in ("text", "_n_words", "_n_removed", "_spans")]
    text = F.col("text").cast("string")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col("doc_id").isNull().alias("_none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"),
    )
    found = repeats(keyed.drop("_row"), window)
    cut = salted_join(keyed, found, _KEY, F.monotonically_increasing_id(), "n", "left").select("_row", "_text", "starts", "whole")
    out = StructType([StructField("row", keyed.schema["_row"].dataType), StructField("text", StringType()), *StructType.fromDDL("words long, removed long, spans array<struct<start:int,end:int>>").fields])
    cut = cut.mapInArrow(lambda it: _cut(it, window), out)
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c in (*others, "text")]
    return cut.select(*columns, F.col("words").alias("_n_words"), F.col("removed").alias("_n_removed"), F.col("spans").alias("_spans"))
