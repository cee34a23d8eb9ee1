"""Trie of conversation prefixes by a splitter skeleton.

A conversation's path is the sequence of its turns, each a 128-bit digest of role and text; every distinct prefix of a
path is a node. Steps:

1. a sample of (path, id) gives splitters that cut the sorted conversations into shards of about even numbers of turns.
   All nodes that two shards can share lie on a splitter's path: these nodes, the skeleton, are broadcast;
2. each shard is sorted by path and id and read once, holding the open nodes of the current path. A node that isn't of the
   skeleton lies in one shard whole and is finished when its last conversation has passed;
3. of skeleton nodes, each shard gives partial aggregates, which are reduced by node and summed from the leaves of the
   skeleton to its root. Ids that end at a skeleton node come in pieces, sorted by shard, and are hashed as a stream.

Ids are part of the order, so that a group of equal conversations is cut like any other. What a task holds is one path
(20 bytes a turn) and the finished children of the nodes open on it. Equal results come out of any sample; it only balances the shards.

Edge cases: null roles and texts are empty, null ids belong to no conversation. Turns are ordered by number, null first,
ties by digest; repeated rows are repeated turns. A conversation without turns ends at the root, an empty table gives no
rows. Ids are whole numbers; other types are refused. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import discard, pieces, stored

#: Bytes of a turn in a path: its digest, and the length of its text.
DIGEST, SIZE = 16, 4
#: Turns of a shard, roughly; shards, nodes of the skeleton (about 16 MB) and bytes of sampled paths at most.
SHARD_TURNS, SHARDS, SKELETON, SAMPLE_BYTES = 1 << 16, 1 << 14, 1 << 17, 1 << 25
#: Ids hashed or handed on at once.
IDS = 1 << 13

_TOTALS = "conv_id long, n_convs long, n_children long, n_leaves long, saved long"
_FOUND = f"kind int, node int, depth long, parent_conv_id long, size long, {_TOTALS}, ends string, shard int, piece long"


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size) for rows(conv_id, turn, role, text) that have an id."""
    kind = rows.schema["conv_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"conv_id must be a whole number, not {kind.simpleString()}")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text)))
    return rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).alias("size"))


def _paths(batches: Iterator[pa.RecordBatch], heads: Callable[[int], int]) -> Iterator[pa.RecordBatch]:
    """(conv_id, path, sizes) for turns sorted by family, head first, and conversation; the head's first turns go before those of each of its family."""

    def done() -> tuple[int, bytes, bytes]:
        n = heads(conv)
        own = (b"".join(digests), b"".join(sizes))
        if not is_head:
            own = tuple(h[: n * w] + x[n * w :] for h, x, w in zip(head, own, (DIGEST, SIZE), strict=True))
        return conv, *own

    def batch_of(rows: list) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["conv_id", "path", "sizes"])

    family, conv, is_head, out, held = None, None, False, [], 0
    head, digests, sizes = (b"", b""), [], []
    for batch in pieces(batches, 4096):
        for f, other, c, digest, size in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if c != conv:
                if conv is not None:
                    out.append(done())
                    held += len(digests)
                    if is_head:
                        head = out[-1][1:]
                    if held >= 1 << 16:
                        yield batch_of(out)
                        out, held = [], 0
                if f != family:
                    family, head = f, (b"", b"")
                conv, is_head, digests, sizes = c, not other, [], []
            digests.append(digest)
            sizes.append(size.to_bytes(SIZE, "little"))
    if conv is not None:
        out.append(done())
        yield batch_of(out)


def rebuilt_paths(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, path, sizes): of conversation c the first h turns are those of c - c % family, all if fewer; h is crc32(c) % most."""
    each = turns(rows).withColumn("family", F.col("conv_id") - F.col("conv_id") % family)
    each = each.select("family", (F.col("conv_id") != F.col("family")).alias("other"), "conv_id", "turn", "digest", "size")
    order = each.repartition("family").sortWithinPartitions("family", "other", "conv_id", "turn", "digest").drop("turn")
    return order.mapInArrow(lambda it: _paths(it, lambda c: zlib.crc32(str(c).encode()) % most), "conv_id long, path binary, sizes binary")


class Skeleton:
    """The trie of the splitters' paths; node 0 is the root, parents come before children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            at = 0
            for i in range(0, len(path), DIGEST):
                key = at, path[i : i + DIGEST]
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[key]


def skeleton(paths: DataFrame) -> Skeleton:
    """Splitters for paths(conv_id, path): weighted quantiles of a hash sample; fewer if their trie would be too large."""
    spark = paths.sparkSession
    total = paths.agg(F.sum(F.octet_length("path") / DIGEST + 1).alias("turns"), F.sum(F.octet_length("path") + 64).alias("bytes")).head()
    if not total["turns"]:
        return Skeleton([])
    shards = int(min(max(total["turns"] // SHARD_TURNS, int(spark.conf.get("spark.sql.shuffle.partitions"))), SHARDS))
    share = min(1.0, SAMPLE_BYTES / total["bytes"])
    drawn = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = paths.where(drawn & (F.octet_length("path") <= SAMPLE_BYTES // 64)).select("path", "conv_id").collect()
    rows = sorted((bytes(r["path"]), r["conv_id"]) for r in rows)
    weight = [len(p) // DIGEST + 1 for p, _ in rows]
    while True:
        cuts, passed, step = [], 0, sum(weight) / shards
        for row, w in zip(rows, weight, strict=True):
            if passed >= step * (len(cuts) + 1):
                cuts.append(row)
            passed += w
        found = Skeleton(cuts)
        if len(found.parent) <= SKELETON or shards == 1:
            return found
        shards = max(shards // 2, 1)


def _dealt(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    splitters = shared.value.splitters
    for batch in pieces(batches, 4096):
        at = [bisect_right(splitters, key) for key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["shard", *batch.schema.names])


class _Node:
    """An open node: its totals so far, and its finished children, which wait for its smallest id."""

    __slots__ = ("children", "digest", "ends", "first", "hash", "leaves", "n", "node", "pieces", "saved", "size", "waiting")

    def __init__(self, digest: bytes, size: int, node: int | None):
        self.digest, self.size, self.node = digest, size, node
        self.first, self.n, self.children, self.leaves, self.saved, self.pieces = None, 0, 0, 0, 0, 0
        self.ends: list[int] = []
        self.hash = None
        self.waiting: list[tuple] = []


def _scanned(batches: Iterator[pa.RecordBatch], shared, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted shards to finished nodes (kind 0), parts of skeleton nodes (1) and pieces of the ids that end there (2)."""
    child = shared.value.child
    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.string(), pa.int32(), pa.int64()]
    out: list[tuple] = []
    open_: list[_Node] = []
    shard = None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def hand_on(x: _Node) -> None:
        text = ",".join(map(str, x.ends))
        if x.node is not None:
            out.append((2, x.node, *[None] * 8, text, shard, x.pieces))
        else:
            x.hash = x.hash or hashlib.sha256()
            x.hash.update((("," if x.pieces else "") + text).encode())
        x.pieces += 1
        x.ends.clear()

    def close() -> None:
        x = open_.pop()
        depth = len(open_)
        if x.ends:
            hand_on(x)
        if x.node is not None:
            out.append((1, x.node, depth, None, x.size, x.first, x.n, x.children, x.leaves, x.saved, None, shard, None))
            return
        saved = x.saved + (x.n - 1) * x.size
        leaves = x.leaves if x.children else 1
        out.extend((0, None, depth + 1, x.first, None, *w) for w in x.waiting)
        up = open_[-1]
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        up.first = x.first if up.first is None else min(up.first, x.first)
        row = x.first, x.n, x.children, leaves, saved, x.hash and x.hash.hexdigest(), None, None
        if up.node is None:
            up.waiting.append(row)
        else:
            out.append((0, up.node, depth, None, None, *row))

    for batch in pieces(batches, 1024):
        for at, conv, path, sizes in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            same = 0
            if at != shard:
                while open_:
                    close()
                shard = at
                open_.append(_Node(b"", 0, 0))
            else:
                while same + 1 < len(open_) and open_[same + 1].digest == path[same * DIGEST : (same + 1) * DIGEST]:
                    same += 1
                while len(open_) > same + 1:
                    close()
            for i in range(same, len(path) // DIGEST):
                digest, up = path[i * DIGEST : (i + 1) * DIGEST], open_[-1].node
                node = None if up is None else child.get((up, digest))
                open_.append(_Node(digest, int.from_bytes(sizes[i * SIZE : (i + 1) * SIZE], "little"), node))
            for x in open_:
                x.n += 1
            last = open_[-1]
            last.first = conv if last.first is None else min(last.first, conv)
            last.ends.append(conv)
            if len(last.ends) >= most:
                hand_on(last)
            if len(out) >= 1 << 13:
                yield flush()
    while open_:
        close()
    if out:
        yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of pieces sorted by node and place, as a stream."""
    node, hash_, found = None, hashlib.sha256(), []
    for batch in pieces(batches, 64):
        for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    found.append((node, hash_.hexdigest()))
                node, hash_ = n, hashlib.sha256()
                hash_.update(text.encode())
            else:
                hash_.update(b"," + text.encode())
    if node is not None:
        found.append((node, hash_.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], ["node", "ends"])


def _summed(parts: list, trie: Skeleton) -> list[tuple]:
    """Rows of the skeleton's nodes from their reduced parts: children before parents."""
    total = {r["node"]: dict(r.asDict(), first=r["conv_id"]) for r in parts}
    for node in range(len(trie.parent) - 1, -1, -1):
        if node in total:
            x = total[node]
            x["n_leaves"] = x["n_leaves"] if x["n_children"] else 1
            x["saved"] += (x["n_convs"] - 1) * x["size"]
            if node:
                up = total[trie.parent[node]]
                up["n_children"] += 1
                up["n_leaves"] += x["n_leaves"]
                up["saved"] += x["saved"]
                up["first"] = x["first"] if up["first"] is None else min(up["first"], x["first"])
    return [(n, trie.depth[n], total[trie.parent[n]]["first"] if n else None, x["first"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved"]) for n, x in total.items()]


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row per node of paths(conv_id, path, sizes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    path: DIGEST bytes a turn; sizes: SIZE bytes a turn, the length of its text, little end first.
    """
    spark = paths.sparkSession
    paths = stored(paths.select("conv_id", "path", "sizes"))
    trie = skeleton(paths)
    shared = spark.sparkContext.broadcast(trie)
    dealt = paths.mapInArrow(lambda it: _dealt(it, shared), "shard int, conv_id long, path binary, sizes binary")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    found = stored(dealt.mapInArrow(lambda it: _scanned(it, shared, IDS), _FOUND))
    parts = found.where("kind = 1").groupBy("node").agg(
        F.max("size").alias("size"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    )
    nodes = spark.createDataFrame(_summed(parts.collect(), trie), f"node int, depth long, parent_conv_id long, {_TOTALS}")
    ends = found.where("kind = 2").select("node", "ends", "shard", "piece").repartition("node").sortWithinPartitions("node", "shard", "piece")
    ends = ends.select("node", "ends").mapInArrow(_hashed, "node int, ends string")
    columns = [F.col("conv_id"), F.col("depth"), F.col("parent_conv_id"), *[F.col(c) for c in ("n_convs", "n_children", "n_leaves")], F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    own = nodes.join(ends, "node", "left").select(*columns)
    up = nodes.select("node", F.col("conv_id").alias("up"))
    rest = found.where("kind = 0").join(F.broadcast(up), "node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    discard(paths)
    return own.unionByName(rest.select(*columns))
