"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items scans each text once.

A window is 10 consecutive words of an item; a shorter item with words is one window. Words are runs of characters
other than ASCII non-alphanumerics, after lower-casing A-Z. The automaton's letters are words: a text becomes the
numbers of its words (0 for words that no item holds), so a hit ends at a word and, where spans are asked for, maps to
code points of the original text.

The nodes of one automaton are bounded by MOST_NODES, counted in Spark before any item is collected. A larger
benchmark is dealt by hash into as many parts as needed, long items in pieces that overlap by a window; the texts then
pass through one scan per part, and what a scan found is stored before the next one, so one automaton at a time is in
memory.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item has no windows; items with a
null id count as id ''. Items that repeat an id are one. Repeated rows are each returned. Empty tables are fine. Extra
columns of any name are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, pieces, stored

WINDOW = 10
#: Nodes of one automaton at most, about 40 bytes each; a word of an item makes WINDOW nodes at most.
MOST_NODES = 2_000_000
#: Words of a piece of an item, besides those that it shares with the next one.
PIECE = 5000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_JAVA_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(_JAVA_WORD)
_built: dict[str, tuple[ahocorasick.Automaton, dict[bytes, int]]] = {}


def _automaton(items, name: str) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """Built once per Python worker from the broadcast (id, words) list; values are (words, item numbers)."""
    if (known := _built.get(name)) is None:
        where: dict[tuple[int, ...], set[int]] = {}
        number: dict[bytes, int] = {}
        for i, (_, line) in enumerate(items.value):
            words = [number.setdefault(w, len(number) + 1) for w in line.encode().split(b" ")]
            for at in range(max(1, len(words) - WINDOW + 1)):
                where.setdefault(tuple(words[at : at + WINDOW]), set()).add(i)
        trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, found in where.items():
            trie.add_word(window, (len(window), tuple(found)))
        if where:
            trie.make_automaton()
        known = trie, number
        _built.clear()
        _built[name] = known
    return known


def _hits(found: list, n: int, had: list) -> list[tuple[int, int]]:
    """The word ranges that matches cover, with those already known."""
    edge = np.zeros(n + 1, np.int64)
    for last, (words, _) in found:
        edge[last + 1 - words] += 1
        edge[last + 1] -= 1
    for r in had:
        edge[r["first"]] += 1
        edge[r["end"]] -= 1
    hit = np.concatenate(([False], np.cumsum(edge) > 0))
    turn = np.flatnonzero(hit[1:] != hit[:-1])
    return [(int(a), int(b)) for a, b in turn.reshape(-1, 2)]


def _scan(batches: Iterator[pa.RecordBatch], items, name: str, spans: bool) -> Iterator[pa.RecordBatch]:
    """Adds what this part of the items hits: word ranges [first, end), item ids and, with spans, code points [start, end)."""
    automaton, number = _automaton(items, name)
    kinds = [pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())])) for a, b in (("first", "end"), ("start", "end"))]
    for batch in pieces(batches):
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        text = columns["text"] if "text" in columns else columns["key"].field("text")
        known = columns["ranges"].to_pylist() if "ranges" in columns else repeat([])
        named = columns["items"].to_pylist() if "items" in columns else repeat([])
        ranges, ids, counts, places = [], [], [], []
        for raw, had, names in zip(text.cast(pa.binary()).to_pylist(), known, named):  # noqa: B905
            words = raw.translate(_FOLD).split() if raw else []
            counts.append(len(words))
            found = list(automaton.iter(tuple(map(number.get, words, repeat(0))))) if words and number else []
            if found:
                had = [{"first": a, "end": b} for a, b in _hits(found, len(words), had)]
                names = sorted({*names, *(items.value[i][0] for _, (_, numbers) in found for i in numbers)})
            ranges.append(had)
            ids.append(names)
            if spans:
                at = [m.span() for m in _WORD.finditer(raw.decode())] if had else []
                places.append([{"start": at[r["first"]][0], "end": at[r["end"] - 1][1]} for r in had])
        out = [batch.column(0), pa.array(ranges, kinds[0]), pa.array(ids, pa.list_(pa.string())), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays([*out, pa.array(places, kinds[1])] if spans else out, ["key", "ranges", "items", "n_words", "spans"][: 4 + spans])


def _pieces(benchmark: DataFrame) -> DataFrame:
    """(id, line, n): the words of each item between single spaces, long items in pieces, with their numbers of words."""
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = tests.select("id", F.regexp_extract_all(F.translate("text", upper, lower), F.lit(_JAVA_WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(PIECE))
    cut = words.select("id", "w", F.explode(starts).alias("at")).select("id", F.slice("w", F.col("at") + 1, F.lit(PIECE + WINDOW - 1)).alias("w"))
    return cut.select("id", F.array_join("w", " ").alias("line"), F.size("w").cast("long").alias("n")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", spans: bool = True) -> DataFrame:
    """A row per row of docs(key, text): key, n_words, n_hit, items (ids as text, sorted) and, if asked, spans of hit code points.

    A struct as key may hold the text itself; docs then need no other column.
    """
    spark = docs.sparkSession
    tests = _pieces(benchmark)
    total = tests.agg(F.sum("n")).first()[0] or 0
    parts = -(-total * WINDOW // MOST_NODES) or 1
    hits = "ranges array<struct<first:bigint,end:bigint>>, items array<string>, n_words bigint"
    wrapped = parts > 1 and "text" in docs.columns  # later scans need the text again
    text = [F.col("text").cast("string").alias("text")] if "text" in docs.columns else []
    rows = docs.select(F.struct(F.col(key).alias("key"), *text).alias("key")) if wrapped else docs.select(F.col(key).alias("key"), *text)
    scans: list[DataFrame] = []
    for part in range(parts):
        mine = tests.where(F.pmod(F.xxhash64("id", "line"), F.lit(parts)) == part).select("id", "line")
        items = spark.sparkContext.broadcast(sorted((r["id"], r["line"]) for r in mine.toLocalIterator()))
        ask = spans and part == parts - 1
        kind = keyed(rows, hits + ", spans array<struct<start:bigint,end:bigint>>" * ask)
        scanned = rows.mapInArrow(lambda it, items=items, name=uuid.uuid4().hex, ask=ask: _scan(it, items, name, ask), kind)
        if part < parts - 1:
            scans.append(stored(scanned))
            items.destroy()
            discard(*scans[:-1])
            scans, rows = scans[-1:], scans[-1].select("key", "ranges", "items")
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    own = F.col("key.key") if wrapped else F.col("key")
    return scanned.select(own.alias(key), "n_words", n_hit.alias("n_hit"), "items", *(["spans"] if spans else []))
