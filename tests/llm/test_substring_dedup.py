"""Removal of repeated word sequences against a plain version that lists every window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lagweave.llm import substring_dedup as sd

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, _n_words string, row string, starts int"


def plain(rows, window):
    """(words, removed, kept) by (id, text), for distinct (id, text) in the operator's order."""
    docs = sorted({(i is None, i or 0, h, t) for i, t, h in rows}, key=lambda d: d[:3])
    seen, out = set(), {}
    for none, i, _, text in docs:
        w = SPLIT.findall(text or "")
        gone = set()
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            if g in seen:
                gone |= set(range(p, p + window))
            seen.add(g)
        out[None if none else i, text] = (len(w), len(gone), None if text is None else " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def got(spark, rows, window=20):
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS)
    hashed = [(r["doc_id"], r["text"], r["h"]) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    cut = sd.substring_dedup(docs, window)
    assert cut.columns == ["doc_id", "text", "row", "starts", "_n_words", "_n_removed", "_spans"]
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["_n_words"], r["_n_removed"], r["text"] or "", sum(s["end"] - s["start"] for s in r["_spans"])) for r in cut.collect())
    want = plain(hashed, window)
    return found, sorted((i is None, i or 0, *want[i, t][:2], want[i, t][2] or "", want[i, t][1]) for i, t in rows)


def text(rng, n, letters="abcdefghijklmnop"):
    return [rng.choice(letters) + rng.choice(letters) for _ in range(n)]


@pytest.mark.parametrize("window", [2, 3, 20])
def test_against_every_window(spark, window):
    rng = random.Random(window)
    parts = [text(rng, rng.randint(window - 1, 3 * window + 5)) for _ in range(4)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(parts)[rng.randint(0, 3) :] if rng.random() < 0.5 else text(rng, rng.randint(1, 2 * window))
        rows.append((rng.choice([i, i, i, None]), rng.choice([" ", "\n", "\t "]).join(w)))
    found, want = got(spark, rows, window)
    assert found == want and sum(r[3] for r in want)


def test_odd_rows(spark):
    rng = random.Random(1)
    base, long = " ".join(text(rng, 45)), " ".join(text(rng, 30_000))
    same = "a " * 70  # windows that overlap themselves
    rows = [
        (1, base), (1, base), (2, base), (3, base + " tail"), (1, "head " + base), (4, None), (4, None), (5, ""), (6, " \t\n"), (None, base), (None, None), (7, long), (8, long[1000:]),
        (9, same), (10, same), (11, "Ä b " * 25), (12, " ".join(base.split()[:19])), (13, base.upper()),
    ]
    found, want = got(spark, rows)
    assert found == want
    assert not sd.substring_dedup(spark.createDataFrame([], DOCS)).collect()
    with pytest.raises(TypeError):
        sd.substring_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_many_copies_and_batches(spark, monkeypatch):
    """A passage that a third of the rows hold, copies, repeated rows; batches and ranges of a few words."""
    rng = random.Random(2)
    shared, copy = text(rng, 25), " ".join(text(rng, 60))
    rows = []
    for i in range(400):
        own = text(rng, 30)
        rows.append((i, " ".join(own[:7] + shared + own[7:]) if i % 3 == 0 else copy if i % 3 == 1 else " ".join(own)))
    rows += [(1000, copy)] * 200
    for name, value in (("BATCH", 300), ("RANGE", 500), ("MARKS", 16)):
        monkeypatch.setattr(sd, name, value)
    found, want = got(spark, rows)
    assert found == want
