"""Periodic runs against a plain version that tries every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from lagweave.llm import periodic_runs as pr
from lagweave.llm import queries

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain(w, least=24, times=3):
    """All runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e > s and e + q - s >= times * q:
                found.setdefault((s, e + q), q)  # a multiple has the same ends as its smallest period
            s = max(e, s) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= least)


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def numbered(words):
    import numpy as np

    known = {}
    return np.array([known.setdefault(x, len(known)) for x in words], np.int64)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (3, 3), (6, 3), (8, 4), (10, 5)])
def test_runs_against_every_period(least, times):
    rng = random.Random(least * times)
    texts = [[], ["a"], ["a"] * 3, ["a"] * 200, list("abc") * 30, list("abaab") * 12 + list("aba") * 20]
    for _ in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            part = [rng.choice("ab") for _ in range(rng.randint(1, 9))]
            w += part * rng.randint(1, 9) + part[: rng.randint(0, len(part))] if rng.random() < 0.6 else [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        texts.append(w)
    a, b = "a", "ab"
    for _ in range(11):
        a, b = b, b + a
    texts.append(list(b))  # a word rich in squares
    found = pr.find_runs([numbered(w) for w in texts], least, times)
    assert found == [plain(w, least, times) for w in texts]
    assert sum(map(len, found)) > 50


def test_odd_rows(spark):
    rng = random.Random(3)
    long = [rng.choice(["x", "y", "z"]) for _ in range(20_000)]
    long[5000:17_000] = (long[:700] * 20)[:12_000]
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t", 7), (4, "a " * 24, 7), (4, "a " * 24, 7), (5, "a " * 23, 7), (None, "a b\n" * 40, None), (6, " ".join(long), 1), (7, "Ä ä Ä " * 30 + "ß", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _runs int")
    got = pr.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "_runs", "_best", "_collapsed"]
    for r in got.collect():
        w = SPLIT.findall(r["text"] or "")
        runs = plain(w) if len(w) < 5000 else [tuple(x) for x in r["_runs"]]
        assert [tuple(x) for x in r["_runs"]] == runs
        assert r["_collapsed"] == (None if r["text"] is None else kept(w, runs))
        if len(w) >= 5000:
            assert [x for x in runs if x[2] % 700 == 0][0][1] >= 12_000
    assert got.count() == len(rows)
    assert not pr.periodic_runs(spark.createDataFrame([], docs.schema)).collect()
    with pytest.raises(ValueError):
        pr.periodic_runs(docs, times=2)


def test_query_against_plain(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs)
    some = 0
    for r in got:
        w = SPLIT.findall(docs[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue  # the plain version is quadratic
        runs = plain(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept(w, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 10
