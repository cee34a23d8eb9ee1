"""Prefix trie against a plain one of dictionaries."""

import hashlib
import random
import zlib

import pytest

from lagweave.llm import prefix_trie as pt

ROWS = "conv_id long, turn long, role string, text string, path string, shard int"


def plain(rows):
    """Rows of the trie by (depth, conv_id); rows of conversations are (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    nodes = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        nodes[path].append(str(c))  # marks where it ends
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        members, ends = [c for c in nodes[path] if isinstance(c, int)], [c for c in nodes[path] if isinstance(c, str)]
        kids = [v for p, v in out.items() if len(p) == len(path) + 1 and p[:-1] == path]
        saved = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        out[path] = (
            min(members), len(path), None if not path else min(c for c in nodes[path[:-1]] if isinstance(c, int)), len(members), len(kids),
            sum(k[5] for k in kids) or 1, saved + sum(k[6] for k in kids), hashlib.sha256(",".join(ends).encode()).hexdigest(),
        )
    return sorted(out.values(), key=lambda r: (r[1], r[0], r[7], r[3]))


def got(spark, rows):
    found = pt.prefix_trie(pt.rebuilt_paths(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=lambda r: (r[1], r[0], r[7], r[3]))


@pytest.mark.parametrize("size", [None, 3, 400])
def test_against_plain(spark, monkeypatch, size):
    """By default, with a skeleton of few nodes and with many shards; a third of the conversations are copies, others share long prefixes."""
    rng = random.Random(5)
    if size:
        monkeypatch.setattr(pt, "SKELETON", size)
        monkeypatch.setattr(pt, "IDS", 2)
    monkeypatch.setattr(pt, "SHARD_TURNS", 20)
    rows, hot = [], [("user", "hé"), ("bot", "yes"), ("user", "no")]
    for c in range(240):
        turns = hot if c % 3 == 0 else hot * 4 if c % 3 == 1 else []
        turns = list(turns) + [(rng.choice(["user", "bot"]), rng.choice(["a", "bb", ""])) for _ in range(rng.randint(0, 3))] if c % 2 else turns
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", None), (0, 1, "user", None), (0, 2, "", ""), (None, 1, "user", "lost"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, None, "x", "first"),
        (11, 1, "ab", "c"), (12, 1, "a", "bc"), (13, 1, "a:1", ""), (14, 0, "user", "long " * 5000), (20, 1, "é", "ß"), *[(25, i, "user", str(i % 3)) for i in range(600)], *[(26, i, "user", str(i % 3)) for i in range(600)],
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [(3, 1, "a", "b")]) == plain([(3, 1, "a", "b")])
    assert not pt.prefix_trie(pt.rebuilt_paths(spark.createDataFrame([], ROWS))).collect()
    assert not got(spark, [(None, 1, "a", "b")])
    with pytest.raises(TypeError):
        pt.turns(spark.createDataFrame([("a", 1, "b", "c")], "conv_id string, turn long, role string, text string"))
