"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Features are words and word beginnings of 4 to 8 letters: that one occurs, that it occurs twice or three times, and
that it is at least one word in a hundred. Voters are the words of a fixed lexicon, word beginnings, and patterns:
several hits, dense hits, no hit, shouting. The annotators' labels are no voter and no start of the label model; they
only choose which word beginnings may vote (those that toxic rows share and clean rows lack, taken greedily by the
toxic rows they newly cover). The label model estimates accuracies and correlations of the voters from their votes
alone, by expectation maximisation. A logistic regression on the features learns its posteriors; its bias is then set
so that 0.7 is the cut that parts the fitted rows best, as the posteriors see them.

Fitting uses at most SAMPLE labelled rows of each class, in hash order; of them the CANDIDATES most frequent features,
the FEATURES most frequent of those that are pure, and VOTERS voters. Scoring reads every whole text: one automaton
over the words and beginnings of the features counts their occurrences.

Edge cases: null, empty or letterless texts get the score of a text without features. Labels that repeat an id count
as toxic if any is. Null labels and ids teach nothing. Without labels of both classes the lexicon alone scores. Rows
that repeat are each returned; an empty table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, hashed_sample, keyed, pieces, stored

#: Common English insults.
LEXICON = "idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb imbecile jerk garbage vermin filth ugly retard bastard bitch"
SAMPLE = 6000
CANDIDATES, FEATURES, VOTERS = 60_000, 1200, 80
PURITY = 0.95
#: Kinds of toxic rows that the label model tells apart, power of the posteriors' odds as which the classifier learns them,
#: and its ridge: the best of folds_of_settings() over the learning rows of a table of 10,000 documents.
KINDS, SHARP, RIDGE = 6, 4, 1e-3
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _line(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_FOLD) + b" "


BEGINNINGS = range(4, 9)
#: What is asked of the occurrences n of a word or beginning in a text of so many words, by the feature's suffix.
ASKED = {"": lambda n, words: n >= 1, "#2": lambda n, words: n >= 2, "#3": lambda n, words: n >= 3, "%": lambda n, words: n >= 2 and n * 100 >= words}


def _features(text: str) -> set[str]:
    """The features of a text: every word as ' word ', every beginning as ' begin', with the suffixes that hold."""
    words = _line(text).decode().split()
    found: Counter = Counter()
    for w, n in Counter(words).items():
        found[f" {w} "] += n
        for size in BEGINNINGS:
            if len(w) >= size:
                found[f" {w[:size]}"] += n
    return {f + suffix for f, n in found.items() for suffix, holds in ASKED.items() if holds(n, len(words))}


def _counts(batches: Iterator[pa.RecordBatch], wanted: frozenset | None) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1024):
        found: Counter = Counter()
        for text in batch.column("text").to_pylist():
            seen = _features(text)
            found.update(seen if wanted is None else seen & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["feature", "n"])


def _rows(batches: Iterator[pa.RecordBatch], index: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = batch.column("text").to_pylist()
        found = [sorted(index[f] for f in _features(t) if f in index) for t in texts]
        words = [len(_line(t).split()) for t in texts]
        loud = [sum(map(str.isupper, t)) > 0.5 * max(1, sum(map(str.isalpha, t))) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(words, pa.int32()), pa.array(loud, pa.bool_())],
            ["toxic", "found", "words", "loud"],
        )


def _spanning_tree(weight: np.ndarray) -> list[tuple[int, int]]:
    """(voter, parent) of a maximum spanning tree, the root (0, -1) first."""
    best, parent = weight[0].copy(), np.zeros(len(weight), int)
    best[0], found = -np.inf, [(0, -1)]
    for _ in range(1, len(weight)):
        at = int(best.argmax())
        found.append((at, int(parent[at])))
        near = (weight[at] > best) & (best > -np.inf)
        best[near], parent[near] = weight[at][near], at
        best[at] = -np.inf
    return found


def _kinds_of_votes(votes: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """First weights per row and class: class 0, then most groups of the rows that start as class 1, from farthest rows."""
    points = votes[start > 0.5].astype(float)
    centres = points[:1] if len(points) else votes[:1].astype(float)
    while len(points) and len(centres) < most:
        gap = ((points[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.vstack([centres, points[gap.argmax()]])
    for _ in range(20 if len(points) else 0):
        near = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([points[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centres)])
    near = ((votes[:, None] - centres) ** 2).sum(2).argmin(1)
    return np.column_stack([1 - start, *[start * (near == k) for k in range(len(centres))]])


def label_model(votes: np.ndarray, start: np.ndarray, kinds_: int | None = None, rounds: int = 20, least: float = 1.0) -> np.ndarray:
    """Posterior of class 1 per row of votes (1, 0 abstains, -1), by expectation maximisation from the given start.

    The model knows nothing but the votes. Class 1 is a mixture of KINDS kinds of rows. In each round it estimates, from
    the current posteriors, the share of each kind, each voter's accuracy as its vote probabilities per kind, and the
    correlations of voters as their mutual information given the kind; along the maximum spanning tree of those, a
    voter's vote depends on the kind and on its neighbour's vote, so voters that repeat one another count once.
    """
    n, m = votes.shape
    kinds = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float32).reshape(n, 3 * m)
    own = votes.astype(int) + 1
    posterior = _kinds_of_votes(votes, start, kinds_ or KINDS)
    for _ in range(rounds):
        joint, single, related = [], [], np.zeros((m, m))
        for weight in posterior.T:
            both = ((kinds * weight[:, None].astype(np.float32)).T @ kinds).reshape(m, 3, m, 3).astype(float)
            alone = (np.einsum("mama->ma", both) + least) / (weight.sum() + 3 * least)
            near = (both + least * alone[:, :, None, None] * alone[None, None]) / (weight.sum() + least)
            related += weight.sum() / n * np.einsum("manb,manb->mn", near, np.log(near / (near.sum(3, keepdims=True) * near.sum(1, keepdims=True))))
            joint.append(both)
            single.append(alone)
        tree = _spanning_tree(related)
        logit = np.tile(np.log((posterior.sum(0) + 1) / (n + posterior.shape[1])), (n, 1))
        for kind, (both, alone) in enumerate(zip(joint, single, strict=True)):
            for voter, parent in tree:
                if parent < 0:
                    logit[:, kind] += np.log(alone[voter])[own[:, voter]]
                else:
                    table = both[parent, :, voter, :] + least * alone[voter]
                    logit[:, kind] += np.log(table / table.sum(1, keepdims=True))[own[:, parent], own[:, voter]]
        posterior = np.exp(logit - logit.max(1, keepdims=True))
        posterior /= posterior.sum(1, keepdims=True)
    return 1 - posterior[:, 0]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 1200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, classes weighing alike, by adaptive gradient steps."""
    share = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * share / 2
        gw, gb = x.T @ error + ridge * w, float(error.sum())
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        up, down = 1 - 0.9**t, 1 - 0.99**t
        w = (w - 0.1 * (mw / up) / (np.sqrt(vw / down) + 1e-8)).astype(np.float32)
        b -= 0.1 * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    return w, float(b)


def operating_point(logit: np.ndarray, posterior: np.ndarray) -> float:
    """The cut with the most toxic rows above it less twice the clean ones, in the middle of the widest such gap."""
    order = np.argsort(-logit, kind="stable")
    value = np.cumsum(np.where(posterior[order] > 0.5, 1.0, -2.0))
    sorted_ = np.append(logit[order], logit.min() - 2)
    gap = sorted_[:-1] - sorted_[1:]
    value[gap <= 0] = -np.inf
    best = max(range(len(value)), key=lambda i: (value[i], gap[i]))
    return float(sorted_[best] + sorted_[best + 1]) / 2


def _voters(dense: np.ndarray, toxic: np.ndarray) -> list[int]:
    """Features chosen one by one for the toxic rows they newly cover, less the clean rows they hit."""
    left, chosen = toxic.astype(np.float32), []
    clean = (1 - toxic).astype(np.float32)
    cost = dense.T @ clean
    for _ in range(VOTERS):
        gain = dense.T @ left - 3 * cost
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] < 2:
            break
        chosen.append(best)
        left *= 1 - dense[:, best]
    return chosen


def _table(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
    """(features, which hold for each fitted row, votes, whether any lexical voter speaks), or None without both classes."""
    lexicon = [f" {w} " for w in LEXICON.split()]
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    some = [hashed_sample(known.where(F.col("toxic") == v), "order", SAMPLE).select("doc_id", "toxic") for v in (1, 0)]
    # at most 2 * SAMPLE rows of two numbers
    texts = stored(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some[0].union(some[1])), "doc_id").select("toxic", "text"))
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        discard(texts)
        return None

    def counted(toxic: int, wanted: frozenset | None) -> DataFrame:
        return texts.where(F.col("toxic") == toxic).mapInArrow(lambda it: _counts(it, wanted), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    least = max(2, size[1] // 1000)
    bad = {r["feature"]: r["n"] for r in counted(1, None).where(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()}
    good = {r["feature"]: r["n"] for r in counted(0, frozenset(bad)).collect()}
    share = {f: n / size[1] / (n / size[1] + good.get(f, 0) / size[0]) for f, n in bad.items()}
    pure = sorted((f for f in bad if share[f] >= PURITY), key=lambda f: (-bad[f], len(f), f))[:FEATURES]
    index = {f: i for i, f in enumerate(dict.fromkeys([*pure, *lexicon]))}
    rows = texts.mapInArrow(lambda it: _rows(it, index), "toxic int, found array<int>, words int, loud boolean").toPandas()
    dense = np.zeros((len(rows), len(index)), np.float32)
    for i, found in enumerate(rows["found"]):
        dense[i, found] = 1
    # features that hold for the same rows are one, the first
    _, at, same = np.unique(dense, axis=1, return_index=True, return_inverse=True)
    first = at[same.ravel()]
    kept = {int(i): k for k, i in enumerate(np.sort(at))}
    known_lexicon = [kept[int(first[index[f]])] for f in lexicon if dense[:, index[f]].any()]
    index = {f: kept[i] for f, i in index.items() if i in kept}
    dense = dense[:, np.sort(at)]
    toxic = rows["toxic"].to_numpy(np.float32)
    hits, words = dense.sum(1), rows["words"].to_numpy()
    chosen = list(dict.fromkeys([*known_lexicon, *_voters(dense, toxic)]))
    votes = np.column_stack([dense[:, chosen], hits >= 3, hits * 50 >= words.clip(1), -(hits == 0).astype(np.float32), rows["loud"].to_numpy()])
    spoken = dense[:, chosen].any(1)
    discard(texts)
    return list(index), dense, votes, spoken


def _trained(dense: np.ndarray, votes: np.ndarray, spoken: np.ndarray, kinds: int, sharp: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier of the posteriors."""
    posterior = label_model(votes, np.where(spoken, 0.9, 0.1), kinds)
    odds = (posterior / np.maximum(1 - posterior, 1e-13)) ** sharp
    weights, bias = logistic(dense, (odds / (1 + odds)).astype(np.float32), ridge=ridge)
    return weights, bias + float(np.log(0.7 / 0.3)) - operating_point(dense @ weights + bias, posterior)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[dict[str, float], float]:
    """Feature weights and bias, from rows of docs(doc_id, text) labelled in labels(doc_id, toxic) for which learn holds."""
    found = _table(docs, labels, learn)
    if found is None:
        return {f" {w} ": 4.0 for w in LEXICON.split()}, -2.5
    index, dense, votes, spoken = found
    weights, bias = _trained(dense, votes, spoken, KINDS, SHARP, RIDGE)
    return {f: float(w) for f, w in zip(index, weights, strict=True) if w}, bias


def folds_of_settings(docs: DataFrame, labels: DataFrame, learn: Column, settings: list[tuple[int, float, float]], folds: int = 5) -> list[tuple[int, float, float, float, float]]:
    """(kinds, sharp, ridge, recall, share of clean rows flagged) over folds of the rows for which learn holds, best first.

    Each fold is left out in turn: features, voters and classifier come from the others, so no row that a score is judged by
    has taught it. The constants KINDS, SHARP and RIDGE are what this gives; rows outside of learn take no part.
    """
    part = crc_mod(F.col("doc_id"), 1009) % folds
    hits = {s: np.zeros(4) for s in settings}
    for fold in range(folds):
        found = _table(docs, labels, learn & (part != fold))
        if found is None:
            continue
        index, dense, votes, spoken = found
        mine = labels.where(learn & (part == fold)).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        judged = stored(docs.select("doc_id", "text").where("text IS NOT NULL").join(mine, "doc_id"))
        toxic = {r["doc_id"]: r["toxic"] for r in judged.select("doc_id", "toxic").collect()}
        for s in settings:
            weights, bias = _trained(dense, votes, spoken, *s)
            model = {f: float(w) for f, w in zip(index, weights, strict=True) if w}, bias
            for r in toxicity(judged, model).collect():
                hits[s] += np.array([toxic[r["doc_id"]], toxic[r["doc_id"]] * (r["score"] >= 0.7), 1 - toxic[r["doc_id"]], (1 - toxic[r["doc_id"]]) * (r["score"] >= 0.7)])
        discard(judged)
    rows = [(*s, float(h[1] / max(h[0], 1)), float(h[3] / max(h[2], 1))) for s, h in hits.items()]
    return sorted(rows, key=lambda r: (-(r[3] - 5 * r[4]), r[:3]))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weights, bias = model.value
    asked: dict[str, list[tuple[str, float]]] = {}
    for feature, weight in weights.items():
        suffix = next((x for x in ("#2", "#3", "%") if feature.endswith(x)), "")
        asked.setdefault(feature.removesuffix(suffix), []).append((suffix, weight))
    automaton = ahocorasick.Automaton()
    for text in asked:
        automaton.add_word(text.encode().decode("latin-1"), text)
    if asked:
        automaton.make_automaton()
    for batch in pieces(batches):
        total = []
        texts = batch.column("text") if "text" in batch.schema.names else batch.column("key").field("text")
        for text in texts.to_pylist():
            value = bias
            if text and asked:
                line = _line(text)
                found = Counter(x for _, x in automaton.iter(line.decode("latin-1")))
                words = len(line.split()) if found else 0
                value += sum(sorted(w for x, n in found.items() for suffix, w in asked[x] if ASKED[suffix](n, words)))
            total.append(value)
        score = 1 / (1 + np.exp(-np.clip(np.array(total, float), -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score)], ["key", "score"])


def toxicity(docs: DataFrame, model: tuple[dict[str, float], float], key: str = "doc_id") -> DataFrame:
    """(key, score) for every row of docs(key, text); a struct as key may hold the text itself."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = [F.col("text").cast("string").alias("text")] if "text" in docs.columns else []
    rows = docs.select(F.col(key).alias("key"), *text)
    scored = rows.mapInArrow(lambda it: _score(it, shared), keyed(rows, "score double"))
    return scored.select(F.col("key").alias(key), "score")
