"""The pipeline's stages: each decision takes effect on the stage's own input, and clean documents stay."""

import collections
import hashlib
import random
import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from lagweave.llm import toxicity

from .test_text_operators import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_planted_rows(spark, tmp_path):
    item = words(900, 30)
    passage = words(901, 55)
    clean = [(i, words(i, 80) + "\n" + words(i + 300, 30)) for i in range(1, 30)]
    near = words(950, 100)
    rows = clean + [(100, near), (101, near + " extra"), (102, near), (110, words(960, 40) + "\n" + passage), (111, words(961, 40) + "\n" + passage), (120, words(970, 20) + " " + item + " " + words(971, 20)), (130, words(980, 30) + " idiot moron " + words(981, 9)), (140, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = {name: f for name, f in pipeline.STAGES}
    before = {r.doc_id for r in docs.collect()}

    def ids(df):
        assert df.columns == COLUMNS
        return {r.doc_id: r.text for r in df.collect()}

    assert ids(step["toxicity"](spark, docs, str(tmp_path))).keys() == before - {130}
    cut = ids(step["line dedup"](spark, docs, str(tmp_path)))
    assert cut.keys() == before - {102} and passage in cut[110] and passage not in cut[111] and cut[111]
    assert ids(step["n-gram Jaccard join"](spark, docs, str(tmp_path))).keys() == before - {101, 102}
    assert ids(step["benchmark decontamination"](spark, docs, str(tmp_path))).keys() == before - {120}
    mixed = step["source mix"](spark, docs, str(tmp_path))
    assert mixed.columns == [*COLUMNS, "copy"] and mixed.agg(F.max("copy")).first()[0] <= 3
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    final = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert not final & {101, 102, 120, 130} and final <= before


def _plain(rows, toxic, items):
    """The five stages in plain Python over (doc_id, text, source); toxic ids are given."""
    docs = [r for r in rows if r[0] not in toxic]
    # line dedup: a run of lines of 50 words or more that an earlier document has goes
    seen, left = set(), []
    for i, text, source in sorted(docs):
        lines = text.split("\n")
        kept = [x for x in lines if x not in seen or len(x.split()) < 50]
        seen.update(lines)
        if kept:
            left.append((i, "\n".join(kept), source))
    # near copies: components of the pairs from 0.8 on, the smallest id stays
    grams = {i: {tuple(w[k : k + 5]) for w in [re.findall(r"\w+", t.lower())] for k in range(len(w) - 4)} for i, t, _ in left}
    lead = {i: i for i in grams}
    pairs = [(a, b) for a in grams for b in grams if a < b and grams[a] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    for _ in grams:
        for a, b in pairs:
            lead[a] = lead[b] = min(lead[a], lead[b])
    left = [r for r in left if lead[r[0]] == r[0]]
    return [r for r in left if not any(item in r[1] for item in items)]


def _copies(rows):
    """Copies of each id: words shared among sources by weights 1, 2, 3, at most thrice a source's own, and a seeded draw."""
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    full: set = set()
    while True:
        unit = (sum(size.values()) - 3 * sum(size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in size if weight[s] * unit > 3 * size[s]}
        if more == full:
            break
        full = more
    out = {}
    for i, _, source in rows:
        rate = min(weight[source] * unit / size[source], 3.0)
        draw = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
        out[i] = int(rate) + (draw < rate - int(rate))
    return {i: n for i, n in out.items() if n}


def test_run_equals_plain_version(spark, tmp_path):
    common = words(1, 60).split()  # both classes draw on the same words
    text = lambda i, n: " ".join(random.Random(i).choices(common, k=n))
    item = words(900, 30)
    passage = words(901, 55)
    near = words(950, 100)
    rows = [(i, text(i, 80) + "\n" + text(i + 300, 30), f"s{i % 3}") for i in range(1, 61)]
    bad = [(i, text(i, 60) + " grumblik snarvok " + text(i + 400, 30), "s1") for i in range(200, 230)]
    rows += [*bad, (100, near, "s0"), (101, near + " extra", "s1"), (102, near, "s2"), (110, words(960, 40) + "\n" + passage, "s0"), (111, words(961, 40) + "\n" + passage, "s1"), (120, words(970, 20) + " " + item + " " + words(971, 20), "s2")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0) for i in range(1, 41)] + [(i, 1) for i in range(200, 222)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    weights, _ = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), F.lit(True))
    assert not weights.keys() <= {f" {w} " for w in toxicity.LEXICON.split()}, weights  # fitted, not the lexicon
    kept = _plain(rows, {r[0] for r in bad}, [item])
    assert {r[0] for r in kept} == {r[0] for r in rows} - {r[0] for r in bad} - {101, 102, 120}
    got = pipeline.run(spark, str(tmp_path)).collect()
    copies = _copies(kept)
    assert copies == collections.Counter(r.doc_id for r in got)
    want = {i: (t, s) for i, t, s in kept}
    assert {r.doc_id: (r.text, r.source) for r in got} == {i: want[i] for i in copies}
    assert all(r.n_chars == len(r.text) and r.lang == "en" for r in got)
    assert {i: sorted(r.copy for r in got if r.doc_id == i) for i in copies} == {i: list(range(1, n + 1)) for i, n in copies.items()}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, empty tables and clashing columns have the results that the stages state."""
    base = words(1, 60)
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base, "en", None, 1), (4, None, None, "a", None), (5, "", "en", "b", 0), (None, base + " z", "en", "a", 1), (6, "one two", "en", "b", 7), (7, words(2, 3000), "en", "a", 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("q") for c in ("row", "key", "_row", "_doc", "score", "n_hit", "component_id", "_size", "_copies", "_n_removed", "copy", "order", "items")}
    wide = plain.withColumns(clash)
    spark.createDataFrame([(1, None), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "--"), (3, words(2, 12)), (3, words(2, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    kept = {"toxicity": {1, 2, 4, 5, None, 6, 7}, "line dedup": {1, 4, 5, 6, 7, None}, "n-gram Jaccard join": {1, 4, 5, None, 6, 7}, "benchmark decontamination": {1, 2, 4, 5, None, 6}}
    for name, stage in pipeline.STAGES:
        one, two = stage(spark, plain, str(tmp_path)), stage(spark, wide, str(tmp_path))
        assert ids(one) == ids(two)
        assert stage(spark, plain.limit(0), str(tmp_path)).count() == 0
        if name in kept:
            assert one.columns == plain.columns and two.columns == wide.columns
            assert {i for i, _ in ids(one)} == kept[name] and ids(one)[1, base] == 2
        else:
            assert one.columns == [*plain.columns, "copy"] and set(two.columns) == set(wide.columns)
    empty = str(tmp_path / "empty")
    for table, kind in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{empty}/{table}.parquet")
    assert all(stage(spark, plain, empty).count() >= 5 for _, stage in pipeline.STAGES)
