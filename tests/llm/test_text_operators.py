"""Operators over documents against brute force, held-out rows and hand-made edge cases."""

import hashlib
import html
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lagweave.llm import decontaminate as deco
from lagweave.llm import html_text, langid, merkle, mixing, ngram_join, pii, toxicity, warc
from lagweave.llm.common import bucket_of, connected_components, crc_mod, hashed_sample, table
from lagweave.llm.line_dedup import line_dedup
from lagweave.llm.ngram_join import ngram_jaccard_join

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _doc string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, a clashing extra column."""
    base = words(1, 60)
    rows = [
        (1, base, "en", "a", 1, "x"), (1, base, "en", "a", 1, "x"), (2, base, "en", "b", 1, "y"), (3, base + " tail", "de", None, 1, None), (4, None, None, "a", None, "z"),
        (5, "", "en", "b", 0, "z"), (None, base, "en", "a", 1, "z"), (6, "one two", "en", None, 7, "z"), (7, words(2, 20000), "en", "a", 1, "z"), (8, " \t\n ", "en", "c", 4, "z"), (9, "¿?!", "en", "c", 3, "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


# --- n-gram join


def components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = SPLIT.findall(lower(t or ""))
        if i is not None:
            sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            for x in sets[ids[a]]:
                for y in sets[ids[b]]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = find(ids[a]), find(ids[b])
                        up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent", "heavy"), [(3, 90, 256), (5, 80, 2)])
def test_join_equals_brute_force(spark, monkeypatch, k, percent, heavy):
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    some = docs.where("doc_id < 120")
    near = some.where("doc_id < 20").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" tail of new words")).alias("text"))
    shared = some.where("doc_id < 12").select((F.col("doc_id") + 2000).alias("doc_id"), F.concat(F.lit(words(3, 40) + " "), F.substring("text", 1, 60)).alias("text"))
    every = some.union(near).union(shared)
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(every, k, percent).collect()}
    assert got == components([tuple(r) for r in every.collect()], k, percent)


def test_join_edges(spark, odd):
    rows = ngram_jaccard_join(odd, 3, 90).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[None][1] is None
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[8] == (0, 8)
    assert got[6] == (1, 6) and got[9] == (1, 9)
    assert got[1] == got[2] == (58, 1) and got[3] == (59, 1)
    assert ngram_jaccard_join(odd.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 140)} == {100}


def test_buckets(spark):
    cuts = [float(x) for x in range(0, 1000, 7)]
    rows = spark.range(-5, 1010).withColumn("b", bucket_of(F.col("id"), cuts)).collect()
    assert all(r.b == sum(c <= r.id for c in cuts) for r in rows)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(bucket_of(F.col("id"), cuts)).first()[0] == len(cuts) + 1


def test_sample_is_the_first_by_hash(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    every = sorted((r.h % (1 << 64)) >> 1 for r in df.collect())
    for size in (20, 2000):
        assert sorted((r.h % (1 << 64)) >> 1 for r in hashed_sample(df, "h", size).collect()) == every[:size]


# --- line dedup


def expected_lines(rows, least):
    """Brute force: lines of windows (both directions) that stand earlier."""
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    where, out = {}, {}
    spans = []
    for d, (_, i, t) in enumerate(order):
        lines = [(p, x, len(SPLIT.findall(x))) for p, x in enumerate(t.split("\n"))]
        lines = [x for x in lines if x[2]]
        found = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total >= least:
                    found.add((a, b))
                    break
            total = 0
            for b in range(a, -1, -1):
                total += lines[b][2]
                if total >= least:
                    found.add((b, a))
                    break
        for a, b in found:
            spans.append((tuple(x[1] for x in lines[a : b + 1]), (d, lines[a][0], lines[b][0])))
    for key, place in spans:
        where[key] = min(where.get(key, place), place)
    for key, (d, a, b) in spans:
        first = where[key]
        if (d, a, b) > first:
            out.setdefault(d, set()).update(range(max(a, first[2] + 1) if first[0] == d else a, b + 1))
    return {order[d][1:]: gone for d, gone in out.items()}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [words(s, rng.choice([3, 8, 20, 60])) for s in range(30)]
    rows = [(i, "\n".join(rng.choices([*pool, ""], k=rng.randint(1, 12)))) for i in range(80)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    gone = expected_lines(rows, 50)
    for i, t in rows:
        drop = gone.get((i, t), set())
        assert got[i] == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop)


def test_line_dedup_edges(spark, odd):
    rows = line_dedup(odd, 50).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].text and by[2].text == "" and by[None].text == "" and by[3].text.endswith("tail")
    assert by[4].text is None and by[5].text == "" and by[8].text == " \t\n "
    assert by[2]["_doc"] == "y"
    assert line_dedup(odd.limit(0)).count() == 0


# --- decontamination


def test_decontamination_equals_brute_force(spark, monkeypatch):
    def toks(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))

    items = [(1, words(11, 14)), (2, "Short one"), (3, None), (4, "--"), (None, words(12, 12)), (1, words(11, 14)), (5, words(11, 14)), (6, "ÄRGER und größe")]
    texts = [(1, "pre " + items[0][1].upper().replace(" ", ",  ") + " post"), (2, "a short ONE? shorter one"), (3, None), (4, ""), (5, words(13, 3000) + " " + " ".join(items[4][1].split()[1:11])), (6, "ÄRGER, und-größe"), (6, "ärger und größe")]
    docs, tests = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def expect(t):
        w, hit, ids = toks(t), set(), set()
        for i, x in items:
            v = toks(x)
            n = min(10, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add("" if i is None else str(i))
        return len(w), len(hit), sorted(ids)

    want = sorted((i, *expect(t)) for i, t in texts)
    for nodes in (2_000_000, 150):
        monkeypatch.setattr(deco, "MOST_NODES", nodes)
        monkeypatch.setattr(deco, "PIECE", 5000 if nodes > 150 else 3)
        rows = deco.decontaminate(docs, tests).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows) == want
    spans = {r.doc_id: r.spans for r in rows}
    assert texts[0][1][spans[1][0].start : spans[1][0].end].lower().replace(",  ", " ") == items[0][1]
    assert deco.decontaminate(docs.limit(0), tests).count() == 0
    assert deco.decontaminate(docs, tests.limit(0)).where("n_hit > 0").count() == 0


# --- mixing


def test_mix(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    again = {(r.doc_id, r.text): r["_copies"] for r in mixing.mix(odd.repartition(5)).collect()}
    for r in rows:
        assert r["_copies"] == again[r.doc_id, r.text] <= 3
        assert r["_size"] == len(SPLIT.findall(r.text or ""))
        assert r["_target"] <= 3 * r["_source_size"] + 1e-9
    targets = {r.source: r["_target"] for r in rows}
    assert abs(sum(targets.values()) - sum(r["_size"] for r in rows)) < 1e-6
    assert mixing.mix(odd.limit(0)).count() == 0


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 100), (None, 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 3 and got[None] <= 30 and abs(sum(got.values()) - 211) < 1e-9
    assert abs(got["c"] / got["a"] - 3) < 1e-9


def test_taken_words_come_near_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("t"), F.first("_target").alias("g")).collect():
        assert abs(r.t / r.g - 1) < 0.06
    assert mixing.emitted(mixing.mix(docs)).count() == mixing.mix(docs).agg(F.sum("_copies")).first()[0]


# --- archives


def test_archive_round_trip(spark):
    same, long_ = "<p>" + words(21, 40) + "</p>", words(22, 50_000)
    rows = [(5, "http://a", same), (3, "http://b", same), (9, None, same), (3, "http://b", same), (1, "http://c\r\nX: y", None), (2, "http://d", ""), (4, "http://e", "short"), (6, "http://f", "short"), (7, "http://g", long_), (None, "http://h", same), (8, "http://ü", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive(pages, payloads=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {i: h for i, _, h in rows}[r.page_id] or ""
        raw = text.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = text == same and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload == (None if revisit else text)
    assert warc.archive(pages.limit(0)).count() == 0


def test_archive_leads_with_its_dictionary(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload")).coalesce(1)
    warc.write(pages, f"file://{tmp_path}/a")
    raw = next((tmp_path / "a").glob("part-*")).read_bytes()
    assert raw[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    records = list(warc.frames_of(raw))
    assert len(records) == pages.count() and all(x.startswith(b"WARC/1.1\r\n") for x in records)
    assert len(raw) < 0.7 * sum(map(len, records))


# --- language


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 5) != 0)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod(F.col("doc_id"), 5) == 0)
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n >= 0.97


def test_language_edges(spark, odd):
    model = langid.fit(odd, F.lit(True))
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert {rows[i].lang_pred for i in (4, 5, 8, 9)} == {"und"}
    assert rows[7].lang_pred in ("en", "de") and 0 <= rows[7].score <= 1
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(odd, F.lit(False))).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000):
        w = langid.windows_of(bytes(range(1, 256)) * 20 if n == 5000 else b"x" * n)
        assert w.shape[1] == langid.WINDOW and (len(w) - 1) * langid.STEP + langid.WINDOW >= n


# --- personal data


def test_base_spans():
    text = "mail a.b@c.example.com, ip 10.0.0.300 1.2.3.4.5 card 4111 1111 1111 1111 x 4111111111111112 tel +1 (302) 555-8032"
    found = {(k, text[a:b]) for a, b, k in pii.base_spans(text)}
    assert found == {("email", "a.b@c.example.com"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (302) 555-8032")}


def test_contexts_find_unseen(spark):
    rows = [(i, f"é card number: 41111111{i:02d} {words(i, 3)} account no {4000000000000000 + 10 * i} end") for i in range(3)]
    luhn = [n for n in range(4000000000000000, 4000000000000400) if pii._luhn(str(n))]
    rows = [(i, f"é pay with account {n} today") for i, n in enumerate(luhn[:12])] + [(50, f"pay with account {luhn[0] + 1} today"), (51, None), (52, ""), (None, f"x {luhn[1]}"), (0, f"é pay with account {luhn[0]} today")]
    got = pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[50].n_card == 0 and by[50].spans == "card:17:33"
    assert by[51].spans == by[52].spans == "" and by[51].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[0].spans == "card:19:35" and by[0].base_sha256 == hashlib.sha256(b"card:19:35").hexdigest()
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_learned_instances_support_new_contexts(spark):
    """A context without any seed is trusted once instances that another context revealed stand in it."""
    luhn = [n for n in range(4000000000000000, 4000000000001000) if pii._luhn(str(n))]
    wrong = [str(n + 1) for n in luhn]  # no base span
    rows = [(i, f"é pay with account {n} today") for i, n in enumerate(luhn[:60])]
    rows += [(100 + i, f"é pay with account {n} today") for i, n in enumerate(wrong[:6])]
    rows += [(200 + i, f"é the old ledger {n} closed") for i, n in enumerate(wrong[:6])] + [(300, f"the old ledger {wrong[40]} closed"), (301, f"some thing {wrong[41]} else")]
    by = {r.doc_id: r for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(by[100 + i].spans == "card:19:35" for i in range(6))
    assert by[300].n_card == 0 and by[300].spans == "card:15:31" and by[301].spans == ""


def plain_base(text):
    """The base spans by a scan of one character after another."""
    def digits(x):
        return [c for c in x if "0" <= c <= "9"]

    def take(at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    tens, letters = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found, at = [], 0
    while at < len(text):  # email
        end = take(at, letters + tens + "._%+-")
        if end == at:
            at += 1
        elif text[end : end + 1] != "@":
            at = end
        else:
            stop, parts = take(end + 1, letters + tens + "-"), 0
            while stop > end + 1 and text[stop : stop + 1] == "." and take(stop + 1, letters + tens + "-") > stop + 1:
                stop, parts = take(stop + 1, letters + tens + "-"), parts + 1
            if parts:
                found.append((at, 0, stop))
            at = stop if parts else end + 1
    at = 0
    while at < len(text):  # ip
        end, parts = take(at, tens), 1
        while end > at and parts < 4 and text[end : end + 1] == "." and take(end + 1, tens) > end + 1:
            end, parts = take(end + 1, tens), parts + 1
        if parts == 4 and all(int(x) <= 255 for x in text[at:end].split(".")):
            found.append((at, 1, end))
        at = end if parts == 4 else max(at + 1, take(at, tens))
    at = 0
    while at < len(text):  # card
        end = take(at, tens)
        while end > at and text[end : end + 1] in (" ", "-") and take(end + 1, tens) > end + 1:
            end = take(end + 1, tens)
        number = digits(text[at:end])
        if 14 <= len(number) <= 19 and sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(number))) % 10 == 0:
            found.append((at, 2, end))
        at = max(end, at + 1)
    at = 0
    while at < len(text):  # phone
        if text[at] == "+" and text[at + 1 : at + 2] in [*tens]:
            end = take(at + 2, tens + " ().-")
            while end > at + 1 and text[end - 1] not in tens:
                end -= 1
            if end >= at + 4:
                if 10 <= len(digits(text[at:end])) <= 15:
                    found.append((at, 3, end))
                at = end
                continue
        at += 1
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_a_plain_scan(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("text IS NOT NULL").collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choices("0123456789+-. ().@ab", weights=[3] * 10 + [2, 1, 3, 2, 1, 1, 3, 2, 2, 2], k=80)) for _ in range(400)]
    for t in texts:
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in pii.base_spans(t)) == plain_base(t), t


# --- fingerprints


def test_fingerprints(spark, odd):
    text = "\n".join(words(s, 12) + ". " + words(s + 100, 9) + "." for s in range(40))
    edit = text.replace(words(20, 12), "changed")
    docs = spark.createDataFrame([(1, text), (2, edit), (3, text), (5, None), (4, ""), (None, "last"), (3, text)], "doc_id long, text string")
    rows = merkle.fingerprints(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 7
    assert by[1].fingerprint == by[3].fingerprint != by[2].fingerprint
    assert by[4].fingerprint == by[5].fingerprint
    assert 0.9 < by[1].near_next < 1
    assert 0.4 < by[1].near_edited
    order = [(1, text), (2, edit), (3, text), (3, text), (4, ""), (5, ""), (None, "last")]
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert hashlib.sha256(e.encode()).hexdigest() in {r.edited_sha256 for r in rows if r.doc_id == i}
    pair = spark.createDataFrame([(text, edit)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert pair.select(merkle.changed(F.col("a"), F.col("b"))).first()[0] == 20
    assert merkle.fingerprints(odd).count() == odd.count() and merkle.fingerprints(odd.limit(0)).count() == 0


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    docs = spark.range(100).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    for r in merkle.next_rows(docs.withColumn("print", F.col("text"))).collect():
        assert r.next_text == f"t{(r.doc_id // 3 + 1) % 100}"


# --- rare languages


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 200)
    rows = [(i, " ".join("abcdefgh"[(i * k) % 8] * (1 + k % 4) for k in range(1, 30)) + f" {i}", "aa") for i in range(3000)]
    rows += [(7000 + i, " ".join("uvwxyz"[(i + k) % 6] * (1 + k % 3) for k in range(1, 30)), "zz") for i in range(4)] + [(1, rows[1][1], "aa")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model[0] == ["aa", "zz"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("doc_id < 40 OR doc_id >= 7000"), model).collect()}
    assert all(v == ("zz" if k >= 7000 else "aa") for k, v in got.items())
    names, sample = langid._sample(docs.select(F.xxhash64("doc_id", "text").alias("order"), "lang", F.col("text").alias("cut")))
    assert names == ["aa", "zz"] and sample["lang"].value_counts().to_dict() == {"aa": 196, "zz": 4}


def test_shares_of_languages(monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 1000)
    assert langid._share([10**9, 10, 10**6]) == 495 and langid._share([600, 300]) >= 600 and langid._share([5000] * 50) == langid.LEAST and langid._share([]) == langid.LEAST


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<header><h2>Site</h2></header><div class="ad">buy this</div><div id="cookie-notice"><p>We use cookies a lot here</p></div><article><header><h1>Head &amp; tail</h1></header><p><b>One
two<br><p>three &lt;four&gt; <em>fi</em>ve</p><ul><li>item<li>other</ul><div class="share"><a href="#">Share</a></div><section class="comments"><p>Nice</p></section></article>
<aside><p>side bar text</p></aside><form><input name=q><button>Go</button></form><footer>&copy; foot"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & tail One two three <four> five item other"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text("<div><p>a &am") == "a &am"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


TEXT = "<p>Many plain words stand in this long paragraph</p><p>and as many in the one after it, too</p>"
PLAIN = "Many plain words stand in this long paragraph and as many in the one after it, too"


@pytest.mark.parametrize("name", ['class="content has-sidebar"', 'id="post-with-comments"', 'class="comments-open post"', 'class="page widget"', 'class="has-header"'])
def test_names_beside_others_keep_the_article(name):
    assert html_text.main_text(f"<body><nav>menu</nav><div {name}>{TEXT}</div><div>few</div></body>").startswith(PLAIN)


def test_names_still_drop_parts():
    for name in ('class="sidebar"', 'class="sidebar-left box"', 'class="adBanner"', 'id="main-nav"', 'class="cookie-notice big"', 'class="share"'):
        assert html_text.main_text(f"<body><div {name}><p>other words of a part</p></div>{TEXT}</body>") == PLAIN


def test_linked_blocks_stay_in_the_article():
    linked = '<p><a href="/a">all of it a link</a></p><ul><li><a href="/b">one</a></li><li><a href="/c">two</a></li></ul>'
    for page in (f"<article>{TEXT}{linked}</article>", f"<div>{TEXT}{linked}</div>", f"{TEXT}{linked}<p>More plain words</p>"):
        assert html_text.main_text(f"<body>{page}</body>").removesuffix(" More plain words") == PLAIN + " all of it a link one two"
    menu = '<ul><li><a href="/b">one</a></li><li><a href="/c">two</a></li></ul>'
    assert html_text.main_text(f"<body>{menu}{TEXT}{menu}</body>") == PLAIN
    assert html_text.main_text(f"<body>{menu}</body>") == "one two"


P1, P2 = "<p>The first paragraph says many plain words before the part</p>", "<p>The last paragraph says just as many plain words after it</p>"
T1, T2 = "The first paragraph says many plain words before the part", "The last paragraph says just as many plain words after it"
PARTS = {
    "quotation": ("<blockquote>" + "".join(f"<p>Quoted paragraph number {i} holds a good many words of its own</p>" for i in range(5)) + "</blockquote>", " ".join(f"Quoted paragraph number {i} holds a good many words of its own" for i in range(5))),
    "list": ("<ul>" + "".join(f"<li>Item {i} holds several words</li>" for i in range(12)) + "</ul>", " ".join(f"Item {i} holds several words" for i in range(12))),
    "table": ("<table>" + "".join(f"<tr><td>Row {i}</td><td>its value</td></tr>" for i in range(12)) + "</table>", " ".join(f"Row {i} its value" for i in range(12))),
    "link": ('<p><a href="/x">a whole paragraph as a link</a></p>', "a whole paragraph as a link"),
    "related work": ('<div class="related-work"><p>Others wrote about it before us</p></div>', "Others wrote about it before us"),
    "box": ("<div class=box>" + "".join(f"<p>Boxed paragraph number {i} holds a good many words of its own</p>" for i in range(12)) + "</div>", " ".join(f"Boxed paragraph number {i} holds a good many words of its own" for i in range(12))),
}


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("around", ["", "article", "main", "div", "section"])
def test_parts_inside_an_article_stay(part, around):
    inner, text = PARTS[part]
    page = f"<{around}>{P1}{inner}{P2}</{around}>" if around else P1 + inner + P2
    menu = '<nav><a href="/a">menu</a></nav><ul><li><a href="/b">one</a></li><li><a href="/c">two</a></li></ul>'
    assert html_text.main_text(f"<body>{menu}{page}<footer>foot</footer></body>") == f"{T1} {text} {T2}"


def test_headings_above_the_article_stay():
    assert html_text.main_text(f"<body><div><h1>Title</h1><div>{TEXT}</div></div><div><a href=/a>x</a></div></body>") == "Title " + PLAIN


def test_densities_equal_the_formula():
    page = "<div><p>one two <a href=/a>three</a></p><p>four</p></div><ul><li><a href=/b>five</a></li></ul>"
    order = html_text.measure(html_text.parse(page))
    # characters, tags, characters of links, links of each node; the logarithm's base from the whole page
    counts = {"body": (19, 7, 9, 2), "div": (15, 3, 5, 1), "ul": (4, 2, 4, 1)}
    for node in order:
        if node.tag in counts:
            chars, tags, linked, links = counts[node.tag]
            assert (node.chars, node.tags, node.link_chars, node.links) == counts[node.tag]
            base = math.log(chars / max(chars - linked, 1) * linked + 9 / 19 * chars + math.e)
            assert node.density == pytest.approx(chars / tags * max(math.log(chars / linked * tags / links), 0) / max(math.log(base), 0.1))


def test_articles_in_comments_stay_out():
    notes = "<article><p>A reader says this and that</p></article>" * 3
    for page in (f"<article>{TEXT}</article><div class='comments'>{notes}</div>", f"{TEXT}<section id=comments>{notes}</section>", f"<div class='content'>{TEXT}</div><div class='comments'><div>{notes}</div></div>"):
        assert html_text.main_text(f"<body>{page}</body>") == PLAIN
    assert html_text.main_text(f"<body><div class='comments'>old<article>{TEXT}</article></body>") == PLAIN


def test_pages_keep_the_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?[a-z0-9]+>", " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    assert html_text.extract(pages.limit(0)).count() == 0


# --- toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    got = toxicity.toxicity(docs, model).join(labels, "doc_id").where(crc_mod(F.col("doc_id"), 3) == 1)
    seen = Counter((r.toxic, r.score >= 0.7) for r in got.collect())
    assert seen[1, True] / (seen[1, True] + seen[1, False]) >= 0.9
    assert seen[0, True] <= 0.02 * (seen[0, True] + seen[0, False])


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(odd, toxicity.fit(odd, labels, F.lit(True))).collect()}
    assert scores[4] == scores[5] == scores[9] < 0.5
    bad = spark.createDataFrame([(1, "you IDIOT"), (2, "kind words")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(bad, toxicity.fit(bad, labels.limit(0), F.lit(True))).collect()}
    assert got[1] >= 0.7 > got[2]
    assert toxicity.toxicity(odd.limit(0), ({}, 0.0)).count() == 0


# --- repeated rows, clashing columns


def test_equal_rows_fill_samples(spark):
    """40,000 equal rows: samples are whole, models are learned and dictionaries made."""
    for text in ("aa bb", "other words", "und noch ein Text"):
        df = spark.range(40_000).select(F.lit(text).alias("cut"), F.xxhash64(F.lit(text)).alias("order"))
        assert hashed_sample(df, "order", 8000).count() == 8000
        assert hashed_sample(df.limit(50), "order", 8000).count() == 50
    docs = spark.range(40_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("some plain words here").alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(docs, F.lit(True))
    assert model[0] == ["en"] and {r.lang_pred for r in langid.identify(docs.limit(3), model).collect()} == {"en"}
    for key in range(4):
        pages = spark.range(2000).select(F.lit(key).cast("long").alias("key"), F.lit("u").alias("url"), F.lit("<p>" + words(key, 60) + "</p>").alias("payload"))
        assert len(warc.dictionary(pages.withColumn("digest", F.sha2("payload", 256)))) > 100
    labels = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, F.lit(True))[1] == -2.5  # one class only: the lexicon


def test_a_third_of_all_rows_in_one_group(spark):
    """Copies of one page, line and context are dealt to several tasks, with the same results."""
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("x" * 200)).otherwise(F.concat(F.lit("y" * 100), F.col("id").cast("string"))).alias("html"))
    got = warc.archive(pages).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r.record_type, r.refers_to or 0, r["count"]) for r in got) == [("response", 0, 6001), ("revisit", 0, 2999)]
    line = words(5, 60)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.lit("\n"), F.when(F.col("id") % 3 == 0, F.lit(line)).otherwise(F.lit("few"))).alias("text"))
    assert line_dedup(docs).agg(F.sum("_n_removed")).first()[0] == 1999


def test_clashing_columns(spark, odd, tmp_path):
    """Columns with the names that operators use inside change no result."""
    clash = {c: F.lit("z") for c in ("key", "row", "hash", "text2", "digest", "payload", "first", "n", "items", "ranges", "spans", "order", "_range", "_tie", "print", "score", "size", "source_size", "target", "_target", "_source", "_copy", "copy", "url2", "lines", "k", "u")}
    more = odd.withColumns(clash)
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    tests = spark.createDataFrame([(1, words(1, 12))], "item_id long, text string")
    assert rows(deco.decontaminate(odd, tests), "doc_id", "n_hit", "items") == rows(deco.decontaminate(more, tests.withColumn("id", F.lit("q"))), "doc_id", "n_hit", "items")
    assert rows(pii.digests(pii.find(odd)), "*") == rows(pii.digests(pii.find(more)), "*")
    assert rows(merkle.fingerprints(odd), "*") == rows(merkle.fingerprints(more), "*")
    assert rows(line_dedup(odd), "doc_id", "text") == rows(line_dedup(more), "doc_id", "text")
    mixed = mixing.mix(more)
    assert rows(mixing.mix(odd), "doc_id", "_copies") == rows(mixed, "doc_id", "_copies")
    assert set(more.columns) - set(mixing.ADDED) <= set(mixed.columns) and mixed.select("_source").distinct().collect()[0][0] == "z"
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    wide = pages.withColumns(clash)
    assert rows(warc.archive(pages), "*") == rows(warc.archive(wide), "*")
    assert rows(html_text.extract(pages), "*") == rows(html_text.extract(wide), "*")
    assert html_text.extract(pages.where("page_id = 7")).first().n_chars == len(words(2, 20000))
    model = ({" idiot ": 1.0}, 0.0)
    assert rows(toxicity.toxicity(odd, model), "*") == rows(toxicity.toxicity(more, model), "*")
    assert rows(ngram_jaccard_join(odd), "*") == rows(ngram_jaccard_join(more), "*")


def test_long_and_odd_texts_have_personal_data(spark):
    long_ = words(7, 20000) + " a@b.cc " + words(8, 20000)
    got = pii.digests(pii.find(spark.createDataFrame([(1, long_), (1, long_), (2, "")], "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.n_email) for r in got) == [(1, 1), (1, 1), (2, 0)]


def naive_tree(text):
    """Root and (section, paragraph, leaves) of a text's tree in plain Python."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parts = [[sha(c) for c in re.split(merkle.CLAUSE, p)] for p in text.split("\n")]
    sections, run = [], []
    for i, p in enumerate(parts):
        run.append((sha(".".join(p)), p))
        if int(run[-1][0][:8], 16) % merkle.SECTION == 0 or i == len(parts) - 1:
            sections.append((sha(",".join(h for h, _ in run) if len(run) else ""), run))
            run = []
    return sha(",".join(h for h, _ in sections)), sections


def test_fingerprints_equal_a_plain_tree(spark):
    short = merkle.DIGITS
    rng = random.Random(9)
    pool = [words(s, 3) + rng.choice([".", "!", ""]) for s in range(40)]
    texts = ["\n".join(" ".join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["", "\n", "a.b\n"]
    trees = [naive_tree(t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("p", merkle.fingerprint(F.col("t")))
    prints = {r.i: r.p for r in df.collect()}
    for i, (root, sections) in enumerate(trees):
        body = ";".join(h[:short] + "=" + ",".join(p[:short] + ":" + ".".join(c[:short] for c in leaves) for p, leaves in run) for h, run in sections)
        assert prints[i] == f"{root}|{body}"
    two = df.select(F.col("i").alias("j"), F.col("p").alias("q"))
    for r in df.crossJoin(two).select("i", "j", merkle.likeness(F.col("p"), F.col("q")).alias("near"), merkle.differing(F.col("p"), F.col("q")).alias("gone")).collect():
        a, b = ({c[:short] for _, run in trees[x][1] for _, p in run for c in p} for x in (r.i, r.j))
        assert abs(r.near - 2 * len(a & b) / (len(a) + len(b))) < 1e-12
        mine = [p for _, run in trees[r.i][1] for p, _ in run]
        other, whole = {p for _, run in trees[r.j][1] for p, _ in run}, {h for h, _ in trees[r.j][1]}
        inside = [h in whole for h, run in trees[r.i][1] for _ in run]
        assert r.gone == [k for k, p in enumerate(mine) if p not in other and not inside[k]]


def test_network_equals_a_plain_convolution():
    import numpy as np

    net, windows = langid.ByteCNN(3), np.random.default_rng(1).integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for row in windows:
        mine = []
        for w in langid.WIDTHS:
            out = np.array([net.p["e"][row[a : a + w]].reshape(-1) @ net.p[f"c{w}"] + net.p[f"b{w}"] for a in range(langid.WINDOW - w + 1)])
            mine.append(np.maximum(out.max(0), 0))
        pooled.append(np.concatenate(mine) @ net.p["o"] + net.p["ob"])
    want = np.exp(pooled) / np.exp(pooled).sum(1, keepdims=True)
    assert np.allclose(net.predict(windows), want, atol=1e-5)
    target = np.eye(3, dtype=np.float32)[[0, 1, 2, 0]]
    loss = lambda: -np.log((net.predict(windows) * target).sum(1)).mean()
    grads = net._gradients(windows, target)
    for name, at in (("o", (0, 1)), ("c3", (5, 2)), ("ob", (2,)), ("b2", (1,))):
        kept = net.p[name][at].copy()
        net.p[name][at] = kept + 1e-2
        high = loss()
        net.p[name][at] = kept - 1e-2
        low = loss()
        net.p[name][at] = kept
        assert abs((high - low) / 2e-2 - grads[name][at]) < 2e-3


def test_label_model_finds_classes_without_labels():
    import numpy as np

    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.2
    votes = np.column_stack([np.where(rng.random(3000) < np.where(truth, 0.6, 0.002), 1, 0) for _ in range(6)])
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0], -(votes.sum(1) == 0).astype(int)])  # copies of a voter count once
    posterior = toxicity.label_model(votes, np.where((votes == 1).any(1), 0.9, 0.1))
    assert ((posterior > 0.5) == truth).mean() > 0.95
