"""Personal data: fixed base patterns, and identifiers that bootstrapped contexts reveal.

Base spans are leftmost non-overlapping matches per kind; a match that fails its kind's test is dropped. They are the
seeds. A looser grammar per kind lists candidates beside them; the words around seeds and candidates, as far as NEAR
code points away, are their contexts, the patterns. Spark keeps the graph of (context, instance) and scores it in
rounds: a context's score is the share of weight among its distinct instances, damped for few of them; an instance's
weight is 1 for a seed and else the noisy-or of the scores of its supported contexts, from HEARD on. A context is
supported when at least SUPPORT distinct instances of weight SCORE or more stand in it, seeds or learned ones: so
instances learned in one round support contexts without any seed in the next. The candidates in supported contexts
that score at least SCORE in the last round become spans of the contexts' kind, unless they overlap a base span.

Edge cases: null text is empty. Rows that repeat an id and text get the same spans; they count as one document in the
graph. Spans are code points, end exclusive. An empty table gives an empty result. Extra columns of any name are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, pieces, salted_join, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, SCORE = 3, 5, 0.9
#: Score from which a supported context lends weight to its instances in the next round.
HEARD = 0.5
#: Weight of instances that a context may hold without being doubted; damps contexts with few instances.
DOUBT = 0.5

# The contract's patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What may stand for an identifier of the kind without matching its pattern.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]| at ) ?[A-Za-z0-9-]+ ?(?:\.|[(\[]dot[)\]]| dot ) ?[A-Za-z]{2,}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:[.,][0-9]{1,3}){3,5}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9+])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9.+@])(?:\([0-9]{2,4}\) ?|00|0)?[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,4}(?![0-9])"),
}
#: Cheap tests that a text with a match passes.
_MAY = {"email": re.compile(r"@|\bat\b"), "ip": re.compile(r"[0-9][.,][0-9]|:[0-9A-Fa-f]{0,4}:"), "card": re.compile(r"[0-9][ .-]?[0-9]"), "phone": re.compile(r"[0-9]")}
_DIGIT = re.compile(r"[0-9]")
_BEFORE, _AFTER = re.compile(r"\S+(?=\s*\Z)"), re.compile(r"\s*(\S+)")
#: Code points on either side of an instance in which the words of its contexts lie.
NEAR = 48


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in found.split("."))
    if kind == "card":
        digits = "".join(_DIGIT.findall(found))
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 10 <= len(_DIGIT.findall(found)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    digits = _DIGIT.search(text) is not None
    for kind in KINDS:
        if ("@" in text) if kind == "email" else digits and (kind != "phone" or "+" in text):
            found += [(*m.span(), kind) for m in BASE[kind].finditer(text) if _holds(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _contexts(text: str, start: int, end: int) -> list[str]:
    """The word before, the word after, both, and the two words before, in lower case."""
    left = text[max(0, start - NEAR) : start].split()[-2:]
    right = text[end : end + NEAR].split()[:1]
    one, two, after = (left[-1:] or ["^"])[0].lower(), " ".join(left).lower(), (right or ["$"])[0].lower()
    return [f"{one} _", f"_ {after}", f"{one} _ {after}", f"{two} _"]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.string()), ("seed", pa.bool_()), ("contexts", pa.list_(pa.string()))])
    for batch in pieces(batches):
        spans, items = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            mine = [{"start": a, "end": b, "kind": k, "instance": text[a:b].lower(), "seed": True, "contexts": _contexts(text, a, b)} for a, b, k in base]
            for kind in KINDS if text else ():
                if _MAY[kind].search(text):
                    for m in LOOSE[kind].finditer(text):
                        a, b = m.span()
                        if all(b <= s or e <= a for s, e, _ in base):
                            mine.append({"start": a, "end": b, "kind": kind, "instance": m[0].lower(), "seed": False, "contexts": _contexts(text, a, b)})
            spans.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
            items.append(mine)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("hash"), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(item))], ["key", "hash", "spans", "items"])


def trusted_contexts(uses: DataFrame) -> DataFrame:
    """(kind, context, n) that bootstrapping trusts, with their numbers of uses, from uses(kind, context, instance, seed)."""
    graph = stored(uses.groupBy("kind", "context", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("uses")))
    weight = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("learned", F.lit(0.0)))
    old: list[DataFrame] = []
    weighed = graph.withColumn("learned", F.lit(0.0))
    for turn in range(ROUNDS):
        contexts = weighed.groupBy("kind", "context").agg(
            (F.sum(weight) / (F.count("*") + DOUBT)).alias("score"), F.count_if(weight >= SCORE).alias("support"), F.count("*").alias("n"), F.sum("uses").alias("uses")
        )
        contexts = stored(contexts.where((F.col("support") >= SUPPORT) & (F.col("score") >= HEARD)))
        discard(*old)
        if turn == ROUNDS - 1:
            break
        unknown = salted_join(graph.where("NOT seed").drop("uses"), contexts.select("kind", "context", "score", "n"), ["kind", "context"], F.xxhash64("instance"))
        learned = unknown.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("score") * 0.999)))).alias("learned"))
        learned = stored(learned.join(graph.groupBy("kind", "instance").agg(F.count("*").alias("n")), ["kind", "instance"]))
        weighed = salted_join(graph, learned, ["kind", "instance"], F.xxhash64("context"), how="left")
        old = [contexts, learned]
    trusted = stored(contexts.where(F.col("score") >= SCORE).select("kind", "context", F.col("uses").alias("n")))
    discard(graph, contexts)
    return trusted


def find(docs: DataFrame) -> DataFrame:
    """A row per row of docs(doc_id, text): doc_id, base and found spans as arrays of (start, end, kind)."""
    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    span = "struct<start:bigint,end:bigint,kind:string"
    found = stored(rows.mapInArrow(_find, keyed(rows, f"hash long, spans array<{span}>>, items array<{span},instance:string,seed:boolean,contexts:array<string>>>")))
    items = found.where(F.size("items") > 0).select("key", "hash", F.explode("items").alias("i"))
    uses = items.select("i.kind", "i.instance", "i.seed", F.explode("i.contexts").alias("context"))
    trusted = trusted_contexts(uses)
    open_items = items.where("NOT i.seed").select("key", "hash", "i.start", "i.end", "i.kind", F.explode("i.contexts").alias("context"))
    new = salted_join(open_items, trusted, ["kind", "context"], F.xxhash64("key", "hash", "start")).select("key", "hash", "start", "end", "kind").distinct()
    per_text = new.groupBy("key", "hash").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))
    per_text = per_text.select(F.col("key").alias("key2"), F.col("hash").alias("hash2"), "more")
    joined = found.join(per_text, found["key"].eqNullSafe(per_text["key2"]) & (found["hash"] == per_text["hash2"]), "left")
    return joined.select(F.col("key").alias("doc_id"), "spans", F.coalesce("more", F.expr(f"CAST(array() AS array<{span}>>)")).alias("more"))


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    rank = {k: i for i, k in enumerate(KINDS)}

    def line(spans):
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.coalesce(*[F.when(s["kind"] == k, i) for k, i in rank.items()]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(F.col("spans")), 256).alias("base_sha256"), line(F.concat("spans", "more")).alias("spans"))
