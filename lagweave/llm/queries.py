"""Queries of the subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, merkle, pii, toxicity, warc
from .common import WORD, crc_mod, table
from .decontaminate import decontaminate
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_jaccard_join
from .periodic_runs import periodic_runs
from .prefix_trie import prefix_trie, rebuilt_paths
from .substring_dedup import substring_dedup


def op1_warc_dictionary_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written and read back. Null html is empty; repeated rows are each returned; no pages, no rows; extra columns are ignored."""
    records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and discovered personal data per document. Null text is empty; repeated rows are each returned; no documents, no rows; extra columns are ignored."""
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language per document, learned from the rows that aren't held out. Null and letterless texts, and all texts if nothing was learned, are 'und'; a null id is not held out and teaches nothing; repeated rows are each returned."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 5) != 0)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text. Null text is empty; ties of an id go by text hash, null ids last; repeated rows are each returned; no documents, no rows; extra columns are ignored."""
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op5_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without its later repeated runs of lines. Null text stays null; rows that repeat an id and text are one document, each returned; no documents, no rows."""
    cut = line_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document. Null text has no words, a null source comes last; repeated rows draw alike; no documents, no rows; extra columns are ignored."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document. Null and wordless texts have no shingles and no links, a null id no component; repeated rows are each returned; no documents, no rows; extra columns are ignored."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article of each page. Null and empty html give ''; repeated rows are each returned; no pages, no rows; extra columns are ignored."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each document. Null and wordless texts and items have no words and no windows; repeated rows are each returned; without benchmark nothing is hit; extra columns are ignored."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_weakly_supervised_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from the rows that aren't held out. Null and empty texts get the score of a text without features; null labels teach nothing; without labels of both classes a word list scores; repeated rows are each returned."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    scored = toxicity.toxicity(docs, model)
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations. Null roles and texts are empty, null ids belong to none; turns that tie are ordered by digest, repeated rows are repeated turns; no conversations, no rows; extra columns are ignored."""
    return prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of each document, of which a tenth by id is made periodic first. Null text has no words; a null id changes nothing; repeated rows are each returned; no documents, no rows; extra columns are ignored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, w = F.floor(h / 10), F.col("_w")
    a = F.pmod(g, F.size(w)).cast("int")
    p = (F.floor((F.size(w) - F.col("_a")) / (3 + g % 8)) + 1).cast("int")
    again = F.concat(F.slice(w, 1, F.col("_a")), F.transform(F.sequence(F.lit(0), F.size(w) - F.col("_a") - 1), lambda i: F.get(w, F.col("_a") + i % F.col("_p"))))
    found = F.when((h % 10 == 0), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    docs = docs.withColumn("_w", found).withColumn("_a", F.when(F.size(w) > 0, a)).withColumn("_p", p)
    docs = docs.withColumn("text", F.when(F.col("_a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text"))).select("doc_id", "text")
    runs = periodic_runs(docs)
    lines = F.array_join(F.transform("_runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return runs.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("_collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op13_fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words without those of windows of 20 that start earlier too. Null text has no words; rows that repeat an id and text are one document, each returned; null ids come last; no documents, no rows; extra columns are ignored."""
    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 20)
    return cut.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Words by the contracts' separators, in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SQL = {
    "op1_warc_dictionary_writer": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN first <> page_id THEN first END AS refers_to FROM f
    """,
    "op6_source_mix": rf"""
        WITH sized AS (SELECT doc_id, source, text, len({_WORDS})::BIGINT AS size FROM documents),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM sized GROUP BY source),
        capped AS (
          SELECT *, 3 * source_size / w AS r, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
            coalesce(sum(source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
            coalesce(sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw FROM sources),
        unit AS (SELECT arg_min(u, r) AS u FROM (SELECT (total - 3 * c)::DOUBLE / (all_w - cw)::DOUBLE AS u, 3 * source_size / w::DOUBLE AS r FROM capped) WHERE u <= r),
        targets AS (SELECT source, source_size, least(w * (SELECT u FROM unit), (3 * source_size)::DOUBLE) AS target FROM sources),
        rated AS (
          SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 1 END AS rate,
            ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
          FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
    """,
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
        reach AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(low) FROM reach WHERE id = d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op9_benchmark_decontamination": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) > 0),
        spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM w, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
        hits AS (SELECT doc_id, p, g.n AS n, item_id FROM spots JOIN g ON g.n = spots.n AND g.g = array_to_string(w[p:p + spots.n - 1], ' ')),
        words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
        SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM w LEFT JOIN words ON words.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id
    """,
    "op11_prefix_trie": r"""
        WITH RECURSIVE bits AS (SELECT range AS n, 0 AS k, range AS v FROM range(256) UNION ALL SELECT n, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM bits WHERE k < 8),
        crc AS (SELECT list(v ORDER BY n) AS tab FROM bits WHERE k = 8),
        t AS (
          SELECT conv_id, turn, md5(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, ''))) AS d, octet_length(encode(coalesce(text, '')))::BIGINT AS b
          FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS d, list(b ORDER BY turn NULLS FIRST, d) AS b FROM t GROUP BY conv_id),
        cut AS (
          SELECT own.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda x, y: xor(x >> 8, tab[xor(x & 255, y) + 1])), 4294967295) % 9 AS h FROM own, crc),
        paths AS (
          SELECT c.conv_id, list_concat(coalesce(f.d, [])[1:c.h], c.d[c.h + 1:]) AS d, list_concat(coalesce(f.b, [])[1:c.h], c.b[c.h + 1:]) AS b
          FROM cut c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 5),
        mark AS (SELECT conv_id, len(d) AS n, list_prepend('', list_transform(range(1, len(d) + 1), lambda k: md5(array_to_string(d[1:k], '')))) AS k, list_prepend(0, b) AS b FROM paths),
        each AS (SELECT conv_id, n, unnest(k) AS k, unnest(list_prepend(NULL, k[:-2])) AS up, unnest(b) AS b, unnest(range(n + 1)) AS depth FROM mark),
        node AS (
          SELECT k, any_value(up) AS up, any_value(b) AS b, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
          FROM each GROUP BY k, depth),
        kids AS (SELECT up, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
        above AS (SELECT a.k AS top, node.k, (node.n_convs - 1) * node.b AS own, kids.n_children IS NULL AS leaf
          FROM node JOIN mark ON mark.conv_id = node.conv_id LEFT JOIN kids ON kids.up = node.k, LATERAL (SELECT unnest(mark.k[:node.depth + 1]) AS k) a),
        sums AS (SELECT top, count(*) FILTER (leaf) AS n_leaves, sum(own) AS saved FROM above GROUP BY top)
        SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, node.ends_sha256
        FROM node JOIN sums ON sums.top = node.k LEFT JOIN kids ON kids.up = node.k LEFT JOIN node p ON p.k = node.up
    """,
    "op13_fixed_block_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        spots AS (
          SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda p: array_to_string(w[p:p + 19], ' '))) AS g FROM w WHERE len(w) >= 20),
        ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM spots),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM ranked WHERE n > 1),
        each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM each ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
        SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
