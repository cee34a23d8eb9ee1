"""Cleaning of a text corpus in stages: each works on all that the one before it kept.

Stages return the columns of documents; the last adds copy, the number of the copy from 1. What each does with the edge
cases of its input is said where its operator is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import toxicity
from lagweave.llm.common import WORD, crc_mod, discard, stored, table
from lagweave.llm.decontaminate import decontaminate
from lagweave.llm.line_dedup import line_dedup
from lagweave.llm.mixing import emitted, mix
from lagweave.llm.ngram_join import ngram_jaccard_join

#: Score from which a document is rejected as toxic.
TOXIC = 0.7
#: Words from which a repeated run of lines is deleted.
RUN_WORDS = 50


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, their text within, for operators that hand a key through."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go. Null and empty texts stay; without labels of both classes a word list scores; repeated rows are each kept or dropped."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return toxicity.toxicity(_rows(docs), model, key="row").where(F.col("score") < TOXIC).select("row.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which no word is left. Null and empty texts stay; rows that repeat an id and text are one document; n_chars follows a cut text."""
    cut = line_dedup(docs, RUN_WORDS)
    left = cut.where((F.col("_n_removed") == 0) | F.col("text").rlike(WORD))
    changed = {"n_chars": F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the smallest id of each group stay. Null and wordless texts and null ids are in no group and stay, repeated rows stay or go together."""
    groups = ngram_jaccard_join(docs, k=5, percent=80)
    others = groups.where("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go. Null and wordless texts stay; without benchmark all stay; repeated rows go alike."""
    return decontaminate(_rows(docs), table(spark, sf_dir, "benchmark"), key="row", spans=False).where("n_hit = 0").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for. Null texts have no words and null sources come last; repeated rows draw alike; a column copy of the input is replaced."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"])
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row")
    mixed = emitted(mix(kept.select(row, "doc_id", "text", "source")))
    return mixed.select(*[F.col(f"row.`{c}`") for c in kept.columns], F.col("_copy").alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mix", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = stored(docs)
            if at > 1:
                discard(before)
    return docs
