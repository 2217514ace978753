"""A corpus pipeline of five stages: each reads what the one before it kept.

Near-duplicates here are documents whose sets of five-word shingles reach a Jaccard similarity of
0.8. Every stage returns the columns of ``documents``, but for the last, which returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import decontaminate, jaccard, langid, mixing, secret_scan
from lanewise.llm.common import table
from lanewise.llm.queries import PIECES
from lanewise.session import discard, stored

MIN_SCORE = 0.5
NEAR = jaccard.Rule(words=5, percent=80)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids``; rows without id stay."""
    return docs.join(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").select(docs.columns)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or without a language of at least even odds, go."""
    model = langid.fit(docs, langid.read_pieces(PIECES))
    found = langid.predictions(model, docs, into="__language")
    good = (F.col("__language.lang") != "und") & (F.col("__language.score") >= MIN_SCORE)
    return found.where(good).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n-gram Jaccard join: the smallest id of each group of near-duplicates stays."""
    groups = jaccard.similar_groups(docs, NEAR)
    return _without(docs, stored(groups.where("doc_id <> component_id").select("doc_id"), "near-copies"))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a copy of a benchmark item go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, stored(found.select("doc_id").distinct(), "leaks"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret span becomes ``[secret]``; all documents stay."""
    found = secret_scan.scan(docs, keep=True)
    text = secret_scan.masked(F.col("text"), [r.kind for r in secret_scan.BASE_RULES + secret_scan.MORE_RULES])
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a row per document with its copies and words taken."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", keep_identified),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_benchmark_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]

# The fitted language model and the dual of the mix have no SQL; tests hold the stages against
# plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
