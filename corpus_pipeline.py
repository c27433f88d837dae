"""A training-corpus pipeline over ``documents``: language identification, line
deduplication, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; ``run`` writes each stage's rows in the shared folder and reads them back.
Documents are rows: null doc_ids, and ids that repeat, decide nothing.  Null
texts and texts without letters go in the first stage, documents of repeated
lines alone in the second; of rows that repeat or nearly repeat one stays.  An
empty table passes through as an empty table; columns beside those of documents
are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, drop, join_skewed, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is in a learned language if at least this share of its n-grams is
#: found in some learned text, whatever the number of languages.  Of documents
#: in their languages even single words reach 0.87; other scripts and random
#: letters stay under 0.4.
LEAST_KNOWN = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: null texts, texts without
    a letter, and those of which most n-grams are in no learned text.  The
    classifier learns from documents that are not held out."""
    from tidemark.llm.langid import UNKNOWN, identify, is_held_out

    rows = identify(docs.select(*COLUMNS), learn=~F.coalesce(is_held_out(), F.lit(False)))
    kept = rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= LEAST_KNOWN)).select(*COLUMNS)
    return stage(kept, "languages", rows_at_once=1000)  # workers live on into the next stages, and so does their memory


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document (or line) has, up to one word of eight or
    more or one character of shorter ones, are cut out; documents of which no line is left go."""
    from tidemark.llm.line_dedup import dedup_lines

    rows = dedup_lines(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by a similarity of 0.8 or more between sets
    of five-word shingles, the one with the least id stays (null ids come last)."""
    from tidemark.llm.ngram_join import link_components

    # rows are numbered in a table of their own, so that every use of it sees the same numbers
    rows = stage(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = link_components(rows.select("_row", "text"), n=5, num=80, den=100, key="_row").select("_row", F.col("component_id").alias("_group"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    ranked = stage(groups.join(rows.select("_row", "doc_id"), "_row").select("_group", place.alias("_place")), "groups")
    first = ranked.groupBy("_group").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    others = stage(
        join_skewed(ranked, stage(first, "group-firsts"), "_group", "_n", most=100_000).filter("_place <> _first").select("_place._row"), "others"
    )
    return rows.join(broadcast_if_small(others), "_row", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in as few sequences of 1024 tokens as can be found."""
    from tidemark.llm.packing import pack

    return pack(docs, capacity=1024)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, and the search for fillings, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)
        before = docs
    return docs
