"""The corpus pipeline: five of the training-data operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join, line_dedup, mixing, quality_rules, sentencepiece_wfst
from graphloom.llm.common import by_key, read, stored, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the lines that fail a rule go from the others.  Ids play no part; null and empty texts have no words and go."""
    rows = quality_rules.quality(docs).select("doc_id", "lang", "source", F.struct("quality.kept", "quality.clean_text").alias("q"))
    # A generator between rules and filter: the optimiser would otherwise evaluate the rules for each of the two.
    rows = rows.select("doc_id", "lang", "source", F.explode(F.array("q")).alias("q")).filter("q.kept")
    return _documents(rows.withColumn("text", F.col("q.clean_text")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_kept_pct: int = 50) -> DataFrame:
    """Lines that other documents hold go, except where they stand first; all other lines of a document stay.

    A rest of a near copy would hide it from the stage behind.  So where a document loses more than half of its words,
    it goes itself, but only if it is a near copy of one that stays: links are those of the join, judged on the texts
    before any line goes, and the first of each component always stays.  Documents without such a link keep what is
    theirs, however little, or nothing.  Rows stay one for one with their own columns; a row without an id keeps its
    lines, rows that repeat an id are alike; null and empty texts are one empty line.
    """
    rows = by_key(docs, "line-rows")
    sized = rows.select("key", "row.*").withColumn("n_words", F.size(words(F.coalesce(F.col("text"), F.lit("")))))
    lines = line_dedup.dedup_lines(sized, carry=("lang", "source", "n_words"), key_col="key", marks=jaccard_join.first_keys(rows))
    whole = 100 * F.size(words(F.col("kept_text"))) >= min_kept_pct * F.col("n_words")
    lines = lines.filter((F.col("n_dropped") == 0) | F.coalesce("marked", F.lit(False)) | whole)
    return _documents(lines.withColumnRenamed("kept_text", "text"))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays, that of the smallest id; rows may have none or repeat one."""
    return _documents(jaccard_join.one_of_each(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are left out or repeated to meet the source targets, each by its own rate, whatever its id."""
    return _documents(mixing.mixed_documents(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix as piece ids.  Ids play no part; a null text counts as empty and has none."""
    return sentencepiece_wfst.encode(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", join_stage),
    ("mixing", mixing_stage),
    ("SentencePiece", encoding_stage),
]
#: The mix and the encoding have no SQL form; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written and read again.

    Null ids, repeated ids and repeated rows pass as the stages say; an empty table gives an empty result; columns other
    than those of documents are not carried.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
