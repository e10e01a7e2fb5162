"""Exact dedup: group by a 128-bit content hash and compare the bytes inside each group.

Grouping on (hash, text) makes Spark compare whole keys, so two texts that collide on the hash end in two
classes.  Copies meet map-side first, hence a group of any size reaches the shuffle as one row per task.
The classes travel back to the documents by hash and SHA-256 without text; that join is one that adaptive
execution can split when a single class holds a large part of all rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, keyed, read


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` is "smallest" or "largest": which id of a group stays.  A null text counts as empty; empty texts
    form a group like any other.  Rows without an id never stay while another row of the group has one; if
    none has, ``keep_id`` is null and all are kept.  Rows that repeat both id and text are one document and
    are flagged alike.  An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    norm = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    classes = (
        norm.groupBy(F.md5("_t").alias("_h"), "_t")
        .agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", F.sha2("_t", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    keyed = norm.select("_id", F.md5("_t").alias("_h"), F.sha2("_t", 256).alias("text_sha256"))
    return keyed.join(classes, ["_h", "text_sha256"], "left").select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each text, with all its columns: the one of the smallest (or largest) id.

    A row without an id stays only where no row of its group has one; of rows that share the id, or have none, the first in
    the table stays.  Null and empty texts are one group.  Runs a job: the rows are stored with a number of their own.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    rows = keyed(docs, "exact-rows")
    id_, text = F.col("row")[id_col], ascii_lower(F.coalesce(F.col("row")[text_col], F.lit("")))
    if keep == "smallest":
        best = F.min(F.struct(id_.isNull(), id_, F.col("key").alias("key")))
    else:
        best = F.max(F.struct(id_.isNotNull(), id_, (-F.col("key")).alias("key")))
    kept = rows.groupBy(F.md5(text), text).agg(best.alias("best")).select(F.abs("best.key").alias("key"))
    return rows.join(kept, "key", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL = f"""
with n as (
  select doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
