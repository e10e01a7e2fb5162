"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines, reassemble by position.

Only 128-bit hashes of lines are shuffled, never the lines.  A document contributes each of its hashes once, so
the count per hash is a plain map-side combined count.  The hashes over the threshold are written to the shared
folder; their join with the lines can then be split by adaptive execution when one line is in a third of all
documents.  Dropped positions are gathered per document, a list that its own lines bound.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import SPACES, ascii_lower, read, stored


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = (), key_col: str | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Add ``n_lines``, ``n_dropped`` and ``kept_text`` to (id, text) of every document.

    A line whose key has ``min_chars`` code points or more and stands in ``min_docs`` documents or more stays
    only in the document with the smallest id, there with all its repeats.  A null or empty text is one empty
    line.  A document without an id is counted but returned unchanged, since no id says who comes first.  Rows
    that repeat an id count as further documents and are treated alike.  An empty table gives an empty result;
    of the other columns those in ``carry`` are returned, each row with its own.

    With ``key_col``, a number that is unique to the row, drops meet their rows by it.  ``marks`` then holds some of these
    numbers in a column ``key``, and ``marked`` is true for rows with dropped lines that it holds, else null: it is joined
    to the drops, so texts move once.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *([F.col(key_col).alias("_row_key")] if key_col else []), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []))
    row_key = ["_row_key"] if key_col else ["_id", "_d"]
    split = base.select("_id", F.col("_row_key") if key_col else F.md5("_t").alias("_d"), F.split("_t", "\n").alias("_lines"), *(["_row"] if carry else []))
    keyed = (
        split.select("_id", row_key[-1], F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", row_key[-1], "_pos", line_key(F.col("_line")).alias("_key"))
        .filter(F.length("_key") >= min_chars)
        .select("_id", row_key[-1], "_pos", F.unhex(F.md5("_key")).alias("_h"))
    )
    once = split.select(
        "_id",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter(F.transform("_lines", line_key), lambda k: F.length(k) >= min_chars), lambda k: F.md5(k)
                )
            )
        ).alias("_hex"),
    ).select("_id", F.unhex("_hex").alias("_h"))
    common = once.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).filter(F.col("_n") >= min_docs)
    common = stored(common.select("_h", "_first"), "line-dedup")
    drops = (
        keyed.join(common, "_h")
        .filter(F.col("_id") != F.col("_first"))
        .groupBy(*row_key)
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    if marks is not None:
        drops = drops.join(marks.select(F.col("key").alias("_row_key"), F.lit(True).alias("_marked")), "_row_key", "left")
    marked = ["_marked"] if marks is not None else []
    joined = split.join(drops, row_key, "left")
    at = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(at, lambda p: F.get("_lines", p)))
    kept = joined.select("_id", F.size("_lines").alias("_n"), kept.alias("_kept"), *marked, *(["_row"] if carry else []))
    return kept.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_lines"),
        (F.col("_n") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept_text"),
        *[F.col(c).alias("marked") for c in marked],
        *[F.col("_row")[c].alias(c) for c in carry],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
l as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as pos from s),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key from l),
c as (select key, min(doc_id) as first_id from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
j as (select k.*, coalesce(c.first_id <> k.doc_id, false) as gone from k left join c using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""
