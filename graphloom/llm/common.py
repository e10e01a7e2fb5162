"""Small helpers that the training-data operators share."""

from __future__ import annotations

import string
import threading
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from graphloom.sources import storage
from graphloom.sources.storage import discard, shared_dir  # noqa: F401

#: The six ASCII white-space characters that separate words: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII values take the fast path."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``; Spark would otherwise repeat the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, end to end, and the offsets between which its rows lie; a null is empty."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = raw.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage for good.

    The shuffle files of the finished write are freed at once, so disk holds one step's shuffles at a time.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = storage.stored(df, name)
    finally:
        spark.conf.set(CLEANUP, before)
    for tables in _kept():
        tables.append(out)
    return out


_local = threading.local()


def _kept() -> list[list[DataFrame]]:
    """Lists of what this thread stores, one for each ``settled`` that is running."""
    if not hasattr(_local, "kept"):
        _local.kept = []
    return _local.kept


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``make`` returns, and delete every table that was stored on the way to it."""
    _kept().append(tables := [])
    try:
        try:
            out = make()
        finally:
            _kept().pop()
        return stored(out, name)
    finally:
        if tables:
            discard(*tables)


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """Store (key, row): each row of ``docs`` as a struct and a number of its own, which tells rows apart whatever their ids."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return stored(docs.select(F.monotonically_increasing_id().alias("key"), row), name)


def by_key(docs: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """(key, row) as from ``keyed``, but where ids are whole numbers, none missing or repeated, they are the keys and nothing is stored.

    ``docs`` is then read each time its rows are asked for; runs a job when called.
    """
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        key = F.col(f"`{id_col}`").cast("long").alias("key")
        if docs.select(key).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or key is null").isEmpty():
            return docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed(docs, name)


def numbered_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with its first column ``id`` as whole numbers called ``doc``, and (doc, id) to turn them back; None if ids were numbers.

    Numbers rise with the ids; a null stays null.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "id"]
    if isinstance(docs.schema["id"].dataType, IntegralType):
        return docs.select(F.col("id").cast("long").alias("doc"), *rest), None
    ids = docs.select("id").filter("id is not null").distinct().orderBy("id")
    names = stored(ids.select("id", F.monotonically_increasing_id().alias("doc")), "id-numbers")
    return stored(docs.join(names, "id", "left").select("doc", *rest), "numbered"), names
