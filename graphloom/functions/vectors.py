"""Vector expressions (M1, M2), centroid coherence (A3), seeded hashing, and the encoder hook."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """M2: length 1; a zero vector stays zero."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, 0.0).otherwise(x / n))), 1)


def cosine(a: Column, b: Column) -> Column:
    """M1: 0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def vector_sum(units: Column, size: int | None = None) -> Column:
    """Element-wise sum over a group, combined map-side: of ``size`` columns, or of vectors where the size is not known."""
    if size is None:
        return vector_to_array(Summarizer.sum(array_to_vector(units)))
    return F.array(*[F.sum(F.get(units, F.lit(i))) for i in range(size)])


def mean_pair_cosine(total: Column, squares: Column, n: Column, few: float = 0.5) -> Column:
    """A3: mean cosine of all unordered pairs, from the sum of unit vectors: (|S|^2 - sum |u|^2) / (n (n - 1))."""
    s = F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(n < 2, F.lit(few)).otherwise((s - squares) / (n * (n - 1)))


def number(text: Column) -> Column:
    """The first 32 bits of the MD5, as a number: a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


@functools.lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")


def feature_hash(sentences: list[str], size: int = 64) -> np.ndarray:
    """Default encoder: signed counts of hashed words, one sparse sum for all sentences."""
    words = [list(map(_word_hash, s.lower().split())) for s in sentences]
    h = np.array([x for w in words for x in w], np.uint64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    slot = row * size + ((h >> np.uint64(1)) % np.uint64(size)).astype(np.int64)
    sign = np.where(h & np.uint64(1), 1.0, -1.0)
    return np.bincount(slot, sign, len(words) * size).reshape(len(words), size)


def encode(sentences: DataFrame, column: str = "sentence", encoder: Callable[[list[str]], np.ndarray] = feature_hash, batch: int = 200) -> DataFrame:
    """(sentence, vector) of the distinct sentences, encoded in batches on the workers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), batch):
                some = part["sentence"].iloc[k : k + batch].tolist()
                yield pd.DataFrame({"sentence": some, "vector": [v.astype(float).tolist() for v in np.asarray(encoder(some))]})

    distinct = sentences.select(F.col(column).alias("sentence")).filter("sentence is not null").distinct()
    return distinct.mapInPandas(run, "sentence string, vector array<double>")


#: Rows of a vector table that are sent to every task rather than shuffled.
SENT = 1 << 14


def row_number(sentences: DataFrame, n: int) -> DataFrame:
    """Add ``_v``, the row ``number(sentence) % n`` of a vector table that ``lookup`` picks."""
    return sentences.withColumn("_v", number(F.col("sentence")) % n)


def lookup(sentences: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """An encoder that picks row ``number(sentence) % n`` of a vector table (vec_id, embedding), adding ``u``, its unit vector, and ``uu``, its square.

    Rows that have ``_v`` need no sentence.  A table of up to ``SENT`` rows goes to every task, so rows stay where they are.
    """
    units = table.select(F.col("vec_id").alias("_v"), unit(F.col("embedding").cast("array<double>")).alias("u"))
    units = units.withColumn("uu", dot(F.col("u"), F.col("u")))
    coded = sentences if "_v" in sentences.columns else row_number(sentences, n)
    return coded.join(F.broadcast(units) if n <= SENT else units, "_v").drop("_v")
