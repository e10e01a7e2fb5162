"""Suffix-array dedup by bucket-pointer refinement: remove every byte of a 100-byte string that also starts earlier.

The suffix array is needed only to depth 100, and only as far as it tells equal windows of 100 bytes apart, so refinement
stops there.  A suffix array of every position would not fit any shuffle.  Of each window one start of a q-gram is chosen,
the one with the least identifier (leftmost of equals): equal windows choose equal q-grams at equal places, so a window
can repeat only inside the bucket of its chosen q-gram.  The sampled suffixes are the chosen places.

1. Initial buckets: the q-gram at each chosen place.  Buckets of one place are done, and their places are left out.
2. Refinement by the identifiers at later offsets: a place carries an identifier of all bytes of the run of windows that
   chose it, made of the identifiers at both its ends.  Places that agree form a class whose first place, the bucket's
   pointer, stands for it; all windows of the others are repeats and leave.
3. A bucket in which several classes remain is refined again, level by level.  Its windows are dealt by how far before the
   place they start: 16 neighbouring starts to a bucket, then 4, then 1.  The windows of such a bucket share a core, which
   a level extends by the bytes at later (and, for starts before it, earlier) offsets.  On each level places that agree on
   all their windows leave as in 2, represented by the pointer; places that are alone with their core are done; only the
   pointers of buckets that still hold several go on.  So each level reads what the one before has updated, and a text
   that differs in one word costs a few rows a level instead of one for each of its windows.

Exactness.  A class of step 2 is told by two independent 64-bit identifiers, of the q-gram and of the run.  On the levels
of step 3 the identifiers are the bytes themselves.  Every grouping combines map-side and every look-up is a join that
adaptive execution can split, so a bucket as large as a third of the corpus needs no task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegralType, LongType, StructField, StructType

from graphloom.llm.common import discard, read, stored

LENGTH, GRAM = 100, 48
#: Bytes handled at once; longer texts are cut into overlapping blocks, which only adds classes.
BLOCK = 1 << 17
#: Starts of windows to a bucket, level by level.
WIDTHS = (16, 4, 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Places within a block, kept in the low bits of a key.
_PLACE = np.uint64((1 << 20) - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of a pair of identifiers."""
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each start."""
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    return x[:-4] | (x[4:] << np.uint64(32))


def _grams(words: np.ndarray) -> np.ndarray:
    """Identifiers of depth 48 for each start, from those of depth 8, 16 and 32."""
    x = _mix(words[:-8], words[8:])
    return _mix(_mix(x[:-16], x[16:])[:-16], x[32:])


def _runs(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Identifier of the bytes of the windows from lo to hi; it shares nothing with those of ``_grams``."""
    h = np.full(len(lo), LENGTH, np.uint64)
    for end in (lo, hi):
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            h = (h + words[end + k]) * _C
            h ^= h >> np.uint64(31)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    k = 1
    while k < width:
        s = min(k, width - k)
        values = np.minimum(values[:-s], values[s:])
        k += s
    return values


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls, not copied."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, borders of its pieces, row of each piece, its offset in the text) of texts of 100 bytes or more."""
    data, at = _flat(column)
    row = 0
    while row < len(column):
        if at[row + 1] - at[row] > BLOCK:
            for base in range(0, int(at[row + 1] - at[row]) - LENGTH + 1, BLOCK):
                part = data[at[row] + base : min(at[row] + base + BLOCK + LENGTH - 1, at[row + 1])]
                yield part, np.array([0, len(part)]), np.array([row]), np.array([base])
            row += 1
            continue
        stop = int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1
        yield data[at[row] : at[stop]], at[row : stop + 1] - at[row], np.arange(row, stop), np.zeros(stop - row, np.int64)
        row = stop


def _chosen(borders: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run that chose the same place, and that place."""
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(keys, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    inside = np.ones(len(at), bool)
    inside[(borders[1:-1, None] - np.arange(1, LENGTH)).ravel()] = False
    valid = np.flatnonzero(inside)
    new = np.r_[True, (np.diff(at[valid]) != 0) | (np.diff(valid) != 1)]
    lo = valid[new]
    return lo, valid[np.r_[new[1:], True]], at[lo]


def _initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The q-gram identifiers chosen in each text."""
    for batch in batches:
        for data, borders, _, _ in _blocks(batch.column(0)):
            grams = _grams(_words(data))
            yield pa.RecordBatch.from_pydict({"bucket": grams[_chosen(borders, grams)[2]].view(np.int64)})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chosen place: bucket, identifier and shape of its run of windows, document, offset.

    ``shape`` is 64 times the first window's distance from the place, plus the number of further windows.
    """
    for batch in batches:
        docs = batch.column(0).to_numpy()
        for data, borders, rows, bases in _blocks(batch.column(1)):
            words = _words(data)
            grams = _grams(words)
            lo, hi, at = _chosen(borders, grams)
            piece = np.searchsorted(borders, lo, "right") - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": grams[at].view(np.int64),
                    "run": _runs(words, lo, hi).view(np.int64),
                    "shape": ((at - lo) * 64 + hi - lo).astype(np.int32),
                    "doc": docs[rows[piece]],
                    "place": (at - borders[piece] + bases[piece]).astype(np.int32),
                }
            )


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, text): ``doc`` differs in all rows and rises with the id, null last, then with the place in the table.

    It is the id itself where that is a whole number that no row lacks or repeats, which a count of the ids tells.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if isinstance(base.schema["id"].dataType, IntegralType) and base.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").isEmpty():
        return base.select(F.col("id").cast("long").alias("doc"), "id", "text")
    rows = stored(base.withColumn("row", F.monotonically_increasing_id()), "suffix-rows")
    order = rows.select("id", "row").orderBy(F.col("id").asc_nulls_last(), "row")
    order = stored(order.select("row", F.monotonically_increasing_id().alias("doc")), "suffix-order")
    numbered = stored(rows.join(order, "row").select("doc", "id", "text"), "suffix-numbered")
    discard(rows)
    discard(order)
    return numbered


def _first(name: str) -> Column:
    """``name`` of the earliest place of a group; the order is one number, so that the aggregate stays a hash aggregate."""
    order = F.col("doc").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("place").cast("decimal(10,0)")
    return F.min_by(name, order).alias(f"first_{name}")


def _later() -> Column:
    return (F.col("doc") != F.col("first_doc")) | (F.col("place") != F.col("first_place"))


def _refined(pieces: DataFrame, width: int) -> tuple[DataFrame, DataFrame | None]:
    """One level: (doc, lo, hi) of the repeated windows, and the pieces that go on to the next.

    A piece is (doc, place, near, far, bytes): the windows that start ``near`` to ``far`` bytes before the place.
    """
    node = F.col("node") * width
    near, far = F.greatest("near", node), F.least(F.col("far"), node + (width - 1))
    span = F.sequence(*(F.floor(F.col(c) / width).cast("int") for c in ("near", "far")))
    rows = pieces.select("*", F.explode(span).alias("node"))
    rows = rows.select(
        "doc", "place", "node", near.alias("near"), far.alias("far"), F.substring(F.col("bytes"), F.col("far") - far + 1, far - near + LENGTH).alias("bytes")
    )
    key = ["node", "near", "far", "bytes"]
    classes = stored(rows.groupBy(*key).agg(_first("doc"), _first("place"), F.count(F.lit(1)).alias("n")), "suffix-classes")
    back = rows.join(classes.filter("n > 1").drop("n"), key, "left")
    again = F.coalesce(_later(), F.lit(False)).alias("again")
    if width == 1:
        lo = (F.col("place") - F.col("far")).alias("lo")
        return stored(back.filter(again).select("doc", lo, lo.alias("hi")), "suffix-repeats"), None
    back = stored(back.select("doc", "place", *key, again), "suffix-level")
    repeats = stored(back.filter("again").select("doc", (F.col("place") - F.col("far")).alias("lo"), (F.col("place") - F.col("near")).alias("hi")), "suffix-repeats")
    core = F.substring(F.col("bytes"), F.col("far") - node + 1, F.lit(LENGTH - width + 1)).alias("core")
    mixed = classes.groupBy("node", core).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", "core")
    onward = back.filter("not again").select("*", core).join(mixed, ["node", "core"], "left_semi")
    onward = stored(onward.select("doc", "place", "near", "far", "bytes"), "suffix-pieces")
    discard(classes)
    discard(back)
    return repeats, onward


def repeated_runs(base: DataFrame) -> DataFrame:
    """(doc, runs) of (doc, text): for each document with repeats, the runs [first start, last start] of repeated windows.

    ``doc`` is unique, and its order is that of the documents.  Runs jobs: each step's result is stored.
    """
    base = base.select("doc", "text").filter(F.length("text") >= LENGTH)
    buckets = base.select("text").mapInArrow(_initial, "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    buckets = stored(buckets.filter("n > 1").select("bucket"), "suffix-buckets")
    places = base.mapInArrow(_places, "bucket long, run long, shape int, doc long, place int").join(buckets, "bucket")
    places = stored(places, "suffix-places")
    discard(buckets)
    key = ["bucket", "run", "shape"]
    classes = stored(places.groupBy(*key).agg(_first("doc"), _first("place"), F.count(F.lit(1)).alias("n")), "suffix-classes")
    far, more = F.floor(F.col("shape") / 64).cast("int"), (F.col("shape") % 64).cast("int")
    lo = F.col("place") - far
    run = F.struct(lo.alias("lo"), (lo + more).alias("hi"))
    again = places.join(classes.filter("n > 1"), key).filter(_later()).groupBy("doc").agg(F.collect_list(run).alias("runs"))
    parts = [stored(again, "suffix-again")]
    discard(places)
    mixed = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket")
    pointers = classes.join(mixed, "bucket", "left_semi").select(F.col("first_doc").alias("doc"), F.col("first_place").alias("place"), (far - more).alias("near"), far.alias("far"))
    pointers = stored(pointers, "suffix-pointers")
    discard(classes)
    piece = F.substring(F.col("text"), F.col("place") - F.col("far") + 1, F.col("far") - F.col("near") + LENGTH).alias("bytes")
    pieces = stored(pointers.join(base, "doc").select("doc", "place", "near", "far", piece), "suffix-pieces")
    discard(pointers)
    for width in WIDTHS:
        before = pieces
        repeats, pieces = _refined(before, width)
        discard(before)
        parts.append(repeats.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _cut(data: np.ndarray, at: np.ndarray, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stays of texts side by side, each one's number of removed bytes and of maximal removed runs."""
    edge = np.bincount(at[owner] + lo, minlength=len(data) + 1) - np.bincount(at[owner] + hi + LENGTH, minlength=len(data) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    opens[first] = gone[first]
    count = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
    return data[~gone], count(gone), count(opens)


def _kept(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text, runs) to (id, n_bytes, n_removed, n_spans, kept); texts without runs pass as they are."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]

    def rows(ids: pa.Array, n_bytes: np.ndarray, removed: np.ndarray, spans: np.ndarray, kept: pa.Array) -> pa.RecordBatch:
        counts = [pa.array(np.asarray(x, np.int64)) for x in (n_bytes, removed, spans)]
        return pa.RecordBatch.from_arrays([ids.cast(kind), *counts, kept.cast(pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(2).is_valid()
            same = batch.filter(pa.compute.invert(some))
            if same.num_rows:
                n = np.diff(_flat(same.column(1))[1])
                yield rows(same.column(0), n, 0 * n, 0 * n, same.column(1))
            changed = batch.filter(some)
            for k in range(0, changed.num_rows, 256):
                part = changed.slice(k, 256)
                data, at = _flat(part.column(1))
                data, at = data[at[0] : at[-1]], at - at[0]
                runs = part.column(2)
                owner = np.repeat(np.arange(len(runs)), pa.compute.list_value_length(runs).to_numpy())
                lo, hi = (runs.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
                left, removed, spans = _cut(data, at, owner, lo, hi)
                ends = np.concatenate(([0], np.cumsum(np.diff(at) - removed))).astype(np.int64)
                kept = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(left)])
                yield rows(part.column(0), np.diff(at), removed, spans, kept)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, n_spans, ``kept`` (the remaining bytes, binary).

    Each whole text is taken as UTF-8 bytes, null as empty.  A byte goes if a 100-byte string over it also
    starts earlier: in a document with a smaller id, or earlier in the same one; matches never cross documents
    and are judged on the input.  ``n_spans`` counts maximal removed runs.  ``kept`` may end inside a
    character.  Ids may be of any type that sorts.  Each row is a document of its own: rows without an id come
    last in the order, and they, like rows that repeat an id, come one after the other as they stand in the
    table.  An empty table gives an empty result; other columns are not returned.  Runs jobs when called.
    """
    base = _numbered(docs, id_col, text_col)
    joined = base.join(repeated_runs(base), "doc", "left").select("id", "text", "runs")
    kind = base.schema["id"].dataType
    schema = StructType([StructField("id", kind), *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    return joined.mapInArrow(_kept(to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
