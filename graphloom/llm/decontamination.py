"""Benchmark decontamination: FM-indexes of training shards, searched for all test phrases.

A phrase is a window of so many consecutive words of a test item.  Distinct (phrase, item) pairs are split by hash into
blocks of bounded size, and each block goes to all tasks.  A task indexes the words of a few megabytes of documents at
a time (``fm_index``): backward search finds each phrase's suffixes, sampled positions say where they stand, and the
word ranges are merged into removal spans.  Words that no phrase holds are one separator, and stretches shorter than
the shortest phrase are left out of the index.  No row is shuffled; with one block, the usual case, it is one narrow
pass, with more a pass for each.

Words are numbered through 64-bit hashes that are checked to differ among a block's own words; every word of a hit is
compared with the phrase's word by its bytes, and a shard with a false one is indexed again without it.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import fm_index
from graphloom.llm.common import byte_view, discard, read, stored

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Text of one index, and of the phrases of one block.
SHARD_BYTES = 6 << 20
BLOCK_BYTES = 64 << 20
#: Words up to this length are hashed together, longer ones one by one.
SHORT = 64


# --- words of many texts
def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and at the end) of the words in lower-cased bytes; texts lie between ``offsets``."""
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; words of up to eight bytes never collide."""
    size = ends - starts
    padded = np.append(data, np.zeros(8, np.uint8))
    out = np.full(len(starts), salt, np.uint64)
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    some = np.flatnonzero(size <= SHORT)
    at = 0
    while len(some):
        left = np.minimum(size[some] - at, 8).astype(np.uint64)
        bits = np.ascontiguousarray(eights[starts[some] + at]).view("<u8").ravel()
        bits = bits << (np.uint64(64) - left * np.uint64(8))
        out[some] = _mixed(out[some] ^ bits) if at == 0 else _mixed(_mixed(out[some]) + bits)
        at += 8
        some = some[size[some] > at]
    for k in np.flatnonzero(size > SHORT):
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=salt.to_bytes(16, "little")).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


# --- phrases
def phrases(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, phrase): every ``window`` consecutive words of an item, joined by spaces; of a shorter item all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text").to_pylist(), strict=True):
                words = WORD.findall((text or "").translate(ASCII_LOWER))
                n = max(len(words) - window + 1, min(len(words), 1))
                for k in range(0, n, 1 << 14):
                    found = [" ".join(words[j : j + window]) for j in range(k, min(n, k + (1 << 14)))]
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item.as_py()] * len(found), pa.string()), "phrase": pa.array(found, pa.string())})

    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "item string, phrase string").distinct()


@dataclass
class Block:
    """Phrases as numbers of words, and which items hold each."""

    salt: int
    hashes: np.ndarray  # of the words, rising
    data: np.ndarray  # bytes of the words in the same order, the first word being number 1
    offsets: np.ndarray
    phrases: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray  # numbers of items, phrase after phrase
    owner_offsets: np.ndarray
    items: list[str]


def block_of(item: list[str | None], phrase: list[str]) -> Block:
    """Numbers the words, phrases and items of one block; an item without an id owns nothing, but its phrases count.

    A block without phrases gets one that no text holds.
    """
    names = sorted(set(phrase)) or ["\0"]
    number = {p: k for k, p in enumerate(names)}
    split = [p.split(" ") for p in names]
    words = sorted({w for p in split for w in p})
    raw = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw], dtype=np.int64)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for salt in range(1 << 16):
        hashes = word_hashes(data, offsets[:-1], offsets[1:], salt)
        order = np.argsort(hashes, kind="stable")
        if not (np.diff(hashes[order]) == 0).any():
            break
    else:
        raise ArithmeticError("no hash tells the words of a block apart")
    place = {words[k]: n for n, k in enumerate(order.tolist(), 1)}
    lengths = np.array([len(p) for p in split], np.int64)
    table = np.zeros((len(names), int(lengths.max(initial=1))), np.int64)
    for k, p in enumerate(split):
        table[k, : len(p)] = [place[w] for w in p]
    items = sorted({i for i in item if i is not None})
    code = {i: k for k, i in enumerate(items)}
    pairs = sorted({(number[p], code[i]) for i, p in zip(item, phrase, strict=True) if i is not None})
    owned = np.bincount([p for p, _ in pairs], minlength=len(names)) if pairs else np.zeros(len(names), np.int64)
    ordered = [raw[k] for k in order.tolist()]
    return Block(
        salt, hashes[order], np.frombuffer(b"".join(ordered), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in ordered], dtype=np.int64)]),
        table, lengths, np.array([i for _, i in pairs], np.int64), np.append(0, np.cumsum(owned)), items,
    )


# --- one shard
def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[0] .. low[0] + size[0] - 1, low[1] .. end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


def occurrences(numbers: np.ndarray, fresh: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, first word) of every occurrence in a sequence of word numbers, 0 where no phrase holds the word; ``fresh`` marks where a text begins."""
    known = numbers > 0
    begins = known & (fresh | ~np.append(False, known[:-1]))
    run = np.cumsum(begins) - 1
    kept = np.flatnonzero(known)
    run = run[kept]
    keep = np.bincount(run)[run] >= block.lengths.min() if len(run) else np.zeros(0, bool)
    kept, run = kept[keep], run[keep]
    if not len(kept):
        return
    # Numbers of the words that stand in this shard only, so that a large block's vocabulary does not deepen its tree.
    here = np.zeros(len(block.hashes) + 1, np.int64)
    present = np.flatnonzero(np.bincount(numbers[kept], minlength=len(here)))
    here[present] = np.arange(1, len(present) + 1)
    asked = np.flatnonzero(((here[block.phrases] > 0) | (block.phrases == 0)).all(1))
    if not len(asked):
        return
    stretch = np.append(0, np.cumsum(run[1:] != run[:-1]))
    # A separator stands before every stretch and one at the end.
    at = np.arange(len(kept)) + stretch + 1
    text = np.zeros(at[-1] + 2, np.int64)
    text[at] = here[numbers[kept]]
    word_of = np.zeros(len(text), np.int64)
    word_of[at] = kept
    index = fm_index.FMIndex(text, len(present))
    low, high = index.search(here[block.phrases[asked]], block.lengths[asked])
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return
    low, size, asked = low[hit], (high - low)[hit], asked[hit]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, low + size, -1)
    rows = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    place = np.zeros(len(text), np.int64)
    place[rows] = index.locate(rows)
    part = np.cumsum(size) // fm_index.MOST
    for p in np.unique(part):
        some = part == p
        yield np.repeat(asked[some], size[some]), word_of[place[_ranges(low[some], size[some])]]


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray, block: Block) -> np.ndarray:
    """Whether each word has the bytes of the phrases' word of its number."""
    size, own = ends - starts, block.offsets[numbers] - block.offsets[numbers - 1]
    same = size == own
    some = np.flatnonzero(same)
    for part in np.array_split(some, int(size[some].sum()) // (4 << 20) + 1) if len(some) else ():
        if len(part):
            equal = data[_ranges(starts[part], size[part])] == block.data[_ranges(block.offsets[numbers[part] - 1], size[part])]
            same[part] = np.logical_and.reduceat(equal, np.append(0, np.cumsum(size[part])[:-1]))
    return same


def scan(data: np.ndarray, offsets: np.ndarray, block: Block):
    """(lower-cased bytes' word starts, ends, words before each text, hit words as a mask, (text, item) pairs) of the texts between ``offsets``."""
    data = LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    starts, ends, before = find_words(data, offsets)
    hashes = word_hashes(data, starts, ends, block.salt)
    place = np.minimum(np.searchsorted(block.hashes, hashes), len(block.hashes) - 1)
    numbers = np.where(block.hashes[place] == hashes, place + 1, 0)
    fresh = np.zeros(len(starts), bool)
    fresh[before[:-1][before[:-1] < len(starts)]] = True
    longest = int(block.lengths.max())
    # Room for as many separators as words; what one index ends with, the next begins with.
    size = fm_index.MOST // 2 - 2
    while True:
        cover, pairs = np.zeros(len(starts) + 1, np.int64), []
        for a in range(0, max(1, len(starts) - longest + 1), size - longest + 1):
            for phrase, word in occurrences(numbers[a : a + size], fresh[a : a + size], block):
                np.add.at(cover, a + word, 1)
                np.add.at(cover, a + word + block.lengths[phrase], -1)
                text = np.searchsorted(before, a + word, "right") - 1
                pairs.append(np.unique(text * len(block.lengths) + phrase))
        hit = np.cumsum(cover)[:-1] > 0
        some = np.flatnonzero(hit)
        wrong = some[~same_words(data, starts[some], ends[some], numbers[some], block)]
        if not len(wrong):
            break
        numbers[wrong] = 0
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    text, phrase = np.divmod(found, len(block.lengths))
    owners = block.owner_offsets[phrase + 1] - block.owner_offsets[phrase]
    item = block.owners[_ranges(block.owner_offsets[phrase], owners)]
    return data, starts, ends, before, hit, np.unique(np.repeat(text, owners) * max(1, len(block.items)) + item)


def _search(block_cell, first: bool, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a block's word spans and items to those that rows have from passes before; the last pass leaves the text out."""
    block = block_cell.value
    for batch in _gathered(batches):
        data, offsets = byte_view(batch.column("text"))
        n_words, spans, items = [], [], []
        old_words, old_items = ([None] * batch.num_rows if first else batch.column(c).to_pylist() for c in ("words", "items"))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SHARD_BYTES, "right")) - 1)
            lowered, starts, ends, before, hit, found = scan(data, offsets[start : stop + 1], block)
            text, item = np.divmod(found, max(1, len(block.items)))
            names: dict[int, list[str]] = {}
            for t, i in zip(text.tolist(), item.tolist(), strict=True):
                names.setdefault(t, []).append(block.items[i])
            n = np.diff(before)
            hits = np.append(0, np.cumsum(hit))
            touched = hits[before[1:]] > hits[before[:-1]]
            for k in range(stop - start):
                row = start + k
                mask = hit[before[k] : before[k + 1]] if touched[k] else np.zeros(0, bool)
                if old_words[row]:
                    mask = np.resize(mask, n[k]) if len(mask) else np.zeros(n[k], bool)
                    for w in old_words[row]:
                        mask[w["start"] : w["stop"]] = True
                spans.append(_runs(mask, starts[before[k] : before[k + 1]], ends[before[k] : before[k + 1]], lowered, int(offsets[start + k] - offsets[start])) if mask.any() else [])
                items.append(sorted({*(old_items[row] or ()), *names.get(k, ())}))
            n_words.append(n)
            start = stop
        words = [[{"start": s[0], "stop": s[1]} for s in row] for row in spans]
        chars = [[{"start": s[2], "stop": s[3]} for s in row] for row in spans]
        pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        columns = {"row": batch.column("row")} | ({} if last else {"text": batch.column("text")})
        columns |= {"n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), "words": pa.array(words, pair), "spans": pa.array(chars, pair), "items": pa.array(items, pa.list_(pa.string()))}
        yield pa.RecordBatch.from_pydict(columns)


def _runs(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, base: int) -> list[tuple[int, int, int, int]]:
    """(first word, end word, first code point, end code point) of every run of hit words of a text that begins at ``base``."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lo, hi = starts[first], ends[last - 1]
    chars = np.append(0, np.cumsum((data[base : hi[-1]] & 0xC0) != 0x80))
    return list(zip(first.tolist(), last.tolist(), chars[lo - base].tolist(), chars[hi - base].tolist(), strict=True))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to the size of a shard."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


# --- the operator
def contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, n_words, n_hit, items, spans, columns in ``carry``) of every row of ``docs``.

    Words are runs of characters other than ASCII signs, white space and controls, A-Z lower-cased.  A phrase is ``window``
    consecutive words of an item, or all of them if they are fewer.  ``n_hit``: words inside any occurrence of a phrase;
    ``items``: ids of the items with occurring phrases, as strings, sorted; ``spans``: (start, stop) in code points of
    each run of hit words, from its first word's start to its last one's end.

    Null and empty texts have no words, those of items no phrases.  An item without an id counts for hits but is not
    listed; rows that repeat an item id are one item, rows that repeat a document id stand for themselves.  Empty tables
    of documents give empty results, of items no hits.  Runs jobs over ``items`` when called; phrases go to all tasks in
    blocks of ``block_bytes`` of text, and with more than one block documents are stored between passes.
    """
    spark = docs.sparkSession
    known = stored(phrases(items, window, item_col, item_text_col), "phrases")
    weight = known.agg(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-weight // block_bytes))
    row = F.struct(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]).alias("row")
    pair = "array<struct<start: bigint, stop: bigint>>"
    rows = docs.select(row, F.col(f"`{text_col}`").alias("text"), F.array().cast(pair).alias("words"), F.array().cast("array<string>").alias("items"))
    kind = rows.schema["row"].dataType.simpleString()
    blocks = range(n)
    for b in blocks:
        some = known.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(n)) == b).toArrow()
        block = block_of(some["item"].to_pylist(), some["phrase"].to_pylist())
        cell, last = spark.sparkContext.broadcast(block), b == blocks[-1]
        schema = f"row {kind}, {'' if last else 'text string, '}n_words long, words {pair}, spans {pair}, items array<string>"
        found = rows.select("row", "text", "words", "items").mapInArrow(functools.partial(_search, cell, b == blocks[0], last), schema)
        before, rows = rows, found if last else stored(found, "decontamination")
        if not last and hasattr(before, "_stored_at"):
            discard(before)
    discard(known)
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w["stop"] - w["start"])
    return rows.select(F.col("row.id").alias(id_col), "n_words", hit.alias("n_hit"), "items", "spans", *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)])


def without_spans(text: Column, spans: Column) -> Column:
    """The text with its (start, stop) spans of code points cut out; a null text stays null."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(edges, stops, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(kept, ""))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", carry: tuple[str, ...] = (), **settings) -> DataFrame:
    """As ``contaminated``, with ``clean_text``: each document's text without the spans; ``carry`` keeps other columns."""
    out = contaminated(docs, items, text_col=text_col, carry=(text_col, *carry), **settings)
    return out.withColumn("clean_text", without_spans(F.col(f"`{text_col}`"), F.col("spans"))).drop(text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: Words as SQL finds them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(string.ascii_uppercase, string.ascii_lowercase)
ORACLE_SQL = f"""
with b as (select item_id, {_WORDS} as a from benchmark),
p as (select distinct item_id, array_to_string(a[i:i + 9], ' ') as phrase, least(len(a), 10) as n from b, unnest(range(1, greatest(len(a) - 9, least(len(a), 1)) + 1)) as t(i)),
d as (select doc_id, {_WORDS} as a from documents),
g as (select doc_id, i, n, array_to_string(a[i:i + n - 1], ' ') as phrase from d, (select distinct n from p) as s, unnest(range(1, len(a) - n + 2)) as t(i)),
f as (select g.doc_id, g.i, g.n, p.item_id from g join p using (phrase, n)),
h as (select doc_id, count(distinct w) as n_hit from f, unnest(range(i, i + n)) as t(w) group by doc_id),
k as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from f) group by doc_id)
select doc_id, len(a)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join k using (doc_id)
"""
