"""N-gram Jaccard join by a token-group matrix: links at similarity t = 0.75 on five-word shingles.

1. Documents with equal shingle sets become one class, whose smallest id stands for it.
2. A global order of shingles puts frequent ones last.  Any order gives the same results, so the table of frequent
   shingles that is sent to all tasks has a fixed size limit: the most frequent ones fill it.  Two linked documents share
   one of the first n - ceil(t n) + 1 shingles of each, so only those are kept as tokens, and of those only the ones that
   two documents have.
3. Similar documents are partitioned into groups.  Classes with the same leading shingle (see ordered_prefix) are compared
   with the first of them, their pivot: m near copies cost m comparisons.  Those that link are one component, in groups of
   bounded bytes; the others of the same leading shingle share groups, too.  Pivots are then joined with one another as in
   4 and 5, so that copies with different leading shingles fall into one component as well.
4. The token-group matrix stores the union of each group's tokens.  A document is a query to the groups of other
   components: the number of its tokens in a group's union bounds its overlap with every member, and a group that cannot
   reach the overlap a link needs stays closed.
5. A query's text goes to the groups that qualify, where it is compared member by member.  Queries of a group are dealt to
   as many tasks as they need; a task emits a spanning forest of its links, never all of them.
6. Components of the links by alternating star contraction; ids and links stay in tables.

Shingles are 64-bit hashes: two texts count as sharing a shingle if its hashes agree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import by_key, discard, numbered_ids, read, settled, stored

WORDS, SHARE = 5, 75
#: Frequent shingles are those in more than FREQUENT documents; at most LISTED of them. All are counted where the hash is
#: in the lowest COUNTED parts of 2**64 (where prefixes lie), elsewhere those that repeat among neighbouring documents.
COUNTED, FREQUENT, LISTED = 0.375, 8, 1 << 20
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
#: Queries of one group that one task answers.
QUERIES = 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _A + b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


class _Words(dict):
    """Hashes of words met so far; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = int.from_bytes(xxhash.xxh3_64_digest(word), "big", signed=True)
        return h


#: Spark gives all its Python workers one fixed hash seed, which makes the built-in hash the same everywhere; were it
#: not set, words are hashed by a library instead.
_hash_of = hash if os.environ.get("PYTHONHASHSEED", "random").isdigit() else _Words().__getitem__


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of UTF-8 bytes, A-Z lower-cased.

    Byte strings split at just the six ASCII white-space characters and lower-case just A-Z.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of, words), np.int64, n).view(np.uint64)
    if n < WORDS:
        out = np.full(1, n, np.uint64)
        for k in range(n):
            out = _mix(out, h[k : k + 1])
        return out
    out = h[: n - WORDS + 1]
    for k in range(1, WORDS):
        out = _mix(out, h[k : n - WORDS + 1 + k])
    out = np.sort(_mix(out, np.full(len(out), _C)))
    return out[np.r_[True, out[1:] != out[:-1]]]


def needed(n: int) -> int:
    """Least overlap of a set of n with anything that links to it."""
    return -(-SHARE * n // 100)


def ordered_prefix(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The first n - needed(n) + 1 shingles, frequent ones last, among equals by hash; and the shingle to group by.

    That is the first one; or, where frequent ones reach into the prefix, the first of those: documents made of much
    repeated text then meet their like, whatever few words are their own.
    """
    keep = len(s) - needed(len(s)) + 1
    if len(frequent):
        at = np.searchsorted(frequent, s)
        common = frequent[np.minimum(at, len(frequent) - 1)] == s
        rare = s[~common]
        if len(rare) < keep:
            often = s[common]
            return np.concatenate((rare, often))[:keep], int(often[:1].view(np.int64)[0])
        s = rare
    return s[:keep], int(s[:1].view(np.int64)[0])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit = np.uint64(int(COUNTED * 2**64))

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        keep = (token < limit) | (n > 1)
        return pa.RecordBatch.from_arrays([_signed(token[keep]), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

    held, size = [], 0
    for (text,) in _rows(batches):
        held.append(shingles(text))
        size += len(held[-1])
        if size > 1 << 20:
            yield counts(held)
            held, size = [], 0
    if size:
        yield counts(held)


class Matcher:
    """One opened side: members' sets, their union, and who holds each of its shingles."""

    def __init__(self, members: list[dict]):
        self.docs = [m["doc"] for m in members]
        self.sets = [shingles(m["text"]) for m in members]
        self.sizes = np.array([len(s) for s in self.sets])
        flat = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.owner = owner[order]
        self.union, self.first = np.unique(flat, return_index=True)
        self.last = np.append(self.first[1:], len(flat))

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Members that link with the set s; none without opening if the union's overlap is too small."""
        at = np.searchsorted(self.union, s)
        at = np.minimum(at, len(self.union) - 1)
        hit = at[self.union[at] == s]
        if len(hit) < needed(len(s)):
            return np.empty(0, np.int64)
        first, size = self.first[hit], self.last[hit] - self.first[hit]
        flat = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        common = np.bincount(self.owner[flat], minlength=len(self.sets))
        return np.flatnonzero(100 * common >= SHARE * (len(s) + self.sizes - common))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (group, part, role, own, doc, text) in that order: the members of a group, then its queries.

    Members link among themselves if ``own`` says so.  Only links that join two trees of a part's forest are put out.
    """
    at: tuple[int, int] | None = None
    members: list[dict] = []
    matcher: Matcher | None = None
    root: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    def ask(doc: int, s: np.ndarray) -> None:
        for k in matcher.linked(s) if len(s) else ():
            a, b = find(doc), find(matcher.docs[k])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((doc, matcher.docs[k]))

    def close() -> None:
        nonlocal matcher
        if members and matcher is None:
            matcher = Matcher(members)
            if members[0]["own"]:
                for doc, s in zip(matcher.docs, matcher.sets, strict=True):
                    ask(doc, s)

    def flush() -> pa.RecordBatch:
        a, b = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for group, part, role, own, doc, text in _rows(batches):
        if (group, part) != at:
            close()
            at, members, matcher = (group, part), [], None
            root.clear()
        if role == 0:
            members.append({"doc": doc, "text": text, "own": own})
            continue
        close()
        ask(doc, shingles(text))
        if len(out) >= 1 << 14:
            yield flush()
    close()
    if out:
        yield flush()


def links_of(base: DataFrame, members: DataFrame, queries: DataFrame) -> DataFrame:
    """Links (a, b) between ``queries`` (group, doc) and the ``members`` (group, doc, own) of their groups.

    Members of groups with ``own`` are compared among themselves, too; groups with neither are not opened.
    """
    parts = queries.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    inside = members.join(parts, "group", "left").filter("own or parts is not null")
    inside = inside.select("group", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("role"), "own", "doc")
    inside = inside.withColumn("own", F.col("own") & (F.col("part") == 0))
    asked = queries.join(parts, "group").select("group", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), F.lit(False).alias("own"), "doc")
    rows = inside.unionByName(asked).join(base.select("doc", "text"), "doc").select("group", "part", "role", "own", "doc", "text")
    return rows.repartition("group", "part").sortWithinPartitions("group", "part", "role").mapInArrow(_opened, "a long, b long")


def candidates(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """(group, doc): which documents to ask of which group, by the overlap of their tokens with the group's stored union.

    ``cells`` are (token, doc, n), ``placed`` (doc, group, component).  Groups of a document's own component are left out,
    and of two groups only the documents of the one with the greater number are asked.

    Of two linked sets the larger, of size H, shares at most shared + ceil(t H) - 1 shingles with the other: those among
    the tokens of both, and those behind the tokens of the one whose tokens end first.  Needed are t / (1 + t) of both sizes.
    """
    at = cells.join(placed, "doc")
    unions = stored(at.groupBy("token", "group", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "token-groups")
    several = unions.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("token")
    matrix = stored(unions.join(several, "token", "left_semi"), "token-groups")
    discard(unions)
    held = matrix.select("token", F.col("group").alias("asked"), F.col("component").alias("other"), "lo", "hi")
    fit = (F.col("asked") < F.col("group")) & (F.col("other") != F.col("component")) & (100 * F.col("hi") >= SHARE * F.col("n")) & (100 * F.col("n") >= SHARE * F.col("lo"))
    pairs = at.join(held, "token").filter(fit).groupBy("doc", "asked", "n").agg(F.count(F.lit(1)).alias("shared"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    t, n = SHARE / 100, F.col("n").cast("double")
    as_larger = F.when(F.col("lo") <= F.col("n"), t / (1 + t) * (n + F.greatest(F.col("lo").cast("double"), t * n)) - t * n)
    as_smaller = F.when(F.col("hi") >= F.col("n"), t / (1 + t) * n + (t / (1 + t) - t) * F.least(F.col("hi").cast("double"), n / t))
    found = stored(pairs.filter(F.col("shared") + 1e-6 >= F.least(as_larger, as_smaller)).select(F.col("asked").alias("group"), "doc"), "group-queries")
    discard(matrix)
    return found


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for every id in a link."""
    links = stored(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
        around = links.select(both).select("e.a", "e.b")
        least = stored(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links-least")
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stored(large, "links-large")
        discard(least)
        discard(links)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "links-least")
        links = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        links = stored(links.select("e.a", "e.b").filter("a != b").distinct(), "links")
        discard(large)
        discard(least)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        before = now


def _grouped(classes: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, group, component) of each class, and (group, doc, own) as ``links_of`` takes it; ``linked`` is (doc, component).

    Linked classes share groups by component, the others by their leading shingle; groups hold bounded bytes.
    """
    known = classes.join(linked, "doc", "left")
    key = [F.col("component").isNotNull().alias("known"), F.coalesce("component", "least").alias("key")]
    known = known.select("doc", "bytes", "component", *key)
    blocks = known.groupBy("known", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    block = F.pmod(F.xxhash64("doc"), F.coalesce("blocks", F.lit(1))).alias("block")
    placed = known.join(blocks.filter("blocks > 1"), ["known", "key"], "left").select("doc", "component", "known", "key", block)
    groups = placed.groupBy("known", "key", "block").agg(F.min("doc").alias("group"), F.count(F.lit(1)).alias("size"))
    placed = placed.join(groups, ["known", "key", "block"])
    own = (~F.col("known") & (F.col("size") > 1)).alias("own")
    placed = stored(placed.select("doc", "group", F.coalesce("component", "group").alias("component"), own), "shingle-groups")
    return placed.select("doc", "group", "component"), placed.select("group", "doc", "own")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id``.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than five words is one shingle,
    a null, empty or blank text has none and links with nothing.  Two documents link when 100 times the shared
    shingles reach 75 times all of theirs; ``component_id`` is the smallest id that links reach.  Ids may be of
    any type that sorts.  A row without an id keeps a null component and links with nothing.  Rows that repeat an
    id are one vertex, reached by the links of each.  An empty table gives an empty result; other columns are not
    returned.  Runs jobs when called.
    """
    spark = docs.sparkSession
    base, names = numbered_ids(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")))
    counts = base.select("text").mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter(F.col("n") > FREQUENT), "shingle-counts")
    listed = [r[0] for r in counts.orderBy(F.col("n").desc(), "token").limit(LISTED).select("token").toLocalIterator()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(listed, np.int64).view(np.uint64)))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n", "same", "least", "bytes", "prefix"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        out, prefixes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(prefixes)))
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)), lists], names=names)

        for doc, text in _rows(batches):
            s = shingles(text)
            if len(s):
                p, least = ordered_prefix(s, frequent.value)
                out.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), least, len(text)))
                prefixes.append(p)
            else:
                out.append((doc, 0, None, None, len(text)))
                prefixes.append(s)
            held += len(prefixes[-1])
            if held > 1 << 18 or len(out) >= 4096:
                yield flush()
                out, prefixes, held = [], [], 0
        if out:
            yield flush()

    about = base.mapInArrow(described, "doc long, n long, same binary, least long, bytes long, prefix array<long>")
    about = stored(about, "shingle-sets")
    usable = about.filter("doc is not null and same is not null")
    classes = usable.groupBy("same").agg(F.min("doc").alias("doc"), F.first("n").cast("int").alias("n"), F.first("least").alias("least"), F.min_by("bytes", "doc").alias("bytes"))
    classes = stored(classes, "shingle-classes")
    # Prefixes move once: those of the classes are stored, and the table of all goes but for its short columns.
    sets = stored(usable.join(classes.select("same", "doc"), ["same", "doc"]).select("doc", F.col("n").cast("int").alias("n"), "prefix"), "class-sets")
    about, before = stored(about.select("doc", "n", "same"), "shingle-sizes"), about
    discard(before)
    # 2. tokens that two documents have
    cells = sets.select(F.explode("prefix").alias("token"), "doc", "n")
    common = cells.groupBy("token").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x < y").select("token")
    common = stored(common, "shared-tokens")
    cells = stored(cells.join(common, "token"), "shared-cells")
    discard(sets, common)
    # 3. pivots, then pivots among themselves
    # Stored, so that the join on a hot leading shingle has no aggregate in its tasks and can be split.
    pivots = stored(classes.groupBy("least").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size"), "leading-pivots")
    mates = stored(classes.join(pivots, "least").filter("doc != pivot").select(F.col("pivot").alias("group"), "doc"), "pivot-mates")
    alone = mates.select("group").distinct().select("group", F.col("group").alias("doc"), F.lit(False).alias("own"))
    stars = stored(links_of(base, alone, mates), "pivot-links")
    discard(mates)
    heads = stored(stars.select(F.col("b").alias("doc")).distinct(), "pivots")
    asked = candidates(cells, heads.select("doc", F.col("doc").alias("group"), F.col("doc").alias("component")))
    bridges = stored(links_of(base, heads.select(F.col("doc").alias("group"), "doc", F.lit(False).alias("own")), asked), "pivot-bridges")
    discard(asked)
    known = stored(components(stars.union(bridges)), "known-components")
    # 4. every document against the groups of other components
    placed, members = _grouped(classes, known.select(F.col("id").alias("doc"), "component"))
    asked = candidates(cells, placed)
    links = stored(links_of(base, members, asked), "group-links")
    discard(asked)
    discard(cells)
    found = stored(components(stars.union(bridges).union(links)), "shingle-components")
    reps = classes.select("same", F.col("doc").alias("id")).join(found, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    out = about.join(stored(reps, "class-components"), "same", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    out = out.select("doc", F.col("n").alias("n_shingles"), component.alias("component_id"))
    if names is None:
        return out.withColumnRenamed("doc", id_col)
    out = out.join(names.select("doc", "id"), "doc", "left").join(names.select(F.col("doc").alias("component_id"), F.col("id").alias("name")), "component_id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("name").alias("component_id"))


def first_keys(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key) of the first row of each component among ``keyed`` rows: the smallest id, rows without one last, then the smallest key.

    Stored; what the join stored on the way is deleted.
    """
    return settled(lambda: _first_keys(rows, id_col, text_col), "first-keys")


def _first_keys(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = jaccard_components(rows.select("key", F.col("row")[text_col].alias("text")), "key", "text")
    ids = rows.select("key", F.col("row")[id_col].alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    return found.join(ids, "key").groupBy("component_id").agg(first).select("first.key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id.

    Every row is a vertex of its own.  A row without an id stays only where no row of its component has one; of rows
    that share the smallest id, or have none, the first in the table stays.
    """
    rows = by_key(docs, "join-rows", id_col)
    return rows.join(first_keys(rows, id_col, text_col), "key", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
r as (select x as doc_id, x as seen from (select distinct x from e) union select r.doc_id, e.y from r join e on e.x = r.seen)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(min(r.seen), w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join r on r.doc_id = w.doc_id group by w.doc_id, n.n
"""
