"""SentencePiece encoding and decoding as shortest paths of a weighted finite-state transducer.

Four machines are compiled from the model file:

- the *normaliser* rewrites the input: a trie of the rules of its character map, longest match first, then the space
  rules (marks for spaces, a prefix, runs of spaces);
- the *pieces* are a trie whose paths put out piece ids at a weight;
- the *byte fallback* reads any one character and puts out the ids of its UTF-8 bytes, or the unknown id;
- the *order* weighs neighbouring pieces.  A unigram model does without it: each piece weighs minus its log probability.
  A BPE model has no such weights, but its encodings are a regular language: a sequence of pieces is an encoding exactly
  if each neighbouring pair encodes its own concatenation, because the first merge that crosses a border of the sequence
  would cross it in the pair as well.  So the order gives a pair 0 if it may stand together and infinity if not.

An input is run through the normaliser, which is deterministic.  What comes out is composed with the closure of pieces and
fallback and with the order: a state is a position and the last piece.  The encoding is the path of the least weight in
the tropical semiring; it is found by uniform-cost search that composes arcs as it meets them, furthest position first
among equal weights, and asks for a pair's weight only when it gets to it.  Each position is settled once, since all
paths of weight 0 of a BPE model to a position end in the same piece.

Texts are cut where no piece can reach across (before a run of space marks, around user-defined pieces), and the
paths of such segments are kept in a bounded table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from graphloom.llm.common import read

#: Where the public vocabularies lie unless a caller says otherwise.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + n]
        at += n


def _trie(outputs: dict[str, object]) -> list:
    """Nodes are [output of the string that ends here or None, next nodes by character]."""
    root: list = [None, {}]
    for word, output in outputs.items():
        node = root
        for c in word:
            node = node[1].setdefault(c, [None, {}])
        node[0] = output
    return root


def character_rules(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a compiled character map: a double-array trie over bytes, then the replacements."""
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    texts = blob[4 + size :]
    labels = np.arange(1, 256)
    reach = lambda u: (u >> 10) << ((u & 512) >> 6)
    rules: dict[str, str] = {}
    open_ = [(int(reach(units[0])), b"")]
    while open_:
        node, key = open_.pop()
        at = node ^ labels
        inside = at < len(units)
        found = labels[inside][(units[at[inside]] & 0x800000FF) == labels[inside]]
        for c in found.tolist():
            unit = int(units[node ^ c])
            after = (node ^ c) ^ reach(unit)
            word = key + bytes([c])
            if unit & 256:
                start = int(units[after]) & 0x7FFFFFFF
                rules[word.decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode()
            open_.append((after, word))
    return rules


class Normaliser:
    """The normalising transducer: rules of the character map, user-defined pieces kept as they are, then spaces."""

    def __init__(self, rules: dict[str, str], kept: list[str], prefix: bool, squeeze: bool, escape: bool):
        # A state is the string read since the last output; maps may hold hundreds of thousands of rules.
        self.rules = rules | {k: k for k in kept}
        self.longest = max(map(len, self.rules), default=0)
        firsts = sorted({k[0] for k in self.rules})
        self.starts = re.compile("[" + "".join(map(re.escape, firsts)) + "]") if firsts else None
        self.prefix, self.squeeze, self.space = prefix, squeeze, MARK if escape else " "

    def outputs(self, text: str) -> list[str]:
        """What each step puts out: stretches that no rule reads as they are, then the output of a rule."""
        out, at = [], 0
        while (m := self.starts.search(text, at)) is not None:
            i = m.start()
            end = next((j for j in range(min(len(text), i + self.longest), i, -1) if text[i:j] in self.rules), None)
            if end is None:
                out.append(text[at : m.end()])
                at = m.end()
            else:
                out += (text[at:i], self.rules[text[i:end]])
                at = end
        out.append(text[at:])
        return out

    def __call__(self, text: str) -> str:
        parts = [text] if self.starts is None else self.outputs(text)
        if self.squeeze:
            # Spaces at the start, after a space and at the end are not put out.
            done, after_space = [], True
            for part in parts:
                part = re.sub(" +", " ", part)
                part = part.removeprefix(" ") if after_space else part
                if part:
                    done.append(part)
                    after_space = part.endswith(" ")
            text = "".join(done).rstrip(" " + self.space)
        else:
            text = "".join(parts)
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", self.space)


class _Paths(dict):
    """Ids of segments met so far; emptied when it is full."""

    ROOM, LONGEST = 500_000, 64

    def __init__(self, path):
        super().__init__()
        self.path = path

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = self.path(segment)
        if len(segment) <= self.LONGEST:
            if len(self) >= self.ROOM:
                self.clear()
            self[segment] = ids
        return ids


class Transducer:
    """Normaliser, pieces, byte fallback and order of one model file, ready to be composed with texts."""

    def __init__(self, model: str | bytes):
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        fields = list(_fields(model))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for _, value in (x for x in fields if x[0] == 1):
            piece = dict(_fields(value))
            self.pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            self.kinds.append(piece.get(3, NORMAL))
        trainer = dict(_fields(next((v for k, v in fields if k == 2), b"")))
        spec = dict(_fields(next((v for k, v in fields if k == 3), b"")))
        if trainer.get(3, 1) not in (1, 2) or trainer.get(24) or UNUSED in self.kinds:
            raise ValueError("only unigram and BPE models with marks before words and no unused pieces are supported")
        self.bpe = trainer.get(3, 1) == 2
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        user = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER]
        self.rules = character_rules(spec[2]) if spec.get(2) else {}
        self.normalise = Normaliser(self.rules, user, self.prefix, self.squeeze, bool(spec.get(5, 1)))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.scores = {p: scores[i] for p, i in self.ids.items() if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.surfaces = [p.replace(MARK, " ") if self.kinds[i] in (NORMAL, USER) else "" for i, p in enumerate(self.pieces)]
        self.surfaces[self.unknown] = trainer.get(44, " ⁇ ".encode()).decode()
        # Weights: minus the scores; a user-defined piece beats whatever else could cover it, the fallback is the last resort.
        low, high = min(self.scores.values(), default=0), max(self.scores.values(), default=0)
        weights = dict.fromkeys(self.ids, 0)
        if not self.bpe:
            if high > 0:
                raise ValueError("scores of a unigram model are log probabilities")
            # Whole multiples of 2 ** -30, so that equal sums are equal in any order.
            weights = {p: round((-self.scores[p] if p in self.scores else 0.1 - high * len(p)) * (1 << 30)) for p in self.ids}
        self.fallback = 0 if self.bpe else round((10 - low) * (1 << 30))
        self.root = _trie({p: (i, p, weights[p]) for p, i in self.ids.items() if not (self.bpe and p in user)})
        # Segments: user-defined pieces of a BPE model stand alone; so does a line feed that no piece has.
        alone = [re.escape(u) for u in sorted(user, key=len, reverse=True)] if self.bpe else []
        self.alone = {u: (self.ids[u],) for u in user} if self.bpe else {}
        free = "" if any("\n" in p for p in self.ids) else "\n"
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        rest = "(?s:.)+" if inner else (f"{free}|" if free else "") + rf"{MARK}*[^{MARK}{free}]+|{MARK}+"
        self.split = re.compile("(" + "|".join(alone) + ")") if alone else None
        self.cut = re.compile(rest)
        self.pairs: dict[int, bool] = {}
        self.paths = _Paths(self.path)

    def _together(self, left: str, right: str) -> bool:
        """Whether merging the characters of ``left + right`` by score, leftmost first, ends in just these two."""
        parts, scores = list(left + right), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == [left, right]

    def together(self, left: tuple[int, str, int], right: tuple[int, str, int]) -> bool:
        """The order's verdict on a pair of arcs, with a bounded memory."""
        if len(self.pairs) >= 1 << 20:
            self.pairs.clear()
        found = self.pairs[(left[0] << 24) + right[0]] = self._together(left[1], right[1])
        return found

    def arcs(self, segment: str, i: int) -> list[tuple[int, str, int]]:
        """(id, characters read, weight) composed with the segment at position i: the fallback (a negative id) where no piece
        is just its character, then pieces, shortest first."""
        c = segment[i]
        first = self.root[1].get(c)
        if first is None:
            return [(-1 - ord(c), c, self.fallback)]
        out = [first[0] or (-1 - ord(c), c, self.fallback)]
        node = first[1]
        for c in segment[i + 1 :]:
            found = node.get(c)
            if found is None:
                break
            arc, node = found
            if arc is not None:
                out.append(arc)
        return out

    def shortest(self, segment: str) -> list[tuple[int, str, int]]:
        """The arcs along the path of the least weight through the composed machine.

        Of equal weights to a position the one with the longest last piece counts.  Where all weights are 0 or infinity
        the frontier is a stack, which gives the longest piece at the furthest position first; else it is a heap.
        """
        n, end, serial, weight, settled = len(segment), 0, 0, 0, set()
        state: tuple = (0, None, None)
        frontier: list = []
        arcs, pairs = self.arcs, self.pairs
        while end != n:
            settled.add(end)
            if not self.bpe:
                for arc in arcs(segment, end):
                    to, serial = end + len(arc[1]), serial + 1
                    heapq.heappush(frontier, (weight + arc[2], -to, end, serial, (to, arc, state)))
                while end in settled:
                    weight, _, _, _, state = heapq.heappop(frontier)
                    end = state[0]
                continue
            for arc in arcs(segment, end):
                frontier.append((end + len(arc[1]), arc, state))
            while True:
                state = frontier.pop()
                end, arc, (_, before, _) = state
                if end in settled:
                    continue
                if before is None:
                    break
                fits = pairs.get((before[0] << 24) + arc[0])
                if fits or fits is None and self.together(before, arc):
                    break
        path = []
        while state[1] is not None:
            path.append(state[1])
            state = state[2]
        return path[::-1]

    def path(self, segment: str) -> tuple[int, ...]:
        """Ids put out along the shortest path of one segment; unknown characters side by side are one unknown piece."""
        out: list[int] = []
        for i, piece, _ in self.shortest(segment):
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode()]
            elif out[-1:] != [self.unknown]:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Piece ids of a text; none for an empty one.  A lone surrogate, which UTF-8 has not, becomes U+FFFD."""
        if not text.isascii() and re.search("[\ud800-\udfff]", text):
            text = re.sub("[\ud800-\udfff]", "�", text)
        text, known = self.normalise(text), self.paths.__getitem__
        if self.split is None:
            out = list(chain.from_iterable(map(known, self.cut.findall(text))))
        else:
            out = []
            for part in self.split.split(text):
                out += self.alone[part] if part in self.alone else chain.from_iterable(map(known, self.cut.findall(part)))
        if not self.byte_ids and self.unknown in out:
            out = [x for k, x in enumerate(out) if x != self.unknown or not k or out[k - 1] != x]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        if self.squeeze:
            start = next((k for k, i in enumerate(ids) if self.surfaces[i] != " "), len(ids))
            ids = ids[start:]
        if self.bytes_of.keys().isdisjoint(ids):
            out = "".join(map(self.surfaces.__getitem__, ids))
        else:
            parts, run = [], b""
            for i in ids:
                if i in self.bytes_of:
                    run += self.bytes_of[i]
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = b""
                parts.append(self.surfaces[i])
            out = "".join(parts) + run.decode("utf-8", "replace")
        return out[1:] if (self.prefix or self.squeeze) and out.startswith(" ") else out


@functools.lru_cache(maxsize=2)
def compiled(model_file: str) -> Transducer:
    """One transducer a worker process."""
    return Transducer(model_file)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """One row per document: its id, ``piece_ids``, ``n_pieces``, ``decoded_sha256``, ``round_trip``.

    ``round_trip`` says whether the decoded ids give the normalised text again, its marks as spaces (where the
    normaliser changes nothing, the text itself).  A null or empty text has no pieces and decodes to an empty text.
    Ids of any type pass through as they are, null or repeated; an empty table gives an empty result; other columns
    are not returned.  Rows are handled in batches that Spark bounds, each text on its own.  The model file must be
    readable on the workers.
    """
    kind = docs.schema[id_col].dataType
    names = ["piece_ids", "n_pieces", "decoded_sha256", "round_trip"]
    kinds = [ArrayType(IntegerType()), LongType(), StringType(), BooleanType()]
    schema = StructType([StructField("id", kind), *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model_file)
        plain = not t.rules and not t.squeeze
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                flat, ends, digests, same = array("i"), [0], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    ids = t.encode(text)
                    back = t.decode(ids)
                    want = text if plain else t.normalise(text).replace(MARK, " ")[t.prefix if text else 0 :]
                    flat.extend(ids)
                    ends.append(len(flat))
                    digests.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(back == want or plain and back == text.replace(MARK, " "))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["id", *names])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """All columns plus ``decoded``, the text of ``ids_col``; null ids give null."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = compiled(model_file)
        for batch in batches:
            yield pd.Series([None if ids is None else t.decode(list(ids)) for ids in batch], dtype=object)

    return encoded.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
