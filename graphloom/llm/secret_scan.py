"""Secret scans: fixed patterns, and strings that zstandard primed with a dictionary finds novel.

A candidate is a long run of key characters, or a shorter one with signs among them, on a line that names something
sensitive before it, that follows such a run after a dot, or that lies in a block from a sensitive BEGIN line to its END
line.  Its novelty is the number of bytes it adds to the compressed context around it, the compressor being primed with
common identifiers and code; a string that costs nearly as many bytes as it is long, or as random characters of its
alphabet must, is no repeat.  It is reported if most of it cannot be read as words, numbers and dates either, and it is
neither a UUID nor a checksum that its line calls one.  The scan is one pass over each text, without a shuffle.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read

KINDS = ["assign", "access", "hex", "novel"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these is in every text that _ASSIGN matches, lower-cased.
_NAMES = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Something sensitive, and how far behind it on the same line a candidate may stand.
_SENSITIVE = re.compile(r"(?i)(auth|bearer|credential|passphrase|passwd|password|private|secret|signature|token|api[_-]?key|\bkey\b|\bpwd\b)", re.A)
REACH = 1024
#: A passphrase: signs among letters and digits, no brackets or quotes.
_SIGNED = re.compile(r"[A-Za-z0-9!@#$%^&*~?+_.=/:-]{12,}")
_SIGN = re.compile(r"[!@#$%^&*~?]")
#: No secrets: UUIDs, and checksums that name their kind.
_OTHER = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|(?:md5|sha-?[0-9]{1,3})[-_=/+].*", re.I)
#: What a line calls a checksum or revision, right before it.
_CHECKSUM = re.compile(r"(?i)(?:md5|sha-?\d{1,3}|checksum|digest|integrity|etag|commit|revision|fingerprint)[\"'\x20:=-]{0,4}$")
#: Pairs of letters that words are made of, in English and its neighbours.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ue ci ke ey ok ut us ro io ic ne ma pa ss co me ri ll om ce li ch be ta "
    "el la ec id ca ac na un im fi ge pr no ct tr di il ns rs ow ol po do ie wi wh em lo ad so ho ag am ir su up ap ex ab ai bl pl ul mo fo pe vi ev ty ay ig gh ts ee oo ot av mp ep op sc sh cl au "
    "nn tt rt rd ck ry ly os da za ba ga va bo go wa we wo if ff ls ks ds ms ry ff ph qu ef ib ob ub od ud um ru lu mu nu du bu hu fu cu gr cr br dr fr fl gl sp sk sm sl sw".split()
)
#: A block that names something sensitive; without an END line it goes on while lines hold nothing but key characters.
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,64})-----")
_BODY = re.compile(r"(?:[\x20\t>|\"']*+(?:[A-Za-z][A-Za-z-]*:[^\n]*|[A-Za-z0-9+/_=-]*)[\x20\t\"',;\\]*\r?(?:\n|\Z))+")
_MAYBE = ("auth", "bearer", "credential", "passphrase", "passw", "private", "secret", "signature", "token", "api", "key", "pwd")
#: What source code and settings are full of.
IDENTIFIERS = (
    "access api argument array assert async attribute auth await base boolean buffer build byte cache callback cell char class client "
    "close code column command config connection const content context cookie copy count create credentials data database date debug "
    "default define delete description dict directory document domain double else email enable encode endpoint entry environment error "
    "event exception export false field file filter float format function group handler hash header height hidden host html http https "
    "identifier image import index input insert instance integer interface item json key label length level library license list local "
    "login message method model module name null number object open option output package page parameter parse password path pattern "
    "port prefix print private process property protocol public query read record reference request require reset response result return "
    "role root schema script search secret select self send server service session settings size source start state static status storage "
    "stream string struct style table target template test text thread time timeout title token true type update upload url user username "
    "utils value variable vector version view void width window write"
)


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: str) -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_dict_id=False)


def novelty(candidate: str, before: str, after: str, dictionary: str = IDENTIFIERS) -> float:
    """Compressed bytes that the candidate adds between its neighbours, for each of its own bytes."""
    c = _compressor(dictionary)
    rest = (before + after).encode()
    return (len(c.compress(rest + candidate.encode())) - len(c.compress(rest))) / len(candidate.encode())


def alphabet(word: str) -> int:
    """Size of the least usual alphabet that has all characters of the word."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", word):
        return 16
    size = sum(n for c, n in (("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26)) if re.search(c, word))
    return size + len(set(re.findall("[^0-9A-Za-z]", word)))


def _word_like(part: str, least: int, share: float) -> bool:
    """Letters whose pairs are mostly those of words."""
    low = part.lower()
    pairs = [low[i : i + 2] in PAIRS for i in range(len(low) - 1)]
    return len(part) >= least and sum(pairs) >= share * len(pairs)


def unexplained(word: str) -> float:
    """Share of a string's letters and digits that are no words, short names, numbers or dates.

    Parts between signs are read as a whole, those with capitals inside by their humps.
    """
    total = left = 0
    for part in re.findall("[0-9A-Za-z]+", word):
        total += len(part)
        if part.isdigit() or re.fullmatch("[0-9]{1,8}[TZtz]?[0-9]{0,6}[Zz]?|[a-z]{1,3}|[A-Z]{1,3}|[vVx][0-9]{1,3}", part):
            continue
        for piece in re.findall("[0-9]+|[A-Z]?[a-z]+|[A-Z]+(?![a-z])", part):
            whole = piece == part
            if piece.isdigit():
                # Numbers count where a word stands before them only.
                left += 0 if re.fullmatch("[A-Za-z]{3,}[0-9]+", part) and len(piece) <= 6 else len(piece)
            elif not (_word_like(piece, 4, 0.5) if whole else _word_like(piece, 3, 0.75 if len(piece) < 5 else 0.6)):
                left += len(piece)
    return left / total if total else 0.0


def is_novel(word: str, score: float, threshold: float, inside: bool = False) -> bool:
    """Whether ``score`` bytes a byte are those of a random word.

    Literals of a long word, or of one among its like, are coded at close to its alphabet's entropy, however random it
    is, and those of a short one by its neighbours' letters.  So a word is also novel if it costs that entropy, less a
    tenth.  Names can cost as much, so half of it must be unexplained, and of one without digits more.
    """
    size = alphabet(word)
    if not (score >= threshold or score * 8 >= 0.9 * math.log2(size)):
        return False
    return inside or unexplained(word) >= (0.5 if re.search("[0-9]", word) else 0.6)


def sensitive_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands between a sensitive BEGIN line, but a public key's, and its END line."""
    out = []
    begins = list(_BEGIN.finditer(text))
    for m, after in zip(begins, [*(x.start() for x in begins), len(text)][1:], strict=True):
        if "PUBLIC" in m[1] or not _SENSITIVE.search(m[1]):
            continue
        s, end = m.end(), text.find(f"-----END {m[1]}-----", m.end(), after)
        if end < 0:
            line = text.find("\n", s) + 1
            end = (body.end() if line and (body := _BODY.match(text, line)) else s)
        out.append((s, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, taken: list[tuple[int, int, int]], threshold: float, window: int, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Candidates apart from ``taken`` that stand in a sensitive context and are incompressible there.

    The context of a candidate is also that of those after it, each parted from the one before by a single dot.
    """
    low = text.lower()
    if not any(n in low for n in _MAYBE):
        return []
    out, k, b, linked = [], 0, 0, -1
    ends = sorted((s, e) for s, _, e in taken)
    blocks = sensitive_blocks(text)
    marks = [m.end() for m in _SENSITIVE.finditer(text)]
    long = [m.span() for m in _CANDIDATE.finditer(text)]
    for s, e, signed in _merged(long, [m.span() for m in _SIGNED.finditer(text) if _SIGN.search(m[0])]):
        while b < len(blocks) and blocks[b][1] <= s:
            b += 1
        inside = b < len(blocks) and blocks[b][0] <= s
        at = bisect.bisect_right(marks, s) - 1
        near = inside or linked == s - 1 and text[linked] == "." or at >= 0 and s - marks[at] <= REACH and "\n" not in text[marks[at] : s]
        if near:
            linked = e
        while k < len(ends) and ends[k][1] <= s:
            k += 1
        if any(x < e and s < y for x, y in ends[k : k + 4]):
            continue
        word = text[s:e]
        if not near or not re.search("[A-Za-z]", word) or _OTHER.fullmatch(word) or not inside and _CHECKSUM.search(text[max(0, s - 24) : s]):
            continue
        if signed and sum(bool(re.search(c, word)) for c in ("[a-z]", "[A-Z]", "[0-9]")) < 2:
            continue
        if is_novel(word, novelty(word, text[max(0, s - window) : s], text[e : e + window], dictionary), threshold, inside):
            out.append((s, 3, e))
    return out


def _merged(long: list[tuple[int, int]], signed: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """Runs of key characters, and signed ones that touch none of them, in order; stops at a signed one's end are not its own."""
    out, k = [(s, e, False) for s, e in long], 0
    for s, e in signed:
        while k < len(long) and long[k][1] <= s:
            k += 1
        if k == len(long) or long[k][0] >= e:
            out.append((s, e, True))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.85, window: int = 256, dictionary: str = IDENTIFIERS) -> DataFrame:
    """One row per document: its id and ``found``, an array of (kind, start, end) in code points.

    Spans of the fixed patterns are always there; ``novel`` ones are added where they overlap none.  Sorted by
    start, then kind.  A null or empty text has none.  Ids pass through, null or repeated; an empty table gives
    an empty result; other columns are not returned.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for text in batch:
                text = text or ""
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + novel_spans(text, base, threshold, window, dictionary))])
            yield pd.Series(rows, dtype=object)

    udf = F.pandas_udf(run, "array<struct<kind: string, start: int, end: int>>")
    return docs.select(F.col(id_col), udf(F.col(text_col)).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["kind"] != "novel")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), count("novel"))
