"""Fill-in-middle transformation: cuts by rank through a piecewise-linear learned index over all boundary offsets.

A cut is drawn as a rank: so many units from the start of a text.  Where that unit begins in the bytes is a lookup
in a learned rank index: the texts of a batch lie end to end, the byte offsets of all unit boundaries are a rising
function of their rank, and error-bounded linear segments fit to it predict an offset within ``ERROR`` bytes; one
stored byte a boundary, the residual, corrects the prediction exactly.  Plain ASCII stretches need one segment and no
residuals.  The index is fitted in blocks, so that a long text costs a byte a unit beside itself.

Forms and cuts depend on a hash of seed and id only.  One narrow pass, no shuffle; the output is turned back by
built-in functions (``restored``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import byte_view, read

SENTINELS = ("<P>", "<S>", "<M>")
ERROR = 120
BLOCK = 1 << 20
BATCH_BYTES = 8 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def boundaries(data: np.ndarray, starts: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, as a mask over UTF-8 bytes.  ``starts``: offsets where texts begin, each a boundary.

    "char" is a code point, "line" a line with its end, "word" a word with the white space behind it (white space
    before the first word is a unit too).
    """
    if unit == "char":
        at = (data & 0xC0) != 0x80
    else:
        at = np.zeros(len(data), bool)
        if unit == "line":
            at[1:] = data[:-1] == 10
        elif unit == "word":
            blank = SPACE[data]
            at[1:] = blank[:-1] & ~blank[1:]
        else:
            raise ValueError(f"unknown unit {unit}")
    at[starts[starts < len(data)]] = True
    return at


def fit(y: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """(first places, slopes) of segments that each predict ``y`` from the place within ``error``: the widest that a cone from their first point allows."""
    if int(y[-1]) - int(y[0]) == len(y) - 1:
        return np.zeros(1, np.int64), np.ones(1)
    first, slopes, start = [], [], 0
    while start < len(y):
        low, high, end, step = -np.inf, np.inf, start + 1, 1 << 12
        while end < len(y):
            stop = min(len(y), end + step)
            run = np.arange(end - start, stop - start, dtype=np.float64)
            rise = (y[end:stop] - y[start]).astype(np.float64)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            good = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else stop - end
            if good:
                low, high = lows[good - 1], highs[good - 1]
            end += good
            if end < stop:
                break
            step *= 2
        first.append(start)
        slopes.append((low + high) / 2 if end > start + 1 else 1.0)
        start = end
    return np.array(first, np.int64), np.array(slopes)


class RankIndex:
    """Byte offset of the unit of any rank; rank ``n`` is the end of the bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, unit: str = "char", error: int = ERROR, block: int = BLOCK):
        if not 0 < error < 127:
            raise ValueError("the error bound must leave residuals in one byte")
        self.n, self.end, self.start_ranks = 0, len(data), np.zeros(len(starts), np.int64)
        ranks, offsets, slopes, self.blocks, self.block_ranks = [], [], [], [], []
        mask = boundaries(data, starts, unit)
        for base in range(0, len(data), block):
            y = np.flatnonzero(mask[base : base + block]) + base
            here = slice(*np.searchsorted(starts, [base, base + block]))
            self.start_ranks[here] = self.n + np.searchsorted(y, starts[here])
            if not len(y):
                continue
            first, slope = fit(y, error)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(y))))
            residual = (y - y[first][of] - np.rint(slope[of] * (np.arange(len(y)) - first[of])).astype(np.int64)).astype(np.int8)
            ranks.append(first + self.n)
            offsets.append(y[first])
            slopes.append(slope)
            self.blocks.append(residual if residual.any() else None)
            self.block_ranks.append(self.n)
            self.n += len(y)
        self.start_ranks[np.searchsorted(starts, len(data)) :] = self.n
        self.ranks, self.offsets, self.slopes = (np.concatenate(x) if x else np.zeros(0) for x in (ranks, offsets, slopes))
        self.block_ranks = np.array(self.block_ranks, np.int64)

    def lookup(self, rank: np.ndarray) -> np.ndarray:
        """Predicted by the segment of each rank, corrected by its residual."""
        out = np.full(len(rank), self.end, np.int64)
        inner = np.flatnonzero(rank < self.n)
        r = rank[inner]
        s = np.searchsorted(self.ranks, r, "right") - 1
        out[inner] = self.offsets[s] + np.rint(self.slopes[s] * (r - self.ranks[s])).astype(np.int64)
        of = np.searchsorted(self.block_ranks, r, "right") - 1
        for b in np.unique(of):
            if (residual := self.blocks[b]) is not None:
                some = of == b
                out[inner[some]] += residual[r[some] - self.block_ranks[b]]
        return out


def transform_batch(data: np.ndarray, offsets: np.ndarray, h: list[np.ndarray], unit: str, fim_pct: int, spm_pct: int, marks: tuple[bytes, bytes, bytes]):
    """(n, form, prefix units, middle units, output) lists of the texts that lie in ``data`` between ``offsets``."""
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    index = RankIndex(data, offsets[:-1], unit)
    first = index.start_ranks
    n = np.append(first[1:], index.n) - first
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), 0)
    at = index.lookup((cuts + first).ravel()).reshape(2, -1)
    at = np.minimum(at, offsets[1:])
    raw, (p, s, m) = data.tobytes(), marks
    forms, outputs = [], []
    whole, spm = h[2] % 100 >= fim_pct, h[3] % 100 < spm_pct
    for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if whole[k] or lo == hi or any(raw.find(x, lo, hi) >= 0 for x in marks):
            forms.append("plain")
            outputs.append(raw[lo:hi])
            continue
        a, b = int(at[0, k]), int(at[1, k])
        prefix, middle, suffix = raw[lo:a], raw[a:b], raw[b:hi]
        forms.append("spm" if spm[k] else "psm")
        outputs.append(b"".join((s, suffix, p, prefix, m, middle) if spm[k] else (p, prefix, s, suffix, m, middle)))
    plain = np.array([f == "plain" for f in forms], bool)
    return n, forms, pa.array(cuts[0], mask=plain), pa.array(cuts[1] - cuts[0], mask=plain), outputs


def fill_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, fim_pct: int = 90, spm_pct: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, columns in ``carry``) of every row.

    A text of n units is cut at two ranks drawn from the hash of ``seed:id``; ``fim_pct`` of 100 texts are rearranged,
    ``spm_pct`` of 100 of these with the suffix first.  A text that is empty or holds a sentinel, and the rest, stay
    "plain": the output is the text, the two counts are null.  A null text counts as empty.  Rows that repeat an id are
    cut by the same draws, each in its own text; a null id draws like an empty one.  Other columns, whatever their
    names, do not matter.  An empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    row = F.struct(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]).alias("row")
    marks = tuple(x.encode() for x in sentinels)
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different sentinels are needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            h = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BATCH_BYTES, "right")) - 1)
                n, form, prefix, middle, output = transform_batch(data, offsets[start : stop + 1], [x[start:stop] for x in h], unit, fim_pct, spm_pct, marks)
                columns = [batch.column("row").slice(start, stop - start), pa.array(n, pa.int64()), pa.array(form), prefix, middle, pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n", "form", "prefix_chars", "middle_chars", "output"])
                start = stop

    rows = docs.select(row, F.col(f"`{text_col}`").alias("text"), *draws)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("row.id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output", *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)])


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before the transformation, from its output and form alone.  No sentinel stands in a rearranged text, so the first of each is the mark."""
    p, s, m = sentinels

    def part(begin: str, end: str | None) -> Column:
        behind = F.substring(output, F.locate(begin, output) + len(begin), F.length(output))
        return F.substring_index(behind, end, 1) if end else behind

    psm = F.concat(part(p, s), part(m, None), part(s, m))
    spm = F.concat(part(p, m), part(m, None), part(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(read(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


_H = ", ".join(f"('0x' || substr(sha256('1:' || doc_id), {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))
ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, {_H} from documents),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
             when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
