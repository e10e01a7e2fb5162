"""Chat formatting: conversations rendered by a compiled template, with a loss mask, and read back.

Turns meet by one shuffle on the conversation and stream past in order; a conversation is rendered piece by piece
into parts of bounded length, so a very long one needs time in one task but no more memory than a short one.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from graphloom.llm.common import read
from graphloom.llm.template import compile_template

#: Turn marks. In roles and texts a backslash goes before control strings and backslashes (in roles before colons too).
TURNS = (
    "{% for m in messages %}### {{ m.role|escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"(?s)### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n")
PART_CHARS = 1 << 20


def escape(value: object) -> str:
    return _CONTROL.sub(r"\\\g<0>", value or "")


def escape_role(value: object) -> str:
    return _ROLE_CONTROL.sub(r"\\\g<0>", value or "")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def format_conversations(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """Rows (conv_id, part, text, mask) in order within each partition, all parts of a conversation in one.

    ``mask`` holds [start, end) code points within the part that lie under a generation mark.  Turns are
    ordered by turn, then role, then text; equal rows are repeated turns.  Null texts and roles count as empty,
    a null turn comes first, and rows with a null conv_id are one conversation.  Ids may be of any type that sorts.
    An empty table gives an empty result; other columns are not read.  A template that asks for what is not there
    raises TemplateError.
    """
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("part", pa.int64()), ("text", pa.string()), ("mask", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape, "escape_role": escape_role})
        ready, chars = [], 0
        for conv_id, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            pieces, mask, at, part = [], [], 0, 0
            for text, flagged in render({"messages": ({"role": r[2] or "", "text": r[3] or ""} for r in rows)}):
                if at >= PART_CHARS:
                    ready.append((conv_id, part, "".join(pieces), mask))
                    chars += at
                    pieces, mask, at, part = [], [], 0, part + 1
                    yield _batch(ready, schema)
                    ready, chars = [], 0
                pieces.append(text)
                if flagged and text:
                    mask.append([at, at + len(text)])
                at += len(text)
            ready.append((conv_id, part, "".join(pieces), mask))
            chars += at
            if chars >= PART_CHARS:
                yield _batch(ready, schema)
                ready, chars = [], 0
        if ready:
            yield _batch(ready, schema)

    return ordered.mapInArrow(run, StructType([StructField("conv_id", kind), *StructType.fromDDL("part long, text string, mask array<array<long>>")]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse what ``format_conversations`` returned: one row per conversation with counts and digests.

    Text that is no sequence of turns raises ValueError.
    """
    kind = formatted.schema["conv_id"].dataType
    schema = pa.schema(
        [("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []
        for conv_id, parts in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            rest = ""
            for _, _, text, mask in parts:
                chars += len(text)
                for start, end in mask:
                    plain = unescape(text[start:end])
                    loss.update(plain.encode())
                    loss_chars += len(plain)
                rest, at = rest + text, 0
                while m := _TURN.match(rest, at):
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                rest = rest[at:]
            if rest:
                raise ValueError(f"conversation {conv_id}: no turn at {rest[:40]!r}")
            ready.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(ready) >= 1000:
                yield _batch(ready, schema)
                ready = []
        if ready:
            yield _batch(ready, schema)

    counts = StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return formatted.mapInArrow(run, StructType([StructField("conv_id", kind), *counts]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(turns))


_ESCAPED = r"length({0}) + len(regexp_extract_all({0}, '\\|###|</turn>{1}'))"
#: The digests straight from the table; a turn takes 14 characters for its marks, an escape one more.
ORACLE_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(14 + {_ESCAPED.format("role", "|:")} + {_ESCAPED.format("text", "")})::bigint as formatted_chars
from t group by conv_id
"""
