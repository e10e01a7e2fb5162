"""Fill-in-middle: the learned rank index against plain slicing, exact round trips, odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, docs

from graphloom.llm import fill_middle, registry

UNITS = {"char": lambda t: list(t), "line": lambda t: t.split("\n"), "word": lambda t: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", t)}


def units(text, unit):
    if unit != "line":
        return UNITS[unit](text)
    parts = [x + "\n" for x in text.split("\n")]
    parts[-1] = parts[-1][:-1]
    return [x for x in parts if x]


@pytest.mark.parametrize("unit", ["char", "line", "word"])
def test_index_gives_every_boundary(unit):
    r = random.Random(5)
    texts = ["".join(r.choice("ab é日😀 \n\t") for _ in range(r.randrange(400))) for _ in range(60)] + ["", "x" * 5000, "日" * 3000, "a" * 2000 + "日" * 2000 + " b\n" * 700, ""]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for error, block in ((120, 1 << 20), (3, 1000), (1, 64)):
        index = fill_middle.RankIndex(np.frombuffer(b"".join(raw), np.uint8), offsets[:-1], unit, error, block)
        rank = 0
        for k, t in enumerate(texts):
            own = units(t, unit)
            assert index.start_ranks[k] == rank
            want = offsets[k] + np.cumsum([0] + [len(u.encode()) for u in own])
            assert index.lookup(np.arange(rank, rank + len(own) + 1)).tolist() == want.tolist()
            rank += len(own)
        assert index.n == rank


def test_segments_keep_their_error_bound():
    y = np.cumsum(np.random.default_rng(2).integers(1, 5, 20_000))
    for error in (1, 8, 120):
        first, slope = fill_middle.fit(y, error)
        of = np.searchsorted(first, np.arange(len(y)), "right") - 1
        assert np.abs(y[first][of] + slope[of] * (np.arange(len(y)) - first[of]) - y).max() <= error + 1e-6
    assert len(fill_middle.fit(y, 120)[0]) < 60 and len(fill_middle.fit(np.arange(9000))[0]) == 1


def twin(doc_id, text, seed=1, fim_pct=90, spm_pct=20):
    t = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_pct:
        return n, "plain", None, None, t
    if h[3] % 100 < spm_pct:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_odd_inputs_and_round_trip(spark):
    r = random.Random(1)
    long = "".join(r.choice("ab é日😀\n") for _ in range(400_000))
    texts = ODD + ["a <P> b", "<S>", "x<M", "<<P", "<P", "tail <", "a<S" * 40, long, "z" * 3_000_000] + ["".join(r.choice("<PSM> é") for _ in range(12)) for _ in range(200)]
    df = docs(spark, texts).withColumn("n", F.lit("clash")).withColumn("output", F.lit(0)).withColumn("row", F.lit(1)).withColumn("h1", F.lit(2))
    df = df.unionByName(df.filter("doc_id < 6").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(df.filter("doc_id = 5"))
    out = fill_middle.fill_middle(df.withColumnRenamed("n", "extra"), carry=("extra", "text"))
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts) + 7
    for x in got:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == twin(x.doc_id, x.text) and x.back == (x.text or "") and x.extra == "clash"
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(df.limit(0)).count() == 0


def test_words_as_units(spark):
    df = docs(spark, ["one  two three\nfour ", " lead", None] * 20)
    out = fill_middle.fill_middle(df, unit="word", fim_pct=100, carry=("text",)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(x.back == (x.text or "") and x.n == len(units(x.text or "", "word")) for x in out)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = registry.QUERIES["op11_fill_middle"](spark, sf).collect()
    assert len(got) == len(table)
    for x in got:
        n, form, a, b, output = twin(x.doc_id, table[x.doc_id])
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output_sha256, x.restored_sha256) == (n, form, a, b, sha(output), sha(table[x.doc_id]))
