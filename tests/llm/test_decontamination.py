"""Benchmark decontamination: the FM-index against plain search, the operator against brute force, odd inputs."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, docs, words

from graphloom.llm import decontamination, fm_index, registry

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("seed,top,n", [(1, 1, 30), (2, 2, 400), (3, 5, 3000), (4, 70, 3000), (5, 1000, 20_000)])
def test_index_finds_every_occurrence(seed, top, n):
    r = np.random.default_rng(seed)
    text = r.integers(0 if seed % 2 else 1, top + 1, n)
    text[r.integers(0, n, n // 40)] = 0
    text[n // 2 : n // 2 + n // 4] = text[: n // 4]
    text[0] = text[-1] = 0
    order = fm_index.suffix_order(text)
    seps = np.cumsum(text == 0) - 1
    whole = [tuple((0, int(s)) if t == 0 else (1, int(t)) for t, s in zip(text, seps, strict=True))][0]
    if n <= 400:
        assert order.tolist() == sorted(range(n), key=lambda k: whole[k:])
    index = fm_index.FMIndex(text, top)
    places = r.integers(0, n + 1, 200)
    symbol, _ = index.wavelet.access(np.minimum(places, n - 1))
    assert symbol.tolist() == text[order[np.minimum(places, n - 1)] - 1].tolist()
    phrases, lengths = np.zeros((300, 6), np.int64), r.integers(1, 7, 300)
    for k, m in enumerate(lengths):
        at = r.integers(0, n - 6)
        phrases[k, :m] = np.where(text[at : at + m] > 0, text[at : at + m], 1) if k % 3 else r.integers(1, top + 1, m)
    low, high = index.search(phrases, lengths)
    view = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(6, np.int64)), 6)
    for k, m in enumerate(lengths):
        want = np.flatnonzero((view[:n, :m] == phrases[k, :m]).all(1))
        assert np.sort(index.locate(np.arange(low[k], high[k]))).tolist() == want.tolist()


def plain(text):
    return WORD.findall((text or "").translate(decontamination.ASCII_LOWER))


def brute(texts, items, window=10):
    """texts: (id, text); items: (item, text)."""
    found = {}
    for item, text in items:
        a = plain(text)
        for k in range(max(len(a) - window + 1, min(len(a), 1))):
            found.setdefault(tuple(a[k : k + window]), set()).add(item)
    sizes = {len(p) for p in found}
    out = []
    for i, text in texts:
        a = plain(text)
        hit, own = set(), set()
        for m in sizes:
            for k in range(len(a) - m + 1):
                if (p := tuple(a[k : k + m])) in found:
                    hit.update(range(k, k + m))
                    own |= {str(x) for x in found[p] if x is not None}
        out.append((i, len(a), len(hit), sorted(own)))
    return out


def clean(text, window_hits):
    spans = [m.span() for m in WORD.finditer(text.translate(decontamination.ASCII_LOWER))]
    out, at, k = "", 0, 0
    while k < len(spans):
        if k in window_hits:
            stop = k
            while stop + 1 in window_hits:
                stop += 1
            out += text[at : spans[k][0]]
            at = spans[stop][1]
            k = stop
        k += 1
    return out + text[at:]


def rows(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()], key=str)


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id string, text string").withColumn("phrase", F.lit("x")).withColumn("item", F.lit(0))


def corpus():
    r = random.Random(3)
    vocabulary = ["alpha", "Beta", "été", "日本", "x", "longer-word", "n0", "ÀB", "w" * 70, "v" * 8, "u" * 9]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [("b", say(25)), ("a", say(12)), ("c", "x alpha"), (None, say(10)), ("d", ""), ("e", None), ("b", say(11)), ("f", "Zebra!"), ("10", say(10)), ("9", say(10))]
    texts = [say(r.randrange(1, 60)) for _ in range(80)]
    for k in range(30):
        text = items[r.choice([0, 1, 3, 6, 8, 9])][1]
        part = text.split(" ")
        a = r.randrange(0, len(part))
        texts.append(say(5) + ".\n" + ", ".join(part[a : a + r.randrange(5, 25)]).upper() + " (" + say(3) + ")")
    texts += [items[0][1]] * 5 + ODD + ["zebra", "ZEBRA zebra-zebra", "x\x00alpha", "x  ,, alpha"]
    return texts, items


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 600])
def test_equals_brute_force(spark, block_bytes):
    texts, items = corpus()
    df = docs(spark, texts).withColumn("row", F.lit(1)).withColumn("words", F.lit("clash")).withColumn("items", F.lit(2))
    df = df.unionByName(df.filter("doc_id between 84 and 86").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(df.filter("doc_id = 85")).repartition(3)
    pairs = list(enumerate(texts)) + [(None, texts[k]) for k in (84, 85, 86)] + [(85, texts[85])]
    assert rows(decontamination.contaminated(df, item_table(spark, items), block_bytes=block_bytes)) == sorted(brute(pairs, items), key=str)


def test_spans_are_removed(spark):
    texts, items = corpus()
    got = {r.doc_id: r for r in decontamination.decontaminate(docs(spark, texts), item_table(spark, items), carry=("source",)).collect()}
    found = {tuple(plain(t)[k : k + 10]) for _, t in items for k in range(max(len(plain(t)) - 9, min(len(plain(t)), 1)))}
    for i, text in enumerate(texts):
        a = plain(text)
        hits = {j for m in {len(p) for p in found} for k in range(len(a) - m + 1) if tuple(a[k : k + m]) in found for j in range(k, k + m)}
        assert got[i].n_hit == len(hits) and got[i].source == "s"
        assert got[i].clean_text == (clean(text, hits) if text is not None else None)


def test_long_documents_and_hot_phrases(spark, monkeypatch):
    hot = words(10, 50)
    long = words(200_000, 1, 50_000) + " " + hot + " " + words(1000, 2)
    texts = [long] + [f"{words(5, k)} {hot} {words(5, 100 + k)}" for k in range(300)] + ["y " * 100_000, "ab" * 2_000_000]
    items = [("1", hot), ("2", words(40, 1, 50_000)), ("3", "y"), ("4", "y y y")]
    assert rows(decontamination.contaminated(docs(spark, texts).coalesce(1), item_table(spark, items))) == sorted(brute(list(enumerate(texts)), items), key=str)
    # Pieces of an index that end inside a phrase.
    monkeypatch.setattr(fm_index, "MOST", 64)
    data = long[-9000:].encode()
    block = decontamination.block_of(["1"], [hot])
    *_, hit, found = decontamination.scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]), block)
    assert hit.sum() == 10 and found.tolist() == [0]


def test_false_hashes_are_found_out(monkeypatch):
    good = decontamination.word_hashes
    monkeypatch.setattr(decontamination, "word_hashes", lambda *a: good(*a) % np.uint64(97))
    text = words(4000, 8, 900)
    phrases = [" ".join(text.split()[k : k + 3]) for k in range(0, 60, 7)] + ["w1"]
    block = decontamination.block_of([str(k) for k in range(len(phrases))], phrases)
    assert block.salt > 0
    data = text.encode()
    *_, hit, _ = decontamination.scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]), block)
    a, want = text.split(), set()
    for p in (x.split() for x in phrases):
        want |= {j for k in range(len(a)) if a[k : k + len(p)] == p for j in range(k, k + len(p))}
    assert set(np.flatnonzero(hit).tolist()) == want


def test_empty_tables(spark):
    texts, items = corpus()
    df = docs(spark, texts)
    assert decontamination.contaminated(df.limit(0), item_table(spark, items)).count() == 0
    none = decontamination.contaminated(df, item_table(spark, items).limit(0))
    assert rows(none) == sorted(brute(list(enumerate(texts)), []), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_brute_force(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").selectExpr(("doc_id" if t == "documents" else "item_id"), "text").collect()]
    want = {i: (n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0) for i, n, hit, own in brute(read("documents"), read("benchmark"))}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in registry.QUERIES["op12_decontamination"](spark, SF).collect()}
    assert got == want and any(x[-1] for x in want.values())
