"""Registered queries without SQL against plain Python, over the whole smallest tables."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from test_operators import brute_repeats

import corpus_pipeline
from graphloom.llm import common, jaccard_join, line_dedup, registry, sentencepiece_wfst

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table():
    return duckdb.sql(f"select doc_id, coalesce(text, '') as text, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def rows(spark, name):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, SF).collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1_equals_the_library(spark, table):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_wfst.DEFAULT_MODEL)
    got = rows(spark, "op1_sentencepiece")
    assert len(got) == len(table)
    for i, text, _ in table:
        assert list(got[i].piece_ids) == lib.encode(text) and got[i].decoded_sha256 == sha(lib.decode(lib.encode(text))) and got[i].round_trip


def test_op2_equals_brute_force(spark, table):
    want = {table[k][0]: (n, gone, spans, sha(kept)) for k, (n, gone, spans, kept) in brute_repeats([t for _, t, _ in table]).items()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows(spark, "op2_suffix_dedup").items()} == want


def test_op4_meets_its_contract(spark, table):
    got = rows(spark, "op4_mixing")
    size = {i: len(WORD.findall(t)) for i, t, _ in table}
    names = sorted({s for *_, s in table if s is not None}) + [None] * any(s is None for *_, s in table)
    total = {s: sum(size[i] for i, _, x in table if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, float(sum(total.values())), list(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * total[s]]
        target |= {s: 3.0 * total[s] if full else share[s] for s in full or free}
        left -= sum(target[s] for s in full)
        free = [s for s in free if s not in full] if full else []
    for i, _, s in table:
        assert (got[i].size, got[i].source_size) == (size[i], total[s]) and abs(got[i].target - target[s]) < 1e-6 and 0 <= got[i].taken <= 3 * size[i]
    for s in names:
        assert abs(sum(got[i].taken for i, _, x in table if x == s) - target[s]) <= max(3, 1e-4 * target[s])


def test_op8_keeps_the_base_spans(spark, table):
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [
        ("assign", re.compile(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    got = rows(spark, "op8_secret_scan")
    for i, text, _ in table:
        spans = [(m.start(), k, m.end(), kind) for k, (kind, pattern, good) in enumerate(kinds) for m in pattern.finditer(text) if good(m)]
        base = [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans)]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(x[3] == k for x in spans) for k, *_ in kinds), sha(",".join(base)))
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if not x.startswith("novel")] == base and len(every) == len(base) + r.n_novel


def test_op9_offsets_and_families(spark, table):
    got = rows(spark, "op9_license_scan")
    found = 0
    for i, text, _ in table:
        for x in got[i].found:
            part = text[x.start : x.end]
            assert part == part.rstrip() and "\n" not in part and 0.5 <= x.probability <= 1 and (x.confirmed or x.family == "unknown")
            found += x.confirmed
        assert got[i].n_confirmed + got[i].n_unknown == len(got[i].found)
    licensed = sum("Apache License" in t or "MIT License" in t or "All rights reserved" in t for _, t, _ in table)
    assert np.sign(found) == np.sign(licensed)


def test_no_component_vanishes_in_the_line_stage(spark):
    """Over a whole table: of every component of near copies at least one document stays, and hardly a copy reaches the mix."""
    sf = "/root/testdata/sf0.01"
    docs = common.stored(corpus_pipeline.quality_stage(spark, common.read(spark, sf, "documents"), sf), "quality")
    component = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    kept = common.stored(corpus_pipeline.line_stage(spark, docs, sf), "lines")
    left = {r.doc_id: r.text for r in kept.collect()}
    assert {component[i] for i in left} == set(component.values())
    # Who is alone in its component keeps every line that dedup leaves.
    alone = {i for i, c in component.items() if list(component.values()).count(c) == 1}
    lines = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(docs).collect()}
    assert all(left[i] == lines[i] for i in left) and alone <= left.keys()
    mixed = [r.doc_id for r in corpus_pipeline.join_stage(spark, kept, sf).collect()]
    assert len(mixed) - len({component[i] for i in mixed}) <= 7
