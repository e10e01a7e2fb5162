"""File formats of any layout and length, bounded rows, exact small samples and stable pooling, against plain Python."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import datasets, evaluate, order, records, stats, views
from graphloom.sources import io


def pairs(df):
    return {tuple(r) for r in df.collect()}


# --- S5
def odd(r):
    return "".join(r.choice('ab{}"\\,: \n[]é😀') for _ in range(r.randrange(0, 25)))


def objects(n=500, seed=1):
    r = random.Random(seed)
    return {f"e{i}{odd(r)}": {"label": odd(r), "description": r.choice([None, "", odd(r)])} for i in range(n)}


@pytest.fixture
def small_blocks(spark):
    """Files are read in pieces of 300 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read_json(spark, path, *texts):
    path.mkdir()
    for k, t in enumerate(texts):
        (path / f"f{k}.json").write_text(t, encoding="utf-8")
    return sorted([tuple(r) for r in io.read_entity_json(spark, str(path)).collect()], key=str)


def rows_of(objs):
    return sorted([(k, v["label"], v["description"]) for k, v in objs.items()], key=str)


def test_one_object_in_any_layout(spark, tmp_path, small_blocks):
    objs = objects(150)
    assert read_json(spark, tmp_path / "a", json.dumps(objs, indent=2, ensure_ascii=False)) == rows_of(objs)
    lines = "\n".join(json.dumps({k: v}, ensure_ascii=False) for k, v in objs.items())
    assert read_json(spark, tmp_path / "b", lines) == rows_of(objs)


def test_objects_in_whole_files(spark, tmp_path):
    objs, more = objects(300, 2), {"a": {"label": "x", "description": None}}
    assert read_json(spark, tmp_path / "a", "﻿" + json.dumps(objs) + "\n\n", "{}", " { }\n", json.dumps(more, indent="\t")) == sorted(rows_of(objs) + rows_of(more), key=str)
    inner = '{"a": null, "b": {"label": "x", "extra": {"z": {"y": "}"}}, "description": "q"}, "c": null}'
    assert read_json(spark, tmp_path / "b", inner) == [("a", None, None), ("b", "x", "q"), ("c", None, None)]


BAD = ['{"a": {"label": "x"}', '{"a": {"label": "x"}}}', '{"a": {"label": "x"}} x', '{"a" {"label": "x"}}', '[{"a": {"label": "x"}}]', '{"a": {"label": "x}}', '{"a": {"label": "x"} "b": {"label": "x"}}', '{"a": {"label": "x"},}', '{"a": {"label": "x"}}\n}\n', "words"]


@pytest.mark.parametrize("text", BAD)
def test_malformed_objects_stop_the_job(spark, tmp_path, text):
    with pytest.raises(Exception, match="JSON|FAILFAST|MALFORMED|malformed"):
        read_json(spark, tmp_path / "a", text)


# --- S13
def test_ranks_of_every_form_are_read_back(spark, tmp_path):
    ranks = spark.createDataFrame([("e", "a type", 2.5), ("f", "/t/x", 3.0), ("g", "t 4", 1.0)], "entity string, type string, rank double")
    io.write_lines(io.rank_lines(ranks), str(tmp_path / "r"))
    assert pairs(io.read_ranks(spark, str(tmp_path / "r"))) == pairs(ranks)
    io.write_lines(io.rank_lines(ranks.withColumn("rank", F.col("rank").cast("bigint"))), str(tmp_path / "w"))
    assert ("f", "/t/x", 3.0) in pairs(io.read_ranks(spark, str(tmp_path / "w")))
    io.write_lines(spark.createDataFrame([("e\tt first",)], "value string"), str(tmp_path / "b"))
    with pytest.raises(Exception, match="no rank in line"):
        io.read_ranks(spark, str(tmp_path / "b")).collect()


# --- rows of hubs
@pytest.fixture(scope="module")
def hub(spark):
    """One entity of 20,000 facts among small ones."""
    big = spark.range(20_000).select(F.lit("hub").alias("head"), F.concat(F.lit("r"), F.col("id") % 7).alias("relation"), F.concat(F.lit("x"), "id").alias("tail"))
    return big.unionByName(spark.createDataFrame([("a", "r1", "b"), ("b", "r2", "hub")], "head string, relation string, tail string"))


def test_parts_are_bounded_and_in_order(spark, hub):
    rows = views.with_inverse(hub).select("entity", "relation", "other")
    got = records.grouped_facts(hub, 700).collect()
    assert max(len(r.facts) for r in got) <= 700 and sorted(r.part for r in got if r.entity == "hub") == list(range(29))
    whole = [tuple(f) for r in sorted((r for r in got if r.entity == "hub"), key=lambda r: r.part) for f in r.facts]
    assert whole == sorted(tuple(x)[1:] for x in rows.filter("entity = 'hub'").collect())
    assert {r.part for r in records.grouped_facts(hub).collect()} == {0}
    assert order.parted(rows.limit(0), ["relation"], 5).count() == 0


def test_arcs_of_a_hub_are_written_and_read(spark, hub, tmp_path):
    arcs = views.edge_view(hub)
    io.write_arcs_json(arcs, str(tmp_path / "j"), 900)
    assert spark.read.json(str(tmp_path / "j")).agg(F.max(F.size("arcs"))).first()[0] <= 900
    assert pairs(io.read_arcs_json(spark, str(tmp_path / "j"))) == pairs(arcs)
    io.write_lines(io.arc_lines(arcs, 900), str(tmp_path / "l"))
    back = io.read_arc_lines(spark, str(tmp_path / "l"))
    assert back.count() == arcs.count() and pairs(back) == pairs(arcs.select("entity", "relation", F.concat_ws(",", "other", "direction")))


def test_records_of_a_hub_are_encoded(spark, hub):
    types = spark.createDataFrame([("hub", f"/t/{k}") for k in range(1500)] + [("a", "/t/x")], "entity string, type string")
    defaults, who, facts = records.record_defaults(types, hub), views.universe(hub), views.with_inverse(hub)
    whole, parts = (records.context_records(who, facts, types, defaults, size=n) for n in (1 << 20, 600))
    longest = parts.agg(F.max(F.size("types")), F.max(F.size("relations")), F.max("part")).first()
    assert longest[0] <= 600 and longest[1] <= 600 and longest[2] == 33
    a, b = (sorted(map(str, records.parse_records(x.select("line")).collect())) for x in (whole, parts))
    assert a == b and pairs(whole.filter("part = 0").select("entity", "line").filter("entity = 'a'")) == pairs(parts.select("entity", "line").filter("entity = 'a'"))
    ids = lambda names: names.distinct().select(F.col(names.columns[0]).alias("name"), F.xxhash64(names.columns[0]).alias("id"))
    clusters = types.select(F.lit("t").alias("c"))
    coded = records.encode_rows(records.parse_records(parts), ids(who), ids(hub.select("relation")), ids(types.select("type")), ids(clusters))
    nested = records.encoded_records(coded, 600)
    flat = nested.select("ent", F.explode(F.concat("et", "kg")).alias("x")).select("ent", *[F.col("x")[k] for k in range(3)])
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, coded.select("entity_id", "a", "b", "c").collect()))
    assert nested.agg(F.max(F.size("et")), F.max(F.size("kg"))).first()[:] <= (600, 600)


def test_nested_records_of_a_small_graph(spark):
    rows = spark.createDataFrame([(0, "type", 0, 1, 2), (0, "fact", 0, 2, 1), (0, "fact", 0, 1, 1), (1, "type", 1, 1, 2)], "entity_id long, part string, a long, b long, c long")
    got = {r.ent: (r.part, [list(x) for x in r.et], [list(x) for x in r.kg]) for r in records.encoded_records(rows).collect()}
    assert got == {0: (0, [[0, 1, 2]], [[0, 1, 1], [0, 2, 1]]), 1: (0, [[1, 1, 2]], [])}


def test_data_sets_take_caps(spark, hub):
    types = spark.createDataFrame([("hub", f"/t/{k}") for k in range(150)], "entity string, type string")
    none = types.limit(0)
    arcs = spark.createDataFrame([], "entity string, relation string, other string, direction string")
    out = datasets.full(hub, types, none, types, (arcs, none), (arcs, none), caps=(200, 100))["records"]
    line = out.filter("entity = 'hub' and mode = 'test'").first().line.split("|||")
    assert line[1].count("[SEP]") == 99 and line[2].count("[SEP]") == 199


# --- A18
@pytest.mark.parametrize("n0,n1", [(1, 1), (1, 6), (3, 4), (5, 5), (2, 9), (8, 4)])
def test_exact_p_counts_every_order(n0, n1):
    counts = {}
    for chosen in itertools.combinations(range(n0 + n1), n1):
        u = sum(x - k for k, x in enumerate(chosen))
        counts[u] = counts.get(u, 0) + 1
    for u in range(n0 * n1 + 1):
        tail = sum(c for x, c in counts.items() if x <= min(u, n0 * n1 - u))
        assert abs(stats.exact_mann_whitney(float(u), n0, n1) - min(1, 2 * tail / math.comb(n0 + n1, n1))) < 1e-12


def test_exact_p_of_one_against_many():
    n = 200_000
    assert abs(stats.exact_mann_whitney(3.0, 1, n) - 2 * 4 / (n + 1)) < 1e-15
    u, sd = 8 * 2000 / 2 - 4000, math.sqrt(8 * 2000 * 2009 / 12)
    assert abs(stats.exact_mann_whitney(u, 8, 2000) - math.erfc((4000 - 0.5) / sd / math.sqrt(2))) < 0.003


def test_small_samples_without_ties_are_exact(spark):
    values = [(1.0, 0), (2.0, 0), (3.5, 1), (4.0, 0), (5.0, 1), (6.0, 1), (7.0, 1)]
    df = spark.createDataFrame([(x, x if x != 2.0 else 1.0, y) for x, y in values], "x double, tied double, y int")
    got = {r.metric: r for r in stats.mann_whitney(df, ["x", "tied"]).collect()}
    assert got["x"].exact and got["x"].u == 11.0 and abs(got["x"].p - 2 * 2 / 35) < 1e-12
    assert not got["tied"].exact and got["tied"].p != got["x"].p
    large = spark.createDataFrame([(float(k), k % 2) for k in range(40)], "x double, y int")
    assert not stats.mann_whitney(large, ["x"]).first().exact


# --- A20
def pooled(s, temperatures=(2, 2.5, 3.5, 4.5)):
    s = np.array(s)
    more = np.append(s, s.mean())
    heads = []
    for t in temperatures:
        w = np.exp(t * (more - s.max()))
        heads.append(s.mean() + (more * w).sum() / w.sum())
    heads.append(s.mean() + s.max())
    return 1 / (1 + np.exp(-np.mean(heads)))


@pytest.mark.parametrize("scale", [1, 200, 3000])
def test_pooling_is_stable_over_any_spread(spark, scale):
    r = np.random.default_rng(scale)
    groups = {("e", f"t{k}"): (r.normal(size=r.integers(1, 9)) * scale).tolist() for k in range(60)}
    groups["e", "near"] = [133.3334, 133.33, 133.34, -0.2, 0.1]
    groups["e", "small"] = [0.1, -0.3, 0.2]
    groups["e", "low"] = [-900.0, -900.5, -1800.0]
    df = spark.createDataFrame([(e, t, x) for (e, t), v in groups.items() for x in v] + [("e", "t0", None)], "entity string, type string, s double")
    for most in (8, 0):
        got = {(x.entity, x.type): x.pooled for x in evaluate.pool_scores(df, most_bands=most).collect()}
        assert got.keys() == groups.keys() and all(abs(got[k] - pooled(v)) < 1e-9 for k, v in groups.items())


def test_pooling_shuffles_once(spark):
    df = spark.range(10).select(F.lit("e").alias("entity"), F.col("id").cast("string").alias("type"), (F.col("id") / 3).alias("s"))
    assert evaluate.pool_scores(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
