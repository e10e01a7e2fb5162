"""Hand-made graphs, and a few registered queries against their SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.functions import text, vectors
from graphloom.operators import augment, datasets, evaluate, features, hops, records, sample, select, stats, views
from graphloom.sources import io

SF = "/root/testdata/sf0.001"
DENY = ["bad"]


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("a", "r", "m"), ("m", "r", "z1"), ("z2", "q", "m"), ("m2", "r", "a"), ("m2", "q", "z3"), ("z4", "r", "m2"), ("a", "loop", "a"), ("a", "s", "m"), ("m", "bad", "z5")]
    return spark.createDataFrame(rows, "head string, relation string, tail string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_degrees_count_loops_twice(spark, triples):
    types = spark.createDataFrame([("a", "/t/x")], "entity string, type string")
    got = {r.entity: (r.kg_degree, r.et_degree) for r in features.degrees(triples, types).collect()}
    assert got["a"] == (5, 1) and got["z5"] == (1, 0)
    assert {r.entity: r.degree for r in sample.node_degrees(triples).collect()}["a"] == 4


def test_inverse_view_drops_loops(triples):
    assert not [r for r in views.with_inverse(triples).collect() if r.entity == r.other]
    assert views.with_inverse(triples).count() == 16


def test_two_hops_cover_the_four_cases(spark, triples):
    who = spark.createDataFrame([("a",)], "entity string")
    got = pairs(hops.two_hop_facts(triples, DENY, who).select("relation", "other", "direction"))
    assert {("r", "z1", "-"), ("q", "z2", "inv"), ("q", "z3", "-"), ("r", "z4", "inv")} <= got
    assert ("bad", "z5", "-") not in got and ("r", "a", "inv") in got


def test_collapse_takes_the_greatest_relation(triples):
    assert ("a", "s", "m") in pairs(views.collapse(triples)) and ("a", "r", "m") not in pairs(views.collapse(triples))


def test_descriptions_and_clusters(spark):
    df = spark.createDataFrame([("l", None), ("l", ""), ("l", "d")], "label string, description string")
    assert [r[0] for r in df.select(text.description(F.col("label"), F.col("description"))).collect()] == ["l", "l", "l, d"]
    kinds = spark.createDataFrame([("/base/x/y",), ("/a/b",), ("flat",), ("/base",), ("x/base/y",), ("/base/",)], "type string")
    got = [tuple(r) for r in kinds.select(text.cluster_or_unknown(F.col("type")), text.cluster(F.col("type"))).collect()]
    assert got == [("/base/x", "/base/x"), ("a", "a"), ("unknown", "flat"), ("base", "/base/"), ("base", "/base/y"), ("/base/", "/base/")]


def test_coherence_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6, 8))
    v[2] = 0
    df = spark.createDataFrame([("e", x.tolist()) for x in v] + [("one", v[0].tolist())], "entity string, v array<double>")
    got = {r.entity: r.sim_mu for r in features.coherence(df.select("entity", vectors.unit(F.col("v")).alias("u"))).collect()}
    u = [x / np.linalg.norm(x) if np.linalg.norm(x) else x for x in v]
    want = np.mean([u[i] @ u[j] for i in range(6) for j in range(i)])
    assert abs(got["e"] - want) < 1e-9 and got["one"] == 0.5


def test_top_facts_short_circuit_and_one_per_relation(spark):
    rows = [("e", "r", f"z{i}", "-", 0.9 - i / 10, 2) for i in range(4)] + [("e", "q", "y", "-", 0.1, 2), ("f", "r", "a", "-", 0.5, 2), ("f", "r", "b", "-", 0.4, 2)]
    df = spark.createDataFrame(rows, "entity string, relation string, other string, direction string, sim double, n_rel int")
    assert pairs(select.top_facts(df).select("entity", "other")) == {("e", "z0"), ("e", "y"), ("f", "a"), ("f", "b")}


def test_budgets_with_zero_quantile(spark):
    df = spark.createDataFrame([("e", 1, 0)], "entity string, k bigint, t bigint")
    r = select.budgets(df, F.lit(3.0), F.lit(0.0)).first()
    assert (r.n_rel, r.n_type) == (4, 2)


def test_ranks_push_known_types_down(spark):
    scores = spark.createDataFrame([("e", "a", 0.9), ("e", "b", 0.8), ("e", "c", 0.7), ("e", "d", 0.7)], "entity string, type string, score double")
    test = spark.createDataFrame([("e", "c")], "entity string, type string")
    known = spark.createDataFrame([("e", "a"), ("e", "c")], "entity string, type string")
    rank = lambda ties: evaluate.filtered_ranks(scores, test, known, ties).first()["rank"]
    assert (rank("min"), rank("max"), rank("mean")) == (2, 3, 2.5)
    alone = spark.createDataFrame([("f", "a", 0.1), ("g", "a", None), ("g", "b", 0.2)], "entity string, type string, score double")
    test = spark.createDataFrame([("f", "a"), ("g", "a")], "entity string, type string")
    assert pairs(evaluate.filtered_ranks(alone, test, test.union(test))) == {("f", "a", 1), ("g", "a", 2)}


def test_selective_is_one_sided_and_full_is_not(spark, triples):
    arc = spark.createDataFrame([("a", "r", "m", "-")], "entity string, relation string, other string, direction string")
    none = arc.limit(0)
    view = pairs(augment.selective(views.edge_view(triples), none, arc))
    assert ("a", "r", "m", "-") not in view and ("m", "r", "a", "inv") in view
    assert ("a", "r", "m") not in pairs(augment.full(triples, none, arc))


def test_records_round_trip(spark, triples):
    types = spark.createDataFrame([("a", "/t/x")], "entity string, type string")
    rec = records.context_records(views.universe(triples), views.with_inverse(triples), types, records.record_defaults(types, triples))
    back = records.parse_records(rec)
    assert ("a", "type", "a", "t", "/t/x") in pairs(back) and ("z5", "type", "z5", "t", "/t/x") in pairs(back)
    assert back.filter("part = 'fact'").count() == 16


def test_records_of_flat_types_lone_entities_and_added_loops(spark):
    triples = spark.createDataFrame([("a", "r", "b"), ("c", "r", "c")], "head string, relation string, tail string")
    types = spark.createDataFrame([("a", "flat"), ("a", "/base/x/y"), ("c", "/t/u")], "entity string, type string")
    who = spark.createDataFrame([("a",), ("c",)], "entity string")
    added = spark.createDataFrame([("c", "inv-q", "c")], "entity string, relation string, other string")
    defaults = records.record_defaults(types, triples)
    make = lambda **k: {r.entity: r.line for r in records.context_records(who, views.with_inverse(triples), types, defaults, **k).collect()}
    # Of /base/x, flat and t the last is t; of the types it is flat.
    assert make() == {
        "a": "a ||| a /base/x /base/x/y [SEP] a unknown flat ||| a r b ||| cluster",
        "c": "c ||| c t /t/u ||| c r a ||| cluster",
    }
    assert make(added=added)["c"] == "c ||| c t /t/u ||| c inv-q c ||| cluster"
    assert make(caps=(None, 1))["a"].count("[SEP]") == 0


def test_encoding_uses_the_dictionary_cluster_and_stops_at_unknown_names(spark):
    rows = spark.createDataFrame([("a", "type", "a", "unknown", "flat"), ("a", "fact", "a", "inv-r", "b")], "entity string, part string, head string, name string, tail string")
    d = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id bigint")
    got = pairs(records.encode_rows(rows, d("a", "b"), d("r"), d("flat"), d("flat")))
    assert got == {(0, "type", 0, 1, 2), (0, "fact", 0, 2, 1)}
    with pytest.raises(Exception, match="no id for b"):
        records.encode_rows(rows, d("a"), d("r"), d("flat"), d("flat")).collect()


def test_readers_are_strict(spark, tmp_path):
    (tmp_path / "kg.txt").write_text(" a\tr\tb \nbad\tline\nx\ty\tz\tw\n")
    assert pairs(io.read_triples(spark, str(tmp_path / "kg.txt"))) == {("a", "r", "b")}


def test_dense_ids_and_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"n{i:03}",) for i in range(57)], "name string")
    assert [tuple(r) for r in sample.dense_ids(df.repartition(7), partitions=5).orderBy("id").collect()] == [(f"n{i:03}", i) for i in range(57)]
    rows = df.select(F.lit("e").alias("entity"), "name")
    one, two = (pairs(sample.fixed_sample(rows.repartition(n), ["name"], 5, 3)) for n in (1, 6))
    assert one == two and len(one) == 5
    assert sample.fixed_sample(rows.limit(2), ["name"], 5).count() == 5


def test_walk_stays_in_the_graph(spark, triples):
    seeds = spark.createDataFrame([("a",), ("m2",)], "entity string")
    got = {r[0] for r in sample.walk(triples, seeds, 4, 0.3).collect()}
    assert {"a", "m2"} <= got <= {r[0] for r in views.universe(triples).collect()}


def test_mann_whitney_and_erfc(spark):
    import math

    df = spark.createDataFrame([(float(v), y) for v, y in [(1, 0), (2, 0), (2, 1), (3, 1), (5, 1), (0, 0)]], "x double, y int")
    r = stats.mann_whitney(df, ["x"], 3).first()
    # Nine pairs, one of them tied; ties of 2 and 2 among 6 values.
    sd = math.sqrt(9 / 12 * (7 - 6 / 30))
    assert r.u == 8.5 and abs(r.z - (4 - 0.5) / sd) < 1e-12 and abs(r.p - math.erfc((4 - 0.5) / sd / math.sqrt(2))) < 1e-6
    for x in (0.0, 0.5, 1.7, 3.0):
        assert abs(spark.range(1).select(stats.erfc(F.lit(x))).first()[0] - math.erfc(x)) < 1e-6


def test_logistic_against_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-x))).astype(int)
    got = {r.term: r.coefficient for r in stats.logistic(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int"), ["x"]).collect()}
    w, d = np.zeros(2), np.stack([x, np.ones(200)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]), d.T @ (y - p))
    assert abs(got["x"] - w[0]) < 1e-5 and abs(got["intercept"] - w[1]) < 1e-5


@pytest.mark.parametrize("name", ["A1_degrees", "A2_text_length", "J3_two_hop_facts", "P3_with_inverse", "S9_arcs_json", "W5_budgets"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    want = sorted(repr([r[[d[0] for d in cur.description].index(c)] for c in cols]) for r in cur.fetchall())
    assert sorted(df.columns) == cols and sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_quantiles_of_skewed_doubles(spark):
    rng = np.random.default_rng(3)
    rows = {"a": rng.normal(size=101).tolist(), "b": [1.0] * 50 + [2.0], "c": [7.5]}
    df = spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs] + [("a", None)], "metric string, value double")
    got = {r.metric: r.q for r in stats.quantiles(df, ["metric"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert all(np.allclose(got[k], np.quantile(v, [0.0, 0.1, 0.5, 0.99, 1.0])) for k, v in rows.items())


def test_encoder_runs_on_distinct_sentences(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("b a",), ("c",), (None,)], "sentence string")
    got = {r.sentence: np.array(r.vector) for r in vectors.encode(df, batch=2).collect()}
    assert set(got) == {"a b", "b a", "c"} and np.array_equal(got["a b"], got["b a"]) and np.abs(got["c"]).sum() == 1 and len(got["c"]) == 64


def test_hubs_can_be_left_out_of_two_hops(spark):
    rows = [(f"x{i}", "r", "hub") for i in range(20)] + [("x0", "r", "m"), ("m", "r", "y")]
    triples = spark.createDataFrame(rows, "head string, relation string, tail string")
    assert hops.two_hop_entities(triples).count() > 400 and hops.two_hop_entities(triples, 10).count() == 8


def test_data_sets_of_a_small_graph(spark, triples):
    types = spark.createDataFrame([("a", "/t/x"), ("m", "/t/y"), ("z1", "flat")], "entity string, type string")
    none = types.limit(0)
    arcs = spark.createDataFrame([("a", "q", "z1", "inv")], "entity string, relation string, other string, direction string")
    gone = spark.createDataFrame([("m", "r", "a", "inv")], "entity string, relation string, other string, direction string")
    change = (arcs, spark.createDataFrame([("a", "/t/y")], "entity string, type string")), (gone, types.filter("entity = 'z1'"))
    out = datasets.full(triples, types, none, none, *change)
    assert ("z1", "q", "a") in pairs(out["triples"]) and ("a", "r", "m") not in pairs(out["triples"]) and pairs(out["types"]) == {("a", "/t/x"), ("m", "/t/y"), ("a", "/t/y")}
    lines = {(r.mode, r.entity): r.line for r in out["records"].collect()}
    assert "a inv-q z1" in lines["train", "a"] and "z1 q a" in lines["train", "z1"] and not [k for k in lines if k[0] == "test"]
    one = {r.entity: r.line for r in datasets.selective(triples, types, none, none, *change)["records"].collect()}
    assert "a inv-q z1" in one["a"] and "z1 q a" not in one["z1"] and "m inv-r a" not in one["m"] and "a r m" in one["a"]
    old = spark.createDataFrame([("r", 0), ("q", 1)], "name string, id bigint")
    more = datasets.concat(triples, types, none, none, (arcs.withColumn("relation", F.lit("r.q")), none), (gone, none), old)
    assert pairs(more["relations"]) == {("r", 0), ("q", 1), ("r.q", 2)} and ("z1", "r.q", "a") in pairs(more["triples"])
    part = datasets.sampled(triples, types, none, types, features.degrees(triples, types), old.select(F.col("name").alias("relation"), F.lit("t").alias("text")), types.select("type", F.lit("t").alias("text")), 2, 2)
    assert pairs(part["train"]) <= pairs(types) and {k for k, *_ in pairs(part["dictionaries"])} >= {"entity", "relation"} and part["records"].filter("mode = 'train'").count() >= 2
