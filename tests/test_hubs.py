"""Hubs, ranks, walks and samples at sizes and shapes that one task could not hold, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import vectors
from graphloom.operators import augment, evaluate, features, hops, order, sample, stats, views
from graphloom.sources import storage
from graphloom.testkg import KG

TRIPLES = "head string, relation string, tail string"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def graph(spark, seed=1, nodes=60, edges=300, hub=25):
    r = random.Random(seed)
    rows = {(f"n{r.randrange(nodes)}", r.choice("pqrs"), f"n{r.randrange(nodes)}") for _ in range(edges)}
    rows |= {(f"n{k}", "p", "hub") for k in range(hub)} | {("hub", "bad", f"n{k}") for k in range(hub)} | {("hub", "q", "hub")}
    return rows, spark.createDataFrame(sorted(rows) * 2, TRIPLES)


def two_hops(rows, deny=("bad",)):
    """The four direction cases."""
    view = [(h, r, t, "-") for h, r, t in rows] + [(t, r, h, "inv") for h, r, t in rows]
    around = {}
    for e, r, o, d in view:
        around.setdefault(e, set()).add((r, o, d))
    facts, composed, entities = set(), set(), set()
    for e, own in around.items():
        for r1, m, _ in own:
            for r2, z, d in around[m]:
                entities.add((e, z))
                if r2 not in deny:
                    facts.add((e, r2, z, d))
                    if r1 not in deny:
                        composed.add((e, f"{r1}.{r2}", z, d))
    return facts, composed, entities


@pytest.mark.parametrize("tile", [3, 20, hops.TILE])
def test_two_hops_in_tiles_are_exact(spark, tile):
    rows, triples = graph(spark)
    facts, composed, entities = two_hops(rows)
    assert (hops.hubs(triples, tile) is None) == (tile == hops.TILE)
    assert pairs(hops.two_hop_facts(triples, ["bad"], tile=tile)) == facts
    assert pairs(hops.two_hop_composed(triples, ["bad"], tile=tile).select("entity", "relation", "other", "direction")) == composed
    assert pairs(hops.two_hop_entities(triples, tile=tile)) == entities
    some = spark.createDataFrame([("hub",), ("n3",)], "entity string")
    assert pairs(hops.two_hop_facts(triples, ["bad"], some, tile=tile)) == {x for x in facts if x[0] in ("hub", "n3")}


def test_composed_names_make_no_pairs(spark, star):
    rows, triples = graph(spark)
    want = {(r,) for _, r, _, _ in two_hops(rows)[1]}
    assert pairs(hops.composed_names(triples, ["bad"])) == want
    some = spark.createDataFrame([("n3",)], "entity string")
    assert pairs(hops.composed_names(triples, ["bad"], some)) == {(r,) for e, r, _, _ in two_hops(rows)[1] if e == "n3"}
    # 10 ** 10 pairs.
    assert pairs(hops.composed_names(star, ["bad"])) == {("r.r",)}


@pytest.fixture(scope="module")
def star(spark):
    """A hub of 100,000 neighbours."""
    return spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("head"), F.lit("r").alias("relation"), F.lit("hub").alias("tail"))


def test_no_task_holds_more_than_a_tile_of_a_hub(spark, star):
    n = hops.neighbours(star).filter("mid = 'hub'")
    near, far = n.filter("hash(entity) % 5 = 0"), n.select(F.col("entity").alias("other"), "mid")
    a, b = hops.tiles(near, far, 4096)
    left, right = ({(r.mid, r._row, r._column): r["count"] for r in x.groupBy("mid", "_row", "_column").count().collect()} for x in (a, b))
    assert left.keys() == right.keys() and max(left.values()) < 1.1 * 4096 and max(right.values()) < 1.1 * 4096
    assert sum(left[k] * right[k] for k in left) == near.count() * far.count()
    some = spark.createDataFrame([(f"x{k}",) for k in range(5)], "entity string")
    got = hops.two_hop_facts(star, ["bad"], some)
    assert got.groupBy("entity").count().collect() and {r["count"] for r in got.groupBy("entity").count().collect()} == {100_000}


def test_two_hop_counts_of_a_hub_make_no_pairs(spark, star):
    some = star.unionByName(spark.createDataFrame([("x1", "r", "y"), ("y", "r", "z")], TRIPLES))
    got = hops.two_hop_counts(some.filter("head in ('x1', 'y') or hash(head) % 20 = 0"), 100, 12)
    true = some.filter("head in ('x1', 'y') or hash(head) % 20 = 0").count() - 1
    counts = {r.entity: r.n for r in got.collect()}
    assert counts["hub"] == 2 and counts["y"] == 2 and counts["z"] == 2
    wrong = [abs(n - true) / true for e, n in counts.items() if e.startswith("x")]
    # Three standard errors of a sketch of 2 ** 12.
    assert len(wrong) > 4000 and max(wrong) < 3 * 2**-6


@pytest.mark.parametrize("exact", [10, 1 << 16])
def test_two_hop_counts_below_the_sketch_size_are_exact(spark, exact):
    rows, triples = graph(spark, 4)
    want = {}
    for e, _ in two_hops(rows)[2]:
        want[e] = want.get(e, 0) + 1
    assert {r.entity: r.n for r in hops.two_hop_counts(triples, exact).collect()} == want
    got = {r.name: r for r in stats.neighbourhood_statistics(triples, spark.createDataFrame([("n1", "t")], "entity string, type string"), exact_pairs=exact).collect()}
    assert abs(got["two-hop neighbours"].mean - np.mean(list(want.values()))) < 1e-9


def test_augment_reaches_hubs(spark):
    _, triples = graph(spark)
    types = spark.createDataFrame([(f"n{k}", f"/t/{k % 4}") for k in range(0, 60, 2)] + [("hub", "/t/h")], "entity string, type string")
    none = spark.createDataFrame([], "relation string, text string")
    encode = lambda df: df.withColumn("u", vectors.unit(F.array(*[(vectors.number(F.concat("sentence", F.lit(str(k)))) % 7 - 3).cast("double") for k in range(4)])))
    args = (triples, types, none, none.withColumnRenamed("relation", "type"), none.withColumnRenamed("relation", "entity"), encode, ["bad"])
    plain, tiled = ([pairs(x) for x in augment.augment(*args, q=0.5, size=4, tile=t)] for t in (hops.TILE, 3))
    assert plain == tiled and plain[0]
    without = pairs(augment.augment(*args, q=0.5, size=4, max_degree=30)[0])
    assert without and without != plain[0]
    both = [pairs(augment.augment(*args, q=0.5, concat=True, tile=t)[0]) for t in (hops.TILE, 3)]
    assert both[0] == both[1]


@pytest.mark.parametrize("concat", [False, True])
def test_augment_makes_no_pairs_of_a_hub(spark, concat):
    """3,000 leaves of one hub, of few kinds and two that are their own: pairs would be nine millions."""
    leaves = spark.range(3000).select(F.concat(F.lit("x"), F.lpad("id", 4, "0")).alias("head"), F.lit("r").alias("relation"), F.lit("hub").alias("tail"))
    triples = leaves.unionByName(spark.createDataFrame([("x0001", "s", "y"), ("y", "t", "z"), ("hub", "u", "w")], TRIPLES))
    types = leaves.select(F.col("head").alias("entity"), F.concat(F.lit("/t/"), F.substring("head", 5, 1)).alias("type"))
    none = spark.createDataFrame([], "relation string, text string")
    seen = spark.sparkContext.accumulator(0)

    def code(sentence):
        seen.add(1)
        v = np.array([len(sentence) % 3, sum(map(ord, sentence)) % 5 - 2])
        return (v / (np.hypot(*v) or 1)).tolist()

    encode = lambda df: df.withColumn("u", F.udf(code, "array<double>")("sentence"))
    args = (triples, types, none, none.withColumnRenamed("relation", "type"), none.withColumnRenamed("relation", "entity"), encode, ["bad"])
    arcs, added = (pairs(x) for x in augment.augment(*args, q=0.5, concat=concat, size=2, tile=1000))
    assert seen.value < 100_000
    assert len({a[0] for a in arcs}) >= 2999
    kind = {}
    for e, *rest in arcs:
        kind.setdefault(e, []).append(tuple(rest))
    like = lambda e: sorted(kind[e])
    assert like("x0002") == like("x0012") == like("x2992")
    # All candidates of a leaf one by one; the first by name of those that are most similar, for each relation.
    unit = lambda s: np.array([len(s) % 3, sum(map(ord, s)) % 5 - 2]) / (np.hypot(len(s) % 3, sum(map(ord, s)) % 5 - 2) or 1)
    centre = np.mean([unit("r hub"), unit("has type /t/2")], 0)
    name = "r.r" if concat else "r"
    want = min((-round(float(unit(f"x{k:04d} {'r r' if concat else 'r'}") @ centre), 9), f"x{k:04d}") for k in range(3000))
    got = {r: (o, s) for r, o, _, s in kind["x0002"]}
    assert got[name][0] == want[1] and abs(got[name][1] + want[0]) < 1e-9


def test_centroids_are_hash_aggregates(spark):
    df = spark.createDataFrame([("e", "r", [0.6, 0.8]), ("e", "q", [1.0, 0.0])], "entity string, relation string, u array<double>")
    plan = features.centroid(df, 2)._jdf.queryExecution().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert features.centroid(df, 2).first().centre == features.centroid(df).first().centre


@pytest.mark.parametrize("limit", [1, 3, 256])
def test_least_coherent_shares_are_the_same_by_either_way(spark, limit):
    r = np.random.default_rng(3)
    rows = [(f"e{k % 7}", f"r{k}", r.integers(-2, 3, 3).astype(float).tolist()) for k in range(90)]
    df = spark.createDataFrame(rows, "entity string, relation string, v array<double>").select("entity", "relation", vectors.unit(F.col("v")).alias("u"))
    got = pairs(features.least_coherent(df, ["relation"], 0.3, size=3, limit=limit).select("entity", "relation"))
    unit = {(e, x): np.array(v) / (np.linalg.norm(v) or 1) for e, x, v in rows}
    want = set()
    for e in {x for x, *_ in rows}:
        own = [x for f, x, _ in rows if f == e]
        centre = np.mean([unit[e, x] for x in own], 0)
        want |= {(e, x) for _, x in sorted((round(float(unit[e, x] @ centre), 9), x) for x in own)[: -(-len(own) * 3 // 10)]}
    assert got == want


# --- ranks
def brute_rank(scores, known, e, t, ties):
    own = scores[e, t]
    rest = [s - ((e, x) in known) for (f, x), s in scores.items() if f == e and x != t]
    above, equal = sum(s > own for s in rest), sum(s == own for s in rest)
    return {"min": 1 + above, "max": 1 + above + equal, "mean": 1 + above + equal / 2}[ties]


@pytest.mark.parametrize("partitions", [1, 5])
def test_ranks_of_a_sweep(spark, partitions):
    r = random.Random(6)
    scores = {(f"e{e}", f"t{t}"): r.choice([0.0, 0.25, 0.5, 1.0, 1.25, float("-inf")]) for e in range(8) for t in range(40)}
    known = {k for k in scores if r.random() < 0.2}
    asked = [k for k in scores if r.random() < 0.2 and k[0] != "e7"]
    asked += asked[:30] + asked[:5] + [("e1", "absent"), ("nobody", "t1")]
    table = spark.createDataFrame([(e, t, None if s == float("-inf") else s) for (e, t), s in scores.items()], "entity string, type string, score double")
    test, true = (spark.createDataFrame(sorted(x), "entity string, type string") for x in (asked, known))
    for ties in ("min", "max", "mean"):
        got = sorted(tuple(x) for x in evaluate.filtered_ranks(table, test, true.union(true), ties, partitions).collect())
        assert got == sorted((e, t, brute_rank(scores, known, e, t, ties)) for e, t in asked if (e, t) in scores)


# --- walks and samples
def test_walks_do_not_depend_on_partitions_and_see_no_whole_head(spark, monkeypatch):
    _, triples = graph(spark, 9)
    seeds = spark.createDataFrame([(f"n{k}",) for k in range(20)] + [("hub",)], "entity string")
    runs = [pairs(sample.walk(triples.repartition(n), seeds, 5, 0.3, None, partitions=n)) for n in (1, 6)]
    assert runs[0] == runs[1]
    edges, heads = sample.adjacency(triples, 5)
    got = {}
    for h in heads.collect():
        got[h["head"]] = (h["first"], h["deg"])
    tails = {r.position: r.tail for r in edges.collect()}
    want = {}
    for h, t in sorted(pairs(triples.select("head", "tail"))):
        want.setdefault(h, []).append(t)
    assert {h: [tails[f + i] for i in range(d)] for h, (f, d) in got.items()} == want
    for df in (edges, heads):
        assert "windowspecdefinition(head" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_positions_need_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = {r.x: r.position for r in order.positions(df.repartition(3), ["x"], partitions=6).collect()}
    assert got == {x: k for k, x in enumerate(sorted(r.x for r in df.collect()))}


@pytest.mark.parametrize("limits", [(1,), (2, 5), (64, 4096)])
def test_samples_of_many_sizes(spark, limits):
    r = random.Random(2)
    rows = [(f"e{k % 9}", round(r.random(), 2), f"t{k}") for k in range(300)]
    sizes = {f"e{k}": [0, 1, 2, 3, 6, 20, 33, 100, -1][k] for k in range(9)}
    df, size = spark.createDataFrame(rows, "entity string, key double, type string"), spark.createDataFrame(sorted(sizes.items()), "entity string, k long")
    want = {(e, t) for e, k in sizes.items() for _, t in sorted((x, t) for f, x, t in rows if f == e)[: max(k, 0)]}
    assert pairs(sample.least(df, size, ["key", "type"], limits).select("entity", "type")) == want


def test_weighted_sample_in_ranges_equals_windows(spark):
    _, triples = graph(spark, 12)
    types = spark.createDataFrame([(f"n{k % 60}", f"/t/{k % 17}") for k in range(500)] + [("hub", f"/t/{k}") for k in range(17)], "entity string, type string")
    ratios = features.degrees(triples, types)
    one, two = (pairs(sample.sample_types(types, triples, ratios, limits=x)) for x in ((1,), (64, 4096)))
    assert one == two and len(one) > 100 and one <= pairs(types)
    assert {e for e, _ in one} <= {r[0] for r in views.universe(triples).collect()}


def shuffled(df):
    """The columns that the shuffles of a plan carry."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


@pytest.mark.parametrize("turns, size", [(1, 100), (3, 4)])
def test_coherence_of_shares_shuffles_no_vectors(spark, turns, size):
    r = np.random.default_rng(5)
    table = spark.createDataFrame([(k, r.integers(-2, 3, 3).astype(float).tolist()) for k in range(11)], "vec_id long, embedding array<double>")
    rows = [(f"e{min(k % 9, k % 4)}", f"r{k}", f"sentence {k % 23}") for k in range(70)]
    facts = spark.createDataFrame(rows, "entity string, relation string, sentence string")
    coded = storage.stored(vectors.row_number(facts, 11).withColumn("n_chars", F.length("sentence")).drop("sentence"), "coded")
    attach = lambda df: vectors.lookup(df, table, 11)
    want = {x.entity: x for x in features.measured(attach(facts), size=3).collect()}
    seen = []

    def run(df, dealt):
        out = features.measured(attach(df), size=3)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        seen.append((dealt, shuffled(out)[1].count("Exchange hashpartitioning")))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        return out

    got = {x.entity: x for x in order.each_entity(coded, run, "measured", size, turns).collect()}
    assert got.keys() == want.keys() and all(abs(got[e].sim_mu - want[e].sim_mu) < 1e-12 and got[e][2:] == want[e][2:] for e in got)
    # Dealing is the only shuffle of dealt rows, and it comes before the vectors.
    assert [d for d, _ in seen] == [True] * turns + [False] * (size == 4) and {n for d, n in seen if d} == {1}
    for fraction, k in ((0.3, None), (None, 2)):
        least = lambda df, dealt: features.least_coherent(attach(df), ["relation"], fraction, k, size=3, dealt=dealt).select("entity", "relation")  # noqa: E731, B023
        assert pairs(order.each_entity(coded, least, "least", size, turns)) == pairs(least(facts, False))


def test_dictionaries_are_joined_without_a_shuffle_of_the_edges(spark):
    kg = KG(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = shuffled(views.describe(views.edge_view(kg.triples), kg.relation_text, kg.entity_desc))[1]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange hashpartitioning(relation" not in plan
