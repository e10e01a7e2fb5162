"""Sampling and dictionaries (W8-W16, G10, G11, A8, A10, A11). Randomness is a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text
from graphloom.functions.vectors import number
from graphloom.operators import views
from graphloom.operators.order import positions, running
from graphloom.sources.storage import stored


def draw(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends on seed and keys only."""
    return (number(F.concat_ws(":", F.lit(str(seed)), *keys)) + 0.5) / float(1 << 32)


def hub_seeds(triples: DataFrame, n: int = 400) -> DataFrame:
    """Nodes with the most distinct tails; ties by name."""
    return triples.groupBy(F.col("head").alias("entity")).agg(F.countDistinct("tail").alias("out_degree")).orderBy(F.desc("out_degree"), "entity").limit(n)


def random_seeds(triples: DataFrame, n: int = 800, seed: int = 1) -> DataFrame:
    """Nodes with an outgoing edge in hash order."""
    return triples.select(F.col("head").alias("entity")).distinct().orderBy(number(F.concat_ws(":", F.lit(str(seed)), "entity")), "entity").limit(n)


def dense_ids(names: DataFrame, column: str = "name", partitions: int | None = None) -> DataFrame:
    """Ids from 0 in order of the names, by range partitions and their offsets: no single sorting task."""
    spread = names.select(F.col(column).alias("name")).filter("name is not null").distinct()
    return positions(spread, ["name"], "id", partitions)


def append_names(dictionary: DataFrame, names: DataFrame) -> DataFrame:
    """Unknown names get the ids after the greatest one, in order."""
    new = dense_ids(names.join(dictionary, "name", "left_anti"))
    top = dictionary.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("top"))
    return dictionary.unionByName(new.crossJoin(F.broadcast(top)).select("name", (F.col("id") + F.col("top")).alias("id")))


def type_weights(types: DataFrame) -> DataFrame:
    """A8."""
    return types.groupBy("type").agg(F.log1p(F.count(F.lit(1))).alias("weight"))


def node_degrees(triples: DataFrame) -> DataFrame:
    """A10: edges at a node, a self-loop once."""
    return triples.select(F.explode(F.array_distinct(F.array("head", "tail"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))


def graph_size(triples: DataFrame) -> DataFrame:
    """Nodes, and edges of the collapsed graph."""
    nodes = views.universe(triples).agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.crossJoin(F.broadcast(triples.select("head", "tail").distinct().agg(F.count(F.lit(1)).alias("edges"))))


def least(rows: DataFrame, size: DataFrame, order: list[str], limits: tuple[int, ...] = (64, 4096)) -> DataFrame:
    """The first k rows of each entity in ``order``, which tells them apart; ``size`` is (entity, k), k a number of its own for each.

    Entities fall into classes by k.  Up to a limit their ranks are cut at it before the shuffle, so a task sends no more
    rows of an entity than the limit; beyond the last one, places go by range partitions. Runs a job over ``size``.
    """
    sized = rows.join(size.select("entity", "k"), "entity")
    w = Window.partitionBy("entity").orderBy(*order)
    out, above = None, 0
    for limit in limits:
        some = sized.filter((F.col("k") > above) & (F.col("k") <= limit)).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
        some = some.filter(F.col("_rn") <= F.col("k")).select(*rows.columns)
        out, above = some if out is None else out.unionByName(some), limit
    if size.filter(F.col("k") > above).isEmpty():
        return out
    large = sized.filter(F.col("k") > above).withColumn("_o", F.struct(*order)).withColumn("_one", F.lit(1))
    large = running(large, ["entity"], "_o", "_one", "_place").filter(F.col("_place") < F.col("k")).select(*rows.columns)
    return out.unionByName(large)


def sample_types(types: DataFrame, sampled: DataFrame, ratios: DataFrame, margin: float = 0.1, seed: int = 1, limits: tuple[int, ...] = (64, 4096)) -> DataFrame:
    """Weighted, without replacement: the greatest ln(u) / weight, of size min(int((ratio + margin) * degree), n)."""
    mine = types.join(views.universe(sampled), "entity", "left_semi").distinct()
    size = node_degrees(sampled).join(ratios.select("entity", "type_kg_ratio"), "entity", "left")
    size = size.select("entity", F.floor((F.coalesce("type_kg_ratio", F.lit(0.0)) + margin) * F.col("degree")).alias("k"))
    weights = type_weights(types.join(views.universe(sampled), "entity", "left_semi"))
    key = F.round(-F.log(draw(seed, "entity", "type")) / F.col("weight"), 9)
    keyed = stored(mine.join(weights, "type").select("entity", "type", key.alias("key")), "type-keys")
    return least(keyed, stored(size, "type-sizes"), ["key", "type"], limits).select("entity", "type")


def fixed_sample(rows: DataFrame, keys: list[str], k: int, seed: int = 1) -> DataFrame:
    """K rows per entity: the first in hash order; with fewer rows, drawn with replacement; k = 1: the least key.

    Adds ``slot`` from 1 to k.
    """
    order = [number(F.concat_ws(":", F.lit(str(seed)), "entity", *keys)), *keys] if k > 1 else keys
    w = Window.partitionBy("entity").orderBy(*order)
    # The rank is cut before the shuffle, so each task sends k rows of an entity at most; the counts combine map-side.
    ranked = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    ranked = ranked.join(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity")
    enough = ranked.filter(F.col("n") >= k).withColumn("slot", F.col("rn"))
    slots = ranked.filter(F.col("n") < k).select("entity", "n").distinct().select("entity", "n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"))
    slots = slots.withColumn("rn", (F.floor(draw(seed, "entity", F.col("slot").cast("string")) * F.col("n")) + 1).cast("int")).drop("n")
    again = ranked.filter(F.col("n") < k).join(slots, ["entity", "rn"])
    names = [*rows.columns, "slot"]
    return enough.select(*names).unionByName(again.select(*names))


def capped(rows: DataFrame, keys: list[str], cap: int, seed: int = 1) -> DataFrame:
    """At most ``cap`` rows per entity, in hash order."""
    w = Window.partitionBy("entity").orderBy(number(F.concat_ws(":", F.lit(str(seed)), "entity", *keys)), *keys)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def second_hop_sample(rows: DataFrame, keys: list[str], first: int, second: int, seeds: tuple[int, int] = (1, 2)) -> DataFrame:
    """``second`` rows of each entity that is the ``other`` of ``first`` sampled rows of any entity."""
    reached = fixed_sample(rows, keys, first, seeds[0]).select(F.col("other").alias("entity")).distinct()
    return fixed_sample(rows.join(reached, "entity", "left_semi"), keys, second, seeds[1])


def pair_sample(types: DataFrame, triples: DataFrame, k: int = 6, seed: int = 1) -> DataFrame:
    """K (cluster, type) pairs of each entity as ids of their dictionaries, shifted by the numbers of relations and entities."""
    kinds = dense_ids(types, "type").select(F.col("name").alias("type"), F.col("id").alias("_t"))
    clusters = types.select(text.cluster(F.col("type")).alias("_c"))
    clusters = dense_ids(clusters, "_c").select(F.col("name").alias("_c"), F.col("id").alias("_k"))
    size = views.universe(triples).agg(F.count(F.lit(1)).alias("_E")).crossJoin(triples.agg(F.countDistinct("relation").alias("_R")))
    rows = types.withColumn("_c", text.cluster(F.col("type"))).join(kinds, "type").join(clusters, "_c").crossJoin(F.broadcast(size))
    rows = rows.select("entity", (F.col("_k") + F.col("_R")).alias("cluster"), (F.col("_t") + F.col("_E")).alias("type"))
    return fixed_sample(rows, ["cluster", "type"], k, seed)


def adjacency(triples: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The out-edges of the collapsed graph as a compressed index: (position, tail) in order of (head, tail), and (head, first, deg).

    Neighbour i of a head stands at position first + i.  Positions go by range partitions, so no task sees a whole head.
    Both tables are stored.
    """
    edges = stored(positions(triples.select("head", "tail").distinct(), ["head", "tail"], "position", partitions), "edges")
    heads = edges.groupBy("head").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("deg"))
    return edges.select("position", "tail"), stored(heads, "heads")


def walk(triples: DataFrame, seeds: DataFrame, length: int = 7, restart: float = 0.7, sample_size: int | None = 100_000, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Nodes seen by random walks with restart, one walker a seed, all walkers a step at a time.

    At each step a walker restarts at a seed with probability ``restart`` or moves to an out-neighbour; without
    one it stops.  Neighbours are picked by their position in ``adjacency``, so no list of them is shipped.
    ``sample_size`` keeps the first nodes by (step, walker).  Adjacency is that of the collapsed graph.
    """
    seeds = dense_ids(seeds, "entity", partitions).select(F.col("name").alias("entity"), F.col("id").alias("no"))
    n_seeds = seeds.count()
    edges, heads = adjacency(triples, partitions)
    now = stored(seeds.select(F.col("entity").alias("walker"), F.col("entity").alias("at")), "walk-step")
    seen = [now.select(F.col("at").alias("entity"), F.lit(0).alias("step"), "walker")]
    for step in range(1, length + 1):
        u = lambda what: draw(seed, "walker", F.lit(str(step)), F.lit(what))
        moved = now.join(heads.withColumnRenamed("head", "at"), "at", "left").withColumn("back", u("restart") < restart)
        moved = moved.filter("back or deg is not null").withColumn("position", F.col("first") + F.floor(u("edge") * F.col("deg"))).withColumn("no", F.floor(u("seed") * n_seeds).cast("bigint"))
        ahead = moved.filter("not back").join(edges, "position").select("walker", F.col("tail").alias("at"))
        again = moved.filter("back").join(seeds, "no").select("walker", F.col("entity").alias("at"))
        now = stored(ahead.unionByName(again), "walk-step")
        seen.append(now.select(F.col("at").alias("entity"), F.lit(step).alias("step"), "walker"))
    every = seen[0]
    for s in seen[1:]:
        every = every.unionByName(s)
    nodes = every.groupBy("entity").agg(F.min(F.struct("step", "walker")).alias("first"))
    return nodes.select("entity") if sample_size is None else nodes.orderBy("first", "entity").limit(sample_size).select("entity")
