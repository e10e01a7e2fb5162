"""Two-hop neighbourhoods (J3-J7, G15) and their counts (A5).

Selected entities are joined in first; pairs (entity, mid) are distinct before they fan out.  A mid with many edges, a
hub, is paired in tiles: both of its sides are split into fragments of about ``tile`` rows and every two fragments meet
in a group of their own, so that no task holds more than a tile of a hub.  Repeated pairs are dropped where they arise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import views
from graphloom.sources.storage import stored

#: Rows of either side that one tile pairs.
TILE = 1 << 12


def neighbours(triples: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Distinct (entity, mid), either direction."""
    out = views.edge_view(triples).select("entity", F.col("other").alias("mid"))
    return (out if entities is None else out.join(entities.select("entity").distinct(), "entity", "left_semi")).distinct()


def without_hubs(mids: DataFrame, triples: DataFrame, max_degree: int | None) -> DataFrame:
    """Rows whose ``mid`` has at most ``max_degree`` edges; all of them if that is None.

    A mid of D neighbours makes D * D two-hop pairs, so a graph with hubs of millions needs a bound, which changes the result.
    """
    if max_degree is None:
        return mids
    hubs = views.edge_view(triples).groupBy(F.col("entity").alias("mid")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_degree)
    return mids.join(hubs.select("mid"), "mid", "left_anti")


def hubs(triples: DataFrame, tile: int = TILE) -> DataFrame | None:
    """(mid) of all mids with more than ``tile`` edges, stored; None if there are none. Runs a job."""
    n = views.edge_view(triples).groupBy(F.col("entity").alias("mid")).agg(F.count(F.lit(1)).alias("n"))
    found = stored(n.filter(F.col("n") > tile).select("mid"), "hubs")
    return None if found.isEmpty() else found


def tiles(near: DataFrame, far: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``mid`` with tile numbers ``_row`` and ``_column``: rows that have both and the mid in common make every pair once.

    A side of n rows of a mid falls into ceil(n / tile) fragments by hash, and is repeated for each fragment of the other
    side: pairing a rows with b costs about 2 a b / tile shuffled rows, whatever the number of tasks.
    """
    count = lambda df, name: df.groupBy("mid").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    shape = stored(count(near, "_rows").join(count(far, "_columns"), "mid"), "tiles")
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = near.join(shape, "mid").select(*near.columns, part(near, "_rows").alias("_row"), every("_columns").alias("_column"))
    b = far.join(shape, "mid").select(*far.columns, part(far, "_columns").alias("_column"), every("_rows").alias("_row"))
    return a, b


def through(near: DataFrame, far: DataFrame, hub: DataFrame | None, tile: int = TILE) -> DataFrame:
    """Join of (mid, ...) with (mid, ...): a plain one for light mids, tiles for those in ``hub``."""
    if hub is None:
        return near.join(far, "mid")
    light = near.join(hub, "mid", "left_anti").join(far.join(hub, "mid", "left_anti"), "mid")
    a, b = tiles(near.join(hub, "mid", "left_semi"), far.join(hub, "mid", "left_semi").distinct(), tile)
    return light.unionByName(a.join(b, ["mid", "_row", "_column"]).drop("_row", "_column"))


def two_hop_facts(triples: DataFrame, deny: list[str], entities: DataFrame | None = None, max_degree: int | None = None, tile: int = TILE) -> DataFrame:
    """Distinct (entity, relation, other, direction) over any mid; the second relation is not denied. Runs a job that finds hubs."""
    far = views.edge_view(triples, deny).withColumnRenamed("entity", "mid")
    near = without_hubs(neighbours(triples, entities), triples, max_degree)
    return through(near, far, hubs(triples, tile), tile).select("entity", "relation", "other", "direction").distinct()


def two_hop_composed(triples: DataFrame, deny: list[str], entities: DataFrame | None = None, max_degree: int | None = None, tile: int = TILE) -> DataFrame:
    """As J3 with ``r1.r2``; neither relation denied. ``r1`` and ``r2`` are kept for the sentence."""
    near = views.edge_view(triples, deny).select("entity", F.col("relation").alias("r1"), F.col("other").alias("mid"))
    if entities is not None:
        near = near.join(entities.select("entity").distinct(), "entity", "left_semi")
    far = views.edge_view(triples, deny).select(F.col("entity").alias("mid"), F.col("relation").alias("r2"), "other", "direction")
    near = without_hubs(near.distinct(), triples, max_degree)
    out = through(near, far, hubs(triples, tile), tile).select("entity", "r1", "r2", "other", "direction").distinct()
    return out.withColumn("relation", F.concat_ws(".", "r1", "r2"))


def composed_names(triples: DataFrame, deny: list[str], entities: DataFrame | None = None, max_degree: int | None = None) -> DataFrame:
    """(relation): the distinct ``r1.r2`` that J4 gives, without its pairs: relations before and after each mid are made distinct first."""
    near = views.edge_view(triples, deny)
    if entities is not None:
        near = near.join(entities.select("entity").distinct(), "entity", "left_semi")
    near = without_hubs(near.select(F.col("other").alias("mid"), F.col("relation").alias("r1")).distinct(), triples, max_degree)
    far = views.edge_view(triples, deny).select(F.col("entity").alias("mid"), F.col("relation").alias("r2")).distinct()
    return near.join(far, "mid").select("r1", "r2").distinct().select(F.concat_ws(".", "r1", "r2").alias("relation")).distinct()


def two_hop_types(triples: DataFrame, types: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Distinct types of all direct neighbours; own types are not excluded."""
    t = types.select(F.col("entity").alias("mid"), "type")
    return neighbours(triples, entities).join(t, "mid").select("entity", "type").distinct()


def two_hop_entities(triples: DataFrame, max_degree: int | None = None, tile: int = TILE) -> DataFrame:
    """Distinct (entity, other) at two hops in any direction, the entity itself included."""
    n = neighbours(triples)
    far = n.select(F.col("entity").alias("mid"), F.col("mid").alias("other"))
    return through(without_hubs(n, triples, max_degree), far, hubs(triples, tile), tile).select("entity", "other").distinct()


def two_hop_counts(triples: DataFrame, exact_pairs: int = 1 << 16, precision: int = 12, tile: int = TILE) -> DataFrame:
    """(entity, n): how many entities J6 gives each, without making the pairs of entities near hubs.

    An entity whose mids have ``exact_pairs`` neighbours or fewer together is counted pair by pair, in tiles.  For the others every
    mid's neighbours become one distinct sketch, and an entity merges those of its mids: exact up to 2 ** ``precision``
    entities, beyond that with a standard error of 2 ** (-precision / 2).  Stores the neighbours and
    the split.
    """
    near = stored(neighbours(triples), "neighbours")
    degree = near.groupBy(F.col("entity").alias("mid")).agg(F.count(F.lit(1)).alias("_d"))
    reach = stored(near.join(degree, "mid").groupBy("entity").agg(F.sum("_d").alias("_reach")), "reach")
    few, many = (reach.filter(c).select("entity") for c in (F.col("_reach") <= exact_pairs, F.col("_reach") > exact_pairs))
    far = near.select(F.col("entity").alias("mid"), F.col("mid").alias("other"))
    exact = through(near.join(few, "entity", "left_semi"), far, hubs(triples, tile), tile).select("entity", "other").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    mine = near.join(many, "entity", "left_semi")
    sketch = far.join(mine.select("mid").distinct(), "mid", "left_semi").groupBy("mid").agg(F.theta_sketch_agg("other", precision).alias("_s"))
    merged = mine.join(sketch, "mid").groupBy("entity").agg(F.theta_sketch_estimate(F.theta_union_agg("_s", precision)).cast("long").alias("n"))
    return exact.unionByName(merged)


def out_neighbour_types(triples: DataFrame, types: DataFrame) -> DataFrame:
    """One row per triple and type of its tail."""
    return triples.join(types.withColumnRenamed("entity", "tail"), "tail").select(F.col("head").alias("entity"), "tail", "type")


def ego_network(triples: DataFrame, known: DataFrame, missing: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) around each centre; a node keeps its first role: centre, neighbour, known type, missing type."""
    c = centres.select(F.col("entity").alias("centre")).distinct()

    def around(df: DataFrame, key: str, relation, node: str, role: int) -> DataFrame:
        return df.join(c.withColumnRenamed("centre", key), key, "left_semi").select(
            F.col(key).alias("centre"), relation.alias("relation"), F.col(node).alias("node"), F.lit(role).alias("rank")
        )

    edges = (
        around(triples, "head", F.col("relation"), "tail", 1)
        .unionByName(around(known, "entity", F.lit("has_type"), "type", 2))
        .unionByName(around(missing, "entity", F.lit("has_type"), "type", 3))
    )
    named = F.element_at(F.array(*[F.lit(x) for x in ("centre", "neighbour", "known type", "missing type")]), F.min("rank") + 1)
    own = c.select("centre", F.col("centre").alias("node"), F.lit(0).alias("rank"))
    nodes = edges.select("centre", "node", "rank").unionByName(own).groupBy("centre", "node").agg(named.alias("role"))
    return edges.drop("rank"), nodes
