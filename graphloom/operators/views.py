"""Filters, views, set operations and sentences (P*, U*, J1, J2, J8-J12, J19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import SEP
from graphloom.sources.storage import stored


def drop_self_loops(triples: DataFrame) -> DataFrame:
    """P1."""
    return triples.filter("head != tail")


def drop_relations(triples: DataFrame, deny: list[str]) -> DataFrame:
    """P2."""
    return triples.filter(~F.col("relation").isin(deny))


def with_inverse(triples: DataFrame) -> DataFrame:
    """Each triple from both ends, the second one's relation marked; one scan. Self-loops are dropped first."""
    both = F.array(
        F.struct(F.col("head").alias("entity"), "relation", F.col("tail").alias("other")),
        F.struct(F.col("tail").alias("entity"), F.concat(F.lit("inv-"), "relation").alias("relation"), F.col("head").alias("other")),
    )
    return drop_self_loops(triples).select(F.explode(both).alias("e")).select("e.*")


def edge_view(triples: DataFrame, deny: list[str] | None = None) -> DataFrame:
    """(entity, relation, other, direction): '-' from the head, 'inv' from the tail; a self-loop gives both."""
    some = drop_relations(triples, deny) if deny else triples
    both = F.array(
        F.struct(F.col("head").alias("entity"), "relation", F.col("tail").alias("other"), F.lit("-").alias("direction")),
        F.struct(F.col("tail").alias("entity"), "relation", F.col("head").alias("other"), F.lit("inv").alias("direction")),
    )
    return some.select(F.explode(both).alias("e")).select("e.*")


def facts_of(triples: DataFrame, entity: str) -> DataFrame:
    """Facts with the entity as head."""
    return triples.filter(F.col("head") == entity)


def typed_in_graph(types: DataFrame, triples: DataFrame) -> DataFrame:
    """P5: types of entities that the graph holds."""
    return types.join(universe(triples), "entity", "left_semi")


def low_degree(degrees: DataFrame, q: float = 0.1, keep: bool = True) -> DataFrame:
    """Both degrees at most their quantile. Stores the degrees, which are read twice, unless told that they are stored (``keep``)."""
    degrees = stored(degrees, "degrees") if keep else degrees
    return degrees.crossJoin(F.broadcast(_quantiles(degrees, q))).filter("kg_degree <= _k and et_degree <= _e").drop("_k", "_e")


def high_degree(degrees: DataFrame, q: float = 0.8, keep: bool = True) -> DataFrame:
    """Both degrees above their quantile. Stores the degrees as P6 does."""
    degrees = stored(degrees, "degrees") if keep else degrees
    return degrees.crossJoin(F.broadcast(_quantiles(degrees, q))).filter("kg_degree > _k and et_degree > _e").drop("_k", "_e")


def _quantiles(degrees: DataFrame, q: float) -> DataFrame:
    """Degrees are whole numbers of few values, which is all that an exact percentile holds."""
    return degrees.agg(F.percentile("kg_degree", F.lit(q)).alias("_k"), F.percentile("et_degree", F.lit(q)).alias("_e"))


def in_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Every named count within its bounds, both included."""
    for name, (lo, hi) in ranges.items():
        df = df.filter(F.col(name).between(lo, hi))
    return df


def stratum(df: DataFrame, low: int = 15, high: int = 135) -> DataFrame:
    """Rows outside the middle, with the name of their stratum."""
    name = F.when(F.col("degree") < low, "low").when(F.col("degree") > high, "high")
    return df.withColumn("stratum", name).filter("stratum is not null")


def universe(triples: DataFrame) -> DataFrame:
    """Heads and tails."""
    return triples.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


def record_universe(triples: DataFrame, train: DataFrame, valid: DataFrame, test: DataFrame, mode: str = "train") -> DataFrame:
    """Who gets a record. Graph entities count if a fact without self-loop names them."""
    if mode != "train":
        return test.select("entity").distinct()
    return universe(drop_self_loops(triples)).union(train.select("entity")).union(valid.select("entity")).distinct()


def known_labels(*splits: DataFrame) -> DataFrame:
    """Distinct (entity, type) of the given splits."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s)
    return out.distinct()


def in_use(df: DataFrame, column: str) -> DataFrame:
    """U4."""
    return df.select(column).distinct()


def fact_sentences(triples: DataFrame, relation_text: DataFrame, entity_desc: DataFrame, deny: list[str] | None = None) -> DataFrame:
    """The edge view with its sentence; names without text stand for themselves."""
    return describe(edge_view(triples, deny), relation_text, entity_desc)


def describe(edges: DataFrame, relation_text: DataFrame, entity_desc: DataFrame) -> DataFrame:
    """Add ``sentence`` to (entity, relation, other, direction)."""
    r = relation_text.select("relation", F.col("text").alias("_r"))
    d = entity_desc.select(F.col("entity").alias("other"), F.col("text").alias("_d"))
    rel, desc = F.coalesce("_r", "relation"), F.coalesce("_d", "other")
    sentence = F.when(F.col("direction") == "-", F.concat_ws(" ", rel, desc)).otherwise(F.concat_ws(" ", desc, rel))
    return edges.join(r, "relation", "left").join(d, "other", "left").select(*edges.columns, sentence.alias("sentence"))


def type_sentences(types: DataFrame, type_text: DataFrame) -> DataFrame:
    """J2."""
    t = type_text.select("type", F.col("text").alias("_t"))
    words = F.replace(F.coalesce("_t", "type"), F.lit(SEP), F.lit(" "))
    return types.join(t, "type", "left").select(*types.columns, F.concat(F.lit("has type "), words).alias("sentence"))


def without_triples(triples: DataFrame, removed: DataFrame) -> DataFrame:
    """J8."""
    return triples.join(removed, ["head", "relation", "tail"], "left_anti")


def without_types(types: DataFrame, removed: DataFrame) -> DataFrame:
    """J9."""
    return types.join(removed, ["entity", "type"], "left_anti")


def held_out_types(held: DataFrame, train: DataFrame, entities: DataFrame) -> DataFrame:
    """Of sampled entities, and of types still in train."""
    return held.join(entities, "entity", "left_semi").join(in_use(train, "type"), "type", "left_semi").select("entity", "type")


def used_text(texts: DataFrame, used: DataFrame, column: str) -> DataFrame:
    """J11."""
    return texts.join(in_use(used, column), column, "left_semi")


def induced(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (entity)."""
    n = nodes.select("entity").distinct()
    heads = triples.join(n.withColumnRenamed("entity", "head"), "head", "left_semi")
    return heads.join(n.withColumnRenamed("entity", "tail"), "tail", "left_semi").select("head", "relation", "tail")


def collapse(triples: DataFrame, order: Column | None = None) -> DataFrame:
    """One relation per (head, tail), the last by ``order`` (default: the greatest name)."""
    pick = F.max("relation") if order is None else F.max_by("relation", order)
    return triples.groupBy("head", "tail").agg(pick.alias("relation")).select("head", "relation", "tail")


def label_or_id(df: DataFrame, column: str, entity_text: DataFrame) -> DataFrame:
    """Ids replaced by labels where there are any."""
    t = entity_text.select(F.col("entity").alias(column), F.col("label").alias("_l"))
    return df.join(t, column, "left").withColumn(column, F.coalesce("_l", column)).drop("_l").select(*df.columns)
