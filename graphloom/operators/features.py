"""Entity features (A1-A4, G13, A22) from sentences with unit vectors ``u``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import vectors
from graphloom.operators import views
from graphloom.operators.order import running
from graphloom.sources.storage import stored


def degrees(triples: DataFrame, types: DataFrame) -> DataFrame:
    """A1: kg_degree (a self-loop counts twice), et_degree, degree, type_kg_ratio for the graph's entities."""
    k = views.edge_view(triples).groupBy("entity").agg(F.count(F.lit(1)).alias("kg_degree"))
    t = types.groupBy("entity").agg(F.count(F.lit(1)).alias("et_degree"))
    out = k.join(t, "entity", "left").withColumn("et_degree", F.coalesce("et_degree", F.lit(0).cast("long")))
    return out.withColumn("degree", F.col("kg_degree") + F.col("et_degree")).withColumn("type_kg_ratio", F.col("et_degree") / F.col("kg_degree"))


def text_length(facts: DataFrame, typed: DataFrame) -> DataFrame:
    """A2: mean sentence length over facts and types of the entities that have facts."""
    f = facts.groupBy("entity").agg(F.sum(F.length("sentence")).alias("a"), F.count(F.lit(1)).alias("n"))
    t = typed.groupBy("entity").agg(F.sum(F.length("sentence")).alias("b"), F.count(F.lit(1)).alias("m"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return f.join(t, "entity", "left").select("entity", ((F.col("a") + zero("b")) / (F.col("n") + zero("m"))).alias("avg_txt_length"))


def _length(sentences: DataFrame) -> Column:
    return F.col("n_chars") if "n_chars" in sentences.columns else F.length("sentence")


def measured(sentences: DataFrame, few: float = 0.5, size: int | None = None) -> DataFrame:
    """(entity, sim_mu, n, chars): coherence, number and total length of an entity's sentences (A2, A3) in one aggregate.

    Rows carry ``u``, perhaps its square ``uu``, and the sentence or its length ``n_chars``.  The mean cosine over all pairs comes from the sum of unit
    vectors instead of pairs; a known ``size`` of the vectors makes the sum a hash aggregate of as many numbers.
    """
    own = F.col("uu") if "uu" in sentences.columns else vectors.dot(F.col("u"), F.col("u"))
    sums = [vectors.vector_sum(F.col("u"), size).alias("s"), F.sum(own).alias("q"), F.count(F.lit(1)).alias("n"), F.sum(_length(sentences)).alias("chars")]
    return sentences.groupBy("entity").agg(*sums).select("entity", vectors.mean_pair_cosine(F.col("s"), F.col("q"), F.col("n"), few).alias("sim_mu"), "n", "chars")


def coherence(sentences: DataFrame, few: float = 0.5, size: int | None = None) -> DataFrame:
    """A3: mean cosine over all pairs of an entity's sentences, as ``measured`` gives it."""
    return measured(sentences.withColumn("n_chars", F.lit(0)), few, size).select("entity", "sim_mu")


def feature_table(triples: DataFrame, types: DataFrame, facts: DataFrame, typed: DataFrame, few: float = 0.5, size: int | None = None) -> DataFrame:
    """The eight feature columns; ``facts`` and ``typed`` carry sentence and unit vector (of a known ``size``, see A3)."""
    return features_of(degrees(triples, types), measured(facts, few, size), measured(typed, few, size), few)


def features_of(degrees: DataFrame, facts: DataFrame, typed: DataFrame, few: float = 0.5) -> DataFrame:
    """G13 from A1 and what ``measured`` gives of facts and types; entities without facts have no text length."""
    side = lambda df, a: df.select("entity", F.col("sim_mu").alias(f"{a}_sim_mu"), F.col("n").alias(f"{a}_n"), F.col("chars").alias(f"{a}_chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = degrees.join(side(facts, "kg"), "entity", "left").join(side(typed, "et"), "entity", "left")
    mean = (F.col("kg_chars") + zero("et_chars")) / (F.col("kg_n") + zero("et_n"))
    return out.select(
        "entity", F.coalesce("kg_sim_mu", F.lit(few)).alias("kg_sim_mu"), F.coalesce("et_sim_mu", F.lit(few)).alias("et_sim_mu"),
        "degree", mean.alias("avg_txt_length"), "kg_degree", "et_degree", "type_kg_ratio",
    )


def neighbour_counts(triples: DataFrame) -> DataFrame:
    """A4: distinct out-neighbours plus distinct in-neighbours."""
    return views.edge_view(triples).groupBy("entity").agg(F.countDistinct("direction", "other").alias("neighbours"))


def centroid(sentences: DataFrame, size: int | None = None) -> DataFrame:
    """(entity, centre, n): mean unit vector of an entity's sentences, a hash aggregate where the ``size`` of vectors is known."""
    g = sentences.groupBy("entity").agg(vectors.vector_sum(F.col("u"), size).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("entity", F.expr("transform(s, x -> x / n)").alias("centre"), "n")


def least_coherent(sentences: DataFrame, keys: list[str], fraction: float | None = 0.05, k: int | None = None, digits: int = 9, size: int | None = None, limit: int = 256, dealt: bool = False) -> DataFrame:
    """The ceil(fraction * count), or k, sentences of each entity with the least mean cosine to all of them.

    The similarity is rounded before ranking, ties go by ``keys``; ``size`` as in ``centroid``.  With a fraction, entities
    that lose ``limit`` sentences at most are ranked with ranks cut before the shuffle; of the others, whose share may be
    millions, scores are stored and places go by range partitions.  Rows that are ``dealt`` (``order.each_entity``) are all
    ranked where they lie.
    """
    c = centroid(sentences, size)
    scored = sentences.join(c, "entity").select("entity", *keys, F.round(vectors.dot(F.col("u"), F.col("centre")), digits).alias("sim"), "n")
    order = Window.partitionBy("entity").orderBy("sim", *keys)
    if k is not None:
        return scored.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")
    if dealt:
        return scored.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.ceil(F.col("n") * F.lit(fraction))).drop("_rn")
    scored = stored(scored.withColumn("_k", F.ceil(F.col("n") * F.lit(fraction))), "coherence")
    names = ["entity", *keys, "sim", "n"]
    few = scored.filter(F.col("_k") <= limit).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).filter(F.col("_rn") <= F.col("_k")).select(*names)
    many = scored.filter(F.col("_k") > limit)
    if many.isEmpty():
        return few
    many = stored(many.withColumn("_o", F.struct("sim", *keys, F.monotonically_increasing_id())).withColumn("_one", F.lit(1)), "coherence-hubs")
    placed = running(many, ["entity"], "_o", "_one", "_before")
    return few.unionByName(placed.filter(F.col("_before") < F.col("_k")).select(*names))


def noise_frequency(facts: DataFrame, column: str, keys: list[str], k: int = 5, size: int | None = None) -> DataFrame:
    """How often each relation (or type) is among the k least coherent sentences of an entity with two or more."""
    return least_coherent(facts, keys, None, k, size=size).filter("n > 1").groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))


def total_frequency(shares: DataFrame, column: str) -> DataFrame:
    """A22 of a whole table from the frequencies of its shares."""
    return shares.groupBy(column).agg(F.sum("frequency").alias("frequency"))
