"""Descriptive and test statistics."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import hops, views
from graphloom.operators.order import running
from graphloom.sources.storage import stored


def quantiles(values: DataFrame, keys: list[str], points: list[float], column: str = "value") -> DataFrame:
    """(keys, q): array of the exact quantiles of each key at ``points``, interpolated between neighbours; nulls do not count."""
    cells = values.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(cells, keys, "_v", "_n", "_below")
    total = placed.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    placed = placed.join(F.broadcast(total), keys)
    at = lambda i: F.max(F.when((F.col("_below") <= i) & (i < F.col("_below") + F.col("_n")), F.col("_v")))
    place = lambda p: p * (F.col("_t") - 1)
    ends = [at(f(place(p))).alias(f"_{n}{k}") for k, p in enumerate(points) for n, f in (("lo", F.floor), ("hi", F.ceil))]
    q = [F.col(f"_lo{k}") + (place(p) - F.floor(place(p))) * (F.col(f"_hi{k}") - F.col(f"_lo{k}")) for k, p in enumerate(points)]
    return placed.groupBy(*keys).agg(F.max("_t").alias("_t"), *ends).select(*keys, F.array(*q).alias("q"))


def describe(values: DataFrame) -> DataFrame:
    """A5: count, mean, sample deviation, min, quartiles, max of the (name, value) rows of each name."""
    x = F.col("value").cast("double")
    g = values.groupBy("name").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    out = g.join(F.broadcast(quantiles(values, ["name"], [0.25, 0.5, 0.75])), "name", "left")
    return out.select("name", "n", "mean", "std", "min", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)], "max")


def neighbourhood_statistics(triples: DataFrame, types: DataFrame, max_degree: int | None = None, exact_pairs: int = 1 << 16, precision: int = 12) -> DataFrame:
    """A5: neighbours, direct types, 2-hop neighbours and neighbour types per entity.

    Two-hop neighbours are counted by ``hops.two_hop_counts``, which is exact for entities of ``exact_pairs`` paths or 2 **
    ``precision`` neighbours at most; with ``max_degree``, pair by pair over mids of as many edges at most.
    """
    from graphloom.operators.features import neighbour_counts

    count = lambda df: df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    parts = {
        "neighbours": neighbour_counts(triples).select(F.col("neighbours").alias("n")),
        "direct types": count(types),
        "two-hop neighbours": hops.two_hop_counts(triples, exact_pairs, precision) if max_degree is None else count(hops.two_hop_entities(triples, max_degree)),
        "neighbour types": hops.out_neighbour_types(triples, types).groupBy("entity").agg(F.countDistinct("type").alias("n")),
    }
    rows = functools.reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), F.col("n").alias("value")) for name, df in parts.items()])
    return describe(stored(rows, "neighbourhoods"))


def summary(triples: DataFrame, train: DataFrame, valid: DataFrame, test: DataFrame) -> DataFrame:
    """(metric, value) of the data set; one aggregate a table."""
    long = lambda df, *names: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("m.*")
    entities = views.universe(triples).agg(F.count(F.lit(1)).alias("entities"))
    edges = triples.agg(F.countDistinct("relation").alias("relations"), F.count(F.lit(1)).alias("triples"))
    kinds = train.unionByName(valid).unionByName(test).agg(F.countDistinct("type").alias("types"))
    rows = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [long(entities, "entities"), long(edges, "relations", "triples"), long(kinds, "types")]
    parts += [long(rows(df, name), name) for df, name in ((train, "train types"), (valid, "valid types"), (test, "test types"))]
    return functools.reduce(DataFrame.unionByName, parts)


#: Columns of the earlier coherence table and the names they get.
COHERENCE = {
    "triple_self_coherence_mean": "kg_sim_mu",
    "triple_self_coherence_std": "kg_sim_sig",
    "type_self_coherence_mean": "et_sim_mu",
    "type_self_coherence_std": "et_sim_sigma",
}


def entity_key() -> Column:
    """Label and description of an entity as the earlier tables name it; a missing description is empty."""
    return F.concat(F.col("label"), F.lit(" "), F.coalesce("description", F.lit("")))


def clean_coherence(measured: DataFrame, entity_text: DataFrame) -> DataFrame:
    """(entity, the four coherence columns): texts mapped back to entities, unknown ones kept as they are.

    Of entities with the same text the greatest name counts. Other columns are dropped.
    """
    keys = entity_text.groupBy(entity_key().alias("_text")).agg(F.max("entity").alias("_e"))
    out = measured.join(keys, F.col("entity") == F.col("_text"), "left")
    return out.select(F.coalesce("_e", "entity").alias("entity"), *[F.col(old).alias(new) for old, new in COHERENCE.items()])


def count_table(triples: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Facts as head, train types and test types per entity, missing ones 0."""
    n = lambda df, key, name: df.groupBy(F.col(key).alias("entity")).agg(F.count(F.lit(1)).alias(name))
    out = n(triples, "head", "facts").join(n(train, "entity", "train_types"), "entity", "full").join(n(test, "entity", "test_types"), "entity", "full")
    return out.fillna(0, ["facts", "train_types", "test_types"])


def representative(counts: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """The second entity, by name, within the ranges; none if there are fewer than two."""
    return views.in_ranges(counts, ranges).select("entity").orderBy("entity").limit(2).orderBy(F.desc("entity")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).filter("n = 2").limit(1).select("entity")


def mean_rank(ranks: DataFrame) -> DataFrame:
    """A12."""
    return ranks.groupBy("entity").agg(F.avg("rank").alias("rank_value"))


def with_rank(features: DataFrame, ranks: DataFrame) -> DataFrame:
    """Unranked entities stay."""
    return features.join(mean_rank(ranks), "entity", "left")


def rank_by_bin(df: DataFrame, metrics: list[str], value: str = "rank_value", bins: int = 10) -> DataFrame:
    """Mean of ``value`` per quantile bin of each metric: equal edges merged, right ends and the least value included."""
    rows = long_form(df.withColumnRenamed(value, "_y"), metrics, ["_y"]).withColumnRenamed("value", "_x").filter("_x is not null")
    edges = quantiles(rows, ["metric"], [i / bins for i in range(bins + 1)], "_x").select("metric", F.array_distinct("q").alias("_e"))
    inside = F.greatest(F.size(F.filter("_e", lambda x: x < F.col("_x"))), F.lit(1))
    return rows.join(F.broadcast(edges), "metric").groupBy("metric", inside.alias("bin")).agg(F.avg("_y").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def long_form(df: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """M6."""
    return df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keep, metrics, "metric", "value")


def scale(df: DataFrame, metrics: list[str]) -> DataFrame:
    """M5: min-max per column; a constant column becomes 0."""
    ends = df.agg(*[F.min(m).alias(f"_lo_{m}") for m in metrics], *[F.max(m).alias(f"_hi_{m}") for m in metrics])
    out = df.crossJoin(F.broadcast(ends))
    for m in metrics:
        lo, hi = F.col(f"_lo_{m}"), F.col(f"_hi_{m}")
        out = out.withColumn(m, F.when(hi == lo, F.when(F.col(m).isNotNull(), 0.0)).otherwise((F.col(m) - lo) / (hi - lo)))
    return out.select(*df.columns)


def class_summary(df: DataFrame, metrics: list[str], median: bool = False, low: int = 15, high: int = 135) -> DataFrame:
    """Per metric, the mean (or median) by y for all rows and for the strata of degrees below ``low`` and above ``high``."""
    v = long_form(df, metrics, ["y", "degree"])
    strata = {"all": F.lit(True), "low": F.col("degree") < low, "high": F.col("degree") > high}
    cells = {f"{name}_{y}": F.when(cond & (F.col("y") == y), F.col("value")) for name, cond in strata.items() for y in (0, 1)}
    if not median:
        return v.groupBy("metric").agg(*[F.avg(x).alias(n) for n, x in cells.items()])
    q = quantiles(v.select("metric", *[x.alias(n) for n, x in cells.items()]).unpivot(["metric"], list(cells), "cell", "value"), ["metric", "cell"], [0.5])
    return q.groupBy("metric").agg(*[F.max(F.when(F.col("cell") == n, F.col("q")[0])).alias(n) for n in cells])


def skewness(df: DataFrame, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """Population skewness, D'Agostino-Pearson K2 and its p, flags; p is null below 8 values."""
    v = long_form(df, metrics, []).filter("value is not null")
    g = v.groupBy("metric").agg(F.count(F.lit(1)).cast("double").alias("n"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("k"))
    n, b = F.col("n"), F.col("k") + 3
    # Skewness z (D'Agostino).
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    a = F.sqrt(2 / (w2 - 1))
    z1 = F.log(y / a + F.sqrt((y / a) * (y / a) + 1)) / F.sqrt(0.5 * F.log(w2))
    # Kurtosis z (Anscombe and Glynn).
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b - e) / F.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    c = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (c - 4))
    z2 = ((1 - 2 / (9 * c)) - F.signum(d) * F.pow((1 - 2 / c) / F.abs(d), F.lit(1 / 3))) / F.sqrt(2 / (9 * c))
    k2 = F.when(n >= 8, z1 * z1 + z2 * z2)
    p = F.exp(-k2 / 2)
    return g.select("metric", n.cast("long").alias("n"), "skew", k2.alias("k2"), p.alias("p"), (F.abs("skew") > 1).alias("skewed"), (p < alpha).alias("not_normal"))


def mann_whitney(df: DataFrame, metrics: list[str], partitions: int | None = None, exact_size: int = 8, exact_cells: int = 10_000_000) -> DataFrame:
    """U of the rows with y = 1 against y = 0, tie-corrected z with continuity correction, two-sided p, and whether p is exact.

    Equal values are grouped first; cumulative counts of the distinct values go by range partitions with offsets, so
    no task sorts a whole metric.  Without ties and with ``exact_size`` rows or fewer on one side, p comes from the null
    distribution of U itself, as long as the product of both sides is ``exact_cells`` at most; else from z.
    """
    v = long_form(df, metrics, ["y"]).filter("value is not null and y is not null")
    cells = v.groupBy("metric", "value").agg(F.sum((F.col("y") == 0).cast("long")).alias("n0"), F.sum((F.col("y") == 1).cast("long")).alias("n1"))
    each = running(cells, ["metric"], "value", "n0", "below", partitions)
    t = (F.col("n0") + F.col("n1")).cast("double")
    g = each.groupBy("metric").agg(
        F.sum(F.col("n1") * (F.col("below") + F.col("n0") / 2)).alias("u"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(t * t * t - t).alias("ties")
    )
    a, b = F.col("n0").cast("double"), F.col("n1").cast("double")
    total = a + b
    sd = F.sqrt(a * b / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = (F.abs(F.col("u") - a * b / 2) - 0.5) / sd
    exact = (F.col("ties") == 0) & (F.least("n0", "n1") <= exact_size) & (a * b <= exact_cells) & (a * b > 0)
    rows = g.select("metric", "u", "n0", "n1", z.alias("z"), F.least(erfc(z / math.sqrt(2.0)), F.lit(1.0)).alias("p"), exact.alias("exact"))

    def precise(batches):
        for batch in batches:
            names = ("exact", "u", "n0", "n1", "p")
            p = [exact_mann_whitney(u, n0, n1) if e else p for e, u, n0, n1, p in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()) if n == "p" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(precise, rows.schema)


def exact_mann_whitney(u: float, n0: int, n1: int) -> float:
    """Two-sided p of U for two samples without ties.

    The number of orders with each U is a Gaussian binomial coefficient's; its factors (1 - q^(n + i)) / (1 - q^i) are
    applied one after the other to the counts up to the smaller of both tails.
    """
    m, n = sorted((n0, n1))
    counts = np.zeros(int(min(u, n0 * n1 - u)) + 1)
    counts[0] = 1.0
    for i in range(1, m + 1):
        rows = -(-len(counts) // i)
        steps = np.zeros(rows * i)
        steps[: len(counts)] = counts
        counts = steps.reshape(rows, i).cumsum(0).ravel()[: len(counts)]
        if n + i < len(counts):
            counts[n + i :] -= counts[: -(n + i)].copy()
    return min(1.0, 2 * float(counts.sum()) / math.comb(n + m, m))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= -1 (relative error below 1.2e-7): a rational exponent, columns only."""
    a = F.abs(x)
    t = 1 / (1 + 0.5 * a)
    #: The coefficients of the approximation.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly: Column = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    y = t * F.exp(-a * a + poly)
    return F.when(x >= 0, y).otherwise(2 - y)


def logistic(df: DataFrame, metrics: list[str], label: str = "y", strata: dict[str, Column] | None = None) -> DataFrame:
    """(stratum, term, coefficient, error, p) of a logistic regression with intercept for each stratum; "all" if none is named.

    Runs jobs: a fit for each stratum. A metric that is constant in a stratum is left out there; a stratum without both
    labels, or without a metric left, has no rows in the result.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.withColumn(label, F.col(label).cast("double"))
    found = []
    for name, condition in (strata or {"all": F.lit(True)}).items():
        some = rows.filter(condition).na.drop(subset=[label, *metrics])
        varied = some.agg(*[(F.min(c) < F.max(c)).alias(c) for c in (label, *metrics)]).first()
        used = [m for m in metrics if varied[m]]
        if not varied[label] or not used:
            continue
        some = VectorAssembler(inputCols=used, outputCol="_features").transform(some)
        model = GeneralizedLinearRegression(family="binomial", featuresCol="_features", labelCol=label).fit(some)
        terms = zip([*used, "intercept"], [*model.coefficients.tolist(), model.intercept], model.summary.coefficientStandardErrors, model.summary.pValues, strict=True)
        found += [(name, n, float(c), float(s), float(p)) for n, c, s, p in terms]
    return df.sparkSession.createDataFrame(found, "stratum string, term string, coefficient double, error double, p double")


def histogram(df: DataFrame, metric: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins between the ends of the metric."""
    ends = df.agg(F.min(metric).alias("_lo"), F.max(metric).alias("_hi"))
    x = df.filter(F.col(metric).isNotNull()).crossJoin(F.broadcast(ends))
    place = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col(metric) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1))
    return x.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_numbers(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 interquartile ranges) of scaled metrics by y."""
    v = long_form(scale(df, metrics), metrics, ["y"]).filter("value is not null")
    q = quantiles(v, ["metric", "y"], [0.25, 0.5, 0.75])
    q = q.select("metric", "y", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.when(F.col("value") >= F.col("q1") - reach, F.col("value")), F.when(F.col("value") <= F.col("q3") + reach, F.col("value"))
    return v.join(F.broadcast(q), ["metric", "y"]).groupBy("metric", "y", "q1", "q2", "q3").agg(F.min(low).alias("low"), F.max(high).alias("high"))
