"""One query per inventory id over the test graph: aggregates, similarity, selection, rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import embeddings, vectors
from graphloom.operators import augment, datasets, features, hops, sample, select, stats, views
from graphloom.operators.order import each_entity
from graphloom.plans.catalog import ARC, C2, COMPOSED, COUNTS, HOP2, RANKS, _degrees, _ranks, query, r6
from graphloom.plans.catalog_records import long_rows, record_ctes
from graphloom.sources import io
from graphloom.testkg import DENY, num


def _facts(kg, deny=None):
    return views.fact_sentences(kg.triples, kg.relation_text, kg.entity_desc, deny)


def _typed(kg):
    return views.type_sentences(kg.train, kg.type_text)


@query("A1_degrees", "select entity, kg_degree, et_degree, kg_degree + et_degree as degree, round(et_degree / kg_degree::double, 6) as type_kg_ratio from deg")
def _(kg):
    return _degrees(kg).select("entity", "kg_degree", "et_degree", "degree", r6("type_kg_ratio"))


@query(
    "A2_text_length",
    "select entity, round(avg(n), 6) as avg_txt_length from (select entity, length(sentence) as n from fs union all select entity, length(sentence) from ts) where entity in (select entity from universe) group by entity",
)
def _(kg):
    return features.text_length(_facts(kg), _typed(kg)).select("entity", r6("avg_txt_length"))


def _measured(kg, coded):
    return each_entity(coded, lambda rows, dealt: features.measured(kg.vectors(rows), size=64), "measured")


#: All pairs, one by one.
PAIRS = """kpair as (select a.entity, avg(list_cosine_similarity(a.v, b.v)) as m from fv a join fv b on a.entity = b.entity and a.rid < b.rid group by 1),
tpair as (select a.entity, avg(list_cosine_similarity(a.v, b.v)) as m from tv a join tv b on a.entity = b.entity and a.rid < b.rid group by 1)"""


@query("A3_coherence", f"with {PAIRS} select u.entity, round(coalesce(kpair.m, 0.5), 6) as sim_mu from universe u left join kpair using (entity)")
def _(kg):
    return _measured(kg, kg.coded_facts()).select("entity", r6("sim_mu"))


@query("A4_neighbour_counts", "select entity, count(distinct other) filter (where direction = '-') + count(distinct other) filter (where direction = 'inv') as neighbours from ev group by entity")
def _(kg):
    return features.neighbour_counts(kg.triples)


def _described(name: str, source: str) -> str:
    return f"select '{name}' as name, count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, min(x)::double as min, quantile_cont(x, 0.25)::double as q1, quantile_cont(x, 0.5)::double as q2, quantile_cont(x, 0.75)::double as q3, max(x)::double as max from ({source})"


@query(
    "A5_neighbourhood_statistics",
    f"with {HOP2} "
    + " union all ".join(
        [
            _described("neighbours", "select count(distinct other) filter (where direction = '-') + count(distinct other) filter (where direction = 'inv') as x from ev group by entity"),
            _described("direct types", "select count(*) as x from train group by entity"),
            _described("two-hop neighbours", "select count(distinct other) as x from hop2 group by entity"),
            _described("neighbour types", "select count(distinct type) as x from triples join train on entity = tail group by head"),
        ]
    ),
)
def _(kg):
    return stats.neighbourhood_statistics(kg.triples, kg.train).select("name", "n", r6("mean"), r6("std"), "min", "q1", "q2", "q3", "max")


@query("A6_quantiles", "select q, case q when 0.1 then lk when 0.8 then hk else quantile_cont(kg_degree, 0.9) end::double as kg_degree, case q when 0.1 then le when 0.8 then he else quantile_cont(et_degree, 0.9) end::double as et_degree from deg, quant, (select unnest([0.1, 0.8, 0.9])::double as q) group by q, lk, le, hk, he")
def _(kg):
    points = [0.1, 0.8, 0.9]
    q = _degrees(kg).agg(*[F.percentile(c, F.array(*map(F.lit, points))).alias(c) for c in ("kg_degree", "et_degree")])
    both = F.arrays_zip(F.array(*map(F.lit, points)).alias("q"), "kg_degree", "et_degree")
    return q.select(F.inline(both))


@query(
    "A7_summary",
    "select 'entities' as metric, count(*) as value from universe union all select 'relations', count(distinct relation) from triples union all select 'triples', count(*) from triples union all select 'types', count(distinct type) from types union all select 'train types', count(*) from train union all select 'valid types', count(*) from valid union all select 'test types', count(*) from test",
)
def _(kg):
    return stats.summary(kg.triples, kg.train, kg.split("valid"), kg.split("test"))


@query("A8_type_weights", "select type, round(ln(1 + count(*)), 6) as weight from train group by type")
def _(kg):
    return sample.type_weights(kg.train).select("type", r6("weight"))


@query("A9_grouped", "select entity, string_agg(f, ';' order by f) as facts, n_types from (select head as entity, relation || ' ' || tail as f from triples where head <> tail union all select tail, 'inv-' || relation || ' ' || head from triples where head <> tail) left join (select entity, count(*) as n_types from train group by 1) using (entity) group by entity, n_types")
def _(kg):
    from graphloom.operators.records import grouped_facts, grouped_types

    facts = F.array_join(F.array_sort(F.transform("facts", lambda x: F.concat_ws(" ", x["relation"], x["other"]))), ";")
    out = grouped_facts(kg.triples).join(grouped_types(kg.train), "entity", "left")
    return out.select("entity", facts.alias("facts"), F.when(F.col("types").isNotNull(), F.size("types")).cast("long").alias("n_types"))


@query("A10_node_degrees", "select entity, count(*) as degree from (select head as entity from triples union all select tail from triples where head <> tail) group by entity")
def _(kg):
    return sample.node_degrees(kg.triples)


@query("A11_graph_size", "select (select count(*) from universe) as nodes, (select count(*) from (select distinct head, tail from triples)) as edges")
def _(kg):
    return sample.graph_size(kg.triples)


@query("A12_mean_rank", f"with {RANKS} select entity, round(avg(rank), 6) as rank_value from ranks group by entity")
def _(kg):
    return stats.mean_rank(_ranks(kg)).select("entity", r6("rank_value"))


@query(
    "A13_ranking_quality",
    f"with {RANKS} select round(avg(1.0 / rank), 6) as mrr, round(avg(rank), 6) as mr, round(avg((rank <= 1)::int), 6) as hit_1, round(avg((rank <= 3)::int), 6) as hit_3, round(avg((rank <= 10)::int), 6) as hit_10 from ranks",
)
def _(kg):
    from graphloom.operators.evaluate import quality

    out = quality(_ranks(kg))
    return out.select(*[r6(c) for c in out.columns])


@query("A14_rank_shares", f"with {RANKS} select t::int as threshold, round(avg((rank > t)::int), 6) as share from ranks, (select unnest([1, 3, 10, 100, 1000]) as t) group by t")
def _(kg):
    from graphloom.operators.evaluate import rank_shares

    return rank_shares(_ranks(kg)).select("threshold", r6("share"))


_LENGTHS = "len_ as (select entity, avg(n) as a from (select entity, length(sentence) as n from fs union all select entity, length(sentence) from ts) group by 1)"
_RANKED = f"{RANKS}, {_LENGTHS}, ranked as (select d.entity, kg_degree::double as kg_degree, et_degree::double as et_degree, a as avg_txt_length, r as rank_value from deg d join len_ using (entity) join (select entity, avg(rank) as r from ranks group by 1) using (entity))"


def _ranked(kg):
    rows = _degrees(kg).join(features.text_length(_facts(kg), _typed(kg)), "entity")
    return stats.with_rank(rows, _ranks(kg)).na.drop(subset=["rank_value"])


@query(
    "A15_rank_by_bin",
    f"with {_RANKED}, m as (select 'kg_degree' as metric, kg_degree as x, rank_value from ranked union all select 'et_degree', et_degree, rank_value from ranked union all select 'avg_txt_length', avg_txt_length, rank_value from ranked), e as (select metric, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from m group by 1) "
    "select metric, greatest(len(list_filter(e, lambda y: y < x)), 1)::int as bin, round(avg(rank_value), 6) as mean_rank, count(*) as n from m join e using (metric) group by 1, 2",
)
def _(kg):
    out = stats.rank_by_bin(_ranked(kg), ["kg_degree", "et_degree", "avg_txt_length"])
    return out.select("metric", "bin", r6("mean_rank"), "n")


_Y = f"ys as (select entity, kg_degree, et_degree, kg_degree + et_degree as degree, ({num('entity')} % 3 = 0)::int as y from deg)"


def _outcome(kg):
    return _degrees(kg).withColumn("y", (vectors.number(F.col("entity")) % 3 == 0).cast("int"))


_WHEN = {"all": "true", "low": "degree < 15", "high": "degree > 135"}


@query(
    "A16_class_summary",
    f"with {_Y}, l as (select 'kg_degree' as metric, kg_degree as v, degree, y from ys union all select 'et_degree', et_degree, degree, y from ys) select metric, "
    + ", ".join(f"round({a}, 6) as {n}_{y}" for n, c in _WHEN.items() for y in (0, 1) for a in [f"avg(case when {c} and y = {y} then v end)"])
    + ", 'mean' as of from l group by metric union all select metric, "
    + ", ".join(f"round(quantile_cont(case when {c} and y = {y} then v end, 0.5), 6)" for c in _WHEN.values() for y in (0, 1))
    + ", 'median' from l group by metric",
)
def _(kg):
    make = lambda median: stats.class_summary(_outcome(kg), ["kg_degree", "et_degree"], median).withColumn("of", F.lit("median" if median else "mean"))
    out = make(False).unionByName(make(True))
    return out.select("metric", "of", *[r6(c) for c in out.columns if c not in ("metric", "of")])


_MOMENTS = """m as (select metric, count(*)::double as n, avg(v) as mu from l group by metric),
c as (select metric, n, avg((v - mu) * (v - mu)) as m2, avg((v - mu) ** 3) as m3, avg((v - mu) ** 4) as m4 from l join m using (metric) group by metric, n),
s as (select metric, n, m3 / m2 ** 1.5 as skew, m4 / (m2 * m2) as b from c),
z as (select metric, n, skew, b, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y,
  3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as beta2,
  (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) as x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as g from s),
k as (select *, sqrt(2 * (beta2 - 1)) - 1 as w2, 6 + 8 / g * (2 / g + sqrt(1 + 4 / (g * g))) as a from z),
r as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1,
  ((1 - 2 / (9 * a)) - sign(1 + x * sqrt(2 / (a - 4))) * ((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4)))) ** (1.0 / 3)) / sqrt(2 / (9 * a)) as z2 from k)"""


@query(
    "A17_skewness",
    f"with {_Y}, l as (select 'kg_degree' as metric, kg_degree::double as v from ys union all select 'degree', degree::double from ys), {_MOMENTS} "
    "select metric, n::bigint as n, round(skew, 6) as skew, round(ln(1 + z1 * z1 + z2 * z2), 6) as log_k2, abs(skew) > 1 as skewed, exp(-(z1 * z1 + z2 * z2) / 2) < 0.05 as not_normal from r",
)
def _(kg):
    out = stats.skewness(_degrees(kg), ["kg_degree", "degree"])
    return out.select("metric", "n", r6("skew"), r6(F.log1p("k2"), "log_k2"), "skewed", "not_normal")


@query(
    "A18_mann_whitney",
    f"with {_Y}, l as (select 'kg_degree' as metric, kg_degree as v, y from ys union all select 'et_degree', et_degree, y from ys), "
    "g as (select metric, v, y, count(*) as n from l group by 1, 2, 3), "
    "u as (select a.metric, sum(a.n * b.n * case when a.v > b.v then 1.0 when a.v = b.v then 0.5 else 0 end)::double as u, (select count(*) from ys where y = 0) as n0, (select count(*) from ys where y = 1) as n1 from g a join g b on a.metric = b.metric and a.y = 1 and b.y = 0 group by a.metric), "
    "t as (select metric, sum(n ** 3 - n)::double as t from (select metric, v, sum(n)::double as n from g group by 1, 2) group by 1) "
    "select metric, u, n0, n1, round((abs(u - n0 * n1 / 2.0) - 0.5) / sqrt(n0 * n1 / 12.0 * (n0 + n1 + 1 - t / ((n0 + n1) * (n0 + n1 - 1.0)))), 6) as z from u join t using (metric)",
)
def _(kg):
    return stats.mann_whitney(_outcome(kg), ["kg_degree", "et_degree"]).select("metric", F.col("u").cast("double").alias("u"), "n0", "n1", r6("z"))


def _newton(steps: int = 25) -> str:
    """The regression of y on both degrees in each stratum by unrolled Newton steps, constant degrees left out; p by Simpson's rule."""
    ctes = [
        "r as (select 'all' as s, * from ys union all select 'low', * from ys where degree < 15 union all select 'high', * from ys where degree > 135), "
        "o as (select s, (min(kg_degree) < max(kg_degree))::int as va, (min(et_degree) < max(et_degree))::int as vb from r group by s having min(y) < max(y) and (va = 1 or vb = 1)), "
        "x as (select s, va, vb, kg_degree * va::double as a, et_degree * vb::double as b, y from r join o using (s)), w0 as (select s, 0.0::double as u, 0.0::double as v, 0.0::double as w from o)"
    ]
    for k in range(1, steps + 1):
        ctes.append(
            f"e{k} as (select x.*, 1 / (1 + exp(-(u + v * a + w * b))) as q from x join w{k - 1} using (s)), "
            f"h{k} as (select s, sum(q * (1 - q)) as m00, sum(q * (1 - q) * a) as m01, sum(q * (1 - q) * b) as m02, sum(q * (1 - q) * a * a) + 1 - max(va) as m11, sum(q * (1 - q) * a * b) as m12, "
            f"sum(q * (1 - q) * b * b) + 1 - max(vb) as m22, sum(y - q) as g0, sum((y - q) * a) as g1, sum((y - q) * b) as g2 from e{k} group by s), "
            f"c{k} as (select *, m11 * m22 - m12 * m12 as c00, m02 * m12 - m01 * m22 as c01, m01 * m12 - m02 * m11 as c02, m00 * m22 - m02 * m02 as c11, m01 * m02 - m00 * m12 as c12, m00 * m11 - m01 * m01 as c22 from h{k}), "
            f"i{k} as (select *, m00 * c00 + m01 * c01 + m02 * c02 as det from c{k}), "
            f"w{k} as (select s, u + (c00 * g0 + c01 * g1 + c02 * g2) / det as u, v + (c01 * g0 + c11 * g1 + c12 * g2) / det as v, w + (c02 * g0 + c12 * g1 + c22 * g2) / det as w, c00 / det as d0, c11 / det as d1, c22 / det as d2 from i{k} join w{k - 1} using (s))"
        )
    last = f"w{steps}"
    ctes.append(
        f"z as (select s, 'kg_degree' as term, v as coefficient, sqrt(d1) as error from {last} join o using (s) where va = 1 union all select s, 'et_degree', w, sqrt(d2) from {last} join o using (s) where vb = 1 union all select s, 'intercept', u, sqrt(d0) from {last})"
    )
    ctes.append(
        "n as (select *, abs(coefficient / error) as t from z), f as (select s, term, sum(case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end * exp(-0.5 * (k * t / 2000.0) ** 2)) * max(t) / 6000.0 as area "
        "from n, (select unnest(range(0, 2001)) as k) group by s, term)"
    )
    return f"with {_Y}, {', '.join(ctes)} select s as stratum, term, round(coefficient, 6) as coefficient, round(error, 6) as error, round(1 - sqrt(2 / pi()) * area, 6) as p from n join f using (s, term)"


@query("A19_logistic", _newton())
def _(kg):
    strata = {"all": F.lit(True), "low": F.col("degree") < 15, "high": F.col("degree") > 135}
    return stats.logistic(io.stored(_outcome(kg), "outcome"), ["kg_degree", "et_degree"], strata=strata).select("stratum", "term", *[r6(c) for c in ("coefficient", "error", "p")])


_EVIDENCE = f"ev3 as (select entity, type, (({num('''entity || '|' || type || '|' || k''')} % 2001) - 1000) / 500.0 as s from test, (select unnest(range(4)) as k))"


def _evidence(kg):
    k = kg.split("test").withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return k.select("entity", "type", ((vectors.number(F.concat_ws("|", "entity", "type", F.col("k").cast("string"))) % 2001 - 1000) / 500.0).alias("s"))


@query(
    "A20_pooled_scores",
    f"with {_EVIDENCE}, more as (select * from ev3 union all select entity, type, avg(s) from ev3 group by 1, 2), h as (select entity, type, t, avg(s) as m0, sum(s * exp(t * s)) / sum(exp(t * s)) as soft from more, (select unnest([2, 2.5, 3.5, 4.5])::double as t) group by 1, 2, 3), "
    "p as (select entity, type, sum(m0 + soft) as a, avg(m0) as m0 from h group by 1, 2), x as (select entity, type, max(s) as top from ev3 group by 1, 2) "
    "select entity, type, round(1 / (1 + exp(-(a + m0 + top) / 5)), 6) as pooled from p join x using (entity, type)",
)
def _(kg):
    from graphloom.operators.evaluate import pool_scores

    return pool_scores(_evidence(kg)).select("entity", "type", r6("pooled"))


_SCORES = f"kinds as (select distinct type from types), who as (select distinct entity from test), scores as (select entity, type, ({num('''entity || '|' || type''')} % 1000) / 1000.0::double as score from who, kinds), known as (select entity, type from train union select entity, type from valid union select entity, type from test)"


@query(
    "A21_losses",
    f"with {_SCORES}, c as (select score as s, (k.type is not null)::int as y, -((k.type is not null)::int * greatest(case when score <= 0 then -100 else ln(nullif(score, 0)) end, -100) + (k.type is null)::int * greatest(case when score >= 1 then -100 else ln(1 - score) end, -100)) as l from scores left join known k using (entity, type)) "
    "select round(avg(l), 6) as bce, round(avg(l * y), 6) as positive, round(avg(l * (1 - y) * (s - s * s)), 6) as fna_negative, round(avg(l * (1 - y) * case when s < 0.5 then 3 * s - 2 * s * s else s - 2 * s * s + 1 end), 6) as sfna_negative from c",
)
def _(kg):
    from graphloom.operators.evaluate import losses

    known = views.known_labels(kg.types.select("entity", "type")).withColumn("_k", F.lit(1))
    out = losses(kg.scores.join(known, ["entity", "type"], "left").withColumn("label", F.coalesce("_k", F.lit(0))))
    return out.select(*[r6(c) for c in out.columns])


@query(
    "W7_filtered_ranks",
    f"with {_SCORES}, adj as (select t.entity, t.type as t, s.type, case when k.type is not null and s.type <> t.type then s.score - 1 else s.score end as a from test t join scores s using (entity) left join known k on k.entity = s.entity and k.type = s.type), "
    "r as (select *, rank() over (partition by entity, t order by a desc) as rank from adj) select entity, t as type, rank from r where type = t",
)
def _(kg):
    from graphloom.operators.evaluate import filtered_ranks

    return filtered_ranks(kg.scores, kg.split("test"), views.known_labels(kg.types.select("entity", "type")))


_LEAST = """sims as (select a.entity, a.relation, a.other, a.direction, round(avg(list_cosine_similarity(a.v, b.v)), 9) as sim, count(*) as n from fv a join fv b on a.entity = b.entity group by a.rid, a.entity, a.relation, a.other, a.direction),
least_ as (select *, row_number() over (partition by entity order by sim, relation, other, direction) as rn from sims)"""


_LEASTT = """simst as (select a.entity, a.type, round(avg(list_cosine_similarity(a.v, b.v)), 9) as sim, count(*) as n from tv a join tv b on a.entity = b.entity group by a.rid, a.entity, a.type),
leastt_ as (select *, row_number() over (partition by entity order by sim, type) as rn from simst)"""


@query("A22_noise_frequency", f"with {_LEAST}, {_LEASTT} select 'relation' as kind, relation as name, count(*) as frequency from least_ where rn <= 5 and n > 1 group by relation union all select 'type', type, count(*) from leastt_ where rn <= 5 and n > 1 group by type")
def _(kg):
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col(kind).alias("name"), "frequency")
    noise = lambda coded, keys: features.total_frequency(
        each_entity(coded, lambda rows, dealt: features.noise_frequency(kg.vectors(rows), keys[0], keys, size=64), "noise"), keys[0]
    )
    relations = noise(kg.coded_facts("relation", "other", "direction"), ["relation", "other", "direction"])
    return named("relation", relations).unionByName(named("type", noise(kg.coded_types("type"), ["type"])))


@query(
    "A23_histogram",
    "with b as (select ln(1 + kg_degree) as x from deg), e as (select min(x) as lo, max(x) as hi from b) select least(20, floor((x - lo) / (hi - lo) * 20) + 1)::int as bin, count(*) as n from b, e group by 1",
)
def _(kg):
    return stats.histogram(_degrees(kg).select(F.log1p("kg_degree").alias("x")), "x")


@query(
    "A24_box_numbers",
    f"with {_Y}, e as (select min(kg_degree) as lo, max(kg_degree) as hi from ys), l as (select y, (kg_degree - lo) / (hi - lo)::double as v from ys, e), q as (select y, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3 from l group by y) "
    "select 'kg_degree' as metric, y, round(q1, 6) as q1, round(q2, 6) as q2, round(q3, 6) as q3, round(min(v) filter (where v >= q1 - 1.5 * (q3 - q1)), 6) as low, round(max(v) filter (where v <= q3 + 1.5 * (q3 - q1)), 6) as high from l join q using (y) group by y, q1, q2, q3",
)
def _(kg):
    out = stats.box_numbers(_outcome(kg).select("y", F.col("kg_degree").cast("double").alias("kg_degree")), ["kg_degree"])
    return out.select("metric", "y", *[r6(c) for c in ("q1", "q2", "q3", "low", "high")])


# --- similarity and selection --------------------------------------------------------------------------------------------
_NEAR = "near as (select entity, v from fv where relation not in (select relation from denied) union all select entity, v from tv)"
_FARV = f"""{HOP2}, farv as (
  select f.*, v from (select h.*, case h.direction when '-' then r.text || ' ' || d.text else d.text || ' ' || r.text end as sentence
    from far h join low using (entity) join rtxt r using (relation) join edesc d on d.entity = h.other) f
  join emb on vec_id = {num("sentence")} % (select n from cnt)),
simf as (select f.entity, f.relation, f.other, f.direction, round(avg(list_cosine_similarity(f.v, n.v)), 9) as sim from farv f join near n on n.entity = f.entity group by 1, 2, 3, 4),
kinds2 as (select distinct e.entity, t.type from low join ev e using (entity) join train t on t.entity = e.other),
kindv as (select k.entity, k.type, v from (select k.*, 'has type ' || replace(x.text, ' [SEP] ', ' ') as sentence from kinds2 k join ttxt x using (type)) k join emb on vec_id = {num("sentence")} % (select n from cnt)),
simt as (select k.entity, k.type, round(avg(list_cosine_similarity(k.v, n.v)), 9) as sim from kindv k join near n on n.entity = k.entity group by 1, 2)"""
_BUDGET = """kt as (select l.entity, coalesce(k, 0) as k, coalesce(t, 0) as t from low l
  left join (select entity, count(*) as k from ev where relation not in (select relation from denied) group by 1) using (entity)
  left join (select entity, count(*) as t from train group by 1) using (entity)),
budget as (select entity, k, t,
  (round_even(lk * (1 - case when lk = 0 then 1 else least(k, lk) / lk end), 0) + 2 + case when k > lk then 1 else 0 end)::bigint as n_rel,
  case when le = 0 then 2 else round_even(le * 2 * (1 - least(t, le) / le + 1), 0) + 2 end::bigint as n_type from kt, quant)"""
#: Best of each relation by the absence of a better one; all candidates where there are no more than the budget.
_CHOSEN = """sized as (select s.*, n_rel, count(*) over (partition by s.entity) as cands from simf s join budget using (entity)),
best as (select * from sized a where cands > n_rel and not exists (
  select 1 from sized b where b.entity = a.entity and b.relation = a.relation and (b.sim > a.sim or b.sim = a.sim and (b.other < a.other or b.other = a.other and b.direction < a.direction)))),
arcs as (select entity, relation, other, direction, sim from sized where cands <= n_rel union all
  select entity, relation, other, direction, sim from best qualify row_number() over (partition by entity order by sim desc, relation, other, direction) <= n_rel),
newtypes as (select s.entity, type, sim from simt s join budget using (entity) qualify row_number() over (partition by s.entity order by sim desc, type) <= n_type)"""


def _low(kg):
    return views.low_degree(_degrees(kg)).select("entity")


def _centre(kg):
    near = _facts(kg, DENY).select("entity", "sentence").unionByName(_typed(kg).select("entity", "sentence"))
    return features.centroid(kg.vectors(near.join(_low(kg), "entity", "left_semi")), size=64)


def _far(kg):
    return kg.vectors(views.describe(hops.two_hop_facts(kg.triples, DENY, _low(kg)), kg.relation_text, kg.entity_desc))


@query("W1_similarity", f"with {_NEAR}, {_FARV} select entity, relation, other, direction, round(sim, 6) as sim from simf")
def _(kg):
    return select.similarity(_far(kg), _centre(kg)).select(*ARC, r6("sim"))


def _augmented(kg, concat=False):
    return augment.augment(kg.graph, kg.train, kg.relation_text, kg.type_text, kg.entity_desc, kg.vectors, DENY, concat=concat, size=64)


@query("W2_top_facts", f"with {_NEAR}, {_FARV}, {_BUDGET}, {_CHOSEN} select entity, relation, other, direction, round(sim, 6) as sim from arcs")
def _(kg):
    return _augmented(kg)[0].select(*ARC, r6("sim"))


@query("W3_top_types", f"with {_NEAR}, {_FARV}, {_BUDGET}, {_CHOSEN} select entity, type, round(sim, 6) as sim from newtypes")
def _(kg):
    return _augmented(kg)[1].select("entity", "type", r6("sim"))


@query("W4_least_coherent", f"with {_LEAST} select entity, relation, other, direction, round(sim, 6) as sim from least_ where rn <= ceil(n * 0.05)")
def _(kg):
    least = lambda rows, dealt: features.least_coherent(kg.vectors(rows), ["relation", "other", "direction"], size=64, dealt=dealt)
    return each_entity(kg.coded_facts("relation", "other", "direction"), least, "least").select(*ARC, r6("sim"))


def _counts(kg):
    k = views.edge_view(kg.triples, DENY).groupBy("entity").agg(F.count(F.lit(1)).alias("k"))
    t = kg.train.groupBy("entity").agg(F.count(F.lit(1)).alias("t"))
    d = _degrees(kg)
    lows = d.agg(F.percentile("kg_degree", F.lit(0.1)).alias("low_kg"), F.percentile("et_degree", F.lit(0.1)).alias("low_et"))
    return _low(kg).join(k, "entity", "left").join(t, "entity", "left").fillna(0, ["k", "t"]).crossJoin(F.broadcast(lows))


@query("W5_budgets", f"with {_BUDGET} select * from budget")
def _(kg):
    return select.budgets(_counts(kg), F.col("low_kg"), F.col("low_et")).select("entity", "k", "t", "n_rel", "n_type")


@query(
    "W6_budgets_archive",
    f"with {_BUDGET} select entity, (round_even(lk * (1 - k / (lk + 1)), 0) + 2)::bigint as n_rel, (round_even(le * 2 * (1 - t / (le + 1)), 0) + 2)::bigint as n_type from kt, quant",
)
def _(kg):
    return select.budgets_archive(_counts(kg), F.col("low_kg"), F.col("low_et")).select("entity", "n_rel", "n_type")


@query(
    "W17_representative",
    f"with {COUNTS}, ok as (select entity, row_number() over (order by entity) as rn from counts where facts between 3 and 9 and train_types between 1 and 2 and test_types between 0 and 1) select entity from ok where rn = 2",
)
def _(kg):
    return stats.representative(stats.count_table(kg.triples, kg.train, kg.split("test")), {"facts": (3, 9), "train_types": (1, 2), "test_types": (0, 1)})


# --- rewriting ---------------------------------------------------------------------------------------------------------------
@query(
    "G1_augment",
    f"with {_NEAR}, {_FARV}, {_BUDGET}, {_CHOSEN} select 'fact' as kind, entity, relation || ' ' || other || ' ' || direction as what from arcs union all select 'type', entity, type from newtypes",
)
def _(kg):
    arcs, kinds = _augmented(kg)
    arcs = arcs.select(F.lit("fact").alias("kind"), "entity", F.concat_ws(" ", "relation", "other", "direction").alias("what"))
    return arcs.unionByName(kinds.select(F.lit("type").alias("kind"), "entity", F.col("type").alias("what")))


def _suppress_sql(fraction: float = 0.05) -> str:
    return f"""hf as (select fv.* from fv join high using (entity)), ht as (select tv.* from tv join high using (entity)),
sf as (select a.entity, a.relation, a.other, a.direction, round(avg(list_cosine_similarity(a.v, b.v)), 9) as sim, count(*) as n from hf a join hf b using (entity) group by a.rid, 1, 2, 3, 4),
st as (select a.entity, a.type, round(avg(list_cosine_similarity(a.v, b.v)), 9) as sim, count(*) as n from ht a join ht b using (entity) group by a.rid, 1, 2),
gonef as (select * from sf qualify row_number() over (partition by entity order by sim, relation, other, direction) <= ceil(n * {fraction})),
gonet as (select * from st qualify row_number() over (partition by entity order by sim, type) <= ceil(n * {fraction}))"""


def _suppressed(kg, **options):
    return augment.suppress(kg.graph, kg.train, kg.relation_text, kg.type_text, kg.entity_desc, kg.vectors, size=64, **options)


@query("G2_suppress", f"with {_suppress_sql()} select 'fact' as kind, entity, relation || ' ' || other || ' ' || direction as what from gonef union all select 'type', entity, type from gonet")
def _(kg):
    arcs, kinds = _suppressed(kg)
    arcs = arcs.select(F.lit("fact").alias("kind"), "entity", F.concat_ws(" ", "relation", "other", "direction").alias("what"))
    return arcs.unionByName(kinds.select(F.lit("type").alias("kind"), "entity", F.col("type").alias("what")))


_BACK = "select case direction when '-' then entity else other end as head, relation, case direction when '-' then other else entity end as tail from"


@query("G3_arcs_to_triples", f"{_BACK} ev")
def _(kg):
    return augment.arcs_to_triples(views.edge_view(kg.triples))


def _splits(kg):
    return kg.graph, kg.train, kg.split("valid"), kg.split("test")


_NEWTYPES = "g4t as (select a.* from (select * from train union all select entity, type from newtypes) a anti join gonet using (entity, type)), known2 as (select * from train union all select * from valid), g4k as (select * from g4t union all select * from valid)"
_TESTED = "select distinct entity from test"


def _rewritten_sql(facts: str | None = None) -> str:
    """CTEs of the rewritten graph, its types and both kinds of record lines; ``facts`` instead of the graph's own."""
    graph = "triples" if facts else "g4"
    more = {"facts": facts} if facts else {}
    return (
        f"{_suppress_sql()}, g4 as (select a.* from (select * from triples union all {_BACK} arcs) a anti join ({_BACK} gonef) g using (head, relation, tail)), {_NEWTYPES}, "
        f"{record_ctes(graph, 'g4k', **more, p='a')}, {record_ctes(graph, 'g4k', **more, who=_TESTED, p='b')}"
    )


_LINES = "select 'types' as part, entity as a, type as b, null as c from g4t union all select 'records', 'train', entity, line from alines union all select 'records', 'test', entity, line from blines"


@query("G4_full", f"with {_NEAR}, {_FARV}, {_BUDGET}, {_CHOSEN}, {_rewritten_sql()} {_LINES} union all select 'triples', head, relation, tail from g4")
def _(kg):
    return long_rows(datasets.full(*_splits(kg), _augmented(kg), _suppressed(kg)))


_MARKED = "select entity, case direction when 'inv' then 'inv-' || relation else relation end as name, other as tail from"


@query(
    "G5_selective",
    f"with {_NEAR}, {_FARV}, {_BUDGET}, {_CHOSEN}, {_rewritten_sql(f'{_MARKED} (select * from ev anti join gonef using (entity, relation, other, direction) where entity <> other) union all {_MARKED} arcs')} {_LINES} "
    "union all select 'edges', entity, relation || ' ' || direction, other from ev e anti join gonef g using (entity, relation, other, direction) union all select 'edges', entity, relation || ' ' || direction, other from arcs",
)
def _(kg):
    out = datasets.selective(*_splits(kg), _augmented(kg), _suppressed(kg))
    edges = out["edges"].select("entity", F.concat_ws(" ", "relation", "direction").alias("relation"), "other")
    return long_rows(out | {"edges": edges})


@query("W11_append_names", f"with {COMPOSED}, old as (select distinct relation as name from triples), new as (select distinct relation as name from composed join low using (entity)) select name, row_number() over (order by name) - 1 as id from old union all select name, (select count(*) from old) + row_number() over (order by name) - 1 from new")
def _(kg):
    old = sample.dense_ids(views.in_use(kg.graph, "relation"), "relation")
    return augment.composed_relations(old, hops.composed_names(kg.graph, DENY, views.low_degree(features.degrees(kg.graph, kg.train)).select("entity")))


_COMPOSEDV = f"""{COMPOSED}, cv as (select c.entity, c.relation, c.other, c.direction, v from (
  select c.*, case direction when '-' then a.text || ' ' || b.text || ' ' || d.text else d.text || ' ' || a.text || ' ' || b.text end as sentence
  from composed c join low using (entity) join rtxt a on a.relation = r1 join rtxt b on b.relation = r2 join edesc d on d.entity = c.other) c
  join emb on vec_id = {num("sentence")} % (select n from cnt)),
simf as (select f.entity, f.relation, f.other, f.direction, round(avg(list_cosine_similarity(f.v, n.v)), 9) as sim from cv f join near n on n.entity = f.entity group by 1, 2, 3, 4),
{_FARV[_FARV.index("kinds2 as"):]}"""


@query(
    "G6_concat",
    f"with {_NEAR}, {_COMPOSEDV}, {_BUDGET}, {_CHOSEN}, {_rewritten_sql()}, olds as (select relation, row_number() over (order by relation) - 1 as id from (select distinct relation from triples)), "
    "names as (select * from olds union all select relation, (select count(*) from olds) + row_number() over (order by relation) - 1 from (select distinct relation from arcs where relation not in (select relation from olds))) "
    f"{_LINES} union all select 'triples', head, relation, tail from g4 union all select 'relations', relation, id::varchar, null from names union all select 'relation_text', relation, trim(replace(relation, '/', ' ')), null from names",
)
def _(kg):
    old = sample.dense_ids(views.in_use(kg.triples, "relation"), "relation")
    return long_rows(datasets.concat(*_splits(kg), _augmented(kg, concat=True), _suppressed(kg), old))


_ARCHIVE = """budget as (select entity, k, t, (round_even(lk * (1 - k / (lk + 1)), 0) + 2)::bigint as n_rel, (round_even(le * 2 * (1 - t / (le + 1)), 0) + 2)::bigint as n_type from kt, quant)"""


@query(
    "G12_direct",
    f"with {_NEAR}, {_FARV}, {_BUDGET[: _BUDGET.index('budget as')]}{_ARCHIVE}, {_CHOSEN}, high2 as (select entity from deg where kg_degree > (select quantile_cont(kg_degree, 0.9) from deg) and et_degree > (select quantile_cont(et_degree, 0.9) from deg)), {_suppress_sql(0.1).replace('join high using', 'join high2 using')} "
    f"select 'triples' as part, t.head as a, t.relation as b, t.tail as c from triples t anti join ({_BACK} gonef) g using (head, relation, tail) union all select 'types', t.entity, t.type, null from train t anti join gonet using (entity, type) "
    f"union all select 'added_triples', * from ({_BACK} arcs) union all select 'added_types', entity, type, null from newtypes",
)
def _(kg):
    added = augment.augment(kg.graph, kg.train, kg.relation_text, kg.type_text, kg.entity_desc, kg.vectors, DENY, budgets=select.budgets_archive, size=64)
    return long_rows(datasets.direct(kg.graph, kg.train, added, _suppressed(kg, q=0.9, fraction=0.1)))


@query(
    "G13_feature_table",
    f"with {PAIRS}, {_LENGTHS} "
    "select d.entity, round(coalesce(kpair.m, 0.5), 6) as kg_sim_mu, round(coalesce(tpair.m, 0.5), 6) as et_sim_mu, kg_degree + et_degree as degree, round(a, 6) as avg_txt_length, kg_degree, et_degree, round(et_degree / kg_degree::double, 6) as type_kg_ratio from deg d left join kpair using (entity) left join tpair using (entity) join len_ using (entity)",
)
def _(kg):
    out = features.features_of(features.degrees(kg.graph, kg.train), _measured(kg, kg.coded_facts()), _measured(kg, kg.coded_types()))
    return out.select("entity", r6("kg_sim_mu"), r6("et_sim_mu"), "degree", r6("avg_txt_length"), "kg_degree", "et_degree", r6("type_kg_ratio"))


@query("G14_encode", None)
def _(kg):
    return vectors.encode(_facts(kg)).select("sentence", F.size("vector").alias("size"), r6(vectors.norm(F.col("vector")), "norm"))


@query("G14_learnt_encoder", None)
def _(kg):
    near = io.stored(_facts(kg).select("sentence").unionByName(_typed(kg).select("sentence")), "sentences")
    out = embeddings.encode(near, embeddings.train(near))
    return out.select("sentence", F.size("vector").alias("size"), r6(vectors.norm(F.col("vector")), "norm"))


@query(
    "G15_ego_network",
    "with c as (select distinct entity as centre from test), e as (select head as centre, relation, tail as node, 1 as r from triples join c on c.centre = head union all select entity, 'has_type', type, 2 from train join c on c.centre = entity union all select entity, 'has_type', type, 3 from test), "
    "n as (select centre, node, r from e union all select centre, centre, 0 from c) select 'node' as part, centre, node, ['centre', 'neighbour', 'known type', 'missing type'][min(r) + 1] as role from n group by 2, 3 union all select 'edge', centre, node, relation from e",
)
def _(kg):
    edges, nodes = hops.ego_network(kg.triples, kg.train, kg.split("test"), kg.split("test"))
    edges = edges.select(F.lit("edge").alias("part"), "centre", "node", F.col("relation").alias("role"))
    return nodes.select(F.lit("node").alias("part"), "centre", "node", "role").unionByName(edges)
