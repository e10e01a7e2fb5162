"""One query per inventory id over the test graph, with the same result in SQL: sources, filters, joins, sets, strings, math."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text, vectors
from graphloom.operators import datasets, hops, records, sample, stats, views
from graphloom.sources import io
from graphloom.testkg import DENY, KG, num, sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None):
    """Register a function of the graph under ``name`` with its SQL (None: it has none)."""

    def add(f: Callable[[KG], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(KG(spark, sf_dir))
        if body is not None:
            ORACLES[name] = sql(body)
        return f

    return add


def r6(x, name: str | None = None):
    """Rounded to six places, so that the order of summation does not show."""
    c = F.round(F.col(x) if isinstance(x, str) else x, 6)
    return c.alias(name or x)


TRIPLE, ARC = ["head", "relation", "tail"], ["entity", "relation", "other", "direction"]


# --- sources and sinks: written to the shared folder and read back -------------------------------------------------
def _again(kg: KG, name: str, df: DataFrame, write, read) -> DataFrame:
    path = io.scratch(kg.spark, name)
    write(df, path)
    return read(kg.spark, path)


@query("S1_read_triples", "select * from triples")
def _(kg):
    bad = kg.triples.limit(0).unionByName(kg.spark.range(1).select(F.lit("a").alias("head"), F.lit("b\tc").alias("relation"), F.lit("d").alias("tail")))
    lines = kg.triples.unionByName(bad).select(F.concat(F.lit(" "), F.concat_ws("\t", *TRIPLE), F.lit(" ")).alias("value"))
    return _again(kg, "s1", lines, io.write_lines, io.read_triples)


@query("S2_read_types", "select entity, type from types")
def _(kg):
    return _again(kg, "s2", kg.types.select(F.concat_ws("\t", "entity", "type").alias("value")), io.write_lines, io.read_types)


@query("S3_read_table", "select * from triples")
def _(kg):
    return _again(kg, "s3", kg.triples.select(*TRIPLE), io.write_table, lambda s, p: io.read_table(s, p, "head string, relation string, tail string"))


@query("S4_dictionary", "select entity as name, row_number() over (order by entity) - 1 as id from universe")
def _(kg):
    return _again(kg, "s4", sample.dense_ids(views.universe(kg.triples), "entity"), io.write_table, io.read_dictionary)


@query("S5_entity_json", "select * from etxt")
def _(kg):
    obj = F.map_from_arrays(F.array("entity"), F.array(F.struct("label", "description")))
    return _again(kg, "s5", kg.entity_text.select(F.to_json(obj, {"ignoreNullFields": "false", "pretty": "true"}).alias("value")), io.write_lines, io.read_entity_json)


@query("S6_relation_text", "select relation as name, text from rtxt union all select type, text from ttxt")
def _(kg):
    both = kg.relation_text.select(F.col("relation").alias("name"), "text").unionByName(kg.type_text.select(F.col("type").alias("name"), "text"))
    return _again(kg, "s6", both, io.write_table, io.read_texts)


@query("S7_write_triples", "select * from triples where head <> tail")
def _(kg):
    return _again(kg, "s7", views.drop_self_loops(kg.triples).select(*TRIPLE), io.write_table, lambda s, p: io.read_table(s, p, "head string, relation string, tail string"))


@query("S8_features_once", "select entity, kg_degree, et_degree from deg")
def _(kg):
    from graphloom.operators.features import degrees

    path = io.scratch(kg.spark, "s8")
    once = lambda: degrees(kg.triples, kg.train).select("entity", "kg_degree", "et_degree")
    io.features_once(kg.spark, path, "entity string, kg_degree bigint, et_degree bigint", once)
    return io.features_once(kg.spark, path, "entity string, kg_degree bigint, et_degree bigint", lambda: 1 / 0)


@query("S9_arcs_json", "select * from ev")
def _(kg):
    return _again(kg, "s9", views.edge_view(kg.triples), io.write_arcs_json, io.read_arcs_json)


@query(
    "S10_arc_lines",
    "select entity || chr(9) || string_agg(relation || ',' || other || ',' || direction, chr(9) order by relation || ',' || other || ',' || direction) as value from ev where entity <> other group by entity",
)
def _(kg):
    return io.arc_lines(views.edge_view(kg.triples))


@query("S11_read_arc_lines", "select entity, relation, other || ',' || direction as rest from ev where entity <> other")
def _(kg):
    return _again(kg, "s11", io.arc_lines(views.edge_view(kg.triples)), io.write_lines, io.read_arc_lines)


# --- filters and views ----------------------------------------------------------------------------------------------
@query("P1_drop_self_loops", "select * from triples where head <> tail")
def _(kg):
    return views.drop_self_loops(kg.triples)


@query("P2_deny_relations", "select * from triples where relation not in (select relation from denied)")
def _(kg):
    return views.drop_relations(kg.triples, DENY)


@query(
    "P3_with_inverse",
    "select head as entity, relation, tail as other from triples where head <> tail union all select tail, 'inv-' || relation, head from triples where head <> tail",
)
def _(kg):
    return views.with_inverse(kg.triples)


@query("P4_facts_of", "select * from triples where head = 'c7'")
def _(kg):
    return views.facts_of(kg.triples, "c7")


@query("P5_typed_in_graph", "select entity, type from test where entity in (select entity from universe)")
def _(kg):
    return views.typed_in_graph(kg.split("test"), kg.triples)


def _degrees(kg):
    from graphloom.operators.features import degrees

    return degrees(kg.triples, kg.train)


@query("P6_low_degree", "select entity from low")
def _(kg):
    return views.low_degree(_degrees(kg)).select("entity")


@query("P7_high_degree", "select entity from high")
def _(kg):
    return views.high_degree(_degrees(kg)).select("entity")


COUNTS = """counts as (
  select entity, coalesce(f, 0) as facts, coalesce(a, 0) as train_types, coalesce(b, 0) as test_types
  from (select head as entity, count(*) as f from triples group by 1)
  full join (select entity, count(*) as a from train group by 1) using (entity)
  full join (select entity, count(*) as b from test group by 1) using (entity))"""


@query("P8_in_ranges", f"with {COUNTS} select * from counts where facts between 3 and 9 and train_types between 1 and 2 and test_types between 0 and 1")
def _(kg):
    return views.in_ranges(stats.count_table(kg.triples, kg.train, kg.split("test")), {"facts": (3, 9), "train_types": (1, 2), "test_types": (0, 1)})


@query("P9_strata", "select entity, kg_degree + et_degree as degree, case when kg_degree + et_degree < 15 then 'low' else 'high' end as stratum from deg where kg_degree + et_degree < 15 or kg_degree + et_degree > 135")
def _(kg):
    return views.stratum(_degrees(kg)).select("entity", "degree", "stratum")


@query("P10_drop_nulls", "select * from etxt where description is not null and label is not null")
def _(kg):
    return kg.entity_text.na.drop()


@query("P11_outcome", f"select entity, type, case when 1 + {num('entity || type')} % 5 = 1 then 1 else 0 end as y from test")
def _(kg):
    rank = 1 + vectors.number(F.concat("entity", "type")) % 5
    return kg.split("test").select("entity", "type", (rank == 1).cast("int").alias("y"))


# --- joins ----------------------------------------------------------------------------------------------------------
@query("J1_fact_sentences", "select * from fs where relation not in (select relation from denied)")
def _(kg):
    return views.fact_sentences(kg.triples, kg.relation_text, kg.entity_desc, DENY)


@query("J2_type_sentences", "select * from ts")
def _(kg):
    return views.type_sentences(kg.train, kg.type_text)


#: The four direction cases one by one.
HOP2 = """hop2 as (
  select a.head as entity, b.relation, b.tail as other, '-' as direction from triples a join triples b on b.head = a.tail
  union select a.head, b.relation, b.head, 'inv' from triples a join triples b on b.tail = a.tail
  union select a.tail, b.relation, b.tail, '-' from triples a join triples b on b.head = a.head
  union select a.tail, b.relation, b.head, 'inv' from triples a join triples b on b.tail = a.head),
far as (select * from hop2 where relation not in (select relation from denied))"""


@query("J3_two_hop_facts", f"with {HOP2} select far.* from far join low using (entity)")
def _(kg):
    return hops.two_hop_facts(kg.triples, DENY, views.low_degree(_degrees(kg)))


COMPOSED = """ok as (select * from triples where relation not in (select relation from denied)),
composed as (
  select a.head as entity, a.relation || '.' || b.relation as relation, b.tail as other, '-' as direction, a.relation as r1, b.relation as r2 from ok a join ok b on b.head = a.tail
  union select a.head, a.relation || '.' || b.relation, b.head, 'inv', a.relation, b.relation from ok a join ok b on b.tail = a.tail
  union select a.tail, a.relation || '.' || b.relation, b.tail, '-', a.relation, b.relation from ok a join ok b on b.head = a.head
  union select a.tail, a.relation || '.' || b.relation, b.head, 'inv', a.relation, b.relation from ok a join ok b on b.tail = a.head)"""


@query("J4_two_hop_composed", f"with {COMPOSED} select entity, relation, other, direction from composed join low using (entity)")
def _(kg):
    return hops.two_hop_composed(kg.triples, DENY, views.low_degree(_degrees(kg))).select(*ARC)


@query("J5_two_hop_types", "select distinct e.entity, t.type from ev e join train t on t.entity = e.other")
def _(kg):
    return hops.two_hop_types(kg.triples, kg.train)


@query("J6_two_hop_entities", f"with {HOP2} select entity, count(distinct other) as n from hop2 group by entity")
def _(kg):
    return hops.two_hop_entities(kg.triples).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("J7_out_neighbour_types", "select head as entity, tail, type from triples join train on train.entity = tail")
def _(kg):
    return hops.out_neighbour_types(kg.triples, kg.train)


@query("J8_without_triples", "select * from triples where relation <> '/people/customer/order' or tail not in (select entity from test)")
def _(kg):
    removed = kg.triples.filter("relation = '/people/customer/order'").join(kg.split("test").select(F.col("entity").alias("tail")).distinct(), "tail", "left_semi")
    return views.without_triples(kg.triples, removed.select(*TRIPLE))


@query("J9_without_types", "select * from train where type not like '/base/%'")
def _(kg):
    return views.without_types(kg.train, kg.train.filter("type like '/base/%'"))


def key(seed: int, *columns: str) -> str:
    """The hash that orders samples."""
    return num(" || ':' || ".join([f"'{seed}'", *columns]))


HUBS, RANDOM = 400, 800
SEEDS = f"""hubs as (select head as entity, count(distinct tail) as out_degree from triples group by 1 order by 2 desc, 1 limit {HUBS}),
others as (select entity from (select distinct head as entity from triples) order by {key(1, "entity")}, entity limit {RANDOM}),
seeds as (select entity, row_number() over (order by entity) - 1 as no from (select entity from hubs union select entity from others))"""


def walk(length: int = 7, restart: float = 0.7, seed: int = 1) -> str:
    """Unrolled steps with the same hashes."""
    u = lambda step, what: f"(({key(seed, 'walker', chr(39) + str(step) + chr(39), chr(39) + what + chr(39))} + 0.5) / 4294967296.0)"
    steps = ["step0 as (select entity as walker, entity as pos from seeds)"]
    for i in range(1, length + 1):
        steps.append(f"""step{i} as (
  select walker, e.tail as pos from step{i - 1} s join adj e on e.head = s.pos and e.i = floor({u(i, "edge")} * e.deg) where {u(i, "restart")} >= {restart}
  union all select walker, d.entity from step{i - 1} s join seeds d on d.no = floor({u(i, "seed")} * (select count(*) from seeds)) where {u(i, "restart")} < {restart})""")
    every = " union ".join(f"select pos as entity from step{i}" for i in range(length + 1))
    adj = "adj as (select head, tail, row_number() over (partition by head order by tail) - 1 as i, count(*) over (partition by head) as deg from (select distinct head, tail from triples))"
    return f"{SEEDS}, {adj}, {', '.join(steps)}, walked as ({every})"


#: The sampled graph, its nodes and their types.
SAMPLED = f"""{walk()}, smp as (select head, max(relation) as relation, tail from triples where head in (select entity from walked) and tail in (select entity from walked) group by head, tail),
sun as (select head as entity from smp union select tail from smp), strain as (select t.* from train t where entity in (select entity from sun))"""


def _sampled(kg):
    return io.stored(datasets.sampled_graph(kg.triples, HUBS, RANDOM), "sampled")


@query("J10_held_out_types", f"with {SAMPLED} select v.* from valid v where entity in (select entity from sun) and type in (select type from strain)")
def _(kg):
    u = io.stored(views.universe(_sampled(kg)), "sampled-nodes")
    return views.held_out_types(kg.split("valid"), kg.train.join(u, "entity", "left_semi"), u)


@query("J11_used_text", f"with {SAMPLED} select 'relation' as kind, r.relation as name, text from rtxt r where relation in (select relation from smp) union all select 'type', type, text from ttxt where type in (select type from strain)")
def _(kg):
    graph = _sampled(kg)
    kinds = kg.train.join(views.universe(graph), "entity", "left_semi")
    relations = views.used_text(kg.relation_text, graph, "relation").select(F.lit("relation").alias("kind"), F.col("relation").alias("name"), "text")
    return relations.unionByName(views.used_text(kg.type_text, kinds, "type").select(F.lit("type").alias("kind"), F.col("type").alias("name"), "text"))


@query("J12_induced", f"with {SAMPLED} select * from triples where head in (select entity from sun) and tail in (select entity from sun)")
def _(kg):
    return views.induced(kg.triples, io.stored(views.universe(_sampled(kg)), "sampled-nodes"))


@query("J13_collapse", "select head, max(relation) as relation, tail from triples group by head, tail")
def _(kg):
    return views.collapse(kg.triples)


RANKS = f"ranks as (select entity, type, 1 + {num('entity || type')} % 50 as rank from test)"


def _ranks(kg):
    return kg.split("test").withColumn("rank", 1 + vectors.number(F.concat("entity", "type")) % 50)


@query("J14_with_rank", f"with {RANKS} select d.entity, kg_degree, round(r, 6) as rank_value from deg d left join (select entity, avg(rank) as r from ranks group by 1) using (entity)")
def _(kg):
    return stats.with_rank(_degrees(kg), _ranks(kg)).select("entity", "kg_degree", r6("rank_value"))


@query("J15_count_table", f"with {COUNTS} select * from counts")
def _(kg):
    return stats.count_table(kg.triples, kg.train, kg.split("test"))


@query(
    "J17_text_to_entity",
    "select coalesce(t.entity, d.text) as entity, m as kg_sim_mu, m + 1 as kg_sim_sig, m + 2 as et_sim_mu, m + 3 as et_sim_sigma from (select text, length(text)::double as m from (select distinct label || ' ' || coalesce(description, '') as text from etxt union select 'no such text')) d left join (select label || ' ' || coalesce(description, '') as text, max(entity) as entity from etxt group by 1) t using (text)",
)
def _(kg):
    texts = kg.entity_text.select(stats.entity_key().alias("entity")).distinct().unionByName(kg.spark.range(1).select(F.lit("no such text").alias("entity")))
    measured = texts.select("entity", *[(F.length("entity") + float(i)).alias(n) for i, n in enumerate(stats.COHERENCE)], F.lit(0).alias("unused"))
    return stats.clean_coherence(measured, kg.entity_text)


@query("J19_label_or_id", "select coalesce(a.label, head) as head, relation, coalesce(b.label, tail) as tail from triples left join etxt a on a.entity = head left join etxt b on b.entity = tail")
def _(kg):
    return views.label_or_id(views.label_or_id(kg.triples, "head", kg.entity_text), "tail", kg.entity_text)


# --- set operations ---------------------------------------------------------------------------------------------------
@query("U1_universe", "select * from universe")
def _(kg):
    return views.universe(kg.triples)


@query("U2_record_universe", "select 'train' as mode, entity from (select head as entity from triples where head <> tail union select tail from triples where head <> tail union select entity from train union select entity from valid) union all select 'test', entity from (select distinct entity from test)")
def _(kg):
    make = lambda m: views.record_universe(kg.triples, kg.train, kg.split("valid"), kg.split("test"), m).select(F.lit(m).alias("mode"), "entity")
    return make("train").unionByName(make("test"))


@query("U3_add_triples", "select * from triples union all select * from triples where relation = '/commerce/order/part'")
def _(kg):
    return kg.triples.unionByName(kg.triples.filter("relation = '/commerce/order/part'"))


@query("U4_in_use", "select 'relation' as kind, relation as name from triples union select 'type', type from train")
def _(kg):
    r, t = views.in_use(kg.triples, "relation"), views.in_use(kg.train, "type")
    return r.select(F.lit("relation").alias("kind"), F.col("relation").alias("name")).unionByName(t.select(F.lit("type").alias("kind"), F.col("type").alias("name")))


@query("U5_known_labels", "select entity, type from train union select entity, type from valid")
def _(kg):
    return views.known_labels(kg.train, kg.split("valid"))


# --- strings and math -------------------------------------------------------------------------------------------------
C1 = "case when starts_with(type, '/base/') then '/base/' || string_split(type, '/')[3] when len(string_split(type, '/')) > 1 then string_split(type, '/')[2] else 'unknown' end"
C2 = "case when len(string_split(type, '/')) < 2 then type when string_split(type, '/')[2] = 'base' then '/base/' || string_split(type, '/')[3] else string_split(type, '/')[2] end"


@query("C1_cluster_of_record", f"select entity, type, {C1} as cluster from types")
def _(kg):
    return kg.types.select("entity", "type", text.cluster_or_unknown(F.col("type")).alias("cluster"))


@query("C2_cluster_of_dictionary", f"select distinct {C2} as cluster from types")
def _(kg):
    return kg.types.select(text.cluster(F.col("type")).alias("cluster")).distinct()


@query(
    "C3_descriptions",
    "select entity, text as hybrid, case when coalesce(description, '') <> '' then description else label end as about, label from edesc join etxt using (entity)",
)
def _(kg):
    d = lambda m: text.description(F.col("label"), F.col("description"), m)
    return kg.entity_text.select("entity", d("hybrid").alias("hybrid"), d("desc").alias("about"), d("label").alias("label"))


@query("C4_texts_by_id", "select row_number() over (order by u.entity) - 1 as id, d.text from universe u join edesc d using (entity)")
def _(kg):
    return records.texts_by_id(sample.dense_ids(views.universe(kg.triples), "entity"), kg.entity_desc)


@query("C5_relation_text", "select * from rtxt")
def _(kg):
    return kg.relation_text


@query("C6_related_text", "select relation, replace(text, '.', ' is related to ') as text from rtxt")
def _(kg):
    return kg.relation_text.select("relation", text.related_text(F.col("text")).alias("text"))


@query("C7_inverse_mark", "select 'inv-' || relation as marked, false as plain_is, true as marked_is, relation as stripped from triples")
def _(kg):
    m = text.inverse(F.col("relation"))
    return kg.triples.select(m.alias("marked"), text.is_inverse(F.col("relation")).alias("plain_is"), text.is_inverse(m).alias("marked_is"), text.strip_inverse(m).alias("stripped"))


@query(
    "C8_masked_fact",
    "select ev.entity, case direction when '-' then '[CLS] [MASK] [SEP] ' || r.text || ' [SEP] ' || d.text || ' [SEP]' else '[CLS] ' || d.text || ' [SEP] ' || r.text || ' [SEP] [MASK] [SEP]' end as text from ev join rtxt r using (relation) join edesc d on d.entity = ev.other",
)
def _(kg):
    e = views.edge_view(kg.triples).join(kg.relation_text.withColumnRenamed("text", "r"), "relation").join(kg.entity_desc.select(F.col("entity").alias("other"), F.col("text").alias("d")), "other")
    return e.select("entity", text.masked_fact(F.col("r"), F.col("d"), F.col("direction")).alias("text"))


@query("C9_masked_type", "select entity, '[CLS] [MASK] has type [SEP] ' || text || ' [SEP]' as text from train join ttxt using (type)")
def _(kg):
    return kg.train.join(kg.type_text, "type").select("entity", text.masked_type(F.col("text")).alias("text"))


@query("C10_parse_rank", f"with {RANKS} select * from ranks")
def _(kg):
    parts = F.split(F.concat_ws(" ", "type", F.col("rank").cast("string")), " ")
    return _ranks(kg).select("entity", parts[0].alias("type"), parts[1].cast("bigint").alias("rank"))


@query("S13_rank_log", f"with {RANKS} select entity, type, rank::double as rank from ranks")
def _(kg):
    return _again(kg, "s13", io.rank_lines(_ranks(kg)), io.write_lines, io.read_ranks)


@query("M1_cosine", "select a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as cosine from emb a join emb b on b.vec_id = a.vec_id + 1")
def _(kg):
    e = kg.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", r6(vectors.cosine(F.col("v"), F.col("w")), "cosine"))


@query(
    "M2_unit_mean",
    "with u as (select label, vec_id, unnest(v) / sqrt(list_inner_product(v, v)) as x, unnest(range(64)) as i from emb join (select vec_id, label from embeddings) using (vec_id)) select label, i::int as i, round(avg(x), 6) as x from u group by label, i",
)
def _(kg):
    e = kg.table("embeddings").select("label", vectors.unit(F.col("embedding").cast("array<double>")).alias("u"))
    g = e.groupBy("label").agg(vectors.vector_sum(F.col("u")).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("label", "n", F.posexplode("s").alias("i", "x")).select("label", "i", r6(F.col("x") / F.col("n"), "x"))


@query("M3_log1p", "select entity, round(ln(1 + kg_degree), 6) as kg_degree, round(ln(1 + et_degree), 6) as et_degree from deg")
def _(kg):
    return _degrees(kg).select("entity", r6(F.log1p("kg_degree"), "kg_degree"), r6(F.log1p("et_degree"), "et_degree"))


@query("M4_sigmoid_softmax", "select entity, round(1 / (1 + exp(-kg_degree / 100.0)), 6) as sigmoid, round(exp(kg_degree / 1000.0) / sum(exp(kg_degree / 1000.0)) over (), 9) as softmax from deg")
def _(kg):
    d = _degrees(kg).select("entity", "kg_degree", F.exp(F.col("kg_degree") / 1000.0).alias("e"))
    total = d.agg(F.sum("e").alias("t"))
    return d.crossJoin(F.broadcast(total)).select("entity", r6(1 / (1 + F.exp(-F.col("kg_degree") / 100.0)), "sigmoid"), F.round(F.col("e") / F.col("t"), 9).alias("softmax"))


@query("M5_min_max", "select entity, round((kg_degree - min(kg_degree) over ()) / (max(kg_degree) over () - min(kg_degree) over ())::double, 6) as kg_degree from deg")
def _(kg):
    return stats.scale(_degrees(kg).select("entity", F.col("kg_degree").cast("double").alias("kg_degree")), ["kg_degree"]).select("entity", r6("kg_degree"))


@query("M6_long_form", "select entity, 'kg_degree' as metric, kg_degree::double as value from deg union all select entity, 'et_degree', et_degree::double from deg")
def _(kg):
    return stats.long_form(_degrees(kg), ["kg_degree", "et_degree"], ["entity"])


@query("M7_rounding", "select entity, ceil(kg_degree * 0.05)::bigint as up, round_even(kg_degree / 2.0, 0)::bigint as even from deg")
def _(kg):
    return _degrees(kg).select("entity", F.ceil(F.col("kg_degree") * 0.05).cast("bigint").alias("up"), F.bround(F.col("kg_degree") / 2).cast("bigint").alias("even"))
