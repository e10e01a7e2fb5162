"""One query per inventory id over the test graph: sampling, dictionaries, walks, context records."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import datasets, records, sample, views
from graphloom.plans.catalog import C1, C2, HUBS, RANDOM, SAMPLED, SEEDS, _again, _degrees, _sampled, key, query, walk
from graphloom.sources import io


@query("W8_hub_seeds", f"with {SEEDS} select * from hubs")
def _(kg):
    return sample.hub_seeds(kg.triples, HUBS)


@query("W9_random_seeds", f"with {SEEDS} select * from others")
def _(kg):
    return sample.random_seeds(kg.triples, RANDOM)


@query(
    "W10_dense_ids",
    " union all ".join(
        f"select '{kind}' as kind, name, row_number() over (order by name) - 1 as id from ({source})"
        for kind, source in [
            ("entity", "select entity as name from universe"),
            ("relation", "select distinct relation as name from triples"),
            ("type", "select distinct type as name from train"),
            ("cluster", f"select distinct {C2} as name from train"),
        ]
    ),
)
def _(kg):
    make = lambda kind, df, column: sample.dense_ids(df, column).select(F.lit(kind).alias("kind"), "name", "id")
    out = make("entity", views.universe(kg.triples), "entity").unionByName(make("relation", kg.triples, "relation")).unionByName(make("type", kg.train, "type"))
    return out.unionByName(make("cluster", kg.train.select(text.cluster(F.col("type")).alias("c")), "c"))


_PICKED = f"""sdeg as (select entity, count(*) as d from (select head as entity from smp union all select tail from smp where head <> tail) group by 1),
wts as (select type, ln(1 + count(*)) as w from strain group by 1),
ksz as (select s.entity, floor((et_degree / kg_degree::double + 0.1) * d) as k from sdeg s join deg using (entity)),
keyed as (select entity, type, row_number() over (partition by entity order by round(-ln(({key(1, "entity", "type")} + 0.5) / 4294967296.0) / w, 9), type) as rn from (select distinct * from strain) join wts using (type))"""


_W12 = f"{SAMPLED}, {_PICKED}"


@query("W12_sample_types", f"with {_W12} select entity, type from keyed join ksz using (entity) where rn <= k")
def _(kg):
    return sample.sample_types(kg.train, _sampled(kg), _degrees(kg))


def _fixed(rows: str, keys: list[str], k: int, seed: int) -> str:
    """CTEs of a fixed-size sample of ``rows``, with replacement where there are too few."""
    names = ", ".join(keys)
    return f"""rk as (select *, row_number() over (partition by entity order by {key(seed, "entity", *(f"{x}::varchar" for x in keys))}, {names}) as rn, count(*) over (partition by entity) as n from {rows}),
draws as (select entity, slot, floor(({key(seed, "entity", "slot")} + 0.5) / 4294967296.0 * n) + 1 as rn from (select distinct entity, n from rk where n < {k}), (select unnest(range(1, {k} + 1)) as slot)),
fixed as (select entity, {names}, rn::bigint as slot from rk where n >= {k} and rn <= {k} union all select rk.entity, {names}, slot from rk join draws d on d.entity = rk.entity and d.rn = rk.rn)"""


_EV = ["relation", "other", "direction"]


@query("W13_fixed_sample", f"with {_fixed('ev', _EV, 7, 1)} select entity, relation, other, direction, slot from fixed")
def _(kg):
    return sample.fixed_sample(views.edge_view(kg.triples), _EV, 7).withColumn("slot", F.col("slot").cast("bigint"))


@query(
    "W14_capped",
    f"select 'fact' as kind, entity, relation || ' ' || other || ' ' || direction as what from ev qualify row_number() over (partition by entity order by {key(1, 'entity', *_EV)}, relation, other, direction) <= 200 "
    f"union all select 'type', entity, type from train qualify row_number() over (partition by entity order by {key(1, 'entity', 'type')}, type) <= 100",
)
def _(kg):
    facts = sample.capped(views.edge_view(kg.triples), _EV, 200).select(F.lit("fact").alias("kind"), "entity", F.concat_ws(" ", *_EV).alias("what"))
    return facts.unionByName(sample.capped(kg.train, ["type"], 100).select(F.lit("type").alias("kind"), "entity", F.col("type").alias("what")))


@query("W15_second_hop_sample", f"with {_fixed('ev', _EV, 3, 1)}, one as (select distinct other as entity from fixed), ev2 as (select ev.* from ev semi join one using (entity)), {_fixed('ev2', _EV, 2, 2).replace('rk as', 'rk2 as').replace('from rk', 'from rk2').replace('draws as', 'draws2 as').replace('join draws', 'join draws2').replace('rk.', 'rk2.').replace('fixed as', 'fixed2 as')} select entity, relation, other, direction, slot from fixed2")
def _(kg):
    return sample.second_hop_sample(views.edge_view(kg.triples), _EV, 3, 2).withColumn("slot", F.col("slot").cast("bigint"))


_IDS = f"""ucl as (select distinct {C2} as name from train), ids as (
  select 'e' as kind, entity as name, row_number() over (order by entity) - 1 as id from universe union all
  select 't', type, row_number() over (order by type) - 1 from (select distinct type from train) union all
  select 'c', name, row_number() over (order by name) - 1 from ucl),
pairs6 as (select entity, c.id + (select count(distinct relation) from triples) as cluster, t.id + (select count(*) from universe) as type
  from train join ids t on t.kind = 't' and t.name = type join ids c on c.kind = 'c' and c.name = {C2.replace("type", "train.type")})"""


@query("W16_pair_sample", f"with {_IDS}, {_fixed('pairs6', ['cluster', 'type'], 6, 1)} select entity, cluster, type, slot from fixed")
def _(kg):
    return sample.pair_sample(kg.train, kg.triples).withColumn("slot", F.col("slot").cast("bigint"))


# --- walks -----------------------------------------------------------------------------------------------------------------
@query("G10_random_walks", f"with {walk()} select entity from walked")
def _(kg):
    seeds = sample.hub_seeds(kg.triples, HUBS).select("entity").union(sample.random_seeds(kg.triples, RANDOM)).distinct()
    return sample.walk(kg.triples, seeds)


# --- records -----------------------------------------------------------------------------------------------------------------
_KNOWN = "known2 as (select * from train union all select * from valid)"
_FACTS = "select head as entity, relation as name, tail from {0} where head <> tail union all select tail, 'inv-' || relation, head from {0} where head <> tail"
_WHO = "select head as entity from {0} where head <> tail union select tail from {0} where head <> tail union select entity from {1}"


def record_ctes(graph: str = "triples", known: str = "known2", first: str = "triples", last: str = "known2", facts: str = _FACTS, who: str = _WHO, p: str = "") -> str:
    """CTEs of the record lines of a graph; names without facts or types take the first and last ones of other tables."""
    return f"""{p}who as ({who.format(graph, known)}),
{p}rt as (select entity, {C1} as name, type as tail from {known} where entity in (select entity from {p}who) union all
  select entity, (select max(x) from (select {C2} as x from {last})), (select max(type) from {last}) from {p}who where entity not in (select entity from {known})),
{p}rf as ({facts.format(graph)}),
{p}rf2 as (select * from {p}rf where entity in (select entity from {p}who) union all select entity, (select min(relation) from {first}), (select least(min(head), min(tail)) from {first}) from {p}who where entity not in (select entity from {p}rf)),
{p}lines as (select w.entity, w.entity || ' ||| ' || t.p || ' ||| ' || f.p || ' ||| cluster' as line from {p}who w
  join (select entity, string_agg(entity || ' ' || name || ' ' || tail, ' [SEP] ' order by tail) as p from {p}rt group by 1) t using (entity)
  join (select entity, string_agg(entity || ' ' || name || ' ' || tail, ' [SEP] ' order by name, tail) as p from {p}rf2 group by 1) f using (entity))"""


REC = f"{_KNOWN}, {record_ctes()}"


def _records(kg, triples=None):
    triples = kg.triples if triples is None else triples
    known = kg.train.unionByName(kg.split("valid"))
    who = views.record_universe(triples, kg.train, kg.split("valid"), kg.split("test"))
    return records.context_records(who, views.with_inverse(triples), known, records.record_defaults(known, kg.triples))


@query("G7_context_records", f"with {REC} select * from lines")
def _(kg):
    return _records(kg).select("entity", "line")


_ROWS = "select entity, 'type' as part, entity as head, name, tail from rt union all select entity, 'fact', entity, name, tail from rf2"


@query("G9_parse_records", f"with {REC} {_ROWS}")
def _(kg):
    return records.parse_records(_records(kg))


@query("S12_records_file", f"with {REC} {_ROWS}")
def _(kg):
    lines = _records(kg).select("line")
    back = _again(kg, "s12", lines, io.write_lines, lambda s, p: s.read.text(p).withColumnRenamed("value", "line"))
    return records.parse_records(back)


_CODE = f"""{REC}, de as (select entity as name, row_number() over (order by entity) - 1 as id from who),
dr as (select relation as name, row_number() over (order by relation) - 1 as id from (select distinct relation from triples)),
dt as (select type as name, row_number() over (order by type) - 1 as id from (select distinct type from known2)),
dc as (select name, row_number() over (order by name) - 1 as id from (select distinct {C2} as name from known2)),
nn as (select (select count(*) from de) as E, (select count(*) from dr) as R, (select count(*) from dc) as C)"""


def _coded(kg):
    known = kg.train.unionByName(kg.split("valid"))
    who = views.record_universe(kg.triples, kg.train, kg.split("valid"), kg.split("test"))
    ids = [sample.dense_ids(who, "entity"), sample.dense_ids(kg.triples, "relation"), sample.dense_ids(known, "type"), sample.dense_ids(known.select(text.cluster(F.col("type")).alias("c")), "c")]
    return records.encode_rows(records.parse_records(_records(kg)), *ids)


_ENCODED = (
    f"select de.id as entity_id, 'type' as part, de.id as a, dc.id + R as b, dt.id + E as c from rt join de on de.name = rt.entity join dc on dc.name = {C2.replace('type', 'rt.tail')} join dt on dt.name = rt.tail, nn "
    "union all select de.id, 'fact', de.id, dr.id + case when starts_with(rf2.name, 'inv-') then R + C else 0 end, z.id from rf2 join de on de.name = rf2.entity join dr on dr.name = case when starts_with(rf2.name, 'inv-') then rf2.name[5:] else rf2.name end join de z on z.name = rf2.tail, nn"
)


@query("G8_encoded_records", f"with {_CODE} {_ENCODED}")
def _(kg):
    return _coded(kg)


def _triples_of(part: str) -> str:
    return f"coalesce('[' || string_agg('[' || a || ',' || b || ',' || c || ']', ',' order by a, b, c) filter (where part = '{part}') || ']', '[]')"


@query("G8_nested_records", f"with {_CODE}, coded as ({_ENCODED}) select entity_id as ent, {_triples_of('type')} as et, {_triples_of('fact')} as kg from coded group by 1")
def _(kg):
    out = records.encoded_records(_coded(kg))
    return out.select("ent", F.to_json("et").alias("et"), F.to_json("kg").alias("kg"))


@query("J16_second_hop_records", f"with {REC}, {_fixed('ev', _EV, 7, 1)}, asked as (select distinct other from fixed union select 'nobody') select other, coalesce(line, 'none') as record, (line is not null)::int as mask from asked left join lines on lines.entity = other")
def _(kg):
    asked = sample.fixed_sample(views.edge_view(kg.triples), _EV, 7).select("other").distinct()
    asked = asked.unionByName(kg.spark.range(1).select(F.lit("nobody").alias("other")))
    return records.second_hop(asked, _records(kg), "none")


@query(
    "J18_record_differences",
    f"with {REC}, n1 as (select entity, count(*) as n1 from (select entity from rt union all select entity from rf2) group by 1), less as (select * from triples where relation <> '/people/customer/order'), "
    "rf3 as (select head as entity from less where head <> tail union all select tail from less where head <> tail), who3 as (select entity from rf3 union select entity from known2), "
    "n2 as (select entity, count(*) as n2 from (select rt.entity from rt where entity in (select entity from who3) union all select entity from rf3 union all select entity from who3 where entity not in (select entity from rf3)) group by 1) "
    "select entity, n1, n2 from n1 join n2 using (entity) where n1 <> n2",
)
def _(kg):
    less = kg.triples.filter("relation <> '/people/customer/order'")
    return records.record_differences(records.parse_records(_records(kg)), records.parse_records(_records(kg, less)))


_SUB = "sub as (select head, max(relation) as relation, tail from triples where head in (select entity from walked) and tail in (select entity from walked) group by head, tail), smp as (select * from sub), sun as (select head as entity from sub union select tail from sub), strain as (select t.* from train t where entity in (select entity from sun))"
_HELD = "in (select entity from sun) and type in (select type from ktrain)"
_G11 = f"""{walk()}, {_SUB}, {_PICKED}, ktrain as (select entity, type from keyed join ksz using (entity) where rn <= k),
kvalid as (select * from valid where entity {_HELD}), ktest as (select * from test where entity {_HELD}), kknown as (select * from ktrain union all select * from kvalid),
{record_ctes("sub", "kknown", "sub", "ktrain", p="a")}, {record_ctes("sub", "kknown", "sub", "ktrain", who="select distinct entity from ktest", p="b")}"""


def long_rows(tables: dict) -> object:
    """Tables of up to three columns under one another: (part, a, b, c)."""
    out = None
    for part, df in tables.items():
        cells = [F.col(c).cast("string") for c in df.columns] + [F.lit(None).cast("string")] * (3 - len(df.columns))
        rows = df.select(F.lit(part).alias("part"), *[c.alias(n) for c, n in zip(cells, "abc")])
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "G11_sampled_dataset",
    f"with {_G11} select 'triples' as part, head as a, relation as b, tail as c from sub union all select 'train', entity, type, null from ktrain union all select 'valid', entity, type, null from kvalid "
    "union all select 'test', entity, type, null from ktest union all select 'relation_text', relation, text, null from rtxt where relation in (select relation from sub) "
    "union all select 'type_text', type, text, null from ttxt where type in (select type from ktrain) union all select 'records', 'train', entity, line from alines union all select 'records', 'test', entity, line from blines "
    "union all select 'dictionaries', kind, name, (row_number() over (partition by kind order by name) - 1)::varchar from (select 'entity' as kind, entity as name from sun "
    f"union select 'relation', relation from sub union select 'type', type from ktrain union select 'cluster', {C2} from ktrain)",
)
def _(kg):
    return long_rows(datasets.sampled(kg.triples, kg.train, kg.split("valid"), kg.split("test"), _degrees(kg), kg.relation_text, kg.type_text))
