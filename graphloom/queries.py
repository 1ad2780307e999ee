"""Queries over graphs derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import PRIME, bucket_hash, edge_parts
from .model import Graph, ends
from .operators import algorithms as alg
from .operators import partition as part
from .operators import transform as tr
from .operators.generate import rmat
from .plans import superstep
from .plans.lineage import shared_folder
from .plans.superstep import Program, run
from .sources import binary, derive, graphs, relations
from .sources.workspace import Workspace, relabelled, write_workspace

N = 4

# ---------------------------------------------------------------- SQL of the graphs

_ORDER = "select o_orderkey::bigint as src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)::bigint as dst from orders"
CHAIN = f"select src, dst from ({_ORDER}) where dst is not null"
GEO = (
    "select c_custkey::bigint + 2000000 as src, c_nationkey::bigint + 100 as dst from customer union all select s_suppkey::bigint + 10000, s_nationkey::bigint + 100 from supplier"
    " union all select n_nationkey::bigint + 100, n_regionkey::bigint from nation"
)
PARTS = "select l_partkey::bigint as src, l_suppkey::bigint as dst from lineitem"
USERS = "select src, dst from (select user_id::bigint as src, lead(user_id) over (order by ts, event_id)::bigint as dst from events) where dst is not null"


def _with(edges: str, *ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ", ".join([f"e as materialized ({edges})", "v as materialized (select src as id from e union select dst from e)", *ctes]) + " "


_SYM = "s as materialized (select src, dst from e union select dst, src from e)"
_HASH = "(((({0}) & 4294967295) * 444984403) & 4294967295) >> 1"
_CUT = f"p as (select src, dst, (({_HASH.format('src')}) % {N})::int as gid from e)"
_OWN = f"o as (select id, (floor(id / ceil((select count(*) from v) / {float(N)}))::bigint % {N})::int as gid from v)"
_DEG = "d as materialized (select id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select src as id, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by id)"
_REACH = "r(id, label) as (select id, id from v union select {0}.dst, r.label from r join {0} on {0}.src = r.id)"


def _ranks(step: str, k: int, first: str) -> list[str]:
    out = [f"r0 as materialized (select id, {first} as value from v)"]
    for i in range(k):
        out.append(f"r{i + 1} as materialized (" + step.format(a=f"r{i}") + ")")
    return out


_MEAN = "select {{a}}.id, case when m.x is not null and ({{a}}.value - 0.01 * m.x) * ({{a}}.value - 0.01 * m.x) > 0.001 then least({{a}}.value, {0}) else {{a}}.value end as value from {{a}} left join (select dst, avg({{a}}.value) as x from e join {{a}} on {{a}}.id = e.src group by dst) m on m.dst = {{a}}.id"
_PR = "select {a}.id, 0.15 / (select count(*) from v) + 0.85 * (coalesce(m.x, 0) + (select coalesce(sum(value), 0) from {a} where id not in (select src from k)) / (select count(*) from v)) as value from {a} left join (select e.dst, sum({a}.value / k.n) as x from e join {a} on {a}.id = e.src join k on k.src = e.src group by e.dst) m on m.dst = {a}.id"
_ASCENT = "r(id, n) as (select id, 0::bigint from v union select s.src, r.n + 1 from r join s on s.dst = r.id where s.src < s.dst)"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- edges, sets, statistics


@query(_with(PARTS, _DEG) + "select * from d")
def degrees(s, d):
    return tr.degrees(derive.part_supp(s, d))


@query(_with(PARTS, _DEG) + "select max(id) as max_vid, max(in_degree) as max_in_degree, max(out_degree) as max_out_degree, max(in_degree + out_degree) as max_degree, sum(in_degree)::bigint as sum_in_degree, sum(out_degree)::bigint as sum_out_degree, (sum(in_degree) // count(*))::bigint as avg_in_degree, (sum(out_degree) // count(*))::bigint as avg_out_degree, sum(out_degree)::bigint as num_edges, count(*) as num_vertexes from d")
def graph_statistics(s, d):
    return tr.graph_statistics(derive.part_supp(s, d))


@query(_with(CHAIN) + "select id from v")
def distinct_vertices(s, d):
    return ends(derive.order_chain(s, d))


@query(_with(GEO) + "select count(*) as n from v")
def vertex_count(s, d):
    return tr.count_ids(ends(derive.geo(s, d)))


@query(_with(PARTS) + "select src, dst from e where src <> dst")
def drop_self_loops(s, d):
    return Graph(derive.part_supp(s, d)).without_loops().edges


@query(_with(PARTS) + "select distinct src, dst from e")
def dedup_edges(s, d):
    return Graph(derive.part_supp(s, d)).deduplicated().edges


@query(_with(PARTS) + "select dst as src, src as dst from e")
def reverse_edges(s, d):
    return Graph(derive.part_supp(s, d)).reversed().edges


@query(_with(PARTS, _SYM) + "select src, dst from s")
def symmetrize(s, d):
    return Graph(derive.part_supp(s, d)).symmetric().edges


@query(_with(PARTS) + "select src as id from e union select dst from e")
def set_union(s, d):
    e = derive.part_supp(s, d)
    return tr.union_ids(e.select(F.col("src").alias("id")), e.select(F.col("dst").alias("id")))


@query(_with(PARTS) + "select src as id from e except select dst from e")
def set_minus(s, d):
    e = derive.part_supp(s, d)
    return tr.minus_ids(e.select(F.col("src").alias("id")), e.select(F.col("dst").alias("id")))


@query(_with(PARTS) + "select src as id from e intersect select dst from e")
def set_common(s, d):
    e = derive.part_supp(s, d)
    return tr.common_ids(e.select(F.col("src").alias("id")), e.select(F.col("dst").alias("id")))


@query(_with(PARTS) + "select not exists ((select src from e except select dst from e) union all (select dst from e except select src from e)) as equal")
def set_equal(s, d):
    e = derive.part_supp(s, d)
    return tr.same_ids(e.select(F.col("src").alias("id")), e.select(F.col("dst").alias("id")))


@query("select i as id from range(1000) t(i) where i not in (select l_partkey from lineitem)")
def set_complement(s, d):
    """The full set of ids below 1,000 without the parts."""
    return tr.minus_ids(tr.full_ids(s, 1000), derive.part_supp(s, d).select(F.col("src").alias("id")))


@query("select 'none' as name, true as empty union all select 'parts', not exists (select 1 from lineitem)")
def set_empty(s, d):
    ids = derive.part_supp(s, d).select(F.col("src").alias("id"))
    return tr.is_empty(tr.empty_ids(s)).select(F.lit("none").alias("name"), "empty").union(tr.is_empty(ids).select(F.lit("parts"), "empty"))


@query(_with(PARTS, _DEG) + "select * from d where id = 7")
def vertex_lookup(s, d):
    return tr.lookup(tr.degrees(derive.part_supp(s, d)), 7)


@query(_with(USERS, _DEG) + "select * from d")
def user_transition_degrees(s, d):
    return tr.degrees(derive.user_transition(s, d))


@query(_with(PARTS) + "select src::int as src, dst::int as dst from e")
def types_convert(s, d):
    return tr.narrow(derive.part_supp(s, d))


# ---------------------------------------------------------------- adjacency, compaction


@query(_with(CHAIN, _DEG) + "select d.id, d.out_degree, d.in_degree, coalesce((select string_agg(dst, ',' order by dst) from e where e.src = d.id), '') as out_edges, coalesce((select string_agg(src, ',' order by src) from e where e.dst = d.id), '') as in_edges from d")
def adjacency(s, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return tr.adjacency(derive.order_chain(s, d)).select("id", "out_degree", "in_degree", text("out_edges"), text("in_edges"))


@query(_with(CHAIN, _DEG) + "select id, out_degree, (sum(out_degree) over (order by id) - out_degree)::bigint as out_offset, in_degree, (sum(in_degree) over (order by id) - in_degree)::bigint as in_offset from d")
def csr_offsets(s, d):
    return tr.csr_offsets(derive.order_chain(s, d))


@query(_with(CHAIN, _DEG, "x as (select id, out_degree, sum(out_degree) over (order by id) - out_degree as spot from d)") + "select 0::int as section, 0::bigint as place, 'AdjacencyGraph' as value union all select 0, 1, (count(*))::varchar from d union all select 0, 2, count(*)::varchar from e union all select 1, id, spot::bigint::varchar from x union all select 2, (x.spot + row_number() over (partition by e.src order by e.dst) - 1)::bigint, e.dst::varchar from e join x on x.id = e.src")
def adjacency_text(s, d):
    return graphs.adjacency_text(derive.order_chain(s, d))


@query(_with(CHAIN) + "select id, (row_number() over (order by id) - 1) as new_id from v")
def compact_graph(s, d):
    return tr.compaction(derive.order_chain(s, d))


@query(_with(CHAIN, "n as (select id, row_number() over (order by id) - 1 as new_id from v)") + "select a.new_id as src, b.new_id as dst from e join n a on a.id = e.src join n b on b.id = e.dst")
def compact_edges(s, d):
    e = derive.order_chain(s, d)
    return tr.relabel(e, tr.compaction(e))


@query(_with(CHAIN, "f as (select id, min(spot) as spot from (select src as id, 2 * src as spot from e union all select dst, 2 * src + 1 from e) group by id)") + "select id, row_number() over (order by spot, id) - 1 as new_id from f")
def compact_first_seen(s, d):
    return tr.compaction_first_seen(derive.order_chain(s, d).withColumn("at", F.col("src")), "at")


# ---------------------------------------------------------------- partitioning


@query(_with(PARTS, _OWN) + "select * from o")
def partition_edgecut(s, d):
    return part.edge_cut(derive.part_supp(s, d), N)


@query(_with(PARTS, _CUT) + "select * from p")
def partition_vertexcut(s, d):
    return part.vertex_cut(derive.part_supp(s, d), N)


@query(_with(PARTS, f"c as (select src, dst, ({_HASH.format('src')}) % {N} * {N} + ({_HASH.format('dst')}) % {N} as cell from e)") + "select src, dst, (dense_rank() over (order by cell) - 1)::int as gid from c")
def partition_2dvc(s, d):
    return part.grid_cut(derive.part_supp(s, d), N)


@query(_with(PARTS, _CUT, "z as (select gid, count(distinct id) as n from (select gid, src as id from p union all select gid, dst from p) group by gid)", "t as (select gid as top from z order by n desc, gid limit 1)") + f"select src, dst, (case when gid = top then {N - 1} + ({_HASH.format('src')}) % 2 when gid > top then gid - 1 else gid end)::int as gid from p, t")
def partition_hybrid(s, d):
    return part.hybrid_cut(derive.part_supp(s, d), N, 2)


@query(_with(PARTS, _CUT) + "select id from (select src as id, gid from p union select dst, gid from p) group by id having count(*) > 1")
def border_vertices(s, d):
    return part.border_vertices(part.vertex_cut(derive.part_supp(s, d), N))


@query(_with(PARTS, _CUT) + "select id, string_agg(gid, ',' order by gid) as gids from (select src as id, gid from p union select dst, gid from p) group by id")
def vertex_dependencies(s, d):
    return part.replicas(part.vertex_cut(derive.part_supp(s, d), N)).select("id", F.array_join(F.col("gids").cast("array<string>"), ",").alias("gids"))


@query(_with(GEO) + "select distinct src as id from e where dst not in (select src from e)")
def list_border(s, d):
    return part.list_border(derive.geo(s, d))


@query(_with(PARTS, _OWN, "q as (select e.src, e.dst, a.gid as here, b.gid as there from e join o a on a.id = e.src join o b on b.id = e.dst where e.src <> e.dst)", "x as (select src, count(*) as dg, count(*) filter (here = there) as dl from q group by src)", "y as (select dst, count(*) as din from q group by dst)") + "select o.gid, count(*) as num_vertexes, sum(coalesce(dg, 0) + coalesce(din, 0))::bigint as num_edges, count(*) as num_active_vertexes, sum(coalesce(dg - dl, 0))::bigint as sum_out_border_vertexes, sum(coalesce(dl, 0))::bigint as sum_dlv, sum(coalesce(dg, 0))::bigint as sum_dgv, sum(coalesce(dl * dl, 0))::bigint as sum_dlv_times_dlv, sum(coalesce(dl * dg, 0))::bigint as sum_dlv_times_dgv, sum(coalesce(dg * dg, 0))::bigint as sum_dgv_times_dgv from o left join x on x.src = o.id left join y on y.dst = o.id group by o.gid")
def fragment_statistics(s, d):
    e = derive.part_supp(s, d)
    return part.fragment_statistics(e, part.edge_cut(e, N))


@query(_with(PARTS, _OWN) + "select a.gid as gid_from, b.gid as gid_to from (select distinct gid from o) a, (select distinct gid from o) b where a.gid <> b.gid")
def communication_matrix(s, d):
    return part.communication_matrix(part.edge_cut(derive.part_supp(s, d), N))


@query(_with(CHAIN, _OWN) + "select distinct a.gid as gid_from, b.gid as gid_to from e join o a on a.id = e.src join o b on b.id = e.dst where a.gid <> b.gid")
def fragment_dependencies(s, d):
    e = derive.order_chain(s, d)
    return part.fragment_dependencies(e, part.edge_cut(e, N))


@query(_with(CHAIN, _OWN) + "select id, gid, row_number() over (partition by gid order by id) - 1 as local_id from o")
def vid_map(s, d):
    return part.vid_map(part.edge_cut(derive.order_chain(s, d), N))


# ---------------------------------------------------------------- algorithms


@query(_with(CHAIN, _SYM, _REACH.format("s"), recursive=True) + "select id, min(label) as label from r group by id")
def connected_components(s, d):
    return alg.connected_components(Graph(derive.order_chain(s, d)))


@query(_with(CHAIN, _SYM, _REACH.format("s"), recursive=True) + "select id, min(label) as label from r group by id")
def components_by_supersteps(s, d):
    return alg.min_ancestor_label(Graph(derive.order_chain(s, d)).both_ways())  # the least label is the same however often an edge stands


@query(_with(GEO, _SYM, _REACH.format("s"), recursive=True) + "select id, min(label) as label from r group by id")
def connected_components_geo(s, d):
    return alg.connected_components(Graph(derive.geo(s, d)))


@query(_with(CHAIN, _REACH.format("e"), recursive=True) + "select id, min(label) as label from r group by id")
def min_ancestor_label(s, d):
    return alg.min_ancestor_label(Graph(derive.order_chain(s, d)))


@query(_with(CHAIN, _SYM, _REACH.format("s"), "c as (select id, min(label) as label from r group by id)", recursive=True) + "select label, count(*) as size from c group by label")
def component_sizes(s, d):
    return alg.component_sizes(Graph(derive.order_chain(s, d)))


@query(_with(CHAIN, _SYM, _REACH.format("s"), recursive=True) + "select id, min(label) as label from r group by id")
def incremental_components(s, d):
    """Labels of one half of the edges, brought up to date by the other half."""
    from .plans.lineage import cut

    e = cut(derive.order_chain(s, d))
    half = F.pmod(bucket_hash(F.col("src")), F.lit(2)) == 0
    return alg.incremental_components(cut(alg.connected_components(Graph(e.where(half)))), e.where(~half))


_HOPS = "h(id, n) as (select 0::bigint, 0::bigint union select s.dst, h.n + 1 from h join s on s.src = h.id where h.n < 8)"


@query(_with(GEO, _SYM, _HOPS, recursive=True) + "select v.id, min(h.n) as distance from v left join h on h.id = v.id group by v.id")
def sssp_hops(s, d):
    return alg.sssp(Graph(derive.geo(s, d)).symmetric(), 0)


@query(_with(GEO, _SYM, _HOPS, recursive=True) + "select v.id, coalesce(min(h.n), 268435455)::bigint as distance from v left join h on h.id = v.id group by v.id")
def sssp_unreached(s, d):
    return alg.sssp(Graph(derive.geo(s, d)).symmetric(), 0, unreached=True)


@query(_with(PARTS, "r(id) as (select 1::bigint union select e.dst from r join e on e.src = r.id)", recursive=True) + "select id from r")
def bfs_reachable(s, d):
    return alg.bfs_reachable(Graph(derive.part_supp(s, d)), 1)


@query(_with(PARTS) + "select v.id, (case when exists (select 1 from e where e.dst = v.id) then 0 else 1 end)::bigint as value from v")
def mean_rank_int(s, d):
    return alg.mean_rank_int(Graph(derive.part_supp(s, d)), 3)


@query(_with(GEO, *_ranks(_MEAN.format("0.01 * m.x"), 5, "1.0::double")) + "select id, round(value, 6) as value from r5")
def mean_rank(s, d):
    return alg.mean_rank(Graph(derive.geo(s, d)), 5).select("id", F.round("value", 6).alias("value"))


@query(_with(PARTS, "k as (select src, count(*) as n from e group by src)", *_ranks(_PR, 5, "1.0::double / (select count(*) from v)")) + "select id, round(value, 9) as value from r5")
def pagerank(s, d):
    return alg.pagerank(Graph(derive.part_supp(s, d)), 5).select("id", F.round("value", 9).alias("value"))


@query(_with(CHAIN, _SYM, _ASCENT, recursive=True) + "select id, max(n) as color from r group by id")
def coloring(s, d):
    return alg.coloring(Graph(derive.order_chain(s, d)).symmetric())


@query(_with(USERS, _SYM, _ASCENT, recursive=True) + "select id, max(n) as color from r group by id")
def coloring_dense(s, d):
    """A dense graph with cycles, of many colours."""
    return alg.coloring(Graph(derive.user_transition(s, d)).symmetric())


@query("select 0::bigint as conflicts")
def coloring_conflicts(s, d):
    """On a dense graph with cycles; the chains of orders that `coloring` colours are paths."""
    g = Graph(derive.user_transition(s, d)).symmetric()
    return alg.coloring_conflicts(g, alg.coloring(g))


@query(_with(GEO) + "select id, label from (select src as id, 'customer' as label from e where src >= 2000000 and dst in (select src from e where dst < 100) union select src, 'nation' from e where dst < 100 union select dst, 'region' from e where dst < 100)")
def simulation(s, d):
    g = Graph(derive.geo(s, d))
    label = F.when(F.col("id") >= 2_000_000, "customer").when(F.col("id") >= 10_000, "supplier").when(F.col("id") >= 100, "nation").otherwise("region")
    return alg.simulation(g, g.vertices.withColumn("label", label), [("customer", "nation"), ("nation", "region")])


def draw_sql(*values: str) -> str:
    """The draw of functions.columns in SQL."""
    h = "1::bigint"
    for v in values:
        h = f"(({h} * 48271 + ({v})::bigint % {PRIME}) % {PRIME})"
    return f"list_reduce([{h}, 0, 0], lambda x, y: (x * (x % 46337 + 1) + 12345) % {PRIME})"


def _walk(step: int) -> str:
    return f"w{step} as materialized (select w.src, w.walk, n.dst as id from w{step - 1} w join k on k.src = w.id join n on n.src = w.id and n.place = {draw_sql('7', 'w.src', 'w.walk', str(step))} % k.degree)"


@query(
    _with(PARTS, "u as materialized (select distinct src, dst from e)", "n as materialized (select src, dst, row_number() over (partition by src order by dst) - 1 as place from u)", "k as materialized (select src, count(*) as degree from u group by src)", "w0 as materialized (select id as src, walk, id from v, (values (0), (1)) t(walk))", *[_walk(i) for i in (1, 2, 3)])
    + " union all ".join(f"select src, walk, {i} as step, id from w{i}" for i in range(4))
)
def random_walks(s, d):
    return alg.random_walks(Graph(derive.part_supp(s, d)), walks=2, length=3, seed=7)


# ---------------------------------------------------------------- the programming model


@query(_with(CHAIN, _REACH.format("e"), recursive=True) + "select id, max(label) as value from r group by id")
def program_max(s, d):
    """A program of the caller's own: the largest id from which a vertex is reached."""
    return run(Graph(derive.order_chain(s, d)), Program(F.col("id"), F.col("value"), "max", F.greatest("value", "msg")), None, contract_after=alg.LONG_PATH).state


@query(_with(GEO, "w as (select dst, count(*) as n from e group by dst)") + "select v.id, (1 + coalesce(n, 0))::bigint as value from v left join w on w.dst = v.id")
def program_sum(s, d):
    """One step of a sum: 1 and one for each in-edge."""
    p = Program(F.lit(1).cast("long"), F.col("value"), "sum", F.col("value") + F.col("msg"), frontier=False)
    return run(Graph(derive.geo(s, d)), p, 1).state


@query(_with(CHAIN, _REACH.format("e"), "l as (select id, min(label) as label from r group by id)", recursive=True) + "select count(distinct label) as roots, max(label)::bigint as last from l")
def program_aggregate(s, d):
    base = alg.least_label_program()
    fold = lambda x: x.agg(F.countDistinct("value").alias("roots"), F.max("value").alias("last"))
    return run(Graph(derive.order_chain(s, d)), Program(base.init, base.message, base.combine, base.update, aggregate=fold), None, contract_after=alg.LONG_PATH).state


_HOP = "h(id, a, n) as (select id, id, 0 from v union all select e.dst, h.a, h.n + 1 from h join e on e.src = h.id)"
_MOVES = "m as (select id, n, a < min(a) over (partition by id order by n rows between unbounded preceding and 1 preceding) as moved from h)"
_STEPS = "c as (select n, count(*) filter (moved) as changed from m where n > 0 group by n)", "t as (select i as step, coalesce(c.changed, 0) as changed from generate_series(1, (select coalesce(max(n), 0) + 1 from c)) g(i) left join c on c.n = i)"


@query(_with(CHAIN, _HOP, _MOVES, *_STEPS, recursive=True) + "select step::int as step, coalesce(lag(changed) over (order by step), (select count(*) from v))::bigint as active, changed::bigint as changed from t where step <= (select min(step) from t where changed = 0)")
def program_metrics(s, d):
    """Metrics of every step: on paths, the label of a vertex changes in a step if its ancestor that many hops away is less than all nearer ones."""
    return run(Graph(derive.order_chain(s, d)), alg.least_label_program(), None).metrics_frame().select("step", "active", "changed")


_FIRST = "select 0 as inc_type, count(*) as active, sum(coalesce(dl, 0))::bigint as sum_dlv, sum(coalesce(dg, 0))::bigint as sum_dgv, sum(coalesce(dl * dl, 0))::bigint as sum_dlv_times_dlv, sum(coalesce(dl * dg, 0))::bigint as sum_dlv_times_dgv, sum(coalesce(dg * dg, 0))::bigint as sum_dgv_times_dgv, sum(coalesce(dg - dl, 0))::bigint as sum_out_border_vertexes, sum(coalesce(ig - il, 0))::bigint as sum_in_border_vertexes, sum(coalesce(dg, 0) + coalesce(ig, 0))::bigint as num_edges, count(*) as num_vertexes from v left join x on x.src = v.id left join y on y.dst = v.id"


@query(_with(CHAIN, _OWN, "q as (select e.src, e.dst, a.gid as here, b.gid as there from e join o a on a.id = e.src join o b on b.id = e.dst where e.src <> e.dst)", "x as (select src, count(*) as dg, count(*) filter (here = there) as dl from q group by src)", "y as (select dst, count(*) as ig, count(*) filter (here = there) as il from q group by dst)") + _FIRST)
def program_counters(s, d):
    """The counters of a first step, in which every vertex is active."""
    e = derive.order_chain(s, d)
    out = run(Graph(e), alg.mean_rank_program(), 1, owners=part.edge_cut(e, N)).metrics_frame()
    return out.drop("step", "changed", "elapsed_time")


@query(_with(GEO) + "select v.id, case when v.id >= 2000000 then v.id + 1 else v.id end as value, v.id in (select dst from e where src >= 2000000) as changed from v")
def vertex_map(s, d):
    """Customers are active and go up by one; their nations are active next."""
    g = Graph(derive.geo(s, d))
    state = g.vertices.select("id", F.col("id").alias("value"), (F.col("id") >= 2_000_000).alias("changed"))
    return superstep.vertex_map(g, state, F.col("value") + 1)


@query(_with(PARTS, _CUT, "z as (select gid, src as id, count(*) as out_degree from p group by gid, src)") + "select gid, id, out_degree from z qualify row_number() over (partition by gid order by out_degree desc, id) = 1")
def active_map(s, d):
    """A kernel of the caller's own for each fragment: the vertex with most out-edges."""

    def kernel(gid, table):
        ids, n = np.unique(table.column("src").to_numpy(), return_counts=True)
        at = int(np.lexsort((ids, -n))[0])
        return pa.table({"gid": pa.array([gid], pa.int32()), "id": pa.array([ids[at]], pa.int64()), "out_degree": pa.array([n[at]], pa.int64())})

    def merge(gid, table):
        return table.slice(int(np.lexsort((table.column("id").to_numpy(), -table.column("out_degree").to_numpy()))[0]), 1)

    return superstep.active_map(part.vertex_cut(derive.part_supp(s, d), N), kernel, "gid int, id long, out_degree long", merge)


@query("select (i % 4)::bigint as number, sum(i * i)::bigint as total from range(1000) t(i) group by i % 4")
def parallel_do(s, d):
    """A kernel without a graph: each task adds up its own squares."""

    def kernel(i, n):
        return pa.record_batch({"number": pa.array([i], pa.int64()), "total": pa.array([sum(x * x for x in range(i, 1000, n))], pa.int64())})

    return superstep.parallel_do(s, 4, kernel, "number long, total long")


# ---------------------------------------------------------------- workspaces and binary files


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _workspace(s: SparkSession, d: str, strategy: str = "edgecut") -> Workspace:
    e = derive.order_chain(s, d)
    values = ends(e).select("id", (F.col("id") % 97).alias("value"))
    return write_workspace(e, _folder(s, "workspace"), strategy, N, values)


@query(_with(CHAIN, _OWN) + "select o.gid, e.src, e.dst from e join o on o.id = e.src")
def csr_round_trip(s, d):
    return _workspace(s, d).edges("out")


@query(_with(CHAIN, _OWN) + "select o.gid, e.src, e.dst from e join o on o.id = e.dst")
def csr_in_edges(s, d):
    return _workspace(s, d).edges("in")


@query(_with(CHAIN, _CUT) + "select gid, src, dst from p")
def csr_round_trip_vertexcut(s, d):
    return _workspace(s, d, "vertexcut").edges("out")


@query(_with(CHAIN, _OWN, _DEG) + "select o.gid, o.id, row_number() over (partition by o.gid order by o.id) - 1 as local_id, d.in_degree, d.out_degree, o.id % 97 as value from o join d on d.id = o.id")
def workspace_vertices(s, d):
    return _workspace(s, d).vertices()


@query(_with(CHAIN, _OWN) + "select id, gid, (id * 3) % 89 as value from o")
def workspace_values(s, d):
    """Values written anew; the structure of the fragments stays."""
    w = _workspace(s, d)
    w.write_values(w.vertices().select("id", ((F.col("id") * 3) % 89).alias("value")))
    return w.vertices().select("id", "gid", "value")


@query(_with(CHAIN, _OWN) + "select distinct gid from o")
def workspace_fragments(s, d):
    return _workspace(s, d).fragments()


@query(_with(CHAIN, _OWN, "m as (select id, row_number() over (partition by gid order by id) - 1 as place from o)") + "select i as id, coalesce(place, 0)::bigint as value from generate_series(0, (select max(id) from o)) g(i) left join m on m.id = i")
def workspace_id_map(s, d):
    return _workspace(s, d).id_map()


@query(_with(CHAIN, _OWN, "q as (select e.src, e.dst from e join o a on a.id = e.src join o b on b.id = e.dst where a.gid <> b.gid)") + "select src as id from q union select dst from q")
def workspace_border(s, d):
    return _workspace(s, d).border()


@query(_with(CHAIN, _OWN) + "select distinct a.gid as gid_from, b.gid as gid_to from e join o a on a.id = e.src join o b on b.id = e.dst where a.gid <> b.gid")
def workspace_matrix(s, d):
    return _workspace(s, d).matrix()


@query(SQL["fragment_statistics"].replace(PARTS, CHAIN))
def workspace_statistics(s, d):
    return _workspace(s, d).statistics()


@query(_with(CHAIN, _OWN, "m as (select id, gid, row_number() over (partition by gid order by id) - 1 as place from o)") + "select a.gid, a.place as src, case when a.gid = b.gid then b.place end as dst from e join m a on a.id = e.src join m b on b.id = e.dst")
def local_edges(s, d):
    e = derive.order_chain(s, d)
    return relabelled(e, part.edge_cut(e, N))


@query(_with(PARTS, _OWN, "w as (select id, count(*) as n from (select src as id from e union all select dst from e) group by id)", "t as (select gid as top from o join w using (id) group by gid order by sum(n) desc, gid limit 1)") + f"select id, (case when gid = top then {N - 1} + id % 3 when gid > top then gid - 1 else gid end)::int as gid from o, t")
def partition_edgecut_split(s, d):
    return part.edge_cut_split(derive.part_supp(s, d), N, 3)


@query(_with(PARTS) + "select src, dst from e")
def binary_file_round_trip(s, d):
    path = _folder(s, "edges")
    graphs.write_binary(derive.part_supp(s, d), path)
    return graphs.read_graph(s, path, "edgelist_bin").edges


@query(_with(PARTS, _CUT) + "select gid || '.bin' as name, id, id % 13 as value from (select gid, src as id from p union select gid, dst from p)")
def edge_list_values(s, d):
    """Edge lists of four fragments with values of vertices."""
    path, e = _folder(s, "lists"), derive.part_supp(s, d)
    binary.write_edge_lists(part.vertex_cut(e, N), path, ends(e).select("id", (F.col("id") % 13).alias("value")))
    return binary.read_edge_list_values(s, path)


@query(_with(PARTS) + "select src, dst from e")
def edge_list_folder(s, d):
    path = _folder(s, "lists")
    binary.write_edge_lists(part.vertex_cut(derive.part_supp(s, d), N), path)
    return graphs.read_graph(s, path, "edgelist_bin_folder").edges


@query(_with(PARTS) + "select distinct src as id from e")
def bitmap_round_trip(s, d):
    path = f"{_folder(s, 'bits')}/set.bin"
    binary.write_bitmap(derive.part_supp(s, d).select(F.col("src").alias("id")).distinct(), path)
    return binary.read_bitmap(s, path)


# ---------------------------------------------------------------- tables and formats


_TABLES = ("region", "nation", "supplier")


@query("select r_regionkey::varchar as r_regionkey, r_name::varchar as r_name from region")
def relation_load(s, d):
    """A table of strings from a CSV file with a header."""
    path = _folder(s, "relation")
    relations.write_folder({"region": s.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name")}, path)
    return relations.read_relations(s, {"region": f"{path}/region"})["region"]


@query(" union all ".join(f"select '{t}' as name, count(*) as n, sum(length({t[0]}_name))::bigint as chars from {t}" for t in _TABLES))
def relation_folder(s, d):
    """Every table of a folder of CSV files, counted."""
    path = _folder(s, "relations")
    relations.write_folder({t: s.read.parquet(f"{d}/{t}.parquet") for t in _TABLES}, path)
    parts = [t.agg(F.count("*").alias("n"), F.sum(F.length(f"{k[0]}_name")).alias("chars")).select(F.lit(k).alias("name"), "n", "chars") for k, t in relations.read_folder(s, path).items()]
    return functools.reduce(DataFrame.union, parts)


@query("select s_suppkey::varchar as s_suppkey, s_name::varchar as s_name, s_nationkey::varchar as s_nationkey from supplier")
def relation_binary(s, d):
    """A table of strings through files of cells of fixed width."""
    path = _folder(s, "cells")
    relations.write_binary({"supplier": s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")}, path)
    return relations.read_binary(s, path, ["supplier"])["supplier"]


@query("select * from (select o_orderkey, o_custkey from orders order by o_orderkey limit (select (count(*) // 10) from orders))")
def head_sample(s, d):
    return tr.head_sample(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey"), 0.1, ["o_orderkey"])


@query("select c1 as c_custkey, c2 as c_name from (select * from customer) t(c1, c2)")
def first_two_columns(s, d):
    return tr.first_columns(s.read.parquet(f"{d}/customer.parquet"))


@query(_with(PARTS) + "select src, dst from e")
def split_edges(s, d):
    lines = derive.part_supp(s, d).select(F.concat_ws(",", "src", "dst").alias("value"))
    a, b = edge_parts(F.col("value"), ",")
    return lines.select(a.alias("src"), b.alias("dst"))


@query(_with(PARTS) + "select src, dst from e")
def binary_round_trip(s, d):
    return graphs.unpacked(graphs.packed(derive.part_supp(s, d)).select("file"))


@query(_with(PARTS) + "select src, dst from e")
def csv_round_trip(s, d):
    path = _folder(s, "csv")
    graphs.write_csv(derive.part_supp(s, d), path, " ")
    return graphs.read_graph(s, path, "edgelist_csv", " ").edges


_CHANCES = (0.57, 0.19, 0.19, 0.05)
_ONE, _TWO, _THREE = (int(x * PRIME) for x in (_CHANCES[0], _CHANCES[0] + _CHANCES[1], _CHANCES[0] + _CHANCES[1] + _CHANCES[2]))
_BITS = [f"select id, {i} as i, {draw_sql('3', str(i), 'id')} as u from range(50000) t(id)" for i in range(12)]


@query(f"with u as ({' union all '.join(_BITS)}) select distinct sum((u >= {_TWO})::bigint << (11 - i))::bigint as src, sum((u >= {_ONE} and u < {_TWO} or u >= {_THREE})::bigint << (11 - i))::bigint as dst from u group by id")
def rmat_graph(s, d):
    return rmat(s, 12, 50_000, *_CHANCES, seed=3)
