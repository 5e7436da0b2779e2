"""Queries over hypotheses derived from the driver's events, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.durable import front_coded
from causeway.operators import alike as A
from causeway.operators import clusters as C
from causeway.operators import dyads as D
from causeway.operators import models as M
from causeway.operators import profiles as P
from causeway.operators import signatures as S
from causeway.operators import summaries as U
from causeway.operators.crux import Crux
from causeway.sources import events as E
from causeway.sources import registry as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The models, nodes and edges of the events, as rows.
BASE = """
with node as (select cast(user_id as varchar) m, event_type n, cast(min(date_diff('day', timestamp '2024-01-01 00:00:00', ts)) as int) t
  from events group by 1, 2),
names as (select n, row_number() over (order by n) i, count(*) over () k from (select distinct event_type n from events)),
reg as (select a.n s, b.n d, 'C' || lpad(cast(a.k + row_number() over (order by a.i, b.i) as varchar), 4, '0') c from names a join names b on a.i < b.i),
nreg as (select n, 'C' || lpad(cast(i as varchar), 4, '0') c from names),
edge as (select x.m, reg.s, reg.d, reg.c, x.t ts, y.t td, case when x.t < y.t then 1 when x.t > y.t then 2 else 0 end st
  from reg join node x on x.n = reg.s join node y on y.m = x.m and y.n = reg.d),
models as (select distinct m from node),
pairs as (select a.m e, b.m a from models a join models b on a.m <> b.m),
nn as (select m, count(*) k from node group by m), ne as (select m, count(*) k from edge group by m),
ns as (select a.m e, b.m a, count(*) c, count(case when a.t <> b.t then 1 end) other from node a join node b on a.n = b.n and a.m <> b.m group by 1, 2),
es as (select a.m e, b.m a, count(*) both_app, sum(case when a.st = b.st and a.st > 0 then 1 else 0 end) sh, sum(case when a.st > 0 or b.st > 0 then 1 else 0 end) un,
  sum(case when a.st > 0 and b.st > 0 and a.st <> b.st then 1 else 0 end) cf, sum(case when a.st <> b.st then 1 else 0 end) moved
  from edge a join edge b on a.c = b.c and a.m <> b.m group by 1, 2),
dyad as (select p.e ego_id, p.a alter_id, cast(coalesce(ns.c, 0) + coalesce(es.sh, 0) as bigint) shared,
  cast(x.k + y.k - coalesce(ns.c, 0) + coalesce(es.un, 0) + coalesce(es.cf, 0) + coalesce(ex.k, 0) + coalesce(ey.k, 0) - 2 * coalesce(es.both_app, 0) as bigint) union_claims,
  cast(x.k + y.k - 2 * coalesce(ns.c, 0) + coalesce(ex.k, 0) + coalesce(ey.k, 0) - 2 * coalesce(es.both_app, 0) + coalesce(es.moved, 0) as bigint) repair_cost,
  cast(x.k + y.k - 2 * coalesce(ns.c, 0) as bigint) node_conflicts, cast(coalesce(es.cf, 0) as bigint) edge_conflicts,
  cast((select count(*) from reg) - coalesce(es.both_app, 0) as bigint) inapplicable_components, coalesce(ns.other, 0) = 0 timing_compatible
  from pairs p join nn x on x.m = p.e join nn y on y.m = p.a left join ne ex on ex.m = p.e left join ne ey on ey.m = p.a
  left join ns on ns.e = p.e and ns.a = p.a left join es on es.e = p.e and es.a = p.a)
"""


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql if sql.lstrip().lower().startswith("with") else BASE + sql
        return fn

    return add


def _counts(spark, sf_dir) -> DataFrame:
    reg, m = E.packed(spark, sf_dir)
    return D.counts(D.pairs(m, reg), reg)


@query("select ego_id, alter_id, shared, union_claims, case when union_claims = 0 then 1.0 else shared / union_claims end similarity from dyad")
def dyad_similarity(spark, sf_dir):
    return _counts(spark, sf_dir).select("ego_id", "alter_id", "shared", "union_claims", D.similarity(F.col("shared"), F.col("union_claims")).alias("similarity"))


@query(BASE.replace("from events group", "from events where ts < timestamp '2024-01-04 00:00:00' group") + "select ego_id, alter_id, shared, union_claims from dyad")
def dyad_counts_of_first_days(spark, sf_dir):
    """The slice of the first build plan: events of three days."""
    reg, m = E.packed(spark, sf_dir, E.SLICE)
    return D.counts(D.pairs(m, reg), reg).select("ego_id", "alter_id", "shared", "union_claims")


@query("select ego_id, alter_id, repair_cost, node_conflicts, edge_conflicts, inapplicable_components from dyad")
def repair_cost(spark, sf_dir):
    return _counts(spark, sf_dir).select("ego_id", "alter_id", "repair_cost", "node_conflicts", "edge_conflicts", "inapplicable_components")


@query("select c as comp_id, 'node' as type, n as source, null::varchar as target from nreg union all select c, 'edge', s, d from reg")
def registry_pairs(spark, sf_dir):
    return E.registry(spark, sf_dir).frame(spark).select("comp_id", "type", "source", "target")


@query("select m as model_id, nreg.c as comp_id, 'present' as status, t as timing from node join nreg using (n) union all select m, c, case st when 1 then 'causal' when 2 then 'non-causal' else 'unknown' end, null from edge")
def claims_round_trip(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return M.unpack(m, reg)


@query("select m as model_id, count(*) as applicable, count(case when st = 1 then 1 end) as causal, count(case when st = 2 then 1 end) as non_causal, count(case when st = 0 then 1 end) as unknown from edge group by m")
def applicability(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    from causeway.functions import bits

    n = reg.words
    return m.select("model_id", *(bits.count(w).cast("bigint").alias(k) for k, w in (("applicable", bits.words("app", n)), ("causal", bits.words("cm", n)), ("non_causal", bits.words("xm", n)), ("unknown", M.unknown(reg))))).where("applicable > 0")


@query("select c as comp_id, count(*) as models from edge where st = 0 group by c")
def unknown_edges(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return M.unknown_edges(m, reg).groupBy("comp_id").agg(F.count("*").alias("models"))


@query("select m as model_id, c as comp_id from edge where ts >= td")
def backward_edges(spark, sf_dir):
    """All edges claimed causal: those against time are found."""
    reg = E.registry(spark, sf_dir)
    edges = [r["comp_id"] for r in reg.edges]
    claims = E.claims(spark, sf_dir, reg).withColumn("status", F.when(F.col("comp_id").isin(edges), "causal").otherwise(F.col("status")))
    m = M.pack(claims, reg)
    return m.select("model_id", F.explode(M.backward_edges(reg)).alias("comp_id"))


@query(
    """, nl as (select m, list(nreg.c) ns, list(t) ts from node join nreg using (n) group by m),
el as (select m, list(c) app, coalesce(list(c) filter (where st = 1), []) cs, coalesce(list(c) filter (where st = 2), []) xs from edge group by m),
w as (select nl.m, ns, map(ns, ts) tm, coalesce(app, []) app, coalesce(cs, []) cs, coalesce(xs, []) xs from nl left join el using (m)),
allc as (select list(c order by c) cc from reg),
r as (select a.m e, b.m a, list_filter(cc, lambda c: not (list_contains(a.app, c) and list_contains(b.app, c))) ex,
  list_sort(list_concat(list_intersect(a.cs, b.xs), list_intersect(a.xs, b.cs))) ec, list_sort(list_concat(list_filter(a.ns, lambda n: not list_contains(b.ns, n)), list_filter(b.ns, lambda n: not list_contains(a.ns, n)))) nc,
  len(list_intersect(a.ns, b.ns)) + len(list_intersect(a.cs, b.cs)) + len(list_intersect(a.xs, b.xs)) sh,
  len(list_filter(a.app, lambda c: list_contains(b.app, c) and (list_contains(a.cs, c) or list_contains(a.xs, c) or list_contains(b.cs, c) or list_contains(b.xs, c)))) un,
  len(a.app) + len(b.app) - 2 * len(list_intersect(a.app, b.app)) one, len(a.ns) + len(b.ns) - len(list_intersect(a.ns, b.ns)) nu,
  len(list_filter(list_intersect(a.ns, b.ns), lambda n: a.tm[n] <> b.tm[n])) late
  from w a join w b on a.m <> b.m cross join allc)
select e || '__' || a as dyad_id, late = 0 as timing_compatible, array_to_string(ex, ',') as excluded_components, array_to_string(list_concat(ec, nc), ',') as conflicting_components,
  sh::bigint as shared_resolved_claims, (nu + un + len(ec) + one)::bigint as union_resolved_claims, len(ec) + len(nc) > 0 as existence_conflict from r"""
)
def dyad_records(spark, sf_dir):
    """Each pair has an id of its own, which no dictionary shortens: see ``front_coded``, which sets how the session writes Parquet from here on."""
    reg, m = E.packed(spark, sf_dir)
    front_coded(spark)
    return D.all_pairs(m, reg, text=True).select("dyad_id", "timing_compatible", "excluded_components", "conflicting_components", "shared_resolved_claims", "union_resolved_claims", "existence_conflict")


@query("select ego_id, alter_id, shared, union_claims from dyad where ego_id = (select min(m) from models)")
def single_reference(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    first = m.agg(F.min("model_id")).first()[0]
    return D.single_reference(m, reg, first).select("ego_id", "alter_id", F.col("shared_resolved_claims").alias("shared"), F.col("union_resolved_claims").alias("union_claims"))


@query("select ego_id, alter_id, shared, union_claims from dyad where ego_id like '%7' or alter_id like '%7'")
def touching_pairs(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return D.touching(m, reg, m.where("model_id like '%7'")).select("ego_id", "alter_id", F.col("shared_resolved_claims").alias("shared"), F.col("union_resolved_claims").alias("union_claims"))


@query("select ego_id, alter_id, shared, union_claims from dyad union all select m, m, cast(nn.k + count(case when st > 0 then 1 end) as bigint), cast(nn.k + count(case when st > 0 then 1 end) as bigint) from models join nn using (m) left join edge using (m) group by m, nn.k")
def pair_matrix(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return D.counts(D.pairs(m, reg, itself=True), reg).select("ego_id", "alter_id", "shared", "union_claims")


@query("select ego_id, alter_id, shared, union_claims from dyad order by case when union_claims = 0 then 1.0 else shared / union_claims end desc, ego_id, alter_id limit 50")
def two_stage_top(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return D.two_stage(m, reg, 50).select("ego_id", "alter_id", F.col("shared_resolved_claims").alias("shared"), F.col("union_resolved_claims").alias("union_claims"))


@query("select m as model_id, count(*) as pairs, round(avg(shared / union_claims), 6) as mean_score from (select ego_id m, shared, union_claims from dyad union all select alter_id, shared, union_claims from dyad) group by m")
def model_means(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return A.of_models(m, reg).withColumn("mean_score", F.round("mean_score", 6))


@query("select count(*) as dyads, sum(shared)::bigint as shared, sum(union_claims)::bigint as union_claims, round(avg(shared / union_claims), 4) as mean_similarity from dyad")
def baseline(spark, sf_dir):
    return _counts(spark, sf_dir).agg(F.count("*").alias("dyads"), F.sum("shared").alias("shared"), F.sum("union_claims").alias("union_claims"), F.round(F.avg(F.col("shared") / F.col("union_claims")), 4).alias("mean_similarity"))


@query(
    """, sig as (select node.m, string_agg(n || ':' || t, ',' order by n) s from node group by node.m), open_ as (select m, count(case when st = 0 then 1 end) u from edge group by m)
select s.m as model_id, count(*) - 1 as duplicates, any_value(coalesce(u, 0)) = 0 as is_resolved, 1::bigint as expected, (any_value(coalesce(u, 0)) = 0)::bigint as represented, any_value(coalesce(u, 0)) = 0 as coverage_complete
from sig s join sig t on s.s = t.s left join open_ on open_.m = s.m group by s.m"""
)
def signature_twins(spark, sf_dir):
    """An edge open between events of one day can only be settled as non-causal, so each model has one completion; it is there where nothing is open."""
    reg, m = E.packed(spark, sf_dir)
    return S.diagnostics(m, reg).select("model_id", "duplicates", "is_resolved", F.col("expected").cast("bigint").alias("expected"), "represented", "coverage_complete")


@query(", k as (select distinct m, c, st from edge) select c as comp_id, count(*) as claims, count(case when st = 0 then 1 end) as unknown, count(case when st = 0 then 1 end) / count(*) as unknown_rate from k group by c")
def unknown_rates(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    edges = [r["comp_id"] for r in reg.edges]
    return U.unknown_rates(M.unpack(m, reg).where(F.col("comp_id").isin(edges)))


@query("select m as model_id, max(case when c = 'C0006' then (st = 1)::int else 0 end) as C0006, max(case when c = 'C0007' then (st = 1)::int else 0 end) as C0007, max(case when c = 'C0010' then (st = 1)::int else 0 end) as C0010, 'view' as outcome from models left join edge using (m) group by m")
def set_matrix(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return U.set_matrix(M.unpack(m, reg), "view", ["C0006", "C0007", "C0010"])


def _given_clusters(spark, sf_dir, m: DataFrame | None = None):
    m = E.packed(spark, sf_dir)[1] if m is None else m
    return m.select("model_id", F.concat(F.lit("Cluster_0"), (F.col("cm0") % 3 + 1).cast("string")).alias("cluster_id"))


_ASSIGN = """, bitsum as (select m, coalesce(sum(1 << (substr(c, 2)::int - 1)) filter (where st = 1), 0)::bigint b from models left join edge using (m) group by m), asg as (select m, 'Cluster_0' || cast(b % 3 + 1 as varchar) c from bitsum),
inner_ as (select a.c, avg(shared / union_claims) s from dyad join asg a on a.m = ego_id join asg b on b.m = alter_id and a.c = b.c group by 1)"""


@query(_ASSIGN + " select c as cluster_id, count(*) as model_count, round(coalesce(any_value(s), 0), 6) as internal_compatibility from asg left join inner_ using (c) group by c")
def cluster_summaries(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return A.summaries(m, reg, _given_clusters(spark, sf_dir, m)).withColumn("internal_compatibility", F.round("internal_compatibility", 6))


@query(
    _ASSIGN
    + """, prior as (select min(m) p from models), far as (select c, avg(shared / union_claims) s from dyad cross join prior join asg on (ego_id = p and asg.m = alter_id) or (alter_id = p and asg.m = ego_id) group by c),
t as (select c, count(*) n, coalesce(any_value(inner_.s), 0) i, coalesce(any_value(far.s), 0) f from asg left join inner_ using (c) left join far using (c) group by c)
select c as cluster_id, n as model_count, round(i, 6) as internal_compatibility, round(f, 6) as prior_compatibility, case when i < 0.3 then 'fragmented' when f < 0.27 then 'ghost' else 'mainstream' end as label from t"""
)
def ghost_contrast(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    prior = m.agg(F.min("model_id")).first()[0]
    return A.contrast(m, reg, _given_clusters(spark, sf_dir, m), prior, 0.3, 0.27).select("cluster_id", "model_count", F.round("internal_compatibility", 6).alias("internal_compatibility"), F.round("prior_compatibility", 6).alias("prior_compatibility"), "label")


@query(
    _ASSIGN
    + """, both_ as (select a.c, a.m, shared / union_claims s from dyad join asg a on a.m = ego_id join asg b on b.m = alter_id and a.c = b.c union all select a.c, b.m, shared / union_claims from dyad join asg a on a.m = ego_id join asg b on b.m = alter_id and a.c = b.c),
mean_ as (select c, m, avg(s) x from both_ group by 1, 2), r as (select c, m, row_number() over (partition by c order by case when n <= 3 then 0 else round(x, 9) end desc, m) k from (select *, count(*) over (partition by c) n from (select c, m, coalesce(x, 0) x from asg left join mean_ using (c, m))))
select c as cluster_id, m as model_id, k as place from r where k <= 3"""
)
def representatives(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return A.representatives(m, reg, _given_clusters(spark, sf_dir, m)).select("cluster_id", "model_id", F.col("place").cast("bigint").alias("place"))


def _closed(spark, sf_dir):
    """Every resolution of the distinct untimed hypotheses over three event types: closed under settling edges."""
    reg = E.registry(spark, sf_dir, ["click", "purchase", "view"], exposure=None, outcome=None)
    m = M.pack(E.claims(spark, sf_dir, reg), reg, timed=False).drop("model_id").distinct()
    out = m
    for r in reg.edges:
        b = reg.ordinal[r["comp_id"]]
        bit = F.lit(1 << b)
        open_ = (F.col("app0").bitwiseAND(bit) != 0) & (F.col("cm0").bitwiseOR(F.col("xm0")).bitwiseAND(bit) == 0)
        pick = F.when(open_, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
        out = out.withColumn("p", F.explode(pick)).withColumns({"cm0": F.when(F.col("p") == 1, F.col("cm0").bitwiseOR(bit)).otherwise(F.col("cm0")), "xm0": F.when(F.col("p") == 2, F.col("xm0").bitwiseOR(bit)).otherwise(F.col("xm0"))}).drop("p")
    out = out.distinct().withColumn("model_id", F.format_string("%02d_%02d_%02d", "np0", "cm0", "xm0"))
    return reg, out.select("model_id", *m.columns)


_CLOSED = """
with node as (select user_id m, event_type n, min(date_diff('day', timestamp '2024-01-01 00:00:00', ts)) t from events where event_type in ('click', 'purchase', 'view') group by 1, 2),
w as (select m, max(case when n = 'click' then t end) a, max(case when n = 'purchase' then t end) b, max(case when n = 'view' then t end) c from node group by m),
sig as (select distinct (a is not null)::int pa, (b is not null)::int pb, (c is not null)::int pc,
  case when a is null or b is null then '-' when a < b then 'c' when a > b then 'n' else 'u' end e1, case when a is null or c is null then '-' when a < c then 'c' when a > c then 'n' else 'u' end e2,
  case when b is null or c is null then '-' when b < c then 'c' when b > c then 'n' else 'u' end e3 from w),
res(f, r) as (values ('u', 'u'), ('u', 'c'), ('u', 'n'), ('c', 'c'), ('n', 'n'), ('-', '-')),
mdl as (select distinct pa, pb, pc, r1.r e1, r2.r e2, r3.r e3 from sig join res r1 on r1.f = e1 join res r2 on r2.f = e2 join res r3 on r3.f = e3),
idd as (select pa || '' || pb || pc || e1 || e2 || e3 id, * from mdl),
cs as (select x.id ego, y.id alter_id,
  (x.pa & y.pa) + (x.pb & y.pb) + (x.pc & y.pc) + (x.e1 = y.e1 and x.e1 in ('c', 'n'))::int + (x.e2 = y.e2 and x.e2 in ('c', 'n'))::int + (x.e3 = y.e3 and x.e3 in ('c', 'n'))::int shared,
  (x.pa | y.pa) + (x.pb | y.pb) + (x.pc | y.pc)
  + case when (x.e1 = '-') <> (y.e1 = '-') then 1 when x.e1 = '-' or (x.e1 = 'u' and y.e1 = 'u') then 0 when x.e1 <> y.e1 and x.e1 <> 'u' and y.e1 <> 'u' then 2 else 1 end
  + case when (x.e2 = '-') <> (y.e2 = '-') then 1 when x.e2 = '-' or (x.e2 = 'u' and y.e2 = 'u') then 0 when x.e2 <> y.e2 and x.e2 <> 'u' and y.e2 <> 'u' then 2 else 1 end
  + case when (x.e3 = '-') <> (y.e3 = '-') then 1 when x.e3 = '-' or (x.e3 = 'u' and y.e3 = 'u') then 0 when x.e3 <> y.e3 and x.e3 <> 'u' and y.e3 <> 'u' then 2 else 1 end uni
  from idd x cross join idd y),
mv(e, st) as (values (1, 'c'), (1, 'n'), (2, 'c'), (2, 'n'), (3, 'c'), (3, 'n')),
flip as (select e, st, id, case when substr(id, 3 + e, 1) = 'u' then substr(id, 1, 2 + e) || st || substr(id, 4 + e) else id end src from idd cross join mv),
g as (select id, replace(substr(id, 4), 'u', 'c') src, substr(id, 1, 3) || replace(substr(id, 4), 'u', 'c') csrc, substr(id, 1, 3) || replace(substr(id, 4), 'u', 'n') nsrc from idd)
"""


@query(
    _CLOSED
    + """select 'C000' || (3 + f.e) as component_id, case f.st when 'c' then 'causal' else 'non-causal' end as status,
  sum(case when post.shared * base.uni > base.shared * post.uni then 1 else 0 end)::bigint as dyads_improved, sum(case when post.shared * base.uni < base.shared * post.uni then 1 else 0 end)::bigint as dyads_worsened,
  round(avg(post.shared / post.uni - base.shared / base.uni), 5) as delta
from flip f join flip g on f.e = g.e and f.st = g.st and f.id <> g.id join cs base on base.ego = f.id and base.alter_id = g.id join cs post on post.ego = f.src and post.alter_id = g.src group by f.e, f.st"""
)
def marginal_crux(spark, sf_dir):
    reg, m = _closed(spark, sf_dir)
    crux = Crux(m, reg)
    e = crux.effects([(f"{c}|{s}", {c: s}) for c in crux.uncertain() for s in ("causal", "non-causal")])
    return e.select(F.substring_index("move", "|", 1).alias("component_id"), F.substring_index("move", "|", -1).alias("status"), "dyads_improved", "dyads_worsened", F.round("delta", 5).alias("delta"))


@query(
    _CLOSED
    + """select 'causal' as status, sum(case when p.shared * b.uni > b.shared * p.uni then 1 else 0 end)::bigint as dyads_improved, sum(case when p.shared * b.uni < b.shared * p.uni then 1 else 0 end)::bigint as dyads_worsened, round(avg(p.shared / p.uni - b.shared / b.uni), 5) as delta
from g x join g y on x.id <> y.id join cs b on b.ego = x.id and b.alter_id = y.id join cs p on p.ego = x.csrc and p.alter_id = y.csrc
union all select 'non-causal', sum(case when p.shared * b.uni > b.shared * p.uni then 1 else 0 end)::bigint, sum(case when p.shared * b.uni < b.shared * p.uni then 1 else 0 end)::bigint, round(avg(p.shared / p.uni - b.shared / b.uni), 5)
from g x join g y on x.id <> y.id join cs b on b.ego = x.id and b.alter_id = y.id join cs p on p.ego = x.nsrc and p.alter_id = y.nsrc"""
)
def global_crux(spark, sf_dir):
    reg, m = _closed(spark, sf_dir)
    e = Crux(m, reg).effects([(s, {r["comp_id"]: s for r in reg.edges}) for s in ("causal", "non-causal")])
    return e.select(F.col("move").alias("status"), "dyads_improved", "dyads_worsened", F.round("delta", 5).alias("delta"))


@query()
def profile_layout(spark, sf_dir):
    """Models laid out so that like profiles stay neighbours."""
    reg, m = E.packed(spark, sf_dir)
    return A.umap(m, reg)


@query(
    """, k as (select m, string_agg(n, ',' order by n) ns from node group by 1), e as (select m, string_agg(st::varchar, '' order by c) p from edge group by 1),
a as (select k.m, ns, coalesce(p, '') p from k left join e using (m)), r as (select distinct ns, p rp from a where p not like '%0%')
select a.m as model_id, power(2, length(p) - length(replace(p, '0', '')))::bigint as expected, count(rp) as represented from a left join r on r.ns = a.ns and rp like replace(p, '0', '_') group by a.m, a.p"""
)
def completion_coverage(spark, sf_dir):
    """Each model's ways to settle its open edges if days told nothing, and how many of them are resolved models."""
    reg, m = E.packed(spark, sf_dir)
    free = m.withColumn("timing", F.transform("timing", lambda t: F.lit(None).cast("int")))
    return S.coverage(free, reg).select("model_id", F.col("expected").cast("bigint").alias("expected"), "represented")


@query(
    _CLOSED
    + """select e.pa || '' || e.pb || e.pc || e.e1 || e.e2 || e.e3 as model, case when e.e1 = 'u' or e.e2 = 'u' or e.e3 = 'u' then null when e.e1 = 'c' and e.e2 = 'c' then 'click' else '' end as adjustment_sets
from idd e where e.pb = 1 and e.pc = 1 and e.e1 <> 'u' and e.e2 <> 'u' and e.e3 <> 'u'"""
)
def adjustment_sets(spark, sf_dir):
    """Minimal adjustment sets for purchase -> view: click confounds if it causes both."""
    reg, m = _closed(spark, sf_dir)
    p = P.build(m, reg, "purchase", "view").where("is_resolved and mas is not null")
    return _lettered(m, reg).join(p, "model_id").select("model", F.concat_ws("|", F.transform("mas", lambda z: F.concat_ws(",", z))).alias("adjustment_sets"))


def _lettered(m: DataFrame, reg: R.Registry) -> DataFrame:
    """(model_id, model): what a model claims, a letter a component."""
    at = {r["comp_id"]: reg.ordinal[r["comp_id"]] for r in reg.rows}
    letter = F.concat(*(F.when(F.col("np0").bitwiseAND(F.lit(1 << at[r["comp_id"]])) != 0, "1").otherwise("0") for r in reg.nodes), *(F.when(F.col("app0").bitwiseAND(F.lit(1 << at[r["comp_id"]])) == 0, "-").when(F.col("cm0").bitwiseAND(F.lit(1 << at[r["comp_id"]])) != 0, "c").when(F.col("xm0").bitwiseAND(F.lit(1 << at[r["comp_id"]])) != 0, "n").otherwise("u") for r in reg.edges))
    return m.select("model_id", letter.alias("model"))


@query()
def profile_clusters(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return C.named(C.dbscan(A.embed(m, reg), 0.3, 4))


@query(
    _ASSIGN
    + """, lab(c, l) as (values ('Cluster_01', 'mainstream'), ('Cluster_03', 'ghost')), o as (select asg.m, asg.c, coalesce(l, 'unknown') l from asg left join lab using (c)),
r as (select *, row_number() over (order by case l when 'ghost' then 0 when 'mainstream' then 1 else 4 end, c, m) k from o), e as (select c, l, max(k) + 0.5 x from r group by 1, 2)
select c as cluster_id, l as label, x::double as position from e where x < (select max(x) from e)"""
)
def cluster_breaks(spark, sf_dir):
    labels = spark.createDataFrame([("Cluster_01", "mainstream"), ("Cluster_03", "ghost")], "cluster_id string, label string")
    return U.cluster_breaks(U.cluster_order(_given_clusters(spark, sf_dir), labels))


@query(
    _CLOSED
    + """select e.pa || '' || e.pb || e.pc || e.e1 || e.e2 || e.e3 as model, 'P(view | do(purchase)) = ' || case when e.e1 = 'c' and e.e2 = 'c' then 'sum_{click} P(view | purchase, click) P(click)' else 'P(view | purchase)' end as formula, 'back-door' as method
from idd e where e.pb = 1 and e.pc = 1 and e.e1 <> 'u' and e.e2 <> 'u' and e.e3 <> 'u'"""
)
def identified_effects(spark, sf_dir):
    """Formulas of the effect purchase -> view in every resolved hypothesis."""
    reg, m = _closed(spark, sf_dir)
    p = P.build(m, reg, "purchase", "view").where("is_resolved and identified")
    return _lettered(m, reg).join(p, "model_id").select("model", "formula", "method")


_F2 = [{"name": "Z", "timing": 1}, {"name": "X", "timing": 2}, {"name": "Y", "timing": 3}]


@query(
    """with s(i, st) as (values (0, 'causal'), (1, 'unknown'), (2, 'non-causal')),
m as (select 'M000' || cast(a.i * 3 + b.i + 1 as varchar) id, a.st x, b.st y from s a cross join s b)
select id as model_id, c as comp_id, st as status, t as timing from (select id, 'C0001' c, 'present' st, 1 t from m union all select id, 'C0002', 'present', 2 from m union all select id, 'C0003', 'present', 3 from m
union all select id, 'C0004', x, null from m union all select id, 'C0005', y, null from m union all select id, 'C0006', 'causal', null from m)"""
)
def exhaustive_expansion(spark, sf_dir):
    from causeway.operators import expansion

    return expansion.exhaustive(spark, R.build(_F2, exposure="X", outcome="Y"))


@query("select 50::bigint as models, 50::bigint as different, 50 * 5::bigint as nodes, 50 * 5 * 4::bigint as edges, 0::bigint as cycles")
def sampled_expansion_check(spark, sf_dir):
    """What holds of any sample: so many different models, each with every node and edge claimed once, none with a cycle."""
    from causeway.operators import expansion

    reg = R.build([{"name": n} for n in "ABCDE"])
    c = expansion.sampled(spark, reg, 50, seed=7)
    m = M.pack(c, reg)
    edges = [r["comp_id"] for r in reg.edges]
    rows = c.distinct().agg(F.count_if(~F.col("comp_id").isin(edges)).alias("nodes"), F.count_if(F.col("comp_id").isin(edges)).alias("edges"))
    models = m.agg(F.count("*").alias("models"), F.count_distinct(M.signature(reg)).alias("different"))
    return models.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(P.cyclic(m, reg).agg(F.count("*").alias("cycles"))))  # a row each


@query()
def sampled_expansion(spark, sf_dir):
    from causeway.operators import expansion

    return expansion.sampled(spark, R.build([{"name": n} for n in "ABCDE"]), 50, seed=7)


@query(
    """with a as (select i, i & 1 > 0 ab, i & 2 > 0 ax, i & 4 > 0 ay, i & 8 > 0 bx, i & 16 > 0 by_, i & 32 > 0 xy from range(64) q(i)),
c as (select xy, (ax and ay) or (bx and by_) or (ax and ab and by_) or (bx and ab and ay) open_ from a)
select xy as direct_effect_edge_present, open_ as open_backdoor_under_empty, not open_ as empty_adjustment_valid, count(*) as mass from c group by 1, 2"""
)
def symbolic_masses(spark, sf_dir):
    from causeway.plans import formulas, symbolic

    u = symbolic.from_nodes([{"name": n, "timing": i} for i, n in enumerate("ABXY")], "X", "Y")
    by = ["direct_effect_edge_present", "open_backdoor_under_empty", "empty_adjustment_valid"]
    return symbolic.query_classes(spark, u, formulas.TRUE).groupBy(*by).agg(F.sum("mass").alias("mass"))


@query(
    """with a as (select i & 1 > 0 ab, i & 2 > 0 xc, i & 4 > 0 cd from range(8) q(i)),
k as (select *, ab as open_, xc as forbidden, ab::int as least from a),
e as (select 'e__A__B' c, 0 o, ab as there, * from k union all select 'e__X__C', 1, xc, * from k union all select 'e__C__D', 2, cd, * from k),
g as (select c, o, there, open_, forbidden, least, ab, xc, count(*) n from e group by all),
h as (select c, there, sum(n) t, -sum(n / tt * log2(n / tt)) h from (select *, sum(n) over (partition by c, there) tt from g) group by 1, 2),
g0 as (select c, o, open_, forbidden, least, ab, xc, count(*) n from e group by all), h0 as (select c, any_value(o) o, -sum(n / tt * log2(n / tt)) h from (select *, sum(n) over (partition by c) tt from g0) group by 1),
r as (select h0.c, o, h0.h b, p.h hp, m.h hm from h0 join h p on p.c = h0.c and p.there join h m on m.c = h0.c and not m.there)
select c as component_id, b + 0.0 as baseline_entropy, hp + 0.0 as entropy_if_present, hm + 0.0 as entropy_if_absent, greatest(b - hp, b - hm, 0) + 0.0 as delta_u, case when b - hp >= b - hm then 'present' else 'absent' end as best_resolution, true as exact,
  row_number() over (order by greatest(b - hp, b - hm, 0) desc, o) as rank from r"""
)
def symbolic_crux(spark, sf_dir):
    """Classes differ by the open back door (A -> B), what the exposure causes (X -> C) and those edges; C -> D tells nothing."""
    from causeway.plans import symbolic

    u = symbolic.paper_small()
    c, _ = symbolic.constraints(u, absent=[e for e in u.edges if e not in u.fixed and e not in (("C", "D"), ("X", "C"), ("A", "B"))])
    return symbolic.crux(spark, u, c).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    """with a as (select i, i & 1 > 0 ab, i & 2 > 0 ax, i & 4 > 0 ay, i & 8 > 0 bx, i & 16 > 0 by_, i & 32 > 0 xy from range(64) q(i)),
c as (select (ax and ay) or (ax and ab and by_) aopen, (bx and by_) or (bx and ab and ay) bopen, * from a),
v as (select not (aopen or bopen) z0, not (bx and by_) za, not (ax and ay) zb from c)
select count(*) as mass, true as possibly_identifiable, true as necessarily_identifiable, count(*) as identifiable_mass, bool_or(z0) as empty_adjustment_valid, 1.0::double as proportion,
  count(case when z0 then 1 end) as empty_valid_mass, count(case when za then 1 end) as with_a_mass, count(case when zb then 1 end) as with_b_mass from v"""
)
def symbolic_signature(spark, sf_dir):
    """What an adjustment for both others, one or none of them does over all graphs of four nodes."""
    from causeway.plans import formulas, symbolic

    u = symbolic.from_nodes([{"name": n, "timing": i} for i, n in enumerate("ABXY")], "X", "Y")
    index = symbolic.Index(u)
    s = symbolic.space(spark, u, formulas.TRUE)
    mass = lambda *z: F.count_if(s.column(index.valid[frozenset(z)]))
    counts = s.df.agg(mass().alias("empty_valid_mass"), mass("A").alias("with_a_mass"), mass("B").alias("with_b_mass"))
    return symbolic.signature(spark, u, formulas.TRUE, index).drop("always_valid_sets", "sometimes_valid_sets", "exact").crossJoin(F.broadcast(counts))  # one row is broadcast


@query(
    """with a as (select i, i & 1 ab, i >> 1 & 1 ax, i >> 2 & 1 ay, i >> 3 & 1 bx, i >> 4 & 1 by_, i >> 5 & 1 xy from range(64) q(i))
select 'edges' as bound, count(*)::bigint as mass from a where ab + ax + ay + bx + by_ + xy <= 2 union all select 'into', count(*) from a where ab <= 1 and ax + bx <= 1 and ay + by_ + xy <= 1
union all select 'out', count(*) from a where ab + ax + ay <= 1 and bx + by_ <= 1"""
)
def symbolic_bounds(spark, sf_dir):
    """Graphs of four nodes with few edges, all in all and at each node: counted by diagrams."""
    from causeway.plans import symbolic

    u = symbolic.from_nodes([{"name": n, "timing": i} for i, n in enumerate("ABXY")], "X", "Y")
    rows = [("edges", symbolic.sparse(u, 2)), ("into", symbolic.sparse(u, most_into=1)), ("out", symbolic.sparse(u, most_out=1))]
    return spark.createDataFrame([(n, symbolic.count(u, f)) for n, f in rows], "bound string, mass long")


@query(
    """with r as (select i from range(128) q(i)), models as (select i, false partial from r union all select i * 2, true from range(64) q(i)),
pairs as (select a.i x, a.partial px, b.i y, b.partial py from models a join models b on (a.i, a.partial) <> (b.i, b.partial))
select 'mas_compatible' as metric, count(*) as dyads, count(case when not px and not py and x & 31 = y & 31 then 1 end) as compatible from pairs
union all select 'identified_compatible', count(*), count(case when not px and not py and x & 1 = 0 and y & 1 = 0 then 1 end) from pairs"""
)
def precision_illusion(spark, sf_dir):
    """Pairs that agree: by the five edges into the exposure, which are its confounders', or by both lacking the direct edge; partial models agree with none."""
    from causeway.plans import scenarios

    rows = [scenarios.illusion_result(spark, m) for m in ("mas_compatible", "identified_compatible")]
    return spark.createDataFrame([(r["metric"], r["dyads"], r["compatible_dyads"]) for r in rows], "metric string, dyads long, compatible long")


@query()
def ghost_scenario(spark, sf_dir):
    from causeway.plans import scenarios

    return scenarios.ghost_result(spark)


@query(
    """with g as (select i, i & 1 > 0 ab, i >> 1 & 1 > 0 at_, i >> 2 & 1 > 0 ay, i >> 3 & 1 > 0 bt, i >> 4 & 1 > 0 by_ from range(32) q(i)),
p as (select *, ab or at_ or ay as ua, ab or bt or by_ as ub, at_ and ay p1, bt and by_ p2, at_ and ab and by_ p3, bt and ab and ay p4 from g),
f as (select i, 'Y ~ ' || case when ay then 'X1 + ' else '' end || case when by_ then 'X2 + ' else '' end || 'Xtest' || case when ua then '' else ', X1 ~ X1' end || case when ab then ', X2 ~ X1' when ub then '' else ', X2 ~ X2' end
    || case when at_ and bt then ', Xtest ~ X1 + X2' when at_ then ', Xtest ~ X1' when bt then ', Xtest ~ X2' else '' end as formula,
  not (p1 or p2 or p3 or p4) z0, not (p2) za, not (p1) zb, case when ua then 'X1_' else '' end || case when ub then 'X2_' else '' end || 'Xtest_Y' nodes from p),
m as (select i + 1 as model, formula, case when z0 then '' else array_to_string(list_filter([case when za then 'X1' end, case when zb then 'X2' end, case when not za and not zb then 'X1,X2' end], lambda x: x is not null), '|') end mas, nodes from f
  union all select 33, 'Y ~ X1 + Xtest, X1 ~ X2', '', 'X1_X2_Xtest_Y' union all select 34, 'Y ~ Xtest, X1 ~ X1', '', 'Xtest_Y'),
s as (select *, case when mas = '' then ['none'] else string_split(mas, '|') end sets from m), ref as (select sets rs, nodes rn from s where model = 1)
select model::int as model, formula, mas, 'yes' as correct_test, nodes as unq_nodes, case when model = 1 then 'reference model' when list_has_any(sets, rs) then 'compatible' else 'incompatible' end as test_compatible,
  case when model = 1 then 'reference model' when nodes = rn then 'compatible' else 'incompatible' end as full_model_compatible from s cross join ref"""
)
def older_workflow(spark, sf_dir):
    """Every choice of five edges among two controls, a test and its outcome, and two models of the user's that are not among them."""
    from causeway.plans import legacy

    edges = legacy.build_causal_node(spark, ["Y", "Xtest", "X1", "X2"], [0, -1, -3, -2], ["otc", "test", "ctr", "ctr"], ["Y ~ X1 + Xtest; X1 ~ X2", "Y ~ Xtest; X2 ~ X1", "Y ~ Xtest; X1 ~ X1"])
    out = legacy.add_compatible(legacy.build_formula_matrix(edges, ["X1", "X2", "Xtest", "Y"]))
    return out.withColumn("mas", F.concat_ws("|", F.transform("mas", lambda z: F.concat_ws(",", z))))


@query(
    """, k as (select m, c, st from edge), cr as (select c, row_number() over (order by sum((st = 0)::int) / count(*) desc, c) o from k group by c), mr as (select m, row_number() over (order by sum((st = 0)::int) / count(*) desc, m) o from k group by m)
select m as model_id, c as comp_id, case st when 1 then 'causal' when 2 then 'non-causal' else 'unknown' end as status, cr.o as component_order, mr.o as model_order from k join cr using (c) join mr using (m)"""
)
def status_heatmap(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    claims = M.unpack(m, reg).where(F.col("comp_id").isin([r["comp_id"] for r in reg.edges]))
    return U.status_heatmap(claims).withColumns({c: F.col(c).cast("bigint") for c in ("component_order", "model_order")})


# --- states, summaries and frames ---


@query("select m as model_id, c as comp_id, case st when 1 then 1 when 2 then 2 else 0 end::int as code from edge union all select m, c, 1 from node join nreg using (n)")
def sparse_codes(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return M.codes(M.unpack(m, reg))


@query(
    """, every_ as (select c, n, null::varchar s from nreg union all select c, null, s from reg)
select m as model_id, every_.c as comp_id, case when every_.n is not null then case when node.m is null then 'absent' else 'present' end when edge.c is null then null when st = 1 then 'causal' when st = 2 then 'non-causal' else 'unknown' end as status, node.t as timing
from models cross join every_ left join node using (m, n) left join edge using (m, c)"""
)
def dense_records(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return M.unpack(m, reg, dense=True)


@query("select m as model_id, c as comp_id, 'unknown' as status from models cross join (select c from nreg union all select c from reg)")
def unknown_states(spark, sf_dir):
    reg, m = E.packed(spark, sf_dir)
    return M.create(m.select("model_id"), reg).drop("timing")


@query("select c as comp_id, count(case when st = 0 or m like '%7' then 1 end) as unknown, count(case when st = 1 and m not like '%7' then 1 end) as causal from edge group by c")
def changed_states(spark, sf_dir):
    """All edges of some models set to unknown."""
    reg, m = E.packed(spark, sf_dir)
    claims, edges = M.unpack(m, reg), [r["comp_id"] for r in reg.edges]
    changes = claims.where(F.col("comp_id").isin(edges) & F.col("model_id").like("%7")).select("model_id", "comp_id", F.lit("unknown").alias("status"))
    own = M.set_status(claims, changes, reg).where(F.col("comp_id").isin(edges))
    return own.groupBy("comp_id").agg(F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_if(F.col("status") == "causal").alias("causal"))


@query("select count(*) as total, count(n) as nodes, count(s) as edges, count(s) as directed, 0::bigint as bidirected from (select n, null::varchar s from nreg union all select null, s from reg)")
def registry_summary(spark, sf_dir):
    r = E.registry(spark, sf_dir).summary()
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} long" for k in r))


@query(_CLOSED + "select id as model, power(2, (e1 = 'u')::int + (e2 = 'u')::int + (e3 = 'u')::int)::bigint as completions from idd")
def completion_counts(spark, sf_dir):
    """Every way to settle three edges that can't run in a circle."""
    reg, m = _closed(spark, sf_dir)
    return S.completions(m, reg).groupBy("model_id").agg(F.count("*").alias("completions")).join(_lettered(m, reg), "model_id").select("model", "completions")


@query(_CLOSED + ", part as (select * from idd where e1 = 'u' or e2 = 'u' or e3 = 'u') select count(distinct (pa, pb, pc, a.r, b.r, c.r)) as support_models from part join res a on a.f = e1 join res b on b.f = e2 join res c on c.f = e3 where a.r <> 'u' and b.r <> 'u' and c.r <> 'u'")
def completion_support(spark, sf_dir):
    """Models to be added so that partial ones alone are closed under completion."""
    reg, m = _closed(spark, sf_dir)
    partial = m.join(S.diagnostics(m, reg).where("not is_resolved"), "model_id", "left_semi")
    return S.support(partial, reg).agg(F.count("*").alias("support_models"))


def _resolved_profiles(spark, sf_dir, exposure: str, outcome: str) -> DataFrame:
    reg, m = _closed(spark, sf_dir)
    return P.build(m, reg, exposure, outcome).where("is_resolved and mas is not null")


_SETTLED = ", done as (select *, case when e1 = 'c' and e2 = 'c' then 'click' else '' end z from idd where pb = 1 and pc = 1 and e1 <> 'u' and e2 <> 'u' and e3 <> 'u')"


@query(_CLOSED + _SETTLED + "select z as adjustment_set, count(*) as models, (count(*) * (count(*) - 1) / 2)::bigint as sole_in_pairs from done group by z")
def adjustment_prevalence(spark, sf_dir):
    return U.adjustment_prevalence(_resolved_profiles(spark, sf_dir, "purchase", "view"))


@query(_CLOSED + _SETTLED + ", k as (select z, count(*) n from done group by z) select string_agg('{' || z || '}', '; ' order by z) as most_common, max(n) as models, string_agg('{' || z || '}', '; ' order by z) as sole, (max(n) * (max(n) - 1) / 2)::bigint as sole_in_pairs from k where n = (select max(n) from k)")
def most_prevalent_sets(spark, sf_dir):
    return U.most_prevalent(U.adjustment_prevalence(_resolved_profiles(spark, sf_dir, "purchase", "view")))


@query(_CLOSED + _SETTLED + "select 'mas_compatible' as metric, count(*) as available, count(*) as pairs, count(case when a.z = b.z then 1 end) as compatible, count(case when a.z = b.z then 1 end) / count(*) as share from done a join done b on a.id <> b.id union all select 'identified_compatible', count(*), count(*), count(*), 1.0 from done a join done b on a.id <> b.id")
def compatibility_shares(spark, sf_dir):
    reg, m = _closed(spark, sf_dir)
    p = _resolved_profiles(spark, sf_dir, "purchase", "view")
    own = m.join(p, "model_id", "left_semi")
    return U.compatibility_share(P.compare(D.counts(D.pairs(own, reg), reg).select("ego_id", "alter_id"), p), "mas_compatible", "identified_compatible")


@query(_CLOSED + ", d as (select *, (e1 = 'c' and e3 = 'c') inner_ from idd where pa = 1 and pc = 1 and e1 <> 'u' and e2 <> 'u' and e3 <> 'u'), k as (select count(case when pb = 1 and not inner_ then 1 end) n, count(*) t from d) select 'purchase' as node, (n * (t - n))::bigint as pairs from k where n > 0 and n < t")
def missing_components(spark, sf_dir):
    """The effect click -> view: purchase counts where the effect doesn't run through it."""
    return U.missing_components(_resolved_profiles(spark, sf_dir, "click", "view"))


@query(_CLOSED + "select count(*) as models, count(*) as identified, 0::bigint as not_identified, 0::bigint as unavailable from idd where pb = 1 and pc = 1")
def identified_models(spark, sf_dir):
    reg, m = _closed(spark, sf_dir)
    return U.identified_models(P.build(m, reg, "purchase", "view").where("nodes is not null or is_resolved"))


@query(
    _CLOSED
    + """, x as (select f.e, f.st, avg(post.shared / post.uni - base.shared / base.uni) d from flip f join flip g on f.e = g.e and f.st = g.st and f.id <> g.id join cs base on base.ego = f.id and base.alter_id = g.id join cs post on post.ego = f.src and post.alter_id = g.src group by 1, 2),
y as (select c.e, c.d dc, n.d dn from x c join x n on n.e = c.e and n.st = 'n' where c.st = 'c')
select 'C000' || (3 + e) as component_id, round(greatest(dc, dn, 0), 5) as delta_u, case when round(dc, 6) >= round(dn, 6) then 'causal' else 'non-causal' end as best_resolution from y"""
)
def crux_ranking(spark, sf_dir):
    reg, m = _closed(spark, sf_dir)
    return Crux(m, reg).rank(None).select("component_id", F.round("delta_u", 5).alias("delta_u"), "best_resolution")


@query(
    _CLOSED
    + """, s as (select round(post.shared / post.uni, 9) - round(base.shared / base.uni, 9) d from flip f join flip g on f.e = 1 and g.e = 1 and f.st = 'c' and g.st = 'c' and f.id <> g.id join cs base on base.ego = f.id and base.alter_id = g.id join cs post on post.ego = f.src and post.alter_id = g.src)
select round(avg(d), 5) as mean_change, count(case when d > 1e-7 then 1 end) as improved, count(case when d < -1e-7 then 1 end) as worsened, count(case when abs(d) <= 1e-7 then 1 end) as unchanged from s"""
)
def crux_shift(spark, sf_dir):
    """Every pair's similarity before and after the first edge is settled as causal."""
    reg, m = _closed(spark, sf_dir)
    crux = Crux(m, reg)
    before = D.counts(D.pairs(m, reg), reg).select("ego_id", "alter_id", D.similarity(F.col("shared"), F.col("union_claims")).alias("score"))
    return U.shift_summary(U.shift(before, crux.resolved_pairs(reg.edges[0]["comp_id"], "causal"))).withColumn("mean_change", F.round("mean_change", 5))


@query(", g as (select m, round(1 - avg(shared / union_claims), 9) gap from (select ego_id m, shared, union_claims from dyad union all select alter_id, shared, union_claims from dyad) group by m) select m as name, round(gap, 6) as gap from g where gap >= (select quantile_cont(gap, 0.9) from g) order by g.gap desc, m limit 15")
def outlying_models(spark, sf_dir):
    """Models least like the others."""
    reg, m = E.packed(spark, sf_dir)
    g = A.of_models(m, reg).select(F.col("model_id").alias("name"), F.round(1 - F.col("mean_score"), 9).alias("gap"))
    return U.outliers(g).select("name", F.round("gap", 6).alias("gap"))


def _points(spark, sf_dir) -> DataFrame:
    """(model_id, x, y): causal and non-causal edges of each model."""
    from causeway.functions import bits

    reg, m = E.packed(spark, sf_dir)
    return m.select("model_id", *(bits.count(bits.words(k, reg.words)).cast("double").alias(a) for k, a in (("cm", "x"), ("xm", "y"))))


_POINTS = ", pts as (select m, count(case when st = 1 then 1 end)::double x, count(case when st = 2 then 1 end)::double y from models left join edge using (m) group by m)"


@query(_ASSIGN + _POINTS + "select asg.c as label, count(*) as models, round(avg(x), 9) as x, round(avg(y), 9) as y from asg join pts using (m) group by asg.c")
def label_centroids(spark, sf_dir):
    return U.label_centroids(_points(spark, sf_dir), _given_clusters(spark, sf_dir).withColumnRenamed("cluster_id", "label")).withColumns({c: F.round(c, 9) for c in "xy"})


@query(
    _POINTS
    + """, near as (select a.m u, b.m v from pts a join pts b on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1), core as (select u from near group by u having count(*) >= 6),
lk as (select distinct n.u, n.v from near n join core a on a.u = n.u join core b on b.u = n.v),
hop1 as (select distinct a.u, b.v from lk a join lk b on a.v = b.u), hop2 as (select distinct a.u, b.v from hop1 a join hop1 b on a.v = b.u), hop4 as (select distinct a.u, b.v from hop2 a join hop2 b on a.v = b.u), hop8 as (select distinct a.u, b.v from hop4 a join hop4 b on a.v = b.u),
lab as (select u, min(v) l from hop8 group by u), num as (select l, dense_rank() over (order by l) - 1 k from (select distinct l from lab)), own as (select u, k from lab join num using (l)),
border as (select n.u, min(k) k from near n join own on own.u = n.v where n.u not in (select u from core) group by n.u)
select m as model_id, coalesce(own.k, border.k)::int as cluster from pts left join own on own.u = m left join border on border.u = m"""
)
def density_clusters(spark, sf_dir):
    """Models by their numbers of causal and non-causal edges: a grid of at most some ten steps, so sixteen links reach everywhere."""
    return C.dbscan(_points(spark, sf_dir), 1.0, 6)


@query(
    """, spot as (select n, (i - (k + 1) / 2.0) * 1.5 y from names)
select m as model_id, c as comp_id, s as source, d as target, case st when 1 then 'causal' else 'unknown' end as status, case st when 1 then 'solid' else 'dashed' end as line, 0.0::double as x, a.y::double as y, 0.0::double as xend, b.y::double as yend
from edge join spot a on a.n = s join spot b on b.n = d where st < 2"""
)
def drawn_edges(spark, sf_dir):
    """Nodes without times lie on one line."""
    from causeway.plans import frames

    reg, m = E.packed(spark, sf_dir)
    return frames.model_edges(M.unpack(m, reg), reg).drop("direction")


@query(
    """with s(i, st) as (values (0, 'causal'), (1, 'unknown'), (2, 'non-causal')), m as (select a.i * 3 + b.i + 1 k, a.st x, b.st y from s a cross join s b)
select case k when 1 then 'S1' else 'M000' || k end as model_id, x as first_edge, y as second_edge, k = 1 as seeded from m"""
)
def seeded_expansion(spark, sf_dir):
    """A seed that claims all edges causal takes the first model's place; the others are numbered on."""
    from causeway.operators import expansion

    reg = R.build(_F2, exposure="X", outcome="Y")
    seed = R.claims_frame(spark, [{"model_id": "S1", "comp_id": c, "status": "causal"} for c in ("C0004", "C0005", "C0006")])
    out = expansion.expand(spark, reg, "exhaustive", seeds=seed).claims
    of = lambda c: F.max(F.when(F.col("comp_id") == c, F.col("status")))
    return out.groupBy("model_id").agg(of("C0004").alias("first_edge"), of("C0005").alias("second_edge"), F.bool_or("seeded").alias("seeded"))


@query("with g as (select i, i & 1 ab, i >> 1 & 1 ac, i >> 2 & 1 ba, i >> 3 & 1 bc, i >> 4 & 1 ca, i >> 5 & 1 cb from range(64) q(i)) select count(*) as projected, count(case when not circle then 1 end) as generated, count(case when circle then 1 end) as pruned_cycles from (select ab = 1 and ba = 1 or ac = 1 and ca = 1 or bc = 1 and cb = 1 or ab = 1 and bc = 1 and ca = 1 or ac = 1 and cb = 1 and ba = 1 as circle from g)")
def expansion_report(spark, sf_dir):
    """Graphs of three nodes without a circle."""
    from causeway.operators import expansion

    r = expansion.expand(spark, R.build([{"name": n} for n in "ABC"]), "exhaustive", edge_statuses=("causal", "non-causal")).report
    return spark.createDataFrame([(r["projected"], r["generated"], r["pruned_cycles"])], "projected long, generated long, pruned_cycles long")
