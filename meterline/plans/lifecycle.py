"""Queries over actions, identities, recovery, response timing and rates, with their DuckDB SQL."""

from pyspark.sql import functions as F

from meterline.operators import lifecycle, workflow
from meterline.plans.registry import HOUR, WINDOW_US, query, signed_in
from meterline.operators import reviewer
from meterline.plans.registry import PRICED, TURN_US, priced
from meterline.plans.reviewing import ANNOUNCED_US
from meterline.sources.telemetry import TELEMETRY_SQL, telemetry


COSTED = f"""{PRICED}, pol as (select *, case when sign_in = 'api' then 'outside_scope' when us < {TURN_US} then 'historical' when us < {ANNOUNCED_US} then 'transition'
  when sign_in = 'subscription' then 'free' else 'unknown' end policy from priced where reviewer)"""


def costed(spark, sf_dir):
    """Priced reviewer rows with their policy status."""
    return reviewer.policy_status(signed_in(priced(spark, sf_dir)).where("reviewer"), TURN_US, ANNOUNCED_US)


@query(f"""with {TELEMETRY_SQL}, a as (select source, model kind, us, case when k % 7 <> 0 then 'c' || (k % 20) else 't' || us end as key, case when line % 5 <> 0 then 'n' || (line % 5) end target, effort from tel)
select source, kind, key, min(us) first_us, count(*) records, coalesce(string_agg(distinct target, ',' order by target), '') targets, count(distinct effort) > 1 name_conflict from a group by 1, 2, 3""")
def dedupe_actions(spark, sf_dir):
    d = telemetry(spark, sf_dir).select(
        "source", F.col("model").alias("kind"), "us", F.col("effort").alias("name"), F.when(F.col("k") % 7 != 0, (F.col("k") % 20).cast("string")).alias("call_id"),
        F.when(F.col("line") % 5 != 0, F.concat(F.lit("n"), F.col("line") % 5)).alias("target"),
    )
    return lifecycle.dedupe_actions(d).withColumn("targets", F.array_join("targets", ","))


@query(f"""with {TELEMETRY_SQL} select c.line, count(r.line) results, min(r.line) first_result from tel c left join tel r on r.source = c.source and r.k // 4 = c.k // 4 and r.k % 4 > 1
  where c.k % 4 < 2 group by c.line""")
def join_results(spark, sf_dir):
    d = telemetry(spark, sf_dir).withColumn("call_id", F.expr("k div 4"))
    return lifecycle.join_results(d.where("k % 4 < 2").select("source", "call_id", "line"), d.where("k % 4 > 1")).select("line", "results", "first_result")


@query(f"""with {TELEMETRY_SQL}, a as (select *, ['trusted', 'diagnostic', 'unresolved'][k % 3 + 1] state from tel)
select model kind, state, effort as method, count(*) actions, (select count(*) from (select distinct source from a b where b.model = a.model and b.state = a.state and b.effort is not distinct from a.effort)) sources
  from a group by model, state, effort""")
def action_coverage(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, ("trusted", "diagnostic", "unresolved"))), F.col("k") % 3 + 1)
    d = telemetry(spark, sf_dir).select("source", F.col("model").alias("kind"), state.alias("state"), F.col("effort").alias("method"))
    return lifecycle.action_coverage(d)


@query(f"""with {TELEMETRY_SQL}, n as (select distinct source node from tel), c as (select distinct source node, k % 25 basis, source // case when k < 60 then 3 else 2 end parent, effort as role from tel),
p as (select node, any_value(basis) basis, case when count(distinct parent) = 1 then max(parent) end parent from c where not exists (select 1 from c o where o.node = c.node and o.basis < c.basis) group by node),
r as (select node, any_value(basis) basis, case when count(distinct role) = 1 then max(role) end as role from c where role is not null and not exists (select 1 from c o where o.node = c.node and o.role is not null and o.basis < c.basis) group by node)
select n.node, p.parent, p.basis, r.role, r.basis role_basis, case when p.node is null then 'unresolved' when p.parent is null then 'conflict' end issue, case when r.node is null then 'unresolved' when r.role is null then 'conflict' end role_issue
  from n left join p on p.node = n.node left join r on r.node = n.node""")
def resolve_identity(spark, sf_dir):
    d = telemetry(spark, sf_dir).withColumnRenamed("source", "node")
    parent = F.when(F.col("k") < 60, F.expr("node div 3")).otherwise(F.expr("node div 2"))
    claims = d.select("node", (F.col("k") % 25).alias("rank"), parent.alias("parent"), F.col("effort").alias("role"))
    return lifecycle.resolve_identity(d.select("node").distinct(), claims)


@query("""with recursive e as (select distinct user_id child, (user_id * user_id + 1) % 11 parent from events where user_id > 0),
r as (select child, parent a from e union select r.child, e.parent from r join e on e.child = r.a)
select child, case when c then null else parent end parent, c on_cycle from (select *, exists (select 1 from r where r.child = e.child and r.a = e.child) c from e)""")
def reject_cycles(spark, sf_dir):
    d = telemetry(spark, sf_dir).where("source > 0").select(F.col("source").alias("child")).distinct()
    return lifecycle.reject_cycles(d.withColumn("parent", (F.col("child") * F.col("child") + 1) % 11)).select("child", "parent", "on_cycle")


@query(f"""with {TELEMETRY_SQL} select coalesce(case when source % 5 > 0 then 'u' || (source % 3) end, 'unattributed') unit, coalesce(effort, 'unattributed') as role, count(*) requests,
  sum(input + output)::bigint tokens from tel group by 1, 2""")
def unit_totals(spark, sf_dir):
    unit = F.when(F.col("source") % 5 > 0, F.concat(F.lit("u"), F.col("source") % 3))
    return lifecycle.unit_totals(telemetry(spark, sf_dir).withColumn("unit", unit).withColumn("role", F.col("effort")))


@query(f"""with {TELEMETRY_SQL}, x as (select *, coalesce(us < (select min(us) from tel b where b.source = t.source and b.k % 50 = 3), false) early from tel t)
select source, count(*) filter (not early) requests, coalesce(sum(input + output) filter (not early), 0)::bigint tokens, count(*) filter (early) excluded_requests,
  coalesce(sum(input + output) filter (early), 0)::bigint excluded_tokens from x group by source""")
def drop_pre_activation(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    return lifecycle.drop_pre_activation(d, d.where("k % 50 = 3").groupBy("source").agg(F.min("us").alias("active_us")))


@query(f"""with {TELEMETRY_SQL}, x as (select model as role, input + output tok, source, min(us) over w a, max(us) over w b, row_number() over (partition by source, model, k % 2 order by line) i
  from tel window w as (partition by source, model, k % 2))
select *, case when active_us > 0 then tokens / (active_us / 1e6) end tokens_per_s from (select role, count(*) requests, sum(tok)::bigint tokens, sum(b - a) filter (i = 1)::bigint active_us from x group by role)""")
def report_rollup(spark, sf_dir):
    role = F.when(F.col("k") % 2 == 0, F.concat(F.lit("unit/"), "model")).otherwise(F.col("model"))
    d = telemetry(spark, sf_dir).groupBy("source", role.alias("role"))
    return lifecycle.report_rollup(d.agg(F.count("*").alias("requests"), F.sum(F.col("input") + F.col("output")).alias("tokens"), (F.max("us") - F.min("us")).alias("active_us")))


@query(f"""with {TELEMETRY_SQL}, f as (select source % 40 family, source % 8 account, max(us) last_us, count(distinct source) sessions from tel where source % 10 <> 3 group by 1, 2),
b as (select account, max(last_us) filter (sessions > 1) linked, max(last_us) alone from f group by account)
select f.account, family, last_us, sessions, (select arg_max(source, (us, source)) from tel t where t.source % 40 = f.family and t.source >= 40) worker, case when sessions > 1 then 'linked' else 'standalone' end kind from f join b on f.account = b.account and last_us = coalesce(linked, alone)""")
def latest_family(spark, sf_dir):
    d = telemetry(spark, sf_dir).withColumns({"family": F.col("source") % 40, "is_root": F.col("source") < 40})
    return lifecycle.latest_family(d, d.where("family % 10 = 3").select("family").distinct())


@query(f"""with {TELEMETRY_SQL}, ks as (select source // 3 f, source::varchar x from tel union select source // 3, 's' || (source % 4) from tel),
s as (select distinct case k % 3 when 0 then k::varchar when 1 then substr(sha256(k::varchar), 1, 24) else 's' || (k % 6) end selector from tel),
j as (select selector, (select count(distinct f) from ks where x = selector or substr(sha256(x), 1, 24) = selector) families, (select min(f) from ks where x = selector or substr(sha256(x), 1, 24) = selector) f from s)
select selector, families, case when families = 1 then f end family, case families when 0 then 'unknown' when 1 then 'resolved' else 'ambiguous' end outcome from j""")
def resolve_selectors(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    family, k = F.expr("source div 3").alias("family"), F.col("k")
    keys = d.select(family, F.col("source").cast("string").alias("key")).unionByName(d.select(family, F.concat(F.lit("s"), F.col("source") % 4).alias("key"))).distinct()
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.substring(F.sha2(k.cast("string"), 256), 1, 24)).otherwise(F.concat(F.lit("s"), k % 6))
    return lifecycle.resolve_selectors(d.select(text.alias("selector")).distinct(), keys)


@query(f"""with {TELEMETRY_SQL}, g as (select source, us, line, case when us - lag(us) over (partition by source order by us, line) > {12 * HOUR} then 1 else 0 end n from tel where k % 3 = 0),
c0 as (select *, sum(n) over (partition by source order by us, line) cluster from g), c as (select source, cluster::bigint cluster, min(us) s, max(us) e from c0 group by 1, 2),
x as (select c.*, (select max(us) from tel t where t.source = c.source and t.k % 3 > 0 and t.us between s and e) i,
  (select min(us) from tel t where t.source = c.source and t.k % 3 > 0 and t.us > e and t.us <= e + {6 * HOUR}) o from c)
select x.source, cluster, coalesce(i, o) sample_us, input, k % 2 = 1 "primary", case when i is not null then 'high' when o is not null then 'medium' end confidence from x left join tel on tel.source = x.source and tel.us = coalesce(i, o)""")
def direct_usage(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    return lifecycle.direct_usage(workflow.compaction_clusters(d.where("k % 3 = 0"), 12 * HOUR), d.where("k % 3 > 0").withColumn("primary", F.col("k") % 2 == 1), 6 * HOUR)


@query(f"""with {TELEMETRY_SQL}, r as (select source, avg(input) i, avg(output) o from tel where k % 6 = 0 group by source), b as (select source, avg(input) i, avg(output) o from tel where k % 6 <> 0 group by source)
select source, r.i recovery_input, r.o recovery_output, b.i baseline_input, b.o baseline_output, r.i - b.i delta_input, r.o - b.o delta_output from r full join b using (source)""")
def recovery_baseline(spark, sf_dir):
    return lifecycle.recovery_baseline(telemetry(spark, sf_dir), ["source"], F.col("k") % 6 == 0)


@query(f"""with {TELEMETRY_SQL} select source, case when k % 9 = 0 then 'opaque-wrapper' else model end category, count(distinct k) calls, count(*) - count(distinct k) duplicates,
  sum(case when k % 9 = 0 then count(distinct k) else 0 end) over (partition by source)::bigint opaque from tel group by source, case when k % 9 = 0 then 'opaque-wrapper' else model end, k % 9 = 0""")
def tool_activity(spark, sf_dir):
    category = F.when(F.col("k") % 9 == 0, "opaque-wrapper").otherwise(F.col("model"))
    return lifecycle.tool_activity(telemetry(spark, sf_dir).withColumn("category", category), ["k"])


@query(f"""{COSTED} select account, period, count(*) requests, sum(input + output)::bigint tokens, cast(sum(usd) as double) usd, count(*) filter (policy = 'historical') historical,
  case when count(*) = count(*) filter (policy = 'historical') then sum(input + output) / 1e6 * 2.5 end estimate from pol group by 1, 2""")
def period_cost(spark, sf_dir):
    return lifecycle.period_cost(costed(spark, sf_dir), ["account", "period"], 2.5)


@query(f"""{COSTED}, p as (select account, period, sum(input + output) t from pol group by 1, 2)
select account, count(*) approvals, sum(input + output)::bigint tokens, quantile_cont(input + output, 0.5) p50, quantile_cont(input + output, 0.9) p90, cast(sum(usd) as double) usd,
  quantile_cont(cast(usd as double), 0.5) usd_p50, quantile_cont(cast(usd as double), 0.9) usd_p90,
  (select period from p where p.account = pol.account order by t desc, period limit 1) worst_period from pol group by account""")
def reviewer_summary(spark, sf_dir):
    return lifecycle.reviewer_summary(costed(spark, sf_dir), ["account"])


CURSOR = f"""with {TELEMETRY_SQL}, q as (select t.*, (select max(us) from tel b where b.source = t.source and b.us < t.us) p from tel t where k % 5 <> 1),
q2 as (select q.*, (select max(us) from q b where b.source = q.source and b.us < q.us) pa from q),
cu as (select q2.*, q2.us - p duration_us, coalesce(b.k % 5 = 1, true) first_interval, exists (select 1 from tel s where s.source = q2.source and s.us > coalesce(pa, -1) and s.us <= q2.us and s.k % 10 = 4) tool_signal,
  exists (select 1 from tel s where s.source = q2.source and s.us > coalesce(pa, -1) and s.us <= q2.us and s.k % 10 = 6) tool_result from q2 left join tel b on b.source = q2.source and b.us = q2.p)"""


def cursor(spark, sf_dir):
    k = F.col("k")
    return lifecycle.cursor_intervals(telemetry(spark, sf_dir), k % 5 == 1, k % 10 == 4, k % 10 == 6)


@query(f"{CURSOR} select line, duration_us, first_interval, tool_signal, tool_result from cu")
def cursor_intervals(spark, sf_dir):
    return cursor(spark, sf_dir).select("line", "duration_us", "first_interval", "tool_signal", "tool_result")


RATES = """select {0}, count(*) filter (duration_us > 0) intervals, sum(output) filter (duration_us > 0) / (sum(duration_us) / 1e6) output_per_s,
  sum(output) filter (duration_us > 0 and not first_interval) / (sum(duration_us) filter (not first_interval) / 1e6) later_per_s,
  sum(output) filter (duration_us > 0 and not tool_signal) / (sum(duration_us) filter (not tool_signal) / 1e6) without_signal_per_s, sum(output) filter (duration_us > 0 and not tool_result) / (sum(duration_us) filter (not tool_result) / 1e6) without_result_per_s,
  coalesce(sum(duration_us) filter (first_interval), 0) / sum(duration_us) first_share from cu group by {0}"""


@query(f"{CURSOR} {RATES.format('model')}")
def interval_rates(spark, sf_dir):
    return lifecycle.interval_rates(cursor(spark, sf_dir), ["model"])


@query(f"""{CURSOR}, r as ({RATES.format("source")}), e as (select source, case when max(us) > min(us) then sum(output) / ((max(us) - min(us)) / 1e6) end elapsed from tel group by source)
select source, output_per_s as cursor, later_per_s as later, elapsed, case when output_per_s > 0 then (later_per_s / output_per_s - 1) * 100 end later_percent,
  case when output_per_s > 0 then (elapsed / output_per_s - 1) * 100 end elapsed_percent from r full join e using (source)""")
def compare_rates(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    r = lifecycle.interval_rates(cursor(spark, sf_dir), ["source"])
    span = F.max("us") - F.min("us")
    elapsed = d.groupBy("source").agg(F.when(span > 0, F.sum("output") / (span / 1e6)).alias("rate"))
    return lifecycle.compare_rates({"cursor": r.withColumnRenamed("output_per_s", "rate"), "later": r.withColumnRenamed("later_per_s", "rate"), "elapsed": elapsed}, ["source"])


@query(f"""with {TELEMETRY_SQL}, sp as (select account, min(us) s, max(us) + 1 e from tel group by account), sc as (select * from (values ('elapsed', 0), ('confirmed', 4), ('hypothetical', 2)) v(scenario, part)),
x as (select distinct scenario, account, period * {WINDOW_US} s, period * {WINDOW_US} + {WINDOW_US} // part e from tel, sc where part > 0),
u as (select scenario, sp.account, sp.e - sp.s - coalesce((select sum(greatest(0, least(x.e, sp.e) - greatest(x.s, sp.s))) from x where x.account = sp.account and x.scenario = sc.scenario), 0) t from sp, sc),
r as (select scenario, account, count(*) n, sum(input + output)::bigint k from tel t, sc where not exists (select 1 from x where x.scenario = sc.scenario and x.account = t.account and x.s <= t.us and x.e > t.us) group by 1, 2)
select u.scenario, u.account, t::bigint time_us, coalesce(n, 0) requests, coalesce(k, 0)::bigint tokens, case when t > 0 then coalesce(k, 0) / (t / 1e6) end tokens_per_s from u left join r on r.account = u.account and r.scenario = u.scenario""")
def pause_scenarios(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    start = F.col("period") * WINDOW_US
    pauses = {n: d.select("account", start.alias("start"), (start + WINDOW_US // part).alias("end")).distinct() for n, part in (("confirmed", 4), ("hypothetical", 2))}
    spans = d.groupBy("account").agg(F.min("us").alias("start"), (F.max("us") + 1).alias("end"))
    return lifecycle.pause_scenarios(d, spans, {"elapsed": pauses["confirmed"].where("false"), **pauses}, ["account"])
