"""Queries over pairs: reviewer bursts and parents, contexts, meters, controls, actions and snapshots, with DuckDB SQL.

A greedy pass is recursive SQL: one step for each left end of a group, with the right ends taken so far in a list.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.temporal import gap_groups
from meterline.operators import pairing, quota
from meterline.plans.registry import HOUR, METERED, bucket_ctes, bucket_rows, metered, query
from meterline.plans.statistics import SUMS, _beta, draws_sql
from meterline.sources.telemetry import TELEMETRY_SQL, telemetry

def greedy_sql(name: str, choice: str = "free[1].r") -> str:
    """Over ``cd`` (g, l, o, rs: candidates as a list of structs (d, r) in order of preference) what one pass in the order
    of o and l takes: CTE ``name`` (g, l, r). ``choice`` picks among the free ones."""
    return f"""nm as (select *, row_number() over (partition by g order by o, l) n from cd),
{name}_walk(g, n, taken, l, r) as (select distinct g, 0::bigint, []::bigint[], null::bigint, null::bigint from nm union all
  select g, n, case when p is null then taken else list_append(taken, p) end, l, p from (select g, n, taken, l, {choice}::bigint p from (
    select w.g, nm.n, w.taken, nm.l, list_filter(nm.rs, lambda x: not list_contains(w.taken, x.r)) free from {name}_walk w join nm on nm.g = w.g and nm.n = w.n + 1))),
{name} as (select g, l, r from {name}_walk where r is not null)"""


MATCH, SPAN, STALE = 12 * HOUR, 6 * HOUR, 8 * HOUR
BURSTS = f"""with {TELEMETRY_SQL}, g as (select *, case when us - lag(us) over (partition by source order by us, line) > {24 * HOUR} then 1 else 0 end n from tel where reviewer),
rb as (select *, (source * 1000 + sum(n) over (partition by source order by us, line))::bigint burst from g), wk as (select * from tel where not reviewer)"""


def bursts(d: DataFrame) -> DataFrame:
    b = gap_groups(d.where("reviewer"), ["source"], ["us", "line"], "us", 24 * HOUR, "burst")
    return b.withColumn("burst", F.col("source") * 1000 + F.col("burst"))


def work(d: DataFrame) -> DataFrame:
    return d.where("not reviewer").select("account", F.col("source").alias("parent"), "us", "model", "effort", (F.col("input") + F.col("output")).alias("tokens"), (F.col("k") % 10 == 2).alias("reviewed"), (F.col("source") % 3 == 0).alias("user_review"))


def paired(d: DataFrame) -> DataFrame:
    """Bursts with their parents: another source of the same account; every seventh burst states one."""
    reviews = bursts(d).select("account", "burst", F.col("us").alias("l_us"))
    w = work(d).withColumnRenamed("us", "r_us")
    links = reviews.where("burst % 7 = 0").select("burst", F.expr("(burst div 1000 + 8) % 16").alias("parent"), (F.col("burst") % 2 == 0).alias("explicit")).distinct()
    links = links.join(w.select("parent").distinct(), "parent", "left_semi")
    return pairing.pair_parent(reviews, w, links, MATCH)


PAIRED = f"""{BURSTS}, lk as (select distinct burst, (burst // 1000 + 8) % 16 parent, burst % 2 = 0 explicit from rb where burst % 7 = 0 and exists (select 1 from wk where wk.source = (burst // 1000 + 8) % 16)),
pc as (select distinct rb.account, burst, wk.source parent from rb join wk on wk.account = rb.account and wk.us between rb.us - {MATCH} and rb.us + {MATCH} union select distinct rb.account, rb.burst, lk.parent from rb join lk on lk.burst = rb.burst),
ds as (select pc.burst, pc.parent, rb.line, min(abs(wk.us - rb.us)) off from pc join rb on rb.burst = pc.burst join wk on wk.source = pc.parent group by 1, 2, 3),
ag as (select burst, parent, avg((off <= 60000000)::int) near60, avg((off <= {MATCH})::int) near, median(off)::double median_us, min(off) nearest_us from ds group by 1, 2),
ti as (select ag.*, case when lk.explicit then 0 when lk.explicit is not null then 1 when exists (select 1 from wk where wk.source = ag.parent and k % 10 = 2) then 2 else 3 end tier from ag left join lk on lk.burst = ag.burst and lk.parent = ag.parent),
tt as (select * from ti a where (tier < 2 or nearest_us <= {MATCH}) and tier = (select min(tier) from ti b where b.burst = a.burst and (b.tier < 2 or b.nearest_us <= {MATCH}))),
rk as (select *, row_number() over o i, lead(near60) over o x60, lead(near) over o xn, lead(nearest_us) over o xd from tt window o as (partition by burst order by near60 desc, near desc, median_us, nearest_us, parent)),
fi as (select *, coalesce(case when tier < 2 then x60 = near60 and xn = near else abs(near60 - x60) < 0.1 and abs(near - xn) < 0.1 and abs(nearest_us - xd) <= 10000000 end, false) ambiguous from rk where i = 1),
pp as (select b.account, b.burst, fi.parent, coalesce(['explicit-parent-id', 'shared-link-id', 'temporal+reviewer', 'temporal'][tier + 1], 'no-nearby-parent') as method,
  case when fi.burst is null then 'unpaired' when tier < 2 then case when ambiguous then 'medium' else 'high' end when ambiguous then 'low' when near60 >= 0.5 or (nearest_us <= 15000000 and near60 > 0) then 'medium' else 'low' end confidence,
  ambiguous, near60, nearest_us from (select distinct account, burst from rb) b left join fi on fi.burst = b.burst)"""


@query(f"{PAIRED} select * from pp")
def pair_parent(spark, sf_dir):
    return paired(telemetry(spark, sf_dir))


EPISODES = f"""{PAIRED}, ep as (select burst episode, min(parent) parent, min(us) as start, max(us) as end_, sum(input + output)::bigint tokens from rb join pp using (burst) where parent is not null group by 1),
cx as (select ep.episode, wk.us, wk.model, coalesce(wk.effort, 'unknown') effort, wk.input + wk.output t, start, end_ from ep join wk on wk.source = ep.parent and wk.us between start - {SPAN} and end_ + {SPAN}),
em as (select episode, model, sum(greatest(t, 1)) w from cx group by 1, 2), ee as (select episode, effort, sum(greatest(t, 1)) w from cx group by 1, 2),
en as (select episode, coalesce(sum(t) filter (us < start), 0)::bigint as before, coalesce(sum(t) filter (us between start and end_), 0)::bigint during, coalesce(sum(t) filter (us > end_), 0)::bigint as after, count(*) parent_requests from cx group by 1),
ec as (select ep.episode, ep.parent, ep.start, ep.end_ as "end", ep.tokens, coalesce(before, 0) as before, coalesce(during, 0) during, coalesce(after, 0) as after, coalesce(parent_requests, 0) parent_requests,
  (select arg_min(model, (-w, model)) from em where em.episode = ep.episode) model, (select arg_min(effort, (-w, effort)) from ee where ee.episode = ep.episode) effort, tokens / (tokens + coalesce(before + during + after, 0)) local_share from ep left join en on en.episode = ep.episode)"""


def episodes(d: DataFrame) -> DataFrame:
    p = paired(d).where("parent is not null").select("burst", "parent")
    e = bursts(d).join(p, "burst").groupBy(F.col("burst").alias("episode"), "parent").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.sum(F.col("input") + F.col("output")).alias("tokens"))
    return pairing.episode_context(e, work(d), SPAN)


@query(f"{EPISODES} select * from ec")
def approval_episodes(spark, sf_dir):
    return episodes(telemetry(spark, sf_dir))


@query(f"""{BURSTS}, mk as (select source, us, case when k % 4 = 0 then 'request' else 'approval' end kind from tel where source % 3 = 0), ch as (select * from mk a where kind = 'request' or not exists (select 1 from mk b where b.source = a.source and b.kind = 'request')),
mg as (select *, case when us - lag(us) over (partition by source order by us) > {24 * HOUR} then 1 else 0 end n from ch), mb as (select *, sum(n) over (partition by source order by us) burst from mg),
me as (select source, burst::bigint burst, min(us) as start, max(us) end_, count(*) markers from mb group by 1, 2),
cx as (select me.source, burst, wk.us, wk.model, coalesce(wk.effort, 'unknown') effort, wk.input + wk.output t, start, end_ from me join wk on wk.source = me.source and wk.us between start - {SPAN} and end_ + {SPAN}),
cm as (select source, burst, model, sum(greatest(t, 1)) w from cx group by 1, 2, 3), ce as (select source, burst, effort, sum(greatest(t, 1)) w from cx group by 1, 2, 3)
select me.source, me.burst, me.start, me.end_ as "end", markers, sum(case when us < cx.start then t else 0 end)::bigint as before, sum(case when us between cx.start and cx.end_ then t else 0 end)::bigint during, sum(case when us > cx.end_ then t else 0 end)::bigint as after, count(*) parent_requests,
  (select arg_min(model, (-w, model)) from cm where cm.source = me.source and cm.burst = me.burst) model, (select arg_min(effort, (-w, effort)) from ce where ce.source = me.source and ce.burst = me.burst) effort
  from me join cx on cx.source = me.source and cx.burst = me.burst group by me.source, me.burst, me.start, me.end_, markers""")
def manual_episodes(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    markers = d.where("source % 3 = 0").select("source", "us", F.when(F.col("k") % 4 == 0, "request").otherwise("approval").alias("kind"))
    everyone = work(d).withColumn("user_review", F.lit(True))
    return pairing.manual_episodes(markers, everyone, 24 * HOUR, SPAN)


@query(f"""{METERED}, hi as (select *, max(used) over (partition by account, reset_key order by us, line) high from m where k % 3 > 0), sp as (select line span, account, us as start, us + input * 1000 end_ from m where k % 3 = 0),
e as (select sp.*, (select arg_max({{'u': us, 'used': used, 'k': reset_key, 'h': high}}, (us, line)) from hi where hi.account = sp.account and hi.us < sp.start) l, (select arg_min({{'u': us, 'used': used, 'k': reset_key, 'h': high}}, (us, line)) from hi where hi.account = sp.account and hi.us >= sp.end_) t from sp),
s as (select *, case when l is null or t is null then 'missing' when start - l.u > {STALE} or t.u - end_ > {STALE} then 'stale' when l.k <> t.k then 'reset-boundary' else 'ok' end status from e)
select account, span, start, end_ as "end", status, case when status = 'ok' then greatest(0.0, t.h - l.h) end points, case when status in ('ok', 'reset-boundary') then l.used end used_before, case when status in ('ok', 'reset-boundary') then t.used end used_after from s""")
def meter_envelope(spark, sf_dir):
    d = quota.reset_key(telemetry(spark, sf_dir))
    tie = F.lpad(F.col("line").cast("string"), 20, "0").alias("tie")
    spans = d.where("k % 3 = 0").select("account", F.col("line").alias("span"), F.col("us").alias("start"), (F.col("us") + F.col("input") * 1000).alias("end"))
    return pairing.meter_envelope(spans, d.where("k % 3 > 0").select("account", "us", "used", "reset_key", tie), STALE)


@query(f"""{METERED}, {bucket_ctes("", "m")}, x as (select account, reset_key, bucket, min(us) as start, max(us) as end_, sum(input + output)::bigint tokens, coalesce(sum(input + output) filter (reviewer), 0)::bigint reviewer_tokens from kept group by 1, 2, 3)
select account, reset_key, bucket, start, end_ as "end", tokens, reviewer_tokens, reviewer_tokens / tokens reviewer_share, reviewer_tokens > 0 present, reviewer_tokens > 0 and reviewer_tokens / tokens + 1e-9 >= 0.5 dominant, reviewer_tokens > 0 and reviewer_tokens = tokens exclusive,
  reviewer_tokens > 0 and reviewer_tokens = tokens and not exists (select 1 from m where m.account = x.account and not reviewer and m.us between x.start - {HOUR} and x.end_ + {HOUR}) isolated from x""")
def reviewer_buckets(spark, sf_dir):
    d = metered(spark, sf_dir)
    return pairing.reviewer_buckets(bucket_rows(d), d, 0.5, HOUR)


FIGURES = ("parent_weight", "reviewer_weight", "condition", "gain", "reviewer_low", "reviewer_mid", "reviewer_high")
_SSE = "yy - 2 * ({0} * ay + {1} * yb) + {0} * {0} * aa + 2 * {0} * {1} * ab + {1} * {1} * bb".format


@query(f"""{EPISODES}, oe as (select parent % 2 half, parent, (before + during + after) / 1e6 a, tokens / 1e6 b, (before + during + after) / 1e6 * 20 + tokens / 1e6 * 35 + episode % 5 * 0.1 y from ec where parent_requests > 0),
opar as (select half, parent, count(*) k, sum(a * a) aa, sum(b * b) bb, sum(a * b) ab, sum(a * y) ay, sum(b * y) yb, sum(y * y) yy, sum(y) y from oe where a > 0 and b > 0 group by 1, 2),
osum as (select half, sum(k)::bigint n_rows, count(*) sessions, sum(y) points, {SUMS}, sum(yy) yy from opar group by 1), ofit as (select *, {_beta()} from osum),
ofig as (select *, case when abs(ab) / sqrt(aa * bb) < 1 - 1e-10 then sqrt((1 + abs(ab) / sqrt(aa * bb)) / (1 - abs(ab) / sqrt(aa * bb))) end cond, case when {_SSE("greatest(0.0, ay / aa)", "0.0")} > 1e-9 then 1 - ({_SSE("wa", "wb")}) / ({_SSE("greatest(0.0, ay / aa)", "0.0")}) else 0.0 end gn from ofit),
{draws_sql("odr", "opar", "o", "half, parent", 300)}, obs as (select half, {_beta()} from (select half, rep, {", ".join(f"sum({x} * z) {x}" for x in ("aa", "bb", "ab", "ay", "yb"))} from odr group by 1, 2)),
oq as (select half, quantile_cont(wb, 0.1) l, quantile_cont(wb, 0.5) m, quantile_cont(wb, 0.9) h, count(*) filter (wb > 1e-9) / count(*) positive from obs group by 1)
select half, n_rows "rows", sessions, round(points, 6) points, {", ".join(f'round({x}, 5) "{c}"' for c, x in zip(FIGURES, ("wa", "wb", "cond", "gn", "l", "m", "h")))}, positive,
  case when n_rows < 10 or sessions < 3 or points < 5 then 'too_few' when cond is null or cond > 20 then 'collinear' when wb <= 1e-9 or gn < 0.05 then 'no_gain' when coalesce(l <= 1e-9 or positive < 0.8 or h / l > 10, true) then 'unstable' else 'supported' end status from ofig left join oq using (half)""")
def overhead_fit(spark, sf_dir):
    """Episodes of reviewer work beside their parents', with points in proportion to both and a remainder by the episode."""
    e = episodes(telemetry(spark, sf_dir)).where("parent_requests > 0")
    parent = (F.col("before") + F.col("during") + F.col("after")) / 1e6
    e = e.select((F.col("parent") % 2).alias("half"), "parent", parent.alias("parent_m"), (F.col("tokens") / 1e6).alias("reviewer_m"), (parent * 20 + F.col("tokens") / 1e6 * 35 + F.col("episode") % 5 * 0.1).alias("points"))
    out = pairing.overhead_fit(e, ["half"], 10, 3, 5.0)
    return out.withColumns({c: F.round(c, 5) for c in FIGURES} | {"points": F.round("points", 6)})


NEAREST = """with recursive {tel}, rq as (select source, line request, us r_us from tel where k % 5 > 0), {acts},
cd as (select a.source g, action l, l_us o, list({{'d': abs(l_us - r_us), 'r': request}} order by abs(l_us - r_us) + case when l_us < r_us then 20000000 else 0 end, abs(l_us - r_us), request) rs
  from ac a join rq on rq.source = a.source and r_us between l_us - {match} and l_us + 15000000 group by 1, 2, 3), {walk}"""


@query(NEAREST.format(tel=TELEMETRY_SQL, acts="ac as (select source, line action, us l_us from tel where k % 5 = 0)", match=MATCH, walk=greedy_sql("tk")) + """
select ac.source, action, request, l_us - r_us delta_us from tk join ac on ac.source = g and action = l join rq on rq.request = r""")
def nearest_decision(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    return pairing.nearest_decision(d.where("k % 5 = 0").select("source", F.col("line").alias("action"), F.col("us").alias("l_us")), d.where("k % 5 > 0").select("source", F.col("line").alias("request"), F.col("us").alias("r_us")), MATCH)


@query(f"""with recursive {TELEMETRY_SQL}, x as (select line, k, model, coalesce(effort, 'none') effort, period regime, greatest(input, 1)::double t, us from tel),
cd as (select concat_ws(':', a.model, a.effort, a.regime) g, a.line l, 0 o, list({{'d': 0, 'r': m.line}} order by round(abs(ln(a.t / m.t)), 12), abs(a.us - m.us), m.line) rs
  from x a join x m using (model, effort, regime) where a.k % 5 = 0 and m.k % 5 > 0 and round(abs(ln(a.t / m.t)), 12) <= ln(2.0) + 1e-12 group by 1, 2), {greedy_sql("tk")}
select a.line auto, m.line manual, a.model, a.effort, a.regime, round(abs(ln(a.t / m.t)), 6) log_ratio from tk join x a on a.line = l join x m on m.line = r""")
def match_controls(spark, sf_dir):
    d = telemetry(spark, sf_dir).select("line", "k", "model", F.coalesce("effort", F.lit("none")).alias("effort"), F.col("period").alias("regime"), F.col("input").alias("tokens"), "us")
    out = pairing.match_controls(d.where("k % 5 = 0").withColumnRenamed("line", "auto").drop("k"), d.where("k % 5 > 0").withColumnRenamed("line", "manual").drop("k"))
    return out.withColumn("log_ratio", F.round("log_ratio", 6))


@query(f"""with recursive {TELEMETRY_SQL}, p as (select *, lag(input) over (partition by source order by us, line) b from tel), dp as (select source, line, us from p where b >= 50000 and input < 0.55 * b),
cd as (select dp.source g, dp.line l, dp.us o, list({{'d': 0, 'r': e.line}} order by abs(dp.us - e.us), e.line) rs from dp join tel e on e.source = dp.source and e.k % 6 = 0 and abs(e.us - dp.us) <= {24 * HOUR} group by 1, 2, 3), {greedy_sql("tk")}
select dp.source, dp.line "drop", r as event from dp left join tk on g = dp.source and l = dp.line""")
def heuristic_check(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    prev = F.lag("input").over(Window.partitionBy("source").orderBy("us", "line"))
    drops = d.withColumn("_p", prev).where("_p >= 50000 and input < 0.55 * _p").select("source", F.col("line").alias("drop"), F.col("us").alias("l_us"))
    return pairing.heuristic_check(drops, d.where("k % 6 = 0").select("source", F.col("line").alias("event"), F.col("us").alias("r_us")), 24 * HOUR)


SENDS = f"""ac as (select source, line // 2 as action, us - us % {HOUR} l_us, max(model) as role from tel where k % 5 = 0 group by 1, 2, 3 having count(distinct model) = 1 and count(*) = count(case when k % 3 > 0 then model end))"""


@query(NEAREST.format(tel=TELEMETRY_SQL, acts=SENDS, match=MATCH, walk=greedy_sql("tk")) + """
select ac.source, action, role, r as request, l_us - r_us delta_us from ac left join tk on ac.source = g and action = l left join rq on rq.request = r""")
def targeted_sends(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    sends = d.where("k % 5 = 0").select("source", F.expr("line div 2").alias("action"), (F.col("us") - F.col("us") % HOUR).alias("l_us"), F.when(F.col("k") % 3 > 0, F.col("model")).alias("role"))
    return pairing.targeted_sends(sends, d.where("k % 5 > 0").select("source", F.col("line").alias("request"), F.col("us").alias("r_us")), MATCH)


@query(f"""with recursive {TELEMETRY_SQL}, ch as (select source session, source % 8 family, min(us) r_us from tel group by source), sp as (select source % 8 family, line as action, us l_us from tel where k % 10 = 1),
ex as (select family, action, family + 8 session from sp where action % 9 = 0), s1 as (select * from sp anti join ex using (family, action)), c1 as (select * from ch anti join ex using (family, session)),
cd as (select s1.family g, action l, l_us o, list({{'d': abs(r_us - l_us), 'r': session}} order by abs(r_us - l_us), session) rs from s1 join c1 on c1.family = s1.family and r_us between l_us - 500000 and l_us + {2 * HOUR} group by 1, 2, 3),
{greedy_sql("tm", "case when len(free) = 1 or free[2].d - free[1].d >= 750000 then free[1].r end")},
br as (select s1.family, s1.action, count(*) n, min(c1.session) session from s1 join c1 on c1.family = s1.family and r_us between l_us - 500000 and l_us + {48 * HOUR}
  where not exists (select 1 from tm where g = s1.family and l = s1.action) and not exists (select 1 from tm where g = s1.family and r = c1.session) group by 1, 2),
al as (select family, action, session, 'id' as method, 'high' confidence from ex union all select g, l, r, 'time', 'medium' from tm union all select family, action, session, 'window', 'diagnostic' from br where n = 1)
select sp.family, sp.action, session, method, coalesce(confidence, 'unresolved') confidence from sp left join al on al.family = sp.family and al.action = sp.action""")
def match_actions(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    children = d.groupBy(F.col("source").alias("session")).agg(F.min("us").alias("r_us")).withColumn("family", F.col("session") % 8)
    spawns = d.where("k % 10 = 1").select((F.col("source") % 8).alias("family"), F.col("line").alias("action"), F.col("us").alias("l_us"))
    ids = spawns.where("action % 9 = 0").select("family", "action", (F.col("family") + 8).alias("session"), F.lit(1).alias("shared"))
    return pairing.match_actions(spawns, children, ids, 2 * HOUR, 48 * HOUR)


KINDS = ("input", "cached", "output", "reasoning")
_SIZE = "({0}[1] + {0}[3])".format
_MOVED = ", ".join(f"tot[{i}] - prev[{i}]" for i in range(1, 5))
_KNOWN = ", ".join(f"x{i}" for i in range(4)), " and ".join(f"s{i} is not null" for i in range(4))


@query(f"""with recursive {TELEMETRY_SQL}, z as (select source, line, k, {", ".join(f"case when k % 7 <> 0 then {c} else 0 end x{i}" for i, c in enumerate(KINDS))} from tel),
s as (select source, line, k, row_number() over w n, {", ".join(f"x{i}" for i in range(4))}, {", ".join(f"sum(x{i}) over w - case when k % 13 = 0 then lag(x{i}) over w else 0 end s{i}" for i in range(4))} from z window w as (partition by source order by line)),
r as (select source, n, case when k % 17 <> 0 then [{_KNOWN[0]}]::bigint[] end las, case when k % 11 <> 0 and {_KNOWN[1]} then [s0, s1, s2, s3]::bigint[] end tot from s),
f(source, n, prev, outcome, used) as (select distinct source, 0::bigint, null::bigint[], null::varchar, null::bigint[] from r union all
  select source, n, case outcome when 'accepted' then coalesce(tot, case when prev is not null then [{", ".join(f"prev[{i}] + las[{i}]" for i in range(1, 5))}] end) when 'reset' then tot else prev end, outcome, case when outcome = 'accepted' then use end from (
    select *, case when first is not null then first when list_max(use) = 0 and list_min(use) = 0 then 'zero' else 'accepted' end outcome from (
      select *, case when las is null and tot is null then 'missing' when tot is null or prev is null then null when tot = prev then 'duplicate'
        when fell and {_SIZE("prev")} > 0 and {_SIZE("prev")} > {_SIZE("tot")} and ({_SIZE("tot")} * 100 >= {_SIZE("prev")} * 98 or (las is not null and {_SIZE("las")} > 0 and {_SIZE("tot")} + 2 * {_SIZE("las")} >= {_SIZE("prev")})) then 'stale'
        when las is null and fell then 'reset' end first, coalesce(las, case when prev is null then tot else [{_MOVED}] end) use from (
        select f.source, r.n, f.prev, r.las, r.tot, r.tot is not null and f.prev is not null and least({_MOVED.replace("tot", "r.tot").replace("prev", "f.prev")}) < 0 fell from f join r on r.source = f.source and r.n = f.n + 1))))
select source, outcome, count(*) snapshots, coalesce(sum(used[1]), 0)::bigint input, coalesce(sum(used[3]), 0)::bigint output from f where n > 0 group by source, outcome""")
def accepted_deltas(spark, sf_dir):
    """Cumulative snapshots of a source, some of them repeated, out of order or without one of their objects."""
    d, w = telemetry(spark, sf_dir), Window.partitionBy("source").orderBy("line")
    counted = {c: F.when(F.col("k") % 7 != 0, F.col(c)).otherwise(0) for c in KINDS}
    late = {f"total_{c}": F.when(F.col("k") % 11 != 0, F.sum(x).over(w) - F.when(F.col("k") % 13 == 0, F.lag(x).over(w)).otherwise(0)) for c, x in counted.items()}
    last = {f"last_{c}": F.when(F.col("k") % 17 != 0, x) for c, x in counted.items()}
    return pairing.outcome_counts(pairing.accepted_deltas(d.withColumns(late | last)), ["source"])
