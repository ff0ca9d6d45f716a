"""Queries over families, lifetimes, lingering, cycles and rollups, with their DuckDB SQL.

Stand-ins over the events table: an account is a family of the sources with the same remainder by 8, of which those under
16 in number have parents under 8; a source's role and chunk follow from its number.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators import graph, windows, workflow
from meterline.plans.registry import HOUR, PRICED, TURN_US, priced, query
from meterline.sources.telemetry import TELEMETRY_SQL, telemetry

ROLES = ("coder", "tester", "planner")
END = TURN_US + 200 * HOUR
MEMBERS = """mb as (select source session, source % 8 family, min(us) first_us, max(us) last_us, any_value(case when source >= 8 then (source // 8 - 1) // 2 * 8 + source % 8 end) parent from tel group by source),
rl as (select *, ['coder', 'tester', 'planner'][session // 8 % 3 + 1] as role, case when session // 8 % 4 > 0 then 'c' || (session // 8 % 4 // 2) end chunk from mb)"""
CLOSURE = """, cl(node, ancestor, depth) as (select session, session, 0 from mb union all select cl.node, mb.parent, cl.depth + 1 from cl join mb on mb.session = cl.ancestor where mb.parent is not null)"""
WINDOWS = f"""{PRICED}, {MEMBERS}, aw as (select family, session as member, role, chunk, first_us spawn_us, greatest(first_us, {TURN_US}) as start, least(last_us + 1, {END}) as end_, first_us < {TURN_US} or last_us + 1 > {END} truncated from rl where session >= 8),
w as (select * from aw where end_ > start), q as (select line, us, source as member, source % 8 family, input, output, input + output t, usd from priced)"""


def members(d: DataFrame) -> DataFrame:
    s = d.groupBy(F.col("source").alias("session")).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    n = F.expr("session div 8")
    return s.withColumns({
        "family": F.col("session") % 8, "parent": F.when(n > 0, F.expr("(session div 8 - 1) div 2 * 8 + session % 8")), "is_top": n == 0, "subagent": n > 0,
        "role": F.element_at(F.array(*map(F.lit, ROLES)), (n % 3 + 1).cast("int")), "chunk": F.when(n % 4 > 0, F.concat(F.lit("c"), F.expr("session div 8 % 4 div 2"))),
    })


def edges(m: DataFrame) -> DataFrame:
    return m.where("parent is not null").select(F.col("session").alias("child"), "parent")


def open_windows(m: DataFrame) -> DataFrame:
    spawns = m.where("not is_top").select(F.col("session").alias("member"), F.col("first_us").alias("spawn_us"))
    return windows.active_windows(m.withColumnRenamed("session", "member"), spawns, TURN_US, END)


def requests(d: DataFrame) -> DataFrame:
    return d.withColumn("member", F.col("source")).withColumn("family", F.col("source") % 8)


def tops(m: DataFrame) -> DataFrame:
    return m.where("is_top").select("family", F.col("session").alias("root"))


@query(f"with {TELEMETRY_SQL} select source, us, count(*) requests, sum(input + output)::bigint tokens from tel group by source, us")
def usage_timeline(spark, sf_dir):
    return windows.usage_timeline(telemetry(spark, sf_dir), ["source"])


@query(f"{PRICED} select coalesce(effort, 'unknown') as role, count(*) requests, sum(input + output)::bigint tokens, cast(sum(usd) as double) usd from priced group by 1")
def role_costs(spark, sf_dir):
    return windows.role_costs(priced(spark, sf_dir).withColumn("role", F.col("effort")))


@query(f"""with {TELEMETRY_SQL}, e as (select source session, model as role, count(*) n from tel group by 1, 2), f as (select session, max(n) n from e group by session),
g as (select f.session, f.n, (select min(role) from e where e.session = f.session and e.n = f.n) as role, coalesce((select max(n) from e where e.session = f.session and e.role <> (select min(role) from e x where x.session = f.session and x.n = f.n)), 0) runner_up from f)
select session, case when n > runner_up then role end as role, n, runner_up, case when n >= greatest(2, 2 * runner_up) then 'high' when n > runner_up then 'medium' else 'ambiguous' end confidence from g""")
def infer_role(spark, sf_dir):
    return windows.infer_role(telemetry(spark, sf_dir).select(F.col("source").alias("session"), F.col("model").alias("role")))


@query(f"""with {TELEMETRY_SQL}, {MEMBERS}, x as (select *, case when session % 3 = 0 and parent is not null then 1 else 0 end up, session >= 8 sub from mb)
select family, arg_min(session, (up, sub, first_us, session)) root, min(up) = 0 structural from x group by family""")
def family_root(spark, sf_dir):
    m = members(telemetry(spark, sf_dir))
    return windows.family_root(m, edges(m).where("child % 3 = 0"))


@query(f"""with {TELEMETRY_SQL}, {MEMBERS}, x as (select family, count(parent) links, count(*) filter (parent is not null and session % 5 > 1) high_links, count(*) filter (parent is not null and session % 5 = 1) medium_links,
  count(*) filter (session >= 8 and session % 7 > 0) workers, count(*) filter (session % 11 > 0) measured, count(*) members, max(last_us) - min(first_us) span_us from mb group by family)
select *, (case when links > 0 then 50.0 * high_links / links + 15.0 * medium_links / links else 0 end + 4 * least(workers, 20) + 40.0 * measured / members + case when workers between 2 and 30 then 20 else 0 end
  + case when span_us <= 172800000000 then 20 when span_us <= 345600000000 then 10 else 0 end + case when links > 0 and links = high_links then 20 else 0 end)::double score,
  case when measured = 0 then 'no usage' when members = 1 then 'standalone' when links = high_links and measured = members then 'complete' else 'limited' end quality from x""")
def family_score(spark, sf_dir):
    link, s = F.col("parent").isNotNull(), F.col("session")
    counts = {"links": link, "high_links": link & (s % 5 > 1), "medium_links": link & (s % 5 == 1), "workers": (s >= 8) & (s % 7 > 0), "measured": s % 11 > 0, "members": F.lit(True)}
    f = members(telemetry(spark, sf_dir)).groupBy("family").agg(*(F.count_if(x).alias(n) for n, x in counts.items()), (F.max("last_us") - F.min("first_us")).alias("span_us"))
    return windows.family_score(f)


@query(f"""with recursive {TELEMETRY_SQL}, {MEMBERS}{CLOSURE}, t as (select * from mb where session < 8 or session % 5 = 0 and session % 8 > 4),
c as (select t.family, t.session from t where exists (select 1 from cl join mb on mb.session = cl.node where cl.ancestor = t.session and mb.first_us < {END} and mb.last_us >= {TURN_US})),
n as (select family, count(*) candidates, min(session) root from c group by family)
select f.family, coalesce(candidates, 0) candidates, case when candidates = 1 then root end root, case when candidates = 1 then 'selected' when candidates > 1 then 'ambiguous' else 'none' end outcome from (select distinct family from mb) f left join n using (family)""")
def select_root(spark, sf_dir):
    m = members(telemetry(spark, sf_dir))
    top = F.col("is_top") | ((F.col("session") % 5 == 0) & (F.col("session") % 8 > 4))
    return windows.select_root(m.withColumn("is_top", top), graph.ancestors(edges(m)), TURN_US, END)


@query(f"""with recursive {TELEMETRY_SQL}, {MEMBERS}{CLOSURE}, b as (select node session, ancestor % 8 family, depth from cl where ancestor < 8),
v as (select b.* from b join mb using (session) where depth > 0 and mb.first_us < {END} and mb.last_us >= {TURN_US})
select family, session, depth, case when depth = 0 then 'root' when session in (select session from v) then 'active' else 'connecting' end why from b
  where depth = 0 or session in (select session from v) or exists (select 1 from cl join v on v.session = cl.node where cl.ancestor = b.session)""")
def window_members(spark, sf_dir):
    m = members(telemetry(spark, sf_dir))
    return windows.window_members(m, graph.ancestors(edges(m)), tops(m), TURN_US, END, carry_in=True)


@query(f"{WINDOWS} select family, member, role, chunk, spawn_us, start, end_ as \"end\", truncated from w")
def active_windows(spark, sf_dir):
    return open_windows(members(telemetry(spark, sf_dir))).select("family", "member", "role", "chunk", "spawn_us", "start", "end", "truncated")


@query(f"""{WINDOWS} select family, line, coalesce((select string_agg(distinct role, '+' order by role) from w where w.family = q.family and w.start <= q.us and w.end_ > q.us), 'idle') state from q where member < 8""")
def active_state(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    r = requests(d).where("member < 8").select("family", "line", "us")
    return windows.active_state(r, open_windows(members(d))).select("family", "line", "state")


@query(f"""{WINDOWS}, j as (select o.family, o.member, o.spawn_us, o.end_, n.spawn_us as start, n.member as trg, case when n.chunk is null or o.chunk is null then 'unclassified-overlap' when n.chunk <> o.chunk then 'cross-chunk-overlap'
    when n.role = o.role then 'same-chunk-replacement-overlap' else 'same-chunk-repair-overlap' end kind from w o join w n on n.family = o.family and n.member <> o.member and n.spawn_us > o.spawn_us and n.spawn_us < o.end_
    and (n.role = o.role or (o.role = 'coder' and n.role = 'tester'))),
f as (select family, member, spawn_us, kind, min(start) as start, arg_min(trg, (start, trg)) as "trigger", max(end_) as "end" from j group by 1, 2, 3, 4)
select f.*, (select count(*) from q where q.family = f.family and q.member = f.member and q.us >= f.start and q.us < f."end") requests,
  coalesce((select sum(t) from q where q.family = f.family and q.member = f.member and q.us >= f.start and q.us < f."end"), 0)::bigint tokens from f""")
def lingering(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    return windows.lingering(open_windows(members(d)), requests(d), {"coder": "tester"})


def _use(who: str, a: str, b: str, name: str) -> str:
    on = f"from q where q.family = c.family and q.member = c.{who} and q.us >= c.{a} and q.us < c.{b}"
    return f"(select count(*) {on}) {name}_requests, coalesce((select sum(t) {on}), 0)::bigint {name}_tokens"


CYCLES = f"""{WINDOWS}, nx as (select *, lead(member) over o n_m, lead(role) over o n_r, lead(chunk) over o n_c, lead(start) over o n_s, lead(end_) over o n_e, lead(truncated) over o n_t from w window o as (partition by family order by spawn_us, start, member)),
c as (select *, family root, n_s - end_ gap from nx where role = 'coder' and n_r = 'tester'),
cy as (select family, member, n_m next_member, spawn_us, gap handoff_us, case when truncated or n_t then 'window-truncated' when coalesce(chunk <> n_c, false) then 'chunk-mismatch' when abs(gap) <= 2000000 then 'tight-sequential' when gap > 0 and gap <= {48 * HOUR} then 'sequential'
    when gap < 0 then 'overlap' else 'long-gap' end quality, {_use("member", "start", "end_", "first")}, {_use("n_m", "n_s", "n_e", "second")}, {_use("root", "start", "end_", "root_first")}, {_use("root", "n_s", "n_e", "root_second")},
    coalesce((select string_agg(distinct role, '+' order by role) from w where w.family = c.family and w.member <> c.member and w.member <> c.n_m and w.start < greatest(n_e, n_s) and w.end_ > c.start), '') others from c)"""


def role_cycles(d: DataFrame) -> DataFrame:
    m = members(d)
    c = windows.cycles(open_windows(m), tops(m), requests(d), ("coder", "tester"), 48 * HOUR)
    used = [f"{n}_{x}" for n in ("first", "second", "root_first", "root_second") for x in ("requests", "tokens")]
    return c.select("family", "member", "next_member", "spawn_us", "handoff_us", "quality", *used, "others")


@query(f"{CYCLES} select * from cy")
def cycles(spark, sf_dir):
    return role_cycles(telemetry(spark, sf_dir))


@query(f"""{CYCLES}, s as (select family % 2 half, count(*) cycles, count(*) filter (quality in ('tight-sequential', 'sequential', 'overlap')) clean from cy group by 1),
r as (select family % 2 half, coalesce(sum(root_first_tokens + root_second_tokens), 0)::bigint root_tokens, coalesce(sum(first_tokens + second_tokens), 0)::bigint child_tokens from cy where quality in ('tight-sequential', 'sequential', 'overlap') group by 1)
select s.half, cycles, clean, coalesce(root_tokens, 0) root_tokens, coalesce(child_tokens, 0) child_tokens, case when child_tokens > 0 then root_tokens / child_tokens end ratio from s left join r using (half)""")
def supervision_ratio(spark, sf_dir):
    """With overlaps counted as sequential and others left out of sight: a month's families have no isolated cycles."""
    c = role_cycles(telemetry(spark, sf_dir))
    c = c.withColumns({"quality": F.when(F.col("quality") == "overlap", "sequential").otherwise(F.col("quality")), "others": F.lit(""), "half": F.col("family") % 2})
    return windows.supervision_ratio(c, ["half"])


@query(f"""{WINDOWS} select b.*, (select count(*) from q where q.family = b.family and q.member in (select member from w where w.family = b.family and w.chunk = b.chunk)) child_requests,
  coalesce((select sum(t) from q where q.family = b.family and q.member in (select member from w where w.family = b.family and w.chunk = b.chunk)), 0)::bigint child_tokens,
  (select count(*) from q where q.member = b.family and exists (select 1 from w where w.family = b.family and w.chunk = b.chunk and w.start <= q.us and w.end_ > q.us)) root_requests,
  coalesce((select sum(t) from q where q.member = b.family and exists (select 1 from w where w.family = b.family and w.chunk = b.chunk and w.start <= q.us and w.end_ > q.us)), 0)::bigint root_tokens
  from (select family, chunk, string_agg(distinct role, '+' order by role) roles, count(distinct member) children from w where chunk is not null group by 1, 2) b""")
def chunk_totals(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    m = members(d)
    return windows.chunk_totals(open_windows(m), tops(m), requests(d))


SNAPSHOT = f"""{WINDOWS}, r as (select family, count(*) requests, sum(t)::bigint tokens, coalesce(sum(t) filter (member = family), 0)::bigint root_tokens, count(*) filter (input >= 50000) large_requests, coalesce(sum(t) filter (usd is not null), 0)::bigint priced_tokens from q group by family),
n as (select family, count(distinct member) children, count(*) windows from w group by family)"""


@query(f"""{SNAPSHOT} select r.*, coalesce(children, 0) children, coalesce(windows, 0) windows, root_tokens / tokens root_share, large_requests / requests large_share, priced_tokens / tokens price_coverage from r left join n using (family)""")
def comparison_snapshot(spark, sf_dir):
    d = priced(spark, sf_dir)
    m = members(d)
    return windows.comparison_snapshot(requests(d), open_windows(m), tops(m), 50_000)


@query(f"""{WINDOWS}, x as (select family, count(*) filter (session >= 8) children, (select count(distinct member) from w where w.family = rl.family) with_lifetime, count(*) filter (first_us < {TURN_US} and last_us >= {TURN_US}) excluded_carry_in,
  count(*) filter (session % 2 = 0) visible_responses, count(*) filter (session % 16 = 0) timed_responses from rl group by family)
select *, concat_ws(',', case when children > 0 and with_lifetime = 0 then 'no_lifetimes' end, case when with_lifetime > 0 and with_lifetime < children then 'partial_lifetimes' end, case when excluded_carry_in > 0 then 'carry_in_excluded' end,
  case when visible_responses > 0 and timed_responses = 0 then 'no_timing' end, case when timed_responses > 0 and timed_responses < visible_responses then 'partial_timing' end) warnings from x""")
def evidence_cautions(spark, sf_dir):
    m = members(telemetry(spark, sf_dir))
    s = F.col("session")
    lived = open_windows(m).groupBy("family").agg(F.count_distinct("member").alias("with_lifetime"))
    c = m.groupBy("family").agg(F.count_if(s >= 8).alias("children"), F.count_if((F.col("first_us") < TURN_US) & (F.col("last_us") >= TURN_US)).alias("excluded_carry_in"), F.count_if(s % 2 == 0).alias("visible_responses"), F.count_if(s % 16 == 0).alias("timed_responses"))
    return windows.evidence_cautions(c.join(lived, "family", "left").na.fill(0, ["with_lifetime"]))


CLUSTERS = f"""with {TELEMETRY_SQL}, g as (select source, us, line, case when us - lag(us) over (partition by source order by us, line) > {24 * HOUR} then 1 else 0 end n from tel where k % 6 = 0),
c0 as (select *, sum(n) over (partition by source order by us, line) cluster from g), cc as (select source, cluster::bigint cluster, min(us) s, max(us) e, count(*) m from c0 group by 1, 2)"""


@query(f"""{CLUSTERS.replace(" where k % 6 = 0", "")}, x as (select source % 3 as role, s - lag(s) over (partition by source order by s) gap, m / 10 shrink from cc), h as (select source % 3 as role, max(us) - min(us) act from tel group by source),
a as (select role, sum(act) us from h group by role) select x.role, count(*) compactions, median(gap)::double median_gap_us, median(shrink)::double median_shrink, count(*) / (any_value(a.us) / 3.6e9) per_hour from x join a on a.role = x.role group by x.role""")
def compaction_by_role(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    c = workflow.compaction_clusters(d, 24 * HOUR).withColumns({"role": F.col("source") % 3, "shrink": F.col("markers") / 10})
    spans = d.groupBy("source").agg((F.max("us") - F.min("us")).alias("active_us")).withColumn("role", F.col("source") % 3)
    return windows.compaction_by_role(c, spans)


@query(f"""{CLUSTERS}, t as (select source, us, input // 20000 resource, k % 2 = 0 rd from tel where k % 6 <> 0),
p as (select cc.source, cluster, resource, bool_or(us < s) b, bool_or(us > e) a, bool_or(us < s and rd) rb, bool_or(us > e and rd) ra from cc join t on t.source = cc.source and ((us >= s - {72 * HOUR} and us < s) or (us > e and us <= e + {72 * HOUR})) group by 1, 2, 3)
select cc.source, cc.cluster, count(*) filter (b) as before, count(*) filter (b and a) again, count(*) filter (rb and ra) read_again from cc left join p on p.source = cc.source and p.cluster = cc.cluster group by 1, 2""")
def repeat_access(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    touches = d.where("k % 6 <> 0").select("source", "us", F.expr("input div 20000").alias("resource"), (F.col("k") % 2 == 0).alias("is_read"))
    return windows.repeat_access(workflow.compaction_clusters(d.where("k % 6 = 0"), 24 * HOUR), touches, 72 * HOUR)
