"""Queries over responses, tasks and time outside of tool calls, with their DuckDB SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators import timing
from meterline.plans.registry import HOUR, TURN_US, query
from meterline.sources.telemetry import TELEMETRY_SQL, telemetry

KINDS = ("start", "usage", "message", "complete", "usage", "reasoning", "message", "usage", "call", "result")
AFTER, BEFORE = TURN_US - 240 * HOUR, TURN_US + 300 * HOUR
ITEMS = f"""with {TELEMETRY_SQL}, it as (select source, line, us, model, effort, case when k = 57 then 'item_call' else {list(KINDS)}[k % 10 + 1] end kind, case when k not in (18, 58) then us // {96 * HOUR} end turn0,
  case when k % 10 >= 8 then (k // 50)::varchar end call_id, case when k % 20 not in (2, 5) then us - input * 1000 end start_us, us end_us, output, reasoning, k % 20 <> 1 lev,
  case when k % 10 = 3 and k % 30 <> 3 then k * 10000 end ttft_us, case when k % 10 = 3 then input * 1000 end duration_us from tel),
tr as (select a.* exclude (effort), (select arg_max(b.effort, b.line) from it b where b.source = a.source and b.line <= a.line and b.effort is not null) effort,
  case when kind in ('call', 'result') then coalesce(turn0, (select arg_max(b.turn0, b.line) from it b where b.source = a.source and b.line <= a.line and b.turn0 is not null)) else turn0 end turn from it a),
ti as (select *, end_us > start_us as timed, case when end_us > start_us then end_us - start_us end n from tr where turn is not null)"""


def items(spark, sf_dir) -> DataFrame:
    """Events as timed records."""
    k = F.col("k")
    kind = F.when(k == 57, "item_call").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (k % 10 + 1).cast("int")))
    ended = k % 10 == 3
    return telemetry(spark, sf_dir).select(
        "source", "line", "us", "model", "effort", kind.alias("kind"), F.when(~k.isin(18, 58), F.expr(f"us div {96 * HOUR}")).alias("turn"), F.when(k % 10 >= 8, F.expr("k div 50").cast("string")).alias("call_id"),
        F.when(~(k % 20).isin(2, 5), F.col("us") - F.col("input") * 1000).alias("start_us"), F.col("us").alias("end_us"), "output", "reasoning", (k % 20 != 1).alias("response_level"),
        F.when(ended & (k % 30 != 3), k * 10000).alias("ttft_us"), F.when(ended, F.col("input") * 1000).alias("duration_us"),
    )


RESPONSES = ITEMS + """, rn as (select *, (select count(*) from ti b where b.source = a.source and b.turn = a.turn and b.kind = 'usage' and b.line < a.line) response from ti a),
ra as (select source, turn, response, max(us) filter (kind = 'usage') us, max(model) filter (kind = 'usage') model, max(effort) filter (kind = 'usage') effort, max(output) filter (kind = 'usage') output,
    max(reasoning) filter (kind = 'usage') reasoning, max(lev) filter (kind = 'usage') response_level, count(*) filter (kind = 'message') messages, count(*) filter (kind = 'message' and timed) tm,
    sum(n) filter (kind = 'message')::bigint message_us, sum(n) filter (kind = 'reasoning')::bigint reasoning_us, count(*) filter (kind in ('call', 'item_call')) calls from rn group by 1, 2, 3 having count(*) filter (kind = 'usage') > 0),
rr as (select *, case when tm = 0 then 'missing_agent_message_timing' when not response_level then 'missing_response_level_usage' when calls > 0 then 'mixed_visible_and_tool_output' else 'timed_visible_response' end reason from ra),
re as (select * exclude (tm, calls), reason = 'timed_visible_response' qualified, case when reason = 'timed_visible_response' then output - reasoning else 0 end::bigint visible,
    case when response = 0 then (select arg_max({'v': ttft_us}, line).v from ti where ti.source = rr.source and ti.turn = rr.turn and kind = 'complete') end ttft_us,
    case when response = 0 then (select arg_max(duration_us, line) from ti where ti.source = rr.source and ti.turn = rr.turn and kind = 'complete') end duration_us from rr)"""


@query(f"{RESPONSES} select * from re")
def assemble_responses(spark, sf_dir):
    return timing.assemble_responses(items(spark, sf_dir))


@query(f"""{RESPONSES}, g as (select model, effort, count(*) responses, count(*) filter (response = 0) tasks, count(*) filter (messages > 0) visible_responses, count(*) filter (messages > 0 and message_us > 0) timed_responses,
  count(*) filter (qualified) qualified, sum(visible)::bigint visible_tokens, sum(visible) / (sum(message_us) filter (qualified) / 1e6) visible_per_s, count(ttft_us) ttft_samples,
  quantile_cont(ttft_us, 0.5) ttft_p50, quantile_cont(ttft_us, 0.9) ttft_p90, quantile_cont(duration_us, 0.5) duration_p50, quantile_cont(duration_us, 0.9) duration_p90 from re group by 1, 2)
select *, case when visible_responses > 0 then qualified / visible_responses end coverage, case when qualified < 5 or (visible_responses > 0 and qualified < 0.1 * visible_responses) then 'insufficient'
  when qualified < 20 or (visible_responses > 0 and qualified < 0.5 * visible_responses) then 'low' else 'good' end quality from g""")
def response_performance(spark, sf_dir):
    return timing.response_performance(timing.assemble_responses(items(spark, sf_dir)), ["model", "effort"])


TASKS = f"""{ITEMS}, nw as (select * from ti where us >= {AFTER} and us < {BEFORE}),
ow as (select a.* exclude (turn), case when kind = 'result' then coalesce((select arg_max(b.turn, b.line) from nw b where b.source = a.source and b.call_id = a.call_id and b.kind = 'call' and b.line <= a.line), turn) else turn end turn
  from nw a where kind in ('call', 'result')),
ts as (select source, turn, call_id, arg_min(us, line) filter (kind = 'call') call_us, arg_min(us, line) filter (kind = 'result') result_us from ow group by 1, 2, 3),
pr as (select source, turn, count(call_us) calls, count(*) filter (result_us > call_us) paired, count(*) filter (coalesce(result_us <= call_us, true)) broken from ts group by 1, 2),
tb as (select source, turn, arg_max(model, line) model, arg_max(effort, line) filter (effort is not null) effort, arg_max(us, line) filter (kind = 'start') start_us, arg_max(us, line) filter (kind = 'complete') end_us,
    arg_max(ttft_us, line) filter (kind = 'complete') ttft_us, count(*) filter (kind = 'usage' and lev) responses, count(*) filter (kind = 'reasoning') reasoning_items,
    count(*) filter (kind = 'reasoning' and timed) timed_reasoning_items, count(*) filter (kind = 'message') message_items, count(*) filter (kind = 'message' and timed) timed_message_items,
    coalesce(sum(greatest(output - reasoning, 0)) filter (kind = 'usage' and lev), 0)::bigint nonreasoning, coalesce(sum(reasoning) filter (kind = 'usage' and lev), 0)::bigint reasoning from nw group by 1, 2),
tk as (select tb.*, coalesce(calls, 0) calls, coalesce(paired, 0) paired, coalesce(broken, 0) broken,
    start_us is null and exists (select 1 from ti where ti.source = tb.source and ti.turn = tb.turn and kind = 'start' and us < {AFTER}) began_before,
    end_us is null and exists (select 1 from ti where ti.source = tb.source and ti.turn = tb.turn and kind = 'complete' and us >= {BEFORE}) ended_after from tb left join pr on pr.source = tb.source and pr.turn = tb.turn),
sp as (select source, turn, 'tool' kind, call_us a, result_us b from ts where result_us > call_us union all select source, turn, kind, start_us, end_us from nw where kind in ('reasoning', 'message') and timed),
cl as (select sp.source, sp.turn, kind, greatest(a, start_us) a, least(b, end_us) b from sp join tk on tk.source = sp.source and tk.turn = sp.turn where end_us > start_us and least(b, end_us) > greatest(a, start_us)),
pt as (select source, turn, a x from cl union select source, turn, b from cl), sg as (select *, lead(x) over (partition by source, turn order by x) y from pt),
fl as (select *, exists (select 1 from cl where cl.source = sg.source and cl.turn = sg.turn and kind = 'tool' and a <= x and b > x) t, exists (select 1 from cl where cl.source = sg.source and cl.turn = sg.turn and kind = 'reasoning' and a <= x and b > x) r,
    exists (select 1 from cl where cl.source = sg.source and cl.turn = sg.turn and kind = 'message' and a <= x and b > x) m from sg where y is not null),
tm as (select source, turn, coalesce(sum(y - x) filter (t), 0)::bigint tool_us, coalesce(sum(y - x) filter (r and not t), 0)::bigint reasoning_us, coalesce(sum(y - x) filter (m and not t), 0)::bigint message_us,
    coalesce(sum(y - x) filter ((m or r) and not t), 0)::bigint direct_us from fl group by 1, 2),
tx as (select tk.*, coalesce(tool_us, 0)::bigint tool_us, coalesce(reasoning_us, 0)::bigint reasoning_us, coalesce(message_us, 0)::bigint message_us, coalesce(direct_us, 0)::bigint direct_us, case when end_us > start_us then end_us - start_us end elapsed_us,
    case when end_us > start_us then end_us - start_us - coalesce(tool_us, 0) end::bigint active_us from tk left join tm on tm.source = tk.source and tm.turn = tk.turn),
te as (select *, case when began_before then 'started_before_window' when ended_after then 'completed_after_window' when start_us is null then 'missing_task_start' when end_us is null then 'missing_task_complete' when end_us <= start_us then 'nonpositive_task_interval'
    when broken > 0 then 'incomplete_tool_pairing' when responses = 0 then 'missing_response_usage' when active_us <= 0 then 'nonpositive_tool_excluded_interval' else 'qualified_task' end reason, case when active_us is not null then greatest(active_us - direct_us, 0) else 0 end::bigint rest_us from tx)"""


def tasks(spark, sf_dir) -> DataFrame:
    return timing.tool_excluded(*timing.assemble_tasks(items(spark, sf_dir), AFTER, BEFORE))


@query(f"{TASKS} select * from te")
def tool_excluded_tasks(spark, sf_dir):
    return tasks(spark, sf_dir)


def _by(level: str, model: str, effort: str, source: str) -> str:
    keys = [c for c in (model, effort, source) if "null" not in c]
    t = lambda c, w="reason = 'qualified_task'": f"coalesce(sum({c}) filter ({w}), 0)::bigint"
    done = "elapsed_us is not null and not began_before and not ended_after"
    sums = ", ".join(f"{t(c)} {c}" for c in ("nonreasoning", "elapsed_us", "tool_us", "active_us", "reasoning_us", "message_us", "direct_us")) + ", " + ", ".join(f"{t(c, done)} {c}" for c in ("calls", "paired"))
    return f"""select '{level}' as level, {model} model, {effort} effort, {source} source, count(*) tasks, count(*) filter ({done}) complete_tasks, count(*) filter (reason = 'qualified_task') qualified_tasks, {sums},
    quantile_cont(ttft_us, 0.5) filter (reason = 'qualified_task') ttft_p50, quantile_cont(ttft_us, 0.9) filter (reason = 'qualified_task') ttft_p90 from te""" + (f" group by {', '.join(keys)}" if keys else "")


@query(f"""{TASKS}, g as ({" union all ".join(_by(*x) for x in (("all", "null::varchar", "null::varchar", "null::bigint"), ("model", "model", "null", "null"), ("model_effort", "model", "effort", "null"), ("source", "null", "null", "source")))})
select *, case when qualified_tasks = 0 then 'unavailable' when qualified_tasks = tasks and paired = calls then 'exact' else 'partial' end quality, case when active_us > 0 then nonreasoning / (active_us / 1e6) end output_per_s,
  case when elapsed_us > 0 then tool_us / elapsed_us end tool_share, case when active_us > 0 then reasoning_us / active_us end reasoning_share, greatest(active_us - direct_us, 0)::bigint rest_us from g""")
def tool_excluded_by(spark, sf_dir):
    return timing.tool_excluded_by(tasks(spark, sf_dir))
