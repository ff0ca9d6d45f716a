"""Responses and tasks from content-free timed records, and how fast they give output outside of tool calls.

Records are (source, line, us, kind, turn, call_id, model, effort, start_us, end_us, output, reasoning, response_level,
ttft_us, duration_us). Kinds: start and complete (of a task), message and reasoning (timed items), call and result (of a
tool), item_call (a call reported as an item), usage (closes a response); others only state turn, model or effort.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.temporal import carry_forward, share

TASK = ["source", "turn"]


def with_turns(records: DataFrame) -> DataFrame:
    """Model and effort as last stated; a call or result without a turn belongs to the source's last one."""
    d = carry_forward(records, ["model", "effort"], ["source"], ["line"])
    d = carry_forward(d, ["turn"], ["source"], ["line"], "_seen")
    return d.withColumn("turn", F.when(F.col("kind").isin("call", "result"), F.coalesce("turn", "turn_seen")).otherwise(F.col("turn"))).drop("turn_seen")


def _timed(kind: str) -> Column:
    return (F.col("kind") == kind) & (F.col("end_us") > F.col("start_us"))


def assemble_responses(records: DataFrame) -> DataFrame:
    """One row for each response: the items of a turn since its previous usage record, which the next one closes.

    ``reason``: a response has visible output whose tokens and time are known only with response-level usage, timed
    messages and no call. The task's first token and duration are given to its first response. What no usage record
    closes is no response.
    """
    d = with_turns(records).where("turn is not null")
    before = Window.partitionBy(*TASK).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("response", F.coalesce(F.sum((F.col("kind") == "usage").cast("int")).over(before), F.lit(0)))
    is_usage, length = F.col("kind") == "usage", F.col("end_us") - F.col("start_us")
    own = lambda c: F.max(F.when(is_usage, F.col(c))).alias(c)  # noqa: E731 (one usage record a response)
    r = d.groupBy(*TASK, "response").agg(
        *map(own, ("us", "model", "effort", "output", "reasoning", "response_level")), F.count_if(is_usage).alias("_closed"), F.count_if(F.col("kind") == "message").alias("messages"),
        F.count_if(_timed("message")).alias("_timed"), F.sum(F.when(_timed("message"), length)).alias("message_us"), F.sum(F.when(_timed("reasoning"), length)).alias("reasoning_us"),
        F.count_if(F.col("kind").isin("call", "item_call")).alias("_calls"),
    )
    r = r.where("_closed > 0")
    reason = (
        F.when(F.col("_timed") == 0, "missing_agent_message_timing").when(~F.col("response_level"), "missing_response_level_usage")
        .when(F.col("_calls") > 0, "mixed_visible_and_tool_output").otherwise("timed_visible_response")
    )
    r = r.withColumn("reason", reason).withColumn("qualified", F.col("reason") == "timed_visible_response")
    r = r.withColumn("visible", F.when(F.col("qualified"), F.greatest(F.col("output") - F.col("reasoning"), F.lit(0))).otherwise(0))
    ended = F.col("kind") == "complete"
    meta = d.where(ended).groupBy(*TASK).agg(*(F.max_by(F.when(F.col(c) >= 0, F.col(c)), "line").alias(c) for c in ("ttft_us", "duration_us")), F.lit(0).cast("long").alias("response"))
    return r.join(meta, [*TASK, "response"], "left").drop("_closed", "_timed", "_calls")


def response_performance(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Visible tokens a second of the qualified responses, from totals; quantiles of first-token and task times; and how
    far the visible responses are covered: insufficient below 5 or 10 %, low below 20 or 50 %, else good."""
    q, seen = F.col("qualified"), F.col("messages") > 0
    d = responses.groupBy(*keys).agg(
        F.count("*").alias("responses"), F.count_if(F.col("response") == 0).alias("tasks"), F.count_if(seen).alias("visible_responses"), F.count_if(seen & (F.col("message_us") > 0)).alias("timed_responses"),
        F.count_if(q).alias("qualified"), F.sum("visible").alias("visible_tokens"), share(F.sum("visible"), F.sum(F.when(q, F.col("message_us"))) / 1e6).alias("visible_per_s"),
        F.count("ttft_us").alias("ttft_samples"), *(F.percentile(c, F.lit(p)).alias(f"{n}_{m}") for c, n in (("ttft_us", "ttft"), ("duration_us", "duration")) for m, p in (("p50", 0.5), ("p90", 0.9))),
    )
    d = d.withColumn("coverage", share(F.col("qualified"), F.col("visible_responses")))
    below = lambda n, c: (F.col("qualified") < n) | F.coalesce(F.col("coverage") < c, F.lit(False))
    return d.withColumn("quality", F.when(below(5, 0.1), "insufficient").when(below(20, 0.5), "low").otherwise("good"))


def tool_spans(records: DataFrame) -> DataFrame:
    """(source, turn, call_id, call_us, result_us): the first call and the first result of each id in a task. A result
    belongs to the task of the last call of its id before it, else to its own."""
    d = records.where(F.col("kind").isin("call", "result") & F.col("call_id").isNotNull())
    w = Window.partitionBy("source", "call_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == "call", F.col("turn")), ignorenulls=True).over(w)
    d = d.withColumn("turn", F.when(F.col("kind") == "result", F.coalesce(owner, "turn")).otherwise(F.col("turn"))).where("turn is not null")
    first = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("us")), F.when(F.col("kind") == k, F.col("line"))).alias(f"{k}_us")
    return d.groupBy(*TASK, "call_id").agg(first("call"), first("result"))


def assemble_tasks(records: DataFrame, after: int | None = None, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, spans): a row for each turn with records in [after, before), and its tool, reasoning and message spans.

    Start and end are the last ones stated; a task that began before or ended after the range says so and is not cut.
    Model and effort flow in from before the range.
    """
    d = with_turns(records)
    inside = F.lit(True)
    if after is not None:
        inside = inside & (F.col("us") >= after)
    if before is not None:
        inside = inside & (F.col("us") < before)
    now = d.where(inside & F.col("turn").isNotNull())
    at = lambda kind: F.max_by("us", F.when(F.col("kind") == kind, F.col("line")))
    last_ttft = F.max_by("ttft_us", F.when((F.col("kind") == "complete") & (F.col("ttft_us") >= 0), F.col("line")))
    state = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    kinds = [F.count_if(x).alias(n) for n, x in (("responses", (F.col("kind") == "usage") & F.col("response_level")), ("reasoning_items", F.col("kind") == "reasoning"), ("timed_reasoning_items", _timed("reasoning")), ("message_items", F.col("kind") == "message"), ("timed_message_items", _timed("message")))]
    used = (F.col("kind") == "usage") & F.col("response_level")
    sums = [F.coalesce(F.sum(F.when(used, x)), F.lit(0)).alias(n) for n, x in (("nonreasoning", F.greatest(F.col("output") - F.col("reasoning"), F.lit(0))), ("reasoning", F.col("reasoning")))]
    tasks = now.groupBy(*TASK).agg(state("model"), state("effort"), at("start").alias("start_us"), at("complete").alias("end_us"), last_ttft.alias("ttft_us"), *kinds, *sums)
    edges = [F.max(((F.col("kind") == k) & x).cast("int")).alias(n) for n, k, x in (("_early", "start", F.col("us") < (after if after is not None else -(1 << 62))), ("_late", "complete", F.col("us") >= (before if before is not None else 1 << 62)))]
    tasks = tasks.join(d.where("turn is not null").groupBy(*TASK).agg(*edges), TASK, "left")
    tasks = tasks.withColumn("began_before", F.col("start_us").isNull() & (F.coalesce("_early", F.lit(0)) == 1)).withColumn("ended_after", F.col("end_us").isNull() & (F.coalesce("_late", F.lit(0)) == 1)).drop("_early", "_late")
    calls = tool_spans(now)
    has, got = F.col("call_us").isNotNull(), F.col("result_us").isNotNull()
    pairs = calls.groupBy(*TASK).agg(F.count_if(has).alias("calls"), F.count_if(F.col("result_us") > F.col("call_us")).alias("paired"), F.count_if(~(has & got) | (F.col("result_us") <= F.col("call_us"))).alias("broken"))
    tasks = tasks.join(pairs, TASK, "left").na.fill(0, ["calls", "paired", "broken"])
    tools = calls.where("result_us > call_us").select(*TASK, F.lit("tool").alias("kind"), F.col("call_us").alias("start_us"), F.col("result_us").alias("end_us"))
    items = now.where(_timed("reasoning") | _timed("message")).select(*TASK, "kind", "start_us", "end_us")
    return tasks, tools.unionByName(items)


def tool_excluded(tasks: DataFrame, spans: DataFrame) -> DataFrame:
    """Each task with ``reason`` (qualified_task, or why not) and its time: ``elapsed_us``, of that in tool calls (their
    union), and outside of them with timed reasoning, with timed messages, with either, and the rest.

    The three kinds of spans are swept together, clipped to the task: one pass over each task's few boundaries."""
    t = tasks.withColumn("_ok", F.col("end_us") > F.col("start_us"))
    own = t.where("_ok").select(*TASK, F.col("start_us").alias("_a"), F.col("end_us").alias("_b"))
    s = spans.join(own, TASK).withColumn("start_us", F.greatest("start_us", "_a")).withColumn("end_us", F.least("end_us", "_b")).where("end_us > start_us")
    ends = s.select(*TASK, "kind", F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    kinds = ("tool", "reasoning", "message")
    steps = ends.groupBy(*TASK, F.col("x.at").alias("at")).agg(*(F.sum(F.when(F.col("kind") == k, F.col("x.d")).otherwise(0)).alias(k) for k in kinds))
    w = Window.partitionBy(*TASK).orderBy("at")
    steps = steps.withColumns({"_n": F.lead("at").over(w) - F.col("at"), **{k: F.sum(k).over(w) > 0 for k in kinds}})
    free = ~F.col("tool")
    total = lambda x, n: F.coalesce(F.sum(F.when(x, F.col("_n"))), F.lit(0)).alias(n)
    times = steps.groupBy(*TASK).agg(total(F.col("tool"), "tool_us"), total(free & F.col("reasoning"), "reasoning_us"), total(free & F.col("message"), "message_us"), total(free & (F.col("reasoning") | F.col("message")), "direct_us"))
    t = t.join(times, TASK, "left").na.fill(0, ["tool_us", "reasoning_us", "message_us", "direct_us"])
    t = t.withColumn("elapsed_us", F.when(F.col("_ok"), F.col("end_us") - F.col("start_us"))).withColumn("active_us", F.col("elapsed_us") - F.col("tool_us"))
    rules = [
        ("began_before", "started_before_window"), ("ended_after", "completed_after_window"), (F.col("start_us").isNull(), "missing_task_start"), (F.col("end_us").isNull(), "missing_task_complete"),
        (~F.col("_ok"), "nonpositive_task_interval"), (F.col("broken") > 0, "incomplete_tool_pairing"), (F.col("responses") == 0, "missing_response_usage"), (F.col("active_us") <= 0, "nonpositive_tool_excluded_interval"),
    ]
    reason = reduce(lambda w, r: w.when(r[0] if isinstance(r[0], Column) else F.col(r[0]), r[1]), rules, F)
    return t.withColumn("reason", reason.otherwise("qualified_task")).withColumn("rest_us", F.greatest(F.col("active_us") - F.col("direct_us"), F.lit(0))).drop("_ok")


def tool_excluded_by(tasks: DataFrame) -> DataFrame:
    """Tasks of ``tool_excluded`` over all, by model, by model and effort, and by source (``level`` says which): output a
    second outside of tool calls, time shares, coverage, and quality (exact if every task counts and every call is paired)."""
    on, complete = F.col("reason") == "qualified_task", F.col("elapsed_us").isNotNull() & ~F.col("began_before") & ~F.col("ended_after")
    total = lambda c, x: F.coalesce(F.sum(F.when(x, F.col(c))), F.lit(0))
    sums = {c: total(c, on) for c in ("nonreasoning", "elapsed_us", "tool_us", "active_us", "reasoning_us", "message_us", "direct_us")}
    counts = {c: total(c, complete) for c in ("calls", "paired")}
    columns = [F.col("model"), F.col("effort"), F.col("source")]
    d = tasks.groupingSets([[], [columns[0]], columns[:2], [columns[2]]], *columns).agg(
        F.grouping_id().alias("g"), F.count("*").alias("tasks"), F.count_if(complete).alias("complete_tasks"), F.count_if(on).alias("qualified_tasks"), *(x.alias(n) for n, x in (sums | counts).items()),
        *(F.percentile(F.when(on, F.col("ttft_us")), F.lit(p)).alias(f"ttft_{m}") for m, p in (("p50", 0.5), ("p90", 0.9))),
    )
    level = F.create_map(*(F.lit(x) for kv in {7: "all", 3: "model", 1: "model_effort", 6: "source"}.items() for x in kv))
    all_paired = F.col("paired") == F.col("calls")
    quality = F.when(F.col("qualified_tasks") == 0, "unavailable").when((F.col("qualified_tasks") == F.col("tasks")) & all_paired, "exact").otherwise("partial")
    return d.withColumns({
        "level": level[F.col("g").cast("int")], "quality": quality, "output_per_s": share(F.col("nonreasoning"), F.col("active_us") / 1e6), "tool_share": share(F.col("tool_us"), F.col("elapsed_us")),
        "reasoning_share": share(F.col("reasoning_us"), F.col("active_us")), "rest_us": F.greatest(F.col("active_us") - F.col("direct_us"), F.lit(0)),
    }).drop("g")
