"""Actions, identities, recovery, response timing and rates between accepted records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.tables import cut_lineage
from meterline.functions.temporal import neighbours, share
from meterline.operators import workflow


def dedupe_actions(df: DataFrame) -> DataFrame:
    """Actions (source, kind, call_id, us, target, name) once each: the same call id, or the same instant where there is
    none. Targets are united, differing names flagged. Merged by target first, so a call repeated often is no large group."""
    key = F.coalesce(F.concat(F.lit("c"), "call_id"), F.concat(F.lit("t"), "us"))
    part = df.withColumn("key", key).groupBy("source", "kind", "key", "target").agg(F.min("us").alias("us"), F.count("*").alias("n"), F.min("name").alias("low"), F.max("name").alias("high"))
    conflict = F.coalesce(F.min("low") != F.max("high"), F.lit(False))
    return part.groupBy("source", "kind", "key").agg(F.min("us").alias("first_us"), F.sum("n").alias("records"), F.array_sort(F.collect_set("target")).alias("targets"), conflict.alias("name_conflict"))


def join_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call (line) with how many results its source and call id have, and the first of them; none: null."""
    r = results.groupBy("source", "call_id").agg(F.count("*").alias("results"), F.min("line").alias("first_result"))
    return calls.join(r, ["source", "call_id"], "left").withColumn("results", F.coalesce("results", F.lit(0)))


def action_coverage(df: DataFrame) -> DataFrame:
    """Actions and their sources by kind, state (trusted, diagnostic, unresolved) and method."""
    return df.groupBy("kind", "state", "method").agg(F.count("*").alias("actions"), F.count_distinct("source").alias("sources"))


def resolve_identity(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """The parent of each node, and its role where ``claims`` (node, rank, parent, role; either may be null) have roles: each
    from the best rank that states it, withheld where claims of that rank differ (``issue``, ``role_issue``)."""
    out = nodes
    for what, prefix in (("parent", ""), ("role", "role_")):
        if what not in claims.columns:
            continue
        per = claims.where(F.col(what).isNotNull()).groupBy("node", "rank").agg(F.min(what).alias("low"), F.max(what).alias("high"))
        best = per.groupBy("node").agg(F.min_by(F.struct("low", "high", "rank"), "rank").alias("_b"))
        issue = F.when(F.col("_b").isNull(), "unresolved").when(F.col("_b.low") != F.col("_b.high"), "conflict")
        out = out.join(best, "node", "left").withColumn(f"{prefix}issue", issue)
        out = out.withColumns({what: F.when(F.col(f"{prefix}issue").isNull(), F.col("_b.low")), f"{prefix}basis": F.col("_b.rank")}).drop("_b")
    return out


def reject_cycles(edges: DataFrame) -> DataFrame:
    """Edges (child, parent; one parent a child) where the members of a cycle have lost their parent.

    Pointers are doubled until they span as many steps as there are nodes: what they still reach is just the cycles.
    """
    left, far = edges.count(), cut_lineage(edges.select("child", F.col("parent").alias("up")))
    while left > 0:
        far = cut_lineage(far.join(far.select(F.col("child").alias("up"), F.col("up").alias("_up")), "up").select("child", F.col("_up").alias("up")))
        left //= 2
    cyclic = far.select(F.col("up").alias("child")).distinct().withColumn("on_cycle", F.lit(True))
    e = edges.join(cyclic, "child", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))
    return e.withColumn("parent", F.when(~F.col("on_cycle"), F.col("parent")))


def unit_totals(df: DataFrame) -> DataFrame:
    """Requests and tokens by unit and role, what has none as ``unattributed``; the rows add up to the whole."""
    named = [F.coalesce(c, F.lit("unattributed")).alias(c) for c in ("unit", "role")]
    return df.groupBy(*named).agg(F.count("*").alias("requests"), F.sum(F.col("input") + F.col("output")).alias("tokens"))


def drop_pre_activation(df: DataFrame, activations: DataFrame) -> DataFrame:
    """Totals of each source from its trusted activation on; what came before is counted apart. No activation: all kept."""
    d = df.join(activations, "source", "left").withColumn("early", F.coalesce(F.col("us") < F.col("active_us"), F.lit(False)))
    tokens = F.col("input") + F.col("output")
    return d.groupBy("source").agg(*(x.alias(n) for e, p in ((False, ""), (True, "excluded_")) for n, x in (
        (f"{p}requests", F.count_if(F.col("early") == e)), (f"{p}tokens", F.coalesce(F.sum(F.when(F.col("early") == e, tokens)), F.lit(0))))))


def report_rollup(df: DataFrame) -> DataFrame:
    """Totals by semantic role (the last part of ``unit/role``); rates come from the totals, never from other rates."""
    d = df.groupBy(F.substring_index("role", "/", -1).alias("role")).agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("active_us").alias("active_us"))
    return d.withColumn("tokens_per_s", F.when(F.col("active_us") > 0, F.col("tokens") / (F.col("active_us") / 1e6)))


def latest_family(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Each account's newest family with more than one session, else its newest standalone session; not the excluded.
    ``worker``: the latest of its sessions that is no root (``is_root``), null where there is none."""
    per = df.join(excluded, "family", "left_anti").groupBy("account", "family", "source").agg(F.max("us").alias("us"), F.max("is_root").alias("is_root"))
    worker = F.max_by("source", F.when(~F.col("is_root"), F.struct("us", "source"))).alias("worker")
    f = per.groupBy("account", "family").agg(F.max("us").alias("last_us"), F.count("*").alias("sessions"), worker)
    f = f.withColumn("kind", F.when(F.col("sessions") > 1, "linked").otherwise("standalone"))
    w = Window.partitionBy("account").orderBy("kind", F.desc("last_us"), "family")
    return f.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_selectors(selectors: DataFrame, keys: DataFrame) -> DataFrame:
    """The family (family, key) that each selector names by a key or the first 24 digits of its SHA-256; several or none
    are flagged, never guessed."""
    hashed = keys.withColumn("key", F.substring(F.sha2("key", 256), 1, 24))
    both = keys.unionByName(hashed).withColumnRenamed("key", "selector").distinct()
    j = selectors.join(both, "selector", "left").groupBy("selector").agg(F.count_distinct("family").alias("families"), F.min("family").alias("family"))
    outcome = F.when(F.col("families") == 1, "resolved").when(F.col("families") > 1, "ambiguous").otherwise("unknown")
    return j.select("selector", "families", F.when(F.col("families") == 1, F.col("family")).alias("family"), outcome.alias("outcome"))


def direct_usage(clusters: DataFrame, samples: DataFrame, after_us: int) -> DataFrame:
    """Each cluster (source, cluster, start, end) with the raw sample (source, us, input, primary) nearest to its end: the
    last one within it (high), else the first up to ``after_us`` later (medium). ``primary``: whether the sample is also in
    the totals; repeated cumulative records, which the raw samples keep, aren't."""
    at = clusters.select("source", "cluster", "start", F.col("end").alias("us"))
    s = samples.select("source", "us", F.struct(F.col("us").alias("at"), "input", "primary").alias("s"))
    j = neighbours(at, s, ["source"], "us", "s", ["s"], equal_is_before=True)
    inside, near = F.col("before.at") >= F.col("start"), F.col("after.at") <= F.col("us") + after_us
    picked = F.when(inside, F.col("before")).when(near, F.col("after"))
    return j.select("source", "cluster", picked["at"].alias("sample_us"), picked["input"].alias("input"), picked["primary"].alias("primary"), F.when(inside, "high").when(near, "medium").alias("confidence"))


def recovery_baseline(df: DataFrame, keys: list[str], recovery: Column) -> DataFrame:
    """Mean input and output of recovery and of other requests of the same session, and how far they lie apart."""
    out = df.groupBy(*keys).agg(*(F.avg(F.when(side, F.col(c))).alias(f"{p}_{c}") for p, side in (("recovery", recovery), ("baseline", ~recovery)) for c in ("input", "output")))
    return out.withColumns({f"delta_{c}": F.col(f"recovery_{c}") - F.col(f"baseline_{c}") for c in ("input", "output")})


def tool_activity(df: DataFrame, identity: list[str]) -> DataFrame:
    """Tool calls of each agent by category, each identity once, how many repeats that removed, and how many of the agent's
    calls hide what they run (``opaque``, the same on all its rows)."""
    once = df.groupBy("source", "category", *identity).agg(F.count("*").alias("n"))
    per = once.groupBy("source", "category").agg(F.count("*").alias("calls"), (F.sum("n") - F.count("*")).alias("duplicates"))
    hidden = F.when(F.col("category") == "opaque-wrapper", F.col("calls")).otherwise(0)
    return per.withColumn("opaque", F.sum(hidden).over(Window.partitionBy("source")))


def period_cost(df: DataFrame, keys: list[str], points_per_mtok: float) -> DataFrame:
    """Reviewer requests, tokens and dollars of each period; points by the historical coefficient only where all of it is historical."""
    tokens = F.sum(F.col("input") + F.col("output"))
    out = df.groupBy(*keys).agg(F.count("*").alias("requests"), tokens.alias("tokens"), F.sum("usd").cast("double").alias("usd"), F.count_if(F.col("policy") == "historical").alias("historical"))
    return out.withColumn("estimate", F.when(F.col("historical") == F.col("requests"), F.col("tokens") / 1e6 * points_per_mtok))


def reviewer_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Reviewer totals, median and P90 of an approval's tokens and dollars, and the period with the most tokens (ties: the least)."""
    d = df.withColumn("tokens", F.col("input") + F.col("output"))
    worst = d.groupBy(*keys, "period").agg(F.sum("tokens").alias("t")).groupBy(*keys).agg(F.max_by("period", F.struct("t", -F.col("period"))).alias("worst_period"))
    total = d.groupBy(*keys).agg(F.count("*").alias("approvals"), F.sum("tokens").alias("tokens"), F.percentile("tokens", F.lit(0.5)).alias("p50"), F.percentile("tokens", F.lit(0.9)).alias("p90"), F.sum("usd").cast("double").alias("usd"), *(F.percentile(F.col("usd").cast("double"), F.lit(p)).alias(f"usd_{n}") for n, p in (("p50", 0.5), ("p90", 0.9))))
    return total.join(worst, keys)


def cursor_intervals(df: DataFrame, boundary: Column, signal: Column | None = None, result: Column | None = None) -> DataFrame:
    """Accepted records with ``duration_us`` since the last accepted record or boundary (a turn's or user message's
    start) of the source, null at its first row, ``first_interval``: whether a boundary, or nothing, came before, and
    ``tool_signal`` and ``tool_result``: whether such a row lies after the last accepted record, this one included."""
    w = Window.partitionBy("source").orderBy("us", "line")
    none = F.lit(False)
    d = df.withColumns({"_b": boundary, "_s": none if signal is None else signal, "_r": none if result is None else result})
    d = d.withColumn("duration_us", F.col("us") - F.lag("us").over(w)).withColumn("first_interval", F.coalesce(F.lag("_b").over(w), F.lit(True)))
    since = F.coalesce(F.sum((~F.col("_b")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("source", "_since").orderBy("us", "line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_since", since).withColumns({"tool_signal": F.max("_s").over(inside), "tool_result": F.max("_r").over(inside)})
    return d.where("not _b").drop("_b", "_s", "_r", "_since")


def interval_rates(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Output tokens a second over all timed intervals, those after the first, and those without a tool signal or result,
    and the first ones' time share."""
    timed, later = F.col("duration_us") > 0, (F.col("duration_us") > 0) & ~F.col("first_interval")
    rate = lambda on: F.sum(F.when(on, F.col("output"))) / (F.sum(F.when(on, F.col("duration_us"))) / 1e6)
    first = F.coalesce(F.sum(F.when(F.col("first_interval"), F.col("duration_us"))), F.lit(0))
    return intervals.groupBy(*keys).agg(F.count_if(timed).alias("intervals"), rate(timed).alias("output_per_s"), rate(later).alias("later_per_s"), *(rate(timed & ~F.col(c)).alias(n) for c, n in (("tool_signal", "without_signal_per_s"), ("tool_result", "without_result_per_s"))), share(first, F.sum("duration_us")).alias("first_share"))


def compare_rates(rates: dict[str, DataFrame], scope: list[str]) -> DataFrame:
    """Rates (scope, rate) by several definitions side by side, and each one's difference to the first in percent; a
    scope that a definition lacks has nulls there."""
    names, out = list(rates), None
    for n, df in rates.items():
        df = df.select(*scope, F.col("rate").alias(n))
        out = df if out is None else out.join(df, scope, "full")
    return out.withColumns({f"{n}_percent": F.when(F.col(names[0]) > 0, (F.col(n) / F.col(names[0]) - 1) * 100) for n in names[1:]})


def pause_scenarios(df: DataFrame, spans: DataFrame, pauses: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """``measure_excluding`` once for each named set of pauses, stacked."""
    parts = [workflow.measure_excluding(df, spans, p, keys).withColumn("scenario", F.lit(n)) for n, p in pauses.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
