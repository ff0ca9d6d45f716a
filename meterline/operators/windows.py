"""Lifetimes of sessions within their families: roots, members, active windows, lingering, cycles, rollups, cautions.

Windows are (family, member, role, chunk, spawn_us, start, end): half-open, one or more a member.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterline.functions.temporal import share

DAY = 86_400_000_000


def tokens() -> Column:
    return F.col("input") + F.col("output")


def usage_timeline(df: DataFrame, keys: list[str]) -> DataFrame:
    """Requests and tokens of each instant."""
    return df.groupBy(*keys, "us").agg(F.count("*").alias("requests"), F.sum(tokens()).alias("tokens"))


def role_costs(df: DataFrame) -> DataFrame:
    """Requests, tokens and dollars by role (unknown where there is none)."""
    role = F.coalesce("role", F.lit("unknown")).alias("role")
    return df.groupBy(role).agg(F.count("*").alias("requests"), F.sum(tokens()).alias("tokens"), F.sum("usd").cast("double").alias("usd"))


def infer_role(evidence: DataFrame) -> DataFrame:
    """A session's role from what it says of itself (session, role, one row each time): high confidence at twice the
    second role's count and two at least, medium if alone in front, else ambiguous and no role."""
    per = evidence.groupBy("session", "role").agg(F.count("*").alias("n"))
    w = Window.partitionBy("session").orderBy(F.desc("n"), "role")
    d = per.withColumns({"_r": F.row_number().over(w), "runner_up": F.coalesce(F.lead("n").over(w), F.lit(0))}).where("_r = 1")
    sure = F.when(F.col("n") >= F.greatest(F.lit(2), 2 * F.col("runner_up")), "high").when(F.col("n") > F.col("runner_up"), "medium").otherwise("ambiguous")
    return d.select("session", F.when(sure != "ambiguous", F.col("role")).alias("role"), "n", "runner_up", sure.alias("confidence"))


def family_root(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Each family's root (family, session, subagent, first_us): a member without a parent, one that is no subagent first,
    then the earliest, then the least key; of a family that is all cycle, the same among all members."""
    up = edges.select(F.col("child").alias("session"), F.lit(1).alias("_up")).distinct()
    d = members.join(up, "session", "left").withColumn("_up", F.coalesce("_up", F.lit(0)))
    return d.groupBy("family").agg(F.min(F.struct("_up", "subagent", "first_us", "session")).alias("r")).select("family", F.col("r.session").alias("root"), (F.col("r._up") == 0).alias("structural"))


def family_score(families: DataFrame) -> DataFrame:
    """``score`` of a family by its evidence, not by names (links, high_links, medium_links, workers that aren't
    reviewers, measured, members, span_us): shares of high and medium links, workers up to 20, measured members, a usual
    number of workers, a span of up to two or four days, all links high. ``quality`` says what the evidence is."""
    of = lambda part, whole: F.coalesce(share(F.col(part), F.col(whole)), F.lit(0.0))
    on = lambda x, n: F.when(x, n).otherwise(0)
    days, sure = F.col("span_us") / DAY, (F.col("links") > 0) & (F.col("high_links") == F.col("links"))
    # fixed values: the points of each kind of evidence
    score = 50 * of("high_links", "links") + 15 * of("medium_links", "links") + 4 * F.least("workers", F.lit(20)) + 40 * of("measured", "members")
    score = score + on(F.col("workers").between(2, 30), 20) + F.when(days <= 2, 20).when(days <= 4, 10).otherwise(0) + on(sure, 20)
    whole = (F.col("high_links") == F.col("links")) & (F.col("measured") == F.col("members"))
    quality = F.when(F.col("measured") == 0, "no usage").when(F.col("members") == 1, "standalone").when(whole, "complete").otherwise("limited")
    return families.withColumn("score", score.cast("double")).withColumn("quality", quality)


def _with_selves(closure: DataFrame, members: DataFrame) -> DataFrame:
    """The closure and each member as its own ancestor, those without any edge too."""
    alone = members.select(F.col("session").alias("node"), F.col("session").alias("ancestor"), F.lit(0).alias("depth"))
    return closure.where("depth > 0").select("node", "ancestor", "depth").unionByName(alone)


def select_root(members: DataFrame, closure: DataFrame, start: int, end: int) -> DataFrame:
    """The one member of each family without a parent below whom (self included) there is a request in [start, end);
    several or none: no root, and why. ``members``: family, session, is_top, first_us, last_us; ``closure``: node, ancestor."""
    live = members.where((F.col("first_us") < end) & (F.col("last_us") >= start)).select(F.col("session").alias("node"))
    tops = members.where("is_top").select("family", F.col("session").alias("ancestor"))
    on = _with_selves(closure, members).join(live, "node", "left_semi").select("ancestor").distinct().join(tops, "ancestor")
    found = on.groupBy("family").agg(F.count("*").alias("candidates"), F.min("ancestor").alias("root"))
    d = members.select("family").distinct().join(found, "family", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return d.select("family", "candidates", F.when(F.col("candidates") == 1, F.col("root")).alias("root"), F.when(F.col("candidates") == 1, "selected").when(F.col("candidates") > 1, "ambiguous").otherwise("none").alias("outcome"))


def window_members(members: DataFrame, closure: DataFrame, roots: DataFrame, start: int, end: int, carry_in: bool = False) -> DataFrame:
    """Who belongs to a family's window: the selected root, its descendants with a request in [start, end) that began in
    it (or before, with ``carry_in``), and the quiet ones that connect them to the root. ``why`` tells which."""
    closure = _with_selves(closure, members)
    below = closure.join(roots.where("root is not null").select(F.col("root").alias("ancestor"), "family"), "ancestor").select("family", F.col("node").alias("session"), "depth")
    m = below.join(members.select("session", "first_us", "last_us"), "session")
    began = F.lit(True) if carry_in else F.col("first_us") >= start
    live = m.where((F.col("depth") > 0) & (F.col("first_us") < end) & (F.col("last_us") >= start) & began).select("family", "session")
    up = closure.join(live.select(F.col("session").alias("node"), "family"), "node").select("family", F.col("ancestor").alias("session")).join(below.select("family", "session"), ["family", "session"], "left_semi").distinct()
    why = F.when(F.col("depth") == 0, "root").when(F.col("_live"), "active").otherwise("connecting")
    d = below.join(live.withColumn("_live", F.lit(True)), ["family", "session"], "left").join(up.withColumn("_up", F.lit(True)), ["family", "session"], "left")
    return d.where("depth = 0 or _live or _up").select("family", "session", "depth", why.alias("why"))


def active_windows(sessions: DataFrame, spawns: DataFrame, start: int, end: int, tail_us: int = 0) -> DataFrame:
    """A child's lifetime from its trusted spawn (earliest, but not after its first record) to its last record and
    ``tail_us``, clipped to [start, end); empty ones go. Sessions without a spawn have none."""
    first = spawns.groupBy("member").agg(F.min("spawn_us").alias("spawn_us"))
    d = sessions.join(first, "member").withColumn("spawn_us", F.least("spawn_us", "first_us"))
    d = d.withColumns({"start": F.greatest("spawn_us", F.lit(start)), "end": F.least(F.col("last_us") + 1 + tail_us, F.lit(end))}).where("end > start")
    return d.withColumn("truncated", (F.col("start") > F.col("spawn_us")) | (F.col("end") < F.col("last_us") + 1))


def _slots(df: DataFrame, slot: int) -> DataFrame:
    return df.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor((F.col("end") - 1) / slot))))


def active_state(requests: DataFrame, windows: DataFrame, slot: int = DAY) -> DataFrame:
    """Each request (family, line, us) with the roles alive then, sorted and joined (``idle``: none). Windows meet requests
    by slots of time."""
    w = _slots(windows.select("family", "role", "start", "end"), slot).withColumnRenamed("_slot", "_s")
    r = requests.withColumn("_s", F.floor(F.col("us") / slot))
    j = r.join(w, ["family", "_s"]).where("start <= us and us < end").groupBy("family", "line").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("state"))
    return r.drop("_s").join(j, ["family", "line"], "left").withColumn("state", F.coalesce("state", F.lit("idle")))


def within(requests: DataFrame, intervals: DataFrame, who: str | None, slot: int = DAY) -> DataFrame:
    """Requests, tokens of each interval (family, id, start, end, and the member asked for in column ``who``, or None for
    the whole family) in [start, end). Intervals meet requests by family, member and slot of time."""
    keys = ["family", "member"] if who else ["family"]
    i = intervals.withColumn("member", F.col(who)) if who else intervals
    i = _slots(i.select(*keys, "id", "start", "end").where("end > start"), slot)
    r = requests.withColumn("_slot", F.floor(F.col("us") / slot)).select(*keys, "_slot", "us", tokens().alias("t"))
    return r.join(i, [*keys, "_slot"]).where("start <= us and us < end").groupBy("id").agg(F.count("*").alias("requests"), F.sum("t").alias("tokens"))


def _triggers(windows: DataFrame, successors: dict[str, str]) -> DataFrame:
    """(family, member, spawn_us, kind, start, trigger, until): ``lingering``'s earliest triggers. A family's windows pass
    by from the last spawn to the first, and of each role and chunk only the two earliest members so far are held."""
    f = {x.name: x.dataType for x in windows.schema}
    schema = StructType([StructField("family", f["family"]), StructField("member", f["member"]), StructField("spawn_us", LongType()), StructField("kind", StringType()), StructField("start", LongType()), StructField("trigger", f["member"]), StructField("until", LongType())])
    arrow = to_arrow_schema(schema)

    def earliest(lists, member, end):
        """The earliest (spawn, member) of other members before ``end``; each list from the earliest on, too."""
        best = None
        for own in lists:
            t = next((x for x in own if x[1] != member), None)
            if t and t[0] < end and (best is None or t < best):
                best = t
        return best

    def apart(chunks, mine, member):
        """The members of the chunks other than ``mine`` and none, last met first (they hold the earliest), up to the first
        chunk that begins with another member: all further ones begin later."""
        for c in reversed(chunks):
            if c is not None and c != mine:
                yield chunks[c]
                if chunks[c][0][1] != member:
                    return

    def found(held, member, role, chunk, spawn, end):
        then = successors.get(role)
        same = held.get(role, {}) if role is not None and role != "unknown" else {}
        after = held.get(then, {}) if then is not None and (then != role or role == "unknown") else {}
        both = (same, after)
        if chunk is None:
            yield "unclassified-overlap", earliest((h for x in both for h in [*apart(x, None, member), x.get(None, ())]), member, end)
            return
        yield "unclassified-overlap", earliest((x.get(None, ()) for x in both), member, end)
        yield "cross-chunk-overlap", earliest((h for x in both for h in apart(x, chunk, member)), member, end)
        yield "same-chunk-replacement-overlap", earliest((same.get(chunk, ()),), member, end)
        yield "same-chunk-repair-overlap", earliest((after.get(chunk, ()),), member, end)

    def run(batches):
        family, held, waiting = None, {}, []

        def push():
            for spawn, member, role, chunk in reversed(waiting):  # the greatest key first, so the least one is earliest
                chunks = held.setdefault(role, {})
                own = [x for x in chunks.pop(chunk, ()) if x[1] != member]
                chunks[chunk] = [(spawn, member), *own[:1]]
            waiting.clear()

        for batch in batches:
            out = []
            for fam, member, role, chunk, spawn, end in zip(*(batch.column(c).to_pylist() for c in ("family", "member", "role", "chunk", "spawn_us", "end")), strict=True):
                if fam != family:
                    family, held = fam, {}
                    waiting.clear()
                if waiting and waiting[0][0] != spawn:
                    push()
                for kind, t in found(held, member, role, chunk, spawn, end):
                    if t:
                        out.append((fam, member, spawn, kind, *t, end))
                waiting.append((spawn, member, role, chunk))
            yield pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(zip(*out, strict=True) if out else [()] * len(arrow), arrow, strict=True)], schema=arrow)

    d = windows.select("family", "member", "role", "chunk", "spawn_us", "end").repartition("family").sortWithinPartitions("family", F.desc("spawn_us"), "member").mapInArrow(run, schema)
    # windows of one member and spawn are one: the earliest trigger of any, and the last end
    t = F.min(F.struct("start", "trigger"))
    return d.groupBy("family", "member", "spawn_us", "kind").agg(t.alias("t"), F.max("until").alias("until")).select("family", "member", "spawn_us", "kind", "t.start", "t.trigger", "until")


def lingering(windows: DataFrame, requests: DataFrame, successors: dict[str, str]) -> DataFrame:
    """Windows still open when a later worker of the same role, or of the role that succeeds theirs, was spawned: the
    earliest trigger of each class, and what the older worker used from then to its end. With chunks on both sides the
    class tells replacement and repair within a chunk from overlap across chunks."""
    first = _triggers(windows, successors).withColumnRenamed("until", "end")
    first = first.withColumn("id", F.struct("member", "spawn_us", "kind"))
    return first.join(within(requests, first, "member"), "id", "left").na.fill(0, ["requests", "tokens"]).drop("id")


def _others(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, role): the roles of which others than the two members were alive within each span. They aren't listed but
    counted: of a role's windows as many meet a span as start before its end less those that end by its start; from
    these the two members' own are taken off."""
    end = lambda c, o, up, down: F.struct(F.col(c).alias("t"), F.lit(o).alias("o"), F.lit(up).alias("up"), F.lit(down).alias("down"))
    events = windows.where("end > start").select("family", "role", F.lit(None).cast(spans.schema["id"].dataType).alias("id"), F.lit(None).cast("boolean").alias("last"), F.explode(F.array(end("start", 2, 1, 0), end("end", 0, 0, 1))).alias("x"))
    roles = windows.where("role is not null").select("family", "role").distinct()
    ask = lambda c, last: F.struct(F.lit(last).alias("last"), end(c, 1, 0, 0).alias("x"))
    asked = spans.join(roles, "family").select("family", "role", "id", F.explode(F.array(ask("start", False), ask("end", True))).alias("q")).select("family", "role", "id", "q.last", "q.x")
    w = Window.partitionBy("family", "role").orderBy("x.t", "x.o").rowsBetween(Window.unboundedPreceding, 0)
    n = events.unionByName(asked).withColumns({"_up": F.sum("x.up").over(w), "_down": F.sum("x.down").over(w)}).where("id is not null")
    n = n.groupBy("id", "role").agg((F.max(F.when(F.col("last"), F.col("_up"))) - F.max(F.when(~F.col("last"), F.col("_down")))).alias("_n"))
    own = spans.select("family", "id", F.col("start").alias("_a"), F.col("end").alias("_b"), F.explode(F.array_distinct(F.array("member", "next_member"))).alias("member"))
    own = own.join(windows.select("family", "member", "role", "start", "end"), ["family", "member"]).where("start < _b and end > _a").groupBy("id", "role").agg(F.count("*").alias("_own"))
    return n.join(own, ["id", "role"], "left").where(F.col("_n") > F.coalesce("_own", F.lit(0))).select("id", "role")


def cycles(windows: DataFrame, roots: DataFrame, requests: DataFrame, roles: tuple[str, str], handoff_us: int = 300_000_000) -> DataFrame:
    """Neighbours in a family's spawn order with these two roles: how they follow each other, what each and the root used
    in their windows, and who else was alive. ``roots``: family, root."""
    w = Window.partitionBy("family").orderBy("spawn_us", "start", "member")
    nxt = {f"next_{c}": F.lead(c).over(w) for c in ("member", "role", "chunk", "start", "end", "truncated")}
    c = windows.withColumns(nxt).where((F.col("role") == roles[0]) & (F.col("next_role") == roles[1])).join(roots, "family", "left")
    gap = F.col("next_start") - F.col("end")
    quality = (
        F.when(F.col("truncated") | F.col("next_truncated"), "window-truncated").when(F.col("chunk") != F.col("next_chunk"), "chunk-mismatch").when(F.abs(gap) <= 2_000_000, "tight-sequential")
        .when((gap > 0) & (gap <= handoff_us), "sequential").when(gap < 0, "overlap").otherwise("long-gap")
    )
    c = c.withColumns({"handoff_us": gap, "quality": quality, "id": F.struct("family", "spawn_us", "member")})
    out = c
    for name, who, a, b in (("first", "member", "start", "end"), ("second", "next_member", "next_start", "next_end"), ("root_first", "root", "start", "end"), ("root_second", "root", "next_start", "next_end")):
        i = c.select("family", "id", F.col(who).alias("_who"), F.col(a).alias("start"), F.col(b).alias("end"))
        used = within(requests, i, "_who").select("id", F.col("requests").alias(f"{name}_requests"), F.col("tokens").alias(f"{name}_tokens"))
        out = out.join(used, "id", "left").na.fill(0, [f"{name}_requests", f"{name}_tokens"])
    span = c.select("family", "id", "member", "next_member", "start", F.greatest("next_end", "next_start").alias("end"))
    met = _others(span, windows).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("others"))
    return out.join(met, "id", "left").withColumn("others", F.coalesce("others", F.lit(""))).drop("id")


def supervision_ratio(c: DataFrame, keys: list[str]) -> DataFrame:
    """Root tokens over child tokens in the sequential cycles in which nobody else was alive; null where there are none."""
    clean = F.col("quality").isin("tight-sequential", "sequential") & (F.col("others") == "")
    total = lambda *names: F.coalesce(F.sum(F.when(clean, sum((F.col(n) for n in names[1:]), F.col(names[0])))), F.lit(0))
    d = c.groupBy(*keys).agg(F.count("*").alias("cycles"), F.count_if(clean).alias("clean"), total("root_first_tokens", "root_second_tokens").alias("root_tokens"), total("first_tokens", "second_tokens").alias("child_tokens"))
    return d.withColumn("ratio", share(F.col("root_tokens"), F.col("child_tokens")))


def chunk_totals(windows: DataFrame, roots: DataFrame, requests: DataFrame) -> DataFrame:
    """By family and chunk: roles, children, what they used in all (each once), and the root's requests inside any of the
    chunk's windows, each once."""
    w = windows.where("chunk is not null")
    base = w.groupBy("family", "chunk").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("roles"), F.count_distinct("member").alias("children"))
    own = requests.join(w.select("family", "chunk", "member").distinct(), ["family", "member"]).groupBy("family", "chunk").agg(F.count("*").alias("child_requests"), F.sum(tokens()).alias("child_tokens"))
    r = requests.join(roots.select("family", F.col("root").alias("member")), ["family", "member"], "left_semi").withColumn("_slot", F.floor(F.col("us") / DAY)).select("family", "_slot", "line", "us", tokens().alias("t"))
    inside = r.join(_slots(w.select("family", "chunk", "start", "end"), DAY), ["family", "_slot"]).where("start <= us and us < end").groupBy("family", "chunk", "line").agg(F.max("t").alias("t"))
    inside = inside.groupBy("family", "chunk").agg(F.count("*").alias("root_requests"), F.sum("t").alias("root_tokens"))
    return base.join(own, ["family", "chunk"], "left").join(inside, ["family", "chunk"], "left").na.fill(0, ["child_requests", "child_tokens", "root_requests", "root_tokens"])


def comparison_snapshot(requests: DataFrame, windows: DataFrame, roots: DataFrame, large: int) -> DataFrame:
    """One row a family for before and after: requests, tokens, the root's share, children, share of large inputs and of
    tokens in requests with a price."""
    r = requests.join(roots, "family", "left").groupBy("family").agg(
        F.count("*").alias("requests"), F.sum(tokens()).alias("tokens"), F.coalesce(F.sum(F.when(F.col("member") == F.col("root"), tokens())), F.lit(0)).alias("root_tokens"),
        F.count_if(F.col("input") >= large).alias("large_requests"), F.coalesce(F.sum(F.when(F.col("usd").isNotNull(), tokens())), F.lit(0)).alias("priced_tokens"),
    )
    w = windows.groupBy("family").agg(F.count_distinct("member").alias("children"), F.count("*").alias("windows"))
    d = r.join(w, "family", "left").na.fill(0, ["children", "windows"])
    return d.withColumns({"root_share": share(F.col("root_tokens"), F.col("tokens")), "large_share": share(F.col("large_requests"), F.col("requests")), "price_coverage": share(F.col("priced_tokens"), F.col("tokens"))})


def evidence_cautions(df: DataFrame) -> DataFrame:
    """``warnings`` of each row of coverage (children, with_lifetime, excluded_carry_in, visible_responses, timed_responses)."""
    partial = lambda part, whole, some, none: [F.when((F.col(whole) > 0) & (F.col(part) == 0), F.lit(none)), F.when((F.col(part) > 0) & (F.col(part) < F.col(whole)), F.lit(some))]
    rules = [*partial("with_lifetime", "children", "partial_lifetimes", "no_lifetimes"), F.when(F.col("excluded_carry_in") > 0, F.lit("carry_in_excluded")), *partial("timed_responses", "visible_responses", "partial_timing", "no_timing")]
    return df.withColumn("warnings", F.array_join(F.array_compact(F.array(*rules)), ","))


def compaction_by_role(clusters: DataFrame, spans: DataFrame) -> DataFrame:
    """Compactions (source, role, start, shrink) by role: how many, an hour of its sources' time (source, role,
    active_us), the median gap to the same source's previous one, and the median shrink."""
    gap = F.col("start") - F.lag("start").over(Window.partitionBy("source").orderBy("start"))
    d = clusters.withColumn("_gap", gap).groupBy("role").agg(F.count("*").alias("compactions"), F.median("_gap").alias("median_gap_us"), F.median("shrink").alias("median_shrink"))
    hours = spans.groupBy("role").agg(F.sum("active_us").alias("_us"))
    return d.join(hours, "role", "left").withColumn("per_hour", share(F.col("compactions"), F.col("_us") / 3.6e9)).drop("_us")


def repeat_access(clusters: DataFrame, touches: DataFrame, span_us: int) -> DataFrame:
    """Of each compaction (source, cluster, start, end) the resources (source, us, resource, is_read) touched in the
    ``span_us`` before it, those touched again in as long after it, and those read on both sides."""
    c = clusters.select("source", "cluster", (F.col("start") - span_us).alias("lo"), F.col("start").alias("a"), F.col("end").alias("b"), (F.col("end") + span_us).alias("hi"))
    c = c.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("lo") / DAY), F.floor(F.col("hi") / DAY))))
    j = touches.withColumn("_slot", F.floor(F.col("us") / DAY)).join(c, ["source", "_slot"])
    before, after = (F.col("us") >= F.col("lo")) & (F.col("us") < F.col("a")), (F.col("us") > F.col("b")) & (F.col("us") <= F.col("hi"))
    per = j.groupBy("source", "cluster", "resource").agg(*(F.max(x.cast("int")).alias(n) for n, x in (("_b", before), ("_a", after), ("_rb", before & F.col("is_read")), ("_ra", after & F.col("is_read")))))
    n = per.groupBy("source", "cluster").agg(F.sum("_b").alias("before"), F.count_if((F.col("_b") == 1) & (F.col("_a") == 1)).alias("again"), F.count_if((F.col("_rb") == 1) & (F.col("_ra") == 1)).alias("read_again"))
    return clusters.select("source", "cluster").join(n, ["source", "cluster"], "left").na.fill(0, ["before", "again", "read_again"])
