"""Workflow windows: concurrency, overlaps, bursts, context, cadence, pauses, lifecycle."""

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meterline.functions.tables import cut_lineage
from meterline.functions.temporal import asof, gap_groups, interval_subtract, interval_union, share, sweep, with_previous


def session_summary(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row a source: span, requests, tokens (cached ones cut at input), most used model (ties: the least), and its
    efforts with their counts, the most used first. With ``counts`` (source, duplicates, parse_errors: ``records.read_counts``)
    these too, and sources from which nothing else could be read."""
    sums = ("input", "cached", "output", "reasoning")
    d = df.withColumns({"cached": F.least("cached", "input"), "effort": F.coalesce("effort", F.lit("unknown"))})
    per = d.groupBy("source", "model", "effort").agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"), *(F.sum(c).alias(c) for c in sums))
    model = per.groupBy("source", "model").agg(F.sum("n").alias("n")).groupBy("source").agg(F.min_by("model", F.struct(-F.col("n"), F.col("model"))).alias("model"))
    effort = per.groupBy("source", "effort").agg(F.sum("n").alias("n")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "effort"))).alias("e"))
    effort = effort.select("source", F.array_join(F.transform("e", lambda x: F.concat_ws(" ", x["effort"], (-x["n"]).cast("string"))), ", ").alias("efforts"))
    total = per.groupBy("source").agg(F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.sum("n").alias("requests"), *(F.sum(c).alias(c) for c in sums))
    out = total.join(model, "source").join(effort, "source")
    if counts is None:
        return out
    zero = ("requests", *sums, "duplicates", "parse_errors")
    return out.join(counts.select("source", "duplicates", "parse_errors"), "source", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def bursts(df: DataFrame, gap_us: int) -> DataFrame:
    """Runs of requests of a source without a longer gap: span, requests, first, last and peak input."""
    g = gap_groups(df, ["source"], ["us", "line"], "us", gap_us, "burst")
    at = F.struct("us", "line")
    return g.groupBy("source", "burst").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count("*").alias("requests"), F.min_by("input", at).alias("first_input"), F.max_by("input", at).alias("last_input"), F.max("input").alias("peak_input"))


def concurrency(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds summed over intervals, seconds with any alive, with two or more, beyond the first, and the peak."""
    s = sweep(intervals, keys).withColumn("us", F.col("until") - F.col("at"))
    return s.groupBy(*keys).agg(F.sum(F.col("us") * F.col("alive")).alias("agent_us"), F.coalesce(F.sum(F.when(F.col("alive") > 0, F.col("us"))), F.lit(0)).alias("active_us"), F.coalesce(F.sum(F.when(F.col("alive") > 1, F.col("us"))), F.lit(0)).alias("overlap_us"), F.sum(F.when(F.col("alive") > 1, (F.col("alive") - 1) * F.col("us")).otherwise(0)).alias("extra_us"), F.max("alive").alias("peak"))


def slot_length(intervals: DataFrame) -> int:
    """The median length of the intervals, but so much that the longest one fills a thousand slots at most."""
    n = F.col("end") - F.col("start")
    half, most = intervals.where("end > start").agg(F.percentile_approx(n, 0.5), F.max(n)).first()
    return max(1, half or 1, -(-(most or 1) // 1000))


#: Members of a block where a group has no more than ``BLOCKS`` of these: beyond, blocks grow, as each member is shuffled
#: once for each block, up to so many members and intervals as a task can hold.
BLOCK, BLOCKS, MEMBERS, INTERVALS = 1024, 8, 32_768, 1 << 20


def shared_time(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)): the time shared by the intervals of two lists of members, each (starts, ends) in two rows. How
    long b's intervals have run until t is taken at the ends of a's. Whole numbers that may wrap; the difference doesn't."""
    at = np.concatenate([x[1] for x in a] + [x[0] for x in a])
    edges = np.concatenate(([0], np.cumsum([x.shape[1] for x in a])))
    out = np.empty((len(a), len(b)), np.int64)
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    half = len(at) // 2
    for j, x in enumerate(b):
        s, e = np.sort(x[0]), np.sort(x[1])
        n, m = np.searchsorted(s, at), np.searchsorted(e, at)
        ran = (n - m) * at - sums(s)[n] + sums(e)[m]
        out[:, j] = np.add.reduceat(ran[:half] - ran[half:], edges[:-1])
    return out


def by_blocks(intervals: DataFrame, keys: list[str], who: str, give: Callable[[dict, list, list, np.ndarray], Iterator[pa.RecordBatch]], schema: StructType, block: int = BLOCK) -> DataFrame:
    """All pairs of a group's members, without a row for a pair before ``give`` takes them: members are dealt to blocks by
    hash, and each two blocks meet in one task, which holds a member's intervals as two arrays. ``give`` (values of the
    keys, left members, right members, shared time) yields batches; each pair comes once, the left one is less."""
    d = intervals.where("end > start").groupBy(*keys, F.col(who).alias("w")).agg(F.collect_list(F.struct("start", "end")).alias("i")).select(*keys, "w", F.col("i.start").alias("s"), F.col("i.end").alias("e"))
    d = cut_lineage(d)
    held = [F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum(F.size("s")) / INTERVALS)]
    parts = d.groupBy(*keys).agg(F.greatest(F.least(F.ceil(F.count("*") / block), F.lit(BLOCKS)), *held).cast("int").alias("n"))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    d = d.join(F.broadcast(parts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})), on).withColumn("_b", F.pmod(F.xxhash64("w"), F.col("n")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    d = d.select(*keys, "w", "s", "e", F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"), "_b")
    tasks = [*keys, "_p", "_q"]

    def settle(key: tuple, own: dict) -> Iterator[pa.RecordBatch]:
        left, right = (own.get(b, []) for b in key[-2:])
        name = dict(zip(keys, key, strict=False))
        same = key[-1] == key[-2]
        for i in range(0, len(left), 64):
            part = left[i : i + 64]
            rest = left[i:] if same else right
            if rest:
                yield from give(name, [w for w, _ in part], [w for w, _ in rest], shared_time([x for _, x in part], [x for _, x in rest]))

    def run(batches):
        now, own = None, {}
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in tasks), strict=True))
            ws, bs, s, e = (batch.column(c) for c in ("w", "_b", "s", "e"))
            ws, bs = ws.to_pylist(), bs.to_pylist()
            for i, key in enumerate(ids):
                if key != now:
                    if now is not None:
                        yield from settle(now, own)
                    now, own = key, {}
                own.setdefault(bs[i], []).append((ws[i], np.array([s[i].values.to_numpy(zero_copy_only=False), e[i].values.to_numpy(zero_copy_only=False)], np.int64)))
        if now is not None:
            yield from settle(now, own)

    # as many tasks as the session has shuffle partitions: by its bytes alone the work would go to few
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *tasks).sortWithinPartitions(*tasks, "w").mapInArrow(run, schema)


def _pairs(left: list, right: list, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that share time, each once: within a block, where both lists hold a member, the left one is less."""
    x, y = np.nonzero(shared)
    known = {w: i for i, w in enumerate(right)}
    first = np.array([known.get(w, -1) for w in left])
    keep = (first[x] < 0) | (y > first[x])
    return x[keep], y[keep]


def pairwise_overlap(intervals: DataFrame, keys: list[str], who: str) -> DataFrame:
    """Pairs of members of a group whose intervals intersect, and for how long. A pair is made where it is given out, so
    nothing is shuffled for it (``by_blocks``); their number, and so the work, is that of the pairs."""
    f = {x.name: x for x in intervals.schema}
    schema = StructType([f[k] for k in keys]).add("left_member", f[who].dataType).add("right_member", f[who].dataType).add("overlap_us", "long")
    arrow = to_arrow_schema(schema)

    def give(name, left, right, shared):
        x, y = _pairs(left, right, shared)
        if len(x):
            a, b = pa.array(left, arrow.field("left_member").type).take(pa.array(x)), pa.array(right, arrow.field("left_member").type).take(pa.array(y))
            swap = pc.less(b, a)
            ends = [pc.if_else(swap, b, a), pc.if_else(swap, a, b)]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(name[k], arrow.field(k).type), len(x)) for k in keys), *ends, pa.array(shared[x, y])], schema=arrow)

    return by_blocks(intervals, keys, who, give, schema)


def partners(intervals: DataFrame, keys: list[str], who: str) -> DataFrame:
    """(keys, who, partners): with how many other members of its group each one shares time; no row for none."""
    f = {x.name: x for x in intervals.schema}
    schema = StructType([f[k] for k in keys]).add(who, f[who].dataType).add("n", "long")
    arrow = to_arrow_schema(schema)

    def give(name, left, right, shared):
        x, y = _pairs(left, right, shared)
        for members, at in ((left, x), (right, y)):
            n = np.bincount(at, minlength=len(members))
            yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(name[k], arrow.field(k).type), len(members)) for k in keys), pa.array(members, arrow.field(who).type), pa.array(n)], schema=arrow)

    return by_blocks(intervals, keys, who, give, schema).groupBy(*keys, who).agg(F.sum("n").alias("partners"))


def alive_at(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, closed: bool = False) -> DataFrame:
    """``points`` with ``alive``: intervals that hold their instant ([start, end), or closed). One sweep: at equal
    instants ends come first, then starts, then points; for closed ones starts, points, ends."""
    end, start, point = (2, 0, 1) if closed else (0, 1, 2)
    i = intervals.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d"), F.lit(start).alias("o")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d"), F.lit(end).alias("o")))).alias("x")).select(*keys, "x.*")
    row = F.struct(*(F.col(c) for c in points.columns))
    p = points.select(*keys, F.col(at).alias("t"), F.lit(0).alias("d"), F.lit(point).alias("o"), row.alias("row"))
    both = i.withColumn("row", F.lit(None).cast(p.schema["row"].dataType)).unionByName(p)
    w = Window.partitionBy(*keys).orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("alive", F.sum("d").over(w)).where("row is not null").select("row.*", "alive")


def context_stats(df: DataFrame, keys: list[str], large: int, fell: str = "0.55") -> DataFrame:
    """Median, P90 and peak input, drops below ``fell`` (a decimal: exact) of a previous input of at least ``large``, and
    requests and tokens of large inputs and of others."""
    d = df.withColumn("_prev", F.lag("input").over(Window.partitionBy("source").orderBy("us", "line")))
    drop = (F.col("_prev") >= large) & (F.col("input") < F.lit(Decimal(fell)) * F.col("_prev"))
    return d.groupBy(*keys).agg(F.percentile("input", F.lit(0.5)).alias("p50"), F.percentile("input", F.lit(0.9)).alias("p90"), F.max("input").alias("peak"), F.count_if(drop).alias("drops"), *(x.alias(f"{n}_{m}") for n, on in (("large", F.col("input") >= large), ("small", F.col("input") < large)) for m, x in (("requests", F.count_if(on)), ("tokens", F.coalesce(F.sum(F.when(on, F.col("input") + F.col("output"))), F.lit(0))))))


def turn_cadence(df: DataFrame, idle_us: int, window_us: int, family: str = "family", role: str = "role") -> DataFrame:
    """For each family: its requests, and the transitions between requests of one source no further apart than ``idle_us``
    with the tokens that they end in; over all, by role, agent (source), model, model and effort (a transition counts there
    if both its ends have the same), and by window of ``window_us`` since the family's first request (``level`` tells).
    Rates a second of the transitions' time, and of the time that the family, or the window within it, took."""
    keys = ["level", "role", "agent", "model", "effort", "window"]
    w = Window.partitionBy("source").orderBy("us", "line")
    before = {f"_{c}": F.lag(c).over(w) for c in ("us", "model", "effort")}
    d = df.withColumns({"_family": F.col(family), "_role": F.col(role)}).withColumns(before)
    span = df.groupBy(F.col(family).alias("_family")).agg(F.min("us").alias("_start"), F.max("us").alias("_end"))
    d = d.join(span, "_family").withColumn("_gap", F.col("us") - F.col("_us"))
    moved = F.coalesce((F.col("_gap") > 0) & (F.col("_gap") <= idle_us), F.lit(False))
    same_model = moved & F.coalesce(F.col("_model") == F.col("model"), F.lit(False))
    same = same_model & F.col("_effort").eqNullSafe(F.col("effort"))
    since = F.col("us") - F.col("_start")
    kinds = {"role": "string", "agent": df.schema["source"].dataType.simpleString(), "model": "string", "effort": "string", "window": "long"}

    def level(name: str, counts: Column, **own: Column) -> Column:
        return F.struct(F.lit(name).alias("level"), *((own[k] if k in own else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()), counts.cast("int").alias("t"))

    model, effort = F.col("model"), F.coalesce("effort", F.lit("unknown"))
    levels = [level("all", moved), level("role", moved, role=F.col("_role")), level("agent", moved, agent=F.col("source")), level("model", same_model, model=model), level("model_effort", same, model=model, effort=effort), level("window", moved, window=F.floor(since / window_us))]
    tokens = F.col("input") + F.col("output")
    d = d.select("_family", "source", "_start", "_end", "_gap", tokens.alias("_tokens"), "output", F.explode(F.array(*levels)).alias("g"))
    on = lambda c: F.sum(F.when(F.col("g.t") == 1, F.col(c)).otherwise(0))
    d = d.groupBy(F.col("_family").alias("family"), *(F.col(f"g.{k}").alias(k) for k in keys), "source").agg(
        F.count("*").alias("turns"), F.sum("g.t").alias("transitions"), on("_gap").alias("gap_us"), F.sum("_tokens").alias("tokens"), F.sum("output").alias("output"), on("_tokens").alias("observed_tokens"), F.max(F.col("_end") - F.col("_start")).alias("elapsed_us"),
    )
    sums = [F.sum(c).alias(c) for c in ("turns", "transitions", "gap_us", "tokens", "output", "observed_tokens")]
    d = d.groupBy("family", *keys).agg(F.count("*").alias("contributors"), *sums, F.max("elapsed_us").alias("elapsed_us"))
    d = d.withColumn("elapsed_us", F.when(F.col("level") == "window", F.least(F.lit(window_us), F.col("elapsed_us") - F.col("window") * window_us)).otherwise(F.col("elapsed_us")))
    seconds = lambda c: F.col(c) / 1e6
    rate = lambda part, of: share(F.col(part), seconds(of))
    return d.withColumns({
        "turns_per_s": share(F.col("transitions"), seconds("gap_us")), "tokens_per_s": rate("observed_tokens", "gap_us"), "turns_per_elapsed_s": rate("turns", "elapsed_us"),
        "output_per_elapsed_s": rate("output", "elapsed_us"), "tokens_per_turn": F.col("tokens") / F.col("turns"),
    })


def top_requests(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("tokens", F.col("input") + F.col("output")).orderBy(F.desc("tokens"), "line").limit(n)


def large_context(df: DataFrame, keys: list[str], input_min: int, output_max: int) -> DataFrame:
    """Requests of large input and small output by ``keys``, ranked by their input (a row a group: a small table)."""
    d = df.where((F.col("input") >= input_min) & (F.col("output") <= output_max))
    d = d.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("input"), *keys)))


def agent_labels(sessions: DataFrame, family: str, root: Column) -> DataFrame:
    """ROOT, then A01, A02, ... by first activity."""
    w = Window.partitionBy(family).orderBy(root.cast("int").desc(), "first_us", "source")
    n = F.row_number().over(w) - 1
    return sessions.withColumn("label", F.when(root, "ROOT").otherwise(F.format_string("A%02d", n)))


def phases(requests: DataFrame, sends: DataFrame) -> DataFrame:
    """Requests of each source by how many sends it had got before (at equal instants the send comes first)."""
    both = requests.select("source", "us", F.lit(1).alias("o"), "input", "output").unionByName(sends.select("source", "us", F.lit(0).alias("o"), F.lit(0).cast("long").alias("input"), F.lit(0).cast("long").alias("output")))
    w = Window.partitionBy("source").orderBy("us", "o").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("phase", F.sum((F.col("o") == 0).cast("int")).over(w)).where("o = 1")
    return d.groupBy("source", "phase").agg(F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"))


def classify_window(sessions: DataFrame, start: int, end: int) -> DataFrame:
    """``window_class`` of each session by its trusted activation (``active_us``, where there is such a column and it is
    known; else its first record) and its last record: pre, post, spanning, carry_in, carry_out or in."""
    first = F.coalesce("active_us", "first_us") if "active_us" in sessions.columns else F.col("first_us")
    kind = F.when(F.col("last_us") < start, "pre").when(first >= end, "post").when((first < start) & (F.col("last_us") >= end), "spanning").when(first < start, "carry_in").when(F.col("last_us") >= end, "carry_out").otherwise("in")
    return sessions.withColumn("window_class", kind)


def assignments_from_labels(df: DataFrame, label: str) -> DataFrame:
    """Unit, role and number of compact (``si1_<hex>_<c|g>_<hex>_<role>_<n>``) and of plain (``unit:role:n``) labels (fixed
    patterns of the format, with their limits on sizes); others aren't ``valid``."""
    compact, plain = r"^si1_([0-9a-f]{2,64})_([cg])_([0-9a-f]{2,64})_([a-z]+)_([0-9]{1,4})$", r"^([^:]{1,80}):([a-z]+):([0-9]{1,4})$"
    c, is_c, is_p = F.col(label), F.coalesce(F.col(label).rlike(compact), F.lit(False)), F.coalesce(F.col(label).rlike(plain), F.lit(False))
    unit = F.when(is_c, F.decode(F.unhex(F.regexp_extract(c, compact, 1)), "UTF-8")).when(is_p, F.regexp_extract(c, plain, 1))
    role = F.when(is_c, F.regexp_extract(c, compact, 4)).when(is_p, F.regexp_extract(c, plain, 2))
    number = F.when(is_c, F.regexp_extract(c, compact, 5)).when(is_p, F.regexp_extract(c, plain, 3)).cast("int")
    return df.withColumns({"unit": unit, "role": role, "number": number, "valid": is_c | is_p})


def conflicting_assignments(assigned: DataFrame, who: str) -> DataFrame:
    """One row for each ``who`` with a valid label: its unit, role and number, and ``conflict`` where its labels differ."""
    one = F.struct("unit", "role", "number")
    d = assigned.where("valid").groupBy(who).agg(F.min(one).alias("a"), F.max(one).alias("b"))
    return d.select(who, "a.*", (F.col("a") != F.col("b")).alias("conflict"))


def quiet_gaps(df: DataFrame, keys: list[str], least_us: int, decisions: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """Gaps of at least ``least_us`` between calls, [previous + 1 us, next); ``status`` from a decision on that gap, else
    covered where one of the ``covered`` intervals (merged) holds it, else unclassified."""
    d = with_previous(df.select(*keys, "us").distinct(), keys, "us", "prev").where(F.col("us") - F.col("prev") >= least_us)
    d = d.select(*keys, (F.col("prev") + 1).alias("start"), F.col("us").alias("end")).withColumn("status", F.lit(None).cast("string"))
    if decisions is not None:
        d = d.drop("status").join(decisions, [*keys, "start", "end"], "left")
    if covered is not None:
        # the last merged interval that begins at or before the gap, if it reaches to its end
        c = interval_union(covered, keys).select(*keys, F.col("start").alias("us"), F.col("end").alias("_reach"), F.lit("").alias("_tie"))
        d = asof(d.withColumn("us", F.col("start")), c, keys, "us", ["_reach"], ["_tie"]).drop("us")
        d = d.withColumn("status", F.coalesce("status", F.when(F.col("_reach") >= F.col("end"), "covered"))).drop("_reach")
    return d.withColumn("status", F.coalesce("status", F.lit("unclassified")))


def measure_excluding(df: DataFrame, spans: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Time and usage left in each group's span after the merged, clipped exclusions; a rate only where time is left."""
    left = interval_subtract(spans, excluded, keys)
    time = left.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("time_us"))
    ex = interval_union(excluded, keys)
    inside = alive_at(df, ex, keys, "us").where("alive = 0")
    use = inside.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum(F.col("input") + F.col("output")).alias("tokens"))
    d = spans.select(*keys).distinct().join(time, keys, "left").join(use, keys, "left").na.fill(0, ["time_us", "requests", "tokens"])
    return d.withColumn("tokens_per_s", share(F.col("tokens"), F.col("time_us") / 1e6))


def child_counts(df: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    d = alive_at(df, intervals, keys, "us").withColumn("alive", F.least("alive", F.lit(3)))
    return d.groupBy(*keys, "alive").agg(F.count("*").alias("requests"), F.sum(F.col("input") + F.col("output")).alias("tokens"))


def compaction_clusters(markers: DataFrame, gap_us: int) -> DataFrame:
    g = gap_groups(markers, ["source"], ["us", "line"], "us", gap_us, "cluster")
    return g.groupBy("source", "cluster").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count("*").alias("markers"))


def compaction_recovery(df: DataFrame, clusters: DataFrame, refill: str = "0.8") -> DataFrame:
    """Input before and after each cluster, and requests until input is back at ``refill`` of what it was, the next
    cluster begins, or the source ends. Each request goes to the one cluster that ended last before it, if the next one
    hasn't begun, so the work is linear in the requests."""
    c = clusters.withColumn("next", F.lead("start").over(Window.partitionBy("source").orderBy("start")))
    r = df.select("source", "us", "line", "input")
    c = asof(c.withColumn("us", F.col("start")), r.withColumnRenamed("input", "before"), ["source"], "us", ["before"], ["line"], strict=True)
    held = c.select("source", F.col("end").alias("us"), F.struct("cluster", "next", "before").alias("c"), F.col("start").alias("tie"))
    j = asof(r, held, ["source"], "us", ["c"], ["tie"], strict=True).where("c is not null and (c.next is null or us < c.next)").select("source", "us", "line", "input", "c.cluster", "c.before")
    back = F.col("input") >= F.lit(Decimal(refill)) * F.col("before")
    earlier = Window.partitionBy("source", "cluster").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    j = j.withColumns({"_back": F.coalesce(back, F.lit(False)), "_was": F.coalesce(F.max(back).over(earlier), F.lit(False))})
    n = j.groupBy("source", "cluster").agg(F.min_by("input", F.struct("us", "line")).alias("after"), F.count_if(~F.col("_was")).alias("requests"), F.max("_back").alias("recovered"))
    d = c.select("source", "cluster", "before").join(n, ["source", "cluster"], "left")
    return d.select("source", "cluster", "before", "after", share(F.col("before") - F.col("after"), F.col("before")).alias("shrink"), F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("recovered", F.lit(False)).alias("recovered"))


#: Characters of text given out at a time.
TEXT = 1 << 23


def overlap_intervals(intervals: DataFrame, keys: list[str], who: str) -> DataFrame:
    """The stretches with two or more members alive, and who they are. Each slot of time (``slot_length``) is one pass: its
    stretches in order, over the intervals that reach into it. A stretch begins within each interval that holds it, so it
    finds all of them there, and nobody's row is made before the text that names them."""
    slot = slot_length(intervals)
    s = sweep(intervals, keys).where("alive > 1").select(*keys, F.floor(F.col("at") / slot).alias("_slot"), F.lit(1).alias("side"), F.lit(None).cast(intervals.schema[who].dataType).alias("w"), F.col("at").alias("a"), F.col("until").alias("b"), "alive")
    i = intervals.where("end > start").withColumn("_slot", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor((F.col("end") - 1) / slot))))
    i = i.select(*keys, "_slot", F.lit(0).alias("side"), F.col(who).alias("w"), F.col("start").alias("a"), F.col("end").alias("b"), F.lit(0).cast("long").alias("alive"))
    d = i.unionByName(s).withColumn("name", F.col("w").cast("string"))
    f = {x.name: x for x in intervals.schema}
    schema = StructType([f[k] for k in keys]).add("start", "long").add("end", "long").add("members", "long").add("who", "string")
    arrow = to_arrow_schema(schema)
    tasks = [*keys, "_slot"]

    def run(batches):
        now, names, ends, out, size = None, [], [], [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*tasks, "side", "a", "b", "alive", "name"))
            for *key, side, a, b, alive, name in zip(*columns, strict=True):
                if key != now:
                    now, names, ends, known = key, [], [], None
                if side == 0:
                    names.append(name)
                    ends.append((a, b))
                    continue
                if known is None:
                    known, (lo, hi) = np.array(names, object), np.array(ends, np.int64).T
                text = ",".join(known[(lo <= a) & (hi > a)])
                out.append((*key[:-1], a, b, alive, text))
                size += len(text)
                if size > TEXT:
                    yield pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *tasks).sortWithinPartitions(*tasks, "side", "w", "a").mapInArrow(run, schema)


def agent_overlap(intervals: DataFrame, keys: list[str], who: str = "source") -> DataFrame:
    """Of each interval that isn't empty, the time shared with any other one (their union), its fraction, and how many
    other members its own member overlaps in any of its intervals (``partners``, each once). The shared time is how much
    the running total of stretches with two or more alive grows between the interval's own two ends, in one sweep."""
    by = [*keys, who, "start", "end"]
    row = F.struct(*by)
    i = intervals.where("end > start").select(*keys, row.alias("row"), F.monotonically_increasing_id().alias("id"), F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("up")), F.struct(F.col("end").alias("t"), F.lit(0).alias("up"))).alias("e"))
    e = i.select(*keys, "row", "id", F.explode("e").alias("e")).select(*keys, "row", "id", "e.t", "e.up")
    w = Window.partitionBy(*keys).orderBy("t", "up", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({"ups": F.sum("up").over(upto), "downs": F.sum(1 - F.col("up")).over(upto), "_t": F.lag("t").over(w)})
    alive = F.col("ups") - F.col("downs") - F.when(F.col("up") == 1, 1).otherwise(-1)  # until this end
    e = e.withColumn("shared", F.sum(F.when(alive > 1, F.col("t") - F.col("_t")).otherwise(0)).over(upto))
    at = lambda c, up: F.max(F.when(F.col("up") == up, F.col(c)))
    d = e.groupBy("id").agg(F.first("row").alias("row"), (at("shared", 0) - at("shared", 1)).alias("overlap_us"))
    d = d.select("row.*", "overlap_us", share(F.col("overlap_us"), F.col("row.end") - F.col("row.start")).alias("fraction"))
    met = partners(intervals, keys, who)
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate([*keys, who])))
    d = d.join(met.withColumnsRenamed({k: f"_m{i}" for i, k in enumerate([*keys, who])}), on, "left")
    return d.select(*by, "overlap_us", F.coalesce("partners", F.lit(0)).alias("partners"), "fraction")


def exposure_by_children(df: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Requests by the number of children alive, both ends of a child's interval included."""
    d = alive_at(df, intervals, keys, "us", closed=True)
    return d.groupBy(*keys, F.col("alive").alias("children")).agg(F.count("*").alias("requests"), F.sum(F.col("input") + F.col("output")).alias("tokens"))


#: Families worth a look first, by what ``family_score`` says of their evidence.
QUALITIES = ("complete", "limited", "standalone", "no usage")


def recent_families(families: DataFrame, span_us: int) -> DataFrame:
    """Families (family, last_us, score, quality) active within ``span_us`` of the newest of all, or all of them if none is
    known to be; ranked by quality, the latest first, the highest score, then the key (a sort by ranges, not in one task)."""
    newest = families.agg(F.max("last_us")).first()[0]
    recent = families if newest is None else families.where(F.col("last_us") >= newest - span_us)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, QUALITIES)), F.col("quality")), F.lit(0))
    rank = F.when(rank > 0, rank - 1).otherwise(9).cast("int")
    return recent.withColumn("quality_rank", rank).orderBy("quality_rank", F.desc_nulls_last("last_us"), F.desc("score"), "family")


def after_completion(df: DataFrame, ends: DataFrame) -> DataFrame:
    """Requests of each source strictly after its declared end (source, end_us)."""
    d = df.join(ends, "source").where(F.col("us") > F.col("end_us"))
    return d.groupBy("source").agg(F.count("*").alias("requests"), F.sum(F.col("input") + F.col("output")).alias("tokens"))


def carry_in_rows(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows in [start, end) of the sources that began before it."""
    began = df.groupBy("source").agg(F.min("us").alias("_first")).where(F.col("_first") < start)
    return df.where((F.col("us") >= start) & (F.col("us") < end)).join(began, "source", "left_semi")


def local_ids(sessions: DataFrame, keys: list[str], prefix: str = "agent") -> DataFrame:
    """``local_id``: ``agent-001`` and so on within a report, by first activity, then source."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("first_us", "source"))
    return sessions.withColumn("local_id", F.format_string(f"{prefix}-%03d", n))
