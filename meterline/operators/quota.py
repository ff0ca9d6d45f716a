"""Quota periods from coarse percent meters: episodes, high-water buckets, the reset ledger, monthly metrics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.temporal import share, weighted_quantile
from meterline.operators.stats import DRAWS, drawn

EPS = 1e-9
EPISODE = ["account", "reset_key"]
ORDER = ["us", "line", "source"]


def project_window(df: DataFrame, minutes: int) -> DataFrame:
    """``used`` and ``reset_at`` of one meter window out of ``meters``; rows without it go."""
    m = F.try_element_at("meters", F.lit(minutes))
    return df.withColumn("used", m["used"]).withColumn("reset_at", m["reset_at"]).where("used is not null")


def reset_key(df: DataFrame, tolerance: int = 60) -> DataFrame:
    return df.withColumn("reset_key", (F.bround(F.col("reset_at") / tolerance) * tolerance).cast("long"))


def raw_episodes(df: DataFrame, window_us: int) -> DataFrame:
    """One row for each reset key: readings, activation, new highs, and how far readings fall back."""
    w = Window.partitionBy(*EPISODE).orderBy(*ORDER)
    high = F.max("used").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_high", high).withColumn("_prev", F.lag("used").over(w))
    at = F.struct(*ORDER)
    e = d.groupBy(*EPISODE).agg(
        F.median("reset_at").alias("reset_at"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("used", at).alias("first_used"), F.max_by("used", at).alias("last_used"),
        F.max("used").alias("high_used"), F.count("*").alias("readings"), F.count_if((F.col("used") > F.col("_high") + EPS) | F.col("_high").isNull()).alias("new_highs"),
        F.count_if(F.col("used") < F.col("_high") - EPS).alias("backsteps"), F.coalesce(F.max(F.when(F.col("used") < F.col("_high") - EPS, F.col("_high") - F.col("used"))), F.lit(0.0)).alias("max_backstep"),
        F.count_if(F.col("used") < F.col("_prev") - EPS).alias("down_steps"),
    )
    return e.withColumn("activation_us", (F.col("reset_at") * 1_000_000).cast("long") - window_us)


def high_water_rows(df: DataFrame) -> DataFrame:
    """Rows with their bucket: work goes to the next reading above the episode's high. Work after the last new high and
    a first reading that isn't zero are in none."""
    w = Window.partitionBy(*EPISODE).orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_high", F.max("used").over(before))
    d = d.withColumn("new_high", F.coalesce(F.col("used") > F.col("_high") + EPS, F.lit(True)))
    d = d.withColumn("bucket", F.coalesce(F.sum(F.col("new_high").cast("int")).over(before), F.lit(0)))
    last = F.max(F.when(F.col("new_high"), F.col("bucket"))).over(Window.partitionBy(*EPISODE))
    d = d.withColumn("_last", last)
    return d.where((F.col("bucket") <= F.col("_last")) & ((F.col("bucket") > 0) | (F.abs("used") <= EPS))).drop("_last")


def bucket_aggregate(df: DataFrame) -> DataFrame:
    """Buckets of ``high_water_rows``: span, points gained, events, tokens, dollars, core figures without reviewers.
    ``fit_excluded``: a reviewer's row whose ``policy`` (where there is one) isn't historical; such a bucket is in no fit."""
    excluded = F.col("reviewer") & (F.coalesce("policy", F.lit("unknown")) != "historical") if "policy" in df.columns else F.lit(False)
    core = ~F.col("reviewer")
    tokens = F.col("input") + F.col("output")
    priced = F.col("usd").isNotNull()
    b = df.groupBy(*EPISODE, "bucket").agg(
        F.max("us").alias("end_us"), F.max("used").alias("end_used"), F.max(F.coalesce("_high", F.lit(0.0))).alias("start_used"), F.count("*").alias("events"), F.sum(tokens).alias("tokens"),
        F.coalesce(F.sum(F.when(priced, tokens)), F.lit(0)).alias("priced_tokens"), F.sum("usd").alias("usd"), F.coalesce(F.sum(F.when(core, tokens)), F.lit(0)).alias("core_tokens"), F.sum(F.when(core, F.col("usd"))).alias("core_usd"),
        *(F.sum(c).alias(c) for c in ("uncached", "cached", "output") if c in df.columns), F.coalesce(F.sum(F.when(core & priced, tokens)), F.lit(0)).alias("core_priced_tokens"),
        F.max(excluded).alias("fit_excluded"), F.min("us").alias("first_us"),
    )
    return b.withColumn("points", F.col("end_used") - F.col("start_used"))


def bucket_mix(df: DataFrame, dims: list[str]) -> DataFrame:
    """Long table of tokens by bucket, dimension and key."""
    parts = [F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("key")) for d in dims]
    return df.select(*EPISODE, "bucket", (F.col("input") + F.col("output")).alias("tokens"), F.explode(F.array(*parts)).alias("m")).groupBy(*EPISODE, "bucket", "m.dim", "m.key").agg(F.sum("tokens").alias("tokens"))


def dominant(mix: DataFrame, keys: list[str], dim: str) -> DataFrame:
    """The key with the most tokens (ties: the least key), and its share."""
    best = F.min_by("key", F.struct(-F.col("tokens"), F.col("key")))
    d = mix.where(F.col("dim") == dim).groupBy(*keys).agg(best.alias(dim), F.max("tokens").alias("_t"), F.sum("tokens").alias("_all"))
    return d.select(*keys, dim, share(F.col("_t"), F.col("_all")).alias(f"{dim}_share"))


def boundary_before(df: DataFrame, episodes: DataFrame) -> DataFrame:
    """``before_used`` of each episode but the first: the previous one's last reading until this one's first, else its
    last reading of all."""
    w = Window.partitionBy("account").orderBy("activation_us", "reset_at", "first_us")
    pairs = episodes.withColumn("prev_key", F.lag("reset_key").over(w)).withColumn("prev_last", F.lag("last_used").over(w)).where("prev_key is not null")
    j = pairs.alias("p").join(df.alias("d"), (F.col("d.account") == F.col("p.account")) & (F.col("d.reset_key") == F.col("p.prev_key")))
    at = F.struct("d.us", "d.line", "d.source")
    seen = F.max_by(F.when(F.col("d.us") <= F.col("p.first_us"), F.col("d.used")), F.when(F.col("d.us") <= F.col("p.first_us"), at))
    return j.groupBy(F.col("p.account").alias("account"), F.col("p.reset_key").alias("reset_key")).agg(F.coalesce(seen, F.first("p.prev_last")).alias("before_used"))


def reset_ledger(episodes: DataFrame, before: DataFrame, tolerance_us: int, noop: float = 1.0, drop: float = 2.0) -> DataFrame:
    """Each raw episode's kind: initial, scheduled, early, after-due, churn (merged into the current accounting episode,
    whose due date stands) or ambiguous. What is due depends on earlier verdicts: a fold over each account's few
    episodes, in built-in expressions."""
    e = episodes.join(before, EPISODE, "left")
    row = F.struct("activation_us", "reset_at", "first_us", "reset_key", "first_used", "before_used")
    rows = e.groupBy("account").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    record = "struct<reset_key:bigint,kind:string,creates:boolean,due_us:bigint,key:bigint>"
    due = lambda r: (r["reset_at"] * 1_000_000).cast("bigint")

    def step(acc, r):
        delta = r["activation_us"] - acc["due"]
        fall = r["before_used"] - r["first_used"]
        kind = (
            F.when(acc["key"].isNull(), "initial").when(F.abs(delta) <= tolerance_us, "scheduled")
            .when(fall + EPS >= drop, F.when(delta < -tolerance_us, "early").otherwise("after-due"))
            .when((r["before_used"] <= noop + EPS) & (r["first_used"] <= noop + EPS), "churn").otherwise("ambiguous")
        )
        creates = kind != "churn"
        key = F.when(creates, r["reset_key"]).otherwise(acc["key"])
        one = F.struct(r["reset_key"].alias("reset_key"), kind.alias("kind"), creates.alias("creates"), acc["due"].alias("due_us"), key.alias("key"))
        return F.struct(F.when(creates, due(r)).otherwise(acc["due"]).alias("due"), key.alias("key"), F.concat(acc["out"], F.array(one.cast(record))).alias("out"))

    zero = F.struct(F.lit(None).cast("bigint").alias("due"), F.lit(None).cast("bigint").alias("key"), F.array().cast(f"array<{record}>").alias("out"))
    out = rows.select("account", F.explode(F.aggregate("rows", zero, step)["out"]).alias("r")).select("account", "r.*")
    return out.join(e, EPISODE).select("account", "reset_key", "kind", "creates", "due_us", F.col("key").alias("accounting_key"), "activation_us", (F.col("activation_us") - F.col("due_us")).alias("lag_us"), "before_used", F.col("first_used").alias("after_used"), (F.col("before_used") - F.col("first_used")).alias("drop"))


def accounting_rows(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events under the key of the accounting episode to which their raw episode belongs."""
    return df.join(ledger.select(*EPISODE, "accounting_key"), EPISODE).withColumn("reset_key", F.col("accounting_key")).drop("accounting_key")


def usable_buckets(b: DataFrame, coverage: float = 0.95) -> DataFrame:
    return b.where(usable(coverage))


def usable(coverage: float = 0.95) -> Column:
    """Whether a bucket's dollars a point mean something."""
    return (F.col("points") > EPS) & F.col("usd").isNotNull() & (F.col("priced_tokens") + EPS >= coverage * F.col("tokens")) & ~F.col("fit_excluded")


def with_month(b: DataFrame) -> DataFrame:
    return b.withColumn("month", F.expr("date_format(timestampadd(MICROSECOND, end_us, timestamp_ntz'1970-01-01'), 'yyyy-MM')"))


def point_metrics(b: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over all buckets, dollars a point over the usable ones, and weighted quantiles of their dollars a point."""
    ok, point = usable(), F.sum(F.when(usable(), F.col("points")))
    out = b.groupBy(*keys).agg(
        F.count("*").alias("buckets"), *(F.sum(c).alias(c) for c in ("points", "tokens", "uncached", "cached", "output")), F.coalesce(point, F.lit(0.0)).alias("priced_points"),
        share(F.sum(F.when(ok, F.col("usd"))).cast("double"), point).alias("usd_per_point"),
    )
    q = weighted_quantile(usable_buckets(b).withColumn("rate", F.col("usd").cast("double") / F.col("points")), keys, "rate", "points", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.join(q, keys, "left")


def monthly_metrics(b: DataFrame) -> DataFrame:
    """``point_metrics`` by account and month of the bucket's end."""
    return point_metrics(with_month(b), ["account", "month"])


def with_dominant(b: DataFrame, mix: DataFrame, dims: list[str]) -> DataFrame:
    """Buckets with the dominant key of each dimension and its share (unknown and 0 where there are no tokens)."""
    for dim in dims:
        b = b.join(dominant(mix, [*EPISODE, "bucket"], dim), [*EPISODE, "bucket"], "left")
        b = b.withColumn(dim, F.coalesce(dim, F.lit("unknown"))).withColumn(f"{dim}_share", F.coalesce(f"{dim}_share", F.lit(0.0)))
    return b


def dominant_rows(b: DataFrame, purity: float, dim: str = "model") -> DataFrame:
    """Buckets of one known model at ``purity`` or more, with points, that no policy keeps out of fits."""
    return b.where((F.col("points") > EPS) & ~F.col("fit_excluded") & (F.col(dim) != "unknown") & (F.col(f"{dim}_share") + EPS >= purity))


def model_month(b: DataFrame, purity: float = 0.9, least_points: float = 5.0) -> DataFrame:
    """``point_metrics`` by account, month and dominant model, of buckets at ``purity``, rows with too few points left out."""
    rows = with_month(b).where(F.col("model_share") + EPS >= purity)
    return point_metrics(rows, ["account", "month", "model"]).where(F.col("points") + EPS >= least_points)


def replay_sensitivity(without: DataFrame, included: DataFrame, least_points: float = 5.0) -> DataFrame:
    """Dollars a point by account and month from buckets without and with replayed rows, and the change in percent, of months with
    enough priced points on both sides."""
    a, b = (monthly_metrics(x).where(F.col("priced_points") >= least_points).select("account", "month", F.col("priced_points").alias(f"points_{n}"), F.col("usd_per_point").alias(f"usd_{n}")) for x, n in ((without, "without"), (included, "included")))
    return a.join(b, ["account", "month"]).where(F.abs("usd_without") > EPS).withColumn("change_percent", (F.col("usd_included") / F.col("usd_without") - 1) * 100)


def cohort_rows(b: DataFrame, episodes: DataFrame, purity: float = 0.95, least_points: float = 10.0, least_episodes: int = 3, latest: bool = True, boots: int = DRAWS, level: float = 0.8) -> DataFrame:
    """Buckets with model and effort at ``purity`` by model, regime (``episodes``: account, reset_key, model, regime,
    end_us) and effort: tokens, their parts and dollars a point, dollars only with enough points and episodes of their
    own; and intervals of tokens and dollars a point from whole episodes drawn again (two or more). ``latest``: each model's
    last regime alone."""
    if latest:
        last = episodes.groupBy("model").agg(F.max_by("regime", F.struct("end_us", -F.col("regime"))).alias("regime"))
        episodes = episodes.join(last, ["model", "regime"], "left_semi")
    rows = dominant_rows(b, purity).where((F.col("effort") != "unknown") & (F.col("effort_share") + EPS >= purity))
    rows = rows.join(episodes.select(*EPISODE, "model", "regime"), [*EPISODE, "model"])
    ep, ok = F.struct(*EPISODE), usable()
    c = rows.groupBy("model", "regime", "effort").agg(
        F.count("*").alias("buckets"), F.count_distinct(ep).alias("episodes"), F.sum("points").alias("points"), *((F.sum(x) / 1e6 / F.sum("points")).alias(f"{x}_m_per_point") for x in ("tokens", "uncached", "cached", "output")),
        F.coalesce(F.sum(F.when(ok, F.col("points"))), F.lit(0.0)).alias("priced_points"), F.count_distinct(F.when(ok, ep)).alias("priced_episodes"),
        share(F.sum(F.when(ok, F.col("usd"))).cast("double"), F.sum(F.when(ok, F.col("points")))).alias("usd_per_point"),
    )
    c = c.where((F.col("points") + EPS >= least_points) & (F.col("episodes") >= least_episodes))
    enough = (F.col("priced_points") + EPS >= least_points) & (F.col("priced_episodes") >= least_episodes)
    by = ["model", "regime", "effort"]
    e = rows.groupBy(*by, *EPISODE).agg(F.sum("tokens").alias("t"), F.sum("points").alias("p"), F.sum(F.when(ok, F.col("usd"))).cast("double").alias("u"), F.sum(F.when(ok, F.col("points"))).alias("q"))
    times = lambda x: F.sum(F.col(x) * F.col("times"))
    per = drawn(e, boots, "r", [*by, *EPISODE]).groupBy(*by, "rep").agg((times("t") / 1e6 / times("p")).alias("tokens_m"), share(times("u"), times("q")).alias("usd"))
    tail = (1 - level) / 2
    span = per.groupBy(*by).agg(*(F.percentile(x, F.lit(q)).alias(f"{x}_{n}") for x in ("tokens_m", "usd") for n, q in (("low", tail), ("high", 1 - tail))))
    many = F.col("episodes") > 1
    c = c.join(span, by, "left").withColumns({f"{x}_{n}": F.when(many if x == "tokens_m" else many & enough, F.col(f"{x}_{n}")) for x in ("tokens_m", "usd") for n in ("low", "high")})
    return c.withColumn("usd_per_point", F.when(enough, F.col("usd_per_point")))


def quota_slice(b: DataFrame, points: float, from_end: bool = False) -> DataFrame:
    """Exactly ``points`` from one end of each episode; the bucket on the edge counts in part."""
    order = F.desc("bucket") if from_end else F.col("bucket")
    before = F.coalesce(F.sum("points").over(Window.partitionBy(*EPISODE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(points) - before) / F.col("points")))
    d = b.where("points > 0").withColumn("part", part)
    return d.groupBy(*EPISODE).agg(F.sum(F.col("points") * F.col("part")).alias("points"), F.round(F.sum(F.col("tokens") * F.col("part")), 4).alias("tokens"), F.max((F.col("part") > 0) & (F.col("part") < 1)).alias("interpolated")).withColumn("complete", F.col("points") >= points - EPS)
