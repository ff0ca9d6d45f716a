"""Reviewer policy, bursts that it splits, confirmed resets, and ratios over strata."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.temporal import share
from meterline.operators import quota

STATUSES = ("historical", "free", "transition", "unknown", "outside_scope")


def policy_status(df: DataFrame, transition_us: int, announced_us: int, member: str = "subscription") -> DataFrame:
    """``policy``: API sign-in is outside the scope at any date; else historical, in transition, and from the
    announcement on free for ``member`` sign-in and unknown for others. ``policy_points`` is 0 only where free."""
    at = F.col("us")
    status = F.when(F.col("sign_in") == "api", "outside_scope").when(at.isNull(), "unknown").when(at < transition_us, "historical").when(at < announced_us, "transition").when(F.col("sign_in") == member, "free").otherwise("unknown")
    return df.withColumn("policy", status).withColumn("policy_points", F.when(F.col("policy") == "free", 0.0))


def policy_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Requests and tokens by status, and the one status there is, or ``mixed``."""
    tokens = F.col("input") + F.col("output")
    columns = [c for s in STATUSES for c in (F.count_if(F.col("policy") == s).alias(f"requests_{s}"), F.coalesce(F.sum(F.when(F.col("policy") == s, tokens)), F.lit(0)).alias(f"tokens_{s}"))]
    one = F.when(F.min("policy") == F.max("policy"), F.min("policy")).otherwise("mixed")
    return df.groupBy(*keys).agg(one.alias("policy"), *columns)


def split_policy(df: DataFrame, gap_us: int, period: str) -> DataFrame:
    """Bursts of a source that also end where the policy status or the reset period changes."""
    w = Window.partitionBy("source").orderBy("us", "line")
    new = (F.col("us") - F.lag("us").over(w) > gap_us) | (F.lag("policy").over(w) != F.col("policy")) | (F.lag(period).over(w) != F.col(period))
    d = df.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("burst", F.sum("_new").over(w))
    return d.groupBy("source", "burst", "policy", period).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("requests"), F.sum(F.col("input") + F.col("output")).alias("tokens"))


def match_markers(markers: DataFrame, boundaries: DataFrame, most_us: int) -> DataFrame:
    """Each confirmed reset (account, marker, start, end: half-open) with the account's nearest boundary (reset_key,
    activation_us, first_us), by whichever of its two times lies nearer to the marker; ties: the earliest activation.

    ``outcome`` is matched, displaced (a nearer marker holds that boundary), or unmatched (none within ``most_us``).
    An account has few markers and few boundaries, and they meet by account.
    """
    def off(t: str) -> Column:
        at = F.col(t)
        return F.when(at < F.col("start"), F.col("start") - at).when(at < F.col("end"), 0).otherwise(at - F.col("end"))

    pairs = markers.join(boundaries, "account", "left").withColumn("offset_us", F.least(off("activation_us"), off("first_us")))
    best = F.min_by(F.struct("reset_key", "offset_us"), F.struct("offset_us", "activation_us", "reset_key"))
    near = pairs.groupBy("account", "marker", "start").agg(best.alias("b")).select("account", "marker", "start", "b.*")
    within = F.coalesce(F.col("offset_us") <= most_us, F.lit(False))
    w = Window.partitionBy("account", "reset_key", within).orderBy("offset_us", "start", "marker")
    outcome = F.when(~within, "unmatched").when(F.row_number().over(w) == 1, "matched").otherwise("displaced")
    return near.select("account", "marker", F.when(within, F.col("reset_key")).alias("reset_key"), "offset_us", outcome.alias("outcome"))


def capacity_ratio(df: DataFrame, keys: list[str], strata: list[str], marked: str, points: str, amount: str) -> DataFrame:
    """Amount a point of marked against other periods: the mean of the log ratios of the strata that have both sides,
    weighed by the marked points."""
    on = F.col(marked) & (F.col(points) > 0) & F.col(amount).isNotNull()
    off = ~F.col(marked) & (F.col(points) > 0) & F.col(amount).isNotNull()
    sums = [F.sum(F.when(side, F.col(c))).alias(n) for side, c, n in ((on, amount, "a1"), (on, points, "p1"), (off, amount, "a0"), (off, points, "p0"))]
    s = df.groupBy(*keys, *strata).agg(*sums).where("a1 > 0 and a0 > 0")
    log = F.log((F.col("a1") / F.col("p1")) / (F.col("a0") / F.col("p0")))
    return s.groupBy(*keys).agg(F.count("*").alias("strata"), F.exp(F.sum(log * F.col("p1")) / F.sum("p1")).alias("ratio"))


def model_mix(df: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """The models with at least ``least`` of the tokens as text, the largest first (ties by name)."""
    per = df.groupBy(*keys, "model").agg(F.sum(F.col("input") + F.col("output")).alias("t"))
    per = per.withColumn("share", share(F.col("t"), F.sum("t").over(Window.partitionBy(*keys))))
    text = F.concat("model", F.lit(" "), F.round(F.col("share") * 100).cast("int"), F.lit("%"))
    rows = F.array_sort(F.collect_list(F.when(F.col("share") >= least, F.struct((-F.col("t")).alias("t"), "model", text.alias("text")))))
    return per.groupBy(*keys).agg(F.coalesce(F.nullif(F.array_join(F.transform(rows, lambda r: r["text"]), ", "), F.lit("")), F.lit("n/a")).alias("mix"))


def episode_metric(buckets: DataFrame, by: list[str], episode: list[str], coverage: float = 0.95) -> DataFrame:
    """Dollars a point of each episode if every episode of its group has enough priced points, else tokens a point."""
    ok = quota.usable(coverage)
    e = buckets.where("points > 0").groupBy(*episode).agg(F.sum("points").alias("points"), F.sum("tokens").alias("tokens"), F.sum(F.when(ok, F.col("points"))).alias("_p"), F.sum(F.when(ok, F.col("usd"))).cast("double").alias("_usd"))
    e = e.withColumn("_api", F.when((F.col("_p") >= F.greatest(F.lit(1.0), 0.8 * F.col("points"))) & (F.col("_usd") > 0), F.col("_usd") / F.col("_p")))
    priced = F.min(F.col("_api").isNotNull()).over(Window.partitionBy(*by))
    e = e.withColumn("basis", F.when(priced, "usd_per_point").otherwise("mtok_per_point"))
    return e.withColumn("metric", F.when(F.col("basis") == "usd_per_point", F.col("_api")).otherwise(F.col("tokens") / 1e6 / F.col("points"))).drop("_p", "_usd", "_api")
