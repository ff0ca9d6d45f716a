"""Quota capacity of confirmed resets: periods, matched ratios with intervals, and equal slices around a boundary."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.temporal import share
from meterline.operators.quota import EPISODE, EPS
from meterline.operators.stats import DRAWS, drawn

#: The four measures of a period, the most telling first: without or with reviewers, dollars or tokens.
MEASURES = ("core_usd", "all_usd", "core_tokens", "all_tokens")


def capacity_periods(b: DataFrame, mix: DataFrame, episodes: DataFrame, coverage: float = 0.95, purity: float = 0.9, least_points: float = 5.0) -> DataFrame:
    """One row for each reset period: points, tokens and dollars with and without reviewers (dollars only at enough price
    coverage), its dominant model and effort without reviewers (``mix``: tokens by bucket, dim and key), where the next
    one starts, and whether it is ``eligible`` for comparison. ``episodes``: account, reset_key, activation_us, regime."""
    s = b.groupBy(*EPISODE).agg(*(F.sum(c).alias(c) for c in ("points", "tokens", "priced_tokens", "usd", "core_tokens", "core_priced_tokens", "core_usd")), F.max("fit_excluded").alias("fit_excluded"))
    for dim in ("model", "effort"):
        per = mix.where(F.col("dim") == dim).groupBy(*EPISODE, "key").agg(F.sum("tokens").alias("t"))
        best = per.groupBy(*EPISODE).agg(F.min_by("key", F.struct(-F.col("t"), F.col("key"))).alias(dim), share(F.max("t"), F.sum("t")).alias(f"{dim}_share"))
        s = s.join(best, EPISODE, "left").withColumns({dim: F.coalesce(dim, F.lit("unknown")), f"{dim}_share": F.coalesce(f"{dim}_share", F.lit(0.0))})
    nxt = F.lead("activation_us").over(Window.partitionBy("account").orderBy("activation_us", "reset_key"))
    s = episodes.withColumn("end_us", nxt).join(s, EPISODE)
    usd = lambda p, of: F.when((F.col(of) > 0) & (F.col(p) + EPS >= coverage * F.col(of)), F.col("usd" if of == "tokens" else "core_usd"))
    known = (F.col("model") != "unknown") & (F.col("effort") != "unknown") & F.col("regime").isNotNull()
    eligible = (F.col("points") + EPS >= least_points) & ~F.col("fit_excluded") & (F.col("model_share") + EPS >= purity) & (F.col("effort_share") + EPS >= purity) & known
    out = s.select(
        *EPISODE, "activation_us", "end_us", "regime", "model", "model_share", "effort", "effort_share", "points", F.col("tokens").alias("all_tokens"), usd("priced_tokens", "tokens").cast("double").alias("all_usd"),
        "core_tokens", usd("core_priced_tokens", "core_tokens").cast("double").alias("core_usd"), eligible.alias("eligible"),
    )
    return out.withColumns({f"{m}_per_point": share(F.col(m), F.col("points")) for m in MEASURES})


def _pooled(rows: DataFrame, keys: list[str], strata: list[str], weight: Column) -> DataFrame:
    """exp of the point-weighted mean log ratio of marked to other periods over strata with both, for each measure."""
    sums = []
    for m in MEASURES:
        for side, on in (("1", F.col("marked")), ("0", ~F.col("marked"))):
            ok = on & F.col(m).isNotNull() & (F.col("points") > EPS)
            sums += [F.sum(F.when(ok, F.col(m) * weight)).alias(f"{m}_a{side}"), F.sum(F.when(ok, F.col("points") * weight)).alias(f"{m}_p{side}")]
    points = F.sum(F.when(F.col("marked"), F.col("points") * weight)).alias("_w")
    s = rows.groupBy(*keys, *strata).agg(*sums, points)
    out = []
    for m in MEASURES:
        a1, p1, a0, p0 = (F.col(f"{m}_{x}") for x in ("a1", "p1", "a0", "p0"))
        log = F.when((a1 > 0) & (a0 > 0), F.log((a1 / p1) / (a0 / p0)))
        out.append(F.exp(F.sum(log * F.col("_w")) / F.sum(F.when(log.isNotNull(), F.col("_w")))).alias(m))
    return s.groupBy(*keys).agg(*out)


def capacity_bootstrap(periods: DataFrame, keys: list[str], strata: list[str], ids: list[str], boots: int = DRAWS, level: float = 0.8, seed: str = "c") -> DataFrame:
    """For each group: how many marked and other periods share strata, and by measure the pooled ratio with an interval
    from periods (told apart by ``ids``) drawn again; and the ``verdict`` on a ratio of one half by the most telling
    measure: above, below, includes, no_interval, or insufficient. ``periods`` has ``marked``, points and the measures."""
    by = Window.partitionBy(*keys, *strata)
    sides = F.count_if("marked").over(by), F.count_if(~F.col("marked")).over(by)
    p = periods.withColumns({"_1": sides[0], "_0": sides[1]}).where("_1 > 0 and _0 > 0").drop("_1", "_0")
    point = _pooled(p, keys, strata, F.lit(1.0)).join(p.groupBy(*keys).agg(F.count_if("marked").alias("marked_periods"), F.count_if(~F.col("marked")).alias("other_periods")), keys)
    per = _pooled(drawn(p, boots, seed, [*keys, *ids]), [*keys, "rep"], strata, F.col("times"))
    tail = (1 - level) / 2
    span = per.groupBy(*keys).agg(*(F.percentile(m, F.lit(q)).alias(f"{m}_{n}") for m in MEASURES for n, q in (("low", tail), ("high", 1 - tail))))
    out = periods.select(*keys).distinct().join(point, keys, "left").join(span, keys, "left").na.fill(0, ["marked_periods", "other_periods"])
    return out.withColumns(dict(zip(("measure", "verdict"), verdict(), strict=True)))


def verdict(half: float = 0.5) -> tuple[Column, Column]:
    """The most telling measure that has a ratio, and how its interval lies to ``half``."""
    pick = lambda suffix: F.coalesce(*(F.when(F.col(m).isNotNull(), F.col(m + suffix)) for m in MEASURES))
    measure = F.coalesce(*(F.when(F.col(m).isNotNull(), F.lit(m)) for m in MEASURES))
    low, high = pick("_low"), pick("_high")
    return measure, F.when(measure.isNull(), "insufficient").when(low.isNull() | high.isNull(), "no_interval").when(low > half + EPS, "above").when(high < half - EPS, "below").otherwise("includes")


def slices(b: DataFrame, sizes: list[float], from_end: bool) -> DataFrame:
    """For each episode and size: exactly so many points from one end, the bucket on the edge in part: measures, the meter
    at both ends, and whether the points were all there (``complete``) and split (``interpolated``)."""
    order = F.desc("bucket") if from_end else F.col("bucket")
    before = F.coalesce(F.sum("points").over(Window.partitionBy(*EPISODE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = b.where(F.col("points") > EPS).withColumn("_before", before).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    d = d.withColumn("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("size") - F.col("_before")) / F.col("points")))).where("part > 0")
    cut = F.col("points") * F.col("part")
    low = F.min(F.when(F.lit(from_end), F.col("end_used") - cut).otherwise(F.col("start_used")))
    high = F.max(F.when(F.lit(from_end), F.col("end_used")).otherwise(F.col("start_used") + cut))
    part = lambda c, n: F.sum(F.col(c).cast("double") * F.col("part")).alias(n)
    return d.groupBy(*EPISODE, "size").agg(
        F.sum(cut).alias("points"), low.alias("meter_start"), high.alias("meter_end"), F.max((F.col("part") < 1)).alias("interpolated"), part("tokens", "all_tokens"), part("usd", "all_usd"),
        part("core_tokens", "core_tokens"), part("core_usd", "core_usd"), F.max("fit_excluded").alias("fit_excluded"),
    ).withColumn("complete", F.col("points") + EPS >= F.col("size"))


def boundary_pairs(b: DataFrame, periods: DataFrame, sizes: list[float], most_start: float = 1.0) -> DataFrame:
    """The last points before each marked reset against the first after it, for each size: four ratios, and whether the
    pair is ``eligible``: both complete, the same known model, effort and regime, the second starting near 0.
    ``periods``: ``capacity_periods`` with ``marked``."""
    w = Window.partitionBy("account").orderBy("activation_us", "reset_key")
    last = lambda c: F.lag(c).over(w).alias(f"_{c}")
    p = periods.select("*", last("reset_key"), last("model"), last("effort"), last("regime")).where(F.col("marked") & F.col("_reset_key").isNotNull())
    side = lambda s, n: s.select("account", F.col("reset_key").alias(f"{n}_key"), "size", *(F.col(c).alias(f"{n}_{c}") for c in s.columns if c not in ("account", "reset_key", "size")))
    j = p.withColumnsRenamed({"reset_key": "after_key", "_reset_key": "before_key"}).join(side(slices(b, sizes, True), "before"), ["account", "before_key"]).join(side(slices(b, sizes, False), "after"), ["account", "after_key", "size"])
    same = (F.col("model") == F.col("_model")) & (F.col("effort") == F.col("_effort")) & (F.col("regime") == F.col("_regime")) & (F.col("model") != "unknown") & (F.col("effort") != "unknown")
    fair = F.col("before_complete") & F.col("after_complete") & ~F.col("before_fit_excluded") & ~F.col("after_fit_excluded") & (F.col("after_meter_start") <= most_start + EPS)
    out = j.withColumn("eligible", F.coalesce(same, F.lit(False)) & fair)
    return out.select("account", "after_key", "before_key", "size", "model", "effort", "regime", "eligible", *(f"{n}_{m}" for m in MEASURES for n in ("before", "after")), *(share(F.col(f"after_{m}"), F.col(f"before_{m}")).alias(m) for m in MEASURES))


def boundary_summary(pairs: DataFrame, keys: list[str], boots: int = DRAWS, level: float = 0.8, preferred: float = 14.0, seed: str = "s") -> DataFrame:
    """Eligible pairs by size: pooled ratios, intervals from pairs drawn again (two or more), the verdict, whether this is
    the ``preferred`` size (else the largest), and ``transient``: near half at the least size and recovered at the largest."""
    p = pairs.where("eligible")
    def pooled(rows: DataFrame, keys: list[str], times: Column) -> DataFrame:
        ok = lambda m: F.col(f"after_{m}").isNotNull() & (F.col(f"before_{m}") > EPS)
        sums = lambda side, m: F.sum(F.when(ok(m), F.col(f"{side}_{m}") * times))
        return rows.groupBy(*keys).agg(F.count("*").alias("pairs"), *(share(sums("after", m), sums("before", m)).alias(m) for m in MEASURES))

    per = pooled(drawn(p, boots, seed, [*keys, "size", "account", "after_key"]), [*keys, "size", "rep"], F.col("times")).drop("pairs")
    tail = (1 - level) / 2
    span = per.groupBy(*keys, "size").agg(*(F.percentile(m, F.lit(q)).alias(f"{m}_{n}") for m in MEASURES for n, q in (("low", tail), ("high", 1 - tail))))
    out = pooled(p, [*keys, "size"], F.lit(1.0)).join(span, [*keys, "size"], "left")
    out = out.withColumns({f"{m}_{n}": F.when(F.col("pairs") > 1, F.col(f"{m}_{n}")) for m in MEASURES for n in ("low", "high")}).withColumns(dict(zip(("measure", "verdict"), verdict(), strict=True)))
    every = Window.partitionBy(*keys)
    best = F.coalesce(F.max(F.when(F.col("size") == preferred, F.col("size"))).over(every), F.max("size").over(every))
    ratio = F.coalesce(*MEASURES)
    out = out.withColumns({"preferred": F.col("size") == best, "_least": F.min("size").over(every), "_most": F.max("size").over(every), "_ratio": ratio})
    low, high = (F.max(F.when(F.col("size") == F.col(c), F.col("_ratio"))).over(every) for c in ("_least", "_most"))
    return out.withColumn("transient", F.coalesce((F.col("_least") < F.col("_most")) & (low <= 0.65) & (high >= 0.8), F.lit(False))).drop("_least", "_most", "_ratio")
