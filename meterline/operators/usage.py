"""Calendar usage: periods, local days, the usage cube, coverage."""

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.temporal import share
from meterline.operators.pricing import totals

UTC = ZoneInfo("UTC")


def month_bounds(month: str, tz: str = "UTC") -> tuple[int, int]:
    """Microseconds of the half-open bounds of a calendar month in a zone, right across changes of the clock."""
    y, m = map(int, month.split("-"))
    ends = [datetime(y, m, 1, tzinfo=ZoneInfo(tz)), datetime(y + m // 12, m % 12 + 1, 1, tzinfo=ZoneInfo(tz))]
    return tuple(round(e.timestamp()) * 1_000_000 for e in ends)


def filter_period(df: DataFrame, month: str | None = None, after: datetime | None = None, before: datetime | None = None, tz: str = "UTC") -> DataFrame:
    """Rows in a month, or in [after, before); naming both a month and bounds, or an empty range, is an error."""
    if month and (after or before):
        raise ValueError("either a month or bounds")
    if month:
        low, high = month_bounds(month, tz)
        return df.where((F.col("us") >= low) & (F.col("us") < high))
    if after and before and after >= before:
        raise ValueError("an empty range")
    for bound, keep in ((after, lambda x: F.col("us") >= x), (before, lambda x: F.col("us") < x)):
        if bound:
            df = df.where(keep(round(bound.timestamp() * 1_000_000)))
    return df


def local_day(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """``day``: the local calendar date; both repeats of an hour fall on one day."""
    return df.withColumn("day", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("ts"))))


def usage_aggregate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Totals with pricing status: complete, partial, unavailable (nothing priced) or not_available (nothing there);
    ``equivalent`` only where complete; what long contexts add; and requests by sign-in evidence where ``df`` has it."""
    more = [F.count_if("long_context").alias("long_contexts"), (F.sum("usd") - F.sum("base_usd")).cast("double").alias("uplift")]
    if "auth_source" in df.columns:
        more += [F.count_if(F.coalesce("auth_source", F.lit("unknown")) == s).alias(f"auth_{s}") for s in ("explicit", "plan", "unknown")]
    d = df.groupBy(*keys).agg(*totals(), *more)
    status = F.when(F.col("requests") == 0, "not_available").when(F.col("priced_requests") == F.col("requests"), "complete").when(F.col("priced_requests") > 0, "partial").otherwise("unavailable")
    d = d.withColumn("pricing_status", status).withColumn("equivalent", F.when(F.col("pricing_status") == "complete", F.col("usd")))
    every = F.col("input") + F.col("output")
    return d.withColumns({"cached_fraction": share(F.col("cached"), F.col("input")), "cached_of_all": share(F.col("cached"), every), "price_coverage": share(F.col("priced_tokens"), every)})


#: The sign-in modes and channels that a report always lists.
SIGN_INS, CHANNELS = ("subscription", "api", "unknown"), ("agent", "reviewer")


def usage_cube(df: DataFrame) -> DataFrame:
    """One row for each value of day, model, sign_in and activity alone, for each (model, sign_in, activity), and the
    total; ``level`` says which. Each sign-in mode and channel has a row, with no requests if there are none."""
    sets = [[F.col("day")], [F.col("model")], [F.col("sign_in")], [F.col("activity")], [F.col("model"), F.col("sign_in"), F.col("activity")], []]
    d = df.groupingSets(sets, "day", "model", "sign_in", "activity").agg(F.grouping_id().alias("g"), *totals())
    level = F.create_map(*(F.lit(x) for kv in {7: "day", 11: "model", 13: "sign_in", 14: "activity", 8: "mix", 15: "total"}.items() for x in kv))
    d = d.withColumn("level", level[F.col("g").cast("int")]).drop("g")
    always = [("sign_in", s, None) for s in SIGN_INS] + [("activity", None, c) for c in CHANNELS]
    fixed = df.sparkSession.createDataFrame(always, "level string, sign_in string, activity string")
    same = ["level", "sign_in", "activity"]
    absent = fixed.join(F.broadcast(d.where(F.col("level").isin("sign_in", "activity")).select(*(F.col(c).alias(f"_{c}") for c in same))), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], "left_anti")
    zero = [F.lit(0).cast(f.dataType).alias(f.name) for f in d.schema if f.name in ("requests", "input", "cached", "uncached", "output", "reasoning", "priced_requests", "priced_tokens")]
    return d.unionByName(absent.select(*same, *zero), allowMissingColumns=True)


def usage_coverage(df: DataFrame, incomplete: bool = False) -> DataFrame:
    """One row over all events of a period: first and last, days observed, what has no meter (``metered``), no price or
    lies in dense seconds, replayed rows left out of all these, and warnings. ``incomplete``: the history holds lines
    or usage that couldn't be read."""
    on = ~F.col("replay")
    x = lambda c: F.when(on, c)
    one = df.agg(F.min(x(F.col("us"))).alias("first_us"), F.max(x(F.col("us"))).alias("last_us"), F.count_distinct(x(F.col("day"))).alias("days"), F.count_if(on).alias("events"), F.count_if(on & F.col("usd").isNull()).alias("unpriced"), F.count_if(on & F.col("dense")).alias("dense"), F.count_if(on & ~F.col("metered")).alias("without_meter"), F.count_if("replay").alias("excluded_replay"))
    warn = F.array_compact(F.array(F.when(F.col("events") == 0, F.lit("no_events")), F.when(F.col("unpriced") > 0, F.lit("unpriced")), F.when(F.col("dense") > 0, F.lit("dense")), F.when(F.lit(incomplete), F.lit("incomplete_history"))))
    return one.withColumn("warnings", F.array_join(warn, ","))
