"""Rate cards and cost. Money is decimal, so that sums don't depend on the order of rows."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.functions.temporal import share

RATE = "decimal(8,4)"


def rate_dimension(spark: SparkSession, rows: list[tuple], overrides: list[tuple] = ()) -> DataFrame:
    """(model, r_in, r_cached, r_out): dollars a million tokens; rows in ``overrides`` replace those of their model."""
    schema = "model string, r_in double, r_cached double, r_out double"
    base, over = spark.createDataFrame(list(rows), schema), spark.createDataFrame(list(overrides), schema)
    every = base.join(over, "model", "left_anti").unionByName(over)
    return every.select("model", *(F.col(c).cast(RATE).alias(c) for c in ("r_in", "r_cached", "r_out")))


def resolve_rate_model(df: DataFrame, aliases: DataFrame, rates: DataFrame) -> DataFrame:
    """``rate_model``: the model itself where it has a price, else what its alias means at the row's time."""
    own = rates.select("model", F.lit(True).alias("_own"))
    a = aliases.select(F.col("alias").alias("model"), "valid_from_us", "valid_to_us", F.col("target").alias("_target"))
    d = df.join(own, "model", "left")
    at = (F.col("model") == F.col("_alias")) & (F.col("us") >= F.col("valid_from_us")) & (F.col("us") < F.col("valid_to_us"))
    d = d.join(a.withColumnRenamed("model", "_alias"), at, "left")
    return d.withColumn("rate_model", F.when(F.col("_own"), F.col("model")).otherwise(F.col("_target"))).drop("_own", "_alias", "_target", "valid_from_us", "valid_to_us")


def price_events(df: DataFrame, rates: DataFrame, long_input: int = 272_000, exempt: list[str] = ()) -> DataFrame:
    """``base_usd`` and ``usd`` (long contexts: input x2, output x1.5); null where the model has no rate."""
    r = rates.withColumnRenamed("model", "_m")
    d = df.join(r, F.col("rate_model") == F.col("_m"), "left")
    million = F.lit("0.000001").cast("decimal(7,6)")
    tokens = lambda c: F.col(c).cast("decimal(12,0)")
    inputs = tokens("uncached") * F.col("r_in") + tokens("cached") * F.col("r_cached")
    outputs = tokens("output") * F.col("r_out")
    long = (F.col("input") > long_input) & ~F.coalesce(F.col("rate_model").isin(list(exempt)), F.lit(False))
    usd = F.when(long, inputs * 2 + outputs * F.lit("1.5").cast("decimal(2,1)")).otherwise(inputs + outputs)
    d = d.withColumn("long_context", long & F.col("_m").isNotNull())
    return d.withColumn("base_usd", ((inputs + outputs) * million).cast("decimal(38,12)")).withColumn("usd", (usd * million).cast("decimal(38,12)")).drop("_m", "r_in", "r_cached", "r_out")


def totals() -> list:
    """The aggregate columns that every grouped operator shares."""
    priced = F.col("usd").isNotNull()
    return [
        F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in ("input", "cached", "uncached", "output", "reasoning")),
        F.sum("usd").cast("double").alias("usd"), F.count_if(priced).alias("priced_requests"),
        F.coalesce(F.sum(F.when(priced, F.col("input") + F.col("output"))), F.lit(0)).alias("priced_tokens"),
    ]


def group_cost(df: DataFrame, keys: list[str]) -> DataFrame:
    """Base and adjusted cost, long contexts, and the rate rows used, ``mixed (a, b)`` for several."""
    rows = F.array_sort(F.collect_set("rate_model"))
    label = F.when(F.size(rows) == 1, rows[0]).when(F.size(rows) > 1, F.concat(F.lit("mixed ("), F.array_join(rows, ", "), F.lit(")")))
    return df.groupBy(*keys).agg(F.sum("base_usd").cast("double").alias("base_usd"), F.sum("usd").cast("double").alias("usd"), F.count_if("long_context").alias("long_contexts"), label.alias("rates"))


def pricing_breakdown(df: DataFrame) -> DataFrame:
    """By observed model and rate row, dearest first: totals, what long contexts add, and the share of all priced tokens
    and of all dollars (a row a model and rate: a small table)."""
    d = df.groupBy("model", "rate_model").agg(*totals(), F.count_if("long_context").alias("long_contexts"), (F.sum("usd") - F.sum("base_usd")).cast("double").alias("uplift"))
    every = Window.partitionBy(F.lit(0))
    d = d.withColumns({"token_share": share(F.col("priced_tokens"), F.sum("priced_tokens").over(every)), "usd_share": share(F.sum("usd").over(Window.partitionBy("model", "rate_model")), F.sum("usd").over(every))})
    return d.orderBy(F.desc_nulls_last("usd"), "model")


def unpriced_models(df: DataFrame, rates: DataFrame) -> DataFrame:
    left = df.join(rates.select(F.col("model").alias("rate_model")), "rate_model", "left_anti")
    return left.groupBy("model").agg(F.sum(F.col("input") + F.col("output")).alias("tokens"))
