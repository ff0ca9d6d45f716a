"""Cleaning of usage events: carried state, repeats, replays, dense seconds, classes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.temporal import carry_forward


def carry_state(df: DataFrame, columns: list[str] = ("model", "effort")) -> DataFrame:
    """State as last stated in the same source, in line order, this row included."""
    return carry_forward(df, list(columns), ["source"], ["line"])


def carry_auth(df: DataFrame) -> DataFrame:
    """``sign_in``: the last explicit evidence, else the last plan label (``auth_source`` tells which); ``conflict`` if
    explicit ones disagree."""
    d = carry_forward(df, ["auth", "plan"], ["source"], ["line"], "_seen")
    before = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    conflict = F.min("auth").over(before) != F.max("auth").over(before)
    d = d.withColumn("sign_in", F.coalesce("auth_seen", "plan_seen", F.lit("unknown"))).withColumn("conflict", F.coalesce(conflict, F.lit(False)))
    source = F.when(F.col("auth_seen").isNotNull(), "explicit").when(F.col("plan_seen").isNotNull(), "plan").otherwise("unknown")
    return d.withColumn("auth_source", source).drop("auth_seen", "plan_seen")


def drop_repeated_cumulative(df: DataFrame, totals: list[str]) -> DataFrame:
    """Without the rows whose cumulative counts equal those of the source's previous row that has them."""
    w = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    now = F.struct(*totals)
    known = F.when(~F.greatest(*(F.col(c).isNull().cast("int") for c in totals)).cast("boolean"), now)
    return df.withColumn("_last", F.last(known, ignorenulls=True).over(w)).where("_last is null or not (_last <=> struct({}))".format(", ".join(totals))).drop("_last")


def valid_usage(df: DataFrame, include_unmetered: bool = True) -> DataFrame:
    """Rows with whole counts, and ``uncached``, at least 0. ``include_unmetered``: without negative counts or more cached
    than input, as nothing else vouches for such a row; else cached counts are only cut at input."""
    counts = ["input", "cached", "output", "reasoning"]
    d = df.withColumns({c: F.col(c).try_cast("long") for c in counts})
    d = d.where(" and ".join(f"{c} is not null" for c in counts))
    if include_unmetered:
        d = d.where("input >= 0 and cached >= 0 and output >= 0 and reasoning >= 0 and cached <= input")
    return d.withColumn("uncached", F.greatest(F.col("input") - F.col("cached"), F.lit(0)))


def global_dedup(df: DataFrame, identity: list[str], quality: list[str]) -> DataFrame:
    """One row for each identity: the first of those with the most known ``quality`` columns."""
    known = sum((F.col(c).isNotNull().cast("int") for c in quality), F.lit(0))
    w = Window.partitionBy(*identity).orderBy(F.desc("_q"), "us", "source", "line")
    return df.withColumn("_q", known).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_q", "_n")


def flag_replay_prefix(df: DataFrame, scan_us: int = 2_000_000, least: int = 20, growth: float = 5e6, start_most: float = 2e6) -> DataFrame:
    """``replay``: rows in the opening seconds of a source whose cumulative counter rebuilds itself there.

    The opening counts if it has enough rows, nearly all with totals that hardly ever fall (98% of steps), starts low,
    grows by ``growth``, and either its meters span different periods or readings, or it grows five times as much.
    """
    by = Window.partitionBy("source")
    d = df.withColumn("_first", F.min("us").over(by)).withColumn("_in", F.col("us") <= F.col("_first") + scan_us)
    step = Window.partitionBy("source").orderBy("line")
    o = d.where("_in").withColumn("_up", (F.col("total") >= F.lag("total").over(step)).cast("int"))
    s = o.groupBy("source").agg(
        F.count("*").alias("n"), F.count("total").alias("with_total"), F.avg("_up").alias("up"), F.min_by("total", "line").alias("start"),
        (F.max_by("total", "line") - F.min_by("total", "line")).alias("grown"), (F.max("reset_at") - F.min("reset_at")).alias("reset_span"), (F.max("used") - F.min("used")).alias("used_span"),
    )
    enough = (F.col("n") >= least) & (F.col("with_total") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.9)))
    evidence = (F.col("reset_span") >= 60) | (F.col("used_span") >= 2) | (F.col("grown") >= 5 * growth)
    proven = s.where(enough & (F.col("up") >= 0.98) & (F.col("start") <= start_most) & (F.col("grown") >= growth) & evidence).select("source", F.lit(True).alias("_proven"))
    d = d.join(proven, "source", "left")
    return d.withColumn("replay", F.coalesce(F.col("_in") & F.col("_proven"), F.lit(False))).drop("_first", "_in", "_proven")


def flag_dense(df: DataFrame, span_us: int, threshold: int) -> DataFrame:
    """``dense``: more than ``threshold`` rows of the source in the same span, unless all are proven replays."""
    w = Window.partitionBy("source", F.expr(f"us div {span_us}"))
    return df.withColumn("dense", (F.count("*").over(w) > threshold) & ~F.min("replay").over(w))


def activity_class(df: DataFrame) -> DataFrame:
    """``activity``: reviewer inference, the parents whose approvals a reviewer or the user gives, other subagents, the
    rest; ``channel``: auto_review or agent."""
    mode = F.col("approvals_reviewer")
    kind = (
        F.when(F.col("reviewer"), "auto-review inference").when(mode == "auto_review", "auto-review parent").when(mode == "user", "user-review parent")
        .when(F.col("source_kind") == "subagent", "other subagent").otherwise("other")
    )
    return df.withColumn("activity", kind).withColumn("channel", F.when(F.col("reviewer"), "auto_review").otherwise("agent"))


def declare_auth(df: DataFrame, mode: str) -> DataFrame:
    """Fills the unknown sign-in of reviewer rows with an assumption."""
    return df.withColumn("sign_in", F.when(F.col("reviewer") & (F.col("sign_in") == "unknown") & ~F.col("conflict"), mode).otherwise(F.col("sign_in")))


def coverage(df: DataFrame) -> DataFrame:
    """What the events can support: for each meter window in ``meters`` (and one row with a null window for all events)
    the first and last instant, how many, and how many sources and known models."""
    windows = F.concat(F.array(F.lit(None).cast("int")), F.coalesce(F.map_keys("meters"), F.array().cast("array<int>")))
    d = df.select("us", "source", F.nullif("model", F.lit("unknown")).alias("model"), F.explode(windows).alias("window_minutes"))
    return d.groupBy("window_minutes").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("events"), F.count_distinct("source").alias("sources"), F.count_distinct("model").alias("models"))


def parse_counts(records: DataFrame) -> DataFrame:
    """One row over ``parse_records``: files, lines, and lines that aren't JSON objects."""
    return records.agg(F.count_distinct("source").alias("files"), F.count("*").alias("lines"), F.count_if("bad").alias("bad_lines"))
