"""Sources: raw session logs in JSON lines, and the telemetry view of the driver's ``events`` table."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, line, value): the lines of ``*.jsonl`` files below ``paths``, numbered within each file.

    The number follows the block's start and the row's place in it, both taken on the scan, before any shuffle.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(paths)
    raw = raw.select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    line = F.row_number().over(Window.partitionBy("source").orderBy("block", "at")).cast("long")
    return raw.select("source", line.alias("line"), "value")


def parse_records(lines: DataFrame) -> DataFrame:
    """``lines`` with ``record`` (variant; null for malformed lines and for anything but an object) and ``bad``."""
    record = F.try_parse_json("value")
    is_object = F.schema_of_variant(record).startswith("OBJECT")
    return lines.withColumn("record", F.when(is_object, record)).withColumn("bad", F.col("record").isNull())


def _get(path: str, kind: str):
    return F.try_variant_get("record", path, kind)


def rate_windows(records: DataFrame) -> DataFrame:
    """``records`` with ``meters``: minutes -> (used, reset_at) of the valid primary and secondary windows."""
    def window(which: str):
        at = f"$.payload.rate_limits.{which}"
        m = F.struct(_get(f"{at}.window_minutes", "int").alias("minutes"), F.struct(_get(f"{at}.used_percent", "double").alias("used"), _get(f"{at}.resets_at", "double").alias("reset_at")).alias("meter"))
        ok = (_get("$.payload.rate_limits.limit_id", "string") == "codex") & (m["minutes"] > 0) & m["meter"]["used"].isNotNull() & m["meter"]["reset_at"].isNotNull()
        return F.when(ok, m)

    both = F.filter(F.array(window("primary"), window("secondary")), lambda x: x.isNotNull())
    first = F.filter(both, lambda x, i: (i == 0) | (x["minutes"] != F.element_at(both, 1)["minutes"]))
    return records.withColumn("meters", F.map_from_entries(first))


def _text(*paths: str):
    """The first of the paths that holds a text that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(_get(p, "string")), F.lit("")) for p in paths))


#: Where records of different ages state the same thing, by precedence.
MODEL_PATHS = tuple(f"$.payload.{p}" for p in ("model", "state.model", "thread_settings.model", "collaboration_mode.settings.model", "state.collaboration_mode.model"))
EFFORT_PATHS = tuple(f"$.payload.{p}" for p in ("effort", "collaboration_mode.settings.reasoning_effort", "thread_settings.reasoning_effort", "thread_settings.collaboration_mode.settings.reasoning_effort"))
PLANS = ("free", "go", "plus", "pro", "team", "business", "enterprise", "edu")
COUNTS = (("input_tokens", "input"), ("cached_input_tokens", "cached"), ("output_tokens", "output"), ("reasoning_output_tokens", "reasoning"))


def stated(records: DataFrame) -> DataFrame:
    """``records`` with what each states: model, effort (``effort_conflict``: its places disagree), policy, reviewer mode,
    source_kind, auth and plan; null where it states nothing."""
    efforts = F.array_compact(F.array(*(F.lower(_text(p)) for p in EFFORT_PATHS)))
    source = _get("$.payload.source", "string")
    is_text = F.schema_of_variant(F.variant_get("record", "$.payload.source", "variant")) == "STRING"
    nested = F.when(_get("$.payload.source.subagent", "variant").isNotNull(), "subagent").when(_get("$.payload.source.guardian", "variant").isNotNull(), "guardian")
    kind = F.when(is_text, F.nullif(F.lower(F.trim(source)), F.lit(""))).otherwise(F.coalesce(nested, F.lower(_text("$.payload.source.type", "$.payload.source.kind"))))
    said = F.replace(F.lower(_text("$.payload.auth_mode", "$.payload.authentication_mode")), F.lit("-"), F.lit("_"))
    sign_in = F.when(said == "chatgpt", "chatgpt").when(said.isin("api", "api_key", "apikey"), "api").when(said.isNotNull(), "unknown")
    return records.withColumns({
        "model": _text(*MODEL_PATHS), "effort": F.get(efforts, F.lit(0)), "effort_conflict": F.size(F.array_distinct(efforts)) > 1,
        "approval_policy": _text("$.payload.approval_policy", "$.payload.thread_settings.approval_policy"), "approvals_reviewer": _text("$.payload.approvals_reviewer", "$.payload.thread_settings.approvals_reviewer"),
        "source_kind": kind, "auth": sign_in, "plan": F.when(_get("$.payload.rate_limits.plan_type", "string").isin(*PLANS), "chatgpt"),
    })


def usage_records(records: DataFrame) -> DataFrame:
    """One row a record: source, line, ts, us, kind, what it states, input, cached, output, reasoning, total_* and meters.
    Counts are null where absent or not whole numbers (``invalid`` tells the latter); ``has_last`` and ``has_total`` tell
    whether the objects are there."""
    at = lambda which: (f"$.payload.info.{which}_token_usage", f"$.payload.{which}_token_usage")
    kinds = (("last", ""), ("total", "total_"))
    counts = [F.coalesce(*(_get(f"{p}.{name}", "long") for p in at(which))).alias(prefix + alias) for which, prefix in kinds for name, alias in COUNTS]
    given = lambda p: _get(p, "variant").isNotNull() & ~F.is_variant_null(_get(p, "variant"))
    bad = [given(f"{p}.{name}") & _get(f"{p}.{name}", "long").isNull() for which, _ in kinds for p in at(which) for name, _ in COUNTS]
    invalid = reduce(lambda a, b: a | b, bad).alias("invalid")
    has = [F.coalesce(*(_get(p, "variant") for p in at(which))).isNotNull().alias(f"has_{which}") for which in ("last", "total")]
    kind = F.coalesce(_get("$.payload.type", "string"), _get("$.type", "string"))
    ts = F.try_to_timestamp(_get("$.timestamp", "string"))
    states = ("model", "effort", "effort_conflict", "approval_policy", "approvals_reviewer", "source_kind", "auth", "plan")
    d = rate_windows(stated(records))
    return d.select("source", "line", ts.alias("ts"), F.unix_micros(ts).alias("us"), kind.alias("kind"), *states, *counts, *has, invalid, "meters")


#: Fixed value: the model under which reviewer inference is logged.
REVIEWER_MODEL = "codex-auto-review"


def file_events(records: DataFrame, account: str | Column = "local", minutes: int = 10080, include_unmetered: bool = False) -> DataFrame:
    """From ``parse_records`` to the usage records that count within their own file.

    State is carried down each file, sign-in too; a record whose cumulative counts repeat those before it goes (one
    without last usage neither counts nor moves that baseline); records without any meter go unless
    ``include_unmetered``, in which mode impossible counts go, too. ``minutes``: the meter window of used and reset_at.
    ``account``: a name, or a column over (source, line, us) where many accounts' logs lie side by side."""
    from meterline.operators import clean

    states = ["model", "effort", "approval_policy", "approvals_reviewer", "source_kind"]
    d = clean.carry_auth(clean.carry_forward(usage_records(records.where("not bad")), states, ["source"], ["line"]))
    d = d.where(F.col("kind").isin("token_count", "token_usage_record") & F.col("has_last") & ~F.col("invalid"))
    totals = ["total_input", "total_cached", "total_output"]
    d = d.withColumns({c: F.when(F.col("has_total"), F.coalesce(c, F.lit(0))) for c in totals})
    d = clean.drop_repeated_cumulative(d, totals)
    metered = F.size(F.coalesce("meters", F.create_map().cast("map<int,struct<used:double,reset_at:double>>"))) > 0
    d = d.where(F.col("ts").isNotNull()).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("input", "cached", "output", "reasoning")})
    d = clean.valid_usage(d, include_unmetered)
    if not include_unmetered:
        d = d.where(metered)
    meter = F.try_element_at("meters", F.lit(minutes))
    identity = F.array_join(F.transform(F.array_sort(F.map_entries("meters")), lambda m: F.concat_ws(":", m["key"].cast("string"), F.round(m["value"]["used"], 6).cast("string"), F.round(m["value"]["reset_at"]).cast("string"))), ",")
    own = account if isinstance(account, Column) else F.lit(account)
    return d.withColumns({"account": own, "used": meter["used"], "reset_at": meter["reset_at"], "metered": metered, "meter_id": identity, "total": sum((F.col(c) for c in totals[1:]), F.col(totals[0]))})


def merge_events(d: DataFrame) -> DataFrame:
    """Of equal events of several files (same instant, counts and meters) the best known one."""
    from meterline.operators import clean

    states = ["model", "effort", "approval_policy", "approvals_reviewer", "source_kind"]
    d = d.withColumn("_auth", F.nullif("sign_in", F.lit("unknown")))
    d = clean.global_dedup(d, ["us", "input", "cached", "output", "total_input", "total_cached", "total_output", "meter_id"], [*states, "_auth"]).drop("meter_id", "_auth")
    d = d.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in states})
    return d.withColumn("reviewer", F.col("model") == REVIEWER_MODEL)


def flag_events(d: DataFrame) -> DataFrame:
    """Openings of files that replay an older session, and dense seconds: flagged, not dropped."""
    from meterline.operators import clean

    return clean.flag_dense(clean.flag_replay_prefix(d), 1_000_000, 20)


def usage_events(records: DataFrame, account: str | Column = "local", minutes: int = 10080, include_unmetered: bool = False) -> DataFrame:
    """From ``parse_records`` to the columns on which the operators run, one row for each usage record that counts:
    ``file_events`` of each file, copies across files ``merge_events``d, ``flag_events`` on what is left."""
    return flag_events(merge_events(file_events(records, account, minutes, include_unmetered)))


def content_free(df: DataFrame, keep: list[str], identifiers: list[str], categories: list[str] = ()) -> DataFrame:
    """Only the columns in ``keep``, the ``categories`` (short known labels) and the hashed ``identifiers``. A text column
    (or one that holds texts) in ``keep`` that isn't a category is an error."""
    texts = [c for c in keep if c not in categories and any(t in df.schema[c].dataType.simpleString() for t in ("string", "variant", "binary"))]
    if texts:
        raise ValueError(f"text columns: {texts}")
    more = [c for c in categories if c not in keep]
    return df.select(*keep, *more, *(F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 24).alias(c) for c in identifiers))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as usage telemetry: the same projection as ``TELEMETRY_SQL``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id line", "user_id source", "user_id % 8 account", "ts", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) us",
        "event_type model", "cast(get_json_object(props, '$.k') as int) k", "cast(floor(value * 1000) as bigint) input",
    )
    e = e.selectExpr(
        "line", "source", "account", "ts", "us", "model", "k", "input", "(input * k) div 100 cached", "cast(k * 10 as bigint) output", "cast(k as bigint) reasoning",
        "case k % 4 when 1 then 'low' when 2 then 'medium' when 3 then 'high' end effort", "case when k % 9 = 0 then case source % 3 when 0 then 'subscription' when 1 then 'api' end end auth",
        "k % 5 = 0 reviewer", "us div 259200000000 period", "((us div 259200000000) + 1) * 259200 + k % 40 - 20 reset_at",
    )
    w = Window.partitionBy("account", "period")
    share = F.expr("100 * rn div cnt")
    e = e.withColumn("rn", F.row_number().over(w.orderBy("us", "line"))).withColumn("cnt", F.count("*").over(w))
    return e.withColumn("used", F.greatest(share - F.when(F.col("k") % 17 == 0, 2).otherwise(0), F.lit(0)).cast("double")).drop("rn", "cnt")


TELEMETRY_SQL = """
e0 as (select event_id line, user_id source, user_id % 8 account, ts, epoch_us(ts) us, event_type model,
         cast(json_extract_string(props, '$.k') as int) k, cast(floor(value * 1000) as bigint) input from events),
e1 as (select line, source, account, ts, us, model, k, input, (input * k) // 100 cached, cast(k * 10 as bigint) output, cast(k as bigint) reasoning,
         case k % 4 when 1 then 'low' when 2 then 'medium' when 3 then 'high' end effort,
         case when k % 9 = 0 then case source % 3 when 0 then 'subscription' when 1 then 'api' end end auth,
         k % 5 = 0 reviewer, us // 259200000000 as period, ((us // 259200000000) + 1) * 259200 + k % 40 - 20 reset_at,
         row_number() over (partition by user_id % 8, us // 259200000000 order by us, line) rn,
         count(*) over (partition by user_id % 8, us // 259200000000) cnt
       from (select *, source user_id from e0)),
tel as (select * exclude (rn, cnt), cast(greatest((100 * rn) // cnt - case when k % 17 = 0 then 2 else 0 end, 0) as double) used from e1)"""
