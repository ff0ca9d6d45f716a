"""All queries by name, and DuckDB SQL for those that it can express.

The queries run the operators over one telemetry view of the ``events`` table. Their SQL is phrased otherwise than the
operators (joins and correlated subqueries for windows, recursion for folds) wherever SQL allows.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.functions.temporal import interval_subtract, interval_union, weighted_quantile
from meterline.operators import clean, graph, pricing, quota, reviewer, usage, workflow
from meterline.sources.telemetry import TELEMETRY_SQL, telemetry

RATES = [("view", 1.25, 0.125, 10.0), ("click", 2.0, 0.2, 8.0), ("purchase", 3.0, 0.3, 15.0)]
TURN_US = 1705276800000000  # 2024-01-15: what the alias "error" means changes
ALIASES = [("error", -(1 << 62), TURN_US, "click"), ("error", TURN_US, 1 << 62, "view")]
LONG = 100_000
WINDOW_US = 259_200_000_000
HOUR = 3_600_000_000

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = pricing.rate_dimension(spark, RATES)
    aliases = spark.createDataFrame(ALIASES, "alias string, valid_from_us long, valid_to_us long, target string")
    d = clean.valid_usage(telemetry(spark, sf_dir))
    return pricing.price_events(pricing.resolve_rate_model(d, aliases, rates), rates, LONG, ["purchase"])


def signed_in(df: DataFrame) -> DataFrame:
    return df.withColumn("sign_in", F.coalesce("auth", F.lit("unknown"))).withColumn("activity", F.when(F.col("reviewer"), "reviewer").otherwise("agent"))


PRICED = (
    "with "
    + TELEMETRY_SQL
    + """,
rates as (select * from (values ('view', 1.25::decimal(8,4), 0.125::decimal(8,4), 10::decimal(8,4)), ('click', 2, 0.2, 8), ('purchase', 3, 0.3, 15)) r(m, r_in, r_cached, r_out)),
p0 as (select *, input - cached uncached, case when model = 'error' then case when us < 1705276800000000 then 'click' else 'view' end when model <> 'signup' then model end rate_model from tel),
p1 as (select p0.*, cast(uncached as decimal(12,0)) * r_in + cast(cached as decimal(12,0)) * r_cached inp, cast(output as decimal(12,0)) * r_out outp,
         input > 100000 and coalesce(rate_model <> 'purchase', true) is_long from p0 left join rates on rate_model = m),
priced as (select * exclude (inp, outp, is_long), is_long and rate_model is not null long_context,
         cast((inp + outp) * 0.000001::decimal(7,6) as decimal(38,12)) base_usd,
         cast((case when is_long then inp * 2 + outp * 1.5 else inp + outp end) * 0.000001::decimal(7,6) as decimal(38,12)) usd,
         cast(ts as date) as day, coalesce(auth, 'unknown') sign_in, case when reviewer then 'reviewer' else 'agent' end activity from p1)
"""
)
TOTALS = """count(*) requests, sum(input)::bigint input, sum(cached)::bigint cached, sum(uncached)::bigint uncached, sum(output)::bigint output, sum(reasoning)::bigint reasoning,
  cast(sum(usd) as double) usd, count(usd) priced_requests, coalesce(sum(case when usd is not null then input + output end), 0)::bigint priced_tokens"""


@query(f"{PRICED} select model, day, {TOTALS} from priced group by model, day")
def usage_by_model_day(spark, sf_dir):
    return usage.local_day(priced(spark, sf_dir)).groupBy("model", "day").agg(*pricing.totals())


@query(f"""{PRICED}, g as (select model, rate_model, {TOTALS}, count(*) filter (long_context) long_contexts, cast(sum(usd) - sum(base_usd) as double) uplift, sum(usd) u from priced group by model, rate_model)
select * exclude (u), priced_tokens / (select sum(priced_tokens) from g) token_share, cast(u as double) / cast((select sum(u) from g) as double) usd_share from g""")
def pricing_breakdown(spark, sf_dir):
    return pricing.pricing_breakdown(priced(spark, sf_dir))


@query(f"""{PRICED} select account, cast(sum(base_usd) as double) base_usd, cast(sum(usd) as double) usd, count(*) filter (long_context) long_contexts,
  case count(distinct rate_model) when 0 then null when 1 then max(rate_model) else 'mixed (' || array_to_string(list_sort(list(distinct rate_model) filter (rate_model is not null)), ', ') || ')' end rates
  from priced group by account""")
def group_cost(spark, sf_dir):
    return pricing.group_cost(priced(spark, sf_dir), ["account"])


@query(f"{PRICED} select model, sum(input + output)::bigint tokens from priced where rate_model is null group by model")
def unpriced_models(spark, sf_dir):
    return pricing.unpriced_models(priced(spark, sf_dir), pricing.rate_dimension(spark, RATES))


@query("select * from (values ('view', 1.25, 0.125, 9.5), ('click', 2.0, 0.2, 8.0), ('purchase', 3.0, 0.3, 15.0)) r(model, r_in, r_cached, r_out) where exists (select 1 from events where event_type = model)")
def rate_override(spark, sf_dir):
    rates = pricing.rate_dimension(spark, RATES, [("view", 1.25, 0.125, 9.5)])
    used = telemetry(spark, sf_dir).select("model").distinct()
    return rates.join(used, "model", "left_semi").select("model", *(F.col(c).cast("double").alias(c) for c in ("r_in", "r_cached", "r_out")))


@query(f"""{PRICED}, g as (select account, model, {TOTALS}, count(*) filter (long_context) long_contexts, cast(sum(usd) - sum(base_usd) as double) uplift, count(*) filter (k % 9 = 0) auth_explicit, count(*) filter (k % 9 = 1) auth_plan,
  count(*) filter (k % 9 > 1) auth_unknown from priced group by account, model)
select *, case when priced_requests = requests then 'complete' when priced_requests > 0 then 'partial' else 'unavailable' end pricing_status,
  case when priced_requests = requests then usd end equivalent, case when input > 0 then cached / input end cached_fraction, case when input + output > 0 then cached / (input + output) end cached_of_all,
  case when input + output > 0 then priced_tokens / (input + output) end price_coverage from g""")
def usage_aggregate(spark, sf_dir):
    evidence = F.when(F.col("k") % 9 == 0, "explicit").when(F.col("k") % 9 == 1, "plan")
    return usage.usage_aggregate(priced(spark, sf_dir).withColumn("auth_source", evidence), ["account", "model"])


@query(f"""{PRICED}
select 'day' as level, day, null model, null sign_in, null activity, {TOTALS} from priced group by day
union all select 'model', null, model, null, null, {TOTALS} from priced group by model
union all select 'sign_in', null, null, s, null, count(us), coalesce(sum(input), 0)::bigint, coalesce(sum(cached), 0)::bigint, coalesce(sum(uncached), 0)::bigint, coalesce(sum(output), 0)::bigint, coalesce(sum(reasoning), 0)::bigint, cast(sum(usd) as double), count(usd),
  coalesce(sum(case when usd is not null then input + output end), 0)::bigint from (values ('subscription'), ('api'), ('unknown')) v(s) left join priced on sign_in = s group by s
union all select 'activity', null, null, null, activity, {TOTALS} from priced group by activity
union all select 'mix', null, model, sign_in, activity, {TOTALS} from priced group by model, sign_in, activity
union all select 'total', null, null, null, null, {TOTALS} from priced""")
def usage_cube(spark, sf_dir):
    return usage.usage_cube(signed_in(usage.local_day(priced(spark, sf_dir))))


@query(f"""{PRICED} select account, cast((ts at time zone 'UTC') at time zone 'America/New_York' as date) as day, count(*) requests, sum(input)::bigint input
  from priced where ts >= timestamp '2024-01-01 05:00:00' and ts < timestamp '2024-02-01 05:00:00' group by 1, 2""")
def month_in_zone(spark, sf_dir):
    d = usage.local_day(usage.filter_period(priced(spark, sf_dir), "2024-01", tz="America/New_York"), "America/New_York")
    return d.groupBy("account", "day").agg(F.count("*").alias("requests"), F.sum("input").alias("input"))


@query(f"""{PRICED}, d as (select *, k % 13 = 0 replay, count(*) over (partition by source, us // {HOUR}) > 1 and not bool_and(k % 13 = 0) over (partition by source, us // {HOUR}) dense, k % 3 <> 0 metered from priced),
o as (select min(us) filter (not replay) first_us, max(us) filter (not replay) last_us, count(distinct day) filter (not replay) as days, count(*) filter (not replay) as events, count(*) filter (not replay and usd is null) as unpriced,
  count(*) filter (not replay and dense) as dense, count(*) filter (not replay and not metered) without_meter, count(*) filter (replay) excluded_replay from d)
select *, concat_ws(',', case when events = 0 then 'no_events' end, case when unpriced > 0 then 'unpriced' end, case when dense > 0 then 'dense' end) as warnings from o""")
def usage_coverage(spark, sf_dir):
    d = usage.local_day(priced(spark, sf_dir)).withColumns({"replay": F.col("k") % 13 == 0, "metered": F.col("k") % 3 != 0})
    return usage.usage_coverage(clean.flag_dense(d, HOUR, 1))


# cleaning


@query(f"""with {TELEMETRY_SQL} select line, source, model,
  (select arg_max(b.effort, b.line) from tel b where b.source = a.source and b.line <= a.line and b.effort is not null) effort from tel a""")
def carry_state(spark, sf_dir):
    return clean.carry_state(telemetry(spark, sf_dir)).select("line", "source", "model", "effort")


@query(f"""with {TELEMETRY_SQL}, x as (select *, case when k % 9 = 1 then 'subscription' when k % 9 = 2 then 'api' end auth2, case when k % 4 = 0 then 'plan' end plan from tel)
select line, coalesce((select arg_max(b.auth2, b.line) from x b where b.source = a.source and b.line <= a.line and b.auth2 is not null),
   (select arg_max(b.plan, b.line) from x b where b.source = a.source and b.line <= a.line and b.plan is not null), 'unknown') sign_in,
  (select count(distinct b.auth2) > 1 from x b where b.source = a.source and b.line <= a.line) as conflict from x a""")
def carry_auth(spark, sf_dir):
    d = telemetry(spark, sf_dir).withColumn("auth", F.when(F.col("k") % 9 == 1, "subscription").when(F.col("k") % 9 == 2, "api"))
    return clean.carry_auth(d.withColumn("plan", F.when(F.col("k") % 4 == 0, "plan"))).select("line", "sign_in", "conflict")


def cumulative(df: DataFrame) -> DataFrame:
    """Cumulative counts in which some records repeat their predecessor's, and some have none."""
    w = Window.partitionBy("source").orderBy("line")
    counts = {f"total_{c}": F.when(F.col("k") % 11 != 0, F.sum(F.when(F.col("k") % 7 != 0, F.col(c)).otherwise(0)).over(w)) for c in ("input", "output")}
    return df.withColumns(counts)


CUMULATIVE = f"""with {TELEMETRY_SQL}, cum as (select *, case when k % 11 <> 0 then sum(case when k % 7 <> 0 then input else 0 end) over (partition by source order by line) end::bigint total_input,
  case when k % 11 <> 0 then sum(case when k % 7 <> 0 then output else 0 end) over (partition by source order by line) end::bigint total_output from tel)"""


@query(f"""{CUMULATIVE} select line, source, total_input, total_output from cum a where total_input is null or not exists (
  select 1 from cum b where b.source = a.source and b.total_input = a.total_input and b.total_output = a.total_output and b.line =
    (select max(c.line) from cum c where c.source = a.source and c.line < a.line and c.total_input is not null))""")
def drop_repeated_cumulative(spark, sf_dir):
    d = clean.drop_repeated_cumulative(cumulative(telemetry(spark, sf_dir)), ["total_input", "total_output"])
    return d.select("line", "source", "total_input", "total_output")


@query(f"""with {TELEMETRY_SQL}, x as (select *, input // 2000 size, (case when effort is null then 0 else 1 end + case when auth is null then 0 else 1 end) q from tel)
select line, model, size from x a where not exists (select 1 from x b where b.model = a.model and b.size = a.size and b.period = a.period
  and (b.q > a.q or (b.q = a.q and (b.us < a.us or (b.us = a.us and b.line < a.line)))))""")
def global_dedup(spark, sf_dir):
    d = telemetry(spark, sf_dir).withColumn("size", F.expr("input div 2000"))
    return clean.global_dedup(d, ["model", "size", "period"], ["effort", "auth"]).select("line", "model", "size")


REPLAY = f"""t as (select *, sum(input * 50) over (partition by source order by line)::bigint total from tel),
o as (select a.*, total >= lag(total) over (partition by source order by line) up from t a where us <= (select min(us) from t b where b.source = a.source) + {120 * HOUR}),
s as (select source from o group by source having count(*) >= 8 and count(total) >= greatest(3, floor(count(*) * 0.9)) and avg(up::int) >= 0.98
  and arg_min(total, line) <= 2000000 and arg_max(total, line) - arg_min(total, line) >= 5000000
  and (max(reset_at) - min(reset_at) >= 60 or max(used) - min(used) >= 2 or arg_max(total, line) - arg_min(total, line) >= 25000000)),
f as (select t.line, t.source, t.us, t.line in (select line from o) and t.source in (select source from s) replay from t)"""


def with_replay(df: DataFrame) -> DataFrame:
    total = F.sum(F.col("input") * 50).over(Window.partitionBy("source").orderBy("line"))
    return clean.flag_replay_prefix(df.withColumn("total", total), scan_us=120 * HOUR, least=8)


@query(f"""with {TELEMETRY_SQL}, {REPLAY}
select line, replay, not (bool_and(replay) over (partition by source, us // {6 * HOUR})) and count(*) over (partition by source, us // {6 * HOUR}) > 1 as dense from f""")
def replay_and_dense(spark, sf_dir):
    return clean.flag_dense(with_replay(telemetry(spark, sf_dir)), 6 * HOUR, 1).select("line", "replay", "dense")


@query(f"""with {TELEMETRY_SQL}, x as (select *, case k % 3 when 0 then 'auto_review' when 1 then 'user' end mode, case when source > 0 then 'subagent' else 'cli' end kind, k % 2 = 0 as conflict from tel)
select case when reviewer then 'auto-review inference' when mode = 'auto_review' then 'auto-review parent' when mode = 'user' then 'user-review parent' when kind = 'subagent' then 'other subagent' else 'other' end activity,
  case when reviewer then 'auto_review' else 'agent' end channel, case when reviewer and auth is null and not conflict then 'assumed' else coalesce(auth, 'unknown') end sign_in, count(*) n from x group by 1, 2, 3""")
def activity_and_auth(spark, sf_dir):
    d = signed_in(telemetry(spark, sf_dir)).withColumns({
        "approvals_reviewer": F.when(F.col("k") % 3 == 0, "auto_review").when(F.col("k") % 3 == 1, "user"), "source_kind": F.when(F.col("source") > 0, "subagent").otherwise("cli"), "conflict": F.col("k") % 2 == 0,
    })
    return clean.activity_class(clean.declare_auth(d, "assumed")).groupBy("activity", "channel", "sign_in").agg(F.count("*").alias("n"))


@query(f"""with {TELEMETRY_SQL}, x as (select us, source, model, null::int window_minutes from tel union all select us, source, model, 300 from tel where k % 3 = 0 union all select us, source, model, 10080 from tel where k % 4 > 0)
select window_minutes, min(us) first_us, max(us) last_us, count(*) as events, count(distinct source) sources, count(distinct model) models from x group by window_minutes""")
def coverage(spark, sf_dir):
    meter = F.struct("used", F.col("reset_at").cast("double").alias("reset_at"))
    windows = F.array_compact(F.array(F.when(F.col("k") % 3 == 0, F.struct(F.lit(300).alias("key"), meter.alias("value"))), F.when(F.col("k") % 4 > 0, F.struct(F.lit(10080).alias("key"), meter.alias("value")))))
    return clean.coverage(telemetry(spark, sf_dir).withColumn("meters", F.map_from_entries(windows)))


@query(f"""with {TELEMETRY_SQL}, x as (select line, case when k % 10 = 0 then null when k % 10 = 1 then -input else input end input, case when k % 7 = 0 then input + 1 else cached end cached, output, reasoning from tel)
select line, input, cached, input - cached uncached from x where input >= 0 and cached <= input""")
def valid_usage(spark, sf_dir):
    k, d = F.col("k"), telemetry(spark, sf_dir)
    d = d.withColumn("cached", F.when(k % 7 == 0, F.col("input") + 1).otherwise(F.col("cached"))).withColumn("input", F.when(k % 10 == 1, -F.col("input")).when(k % 10 != 0, F.col("input")))
    return clean.valid_usage(d).select("line", "input", "cached", "uncached")


@query(f"with {TELEMETRY_SQL} select account, count(*) readings, min(used) least, max(used) most from tel where k % 3 <> 0 group by account")
def project_window(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    minutes = F.when(F.col("k") % 3 != 0, 4320).otherwise(300)
    d = d.withColumn("meters", F.create_map(minutes, F.struct("used", F.col("reset_at").cast("double").alias("reset_at"))))
    return quota.project_window(d, 4320).groupBy("account").agg(F.count("*").alias("readings"), F.min("used").alias("least"), F.max("used").alias("most"))


# quota


def metered(spark, sf_dir):
    return quota.reset_key(priced(spark, sf_dir))


METERED = PRICED + ", m as (select *, cast(round_even(reset_at / 60, 0) * 60 as bigint) reset_key from priced)"
EPISODES = (
    METERED
    + f""", h as (select *, (select max(b.used) from m b where b.account = a.account and b.reset_key = a.reset_key and (b.us < a.us or (b.us = a.us and b.line < a.line))) high,
   lag(used) over (partition by account, reset_key order by us, line) prev from m a),
ep as (select account, reset_key, median(reset_at)::double reset_at, min(us) first_us, max(us) last_us, arg_min(used, us) first_used, arg_max(used, us) last_used, max(used) high_used, count(*) readings,
   count(*) filter (high is null or used > high) new_highs, count(*) filter (used < high) backsteps, coalesce(max(case when used < high then high - used end), 0.0) max_backstep,
   count(*) filter (used < prev) down_steps, cast(median(reset_at) * 1000000 as bigint) - {WINDOW_US} activation_us from h group by account, reset_key)"""
)


@query(f"{EPISODES} select * from ep")
def raw_episodes(spark, sf_dir):
    return quota.raw_episodes(metered(spark, sf_dir), WINDOW_US)


def bucket_ctes(p: str, rows: str) -> str:
    """CTEs {p}h to {p}bk: the buckets of ``rows``, which have a reset_key."""
    return f"""{p}h as (select *, max(used) over (partition by account, reset_key order by us, line rows between unbounded preceding and 1 preceding) high from {rows}),
{p}n as (select * from {p}h where high is null or used > high),
{p}hb as (select a.*, (select count(*) from {p}n b where b.account = a.account and b.reset_key = a.reset_key and (b.us < a.us or (b.us = a.us and b.line < a.line))) bucket from {p}h a),
{p}kept as (select * from {p}hb a where exists (select 1 from {p}n b where b.account = a.account and b.reset_key = a.reset_key and (b.us > a.us or (b.us = a.us and b.line >= a.line))) and (bucket > 0 or used = 0)),
{p}bk as (select account, reset_key, bucket, max(us) end_us, max(used) end_used, max(coalesce(high, 0.0)) start_used, count(*) events, sum(input + output)::bigint tokens,
  coalesce(sum(case when usd is not null then input + output end), 0)::bigint priced_tokens, sum(usd) usd, coalesce(sum(case when not reviewer then input + output end), 0)::bigint core_tokens,
  sum(case when not reviewer then usd end) core_usd, sum(uncached)::bigint uncached, sum(cached)::bigint cached, sum(output)::bigint output,
  coalesce(sum(case when not reviewer and usd is not null then input + output end), 0)::bigint core_priced_tokens, bool_or(reviewer and (sign_in = 'api' or us >= {TURN_US})) fit_excluded, min(us) first_us,
  max(used) - max(coalesce(high, 0.0)) points from {p}kept group by account, reset_key, bucket)"""


BUCKETS = METERED + ", " + bucket_ctes("", "m")
USABLE = "points > 0 and usd is not null and priced_tokens >= 0.95 * tokens and not fit_excluded"


def bucket_rows(df: DataFrame) -> DataFrame:
    """Events with their buckets; a reviewer's row before the turn is historical unless it signed in by API."""
    return quota.high_water_rows(reviewer.policy_status(signed_in(df), TURN_US, TURN_US + 48 * HOUR))


def buckets(spark, sf_dir):
    return quota.bucket_aggregate(bucket_rows(metered(spark, sf_dir)))


@query(f"{BUCKETS} select * replace (cast(usd as double) as usd, cast(core_usd as double) as core_usd) from bk")
def high_water_buckets(spark, sf_dir):
    return buckets(spark, sf_dir).withColumn("usd", F.col("usd").cast("double")).withColumn("core_usd", F.col("core_usd").cast("double"))


@query(f"""{BUCKETS}, mix as (select account, reset_key, bucket, model, sum(input + output) t from kept group by all)
select account, reset_key, bucket, arg_min(model, (-t, model)) model, max(t) / sum(t) model_share from mix group by account, reset_key, bucket""")
def dominant_model(spark, sf_dir):
    mix = quota.bucket_mix(bucket_rows(metered(spark, sf_dir)), ["model", "effort"])
    return quota.dominant(mix, [*quota.EPISODE, "bucket"], "model")


LEDGER = (
    EPISODES
    + """, seq as (select *, row_number() over (partition by account order by activation_us, reset_at, first_us) i from ep),
pr as (select a.*, b.reset_key prev_key, b.last_used prev_last from seq a left join seq b on b.account = a.account and b.i = a.i - 1),
bf as (select pr.*, case when prev_key is not null then coalesce((select arg_max(used, (us, line)) from m where m.account = pr.account and m.reset_key = pr.prev_key and m.us <= pr.first_us), prev_last) end before_used from pr)"""
)
# the fold as recursion
FOLD = LEDGER.replace("with ", "with recursive ", 1) + """, w as (
select account, i, reset_key, 'initial' kind, true creates, null::bigint due_us, reset_key accounting_key, activation_us, null::bigint lag_us, before_used, first_used after_used, before_used - first_used as drop, cast(reset_at * 1000000 as bigint) due from bf where i = 1
union all
select account, i, reset_key, kind, kind <> 'churn', prev_due, case when kind <> 'churn' then reset_key else key0 end, activation_us, activation_us - prev_due, before_used, first_used, before_used - first_used, case when kind <> 'churn' then cast(reset_at * 1000000 as bigint) else prev_due end
from (select bf.*, w.due prev_due, w.accounting_key key0, case when abs(bf.activation_us - w.due) <= 1000000 then 'scheduled' when bf.before_used - bf.first_used >= 2 then case when bf.activation_us - w.due < -1000000 then 'early' else 'after-due' end
   when bf.before_used <= 1 and bf.first_used <= 1 then 'churn' else 'ambiguous' end kind from w join bf on bf.account = w.account and bf.i = w.i + 1) x)"""


@query(f"{FOLD} select account, reset_key, kind, creates, due_us, accounting_key, activation_us, lag_us, before_used, after_used, drop from w")
def reset_ledger(spark, sf_dir):
    d = metered(spark, sf_dir)
    e = quota.raw_episodes(d, WINDOW_US)
    return quota.reset_ledger(e, quota.boundary_before(d, e), 1_000_000)


def point_sql(rows: str, keys: str, having: str = "") -> str:
    """Point metrics of ``rows`` by ``keys``."""
    on = " and ".join(f"x.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    least = lambda q, n: f"(select min(cast(x.usd as double) / x.points) from {rows} x where {on} and {USABLE} and (select sum(y.points) from {rows} y where {on.replace('x.', 'y.')} and y.points > 0 and y.usd is not null and y.priced_tokens >= 0.95 * y.tokens and not y.fit_excluded and cast(y.usd as double) / y.points <= cast(x.usd as double) / x.points) + 1e-9 >= {q} * g.priced_points) {n}"
    return f"""select *, {least(0.1, "p10")}, {least(0.5, "p50")}, {least(0.9, "p90")} from (
  select {keys}, count(*) buckets, sum(points) points, sum(tokens)::bigint tokens, sum(uncached)::bigint uncached, sum(cached)::bigint cached, sum(output)::bigint output,
    coalesce(sum(points) filter ({USABLE}), 0.0) priced_points, cast(sum(usd) filter ({USABLE}) as double) / sum(points) filter ({USABLE}) usd_per_point from {rows} group by {keys} {having}) g"""


MONTHS = BUCKETS + ", d as (select *, strftime(make_timestamp(end_us), '%Y-%m') as month from bk)"


@query(f"{MONTHS} {point_sql('d', 'account, month')}")
def monthly_metrics(spark, sf_dir):
    return quota.monthly_metrics(buckets(spark, sf_dir))


@query(f"""{BUCKETS}, c as (select *, coalesce((select sum(b.points) from bk b where b.account = a.account and b.reset_key = a.reset_key and b.bucket < a.bucket and b.points > 0), 0) bef from bk a where points > 0),
f as (select *, greatest(0.0, least(1.0, (10.0 - bef) / points)) part from c)
select account, reset_key, sum(points * part) points, round(sum(tokens * part), 4) tokens, max(part > 0 and part < 1) interpolated, sum(points * part) >= 10 - 1e-9 complete from f group by account, reset_key""")
def quota_slice(spark, sf_dir):
    return quota.quota_slice(buckets(spark, sf_dir), 10.0)


# workflow


def sessions(df: DataFrame) -> DataFrame:
    return workflow.session_summary(df)


@query(f"""with {TELEMETRY_SQL}, mc as (select source, model, count(*) c from tel group by 1, 2), ec as (select source, coalesce(effort, 'unknown') effort, count(*) c from tel group by 1, 2),
rc as (select source, count(*) filter (input // 30000 = p) duplicates, count(*) filter (k % 23 = 0) parse_errors from (select *, lag(input // 30000) over (partition by source order by line) p from tel) group by source)
select source, min(us) first_us, max(us) last_us, count(*) requests, sum(input)::bigint input, sum(least(cached, input))::bigint cached, sum(output)::bigint output, sum(reasoning)::bigint reasoning,
 (select arg_min(model, (-c, model)) from mc where mc.source = t.source) model, (select string_agg(effort || ' ' || c, ', ' order by c desc, effort) from ec where ec.source = t.source) efforts,
 (select duplicates from rc where rc.source = t.source) duplicates, (select parse_errors from rc where rc.source = t.source) parse_errors from tel t group by source""")
def session_summary(spark, sf_dir):
    """With counts of what could not be used, for which totals in steps and every 23rd value stand in."""
    d = telemetry(spark, sf_dir).withColumns({c: F.expr("input div 30000") for c in ("total", "total_too")})
    kept = clean.drop_repeated_cumulative(d, ["total", "total_too"]).groupBy("source").agg(F.count("*").alias("kept"))
    counts = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("k") % 23 == 0).alias("parse_errors")).join(kept, "source")
    return workflow.session_summary(d, counts.select("source", (F.col("n") - F.col("kept")).alias("duplicates"), "parse_errors"))


BURSTS = f"""with {TELEMETRY_SQL}, g as (select *, case when us - lag(us) over (partition by source order by us, line) > {12 * HOUR} then 1 else 0 end n from tel),
b as (select *, sum(n) over (partition by source order by us, line) burst from g),
br as (select source, burst::bigint burst, min(us) as start, max(us) as "end", count(*) requests, arg_min(input, us) first_input, arg_max(input, us) last_input, max(input) peak_input from b group by source, burst)"""


@query(f"{BURSTS} select * from br")
def request_bursts(spark, sf_dir):
    return workflow.bursts(telemetry(spark, sf_dir), 12 * HOUR)


def burst_spans(spark, sf_dir):
    b = workflow.bursts(telemetry(spark, sf_dir), 12 * HOUR)
    return b.select((F.col("source") % 8).alias("account"), "source", "start", (F.col("end") + 1).alias("end"))


SPANS = BURSTS + ', sp as (select source % 8 account, source, start as s, "end" + 1 e from br)'
SWEEP = SPANS + """, pt as (select account, s t from sp union select account, e from sp), sg as (select account, t, lead(t) over (partition by account order by t) u from pt),
sw as (select sg.account, t, u, (select count(*) from sp where sp.account = sg.account and sp.s <= t and sp.e > t) alive from sg where u is not null)"""


@query(f"""{SWEEP} select account, sum((u - t) * alive)::bigint agent_us, coalesce(sum(u - t) filter (alive > 0), 0)::bigint active_us, coalesce(sum(u - t) filter (alive > 1), 0)::bigint overlap_us,
  coalesce(sum((u - t) * (alive - 1)) filter (alive > 1), 0)::bigint extra_us, max(alive) peak from sw group by account""")
def concurrency(spark, sf_dir):
    return workflow.concurrency(burst_spans(spark, sf_dir), ["account"])


@query(f"""{SPANS} select a.account, a.source left_member, b.source right_member, sum(least(a.e, b.e) - greatest(a.s, b.s))::bigint overlap_us
  from sp a join sp b on a.account = b.account and a.source < b.source and a.s < b.e and b.s < a.e group by 1, 2, 3""")
def pairwise_overlap(spark, sf_dir):
    return workflow.pairwise_overlap(burst_spans(spark, sf_dir), ["account"], "source")


@query(f"""{SWEEP}, al as (select account, t, u, alive > 0 x, row_number() over (partition by account order by t) - row_number() over (partition by account, alive > 0 order by t) g from sw)
select account, min(t) as start, max(u) as "end" from al where x group by account, g""")
def active_union(spark, sf_dir):
    return interval_union(burst_spans(spark, sf_dir).select("account", "start", "end"), ["account"])


@query(f"""{SPANS}, day_ as (select account, min(s) s, max(e) e from sp group by account), pt as (select account, s t from sp union select account, e from sp),
sg as (select account, t, lead(t) over (partition by account order by t) u from pt)
select account, count(*) gaps, sum(u - t)::bigint us from sg where u is not null and not exists (select 1 from sp where sp.account = sg.account and sp.s <= t and sp.e > t) group by account""")
def idle_time(spark, sf_dir):
    b = burst_spans(spark, sf_dir).select("account", "start", "end")
    whole = b.groupBy("account").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return interval_subtract(whole, b, ["account"]).groupBy("account").agg(F.count("*").alias("gaps"), F.sum(F.col("end") - F.col("start")).alias("us"))


@query(f"""{SPANS} , x as (select t.account, t.input + t.output tok, least(3, (select count(*) from sp where sp.account = t.account and sp.s <= t.us and sp.e > t.us)) alive from tel t)
select account, alive, count(*) requests, sum(tok)::bigint tokens from x group by account, alive""")
def child_counts(spark, sf_dir):
    return workflow.child_counts(telemetry(spark, sf_dir), burst_spans(spark, sf_dir), ["account"])


@query(f"""with {TELEMETRY_SQL}, d as (select *, lag(input) over (partition by source order by us, line) p from tel)
select model, quantile_cont(input, 0.5) p50, quantile_cont(input, 0.9) p90, max(input) peak, count(*) filter (p >= 20000 and input < 0.55 * p) drops, count(*) filter (input >= 20000) large_requests, coalesce(sum(input + output) filter (input >= 20000), 0)::bigint large_tokens,
  count(*) filter (input < 20000) small_requests, coalesce(sum(input + output) filter (input < 20000), 0)::bigint small_tokens from d group by model""")
def context_stats(spark, sf_dir):
    return workflow.context_stats(telemetry(spark, sf_dir), ["model"], 20_000)


CADENCE = f"""with {TELEMETRY_SQL}, c as (select *, source % 8 family, 'r' || k % 3 as role, coalesce(effort, 'unknown') ef, us - lag(us) over w gap, lag(model) over w pm, lag(effort) over w pe, input + output t, min(us) over (partition by source % 8) s, max(us) over (partition by source % 8) e from tel window w as (partition by source order by us, line)),
d as (select *, coalesce(gap > 0 and gap <= {24 * HOUR}, false) mv, (us - s) // {96 * HOUR} win from c)"""


def _cadence(level: str, on: str = "mv", **keys: str) -> str:
    own = ", ".join(f"{keys.get(k, 'null')} {k}" for k in ("role", "agent", "model", "effort", '"window"'.strip('"')))
    by = "".join(f", {v}" for v in keys.values())
    took = f"least({96 * HOUR}, max(e - s) - win * {96 * HOUR})" if level == "window" else "max(e - s)"
    return f"""select family, '{level}' as level, {own.replace(" window", ' "window"')}, count(distinct source) contributors, count(*) turns, count(*) filter ({on}) transitions, coalesce(sum(gap) filter ({on}), 0)::bigint gap_us, sum(t)::bigint tokens, sum(output)::bigint output,
  coalesce(sum(t) filter ({on}), 0)::bigint observed_tokens, ({took})::bigint elapsed_us from d group by family{by}"""


LEVELS = [_cadence("all"), _cadence("role", role="role"), _cadence("agent", agent="source"), _cadence("model", "mv and coalesce(pm = model, false)", model="model"),
          _cadence("model_effort", "mv and coalesce(pm = model, false) and pe is not distinct from effort", model="model", effort="ef"), _cadence("window", window="win")]


@query(f"""{CADENCE}, g as ({" union all ".join(LEVELS)}) select *, case when gap_us > 0 then transitions / (gap_us / 1e6) end turns_per_s, case when gap_us > 0 then observed_tokens / (gap_us / 1e6) end tokens_per_s,
  case when elapsed_us > 0 then turns / (elapsed_us / 1e6) end turns_per_elapsed_s, case when elapsed_us > 0 then output / (elapsed_us / 1e6) end output_per_elapsed_s, tokens / turns tokens_per_turn from g""")
def turn_cadence(spark, sf_dir):
    d = telemetry(spark, sf_dir).withColumns({"family": F.col("source") % 8, "role": F.concat(F.lit("r"), F.col("k") % 3)})
    return workflow.turn_cadence(d, 24 * HOUR, 96 * HOUR)


@query(f"with {TELEMETRY_SQL} select line, source, model, input + output tokens from tel order by input + output desc, line limit 20")
def top_requests(spark, sf_dir):
    return workflow.top_requests(telemetry(spark, sf_dir), 20).select("line", "source", "model", "tokens")


@query(f"with {TELEMETRY_SQL} select model, count(*) requests, sum(input)::bigint input, sum(output)::bigint output, (row_number() over (order by sum(input) desc, model))::int place from tel where input >= 20000 and output <= 300 group by model")
def large_context(spark, sf_dir):
    return workflow.large_context(telemetry(spark, sf_dir), ["model"], 20_000, 300)


@query(f"""with {TELEMETRY_SQL}, snd as (select source, us from tel where k % 10 = 3), x as (select source, input, output, (select count(*) from snd s where s.source = t.source and s.us <= t.us) phase from tel t where k % 10 <> 3)
select source, phase, count(*) requests, sum(input)::bigint input, sum(output)::bigint output from x group by source, phase""")
def phases(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    return workflow.phases(d.where("k % 10 <> 3"), d.where("k % 10 = 3"))


@query(f"""with {TELEMETRY_SQL}, s as (select source, min(us) first_us, max(us) last_us, coalesce(min(us) filter (k % 50 = 3), min(us)) a from tel group by source)
select source, case when last_us < {TURN_US} then 'pre' when a >= {TURN_US + 200 * HOUR} then 'post' when a < {TURN_US} and last_us >= {TURN_US + 200 * HOUR} then 'spanning'
  when a < {TURN_US} then 'carry_in' when last_us >= {TURN_US + 200 * HOUR} then 'carry_out' else 'in' end window_class,
  case when source < 8 then 'ROOT' else 'A' || lpad((row_number() over (partition by source % 8, source < 8 order by first_us, source))::varchar, 2, '0') end as label from s""")
def windows_and_labels(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    active = d.where("k % 50 = 3").groupBy("source").agg(F.min("us").alias("active_us"))
    s = workflow.classify_window(sessions(d).join(active, "source", "left"), TURN_US, TURN_US + 200 * HOUR).withColumn("family", F.col("source") % 8)
    return workflow.agent_labels(s, "family", F.col("source") < 8).select("source", "window_class", "label")


@query(f"""with {TELEMETRY_SQL}, d as (select account, us, lag(us) over (partition by account order by us) p from (select distinct account, us from tel)),
g as (select account, p + 1 a, us b from d where us - p >= {5 * HOUR}), c as (select distinct account, period * {WINDOW_US} s, period * {WINDOW_US} + {WINDOW_US // 2} e from tel)
select account, a as start, b as "end", case when b % 7 = 0 then 'confirmed' when exists (select 1 from c where c.account = g.account and s <= a and e >= b) then 'covered' else 'unclassified' end status from g""")
def quiet_gaps(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    decisions = workflow.quiet_gaps(d, ["account"], 5 * HOUR).where("end % 7 = 0").withColumn("status", F.lit("confirmed"))
    start = F.col("period") * WINDOW_US
    covered = d.select("account", start.alias("start"), (start + WINDOW_US // 2).alias("end")).distinct()
    return workflow.quiet_gaps(d, ["account"], 5 * HOUR, decisions, covered)


@query(f"""with {TELEMETRY_SQL}, x as (select account, period * {WINDOW_US} s, period * {WINDOW_US} + {WINDOW_US // 2} e from tel group by account, period),
sp as (select account, min(us) s, max(us) + 1 e from tel group by account),
u as (select sp.account, sp.e - sp.s - (select sum(greatest(0, least(x.e, sp.e) - greatest(x.s, sp.s))) from x where x.account = sp.account) t from sp),
r as (select account, count(*) n, sum(input + output)::bigint k from tel t where not exists (select 1 from x where x.account = t.account and x.s <= t.us and x.e > t.us) group by account)
select u.account, t::bigint time_us, n requests, k tokens, k / (t / 1e6) tokens_per_s from u join r using (account)""")
def pause_measure(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    start = F.col("period") * WINDOW_US
    out = d.select("account", start.alias("start"), (start + WINDOW_US // 2).alias("end")).distinct()
    spans = d.groupBy("account").agg(F.min("us").alias("start"), (F.max("us") + 1).alias("end"))
    return workflow.measure_excluding(d, spans, out, ["account"])


@query(f"""with {TELEMETRY_SQL}, g as (select source, us, line, case when us - lag(us) over (partition by source order by us, line) > {24 * HOUR} then 1 else 0 end n from tel where k % 6 = 0),
c0 as (select *, sum(n) over (partition by source order by us, line) cluster from g),
c as (select source, cluster::bigint cluster, min(us) s, max(us) e from c0 group by 1, 2), cc as (select *, lead(s) over (partition by source order by s) nx from c),
b as (select cc.*, (select arg_max(input, us) from tel t where t.source = cc.source and t.us < s) bef, (select arg_min(input, us) from tel t where t.source = cc.source and t.us > e and (nx is null or t.us < nx)) aft from cc),
k as (select b.*, (select min(us) from tel t where t.source = b.source and t.us > e and (nx is null or t.us < nx) and t.input >= 0.8 * bef) bk from b)
select source, cluster, bef as before, aft as after, case when bef > 0 then (bef - aft) / bef end shrink,
  (select count(*) from tel t where t.source = k.source and t.us > e and (nx is null or t.us < nx) and (bk is null or t.us <= bk)) requests, bk is not null recovered from k""")
def compaction_recovery(spark, sf_dir):
    d = telemetry(spark, sf_dir)
    clusters = workflow.compaction_clusters(d.where("k % 6 = 0"), 24 * HOUR)
    return workflow.compaction_recovery(d, clusters)


@query(f"""with recursive {TELEMETRY_SQL}, n as (select source, source // 3 parent, sum(input + output) tokens from tel group by source),
up as (select source node, source ancestor from n union all select up.node, n.parent from up join n on n.source = up.ancestor where n.source > 0)
select ancestor node, sum(tokens)::bigint tokens, count(*) members from up join n on n.source = up.node group by ancestor""")
def subtree_totals(spark, sf_dir):
    per = telemetry(spark, sf_dir).groupBy(F.col("source").alias("node")).agg(F.sum(F.col("input") + F.col("output")).alias("tokens"))
    edges = per.where("node > 0").select(F.col("node").alias("child"), F.expr("node div 3").alias("parent"))
    return graph.subtree_totals(graph.ancestors(edges), per, ["tokens"])


@query("""with recursive s as (select distinct user_id v from events where user_id >= 4), up as (select v, v a, 0 d from s union all select v, a // 3, d + 1 from up where a >= 4)
select v child, a root, d::bigint as depth, false cyclic from up where a < 4""")
def session_families(spark, sf_dir):
    s = telemetry(spark, sf_dir).select("source").distinct().where("source >= 4")
    return graph.families(s.select(F.col("source").alias("child"), F.expr("source div 3").alias("parent")))


@query(f"""with {TELEMETRY_SQL}, l as (select distinct source s, input // 5000 fp, k % 2 = 0 up from tel where k % 2 = 1 or source % 4 > 0), f as (select source s, min(us) u from tel group by source),
p as (select c.s c, p.s p, count(distinct c.fp) n, 0 t from l c join l p on c.fp = p.fp and c.s <> p.s where c.up and not p.up group by 1, 2
  union all select c.s, p.s, count(distinct c.fp), 1 from l c join l p on c.fp = p.fp and c.s <> p.s where not c.up and not p.up and c.s % 3 > 0 group by 1, 2),
q as (select p.*, abs(fc.u - fp_.u) d from p join f fc on fc.s = c join f fp_ on fp_.s = p where t = 0 or fc.u - fp_.u between 0 and {6 * HOUR}),
r as (select *, row_number() over w i, lead(n) over w nx, lead(t) over w nt from q window w as (partition by c order by t, n desc, d, p))
select c child, p parent, case t when 0 then 'explicit' else 'shared' end as method, case when nx = n and nt = t then 'ambiguous' when t = 0 then 'high' else 'medium' end confidence from r where i = 1""")
def best_parents(spark, sf_dir):
    """Every fourth source states no parent; two of three are subagents."""
    d = telemetry(spark, sf_dir)
    links = d.select(F.col("source").alias("session"), F.expr("input div 5000").alias("fp"), (F.col("k") % 2 == 0).alias("is_parent")).where("not is_parent or session % 4 > 0").distinct()
    s = d.groupBy(F.col("source").alias("session")).agg(F.min("us").alias("first_us")).withColumn("subagent", F.col("session") % 3 > 0)
    return graph.build_edges(s, links)


@query(f"""with {TELEMETRY_SQL}, v as (select model, input::double x, (k + 1)::double w from tel),
c as (select model, x, sum(w) over (partition by model order by x) c, sum(w) over (partition by model) t from v)
select model, min(x) filter (c + 1e-9 >= 0.25 * t) q25, min(x) filter (c + 1e-9 >= 0.75 * t) q75 from c group by model""")
def weighted_quantiles(spark, sf_dir):
    d = telemetry(spark, sf_dir).select("model", F.col("input").cast("double").alias("x"), (F.col("k") + 1).cast("double").alias("w"))
    return weighted_quantile(d, ["model"], "x", "w", {"q25": 0.25, "q75": 0.75})


@query(f"""with {TELEMETRY_SQL}, l as (select distinct case when k % 5 = 0 then 'unit' || source || ':role:' || (k % 7) when k % 5 = 1 then 'si1_756e6974_c_00ff_coder_' || (k % 7) else 'bad label' end label from tel)
select label, case when label like 'si1%' then 'unit' when label like 'unit%' then split_part(label, ':', 1) end unit, case when label like 'si1%' then 'coder' when label like 'unit%' then 'role' end as role,
  case when label like 'si1%' then split_part(label, '_', 6)::int when label like 'unit%' then split_part(label, ':', 3)::int end number, label <> 'bad label' valid from l""")
def assignment_labels(spark, sf_dir):
    label = F.when(F.col("k") % 5 == 0, F.concat(F.lit("unit"), "source", F.lit(":role:"), F.col("k") % 7)).when(F.col("k") % 5 == 1, F.concat(F.lit("si1_756e6974_c_00ff_coder_"), F.col("k") % 7)).otherwise("bad label")
    return workflow.assignments_from_labels(telemetry(spark, sf_dir).select(label.alias("label")).distinct(), "label")
