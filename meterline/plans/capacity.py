"""Queries over the capacity of marked quota periods, with their DuckDB SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators import capacity, quota
from meterline.operators.capacity import MEASURES
from meterline.operators.stats import DRAWS
from meterline.plans.registry import BUCKETS, TURN_US, WINDOW_US, bucket_rows, buckets, metered, query
from meterline.plans.statistics import draws_sql

SIZES = [4.0, 8.0]
PERIODS = f"""{BUCKETS}, cm as (select account, reset_key, model, sum(input + output) t from kept where not reviewer group by 1, 2, 3), ce as (select account, reset_key, coalesce(effort, 'unknown') effort, sum(input + output) t from kept where not reviewer group by 1, 2, 3),
dm as (select account, reset_key, arg_min(model, (-t, model)) model, max(t) / sum(t) model_share from cm group by 1, 2), de as (select account, reset_key, arg_min(effort, (-t, effort)) effort, max(t) / sum(t) effort_share from ce group by 1, 2),
sm as (select account, reset_key, sum(points) points, sum(tokens)::bigint all_tokens, sum(priced_tokens) pt, sum(usd) u, sum(core_tokens)::bigint core_tokens, sum(core_priced_tokens) cp, sum(core_usd) cu, bool_or(fit_excluded) fx from bk group by 1, 2),
ac as (select account, reset_key, reset_key * 1000000 - {WINDOW_US} activation_us, case when reset_key * 1000000 < {TURN_US} then 1 else 2 end regime from m group by all),
pe as (select ac.*, lead(activation_us) over (partition by account order by activation_us, reset_key) end_us from ac),
pd as (select pe.account, pe.reset_key, activation_us, end_us, regime, coalesce(model, 'unknown') model, coalesce(model_share, 0.0) model_share, coalesce(effort, 'unknown') effort, coalesce(effort_share, 0.0) effort_share, points, all_tokens,
  case when pt >= 0.5 * all_tokens then cast(u as double) end all_usd, core_tokens, case when core_tokens > 0 and cp >= 0.5 * core_tokens then cast(cu as double) end core_usd,
  points >= 5 and not fx and coalesce(model_share, 0) >= 0.2 and coalesce(effort_share, 0) >= 0.2 and model is not null and coalesce(effort, 'unknown') <> 'unknown' eligible
  from pe join sm on sm.account = pe.account and sm.reset_key = pe.reset_key left join dm on dm.account = pe.account and dm.reset_key = pe.reset_key left join de on de.account = pe.account and de.reset_key = pe.reset_key),
pm as (select *, reset_key // 259200 % 2 = 0 marked, account % 2 half from pd)"""


def periods(spark, sf_dir) -> DataFrame:
    d = metered(spark, sf_dir)
    rows = bucket_rows(d)
    e = d.select("account", "reset_key").distinct().withColumn("activation_us", F.col("reset_key") * 1_000_000 - WINDOW_US)
    e = e.withColumn("regime", F.when(F.col("reset_key") * 1_000_000 < TURN_US, 1).otherwise(2))
    return capacity.capacity_periods(quota.bucket_aggregate(rows), quota.bucket_mix(rows.where("not reviewer"), ["model", "effort"]), e, 0.5, 0.2)


def marked(p: DataFrame) -> DataFrame:
    return p.withColumns({"marked": F.expr("reset_key div 259200") % 2 == 0, "half": F.col("account") % 2})


@query(f"""{PERIODS} select *, """ + ", ".join(f"case when points > 0 then {m} / points end {m}_per_point" for m in MEASURES) + " from pd")
def capacity_periods(spark, sf_dir):
    return periods(spark, sf_dir)


def _pool(rows: str, keys: str) -> str:
    """Pooled ratios of ``rows`` (with a number of times ``z``) by ``keys``."""
    one = ", ".join(f"sum({m} * z) filter (marked and {m} is not null and points > 0) a{i}, sum(points * z) filter (marked and {m} is not null and points > 0) b{i}, sum({m} * z) filter (not marked and {m} is not null and points > 0) c{i}, sum(points * z) filter (not marked and {m} is not null and points > 0) d{i}" for i, m in enumerate(MEASURES))
    out = ", ".join(f"exp(sum(ln((a{i} / b{i}) / (c{i} / d{i})) * w) filter (a{i} > 0 and c{i} > 0) / sum(w) filter (a{i} > 0 and c{i} > 0)) {m}" for i, m in enumerate(MEASURES))
    return f"select {keys}, {out} from (select {keys}, model, effort, regime, sum(points * z) filter (marked) w, {one} from {rows} group by {keys}, model, effort, regime) g group by {keys}"


def _verdict(t: str) -> str:
    pick = lambda s: "coalesce(" + ", ".join(f"case when {t}.{m} is not null then {m}{s} end" for m in MEASURES) + ")"
    measure = "coalesce(" + ", ".join(f"case when {t}.{m} is not null then '{m}' end" for m in MEASURES) + ")"
    return f"{measure} measure, case when {measure} is null then 'insufficient' when {pick('_low')} is null or {pick('_high')} is null then 'no_interval' when {pick('_low')} > 0.5 + 1e-9 then 'above' when {pick('_high')} < 0.5 - 1e-9 then 'below' else 'includes' end verdict"


QUANTILES = ", ".join(f"quantile_cont({m}, 0.1) {m}_low, quantile_cont({m}, 0.9) {m}_high" for m in MEASURES)
ROUNDED = ", ".join(f"round({m}{s}, 6) {m}{s}" for m in MEASURES for s in ("", "_low", "_high"))


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.round(f"{m}{s}", 6).alias(f"{m}{s}") for m in MEASURES for s in ("", "_low", "_high")))


@query(f"""{PERIODS}, el as (select * from pm where eligible), bo as (select half, model, effort, regime from el group by all having bool_or(marked) and bool_or(not marked)),
u as (select el.*, 1.0 z from el semi join bo using (half, model, effort, regime)),
pt as ({_pool("u", "half")}), ct as (select half, count(*) filter (marked) marked_periods, count(*) filter (not marked) other_periods from u group by half),
u0 as (select * exclude (z) from u), {draws_sql("dx", "u0", "c", "half, account, reset_key", DRAWS)},
bs as ({_pool("dx", "half, rep")}), bq as (select half, {QUANTILES} from bs group by half),
fin as (select h.half, coalesce(marked_periods, 0) marked_periods, coalesce(other_periods, 0) other_periods, pt.* exclude (half), bq.* exclude (half) from (select distinct half from el) h left join pt on pt.half = h.half left join ct on ct.half = h.half left join bq on bq.half = h.half)
select half, marked_periods, other_periods, {_verdict("fin")}, {ROUNDED} from fin""")
def capacity_bootstrap(spark, sf_dir):
    p = marked(periods(spark, sf_dir)).where("eligible")
    out = capacity.capacity_bootstrap(p, ["half"], ["model", "effort", "regime"], ["account", "reset_key"])
    return rounded(out, ["half", "marked_periods", "other_periods", "measure", "verdict"])


def _slice(name: str, order: str, low: str, high: str) -> str:
    return f"""{name} as (select account, reset_key, size, sum(points * part) points, min({low}) meter_start, max({high}) meter_end, max(part < 1) interpolated, sum(tokens * part) all_tokens, sum(cast(usd as double) * part) all_usd,
  sum(core_tokens * part) core_tokens, sum(cast(core_usd as double) * part) core_usd, bool_or(fit_excluded) fx, sum(points * part) >= size - 1e-9 complete
  from (select *, greatest(0.0, least(1.0, (size - bef) / points)) part from (select b.*, z.size, coalesce((select sum(c.points) from bk c where c.account = b.account and c.reset_key = b.reset_key and c.bucket {order} b.bucket and c.points > 0), 0) bef
    from bk b, (values ({SIZES[0]}::double), ({SIZES[1]}::double)) z(size) where b.points > 0)) where part > 0 group by 1, 2, 3)"""


PAIRS = f"""{PERIODS}, {_slice("sb", ">", "end_used - points * part", "end_used")}, {_slice("sa", "<", "start_used", "start_used + points * part")},
lg as (select *, lag(reset_key) over w bk0, lag(model) over w m0, lag(effort) over w e0, lag(regime) over w r0 from pm window w as (partition by account order by activation_us, reset_key)),
bp as (select lg.account, lg.reset_key after_key, bk0 before_key, sa.size, model, effort, regime, coalesce(model = m0 and effort = e0 and regime = r0 and model <> 'unknown' and effort <> 'unknown', false) and sb.complete and sa.complete and not sb.fx and not sa.fx and sa.meter_start <= 1 + 1e-9 eligible,
  {", ".join(f"sb.{m} before_{m}, sa.{m} after_{m}" for m in MEASURES)}, {", ".join(f"case when sb.{m} > 0 then sa.{m} / sb.{m} end {m}" for m in MEASURES)}
  from lg join sb on sb.account = lg.account and sb.reset_key = bk0 join sa on sa.account = lg.account and sa.reset_key = lg.reset_key and sa.size = sb.size where marked and bk0 is not null)"""


def pairs(spark, sf_dir) -> DataFrame:
    return capacity.boundary_pairs(buckets(spark, sf_dir), marked(periods(spark, sf_dir)), SIZES)


DOLLARS = [f"{side}_{m}" for side in ("before", "after") for m in ("core_usd", "all_usd")]


@query(f"{PAIRS} select * replace ({', '.join(f'round({c}, 4) as {c}' for c in DOLLARS)}) from bp")
def boundary_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).withColumns({c: F.round(c, 4) for c in DOLLARS})


def _ratios(rows: str, keys: str) -> str:
    ok = lambda m: f"after_{m} is not null and before_{m} > 1e-9"
    return f"select {keys}, count(*) pairs, " + ", ".join(f"case when sum(before_{m} * z) filter ({ok(m)}) > 0 then sum(after_{m} * z) filter ({ok(m)}) / sum(before_{m} * z) filter ({ok(m)}) end {m}" for m in MEASURES) + f" from {rows} group by {keys}"


@query(f"""{PAIRS}, u0 as (select *, account % 2 half from bp where before_all_tokens > 0), u as (select *, 1.0 z from u0),
pt as ({_ratios("u", "half, size")}), {draws_sql("dx", "u0", "s", "half, size, account, after_key", DRAWS)},
bs as ({_ratios("dx", "half, size, rep")}), bq as (select half, size, {QUANTILES} from bs group by 1, 2),
fin as (select pt.*, bq.* exclude (half, size) from pt left join bq on bq.half = pt.half and bq.size = pt.size and pairs > 1),
en as (select half, min(size) a, max(size) b, arg_min(coalesce({", ".join(MEASURES)}), size) x, arg_max(coalesce({", ".join(MEASURES)}), size) y from pt group by half)
select fin.half, size, pairs, {_verdict("fin")}, size = b preferred, a < b and x <= 0.65 and y >= 0.8 transient, {ROUNDED} from fin join en on en.half = fin.half""")
def boundary_summary(spark, sf_dir):
    """Over all pairs with tokens on both sides: the strict rule leaves too few in a month."""
    p = pairs(spark, sf_dir).where("before_all_tokens > 0").withColumns({"eligible": F.lit(True), "half": F.col("account") % 2})
    out = capacity.boundary_summary(p, ["half"])
    return rounded(out, ["half", "size", "pairs", "measure", "verdict", "preferred", "transient"])
