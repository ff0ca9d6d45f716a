"""Queries over quota statistics: regimes, cohorts, fits and resampling, with their DuckDB SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators import quota, reviewer, stats
from meterline.plans.registry import BUCKETS, METERED, MONTHS, REPLAY, bucket_ctes, bucket_rows, buckets, metered, point_sql, query, with_replay

MIX = """mt as (select account, reset_key, bucket, model, sum(input + output) t from kept group by all),
me as (select account, reset_key, bucket, coalesce(effort, 'unknown') effort, sum(input + output) t from kept group by all),
dm as (select account, reset_key, bucket, arg_min(model, (-t, model)) model, max(t) / sum(t) model_share from mt group by 1, 2, 3),
de as (select account, reset_key, bucket, arg_min(effort, (-t, effort)) effort, max(t) / sum(t) effort_share from me group by 1, 2, 3),
bd as (select bk.*, model, model_share, effort, effort_share, strftime(make_timestamp(end_us), '%Y-%m') as month from bk join dm using (account, reset_key, bucket) join de using (account, reset_key, bucket))"""
DOMINANT = f"{BUCKETS}, {MIX}"


def dominant_buckets(spark, sf_dir) -> DataFrame:
    rows = bucket_rows(metered(spark, sf_dir))
    return quota.with_dominant(quota.bucket_aggregate(rows), quota.bucket_mix(rows, ["model", "effort"]), ["model", "effort"])


def draws_sql(name: str, units: str, seed: str, ids: str, boots: int) -> str:
    """A CTE with the rows of ``units`` for each draw (rep) that takes them, z times: from 16 bits of an md5 each."""
    z = " + ".join(f"(v >= {t})::int" for t in stats.STEPS)
    h = f"select *, md5(concat_ws(':', '{seed}', w, {ids})) h from {units}, range({-(-boots // 8)}) words(w)"
    v = f"select *, w * 8 + j rep, ('0x' || substr(h, (4 * j + 1)::int, 4))::int v from ({h}), range(8) places(j)"
    return f"{name} as (select * from (select * exclude (w, h, j, v), {z} z from ({v})) where rep < {boots} and z > 0)"


@query(f"{DOMINANT}, mm as (select * from bd where model_share >= 0.9) {point_sql('mm', 'account, month, model', 'having sum(points) >= 5')}")
def model_month(spark, sf_dir):
    return quota.model_month(dominant_buckets(spark, sf_dir))


@query(f"""{METERED}, {REPLAY}, m2 as (select m.* from m join f using (line) where not f.replay), {bucket_ctes("a", "m")}, {bucket_ctes("b", "m2")},
da as (select *, strftime(make_timestamp(end_us), '%Y-%m') as month from abk), db as (select *, strftime(make_timestamp(end_us), '%Y-%m') as month from bbk),
pa as ({point_sql("da", "account, month")}), pb as ({point_sql("db", "account, month")})
select account, month, pb.priced_points points_without, pb.usd_per_point usd_without, pa.priced_points points_included, pa.usd_per_point usd_included, (pa.usd_per_point / pb.usd_per_point - 1) * 100 change_percent
  from pa join pb using (account, month) where pa.priced_points >= 5 and pb.priced_points >= 5""")
def replay_sensitivity(spark, sf_dir):
    d = with_replay(metered(spark, sf_dir))
    return quota.replay_sensitivity(quota.bucket_aggregate(bucket_rows(d.where("not replay"))), quota.bucket_aggregate(bucket_rows(d)))


# regimes: an account's series of a model has at most 11 episodes (a month of three-day windows), and a cut leaves 4 on both sides, so the SQL's one level is all there can be

SERIES = f"""{DOMINANT}, dr as (select * from bd where points > 0 and not fit_excluded and model_share >= 0.5),
r0 as (select account, model, reset_key, min(first_us) start_us, max(end_us) end_us, sum(points) points, sum(tokens)::bigint tokens, sum(points) filter (usd is not null and priced_tokens >= 0.95 * tokens) p,
  cast(sum(usd) filter (priced_tokens >= 0.95 * tokens) as double) u from dr group by 1, 2, 3),
r1 as (select *, case when p >= greatest(1, 0.8 * points) and u > 0 then u / p end api from r0), z as (select distinct account, model from r1 where api is null),
r2 as (select r1.*, case when z.model is null then 'usd_per_point' else 'mtok_per_point' end basis, case when z.model is null then api else tokens / 1e6 / points end metric
  from r1 left join z on z.account = r1.account and z.model = r1.model),
i as (select *, row_number() over (partition by account, model order by start_us, reset_key) i, count(*) over (partition by account, model) n, ln(metric) x from r2),
c as (select a.account, a.model, a.i, b.i <= a.i as lft, sum(b.points) w, sum(b.points * b.x) s, sum(b.points * b.x * b.x) q from i a join i b using (account, model) where a.i >= 4 and a.n - a.i >= 4 group by all),
g as (select l.account, l.model, l.i, l.w lw, r.w rw, (l.q + r.q) - (l.s + r.s) ** 2 / (l.w + r.w) sse0, (l.q - l.s ** 2 / l.w) + (r.q - r.s ** 2 / r.w) sse, exp(abs(l.s / l.w - r.s / r.w)) ratio
  from c l join c r on l.account = r.account and l.model = r.model and l.i = r.i and l.lft and not r.lft),
rh as (select *, round(greatest(0, 1 - sse / sse0), 9) gain from g where sse0 > 1e-9 and lw >= 5 and rw >= 5),
best as (select account, model, arg_min(i, (-round(gain * ln(greatest(round(ratio, 9), 1.000001)), 9), i)) cut from rh where gain >= 0.15 and round(ratio, 9) >= 1.05 group by 1, 2),
rg as (select i.*, case when i.i > coalesce(cut, n) then 2 else 1 end regime from i left join best on best.account = i.account and best.model = i.model)"""


def model_episodes(b: DataFrame) -> DataFrame:
    """Episodes of ``dominant_buckets`` with their metric and regime."""
    rows = quota.dominant_rows(b, 0.5)
    by = ["account", "model"]
    e = reviewer.episode_metric(rows, by, [*by, "reset_key"])
    e = e.join(rows.groupBy(*by, "reset_key").agg(F.min("first_us").alias("start_us"), F.max("end_us").alias("end_us")), [*by, "reset_key"])
    return stats.detect_regimes(e.withColumn("x", F.log("metric")), by, ["start_us", "reset_key"], "x", "points", 4, 5.0, 0.15, 1.05)


@query(f"{SERIES} select account, model, reset_key, points, tokens, basis, metric, regime from rg")
def usage_regimes(spark, sf_dir):
    out = model_episodes(dominant_buckets(spark, sf_dir))
    return out.select("account", "model", "reset_key", "points", "tokens", "basis", "metric", "regime")


@query(f"""{SERIES}, sp as (select account, model, regime, min(start_us) a, max(end_us) b from rg group by 1, 2, 3),
x as (select m.account, m.model, (select min(regime) from sp where sp.account = m.account and sp.model = m.model and m.us between a and b) regime from m)
select account, model, regime, count(*) events from x group by 1, 2, 3""")
def regime_at(spark, sf_dir):
    spans = model_episodes(dominant_buckets(spark, sf_dir)).groupBy("account", "model", "regime").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    d = stats.regime_at(metered(spark, sf_dir), spans, ["account", "model"], "us")
    return d.groupBy("account", "model", "regime").agg(F.count("*").alias("events"))


@query(f"""{SERIES}, la as (select model, arg_max(regime, (end_us, -regime)) regime from rg group by model),
r as (select dr.*, rg.regime from dr join rg using (account, model, reset_key) join la on la.model = rg.model and la.regime = rg.regime where dr.model_share >= 0.8 and dr.effort <> 'unknown' and dr.effort_share >= 0.8),
ce as (select model, regime, effort, account, reset_key, sum(tokens) t, sum(points) p, cast(sum(usd) filter (priced_tokens >= 0.95 * tokens) as double) u, sum(points) filter (usd is not null and priced_tokens >= 0.95 * tokens) q from r group by all),
{draws_sql("dw", "ce", "r", "model, regime, effort, account, reset_key", stats.DRAWS)}, dv as (select model, regime, effort, rep, sum(t * z) / 1e6 / sum(p * z) x, case when sum(q * z) > 0 then sum(u * z) / sum(q * z) end y from dw group by all),
ci as (select model, regime, effort, quantile_cont(x, 0.1) xl, quantile_cont(x, 0.9) xh, quantile_cont(y, 0.1) yl, quantile_cont(y, 0.9) yh from dv group by all),
co as (select model, regime, effort, count(*) buckets, count(distinct (account, reset_key)) episodes, sum(points) points, sum(tokens) / 1e6 / sum(points) tokens_m_per_point, sum(uncached) / 1e6 / sum(points) uncached_m_per_point,
  sum(cached) / 1e6 / sum(points) cached_m_per_point, sum(output) / 1e6 / sum(points) output_m_per_point, coalesce(sum(points) filter (usd is not null and priced_tokens >= 0.95 * tokens), 0.0) priced_points,
  count(distinct (account, reset_key)) filter (usd is not null and priced_tokens >= 0.95 * tokens) priced_episodes,
  case when sum(points) filter (usd is not null and priced_tokens >= 0.95 * tokens) >= 5 and count(distinct (account, reset_key)) filter (usd is not null and priced_tokens >= 0.95 * tokens) >= 2
    then cast(sum(usd) filter (priced_tokens >= 0.95 * tokens) as double) / sum(points) filter (usd is not null and priced_tokens >= 0.95 * tokens) end usd_per_point
  from r group by model, regime, effort having sum(points) >= 5 and count(distinct (account, reset_key)) >= 2)
select co.*, round(xl, 6) tokens_m_low, round(xh, 6) tokens_m_high, round(case when usd_per_point is not null then yl end, 6) usd_low, round(case when usd_per_point is not null then yh end, 6) usd_high from co left join ci using (model, regime, effort)""")
def cohort_rows(spark, sf_dir):
    b = dominant_buckets(spark, sf_dir)
    out = quota.cohort_rows(b, model_episodes(b), 0.8, 5.0, 2)
    return out.withColumns({c: F.round(c, 6) for c in ("tokens_m_low", "tokens_m_high", "usd_low", "usd_high")})


# resampling and fits


@query(f"""{BUCKETS}, ep as (select account, reset_key, sum(tokens) tokens, sum(points) points from bk where points > 0 group by 1, 2),
{draws_sql("r", "ep", "b", "account, reset_key", stats.DRAWS)}, e as (select account, rep, sum(tokens * z) / sum(points * z) x from r group by 1, 2)
select account, count(*) units, sum(tokens)::bigint / sum(points) estimate, case when count(*) > 1 then (select quantile_cont(x, 0.1) from e where e.account = ep.account) end low, case when count(*) > 1 then (select quantile_cont(x, 0.9) from e where e.account = ep.account) end high from ep group by account""")
def episode_bootstrap(spark, sf_dir):
    """Whole episodes are drawn: their buckets are summed first."""
    u = buckets(spark, sf_dir).where("points > 0").groupBy(*quota.EPISODE).agg(F.sum("tokens").alias("tokens"), F.sum("points").alias("points"))
    out = stats.ratio_bootstrap(u, ["account"], "tokens", "points", ["reset_key"])
    return out.withColumn("units", F.col("units").cast("long"))


#: Features of each fit, in millions of tokens.
SPECS = {"total": (1, ["all_m"]), "cache": (2, ["uncached_m", "cached_m"]), "io": (2, ["input_m", "output_m"]), "full": (3, ["uncached_m", "cached_m", "output_m"])}


def fit_rows(spark, sf_dir) -> DataFrame:
    m = lambda c: (c / 1e6)
    b = buckets(spark, sf_dir).where("points > 0 and not fit_excluded")
    return b.select("account", "reset_key", "points", m(F.col("uncached")).alias("uncached_m"), m(F.col("cached")).alias("cached_m"), m(F.col("output")).alias("output_m"), m(F.col("uncached") + F.col("cached")).alias("input_m"), m(F.col("tokens")).alias("all_m"))


def _beta(p: str = "") -> str:
    """wa, wb: non-negative least squares on two features (the second may be all zero) from sums with a prefix."""
    c = {k: f"{p}{k}" for k in ("aa", "bb", "ab", "ay", "yb")}
    free = "({bb} > 0 and {aa} * {bb} - {ab} * {ab} > 1e-12 * {aa} * {bb} and ({ay} * {bb} - {yb} * {ab}) / ({aa} * {bb} - {ab} * {ab}) >= 0 and ({yb} * {aa} - {ay} * {ab}) / ({aa} * {bb} - {ab} * {ab}) >= 0)".format(**c)
    first = "({bb} <= 0 or {ay} * {ay} / {aa} >= {yb} * {yb} / {bb})".format(**c)
    wa = "case when {0} then ({ay} * {bb} - {yb} * {ab}) / ({aa} * {bb} - {ab} * {ab}) when {1} then {ay} / {aa} else 0.0 end wa".format(free, first, **c)
    return wa + ", case when {0} then ({yb} * {aa} - {ay} * {ab}) / ({aa} * {bb} - {ab} * {ab}) when {1} then 0.0 else {yb} / {bb} end wb".format(free, first, **c)


SUMS = ", ".join(f"sum({x}) {x}" for x in ("aa", "bb", "ab", "ay", "yb"))
FITS = f"""{BUCKETS}, fx as (select account, reset_key, points y, unnest([{{'spec': 'total', 'a': tokens / 1e6, 'b': 0.0::double}}, {{'spec': 'cache', 'a': uncached / 1e6, 'b': cached / 1e6}}, {{'spec': 'io', 'a': (uncached + cached) / 1e6, 'b': output / 1e6}}]) f
  from bk where points > 0 and not fit_excluded),
fe as (select account, f.spec spec, reset_key, sum(f.a * f.a) aa, sum(f.b * f.b) bb, sum(f.a * f.b) ab, sum(f.a * y) ay, sum(f.b * y) yb, sum(f.a) sa, sum(f.b) sb, sum(y) y, count(*) k from fx group by all),
ei as (select *, row_number() over (partition by account, spec order by reset_key) - 1 i, count(*) over (partition by account, spec) n from fe),
ef as (select *, case when n <= 12 then i else i % 5 end fold from ei where n >= 3),
tr as (select f.account, f.spec, f.fold, {SUMS.replace("sum(", "sum(e.")} from (select distinct account, spec, fold from ef) f join ef e on e.account = f.account and e.spec = f.spec and e.fold <> f.fold group by all),
tb as (select account, spec, fold, {_beta()} from tr),
cv as (select account, spec, sum(abs(wa * sa + wb * sb - y)) / sum(y) cv_wape, sum(wa * sa + wb * sb - y) / sum(y) cv_bias from ef join tb using (account, spec, fold) group by 1, 2),
{draws_sql("dr", "fe", "f", "account, reset_key", stats.FIT_DRAWS)},
bs as (select account, spec, rep, {_beta()} from (select account, spec, rep, {", ".join(f"sum({x} * z) {x}" for x in ("aa", "bb", "ab", "ay", "yb"))} from dr group by 1, 2, 3)),
bq as (select account, spec, quantile_cont(wb / wa, 0.1) filter (wa > 1e-10) low, quantile_cont(wb / wa, 0.5) filter (wa > 1e-10) mid, quantile_cont(wb / wa, 0.9) filter (wa > 1e-10) high, count(*) filter (wa > 1e-10) / count(*) valid from bs group by 1, 2),
al as (select account, spec, n_rows, {_beta()}, case when spec = 'total' then 1.0 when abs(ab) / sqrt(aa * bb) < 1 - 1e-10 then sqrt((1 + abs(ab) / sqrt(aa * bb)) / (1 - abs(ab) / sqrt(aa * bb))) end cond from (select account, spec, sum(k)::bigint n_rows, {SUMS} from fe group by 1, 2)),
fit as (select al.account, al.spec, n_rows, wa, wb, cond, cv_wape, cv_bias, low, mid, high, valid, case when cond is null or cond > 50 or cv_wape is null then 'not identifiable' when cv_wape > 0.4 then 'weak'
  when al.spec <> 'total' and coalesce(valid < 0.8 or low is null or (low <= 0 and high > 0) or (low > 0 and high / low > 10), true) then 'not identifiable' else 'supported' end status
  from al left join cv using (account, spec) left join bq using (account, spec))"""


def fits(spark, sf_dir, names) -> DataFrame:
    rows, out = fit_rows(spark, sf_dir), None
    for name in names:
        complexity, features = SPECS[name]
        f = stats.fit_candidate(rows, ["account"], "reset_key", features, "points")
        f = f.withColumns({"spec": F.lit(name), "complexity": F.lit(complexity)})
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


@query(f"""{FITS} select account, spec, n_rows n, round(wa, 4) weight_0, case when spec <> 'total' then round(wb, 4) end weight_1, round(cond, 4) "condition", round(cv_wape, 5) cv_wape, round(cv_bias, 5) cv_bias,
  case when spec <> 'total' then round(low, 3) end ratio_low, case when spec <> 'total' then round(mid, 3) end ratio_mid, case when spec <> 'total' then round(high, 3) end ratio_high, case when spec <> 'total' then valid end valid, status from fit""")
def fit_candidates(spark, sf_dir):
    d = fits(spark, sf_dir, ["total", "cache", "io"])
    return d.select("account", "spec", "n", F.round("weight_0", 4).alias("weight_0"), F.round("weight_1", 4).alias("weight_1"), F.round("condition", 4).alias("condition"), F.round("cv_wape", 5).alias("cv_wape"), F.round("cv_bias", 5).alias("cv_bias"),
                    *(F.round(f"ratio_{q}_1", 3).alias(f"ratio_{q}") for q in ("low", "mid", "high")), F.col("valid_1").alias("valid"), "status")


@query(f"""{FITS}, g as (select *, case spec when 'total' then 1 else 2 end complexity, case status when 'supported' then 0 else 1 end r from fit where status in ('supported', 'weak') and cv_wape is not null),
t as (select g.* from g where r = (select min(r) from g h where h.account = g.account)), l as (select t.* from t where cv_wape <= (select min(cv_wape) from t u where u.account = t.account) + 0.03)
select account, arg_min(spec, (complexity, cv_wape, spec)) spec, min(complexity)::int complexity from l group by account""")
def choose_fit(spark, sf_dir):
    d = fits(spark, sf_dir, ["total", "cache", "io"]).withColumn("name", F.col("spec"))
    return stats.choose_fit(d, ["account"]).select("account", "spec", "complexity")
