import json
import math
from decimal import Decimal

import duckdb
import pytest

from meterline.functions.temporal import interval_union
from meterline.operators import clean, pricing, quota, stats, usage
from meterline.plans import registry
from meterline.sources import telemetry as src
from meterline.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    return con


def norm(v):
    v = float(v) if isinstance(v, Decimal) else v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    q = duck.sql(registry.ORACLES[name])
    assert cols == sorted(q.columns)
    at = [q.columns.index(c) for c in cols]
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in q.fetchall()), key=str)


def meter(spark, used, key=0, start=0):
    rows = [(1, key, start + i, i, 1, float(u), 10, 0, 5, False, None) for i, u in enumerate(used)]
    return spark.createDataFrame(rows, "account long, reset_key long, us long, line long, source long, used double, input long, cached long, output long, reviewer boolean, usd decimal(38,12)")


def test_high_water_known_answer(spark):
    d = meter(spark, [0, 0, 1, 1, 2, 1, 1, 2, 3])
    b = quota.bucket_aggregate(quota.high_water_rows(d)).orderBy("bucket").collect()
    assert [r.points for r in b if r.points > 0] == [1.0, 1.0, 1.0] and b[-1].events == 4
    e = quota.raw_episodes(d.withColumn("reset_at", d["reset_key"]), 0).first()
    assert (e.max_backstep, e.backsteps, e.new_highs) == (1.0, 2, 4)


def test_ledger_known_answer(spark):
    hour = 3600
    rows = [(1, k, float(r), f, f + 1, a, b, max(a, b), (r - 168 * hour) * 1_000_000) for k, r, f, a, b in
            ((1, 168 * hour, 0, 0.0, 3.0), (2, 240 * hour, 80 * hour * 10**6, 0.0, 0.5), (3, 241 * hour, 81 * hour * 10**6, 0.0, 0.0), (4, 408 * hour, 250 * hour * 10**6, 0.0, 1.0))]
    e = spark.createDataFrame(rows, "account long, reset_key long, reset_at double, first_us long, last_us long, first_used double, last_used double, high_used double, activation_us long")
    before = spark.createDataFrame([(1, 2, 3.0), (1, 3, 0.5), (1, 4, 0.0)], "account long, reset_key long, before_used double")
    led = quota.reset_ledger(e, before, 2 * hour * 10**6).orderBy("reset_key").collect()
    assert [r.kind for r in led] == ["initial", "early", "churn", "scheduled"] and sum(r.creates for r in led) == 3


def test_long_context_known_answer(spark):
    rates = pricing.rate_dimension(spark, [("m", 2.0, 0.1, 10.0)])
    d = spark.createDataFrame([("m", 300_000, 250_000, 50_000, 10_000)], "rate_model string, input long, cached long, uncached long, output long")
    r = pricing.price_events(d, rates).first()
    assert float(r.usd) == 0.4 and float(r.usd - r.base_usd) == 0.175
    assert pricing.price_events(d, rates, exempt=["m"]).first().usd == r.base_usd


def test_replay_prefix(spark):
    rows = [(1, i, i * 1000, 310_000 * (i + 1), 60.0 * i, 1.0 * i) for i in range(30)] + [(1, 30, 10_000_000, 310_000 * 31, 60.0, 1.0)]
    d = spark.createDataFrame(rows, "source long, line long, us long, total long, reset_at double, used double")
    flags = [r.replay for r in clean.flag_replay_prefix(d).orderBy("line").collect()]
    assert flags == [True] * 30 + [False]


def test_month_bounds_across_clock_changes():
    low, high = usage.month_bounds("2024-03", "Europe/Berlin")
    assert (high - low) // 3_600_000_000 == 31 * 24 - 1
    with pytest.raises(ValueError):
        usage.filter_period(None, month="2024-01", after=1)


def test_regimes_find_a_step(spark):
    d = spark.createDataFrame([(1, i, (0.0 if i < 10 else 1.0) + 0.01 * (i % 3), 5.0) for i in range(20)], "g long, i long, x double, w double")
    out = {r.i: r.regime for r in stats.detect_regimes(d, ["g"], ["i"], "x", "w").collect()}
    assert [out[i] for i in range(20)] == [1] * 10 + [2] * 10


def test_interval_union_drops_empty(spark):
    d = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 10, 12)], "k long, start long, end long")
    assert sorted(map(tuple, interval_union(d, ["k"]).collect())) == [(1, 0, 7), (1, 10, 12)]


def log_line(ts, n, used=1):
    usage_ = {"input_tokens": n, "cached_input_tokens": 1, "output_tokens": 2, "reasoning_output_tokens": 0}
    limits = {"limit_id": "codex", "primary": {"window_minutes": 300, "used_percent": used, "resets_at": 1000}, "secondary": {"window_minutes": 0, "used_percent": 1, "resets_at": 1}}
    return json.dumps({"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": usage_}, "rate_limits": limits}})


def test_logs_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [log_line(f"2024-01-01T00:00:0{i}Z", i) for i in range(5)]
    (tmp_path / "in/a.jsonl").write_text("\n".join([*lines, "{broken", "[1]"]))
    (tmp_path / "in/b.jsonl").write_text(lines[0])
    lines_df = src.read_logs(spark, str(tmp_path / "in"))
    records = src.parse_records(lines_df)
    assert records.where("bad").count() == 2
    u = src.usage_records(records.where("not bad")).orderBy("source", "line").collect()
    assert [r.input for r in u] == [0, 1, 2, 3, 4, 0] and [r.line for r in u] == [1, 2, 3, 4, 5, 1] and list(u[0].meters) == [300]
    q = streams.stream_logs(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("logs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert spark.table("logs").count() == 8


def test_stream_bursts_equal_batch(spark, tmp_path):
    d = src.telemetry(spark, SF).selectExpr("source", "cast(ts as timestamp) ts", "input")
    batch = sorted(map(tuple, streams.stream_bursts(d, "12 hours").collect()))
    d.write.parquet(str(tmp_path / "e"))
    s = streams.stream_bursts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "e")), "12 hours")
    q = s.writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bursts").collect())) == batch


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
