import hashlib
import json
import random

import pytest
from logs import Log
from pyspark.sql import functions as F

from meterline.operators import pricing, quota, workflow
from meterline.plans import registry
from meterline.sources import records as rec
from meterline.sources import tables
from meterline.sources import telemetry as src
from meterline.streaming import streams

SF = "/root/testdata/sf0.001"
PARENT, CHILD = "0123456789abcdef", "fedcba9876543210"
AT = "2026-09-12T12:00:0{}Z"


def fp(text):
    return hashlib.sha256(text.encode()).hexdigest()[:24]


@pytest.fixture
def parsed(spark, tmp_path):
    def load(*payloads):
        lines = [json.dumps({"timestamp": AT.format(i), "type": "response_item", "payload": p}) for i, p in enumerate(payloads)]
        (tmp_path / "a.jsonl").write_text("\n".join([*lines, "{broken"]))
        return src.parse_records(src.read_logs(spark, str(tmp_path)))

    return load


def test_links(parsed):
    r = parsed({"session_id": CHILD, "source": {"subagent": {"thread_spawn": {"parent_thread_id": PARENT}}}, "title": "a long text of many words", "thread": {"id": "x/y/z123"}, "agent_id": "no"})
    out = {(x.fp, x.is_parent) for x in rec.link_ids(rec.payload_leaves(r)).collect()}
    assert out == {(fp(CHILD), False), (fp(PARENT), True)}


def test_approval_markers(parsed):
    r = parsed({"type": "exec_approval_request", "text": "x"}, {"type": "note", "approval_decision": "denied"}, {"type": "turn", "approval_policy": "never"}, {"type": "approval"}, {"type": "thread_settings_approval"})
    out = [x.kind for x in rec.approval_markers(r).orderBy("us").collect()]
    assert out == ["request", "decision", "approval"]


def call(name, args, **more):
    return {"type": "function_call", "name": name, "arguments": json.dumps(args) if isinstance(args, dict) else args, "call_id": "c1", **more}


def test_lifecycle_actions(parsed):
    r = parsed(
        call("spawn_agent", {"agent_type": "Code reviewer", "message": "secret words"}), call("tools.send-input", {"agent_id": CHILD, "thread_id": PARENT}), call("wait", {"agent_ids": [CHILD, PARENT]}),
        {"type": "function_call_output", "name": "spawn_agent", "arguments": "{}"}, call("shell", {"command": "ls"}),
    )
    out = [(x.kind, x.targets, x.roles) for x in rec.lifecycle_actions(rec.tool_calls(r), ["reviewer", "view"]).orderBy("line").collect()]
    assert out == [("spawn", [], ["reviewer"]), ("send", [fp(CHILD)], []), ("wait", sorted([fp(CHILD), fp(PARENT)]), [])]


def test_tool_events(parsed):
    """By the format's own names: the first rule that fits counts."""
    cases = [
        (call("shell", {"command": ["git", "status"]}), "git-state", 0), (call("shell", {"command": "cat src/a.py:12"}), "file-read", 1), (call("shell", {"command": "sed -i s/a/b/ src/a.py"}), "shell-other", 2),
        (call("exec", {"code": "x"}), "opaque-wrapper", 0), (call("read_file", {"path": "src/a.py"}), "file-read", 1), (call("shell", {"cmd": "npm run build"}), "test-build", 0), (call("shell", {"cmd": "npm install"}), "shell-other", 0), (call("wait", {"id": 1}), "lifecycle", 0),
        (call("read_text", {"workdir": "/src"}), "file-read", 1), (call("file_read", {"files": ["a.py", "b.rs", "c"]}), "file-read", 2), (call("terminal", {"cmd": "git log"}), "git-state", 0), (call("run_command", {"script": "git diff"}), "git-state", 0),
        (call("command", {"command": "git show"}), "git-state", 0), (call("credit_check", {"n": 1}), "test-build", 0), (call("apply-patch", {"edits": [{"target_path": "x/y.go"}]}), "write-edit", 1), (call("mcp.rg", {"q": "x"}), "search", 0),
        (call("bash", {"command": "/usr/bin/cargo clippy"}), "test-build", 1), (call("bash", {"command": "cargo install x"}), "shell-other", 0), (call("exec_command", {"cmd": "cat 'my notes.md' \"b c.py\""}), "file-read", 2), (call("exec_command", {"cmd": "cat 'broken a.py"}), "file-read", 1),
        (call("draw", {"size": 3}), "other", 0),
    ]
    out = []
    for lo in range(0, len(cases), 9):
        out += rec.tool_events(rec.tool_calls(parsed(*(c for c, _, _ in cases[lo : lo + 9])))).orderBy("line").collect()
    assert [(x.category, len(x.resources)) for x in out] == [(c, n) for _, c, n in cases]
    assert out[1].resources == out[4].resources == [hashlib.sha256(b"src/a.py").hexdigest()[:12]]


def test_nested_calls_are_found_and_calls_are_not_entered(parsed):
    deep = {"type": "batch", "steps": [{"run": call("spawn_agent", {"agent_type": "reviewer", "then": call("wait", {"agent_id": PARENT})})}, call("close_agent", {"who": [{"target": {"id": CHILD}}]})]}
    r = parsed(deep, {"type": "note", "content": [call("wait", {})]}, {"type": "tool_result", "inner": call("wait", {})}, {"x": {"function": {"name": "tools.wait", "arguments": json.dumps({"agent_ids": [CHILD, PARENT]})}}})
    calls = rec.tool_calls(r)
    assert [(x.line, x.name, x.place) for x in calls.orderBy("line", "place").collect()] == [(1, "close_agent", "steps.[]"), (1, "spawn_agent", "steps.[].run"), (4, "wait", "x")]
    out = {x.kind: (x.targets, x.roles) for x in rec.lifecycle_actions(calls, ["reviewer"]).collect()}
    assert out == {"spawn": ([], ["reviewer"]), "close": ([fp(CHILD)], []), "wait": (sorted([fp(CHILD), fp(PARENT)]), [])}


def test_markers_are_read_from_names_whatever_they_hold(parsed):
    r = parsed({"approval_request": {}}, {"a": [{"approval_denied": []}]}, {"approvals_reviewer": {}}, {"type": "x", "a": {"b": {"c": {"d": {"approval": 1}}}}}, {"a": {"b": {"c": {"d": {"e": {"approval": 1}}}}}})
    assert [(x.us % 10_000_000 // 1_000_000, x.kind) for x in rec.approval_markers(r).orderBy("us").collect()] == [(0, "request"), (1, "decision"), (3, "approval")]


def test_leaves_and_what_lies_beyond_them(parsed):
    r = parsed({"A": {"b": [1, "x", None, {"c": True}]}, "e": {}, "f": 2.5, "n": [[]]}, {"l": list(range(70))}, {"a": {"a": {"a": {"a": {"a": {"a": {"a": {"a": 1}}}}}}}})
    leaves = rec.payload_leaves(r)
    assert sorted((x.path, x.kind) for x in leaves.where("line = 1").collect()) == [("a.b.[]", "null"), ("a.b.[]", "number"), ("a.b.[]", "string"), ("a.b.[].c", "boolean"), ("f", "number")]
    assert leaves.where("line = 2").count() == 64 and leaves.where("line = 3").count() == 0
    assert tuple(rec.beyond(r).first()) == (1, 1)
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan.split("Window")[0]


def test_counts_of_a_session(spark, tmp_path):
    log = Log().spend(5, total=5).wait(seconds=1).spend(5, total=5).wait(seconds=1).spend(5, total=5).raw("{").spend(6, total=11).raw("[1]")
    log.save(tmp_path / "a.jsonl")
    Log().raw("nothing").save(tmp_path / "b.jsonl")
    records = src.parse_records(src.read_logs(spark, str(tmp_path)))
    counts = rec.read_counts(records)
    assert sorted((x.source[-7], x.duplicates, x.parse_errors) for x in counts.collect()) == [("a", 2, 2), ("b", 0, 1)]
    events = src.usage_events(records, include_unmetered=True)
    out = sorted((x.source[-7], x.requests, x.input, x.duplicates, x.parse_errors) for x in workflow.session_summary(events, counts).collect())
    assert out == [("a", 2, 11, 2, 2), ("b", 0, 0, 0, 1)]


def test_recent_families_are_ranked(spark):
    day = 86_400_000_000
    f = [(1, 9 * day, 5.0, "limited"), (2, 10 * day, 1.0, "complete"), (3, 10 * day, 9.0, "limited"), (4, 10 * day, 9.5, "limited"), (5, day, 99.0, "complete"), (6, 10 * day, 1.0, "odd"), (7, None, 1.0, "complete")]
    d = spark.createDataFrame(f, "family long, last_us long, score double, quality string")
    assert [x.family for x in workflow.recent_families(d, 3 * day).collect()] == [2, 4, 3, 1, 6]
    assert [x.family for x in workflow.recent_families(d.where("last_us is null"), day).collect()] == [7]


def test_shape_of_actions(parsed, spark):
    r = parsed({"type": "function_call", "name": "send_input", "arguments": {"agent_id": CHILD, "n": 1}}, {"type": "function_call", "name": "send_input", "arguments": {"agent_id": PARENT}})
    actions = rec.lifecycle_actions(rec.tool_calls(r))
    spawned = spark.createDataFrame([(fp(CHILD),)], "fp string")
    out = {x.path: (x.action, x.occurrences, x.calls, x.kinds, x.id_shaped, x.spawn_handles) for x in rec.action_schema(actions, rec.payload_leaves(r), spawned).collect()}
    assert out["arguments.agent_id"] == ("send", 2, 2, "string", 2, 1) and out["arguments.n"] == ("send", 1, 1, "number", 0, 0)


def test_write_table(spark, tmp_path):
    d = spark.createDataFrame([(1, "x")], "a long, b string")
    tables.write_table(d, str(tmp_path / "t"), ["b", "a"], "csv")
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == ["b", "a"]
    with pytest.raises(ValueError, match="no such columns"):
        tables.write_table(d, str(tmp_path / "u"), ["c"])


def test_refresh_reads_changed_files_alone(spark, tmp_path):
    logs, table = tmp_path / "logs", f"file://{tmp_path}/table"
    logs.mkdir()
    extract = lambda lines: lines.select("source", "line", F.length("value").alias("n"))
    go = lambda settings="1": tables.refresh(spark, str(logs), table, extract, settings)
    for name in "ab":
        (logs / f"{name}.jsonl").write_text("x\nyy\n")
    assert go() == {"read": 2, "kept": 0, "gone": 0} and tables.current(spark, table).count() == 4
    assert go() == {"read": 0, "kept": 2, "gone": 0}
    (logs / "a.jsonl").write_text("x\nyy\nzzz\n")
    (logs / "c.jsonl").write_text("x\n")
    assert go() == {"read": 2, "kept": 1, "gone": 0} and tables.current(spark, table).count() == 6
    (logs / "b.jsonl").unlink()
    assert go() == {"read": 0, "kept": 2, "gone": 1} and tables.current(spark, table).count() == 4
    assert go("2") == {"read": 2, "kept": 0, "gone": 0}


def run_stream(spark, tmp_path, df, make, name, mode="append"):
    df.write.parquet(str(tmp_path / name))
    s = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    q = s.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


READINGS = "account long, reset_key long, us long, line long, used double, tokens long, ts timestamp"


def later(d, by_us):
    """A reading of another key so late that the watermark passes all others."""
    return d.limit(1).withColumns({"account": F.lit(-1).cast("long"), "us": F.lit(by_us).cast("long"), "ts": F.timestamp_micros(F.lit(by_us).cast("long"))})


def test_stream_high_water_equals_batch(spark, tmp_path, rocksdb):
    d = registry.metered(spark, SF).withColumns({"tokens": F.col("input") + F.col("output"), "policy": F.lit("historical")})
    b = quota.bucket_aggregate(quota.high_water_rows(d))
    want = sorted((r.account, r.reset_key, r.bucket, r.points, r.events, r.tokens) for r in b.collect())
    rows = d.select("account", "reset_key", "us", "line", "used", "tokens", F.timestamp_micros("us").alias("ts"))
    end = d.agg(F.max("us")).first()[0] + 10 * 86_400_000_000
    out = run_stream(spark, tmp_path, rows.unionByName(later(rows, end)), streams.stream_high_water, "high")
    assert sorted(map(tuple, out)) == want


def test_shuffled_readings_of_one_key_fold_in_order(spark, tmp_path, rocksdb):
    """30,000 readings, shuffled within files that come in one micro-batch each and overlap in time."""
    r = random.Random(5)
    n, start = 30_000, 1_750_000_000_000_000
    rows = [(1, 7, start + i * 100_000, i, float(i // 300 - (3 if i % 7 == 0 else 0)) if i else 0.0, 1 + i % 3) for i in range(n)]
    high, bucket, events, tokens, want = None, 0, 0, 0, []
    for *_, used, t in rows:
        events, tokens = events + 1, tokens + t
        if high is None or used > high + 1e-9:
            want.append((1, 7, bucket, used - (high or 0.0), events, tokens))
            high, bucket, events, tokens = used, bucket + 1, 0, 0
    at = sorted(rows, key=lambda x: x[2] + r.randrange(0, 300_000_000))  # up to five minutes late
    rows_of = lambda own: spark.createDataFrame(own, READINGS.replace(", ts timestamp", "")).withColumn("ts", F.timestamp_micros("us"))
    for i in range(6):
        r.shuffle(part := at[i * 5000 : i * 5000 + 5000])
        rows_of(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    last = rows_of(rows[-1:])
    later(last, start + 20 * 86_400_000_000).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    source = spark.readStream.schema(last.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_high_water(source, "10 minutes").writeStream.format("memory").queryName("shuffled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(300)
    assert sorted(map(tuple, spark.table("shuffled").where("account = 1").collect())) == want


def test_stream_usage_and_dedup(spark, tmp_path):
    d = registry.priced(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted((str(r.d), r.model, r.n) for r in d.groupBy(F.to_date("ts").alias("d"), "model").agg(F.count("*").alias("n")).collect())
    keep = d.select("ts", "model", "input", "cached", "uncached", "output", "reasoning", "usd", "line")
    out = run_stream(spark, tmp_path, keep, streams.stream_usage, "usage", "complete")
    assert sorted((str(r.start.date()), r.model, r.requests) for r in out) == want
    twice = keep.unionByName(keep)
    assert len(run_stream(spark, tmp_path, twice, lambda s: streams.stream_dedup(s, ["line"], "60 days"), "once")) == keep.count()
    assert pricing.totals()
