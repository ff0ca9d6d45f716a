from meterline.operators import timing

FIELDS = "source long, line long, us long, model string, effort string, kind string, turn string, call_id string, start_us long, end_us long, output long, reasoning long, response_level boolean, ttft_us long, duration_us long"
S = 1_000_000


def rec(line, at, kind, turn="t", **more):
    d = dict.fromkeys(("model", "effort", "call_id", "start_us", "end_us", "output", "reasoning", "response_level", "ttft_us", "duration_us"))
    return {"source": 1, "line": line, "us": at * S, "kind": kind, "turn": turn, **d, **more}


def frame(spark, records):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in records], FIELDS)


def test_task_of_twelve_seconds_with_a_tool_span(spark):
    """12 s, one 5 s tool span, outputs 20 (5 of them reasoning) and 30 (10): 7 s and 35 tokens remain."""
    r = [
        rec(1, 100, "start", model="m", effort="low"), rec(2, 102, "reasoning", start_us=100 * S, end_us=101_500_000), rec(3, 103, "call", call_id="c"), rec(4, 103, "usage", output=20, reasoning=5, response_level=True),
        rec(5, 108, "result", call_id="c", turn=None), rec(6, 110, "message", start_us=109 * S, end_us=110 * S), rec(7, 111, "usage", output=30, reasoning=10, response_level=True), rec(8, 112, "complete", ttft_us=S, duration_us=12 * S),
    ]
    d = frame(spark, r)
    t = timing.tool_excluded(*timing.assemble_tasks(d)).collect()[0]
    assert (t.reason, t.elapsed_us, t.tool_us, t.active_us) == ("qualified_task", 12 * S, 5 * S, 7 * S)
    assert (t.nonreasoning, t.reasoning_us, t.message_us, t.rest_us) == (35, 1_500_000, S, 4_500_000)
    whole = timing.tool_excluded_by(timing.tool_excluded(*timing.assemble_tasks(d))).where("level = 'all'").collect()[0]
    assert whole.quality == "exact" and whole.output_per_s == 5.0
    first, second = timing.assemble_responses(d).orderBy("response").collect()
    assert (first.reason, first.ttft_us, first.duration_us) == ("missing_agent_message_timing", S, 12 * S)
    assert (second.reason, second.visible, second.message_us, second.ttft_us) == ("timed_visible_response", 20, S, None)


def test_broken_pairs_and_borders(spark):
    r = [rec(1, 1, "start"), rec(2, 2, "call", call_id="c"), rec(3, 3, "usage", output=1, reasoning=0, response_level=True), rec(4, 9, "complete")]
    assert [x.reason for x in timing.tool_excluded(*timing.assemble_tasks(frame(spark, r))).collect()] == ["incomplete_tool_pairing"]
    assert [x.reason for x in timing.tool_excluded(*timing.assemble_tasks(frame(spark, r), after=2 * S)).collect()] == ["started_before_window"]
    assert [x.reason for x in timing.tool_excluded(*timing.assemble_tasks(frame(spark, r), before=9 * S)).collect()] == ["completed_after_window"]


def test_mixed_output_is_not_timed(spark):
    r = [rec(1, 1, "message", start_us=0, end_us=S), rec(2, 2, "call", call_id="c", turn=None), rec(3, 3, "usage", output=9, reasoning=0, response_level=True), rec(4, 4, "message", start_us=3 * S, end_us=4 * S), rec(5, 5, "usage", output=9, reasoning=0, response_level=False)]
    out = timing.assemble_responses(frame(spark, r)).orderBy("response").collect()
    assert [x.reason for x in out] == ["mixed_visible_and_tool_output", "missing_response_level_usage"]
