from pyspark.sql import functions as F

from meterline.operators import lifecycle, timing


def test_cursor_resets_at_a_user_message(spark):
    rows = [(1, 0, 1, True, 0), (1, 2, 2, False, 10), (1, 100, 3, True, 0), (1, 102, 4, False, 10), (2, 5, 5, False, 3)]
    d = spark.createDataFrame(rows, "source long, us long, line long, boundary boolean, output long")
    got = lifecycle.cursor_intervals(d, F.col("boundary")).orderBy("line").collect()
    assert [(r.duration_us, r.first_interval) for r in got] == [(2, True), (2, True), (None, True)]


def test_cycles_lose_their_parents_only(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (8, 7)]
    got = lifecycle.reject_cycles(spark.createDataFrame(edges, "child long, parent long")).collect()
    assert {r.child: r.parent for r in got} == {1: None, 2: None, 3: None, 4: 1, 5: 4, 6: None, 8: 7}
    assert lifecycle.reject_cycles(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_conflicting_claims_are_withheld(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    claims = spark.createDataFrame([(1, 0, 9), (1, 0, 9), (1, 1, 8), (2, 1, 7), (2, 1, 6)], "node long, rank int, parent long")
    got = {r.node: (r.parent, r.issue) for r in lifecycle.resolve_identity(nodes, claims).collect()}
    assert got == {1: (9, None), 2: (None, "conflict"), 3: (None, "unresolved")}


def test_response_quality_steps(spark):
    rows = [(s, i < q, 10, 1_000_000, 1, i, 1_000_000, None) for s, n, q in ((1, 8, 4), (2, 60, 5), (3, 20, 10), (4, 30, 20)) for i in range(n)]
    d = spark.createDataFrame(rows, "source long, qualified boolean, visible long, duration_us long, messages long, response long, message_us long, ttft_us long")
    got = {r.source: r.quality for r in timing.response_performance(d, ["source"]).collect()}
    assert got == {1: "insufficient", 2: "insufficient", 3: "low", 4: "good"}
