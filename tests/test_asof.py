"""As-of joins, neighbours and gaps by key and time slice, against plain loops."""

import random

import pytest

from meterline.functions import temporal

NONE = (None, None)


def made(seed, keys, n, most):
    r = random.Random(seed)
    left = [(r.choice(keys), r.randrange(most), i) for i in range(n)]
    right = [(r.choice(keys), r.randrange(most), i % 3, f"v{i}") for i in range(n)]
    return left, right


@pytest.fixture(params=[(1, 50), (10, 10_000), (1_000_000, 50)])
def case(request, spark):
    """One key with nearly all rows among others and null, over many slices or one."""
    span, most = request.param
    left, right = made(3, ["hot"] * 8 + ["a", None], 120, most)
    return span, left, right, spark.createDataFrame(left, "key string, us long, id long"), spark.createDataFrame(right, "key string, us long, line long, v string")


def test_asof(case):
    span, left, right, a, b = case
    for strict in (False, True):
        for forward in (False, True):
            got = {r.id: r.v for r in temporal.asof(a, b, ["key"], "us", ["v"], ["line", "v"], strict, forward, span).collect()}
            for key, at, i in left:
                fits = [(us, line, v) for k, us, line, v in right if k == key and ((us > at if strict else us >= at) if forward else (us < at if strict else us <= at))]
                want = (min(fits) if forward else max(fits))[2] if fits else None
                assert got[i] == want


def test_neighbours(case):
    span, left, right, a, b = case
    for equal in (False, True):
        got = {r.id: (r.before, r.after) for r in temporal.neighbours(a, b, ["key"], "us", "v", ["line", "v"], equal, span).collect()}
        for key, at, i in left:
            own = sorted((us, line, v) for k, us, line, v in right if k == key)
            before, after = [x for x in own if x[0] < at or (equal and x[0] == at)], [x for x in own if x[0] > at or (not equal and x[0] == at)]
            assert got[i] == (before[-1][2] if before else None, after[0][2] if after else None)


def test_rows_before(case, spark):
    span, left, *_ = case
    own = sorted({(k or "", us) for k, us, _ in left})
    d = spark.createDataFrame([(k or None, us) for k, us in own], "key string, us long")
    got = {(r.key or "", r.us): r.prev for r in temporal.with_previous(d, ["key"], "us", "prev", span).collect()}
    for i, (k, us) in enumerate(own):
        assert got[k, us] == (own[i - 1][1] if i and own[i - 1][0] == k else None)


def test_one_key_goes_to_many_tasks(spark):
    n = 20_000
    d = spark.range(n).selectExpr("'one' as key", "id * 60000000 as us", "id as line", "cast(id as string) as v")
    points = spark.range(n).selectExpr("'one' as key", "id * 60000000 + 5 as us", "id")
    out = temporal.asof(points, d, ["key"], "us", ["v"], ["line"])
    assert out.where("v <> cast(id as string)").isEmpty() and out.count() == n
    # fourteen days: no slice holds more than a day's rows
    assert d.groupBy((d.us / temporal.SLICE_US).cast("long")).count().agg({"count": "max"}).first()[0] <= 1440
