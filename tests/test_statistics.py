import random

import numpy as np

from meterline.operators import graph, stats

FEATURES = ["a", "b", "c"]


def fitted(rows, n):
    """Non-negative least squares by trying all sets of features."""
    x, y = np.array([r[2 : 2 + n] for r in rows]), np.array([r[5] for r in rows])
    best, out = -1.0, np.zeros(n)
    for mask in range(1, 1 << n):
        own = [i for i in range(n) if mask >> i & 1]
        beta = np.linalg.lstsq(x[:, own], y, rcond=None)[0]
        if (beta >= 0).all():
            gain = float((x[:, own] @ beta) @ y)
            if gain > best + 1e-9:
                best, out = gain, np.zeros(n)
                out[own] = beta
    return out


def test_fits_against_numpy(spark):
    r = random.Random(1)
    rows = []
    for g in range(6):
        w = [r.choice([0.0, 0.5, 2.0]), r.choice([0.0, 1.0]), r.choice([-1.0, 1.5])]
        for e in range(14 if g % 2 else 5):
            for _ in range(r.randint(1, 4)):
                x = [r.random() for _ in range(3)]
                rows.append((g, e, *x, max(0.01, sum(a * b for a, b in zip(w, x, strict=True)) + r.gauss(0, 0.1))))
    df = spark.createDataFrame(rows, "g long, episode long, a double, b double, c double, y double")
    for n in (1, 2, 3):
        fit = {x.g: x for x in stats.weight_fit(df, ["g"], FEATURES[:n], "y").collect()}
        episodes = stats.by_episode(df, ["g"], "episode", FEATURES[:n], "y")
        cv = {x.g: x for x in stats.episode_cv(episodes, ["g"], n).collect()}
        for g in range(6):
            own = [x for x in rows if x[0] == g]
            assert np.allclose([fit[g][f"weight_{i}"] for i in range(n)], fitted(own, n), atol=1e-6)
            x = np.array([x[2 : 2 + n] for x in own])
            x = x / np.linalg.norm(x, axis=0)
            eig = np.linalg.eigvalsh(x.T @ x)
            assert abs(fit[g].condition - np.sqrt(eig[-1] / eig[0])) < 1e-6
            ids = sorted({x[1] for x in own})
            folds = [[i] for i in ids] if len(ids) <= 12 else [ids[k::5] for k in range(5)]
            off = total = 0.0
            for held in folds:
                beta = fitted([x for x in own if x[1] not in held], n)
                for i in held:
                    mine = [x for x in own if x[1] == i]
                    actual = sum(x[5] for x in mine)
                    off += abs(sum(np.dot(beta, x[2 : 2 + n]) for x in mine) - actual)
                    total += actual
            assert abs(cv[g].cv_wape - off / total) < 1e-6


def test_choice_of_fits(spark):
    rows = [(1, "total", 1, 0.12, "supported"), (1, "io", 2, 0.10, "supported"), (1, "full", 3, 0.01, "weak"), (2, "total", 1, 0.5, "weak"), (2, "io", 2, 0.41, "weak"), (3, "io", 2, None, "supported")]
    d = spark.createDataFrame(rows, "g long, name string, complexity int, cv_wape double, status string")
    assert {r.g: r.name for r in stats.choose_fit(d, ["g"]).collect()} == {1: "total", 2: "io"}


def test_regime_of_a_time(spark):
    spans = spark.createDataFrame([("m", 1, 0, 10), ("m", 2, 10, 20)], "model string, regime int, start_us long, end_us long")
    d = spark.createDataFrame([("m", 10), ("m", 11), ("m", 21), ("n", 5)], "model string, us long")
    out = {(r.model, r.us): r.regime for r in stats.regime_at(d, spans, ["model"], "us").collect()}
    assert out == {("m", 10): 1, ("m", 11): 2, ("m", 21): None, ("n", 5): None}


def test_regimes_split_below_eight_levels(spark):
    """Twelve steps of growing height: a cut parts off the last one, so levels lie within each other."""
    rows = [(1, 3 * s + k, 1.7**s / 100, 5.0) for s in range(12) for k in range(3)]
    d = spark.createDataFrame(rows, "g long, i long, x double, w double")
    out = {r.i: r.regime for r in stats.detect_regimes(d, ["g"], ["i"], "x", "w", gain=0.01, ratio=1.001).collect()}
    assert [out[i] for i in range(36)] == [s + 1 for s in range(12) for _ in range(3)]


def test_ancestors_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 1000)], "child long, parent long")
    c = graph.ancestors(edges)
    per = {r.node: r["count"] for r in c.groupBy("node").count().collect()}
    assert per == {i: i + 1 for i in range(1000)} and c.where("node - ancestor <> depth").isEmpty()
    loop = spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long")
    try:
        graph.ancestors(loop)
    except ValueError:
        return
    raise AssertionError("a cycle must be an error")


def test_nearest_assignment(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (6, 5)], "child long, parent long")
    a = spark.createDataFrame([(1, "u", False), (3, "v", True)], "node long, unit string, conflict boolean")
    out = {r.node: (r.unit, r.inherited_from) for r in graph.nearest_assignment(graph.ancestors(edges), a).collect()}
    assert out == {1: ("u", 0), 2: ("u", 1), 3: (None, 0), 4: (None, 1)}


def test_families_with_cycles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (7, 8), (8, 9), (9, 7), (10, 9)], "child long, parent long")
    out = {r.child: (r.root, r.cyclic) for r in graph.families(edges).collect()}
    assert out[2] == (1, False) and out[3] == (1, False) and all(out[i] == (7, True) for i in (7, 8, 9, 10))


def test_draws_are_poisson_and_the_same_anywhere(spark):
    d = spark.range(300).selectExpr("id", "id % 3 as g", "1.0 as x")
    rows = d.select("id", stats.multiplicities(1000, "b", ["g", "id"]).alias("m")).collect()
    m = np.array([r.m for r in rows])
    assert m.shape == (300, 1000) and abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.02
    assert abs((m == 0).mean() - np.exp(-1)) < 0.005 and abs(np.corrcoef(m[0], m[1])[0, 1]) < 0.12
    again = {r.id: r.m for r in d.repartition(7).select("id", stats.multiplicities(1000, "b", ["g", "id"]).alias("m")).collect()}
    assert all(again[r.id] == r.m for r in rows)


def test_interval_of_a_ratio(spark):
    """Against drawing whole units with replacement in numpy."""
    r = np.random.default_rng(1)
    num, den = r.gamma(2.0, 3.0, 80), r.gamma(3.0, 1.0, 80)
    d = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(num, den))] + [(2, 0, 5.0, 2.0)], "g long, i long, a double, b double")
    out = {x.g: x for x in stats.ratio_bootstrap(d, ["g"], "a", "b", ["i"]).collect()}
    pick = r.integers(0, 80, (4000, 80))
    low, high = np.quantile(num[pick].sum(1) / den[pick].sum(1), [0.1, 0.9])
    assert abs(out[1].low - low) < 0.08 * (high - low) + 0.02 and abs(out[1].high - high) < 0.08 * (high - low) + 0.02
    assert (out[2].estimate, out[2].low, out[2].units) == (2.5, None, 1)


def test_edges_of_a_widely_shared_id_stay_few(spark):
    """3,000 sessions an hour apart share one id: only those within six hours of each other meet."""
    s = spark.range(3000).selectExpr("id as session", "id * 3600000000 as first_us", "id > 0 as subagent")
    links = s.selectExpr("session", "'one' as fp", "false as is_parent")
    e = graph.build_edges(s, links).collect()
    assert len(e) == 2999 and all(x.parent == x.child - 1 and x.method == "shared" for x in e)
    up = spark.createDataFrame([(5, "own", True), (7, "own", False), (9, "own", False)], "session long, fp string, is_parent boolean")
    (x,) = graph.build_edges(s, up).where("child = 5").collect()
    assert (x.parent, x.method, x.confidence) == (7, "explicit", "ambiguous")
