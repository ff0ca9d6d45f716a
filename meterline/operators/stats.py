"""Grouped statistics: resampling with reproducible draws, non-negative fits, change points."""

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.tables import cut_lineage
from meterline.functions.temporal import share


#: Draws of each interval, as the contract has them: of whole units, and of fits.
DRAWS, FIT_DRAWS = 1000, 200
#: A 16-bit number is this many times at or over the steps of the Poisson distribution of mean 1: how often a unit is drawn.
STEPS = tuple(round(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))


def multiplicities(boots: int, seed: str, ids: list[str]) -> Column:
    """How often each of ``boots`` draws takes a unit, as one array, from md5 of the seed and the unit's ``ids`` alone: the
    same on any engine and in any task. Each draw takes a unit a Poisson number of times (mean 1), the form of drawing
    with replacement that needs no look at other units, so no join and no row for a pick."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]

    def of(word: Column) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(seed), word.cast("string"), *known).cast("binary"))
        u = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.conv(F.substring(h, 4 * j + 1, F.lit(4)), 16, 10).cast("int"))
        return F.transform(u, lambda v: reduce(lambda x, y: x + y, ((v >= t).cast("int") for t in STEPS)))

    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-boots // 8) - 1)), of)), 1, boots)


def drawn(units: DataFrame, boots: int, seed: str, ids: list[str]) -> DataFrame:
    """``units`` once for each draw (``rep``) that takes them, ``times`` over. The rows live within the stage: what follows
    sums them up by draw before anything is shuffled. Units are few bytes but each takes all the draws' work, so they are
    dealt to as many tasks as the session has shuffle partitions: by their bytes they would be read by one or two."""
    d = units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ids).select("*", F.posexplode(multiplicities(boots, seed, ids)).alias("rep", "times"))
    return d.where("times > 0")


def ratio_bootstrap(units: DataFrame, keys: list[str], num: str, den: str, ids: list[str], boots: int = DRAWS, level: float = 0.8, seed: str = "b") -> DataFrame:
    """Ratio of sums with a percentile interval from whole units (told apart by ``ids``) drawn again; no interval below two."""
    point = units.groupBy(*keys).agg(F.count("*").alias("units"), (F.sum(num) / F.sum(den)).alias("estimate"))
    per = drawn(units, boots, seed, [*keys, *ids]).groupBy(*keys, "rep").agg((F.sum(F.col(num) * F.col("times")) / F.sum(F.col(den) * F.col("times"))).alias("r"))
    tail = (1 - level) / 2
    span = per.groupBy(*keys).agg(F.percentile("r", F.lit(tail)).alias("low"), F.percentile("r", F.lit(1 - tail)).alias("high"))
    many = lambda c: F.when(F.col("units") > 1, F.col(c)).alias(c)
    return point.join(span, keys, "left").select(*keys, "units", "estimate", many("low"), many("high"))


def determinant(m: list[list[Column]]) -> Column:
    """Of a square matrix of columns, by its first row."""
    if len(m) == 1:
        return m[0][0]
    parts = [m[0][j] * determinant([row[:j] + row[j + 1 :] for row in m[1:]]) * (-1) ** j for j in range(len(m))]
    return sum(parts[1:], parts[0])


def gram_sums(features: list[str], y: str) -> list[Column]:
    """Aggregate columns g_i_j (i <= j), h_i, s_i and y: the sums of products that fits and predictions need."""
    n = range(len(features))
    pairs = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"g_{i}_{j}") for i in n for j in n if i <= j]
    return [*pairs, *(F.sum(F.col(features[i]) * F.col(y)).alias(f"h_{i}") for i in n), *(F.sum(features[i]).alias(f"s_{i}") for i in n), F.sum(y).alias("y")]


def sum_names(n: int) -> list[str]:
    return [*(f"g_{i}_{j}" for i in range(n) for j in range(n) if i <= j), *(f"h_{i}" for i in range(n)), *(f"s_{i}" for i in range(n)), "y"]


def non_negative(n: int, eps: float = 1e-12) -> list[Column]:
    """The coefficients of non-negative least squares without intercept from the sums of ``gram_sums``: of the least
    squares solutions of all sets of features without a negative coefficient the one that explains most (that is the
    exact optimum: it is the free solution of its own features). Features that are all zero get zero. Of two features, one
    alone is judged by h * h / g without rounding, the form that the queries' SQL has: on one row both explain the same,
    and only the same steps take the same one."""
    g = lambda i, j: F.col(f"g_{min(i, j)}_{max(i, j)}")
    ways = {}
    for k in range(1, n + 1):
        for own in combinations(range(n), k):
            det = determinant([[g(i, j) for j in own] for i in own])
            scale = reduce(lambda x, y: x * y, (g(i, i) for i in own))
            beta = {}
            for c, i in enumerate(own):
                swapped = [[F.col(f"h_{r}") if c == d else g(r, q) for d, q in enumerate(own)] for r in own]
                beta[i] = F.when(det > eps * scale, determinant(swapped) / det)
            fits = reduce(lambda x, y: x & y, (F.coalesce(b >= 0, F.lit(False)) for b in beta.values()))
            gain = F.round(sum((b * F.col(f"h_{i}") for i, b in beta.items()), F.lit(0.0)), 9)
            if n == 2:  # only one alone against the other: as it is, the first where equal
                gain = F.when(det > 0, F.col(f"h_{own[0]}") * F.col(f"h_{own[0]}") / det) if k == 1 else F.lit(math.inf)
            cells = [beta.get(i, F.lit(0.0)).alias(f"b{i}") for i in range(n)]
            ways[own] = fits, F.struct(gain.alias("gain"), F.lit(-k).alias("few"), *cells)
    # a set that fits explains no less than the sets within it, so these never compete with it: rounding would decide
    beaten = lambda own: reduce(lambda x, y: x | y, (f for o, (f, _) in ways.items() if set(own) < set(o)), F.lit(False))
    ways = [F.when(fits & ~beaten(own), way) for own, (fits, way) in ways.items()]
    best = F.array_max(F.array_compact(F.array(*ways)))
    return [F.coalesce(best[f"b{i}"], F.lit(0.0)) for i in range(n)]


def condition(n: int) -> Column:
    """Of the Gram matrix of the features scaled to length 1: the root of the greatest over the least eigenvalue; null
    where the least is none. One to three features, in closed form."""
    if n == 1:
        return F.lit(1.0)
    r = lambda i, j: F.col(f"g_{i}_{j}") / F.sqrt(F.col(f"g_{i}_{i}") * F.col(f"g_{j}_{j}"))
    if n == 2:
        low, high = 1 - F.abs(r(0, 1)), 1 + F.abs(r(0, 1))
    else:
        a, b, c = r(0, 1), r(0, 2), r(1, 2)
        p = F.sqrt((a * a + b * b + c * c) / 3)
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(a * b * c, p * p * p)))) / 3
        high, low = 1 + 2 * p * F.cos(angle), 1 + 2 * p * F.cos(angle + 2 * math.pi / 3)
        low, high = F.when(p > 0, low).otherwise(1.0), F.when(p > 0, high).otherwise(1.0)
    return F.when(low > 1e-10, F.sqrt(high / low))


def weight_fit(df: DataFrame, keys: list[str], features: list[str], y: str) -> DataFrame:
    """Non-negative least squares of ``y`` on one to three features, for each group: rows, ``weight_0`` and so on, and
    the ``condition`` of the features."""
    s = df.groupBy(*keys).agg(*gram_sums(features, y), F.count("*").alias("n"))
    n = len(features)
    return s.select(*keys, "n", *(b.alias(f"weight_{i}") for i, b in enumerate(non_negative(n))), condition(n).alias("condition"))


def by_episode(df: DataFrame, keys: list[str], episode: str, features: list[str], y: str) -> DataFrame:
    """Sums of each episode of each group (a few hundred an account at most), numbered from 0."""
    e = df.groupBy(*keys, episode).agg(*gram_sums(features, y))
    by = Window.partitionBy(*keys)
    return e.withColumn("_i", F.row_number().over(by.orderBy(episode)) - 1).withColumn("_n", F.count("*").over(by))


def episode_cv(episodes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Held-out error of the fit on whole episodes (of ``by_episode``): each alone up to 12, else five folds in turn.
    ``cv_wape``: absolute errors over actual sums; ``cv_bias``: errors over them; null below three episodes.

    A fold's training sums are the group's sums less its own, so nothing is fitted again row by row."""
    names = sum_names(n)
    e = episodes.where("_n >= 3").withColumn("_fold", F.when(F.col("_n") <= 12, F.col("_i")).otherwise(F.col("_i") % 5))
    fold = e.groupBy(*keys, "_fold").agg(*(F.sum(c).alias(c) for c in names))
    every = Window.partitionBy(*keys)
    train = fold.withColumns({c: F.sum(c).over(every) - F.col(c) for c in names})
    beta = train.select(*keys, "_fold", *(b.alias(f"_b{i}") for i, b in enumerate(non_negative(n))))
    j = e.join(beta, [*keys, "_fold"])
    off = sum((F.col(f"_b{i}") * F.col(f"s_{i}") for i in range(n)), F.lit(0.0)) - F.col("y")
    out = j.groupBy(*keys).agg(F.sum(F.abs(off)).alias("_a"), F.sum(off).alias("_s"), F.sum("y").alias("_y"))
    return out.select(*keys, share(F.col("_a"), F.col("_y")).alias("cv_wape"), F.when(F.col("_y") > 0, F.col("_s") / F.col("_y")).alias("cv_bias"))


def bootstrap_fit(episodes: DataFrame, keys: list[str], episode: str, n: int, boots: int = FIT_DRAWS, level: float = 0.8, seed: str = "f") -> DataFrame:
    """Fits on episodes drawn again with replacement: for each further coefficient its ratio to the first one
    (``ratio_low_i``, ``ratio_mid_i``, ``ratio_high_i``), in what share of the draws there is one (``valid_i``), the same of
    the coefficient itself (``weight_low_i`` and so on), and in what share it is over 0 (``positive_i``)."""
    names = sum_names(n)
    d = drawn(episodes.select(*keys, episode, *names), boots, seed, [*keys, episode])
    per = d.groupBy(*keys, "rep").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in names))
    beta = per.select(*keys, *(b.alias(f"_b{i}") for i, b in enumerate(non_negative(n))))
    tail, out = (1 - level) / 2, []
    for i in range(1, n):
        ratio = F.when(F.col("_b0") > 1e-10, F.col(f"_b{i}") / F.col("_b0"))
        out += [F.percentile(ratio, F.lit(q)).alias(f"ratio_{name}_{i}") for name, q in (("low", tail), ("mid", 0.5), ("high", 1 - tail))]
        out.append((F.count(ratio) / F.count("*")).alias(f"valid_{i}"))
        out += [F.percentile(f"_b{i}", F.lit(q)).alias(f"weight_{name}_{i}") for name, q in (("low", tail), ("mid", 0.5), ("high", 1 - tail))]
        out.append((F.count_if(F.col(f"_b{i}") > 1e-9) / F.count("*")).alias(f"positive_{i}"))
    return beta.groupBy(*keys).agg(F.count("*").alias("boots"), *out)


def fit_candidate(df: DataFrame, keys: list[str], episode: str, features: list[str], y: str, boots: int = FIT_DRAWS, most_condition: float = 50.0, most_wape: float = 0.4) -> DataFrame:
    """A fit with its evidence, and ``status``: not identifiable (collinear, under three episodes, or ratios that draws
    don't support: missing in over a fifth, at the boundary, or spanning more than ten times), weak (held-out error), or
    supported."""
    n = len(features)
    episodes = cut_lineage(by_episode(df, keys, episode, features, y))
    d = weight_fit(df, keys, features, y).join(episode_cv(episodes, keys, n), keys, "left")
    d = d.join(bootstrap_fit(episodes, keys, episode, n, boots), keys, "left")
    unstable = F.lit(False)
    for i in range(1, n):
        low, high = F.col(f"ratio_low_{i}"), F.col(f"ratio_high_{i}")
        unstable = unstable | F.coalesce((F.col(f"valid_{i}") < 0.8) | low.isNull() | ((low <= 0) & (high > 0)) | ((low > 0) & (high / low > 10)), F.lit(True))
    collinear = F.col("condition").isNull() | (F.col("condition") > most_condition)
    status = F.when(collinear | F.col("cv_wape").isNull(), "not identifiable").when(F.col("cv_wape") > most_wape, "weak").when(unstable, "not identifiable").otherwise("supported")
    return d.withColumn("status", status)


def choose_fit(fits: DataFrame, keys: list[str], tolerance: float = 0.03) -> DataFrame:
    """Of the supported fits (else the weak ones) of each group (name, complexity, cv_wape, status) the simplest within
    ``tolerance`` of the least held-out error; ties: the least error, then the name."""
    good = fits.where(F.col("status").isin("supported", "weak") & F.col("cv_wape").isNotNull())
    by = Window.partitionBy(*keys)
    good = good.withColumn("_rank", F.when(F.col("status") == "supported", 0).otherwise(1)).withColumn("_top", F.min("_rank").over(by)).where("_rank = _top")
    near = good.withColumn("_least", F.min("cv_wape").over(by)).where(F.col("cv_wape") <= F.col("_least") + tolerance)
    n = F.row_number().over(by.orderBy("complexity", "cv_wape", "name"))
    return near.withColumn("_n", n).where("_n = 1").drop("_n", "_rank", "_top", "_least")


def best_split(df: DataFrame, keys: list[str], order: list[str], x: str, w: str, least: int = 3, least_weight: float = 0.0, gain: float = 0.0, ratio: float = 1.0) -> DataFrame:
    """Of the cuts of each group's ordered values that leave enough rows and weight on both sides, part the levels by
    ``ratio`` and lower the weighted squared error by ``gain``, the one with the greatest gain x log of the ratio
    (earliest on ties). Prefix sums give every cut's error in one window. ``x`` is a logarithm."""
    by = Window.partitionBy(*keys)
    up = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.select(*keys, F.row_number().over(by.orderBy(*order)).alias("i"), F.count("*").over(by).alias("n"), *(F.sum(e).over(v).alias(m) for m, e, v in (
        ("w1", F.col(w), up), ("s1", F.col(w) * F.col(x), up), ("q1", F.col(w) * F.col(x) ** 2, up), ("w0", F.col(w), by), ("s0", F.col(w) * F.col(x), by), ("q0", F.col(w) * F.col(x) ** 2, by))))
    sse = lambda a, s, q: q - s * s / a
    whole = sse(F.col("w0"), F.col("s0"), F.col("q0"))
    cut = sse(F.col("w1"), F.col("s1"), F.col("q1")) + sse(F.col("w0") - F.col("w1"), F.col("s0") - F.col("s1"), F.col("q0") - F.col("q1"))
    apart = F.exp(F.abs(F.col("s1") / F.col("w1") - (F.col("s0") - F.col("s1")) / (F.col("w0") - F.col("w1"))))
    c = d.where((F.col("i") >= least) & (F.col("n") - F.col("i") >= least) & (F.col("w1") >= least_weight) & (F.col("w0") - F.col("w1") >= least_weight))
    c = c.withColumn("gain", F.round(F.greatest(F.lit(0.0), 1 - cut / whole), 9)).withColumn("ratio", F.round(apart, 9)).where(whole > 1e-9)
    c = c.where((F.col("gain") >= gain) & (F.col("ratio") >= ratio)).withColumn("score", F.round(F.col("gain") * F.log(F.greatest("ratio", F.lit(1.000001))), 9))
    best = F.max_by(F.struct("i", "gain", "ratio"), F.struct("score", -F.col("i")))
    return c.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.i").alias("cut_after"), "b.gain", "b.ratio")


def detect_regimes(df: DataFrame, keys: list[str], order: list[str], x: str, w: str, least: int = 3, least_weight: float = 0.0, gain: float = 0.45, ratio: float = 1.3) -> DataFrame:
    """``regime``: segments of ``best_split`` applied again and again while a cut passes. One pass for each level, over
    all segments at once; it ends when no segment splits, after as many levels as cuts lie within each other."""
    d = cut_lineage(df.withColumn("_seg", F.lit(0).cast("long")))
    while True:
        cuts = cut_lineage(best_split(d, [*keys, "_seg"], order, x, w, least, least_weight, gain, ratio))
        if cuts.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order))
        d = d.withColumn("_i", place).join(cuts.select(*keys, "_seg", "cut_after"), [*keys, "_seg"], "left")
        # a segment's number is the place of its first row in its group
        d = cut_lineage(d.withColumn("_seg", F.when(F.col("_i") > F.col("cut_after"), F.col("_seg") + F.col("cut_after")).otherwise(F.col("_seg"))).drop("_i", "cut_after"))
    return d.withColumn("regime", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_seg"))).drop("_seg")


def regime_at(df: DataFrame, regimes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``df`` with the lowest ``regime`` (keys, regime, start_us, end_us: closed) that holds ``at``; none: null. A group
    has a few regimes, so they come as one array."""
    spans = regimes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("regime", "start_us", "end_us"))).alias("_r"))
    held = F.filter("_r", lambda r: (r["start_us"] <= F.col(at)) & (F.col(at) <= r["end_us"]))
    return df.join(spans, keys, "left").withColumn("regime", F.get(held, F.lit(0))["regime"]).drop("_r")
