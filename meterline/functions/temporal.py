"""Ordered and interval building blocks that most operators are made of."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.tables import cut_lineage


def carry_forward(df: DataFrame, columns: list[str], keys: list[str], order: list[str], suffix: str = "") -> DataFrame:
    """The last known value of each column, this row included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c + suffix: F.last(c, ignorenulls=True).over(w) for c in columns})


def gap_groups(df: DataFrame, keys: list[str], order: list[str], at: str, gap: int, name: str = "group_no") -> DataFrame:
    """Numbers the groups (from 0) into which rows fall where ``at`` grows by more than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


#: Length of the slices in which one key's rows are dealt to tasks.
SLICE_US = 86_400_000_000


def carried(edges: DataFrame, keys: list[str], values: dict[str, tuple[str, bool]]) -> DataFrame:
    """(_k0, ..., _cell, names): for each slice of a key the last known value of the slices before it, or after it. ``values``:
    name -> (column of ``edges``, forward). ``edges`` has a row for each slice, so these windows are small however many
    rows a key has."""
    def over(forward: bool):
        return Window.partitionBy(*keys).orderBy(F.desc("_slice") if forward else F.col("_slice")).rowsBetween(Window.unboundedPreceding, -1)

    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return edges.select(*own, F.col("_slice").alias("_cell"), *(F.last(v, ignorenulls=True).over(over(forward)).alias(n) for n, (v, forward) in values.items()))


def with_carried(d: DataFrame, c: DataFrame, keys: list[str]) -> DataFrame:
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_slice") == F.col("_cell"))
    return d.join(c, on, "left")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], order: list[str], strict: bool = False, forward: bool = False, span: int = SLICE_US) -> DataFrame:
    """``left`` with the ``values`` of the nearest row of ``right`` before (or after, ``forward``) its ``at``; at equal
    ``at`` too, unless ``strict``; equal rows of ``right`` by ``order``.

    Rows are dealt by key and slice of ``span``, so a key's history goes to as many tasks as it has slices. In each slice
    one union and one window find the row; where a slice has none yet, it is the last one of the slices before, of which
    a row for each slice is carried on. No pairs, no row in more than one slice; the windowed rows are written once, and
    both what is carried and what is found is read from them."""
    side = F.lit(0 if strict else 1)
    cell = F.floor(F.col(at) / span).alias("_slice")
    held = F.struct(*(F.col(v) for v in values))
    tie = lambda known: F.struct(*((F.col(c) if known else F.lit(None).cast(right.schema[c].dataType)).alias(c) for c in order)).alias("_tie")
    r = right.select(*keys, F.col(at), held.alias("_held"), F.lit(None).cast(left.schema).alias("_left"), (1 - side).alias("_side"), tie(True), cell)
    row = F.struct(*(F.col(c) for c in left.columns))
    lft = left.select(*keys, F.col(at), F.lit(None).cast(r.schema["_held"].dataType).alias("_held"), row.alias("_left"), side.alias("_side"), tie(False), cell)
    turn = (lambda c: F.col(c).desc()) if forward else F.col
    w = Window.partitionBy(*keys, "_slice").orderBy(turn(at), "_side", turn("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    both = cut_lineage(r.unionByName(lft).withColumn("_found", F.last("_held", ignorenulls=True).over(w)))
    known = F.when(F.col("_held").isNotNull(), F.struct(F.col(at), F.col("_tie")))
    edges = both.groupBy(*keys, "_slice").agg((F.min_by if forward else F.max_by)("_held", known).alias("_edge"))
    d = with_carried(both.where("_left is not null"), carried(edges, keys, {"_carry": ("_edge", forward)}), keys)
    d = d.select("_left", F.coalesce("_found", "_carry").alias("_found"))
    return d.select("_left.*", *(F.col("_found")[v].alias(v) for v in values))


def with_previous(df: DataFrame, keys: list[str], at: str, name: str, span: int = SLICE_US) -> DataFrame:
    """``df`` (``at`` differs within a key) with ``name``: the ``at`` of the row before; dealt by key and slice as ``asof``."""
    d = df.withColumn("_slice", F.floor(F.col(at) / span))
    d = cut_lineage(d.withColumn(name, F.lag(at).over(Window.partitionBy(*keys, "_slice").orderBy(at))))
    c = carried(d.groupBy(*keys, "_slice").agg(F.max(at).alias("_edge")), keys, {"_carry": ("_edge", False)})
    return with_carried(d, c, keys).select(*df.columns, F.coalesce(name, "_carry").alias(name))


def neighbours(points: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, order: list[str], equal_is_before: bool = False, span: int = SLICE_US) -> DataFrame:
    """``points`` with ``before`` and ``after``: the ``value`` of the nearest rows of ``right`` on both sides of its ``at``; a
    row at equal ``at`` is the one after (or before, ``equal_is_before``). Dealt by key and slice as ``asof``."""
    side, cell = F.lit(1 if equal_is_before else 0), F.floor(F.col(at) / span).alias("_slice")
    kind = right.schema[value].dataType
    tie = lambda known: F.struct(*((F.col(c) if known else F.lit(None).cast(right.schema[c].dataType)).alias(c) for c in order)).alias("_tie")
    r = right.select(*keys, F.col(at), F.col(value).alias("_held"), F.lit(None).cast(points.schema).alias("_left"), (1 - side).alias("_side"), tie(True), cell)
    p = points.select(*keys, F.col(at), F.lit(None).cast(kind).alias("_held"), F.struct(*(F.col(c) for c in points.columns)).alias("_left"), side.alias("_side"), tie(False), cell)
    # backwards over the reverse order, too: a frame that ends unbounded is run through again for each row
    own = Window.partitionBy(*keys, "_slice")
    up, down = own.orderBy(at, "_side", "_tie"), own.orderBy(F.desc(at), F.desc("_side"), F.desc("_tie"))
    sides = {n: F.last("_held", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n, w in (("_b", up), ("_a", down))}
    both = cut_lineage(r.unionByName(p).withColumns(sides))
    known = F.when(F.col("_held").isNotNull(), F.struct(F.col(at), F.col("_tie")))
    edges = both.groupBy(*keys, "_slice").agg(F.max_by("_held", known).alias("_last"), F.min_by("_held", known).alias("_first"))
    c = carried(edges, keys, {"_cb": ("_last", False), "_ca": ("_first", True)})
    d = with_carried(both.where("_left is not null"), c, keys)
    return d.select("_left.*", F.coalesce("_b", "_cb").alias("before"), F.coalesce("_a", "_ca").alias("after"))


def interval_union(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merges intervals that touch or overlap; empty ones are dropped."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.where(F.col(end) > F.col(start)).withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    d = d.withColumn("_island", F.sum("_new").over(w))
    return d.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def sweep(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, at, until, alive): the stretches between interval ends and how many half-open intervals hold them."""
    d = df.where(F.col(end) > F.col(start))
    d = d.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    d = d.groupBy(*keys, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at")
    return d.select(*keys, "at", F.lead("at").over(w).alias("until"), F.sum("d").over(w).alias("alive")).where("until is not null")


def interval_subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of the union of ``a`` outside the union of ``b`` (start, end)."""
    def ends(df: DataFrame, which: str) -> DataFrame:
        d = interval_union(df, keys)
        return d.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(*keys, "x.at", *((F.col("x.d") if c == which else F.lit(0)).alias(c) for c in ("a", "b")))

    d = ends(a, "a").unionByName(ends(b, "b")).groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*keys).orderBy("at")
    d = d.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
    return interval_union(d.where("a > 0 and b = 0").drop("a", "b"), keys)


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float], eps: float = 1e-9) -> DataFrame:
    """Lower weighted quantiles: the least value whose cumulative weight, and ``eps``, reaches q of the whole."""
    w = Window.partitionBy(*keys)
    up = w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    d = df.where((F.col(weight) > 0) & F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.sum(weight).over(up).alias("_c"), F.sum(weight).over(w).alias("_t"))
    return d.groupBy(*keys).agg(*(F.min(F.when(F.col("_c") + eps >= q * F.col("_t"), F.col("_v"))).alias(n) for n, q in qs.items()))


def share(part: Column, whole: Column) -> Column:
    """part / whole; null where there is nothing to share."""
    return F.when(whole > 0, part / whole)
