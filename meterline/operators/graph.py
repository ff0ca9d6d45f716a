"""Session families: edges, components of a parent forest, ancestors, subtree totals."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from meterline.functions.tables import cut_lineage


#: Sessions that meet as many others in one task.
BLOCK = 4096
#: Ids that two blocks share are counted this many at a time.
WIDE = 2048


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """How many of ``ids`` (sorted) each list of one block shares with each of the other: (offsets, ids) both."""
    def table(offsets, values, part):
        i = np.searchsorted(part, values)
        ok = part[np.minimum(i, len(part) - 1)] == values
        t = np.zeros((len(offsets) - 1, len(part)), np.float32)
        t[np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[ok], i[ok]] = 1
        return t

    out = np.zeros((len(a[0]) - 1, len(b[0]) - 1), np.float32)
    for lo in range(0, len(ids), WIDE):
        out += table(*a, ids[lo : lo + WIDE]) @ table(*b, ids[lo : lo + WIDE]).T
    return out


def best_shared(children: DataFrame, parents: DataFrame, lag_us: int | None = None) -> DataFrame:
    """(child, parent, shared, ties) of each child (session, first_us, fps: ids as longs, each once) that shares an id
    with another session of ``parents``: the one that shares the most, then the nearest in time, then the least key;
    ``ties``: how many share as many. With ``lag_us`` only those that began up to that long before it.

    What every two share is a product of sets, so no row is made for a pair: a block of children and one of parents meet
    in a task, which counts their common ids by matrix products and gives one row a child."""
    n, m = (max(1, -(-d.count() // BLOCK)) for d in (children, parents))
    block = lambda k: F.pmod(F.xxhash64("session"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cols = ["_c", "_p", "side", "session", "first_us", "fps"]
    d = parents.withColumns({"side": F.lit(0), "_p": block(m)}).withColumn("_c", every(n)).select(*cols)
    d = d.unionByName(children.withColumns({"side": F.lit(1), "_c": block(n)}).withColumn("_p", every(m)).select(*cols))
    kind = children.schema["session"].dataType
    schema = StructType([StructField("child", kind), StructField("parent", kind), *(StructField(c, LongType()) for c in ("shared", "ties", "dist"))])
    arrow = to_arrow_schema(schema)

    def lists(rows):
        return np.concatenate(([0], np.cumsum([len(x[2]) for x in rows]))), np.concatenate([x[2] for x in rows])

    def settle(up, down):
        right, p_us = lists(up), np.array([x[1] for x in up])
        place = {x[0]: i for i, x in enumerate(up)}
        known = np.unique(right[1])
        for lo in range(0, len(down), 256):
            part = down[lo : lo + 256]
            left = lists(part)
            n = _shared(left, right, np.intersect1d(known, left[1]))
            gap = np.array([x[1] for x in part])[:, None] - p_us
            if lag_us is not None:
                n[(gap < 0) | (gap > lag_us)] = 0
            own = [(i, place[x[0]]) for i, x in enumerate(part) if x[0] in place]
            if own:
                n[tuple(np.array(own).T)] = 0
            top = n.max(axis=1)
            equal = n == top[:, None]
            far = np.where(equal, np.abs(gap), 1 << 62)
            at = far.argmin(axis=1)  # parents come by key, so the first is the least
            ok = np.nonzero(top > 0)[0]
            data = [[part[i][0] for i in ok], [up[i][0] for i in at[ok]], top[ok].astype(np.int64), equal[ok].sum(axis=1), far[ok, at[ok]]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, arrow, strict=True)], schema=arrow)

    def run(batches):
        now, up, down = None, [], []
        for batch in batches:
            *ids, fps = (batch.column(c) for c in cols)
            for i, (c, p, side, who, us) in enumerate(zip(*(x.to_pylist() for x in ids), strict=True)):
                if (c, p) != now:
                    if up and down:
                        yield from settle(up, down)
                    now, up, down = (c, p), [], []
                (down if side else up).append((who, us, fps[i].values.to_numpy()))
        if up and down:
            yield from settle(up, down)

    tasks = ["_c", "_p"]
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *tasks).sortWithinPartitions(*tasks, "side", "session").mapInArrow(run, schema)
    first = F.min(F.struct((-F.col("shared")).alias("n"), "dist", "parent"))
    return d.groupBy("child").agg(first.alias("b"), F.collect_list(F.struct("shared", "ties")).alias("t")).select("child", "b.parent", (-F.col("b.n")).alias("shared"), F.aggregate(F.filter("t", lambda x: x["shared"] == -F.col("b.n")), F.lit(0).cast("long"), lambda s, x: s + x["ties"]).alias("ties"))


def build_edges(sessions: DataFrame, links: DataFrame, shared_us: int = 6 * 3_600_000_000) -> DataFrame:
    """One best parent for each child (``sessions``: session, first_us, subagent; ``links``: session, fp, is_parent). Ids that
    the child states as its parent's count first: the most, then the nearest in time, then the least key; ``confidence`` is
    high where the best is alone at its count. A subagent without one takes a session that shares an id of its own and
    began up to ``shared_us`` before it, by the same order: medium where alone."""
    at = sessions.select("session", "first_us", "subagent")
    fp = F.col("fp").cast("long") if links.schema["fp"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("fp")
    held = links.where("fp is not null").join(at, "session").groupBy("session", "first_us", "subagent", "is_parent").agg(F.collect_set(fp).alias("fps"))
    held = cut_lineage(held)
    own = held.where("not is_parent")
    explicit = cut_lineage(best_shared(held.where("is_parent"), own))
    rest = own.where("subagent").join(explicit.select(F.col("child").alias("session")), "session", "left_anti")
    shared = best_shared(rest, own, shared_us)
    tiers = [d.select("child", "parent", F.lit(m).alias("method"), F.when(F.col("ties") > 1, "ambiguous").otherwise(c).alias("confidence")) for d, m, c in ((explicit, "explicit", "high"), (shared, "shared", "medium"))]
    return tiers[0].unionByName(tiers[1])


def families(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(child, root, depth, cyclic) where each child has one parent: pointers doubled until none moves. A member of a
    cycle, or above whom one lies, is ``cyclic``; its root is the least member on the way."""
    d = edges.select(F.col("child"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.least("child", "parent").alias("low"))
    for i in range(rounds):
        p = d.select(F.col("child").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("low").alias("_low"))
        d = cut_lineage(d.join(p, "up", "left").select("child", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("_up").isNotNull().alias("moved")))
        size = d.where("moved").limit(1).isEmpty()
        if size or 2**i > 2 * d.count():
            break
    return d.select("child", F.when(F.col("moved"), F.col("low")).otherwise(F.col("up")).alias("root"), F.when(~F.col("moved"), F.col("depth")).alias("depth"), F.col("moved").alias("cyclic"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) for every pair on a path upwards, self included, in a forest of any depth.

    Paths are doubled: those of up to 2^k steps, and each of exactly 2^k steps followed by them, give those of up to
    2^(k+1) steps less one. A cycle has no end, so it is an error (``reject_cycles`` first).
    """
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    out = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    jump, step, most = edges.select(F.col("child").alias("node"), F.col("parent").alias("up")), 1, edges.count()
    while not jump.isEmpty():
        if step > most:
            raise ValueError("the edges hold a cycle")
        further = jump.join(out.withColumnRenamed("node", "up"), "up").select("node", "ancestor", (F.col("depth") + step).alias("depth"))
        out = cut_lineage(out.unionByName(further))
        jump = cut_lineage(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("_up")), "up").select("node", F.col("_up").alias("up")))
        step *= 2
    return out.withColumn("depth", F.col("depth").cast("int"))


def subtree_totals(closure: DataFrame, per_node: DataFrame, amounts: list[str]) -> DataFrame:
    """Totals of each node with all its descendants (overlapping by design)."""
    j = closure.join(per_node, "node")
    return j.groupBy(F.col("ancestor").alias("node")).agg(*(F.sum(a).alias(a) for a in amounts), F.count("*").alias("members"))


def nearest_assignment(closure: DataFrame, assigned: DataFrame) -> DataFrame:
    """The assignment of the closest ancestor that has one, self included; a conflicting one blocks (null)."""
    j = closure.join(assigned.withColumnRenamed("node", "ancestor"), "ancestor")
    return j.groupBy("node").agg(F.min_by(F.struct(F.when(~F.col("conflict"), F.col("unit")).alias("unit"), "depth"), "depth").alias("b")).select("node", "b.unit", F.col("b.depth").alias("inherited_from"))
