"""Links between sets or fingerprints within groups of candidates, and connected components of links."""

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import record_batch, struct, written


class Joined:
    """Union-find over positions; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def tiled(members: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """``members`` with ``pair``: groups of up to ``tile`` rows are one tile (0); a larger group is dealt by hash to
    tiles, and each row goes to each pair of tiles that holds its own, so any two rows of a group meet in some pair and
    no task ever holds more than two tiles."""
    spread = members.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    sizes = spread.groupBy(*keys, "_salt").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("_n"))
    sizes = sizes.where("_n > 1").withColumn("_tiles", F.ceil(F.col("_n") / tile).cast("int")).drop("_n")
    t = members.join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_tiles")).cast("int"))
    t = t.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return t.withColumn("pair", F.least("_own", "_other") * F.col("_tiles") + F.greatest("_own", "_other")).drop("_own", "_other", "_tiles")


def sets_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links (Jaccard at or over ``threshold``) among sorted arrays of distinct hashes.

    Sets by size, elements by rarity in this group: two sets this alike share an element of their prefixes (the first
    |s| - ceil(threshold |s|) + 1 elements), so only sets that do are compared, and only until they are connected.
    """
    n = len(sets)
    lists = [s.tolist() for s in sets]
    often = Counter(x for s in lists for x in s)
    joined, index, links = Joined(n), {}, []
    whole = [frozenset(s) for s in lists]
    same: dict[frozenset, int] = {}
    for i in sorted(range(n), key=lambda i: len(lists[i])):
        if (j := same.setdefault(whole[i], i)) != i:
            if len(whole[i]) and joined.join(i, j):
                links.append((i, j))
            continue
        s = sorted(lists[i], key=lambda x: (often[x], x))
        prefix = s[: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1]
        for j in {j for x in prefix for j in index.get(x, ())}:
            if len(lists[j]) >= threshold * len(s) - 1e-9 and joined.root(i) != joined.root(j):
                both = len(whole[i] & whole[j])
                if both >= threshold * (len(s) + len(lists[j]) - both) - 1e-9:
                    joined.join(i, j)
                    links.append((i, j))
        for x in prefix:
            index.setdefault(x, []).append(i)
    return links


def similar_sets(members: DataFrame, keys: list[str], threshold: float, tile: int = 2048) -> DataFrame:
    """(src, dst): links that connect, within each group of ``keys``, all ``node``s whose ``items`` (binary: sorted
    distinct 64-bit hashes) have a Jaccard similarity at or over ``threshold``. Not all pairs: a forest for each tile."""
    ddl = "src long, dst long"
    arrow = to_arrow_schema(struct(ddl))

    def links(table):
        node = table.column("node").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        found = [(node[i], node[j]) for i, j in sets_links(sets, threshold)]
        return to_table([list(x) for x in zip(*found, strict=True)] or [[], []], arrow)

    members = written(members, "sets")  # both their sizes and their tiles are read from it
    return tiled(members, keys, tile).groupBy(*keys, "pair").applyInArrow(links, ddl)


def to_table(columns: list, arrow):
    import pyarrow as pa

    return pa.Table.from_batches([record_batch(columns, arrow)])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``links`` (src, dst).

    Alternating steps: each node's larger neighbours are tied to its smallest neighbour, then each node's smaller
    neighbours and itself. Both keep components whole and shrink them to stars; rounds grow with the logarithm of the
    size. Each round is a written table, so lineage stays short and nothing is held by one executor.
    """
    def tied(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            low = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))
            return both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        low = edges.groupBy("src").agg(F.min("dst").alias("low"))
        step = edges.join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        return step.unionByName(low.select("src", F.col("low").alias("dst")))

    edges = links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges, before = written(edges, "links"), None
    for _ in range(rounds):
        edges = written(tied(tied(edges, True), False).where("src <> dst").distinct(), "links")
        # the sum of all pointers falls until nothing changes
        now = edges.agg(F.count("*"), F.sum(F.col("dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    roots = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return roots.unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
