"""SimHash fingerprints, and groups of near copies by tiled exact comparison."""

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import WordHashes, documents, map_columns, mix, numbered, shingle_hashes, struct, words, written
from meterline.llm.links import Joined, components, similar_sets, tiled, to_table

TILE = 512


def hash_shingles(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each space-joined run of k words, repeats included; of the whole sequence where it is
    shorter; none without words."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(k, len(w))
    pairs = zip(starts[: len(w) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in pairs], np.uint64)


def majority(h: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes; 0 for none."""
    if len(h) == 0:
        return 0
    set_in = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        set_in += np.unpackbits(h[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fingerprint): the whole text's SimHash as a signed long. Null and empty texts: 0."""

    def make():
        return lambda doc_id, text: [doc_id, [signed(majority(hash_shingles(t, k))) for t in text]]

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, fingerprint long")


def close_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (rows that differ in at most ``radius`` bits) among rows of 64-bit words.

    Rows are ordered by population count and compared in tiles by exclusive-or and bit counts; two tiles whose counts
    lie further apart than the radius hold no link and are skipped.
    """
    ones = np.bitwise_count(prints).sum(1).astype(int)
    order = np.argsort(ones, kind="stable")
    p, ones = prints[order], ones[order]
    joined, links = Joined(len(p)), []
    for a in range(0, len(p), TILE):
        left, last = p[a : a + TILE], ones[min(a + TILE, len(p)) - 1]
        for b in range(a, len(p), TILE):
            if ones[b] - last > radius:
                break
            right = p[b : b + TILE]
            apart = np.zeros((len(left), len(right)), np.uint16)
            for k in range(p.shape[1]):
                apart += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
            near = apart <= radius
            if a == b:
                near &= np.tri(*near.shape, -1, dtype=bool).T
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                if joined.join(a + i, b + j):
                    links.append((int(order[a + i]), int(order[b + j])))
    return links


def close_prints(members: DataFrame, keys: list[str], radius, tile: int = 8192) -> DataFrame:
    """(src, dst): a forest of the links among ``node``s in each group of ``keys`` whose ``print`` (binary: 64-bit
    words) differ in at most ``radius(first key)`` bits."""
    ddl = "src long, dst long"
    arrow = to_arrow_schema(struct(ddl))

    def links(key, table):
        node = table.column("node").to_pylist()
        raw = b"".join(table.column("print").to_pylist())
        found = close_links(np.frombuffer(raw, np.uint64).reshape(len(node), -1), radius(key[0].as_py()))
        return to_table([list(x) for x in zip(*((node[i], node[j]) for i, j in found), strict=True)] or [[], []], arrow)

    return tiled(members, keys, tile).groupBy(*keys, "pair").applyInArrow(links, ddl)


def fingerprint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(src, dst): links among distinct fingerprints that differ in at most ``radius`` of 64 bits.

    Cut into radius + 2 bands, two such fingerprints agree in two bands at least; the tiles compare the groups that each
    pair of bands makes. Every link is found, with (radius + 2)(radius + 1) / 2 small rows for each fingerprint (15 at
    radius 4, keys of 21 bits or so), in place of all tiles against all.
    """
    edge = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    cuts = [F.shiftrightunsigned("fingerprint", 64 - b).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    pairs = [F.shiftleft(x, edge[j + 1] - edge[j]).bitwiseOR(cuts[j]) for i, x in enumerate(cuts) for j in range(i + 1, len(cuts))]
    m = nodes.select("node", F.posexplode(F.array(*pairs)).alias("band", "value"), F.hex("fingerprint").alias("h"))
    # the long's bytes; their order doesn't matter to exclusive-or and bit counts
    m = m.select("node", "band", "value", F.unhex(F.lpad("h", 16, "0")).alias("print"))
    return close_prints(m, ["band", "value"], lambda band: radius)


def simhash_groups(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: the component's smallest doc_id, itself included.

    Rows of equal fingerprints are one node, so copies cost nothing more. Null and empty texts have fingerprint 0 and
    link like any other; repeated rows each come back; a row with a null doc_id keeps its component's id, which is
    null only where no row of it has an id. Other columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, k), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    nodes = written(nodes.withColumn("node", F.col("fingerprint")), "nodes")
    found = components(fingerprint_links(nodes.select("node", "fingerprint"), radius))
    group = F.coalesce("component", "node")
    grouped = nodes.join(found, "node", "left").withColumn("group", group)
    lowest = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    by_print = grouped.join(lowest, "group").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and their components at 4 or fewer differing bits; see ``simhash_groups``."""
    return simhash_groups(documents(spark, sf_dir))


# -- near copies by similarity: wider fingerprints find candidates, Jaccard decides --------------------------------


def wide_print(shingles: np.ndarray, width: int) -> bytes:
    """SimHash of ``width`` x 64 bits from 64-bit hashes: word w is the majority of the hashes mixed w times over."""
    out, h = [], shingles
    for _ in range(width):
        out.append(majority(h))
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    return np.array(out, np.uint64).tobytes()


def lowest(shingles: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` least of the hashes mixed anew (all where there are fewer)."""
    h = mix(shingles ^ np.uint64(0x27D4EB2F165667C5))
    return h if len(h) <= n else np.partition(h, n - 1)[:n]


def near_copies(docs: DataFrame, k: int = 5, threshold: float = 0.8, width: int = 2, radius: int = 36, wide: int = 48, small: int = 16, keys: int = 8) -> DataFrame:
    """(node, component) for each row that has a near copy: Jaccard similarity of the sets of k-word shingles at or
    over ``threshold``, linked through any number of rows; the component is its smallest node. ``docs`` has node (long,
    unique) and text; rows of equal word sequences are near copies, null and empty texts of each other.

    Equal shingle sets are one node first. Of the rest, sets meet that share one of the ``keys`` least hashes of their
    shingles: at similarity 0.8 each of the union's least ones is in both with probability 0.8, so 8 keys miss about
    0.2^8 of such pairs. Each such block is compared by fingerprints of ``width`` x 64 bits in tiles (at 0.8 about 0.15 of
    the bits differ: 19 of 128, deviation 4; more in sets of up to ``small`` shingles, whose radius is ``wide``), so the
    work doesn't grow with the square of the rows. Rows with a candidate bring their sets, and the exact similarity decides.
    """

    def make():
        seen = WordHashes()

        def fn(node, text):
            sets = [np.unique(shingle_hashes(seen.of(words(t)), k)) for t in text]
            same = [int(mix(s).sum(dtype=np.uint64)) ^ len(s) for s in sets]
            least = [lowest(s, keys).view(np.int64).tolist() for s in sets]
            return [node, [signed(x) for x in same], [len(s) for s in sets], [wide_print(s, width) for s in sets], least]

        return fn

    # the set's own hash stands for it: the sum of its mixed members
    rows = written(map_columns(docs.select("node", "text"), make, "node long, same long, size long, print binary, keys array<long>"), "prints")
    sets = rows.groupBy("same").agg(F.min("node").alias("node"), *(F.first(c).alias(c) for c in ("size", "print", "keys")))
    sets = written(sets, "sets")
    # sets of up to small / threshold shingles can be near a small one, those over small near a larger one
    kinds = F.array_compact(F.array(F.when(F.col("size") <= int(small / threshold), 1), F.when(F.col("size") > small, 0)))
    m = sets.where("size > 0").select("node", "print", F.explode(kinds).alias("small"), "keys").select("small", F.explode("keys").alias("key"), "node", "print")
    near = components(close_prints(m, ["small", "key"], lambda is_small: wide if is_small else radius))
    near = written(near, "candidates")

    def make_items():
        seen = WordHashes()
        return lambda node, component, text: [node, component, [np.unique(shingle_hashes(seen.of(words(t)), k)).tobytes() for t in text]]

    texts = docs.select("node", "text").join(near, "node").select("node", "component", "text")
    items = map_columns(texts, make_items, "node long, component long, items binary")
    links = similar_sets(items, ["component"], threshold, tile=1024)
    copies = rows.join(sets.select("same", F.col("node").alias("first")), "same").where("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    return components(links.unionByName(copies))


def drop_near_copies(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the near copies: of each group of ``near_copies`` the row with the smallest doc_id stays (null
    last; equal ids: one row). All columns are kept, whatever their names."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: i for i, c in enumerate(docs.columns)}
    kept = docs.toDF(*names)
    order = F.col(names[at["doc_id"]])
    kept = numbered(kept, [names[at["doc_id"]], names[at["text"]]], "_row")
    rows = kept.select("_row", order.alias("doc_id"), F.col(names[at["text"]]).alias("text"))
    found = near_copies(rows.select(F.col("_row").alias("node"), "text"), k, threshold)
    found = found.join(rows.select(F.col("_row").alias("node"), "doc_id"), "node")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")).alias("best"))
    gone = found.join(best, "component").where("node <> best.node").select(F.col("node").alias("_row"))
    return kept.join(gone, "_row", "left_anti").select(*names).toDF(*docs.columns)
