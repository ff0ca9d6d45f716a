"""MinHash fingerprints of documents, their edited neighbours, and near-duplicate pairs by bands."""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import WordHashes, documents, map_columns, record_batch, shingle_hashes, shuffle_partitions, struct, words, written
from meterline.llm.links import components, similar_sets
from meterline.llm.simhash import signed

PERMUTATIONS, SEED, WORDS = 128, 1, 5


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Universal hashes x -> high half of (a x + b) modulo 2^64, with odd a; the same for each n and seed."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least high half under each permutation (uint32); all ones for no shingles."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = shingles.view(np.uint32)[::2].astype(np.uint64) ^ (shingles >> np.uint64(32))
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        for i in range(0, len(a), 16):  # small enough for the processor's cache
            h = part[None, :] * a[i : i + 16, None]
            h += b[i : i + 16, None]
            h >>= np.uint64(32)
            np.minimum(low[i : i + 16], h.min(1).astype(np.uint32), out=low[i : i + 16])
    return low


def likeness(s: np.ndarray, t: np.ndarray) -> float:
    """Share of equal places: an estimate of the Jaccard similarity. Two texts without words are alike (1)."""
    return float(np.mean(s == t))


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, in two levels of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    which = F.size(F.filter(F.lit([g[0] for g in groups]), lambda x: x <= key))
    within = F.size(F.filter(F.element_at(F.array(*map(F.lit, groups)), F.greatest(which, F.lit(1))), lambda x: x <= key))
    return F.when(which == 0, 0).otherwise((which - 1) * step + within)


def in_order(docs: DataFrame) -> DataFrame:
    """(part, last, doc_id, text): rows by part and within each by doc_id (null last, equal ids by text), each part
    ended by a copy of the row that follows its own (``last``), the very last by the first of all.

    Parts are ranges of ids at their approximate quantiles. The driver holds the bounds and the first row's id of each
    part, no texts; the texts are shuffled once.
    """
    spark = docs.sparkSession
    n = max(1, shuffle_partitions(spark) * 2)
    top = (1 << 63) - 1
    docs = docs.select("doc_id", "text").withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(top)))
    bounds = sorted(set(docs.stat.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n)))
    docs = docs.withColumn("part", _bucket(F.col("key"), [int(x) for x in bounds]))
    tie = F.struct("key", F.xxhash64("text"))
    firsts = {r[0]: r[1] for r in docs.groupBy("part").agg(F.min(tie).alias("first")).collect()}
    if not firsts:
        return docs.select("part", F.lit(False).alias("last"), "doc_id", "text")
    parts = sorted(firsts)
    before = dict(zip(parts[1:] + parts[:1], parts, strict=True))
    pairs = [F.struct(F.lit(before[p]).alias("part"), F.lit(True).alias("last"), F.lit(firsts[p][0]).alias("key"), F.lit(firsts[p][1]).alias("tie")) for p in parts]
    ends = spark.range(1).select(F.explode(F.array(*pairs)).alias("e")).select("e.*")
    docs = docs.withColumn("tie", F.xxhash64("text"))
    extra = docs.drop("part").join(ends, ["key", "tie"]).dropDuplicates(["part", "last"])
    cols = ["part", "last", "key", "tie", "doc_id", "text"]
    every = docs.withColumn("last", F.lit(False)).select(*cols).unionByName(extra.select(*cols))
    return every.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "last", "key", "tie").select("part", "last", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, k: int = WORDS, n: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see ``_edited``; the next document in ``in_order``).

    Null texts count as empty. The fingerprint is the hex of the signature over the set of k-word shingles of the text
    in lower case (A-Z); a text without words has all ones. A table of one row edits it with itself. Repeated rows are
    rows of their own; other columns are ignored; an empty table gives no rows.
    """
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = to_arrow_schema(struct(ddl))
    a, b = permutations(n, seed)

    def run(batches):
        seen = WordHashes()

        def sign(text):
            return signature(np.unique(shingle_hashes(seen.of(words(text)), k)), a, b)

        held = None  # part, doc_id, text, signature of the row before
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for part, last, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    text = text or ""
                    own = sign(text)
                    if held and held[0] == part:
                        _, i, t, s = held
                        e = _edited(t, text)
                        es = sign(e)
                        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), s.tobytes().hex(), es.tobytes().hex(), likeness(s, es), likeness(s, own)))
                    held = None if last else (part, doc_id, text, own)
                if out:
                    yield record_batch([list(x) for x in zip(*out, strict=True)], arrow)

    return in_order(docs).mapInArrow(run, ddl)


def bands_for(n: int, threshold: float, recall: float = 0.999) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which pairs at ``threshold`` collide with probability ``recall``."""
    rows = max((r for r in range(1, n + 1) if 1 - (1 - threshold**r) ** (n // r) >= recall), default=1)
    return n // rows, rows


def minhash_groups(docs: DataFrame, k: int = WORDS, threshold: float = 0.8, n: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """(doc_id, component_id): near copies (Jaccard of k-word shingles at or over ``threshold``) by banded signatures.

    Signature bands are joined in Spark by grouping equal bands; sets are verified exactly. Rows of equal sets are one
    node. A row without words has no near copy but others without words.
    """
    bands, rows = bands_for(n, threshold)
    a, b = permutations(n, seed)

    def make():
        seen = WordHashes()

        def fn(doc_id, text):
            sets = [np.unique(shingle_hashes(seen.of(words(t)), k)) for t in text]
            keys = []
            for s in sets:
                sig = signature(s, a, b)[: bands * rows].reshape(bands, rows)
                keys.append([signed(int(x)) for x in shingle_hashes_rows(sig)])
            node = [signed(int((s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) ^ len(s)) for s in sets]
            return [doc_id, node, keys, [s.tobytes() for s in sets]]

        return fn

    def shingle_hashes_rows(sig):
        return [shingle_hashes(r.astype(np.uint64), rows)[0] for r in sig]

    signed_docs = written(map_columns(docs.select("doc_id", "text"), make, "doc_id long, node long, keys array<long>, items binary"), "signatures")
    nodes = signed_docs.groupBy("node").agg(F.first("keys").alias("keys"), F.min("doc_id").alias("first"))
    keys = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = keys.join(shared.select("band", "key"), ["band", "key"], "left_semi")
    items = signed_docs.groupBy("node").agg(F.first("items").alias("items"))
    links = similar_sets(met.join(items, "node"), ["band", "key"], threshold)
    found = nodes.select("node", "first").join(components(links), "node", "left").withColumn("group", F.coalesce("component", "node"))
    lowest = found.groupBy("group").agg(F.min("first").alias("component_id"))
    return signed_docs.select("doc_id", "node").join(found.join(lowest, "group").select("node", "component_id"), "node").select("doc_id", "component_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with the fingerprints of their text and edited text. Null and empty texts share a fingerprint; rows
    with equal or null ids each keep a row, the next document being the next row in order; an empty table gives no rows;
    other columns are left out."""
    return fingerprint_documents(documents(spark, sf_dir))
