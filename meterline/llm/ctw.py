"""Language-model scores by context-tree weighting over bytes, in counts that Spark gathers.

A text becomes the bytes of its words (A-Z in lower case), each followed by a space, and one line feed as its end; the
bytes before its start are line feeds. Each byte is eight binary decisions, from the highest bit on. A decision is
predicted in the contexts of the 0 to DEPTH bytes before it: every context keeps how often each bit followed in the training
texts, the Krichevsky-Trofimov estimate of those counts, and the weight of that estimate against the deeper contexts.

The counts come in any order, so they are gathered as (context, byte) grams; the weights go up the tree and the mixed
probabilities down it. A part of the tree below TOP context bytes is one piece of work; the roots of these parts are
summed by Spark to the depths above, which have at most 65,536 x 255 decisions, whatever the input, and which the driver
holds and broadcasts. Probabilities reach the texts by a join on the grams of each chunk of texts, so no task and no
broadcast holds a table that grows with the corpus.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import documents, record_batch, remainder_is, shuffle_partitions, struct, words, written, written_by

DEPTH, TOP = 5, 3
END = b"\n"
#: Grams of a chunk's texts are sorted and counted in parts of this many; the tree is worked through in parts of that many.
SORTED, WORKED = 2_000_000, 300_000
LN2 = math.log(2.0)
#: Words' keys carry bit 62; those of grams are below 2^(8 DEPTH + 8).
WORD_BIT = 1 << 62
SMALL = 4096


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after eight steps up."""
    y = x + 8.0
    steps = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    inverse = 1.0 / y
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 / 1260))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


HALF, WHOLE = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of any sequence with these counts (whole numbers)."""
    both = zeros + ones
    small = both < SMALL
    z, o, n = (np.where(small, x, 0).astype(np.int64) for x in (zeros, ones, both))
    out = HALF[z] + HALF[o] - WHOLE[n]
    if not small.all():
        z, o = zeros[~small].astype(float), ones[~small].astype(float)
        out[~small] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1.0)
    return out - math.log(math.pi)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, the estimate's share): half the node's own estimate, half its contexts'."""
    whole = np.logaddexp(own, below) - LN2
    return whole, np.exp(own - LN2 - whole)


def levels(grams: np.ndarray, n: np.ndarray, top: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """From depth DEPTH up to ``top``: the distinct grams of that depth in order, their counts, and the place of each
    gram of the depth below among them. A gram is the context bytes, the last one first, and then the byte."""
    out = [(grams, n, None)]
    for _ in range(DEPTH - top):
        g, n, _ = out[-1]
        shorter, place = np.unique(((g >> 16) << 8) | (g & 255), return_inverse=True)
        out.append((shorter, np.bincount(place, n, len(shorter)).astype(np.int64), place))
    return out


def subtree(grams: np.ndarray, n: np.ndarray, top: int = TOP, mix: bool = True) -> tuple[np.ndarray | None, tuple]:
    """Of all grams (sorted, distinct) with some contexts of ``top`` bytes: the mixed probability of each gram's bits from
    depth ``top`` down (8, n; None without ``mix``), and for each decision at depth ``top`` (context, number from 1 to
    255, log weighted probability, zeros, ones)."""
    tree = levels(grams, n, top)
    mixed = np.empty((8, len(grams))) if mix else None
    roots = []
    for k in range(8):
        p = at = below = starts = None
        for g, count, place in tree:
            node = g >> (8 - k)
            begins = np.concatenate(([True], node[1:] != node[:-1]))
            number = np.cumsum(begins) - 1
            up = None if place is None else number[place[starts]]
            starts = np.flatnonzero(begins)
            bit = (g >> (7 - k)) & 1
            every = np.add.reduceat(count, starts)
            ones = np.add.reduceat(count * bit, starts)
            own = log_kt(every - ones, ones)
            if place is None:
                whole, share = own, None
            else:
                whole, share = weigh(own, np.bincount(up, below, len(starts)))
            below = whole
            if mix:
                kt = ((ones + 0.5) / (every + 1.0))[number]
                kt = np.where(bit == 1, kt, 1 - kt)
                if place is None:
                    p = kt
                else:
                    at = place if at is None else place[at]
                    s = share[number][at]
                    p = s * kt[at] + (1 - s) * p
        if mix:
            mixed[k] = p
        first = node[starts]
        roots.append((first >> k, (first & ((1 << k) - 1)) | (1 << k), whole, every - ones, ones))
    return mixed, tuple(np.concatenate(x) for x in zip(*roots, strict=True))


class Upper:
    """Depths 0 to 2: the estimate's share and the probability of a one for each decision after each context of so many
    bytes. Depth 2 has a row of 256 decisions for each pair of bytes that occurs: 65,536 rows at most."""

    def __init__(self, pair: np.ndarray, number: np.ndarray, whole: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        used, row = np.unique(pair, return_inverse=True)
        self.row = np.zeros(1 << 16, np.int64)
        self.row[used] = np.arange(len(used))
        z, o, below = (np.zeros((len(used), 256)) for _ in range(3))
        for table, x in ((z, zeros), (o, ones), (below, whole)):
            np.add.at(table, (row, number), x)
        self.depths = []
        for last in (used >> 8, np.zeros(256, np.int64), None):
            up, share = weigh(log_kt(z, o), below)
            up = np.where(z + o > 0, up, 0.0)  # a context never met weighs 1
            self.depths.append((share, (o + 0.5) / (z + o + 1)))
            if last is not None:
                z, o, below = (self._sum(x, last, 256 if len(self.depths) == 1 else 1) for x in (z, o, up))

    @staticmethod
    def _sum(table: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 256))
        np.add.at(out, to, table)
        return out

    def log10(self, grams: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Base-10 logarithm of each gram's probability from its mixed probabilities (8, n) at depth TOP."""
        byte = grams & 255
        rows = (self.row[grams >> (8 * DEPTH - 8)], grams >> (8 * DEPTH), np.zeros(len(grams), np.int64))
        out = np.zeros(len(grams))
        for k in range(8):
            number, one = (1 << k) | (byte >> (8 - k)), ((byte >> (7 - k)) & 1) == 1
            p = mixed[k]
            for row, (share, table) in zip(rows, self.depths, strict=True):
                s, kt = share[row, number], table[row, number]
                p = s * np.where(one, kt, 1 - kt) + (1 - s) * p
            out += np.log10(p)
        return out


def text_grams(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """A text's grams (int64: DEPTH context bytes, the last one first, then the byte), and its words."""
    w = words(text)
    body = END * DEPTH + b" ".join(w) + (b" " if w else b"") + END + bytes(7 - DEPTH)
    # eight bytes from each place on, of which the last ones are too many
    eight = np.ndarray(len(body) - 7, "<i8", body, 0, (1,))
    return ((eight & ((1 << 8 * DEPTH) - 1)) << 8) | ((eight >> (8 * DEPTH)) & 255), [*w, END]


def word_key(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word, 42) >> 2) | WORD_BIT


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how many of each there are in training texts: those whose lowest bit (after the
    gram) is set."""
    grams.sort()
    key = grams >> 1
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[starts], np.add.reduceat(grams & 1, starts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    key, n = map(np.concatenate, zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")  # merges runs that are in order
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[starts], np.add.reduceat(n[order], starts)


class ChunkCounts:
    """Distinct grams and words of the texts of a chunk, and how often they stand in its training texts."""

    def __init__(self):
        self.parts, self.waiting, self.size = [], [], 0
        self.words: Counter = Counter()

    def add(self, text: str | None, train: bool) -> None:
        grams, w = text_grams(text)
        self.waiting.append((grams << 1) | train)
        self.size += len(grams)
        if train:
            self.words.update(w)
        else:
            for x in set(w):
                self.words[x] += 0
        if self.size > SORTED:
            self._sort()

    def _sort(self) -> None:
        if self.waiting:
            grams = np.concatenate(self.waiting)
            self.waiting, self.size = [], 0
            self.parts.append(_counted(grams))
            if len(self.parts) > 3:
                self.parts = [_merged(self.parts)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._sort()
        grams, n = _merged(self.parts)
        w = np.fromiter(map(word_key, self.words), np.int64, len(self.words))
        return np.concatenate([grams, w]), np.concatenate([n, np.fromiter(self.words.values(), np.int64, len(w))])


def chunk_keys(docs: DataFrame) -> DataFrame:
    """(chunk, key, n) of texts with ``chunk`` and ``train``: each chunk's distinct grams and words, and how often they
    stand in its training texts. A chunk's texts pass through one by one."""
    ddl = "chunk long, key long, n long"
    arrow = to_arrow_schema(struct(ddl))

    def run(batches):
        now, counts = None, None

        def ended():
            keys, n = counts.result()
            return record_batch([np.full(len(keys), now), keys, n], arrow)

        for batch in batches:
            for chunk, train, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    if counts:
                        yield ended()
                    now, counts = chunk, ChunkCounts()
                counts.add(text, train)
        if counts:
            yield ended()

    dealt = docs.select("chunk", "train", "text").repartition(shuffle_partitions(docs.sparkSession), "chunk")
    return dealt.sortWithinPartitions("chunk").mapInArrow(run, ddl)


def whole_contexts(batches, least: int = WORKED):
    """(key, n) arrays from sorted batches, cut where a context of TOP bytes ends, once there are ``least`` rows."""
    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, n = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([n, batch.column(1).to_numpy()])
        if len(key) >= least:
            cut = int(np.searchsorted(key, key[-1] >> CONTEXT_SHIFT << CONTEXT_SHIFT))
            if cut:
                yield key[:cut], n[:cut]
                key, n = key[cut:], n[cut:]
    if len(key):
        yield key, n


CONTEXT_SHIFT = 8 * (DEPTH - TOP) + 8


def gram_scores(grams: DataFrame) -> DataFrame:
    """(key, value): the base-10 logarithm of the probability of each gram (key, n; keys distinct) under the weighted
    tree. The tree's parts are worked through twice: for their roots, then for the probabilities below them."""
    spark = grams.sparkSession
    context = F.shiftright("key", CONTEXT_SHIFT)
    sorted_grams = grams.select("key", "n").repartition(shuffle_partitions(spark), context).sortWithinPartitions("key")
    ddl = "pair int, number int, whole double, zeros double, ones double"
    arrow = to_arrow_schema(struct(ddl))

    def roots(batches):
        for key, n in whole_contexts(batches):
            _, (context, number, whole, zeros, ones) = subtree(key, n, mix=False)
            yield record_batch([(context >> 8).astype(np.int32), number.astype(np.int32), whole, zeros.astype(float), ones.astype(float)], arrow)

    sums = [F.sum(c).alias(c) for c in ("whole", "zeros", "ones")]
    top = sorted_grams.mapInArrow(roots, ddl).groupBy("pair", "number").agg(*sums).toArrow()  # at most 65,536 x 255 rows
    upper = spark.sparkContext.broadcast(Upper(*(top.column(c).to_numpy() for c in ("pair", "number", "whole", "zeros", "ones"))))
    ddl = "key long, value double"
    out = to_arrow_schema(struct(ddl))

    def values(batches):
        for key, n in whole_contexts(batches):
            yield record_batch([key, upper.value.log10(key, subtree(key, n)[0])], out)

    return sorted_grams.mapInArrow(values, ddl)


class Numbered(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class GramSums:
    """Sums of values over the grams of texts. The grams of some texts are sorted together, each with its text's number
    in the lowest bits, so each distinct one is looked up once and in order."""

    BITS, MOST = 15, 1_500_000

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.key, self.value, self.held, self.size, self.out = key, value, [], 0, []

    def add(self, grams: np.ndarray) -> None:
        self.held.append((grams << self.BITS) | len(self.held))
        self.size += len(grams)
        if self.size >= self.MOST or len(self.held) == 1 << self.BITS:
            self._sum()

    def _sum(self) -> None:
        x, texts = np.concatenate(self.held), len(self.held)
        self.held, self.size = [], 0
        x.sort()
        gram = x >> self.BITS
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        found = self.value[np.searchsorted(self.key, gram[first])]
        x &= (1 << self.BITS) - 1
        self.out.append(np.bincount(x, np.repeat(found, np.diff(first, append=len(x))), texts))

    def result(self) -> np.ndarray:
        if self.held:
            self._sum()
        return np.concatenate(self.out)


def score_documents(docs: DataFrame, chunk_chars: int = 12_000_000) -> DataFrame:
    """Scores of every whole text. Learning texts are those whose crc32(doc_id as text) mod 5 isn't 1.

    Null texts are empty (their end alone); a null id counts as the empty text's crc32; repeated rows each count and
    each get a row; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-chars // chunk_chars))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks))).withColumn("train", ~remainder_is(5, 1))
    keys = written_by(chunk_keys(docs), "key", "chunk-keys")
    totals = written(keys.groupBy("key").agg(F.sum("n").alias("n")), "key-totals")
    is_word = F.col("key") >= WORD_BIT
    n_tokens, n_types = totals.where(is_word & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    values = totals.where(is_word).select("key", F.col("n").cast("double").alias("value"))
    values = values.unionByName(gram_scores(totals.where(~is_word)))
    known = keys.select("chunk", "key").join(values, "key").select("chunk", "key", "value")
    ddl = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = to_arrow_schema(struct(ddl))
    floor = n_tokens + 0.5 * (n_types + 1)

    def run(texts, table):
        key, value = table.column("key").to_numpy(), table.column("value").to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        sums, number, at, sizes, ids = GramSums(key, value), Numbered(), [], [], []
        for batch in texts.to_batches():
            for i, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                g, w = text_grams(t)
                sums.add(g)
                ids.append(i)
                sizes.append(len(w))
                at.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
        if not ids:
            return pa.Table.from_batches([], schema=arrow)
        c = value[np.searchsorted(key, np.fromiter(map(word_key, number), np.int64, len(number)))]
        at, starts = np.concatenate(at), np.cumsum(sizes) - sizes
        n_known = np.add.reduceat((c > 0).astype(np.int64)[at], starts)
        base = np.add.reduceat(np.log10((c + 0.5) / floor)[at], starts)
        return pa.Table.from_batches([record_batch([ids, sizes, n_known, np.full(len(ids), n_tokens), base, sums.result()], arrow)])

    return docs.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, ddl)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and context-tree score, in base-10 logarithms; see ``score_documents``."""
    scored = score_documents(documents(spark, sf_dir))
    return scored.select("doc_id", remainder_is(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
