"""Passages that repeat across documents: MinHash keys of sliding paragraphs, word-by-word alignment, removals.

Lines don't show where a pasted passage begins, so each stretch of WINDOW seeds (shingles of SEED words) is a paragraph,
and its key is the seed with the least hash (a MinHash of one permutation). Any 25 words that two rows share hold a whole
paragraph and so a common key, wherever they stand. Keys only propose places; what repeats is found by comparing words.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.common import MIX, WordHashes, documents, map_columns, mix, numbered, words, written
from meterline.llm.links import components

SEED, WINDOW, RUN = 16, 10, 16
WORDS, THRESHOLD, REACH = 5, 0.8, 16


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each ``n`` neighbours."""
    size = 1
    while size * 2 <= n:
        x, size = pick(x[:-size], x[size:]), size * 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def seeds(h: np.ndarray, starts: np.ndarray, k: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the seeds of a text with these word hashes: of each ``window`` neighbouring shingles of
    ``k`` words the one with the least hash (all of a text with fewer are one window), and those at ``starts``. Of equal
    neighbours (one word over and over) only the first is taken."""
    if len(h) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    s, size = h, 1
    while size < k:
        step = min(size, k - size)
        s, size = s[:-step] * MIX[0] + mix(s[step:]), size + step
    s = mix(s)
    if len(s) <= window:
        take = s == s.min()
    else:
        low = _sliding(s, window, np.minimum)
        pad = np.zeros(window - 1, np.uint64)
        take = _sliding(np.concatenate((pad, low, pad)), window, np.maximum) == s
    take[starts[starts < len(s)]] = True
    take[1:] &= s[1:] != s[:-1]
    at = np.flatnonzero(take)
    return at, s[at]


def line_starts(text: str | None) -> np.ndarray:
    """Number of the first word of each line of ``text``."""
    n = [len(line.split()) for line in (text or "").encode().split(b"\n")]
    return np.cumsum([0, *n[:-1]])


def seed_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, at, seed): the seeds of each text."""

    def make():
        seen = WordHashes()

        def fn(row, doc_id, text):
            ats, hs, n = [], [], []
            for t in text:
                at, h = seeds(seen.of(words(t)), line_starts(t))
                ats.append(at)
                hs.append(h)
                n.append(len(at))
            if not sum(n):
                return None
            rows = pa.array(row, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            ids = pa.array(doc_id, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            return [rows, ids, pa.array(np.concatenate(ats).astype(np.int32)), pa.array(np.concatenate(hs).view(np.int64))]

        return fn

    return map_columns(docs.select("row", "doc_id", "text"), make, "row long, doc_id long, at int, seed long")


def word_rows(docs: DataFrame) -> DataFrame:
    """(row, words): the texts as 32-bit hashes of their words (binary)."""

    def make():
        seen = WordHashes()
        return lambda row, text: [row, [seen.of(words(t)).astype(np.uint32).tobytes() for t in text]]

    return map_columns(docs.select("row", "text"), make, "row long, words binary")


def blocks(h: np.ndarray, g: np.ndarray, at: list[int], first_at: list[int]) -> list[tuple[int, int, int]]:
    """(first word in ``h``, in ``g``, words): the longest equal stretches through the pairs of places, by place in ``h``.
    Seeds inside a stretch before them are passed over (a line over and over meets itself at any distance)."""
    out, end = [], 0
    for a, f in sorted(zip(at, first_at, strict=True)):
        if a + SEED <= end:
            continue
        m, n = min(a, f), min(len(h) - a, len(g) - f)
        left = _equal(h[a - m : a][::-1], g[f - m : f][::-1])
        right = _equal(h[a : a + n], g[f : f + n])
        if right:
            out.append((a - left, f - left, left + right))
            end = max(end, a + right)
    return out


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading values are equal."""
    lo, size = 0, 64
    while lo < len(x):
        differ = np.flatnonzero(x[lo : lo + size] != y[lo : lo + size])
        if len(differ):
            return lo + int(differ[0])
        lo, size = lo + size, size * 4
    return len(x)


def resumed(h: np.ndarray, g: np.ndarray, a: int, f: int, k: int = WORDS, reach: int = REACH):
    """(first word in ``h``, in ``g``, words): the equal stretches of at least ``k`` words that follow each other from
    these places on, each within ``reach`` words of the one before, one after the other."""
    while True:
        same = h[a : a + reach, None] == g[None, f : f + reach]
        if min(same.shape) < k:
            return
        run = same[: len(same) - k + 1, : same.shape[1] - k + 1].copy()
        for o in range(1, k):
            run &= same[o : len(same) - k + 1 + o, o : same.shape[1] - k + 1 + o]
        x, y = np.nonzero(run)
        if not len(x):
            return
        i = int(np.argmin(x + y))
        a, f = a + int(x[i]), f + int(y[i])
        m = min(len(h) - a, len(g) - f)
        n = _equal(h[a : a + m], g[f : f + m])
        yield a, f, n
        a, f = a + n, f + n


def chains(found: list[tuple[int, int, int]], k: int = WORDS) -> list[list[tuple[int, int, int]]]:
    """Stretches in sequences that go forward in both texts, each after the nearest; words that overlap stay with the first."""
    out = []
    for a, f, n in sorted(found):
        best = None
        for c in out:
            x, y, m = c[-1]
            over = max(x + m - a, y + m - f, 0)
            if n - over >= k and a >= x and f >= y:
                cost = (over, a + f - x - y - 2 * m)
                if best is None or cost < best[0]:
                    best = cost, c, over
        if best is None:
            out.append([(a, f, n)])
        else:
            _, c, over = best
            c.append((a + over, f + over, n - over))
    return out


def joined(chain: list[tuple[int, int, int]], k: int = WORDS, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(first word, words, first word in the other text, words): the longest part of the chain whose two sides have a
    Jaccard similarity of aligned ``k``-word shingles at or over ``threshold``, then the same of what is before and after.

    With S common shingles and sides of L and M words it is S / (L + M - 2 (k - 1) - S), so the test is whether
    (1 + threshold) S - threshold (L + M - 2 (k - 1)) is at least 0, a sum over the stretches and the gaps between them.
    """
    out, todo = [], [(0, len(chain))]
    value = [(1 + threshold) * (n - k + 1) - threshold * 2 * n for _, _, n in chain]
    gap = [0.0] + [threshold * (a + f - x - y - 2 * m) for (x, y, m), (a, f, _) in zip(chain, chain[1:], strict=False)]
    free = threshold * 2 * (k - 1) + 1e-9
    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        sums, at, low = [], 0.0, []  # low: starts that are cheaper than all before them
        for i in range(lo, hi):
            at += value[i] - gap[i]
            sums.append(at)
            if not low or at - value[i] < low[-1][0]:
                low.append((at - value[i], i))
        best = (-1, lo, lo)
        for j in range(hi - 1, lo - 1, -1):
            while low and low[-1][1] <= j and sums[j - lo] - low[-1][0] + free >= 0:
                i = low.pop()[1]
                best = max(best, (chain[j][0] + chain[j][2] - chain[i][0], i, j))
        _, i, j = best
        (a, f, _), (x, y, n) = chain[i], chain[j]
        out.append((a, x + n - a, f, y + n - f))
        todo += [(lo, i), (j + 1, hi)]
    return out


def spans(h: np.ndarray, g: np.ndarray, at: list[int], first_at: list[int]) -> list[tuple[int, int, int, int]]:
    """(first word in ``h``, words, first word in ``g``, words): what the two texts share through these places, equal or
    nearly so."""
    found = blocks(h, g, at, first_at)
    every = set(found)
    for a, f, n in found:
        for new in resumed(h, g, a + n, f + n):
            if new in every:  # what follows it is looked for from there
                break
            every.add(new)
        for x, y, m in resumed(h[::-1], g[::-1], len(h) - a, len(g) - f):
            new = len(h) - x - m, len(g) - y - m, m
            if new in every:
                break
            every.add(new)
    return [s for c in chains(list(every)) for s in joined(c)]


def matches(pairs: DataFrame, hashes: DataFrame, run_words: int) -> DataFrame:
    """(row, first_word, n_words, other, own): the spans of ``pairs`` (row, first, at: array, first_at: array) of at least
    ``run_words`` words; for each also the place in ``first`` (``own``)."""

    def make():
        def fn(row, first, at, first_at, own, others):
            out = []
            for r, i, a, f, h, g in zip(row, first, at, first_at, own, others, strict=True):
                for x, n, y, m in spans(np.frombuffer(h, np.uint32), np.frombuffer(g, np.uint32), a, f):
                    if n >= run_words:
                        out += [(r, x, n, i, False), (i, y, m, i, True)]
            return [list(c) for c in zip(*out, strict=True)] if out else None

        return fn

    both = pairs.join(hashes.select(F.col("row").alias("first"), F.col("words").alias("others")), "first").join(hashes, "row")
    return map_columns(both.select("row", "first", "at", "first_at", "words", "others"), make, "row long, first_word int, n_words int, other long, own boolean", rows=64)


def apart(found: list[tuple[int, int, bool, int]], run_words: int) -> list[tuple[int, int, bool, int]]:
    """(first word, words, own, other) of one row without overlaps: removed spans (not ``own``) by place, each without the
    words of those before it; then the row's own spans, joined, without the words of all removed ones."""
    out, end = [], 0
    for a, n, _, other in sorted((x for x in found if not x[2]), key=lambda x: (x[0], -x[1])):
        if a + n > end:
            out.append((max(a, end), a + n - max(a, end), False, other))
            end = a + n
    taken, last, own = list(out), 0, []
    for a, n, _, other in sorted(x for x in found if x[2]):
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], a + n)
        else:
            own.append([a, a + n, other])
    for a, e, other in own:
        while last < len(taken) and taken[last][0] + taken[last][1] <= a:
            last += 1
        i = last
        while a < e:
            stop = min(e, taken[i][0]) if i < len(taken) else e
            if stop - a >= run_words:
                out.append((a, stop - a, True, other))
            if i == len(taken):
                break
            a, i = max(a, taken[i][0] + taken[i][1]), i + 1
    return sorted(out)


def repeated_passages(docs: DataFrame, run_words: int = RUN, clusters: bool = True) -> DataFrame:
    """(row, doc_id, first_word, n_words, first_doc_id, removed, component_id): spans of words that repeat across rows of
    ``docs`` (row: long, unique; doc_id; text), with the first doc_id where they stand; ``removed`` is false for that one.
    ``component_id`` is the smallest doc_id of those that removals tie together, one after another (null: all are null), left out without ``clusters``.

    Each seed is compared with the row of the smallest doc_id that holds it: from there the words of both are compared to
    the left and right as far as they are equal, and across the gaps between equal stretches as long as the exact Jaccard
    similarity of the whole is at or over ``THRESHOLD``. Repeats of 25 words, or of a whole line, are always found, and
    so are near copies of over 50 words (to be over 0.8 they share 25 words in a row); shorter ones by chance, under
    ``run_words`` (at least ``SEED``) none. Spans of a row don't overlap; where several first rows
    share parts of a passage, the parts follow each other. Repeats within one row are left out. Null and empty texts give
    no rows; null ids come after all others; equal rows are repeats of each other, and the one with the smallest row
    number stays.
    """
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row", "at")
    first = F.min(place).over(Window.partitionBy("seed"))
    hits = seed_rows(docs).withColumn("to", first).where("to.row <> row")
    pairs = hits.groupBy("row", F.col("to.row").alias("first")).agg(F.collect_list(F.struct("at", F.col("to.at").alias("first_at"))).alias("all"))
    pairs = written(pairs.select("row", "first", F.col("all.at").alias("at"), F.col("all.first_at").alias("first_at")), "pairs")
    needed = pairs.select("row").unionByName(pairs.select(F.col("first").alias("row"))).distinct()
    hashes = written(word_rows(docs.join(needed, "row", "left_semi")), "words")
    found = matches(pairs, hashes, run_words).distinct()
    found = found.groupBy("row").agg(F.collect_list(F.struct("first_word", "n_words", "own", "other")).alias("all"))

    def make():
        def fn(row, all):
            out = [(r, *x) for r, every in zip(row, all, strict=True) for x in apart([tuple(e.values()) for e in every], run_words)]
            return [list(c) for c in zip(*out, strict=True)] if out else None

        return fn

    runs = written(map_columns(found, make, "row long, first_word int, n_words int, own boolean, other long"), "runs")
    ids = docs.select("row", "doc_id")
    runs = runs.join(ids, "row").join(ids.select(F.col("row").alias("other"), F.col("doc_id").alias("first_doc_id")), "other")
    kept = ["row", "doc_id", "first_word", "n_words", "first_doc_id", (~F.col("own")).alias("removed")]
    if not clusters:
        return runs.select(*kept)
    linked = components(runs.where("not own").select(F.col("row").alias("src"), F.col("other").alias("dst")))
    least = linked.withColumnRenamed("node", "row").join(ids, "row").withColumnRenamed("row", "node")
    least = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    cluster = linked.join(least, "component").select(F.col("node").alias("row"), "component_id")
    return runs.join(cluster, "row", "left").select(*kept, "component_id")


def remove_passages(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (all columns kept) with the words of the removed passages cut out of ``text``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    found = repeated_passages(rows.select("row", F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).alias("text")), clusters=False, **options)
    cuts = found.where("removed").groupBy("row").agg(F.sort_array(F.collect_list(F.array("first_word", "n_words"))).alias("cuts"))
    marked = rows.join(cuts, "row", "left")
    text = F.when(F.col("cuts").isNull(), F.col(at["text"])).otherwise(_cut(F.col(at["text"]), F.col("cuts")))
    return marked.withColumn(at["text"], text).select(*names).toDF(*docs.columns)


def _cut(text, cuts):
    """The text without the words at ``cuts`` ([first, number] each), in Spark's own expressions."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(cuts, lambda c: (i >= c[0]) & (i < c[0] + c[1])))
    return F.array_join(kept, "")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages that repeat across ``documents``; nulls, empty and long texts, repeated rows and empty tables as in
    ``repeated_passages``, other columns are left out."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeated_passages(numbered(docs, ["doc_id", "text"], "row")).drop("row")
