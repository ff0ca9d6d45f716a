"""Packing token sequences into bins by bin completion over the histogram of lengths.

Where a piece can go depends on its length alone, and there are at most ``capacity`` lengths: the search works on that
histogram (bounded, whatever the input), gives runs of equally filled bins, and Spark deals the pieces out to them.
"""

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import by_bytes, documents, record_batch, struct, written
from meterline.llm.tokens import default_vocabulary, encoder

CAPACITY = 2048


def fillings(lengths: list[int], count: dict[int, int], room: int, slack: int, budget: list[int]):
    """Undominated ways to fill ``room`` with pieces (``lengths``: distinct, descending; ``count`` of each) that waste at
    most ``slack``: all of them, larger pieces first, one by one as they are asked for.

    A filling is dominated if another piece still fits, or if a piece of it, or two, could give way to one larger piece
    (for two: as large as both) that is left and fits: what gave way would find its place where that piece was. Each step
    takes one from ``budget``; the ways end when it is spent.
    """
    up, below = lengths[::-1], [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        below[i] = below[i + 1] + lengths[i] * count[lengths[i]]

    def spare(low: int, high: int, held: Counter) -> bool:
        return any(count[b] > held[b] for b in up[bisect_left(up, low) : bisect_right(up, high)])

    def dominated(held: Counter, rest: int) -> bool:
        if spare(1, rest, held):
            return True
        for x, a in enumerate(own := sorted(held)):
            if spare(a + 1, a + rest, held):
                return True
            if any((a != b or held[a] > 1) and spare(a + b, a + b + rest, held) for b in own[x:]):
                return True
        return False

    stack: list[list[int]] = []  # place among the lengths, how many, room before
    i, rest = 0, room
    while budget[0] > 0:
        while rest - below[i] <= slack and (i := max(i, len(up) - bisect_right(up, rest))) < len(lengths):
            n = min(count[lengths[i]], rest // lengths[i])
            stack.append([i, n, rest])
            i, rest = i + 1, rest - n * lengths[i]
            budget[0] -= 1
        held = Counter({lengths[j]: n for j, n, _ in stack if n})
        if rest <= slack and not dominated(held, rest):
            yield tuple(held.elements())
        while stack and stack[-1][1] == 0:
            stack.pop()
        if not stack:
            return
        stack[-1][1] -= 1
        j, n, before = stack[-1]
        i, rest = j + 1, before - n * lengths[j]
        budget[0] -= 1


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over the histogram: (number of equal bins, lengths in each). Pieces of one length are dealt
    together to the fullest bins that still take them, so the work depends on the number of lengths."""
    rooms: dict[int, list[list]] = {}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = min((r for r in rooms if r >= size and rooms[r]), default=None)
            if room is None:
                each = capacity // size
                if full := left // each:
                    rooms.setdefault(capacity - each * size, []).append([full, (size,) * each])
                if left % each:
                    rooms.setdefault(capacity - left % each * size, []).append([1, (size,) * (left % each)])
                break
            n, held = rooms[room].pop()
            each = min(room // size, left)
            bins = min(n, left // each)
            if n > bins:
                rooms[room].append([n - bins, held])
            rooms.setdefault(room - each * size, []).append([bins, held + (size,) * each])
            left -= bins * each
    return [(n, held) for groups in rooms.values() for n, held in groups]


def complete(histogram: dict[int, int], capacity: int, steps: int = 300_000) -> list[tuple[int, tuple[int, ...]]]:
    """Bin completion by branch and bound: (number of equal bins, lengths in each).

    Around the largest piece left, each undominated filling is tried (of the first few those of least waste before the
    others), for as many bins as the counts allow, and for one. A branch is cut when its waste exceeds what the incumbent
    leaves (bins cannot be fewer than (total + waste so far) / capacity), or when the same pieces were left before after
    no more bins. The best-fit packing of what is left closes each node, and the best one stays as the incumbent.

    The search ends at the lower bound, when all is tried (then no packing is better), or after ``steps`` steps (the
    problem is NP-hard: the incumbent stands, and ``fewest possible`` isn't proven).
    """
    if not histogram:
        return []
    total = sum(k * n for k, n in histogram.items())
    least = -(-total // capacity)
    incumbent = best_fit(histogram, capacity)
    fewest = sum(n for n, _ in incumbent)
    count, budget = {k: n for k, n in histogram.items() if n}, [steps]
    seen: dict[tuple, int] = {}

    def options(waste: int):
        left = sorted((k for k, n in count.items() if n), reverse=True)
        top = left[0]
        beside = {**count, top: count[top] - 1}
        room, slack = capacity - top, (fewest - 1) * capacity - total - waste
        ways = fillings([k for k in left if k <= room and beside[k]], beside, room, slack, budget)
        some = sorted(islice(ways, 32), key=lambda f: (-sum(f), len(f)))
        for f in chain(some, ways):
            held = (top, *f)
            n = min(count[k] // m for k, m in Counter(held).items())
            yield n, held
            if n > 1:
                yield 1, held

    def take(n: int, held: tuple[int, ...]) -> None:
        for k in held:
            count[k] -= n

    stack: list[list] = [[options(0), None, 0, 0]]  # what is left to try, the run taken, waste and bins before it
    while stack and fewest > least and budget[0] > 0:
        node = stack[-1]
        if node[1]:
            take(-node[1][0], node[1][1])
            node[1] = None
        if (run := next(node[0], None)) is None:
            stack.pop()
            continue
        n, held = run
        waste, bins = node[2] + n * (capacity - sum(held)), node[3] + n
        if -(-(total + waste) // capacity) >= fewest:
            continue
        take(n, held)
        node[1] = run
        left = {k: c for k, c in count.items() if c}
        budget[0] -= len(left) + 1
        if seen.get(key := tuple(left.items()), bins + 1) <= bins:
            continue
        seen[key] = bins
        rest = best_fit(left, capacity)
        if (now := bins + sum(m for m, _ in rest)) < fewest:
            fewest, incumbent = now, [x[1] for x in stack] + rest
        if left:
            stack.append([options(waste), None, waste, bins])
    return incumbent


class Deal:
    """From (length, rank among the pieces of that length) to (sequence, offset), by runs of equally filled bins."""

    def __init__(self, runs: list[tuple[int, tuple[int, ...]]]):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter = Counter()
        first = 0
        for n, held in runs:
            at = 0
            for size, m in sorted(Counter(held).items(), reverse=True):
                by.setdefault(size, []).append((taken[size], first, m, at))
                taken[size] += n * m
                at += size * m
            first += n
        self.runs = {k: np.array(v, np.int64).T for k, v in by.items()}
        self.sequences = first

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length):
            here = np.flatnonzero(length == size)
            start, first, each, at = self.runs[int(size)]
            k = np.searchsorted(start, rank[here], side="right") - 1
            within = rank[here] - start[k]
            seq[here] = first[k] + within // each[k]
            off[here] = at[k] + within % each[k] * size
        return seq, off


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one, or pieces of ``capacity`` of which the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document's ids (``end_id`` last; null text: the end id alone), with its rank among
    the pieces of its length that the same task made. ``doc_row`` tells rows of equal doc_id apart. The ids (little-endian
    unsigned 32-bit) come along ``with_ids``; else whoever needs them cuts the document's ids at ``start``."""
    ddl = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, task_rank long, doc_row long" + (", ids binary" if with_ids else "")
    arrow = to_arrow_schema(struct(ddl))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode, seen, task = encoder(vocabulary), Counter(), TaskContext.get().partitionId()
        row = (task << 33) - 1
        for batch in batches:
            for part in by_bytes(batch, 1):
                out = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    row += 1
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + n)]
                        out.append((doc_id, k, start, n, zlib.crc32(own), task, seen[n], row, own)[: len(arrow)])
                        seen[n] += 1
                if out:
                    yield record_batch(list(map(list, zip(*out, strict=True))), arrow)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, ddl)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length, task, task_rank) and their sequence_id and offset: no sequence over ``capacity``,
    offsets without gaps, and as few sequences as the search finds.

    A piece's rank among all of its length is its rank in its task after the counts of earlier tasks, so no length,
    however common, meets in one task. Only the histogram (at most ``capacity`` rows) goes to the driver; the counts by
    length and task grow with the tasks, so they are joined by a shuffle.
    """
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "length-counts")
    histogram = {k: n for k, n in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    full = histogram.pop(capacity, 0)
    runs = complete(histogram, capacity)
    if full:
        runs.append((full, (capacity,)))
    deal = Deal(runs)
    ranked = pieces.join(counts.select("length", "task", "before").hint("merge"), ["length", "task"])
    kept = [f for f in pieces.schema.fields if f.name not in ("task", "task_rank")]
    out = ranked.select(*(f.name for f in kept), (F.col("before") + F.col("task_rank")).alias("rank"))
    ddl = ", ".join([*(f"`{f.name}` {'long' if f.name == 'length' else f.dataType.simpleString()}" for f in kept), "sequence_id long", "offset long"])
    arrow = to_arrow_schema(struct(ddl))
    at = [f.name for f in kept].index("length")

    def place(batches):
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, len(kept)))
            columns = [*b.columns[: len(kept)], *map(pa.array, deal(length, rank))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return out.mapInArrow(place, ddl)


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places. Null and empty texts are one id long; rows with equal or null ids
    are each packed (``doc_row`` tells them apart); other columns are ignored; an empty table gives no rows."""
    return pack(written(token_pieces(docs, vocabulary, end_id, capacity, with_ids), "pieces"), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens; see ``packed_documents``."""
    return packed_documents(documents(spark, sf_dir), default_vocabulary()).drop("doc_row")
