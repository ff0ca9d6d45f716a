"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.common import documents, numbered, shuffle_partitions, written

#: The golden ratio's fraction in units of 2^-31: its multiples modulo 1 in whole numbers that no product overflows.
GOLDEN, UNIT, CELLS = 1327217885, 1 << 31, 4096
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_no, source_size, target): sources by code point, null last, weigh ``weights`` in turn; together
    they take as much as there is; none more than ``most`` times its size, the excess going to the others by weight.

    Sharing again and again ends at min(weight x level, cap) for one level. With sources by cap over weight, it is
    (all - caps before) / weights from here on, at the first source that this level leaves under its cap. One row a
    source: a small table, aggregated before it is ordered.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(order) - 1
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", no)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("left", F.sum("source_size").over(every) - F.sum("cap").over(by_cap) + F.col("cap"))
    s = s.withColumn("level", F.col("left").cast("double") / F.sum("weight").over(rest).cast("double"))
    s = s.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), "source_no"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return s.select("source", "source_no", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def running(df: DataFrame, keys: list[str], block: Column, order: list, amount: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of the same keys that come before.

    In two levels, so that no key's rows meet in one task: sums within each block, and sums of the blocks' totals.
    ``block`` must grow with the order.
    """
    df = df.withColumn("_block", block)
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_block").agg(F.sum(amount).alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0))).drop("_total")
    df = df.withColumn(name, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return df.join(totals, [*keys, "_block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, rank, words): which source each slot takes a block from, and which block of it.

    Slot i takes the source in whose share of the cumulative targets the fraction of (i + 1) x the golden ratio falls.
    Each source needs ceil(target / block) blocks, the last one shorter. Slots past that need are passed over; those
    that a source lacks (a few: the sequence's discrepancy grows with the logarithm) follow at the end.
    """
    spark = targets.sparkSession
    t = targets.withColumn("take", F.floor("target").cast("long"))
    t = t.withColumn("high", F.sum("take").over(Window.orderBy("source_no")))
    t = t.withColumn("low", F.col("high") - F.col("take")).withColumn("need", F.ceil(F.col("take") / block).cast("long"))
    t = written(t, "targets")
    total, slots = t.agg(F.coalesce(F.max("high"), F.lit(0)), F.coalesce(F.sum("need"), F.lit(0))).first()
    cell = lambda word: F.floor(F.col(word) / F.lit(max(total, 1) / CELLS)).cast("int")
    point = (F.col("slot") + 1) % UNIT * GOLDEN % UNIT
    i = spark.range(slots).withColumnRenamed("id", "slot").withColumn("word", F.floor(point / F.lit(UNIT / max(total, 1))).cast("long"))
    edges = t.where("take > 0").select("source_no", "low", "high", "need", "take")
    # a source is found by the cell of the cumulative targets in which the point falls: at most CELLS + sources rows
    cells = edges.withColumn("last", F.col("high") - 1).withColumn("cell", F.explode(F.sequence(cell("low"), cell("last")))).drop("last")
    placed = i.withColumn("cell", cell("word")).join(cells, "cell").where("word >= low and word < high")
    placed = running(placed.withColumn("one", F.lit(1)), ["source_no"], F.shiftright("slot", 14), ["slot"], "one", "rank")
    placed = placed.where("rank < need").select("slot", "source_no", "rank", "need", "take")
    had = placed.groupBy("source_no").agg(F.count("*").alias("had"))
    tail = edges.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    tail = tail.withColumn("rank", F.explode(F.sequence("had", F.col("need") - 1)))
    last = F.row_number().over(Window.orderBy("rank", "source_no")) - 1  # a few rows for each source
    tail = tail.select((F.lit(slots) + last).alias("slot"), "source_no", "rank", "need", "take")
    words = F.least(F.lit(block), F.col("take") - F.col("rank") * block)
    return placed.unionByName(tail).select("slot", "source_no", "rank", words.cast("long").alias("words"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 128, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of all documents: (sized documents, plan).

    sized: doc_id, source_no, size, source_size, target, a_row (which row this is). plan: slot, source_no, rank, a_row,
    doc_id, epoch, place (in the source's stream), from_word, n_words: the runs of words, in order of slot, that make up the mix. Each source's documents, in
    the order of a hash of their ids, form a stream, repeated up to ``most`` times; a slot takes its next ``block``
    words. Nulls: a null text has size 0, a null source is a source of its own, null ids are rows like any other;
    equal rows are each taken. A text without words is never taken. An empty table gives empty results. ``row`` names a
    column that tells all rows apart; without one they are numbered here. Other columns are left out, whatever their names.
    """
    docs = docs.select("doc_id", "source", "text", (F.col(row) if row else F.monotonically_increasing_id()).alias("a_row"))
    sized = docs.select("a_row", "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = written(sized.withColumn("key", key), "sized")
    targets = written(source_targets(sized, weights, most), "source-targets")
    sized = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(sized["*"], "source_no", "source_size", "target")
    stream = sized.where("size > 0")
    # blocks of hashes: 4096 equal parts of the key's range, whatever the source
    stream = running(stream, ["source_no"], F.conv(F.substring("key", 1, 3), 16, 10).cast("int"), ["key", "text_hash", "a_row"], "size", "at")
    epochs = stream.withColumn("epoch", F.explode(F.array(*map(F.lit, range(most)))))
    epochs = epochs.withColumn("start", F.col("epoch") * F.col("source_size") + F.col("at"))
    epochs = epochs.where(F.col("start") < F.floor("target")).withColumn("end", F.col("start") + F.col("size"))
    touched = epochs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    touched = touched.select("source_no", "rank", "a_row", "doc_id", "epoch", "start", "end")
    slots = schedule(targets, block)
    j = touched.join(slots, ["source_no", "rank"])
    low, high = F.greatest("start", F.col("rank") * block), F.least("end", F.col("rank") * block + F.col("words"))
    plan = j.where(high > low).select("slot", "source_no", "rank", "a_row", "doc_id", "epoch", low.alias("place"), (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"))
    return sized, plan


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, all columns kept: each row as often as the mix takes it, the last copy of a row cut to its
    first words where the target ends within it. Rows that the mix doesn't take are gone. The rows come in the order of
    the slots in which they begin, over all partitions, so a reader that goes through the files in order meets the
    sources by their schedule. ``n_chars``, where there is such a column, follows the text."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    rows = numbered(docs.toDF(*names), [at[c] for c in ("doc_id", "source", "text")], "a_row")
    sized, plan = mix_sources(rows.select("a_row", *(F.col(at[c]).alias(c) for c in ("doc_id", "source", "text"))), row="a_row", **options)
    first_slot = F.min(F.struct("slot", "place")).alias("_at")
    copies = plan.groupBy("a_row", "epoch").agg(F.sum("n_words").cast("int").alias("n"), first_slot)
    copies = copies.join(sized.select("a_row", "size"), "a_row").select("a_row", "epoch", "size", "n", "_at")
    text = F.col(at["text"])
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("n")), "")
    out = rows.join(copies, "a_row").withColumn(at["text"], F.when(F.col("n") == F.col("size"), text).otherwise(first))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    out = out.repartitionByRange(shuffle_partitions(docs.sparkSession), "_at", "a_row").sortWithinPartitions("_at", "a_row")
    return out.select(*names).toDF(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and where the schedule puts it: its first slot (null: not taken) and how many
    runs of its words stand in slots. Rows with null ids or texts and repeated rows each get a row; see ``mix_sources``."""
    sized, plan = mix_sources(documents(spark, sf_dir))
    taken = plan.groupBy("a_row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("runs"))
    out = sized.join(taken, "a_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "size", "source_size", "target", zero("taken"), "first_slot", zero("runs"))


ORACLE_OP4 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         md5(coalesce(doc_id::varchar, '')) k from documents),
src as (
  select source, sum(size)::bigint source_size, row_number() over (order by encode(source) nulls last) - 1 no
  from sized group by source),
w as (select *, case no % 3 when 0 then 5 when 1 then 2 else 1 end weight, source_size * 3 cap from src),
lv as (
  select a.*, (select sum(source_size) from src)
    - coalesce((select sum(b.cap) from w b where b.cap / b.weight < a.cap / a.weight
                or (b.cap / b.weight = a.cap / a.weight and b.no < a.no)), 0) left_over,
    (select sum(b.weight) from w b where b.cap / b.weight > a.cap / a.weight
                or (b.cap / b.weight = a.cap / a.weight and b.no >= a.no)) weights
  from w a),
level as (
  select left_over::double / weights::double lev from lv
  where left_over::double / weights::double * weight <= cap order by cap / weight, no limit 1),
tg as (
  select source, source_size, coalesce(least(cap::double, weight * (select lev from level)), 0.0) target from w),
st as (
  select doc_id, size, s.source_size, t.target, s.no,
    sum(size) over (partition by s.source order by k, doc_id) - size a
  from sized z join src s on z.source is not distinct from s.source join tg t on t.source is not distinct from s.source),
need as (
  select no, floor(target)::bigint take, (floor(target)::bigint + 127) // 128 need,
    sum(floor(target)::bigint) over (order by no) high from src join tg using (source_size) where tg.source is not distinct from src.source),
tot as (select coalesce(max(high), 0)::bigint total, coalesce(sum(need), 0)::bigint slots from need),
point as (
  select i slot, floor(((i + 1) % 2147483648 * 1327217885 % 2147483648) / (2147483648.0::double / greatest(total, 1)))::bigint word
  from tot, range((select slots from tot)) r(i)),
hit as (
  select slot, no, need, row_number() over (partition by no order by slot) - 1 rank
  from point join need on word >= high - take and word < high),
late as (
  select no, r.rank from (select no, need, (select count(*) from hit h where h.no = n.no and h.rank < h.need) had from need n) x,
    range((select coalesce(max(need), 0) from need)) r(rank) where r.rank >= had and r.rank < need),
sched as (
  select slot, no, rank from hit where rank < need
  union all select (select slots from tot) + row_number() over (order by rank, no) - 1, no, rank from late),
run as (
  select doc_id, no, e * source_size + a lo, least(e * source_size + a + size, floor(target)::bigint) hi
  from st, range(3) r(e) where size > 0 and e * source_size + a < floor(target)::bigint),
used as (
  select doc_id, sum(least(hi, (rank + 1) * 128) - greatest(lo, rank * 128))::bigint taken, min(slot)::bigint first_slot, count(*) runs
  from run join sched on sched.no = run.no and rank >= lo // 128 and rank <= (hi - 1) // 128 group by doc_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken, first_slot, coalesce(runs, 0)::bigint runs
from st left join used using (doc_id)
"""
