"""Contiguous shards of nearly equal bytes: global prefix sums from per-partition totals, cut at equal targets."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from meterline.llm.common import documents, shuffle_partitions, written


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none), and one more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def running_sums(rows: DataFrame, order: list[str], size: Column) -> DataFrame:
    """``rows`` as one struct ``row`` each, put in ``order`` by ranges, with size, part (the range), before (bytes of the
    rows before it in its range) and place (their number), as a written table.

    Rows with equal ``order`` go by the hash of all their columns; a number of the scan deals rows that are equal in
    everything (so interchangeable) to several ranges. One shuffle; a task keeps two running numbers.
    """
    every = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    d = rows.select(every.alias("row"), size.alias("size"), *keys, F.xxhash64(every).alias("same"), F.monotonically_increasing_id().alias("scan"))
    by = [*(f"k{i}" for i in range(len(order))), "same", "scan"]
    d = d.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by).select("row", "size")
    schema = StructType([d.schema["row"], *(StructField(c, LongType()) for c in ("size", "part", "before", "place"))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        part, before, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(1).to_numpy().astype(np.int64)
            upto = before + np.cumsum(sizes)
            own = [sizes, np.full(len(sizes), part), upto - sizes, place + np.arange(len(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *(pa.array(c, pa.int64()) for c in own)], schema=arrow)
            before, place = int(upto[-1]) if len(upto) else before, place + len(sizes)

    return written(d.mapInArrow(run, schema), "running")


def balanced_shards(rows: DataFrame, shards: int = 8, order: list[str] = ("doc_id",), size: Column | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each): contiguous in ``order``, cut
    where the running sum of ``size`` (default: ``text_size``) passes equal targets. A row goes where its middle byte
    lies, so each cut is off by half a row at most, and a shard by one row.

    Null keys come first; rows with equal keys, repeated rows too, each keep a place of their own; equal texts aren't
    kept together. Null and empty texts have size 1; a text longer than a target may leave a shard without rows. An
    empty table gives no rows. Columns named ``shard`` and ``slot`` are replaced, all others come back as they were.
    The driver gets one pair of totals for each range of the shuffle, never rows.
    """
    spark = rows.sparkSession
    d = running_sums(rows, list(order), text_size() if size is None else size.cast("long"))
    totals = sorted(tuple(r) for r in d.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    ends = np.cumsum([(s, n) for _, s, n in totals], axis=0, dtype=np.int64).reshape(-1, 2)
    starts = [(p, int(b) - s, int(r) - n) for (p, s, n), (b, r) in zip(totals, ends, strict=True)]
    total = int(ends[-1, 0]) if len(ends) else 1
    bases = spark.createDataFrame(starts, "part long, bytes long, rows long")  # a row for each range
    d = d.join(F.broadcast(bases), "part")
    middle = 2 * (F.col("bytes") + F.col("before")) + F.col("size")
    shard = F.least(F.lit(shards - 1), F.call_function("div", middle * shards, F.lit(2 * total)).cast("int"))
    d = d.select("row", shard.alias("shard"), (F.col("rows") + F.col("place")).alias("at"))
    first = d.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
    out = d.join(F.broadcast(first), "shard")
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")]
    return out.select(*kept, "shard", (F.col("at") - F.col("first")).alias("slot"))


def write_balanced(rows: DataFrame, folder: str, shards: int = 8, order: list[str] = ("doc_id",), size: Column | None = None) -> None:
    """The rows of ``balanced_shards`` as Parquet in ``folder``, one subfolder a shard, each file in the order of slots."""
    d = balanced_shards(rows, shards, order, size)
    by = ["shard", "slot"]
    d.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by).write.partitionBy("shard").parquet(folder)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of nearly equal bytes, in ascending ``doc_id`` order (null first), with
    the law ``bytes``: nothing is promised of rows or copies, and ``grown_shard`` is null. A null text counts as empty
    (size 1, CRC 0); rows repeated in everything get slots of their own; an empty table gives no rows; other columns are
    left out. Texts stay on the scan: only id, size and CRC are shuffled."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    d = documents(spark, sf_dir).select("doc_id", text_size().alias("size"), crc.alias("text_crc32"))
    out = balanced_shards(d, 8, ["doc_id"], F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 byte by byte: the table follows from the polynomial 0xEDB88320 by eight steps an entry.
ORACLE_OP12 = """
with recursive bits(n, c, k) as (
  select i, cast(i as ubigint), 0 from range(256) t(i) union all
  select n, case when c % 2 = 1 then xor(c // 2, cast(3988292384 as ubigint)) else c // 2 end, k + 1 from bits where k < 8),
crcs as (select list(c order by n) t from bits where k = 8),
d as (select doc_id, coalesce(strlen(text), 0) + 1 size, hex(encode(coalesce(text, ''))) h from documents),
c as (select doc_id, size, xor(cast(4294967295 as ubigint), list_reduce(
        list_prepend(cast(4294967295 as ubigint), [cast('0x' || h[2 * i + 1 : 2 * i + 2] as ubigint) for i in range(size - 1)]),
        lambda a, b: xor(a // 256, t[cast(xor(a % 256, b) as int) + 1]))) text_crc32 from d, crcs),
p as (select *, sum(size) over (order by doc_id nulls first, text_crc32 rows unbounded preceding) - size before, sum(size) over () total,
        row_number() over (order by doc_id nulls first, text_crc32) as nth from c),
s as (select *, cast(least(7, ((2 * before + size) * 8) // (2 * total)) as int) shard from p)
select doc_id, size, cast(text_crc32 as bigint) text_crc32, 'bytes' as law, shard, nth - min(nth) over (partition by shard) slot, cast(null as int) grown_shard from s"""
