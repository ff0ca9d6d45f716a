"""Helpers that several text operators share."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests)
    gets one of its own, and a cluster an error: executors don't see each other's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, in sorted buckets by ``key``: grouping and joining by it shuffle no more."""
    spark = df.sparkSession
    path, n = fresh_path(spark, name), shuffle_partitions(spark)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def record_batch(columns: list, ddl_schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, ddl_schema, strict=True)],
        schema=ddl_schema,
    )


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4_000_000):
    """The batch in slices whose texts (or bytes) in ``column`` come to ``most`` bytes, or one row each where longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_columns(df: DataFrame, make, ddl: str, rows: int = 256) -> DataFrame:
    """Arrow map: ``make()`` gives, once per task, a function from lists of column values to lists of output columns.

    Batches are cut to ``rows`` rows, so memory stays bounded with long texts.
    """
    arrow = to_arrow_schema(struct(ddl))

    def run(batches):
        fn = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                out = fn(*(c.to_pylist() for c in batch.slice(lo, rows).columns))
                if out is not None:
                    yield record_batch(out, arrow)

    return df.mapInArrow(run, ddl)


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; kept up to ``capacity`` words, then begun anew (this changes speed only)."""

    def __init__(self, capacity: int = 400_000):
        super().__init__()
        self.capacity = capacity

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.capacity:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8. ``bytes.lower`` and ``bytes.split``
    know ASCII only, which is just this rule."""
    return (text or "").encode().lower().split()


MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash: multiply, shift and fold."""
    h = (h ^ (h >> np.uint64(29))) * MIX[1]
    h = (h ^ (h >> np.uint64(32))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; of the whole sequence where it is shorter; none for no words."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * MIX[0] + h[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def id_text(doc_id: str = "doc_id") -> Column:
    """``doc_id`` as text; the empty text for a null id."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def remainder_is(n: int, r: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod n is r: the folds of the held-out rows."""
    return (F.crc32(id_text(doc_id).cast("binary")) % n) == r


def replace_text(docs: DataFrame, make) -> DataFrame:
    """``docs`` with a new ``text``; ``make()`` gives a function from a list of texts to a list of texts."""
    at, arrow = docs.columns.index("text"), to_arrow_schema(docs.schema)

    def run(batches):
        fn = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                columns = list(part.columns)
                columns[at] = pa.array(fn(columns[at].to_pylist()), type=arrow.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def filter_rows(docs: DataFrame, make) -> DataFrame:
    """The rows of ``docs`` for which the function that ``make()`` gives, on a list of texts, returns true."""
    at, arrow = docs.columns.index("text"), to_arrow_schema(docs.schema)

    def run(batches):
        fn = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                kept = part.filter(pa.array(fn(part.column(at).to_pylist()), pa.bool_()))
                if kept.num_rows:
                    yield pa.RecordBatch.from_arrays(kept.columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def numbered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``df`` with a long ``name`` that differs for each row and is the same whenever the result is read: the hash of
    ``columns`` where that tells all rows apart (nothing is written), else a number in a written copy of the table."""
    key = F.xxhash64(*columns)
    if df.groupBy(key.alias(name)).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return df.withColumn(name, key)
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")
