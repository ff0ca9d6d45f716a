"""Sinks with fixed columns, and tables that follow a folder of logs file by file."""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_table(df: DataFrame, path: str, columns: list[str], form: str = "parquet", mode: str = "errorifexists", partition_by: list[str] = ()) -> None:
    """``columns`` of ``df`` in that order as CSV with a header, JSON or Parquet; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    w = df.select(*columns).write.mode(mode).format(form)
    w = w.option("header", "true") if form == "csv" else w
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, modified): the ``*.jsonl`` files below ``paths``; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(paths)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


DAY = 86_400_000_000


class Store:
    """The versions of a refreshed table. A version is whole once its ``days-<n>`` is written to its end, which comes last;
    what a job that died left of a later one is never read and is written over by the next."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(table).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.fs.exists(self.path(self.table)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.table))]
        return sorted(int(n[5:]) for n in names if n.startswith("days-") and self.fs.exists(self.path(f"{self.table}/{n}/_SUCCESS")))

    def days(self, version: int) -> dict[int, tuple[int | None, int | None]]:
        """day -> the versions that hold its rows and its merged rows."""
        d = self.spark.read.schema("day long, rows long, merged long").parquet(f"{self.table}/days-{version}")
        return {r.day: (r.rows, r.merged) for r in d.collect()}  # a row a day

    def schema(self, version: int, level: str) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.table}/{level}-schema-{version}").first()[0]))

    def read(self, version: int, level: str, days=None) -> DataFrame:
        at = self.days(version)
        own = [(d, at[d][level == "merged"]) for d in (at if days is None else days) if d in at and at[d][level == "merged"] is not None]
        schema = self.schema(version, level)
        paths = [f"{self.table}/{level}/v={v}/_day={d}" for d, v in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, version: int, level: str) -> set[int]:
        """Writes the rows by day and tells which days have any."""
        plain = df.drop("_day")
        self.spark.createDataFrame([(plain.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.table}/{level}-schema-{version}")
        path = f"{self.table}/{level}/v={version}"
        df.write.mode("overwrite").partitionBy("_day").parquet(path)
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(path))]
        return {int(n[5:]) for n in names if n.startswith("_day=")}

    def discard(self, *names: str) -> None:
        for n in names:
            self.fs.delete(self.path(f"{self.table}/{n}"), True)


def refresh(spark: SparkSession, paths: str | list[str], table: str, extract: Callable[[DataFrame], DataFrame], settings: str, merge: Callable[[DataFrame], DataFrame] | None = None, flag: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Brings a table of logs up to date with its files, equal to ``flag(merge(extract(all lines)))``; gives how many files
    were read, kept and gone.

    ``extract`` makes rows with ``source`` (and ``us``) of (source, line, value), each file by itself; ``merge`` chooses among
    rows of the same ``us``; ``flag`` adds columns by a source's rows. Two levels are kept, both by day: the rows of all files
    and the merged ones. A refresh reads new and changed files alone; the days that they touch, now or before, are merged
    again, so a copy in a later file meets the first one, and comes back once that is deleted; the sources seen there are
    flagged again over all their days; other days stay as they are. Other ``settings`` make all anew. The last two versions
    are kept, so readers of the former one aren't cut off.
    """
    from meterline.sources.telemetry import read_logs

    store = Store(spark, table)
    kept_versions = store.versions()
    last = kept_versions[-1] if kept_versions else 0
    version = last + 1
    now = listing(spark, paths).withColumn("settings", F.lit(settings))
    same = ["path", "length", "modified", "settings"]
    files_ddl = "path string, length long, modified timestamp, settings string, days array<long>"
    old = spark.read.schema(files_ddl).parquet(f"{table}/files-{last}") if last else spark.createDataFrame([], files_ddl)
    fresh, kept = now.join(old, same, "left_anti"), now.join(old, same, "left_semi")
    counts = {"read": fresh.count(), "kept": kept.count(), "gone": old.join(now, "path", "left_anti").count()}
    if last and counts["read"] == 0 and counts["gone"] == 0:
        return counts
    lines = read_logs(spark, paths)
    if counts["kept"]:
        lines = lines.join(fresh.select(F.col("path").alias("source")), "source", "left_semi")
    rows = extract(lines)
    day = F.expr(f"us div {DAY}") if "us" in rows.columns else F.lit(0).cast("long")
    # what changed files hold now, read several times below
    rows.withColumn("_day", day).write.mode("overwrite").parquet(f"{table}/delta-{version}")
    delta = spark.read.schema(rows.withColumn("_day", day).schema).parquet(f"{table}/delta-{version}")
    own = delta.groupBy(F.col("source").alias("path")).agg(F.collect_set("_day").alias("days"))
    none = F.array().cast("array<long>")
    files = fresh.join(own, "path", "left").select(*same, F.coalesce("days", none).alias("days")).unionByName(old.join(now, same, "left_semi").select(*same, "days"))
    files.write.mode("overwrite").parquet(f"{table}/files-{version}")
    files = spark.read.schema(files_ddl).parquet(f"{table}/files-{version}")
    left = old.join(now, same, "left_anti")  # changed or gone
    in_days = lambda d: {r[0] for r in d.select(F.explode("days")).distinct().collect()}  # noqa: E731  a number a day
    touched = in_days(left) | {r[0] for r in delta.select("_day").distinct().collect()}
    before = store.read(last, "rows", touched) if last else delta.drop("_day").limit(0)
    stay = before.join(left.select(F.col("path").alias("source")), "source", "left_anti").select(*rows.columns)
    level = stay.withColumn("_day", day).unionByName(delta)
    have = store.write(level, version, "rows")
    level = spark.read.schema(rows.schema).parquet(*[f"{table}/rows/v={version}/_day={d}" for d in sorted(have)]) if have else rows.limit(0)
    merged = merge(level) if merge else level
    wide = flag(merged) if flag else merged
    redo = set(touched)
    if flag:
        seen = level.select("source").unionByName(before.select("source")).distinct()
        redo |= in_days(files.join(seen.select(F.col("source").alias("path")), "path", "left_semi")) | in_days(old.join(seen.select(F.col("source").alias("path")), "path", "left_semi"))
        rest = store.read(last, "merged", redo - touched) if last else wide.limit(0)
        merged = merged.unionByName(rest.select(*merged.columns))
        wide = flag(merged.join(seen, "source", "left_semi")).unionByName(rest.join(seen, "source", "left_anti").select(*wide.columns))
    full = store.write(wide.withColumn("_day", day), version, "merged")
    at = store.days(last) if last else {}
    at = {d: v for d, v in at.items() if d not in touched} | {d: (version, at.get(d, (None, None))[1]) for d in have}
    at = {d: (v[0], (version if d in full else None) if d in redo else v[1]) for d, v in at.items()}
    spark.createDataFrame([(d, r, m) for d, (r, m) in sorted(at.items())], "day long, rows long, merged long").write.mode("overwrite").parquet(f"{table}/days-{version}")
    # from here on the new version is the last whole one; what only versions before the former one name goes
    store.discard(f"delta-{version}")
    for v in kept_versions[:-1]:
        held = {(i, d, w[i]) for x in (at, store.days(last)) for d, w in x.items() for i in (0, 1)}
        for d, w in store.days(v).items():
            store.discard(*(f"{('rows', 'merged')[i]}/v={w[i]}/_day={d}" for i in (0, 1) if w[i] is not None and (i, d, w[i]) not in held))
        store.discard(f"days-{v}", f"files-{v}", f"rows-schema-{v}", f"merged-schema-{v}")
    return counts


def current(spark: SparkSession, table: str) -> DataFrame:
    """The merged rows of the last whole version."""
    store = Store(spark, table)
    return store.read(store.versions()[-1], "merged")


def refresh_usage(spark: SparkSession, paths: str | list[str], table: str, account: str | Column = "local", minutes: int = 10080, include_unmetered: bool = False) -> dict[str, int]:
    """``refresh`` of ``telemetry.usage_events``: ``current`` then gives what it makes of the whole history."""
    from meterline.sources import telemetry

    settings = f"usage {account} {minutes} {include_unmetered}"
    return refresh(spark, paths, table, lambda lines: telemetry.file_events(telemetry.parse_records(lines), account, minutes, include_unmetered), settings, telemetry.merge_events, telemetry.flag_events)
