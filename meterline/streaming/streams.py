"""Streaming forms of the incremental operators. Each takes and returns streaming (or batch) DataFrames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from meterline.operators.pricing import totals


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New ``*.jsonl`` files below ``path`` (source, value). Files are read once: writers must roll, not append."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return raw.select(F.col("_metadata.file_path").alias("source"), "value")


def stream_dedup(events: DataFrame, identity: list[str], late: str = "1 hour") -> DataFrame:
    """First row of each identity within the watermark (the batch operator keeps the best known one)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(identity)


def stream_usage(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Totals by tumbling window and model; rows later than the watermark are dropped."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "model").agg(*totals())
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in d.columns if c != "w"))


def stream_bursts(events: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of a source (a row at exactly the gap still joins the burst)."""
    d = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "source").agg(F.count("*").alias("requests"), F.sum("input").alias("input"))
    return d.select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "input")


READING = "us long, line long, used double, tokens long"
#: A key that has no reading for so long past its last one is forgotten.
IDLE_MS = 7 * 86_400_000


class HighWater(StatefulProcessor):
    """Per key: readings that wait in a list until the watermark has passed them, and the fold over those that it has.

    Nothing may still come below the watermark, so what is folded comes in the order of (us, line) whatever the batches
    and micro-batches in which it came; a timer at the latest new reading brings the fold on."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", READING)
        self.fold = handle.getValueState("fold", "high double, seen boolean, bucket long, events long, tokens long, dropping boolean, last_ms long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        latest = -1
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(list(pdf[["us", "line", "used", "tokens"]].itertuples(index=False, name=None)))
                latest = max(latest, int(pdf["us"].max()) // 1000)
        if latest >= 0:
            # a reading counts as passed once the watermark is at its millisecond or later
            self.handle.registerTimer(latest + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        passed, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(r for r in map(tuple, waiting) if r[0] // 1000 < passed)
        high, seen, bucket, events, total, dropping, last = tuple(self.fold.get()) if self.fold.exists() else (0.0, False, 0, 0, 0, False, 0)
        for us, _, used, n in ready:
            if not seen:
                dropping = abs(used) > 1e-9  # a first reading that isn't zero counts for nothing
            events, total, last = events + 1, total + n, max(last, us // 1000)
            if not seen or used > high + 1e-9:
                if not dropping:
                    out.append((*key, bucket, used - (high if seen else 0.0), events, total))
                high, seen, bucket, events, total, dropping = used, True, bucket + 1, 0, 0, False
        rest = [tuple(r) for r in waiting if r[0] // 1000 >= passed]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            self.fold.update((high, seen, bucket, events, total, dropping, last))
            self.handle.registerTimer(last + IDLE_MS)
        elif not rest and passed >= last + IDLE_MS:
            self.waiting.clear()
            self.fold.clear()
        yield pd.DataFrame(out, columns=["account", "reset_key", "bucket", "points", "events", "tokens"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def stream_high_water(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Buckets (account, reset_key, bucket, points, events, tokens) of a stream of meter readings (account, reset_key, us,
    line, used, tokens, ts), each as its new high is sure: work goes to the next reading above the key's high, as in
    ``quota.high_water_rows`` and in the same order. A reading is held for ``late``, until the watermark on ``ts`` passes
    it; one later than that is dropped. State is a key's high and its waiting readings, so it grows with ``late`` alone; a
    key is forgotten a week after its last reading. The session's state store must be RocksDB."""
    ddl = "account long, reset_key long, bucket long, points double, events long, tokens long"
    d = readings.withWatermark("ts", late).groupBy("account", "reset_key")
    return d.transformWithStateInPandas(HighWater(), ddl, "Append", "EventTime")
