"""Tables that follow a folder of logs: after any change equal to the whole history read at once."""

import random

import pytest
from logs import Log

from meterline.sources import tables
from meterline.sources import telemetry as src


def whole(spark, logs):
    return src.usage_events(src.parse_records(src.read_logs(spark, str(logs))), include_unmetered=True)


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    logs, table = tmp_path / "logs", f"file://{tmp_path}/table"
    logs.mkdir()

    def go():
        counts = tables.refresh_usage(spark, str(logs), table, include_unmetered=True)
        assert rows(tables.current(spark, table)) == rows(whole(spark, logs))
        return tuple(counts[k] for k in ("read", "kept", "gone"))

    return logs, table, go


def session(at, n=6, total=0, **state):
    log = Log(at, **state)
    for i in range(n):
        log.wait(minutes=7).spend(100 + i, total=total + 1000 * (i + 1), percent=i % 5)
    return log


def test_a_copy_in_a_later_file_counts_once_and_returns_when_the_first_goes(folder, spark):
    logs, table, go = folder
    session("2025-02-01T23:40:00").save(logs / "a.jsonl")
    session("2025-02-07T10:00:00").save(logs / "z.jsonl")
    assert go() == (2, 0, 0)
    session("2025-02-01T23:40:00", 8, effort="low").save(logs / "b.jsonl")
    assert go() == (1, 2, 0)
    assert tables.current(spark, table).where("effort = 'low'").count() == 8  # the better known copies
    (logs / "b.jsonl").unlink()
    assert go() == (0, 2, 1) and go() == (0, 2, 0)
    assert tables.current(spark, table).where("effort = 'low'").count() == 0


def test_flags_follow_a_source_over_midnight(folder):
    logs, _, go = folder
    log = Log("2025-02-01T23:59:58.800000")
    for i in range(45):
        log.wait(milliseconds=40).spend(900_000, total=900_000 * (i + 1))
    log.save(logs / "replay.jsonl")
    session("2025-02-02T08:00:00").save(logs / "s.jsonl")
    assert go() == (2, 0, 0)
    # the first half of the opening is now told better by another file, so what is left of it may prove nothing
    other = Log("2025-02-01T23:59:58.800000", effort="high")
    for i in range(30):
        other.wait(milliseconds=40).spend(900_000, total=900_000 * (i + 1))
    other.save(logs / "other.jsonl")
    assert go() == (1, 2, 0)
    (logs / "other.jsonl").unlink()
    assert go() == (0, 2, 1)


def test_random_changes(folder):
    logs, _, go = folder
    r = random.Random(11)
    for step in range(6):
        for name in r.sample("abcde", 2):
            path = logs / f"{name}.jsonl"
            if path.exists() and r.random() < 0.4:
                path.unlink()
            else:
                session(f"2025-02-0{r.randint(1, 4)}T{r.choice(['10:00', '23:30'])}:0{step % 2}", r.randint(1, 9), r.choice([0, 5]), **r.choice([{}, {"effort": "low"}])).save(path)
        go()


def test_a_job_that_dies_leaves_the_last_whole_version(folder, spark, monkeypatch):
    logs, table, go = folder
    session("2025-02-01T10:00:00").save(logs / "a.jsonl")
    go()
    before = rows(tables.current(spark, table))
    session("2025-02-01T10:00:00", effort="low").save(logs / "b.jsonl")
    write = tables.Store.write

    def dies(self, df, version, level):
        if level == "merged":
            raise RuntimeError("lost")
        return write(self, df, version, level)

    monkeypatch.setattr(tables.Store, "write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        go()
    assert rows(tables.current(spark, table)) == before
    monkeypatch.undo()
    assert go() == (1, 1, 0)


def test_only_touched_days_are_written_again(folder, spark):
    logs, table, go = folder
    for i in range(1, 6):
        session(f"2025-02-0{i}T10:00:00").save(logs / f"{i}.jsonl")
    go()
    session("2025-02-03T15:00:00").save(logs / "new.jsonl")
    go()
    store = tables.Store(spark, table)
    at = store.days(store.versions()[-1])
    assert sorted(v for v, _ in at.values()) == [1, 1, 1, 1, 2] and sorted(v for _, v in at.values()) == [1, 1, 1, 1, 2]
    session("2025-02-04T15:00:00").save(logs / "more.jsonl")
    go()
    assert store.versions() == [2, 3]
