"""Answers are appended once each, from a folder that grows."""

import json
from datetime import timedelta

from textmill.streaming import append, ledger


def test_append_of_a_growing_folder(spark, tmp_path):
    source, target, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    line = lambda i, content: json.dumps({"custom_id": str(i), "content": content}) + "\n"
    (source / "a.jsonl").write_text(line(1, "x") + line(2, '["y", "z"]') + "not json\n")
    append.append_results(spark, str(source), str(target), str(state))
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(str(target)).select("custom_id", "content").collect())
    assert rows() == [("1", "x"), ("2", "y"), ("2", "z")]
    append.append_results(spark, str(source), str(target), str(state))  # nothing new
    assert len(rows()) == 3
    (source / "b.jsonl").write_text(line(3, "w"))
    append.append_results(spark, str(source), str(target), str(state))
    assert rows() == [("1", "x"), ("2", "y"), ("2", "z"), ("3", "w")]


def test_first_of_each_with_a_watermark(spark, tmp_path):
    source = tmp_path / "in"
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, t int").selectExpr("k", "timestamp_seconds(t) AS ts")
    frame.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(frame.schema).parquet(str(source))
    append.append_to(append.first_of_each(stream, ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def events(spark, rows):
    return spark.createDataFrame(rows, "job string, minute long, done boolean, output string").selectExpr("job", "timestamp_seconds((minute + 100000) * 60) AS at", "done", "output").coalesce(1)


def run_ledger(spark, tmp_path):
    stream = spark.readStream.schema("job string, at timestamp, done boolean, output string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append.append_to(ledger.changes(stream, timedelta(minutes=60), "5 minutes"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out")).selectExpr("job", "state", "unix_seconds(at) DIV 60 - 100000 AS minute", "output")
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    first = events(spark, [("a", 0, False, None), ("b", 1, False, None), ("b", 1, False, None), ("c", 2, True, "c.json"), ("d", 3, False, None), (None, 3, True, "x")])
    first.write.parquet(str(tmp_path / "in"))
    started = [("a", "active", 0, None), ("b", "active", 1, None), ("c", "active", 2, None), ("c", "finished", 2, "c.json"), ("d", "active", 3, None)]
    assert run_ledger(spark, tmp_path) == sorted(started, key=str)
    assert run_ledger(spark, tmp_path) == sorted(started, key=str)  # nothing new, nothing twice
    # the query is started again: a ends, c ends once more in vain, and time passes for b and d
    events(spark, [("a", 50, True, "a.json"), ("c", 51, True, "other.json"), ("e", 200, False, None)]).write.mode("append").parquet(str(tmp_path / "in"))
    ended = [("a", "finished", 50, "a.json"), ("b", "timed out", 61, None), ("d", "timed out", 63, None), ("e", "active", 200, None)]
    assert run_ledger(spark, tmp_path) == sorted(started + ended, key=str)
    events(spark, [("b", 210, True, "late.json"), ("e", 270, True, "too late"), ("f", 300, True, "f.json")]).write.mode("append").parquet(str(tmp_path / "in"))
    last = [("e", "timed out", 260, None), ("f", "active", 300, None), ("f", "finished", 300, "f.json")]
    assert run_ledger(spark, tmp_path) == sorted(started + ended + last, key=str)
    got = {r.job: r.state for r in ledger.current(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": "finished", "b": "timed out", "c": "finished", "d": "timed out", "e": "timed out", "f": "finished"}
