"""Many files of which some are bad; statistics by file; evaluation strategies."""

import json
import statistics

import pytest
from pyspark.sql import functions as F

from textmill.operators import evaluate, labels
from textmill.sources import tables


def test_files_that_are_bad(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    put = lambda name, text: (folder / name).write_text(text, encoding="utf-8")
    put("one.json", json.dumps([{"k": 1, "v": 1.5}, {"k": 2, "v": 2.5, "other": [1]}]))
    put("two.json", json.dumps({"k": 3, "v": None}))
    put("broken.json", '[{"k": 9, "v": 1}, {"k": ')
    put("empty.json", "")
    put("list.json", "[]")
    put("lines.jsonl", '{"k": 4, "v": 4}\nnot json\n{"k": 5, "v": 6}\n')
    put("table.csv", 'k,v\n6,1\n7,"2"\nx,3\n')
    put("notes.txt", "no table")
    rows, bad = tables.read_files(spark, [str(folder)], "k int, v double")
    name = F.regexp_extract("file", "([^/]*)$", 1)
    got = {(r[0], r.k, r.v) for r in rows.select(name, "k", "v").collect()}
    assert got == {("one.json", 1, 1.5), ("one.json", 2, 2.5), ("two.json", 3, None), ("lines.jsonl", 4, 4.0), ("lines.jsonl", 5, 6.0), ("table.csv", 6, 1.0), ("table.csv", 7, 2.0)}
    assert {(r[0], r.reason) for r in bad.select(name, "reason").collect()} == {("broken.json", "malformed"), ("empty.json", "empty"), ("list.json", "empty"), ("lines.jsonl", "malformed"), ("table.csv", "malformed")}
    stats = {r[0]: r for r in tables.by_file(rows, ["v"]).withColumn("file", name).collect()}
    assert stats["lines.jsonl"].n == 2 and stats["lines.jsonl"].v_avg == 5.0 and stats["lines.jsonl"].v_std == pytest.approx(statistics.stdev([4, 6]))
    assert stats["two.json"].v_avg is None
    with pytest.raises(ValueError):
        tables.read_files(spark, [str(folder / "broken.json")], "k int, v double")
    with pytest.raises(ValueError):
        tables.read_files(spark, [str(folder / "notes.txt")], "k int")


def test_rounds(spark):
    steps = spark.range(7).toDF("s")
    sets = spark.createDataFrame([("b", ["x"]), ("b", ["y", "x"]), ("a", ["z"]), ("c", []), ("skip", ["w"])], "name string, types array<string>")
    got = lambda strategy: sorted((r.step, r.dataset, r.examples, tuple(r.types)) for r in evaluate.rounds(steps, "s", sets, "name", "types", strategy, ("skip",)).collect())
    known = {"a": (1, ("z",)), "b": (2, ("x", "y")), "c": (1, ()), "skip": (1, ("w",))}
    assert got("cycling") == [(i, n, *known[n]) for i, n in enumerate(["a", "b", "c", "skip", "a", "b", "c"])]
    assert got("all") == sorted((i, n, *known[n]) for i in range(7) for n in known)
    assert got("combined") == [(i, "combined", 4, ("x", "y", "z")) for i in range(7)]
    drawn = got("random")
    assert [x[0] for x in drawn] == list(range(7)) and all(x[2:] == known[x[1]] for x in drawn) and drawn == got("random")
    with pytest.raises(ValueError):
        got("other")


def test_complete(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, " ", "b"), (4, "a", "")], "k int, x string, y string")
    assert [r.k for r in labels.complete(df, ["x", "y"]).collect()] == [1]
