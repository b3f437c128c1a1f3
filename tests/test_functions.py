"""Functions and sources without an SQL twin: mail cleaning against plain Python, readers, sampling, rows that are null."""

import re

import pytest
from pyspark.sql import functions as F

from textmill.functions import cleaning
from textmill.functions import text as fx
from textmill.operators import chains, dedup, evaluate, extract, fuzzy, labels, places, rollup, sampling, scores
from textmill.sources import mails, tables

MAILS = [
    None, "", "short", "Subject: x\nFrom: a@b.com\n\nPlease find the figures for the third quarter in the following text.\nBest regards,\nAnn",
    "We would like to offer the ship for the voyage in question.\nDisclaimer: this is private\nAnd so on for a line.\nclick here to view it. More text follows here.",
    "The first long line of this mail has some words.\n\n-----Original Message-----\nFrom: x\nSubject: y\nold text that nobody reads any more",
    "a very long beginning of a mail that goes on and on and on\nforwarded by Bob on Monday\nthe end of it is quite long too",
    "Call 555-123-4567 or +1 (555) 123-4567 before 12:30 pm on 12/11/2001 and pay 1200 of it, see www.site.org/x and mail.example.com now",
    "\tJohn Smith@ENRON\n\t01/02/2001 10:00 AM\n\t\tto: all\n\n\t\t to: x \nThis line is what is left of this mail of old.", "visit our website for more. Thanks\nUnsubscribe here. The text goes on and on, ünïcode 12x3 too.",
]


def plain_cleaned(text, least=30):
    raw = (text or "").lower()
    x = raw
    for word, p in cleaning.CSV_LINES:
        x = re.sub(p, "", x)
    x = re.sub(cleaning.SEPARATORS, " ", x)
    for m in cleaning.FORWARD_MARKS:
        at = x.find(m)
        if at >= 0:
            x = x[:at].strip(" ") if at > 0.1 * len(x) else x
            break
    families = (cleaning.FORWARDS, cleaning.DISCLAIMERS, cleaning.PROMOTIONS, cleaning.SIGNATURES, cleaning.ATTACHMENTS, cleaning.HEADERS, cleaning.LAYOUT, cleaning.PRIVATE, (("", cleaning.BARE_URL),), cleaning.NUMBERS)
    for family in families:
        for _, p in family:
            x = re.sub(p, "", x)
    x = re.sub(r"[^a-z'\s]", " ", re.sub(r"\d+", " ", x))
    x = re.sub(r"[ \t]+", " ", " ".join(line for line in (part.strip(" ") for part in x.split("\n")) if len(line) > 10)).strip(" ")
    letters = re.sub(r"\s+", " ", re.sub(r"[^a-z'\s]", " ", raw)).strip(" ")
    return letters if len(x) < least else x


def test_full_mail_cleaning(spark):
    documents = [r.text for r in tables.table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    every = list(enumerate(MAILS + documents))
    frame = spark.createDataFrame(every, "i long, text string").select("i", cleaning.clean_mail_full("text").alias("c"))
    got = {r.i: r.c for r in frame.collect()}
    for i, text in every:
        assert got[i] == plain_cleaned(text), (i, text)


def test_greetings(spark):
    texts = ["Dear Bob, thank you. Best Regards, Ann", "Hi Ann! it's a well-known é at 12:30 on 2020-01-02; x@y.z", ""]

    def plain(x):
        for p in cleaning.GREETINGS:
            x = re.sub(p, "", x)
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s'-]", " ", x)).lower()

    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", cleaning.without_greetings("text").alias("c"))
    assert [r.c for r in frame.orderBy("i").collect()] == [plain(t) for t in texts]


def test_exact_groups_keep_null_texts(spark):
    rows = [(1, "a"), (2, None), (3, "a"), (4, None), (5, "")]
    got = {tuple(r) for r in dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id").select("doc_id", "first_id", "copies").collect()}
    assert got == {(1, 1, 2), (3, 1, 2), (2, 2, 2), (4, 2, 2), (5, 5, 1)}


def test_running_totals_and_ranks(spark):
    rows = [(i, (i * 37) % 101, 1) for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, v long, one long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r.k: (r.run_v, r.run_one) for r in rollup.running_totals(frame, [F.desc("v"), F.col("k")], ["v", "one"]).collect()}
    total = 0
    for place, (k, v, _) in enumerate(order, 1):
        total += v
        assert got[k] == (total, place)
    empty = rollup.running_totals(frame.limit(0), [F.col("v"), F.col("k")], ["v"])
    assert empty.count() == 0


def test_threshold_of_a_table(spark):
    rows = [(i / 10, int(i > 6 or i == 2)) for i in range(10)] * 2
    best = evaluate.threshold_sweep(spark.createDataFrame(rows, "score double, label int"), "score", "label").first()
    accuracy = {t: sum((s >= t) == bool(y) for s, y in rows) / len(rows) for t in sorted({s for s, _ in rows})}
    assert best.accuracy == max(accuracy.values()) and best.threshold == max(accuracy, key=lambda t: (accuracy[t], -t))


def test_stage_falls_back_to_the_least(spark):
    frame = spark.createDataFrame([(i, 5.0 if i else 1.0) for i in range(40)], "k long, score double")
    assert {r.k for r in sampling.stage(frame, "score", "k", 0.0).collect()} == {0, 1, 2, 3}
    assert {r.k for r in sampling.easiest(frame, "score", "k", 0.1, least=3).collect()} == {0, 1, 2, 3}


def test_stratified_batch(spark):
    rows = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(80)], "k long, label string")
    strata = spark.createDataFrame([("a", 1, "b"), ("a", 2, "c"), ("d", 1, "c")], "a string, place int, b string")
    got = sampling.stratified_batch(rows, "label", "k", {0: 4, 1: 3, 2: 2}, spark.createDataFrame([("a",)], "a string"), strata)
    assert {(r.label, r["count"]) for r in got.groupBy("label").count().collect()} == {("a", 4), ("b", 3), ("c", 2)}


def test_readers_and_writers(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "k long, v string")
    for suffix in ("jsonl", "csv", "parquet"):
        path = str(tmp_path / f"x.{suffix}")
        tables.write_any(frame, path)
        back = tables.read_any(spark, path, "k long, v string")
        assert {tuple(r) for r in back.collect()} == {(1, 'a "b"\nc'), (2, None)}
    (tmp_path / "y.json").write_text('[{"k": 1},\n {"k": 2}]')
    assert tables.read_any(spark, str(tmp_path / "y.json")).count() == 2
    with pytest.raises(ValueError):
        tables.read_any(spark, "x.xlsx")
    both = tables.union_all([frame, frame.select("k").withColumn("w", F.lit(1))])
    assert both.columns == ["k", "v", "w"] and both.count() == 4
    assert tables.present(frame, {"v": "text", "none": "x"}).columns == ["text"]
    assert tables.non_blank(frame, "v").count() == 1 and tables.hash_sample(frame, "k", 5).count() == 2


def test_mails_of_odd_shape(spark):
    raws = [None, "", "no header at all", "Subject: =?utf-8?q?x?=\n\nbody\n"]
    frame = spark.createDataFrame(list(enumerate(raws)), "i long, raw string")
    got = {r.i: r.m for r in frame.select("i", mails.parse_mail(F.col("raw")).alias("m")).collect()}
    assert [got[i].body for i in range(4)] == ["", "", "", "body\n"] or got[2].body in ("no header at all", "")
    assert got[0].subject is None and got[3].subject is not None


def test_chain_formats(spark):
    frame = spark.createDataFrame([([("a", "b", None, "t", "hello\nyou")],)], "chain array<struct<from:string,to:string,subject:string,timestamp:string,body:string>>")
    text = frame.select(chains.format_chain(F.col("chain")).alias("t")).first().t
    assert text == "From: a\nTo: b\nSubject: N/A\nTimestamp: t\nBody: hello\nyou"
    assert frame.select(chains.bodies(F.lit(text + "\n\n---\n\nBody: x")).alias("b")).first().b == ["hello you", "x"]
    code = 'entities.append({"text": "MV X", "type": "vessel"})\nentities.append({"text": "", "type": "y"})'
    assert [tuple(e) for e in frame.select(chains.appended_entities(F.lit(code)).alias("e")).first().e] == [("MV X", "vessel")]
    lines = chains.requests(spark.createDataFrame([(1, "hi")], "id long, prompt string"), "id", "prompt", "m").first().value
    assert lines == '{"custom_id":"1","params":{"model":"m","max_tokens":1024,"messages":[{"role":"user","content":"hi"}]}}'
    assert [x for x in frame.select(chains.split_chain(F.lit("Email 1: a0 Email 2: 1b")).alias("s")).first().s] == ["a0", "1b"]


def test_scores_of_edges(spark):
    frame = spark.createDataFrame([(1.0,), (0.0,), (0.5,)], "p double").select("p", scores.calibrated(F.col("p")).alias("s"))
    got = {r.p: (r.s, r.c) for r in frame.select("p", "s", scores.category(F.col("s")).alias("c")).collect()}
    assert got[1.0][1] == "Positive" and got[0.0][1] == "Negative" and got[0.5][1] == "Neutral"
    assert all(abs(sum(s) - 1) < 1e-12 for s, _ in got.values())
    assert frame.select(evaluate.correct(F.lit("ab"), F.lit("b")).alias("a"), evaluate.correct(F.lit(""), F.lit("b")).alias("b"), evaluate.correct(F.lit("x"), F.lit("")).alias("c")).first()[:] == (True, False, None)


def test_annotations_by_another_key(spark):
    chunks = spark.createDataFrame([(i, 100 + i, f"word{i} text") for i in range(10)], "chunk_idx long, other long, text string")
    notes = spark.createDataFrame([(9 - i, 100 + i, [f"word{i} <> x"]) for i in range(10)], "chunk_idx long, other long, entities array<string>")
    assert labels.annotated(chunks, notes, ["chunk_idx"]).count() == 0
    assert labels.annotated(chunks, notes.withColumnRenamed("chunk_idx", "c").withColumnRenamed("c", "chunk_idx"), ["chunk_idx"], also=["other"]).count() == 10


def test_place_matrix_is_bounded_and_names_are_not(spark, monkeypatch):
    monkeypatch.setattr(places, "MOST_PLACES", 2)
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 2.0, 2.0)], "n string, lat double, lon double")
    with pytest.raises(ValueError):
        places.distance_matrix(rows, "n", "lat", "lon")
    assert [r.matched for r in fuzzy.best_name(rows, "n", rows, "n").orderBy("n").collect()] == ["a", "b", "c"]


def test_substitution_and_names(spark):
    assert spark.range(1).select(fx.name_format(F.lit("  mv OCEAN-star (lng) xii o'neil wb2 7a ")).alias("n")).first().n == "MV Ocean-Star (LNG) XII O'Neil WB2 7A"
    assert spark.range(1).select(fx.valid_name(F.lit(None).cast("string")).alias("v")).first().v is False
    tokens, spans = F.split(F.lit("the MV Old ship from X"), " "), F.from_json(F.lit('[{"start":1,"end":2},{"start":5,"end":5}]'), "array<struct<start:int,end:int>>")
    made = spark.range(1).select(extract.substitute(tokens, spans, F.array(F.lit("New"), F.lit("Port of Y"))).alias("s")).first().s
    assert made.tokens == ["the", "New", "ship", "from", "Port", "of", "Y"] and [tuple(x) for x in made.spans] == [(1, 1), (4, 6)]


def test_spans_of_all_entities_from_one_pass(spark):
    """Places of several entities, against plain Python: overlaps, none across rows, and the text is cut in tokens once."""
    from textmill.operators import extract

    texts = ["of the of the", "OF", "the end, of\nThe", None, "", "la-la LA la", "of of the"]
    entities = [("of the", "pair"), ("la", "word"), ("of", "word"), ("", "none"), ("la la", "pair")]
    made = extract.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), entities)
    want = set()
    for i, text in enumerate(texts):
        tokens = [t.lower() for t in re.findall(r"\w+(?:[-_]\w+)*|\S", text or "")]
        for entity, kind in entities:
            parts = entity.split()
            want |= {(i, entity, kind, p, p + len(parts) - 1) for p in range(len(tokens)) if parts and tokens[p : p + len(parts)] == parts}
    got = [tuple(r) for r in made.collect()]
    assert set(got) == want and len(got) == len(want) > 8
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
