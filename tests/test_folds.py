"""Queries that SQL cannot express, against plain Python on whole small tables; the hook for outside models."""

import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textmill.functions import cleaning
from textmill.functions import text as fx
from textmill.operators import annotate, evaluate, quality
from textmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sentences(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", fx.protected_sentences("text").alias("s")).collect()
    return {r.doc_id: r.s for r in rows}


def plain_segments(sentences, budget):
    done, open_, n = [], [], 0
    for s in sentences:
        size = len(re.findall(r"\S+", s))
        if open_ and n + size > budget and n > 0:
            done.append(" ".join(open_))
            open_, n = [], 0
        open_.append(s)
        n += size
    return done + ([" ".join(open_)] if open_ else [])


def test_segments(spark, sentences):
    got = Counter((r.doc_id, r.segment_index, r.content) for r in registry.queries()["segment_text"](spark, SF).collect())
    assert got == Counter((k, i, c) for k, s in sentences.items() for i, c in enumerate(plain_segments(s, 200)))


def plain_chunks(s, target=400, most=600, overlap=2, least=100):
    out, start, n = [], 0, 0
    for i, x in enumerate(s):
        end = None
        if n > 0 and n + len(x) > most:
            end, following = i - 1, max(i - overlap, start + 1)
        elif n + len(x) >= target:
            end, following = i, max(i + 1 - overlap, start + 1)
        if end is None:
            n += len(x)
        else:
            out.append((start, end))
            start = following
            n = sum(len(y) for y in s[start : i + 1])
    return out, start


def test_chunks_cover_and_overlap(spark, sentences):
    got: dict = {}
    for r in registry.queries()["chunk_overlap"](spark, SF).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append((r.start_sentence, r.end_sentence, r.text))
    for key, s in sentences.items():
        if not s:
            assert key not in got
            continue
        closed, tail = plain_chunks(s)
        mine = [(a, b) for a, b, _ in got[key]]
        # all but the last chunk, which the tail may have joined, are those of the fold; every sentence is in a chunk
        assert mine[: len(closed) - 1] == closed[: len(mine)][: len(closed) - 1]
        assert {i for a, b in mine for i in range(a, b + 1)} == set(range(len(s)))
        assert all(text == " ".join(s[a : b + 1]) for a, b, text in got[key])


def plain_greedy(found, labels):
    used, hits = set(), 0
    for f in found:
        for i, label in enumerate(labels):
            if i not in used and (f in label or label in f):
                used.add(i)
                hits += 1
                break
    if not found and not labels:
        return 0, 0, 0, 1.0, 1.0, 1.0
    p, r = hits / len(found) if found else 0.0, hits / len(labels) if labels else 0.0
    return hits, len(found) - hits, len(labels) - hits, p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_greedy_matching(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lists = docs.select("doc_id", F.array_sort(F.slice(fx.tokens("text"), 1, 6)).alias("f"), F.array_sort(F.slice(fx.tokens("text"), 4, 6)).alias("l")).collect()
    got = {r.doc_id: tuple(r)[1:] for r in registry.queries()["greedy_match_prf"](spark, SF).collect()}
    for r in lists:
        assert got[r.doc_id] == pytest.approx(plain_greedy(r.f, r.l))
    pairs = [([], []), ([], ["a"]), (["a"], []), (["ab", "b"], ["b", "abc"]), (["x", "x"], ["x"])]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, f array<string>, l array<string>")
    for r in frame.select("i", evaluate.greedy_match(F.col("f"), F.col("l")).alias("m")).collect():
        assert tuple(r.m) == pytest.approx(plain_greedy(*pairs[r.i]))


def test_model_hook_tells_errors(spark):
    def model(batch: pd.DataFrame) -> pd.Series:
        if (batch["text"] == "bad").any():
            raise ValueError("no answer")
        return batch["text"].str.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k long, text string").coalesce(1)
    got = {r.k: (r.answer, r.error) for r in annotate.applied(rows, model).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no answer"), 3: ("C", None)}
    assert annotate.applied(rows.limit(0), model).count() == 0


def test_logistic_split(spark):
    got = registry.queries()["logistic_split"](spark, "/root/testdata/sf0.01").first()
    assert 0.5 < got.accuracy <= 1 and 0 < got.f1 <= 1


def test_segments_of_one_long_sentence(spark):
    frame = spark.range(1).select(quality.segments(F.array(F.lit("a b c d"), F.lit("e")), 2).alias("s"))
    assert frame.first().s == ["a b c d", "e"]


def test_logistic_split_as_newton_finds_it(spark):
    """The likelihood has one optimum; plain Newton steps find the same figures."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = docs.select("n_chars", "text", "quality").collect()
    x = np.array([[np.log(1 + r.n_chars), len(re.findall("[#$%&*]", r.text or "")) / max(len(r.text or ""), 1)] for r in rows])
    y = np.array([float(r.quality) for r in rows])
    x = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(3), x.T @ (y - p))
    said = x @ w > 0
    tp, p, n = (said & (y == 1)).sum(), said.sum(), (y == 1).sum()
    got = registry.queries()["logistic_split"](spark, "/root/testdata/sf0.01").first()
    assert got.accuracy == pytest.approx((said == y).mean(), abs=2 / len(y))
    assert got.f1 == pytest.approx(2 * tp / (p + n), abs=0.005) and got.precision == pytest.approx(tp / max(p, 1), abs=0.005) and got.recall == pytest.approx(tp / n, abs=0.005)


def plain_light(text):
    x = " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"<[^>]+>", " ", text)))
    x = re.sub(r"(?i)-+ ?original message ?-+.*", "", x)
    for p in cleaning.LIGHT_DISCLAIMERS + cleaning.LIGHT_PROMOTIONS + cleaning.LIGHT_FORWARDS:
        x = re.sub(p, "", x)
    return re.sub(r"[ \t-\r]+", " ", x).strip(" ")


MAILS = [
    "Please send it.\n\n-----Original Message-----\nFrom: a\nTo: b", "Dear all,\n<b>see</b> below.  This e-mail is confidential and\nmore", "CLICK HERE to win. Bye\nUnsubscribe now. End", "Begin forwarded message: x\ny",
    "---- Forwarded Message ----\nFrom: z", "If you are not the intended recipient, delete it. Thanks", "Text. Confidentiality Notice: no more", "to be removed, write. rest", "visit our web site today. All rights reserved", "", "  ", "plain text", "the information contained in this email is ours",
    "special offer! only\nlimited time. more", "a < b and c > d",
]


def test_light_cleaning_of_mails(spark):
    rows = [(i, m) for i, m in enumerate(MAILS)]
    got = spark.createDataFrame(rows, "id int, t string").select("id", cleaning.clean_mail_light("t").alias("c")).collect()
    assert [(MAILS[r.id], r.c) for r in sorted(got)] == [(m, plain_light(m)) for m in MAILS]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = registry.queries()["email_clean_light"](spark, SF).collect()
    assert len(made) == len(docs) and all(r.cleaned == plain_light(docs[r.doc_id]) for r in made)
