"""Language identification against a naive Bayes of dictionaries, in one pass and in blocks of languages."""

import math
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import langid, queries

SF = "/root/testdata/sf0.001"
WIDE = 0xFFFFFFFF


def plain_grams(text):
    """Buckets of all n-grams, by the definition of the hash."""
    codes = [ord(c) for c in text.lower()]
    for n in langid.ORDERS:
        for i in range(len(codes) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + codes[i + k] * 0x9E3779B1 + k + 1) & WIDE
            mixed = ((h ^ (h >> 15)) * 0x2C1B3C6D) & WIDE
            yield (mixed >> 17) & (langid.BUCKETS - 1)


def plain_fit(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(plain_grams(text))
    for _, lang in rows:
        if lang is not None:
            counts[lang]  # a label without a text is a language, too
    total = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    return {lang: (lambda b, c=c, t=total[lang]: math.log((c[b] + 0.5) / t)) for lang, c in counts.items()}


def plain_predict(model, text):
    if not any(c.isalpha() for c in text or "") or not model:
        return "und", 0.0
    found = list(plain_grams(text))
    log = {lang: sum(map(p, found)) for lang, p in model.items()}
    best = max(sorted(log), key=log.get)
    return best, 1 / sum(math.exp(v - log[best]) for v in log.values())


ODD = [(9001, None, "en"), (9002, "", "en"), (9003, "12 !", "de"), (9004, "Ünï 漢字 x", None), (9005, "the the", "xx"), (9005, "the the", "xx"), (None, "no key", "en"), (9006, None, "only a label"), (9007, "z" * 3000, "zz")]


@pytest.fixture(scope="module")
def rows():
    real = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:150]
    return [(r["doc_id"], r["text"], r["lang"]) for r in real] + ODD


@pytest.fixture(scope="module")
def plain(rows):
    model = plain_fit([(t, x) for k, t, x in rows if k is None or zlib.crc32(str(k).encode()) % 4 != 2])
    return {t: plain_predict(model, t) for _, t, _ in rows}


@pytest.mark.parametrize("block", [256, 2, 1])
def test_as_plain_naive_bayes(spark, rows, plain, block):
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, `__best` string").repartition(3)
    model = langid.fit(df.where(F.coalesce(~queries.held_out(), F.lit(True))), block=block)
    got = langid.predict(df, model, keep=("doc_id", "text", "score"), block=block).collect()
    assert len(got) == len(rows) and model.languages == sorted({"de", "en", "es", "fr", "xx", "zz", "only a label"} & {x for _, _, x in rows})
    for r in got:
        want, score = plain[r.text]
        assert r.lang_pred == want and r.score == pytest.approx(score, abs=2e-3), r.text


def test_blocks_and_one_matrix_agree_when_calibrated(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    answers = []
    for block in (256, 2):
        model = langid.calibrate(df.where(queries.held_out()), langid.fit(df.where(~queries.held_out()), block=block), block=block)
        answers.append(sorted((str(r.doc_id), r.text or "", r.lang_pred, round(r.score, 6)) for r in langid.predict(df, model, keep=("doc_id", "text"), block=block).collect()))
    assert answers[0] == answers[1]


def test_all_labelled_texts_are_learnt_from(spark):
    texts = [f"text {i}" for i in range(9000)]
    model = langid.fit(spark.createDataFrame([(t, "a") for t in texts], "text string, lang string"))
    total = len(langid.grams(texts)[0]) + 0.5 * langid.BUCKETS
    assert np.exp(model.log_prob.astype(np.float64)).min() == pytest.approx(0.5 / total, rel=1e-3)
